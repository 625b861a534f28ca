"""Mixing sources to target weights by capped water-filling.

Every source gets its share of the total size by weight, but no more than
``max_epochs`` times its own size.  What the capped sources leave is reshared
among the others by weight until none is above its cap.  A source whose target
is e epochs takes each document floor(e) times and once more for a seeded
sample of documents that fills the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.text import n_words

SEED = "mix-1"


def seeded_rank(key: str, seed: str = SEED) -> Column:
    """60 pseudo-random bits of the key; reruns and other engines agree."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def water_level(sources: DataFrame) -> float:
    """The level L at which targets least(cap, weight * L) use up the total.

    ``sources`` has one row per source: (size, weight, cap).  Each round is one
    aggregate over it; the driver sees four numbers a round.
    """
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("cap") < F.col("weight") * F.lit(level)
        total, fixed, free = sources.agg(
            F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        if not free:
            return level or 0.0
        new = (total - fixed) / free
        if level is not None and new <= level:
            return level
        level = new


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = SEED,
        source: str = "source", key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, size, source_size, target, taken, repeats.

    With ``carry`` a struct column ``row`` holds the whole input row as well.

    Sources in code-point order, null last, get ``weights`` in turn.  Null and
    empty texts have size 0 and are never taken.  Rows that repeat a key share
    its place in the seeded order and are judged each by its own size.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    # Null is a source of its own: (true, '') can be joined on, null can't.
    sized = scratch.table(docs.select(
        F.col(key), F.col(source).isNull().alias("s_null"), F.coalesce(source, F.lit("")).alias("s"),
        n_words(F.col(text)).alias("size"), seeded_rank(key, seed).alias("u"),
        *([F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if carry else [])), "sized")
    by = ["s_null", "s"]
    fine = scratch.table(sized.groupBy(*by, F.shiftright("u", 36).alias("b24")).agg(F.sum("size").alias("size")), "fine")
    coarse = fine.groupBy(*by, F.shiftright("b24", 12).alias("b12")).agg(F.sum("size").alias("size"))
    totals = coarse.groupBy(*by).agg(F.sum("size").alias("size"))
    # One row per source reaches this window, none per document.
    place = F.row_number().over(Window.orderBy("s_null", "s")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = scratch.table(totals.select(*by, "size", weight.alias("weight"), (F.col("size") * max_epochs).alias("cap")), "sources")
    level = water_level(sources)
    wanted = F.col("weight") * F.lit(float(level))
    target = F.when(F.col("cap") < wanted, F.col("cap").cast("double")).otherwise(wanted)
    plan = sources.select(*by, F.col("size").alias("source_size"), target.alias("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))

    # Running sizes in seeded order, in three steps of bounded windows.
    before = lambda order: Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    w12, w24 = before("b12").partitionBy(*by), before("b24").partitionBy(*by, "b12")
    coarse = coarse.select(*by, "b12", F.coalesce(F.sum("size").over(w12), F.lit(0)).alias("base12"))
    base = (fine.withColumn("b12", F.shiftright("b24", 12))
            .select(*by, "b12", "b24", F.coalesce(F.sum("size").over(w24), F.lit(0)).alias("base24"))
            .join(coarse, [*by, "b12"]).select(*by, "b24", (F.col("base12") + F.col("base24")).alias("base")))
    run = F.sum("size").over(Window.partitionBy(*by, "b24").orderBy("u", key))
    placed = sized.withColumn("b24", F.shiftright("u", 36)).withColumn("run", run).join(base, [*by, "b24"])
    extra = 2 * (F.col("base") + F.col("run")) - F.col("size") <= 2 * F.col("need")
    repeats = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("whole") + extra.cast("int")).cast("long")
    return placed.join(plan, by).select(
        key, "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"),
        *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it."""
    taken = mix(docs, carry=True, **options).where(F.col("repeats") > 0)
    copies = F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))
    return taken.select("row", copies.alias("copy")).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("repeats")


ORACLE = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15) AS BIGINT) AS u
  FROM documents),
src AS (
  SELECT source, size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 3 * size AS cap
  FROM (SELECT source, sum(size)::BIGINT AS size FROM sized GROUP BY source)),
step(k, lvl) AS (
  SELECT 0, (SELECT sum(size)::DOUBLE / sum(weight)::DOUBLE FROM src)
  UNION ALL
  SELECT k + 1, (SELECT (sum(size) - coalesce(sum(cap) FILTER (WHERE cap < weight * lvl), 0))::DOUBLE
                      / (sum(weight) FILTER (WHERE NOT cap < weight * lvl))::DOUBLE FROM src)
  FROM step WHERE k < 12),
plan AS (
  SELECT source, size AS source_size, CASE WHEN cap < weight * lvl THEN cap::DOUBLE ELSE weight * lvl END AS target
  FROM src, (SELECT max(lvl) AS lvl FROM step)),
run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u, doc_id) AS upto FROM sized)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE size * (floor(target / source_size)
         + CASE WHEN 2 * upto - size <= 2 * (target - floor(target / source_size) * source_size) THEN 1 ELSE 0 END) END)::BIGINT AS taken
FROM run JOIN plan ON run.source IS NOT DISTINCT FROM plan.source
"""
