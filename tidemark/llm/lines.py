"""Line dedup over levelled sorted runs of line hashes.

The corpus arrives in batches.  A batch is reduced to one row per line hash
with the number of its documents that hold the line, merge-anti-joined with
the runs of hashes that already reached the threshold, and written as a sorted
run of level 0.  Whenever a level holds ``fanout`` runs they are compacted: the
counts of equal hashes are added, hashes that reach the threshold go to the
settled runs, and the rest make one sorted run of the next level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.text import SPACES, ascii_lower, text_or_empty

HASH = ["h1", "h2"]
ROW = ["r1", "r2"]
#: A hash with at least this share of all line occurrences is joined by broadcast.
#: No more than 1 / HOT_SHARE hashes can have it, whatever the corpus.
HOT_SHARE = 1e-4


def line_key(line: Column) -> Column:
    """The line without outer ASCII white space and with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hash(key: Column, name1: str, name2: str) -> list[Column]:
    return [F.xxhash64(key).alias(name1), F.xxhash64(F.lit("second"), key).alias(name2)]


class LineRuns:
    """The index: unsettled runs by level, and settled runs of frequent hashes."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 2):
        self.scratch = Scratch(spark, "line-runs")
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def _run(self, df: DataFrame, name: str) -> DataFrame:
        return self.scratch.table(df.sortWithinPartitions(*HASH), name)

    def known(self) -> DataFrame:
        """Hashes that reached the threshold so far."""
        empty = self.spark.createDataFrame([], "h1 long, h2 long")
        return reduce(DataFrame.unionByName, [r.select(*HASH) for r in self.settled], empty)

    def add(self, batch: DataFrame) -> None:
        """Take in one batch, rows (h1, h2, n)."""
        fresh = batch
        if self.settled:
            fresh = batch.join(self.known().hint("merge"), HASH, "left_anti")
        self.levels[0].append(self._run(fresh, "run"))
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        runs, self.levels[level] = self.levels[level], []
        merged = self._run(
            reduce(DataFrame.unionByName, runs).groupBy(*HASH).agg(F.sum("n").alias("n")), "merged")
        for run in runs:
            self.scratch.drop(run)
        self.settled.append(self._run(merged.where(F.col("n") >= self.min_docs), "settled"))
        if level + 1 == len(self.levels):
            self.levels.append([])
        unsettled = merged.where(F.col("n") < self.min_docs)
        unsettled._scratch_path = merged._scratch_path  # goes with the run when that is compacted
        self.levels[level + 1].append(unsettled)

    def finish(self) -> DataFrame:
        """Compact all that is left; every frequent hash is settled then."""
        self.levels = [[run for level in self.levels for run in level]]
        if self.levels[0]:
            self._compact(0)
        return self.known()


def dedup_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, fanout: int = 2,
                text: str = "text", key: str = "doc_id") -> DataFrame:
    """Drop the lines whose key stands in at least ``min_docs`` documents.

    Adds ``__n_lines``, ``__n_dropped`` and ``__kept`` to the columns of ``docs``.
    Each row is a document of its own, also where a ``doc_id`` repeats or is
    null; a line that a document repeats counts once.  A null or empty text is
    one empty line.  Lines with an empty key always stay.  A document that
    loses all lines keeps the empty text.  Extra columns pass through.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    lines = F.split(text_or_empty(text), "\n", -1)
    row_id = [F.xxhash64(F.col(key).isNull(), F.col(key), text_or_empty(text)),
              F.xxhash64(F.lit("second"), F.col(key).isNull(), F.col(key), text_or_empty(text))]
    # One row a line: where it stands and the hash of its key, never the text.
    occurs = (docs.select(row_id[0].alias("r1"), row_id[1].alias("r2"), F.posexplode(lines).alias("pos", "line"))
              .select(*ROW, "pos", line_key(F.col("line")).alias("key"))
              .where(F.length("key") > 0)
              .select(*ROW, "pos", *_hash(F.col("key"), *HASH)))
    distinct = F.array_distinct(F.transform(lines, line_key))
    staged = scratch.table(
        docs.select(row_id[0].alias("r1"), F.explode(distinct).alias("key"))
        .where(F.length("key") > 0)
        .select(F.pmod("r1", F.lit(batches)).cast("int").alias("batch"), *_hash(F.col("key"), *HASH))
        .groupBy("batch", *HASH).agg(F.count(F.lit(1)).alias("n")), "staged", ("batch",))

    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        runs.add(staged.where(F.col("batch") == batch).select(*HASH, "n"))
    frequent = runs.finish()

    total = staged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = staged.where(F.col("n") >= max(min_docs, total * HOT_SHARE)).select(*HASH).distinct()
    hot = F.broadcast(hot.join(frequent, HASH, "left_semi").withColumn("hot", F.lit(True)))
    marked = occurs.join(hot, HASH, "left")
    rare = marked.where(F.col("hot").isNull()).select(*ROW, "pos", *HASH)
    dropped = (marked.where("hot").select(*ROW, "pos")
               .unionByName(rare.join(frequent.hint("merge"), HASH, "left_semi").select(*ROW, "pos"))
               .groupBy(*ROW).agg(F.collect_set("pos").alias("__drops")))

    ided = docs.withColumns({"__r1": row_id[0], "__r2": row_id[1], "__lines": lines})
    joined = ided.join(dropped.withColumnsRenamed({"r1": "__r1", "r2": "__r2"}), ["__r1", "__r2"], "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1),
                            F.coalesce("__drops", F.array().cast("array<int>")))
    kept = F.when(F.col("__drops").isNull(), text_or_empty(text)).otherwise(
        F.array_join(F.transform(places, lambda i: F.get(F.col("__lines"), i)), "\n"))
    return joined.select(
        *docs.columns, F.size("__lines").cast("long").alias("__n_lines"),
        F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias("__n_dropped"), kept.alias("__kept"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.col("__kept"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, x AS line,
         translate(trim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
frequent AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (k) GROUP BY doc_id
"""
