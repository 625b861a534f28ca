"""Quality classifier by importance resampling with Gumbel top-k.

Text is a bag of hashed n-grams: words, word starts and word pairs of one
language.  The target model is the bag of the labels' good and not toxic documents.
The raw model is a mixture of components (``KINDS``): their bags come from labelled documents,
and their shares are fitted on all documents of the corpus by expectation steps.

A document's weight is log p(text | target) - log p(text | raw), raw being the
mixture: under one bag of all raw text, what a few toxic words say would be lost in
the sum over a long text.  The k documents with the largest weight + Gumbel noise
are a sample of size k without replacement by importance.  k is the expected number of
target documents, the target's share of the raw text times the number of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.mixing import seeded_rank
from tidemark.llm.scratch import Scratch, running, small_batches
from tidemark.llm.text import byte_chunks, byte_planes, fold, from_planes, mix64, prefix_hash, span_hash, text_or_empty, word_spans

#: Cells of a language's table of n-grams, and of what travels as one row.
BITS, SLICE_BITS = 17, 15
#: The commonest languages have tables of their own, and the others one together.
MAX_GROUPS = 6
#: No more labelled rows than this, drawn by a seeded hash of the key, fit the model.
MAX_LABELS = 200_000
STARTS = (4, 6)
#: Pseudo-uses of every n-gram, in which a kind's rate is that of all kinds.
SMOOTH = np.float32(2.0)
KINDS = ("target", "toxic", "poor")
STEPS = 8
SEED = "gumbel-1"
LOGS = [f"__log_{k}" for k in KINDS]
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def features(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of every n-gram of the rows, whose languages have the numbers ``group``; A-Z folded, pairs within a row."""
    data = fold(data)
    start, end, row = word_spans(data, offsets)
    prefix = prefix_hash(data)
    word = span_hash(prefix, start, end)
    hashes, rows = [word], [row]
    for length in STARTS:
        longer = end - start > length
        hashes.append(span_hash(prefix, start[longer], start[longer] + length))
        rows.append(row[longer])
    paired = row[1:] == row[:-1]
    hashes.append(mix64(word[:-1][paired] * _PAIR + word[1:][paired]))
    rows.append(row[1:][paired])
    rows = np.concatenate(rows)
    return (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64) | group[rows].astype(np.int64) << BITS, rows


def label_sample(labels: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, kind): one row per labelled key; repeated labels: the worst holds."""
    kinds = (labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
             .groupBy(key).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
             .select(key, F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).otherwise(0).alias("kind")))
    n = kinds.count()
    if n <= limit:
        return kinds
    return kinds.where(seeded_rank(key, "labels") < int(limit / n * 0.98 * 2**60))


def group_of(docs: DataFrame, lang: str) -> tuple[Column, int]:
    """The number of a row's language group, and of groups: the commonest languages, and one for the rest."""
    named = docs.groupBy(lang).count().where(F.col(lang).isNotNull()).orderBy(F.desc("count"), lang).limit(MAX_GROUPS - 1).collect()
    group = F.lit(len(named))
    for i, row in enumerate(named):
        group = F.when(F.col(lang) == row[0], F.lit(i)).otherwise(group)
    return group.cast("int"), len(named) + 1


def _alike(text: str) -> list[Column]:
    """Two hashes that tell texts apart."""
    return [F.xxhash64(text_or_empty(text)).alias("__h1"), F.xxhash64(F.lit(1), text_or_empty(text)).alias("__h2")]


class Model:
    """Counts of n-grams in labelled documents, by kind; ``ratio``: a kind's n-grams to all kinds', by language."""

    def __init__(self, counts: np.ndarray, n_groups: int):
        cells, n = n_groups << BITS, len(KINDS)
        table, self.labelled = counts[: n * cells].reshape(n, cells), counts[n * cells :]
        totals = table.reshape(n, n_groups, -1).sum(axis=2, dtype=np.float64).astype(np.float32)
        self.labelled = self.labelled.copy()  # no view, which would hold all counts
        self.all, self.logs = table.sum(axis=0), np.log(table + SMOOTH)
        self.ratio = totals / np.maximum(totals.sum(axis=0), 1)

    def log_rates(self, cell: np.ndarray):
        """Each kind's log rates of n-grams over those of all kinds."""
        everywhere = self.all[cell]
        for k in range(len(KINDS)):
            yield self.logs[k][cell] - np.log(everywhere * self.ratio[k][cell >> BITS] + SMOOTH)


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, group: Column, n_groups: int, limit: int) -> Model:
    """Count the n-grams of labelled documents by kind; of texts alike with one kind the one of the least key counts."""
    n, cells = len(KINDS), n_groups << BITS
    size = n * cells + n

    def count(batches):
        total = np.zeros(size, np.uint32)
        for batch in batches:
            kind, group = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy()
            total[n * cells :] += np.bincount(kind, minlength=n).astype(np.uint32)
            for lo, hi, data, offsets in byte_chunks(batch.column(0)):
                cell, row = features(data, offsets, group[lo:hi])
                np.add.at(total, kind[lo:hi][row] * cells + cell, 1)
        at = np.flatnonzero(total)
        cuts = np.flatnonzero(np.diff(at >> SLICE_BITS)) + 1
        parts = np.split(at, cuts) if len(at) else []
        bodies = [byte_planes((p & ((1 << SLICE_BITS) - 1)).astype(np.uint16)) + byte_planes(total[p]) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array([int(p[0]) >> SLICE_BITS for p in parts], pa.int32()), pa.array([len(p) for p in parts], pa.int32()), pa.array(bodies, pa.binary())], ["slice", "n", "body"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, m, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = body.as_buffer()
                held.setdefault(k, np.zeros(1 << SLICE_BITS, np.int64))[from_planes(raw, np.uint16, m)] += from_planes(raw[2 * m :], np.uint32, m)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.astype("<f4").tobytes() for v in held.values()], pa.binary())], ["slice", "counts"])

    alike = _alike(text)
    sample = F.broadcast(label_sample(labels, key, limit))  # at most ``limit`` rows of two numbers
    once = (docs.select(key, *alike).join(sample, key).groupBy("__h1", "__h2", "kind").agg(F.min(key).alias(key))
            .select(key, "__h1", "__h2", F.col("kind").cast("int").alias("kind")))
    chosen = docs.select(key, *alike, F.col(text).alias("t"), group.alias("group")).join(F.broadcast(once), [key, "__h1", "__h2"]).select("t", "kind", "group")
    # The table's cells come to the driver, as many whatever the input.
    with running(docs.sparkSession):
        found = (chosen.mapInArrow(count, "slice int, n int, body binary").repartition(-(-size >> SLICE_BITS), "slice")
                 .mapInArrow(add, "slice int, counts binary").collect())
    counts = np.zeros(-(-size >> SLICE_BITS) << SLICE_BITS, np.float32)
    for k, body in found:
        counts[k << SLICE_BITS : (k + 1) << SLICE_BITS] = np.frombuffer(body, "<f4")
    return Model(counts[:size], n_groups)


def score(docs: DataFrame, model, text: str, group: Column) -> DataFrame:
    """``docs`` with ``__n_features`` and each kind's log probability of the text over that of all kinds (``LOGS``); a text without words has 0."""
    names, where = docs.columns, docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("__n_features", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in LOGS)])

    def run(batches):
        arrow, m = to_arrow_schema(schema), model.value
        for batch in batches:
            group = batch.column(len(names)).to_numpy()
            n, logs = np.zeros(batch.num_rows, np.int64), np.zeros((len(KINDS), batch.num_rows))
            for lo, hi, data, offsets in byte_chunks(batch.column(where)):
                cell, row = features(data, offsets, group[lo:hi])
                n[lo:hi] = np.bincount(row, minlength=hi - lo)
                for k, rates in enumerate(m.log_rates(cell)):
                    logs[k, lo:hi] = np.bincount(row, rates, hi - lo)
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[: len(names)], list(arrow), strict=False)), pa.array(n), *map(pa.array, logs)], schema=arrow)

    return docs.withColumn("__group", group).mapInArrow(run, schema)


def _raw(share: list[float]) -> Column:
    """The log probability of a text under the mixture of raw text, over that of all kinds in one bag."""
    parts = [F.col(x) + F.lit(float(np.log(s + 1e-12))) for x, s in zip(LOGS, share, strict=True)]
    best = F.greatest(*parts)
    return best + F.log(sum((F.exp(p - best) for p in parts), F.lit(0.0)))


def shares(logs: DataFrame, start: list[float], steps: int = STEPS) -> tuple[list[float], float]:
    """(shares of the kinds in all documents, expected number of target documents), by expectation steps from ``start``."""
    share, n = start, 0.0
    for _ in range(steps):
        raw = _raw(share)
        posterior = [F.coalesce(F.sum(F.exp(F.col(x) + F.lit(float(np.log(s + 1e-12))) - raw)), F.lit(0.0)) for x, s in zip(LOGS, share, strict=True)]
        sums = logs.agg(*posterior).first()
        total = sum(sums) or 1.0
        new, n = [x / total for x in sums], sums[0]
        done = max(abs(a - b) for a, b in zip(new, share, strict=True)) < 1e-4
        share = new
        if done:
            break
    return share, n


def gumbel(key: str, seed: str = SEED) -> Column:
    """Standard Gumbel noise of the key; reruns agree."""
    u = (seeded_rank(key, seed).cast("double") + 0.5) / float(2**60)
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest of finite numbers, by narrowing histograms; the driver sees ``bins`` counts a round."""
    lo, hi = values.agg(F.min(column), F.max(column)).first()
    above = 0  # values over hi
    while True:
        width = (hi - lo) / bins
        if not width or lo + width <= lo:
            return lo
        edge = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).alias("bin")
        counts = dict(values.where(F.col(column).between(lo, hi)).groupBy(edge).count().collect())
        for b in sorted(counts, reverse=True):
            if above + counts[b] >= k:
                break
            above += counts[b]
        # The exact ends of the bin's values keep the count above right.
        lo, hi = values.where(F.col(column).between(lo, hi) & (edge == b)).agg(F.min(column), F.max(column)).first()
        if counts[b] == 1 or above + counts[b] == k:
            return lo


class Sample:
    """What the sample takes: ``logs`` has a row a document, ``weigh`` adds its weight and key, ``least`` is the key of the last one.

    The model is gone from driver and executors once ``logs`` is written.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, limit: int, seed: str):
        self.scratch = Scratch(docs.sparkSession, "quality")
        self.key, self.seed = key, seed
        self.group, n_groups = group_of(docs, lang)
        model = fit(docs, labels, key, text, self.group, n_groups, limit)
        labelled, sent = model.labelled, docs.sparkSession.sparkContext.broadcast(model)
        del model
        self.logs = self.scratch.table(score(docs.select(key, text, lang, *_alike(text)), sent, text, self.group).select(
            key, "__h1", "__h2", "__n_features", *LOGS), "logs")
        sent.destroy()
        self.share, self.least = [1.0] + [0.0] * (len(KINDS) - 1), None
        if labelled.sum():
            self.share, expected = shares(self.logs, (labelled / labelled.sum()).tolist())
            k = round(expected)
            # No document is a target's: the sample is empty.
            self.least = kth_largest(self.weigh(self.logs), "__key", k) if k else float("inf")

    def weigh(self, logs: DataFrame) -> DataFrame:
        weight = F.col(LOGS[0]) - _raw(self.share)
        return logs.withColumn("__log_weight", weight).withColumn("__key", F.col("__log_weight") + gumbel(self.key, self.seed)).drop(*LOGS)

    def taken(self, weighed: DataFrame) -> DataFrame:
        return weighed if self.least is None else weighed.where(F.col("__key") >= F.lit(self.least))


def select(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = MAX_LABELS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` that the sample takes, with ``__n_features``, ``__log_weight`` and ``__key`` added.

    Rows of equal key and text are taken or left together, and ties at the
    k-th place are all taken.  Null keys share one noise value; null languages belong to the rest.  Null and empty texts weigh
    0, so they are taken where most documents are good.  Without labelled
    rows every row is taken.  Each text is weighed once, and the rows that stay are found by key and text.
    """
    sample = Sample(docs, labels, key, text, lang, limit, seed)
    chosen = sample.taken(sample.weigh(sample.logs)).distinct().withColumnRenamed(key, "__id")
    hashed = docs.withColumns({f"__r{i}": c for i, c in enumerate(_alike(text))})
    on = hashed[key].eqNullSafe(chosen["__id"]) & (F.col("__r0") == F.col("__h1")) & (F.col("__r1") == F.col("__h2"))
    return hashed.join(chosen, on).select(*[hashed[c] for c in docs.columns], "__n_features", "__log_weight", "__key")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    sample = Sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text", "lang", MAX_LABELS, SEED)
    return sample.taken(sample.weigh(sample.logs)).select(
        "doc_id", F.col("__n_features").alias("n_features"), F.col("__log_weight").alias("log_weight"), F.col("__key").alias("gumbel_key"))
