"""LM scoring by the marginal probability of a subword lattice.

A token (a word, or the end of a text) of class k has probability

    (1 - u_k) * c_k / N_k + u_k * lattice_k(word)

where the lattice sums all segmentations of the word into pieces of a fixed
vocabulary, and the first term is the path that takes a learned word as one
piece.  The vocabulary's own scores weigh the pieces: they are ``OWN`` of each
piece's weight, whatever the corpus, and the rest are the piece's expected uses in all training
words, found by two expectation steps that start from those scores; u_k is twice the share of tokens
whose word is seen once, after Good and Turing.  Classes are the languages, and a text's probability is the
mixture over classes, so a text need not tell its language.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import pieces
from tidemark.llm.quality import kth_largest
from tidemark.llm.scratch import Scratch, small_batches
from tidemark.llm.text import byte_chunks, text_or_empty

#: The commonest words travel by broadcast, so many at most; the others are joined.
FREQUENT = 1 << 18
MAX_CLASSES = 8
STEPS = 2
FLUSH = 300_000
#: The vocabulary's own scores' part of a piece's weight.
OWN = 0.5
END = b""


def _tokens(raw: bytes) -> list[bytes]:
    """ASCII folding and splitting are what bytes.lower and bytes.split do."""
    return raw.lower().split()


def _texts(column):
    for lo, hi, data, offsets in byte_chunks(column):
        raw = data.tobytes()
        for i in range(hi - lo):
            yield lo + i, raw[offsets[i] : offsets[i + 1]]


def _counts(column: pa.Array, n_classes: int) -> np.ndarray:
    """A column of lists of one length as rows of numbers; null lists are zeros."""
    out = np.zeros((len(column), n_classes))
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy().reshape(-1, n_classes)
    return out


def word_counts(docs: DataFrame, n_classes: int) -> DataFrame:
    """(word binary, c array<long>): the training tokens by class, ends included."""
    def count(batches):
        held: list[Counter] = [Counter() for _ in range(n_classes)]

        def rows():
            for k, counter in enumerate(held):
                if counter:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()), pa.array([k] * len(counter), pa.int32()),
                                                      pa.array(list(counter.values()), pa.int64())], ["word", "k", "c"])
                    counter.clear()

        for batch in batches:
            classes = batch.column(1).to_pylist()
            for i, raw in _texts(batch.column(0)):
                counter = held[classes[i]]
                counter.update(_tokens(raw))
                counter[END] += 1
                if sum(map(len, held)) > FLUSH:
                    yield from rows()
        yield from rows()

    parts = docs.select("text", "k").mapInArrow(count, "word binary, k int, c long")
    by_class = [F.sum(F.when(F.col("k") == k, F.col("c")).otherwise(0)) for k in range(n_classes)]
    return parts.groupBy("word").agg(F.array(*by_class).alias("c"))


def learn_weights(words: DataFrame, steps: int, vocabulary, n_classes: int) -> np.ndarray:
    """Log piece weights, classes x rows, after ``steps`` expectation steps, each over all of ``words``."""
    shared = vocabulary.prior
    for _ in range(steps):
        total = _expected(words, vocabulary, n_classes, shared)
        shared = _weights(total.sum(axis=0), vocabulary)
    return _weights(total, vocabulary)


def _weights(uses: np.ndarray, vocabulary) -> np.ndarray:
    """Log weights of pieces: ``OWN`` by the vocabulary's scores, the rest by the expected uses."""
    own = np.exp(vocabulary.prior)
    own /= own.sum()
    total = uses.sum(axis=-1, keepdims=True)
    # Where nothing was learned the vocabulary's scores are all there is.
    return np.log(OWN * own + (1 - OWN) * np.where(total > 0, uses / np.maximum(total, 1e-300), own))


def _expected(words: DataFrame, vocabulary, n_classes: int, shared: np.ndarray) -> np.ndarray:
    """Expected uses of the pieces by class."""
    def expect(batches):
        total = np.zeros((len(vocabulary.strings), n_classes))
        for batch in batches:
            strings = [b" " + w for w in batch.column(0).to_pylist()]
            counts = _counts(batch.column(1), n_classes)
            keep = [i for i, s in enumerate(strings) if len(s) > 1]
            total += pieces.expected_counts(vocabulary, [strings[i] for i in keep], counts[keep], shared)
        rows = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(list(total[rows]), pa.list_(pa.float64()))], ["row", "e"])

    sums = [F.sum(F.col("e")[k]).alias(f"e{k}") for k in range(n_classes)]
    # One row per piece of the fixed vocabulary comes to the driver.
    found = words.select("word", "c").mapInArrow(expect, "row int, e array<double>").groupBy("row").agg(*sums).collect()
    total = np.zeros((n_classes, len(vocabulary.strings)))
    for row in found:
        total[:, row[0]] = row[1:]
    return total


def score(docs: DataFrame, model: str = pieces.DEFAULT_MODEL, key: str = "doc_id", text: str = "text",
          lang: str = "lang", folds: int = 5, held_out_fold: int = 1) -> DataFrame:
    """One row per row of ``docs``, columns as in ``op4_lm_score``.

    Training rows are those whose crc32(key as text) mod ``folds`` is not
    ``held_out_fold``; a null key counts as the text ``null``.  A null text is
    empty and has the end as its one token.  Repeated rows count each.  With
    no training rows all scores are those of the untrained model.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lattice-lm")
    vocabulary = pieces.load(model)
    named = docs.groupBy(lang).count().orderBy(F.desc("count"), F.asc_nulls_last(lang)).limit(MAX_CLASSES).collect()
    classes = [r[0] for r in named if r[0] is not None][: MAX_CLASSES - 1]
    n_classes = len(classes) + (len(classes) < len(named) or not classes)  # the rest, where there is any
    k = F.lit(n_classes - 1)
    for i, name in enumerate(classes):
        k = F.when(F.col(lang) == name, F.lit(i)).otherwise(k)
    held = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")) % folds == held_out_fold
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"), k.cast("int").alias("k"), held.alias("held_out"))

    words = scratch.table(word_counts(rows.where(~F.col("held_out")), n_classes), "words")
    each = [F.coalesce(F.sum(F.col("c")[i]), F.lit(0)) for i in range(n_classes)]
    once = [F.count_if((F.col("c")[i] == 1) & (F.length("word") > 0)) for i in range(n_classes)]
    docs_in = [F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("c")[i])), F.lit(0)) for i in range(n_classes)]
    facts = words.agg(F.count(F.lit(1)), *each, *once, *docs_in).first()
    distinct, by_class = facts[0], np.array(facts[1:], float).reshape(3, n_classes)
    total = int(by_class[0].sum())

    unseen = np.minimum(0.5, 2 * (by_class[1] + 1) / (by_class[0] + 2))
    share = (by_class[2] + 1) / (by_class[2].sum() + n_classes)
    total_c = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
    sized = words.withColumn("all", total_c)
    least = kth_largest(sized, "all", FREQUENT) if distinct > FREQUENT else 0
    # Words that tie with the last one stay out, so the bound holds.
    top = sized.where(F.col("all") > least).drop("all").collect()
    weights = learn_weights(words, STEPS, vocabulary, n_classes)
    strings = [bytes(r[0]) for r in top]
    frequent = {w: i for i, w in enumerate(strings)}
    top_c = np.array([r[1] for r in top], float).reshape(-1, n_classes)
    lattice = pieces.marginals(vocabulary, [b" " + w for w in strings], weights)

    def class_log10(c: np.ndarray, log_lattice: np.ndarray, ends: np.ndarray) -> np.ndarray:
        word = np.logaddexp(np.log1p(-unseen) + np.log(np.maximum(c, 1e-300) / np.maximum(by_class[0], 1)),
                            np.log(unseen) + log_lattice)
        end = np.log((c + 1) / (by_class[0] + 2))
        return np.where(ends[:, None], end, word) / np.log(10)

    def base_log10(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))

    top_log = class_log10(top_c, lattice, np.array([w == END for w in strings], bool))
    if END not in frequent:  # too few training texts for the end to be frequent
        end_c = by_class[2][None]
        frequent[END] = len(frequent)
        top_c = np.concatenate([top_c, end_c])
        top_log = np.concatenate([top_log, class_log10(end_c, np.zeros((1, n_classes)), np.array([True]))])
    tables = spark.sparkContext.broadcast((frequent, top_c.sum(axis=1), base_log10(top_c.sum(axis=1)), top_log))

    def read(batches):
        where, c, base, logs = tables.value
        get = where.get
        for batch in batches:
            out = []
            for _, raw in _texts(batch.column(1)):
                tokens = _tokens(raw)
                counter = Counter(tokens)
                counter[END] += 1
                found = np.fromiter((get(w, -1) for w in counter), np.int64, len(counter))
                times = np.fromiter(counter.values(), np.int64, len(counter))
                known = found >= 0
                at, n = found[known], times[known]
                rare = [w for w, i in zip(counter, found.tolist(), strict=True) if i < 0]
                out.append((len(tokens) + 1, int(n[c[at] > 0].sum()), float(base[at] @ n), (n @ logs[at]).tolist(), rare, times[~known].tolist()))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))],
                                             ["key", "held_out", "n_tokens", "n_known", "base", "logs", "rare", "times"])

    schema = f"key {docs.schema[key].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, logs array<double>, rare array<binary>, times array<long>"
    read_once = scratch.table(rows.select("key", "text", "held_out").mapInArrow(read, schema)
                              .withColumn("row", F.monotonically_increasing_id()), "read")
    pairs = read_once.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("row", F.col("p.rare").alias("word"), F.col("p.times").alias("n"))
    looked_up = pairs.join(words, "word", "left").select("row", "word", "n", "c")

    def judge(batches):
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            strings = [b" " + w for w in coded.dictionary.to_pylist()]
            lattice = pieces.marginals(vocabulary, strings, weights)[coded.indices.to_numpy()]
            c = _counts(batch.column(3), n_classes)
            n = batch.column(2).to_numpy()
            logs = class_log10(c, lattice, np.zeros(len(c), bool)) * n[:, None]
            all_c = c.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n * (all_c > 0)), pa.array(base_log10(all_c) * n),
                                              *(pa.array(logs[:, i]) for i in range(n_classes))],
                                             ["row", "known", "b", *(f"g{i}" for i in range(n_classes))])

    parts = looked_up.mapInArrow(judge, "row long, known long, b double, " + ", ".join(f"g{i} double" for i in range(n_classes)))
    sums = parts.groupBy("row").agg(*[F.sum(x).alias(x) for x in ("known", "b", *(f"g{i}" for i in range(n_classes)))])
    both = read_once.drop("rare", "times").join(sums, "row", "left")
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    by_k = [F.col("logs")[i] + zero(f"g{i}") + F.lit(float(np.log10(share[i]))) for i in range(n_classes)]
    best = F.greatest(*by_k) if n_classes > 1 else by_k[0]
    mixed = best + F.log10(sum((F.pow(F.lit(10.0), x - best) for x in by_k), F.lit(0.0)))
    return both.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), mixed.alias("score"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
