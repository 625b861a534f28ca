"""The corpus pipeline: five operators of ``tidemark.llm`` one after another.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.jaccard import near_duplicates
from tidemark.llm.lines import dedup_lines
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.quality import select
from tidemark.llm.scratch import Scratch, small_batches
from tidemark.llm.sentencepieces import encode

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the importance sample takes."""
    small_batches(spark)
    return select(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that at least ten documents hold; n_chars follows the text.

    A document that loses all of its lines stays with the empty text.
    """
    small_batches(spark)
    kept = dedup_lines(docs.select(*COLUMNS))
    return kept.withColumns({"text": F.col("__kept"), "n_chars": F.length("__kept").cast("long")}).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near duplicates: that of the least doc_id.

    Texts without words are near duplicates of nothing and stay.  Of rows that
    repeat a doc_id with its text one stays.
    """
    small_batches(spark)
    found = near_duplicates(docs.select("doc_id", "text"))
    # The operator gives ids only; the rows that stay are looked up by id.
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component"))).select("doc_id").distinct()
    keep = docs.select(*COLUMNS).join(first, docs["doc_id"].eqNullSafe(first["doc_id"]), "left_semi")
    return keep.dropDuplicates(["doc_id", "text"]) if _repeats(docs) else keep


def _repeats(docs: DataFrame) -> bool:
    return bool(docs.groupBy("doc_id").count().where("count > 1").head(1))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every document as often as its source's target asks."""
    small_batches(spark)
    return mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each taken document; repeats give a row each."""
    small_batches(spark)
    return encode(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_pieces", "score", "second_score", "ids_sha256", "nbest_sha256", "decoded_sha256", "round_trip")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near), ("mixing", mixing), ("sentencepiece", pieces)]

#: The quality sample, the near duplicates of 5-word shingles over its result and the
#: piece lattice are not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
