"""From raw documents to packed training sequences.

The stages are applied in order; each is written as Parquet and reread as the next
one's input.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import packing, quality_knn, secret_scan, simhash, substring_dedup
from docmill.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars of the text as it is now (null stays null)."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  It learns from the labels of the documents at hand.

    Null and empty texts score the share of label 1 in training, without labels 0.5, and so
    stay as a rule; a score that equals the limit stays; each repeated row is judged for
    itself; no documents give no rows.
    """
    docs = docs.select(*COLUMNS)
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels"))
    return quality_knn.score(docs, model, name="_score").filter(F.col("_score") >= quality_knn.ACCEPT).drop("_score")


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays.

    Texts without words are copies of each other, null ones among them, so one of them
    stays; a null id is larger than any other; of rows that repeat an id and a text one
    stays; no documents give no rows.
    """
    return simhash.keep_first(docs.select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that a document with a smaller id has as well are cut out.

    Null texts stay null and texts of fewer words stay as they are; rows with the same id
    take nothing from each other; a null id is larger than any other; no documents give no
    rows.
    """
    return _measured(substring_dedup.remove(docs.select(*COLUMNS)))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked.

    Null texts stay null, empty ones empty; overlapping spans are masked as one; each
    repeated row is masked for itself; no documents give no rows.
    """
    return _measured(secret_scan.redact(docs.select(*COLUMNS)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 words: which part of which document lies where.

    Documents without words or text give a row without a sequence; longer ones come in
    pieces; a null source is a source of its own; repeated rows are packed each for
    itself, in different sequences; no documents give no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", near_distinct),
    ("substring_dedup", without_repeats),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Compression, hashing and model stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
