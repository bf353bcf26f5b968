"""File sources: Markdown corpora, extraction JSON, JSON lines; and file sinks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.text import nfc, strip

EXCLUDED_MARKERS = ("benchmark", "sample", "test")

CASE_SCHEMA = (
    "id STRING, case_id STRING, question STRING, query STRING, gold_answer STRING, "
    "case_type STRING, task_type STRING, risk_level STRING, expected_behavior STRING, "
    "provider STRING, source_path STRING, benchmark_version STRING, difficulty STRING, "
    "evidence_quote STRING, expected_evidence ARRAY<STRING>, "
    "expected_sources ARRAY<STRUCT<provider STRING, source_path STRING, line_start INT, "
    "line_end INT, evidence_quote STRING, relationship STRING>>, "
    "scoring STRUCT<required_source_paths: ARRAY<STRING>>")


def _relative(root: str) -> Column:
    """Path below ``root`` of the file a row came from."""
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z0-9]+:(//)?", "")
    base = "/" + root.split("://")[-1].strip("/") + "/"
    return F.regexp_replace(F.url_decode(path), "^.*?" + re.escape(base), "")


def markdown_corpus(spark: SparkSession, root: str, limit: int | None = None,
                    preferred: Sequence[str] = (), exclude: Sequence[str] = (),
                    normalise: bool = False) -> DataFrame:
    """(source_path, provider, text) of every .md file below ``root``.

    Preferred paths come first, then path order; ``exclude`` drops paths with a
    marker; ``normalise`` composes, unifies line ends and drops blank files.
    """
    raw = (spark.read.option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.md").text(root, wholetext=True))
    rows = raw.select(_relative(root).alias("source_path"), F.col("value").alias("text"))
    if exclude:
        rows = rows.filter(~F.lower("source_path").rlike("|".join(exclude)))
    if normalise:
        rows = rows.withColumn("text", F.regexp_replace(nfc(F.col("text")), r"\r\n?", "\n")) \
            .filter(strip(F.col("text")) != "")
    rows = rows.select("source_path", F.split("source_path", "/")[0].alias("provider"), "text")
    if limit is None:
        return rows
    if limit < 1:
        raise ValueError("limit must be positive.")
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(preferred)
                                                  for x in (p, i)]), F.col("source_path"))
                      if preferred else F.lit(None).cast("int"), F.lit(1 << 30))
    return rows.orderBy(rank, "source_path").limit(limit)


def one_document(spark: SparkSession, root: str, path: str) -> DataFrame:
    return markdown_corpus(spark, root).filter(F.col("source_path") == path)


def extraction_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every extraction JSON, reports of earlier runs excluded."""
    raw = (spark.read.option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.json").text(root, wholetext=True))
    rows = raw.select(_relative(root).alias("path"), F.col("value").alias("content"))
    return rows.filter(~F.col("path").rlike("classification_output|schema_mapping"))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines by schema; blank lines are skipped, a line that is no object fails."""
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    checked = F.when(strip(F.col("value")).startswith("{"), parsed).otherwise(
        F.raise_error(F.concat(F.lit("JSONL row is not an object: "), F.substring("value", 1, 80))))
    return lines.select(checked.alias("r")).select("r.*")


def benchmark_cases(spark: SparkSession, path: str | list[str], limit: int | None = None
                    ) -> DataFrame:
    """Evaluation cases with defaults for absent fields."""
    empty = F.array().cast(T._parse_datatype_string(CASE_SCHEMA)["expected_sources"].dataType)
    rows = read_jsonl(spark, path, CASE_SCHEMA)
    out = rows.select(
        F.coalesce("case_id", "id").alias("case_id"),
        F.coalesce("question", "query", F.lit("")).alias("question"),
        F.coalesce("gold_answer", F.lit("")).alias("gold_answer"),
        F.coalesce("case_type", F.lit("")).alias("case_type"),
        F.coalesce("task_type", F.lit("")).alias("task_type"),
        F.coalesce("risk_level", F.lit("")).alias("risk_level"),
        F.coalesce("expected_behavior", F.lit("")).alias("expected_behavior"),
        F.coalesce("expected_sources", empty).alias("expected_sources"),
        F.col("scoring.required_source_paths").alias("required_source_paths"))
    return out.limit(limit) if limit else out


def production_cases(rows: DataFrame) -> DataFrame:
    """Retrieval cases: id, query and source path required; provider from the path."""
    def required(name: str) -> Column:
        value = strip(F.coalesce(F.col(name), F.lit("")))
        return F.when(value != "", value).otherwise(F.raise_error(
            F.lit(f"Benchmark case misses required field: {name}")))
    path = required("source_path")
    return rows.select(
        required("id").alias("case_id"), required("query").alias("query"),
        path.alias("source_path"), F.coalesce("provider", F.split(path, "/")[0]).alias("provider"),
        "benchmark_version", "difficulty", "task_type", "evidence_quote",
        F.coalesce("expected_evidence", F.array().cast("array<string>"))
        .alias("expected_evidence"))


# --- sinks -----------------------------------------------------------------------------------

def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested)
                       else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, sorted_columns: bool = False) -> None:
    out = _flat(df)
    if sorted_columns:
        out = out.select(*sorted(out.columns))
    out.write.mode("overwrite").option("header", True).csv(path)


def union_columns(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; columns in first-seen order, absent ones NULL."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_review_csvs(views: dict[str, DataFrame], root: str) -> None:
    for name, df in views.items():
        write_csv(df, f"{root}/{name}")
