"""Evidence rows: mapping, citations, merging, conflicts and context budgets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.parse import clamp01
from docmill.functions.text import strip
from docmill.operators.chunking.production import REQUIRED

# Columns of a tool row that describe its origin, not its content.
ROW_METADATA = ("source_table_id", "document_id", "source_file_path", "company_code",
                "document_name")


def from_chunks(results: DataFrame, item: str = "chunk_id") -> DataFrame:
    """Retrieved chunks as evidence; a payload without its required fields is an error."""
    missing = [f for f in REQUIRED if f not in results.columns]
    if missing:
        raise ValueError("Missing payload field(s): " + ", ".join(missing))
    parent = [F.col("parent_text")] if "parent_text" in results.columns else []
    return results.select(
        *[c for c in ("query_id", "rank") if c in results.columns],
        F.lit("qdrant_chunk").alias("source_type"), F.col(item).cast("string").alias("source_id"),
        F.coalesce(*parent, F.col("text"), F.lit("")).alias("content"),
        F.to_json(F.struct(*[c for c in results.columns if c not in ("rank", "score")]))
        .alias("metadata"), clamp01(F.col("score")).alias("confidence"),
        F.lit("QdrantRetriever").alias("retrieved_by"))


def from_tool_rows(rows: DataFrame, tool: str) -> DataFrame:
    """Relational rows as evidence: content columns as "name: value" pairs."""
    content = [c for c in rows.columns if c not in ROW_METADATA]
    pairs = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(
        F.col(c).cast("string"), F.lit("None"))) for c in content])
    key = next((c for c in ("source_table_id", "id") if c in rows.columns), None)
    kept = [c for c in ROW_METADATA if c in rows.columns]
    return rows.select(
        F.lit("sqlite_row").alias("source_type"),
        (F.col(key).cast("string") if key else F.lit("unknown")).alias("source_id"),
        pairs.alias("content"),
        F.to_json(F.struct(*kept, F.lit(tool).alias("tool_name"))).alias("metadata"),
        F.lit(1.0).alias("confidence"), F.lit("DatabaseAgent").alias("retrieved_by"))


def from_profiles(rows: DataFrame) -> DataFrame:
    """User profile rows as evidence: every column is content."""
    pairs = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(
        F.col(c).cast("string"), F.lit("None"))) for c in rows.columns])
    user = F.col("user_id").cast("string") if "user_id" in rows.columns else F.lit("unknown")
    return rows.select(
        F.lit("sqlite_row").alias("source_type"), user.alias("source_id"),
        pairs.alias("content"), F.lit("{}").alias("metadata"), F.lit(1.0).alias("confidence"),
        F.lit("ProfileAdapter").alias("retrieved_by"))


def citations(evidence: DataFrame) -> DataFrame:
    """Citation columns from evidence metadata; a missing company code is an error."""
    meta = F.from_json("metadata", "company_code STRING, document_id STRING, "
                                   "document_name STRING, source_file_path STRING, "
                                   "source_table_id STRING, page STRING")
    rows = evidence.select("source_id", meta.alias("m"))
    company = F.when(F.col("m.company_code").isNotNull(), F.col("m.company_code")).otherwise(
        F.raise_error(F.lit("Missing required citation field: company_code")))
    return rows.select("source_id", company.alias("company_code"), "m.document_id",
                       "m.document_name", "m.source_file_path", "m.source_table_id", "m.page")


# --- merging -----------------------------------------------------------------------------

def dedupe(evidence: DataFrame, order: str = "ord") -> DataFrame:
    """First row per (source_type, source_id, content).

    min_by combines map-side, so a source that holds a third of all copies is
    reduced before the shuffle and never gathers in one window.
    """
    rest = [c for c in evidence.columns if c not in ("source_type", "source_id")]
    return (evidence.groupBy("source_type", "source_id", F.md5("content").alias("content_hash"))
            .agg(F.min_by(F.struct(*rest), order).alias("first"))
            .select("source_type", "source_id", "content_hash",
                    *[F.col(f"first.{c}").alias(c) for c in rest]))


def conflicts(evidence: DataFrame, order: str = "ord") -> DataFrame:
    """One row per further distinct content of a source id, beside the first one seen."""
    # a message shows the first 50 characters: only they travel
    distinct = (evidence.groupBy("source_id", F.md5("content").alias("content_hash"))
                .agg(F.min(order).alias("ord"),
                     F.min_by(F.substring("content", 1, 50), order).alias("content")))
    first = distinct.groupBy("source_id").agg(
        F.min("ord").alias("first_ord"), F.min_by("content", "ord").alias("existing"))
    rows = distinct.join(first, "source_id").filter(F.col("ord") > F.col("first_ord"))
    message = F.format_string(
        "Conflict detected for source_id '%s'. New content snippet: '%s...'. "
        "Existing content snippet: '%s...'.", F.col("source_id"),
        F.substring("content", 1, 50), F.substring("existing", 1, 50))
    return rows.select("source_id", "ord", "content_hash", message.alias("message"))


def merge(evidence: DataFrame, top_k: int | None = None, order: str = "ord",
          score: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept evidence, conflicts): dedupe, then an optional scored or plain cut."""
    if top_k is not None and top_k < 1:
        raise ValueError("top_k must be greater than zero.")
    kept = dedupe(evidence, order)
    keys = [F.desc("rerank_score"), F.col(order)] if score else [F.col(order)]
    if score:
        kept = kept.withColumn("rerank_score", score(rerank_text(F.col("content"))))
    if top_k is not None:
        kept = kept.orderBy(*keys).limit(top_k)
    return kept, conflicts(evidence, order)


def rerank_text(content: Column, payload_text: Column | None = None) -> Column:
    """Text scored for an evidence row: its content and a differing payload text."""
    body = strip(content)
    if payload_text is None:
        return body
    other = strip(F.coalesce(payload_text, F.lit("")))
    return F.when((other != "") & (other != body), strip(F.concat_ws("\n", F.when(
        body != "", body), other))).otherwise(body)


# --- context budget ---------------------------------------------------------------------------

def context_budget(contexts: DataFrame, group: Sequence[str], order: str, per_item: int = 900,
                   total: int = 4500, text: str = "text") -> DataFrame:
    """Contexts cut per item and in total; the last one that fits is truncated.

    Groups here are the few contexts of one question.
    """
    before = (Window.partitionBy(*group).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    used = F.coalesce(F.sum(F.least(F.length(text), F.lit(per_item))).over(before), F.lit(0))
    rows = contexts.withColumn("used_before", used).filter(F.col("used_before") < total)
    room = F.least(F.lit(per_item), total - F.col("used_before")).cast("int")
    return rows.withColumn(text, F.substring(F.col(text), F.lit(1), room))


def labelled_contexts(retrievals: DataFrame, limit: int = 5, case: str = "case_id") -> DataFrame:
    """Contexts in rank order (no rank comes last), cut and labelled S1..Sn."""
    place = F.coalesce(F.nullif(F.col("rank"), F.lit(0)), F.lit(999999))
    order = Window.partitionBy(case).orderBy(place, "source_path", "text")
    rows = retrievals.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)
    return rows.withColumn("citation_id", F.concat(F.lit("S"), F.col("n").cast("string"))) \
        .drop("n")
