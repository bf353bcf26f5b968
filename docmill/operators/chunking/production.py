"""The indexed chunk form: sections, children, payload and its validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.arrays import stage
from docmill.functions.text import content_type, nfc, slugify, strip
from docmill.operators.chunking import markdown as md
from docmill.operators.chunking import splitters as sp

STRATEGY = "hierarchical_header_recursive"
# The payload contract of an indexed chunk.
REQUIRED = ("company_code", "document_id", "document_type", "document_name", "product_line",
            "section_type", "chunk_index", "parent_section_id", "file_name", "content_hash",
            "ingestion_version")
HIERARCHY = ("chunking_strategy", "header_hierarchy", "header_path", "header_level",
             "section_heading")
NON_EMPTY = ("company_code", "document_id", "document_type", "document_name", "product_line",
             "section_type", "parent_section_id", "file_name", "content_hash",
             "ingestion_version", "chunking_strategy", "header_path", "section_heading")
DROPPED = ("source_path", "page", "page_number")


def _checked(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("child_chunk_chars must be positive.")
    if overlap < 0:
        raise ValueError("child_chunk_overlap cannot be negative.")
    if overlap >= size:
        raise ValueError("child_chunk_overlap must be smaller than chunk size.")


def _with_defaults(docs: DataFrame) -> DataFrame:
    if "file_name" not in docs.columns:
        docs = docs.withColumn("file_name", F.element_at(F.split("source_path", "/"), -1))
    if "ingestion_version" not in docs.columns:
        docs = docs.withColumn("ingestion_version", F.lit("unversioned"))
    return docs


def parent_sections(docs: DataFrame) -> DataFrame:
    """One row per heading section with its header metadata; document columns kept."""
    normal = docs.withColumn("text", nfc(F.col("text")))
    staged = stage(normal, _sections=md.header_sections(F.col("text")))
    rows = staged.select(*[c for c in docs.columns if c != "text"],
                         F.posexplode("_sections").alias("section_index", "_s"))
    titles = md.header_titles(F.col("_s.headers"))
    heading = F.coalesce(F.try_element_at(titles, F.lit(-1)), F.col("document_name"),
                         F.lit("document"))
    rows = stage(rows, header_hierarchy=titles, section_heading=heading)
    path = F.when(F.size("header_hierarchy") > 0, F.array_join("header_hierarchy", " > "))
    return rows.select(
        *[c for c in rows.columns if c not in ("_s",)],
        F.coalesce(path, "section_heading").alias("header_path"),
        F.size("header_hierarchy").alias("header_level"),
        F.concat_ws(":", "document_id", slugify(F.col("section_heading")),
                    F.col("section_index").cast("string")).alias("parent_section_id"),
        strip(F.col("_s.text")).alias("section_text")).filter("section_text <> ''")


def chunk_markdown(docs: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """Indexed chunks: sections split recursively, each with its full payload."""
    _checked(size, overlap)
    sections = parent_sections(_with_defaults(docs))
    split = sections.withColumn("_c", sp.recursive_split(F.col("section_text"), size, overlap))
    drop = ("_c", "section_text", "section_index", *DROPPED)
    rows = split.select(*[c for c in split.columns if c not in drop],
                        F.posexplode("_c").alias("chunk_index", "c"))
    rows = stage(rows, text=F.col("c.text"), content_type=content_type(F.col("c.text"))).drop("c")
    return rows.select(
        "*", F.concat(F.col("parent_section_id"), F.lit(":chunk:"),
                      F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.lit(STRATEGY).alias("chunking_strategy"),
        slugify(F.col("section_heading"), "_").alias("section_type"),
        F.col("content_type").isin("table", "mixed").alias("has_table"),
        F.sha2("text", 256).alias("content_hash"))


def payload_violations(chunks: DataFrame) -> DataFrame:
    """chunk_id with its missing, empty and invalid payload fields; valid rows drop out."""
    missing = [f for f in (*REQUIRED, *HIERARCHY) if f not in chunks.columns]

    def named(conditions: list[tuple[str, Column]]) -> Column:
        return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions]))
    present = [f for f in NON_EMPTY if f in chunks.columns]
    empty = named([(f, F.col(f).isNull() | (strip(F.col(f).cast("string")) == ""))
                   for f in present])
    checks = []
    if "chunking_strategy" in chunks.columns:
        checks.append(("chunking_strategy", F.col("chunking_strategy") != STRATEGY))
    if "header_hierarchy" in chunks.columns:
        checks.append(("header_hierarchy", F.col("header_hierarchy").isNull() | F.exists(
            "header_hierarchy", lambda h: h.isNull() | (strip(h) == ""))))
    if "header_level" in chunks.columns:
        checks.append(("header_level", F.col("header_level").isNull()
                       | (F.col("header_level") < 0)))
    invalid = named(checks) if checks else F.array().cast("array<string>")
    report = chunks.select("chunk_id", F.array(*[F.lit(m) for m in missing])
                           .cast("array<string>").alias("missing"),
                           empty.alias("empty"), invalid.alias("invalid"))
    return report.filter((F.size("missing") + F.size("empty") + F.size("invalid")) > 0)


def validated(chunks: DataFrame) -> DataFrame:
    """The chunks unchanged; the first violating row fails the job with its fields."""
    missing = [f for f in (*REQUIRED, *HIERARCHY) if f not in chunks.columns]
    if missing:
        raise ValueError("Missing payload field(s): " + ", ".join(missing))
    blank = F.concat_ws(", ", *[F.when(
        F.col(f).isNull() | (strip(F.col(f).cast("string")) == ""), F.lit(f)) for f in NON_EMPTY])
    return chunks.withColumn("chunk_id", F.when(blank == "", F.col("chunk_id")).otherwise(
        F.raise_error(F.concat(F.lit("Empty payload field(s): "), blank))))


def document_summary(chunks: DataFrame) -> DataFrame:
    """Per document: sections, chunks and chunk length statistics."""
    n = F.length("text")
    return chunks.groupBy("document_id").agg(
        F.countDistinct("parent_section_id").alias("parent_section_count"),
        F.count("*").alias("child_chunk_count"), F.min(n).alias("chunk_length_min"),
        F.max(n).alias("chunk_length_max"), F.round(F.avg(n), 2).alias("chunk_length_avg"))


def index_report(chunks: DataFrame) -> DataFrame:
    """Dry-run totals: documents, sections, chunks, distinct and repeated contents."""
    return chunks.agg(
        F.countDistinct("document_id").alias("documents"),
        F.countDistinct("parent_section_id").alias("parent_sections"),
        F.count("*").alias("chunks"),
        F.countDistinct("content_hash").alias("unique_content_hashes")).withColumn(
        "duplicate_content_hashes", F.col("chunks") - F.col("unique_content_hashes"))


def metadata_quality(chunks: DataFrame, fields=REQUIRED, optional=("plan_code",)) -> DataFrame:
    """Per field: rows where it is null, blank, and whether the field is acceptable.

    One aggregate pass over all fields, then unpivoted from its single row.
    """
    names = [f for f in (*fields, *optional) if f in chunks.columns]
    counts = chunks.agg(F.count("*").alias("total"), *[F.count_if(F.col(f).isNull())
                        .alias(f"{f}__missing") for f in names],
                        *[F.count_if(strip(F.col(f).cast("string")) == "").alias(f"{f}__blank")
                          for f in names])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col("total"),
                              F.col(f"{f}__missing").alias("missing"),
                              F.col(f"{f}__blank").alias("blank"),
                              F.lit(f in fields).alias("required")) for f in names])
    return counts.select(F.inline(rows)).withColumn(
        "is_valid", ~F.col("required") | ((F.col("missing") == 0) & (F.col("blank") == 0)))
