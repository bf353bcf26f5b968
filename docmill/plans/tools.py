"""Parameterised relational query tools over the domain tables.

Every tool composes one lazy plan: optional predicates are applied to the
narrowest table they touch before any join, the lineage dimensions are joined
with only the columns the result needs, and ORDER BY + LIMIT ends in a
TakeOrderedAndProject.  Rows equal on the documented sort keys are ordered by
their remaining columns, so a limited result is deterministic.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.catalog import DOMAIN_DDL, SUMMARY_TABLES, Catalog

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# The wordings that mark an exclusion clause.
EXCLUSION_TERMS = ("loại trừ", "không chi trả", "không được bảo hiểm", "exclusion")


# --- helpers ---------------------------------------------------------------

def clamp_limit(value, default: int = 50, maximum: int = 200) -> int:
    return default if value is None else max(1, min(int(value), maximum))


def like(column: Column, keyword: str) -> Column:
    """``%keyword%`` with ASCII-only case folding; % and _ stay wildcards."""
    folded = keyword.strip().translate(str.maketrans(UPPER, LOWER))
    pattern = "%" + folded.replace("\\", "\\\\") + "%"
    return F.translate(column, UPPER, LOWER).like(pattern)


def any_like(keyword: str, *columns: str) -> Column:
    return functools.reduce(Column.__or__, [like(F.col(c), keyword) for c in columns])


def any_of(keywords: Sequence[str], *columns: str) -> Column:
    """Does any column hold any keyword?  Texts are folded once for all plain keywords."""
    plain = [k for k in keywords if not set(k) & set("%_\\")]
    tests = [like(F.col(c), k) for k in keywords if k not in plain for c in columns]
    if plain:
        folded = "|".join(rf"\Q{k.strip().translate(str.maketrans(UPPER, LOWER))}\E" for k in plain)
        tests += [F.translate(F.col(c), UPPER, LOWER).rlike(folded) for c in columns]
    return functools.reduce(Column.__or__, tests)


def ranked(df: DataFrame, keys: Sequence[str], output: Sequence[str], limit: int) -> DataFrame:
    """Sort by the documented keys, then by the output columns, and cut."""
    rest = [c for c in output if c not in keys]
    return df.orderBy(*keys, *rest).limit(limit).select(*output)


def _documents(db: Catalog, company_code: str | None = None,
               company_codes: Sequence[str] | None = None) -> DataFrame:
    companies = db["companies"].select(
        F.col("id").alias("company_id"), F.col("code").alias("company_code"),
        F.col("name").alias("company_name"))
    if company_code:
        companies = companies.filter(F.col("company_code") == company_code)
    if company_codes:
        companies = companies.filter(F.col("company_code").isin(list(company_codes)))
    documents = db["documents"].select(
        F.col("id").alias("document_id"), "company_id", "document_name")
    return documents.join(companies, "company_id").drop("company_id")


def _with_lineage(fact: DataFrame, db: Catalog, company_code: str | None = None,
                  company_codes: Sequence[str] | None = None) -> DataFrame:
    sources = db["source_tables"].select(
        F.col("id").alias("source_table_id"), F.col("file_path").alias("source_file_path"))
    return (fact.join(_documents(db, company_code, company_codes), "document_id")
                .join(sources, "source_table_id"))


def _plans(db: Catalog) -> DataFrame:
    return db["plan_types"].select(
        F.col("id").alias("plan_type_id"), F.col("raw_name").alias("plan_name"),
        F.col("normalized_code").alias("plan_code"), "plan_level")


LINEAGE = ["source_table_id", "document_id", "source_file_path", "company_code",
           "company_name", "document_name"]


# --- catalogue and free SQL ---------------------------------------------------

def list_tables(db: Catalog) -> list[str]:
    return sorted(db)


def get_schema(db: Catalog, table_names: Sequence[str]) -> list[str]:
    """A CREATE TABLE text per requested table, or a placeholder comment."""
    out = []
    for name in table_names:
        if name in db:
            columns = ",\n  ".join(
                f"{f.name} {f.dataType.simpleString().upper()}" for f in db[name].schema)
            out.append(f"CREATE TABLE {name} (\n  {columns}\n)")
        else:
            out.append(f"-- Schema not found for table: {name}")
    return out


def run_ddl(spark: SparkSession, script: str) -> int:
    """Run the statements of a DDL script in order; returns how many ran."""
    statements = [s.strip() for s in script.split(";") if s.strip()]
    for statement in statements:
        spark.sql(statement)
    return len(statements)


def execute_query(db: Catalog, query: str) -> DataFrame:
    """Run one read-only statement.

    Besides the leading keyword the parsed plan is inspected, so a write that
    hides behind WITH is rejected as well.
    """
    text = query.strip()
    head = text.upper()
    if not head.startswith(("SELECT", "WITH", "EXPLAIN QUERY PLAN")):
        raise ValueError("Security Error: Only SELECT queries are allowed.")
    spark = db.spark
    db.register_views(text)
    explain = head.startswith("EXPLAIN QUERY PLAN")
    if explain:
        text = text[len("EXPLAIN QUERY PLAN"):].strip()
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    nodes = [parsed]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getName()
        if ".command." in kind or node.nodeName().startswith(
                ("InsertInto", "Create", "Drop", "Delete", "Update", "Merge", "Replace")):
            raise ValueError("Security Error: Only SELECT queries are allowed.")
        children = node.children()
        nodes.extend(children.apply(i) for i in range(children.size()))
    return spark.sql("EXPLAIN " + text if explain else text)


def database_summary(db: Catalog) -> DataFrame:
    counts = [
        db[name].agg(F.count(F.lit(1)).alias("row_count"))
                .select(F.lit(name).alias("table_name"), "row_count")
        for name in SUMMARY_TABLES
    ]
    return functools.reduce(DataFrame.unionByName, counts)


# --- listings -------------------------------------------------------------------

def list_companies(db: Catalog) -> DataFrame:
    """Each company with its document and plan counts.

    Both fact sides are counted per company before the join: the join never
    multiplies documents by plans, and partial counts combine map-side.
    """
    documents = (db["documents"].groupBy(F.col("company_id").alias("id"))
                 .agg(F.count("id").alias("document_count")))
    plans = (db["plan_types"].groupBy(F.col("company_id").alias("id"))
             .agg(F.count("id").alias("plan_count")))
    return (db["companies"].select("id", "code", "name", "website")
            .join(documents, "id", "left").join(plans, "id", "left")
            .select("code", "name", "website",
                    F.coalesce("document_count", F.lit(0)).alias("document_count"),
                    F.coalesce("plan_count", F.lit(0)).alias("plan_count"))
            .orderBy("code"))


def list_documents(db: Catalog, company_code=None, document_type=None, keyword=None,
                   limit=100) -> DataFrame:
    """Documents with table and plan counts; only the kept rows are counted."""
    companies = db["companies"].select(
        F.col("id").alias("company_id"), F.col("code").alias("company_code"),
        F.col("name").alias("company_name"))
    if company_code:
        companies = companies.filter(F.col("company_code") == company_code)
    documents = db["documents"]
    if document_type:
        documents = documents.filter(F.col("document_type") == document_type)
    if keyword:
        documents = documents.filter(
            any_like(keyword, "document_name", "source_path", "description"))
    output = ["document_id", "company_code", "company_name", "source_path",
              "document_name", "document_type", "language", "description",
              "effective_date", "version"]
    kept = ranked(
        documents.withColumnRenamed("id", "document_id").join(companies, "company_id"),
        ["company_code", "document_name", "document_id"], output, clamp_limit(limit, 100))
    # At most `limit` documents are kept, so this side is bounded and broadcast.
    wanted = F.broadcast(kept.select("document_id"))

    def counted(table: str, alias: str) -> DataFrame:
        return (db[table].select("document_id", "id").join(wanted, "document_id", "left_semi")
                .groupBy("document_id").agg(F.count("id").alias(alias)))

    return (kept.join(counted("source_tables", "source_table_count"), "document_id", "left")
                .join(counted("plan_types", "plan_count"), "document_id", "left")
                .select(*output,
                        F.coalesce("source_table_count", F.lit(0)).alias("source_table_count"),
                        F.coalesce("plan_count", F.lit(0)).alias("plan_count"))
                .orderBy("company_code", "document_name", "document_id"))


def list_source_tables(db: Catalog, company_code=None, document_id=None, table_type=None,
                       processed=None, limit=100) -> DataFrame:
    """Source-table metadata; the raw JSON column is never read."""
    tables = db["source_tables"].select(
        F.col("id").alias("source_table_id"), "document_id", "file_path", "table_type",
        "classification_reason", "classification_confidence", "page_number", "table_index",
        "keys", "content_type", "processed", "error_reason")
    if document_id is not None:
        tables = tables.filter(F.col("document_id") == document_id)
    if table_type:
        tables = tables.filter(F.col("table_type") == table_type)
    if processed is not None:
        tables = tables.filter(F.col("processed") == bool(processed))
    output = ["source_table_id", "document_id", "company_code", "company_name",
              "document_name", "file_path", "table_type", "classification_reason",
              "classification_confidence", "page_number", "table_index", "keys",
              "content_type", "processed", "error_reason"]
    return ranked(tables.join(_documents(db, company_code), "document_id"),
                  ["company_code", "document_name", "page_number", "table_index"],
                  output, clamp_limit(limit, 100))


def list_benefit_categories(db: Catalog) -> DataFrame:
    parents = db["benefit_categories"].select(
        F.col("id").alias("parent_id"), F.col("code").alias("parent_code"),
        F.col("name_vi").alias("parent_name_vi"))
    return (db["benefit_categories"].join(parents, "parent_id", "left")
            .orderBy(F.coalesce("parent_code", "code"), "code")
            .select(F.col("id").alias("category_id"), "code", "name_vi", "name_en",
                    "parent_code", "parent_name_vi"))


def search_plans(db: Catalog, keyword=None, company_code=None, normalized_code=None,
                 limit=100) -> DataFrame:
    plans = db["plan_types"]
    if keyword:
        plans = plans.filter(any_like(keyword, "raw_name", "normalized_code", "product_line"))
    if normalized_code:
        plans = plans.filter(F.col("normalized_code") == normalized_code)
    companies = db["companies"].select(
        F.col("id").alias("company_id"), F.col("code").alias("company_code"),
        F.col("name").alias("company_name"))
    documents = db["documents"].select(F.col("id").alias("document_id"), "document_name")
    plans = plans.select(
        F.col("id").alias("plan_type_id"), "company_id",
        F.col("document_id").alias("plan_document_id"), F.col("raw_name").alias("plan_name"),
        F.col("normalized_code").alias("plan_code"), "plan_level", "product_line")
    joined = (plans.join(companies, "company_id", "left")
              .join(documents, F.col("plan_document_id") == F.col("document_id"), "left"))
    if company_code:
        joined = joined.filter(F.col("company_code") == company_code)
    return ranked(joined, ["company_code", "product_line", "plan_level", "plan_name"],
                  ["plan_type_id", "company_code", "company_name", "document_id",
                   "document_name", "plan_name", "plan_code", "plan_level", "product_line"],
                  clamp_limit(limit, 100))


def list_plans(db: Catalog, company_code=None, limit=100) -> DataFrame:
    return search_plans(db, company_code=company_code, limit=limit).drop("plan_type_id")


# --- domain searches ----------------------------------------------------------------

def premium_quotes(db: Catalog, age=None, company_code=None, plan_code=None,
                   max_premium=None, limit=50, open_ended=False) -> DataFrame:
    """Premium rows whose age band holds ``age``, cheapest first.

    A band with an unknown end never matches (three-valued logic) unless
    ``open_ended`` reads the missing end as unbounded.
    """
    entries = db["premium_entries"].select(
        "source_table_id", "document_id", "plan_type_id", "age_label", "age_min", "age_max",
        "premium_amount", "currency", "period", "year_label")
    if age is not None:
        low, high = F.col("age_min") <= age, F.col("age_max") >= age
        if open_ended:
            low, high = low | F.col("age_min").isNull(), high | F.col("age_max").isNull()
        entries = entries.filter(low & high)
    if max_premium is not None:
        entries = entries.filter(F.col("premium_amount") <= max_premium)
    joined = _with_lineage(entries, db, company_code).join(_plans(db), "plan_type_id", "left")
    if plan_code:
        joined = joined.filter(F.col("plan_code") == plan_code)
    return ranked(joined, ["premium_amount", "company_code", "plan_level"],
                  [*LINEAGE, "plan_name", "plan_code", "age_label", "age_min", "age_max",
                   "premium_amount", "currency", "period", "year_label"], clamp_limit(limit))


def _benefit_rows(db: Catalog, keyword: str | None, searched: Sequence[str],
                  company_code=None, company_codes=None, plan_codes=None,
                  document_id=None, categories: bool = False) -> DataFrame:
    items = db["benefit_items"].select(
        F.col("id").alias("benefit_item_id"), "source_table_id", "document_id", "category_id",
        F.col("raw_name").alias("benefit_name"), "normalized_name", "applicable_to",
        F.col("note").alias("benefit_note"), "display_order")
    if document_id is not None:
        items = items.filter(F.col("document_id") == document_id)
    values = db["benefit_values"].select(
        "benefit_item_id", "plan_type_id", "value", "value_numeric", "value_context",
        "limit_type", "unit", "is_covered", F.col("note").alias("value_note"))
    joined = (_with_lineage(items, db, company_code, company_codes)
              .join(values, "benefit_item_id", "left")
              .join(_plans(db), "plan_type_id", "left"))
    if categories:
        joined = joined.join(db["benefit_categories"].select(
            F.col("id").alias("category_id"), F.col("code").alias("category_code"),
            F.col("name_vi").alias("category_name_vi")), "category_id", "left")
    if keyword:
        joined = joined.filter(any_like(keyword, *searched))
    if plan_codes:
        joined = joined.filter(F.col("plan_code").isin(list(plan_codes)))
    return joined


def search_benefits(db: Catalog, keyword, company_code=None, plan_code=None,
                    limit=50) -> DataFrame:
    rows = _benefit_rows(db, keyword, ["benefit_name", "benefit_note", "value"], company_code,
                         plan_codes=[plan_code] if plan_code else None)
    return ranked(rows, ["company_code", "document_name", "display_order", "plan_level"],
                  [*LINEAGE, "benefit_name", "applicable_to", "benefit_note", "plan_name",
                   "plan_code", "value", "value_numeric", "value_context", "unit",
                   "limit_type", "is_covered", "value_note"], clamp_limit(limit))


def benefit_matrix(db: Catalog, document_id=None, company_code=None, keyword=None,
                   category_code=None, plan_code=None, limit=150) -> DataFrame:
    rows = _benefit_rows(db, keyword,
                         ["benefit_name", "normalized_name", "benefit_note", "value"],
                         company_code, plan_codes=[plan_code] if plan_code else None,
                         document_id=document_id, categories=True)
    if category_code:
        rows = rows.filter(F.col("category_code") == category_code)
    return ranked(rows, ["company_code", "document_name", "display_order", "plan_level"],
                  [*LINEAGE, "category_code", "category_name_vi", "benefit_name",
                   "normalized_name", "applicable_to", "benefit_note", "plan_name",
                   "plan_code", "plan_level", "value", "value_numeric", "value_context",
                   "limit_type", "unit", "is_covered", "value_note"],
                  clamp_limit(limit, 150, 300))


def benefit_matrix_wide(db: Catalog, plan_codes: Sequence[str]) -> DataFrame:
    """The matrix in wide form: a column per named plan code."""
    rows = _benefit_rows(db, None, [])
    return (rows.groupBy("benefit_name")
            .pivot("plan_code", list(plan_codes)).agg(F.max("value_numeric")))


def compare_benefits(db: Catalog, keyword, company_codes, plan_codes=None,
                     limit=100) -> DataFrame:
    if not company_codes:
        raise ValueError("company_codes must contain at least one insurer code.")
    rows = _benefit_rows(db, keyword, ["benefit_name", "benefit_note", "value"],
                         company_codes=company_codes, plan_codes=plan_codes)
    return ranked(rows, ["company_code", "plan_level", "document_name", "display_order"],
                  [*LINEAGE, "benefit_name", "applicable_to", "benefit_note", "plan_name",
                   "plan_code", "plan_level", "value", "value_numeric", "value_context",
                   "unit", "limit_type", "is_covered", "value_note"],
                  clamp_limit(limit, 100))


def search_hospitals(db: Catalog, keyword=None, city=None, country=None, company_code=None,
                     gop_supported=None, limit=50) -> DataFrame:
    rows = db["hospitals"]
    if keyword:
        rows = rows.filter(any_like(keyword, "name_vi", "name_en", "address", "note"))
    if city:
        rows = rows.filter(like(F.col("city"), city))
    if country:
        rows = rows.filter(like(F.col("country"), country))
    if gop_supported is not None:
        rows = rows.filter(F.col("gop_supported") == bool(gop_supported))
    output = ["name_vi", "name_en", "address", "city", "country", "phone", "hospital_type",
              "gop_supported", "gop_time", "working_hours", "external_id", "note"]
    rows = rows.select("source_table_id", "document_id", *output)
    return ranked(_with_lineage(rows, db, company_code),
                  ["company_code", "country", "city", "name_vi"], [*LINEAGE, *output],
                  clamp_limit(limit))


def _simple_search(db: Catalog, name: str, output: Sequence[str], keys: Sequence[str],
                   company_code, limit: int, *predicates: Column) -> DataFrame:
    rows = db[name]
    for predicate in predicates:
        rows = rows.filter(predicate)
    rows = rows.select("source_table_id", "document_id", *output)
    return ranked(_with_lineage(rows, db, company_code), ["company_code", *keys],
                  [*LINEAGE, *output], limit)


def search_waiting_periods(db: Catalog, keyword=None, company_code=None,
                           max_waiting_days=None, limit=50) -> DataFrame:
    predicates = []
    if keyword:
        predicates.append(
            any_like(keyword, "condition_group", "condition_detail", "waiting_text"))
    if max_waiting_days is not None:
        days = F.col("waiting_days")
        predicates.append(days.isNull() | (days <= max_waiting_days))
    return _simple_search(
        db, "waiting_periods",
        ["condition_group", "condition_detail", "waiting_days", "waiting_text"],
        ["waiting_days", "condition_detail"], company_code, clamp_limit(limit), *predicates)


def search_claim_payouts(db: Catalog, keyword=None, company_code=None, limit=50) -> DataFrame:
    predicates = [any_like(keyword, "event", "payout_text")] if keyword else []
    return _simple_search(db, "claim_payouts", ["event", "payout_rate", "payout_text"],
                          ["event"], company_code, clamp_limit(limit), *predicates)


def search_glossary_terms(db: Catalog, keyword, company_code=None, limit=30) -> DataFrame:
    return _simple_search(db, "glossary_terms", ["term", "definition", "language"], ["term"],
                          company_code, clamp_limit(limit, 30),
                          any_like(keyword, "term", "definition"))


def short_term_premiums(db: Catalog, company_code=None, duration_days=None,
                        limit=50) -> DataFrame:
    predicates = []
    if duration_days is not None:
        days = F.col("duration_days")
        predicates.append(days.isNull() | (days >= duration_days))
    return _simple_search(
        db, "short_term_premiums", ["duration_text", "duration_days", "premium_rate"],
        ["duration_days", "duration_text"], company_code, clamp_limit(limit), *predicates)


def get_raw_source(db: Catalog, source_table_id: int) -> DataFrame:
    """Point lookup by key, raw JSON included; empty when the key is unknown."""
    sources = db["source_tables"].filter(F.col("id") == source_table_id)
    documents = db["documents"].select(
        F.col("id").alias("document_id"), "company_id", "source_path", "document_name")
    companies = db["companies"].select(
        F.col("id").alias("company_id"), F.col("code").alias("company_code"),
        F.col("name").alias("company_name"))
    return (sources.withColumnRenamed("id", "source_table_id")
            .join(documents, "document_id").join(companies, "company_id")
            .select("source_table_id", "file_path", "table_type", "classification_reason",
                    "classification_confidence", "page_number", "table_index", "keys",
                    "content_type", "raw_json", "document_id", "source_path",
                    "document_name", "company_code", "company_name"))


def search_exclusions(db: Catalog, keyword=None, company_code=None, limit=50) -> DataFrame:
    """Exclusion wordings across benefit items and glossary terms, tagged by origin."""
    terms = [*EXCLUSION_TERMS, *([keyword] if keyword else [])]

    def arm(table: str, kind: str, title: str, detail: str, extra: str,
            searched: Sequence[str]) -> DataFrame:
        rows = db[table].filter(any_of(terms, *searched)).select(
            F.lit(kind).alias("source_kind"), "source_table_id", "document_id",
            F.col(title).alias("title"), F.col(detail).alias("detail"),
            F.col(extra).alias("extra"))
        return rows

    both = arm("benefit_items", "benefit_item", "raw_name", "note", "applicable_to",
               ["raw_name", "note", "applicable_to"]).unionByName(
        arm("glossary_terms", "glossary_term", "term", "definition", "language",
            ["term", "definition"]))
    return ranked(_with_lineage(both, db, company_code),
                  ["company_code", "source_kind", "title"],
                  ["source_kind", *LINEAGE, "title", "detail", "extra"], clamp_limit(limit))


# --- review views -----------------------------------------------------------------------

def review_views(db: Catalog) -> dict[str, DataFrame]:
    """The eight review listings written out after a load."""
    documents = _documents(db).withColumnRenamed("company_code", "company")
    sources = db["source_tables"].select(
        F.col("id").alias("source_table_id"), "table_type", "file_path")
    plans = _plans(db)

    def view(name: str, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
        return (db[name].join(documents, "document_id")
                .orderBy("company", *keys)
                .select("id", "company", "document_name", *columns))

    items = db["benefit_items"].join(documents, "document_id")
    return {
        "benefit_items": items.join(sources, "source_table_id")
        .orderBy("company", "document_name", "row_index")
        .select("id", "company", "document_name", "raw_name", "applicable_to", "note",
                "table_type", "file_path"),
        "benefit_values": db["benefit_values"]
        .select("id", "benefit_item_id", "plan_type_id", "value", "value_numeric", "unit")
        .join(items.select(F.col("id").alias("benefit_item_id"), "company", "document_name",
                           F.col("raw_name").alias("benefit_name"), "row_index"),
              "benefit_item_id")
        .join(plans, "plan_type_id")
        .orderBy("company", "document_name", "row_index", "plan_level")
        .select("id", "company", "document_name", "benefit_name", "plan_name", "plan_code",
                "plan_level", "value", "value_numeric", "unit"),
        "premium_entries": db["premium_entries"].join(documents, "document_id")
        .join(sources, "source_table_id").join(plans, "plan_type_id", "left")
        .orderBy("company", "document_name", "row_index")
        .select("id", "company", "document_name", "plan_name", "plan_code", "age_label",
                "age_min", "age_max", "premium_amount", "file_path"),
        "hospitals": view("hospitals", ["name_vi", "name_en", "address", "city", "country",
                                        "phone", "hospital_type"], ["city", "name_vi"]),
        "glossary_terms": view("glossary_terms", ["term", "definition"], ["term"]),
        "waiting_periods": view("waiting_periods",
                                ["condition_group", "condition_detail", "waiting_days",
                                 "waiting_text"], ["condition_group"]),
        "claim_payouts": view("claim_payouts", ["event", "payout_rate", "payout_text"],
                              ["event"]),
        "short_term_premiums": view("short_term_premiums",
                                    ["duration_text", "duration_days", "premium_rate"], []),
    }


# --- tool registry and error envelope -------------------------------------------------------

TOOLS: dict[str, Callable] = {
    "list-tables": list_tables,
    "get-schema": get_schema,
    "execute-query": execute_query,
    "database-summary": database_summary,
    "list-companies": list_companies,
    "list-documents": list_documents,
    "list-source-tables": list_source_tables,
    "list-benefit-categories": list_benefit_categories,
    "search-plans": search_plans,
    "list-plans": list_plans,
    "get-premium-quotes": premium_quotes,
    "search-benefits": search_benefits,
    "search-hospitals": search_hospitals,
    "search-waiting-periods": search_waiting_periods,
    "search-claim-payouts": search_claim_payouts,
    "search-glossary-terms": search_glossary_terms,
    "get-benefit-matrix": benefit_matrix,
    "get-short-term-premiums": short_term_premiums,
    "get-raw-source": get_raw_source,
    "compare-benefits": compare_benefits,
    "search-exclusions": search_exclusions,
}


#: Rows that a call hands to its caller; larger results belong in a table.
CALL_ROWS = 10_000


def call_tool(db: Catalog, name: str, **arguments):
    """Run a tool to plain rows; a failure becomes a JSON error text.

    Spark is lazy, so the envelope covers the collect of the limited result.  More than
    ``CALL_ROWS`` rows are a failure as well: none are left out in silence.
    """
    try:
        result = TOOLS[name](db, **arguments)
        if isinstance(result, DataFrame):
            result = [row.asDict(recursive=True) for row in result.limit(CALL_ROWS + 1).collect()]
            if len(result) > CALL_ROWS:
                raise ValueError(f"The result has more than {CALL_ROWS} rows; add a LIMIT or write it to a table.")
            if name == "get-raw-source":
                return result[0] if result else {}
        return result or []
    except Exception as error:
        return json.dumps({
            "status": "error", "error_type": type(error).__name__, "message": str(error),
            "tool": name,
            "suggestion": "Check your SQL syntax or arguments and try again.",
        }, ensure_ascii=False)


def create_tables_sql() -> str:
    """DDL script of the relational model for a session with a warehouse."""
    return ";\n".join(f"CREATE TABLE IF NOT EXISTS {n} ({d}) USING parquet"
                      for n, d in DOMAIN_DDL.items())
