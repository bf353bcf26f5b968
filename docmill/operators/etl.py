"""Extraction JSON to domain tables: key sets, role mapping, unpivot, keys, outcomes.

The whole load is one lazy graph: files are parsed once, joined with the role
mapping on their key set, and each domain table is a projection of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import parse as ps

from docmill.functions.text import nfc, normalize_key_jvm, strip, truncate

ROWS = "array<map<string,string>>"
ROLE = "struct<role:string,column:string,plan_normalized_code:string,plan_level:int>"
TARGETS = ("benefit_items", "premium_entries", "hospitals", "glossary_terms",
           "waiting_periods", "claim_payouts", "short_term_premiums")


# --- parsing and key sets -------------------------------------------------------------------

def parse_extractions(files: DataFrame, path: str = "path", content: str = "content"
                      ) -> DataFrame:
    """(path, raw_json) to parsed rows; a single object counts as one row.

    Text that is no JSON object keeps ``rows`` NULL and ``bad_json`` true.  Everything is
    read from the composed text, so decomposed keys name the same columns; only texts with
    combining marks cross to Python for that, and ``raw_json`` stays as it came.
    """
    marked = F.when(F.col(content).rlike(r"[\u0300-\u036f]"), F.col(content))
    files = files.withColumn("_composed", F.coalesce(nfc(marked), F.col(content)))
    value = F.col("_composed")
    kind = F.get_json_object(value, "$.structured_data")
    listed = F.from_json(kind, ROWS)
    single = F.array(F.from_json(kind, "map<string,string>"))
    rows = F.when(kind.startswith("["), listed).when(kind.startswith("{"), single)
    parsed = F.from_json(value, "map<string,string>", {"mode": "PERMISSIVE"})
    return files.select(
        F.col(path).alias("path"), F.col(content).alias("raw_json"),
        (F.try_parse_json(value).isNull() | parsed.isNull()).alias("bad_json"),
        rows.alias("rows"),
        F.coalesce(F.get_json_object(value, "$.content_type"), F.lit("table"))
        .alias("content_type"),
        F.get_json_object(value, "$.description").alias("description"),
        ps.keyset_id(rows).alias("keyset_id"))


def keysets(parsed: DataFrame) -> DataFrame:
    """Distinct key sets with their file count, first file, its samples and description."""
    with_keys = parsed.filter(F.col("keyset_id").isNotNull())
    return with_keys.groupBy("keyset_id").agg(
        F.count("*").alias("file_count"), F.min("path").alias("first_path"),
        F.to_json(F.min_by(F.slice("rows", 1, 2), "path")).alias("samples"),
        F.min_by("description", "path").alias("description"))


def keyset_files(parsed: DataFrame) -> DataFrame:
    """(keyset_id, path) pairs: the key-set-to-files map in row form.

    Rows instead of lists: a key set shared by a third of all files stays spread.
    """
    return parsed.filter(F.col("keyset_id").isNotNull()).select("keyset_id", "path")


def key_usage(parsed: DataFrame) -> DataFrame:
    """Per key: how many files hold it."""
    keys = parsed.select("path", F.explode(F.array_distinct(F.flatten(
        F.transform("rows", lambda r: F.map_keys(r))))).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("file_count"))


def shared_schemas(parsed: DataFrame) -> DataFrame:
    """Key sets found in more than one file."""
    return keysets(parsed).filter("file_count > 1").select("keyset_id", "file_count")


def good_or_trash(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with rows, and files whose structured data is missing or empty."""
    empty = F.size(F.coalesce("rows", F.array().cast(ROWS))) <= 0
    return parsed.filter(~empty), parsed.filter(empty)


def classify_files(parsed: DataFrame) -> DataFrame:
    """Rule class of every file from its column headings."""
    keys = F.array_sort(F.array_distinct(F.flatten(F.transform(
        "rows", lambda r: F.map_keys(r)))))
    hit = ps.classify_keys(F.coalesce(keys, F.array().cast("array<string>")))
    page = ps.page_info(F.element_at(F.split("path", "/"), -1))
    return parsed.select(
        "path", ps.company_code(F.col("path")).alias("company_code"),
        ps.document_name(F.col("path")).alias("document_name"),
        page["page_number"].alias("page_number"), page["table_index"].alias("table_index"),
        hit["table_type"].alias("table_type"), hit["matched"].alias("matched"))


def apply_keyset_classes(parsed: DataFrame, classes: DataFrame) -> DataFrame:
    """Class per key set applied to every file; unknown key sets become misc."""
    joined = parsed.select("path", "keyset_id").join(
        classes.select("keyset_id", "table_type"), "keyset_id", "left")
    return joined.select(
        "path", "keyset_id", F.coalesce("table_type", F.lit("misc")).alias("table_type"),
        F.when(F.col("table_type").isNull(), "not_in_cache").otherwise("keyset")
        .alias("classification_reason"))


def mapping_violations(mapping: DataFrame) -> DataFrame:
    """Key sets whose mapping has not exactly one row label or repeats a plan level."""
    roles = mapping.select("keyset_id", "target_table", F.map_values("key_roles").alias("r"))
    labels = F.size(F.filter("r", lambda x: x["role"] == "row_label"))
    levels = F.transform(F.filter("r", lambda x: x["role"] == "plan_value"),
                         lambda x: x["plan_level"])
    issues = F.array_compact(F.array(
        F.when(labels != 1, "row_label_count"),
        F.when(F.size(F.array_distinct(levels)) < F.size(levels), "plan_level_repeated")))
    return roles.select("keyset_id", issues.alias("issues")).filter(F.size("issues") > 0)


def mapping_review(mapping: DataFrame, files: DataFrame) -> DataFrame:
    """One review row per key and role, with the key set's short hash and file count."""
    counts = files.groupBy("keyset_id").agg(F.count("*").alias("file_count"))
    rows = mapping.join(counts, "keyset_id", "left").select(
        F.substring(F.md5("keyset_id"), 1, 12).alias("keyset_hash"), "target_table",
        F.coalesce("file_count", F.lit(0)).alias("file_count"),
        F.explode(F.map_entries("key_roles")).alias("e"))
    return rows.select("keyset_hash", "target_table", "file_count", F.col("e.key").alias("key"),
                       F.col("e.value.role").alias("role"),
                       F.col("e.value.column").alias("column"))


def target_shares(mapping: DataFrame, files: DataFrame) -> DataFrame:
    """Files per target table and their share of all mapped files."""
    counts = files.join(mapping.select("keyset_id", "target_table"), "keyset_id") \
        .groupBy("target_table").agg(F.count("*").alias("file_count"))
    every = Window.partitionBy(F.lit(1))  # one row per target table
    return counts.withColumn("percent", F.round(
        100 * F.col("file_count") / F.sum("file_count").over(every), 2))


# --- keys ---------------------------------------------------------------------------------------

def stable_key(*parts: Column) -> Column:
    """Deterministic surrogate key: the same parts give the same id on every run."""
    return F.xxhash64(F.concat_ws("\x1f", *parts))


def upsert_last(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str
                ) -> DataFrame:
    """Union in which the row with the highest ``order`` wins per key."""
    from docmill.operators.evaluation import latest_per_key

    old = existing.withColumn(order, F.lit(None).cast(incoming.schema[order].dataType)) \
        if order not in existing.columns else existing
    return latest_per_key(old.unionByName(incoming, allowMissingColumns=True), keys, [order])


# --- the load -------------------------------------------------------------------------------------

@dataclass
class Load:
    """Tables of one ingestion run plus the outcome of every file."""

    outcomes: DataFrame
    tables: dict[str, DataFrame]

    def counters(self) -> DataFrame:
        return self.outcomes.groupBy("status").agg(F.count("*").alias("files"))


def by_role(roles: Column, *names: str) -> Column:
    return F.map_filter(roles, lambda k, v: v["role"].isin(*names))


def key_for(roles: Column, column: str, *names: str) -> Column:
    """The JSON key mapped to a column (the last one in key order)."""
    wanted = F.map_filter(roles, lambda k, v: (v["column"] == column)
                          & (v["role"].isin(*names) if names else F.lit(True)))
    return F.try_element_at(F.array_sort(F.map_keys(wanted)), F.lit(-1))


def value_of(row: Column, roles: Column, column: str, *names: str) -> Column:
    return F.try_element_at(row, key_for(roles, column, *names))


def _filled(value: Column, limit: int | None = None) -> Column:
    """Blank reads as NULL; long text is cut to its column."""
    kept = F.when(value != "", value)
    return truncate(kept, limit) if limit else kept


def ingest(parsed: DataFrame, mapping: DataFrame, companies: DataFrame,
           parity_bugs: bool = False) -> Load:
    """Load extraction files into the domain tables.

    ``mapping``: keyset_id, target_table, description, key_roles map<string, role>.
    With ``parity_bugs`` two source quirks are kept: a blank benefit label falls
    back to a key's name, and ``applicable_to`` is looked up by column name.
    """
    files = parsed.withColumn("company_code", ps.company_code(F.col("path")))
    known = companies.select(F.col("id").alias("company_id"), F.col("code").alias("company_code"))
    files = files.join(known, "company_code", "left")
    files = files.join(mapping, "keyset_id", "left")
    size = F.size(F.coalesce("rows", F.array().cast(ROWS)))
    status = ps.first_match([
        (F.col("company_id").isNull(), "skipped_no_company"),
        (F.col("bad_json"), "skipped_bad_json"),
        (F.col("target_table").isNull(), "skipped_no_mapping"),
        (~F.col("target_table").isin(*TARGETS), "skipped_unknown_table"),
        (size <= 0, "skipped_empty")], "files_ok")
    files = files.withColumn("status", status)
    outcomes = files.select("path", "status", "target_table",
                            F.when(F.col("status") == "files_ok", size).otherwise(0)
                            .alias("row_count"))
    ok = files.filter(F.col("status") == "files_ok")
    doc_name = ps.document_name(F.col("path"))
    source_path = F.concat_ws("/", "company_code", doc_name)
    page = ps.page_info(F.element_at(F.split("path", "/"), -1))
    keys = F.array_sort(F.array_distinct(F.transform(F.filter(F.flatten(F.transform(
        "rows", lambda r: F.map_keys(r))), lambda k: strip(k) != ""), lambda k: normalize_key_jvm(k))))
    ok = ok.withColumns({
        "document_id": stable_key(source_path), "source_path": source_path,
        "document_name": doc_name, "source_table_id": stable_key(F.col("path")),
        "page_number": page["page_number"], "table_index": page["table_index"],
        "keys": F.to_json(keys)})
    documents = ok.select(F.col("document_id").alias("id"), "company_id", "source_path",
                          "document_name").dropDuplicates(["id"])
    sources = ok.select(
        F.col("source_table_id").alias("id"), "document_id", F.col("path").alias("file_path"),
        F.col("target_table").alias("table_type"), "page_number", "table_index", "raw_json",
        "keys", "content_type").dropDuplicates(["id"])
    rows = ok.select("target_table", "company_id", "document_id", "source_table_id", "key_roles",
                     F.posexplode("rows").alias("row_index", "row")).filter("row IS NOT NULL")
    rows = rows.withColumn("raw_row", F.to_json("row"))
    roles, row = F.col("key_roles"), F.col("row")
    label_key = F.try_element_at(F.array_sort(F.map_keys(by_role(roles, "row_label"))),
                                 F.lit(-1))
    plan_roles = by_role(roles, "plan_value")
    base = ["source_table_id", "document_id", "row_index", "raw_row"]

    def of(table: str) -> DataFrame:
        return rows.filter(F.col("target_table") == table)

    def plan_cells(df: DataFrame, *extra: str) -> DataFrame:
        """Unpivot plan columns to one row per cell; NULL cells drop out."""
        return (df.select("company_id", *base, *extra, "row",
                          F.explode(F.map_entries(plan_roles)).alias("p"))
                .select("company_id", *base, *extra, F.col("p.key").alias("plan_name"),
                        F.coalesce("p.value.plan_normalized_code", F.lit("other")).alias("code"),
                        F.coalesce("p.value.plan_level", F.lit(9)).alias("level"),
                        F.try_element_at("row", F.col("p.key")).alias("value"))
                .filter(F.col("value").isNotNull())
                .withColumn("plan_type_id", stable_key(
                    F.col("document_id").cast("string"), F.col("plan_name"))))

    # plans: every mapped plan column of a file's document, first writer wins
    plans = (ok.filter(F.col("target_table").isin("benefit_items", "premium_entries"))
             .select("company_id", "document_id", "path",
                     F.explode(F.map_entries(plan_roles)).alias("p"))
             .groupBy("company_id", "document_id", F.col("p.key").alias("raw_name"))
             .agg(F.min_by(F.struct(
                 F.coalesce("p.value.plan_normalized_code", F.lit("other")).alias("c"),
                 F.coalesce("p.value.plan_level", F.lit(9)).alias("l")), "path").alias("v"))
             .select(stable_key(F.col("document_id").cast("string"), F.col("raw_name"))
                     .alias("id"), "company_id", "document_id", "raw_name",
                     F.col("v.c").alias("normalized_code"), F.col("v.l").alias("plan_level")))

    label = _filled(F.try_element_at(row, label_key))
    if parity_bugs:
        other = F.filter(F.map_entries(row), lambda e: ~F.array_contains(
            F.map_keys(plan_roles), e["key"]) & (F.coalesce(e["value"], F.lit("")) != "")
            & (e["key"] != label_key)
            & F.coalesce(F.element_at(roles, e["key"])["column"], F.lit("")).isin(""))
        label = F.coalesce(label, F.try_element_at(other, F.lit(1))["key"])
        applicable = F.try_element_at(row, F.when(
            key_for(roles, "applicable_to").isNotNull(), F.lit("___")))
    else:
        applicable = value_of(row, roles, "applicable_to", "direct_column", "metadata")
    benefits = of("benefit_items").withColumns({
        "raw_name": truncate(label, 500), "applicable_to": _filled(applicable, 500),
        "note": value_of(row, roles, "note", "direct_column", "metadata"),
        "unit": _filled(value_of(row, roles, "unit", "direct_column", "metadata"), 100),
        "item_id": stable_key(F.col("source_table_id").cast("string"),
                              F.col("row_index").cast("string"))})
    benefits = benefits.filter(F.col("raw_name").isNotNull())
    items = benefits.select(F.col("item_id").alias("id"), *base, "raw_name", "applicable_to",
                            "note")
    cells = plan_cells(benefits, "item_id", "unit")
    values = cells.select(
        stable_key(F.col("item_id").cast("string"), F.col("plan_name")).alias("id"),
        F.col("item_id").alias("benefit_item_id"), "plan_type_id", "value",
        ps.parse_numeric(F.col("value")).cast("double").alias("value_numeric"), "unit")
    aged = of("premium_entries").withColumn("age_label", _filled(F.try_element_at(row, label_key)))
    priced = plan_cells(aged.filter(F.col("age_label").isNotNull()), "age_label")
    age = ps.parse_age_range(F.col("age_label"))
    premiums = priced.select(
        stable_key(F.col("source_table_id").cast("string"), F.col("row_index").cast("string"),
                   F.col("plan_name")).alias("id"), *base[:2], "plan_type_id", *base[2:],
        age["age_min"].alias("age_min"), age["age_max"].alias("age_max"),
        truncate(F.col("age_label"), 50).alias("age_label"),
        ps.parse_numeric(F.col("value")).cast("double").alias("premium_amount"),
        F.lit("VND").alias("currency"), F.lit("annual").alias("period"))

    def mapped(table: str, **columns: Column) -> DataFrame:
        key = stable_key(F.col("source_table_id").cast("string"),
                         F.col("row_index").cast("string"))
        return of(table).select(key.alias("id"), *base,
                                *[c.alias(n) for n, c in columns.items()])

    def col(name: str, limit: int | None = None, *names: str) -> Column:
        return _filled(value_of(row, roles, name, *names), limit)

    def direct(name: str, limit: int | None = None) -> Column:
        return col(name, limit, "row_label", "direct_column", "metadata")

    def number(name: str) -> Column:
        return ps.parse_numeric(value_of(row, roles, name))
    tables = {
        "documents": documents, "source_tables": sources, "plan_types": plans,
        "benefit_items": items, "benefit_values": values, "premium_entries": premiums,
        "hospitals": mapped(
            "hospitals", name_vi=direct("name_vi", 300), name_en=direct("name_en", 300),
            address=direct("address"), city=direct("city"), phone=direct("phone", 100),
            hospital_type=direct("hospital_type"), external_id=direct("external_id", 50),
            note=direct("note"), country=F.coalesce(direct("country"), F.lit("VN")))
        .filter("name_vi IS NOT NULL OR name_en IS NOT NULL"),
        "glossary_terms": mapped("glossary_terms", term=col("term", 300),
                                 definition=col("definition"))
        .filter("term IS NOT NULL AND definition IS NOT NULL"),
        "waiting_periods": mapped(
            "waiting_periods", condition_group=col("condition_group", 200),
            condition_detail=col("condition_detail"),
            waiting_days=number("waiting_days").cast("int"),
            waiting_text=col("waiting_text", 200)),
        "claim_payouts": mapped("claim_payouts", event=col("event", 300),
                                payout_rate=number("payout_rate").cast("double"),
                                payout_text=col("payout_text", 200)),
        "short_term_premiums": mapped(
            "short_term_premiums", duration_text=col("duration_text", 200),
            duration_days=number("duration_days").cast("int"),
            premium_rate=number("premium_rate").cast("double")),
    }
    return Load(outcomes, tables)


def write_load(load: Load, root: str) -> None:
    """Truncate-and-reload: every table overwritten under ``root``."""
    for name, df in load.tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


# --- smaller pipelines -------------------------------------------------------------------------------

def map_documents_to_tables(files: DataFrame, tables: DataFrame) -> DataFrame:
    """Markdown files with the tables of the same company and document folder.

    The folder pair is cut from both paths, so a path search becomes an equi-join.
    """
    folder = F.concat_ws("/", F.get(F.split("path", "/"), F.lit(0)),
                         F.get(F.split("path", "/"), F.lit(1)))
    left = files.select("path", folder.alias("folder"))
    right = tables.select(
        F.col("id").alias("source_table_id"), "file_path", "table_type", "page_number",
        F.concat_ws("/", F.get(F.split("file_path", "/"), F.lit(0)),
                    F.get(F.split("file_path", "/"), F.lit(1))).alias("folder"))
    return left.join(right, "folder", "left").drop("folder")


def first_table_or_minus_one(mapped: DataFrame) -> DataFrame:
    """Per file the lowest mapped table id, -1 without any."""
    return mapped.groupBy("path").agg(
        F.coalesce(F.min("source_table_id"), F.lit(-1)).alias("source_table_id"))


def pair_by_stem(images: DataFrame, extractions: DataFrame, seed: int = 42,
                 train_share: float = 0.9) -> DataFrame:
    """Image and JSON pairs by file stem with an exact seeded train/validation split.

    The cut is the exact rank-order position found by a histogram, so no
    global sort window gathers all rows.
    """
    from docmill.functions.text import file_stem
    from docmill.operators.evaluation import nearest_rank

    pairs = images.select(file_stem(F.col("path")).alias("stem"), F.col("path").alias("image")) \
        .join(extractions.select(file_stem(F.col("path")).alias("stem"),
                                 F.col("path").alias("json")), "stem")
    keyed = pairs.withColumn("_o", F.xxhash64("image", F.lit(seed)).cast("double"))
    edge = nearest_rank(keyed, [], "_o", train_share) if train_share < 1 else None
    if edge is None:
        return pairs.withColumn("split", F.lit("train"))
    cut = edge.select("percentile").scalar()
    return keyed.withColumn("split", F.when(F.col("_o") <= cut, "train")
                            .otherwise("validation")).drop("_o")


def synthetic_cases(spark, count: int = 100) -> DataFrame:
    """The seeded benchmark cases, by their modulo rules."""
    i = F.col("id")
    third, second = i % 3 == 0, i % 2 == 0

    def pick(a: str, b: str, c: str) -> Column:
        return F.when(third, a).when(second, b).otherwise(c)
    return spark.range(1, count + 1).select(
        F.format_string("case_%03d", i).alias("case_id"), F.lit("U_BENCHMARK").alias("user_id"),
        F.concat(F.lit("Test question "), i.cast("string")).alias("query"),
        pick("claim", "comparison", "policy_qa").alias("expected_intent_group"),
        pick("high", "medium", "low").alias("expected_risk_level"),
        pick("high_risk_claim", "verified_compare", "policy_qa").alias("expected_workflow"),
        F.array(F.lit("sqlite_row"), F.lit("qdrant_doc")).alias("expected_evidence_types"))


def reuse_descriptions(tables: DataFrame, described: DataFrame) -> DataFrame:
    """Table texts with the description of an identical earlier table, NULL when new."""
    known = described.select(F.md5("table_text").alias("h"), "description") \
        .dropDuplicates(["h"])
    return tables.withColumn("h", F.md5("table_text")).join(known, "h", "left").drop("h")


