"""Registered queries: extraction loads, graphs, benchmark building, streaming."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from docmill.operators import benchmark as bm
from docmill.operators import etl
from docmill.operators import evaluation as ev
from docmill.operators import graph as gr
from docmill.operators.chunking import research as rs
from docmill.operators.numbering import ranked
from docmill.plans.corpus import DOCS_CTE, documents_corpus, pages_corpus
from docmill.plans.registry import query
from docmill.session import scratch_path, spread, table

# --- extraction files: one JSON text per part, its shape by key -----------------------------

KINDS = ("benefit_items", "premium_entries", "hospitals", "glossary_terms",
         "waiting_periods", "claim_payouts", "short_term_premiums", "unknown")


def extraction_json(spark, sf):
    """Every part as an extraction file of one of eight shapes."""
    p = table(spark, sf, "part")
    kind = F.col("p_partkey") % 8
    size, name = F.col("p_size").cast("string"), F.col("p_name")

    def row(**cells):
        return F.array(F.create_map(*[x for k, v in cells.items() for x in (
            F.lit(k.replace("_", " ")), v)]))
    age = F.concat(size, F.lit("-"), (F.col("p_size") + 4).cast("string"))
    rows = (F.when(kind == 0, row(Quyền_lợi=name, HF1=F.concat(size, F.lit(".000")), HF2=size,
                                  Ghi_chú=F.col("p_type")))
            .when(kind == 1, row(Tuổi=age, HF1=F.concat(size, F.lit(",000"))))
            .when(kind == 2, row(Tên=name, Thành_phố=F.col("p_type")))
            .when(p.p_partkey % 16 == 3, row(**{unicodedata.normalize("NFD", k): v for k, v in (
                ("Thuật_ngữ", name), ("Định_nghĩa", F.col("p_brand")))}))  # decomposed keys
            .when(kind == 3, row(Thuật_ngữ=name, Định_nghĩa=F.col("p_brand")))
            .when(kind == 4, row(Nhóm=name, Số_ngày=size))
            .when(kind == 5, row(Sự_kiện=name, Tỷ_lệ=size))
            .when(kind == 6, row(Thời_hạn=name, Ngày=size, Mức=size))
            .otherwise(row(Khác=name)))
    path = F.format_string("bic.vn/%s/table_p%d_n%d.json", F.col("p_brand"), F.col("p_size"),
                           F.col("p_partkey"))
    text = F.to_json(F.struct(rows.alias("structured_data"), F.lit("table")
                              .alias("content_type"), name.alias("description")))
    return spread(p).select(path.alias("path"), text.alias("content"))


def mapping(spark):
    """Key roles of the seven known shapes."""
    def role(r, column=None, code=None, level=None):
        return (r, column, code, level)
    plans = {"HF1": role("plan_value", None, "basic", 1), "HF2": role("plan_value", None, "plus", 2)}
    shapes = [
        ("benefit_items", {"Quyền lợi": role("row_label"), **plans,
                           "Ghi chú": role("metadata", "note")}),
        ("premium_entries", {"Tuổi": role("row_label"), "HF1": plans["HF1"]}),
        ("hospitals", {"Tên": role("row_label", "name_vi"),
                       "Thành phố": role("direct_column", "city")}),
        ("glossary_terms", {"Thuật ngữ": role("row_label", "term"),
                            "Định nghĩa": role("direct_column", "definition")}),
        ("waiting_periods", {"Nhóm": role("row_label", "condition_group"),
                             "Số ngày": role("direct_column", "waiting_days")}),
        ("claim_payouts", {"Sự kiện": role("row_label", "event"),
                           "Tỷ lệ": role("direct_column", "payout_rate")}),
        ("short_term_premiums", {"Thời hạn": role("row_label", "duration_text"),
                                 "Ngày": role("direct_column", "duration_days"),
                                 "Mức": role("direct_column", "premium_rate")})]
    return spark.createDataFrame(
        [(" | ".join(sorted(roles)), target, "", roles) for target, roles in shapes],
        f"keyset_id STRING, target_table STRING, map_description STRING, "
        f"key_roles MAP<STRING, {etl.ROLE.replace('struct', 'STRUCT')}>")


def load(spark, sf):
    companies = spark.createDataFrame([(3, "bic")], "id BIGINT, code STRING")
    return etl.ingest(etl.parse_extractions(extraction_json(spark, sf)), mapping(spark),
                      companies)


PART = """WITH p AS (SELECT *, p_partkey % 8 AS kind, 'bic.vn/' || p_brand || '/table_p' || p_size
      || '_n' || p_partkey || '.json' AS path FROM part)"""


def loaded(name, sql, table_name, *columns):
    @query(name, sql)
    def run(spark, sf):
        return load(spark, sf).tables[table_name].select(*columns)


loaded("etl_benefit_items", PART + """
    SELECT p_name AS raw_name, p_type AS note, 0 AS row_index FROM p WHERE kind = 0""",
       "benefit_items", "raw_name", "note", "row_index")
loaded("etl_benefit_values", PART + """
    SELECT p_size || '.000' AS value, CAST(p_size * 1000 AS DOUBLE) AS value_numeric
    FROM p WHERE kind = 0
    UNION ALL SELECT CAST(p_size AS VARCHAR), CAST(p_size AS DOUBLE) FROM p WHERE kind = 0""",
       "benefit_values", "value", "value_numeric")
loaded("etl_premiums", PART + """
    SELECT p_size || '-' || (p_size + 4) AS age_label, p_size AS age_min, p_size + 4 AS age_max,
           CAST(p_size * 1000 AS DOUBLE) AS premium_amount, 'VND' AS currency FROM p
    WHERE kind = 1""", "premium_entries", "age_label", "age_min", "age_max", "premium_amount",
       "currency")
loaded("etl_plans", PART + """
    SELECT DISTINCT p_brand AS document_name, 'HF1' AS raw_name, 'basic' AS normalized_code,
           1 AS plan_level FROM p WHERE kind IN (0, 1)
    UNION ALL SELECT DISTINCT p_brand, 'HF2', 'plus', 2 FROM p WHERE kind = 0""", "plan_types")
loaded("etl_hospitals", PART + """
    SELECT p_name AS name_vi, p_type AS city, 'VN' AS country FROM p WHERE kind = 2""",
       "hospitals", "name_vi", "city", "country")
loaded("etl_glossary", PART + """
    SELECT p_name AS term, p_brand AS definition FROM p WHERE kind = 3""",
       "glossary_terms", "term", "definition")
loaded("etl_waiting_periods", PART + """
    SELECT p_name AS condition_group, p_size AS waiting_days FROM p WHERE kind = 4""",
       "waiting_periods", "condition_group", "waiting_days")
loaded("etl_claim_payouts", PART + """
    SELECT p_name AS event, CAST(p_size AS DOUBLE) AS payout_rate FROM p WHERE kind = 5""",
       "claim_payouts", "event", "payout_rate")
loaded("etl_short_term_premiums", PART + """
    SELECT p_name AS duration_text, p_size AS duration_days,
           CAST(p_size AS DOUBLE) AS premium_rate FROM p WHERE kind = 6""",
       "short_term_premiums", "duration_text", "duration_days", "premium_rate")
loaded("etl_documents", PART + """
    SELECT DISTINCT 'bic/' || p_brand AS source_path, p_brand AS document_name,
           CAST(3 AS BIGINT) AS company_id FROM p WHERE kind < 7""",
       "documents", "source_path", "document_name", "company_id")
loaded("etl_source_tables", PART + """
    SELECT path AS file_path, p_size AS page_number, CAST(p_partkey AS INT) AS table_index,
           'table' AS content_type FROM p WHERE kind < 7""",
       "source_tables", "file_path", "page_number", "table_index", "content_type")


def _plans_with_documents(spark, sf):
    run = load(spark, sf)
    docs = run.tables["documents"].select(F.col("id").alias("document_id"), "document_name")
    return run.tables["plan_types"].join(docs, "document_id").select(
        "document_name", "raw_name", "normalized_code", "plan_level")


from docmill.plans.registry import QUERIES  # noqa: E402

QUERIES["etl_plans"] = _plans_with_documents


@query("etl_outcomes", PART + """
    SELECT CASE WHEN kind = 7 THEN 'skipped_no_mapping' ELSE 'files_ok' END AS status,
           count(*) AS files FROM p GROUP BY 1""")
def etl_outcomes(spark, sf):
    return load(spark, sf).counters()


@query("etl_target_shares", PART + """
    SELECT CASE kind WHEN 0 THEN 'benefit_items' WHEN 1 THEN 'premium_entries'
             WHEN 2 THEN 'hospitals' WHEN 3 THEN 'glossary_terms' WHEN 4 THEN 'waiting_periods'
             WHEN 5 THEN 'claim_payouts' ELSE 'short_term_premiums' END AS target_table,
           count(*) AS file_count,
           round(100.0 * count(*) / (SELECT count(*) FROM p WHERE kind < 7), 2) AS percent
    FROM p WHERE kind < 7 GROUP BY 1""")
def etl_target_shares(spark, sf):
    parsed = etl.parse_extractions(extraction_json(spark, sf))
    return etl.target_shares(mapping(spark), etl.keyset_files(parsed))


@query("etl_key_usage", """
    SELECT 'k' AS key, count(*) AS file_count FROM events""")
def etl_key_usage(spark, sf):
    return etl.key_usage(event_files(spark, sf))


def event_files(spark, sf):
    """Event properties as extraction files: the JSON object is the structured data."""
    files = table(spark, sf, "events").select(
        F.concat_ws("/", F.lit("pti.com.vn"), "event_type", F.concat(
            F.col("event_id").cast("string"), F.lit(".json"))).alias("path"),
        F.concat(F.lit('{"structured_data":'), F.col("props"), F.lit("}")).alias("content"))
    return etl.parse_extractions(files)


@query("etl_keysets", """
    SELECT 'k' AS keyset_id, count(*) AS file_count,
           min('pti.com.vn/' || event_type || '/' || event_id || '.json') AS first_path
    FROM events""")
def etl_keysets(spark, sf):
    return etl.keysets(event_files(spark, sf)).select("keyset_id", "file_count", "first_path")


@query("etl_shared_schemas", PART + """
    SELECT file_count FROM (SELECT kind, count(*) AS file_count FROM p GROUP BY kind)
    WHERE file_count > 1""")
def etl_shared_schemas(spark, sf):
    parsed = etl.parse_extractions(extraction_json(spark, sf))
    return etl.shared_schemas(parsed).select("file_count")


@query("etl_file_classes", PART + """
    SELECT 'bic' AS company_code, p_brand AS document_name,
           CASE kind WHEN 0 THEN 'benefit_table' WHEN 3 THEN 'glossary'
                ELSE 'unclassified' END AS table_type, count(*) AS files
    FROM p GROUP BY ALL""")
def etl_file_classes(spark, sf):
    parsed = etl.parse_extractions(extraction_json(spark, sf))
    return etl.classify_files(parsed).groupBy("company_code", "document_name", "table_type") \
        .agg(F.count("*").alias("files"))


@query("etl_keyset_classes", PART + """
    SELECT CASE WHEN kind = 7 THEN 'misc' WHEN kind = 0 THEN 'benefit_items'
                WHEN kind = 1 THEN 'premium_entries' WHEN kind = 2 THEN 'hospitals'
                WHEN kind = 3 THEN 'glossary_terms' WHEN kind = 4 THEN 'waiting_periods'
                WHEN kind = 5 THEN 'claim_payouts' ELSE 'short_term_premiums' END AS table_type,
           CASE WHEN kind = 7 THEN 'not_in_cache' ELSE 'keyset' END AS classification_reason,
           count(*) AS files FROM p GROUP BY ALL""")
def etl_keyset_classes(spark, sf):
    parsed = etl.parse_extractions(extraction_json(spark, sf))
    classes = mapping(spark).select("keyset_id", F.col("target_table").alias("table_type"))
    return etl.apply_keyset_classes(parsed, classes).groupBy(
        "table_type", "classification_reason").agg(F.count("*").alias("files"))


@query("etl_good_files", "SELECT count(*) AS good, 0 AS trash FROM events")
def etl_good_files(spark, sf):
    good, trash = etl.good_or_trash(event_files(spark, sf))
    return good.select(F.lit(1).alias("g"), F.lit(0).alias("t")).unionByName(
        trash.select(F.lit(0).alias("g"), F.lit(1).alias("t"))).agg(
        F.sum("g").alias("good"), F.sum("t").cast("int").alias("trash"))


@query("etl_mapping_review", PART + """
    SELECT target_table, key, role FROM (VALUES
      ('benefit_items', 'Quyền lợi', 'row_label'), ('benefit_items', 'HF1', 'plan_value'),
      ('benefit_items', 'HF2', 'plan_value'), ('benefit_items', 'Ghi chú', 'metadata'),
      ('premium_entries', 'Tuổi', 'row_label'), ('premium_entries', 'HF1', 'plan_value'),
      ('hospitals', 'Tên', 'row_label'), ('hospitals', 'Thành phố', 'direct_column'),
      ('glossary_terms', 'Thuật ngữ', 'row_label'),
      ('glossary_terms', 'Định nghĩa', 'direct_column'),
      ('waiting_periods', 'Nhóm', 'row_label'), ('waiting_periods', 'Số ngày', 'direct_column'),
      ('claim_payouts', 'Sự kiện', 'row_label'), ('claim_payouts', 'Tỷ lệ', 'direct_column'),
      ('short_term_premiums', 'Thời hạn', 'row_label'),
      ('short_term_premiums', 'Ngày', 'direct_column'),
      ('short_term_premiums', 'Mức', 'direct_column')) v(target_table, key, role)
    WHERE (SELECT count(*) FROM p) > 0""")
def etl_mapping_review(spark, sf):
    parsed = etl.parse_extractions(extraction_json(spark, sf))
    return etl.mapping_review(mapping(spark), etl.keyset_files(parsed)) \
        .filter("file_count > 0").select("target_table", "key", "role")


@query("etl_upsert_last_wins", """
    SELECT c_custkey, coalesce(arg_max(o_orderpriority, o_orderkey), c_mktsegment) AS segment
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment""")
def etl_upsert(spark, sf):
    old = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("segment"), F.lit(-1).cast("bigint").alias("v"))
    new = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("segment"),
        F.col("o_orderkey").alias("v"))
    return etl.upsert_last(old, new, ["c_custkey"], "v").select("c_custkey", "segment")


@query("etl_pair_split")
def etl_pair_split(spark, sf):
    d = table(spark, sf, "documents")
    images = d.select(F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png"))
                      .alias("path"))
    texts = d.select(F.concat(F.lit("json/"), F.col("doc_id").cast("string"), F.lit(".json"))
                     .alias("path"))
    return etl.pair_by_stem(images, texts)


@query("latest_per_key", """
    SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type
    FROM events GROUP BY user_id""")
def latest_per_key(spark, sf):
    return ev.latest_per_key(table(spark, sf, "events").select("user_id", "event_id",
                                                               "event_type"),
                             ["user_id"], ["event_id"])


# --- graph: regions, nations, suppliers, customers and parts ----------------------------------

NODE_SQL = """n AS (SELECT 'nation:' || n_nationkey AS id, 'Nation' AS entity_type FROM nation
    UNION ALL SELECT 'region:' || r_regionkey, 'Region' FROM region
    UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier' FROM supplier
    UNION ALL SELECT 'customer:' || c_custkey, 'Customer' FROM customer
    UNION ALL SELECT 'part:' || p_partkey, 'Part' FROM part)"""
EDGE_SQL = """e AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst,
      'PART_OF' AS relationship_type, 1.0 AS conf, 'd1' AS doc FROM nation
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN',
      CASE WHEN s_suppkey % 4 = 0 THEN 0.5 ELSE 0.9 END, 'd1' FROM supplier
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'LIVES_IN', 0.8,
      CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'd' || c_custkey % 3 END FROM customer)"""


def graph(spark, sf):
    def ids(kind, key):
        return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    none = F.create_map().cast("map<string,string>")

    def nodes(name, kind, key, label):
        return table(spark, sf, name).select(ids(kind, key).alias("id"),
                                             F.lit(label).alias("entity_type"),
                                             none.alias("props"))

    def edges(name, src, dst, label, conf, doc):
        props = F.map_filter(F.create_map(
            F.lit("confidence"), conf.cast("string"), F.lit("document_id"), doc,
            F.lit("source_path"), F.lit(f"{name}.md"), F.lit("chunk_id"),
            F.concat(doc, F.lit(":0"))), lambda k, v: v.isNotNull())
        return table(spark, sf, name).select(src.alias("src"), dst.alias("dst"),
                                             F.lit(label).alias("relationship_type"),
                                             props.alias("props"))
    n = (nodes("nation", "nation", "n_nationkey", "Nation")
         .unionByName(nodes("region", "region", "r_regionkey", "Region"))
         .unionByName(nodes("supplier", "supplier", "s_suppkey", "Supplier"))
         .unionByName(nodes("customer", "customer", "c_custkey", "Customer"))
         .unionByName(nodes("part", "part", "p_partkey", "Part")))
    e = (edges("nation", ids("nation", "n_nationkey"), ids("region", "n_regionkey"), "PART_OF",
               F.lit(1.0), F.lit("d1"))
         .unionByName(edges("supplier", ids("supplier", "s_suppkey"),
                            ids("nation", "s_nationkey"), "LOCATED_IN",
                            F.when(F.col("s_suppkey") % 4 == 0, 0.5).otherwise(0.9), F.lit("d1")))
         .unionByName(edges("customer", ids("customer", "c_custkey"),
                            ids("nation", "c_nationkey"), "LIVES_IN", F.lit(0.8),
                            F.when(F.col("c_custkey") % 7 != 0, F.concat(
                                F.lit("d"), (F.col("c_custkey") % 3).cast("string"))))))
    docs = spark.createDataFrame([("d0",), ("d1",)], "document_id STRING")
    types = spark.createDataFrame([("PART_OF",), ("LOCATED_IN",)], "label STRING")
    return n, e, docs, types


ISSUES = f"""WITH {NODE_SQL}, {EDGE_SQL},
    i AS (SELECT 'orphan_node' AS issue, id AS subject FROM n
          WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)
      UNION ALL SELECT 'missing_document_lineage', src || '->' || dst FROM e WHERE doc IS NULL
      UNION ALL SELECT DISTINCT 'dangling_chunk_reference', doc || ':0' FROM e
                WHERE doc NOT IN ('d0', 'd1')
      UNION ALL SELECT 'low_confidence_edge', src || '->' || dst FROM e WHERE conf < 0.75
      UNION ALL SELECT DISTINCT 'invalid_relationship', relationship_type FROM e
                WHERE relationship_type NOT IN ('PART_OF', 'LOCATED_IN'))"""


@query("graph_quality_issues", ISSUES + " SELECT issue, subject FROM i")
def graph_quality_issues(spark, sf):
    n, e, docs, types = graph(spark, sf)
    return gr.quality_issues(n, e, docs, types)


@query("graph_quality_report", ISSUES + """
    SELECT count(*) FILTER (issue = 'orphan_node') AS orphan_node,
           count(*) FILTER (issue = 'missing_document_lineage') AS missing_document_lineage,
           count(*) FILTER (issue = 'dangling_chunk_reference') AS dangling_chunk_reference,
           count(*) FILTER (issue = 'low_confidence_edge') AS low_confidence_edge,
           count(*) FILTER (issue = 'invalid_relationship') AS invalid_relationship,
           count(*) = 0 AS is_valid, (SELECT count(*) FROM n) AS node_count,
           (SELECT count(*) FROM e) AS edge_count FROM i""")
def graph_quality_report(spark, sf):
    n, e, docs, types = graph(spark, sf)
    return gr.quality_report(n, e, gr.quality_issues(n, e, docs, types))


@query("graph_degrees", f"""WITH {EDGE_SQL}
    SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e)
    GROUP BY id""")
def graph_degrees(spark, sf):
    return gr.degrees(graph(spark, sf)[1])


@query("graph_type_counts", f"""WITH {NODE_SQL}
    SELECT entity_type, count(*) AS n FROM n GROUP BY entity_type""")
def graph_type_counts(spark, sf):
    return gr.type_counts(graph(spark, sf)[0], "entity_type")


@query("graph_neighbours", f"""WITH {EDGE_SQL},
    a AS (SELECT DISTINCT 'customer:' || c_custkey AS id FROM customer
          WHERE c_mktsegment = 'BUILDING'),
    b AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM a)),
    c AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM b))
    SELECT id, 0 AS depth FROM a UNION ALL SELECT id, 1 FROM b UNION ALL SELECT id, 2 FROM c""")
def graph_neighbours(spark, sf):
    start = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return gr.neighbours(graph(spark, sf)[1], start, 2)


@query("graph_node_link_roundtrip", f"""WITH {EDGE_SQL}
    SELECT src, dst, relationship_type FROM e""")
def graph_node_link(spark, sf):
    n, e, _, _ = graph(spark, sf)
    return gr.read_node_link(gr.node_link_json(n, e))[1].drop("props")


def graph_documents(spark, sf):
    """Each order as an extracted graph of its customer, its status and an odd type."""
    def node(i, t):
        return F.struct(i.alias("id"), F.lit(t).alias("type"),
                        F.create_map(F.lit("from"), F.col("o_orderkey").cast("string"))
                        .alias("properties"))

    def rel(a, b, t):
        return F.struct(a.alias("source"), b.alias("target"), F.lit(t).alias("type"),
                        F.create_map(F.lit("from"), F.col("o_orderkey").cast("string"))
                        .alias("properties"))
    c = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    s, x = F.concat(F.lit("s"), F.col("o_orderstatus")), F.lit("x")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ord"),
        F.array(node(c, "Customer"), node(s, "Status"), node(x, "Odd")).alias("nodes"),
        F.array(rel(c, s, "HAS"), rel(c, x, "HAS"), rel(s, c, "ODD")).alias("relationships"))


@query("graph_build", """
    SELECT 'c' || o_custkey AS src, 's' || o_orderstatus AS dst, 'HAS' AS relationship_type,
           CAST(max(o_orderkey) AS VARCHAR) AS last_order FROM orders GROUP BY ALL""")
def graph_build(spark, sf):
    allowed = spark.createDataFrame([("Customer",), ("Status",)], "label STRING")
    has = spark.createDataFrame([("HAS",)], "label STRING")
    edges = gr.build_graph(graph_documents(spark, sf), allowed, has)[1]
    return edges.select("src", "dst", "relationship_type",
                        F.element_at("props", "from").alias("last_order"))


def proposals(spark, sf):
    """Parts as label proposals: name, brand file, type alias, size as confidence."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_brand").alias("file_path"),
        F.col("p_name").alias("label"), F.array("p_type").alias("aliases"),
        F.concat_ws(" ", "p_brand", "p_type").alias("evidence_text"),
        (F.col("p_size") / 50).alias("confidence"))


def canonical(spark, sf):
    """Every two-word label maps to its last word."""
    return table(spark, sf, "part").select(F.col("p_name").alias("label"), F.substring_index(
        "p_name", " ", -1).alias("canonical_label")).distinct()


LABEL = """WITH t AS (SELECT p_partkey AS ord, p_brand AS file_path, p_type AS alias,
    p_name AS raw, regexp_extract(p_name, '(\\S+)$', 1) AS label, p_size / 50 AS conf FROM part)"""


@query("schema_label_aggregate", LABEL + """
    SELECT label, count(*) AS occurrence_count, count(DISTINCT file_path) AS source_file_count,
           round(avg(conf), 4) AS average_confidence FROM t GROUP BY label""")
def schema_label_aggregate(spark, sf):
    return gr.aggregate_labels(proposals(spark, sf), canonical(spark, sf))


@query("schema_label_examples", LABEL + """,
    v AS (SELECT label, file_path || ' ' || alias AS value, min(ord) AS seen_at FROM t GROUP BY ALL),
    r AS (SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY seen_at) AS position
          FROM v)
    SELECT label, value, position FROM r WHERE position <= 5""")
def schema_label_examples(spark, sf):
    return gr.label_details(proposals(spark, sf), "examples", canonical(spark, sf), 5)


@query("schema_label_merge", LABEL + """,
    i AS (SELECT raw, label, count(*) AS n, round(avg(conf), 4) AS c FROM t GROUP BY raw, label),
    f AS (SELECT label, count(DISTINCT file_path) AS source_file_count FROM t GROUP BY label)
    SELECT upper(i.label[1]) || lower(i.label[2:]) AS label,
           CAST(sum(n) AS BIGINT) AS occurrence_count,
           round(sum(c * n) / sum(n), 4) AS average_confidence,
           any_value(source_file_count) AS source_file_count
    FROM i JOIN f USING (label) GROUP BY i.label""")
def schema_label_merge(spark, sf):
    items = gr.aggregate_labels(proposals(spark, sf))
    files = proposals(spark, sf).groupBy("label").agg(
        F.collect_set("file_path").alias("source_files"))  # at most one entry per brand
    return gr.merge_labels(items.join(files, "label"), canonical(spark, sf))


@query("schema_label_selection", LABEL + """,
    a AS (SELECT label, count(*) AS occurrence_count,
                 count(DISTINCT file_path) AS source_file_count,
                 round(avg(conf), 4) AS average_confidence FROM t GROUP BY label
          HAVING count(*) >= 5 OR count(DISTINCT file_path) >= 3),
    w AS (SELECT label, CAST(row_number() OVER (ORDER BY label) AS INT) AS position
          FROM (SELECT DISTINCT label FROM t))
    SELECT label, occurrence_count, source_file_count, average_confidence FROM a
    JOIN w USING (label) ORDER BY occurrence_count DESC, source_file_count DESC, position
    LIMIT 4""")
def schema_label_selection(spark, sf):
    items = gr.keep_stable_labels(schema_label_aggregate(spark, sf))
    words = canonical(spark, sf).select(F.col("canonical_label").alias("label")).distinct()
    allowed = ranked(words, [], ["label"], "position")
    return gr.select_labels(items, allowed, 4).drop("position")


@query("schema_canonicalization_report", """
    SELECT count(*) AS raw_labels, count(*) AS canonical_labels, count(*) AS changed_labels
    FROM (SELECT DISTINCT p_name FROM part)""")
def schema_canonicalization_report(spark, sf):
    return gr.canonicalization_report(proposals(spark, sf))


# --- benchmark building ---------------------------------------------------------------------------

TOPIC = "the|und|que|les"
CANDIDATES = f"""WITH {DOCS_CTE},
    l AS (SELECT doc_id, provider, source_path, i, trim(ls[i]) AS quote
          FROM (SELECT *, string_split(text, chr(10)) AS ls FROM docs) s,
               unnest(range(1, len(ls) + 1)) AS u(i)),
    k AS (SELECT provider, source_path, CAST(i AS INT) AS line_start, quote FROM l
          WHERE length(quote) BETWEEN 80 AND 900 AND NOT starts_with(quote, '|')
            AND regexp_matches(lower(quote), '{TOPIC}') AND NOT regexp_matches(lower(quote), 'ist'))"""


def candidates(spark, sf):
    return bm.candidate_lines(documents_corpus(spark, sf), TOPIC, "ist")


@query("benchmark_candidates", CANDIDATES + """
    SELECT provider, source_path, line_start, md5(quote) AS quote_md5 FROM k""")
def benchmark_candidates(spark, sf):
    return candidates(spark, sf).select("provider", "source_path", "line_start",
                                        F.md5("quote").alias("quote_md5"))


@query("benchmark_interleave", """
    WITH r AS (SELECT source AS provider, doc_id, row_number() OVER (
                 PARTITION BY source ORDER BY doc_id) - 1 AS position FROM documents)
    SELECT provider, doc_id, position FROM r""")
def benchmark_interleave(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("source").alias("provider"), "doc_id")
    return bm.interleave(rows, ["doc_id"]).select("provider", "doc_id", "position")




@query("benchmark_related_sources", CANDIDATES + r""",
    q AS (SELECT source_path || '#' || lpad(CAST(line_start AS VARCHAR), 6, '0') AS id, source_path AS path,
            list_distinct(list_filter(string_split_regex(regexp_replace(lower(quote), '[^\p{L}\p{N}_\s]', ' ', 'g'),
                                                         '\s+'), lambda w: length(w) >= 5)) AS ts FROM k),
    t AS (SELECT id, path, len(ts) AS n, unnest(ts) AS t FROM q),
    p AS (SELECT a.id, b.id AS other, a.n AS an, b.n AS bn, count(*) AS c
          FROM t a JOIN t b ON a.t = b.t AND a.path <> b.path GROUP BY ALL),
    o AS (SELECT id, other, round(c / (an + bn - c), 6) AS overlap FROM p WHERE c >= 0.12 * (an + bn - c)),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, other) AS rank FROM o)
    SELECT id, other, overlap, rank FROM r WHERE rank <= 2""")
def benchmark_related_sources(spark, sf):
    return bm.related_sources(candidates(spark, sf)).select("id", "other", "overlap", "rank")


@query("benchmark_unique_questions", r"""
    SELECT min(doc_id) AS ord FROM documents
    GROUP BY lower(trim(regexp_replace(text, '\s+', ' ', 'g')))""")
def benchmark_unique_questions(spark, sf):
    rows = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("ord"),
                                                        F.col("text").alias("question"))
    return bm.unique_questions(rows).select("ord")


@query("benchmark_stride_sample", """
    WITH e AS (SELECT o_custkey AS doc_id, row_number() OVER (
                 PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS span_index,
                 count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    s AS (SELECT doc_id, span_index, greatest(1, n // 3) AS step FROM e)
    SELECT doc_id, span_index FROM s
    ORDER BY CASE WHEN span_index % step = 0 AND span_index // step < 3 THEN 0 ELSE 1 END,
             doc_id, span_index LIMIT 3000""")
def benchmark_stride_sample(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("o_orderkey")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey")
    spans = rows.withColumn("span_index", F.row_number().over(order) - 1).drop("o_orderkey")
    return bm.stride_sample(spans, 3, 3000).select("doc_id", "span_index")


@query("benchmark_group_evidence", """
    WITH g AS (SELECT o_custkey AS case_id, o_orderpriority AS chunk_id, min(o_orderkey) AS ord,
                 CAST(min(o_orderkey % 100) AS INT) AS line_start,
                 CAST(max(o_orderkey % 100 + 2) AS INT) AS line_end,
                 arg_min(o_orderstatus, o_orderkey) AS evidence_quote, count(*) AS quote_count
               FROM orders GROUP BY ALL)
    SELECT *, CASE WHEN ord = min(ord) OVER (PARTITION BY case_id) THEN 'primary'
                   ELSE 'supporting_context' END AS relationship FROM g""")
def benchmark_group_evidence(spark, sf):
    line = (F.col("o_orderkey") % 100).cast("int")
    return bm.group_evidence(table(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("chunk_id"),
        F.col("o_orderkey").alias("ord"), line.alias("line_start"),
        (line + 2).alias("line_end"), F.col("o_orderstatus").alias("evidence_quote")))


@query("benchmark_verify_quotes", CANDIDATES + """
    SELECT source_path || '#' || line_start AS case_id, source_path, line_start,
           'quote_mismatch' AS error FROM k WHERE line_start % 2 = 0""")
def benchmark_verify_quotes(spark, sf):
    sources = candidates(spark, sf).select(
        F.concat_ws("#", "source_path", F.col("line_start").cast("string")).alias("case_id"),
        "source_path", "line_start", F.when(F.col("line_start") % 2 == 0, F.concat(
            F.col("quote"), F.lit("!"))).otherwise(F.col("quote")).alias("evidence_quote"))
    return bm.verify_quotes(sources, documents_corpus(spark, sf))


@query("benchmark_quality_caps", """
    WITH RECURSIVE c AS (
        SELECT o_orderkey AS ord, o_orderpriority AS question,
               CASE WHEN o_orderkey % 5 = 0 THEN 'call the hotline' ELSE 'x' END AS gold_answer,
               CASE WHEN o_orderstatus = 'P' THEN 'provider_list' ELSE 'claim' END AS task_type,
               CASE WHEN o_orderkey % 3 = 0 THEN 'low' ELSE 'high' END AS risk_level,
               CAST(o_orderstatus = 'P' AS INT) AS p, CAST(o_orderkey % 5 = 0 AS INT) AS h,
               CAST(o_orderkey % 3 = 0 AS INT) AS l FROM orders),
    f AS (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM c WHERE p + h + l > 0),
    r AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ord, 0 AS a, 0 AS b, 0 AS d, false AS ok
        UNION ALL
        SELECT n, ord, a + k * p, b + k * h, d + k * l, k = 1 FROM (
            SELECT f.n, f.ord, a, b, d, p, h, l, CASE WHEN (p = 0 OR a < 15) AND (h = 0 OR b < 15)
                   AND (l = 0 OR d < 45) THEN 1 ELSE 0 END AS k
            FROM r JOIN f ON f.n = r.n + 1 WHERE a < 15 OR b < 15 OR d < 45))
    SELECT ord, question, gold_answer, task_type, risk_level FROM c
    WHERE p + h + l = 0 OR ord IN (SELECT ord FROM r WHERE ok)""")
def benchmark_quality_caps(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("question"),
        F.when(F.col("o_orderkey") % 5 == 0, "call the hotline").otherwise("x")
        .alias("gold_answer"),
        F.when(F.col("o_orderstatus") == "P", "provider_list").otherwise("claim")
        .alias("task_type"), F.when(F.col("o_orderkey") % 3 == 0, "low").otherwise("high")
        .alias("risk_level"))
    return bm.apply_quality_caps(rows)


DRAWN = " UNION ALL ".join(f"""
    (SELECT '{kind}' AS case_type, doc_id, chunk_index AS first_block, chunk_index + {span - 1} AS last_block FROM b
     WHERE {"tab" if kind == "table_context" else f"NOT tab AND chunk_index + {span - 1} <= last"}
     ORDER BY md5(concat_ws('|', doc_id, chunk_index, '42', '{kind}')), doc_id, chunk_index LIMIT 30)"""
    for kind, span in bm.CONTEXTS.items())
DRAWS = dict.fromkeys(bm.CONTEXTS, 30)


@query("benchmark_context_draws", f"""
    WITH r AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber - 1 AS chunk_index, l_linenumber % 3 = 0 AS tab FROM lineitem),
    b AS (SELECT *, max(chunk_index) FILTER (NOT tab) OVER (PARTITION BY doc_id) AS last FROM r){DRAWN}""")
def benchmark_context_draws(spark, sf):
    """Order lines as blocks of a source, every third one a table: all four case types are drawn."""
    blocks = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("chunk_index"),
        (F.col("l_linenumber") % 3 == 0).alias("contains_table")).distinct()
    return bm.context_candidates(blocks, DRAWS)


@query("benchmark_context_candidates")
def benchmark_context_candidates(spark, sf):
    """Cases over the pages, whose menus are tables."""
    pages = pages_corpus(spark, sf).withColumnRenamed("page_id", "doc_id")
    return bm.context_candidates(rs.context_blocks(pages, 200, 40), DRAWS)


# --- incremental ingestion --------------------------------------------------------------------------

@query("stream_ingest_results", """
    SELECT CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) AS files FROM documents""")
def stream_ingest(spark, sf):
    """All documents through the streaming loader; its result rows are summed."""
    from docmill.streaming.ingest import ingest_stream

    root = scratch_path(spark, "ingest")
    schema = table(spark, sf, "documents").schema
    # a pattern: the table may be one file or a folder of part files
    docs = (spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")
            .select(F.col("doc_id").cast("string").alias("source_path"), "doc_id", "text"))
    def chunk(batch):
        return rs.fixed(batch).join(batch.select("doc_id", "source_path"), "doc_id")
    ingest_stream(docs, chunk, root, f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/results").agg(
        F.sum("n_chars").alias("n_chars"), F.count("*").alias("files"))
