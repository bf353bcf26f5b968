"""Registered queries: file round trips, identifiers, caches, evidence and benchmark parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import parse as ps
from docmill.functions import text as tx
from docmill.operators import benchmark as bm
from docmill.operators import embedding as em
from docmill.operators import etl
from docmill.operators import evaluation as ev
from docmill.operators import evidence as evd
from docmill.operators import graph as gr
from docmill.operators import retrieval as rt
from docmill.operators.chunking import research as rs
from docmill.plans.q_chunk import FIXED_SQL
from docmill.plans.q_text import SEARCH
from docmill.plans.registry import query
from docmill.session import scratch_path, table
from docmill.sources import files
from docmill.sources.index import VersionedTable, chunk_with_cache
from docmill.streaming.ingest import remaining_work


# --- files ---------------------------------------------------------------------------------

@query("source_jsonl_roundtrip", """
    SELECT item_id, md5(text) AS text_md5, CASE WHEN item_id % 2 = 0 THEN item_id END AS even
    FROM benchmark""")
def source_jsonl_roundtrip(spark, sf):
    path = scratch_path(spark, "jsonl")
    files.write_jsonl(table(spark, sf, "benchmark").select(
        "item_id", "text", F.when(F.col("item_id") % 2 == 0, F.col("item_id")).alias("even")), path)
    return files.read_jsonl(spark, path, "item_id BIGINT, text STRING, even BIGINT").select(
        "item_id", F.md5("text").alias("text_md5"), "even")


@query("source_benchmark_cases", """
    SELECT 'c' || o_orderkey AS case_id, o_orderpriority AS question,
           CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE '' END AS gold_answer, '' AS task_type,
           lower(o_orderstatus) AS risk_level, 0 AS sources FROM orders""")
def source_benchmark_cases(spark, sf):
    path = scratch_path(spark, "cases")
    key = F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))
    even = F.col("o_orderkey") % 2 == 0
    files.write_jsonl(table(spark, sf, "orders").select(
        F.when(even, key).alias("case_id"), F.when(~even, key).alias("id"),
        F.when(even, F.col("o_orderpriority")).alias("question"),
        F.when(~even, F.col("o_orderpriority")).alias("query"),
        F.when(F.col("o_orderkey") % 3 == 0, "yes").alias("gold_answer"),
        F.lower("o_orderstatus").alias("risk_level")), path)
    return files.benchmark_cases(spark, path).select(
        "case_id", "question", "gold_answer", "task_type", "risk_level",
        F.size("expected_sources").alias("sources"))


@query("source_production_cases", """
    SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_orderpriority AS query,
           'p' || o_custkey % 9 || '/a.md' AS source_path,
           CASE WHEN o_orderkey % 4 = 0 THEN 'given' ELSE 'p' || o_custkey % 9 END AS provider,
           0 AS evidence FROM orders""")
def source_production_cases(spark, sf):
    absent = F.lit(None).cast("string")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit(" "), "o_orderpriority", F.lit("  "))
        .alias("query"), F.concat(F.lit("p"), (F.col("o_custkey") % 9).cast("string"), F.lit("/a.md"))
        .alias("source_path"), F.when(F.col("o_orderkey") % 4 == 0, "given").alias("provider"),
        absent.alias("benchmark_version"), absent.alias("difficulty"), absent.alias("task_type"),
        absent.alias("evidence_quote"), F.lit(None).cast("array<string>").alias("expected_evidence"))
    return files.production_cases(rows).select(
        "case_id", "query", "source_path", "provider", F.size("expected_evidence").alias("evidence"))


@query("source_csv_sorted_nested", """
    SELECT p_brand AS a_brand, '["' || p_type || '",' || '"x"]' AS b_list,
           '{"key":' || p_partkey || '}' AS c_nested, p_partkey AS d_key FROM part""")
def source_csv_sorted_nested(spark, sf):
    path = scratch_path(spark, "csv")
    files.write_csv(table(spark, sf, "part").select(
        F.col("p_partkey").alias("d_key"), F.struct(F.col("p_partkey").alias("key")).alias("c_nested"),
        F.array("p_type", F.lit("x")).alias("b_list"), F.col("p_brand").alias("a_brand")), path,
        sorted_columns=True)
    schema = "a_brand STRING, b_list STRING, c_nested STRING, d_key BIGINT"
    return spark.read.schema(schema).option("header", True).option("escape", "\\").csv(path)


@query("source_json_scan", "SELECT count(*) AS records, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part")
def source_json_scan(spark, sf):
    """Extraction files found below a root; a report of an earlier run is left out."""
    root = scratch_path(spark, "extractions")
    table(spark, sf, "part").select("p_partkey").write.json(f"{root}/a/tables")
    table(spark, sf, "part").select("p_partkey").write.json(f"{root}/a/classification_output")
    found = files.extraction_files(spark, root)
    lines = found.select(F.explode(F.split("content", "\n")).alias("line")).filter("line <> ''")
    return lines.select(F.get_json_object("line", "$.p_partkey").cast("bigint").alias("k")).agg(
        F.count("*").alias("records"), F.sum("k").alias("keys"))


@query("source_union_columns", """
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS BIGINT) AS nation
    FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier""")
def source_union_columns(spark, sf):
    return files.union_columns([
        table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                            F.col("c_mktsegment").alias("segment")),
        table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                                            F.col("s_nationkey").cast("bigint").alias("nation"))])


# --- scalar rules --------------------------------------------------------------------------

@query("text_truncate", "SELECT p_partkey, p_name[1:9] AS short FROM part")
def text_truncate(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.truncate(F.col("p_name"), 9).alias("short"))


@query("rank_helpers", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 3 THEN 1.0 ELSE 0.0 END AS hit,
           1.0 / l_linenumber AS rr,
           CASE WHEN l_suppkey % 3 > 0 THEN l_linenumber - l_suppkey % 3 END AS gained
    FROM lineitem""")
def rank_helpers(spark, sf):
    after = F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 3)
    rank = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", ps.rank_hit(rank, 3).alias("hit"),
        ps.reciprocal_rank(rank).alias("rr"), ps.rank_delta(rank, after).alias("gained"))


@query("graph_node_ids", """
    SELECT c_custkey, 'insurance_company:' || upper(c_mktsegment) AS company,
           'insurance_document:' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_') AS document,
           'insurance_plan:' || upper(c_mktsegment) || ':'
             || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_') AS plan,
           'source_chunk:' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_')
             || ':' || c_nationkey AS chunk FROM customer""")
def graph_node_ids(spark, sf):
    segment, name = F.concat(F.lit(" "), F.lower("c_mktsegment")), F.col("c_name")
    return table(spark, sf, "customer").select(
        "c_custkey", tx.company_node(segment).alias("company"), tx.document_node(name).alias("document"),
        tx.plan_node(segment, name).alias("plan"), tx.chunk_node(name, F.col("c_nationkey")).alias("chunk"))


@query("metadata_sanitize", """
    SELECT p_partkey, p_name[1:12] AS name, CAST(NULL AS VARCHAR) AS heavy, 2 AS fields FROM part""")
def metadata_sanitize(spark, sf):
    meta = F.create_map(F.lit("name"), F.col("p_name"), F.lit("heavy"), F.col("p_type"),
                        F.lit("brand"), F.col("p_brand"))
    kept = table(spark, sf, "part").select("p_partkey", tx.sanitize_metadata(meta, ("heavy",), 12).alias("m"))
    return kept.select("p_partkey", F.try_element_at("m", F.lit("name")).alias("name"),
                       F.try_element_at("m", F.lit("heavy")).alias("heavy"), F.size("m").alias("fields"))


@query("benchmark_case_rules", """
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'thời_gian_chờ' WHEN 1 THEN 'bồi_thường'
             WHEN 2 THEN 'hồ_sơ' ELSE 'policy_qa' END AS task_type,
           CASE WHEN p_partkey % 4 = 1 THEN 'high' ELSE 'medium' END AS risk FROM part""")
def benchmark_case_rules(spark, sf):
    words = F.array(*[F.lit(w) for w in ("Thời gian chờ", "bồi thường", "hồ sơ", "khác")])
    quote = F.concat_ws(" ", F.get(words, (F.col("p_partkey") % 4).cast("int")), F.col("p_name"))
    asked = ps.fallback_question(F.lit("aia"), F.lit("aia/quy-tac.md"), quote)
    return table(spark, sf, "part").select("p_partkey", asked.alias("q")).select(
        "p_partkey", "q.task_type", "q.risk")


@query("evaluation_scoring_key", """
    SELECT o_orderkey, sha256('{"config":"c1","case":"' || o_orderkey || '","contexts":["'
           || o_orderpriority || '"]}') AS scoring_key FROM orders""")
def evaluation_scoring_key(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", ev.scoring_key(
        F.lit("c1"), F.col("o_orderkey").cast("string"), F.array("o_orderpriority")).alias("scoring_key"))


@query("span_relevance", """
    WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS a, CAST(l_suppkey % 60 AS INT) AS b
               FROM lineitem),
    o AS (SELECT *, greatest(0, least(a + 20, b + 30) - greatest(a, b)) AS shared FROM s)
    SELECT l_orderkey, l_linenumber, shared, round(least(1.0, shared / 30.0), 6) AS relevance,
           round(0.78 * shared + 0.22 * a, 4) AS overall FROM o""")
def span_relevance(spark, sf):
    a, b = F.col("l_quantity").cast("int"), (F.col("l_suppkey") % 60).cast("int")
    shared = ev.overlap_chars(a, a + 20, b, b + 30)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", shared.alias("shared"),
        F.round(ev.chunk_relevance((a, a + 20), (b, b + 30)), 6).alias("relevance"),
        F.round(ev.overall_score(shared, a), 4).alias("overall"))


# --- retrieval and evidence ----------------------------------------------------------------

@query("query_preparation", "SELECT item_id AS query_id, " + SEARCH.format(c="text || ' ' || text")
       + " AS query FROM benchmark")
def query_preparation(spark, sf):
    return rt.prepare_queries(table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.array("text", "text").alias("search_queries")))


@query("embedding_text", """
    SELECT item_id, 'query: ' || text AS q, 'passage: ' || text AS p,
           'Instruct: Given a search query, retrieve relevant passages' || chr(10) || 'Query:' || text AS i,
           text AS d, 'query: ' || text AS once FROM benchmark""")
def embedding_text(spark, sf):
    text = F.col("text")
    return table(spark, sf, "benchmark").select(
        "item_id", em.prepare_text(text, "query", "e5").alias("q"),
        em.prepare_text(text, "document", "e5").alias("p"),
        em.prepare_text(text, "query", "instruct").alias("i"),
        em.prepare_text(text, "document", "instruct").alias("d"),
        em.prepare_text(F.concat(F.lit("query: "), text), "query", "e5").alias("once"))


def _lengths(text):
    return F.array(F.length(text).cast("double"))


@query("embedding_cache", """
    SELECT doc_id, CAST(length(text) AS DOUBLE) AS first,
           (SELECT count(DISTINCT text) FROM documents WHERE text NOT IN
              (SELECT text FROM documents WHERE doc_id % 3 = 0)) AS computed FROM documents""")
def embedding_cache(spark, sf):
    """A third of the documents is cached; only new distinct texts are embedded."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = docs.filter("doc_id % 3 = 0").select(
        em.cache_key(F.col("text"), "local", "m", "document", "").alias("cache_key"),
        _lengths("text").alias("embedding")).dropDuplicates(["cache_key"])
    filled, fresh = em.embed_with_cache(docs, cache, _lengths, "local", "m", "document")
    return filled.select("doc_id", F.col("embedding")[0].alias("first"),
                         fresh.agg(F.count("*")).scalar().alias("computed"))


@query("embedding_cache_statistics", """
    SELECT count(*) FILTER (text IN (SELECT text FROM documents WHERE doc_id % 3 = 0)) AS hits,
           count(*) FILTER (text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)) AS misses,
           0 AS stale FROM documents""")
def embedding_cache_statistics(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = docs.filter("doc_id % 3 = 0").select(
        em.cache_key(F.col("text"), "local", "m", "document", "").alias("cache_key"),
        _lengths("text").alias("embedding"), F.lit(1).alias("dimensions")).dropDuplicates(["cache_key"])
    return em.cache_statistics(docs, cache, "local", "m", "document")


@query("embedding_fill", """
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN -1.0 ELSE CAST(length(text) AS DOUBLE) END AS first
    FROM documents""")
def embedding_fill(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", F.when(
        F.col("doc_id") % 2 == 0, F.array(F.lit(-1.0))).alias("embedding"))
    return em.fill_vectors(rows, _lengths).select("doc_id", F.col("embedding")[0].alias("first"))


@query("evidence_from_chunks", """
    SELECT doc_id AS query_id, 'qdrant_chunk' AS source_type, CAST(doc_id AS VARCHAR) AS source_id,
           md5(text) AS content_md5, CASE WHEN doc_id % 3 = 0 THEN 1.0 WHEN doc_id % 3 = 1 THEN 0.0
             ELSE 0.5 END AS confidence FROM documents""")
def evidence_from_chunks(spark, sf):
    from docmill.operators.chunking.production import REQUIRED

    score = F.when(F.col("doc_id") % 3 == 0, 1.7).when(F.col("doc_id") % 3 == 1, -0.2).otherwise(0.5)
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("doc_id").alias("chunk_id"), "text", score.alias("score"),
        *[F.lit("x").alias(c) for c in REQUIRED])
    return evd.from_chunks(rows).select("query_id", "source_type", "source_id",
                                        F.md5("content").alias("content_md5"), "confidence")


@query("evidence_scored_merge", """
    WITH k AS (SELECT min(doc_id) AS ord, length(trim(text, chr(10) || ' ')) AS n, source
               FROM documents GROUP BY lang, source, text)
    SELECT ord, CAST(n AS DOUBLE) AS rerank_score FROM k
    ORDER BY n DESC, ord LIMIT 50""")
def evidence_scored_merge(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("lang").alias("source_type"), F.col("source").alias("source_id"),
        F.col("text").alias("content"), F.col("doc_id").alias("ord"))
    kept, _ = evd.merge(rows, 50, score=lambda t: F.length(t).cast("double"))
    return kept.select("ord", "rerank_score")


@query("context_efficiency", """
    WITH r AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, l_suppkey % 3 AS doc_id,
                      CAST(l_quantity AS INT) AS a FROM lineitem WHERE l_linenumber <= 5),
    e AS (SELECT o_orderkey AS query_id, o_custkey % 3 AS doc_id, CAST(o_orderkey % 40 AS INT) AS b FROM orders)
    SELECT r.query_id, round(max(CASE WHEN r.doc_id = e.doc_id THEN
             greatest(0, least(a + 15, b + 20) - greatest(a, b)) ELSE 0 END) / (15.0 * count(*)), 6)
             AS context_efficiency_5 FROM r JOIN e USING (query_id) GROUP BY r.query_id""")
def context_efficiency(spark, sf):
    a, b = F.col("l_quantity").cast("int"), (F.col("o_orderkey") % 40).cast("int")
    found = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"),
        (F.col("l_suppkey") % 3).alias("doc_id"), a.alias("start"), (a + 15).alias("end"),
        F.lit(15).alias("n_chars"))
    evidence = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 3).alias("doc_id"),
        b.alias("start"), (b + 20).alias("end"))
    return ev.context_efficiency(found, evidence)


@query("judge_inputs", """
    SELECT l_returnflag AS strategy, l_orderkey AS case_id, o_orderpriority AS question,
           string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, CAST(l_suppkey AS VARCHAR)) AS chunk_ids
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 2 = 0 GROUP BY ALL""")
def judge_inputs(spark, sf):
    found = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("strategy"), F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").alias("rank"), F.col("l_suppkey").cast("string").alias("chunk_id"))
    cases = table(spark, sf, "orders").filter("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("question"))
    return ev.judge_inputs(found, cases).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


# --- small pipelines ------------------------------------------------------------------------

FILES = "'src' || p_partkey % 30 || '/doc' || p_partkey % 7"


@query("etl_document_tables", f"""
    WITH t AS (SELECT p_partkey AS id, {FILES} || '/t.json' AS file_path FROM part),
    d AS (SELECT doc_id, source || '/doc' || doc_id % 9 || '/' || doc_id || '.md' AS path,
                 source || '/doc' || doc_id % 9 AS folder FROM documents)
    SELECT path, coalesce(min(id), -1) AS source_table_id, count(id) AS tables
    FROM d LEFT JOIN t ON starts_with(file_path, folder || '/') GROUP BY path""")
def etl_document_tables(spark, sf):
    """Tables of a document's folder, and the lowest of them or -1."""
    documents = table(spark, sf, "documents").select(F.concat_ws(
        "/", "source", F.concat(F.lit("doc"), (F.col("doc_id") % 9).cast("string")),
        F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))
    tables = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat(
            F.lit("src"), (F.col("p_partkey") % 30).cast("string"), F.lit("/doc"),
            (F.col("p_partkey") % 7).cast("string"), F.lit("/t.json")).alias("file_path"),
        F.lit("x").alias("table_type"), F.lit(1).alias("page_number"))
    mapped = etl.map_documents_to_tables(documents, tables)
    first = etl.first_table_or_minus_one(mapped)
    return first.join(mapped.groupBy("path").agg(F.count("source_table_id").alias("tables")), "path")


@query("etl_description_reuse", """
    SELECT p_partkey, (SELECT min('about ' || q.p_type) FROM part q
                       WHERE q.p_partkey % 2 = 0 AND q.p_type = part.p_type) AS description FROM part""")
def etl_description_reuse(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("table_text"))
    known = parts.filter("p_partkey % 2 = 0").select(
        "table_text", F.concat(F.lit("about "), "table_text").alias("description"))
    return etl.reuse_descriptions(parts, known).select("p_partkey", "description")


@query("graph_source_documents", """
    SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id || ':c' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS id,
           md5(CASE WHEN doc_id % 3 = 0 THEN lang || ' x' ELSE text END) AS text_md5 FROM documents""")
def graph_source_documents(spark, sf):
    rows = table(spark, sf, "documents")
    key = F.col("doc_id").cast("string")
    docs = rows.select(key.alias("document_id"), F.col("source").alias("document_name"),
                       F.col("source").alias("company_code"), F.col("source").alias("source_path"), "text")
    chunks = rows.filter("doc_id % 3 < 2").select(
        key.alias("document_id"), F.concat(F.lit("c"), key).alias("chunk_id"),
        F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit(" x\n"))).otherwise("  ").alias("text"))
    return gr.source_documents(docs, chunks).select("id", F.md5("text").alias("text_md5"))


@query("graph_property_filter", """
    SELECT c_custkey, c_name AS name, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS secret,
           c_mktsegment AS evidence_text, '0.5' AS confidence FROM customer""")
def graph_property_filter(spark, sf):
    props = F.create_map(F.lit("name"), F.col("c_name"), F.lit("id"), F.lit("1"), F.lit("secret"),
                         F.lit("x"), F.lit("evidence_text"), F.lit("old"))
    kept = gr.extraction_properties(
        props, {"source_path": F.lit("a.md"), "empty": F.lit(None)},
        ["name", "id", "evidence_text", "confidence", "empty"], F.col("c_mktsegment"), F.lit(0.5))
    rows = table(spark, sf, "customer").select("c_custkey", kept.alias("m"))
    return rows.select("c_custkey", *[F.try_element_at("m", F.lit(n)).alias(n)
                                      for n in ("name", "id", "secret", "evidence_text", "confidence")])


@query("graph_match_files", """
    WITH c AS (SELECT source AS company_code, doc_id, source || '/' || doc_id % 50 || '.md' AS path FROM documents),
    p AS (SELECT path, min('d' || doc_id) AS document_id, arg_min(company_code, 'd' || doc_id) AS company_code
          FROM c GROUP BY path)
    SELECT path, coalesce(p.document_id, CAST(n AS VARCHAR)) AS document_id,
           coalesce(company_code, 'UNKNOWN') AS company_code
    FROM (SELECT 'src' || s || '/' || n || '.md' AS path, n FROM range(0, 25) a(s), range(0, 60, 7) b(n)) f
    LEFT JOIN p USING (path)
    WHERE 'src' || split_part(split_part(path, '/', 1), 'src', 2) IN (SELECT source FROM documents)""")
def graph_match_files(spark, sf):
    rows = table(spark, sf, "documents")
    name = F.concat((F.col("doc_id") % 50).cast("string"), F.lit(".md"))
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    # every name occurs in several folders, so a file without its own path matches nothing
    chunks = rows.select(key.alias("chunk_id"), F.concat_ws("/", "source", name).alias("source_path"),
                         key.alias("document_id"), F.col("source").alias("document_name"),
                         F.col("source").alias("company_code"))
    wanted = rows.select("source").distinct().select(F.col("source"), F.explode(
        F.sequence(F.lit(0), F.lit(59), F.lit(7))).alias("n")).select(F.concat(
            "source", F.lit("/"), F.col("n").cast("string"), F.lit(".md")).alias("path"))
    return gr.match_chunks_to_files(wanted, chunks).select("path", "document_id", "company_code")


@query("graph_compact_properties", """
    SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_type FROM part""")
def graph_compact_properties(spark, sf):
    return gr.compact_properties(table(spark, sf, "part").select(
        F.col("p_partkey").alias("position"), F.col("p_name").alias("label"),
        F.array("p_brand", F.lit("id"), "p_type").alias("properties")))


@query("graph_sink_roundtrip", """
    SELECT 'nodes' AS part, count(*) AS n FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)
    UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders)""")
def graph_sink_roundtrip(spark, sf):
    root = scratch_path(spark, "graph")
    none = F.create_map().cast("map<string,string>")
    gr.write_graph(
        table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("id"),
                                            F.col("c_mktsegment").alias("entity_type"), none.alias("props")),
        table(spark, sf, "orders").select(
            F.col("o_custkey").cast("string").alias("src"), F.col("o_orderstatus").alias("dst"),
            F.col("o_orderpriority").alias("relationship_type"), none.alias("props")), root)
    counts = [spark.read.parquet(f"{root}/{p}").agg(F.lit(p).alias("part"), F.count("*").alias("n"))
              for p in ("nodes", "edges")]
    return counts[0].unionByName(counts[1])


@query("graph_label_batches", """
    SELECT label, CAST(floor((row_number() OVER (ORDER BY family, label) - 1) / 7) AS BIGINT) AS batch
    FROM (SELECT DISTINCT upper(p_brand) AS label, '' AS family FROM part)""")
def graph_label_batches(spark, sf):
    labels = table(spark, sf, "part").select(F.upper("p_brand").alias("label")).distinct() \
        .withColumn("aliases", F.lit(None).cast("array<string>"))
    return gr.batches(labels, 7).select("label", "batch")


@query("benchmark_renumber", """
    SELECT o_orderkey AS id, format('case_{:05d}', row_number() OVER (ORDER BY CASE o_orderkey % 3
             WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 999 END, o_orderkey)) AS new_id FROM orders""")
def benchmark_renumber(spark, sf):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "single_context").when(
        F.col("o_orderkey") % 3 == 1, "two_context").otherwise("other")
    return bm.renumber(table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), kind.alias("case_type"))).select("id", "new_id")


@query("benchmark_case_type_counts", """
    SELECT CASE t WHEN 'single_context' THEN 0 WHEN 'table_context' THEN 3 ELSE 4 END AS position,
           t AS case_type, count(*) AS cases
    FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'single_context' WHEN 1 THEN 'table_context'
                 ELSE 'other' END AS t FROM orders) GROUP BY t""")
def benchmark_case_type_counts(spark, sf):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "single_context").when(
        F.col("o_orderkey") % 3 == 1, "table_context").otherwise("other")
    return bm.case_type_counts(table(spark, sf, "orders").select(kind.alias("case_type")))


@query("benchmark_sampled_chunks", """
    SELECT p_partkey AS chunk_id, p_brand, min(l_orderkey) AS first_ord
    FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_linenumber = 1 GROUP BY ALL""")
def benchmark_sampled_chunks(spark, sf):
    cases = table(spark, sf, "lineitem").filter("l_linenumber = 1").select(
        F.col("l_orderkey").alias("ord"), F.array("l_partkey", F.lit(-1).cast("bigint")).alias("required_chunk_ids"))
    chunks = table(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), "p_brand")
    return bm.sampled_chunks(cases, chunks)


@query("benchmark_verify_cases", """
    WITH c AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)
    SELECT doc_id AS case_id, 'empty_question' AS error FROM c WHERE doc_id % 11 = 0
    UNION ALL SELECT doc_id, 'empty_gold_answer' FROM c WHERE doc_id % 13 = 0
    UNION ALL SELECT doc_id, 'missing_sources' FROM c WHERE doc_id % 29 = 0
    UNION ALL SELECT doc_id, 'context_count' FROM c WHERE doc_id % 29 > 0 AND doc_id % 7 = 0
    UNION ALL SELECT doc_id, 'chunk_ids' FROM c WHERE doc_id % 29 > 0 AND doc_id % 9 = 0
    UNION ALL SELECT doc_id, 'no_table_source' FROM c WHERE doc_id % 29 > 0 AND doc_id % 4 = 1
    UNION ALL SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'missing_source_path'
             WHEN doc_id % 19 = 0 THEN 'unknown_source_path' WHEN doc_id % 23 = 0 THEN 'empty_quote'
             WHEN 1 + doc_id % 2 > n THEN 'invalid_line_range' ELSE 'quote_not_found' END
    FROM c WHERE doc_id % 29 > 0 AND (doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 23 = 0
                 OR 1 + doc_id % 2 > n OR doc_id % 5 = 0)""")
def benchmark_verify_cases(spark, sf):
    """Every document as a case whose fields break the rules by turns."""
    d = F.col("doc_id")
    first = F.element_at(F.split("text", "\n"), 1)
    path = F.when(d % 17 == 0, "").when(d % 19 == 0, "nowhere.md").otherwise(d.cast("string"))
    quote = F.when(d % 23 == 0, " ").when(d % 5 == 0, F.concat(first, F.lit("!"))).otherwise(first)
    source = F.struct(
        F.when(d % 9 == 0, "other").otherwise("c1").alias("chunk_id"), path.alias("source_path"),
        (d % 4 == 3).alias("contains_table"), quote.alias("evidence_quote"),
        F.lit(1).alias("line_start"), (1 + d % 2).cast("int").alias("line_end"))
    rows = table(spark, sf, "documents")
    cases = rows.select(
        d.alias("case_id"), F.when(d % 11 == 0, " ").otherwise("q").alias("question"),
        F.when(d % 13 > 0, "a").alias("gold_answer"),
        F.when(d % 7 == 0, 2).otherwise(1).alias("context_count"),
        F.array(F.lit("c1")).alias("required_chunk_ids"), (d % 2 == 1).alias("needs_table"),
        F.when(d % 29 > 0, F.array(source)).alias("sources"))
    return bm.verify_cases(cases, rows.select(d.cast("string").alias("source_path"), "text"))


@query("benchmark_distribution_errors", """
    SELECT t AS case_type, CASE t WHEN 'single_context' THEN 5 ELSE 0 END AS expected, count(*) AS found
    FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'single_context' WHEN 1 THEN 'table_context'
                 ELSE 'other' END AS t FROM orders) GROUP BY t
    UNION ALL SELECT 'three_context', 2, 0""")
def benchmark_distribution_errors(spark, sf):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "single_context").when(
        F.col("o_orderkey") % 3 == 1, "table_context").otherwise("other")
    return bm.distribution_errors(table(spark, sf, "orders").select(kind.alias("case_type")),
                                  {"single_context": 5, "two_context": 0, "three_context": 2})


@query("benchmark_evidence_items", """
    SELECT p_partkey, 0 AS i, '' AS chunk_id, p_name AS quote FROM part WHERE p_partkey % 3 < 2
    UNION ALL SELECT p_partkey, 1, 'c' || p_partkey, p_type FROM part WHERE p_partkey % 3 < 2""")
def benchmark_evidence_items(spark, sf):
    def named(key):
        return F.to_json(F.struct(F.concat(F.lit(" c"), F.col("p_partkey").cast("string")).alias("chunk_id"),
                                  F.col("p_type").alias(key)))
    odd = F.col("p_partkey") % 2 == 0
    listed = F.concat(F.lit("["), F.to_json(F.struct(F.col("p_name").alias("x"))), F.lit("]"))
    text = F.concat(F.lit('["'), F.col("p_name"), F.lit('",'),
                    F.when(odd, named("quote")).otherwise(named("evidence_quote")), F.lit(', {"chunk_id":"z"}, ""]'))
    value = F.when(F.col("p_partkey") % 3 < 2, text).otherwise(F.substring(listed, 2, 1 << 10))
    rows = table(spark, sf, "part").select("p_partkey", F.posexplode(bm.evidence_items(value)).alias("i", "e"))
    return rows.select("p_partkey", "i", "e.chunk_id", "e.quote")


@query("graph_contract_columns", """
    SELECT trim(p_brand) AS node_type, count(*) AS n FROM part WHERE p_partkey % 3 > 0 GROUP BY 1""")
def graph_contract_columns(spark, sf):
    path = scratch_path(spark, "contract")
    files.write_csv(table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_brand"))
        .alias("node_type"), "p_partkey"), path)
    return gr.contract_column(spark, path, "node_type").groupBy("node_type").agg(F.count("*").alias("n"))


@query("graph_property_definitions", """
    WITH r AS (SELECT p_brand AS label, p_type AS name, p_name AS description, p_partkey AS k, 0 AS i FROM part
               UNION ALL SELECT p_brand, 'fixed', CAST(p_partkey AS VARCHAR), p_partkey, 1 FROM part)
    SELECT label, name, arg_min(description, k * 2 + i) AS description FROM r GROUP BY label, name""")
def graph_property_definitions(spark, sf):
    def one(name, text):
        return F.struct(name.alias("name"), text.alias("description"))
    return gr.property_definitions(table(spark, sf, "part").select(
        F.col("p_partkey").alias("position"), F.col("p_brand").alias("label"), F.array(
            one(F.col("p_type"), F.col("p_name")),
            one(F.lit("fixed"), F.col("p_partkey").cast("string"))).alias("properties")))


@query("chunker_ranking", """
    WITH s AS (SELECT event_type AS method, round(avg(value), 6) AS r, round(max(value), 6) AS q
               FROM events GROUP BY 1),
    o AS (SELECT method, r AS retrieval_score, q AS quality_score, round(0.78 * r + 0.22 * q, 6) AS overall_score FROM s)
    SELECT *, row_number() OVER (ORDER BY overall_score DESC, method) - 1 AS place FROM o""")
def chunker_ranking(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.col("event_type").alias("method")).agg(
        F.round(F.avg("value"), 6).alias("retrieval_score"), F.round(F.max("value"), 6).alias("quality_score"))
    return ev.rank_methods(rows, rows)


@query("etl_pairs", """
    SELECT CAST(doc_id AS VARCHAR) AS stem, 'img/' || doc_id || '.png' AS image,
           'json/' || doc_id || '.json' AS json FROM documents WHERE doc_id % 5 > 0""")
def etl_pairs(spark, sf):
    return _split_pairs(spark, sf).select("stem", "image", "json")


@query("etl_split_sizes", """
    SELECT 'train' AS split, CAST(ceil(0.9 * count(*)) AS BIGINT) AS n FROM documents WHERE doc_id % 5 > 0
    UNION ALL SELECT 'validation', count(*) - CAST(ceil(0.9 * count(*)) AS BIGINT)
    FROM documents WHERE doc_id % 5 > 0""")
def etl_split_sizes(spark, sf):
    return _split_pairs(spark, sf).groupBy("split").agg(F.count("*").alias("n"))


def _split_pairs(spark, sf):
    d = table(spark, sf, "documents")
    key = F.col("doc_id").cast("string")
    return etl.pair_by_stem(
        d.select(F.concat(F.lit("img/"), key, F.lit(".png")).alias("path")),
        d.filter("doc_id % 5 > 0").select(F.concat(F.lit("json/"), key, F.lit(".json")).alias("path")))


@query("etl_outcome_kinds", """
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'skipped_no_company' WHEN 1 THEN 'skipped_bad_json'
             WHEN 2 THEN 'skipped_no_mapping' WHEN 3 THEN 'skipped_unknown_table' ELSE 'files_ok' END AS status,
           CASE WHEN p_partkey % 5 = 4 THEN 2 ELSE 0 END AS row_count FROM part""")
def etl_outcome_kinds(spark, sf):
    """Files of every fate: unknown company, broken text, unmapped keys, unknown target, loaded."""
    kind = F.col("p_partkey") % 5
    cell = F.when(kind == 2, "Không rõ").when(kind == 3, "Lạ").otherwise("Tên")
    rows = F.array(F.create_map(cell, F.col("p_name")), F.create_map(cell, F.lit("x")))
    text = F.when(kind == 1, "no { json").otherwise(F.to_json(F.struct(rows.alias("structured_data"))))
    path = F.concat_ws("/", F.when(kind == 0, "nobody.example").otherwise("bic.vn"), F.lit("doc"),
                       F.concat(F.col("p_partkey").cast("string"), F.lit(".json")))
    files_ = table(spark, sf, "part").select(path.alias("path"), text.alias("content"))
    role = ("row_label", "name_vi", None, None)
    mapping = spark.createDataFrame(
        [("Tên", "hospitals", "", {"Tên": role}), ("Lạ", "nowhere", "", {"Lạ": role})],
        f"keyset_id STRING, target_table STRING, map_description STRING, key_roles MAP<STRING, {etl.ROLE}>")
    companies = spark.createDataFrame([(3, "bic")], "id BIGINT, code STRING")
    done = etl.ingest(etl.parse_extractions(files_), mapping, companies).outcomes
    key = F.regexp_extract("path", r"(\d+)\.json$", 1).cast("bigint")
    return done.select(key.alias("p_partkey"), "status", "row_count")


# --- resuming and caches ---------------------------------------------------------------------

@query("stream_remaining_work", """
    SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority LIKE '1%')""")
def stream_remaining_work(spark, sf):
    items = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    done = items.filter("o_orderpriority LIKE '1%'").withColumn("status", F.when(
        F.col("o_orderstatus") == "F", "success").otherwise("error"))
    return remaining_work(items, done, ["o_orderstatus", "o_orderpriority"]).select("o_orderkey")


@query("chunk_cache_roundtrip", FIXED_SQL + """
    SELECT doc_id, count(*) AS chunks FROM fx GROUP BY doc_id""")
def chunk_cache_roundtrip(spark, sf):
    """Half of the documents is chunked first; the second call chunks only the others."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = VersionedTable(spark, scratch_path(spark, "chunk-cache"))

    def chunk(keyed):
        return rs.fixed(keyed).join(keyed.select("doc_id", "cache_key"), "doc_id")
    chunk_with_cache(docs.filter("doc_id % 2 = 0"), cache, {"size": 300}, chunk)
    both = chunk_with_cache(docs, cache, {"size": 300}, chunk)
    return both.groupBy("doc_id").agg(F.count("*").alias("chunks"))
