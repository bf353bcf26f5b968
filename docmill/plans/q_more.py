"""Registered queries: cleaning, recovery, naming rules, scenarios and the stored index."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import parse as ps
from docmill.functions import text as tx
from docmill.operators import evaluation as ev
from docmill.operators import graph as gr
from docmill.operators.chunking import research as rs
from docmill.plans.corpus import documents_corpus
from docmill.plans.q_chunk import FIXED_SQL
from docmill.plans.registry import query
from docmill.session import dealt, scratch_path, table
from docmill.sources.index import ChunkIndex


@query("text_image_noise", r"""
    SELECT p_partkey, p_name || chr(10) || chr(10) || 'end ' || p_type || chr(10) AS cleaned
    FROM part""")
def image_noise(spark, sf):
    dirty = F.concat(F.col("p_name"), F.lit("\n\n![](page_img.png)\n\nA man with a "),
                     F.col("p_name"), F.lit("\n\n\nend  "), F.col("p_type"))
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return dealt(rows, "p_partkey").select("p_partkey", tx.clean_image_noise(dirty).alias("cleaned"))


@query("text_json_recovery", "SELECT event_id, props AS recovered FROM events")
def json_recovery(spark, sf):
    said = F.concat(F.lit("Here { it is: ```json\n"), F.col("props"), F.lit("\n``` and {more}"))
    return table(spark, sf, "events").select("event_id", tx.first_json_object(said)
                                             .alias("recovered"))


@query("text_document_types", """
    SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'premium_table' WHEN 1 THEN 'hospital_list'
             WHEN 2 THEN 'terms_and_rules' WHEN 3 THEN 'summary' WHEN 4 THEN 'product_brochure'
             WHEN 5 THEN 'form' ELSE 'policy' END AS document_type,
           CASE p_partkey % 7 WHEN 0 THEN '2_bieu_phi_he_so' WHEN 2 THEN '1_quy_tac_dieu_khoan'
             WHEN 3 THEN '1_quy_tac_dieu_khoan' WHEN 4 THEN '4_tai_lieu_san_pham' END AS pdf_class
    FROM part""")
def document_types(spark, sf):
    names = ("Bieu-phi", "Benh-vien", "Quy-tac", "Tom-tat", "Brochure", "To-khai", "Khac")
    name = F.get(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 7).cast("int"))
    path = F.concat_ws("/", F.lit("bic.vn"), F.concat_ws("_", name, F.col("p_partkey")))
    return table(spark, sf, "part").select("p_partkey", ps.document_type(path)
                                           .alias("document_type"),
                                           ps.pdf_class(name).alias("pdf_class"))


@query("text_risk_levels", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'high'
             WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'medium'
               ELSE 'high' END
             ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'low' ELSE 'high' END END AS risk_level
    FROM orders""")
def risk_levels(spark, sf):
    task = (F.when(F.col("o_orderstatus") == "F", "Claim ")
            .when(F.col("o_orderstatus") == "O", "premium").otherwise("policy_qa"))
    given = F.when(F.col("o_orderkey") % 2 == 0, "LOW").otherwise("High")
    return table(spark, sf, "orders").select("o_orderkey", ps.risk_level(task, given)
                                             .alias("risk_level"))


@query("evaluation_scenarios", """
    SELECT item_id, scenario_name, mode, company_filter_applied, rerank_applied
    FROM benchmark, (VALUES ('vector', 'vector', false, false), ('hybrid', 'hybrid', false, false),
      ('hybrid_company_filter', 'hybrid', true, false), ('hybrid_rerank', 'hybrid', false, true),
      ('hybrid_company_filter_rerank', 'hybrid', true, true))
      s(scenario_name, mode, company_filter_applied, rerank_applied)""")
def evaluation_scenarios(spark, sf):
    return ev.with_scenarios(table(spark, sf, "benchmark").select("item_id"))


@query("evaluation_primary_sources", """
    SELECT 'src' || (o_custkey % 40) AS source_path, min(o_orderkey) AS ord FROM orders
    WHERE 'src' || (o_custkey % 40) IN (SELECT source FROM documents) GROUP BY 1""")
def evaluation_primary_sources(spark, sf):
    path = F.concat(F.lit("src"), (F.col("o_custkey") % 40).cast("string"))
    cases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.array(
        F.struct(F.lit("other").alias("source_path"), F.lit("related").alias("relationship")),
        F.struct(path.alias("source_path"), F.lit("primary").alias("relationship")))
        .alias("expected_sources"))
    corpus = table(spark, sf, "documents").select(F.col("source").alias("source_path"))
    return ev.first_primary_sources(cases, corpus, 100)


@query("graph_pending_chunks", """
    WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id)
    SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS chunk_id FROM customer
    WHERE c_custkey NOT IN (SELECT user_id FROM last WHERE t = 'click')""")
def graph_pending_chunks(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("chunk_id"), F.col("event_id").alias("offset"),
        F.when(F.col("event_type") == "click", "success").otherwise("error").alias("status"))
    chunks = table(spark, sf, "customer").select(F.col("c_custkey").cast("string")
                                                 .alias("chunk_id"))
    return gr.pending_chunks(chunks, log)


@query("index_upsert_roundtrip", FIXED_SQL + """
    SELECT d.source AS company_code, count(*) AS chunks FROM fx JOIN documents d USING (doc_id)
    WHERE d.lang <> 'de' GROUP BY d.source""")
def index_upsert_roundtrip(spark, sf):
    """Written, written again (same ids), then one language deleted; counted per company."""
    docs = documents_corpus(spark, sf)
    langs = table(spark, sf, "documents").select("doc_id", "lang")
    chunks = rs.fixed(docs).join(docs.select("doc_id", F.col("provider").alias("company_code")),
                                 "doc_id").join(langs, "doc_id").select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
        .alias("chunk_id"), "company_code", "lang", "text")
    index = ChunkIndex(spark, scratch_path(spark, "index"))
    index.upsert(chunks)
    index.upsert(chunks)
    index.delete(index.read().filter("lang = 'de'").select("chunk_id"))
    return index.read().groupBy("company_code").agg(F.count("*").alias("chunks"))
