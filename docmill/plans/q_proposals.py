"""Registered queries: chunks at unit ranges that a table of answers proposes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions.arrays import delimited
from docmill.operators.chunking import proposals as pp
from docmill.plans.corpus import PAGES_CTE, pages_corpus
from docmill.plans.registry import query

# Answers by page: three units a range, then one kind of fault for each remainder of the id.
FIRST, LAST = "3 * i + 1", "least(3 * i + 3, n)"
KINDS = {0: (FIRST, LAST, "true"), 1: (FIRST, LAST, "i % 2 = 0"), 2: (f"greatest({FIRST} - 1, 1)", LAST, "true"), 3: (FIRST, "3 * i + 3 + n", "true")}


def _pages(spark, sf):
    return pages_corpus(spark, sf).withColumnRenamed("page_id", "doc_id").filter("length(text) > 0")


def _lines():
    return delimited(F.col("text"), "\n")


def _answers(spark, sf):
    rows = (_pages(spark, sf).select("doc_id", pp.text_key(F.col("text")).alias("text_key"), F.size(_lines()).alias("n"))
            .groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")).filter("doc_id % 6 < 5"))
    ranges = "CASE doc_id % 6 " + " ".join(
        f"WHEN {k} THEN transform(filter(sequence(0, int((n - 1) / 3)), i -> {keep}), i -> named_struct('start_unit', {a}, 'end_unit', {b}))"
        for k, (a, b, keep) in KINDS.items()) + " END"
    return rows.select("text_key", F.when(F.expr("doc_id % 6 = 4"), "no ranges today").otherwise(
        F.to_json(F.struct(F.expr(ranges).alias("chunks")))).alias("response"))


_START_SQL = " ".join(f"WHEN {k} THEN {a}" for k, (a, _, _) in KINDS.items())
_KEEP_SQL = " ".join(f"WHEN {k} THEN {keep}" for k, (_, _, keep) in KINDS.items())


@query("plan_proposed_chunks", f"""
    WITH {PAGES_CTE},
    u AS (SELECT page_id AS doc_id, text, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\s]'))) AS n
          FROM pages_md WHERE length(text) > 0),
    k AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY text) % 6 AS kind FROM u),
    r AS (SELECT doc_id, n, kind, i FROM k, unnest(range(0, (n - 1) // 3 + 1)) AS t(i) WHERE kind < 4),
    s AS (SELECT DISTINCT doc_id, n, kind, CASE kind {_START_SQL} END AS s FROM r WHERE CASE kind {_KEEP_SQL} END
          UNION SELECT doc_id, n, kind, 1 FROM k WHERE kind < 4)
    SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS chunk_index,
           CASE kind WHEN 0 THEN 'valid' WHEN 1 THEN CASE WHEN n > 3 THEN 'gapped' ELSE 'valid' END
                WHEN 2 THEN CASE WHEN n > 3 THEN 'overlapping' ELSE 'valid' END ELSE 'unknown_unit' END AS status,
           CAST(s AS INTEGER) AS first_unit, CAST(coalesce(lead(s) OVER w, n + 1) - 1 AS INTEGER) AS last_unit
    FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY s)
    UNION ALL SELECT doc_id, 0, CASE kind WHEN 4 THEN 'unreadable' ELSE 'missing' END, NULL, NULL FROM k WHERE kind >= 4""")
def plan_proposed_chunks(spark, sf):
    """Whole pages; of a page that falls back only the first piece is told, as its splits are no SQL."""
    chunks = pp.proposed_chunks(_pages(spark, sf), _answers(spark, sf), _lines())
    return chunks.filter("first_unit IS NOT NULL OR chunk_index = 0").select("doc_id", "chunk_index", "status", "first_unit", "last_unit")


@query("plan_proposal_requests", f"""
    WITH {PAGES_CTE}, k AS (SELECT md5(text) AS text_key, text, min(page_id) AS least FROM pages_md WHERE length(text) > 0 GROUP BY text)
    SELECT text_key, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\s]'))) AS n_units FROM k WHERE least % 6 = 5""")
def plan_proposal_requests(spark, sf):
    asked = pp.requests(_pages(spark, sf), _answers(spark, sf), _lines())
    return asked.select("text_key", F.size("units").cast("long").alias("n_units"))
