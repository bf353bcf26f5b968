"""Registered queries: scores of chunks and of retrieval as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.operators import benchmark as bm
from docmill.operators import evaluation as ev
from docmill.operators.quota import fill_quota
from docmill.plans.q_retrieval import graded_retrieval_metrics
from docmill.plans.registry import ORACLES, query
from docmill.session import scratch_path, spread, table
from docmill.sources.index import VersionedTable

KEYWORDS = ("the", "que", "der", "tion", "absent word")
PHRASES = ("the and", "de la", "und die der")


def _turns(spark, sf):
    return spread(table(spark, sf, "conversations")).select("conv_id", "turn", "text")


@query("chunk_keyword_coverage", "SELECT conv_id, round((" + " + ".join(
    f"max(CAST(contains(lower(text), '{k}') AS INT))" for k in KEYWORDS) + f") / {len(KEYWORDS)}.0, 2) AS keyword_coverage FROM conversations GROUP BY conv_id")
def chunk_keyword_coverage(spark, sf):
    """Turns as the chunks of a conversation."""
    return ev.keyword_coverage(_turns(spark, sf), KEYWORDS, ["conv_id"])


def _split_sql(phrase: str) -> str:
    """1 where a phrase stands in pieces across turns and nowhere whole."""
    words = phrase.split()
    apart = " OR ".join(
        f"coalesce(min(turn) FILTER (contains(low, '{' '.join(words[:i])}')) < max(turn) FILTER (contains(low, '{' '.join(words[i:])}')"
        f" AND NOT contains(low, '{' '.join(words[:i])}')), false)" for i in range(1, len(words)))
    return f"CAST(({apart}) AND NOT bool_or(contains(low, '{phrase}')) AS INT)"


@query("chunk_concept_integrity", f"""
    SELECT conv_id, round(1 - ({" + ".join(map(_split_sql, PHRASES))}) / {len(PHRASES)}.0, 2) AS concept_integrity
    FROM (SELECT *, lower(text) AS low FROM conversations) GROUP BY conv_id""")
def chunk_concept_integrity(spark, sf):
    return ev.concept_integrity(_turns(spark, sf), PHRASES, ["conv_id"], "turn")


@query("retrieval_overall_score", f"""
    SELECT count(*) AS queries, round(avg(hit_1), 6) AS hit_1, round(avg(hit_3), 6) AS hit_3, round(avg(hit_5), 6) AS hit_5,
           round(avg(mrr_5), 6) AS mrr_5, round(avg(ndcg_5), 6) AS ndcg_5, round(avg(coverage_5), 6) AS coverage_5,
           round(100 * (0.30 * avg(hit_1) + 0.20 * avg(hit_3) + 0.15 * avg(hit_5) + 0.20 * avg(mrr_5) + 0.15 * avg(coverage_5)), 4) AS retrieval_score
    FROM ({ORACLES["graded_retrieval_metrics"]})""")
def retrieval_overall_score(spark, sf):
    return ev.retrieval_score(graded_retrieval_metrics(spark, sf))


def _asked(text, attempt):
    if len(text) % 5 == 0:
        raise ValueError("no answer")
    return "" if len(text) % 7 == 0 else text[:40]


# A quarter of the documents asks for each case type; a source may have four times its share of cases.
@query("benchmark_fill_quota", """
    WITH d AS (SELECT *, ['single_context', 'two_context', 'three_context', 'table_context'][doc_id % 4 + 1] AS case_type FROM documents)
    SELECT case_type, least(count(*) FILTER (length(text) % 5 <> 0 AND length(text) % 7 <> 0), count(*) // 10) AS accepted,
           true AS fine, true AS within_cap
    FROM d GROUP BY case_type""")
def benchmark_fill_quota(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    kinds = F.array(*map(F.lit, bm.CONTEXTS))
    candidates = docs.select(F.col("doc_id").cast("string").alias("candidate_id"), F.get(kinds, (F.col("doc_id") % 4).cast("int")).alias("case_type"),
                             F.col("source").alias("capped_by"), "text")
    sizes = {r.case_type: r["count"] for r in candidates.groupBy("case_type").count().collect()}
    quota = {kind: sizes.get(kind, 0) // 10 for kind in bm.CONTEXTS}
    cap = max(4 * sum(quota.values()) // 10, 1)
    log = VersionedTable(spark, scratch_path(spark, "cases"))
    fill_quota(candidates, quota, log, _asked, F.length("result") > 0, cap, rounds=1)
    cases = fill_quota(candidates, quota, log, _asked, F.length("result") > 0, cap)
    texts = cases.join(candidates.select("candidate_id", F.substring("text", 1, 40).alias("head"), F.length("text").alias("size")), "candidate_id")
    most = cases.groupBy("capped_by").count().agg(F.max("count")).scalar()
    return texts.groupBy("case_type").agg(
        F.count_distinct("case_id").alias("accepted"), F.bool_and((F.col("result") == F.col("head")) & (F.col("size") % 5 != 0)).alias("fine"),
        F.bool_and(most <= cap).alias("within_cap"))
