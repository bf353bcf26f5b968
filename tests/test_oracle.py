"""A cross-section of registered queries against their oracle SQL, smallest data set."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from __spark_entry__ import entry, oracle_sql, queries
from docmill.session import TABLES
from scripts.check_oracle import rows_of

SF = "/root/testdata/sf0.001"
CHECKED = ["list_companies", "premium_quotes", "benefit_matrix", "search_exclusions",
           "sql_rollup", "text_ascii_fold", "text_top_keywords", "chunk_fixed",
           "markdown_blocks", "heading_statistics", "bm25_top10", "hybrid_fusion_top10",
           "rerank_two_stage", "evidence_conflicts", "retrieval_summary", "etl_benefit_values",
           "graph_quality_issues", "schema_label_examples", "benchmark_interleave",
           "stream_ingest_results"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, oracle, name):
    df = queries()[name](spark, SF)
    cursor = oracle.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == \
        rows_of(columns, cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    assert len(entry(spark).collect()) > 0
