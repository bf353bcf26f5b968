"""The domain tables derived from the driver's star schema.

Each table is one projection (with at most a foreign-key join) in portable
SQL, so the same text feeds the tools on Spark and the oracle's CTEs.  Nothing
is sampled: every source row becomes a domain row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docmill.catalog import Catalog
from docmill.session import table

DOMAIN_SQL: dict[str, str] = {
    "d_companies": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, lower(n_name) AS code, n_name AS name,
               concat(lower(n_name), '.example') AS website
        FROM nation""",
    "d_documents": """
        SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS company_id,
               concat(lower(c_mktsegment), '/', c_name, '.md') AS source_path,
               c_name AS document_name, c_mktsegment AS document_type, 'en' AS language,
               concat('Account file of ', c_name) AS description,
               CAST(NULL AS VARCHAR(10)) AS effective_date, 'v1' AS version
        FROM customer""",
    "d_source_tables": """
        SELECT o_orderkey AS id, o_custkey AS document_id,
               concat(o_orderpriority, '/', CAST(o_orderkey AS VARCHAR(20)), '.json') AS file_path,
               o_orderpriority AS table_type,
               concat('status ', o_orderstatus) AS classification_reason,
               'rule' AS classification_confidence,
               CAST(o_orderkey % 50 AS INT) AS page_number,
               CAST(o_orderkey % 7 AS INT) AS table_index,
               concat('{"status":"', o_orderstatus, '"}') AS raw_json,
               '["status"]' AS keys, 'table' AS content_type,
               o_orderstatus = 'F' AS processed, CAST(NULL AS VARCHAR(10)) AS error_reason
        FROM orders""",
    "d_plan_types": """
        SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS company_id,
               s_suppkey AS document_id, s_name AS raw_name,
               concat('tier_', CAST(s_suppkey % 5 AS VARCHAR(5))) AS normalized_code,
               CAST(s_suppkey % 5 + 1 AS INT) AS plan_level,
               concat('line ', CAST(s_nationkey % 3 AS VARCHAR(5))) AS product_line
        FROM supplier""",
    "d_benefit_categories": """
        SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS id, lower(p_brand) AS code,
               p_brand AS name_vi, upper(p_brand) AS name_en,
               CASE WHEN CAST(substr(p_brand, 7) AS BIGINT) % 5 = 0 THEN NULL
                    ELSE CAST(substr(p_brand, 7) AS BIGINT)
                         - CAST(substr(p_brand, 7) AS BIGINT) % 5 END AS parent_id
        FROM part""",
    "d_benefit_items": """
        SELECT p_partkey AS id, o_orderkey AS source_table_id, o_custkey AS document_id,
               CAST(substr(p_brand, 7) AS BIGINT) AS category_id, p_name AS raw_name,
               upper(p_name) AS normalized_name, p_size AS display_order,
               CAST(p_partkey % 10 AS INT) AS row_index,
               p_type AS applicable_to, concat(p_brand, ' ', p_type) AS note
        FROM part JOIN orders ON o_orderkey = p_partkey""",
    "d_benefit_values": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS benefit_item_id,
               l_suppkey AS plan_type_id, concat(l_returnflag, '-', l_linestatus) AS value,
               l_extendedprice AS value_numeric, l_returnflag AS value_context,
               l_linestatus AS limit_type, 'VND' AS unit, l_discount < 0.05 AS is_covered,
               CAST(NULL AS VARCHAR(10)) AS note
        FROM lineitem""",
    "d_premium_entries": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS source_table_id,
               o_custkey AS document_id, l_suppkey AS plan_type_id,
               l_linenumber AS row_index, CAST(l_quantity AS INT) AS age_min,
               CAST(l_quantity AS INT) + 10 AS age_max,
               concat(CAST(CAST(l_quantity AS INT) AS VARCHAR(5)), '-',
                      CAST(CAST(l_quantity AS INT) + 10 AS VARCHAR(5))) AS age_label,
               l_extendedprice AS premium_amount, 'VND' AS currency, 'annual' AS period,
               CAST(year(l_shipdate) AS VARCHAR(5)) AS year_label
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "d_hospitals": """
        SELECT o_orderkey AS id, o_orderkey AS source_table_id, o_custkey AS document_id,
               c_name AS name_vi, upper(c_name) AS name_en,
               concat(c_mktsegment, ' street ', CAST(c_custkey AS VARCHAR(20))) AS address,
               n_name AS city, r_name AS country, CAST(NULL AS VARCHAR(10)) AS phone,
               c_mktsegment AS hospital_type, o_orderstatus = 'O' AS gop_supported,
               o_orderpriority AS gop_time, CAST(NULL AS VARCHAR(10)) AS working_hours,
               CAST(o_orderkey AS VARCHAR(20)) AS external_id, o_orderpriority AS note
        FROM orders JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey
        JOIN region ON r_regionkey = n_regionkey""",
    "d_glossary_terms": """
        SELECT doc_id AS id, doc_id AS source_table_id, o_custkey AS document_id,
               concat(source, '-', CAST(doc_id AS VARCHAR(20))) AS term, text AS definition,
               lang AS language
        FROM documents JOIN orders ON o_orderkey = doc_id""",
    "d_waiting_periods": """
        SELECT o_orderkey AS id, o_orderkey AS source_table_id, o_custkey AS document_id,
               o_orderpriority AS condition_group,
               concat(o_orderpriority, ' #', CAST(o_orderkey AS VARCHAR(20))) AS condition_detail,
               CASE WHEN o_orderstatus = 'P' THEN NULL
                    ELSE CAST(o_orderkey % 365 AS INT) END AS waiting_days,
               concat('status ', o_orderstatus) AS waiting_text
        FROM orders""",
    "d_claim_payouts": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS source_table_id,
               o_custkey AS document_id,
               concat('event ', l_returnflag, l_linestatus) AS event,
               l_discount AS payout_rate,
               concat('line ', CAST(l_linenumber AS VARCHAR(5))) AS payout_text
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "d_short_term_premiums": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS source_table_id,
               o_custkey AS document_id,
               concat(CAST(CAST(l_quantity AS INT) AS VARCHAR(5)), ' units') AS duration_text,
               CASE WHEN l_linenumber = 7 THEN NULL
                    ELSE CAST(l_quantity AS INT) * 10 END AS duration_days,
               l_tax AS premium_rate
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
}


class DriverCatalog(Catalog):
    """Domain tables over the driver tables, each defined when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, {})
        self._sf_dir = sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            text = DOMAIN_SQL[f"d_{name}"]
            for source in set(re.findall(r"(?:FROM|JOIN) (\w+)", text)):
                # Prefixed, so a registered domain view never shadows a driver table.
                table(self.spark, self._sf_dir, source).createOrReplaceTempView(f"driver_{source}")
            prefixed = re.sub(r"(FROM|JOIN) (\w+)", r"\1 driver_\2", text)
            self._tables[name] = self.spark.sql(prefixed)
        return self._tables[name]

    def __iter__(self):
        return (name[2:] for name in DOMAIN_SQL)

    def __len__(self) -> int:
        return len(DOMAIN_SQL)


def driver_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The domain catalogue over the driver tables (lazy; nothing is stored)."""
    return DriverCatalog(spark, sf_dir)


def oracle_ctes(*names: str) -> str:
    """WITH prelude that defines the named domain tables for the oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({DOMAIN_SQL[n]})" for n in names)
