"""Domain tables: declared schemas, seed rows and the table registry."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Declared column types of the relational model (money stays DOUBLE).
DOMAIN_DDL: dict[str, str] = {
    "companies": "id BIGINT, code STRING, name STRING, website STRING, created_at TIMESTAMP",
    "documents": "id BIGINT, company_id BIGINT, source_path STRING, document_name STRING, "
                 "document_type STRING, language STRING, description STRING, "
                 "effective_date STRING, version STRING, created_at TIMESTAMP",
    "source_tables": "id BIGINT, document_id BIGINT, file_path STRING, table_type STRING, "
                     "classification_reason STRING, classification_confidence STRING, "
                     "page_number INT, table_index INT, raw_json STRING, keys STRING, "
                     "content_type STRING, processed BOOLEAN, error_reason STRING, "
                     "created_at TIMESTAMP",
    "plan_types": "id BIGINT, company_id BIGINT, document_id BIGINT, raw_name STRING, "
                  "normalized_code STRING, plan_level INT, product_line STRING, "
                  "created_at TIMESTAMP",
    "benefit_categories": "id BIGINT, code STRING, name_vi STRING, name_en STRING, "
                          "parent_id BIGINT",
    "benefit_items": "id BIGINT, source_table_id BIGINT, document_id BIGINT, "
                     "category_id BIGINT, row_index INT, raw_row STRING, raw_name STRING, "
                     "normalized_name STRING, display_order INT, applicable_to STRING, "
                     "note STRING, created_at TIMESTAMP",
    "benefit_values": "id BIGINT, benefit_item_id BIGINT, plan_type_id BIGINT, value STRING, "
                      "value_numeric DOUBLE, value_context STRING, limit_type STRING, "
                      "unit STRING, is_covered BOOLEAN, note STRING",
    "premium_entries": "id BIGINT, source_table_id BIGINT, document_id BIGINT, "
                       "plan_type_id BIGINT, row_index INT, raw_row STRING, age_min INT, "
                       "age_max INT, age_label STRING, premium_amount DOUBLE, "
                       "currency STRING, period STRING, year_label STRING, "
                       "created_at TIMESTAMP",
    "hospitals": "id BIGINT, source_table_id BIGINT, document_id BIGINT, row_index INT, "
                 "raw_row STRING, name_vi STRING, name_en STRING, address STRING, "
                 "city STRING, country STRING, phone STRING, hospital_type STRING, "
                 "gop_supported BOOLEAN, gop_time STRING, working_hours STRING, "
                 "external_id STRING, note STRING, created_at TIMESTAMP",
    "glossary_terms": "id BIGINT, source_table_id BIGINT, document_id BIGINT, row_index INT, "
                      "raw_row STRING, term STRING, definition STRING, language STRING, "
                      "created_at TIMESTAMP",
    "waiting_periods": "id BIGINT, source_table_id BIGINT, document_id BIGINT, "
                       "row_index INT, raw_row STRING, condition_group STRING, "
                       "condition_detail STRING, waiting_days INT, waiting_text STRING, "
                       "created_at TIMESTAMP",
    "claim_payouts": "id BIGINT, source_table_id BIGINT, document_id BIGINT, row_index INT, "
                     "raw_row STRING, event STRING, payout_rate DOUBLE, payout_text STRING, "
                     "created_at TIMESTAMP",
    "short_term_premiums": "id BIGINT, source_table_id BIGINT, document_id BIGINT, "
                           "row_index INT, raw_row STRING, duration_text STRING, "
                           "duration_days INT, premium_rate DOUBLE, created_at TIMESTAMP",
    "synthetic_users": "id STRING, age INT, gender STRING, income DOUBLE, job STRING, "
                       "city STRING, family_status STRING, health_background STRING, "
                       "risk_tolerance STRING, created_at TIMESTAMP",
    "synthetic_policies": "id STRING, user_id STRING, company_id BIGINT, "
                          "plan_type_id BIGINT, document_id BIGINT, effective_date DATE, "
                          "renewal_date DATE, payment_status STRING, created_at TIMESTAMP",
    "synthetic_benchmark_cases": "case_id STRING, user_id STRING, query STRING, "
                                 "expected_intent_group STRING, expected_risk_level STRING, "
                                 "expected_workflow STRING, "
                                 "expected_evidence_types ARRAY<STRING>, "
                                 "created_at TIMESTAMP",
}

# Tables counted by the summary tool, in reporting order.
SUMMARY_TABLES = (
    "companies", "documents", "plan_types", "benefit_items", "benefit_values",
    "premium_entries", "hospitals", "glossary_terms", "waiting_periods",
    "claim_payouts", "short_term_premiums",
)

# Seed companies and benefit categories of the domain.
SEED_COMPANIES = (
    ("aia", "AIA Việt Nam", "aia.com.vn"),
    ("pacific_cross", "Pacific Cross Việt Nam", "pacificcross.com.vn"),
    ("bic", "BIC - BIDV Insurance", "bic.vn"),
    ("liberty", "Liberty Insurance", "libertyinsurance.com.vn"),
    ("baominh", "Bảo Minh", "baominh.com.vn"),
    ("pti", "PTI Insurance", "pti.com.vn"),
)
SEED_CATEGORIES = (
    ("inpatient", "Điều trị nội trú", "Inpatient"),
    ("outpatient", "Điều trị ngoại trú", "Outpatient"),
    ("emergency", "Cấp cứu", "Emergency"),
    ("maternity", "Thai sản", "Maternity"),
    ("dental", "Nha khoa", "Dental"),
    ("cancer", "Ung thư", "Cancer"),
    ("mental_health", "Sức khỏe tâm thần", "Mental Health"),
    ("accident", "Tai nạn cá nhân", "Personal Accident"),
    ("life", "Sinh mạng cá nhân", "Personal Life"),
    ("day_treatment", "Điều trị trong ngày", "Day Treatment"),
)


def schema_of(name: str) -> T.StructType:
    return T._parse_datatype_string(DOMAIN_DDL[name])


class Catalog(Mapping[str, DataFrame]):
    """Read-only registry of named DataFrames the query tools run against."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]):
        self.spark = spark
        self._tables = dict(tables)

    def __getitem__(self, name: str) -> DataFrame:
        return self._tables[name]

    def __iter__(self):
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def register_views(self, query: str | None = None) -> "Catalog":
        """Register the tables as views; with a query only those it may mention."""
        for name in self:
            if query is None or name in query.lower():
                self[name].createOrReplaceTempView(name)
        return self

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "Catalog":
        """Open stored domain tables; declared types win over inference."""
        return cls(spark, {
            name: spark.read.schema(schema_of(name)).parquet(f"{root}/{name}")
            for name in DOMAIN_DDL
        })

    @classmethod
    def empty(cls, spark: SparkSession) -> "Catalog":
        """Every declared table, holding only the seed rows."""
        tables = {n: spark.createDataFrame([], schema_of(n)) for n in DOMAIN_DDL}
        tables["companies"] = spark.createDataFrame(
            [(i, *row, None) for i, row in enumerate(SEED_COMPANIES, 1)],
            schema_of("companies"))
        tables["benefit_categories"] = spark.createDataFrame(
            [(i, *row, None) for i, row in enumerate(SEED_CATEGORIES, 1)],
            schema_of("benefit_categories"))
        return cls(spark, tables)

    def with_tables(self, **tables: DataFrame) -> "Catalog":
        return Catalog(self.spark, {**self._tables, **tables})
