import json

import pytest
from pyspark.sql import functions as F

from docmill.catalog import Catalog, schema_of
from docmill.operators import etl
from docmill.plans import tools


@pytest.fixture(scope="module")
def db(spark):
    def rows(table, *records):
        fields = schema_of(table).fieldNames()
        return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in records],
                                     schema_of(table))
    return Catalog.empty(spark).with_tables(
        documents=rows("documents", dict(id=1, company_id=1, source_path="aia/a", document_name="A",
                                         document_type="policy"),
                       dict(id=2, company_id=3, source_path="bic/b", document_name="B")),
        source_tables=rows("source_tables", dict(id=5, document_id=1, file_path="a.json",
                                                 raw_json="{}", processed=True)),
        plan_types=rows("plan_types", dict(id=8, company_id=1, document_id=1, raw_name="Gói 1",
                                           normalized_code="basic", plan_level=1)),
        benefit_items=rows("benefit_items",
                           dict(id=20, source_table_id=5, document_id=1, raw_name="Nha khoa",
                                note="Loại trừ niềng", display_order=1),
                           dict(id=21, source_table_id=5, document_id=1, raw_name="ROOM 100%",
                                display_order=2)),
        benefit_values=rows("benefit_values", dict(id=1, benefit_item_id=20, plan_type_id=8,
                                                   value="5 triệu", value_numeric=5e6)),
        premium_entries=rows(
            "premium_entries",
            dict(id=1, source_table_id=5, document_id=1, plan_type_id=8, age_min=18, age_max=30,
                 premium_amount=3e6),
            dict(id=2, source_table_id=5, document_id=1, plan_type_id=None, age_min=None,
                 age_max=30, premium_amount=1e6)),
        waiting_periods=rows("waiting_periods",
                             dict(id=1, source_table_id=5, document_id=1, waiting_days=None),
                             dict(id=2, source_table_id=5, document_id=1, waiting_days=30),
                             dict(id=3, source_table_id=5, document_id=1, waiting_days=90)))


def test_limits_and_patterns(one):
    assert [tools.clamp_limit(v) for v in (None, 0, 5, 999)] == [50, 1, 5, 200]
    hit = tools.like(F.col("t"), " ROOM ")
    assert one(hit, t="a room b") and not one(hit, t="phong")
    # ASCII letters fold, accented ones do not; % stays a wildcard.
    assert not one(tools.like(F.col("t"), "BẢO"), t="bảo hiểm")
    assert one(tools.like(F.col("t"), "a%c"), t="abbbc")


def test_companies_and_documents(db):
    got = {r.code: (r.document_count, r.plan_count) for r in tools.list_companies(db).collect()}
    assert got["aia"] == (1, 1) and got["bic"] == (1, 0) and got["pti"] == (0, 0)
    doc = tools.list_documents(db, company_code="aia").first()
    assert (doc.source_table_count, doc.plan_count) == (1, 1)
    assert tools.list_documents(db, keyword="zzz").count() == 0
    assert len(tools.list_benefit_categories(db).collect()) == 10


def test_open_age_bands(db):
    assert [r.premium_amount for r in tools.premium_quotes(db, age=25).collect()] == [3e6]
    both = tools.premium_quotes(db, age=25, open_ended=True).collect()
    assert [r.premium_amount for r in both] == [1e6, 3e6]
    assert tools.premium_quotes(db, max_premium=2e6).first().plan_name is None


def test_benefit_tools(db):
    rows = tools.search_benefits(db, "o").collect()
    assert {r.benefit_name for r in rows} == {"Nha khoa", "ROOM 100%"}
    assert tools.compare_benefits(db, "khoa", ["aia", "bic"], ["basic"]).count() == 1
    with pytest.raises(ValueError, match="at least one insurer"):
        tools.compare_benefits(db, "x", [])
    hit = tools.search_exclusions(db).collect()
    assert [(r.source_kind, r.title) for r in hit] == [] or hit[0].title == "Nha khoa"
    assert tools.search_exclusions(db, keyword="niềng").first().source_kind == "benefit_item"
    wide = tools.benefit_matrix_wide(db, ["basic"]).filter("benefit_name = 'Nha khoa'").first()
    assert wide.basic == 5e6


def test_null_permissive_waiting(db):
    days = [r.waiting_days for r in tools.search_waiting_periods(db, max_waiting_days=30).collect()]
    assert days == [None, 30]


def test_free_sql_guard(db):
    assert tools.execute_query(db, "SELECT count(*) AS n FROM companies").first().n == 6
    assert tools.execute_query(db, "EXPLAIN QUERY PLAN SELECT * FROM companies").count() == 1
    for text in ("DROP TABLE companies", "UPDATE companies SET code = 1", "PRAGMA x",
                 "INSERT INTO companies VALUES (1)"):
        with pytest.raises(ValueError, match="Only SELECT"):
            tools.execute_query(db, text)
    error = json.loads(tools.call_tool(db, "execute-query", query="DROP TABLE x"))
    assert (error["status"], error["error_type"], error["tool"]) == \
        ("error", "ValueError", "execute-query")
    with pytest.raises(Exception):
        tools.execute_query(db, "WITH c AS (SELECT 1) INSERT INTO companies SELECT * FROM c")


def test_lookup_schema_and_registry(db):
    assert tools.call_tool(db, "get-raw-source", source_table_id=5)["raw_json"] == "{}"
    assert tools.call_tool(db, "get-raw-source", source_table_id=6) == {}
    ddl = tools.get_schema(db, ["companies", "nope"])
    assert ddl[0].startswith("CREATE TABLE companies (") and "not found for table: nope" in ddl[1]
    assert len(tools.TOOLS) == 21 and "companies" in tools.list_tables(db)
    counts = {r.table_name: r.row_count for r in tools.database_summary(db).collect()}
    assert counts["companies"] == 6 and len(counts) == 11


FILES = {
    "aia.com.vn/doc/table_p1_n2.json": {
        "structured_data": [{"Quyền lợi": "Nội trú", "HF1": "1.000", "HF2": None},
                            {"Quyền lợi": "", "HF1": "2"}], "content_type": "table"},
    "aia.com.vn/doc/table_p2_n1.json": {"structured_data": {"Tuổi": "dưới 5", "HF1": "10%"}},
    "aia.com.vn/doc/empty.json": {"structured_data": []},
    "unknown/doc/x.json": {"structured_data": [{"a": "b"}]},
    "bic.vn/doc/y.json": {"structured_data": [{"a": "b"}]},
}


@pytest.fixture(scope="module")
def load(spark):
    rows = [(p, json.dumps(j, ensure_ascii=False)) for p, j in FILES.items()]
    files = spark.createDataFrame([*rows, ("aia.com.vn/doc/bad.json", "{oops")],
                                  "path STRING, content STRING")
    plan = ("plan_value", None, "basic", 1)
    mapping = spark.createDataFrame(
        [("HF1 | HF2 | Quyền lợi", "benefit_items", {"Quyền lợi": ("row_label", None, None, None),
                                                     "HF1": plan, "HF2": plan}),
         ("HF1 | Tuổi", "premium_entries", {"Tuổi": ("row_label", None, None, None), "HF1": plan})],
        f"keyset_id STRING, target_table STRING, key_roles MAP<STRING, {etl.ROLE}>")
    companies = spark.createDataFrame([(1, "aia"), (3, "bic")], "id BIGINT, code STRING")
    return etl.ingest(etl.parse_extractions(files), mapping, companies)


def test_ingestion_outcomes(load):
    got = {r.path.split("/")[-1]: r.status for r in load.outcomes.collect()}
    assert got == {"table_p1_n2.json": "files_ok", "table_p2_n1.json": "files_ok",
                   "empty.json": "skipped_no_mapping", "x.json": "skipped_no_company",
                   "y.json": "skipped_no_mapping", "bad.json": "skipped_bad_json"}


def test_ingested_tables(load):
    t = load.tables
    assert [(r.raw_name, r.row_index) for r in t["benefit_items"].collect()] == [("Nội trú", 0)]
    values = t["benefit_values"].collect()
    assert [(v.value, v.value_numeric) for v in values] == [("1.000", 1000.0)]
    assert values[0].benefit_item_id == t["benefit_items"].first().id
    p = t["premium_entries"].first()
    assert (p.age_min, p.age_max, p.premium_amount) == (None, 5, None)
    assert sorted(r.raw_name for r in t["plan_types"].collect()) == ["HF1", "HF2"]
    assert [r.source_path for r in t["documents"].collect()] == ["aia/doc"]
    s = t["source_tables"].filter("page_number = 1").first()
    assert (s.table_index, json.loads(s["keys"])) == (2, ["HF1", "HF2", "Quyền lợi"])


def test_mapping_checks(spark):
    bad = spark.createDataFrame(
        [("k", "benefit_items", {"a": ("plan_value", None, "x", 1),
                                 "b": ("plan_value", None, "y", 1)})],
        f"keyset_id STRING, target_table STRING, key_roles MAP<STRING, {etl.ROLE}>")
    assert etl.mapping_violations(bad).first().issues == ["row_label_count", "plan_level_repeated"]


def test_small_pipelines(spark):
    cases = {r.case_id: r.expected_workflow for r in etl.synthetic_cases(spark, 6).collect()}
    assert cases == {"case_001": "policy_qa", "case_002": "verified_compare",
                     "case_003": "high_risk_claim", "case_004": "verified_compare",
                     "case_005": "policy_qa", "case_006": "high_risk_claim"}
    files = spark.createDataFrame([("aia/d/x.md",), ("bic/e/y.md",)], "path STRING")
    tables = spark.createDataFrame([(9, "aia/d/t.json", "b", 1), (4, "aia/d/u.json", "b", 2)],
                                   "id BIGINT, file_path STRING, table_type STRING, page_number INT")
    got = etl.first_table_or_minus_one(etl.map_documents_to_tables(files, tables))
    assert {r.path: r.source_table_id for r in got.collect()} == {"aia/d/x.md": 4, "bic/e/y.md": -1}
