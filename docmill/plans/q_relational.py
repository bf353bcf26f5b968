"""Registered queries: the relational tools over the derived domain tables."""

from __future__ import annotations

from docmill.plans import tools
from docmill.plans.mart import driver_catalog, oracle_ctes
from docmill.plans.registry import query

JOIN = """JOIN d_documents d ON d.id = {a}.document_id
    JOIN d_companies c ON c.id = d.company_id
    JOIN d_source_tables st ON st.id = {a}.source_table_id"""
HEAD = """{a}.source_table_id, d.id AS document_id, st.file_path AS source_file_path,
    c.code AS company_code, c.name AS company_name, d.document_name"""
LINEAGE_CTES = ("d_companies", "d_documents", "d_source_tables")
LINEAGE_ORDER = ("source_table_id, document_id, source_file_path, company_code, "
                 "company_name, document_name")


def nulls_first(columns: str) -> str:
    return ", ".join(f"{c.strip()} NULLS FIRST" for c in columns.split(","))


def tool(name: str, sql: str, fn):
    query(name, sql)(lambda spark, sf: fn(driver_catalog(spark, sf)))


tool("database_summary",
     oracle_ctes("d_companies", "d_documents", "d_plan_types", "d_benefit_items",
                 "d_benefit_values", "d_premium_entries", "d_hospitals", "d_glossary_terms",
                 "d_waiting_periods", "d_claim_payouts", "d_short_term_premiums")
     + " UNION ALL ".join(
         f"\nSELECT '{t}' AS table_name, count(*) AS row_count FROM d_{t}"
         for t in tools.SUMMARY_TABLES),
     tools.database_summary)

tool("list_companies", oracle_ctes("d_companies", "d_documents", "d_plan_types") + """
    SELECT c.code, c.name, c.website, count(DISTINCT d.id) AS document_count,
           count(DISTINCT pt.id) AS plan_count
    FROM d_companies c LEFT JOIN d_documents d ON d.company_id = c.id
    LEFT JOIN d_plan_types pt ON pt.company_id = c.id
    GROUP BY c.code, c.name, c.website""", tools.list_companies)

tool("list_documents", oracle_ctes("d_companies", "d_documents", "d_source_tables",
                                   "d_plan_types") + """
    SELECT d.id AS document_id, c.code AS company_code, c.name AS company_name,
           d.source_path, d.document_name, d.document_type, d.language, d.description,
           d.effective_date, d.version, count(DISTINCT st.id) AS source_table_count,
           count(DISTINCT pt.id) AS plan_count
    FROM d_documents d JOIN d_companies c ON c.id = d.company_id
    LEFT JOIN d_source_tables st ON st.document_id = d.id
    LEFT JOIN d_plan_types pt ON pt.document_id = d.id
    WHERE d.document_type = 'BUILDING'
      AND (d.document_name ILIKE '%customer%' OR d.source_path ILIKE '%customer%'
           OR d.description ILIKE '%customer%')
    GROUP BY ALL ORDER BY company_code, document_name, document_id LIMIT 100""",
     lambda db: tools.list_documents(db, document_type="BUILDING", keyword=" customer "))

tool("list_source_tables", oracle_ctes(*LINEAGE_CTES) + f"""
    SELECT st.id AS source_table_id, d.id AS document_id, c.code AS company_code,
           c.name AS company_name, d.document_name, st.file_path, st.table_type,
           st.classification_reason, st.classification_confidence, st.page_number,
           st.table_index, st.keys, st.content_type, st.processed, st.error_reason
    FROM d_source_tables st JOIN d_documents d ON d.id = st.document_id
    JOIN d_companies c ON c.id = d.company_id
    WHERE st.table_type = '1-URGENT' AND st.processed
    ORDER BY {nulls_first("company_code, document_name, page_number, table_index, source_table_id")}
    LIMIT 200""",
     lambda db: tools.list_source_tables(db, table_type="1-URGENT", processed=True, limit=999))

tool("benefit_categories", oracle_ctes("d_benefit_categories") + """
    SELECT bc.id AS category_id, bc.code, bc.name_vi, bc.name_en, p.code AS parent_code,
           p.name_vi AS parent_name_vi
    FROM d_benefit_categories bc LEFT JOIN d_benefit_categories p ON p.id = bc.parent_id""",
     tools.list_benefit_categories)

PLAN_SQL = """pt.raw_name AS plan_name, pt.normalized_code AS plan_code, pt.plan_level,
    pt.product_line FROM d_plan_types pt LEFT JOIN d_companies c ON c.id = pt.company_id
    LEFT JOIN d_documents d ON d.id = pt.document_id"""
PLAN_ORDER = nulls_first("company_code, product_line, plan_level, plan_name")

tool("search_plans", oracle_ctes("d_companies", "d_documents", "d_plan_types") + f"""
    SELECT pt.id AS plan_type_id, c.code AS company_code, c.name AS company_name,
           d.id AS document_id, d.document_name, {PLAN_SQL}
    WHERE (pt.raw_name ILIKE '%LINE 1%' OR pt.normalized_code ILIKE '%LINE 1%'
           OR pt.product_line ILIKE '%LINE 1%')
    ORDER BY {PLAN_ORDER}, plan_type_id LIMIT 100""",
     lambda db: tools.search_plans(db, keyword="LINE 1"))

tool("list_plans", oracle_ctes("d_companies", "d_documents", "d_plan_types") + f"""
    SELECT c.code AS company_code, c.name AS company_name, d.id AS document_id,
           d.document_name, {PLAN_SQL}
    WHERE c.code = 'nation_7' ORDER BY {PLAN_ORDER} LIMIT 100""",
     lambda db: tools.list_plans(db, company_code="nation_7"))

tool("premium_quotes", oracle_ctes(*LINEAGE_CTES, "d_plan_types", "d_premium_entries") + f"""
    SELECT {HEAD.format(a="pe")}, pt.raw_name AS plan_name, pt.normalized_code AS plan_code,
           pe.age_label, pe.age_min, pe.age_max, pe.premium_amount, pe.currency, pe.period,
           pe.year_label
    FROM d_premium_entries pe {JOIN.format(a="pe")}
    LEFT JOIN d_plan_types pt ON pt.id = pe.plan_type_id
    WHERE 25 BETWEEN pe.age_min AND pe.age_max AND pe.premium_amount <= 50000
      AND pt.normalized_code = 'tier_2'
    ORDER BY premium_amount, company_code, pt.plan_level,
      {LINEAGE_ORDER}, plan_name, plan_code, age_label LIMIT 50""",
     lambda db: tools.premium_quotes(db, age=25, plan_code="tier_2", max_premium=50000.0))

BENEFIT_SQL = f"""FROM d_benefit_items bi {JOIN.format(a="bi")}
    LEFT JOIN d_benefit_values bv ON bv.benefit_item_id = bi.id
    LEFT JOIN d_plan_types pt ON pt.id = bv.plan_type_id"""
BENEFIT_CTES = (*LINEAGE_CTES, "d_plan_types", "d_benefit_items", "d_benefit_values")
BENEFIT_HIT = """(bi.raw_name ILIKE '%{k}%' OR bi.note ILIKE '%{k}%'
    OR bv.value ILIKE '%{k}%')"""

tool("search_benefits", oracle_ctes(*BENEFIT_CTES) + f"""
    SELECT {HEAD.format(a="bi")}, bi.raw_name AS benefit_name, bi.applicable_to,
           bi.note AS benefit_note, pt.raw_name AS plan_name, pt.normalized_code AS plan_code,
           bv.value, bv.value_numeric, bv.value_context, bv.unit, bv.limit_type,
           bv.is_covered, bv.note AS value_note
    {BENEFIT_SQL} WHERE {BENEFIT_HIT.format(k="RED")} AND c.code = 'nation_3'
    ORDER BY {nulls_first("company_code, document_name, bi.display_order, pt.plan_level, bi.source_table_id, document_id, source_file_path, company_name, benefit_name, bi.applicable_to, benefit_note, plan_name, plan_code, bv.value, bv.value_numeric, bv.value_context, bv.unit, bv.limit_type, bv.is_covered")}
    LIMIT 50""",
     lambda db: tools.search_benefits(db, "RED", company_code="nation_3"))

tool("benefit_matrix", oracle_ctes(*BENEFIT_CTES, "d_benefit_categories") + f"""
    SELECT {HEAD.format(a="bi")}, bc.code AS category_code, bc.name_vi AS category_name_vi,
           bi.raw_name AS benefit_name, bi.normalized_name, bi.applicable_to,
           bi.note AS benefit_note, pt.raw_name AS plan_name, pt.normalized_code AS plan_code,
           pt.plan_level, bv.value, bv.value_numeric, bv.value_context, bv.limit_type,
           bv.unit, bv.is_covered, bv.note AS value_note
    {BENEFIT_SQL} LEFT JOIN d_benefit_categories bc ON bc.id = bi.category_id
    WHERE bc.code = 'brand#5' AND pt.normalized_code = 'tier_1'
    ORDER BY {nulls_first("company_code, document_name, bi.display_order, pt.plan_level, bi.source_table_id, document_id, source_file_path, company_name, category_code, category_name_vi, benefit_name, normalized_name, bi.applicable_to, benefit_note, plan_name, plan_code, bv.value, bv.value_numeric, bv.value_context, bv.limit_type, bv.unit, bv.is_covered")}
    LIMIT 300""",
     lambda db: tools.benefit_matrix(db, category_code="brand#5", plan_code="tier_1",
                                     limit=1000))

tool("benefit_matrix_wide", oracle_ctes(*BENEFIT_CTES) + f"""
    SELECT bi.raw_name AS benefit_name,
           max(bv.value_numeric) FILTER (pt.normalized_code = 'tier_0') AS tier_0,
           max(bv.value_numeric) FILTER (pt.normalized_code = 'tier_1') AS tier_1,
           max(bv.value_numeric) FILTER (pt.normalized_code = 'tier_4') AS tier_4
    {BENEFIT_SQL} GROUP BY bi.raw_name""",
     lambda db: tools.benefit_matrix_wide(db, ["tier_0", "tier_1", "tier_4"]))

tool("compare_benefits", oracle_ctes(*BENEFIT_CTES) + f"""
    SELECT {HEAD.format(a="bi")}, bi.raw_name AS benefit_name, bi.applicable_to,
           bi.note AS benefit_note, pt.raw_name AS plan_name, pt.normalized_code AS plan_code,
           pt.plan_level, bv.value, bv.value_numeric, bv.value_context, bv.unit,
           bv.limit_type, bv.is_covered, bv.note AS value_note
    {BENEFIT_SQL} WHERE {BENEFIT_HIT.format(k="widget")}
      AND c.code IN ('nation_1', 'nation_2', 'nation_3')
      AND pt.normalized_code IN ('tier_0', 'tier_3')
    ORDER BY {nulls_first("company_code, pt.plan_level, document_name, bi.display_order, bi.source_table_id, document_id, source_file_path, company_name, benefit_name, bi.applicable_to, benefit_note, plan_name, plan_code, bv.value, bv.value_numeric, bv.value_context, bv.unit, bv.limit_type, bv.is_covered")}
    LIMIT 100""",
     lambda db: tools.compare_benefits(db, "widget", ["nation_1", "nation_2", "nation_3"],
                                       ["tier_0", "tier_3"]))

tool("search_hospitals", oracle_ctes(*LINEAGE_CTES, "d_hospitals") + f"""
    SELECT {HEAD.format(a="h")}, h.name_vi, h.name_en, h.address, h.city, h.country, h.phone,
           h.hospital_type, h.gop_supported, h.gop_time, h.working_hours, h.external_id, h.note
    FROM d_hospitals h {JOIN.format(a="h")}
    WHERE (h.name_vi ILIKE '%street 1%' OR h.name_en ILIKE '%street 1%'
           OR h.address ILIKE '%street 1%' OR h.note ILIKE '%street 1%')
      AND h.country ILIKE '%asia%' AND h.gop_supported
    ORDER BY company_code, h.country, h.city, h.name_vi, h.source_table_id LIMIT 50""",
     lambda db: tools.search_hospitals(db, keyword="street 1", country="asia",
                                       gop_supported=True))

tool("search_waiting_periods", oracle_ctes(*LINEAGE_CTES, "d_waiting_periods") + f"""
    SELECT {HEAD.format(a="wp")}, wp.condition_group, wp.condition_detail, wp.waiting_days,
           wp.waiting_text
    FROM d_waiting_periods wp {JOIN.format(a="wp")}
    WHERE wp.condition_group ILIKE '%high%'
      AND (wp.waiting_days IS NULL OR wp.waiting_days <= 30) AND c.code = 'nation_4'
    ORDER BY wp.waiting_days NULLS FIRST, wp.condition_detail LIMIT 50""",
     lambda db: tools.search_waiting_periods(db, "high", "nation_4", 30))

tool("search_claim_payouts", oracle_ctes(*LINEAGE_CTES, "d_claim_payouts") + f"""
    SELECT {HEAD.format(a="cp")}, cp.event, cp.payout_rate, cp.payout_text
    FROM d_claim_payouts cp {JOIN.format(a="cp")}
    WHERE (cp.event ILIKE '%RF%' OR cp.payout_text ILIKE '%RF%')
    ORDER BY company_code, cp.event, cp.source_table_id, document_id, cp.payout_rate,
             cp.payout_text LIMIT 50""",
     lambda db: tools.search_claim_payouts(db, "RF"))

tool("search_glossary_terms", oracle_ctes(*LINEAGE_CTES, "d_glossary_terms") + f"""
    SELECT {HEAD.format(a="gt")}, gt.term, gt.definition, gt.language
    FROM d_glossary_terms gt {JOIN.format(a="gt")}
    WHERE (lower(gt.term) LIKE '%the%' OR lower(gt.definition) LIKE '%the%')
    ORDER BY company_code, gt.term LIMIT 30""",
     lambda db: tools.search_glossary_terms(db, "the"))

tool("short_term_premiums", oracle_ctes(*LINEAGE_CTES, "d_short_term_premiums") + f"""
    SELECT {HEAD.format(a="sp")}, sp.duration_text, sp.duration_days, sp.premium_rate
    FROM d_short_term_premiums sp {JOIN.format(a="sp")}
    WHERE (sp.duration_days IS NULL OR sp.duration_days >= 300)
    ORDER BY company_code, sp.duration_days NULLS FIRST, sp.duration_text,
             sp.source_table_id, document_id, sp.premium_rate LIMIT 50""",
     lambda db: tools.short_term_premiums(db, duration_days=300))

tool("raw_source", oracle_ctes(*LINEAGE_CTES) + """
    SELECT st.id AS source_table_id, st.file_path, st.table_type, st.classification_reason,
           st.classification_confidence, st.page_number, st.table_index, st.keys,
           st.content_type, st.raw_json, d.id AS document_id, d.source_path, d.document_name,
           c.code AS company_code, c.name AS company_name
    FROM d_source_tables st JOIN d_documents d ON d.id = st.document_id
    JOIN d_companies c ON c.id = d.company_id WHERE st.id = 77""",
     lambda db: tools.get_raw_source(db, 77))

EXCLUSION_HIT = " OR ".join(
    f"lower({{c}}) LIKE '%{t}%'" for t in (*tools.EXCLUSION_TERMS, "econ"))


def _exclusion_hit(*columns: str) -> str:
    return "(" + " OR ".join(EXCLUSION_HIT.format(c=c) for c in columns) + ")"


tool("search_exclusions", oracle_ctes(*LINEAGE_CTES, "d_benefit_items", "d_glossary_terms")
     + f"""
    SELECT 'benefit_item' AS source_kind, {HEAD.format(a="bi")}, bi.raw_name AS title,
           bi.note AS detail, bi.applicable_to AS extra
    FROM d_benefit_items bi {JOIN.format(a="bi")}
    WHERE {_exclusion_hit("bi.raw_name", "bi.note", "bi.applicable_to")}
    UNION ALL
    SELECT 'glossary_term', {HEAD.format(a="gt")}, gt.term, gt.definition, gt.language
    FROM d_glossary_terms gt {JOIN.format(a="gt")}
    WHERE {_exclusion_hit("gt.term", "gt.definition")}
    ORDER BY company_code, source_kind, title, source_table_id LIMIT 200""",
     lambda db: tools.search_exclusions(db, keyword="econ", limit=200))

REVIEW = oracle_ctes(*BENEFIT_CTES, "d_premium_entries", "d_hospitals", "d_glossary_terms",
                     "d_waiting_periods", "d_claim_payouts", "d_short_term_premiums")


def review(name: str, alias: str, columns: str, extra: str = "", source: str | None = None):
    sql = REVIEW + (source or f"""
        SELECT {alias}.id, c.code AS company, d.document_name, {columns}
        FROM d_{name} {alias} JOIN d_documents d ON d.id = {alias}.document_id
        JOIN d_companies c ON c.id = d.company_id {extra}""")
    tool(f"review_{name}", sql, lambda db: tools.review_views(db)[name])


review("benefit_items", "bi", "bi.raw_name, bi.applicable_to, bi.note, st.table_type, st.file_path",
       "JOIN d_source_tables st ON st.id = bi.source_table_id")
review("benefit_values", "bv", "", source="""
    SELECT bv.id, c.code AS company, d.document_name, bi.raw_name AS benefit_name,
           pt.raw_name AS plan_name, pt.normalized_code AS plan_code, pt.plan_level,
           bv.value, bv.value_numeric, bv.unit
    FROM d_benefit_values bv JOIN d_benefit_items bi ON bi.id = bv.benefit_item_id
    JOIN d_plan_types pt ON pt.id = bv.plan_type_id
    JOIN d_documents d ON d.id = bi.document_id JOIN d_companies c ON c.id = d.company_id""")
review("premium_entries", "pe",
       "pt.raw_name AS plan_name, pt.normalized_code AS plan_code, pe.age_label, pe.age_min, "
       "pe.age_max, pe.premium_amount, st.file_path",
       "JOIN d_source_tables st ON st.id = pe.source_table_id "
       "LEFT JOIN d_plan_types pt ON pt.id = pe.plan_type_id")
review("hospitals", "h",
       "h.name_vi, h.name_en, h.address, h.city, h.country, h.phone, h.hospital_type")
review("glossary_terms", "g", "g.term, g.definition")
review("waiting_periods", "w",
       "w.condition_group, w.condition_detail, w.waiting_days, w.waiting_text")
review("claim_payouts", "cp", "cp.event, cp.payout_rate, cp.payout_text")
review("short_term_premiums", "sp", "sp.duration_text, sp.duration_days, sp.premium_rate")


# --- free SQL through the read-only passthrough ------------------------------------------

def passthrough(name: str, text: str, *ctes: str, oracle: str | None = None):
    """The same text runs on Spark over the domain tables and on the oracle."""
    body = oracle or text
    prelude = oracle_ctes(*(f"d_{c}" for c in ctes))
    renamed = ", ".join(f"{c} AS (SELECT * FROM d_{c})" for c in ctes)
    if body.lstrip().upper().startswith("WITH"):
        keyword, rest = body.lstrip().split(None, 1)
        if rest.upper().startswith("RECURSIVE"):
            prelude = prelude.replace("WITH", "WITH RECURSIVE", 1)
            rest = rest[len("RECURSIVE"):]
        sql = f"{prelude}, {renamed}, {rest}"
    else:
        sql = f"{prelude}, {renamed} {body}"
    tool(name, sql, lambda db: tools.execute_query(db, text))


passthrough("sql_having", """
    SELECT document_type, company_id, count(*) AS n FROM documents
    GROUP BY document_type, company_id HAVING count(*) > 5""", "documents")
passthrough("sql_rollup", """
    SELECT table_type, classification_reason, count(*) AS n,
           CAST(sum(page_number) AS BIGINT) AS pages
    FROM source_tables GROUP BY ROLLUP (table_type, classification_reason)""",
            "source_tables")
passthrough("sql_cube", """
    SELECT condition_group, waiting_text, count(*) AS n, max(waiting_days) AS longest
    FROM waiting_periods GROUP BY CUBE (condition_group, waiting_text)""", "waiting_periods")
passthrough("sql_grouping_sets", """
    SELECT document_type, company_id, count(*) AS n FROM documents
    GROUP BY GROUPING SETS ((document_type), (company_id), ())""", "documents")
passthrough("sql_window_rank", """
    SELECT id, table_type, page_number, rn FROM (
        SELECT id, table_type, page_number,
               row_number() OVER (PARTITION BY document_id ORDER BY page_number, id) AS rn
        FROM source_tables) ranked
    WHERE rn <= 2""", "source_tables")
passthrough("sql_intersect", """
    SELECT company_id FROM documents WHERE document_type = 'BUILDING'
    INTERSECT SELECT company_id FROM plan_types""", "documents", "plan_types")
passthrough("sql_except", """
    SELECT id FROM documents EXCEPT SELECT document_id FROM plan_types""",
            "documents", "plan_types")
passthrough("sql_recursive_tree", """
    WITH RECURSIVE tree AS (
        SELECT id, code, 0 AS depth FROM benefit_categories WHERE parent_id IS NULL
        UNION ALL
        SELECT b.id, b.code, t.depth + 1 FROM benefit_categories b
        JOIN tree t ON b.parent_id = t.id)
    SELECT id, code, depth FROM tree""", "benefit_categories")
passthrough("sql_correlated_exists", """
    SELECT d.id, d.document_name FROM documents d
    WHERE EXISTS (SELECT 1 FROM source_tables s WHERE s.document_id = d.id AND s.processed)
      AND NOT EXISTS (SELECT 1 FROM plan_types p WHERE p.document_id = d.id)""",
            "documents", "source_tables", "plan_types")
