from pyspark.sql import functions as F

from docmill.functions import parse as ps
from docmill.functions import text as tx
from docmill.functions.arrays import delimited, lines, pack_texts, running_total


def test_transliteration_and_slugs(one):
    folded = tx.ascii_fold(F.col("t"))
    assert one(folded, t="ÙÚỦŨỤ ƯỪỨỬỮỰ ỲÝỶỸỴ Đđ") == "UUUUU UUUUUU YYYYY Dd"
    assert one(folded, t="oﬃce ½ 日本 é") == "office 12  e"
    assert one(tx.slugify(F.col("t")), t="Điều trị nội trú - Đồng hành trọn đời") == \
        "dieu-tri-noi-tru-dong-hanh-tron-doi"
    assert one(tx.slugify(F.col("t"), fallback="unknown"), t="!!!") == "unknown"
    assert one(tx.search_text(F.col("t")), t="  Bảo   HIỂM\n y tế ") == "bao hiem y te"
    assert one(tx.strip_marks(F.col("t")), t="Đường ÀÉ ß") == "duong ae ß"


def test_parsers(one):
    numeric = ps.parse_numeric(F.col("t"))
    assert [one(numeric, t=t) for t in ("1.500.000", "1.5", "10%", "", " 7 ")] == \
        [1500000, 15, None, None, 7]
    age = ps.parse_age_range(F.col("t"))
    got = {t: tuple(one(age, t=t)) for t in ("0-3 tuổi", "dưới 5", "từ 60", "18", "mọi")}
    assert got == {"0-3 tuổi": (0, 3), "dưới 5": (None, 5), "từ 60": (60, None),
                   "18": (18, 18), "mọi": (None, None)}
    assert one(ps.company_code(F.col("t")), t="aia.com.vn/x/table_p6_n1.json") == "aia"
    assert one(ps.document_name(F.col("t")), t="a/b/c.json") == "b"
    assert tuple(one(ps.page_info(F.col("t")), t="table_p6_n1.json")) == (6, 1)
    assert one(ps.document_type(F.col("t")),
               t="aia.com.vn/Quy-tac-suc-khoe/Quy-tac-suc-khoe.md") == "terms_and_rules"
    assert one(tx.stable_identifier(F.lit(
        "aia.com.vn/Quy-tac-suc-khoe/Quy-tac-suc-khoe"))) == \
        "aia_com_vn_quy_tac_suc_khoe_quy_tac_suc_khoe"


def test_rule_classifiers(one):
    def keys(*names):
        return one(ps.classify_keys(F.array(*[F.lit(n) for n in names])).getField("table_type"))
    assert keys("Thuật ngữ", "Định nghĩa", "x") == "glossary"
    assert keys("Tên cơ sở", "Điện thoại") == "hospital_network"
    assert keys("Thời gian chờ", "Nhóm bệnh") == "waiting_period"
    assert keys("Tỷ lệ chi trả") == "claim_payout"
    assert keys("Bạc", "Vàng", "Đồng", "AIA Vitality") == "vitality_tier"
    assert keys("Tuổi", "0-3", "4-6", "7-9") == "premium_table"
    assert keys("HF1", "HF2", "Quyền lợi") == "benefit_table"
    assert keys("Mức chi trả tối đa") == "benefit_detail"
    assert keys("foo") == "unclassified"
    assert one(ps.pdf_class(F.lit("Bieu-Phi-2024.pdf"))) == "2_bieu_phi_he_so"
    assert one(ps.folder_class(F.lit("tom-tat-quy-tac"))) == "others"
    assert one(ps.is_health_insurance(F.lit("motor.pdf"))) is None
    assert one(ps.risk_level(F.lit("claim"), F.lit("low"))) == "high"
    assert one(ps.risk_level(F.lit("premium"), F.lit("low"))) == "medium"
    assert one(ps.risk_level(F.lit("other"), F.lit("weird"))) == "medium"
    assert one(ps.case_type(F.lit("Quyền lợi bảo hiểm"))) == "benefit"
    assert one(ps.case_type(F.lit("a | b"))) == "table"


def test_citations(one):
    text = "Câu thứ nhất dài đủ. Câu thứ hai cũng dài đủ."
    assert one(tx.cite_statements(F.col("t"), F.lit("S1")), t=text) == \
        "Câu thứ nhất dài đủ [S1]. Câu thứ hai cũng dài đủ [S1]."
    assert one(tx.merge_detached_citations(tx.statements(F.col("t"))), t="Abc. [S1]\n[S2] x") == \
        ["Abc. [S1]", "[S2] x"]
    assert one(tx.numbers(F.col("t")), t="5.000.000, 10% và 3-5; .") == ["5.000.000", "10%", "3-5"]
    assert len(one(tx.extractive_answer(F.col("t"), F.lit("S1")), t="dài " * 300)) < 720
    assert one(tx.extractive_answer(F.lit(None).cast("string"), F.lit("S1"))).startswith("Không đủ")


def test_labels(one):
    assert one(tx.node_label(F.lit("quyền lợi nội trú"))) == "QuyenLoiNoiTru"
    assert one(tx.node_label(F.lit("HealthPlan"))) == "HealthPlan"
    assert one(tx.node_label(F.lit("???"))) == "UnknownNode"
    assert one(tx.relationship_label(F.lit("hasBenefit"))) == "HAS_BENEFIT"
    none = F.array().cast("array<string>")
    assert one(tx.label_family(F.lit("BenhVien"), none)) == "condition"
    assert one(tx.company_node(F.lit(" aia "))) == "insurance_company:AIA"
    assert one(tx.plan_node(F.lit("aia"), F.lit("Gói 1"))) == "insurance_plan:AIA:goi_1"


def test_tables_and_lines(one):
    assert one(lines(F.col("t")), t="a\r\nb\n\nc\n") == ["a", "b", "", "c"]
    assert one(tx.content_type(F.col("t")), t="| a |\n\n| b |") == "table"
    assert one(tx.content_type(F.col("t")), t="x\n| b |") == "mixed"
    assert one(tx.contains_table(F.col("t")), t="a|b|\n|---|---|\n|1|2|")
    assert not one(tx.contains_table(F.col("t")), t="a|b|\nc|d|")


def test_array_helpers(one):
    values = list(range(1, 700))
    got = one(running_total(F.sequence(F.lit(1), F.lit(699))))
    assert got == [sum(values[:i]) for i in range(699)]
    assert one(pack_texts(F.array(*[F.lit(x) for x in ("aa", "bb", "cccc", "d")]), 6, "-")) == \
        ["aa-bb", "cccc-d"]
    spans = one(delimited(F.col("t"), r"\n{2,}"), t="ab\n\ncd\n\n\n \n\nef")
    assert [(s.start, s.end, s.text) for s in spans] == \
        [(0, 2, "ab"), (4, 6, "cd"), (12, 14, "ef")]


def test_top_keywords(one):
    words = tx.search_words(F.col("t"))
    assert one(tx.top_keywords(words, 2), t="beta alpha beta alpha gamma") == ["beta", "alpha"]
    assert one(tx.top_keywords(words, 2, "alphabet"), t="beta alpha beta alpha gamma") == \
        ["alpha", "beta"]


def test_image_noise(one):
    text = ("Tiêu đề\n\n![](_page_1_img.jpeg)\n\nA man holding a book\nin the park\n\n"
            "(3) AON là công ty\n![x](b_img.png) giữ  lại\n\n\n\n\ncuối")
    assert one(tx.clean_image_noise(F.col("t")), t=text) == \
        "Tiêu đề\n\n(3) AON là công ty\n giữ lại\n\n\ncuối\n"
    assert one(tx.clean_image_noise(F.col("t")), t="![](a_img.png)\n") == ""


def test_json_recovery(one):
    found = tx.first_json_object(F.col("t"))
    assert one(found, t='text ```json\n{"a": {"b": "}"}, "c": 1} tail {"d": 2}\n```') == \
        '{"a": {"b": "}"}, "c": 1}'
    assert one(found, t='broken { no, then {"x": 1}') == '{"x": 1}'
    assert one(found, t="nothing") is None


def test_metadata_sanitizing(one):
    got = one(tx.sanitize_metadata(F.create_map(F.lit("keep"), F.lit("abcdef"), F.lit("heavy"),
                                                F.lit("x")), ("heavy",), 3))
    assert got == {"keep": "abc"}


def test_image_noise_is_dealt_to_all_cores(spark):
    """The scan of a table of few bytes is one task, and a row costs more than its shuffle."""
    from docmill.plans import load_all

    found = load_all()[0]["text_image_noise"](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_image_noise_takes_captions_by_any_opening(one):
    for lead in tx.CAPTION_STARTS:
        assert one(tx.clean_image_noise(F.col("t")), t=f"x\n![](p_img.png)\n\n{lead.title()}of it\nand on\n\n- {lead}item\n") == f"x\n- {lead}item\n"
