"""Value parsers and rule classifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.arrays import let
from docmill.functions.text import collapse_ws, lookup_text, normalize_key_jvm, strip

# Source folder of each company.
COMPANY_FOLDERS = {
    "aia.com.vn": "aia",
    "pacific_cross_all_pdfs": "pacific_cross",
    "bic.vn": "bic",
    "libertyinsurance.com.vn": "liberty",
    "baominh.com.vn": "baominh",
    "pti.com.vn": "pti",
}


def first_match(rules, default=None) -> Column:
    """CASE chain over (condition, value) pairs; the first true condition wins."""
    chain = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def parse_numeric(value: Column) -> Column:
    """Digits once '.' and ',' are dropped, else NULL ("1.5" reads as 15)."""
    digits = strip(F.regexp_replace(value.cast("string"), "[.,]", ""))
    return F.when(digits.rlike(r"^\d+$"), digits.try_cast("bigint"))


def parse_age_range(label: Column) -> Column:
    """struct(age_min, age_max) from a label such as "0-3", "dưới 5", "từ 18"."""
    def number(pattern: str, group: int) -> Column:
        found = F.regexp_extract(label, pattern, group)
        return F.when(found != "", found.cast("int"))

    pair = r"(\d+)\s*[-–]\s*(\d+)"
    single = number(r"(\d+)", 1)
    low, lowered = number(pair, 1), F.lower(label)
    none = F.lit(None).cast("int")
    below = lowered.contains("dưới")
    above = lowered.contains("trên") | lowered.contains("từ")
    return F.struct(
        F.when(low.isNotNull(), low).when(below, none).otherwise(single).alias("age_min"),
        F.when(low.isNotNull(), number(pair, 2)).when(below, single).when(above, none)
        .otherwise(single).alias("age_max"))


def company_code(path: Column) -> Column:
    return first_match([(path.contains(folder), code)
                        for folder, code in COMPANY_FOLDERS.items()])


def document_name(path: Column) -> Column:
    """The folder that holds the file, or the path itself when it has none."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)).otherwise(parts[0])


def page_info(file_name: Column) -> Column:
    """struct(page_number, table_index) from names like table_p6_n1.json."""
    def part(group: int) -> Column:
        found = F.regexp_extract(file_name, r"^table_p(\d+)_n(\d+)", group)
        return F.when(found != "", found.cast("int"))
    return F.struct(part(1).alias("page_number"), part(2).alias("table_index"))


def keyset_id(rows: Column) -> Column:
    """Sorted normalised keys of all rows joined by ' | '; NULL without keys."""
    keys = F.flatten(F.transform(rows, lambda r: F.map_keys(r)))
    named = F.filter(keys, lambda k: strip(k) != "")
    ids = F.array_join(F.array_sort(F.transform(
        F.array_distinct(named), lambda k: normalize_key_jvm(k))), " | ")
    return F.when(ids != "", ids)


def document_type(path: Column) -> Column:
    """Coarse type from folder and file names; the first rule that fits wins."""
    key = lookup_text(path)
    return first_match([
        (key.rlike("bieu phi|premium"), "premium_table"),
        (key.rlike("danh sach co so y te|benh vien|hospital"), "hospital_list"),
        (key.rlike("quy tac|dieu khoan|terms"), "terms_and_rules"),
        (key.contains("tom tat"), "summary"),
        (key.rlike("brochure|gioi thieu|tai lieu san pham"), "product_brochure"),
        (key.rlike("to khai|yeu cau bao hiem"), "form"),
    ], "policy")


def benchmark_document_type(path: Column) -> Column:
    """The coarser type used while building benchmark questions."""
    key = F.lower(path)
    return first_match([
        (key.rlike("bieu-phi|premium|phi"), "premium"),
        (key.rlike("provider-list|co-so-y-te|benh-vien"), "provider_list"),
        (key.rlike("brochure|gioi-thieu"), "brochure"),
        (key.rlike("tom-tat|summary"), "summary"),
        (key.rlike("quy-tac|policy-wording|dieu-khoan"), "policy_wording"),
    ], "other")


# --- file and folder names (NULL where no rule applies) -----------------------------------

def pdf_class(name: Column) -> Column:
    key = F.lower(name)
    return first_match([
        (key.rlike("quy[-_]?tac|dieu[-_]?khoan|tom[-_]?tat"), "1_quy_tac_dieu_khoan"),
        (key.rlike("bieu[-_]?phi|he[-_]?so|bang[-_]?le[-_]?phi"), "2_bieu_phi_he_so"),
        (key.rlike("bang[-_]?minh[-_]?hoa|minh[-_]?hoa"), "3_bang_minh_hoa"),
        (key.rlike("tai[-_]?lieu[-_]?(san[-_]?pham|gioi[-_]?thieu)|brochure"),
         "4_tai_lieu_san_pham"),
        (key.rlike("bao[-_]?cao[-_]?(tai[-_]?chinh|thuong[-_]?nien)|sustainability"),
         "5_bao_cao_tai_chinh"),
        (key.rlike("lai[-_]?suat|lai[-_]?chia"), "6_thong_tin_lai_suat_quy"),
        (key.rlike("bieu[-_]?mau|huong[-_]?dan|tuong[-_]?trinh|thong[-_]?bao|"
                   "thoi[-_]?gian[-_]?xu[-_]?ly|pos"), "7_bieu_mau_huong_dan"),
    ])


def is_health_insurance(name: Column) -> Column:
    """True on a sure keyword, NULL when the name decides nothing."""
    return F.when(F.lower(name).rlike(
        "suc[-_]?khoe|health|y[-_]?te|medical|bhsk|cham[-_]?soc[-_]?suc[-_]?khoe|"
        "bao[-_]?hiem[-_]?suc[-_]?khoe"), F.lit(True))


def keyword_category(name: Column, categories: dict[str, list[str]],
                     default: str = "7_Khac") -> Column:
    """First category (in order) with a keyword contained in the name, any case."""
    key = F.upper(name)
    rules = []
    for category, words in categories.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | key.contains(word.upper())
        rules.append((hit, category))
    return first_match(rules, default)


def folder_class(name: Column) -> Column:
    key = F.lower(name)
    summary = key.rlike("tom[-_]?tat|summary|gioi[-_]?thieu|brochure")
    terms = key.rlike(r"quy[-_]?tac|dieu[-_]?khoan|t[-_]?c|terms|conditions|policy|\bqt|\bdk")
    return first_match([
        (terms & ~summary, "terms_and_rules"),
        (key.rlike(r"bieu[-_]?phi|bang[-_]?phi|premium|fee|rate|\bbp"), "premium_tables"),
        (key.rlike(r"benh[-_]?vien|hospital|clinic|provider|co[-_]?so[-_]?y[-_]?te|"
                   r"mang[-_]?luoi|network|\bdsbv"), "hospital_lists"),
        (summary | key.rlike("thong[-_]?bao|press|to[-_]?khai|form"), "others"),
    ])


# --- key-set classifier ------------------------------------------------------------------------

# Column headings that identify each kind of extracted table.
HOSPITAL_VI = ("tên cơ sở y tế", "tên cơ sở", "điện thoại", "tỉnh thành",
               "thời gian làm việc", "gop time")
HOSPITAL_EN = ("hospital", "hospital/clinic", "hospital name", "provider", "provider name",
               "facility", "facility name", "name (en)", "phone", "address", "province/city",
               "gop service", "gop time", "type of hospital", "medical facility name", "id",
               "country", "city", "state", "region", "city/suburb", "au/nz", "aus/nz",
               "location/address")
HOSPITAL_NAME = ("hospital", "hospital/clinic", "hospital name", "provider", "provider name",
                 "facility", "facility name", "name (en)", "tên cơ sở y tế", "tên cơ sở",
                 "tên")
HOSPITAL_LOCATION = ("address", "city", "country", "id", "phone", "địa chỉ", "điện thoại",
                     "quốc gia")
HOSPITAL_VI_ALT = ("tên cơ sở", "địa chỉ", "ghi chú")
PLAN = ("cơ bản", "nâng cao", "toàn diện", "hoàn hảo", "gói 1", "gói 2", "gói 3", "gói 4",
        "mức 1", "mức 2", "mức 3", "mức 4", "mức áp dụng 1", "mức áp dụng 2",
        "mức áp dụng 3", "mức áp dụng 4", "cột 1", "cột 2", "cột 3", "cột 4", "hf1", "hf2",
        "hf3", "plan classic h1", "plan executive h2", "plan premier h3", "plan h1 classic",
        "plan h2 executive", "plan h3 premier", "chương trình classic h1",
        "chương trình executive h2", "chương trình premier h3", "chương trình 1",
        "chương trình 2", "chương trình 3", "chương trình 4", "chương trình cơ bản",
        "chương trình hoàn hảo", "chương trình nâng cao", "chương trình toàn diện")
PREMIUM = ("tuổi hiện tại của nđbh", "tuổi bảo hiểm", "phí bảo hiểm", "phí năm 1",
           "phí năm 2", "phí năm 3", "phí năm 4", "phí năm 5", "premium",
           "ages (last birthday)", "age (last birthday)", "phí bảo hiểm/người/năm")
GLOSSARY = ("thuật ngữ", "định nghĩa")
WAITING = ("thời gian chờ", "thời gian chờ 1", "thời gian chờ 2", "nhóm bệnh")
PAYOUT = ("tỷ lệ chi trả", "tỷ lệ trả tiền (%)", "sự kiện bảo hiểm", "tỷ lệ 1", "tỷ lệ 2",
          "các trường hợp thương tật", "loại thương tật",
          "tỷ lệ chi trả trên số tiền bảo hiểm của quyền lợi tương ứng (%)")
BENEFIT_DETAIL = ("chi tiết quyền lợi", "phạm vi bảo hiểm", "cơ sở bồi thường",
                  "cơ sở bồi thưởng", "nội dung quyền lợi", "nội dung trợ cấp",
                  "rủi ro được bảo hiểm")
SHORT_TERM = ("mức phí bảo hiểm ngắn hạn",
              "khoảng thời gian trước khi hủy bỏ hợp đồng bảo hiểm",
              "thời hạn bảo hiểm hoặc khoảng thời gian đã bảo hiểm cho người được bảo hiểm "
              "trong năm hợp đồng")
VITALITY = ("bạc", "vàng", "bạch kim", "đồng")
BENEFIT_LABEL = ("quyền lợi bảo hiểm", "hạng mục", "hospital services", "điều trị nội trú",
                 "quyền lợi", "nội dung", "quyền lợi nha khoa",
                 "quyền lợi điều trị ngoại trú", "quyền lợi điều trị trong ngày", "chi phí",
                 "điều trị ung thư", "1. outpatient services", "2. dental service (*)",
                 "3. maternity care (**)", "an tâm trọn đời")


def classify_keys(keys: Column) -> Column:
    """struct(table_type, matched) for a key array; nine ordered rules.

    ``matched`` lists the headings the deciding rule saw, sorted.
    """
    def both(ks: Column, *groups: tuple[str, ...]) -> Column:
        words = sorted({w for g in groups for w in g})
        return F.array_sort(F.array_intersect(ks, F.array(*[F.lit(w) for w in words])))

    def hits(ks: Column, group: tuple[str, ...]) -> Column:
        return F.size(both(ks, group))

    def containing(ks: Column, *terms: str) -> Column:
        return F.filter(ks, lambda k: k.rlike("|".join(terms)))

    def decide(ks: Column) -> Column:
        hospital = ((hits(ks, HOSPITAL_VI) >= 2) | (hits(ks, HOSPITAL_EN) >= 3)
                    | ((hits(ks, HOSPITAL_NAME) > 0) & (hits(ks, HOSPITAL_LOCATION) > 0))
                    | ((hits(ks, HOSPITAL_VI_ALT) >= 2)
                       & (F.array_contains(ks, "stt") | F.array_contains(ks, "tên cơ sở"))))
        payout = hits(ks, PAYOUT)
        payout_context = F.size(containing(ks, "tỷ lệ chi trả", "sự kiện bảo hiểm",
                                           "thương tật")) > 0
        vitality = (hits(ks, VITALITY) >= 3) & (F.size(containing(
            ks, "vitality", "mất hiệu lực", "mức thay đổi")) > 0)
        ages = F.filter(keys, lambda k: strip(k).rlike(r"^\d+-\d+$"))
        age_table = (F.size(containing(ks, "tuổi")) > 0) & (F.size(ages) >= 3)
        specific = containing(ks, "quyền lợi bảo hiểm", "số tiền bảo hiểm",
                              "giới hạn bảo hiểm", "mức chi trả")
        none = F.array().cast("array<string>")
        rules = [
            (F.size(ks) == 0, "unclassified", none),
            (hits(ks, GLOSSARY) == 2, "glossary", both(ks, GLOSSARY)),
            (hospital, "hospital_network", F.slice(both(
                ks, HOSPITAL_VI, HOSPITAL_EN, HOSPITAL_VI_ALT, HOSPITAL_NAME), 1, 5)),
            (hits(ks, WAITING) >= 2, "waiting_period", both(ks, WAITING)),
            (((payout > 0) & payout_context) | (payout >= 2), "claim_payout",
             both(ks, PAYOUT)),
            (hits(ks, SHORT_TERM) > 0, "short_term_premium", both(ks, SHORT_TERM)),
            (vitality, "vitality_tier", both(ks, VITALITY)),
            (hits(ks, PREMIUM) > 0, "premium_table", both(ks, PREMIUM)),
            (age_table, "premium_table", F.slice(ages, 1, 3)),
            (hits(ks, PLAN) >= 2, "benefit_table", F.slice(both(ks, PLAN), 1, 4)),
            (hits(ks, BENEFIT_DETAIL) > 0, "benefit_detail", both(ks, BENEFIT_DETAIL)),
            (F.size(specific) > 0, "benefit_detail", F.slice(F.array_sort(specific), 1, 3)),
        ]
        fallback = F.slice(F.array_sort(ks), 1, 5)
        return F.struct(
            first_match([(c, t) for c, t, _ in rules], "unclassified").alias("table_type"),
            first_match([(c, m) for c, _, m in rules], fallback).alias("matched"))

    named = F.filter(keys, lambda k: strip(k) != "")
    return let(F.array_distinct(F.transform(
        named, lambda k: normalize_key_jvm(k, lowercase=True))), decide)


# --- benchmark cases ----------------------------------------------------------------------------

# Wordings that make a line worth asking about, and those that do not.
KEYWORDS = (
    "bảo hiểm|quyền lợi|chi trả|bồi thường|loại trừ|thời gian chờ|nội trú|ngoại trú|"
    "thai sản|hồ sơ|phí bảo hiểm|số tiền bảo hiểm|người được bảo hiểm|điều kiện|thời hạn|"
    "tử vong|thương tật"
)
LOW_VALUE = (
    "ban hành kèm|căn cứ giấy phép|trên cơ sở người được bảo hiểm|"
    "là tổ chức được thành lập|chọn có hoặc không|tôi đồng ý cho phép"
)
QUESTION_KEYWORDS = ("thời gian chờ", "loại trừ", "bồi thường", "hồ sơ", "thai sản",
                     "nội trú", "ngoại trú", "số tiền bảo hiểm")
CASE_HINTS = {
    "benefit": ("quyen loi", "han muc", "boi thuong", "chi tra", "tro cap"),
    "exclusion": ("loai tru", "khong chi tra", "tu choi", "mien tru"),
    "waiting": ("thoi gian cho", "ngay cho", "benh dac biet"),
    "claim": ("boi thuong", "ho so", "yeu cau", "claim", "khieu nai"),
    "provider": ("benh vien", "phong kham", "co so y te", "bao lanh"),
    "premium": ("phi bao hiem", "bieu phi", "muc phi"),
    "eligibility": ("tuoi", "doi tuong", "tham gia", "nguoi duoc bao hiem"),
}


def case_type(text: Column, hints: dict[str, tuple[str, ...]] = CASE_HINTS) -> Column:
    from docmill.functions.text import strip_marks

    key = strip_marks(text)
    rules = [(key.rlike("|".join(words)), name) for name, words in hints.items()]
    return first_match([*rules, (text.contains("|"), "table")], "general")


def risk_level(task_type: Column, risk: Column) -> Column:
    task, given = F.lower(strip(task_type)), F.lower(strip(risk))
    return first_match([
        (task.isin("claim", "exclusion"), "high"),
        (task.isin("waiting_period", "eligibility", "premium"),
         F.when(given == "low", "medium").otherwise(given)),
        (given.isin("low", "medium", "high"), given),
    ], "medium")


def quote_topic(quote: Column) -> Column:
    """A short topic phrase: after a known lead-in, else the first 14 words."""
    edge = r"^[ ,;:-]+|[ ,;:-]+$"
    text = strip(F.regexp_replace(quote, r"^[#\-*>|\d\.\)\s]+", ""))
    text = F.regexp_replace(F.regexp_replace(text, r"\*\*|__", ""), r"\s+", " ")
    first = F.regexp_extract(
        text, "(?iu)(?:quy định|quyền lợi|điều khoản|nội dung|hồ sơ|thời gian chờ)"
              r"\s+(?:về|cho|của)?\s*([^.;:]{12,120})", 1)
    second = F.regexp_extract(
        text, "(?iu)(?:trường hợp|chi phí|dịch vụ|bệnh|tai nạn|thai sản)"
              r"\s+([^.;:]{12,120})", 1)
    words = F.array_join(F.slice(F.filter(F.split(text, " "), lambda w: w != ""), 1, 14), " ")
    chosen = F.when(first != "", first).when(second != "", second).otherwise(words)
    return F.substring(F.regexp_replace(chosen, edge, ""), 1, 90)


def benchmark_document_name(path: Column) -> Column:
    from docmill.functions.text import file_stem

    stem = F.regexp_replace(file_stem(path), "[-_]", " ")
    stem = collapse_ws(F.regexp_replace(stem, r"\b\d{4,}\b", ""))
    parent = F.coalesce(F.get(F.split(path, "/"), F.size(F.split(path, "/")) - 2), F.lit(""))
    return F.substring(F.when(stem != "", stem).otherwise(parent), 1, 80)


def fallback_question(provider: Column, path: Column, quote: Column) -> Column:
    """struct(question, task_type, risk) grounded in the quote, by keyword order."""
    lowered = F.lower(quote)
    keyword = first_match([(lowered.contains(k), k) for k in QUESTION_KEYWORDS])
    lead = F.concat(F.lit("Trong tài liệu "), benchmark_document_name(path),
                    F.lit(" của "), provider, F.lit(", "))
    topic = quote_topic(quote)
    return F.struct(
        F.when(keyword.isNotNull(), F.concat(
            lead, F.lit("nội dung về "), topic, F.lit(" được quy định như thế nào?")))
        .otherwise(F.concat(lead, topic, F.lit(" được nêu như thế nào?"))).alias("question"),
        F.coalesce(F.replace(keyword, F.lit(" "), F.lit("_")), F.lit("policy_qa"))
        .alias("task_type"),
        F.when(keyword.isin("loại trừ", "bồi thường", "thai sản"), "high")
        .otherwise("medium").alias("risk"))


# --- scores --------------------------------------------------------------------------------------

def clamp01(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def finite(x: Column) -> Column:
    """The value when finite, else NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def reciprocal_rank(rank: Column) -> Column:
    return F.when(rank > 0, 1 / rank).otherwise(F.lit(0.0))


def rank_hit(rank: Column, k: int) -> Column:
    return F.when((rank > 0) & (rank <= k), F.lit(1.0)).otherwise(F.lit(0.0))


def rank_delta(before: Column, after: Column) -> Column:
    """Ranks gained; NULL unless both ranks exist."""
    return F.when(before.isNotNull() & after.isNotNull(), before - after)
