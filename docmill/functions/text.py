"""Text normalisers and scanners as Column expressions.

Everything runs inside the JVM except Unicode composition (NFC, NFKC), which
Spark has no function for; those two are Arrow UDFs of one line.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.arrays import islands, let, lines
from docmill.functions.rows import each_text

# Whitespace as Unicode-aware regular expressions see it.
WS = r"[\s\x0B\x1C-\x1F\u0085   -     　]"


NON_ASCII = r"[^\x00-\x7F]"


# --- Unicode folding -------------------------------------------------------------

def _fold_table(form: str, ascii_only: bool) -> tuple[str, str, dict[str, str]]:
    """Per-character effect of decomposing and dropping the marks.

    Returns source and target strings for translate() (characters beyond the
    target's end are deleted) and the few characters that become several.
    """
    one_from, one_to, gone, several = [], [], [], {}
    for code in range(0x80, 0x30000):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        folded = unicodedata.normalize(form, ch)
        if ascii_only:
            folded = "".join(c for c in folded if not unicodedata.combining(c))
            folded = folded.encode("ascii", "ignore").decode()
        else:
            folded = "".join(c for c in folded if unicodedata.category(c) != "Mn")
        if folded == ch:
            continue
        if len(folded) == 1:
            one_from.append(ch)
            one_to.append(folded)
        elif folded:
            several[ch] = folded
        elif not ascii_only:
            gone.append(ch)
    return "".join(one_from) + "".join(gone), "".join(one_to), several


@cache
def _ascii_table() -> tuple[str, str, dict[str, str]]:
    source, target, several = _fold_table("NFKD", ascii_only=True)
    # đ and Đ have no decomposition; the language writes them as d and D.
    return "đĐ" + source, "dD" + target, several


def ascii_fold(text: Column) -> Column:
    """ASCII transliteration: accents dropped, đ→d, anything else removed.

    Single-character foldings are one translate(); the rare characters that
    become several (ligatures, fractions) take a per-character map, evaluated
    only on rows that hold one.
    """
    source, target, several = _ascii_table()
    # One literal instead of a map of literals keeps the plan small.
    pairs = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    wide = let(pairs, lambda m: F.array_join(F.transform(
        F.split(text, ""), lambda c: F.coalesce(F.element_at(m, c), c)), ""))
    simple = F.when(text.rlike(_char_class(tuple(several))), wide).otherwise(text)
    folded = F.regexp_replace(F.translate(simple, source, target), r"[^\x00-\x7F]", "")
    # Plain ASCII text, the common case, skips every per-character step.
    return F.when(text.rlike(NON_ASCII), folded).otherwise(text)


@cache
def ascii_mapping() -> dict[int, str | None]:
    """``ascii_fold`` for ``str.translate``; what is not ASCII afterwards goes as well."""
    source, target, several = _ascii_table()
    one = itertools.zip_longest(source, target)
    return {ord(a): b for a, b in one} | {ord(a): b for a, b in several.items()}


@cache
def _char_class(chars: tuple[str, ...]) -> str:
    """A character class of the given characters, runs written as ranges."""
    codes = sorted(map(ord, chars))
    runs = [list(g) for _, g in itertools.groupby(
        enumerate(codes), lambda pair: pair[1] - pair[0])]
    return "[" + "".join(f"\\x{{{r[0][1]:X}}}-\\x{{{r[-1][1]:X}}}" for r in runs) + "]"


def latin_ascii_fold(text: Column) -> Column:
    """ascii_fold without the multi-character map, for text known to be Latin."""
    source, target, _ = _ascii_table()
    return F.regexp_replace(F.translate(text, source, target), r"[^\x00-\x7F]", "")


@cache
def _mark_table() -> tuple[str, str]:
    source, target, _ = _fold_table("NFD", ascii_only=False)
    return source, target


def strip_marks(text: Column) -> Column:
    """Lowercase, drop nonspacing marks, đ→d; other letters stay."""
    source, target = _mark_table()
    plain = F.translate(F.lower(text), "đ" + source, "d" + target)
    return F.when(text.rlike(NON_ASCII), F.regexp_replace(plain, r"\p{Mn}+", "")) \
        .otherwise(F.lower(text))


def nfc(text: Column) -> Column:
    """Canonical composition."""
    return each_text(lambda t: unicodedata.normalize("NFC", t))(text)


def nfkc_casefold(text: Column) -> Column:
    """Compatibility composition and full case folding."""
    return each_text(lambda t: unicodedata.normalize("NFKC", t).casefold())(text)


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def strip(text: Column) -> Column:
    """Strip Unicode whitespace at both ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def slugify(text: Column, separator: str = "-", fallback: str = "section") -> Column:
    slug = F.regexp_replace(F.lower(ascii_fold(text)), "[^a-z0-9]+", separator)
    slug = F.regexp_replace(slug, f"^{re.escape(separator)}+|{re.escape(separator)}+$", "")
    return F.when(slug == "", F.lit(fallback)).otherwise(slug)


def search_text(text: Column) -> Column:
    """Indexed form of a text: ASCII, lowercase, single spaces."""
    return collapse_ws(F.lower(ascii_fold(text)))


def lookup_text(text: Column) -> Column:
    """ASCII words separated by single spaces."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(text)), "[^a-z0-9]+", " "))


def stable_identifier(path: Column) -> Column:
    return slugify(path, "_", "unknown")


def readable_name(stem: Column) -> Column:
    name = F.trim(F.regexp_replace(stem, "[-_]+", " "))
    return F.when(name == "", stem).otherwise(name)


def eval_text(text: Column) -> Column:
    """Matching form in retrieval scoring: NFC, lowercase, no bold marks."""
    return collapse_ws(F.replace(F.lower(nfc(text)), F.lit("**"), F.lit(" ")))


def answer_text(text: Column) -> Column:
    """Matching form in answer scoring: NFKC, case-folded, single spaces."""
    return collapse_ws(nfkc_casefold(text))


def normalize_key(key: Column, lowercase: bool = False) -> Column:
    key = collapse_ws(nfc(key))
    return F.lower(key) if lowercase else key


def normalize_key_jvm(key: Column, lowercase: bool = False) -> Column:
    """The same for keys already composed, usable inside array lambdas."""
    key = collapse_ws(key)
    return F.lower(key) if lowercase else key


# --- counting and hashing ------------------------------------------------------------

def word_count(text: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.size(F.filter(F.split(text, WS + "+"), lambda w: w != ""))


def estimate_tokens(text: Column, chars_per_token: int = 4) -> Column:
    return F.ceil(F.length(text) / chars_per_token).cast("int")


def point_id(chunk_id: Column) -> Column:
    """Stable numeric id: the first 15 hex digits of the md5."""
    return F.conv(F.substring(F.md5(chunk_id), 1, 15), 16, 10).cast("bigint")


def short_sha1(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha1(text), 1, n)


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


# --- Markdown lines and tables ----------------------------------------------------------

TABLE_SEPARATOR = r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"


def pipe_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))


def is_table_line(line: Column) -> Column:
    """At least two pipes and no opening code fence."""
    return (pipe_count(line) >= 2) & ~F.trim(line).startswith("```")


def is_table_separator(line: Column) -> Column:
    return line.contains("-") & (F.regexp_replace(line, r"[\s|:-]", "") == "")


def contains_table_line(text: Column) -> Column:
    return F.exists(lines(text), is_table_line)


def contains_table(text: Column) -> Column:
    """A pipe row directly followed by a separator row."""
    return let(lines(text), lambda ls: F.exists(
        F.zip_with(ls, F.slice(ls, 2, F.greatest(F.size(ls) - 1, F.lit(0))),
                   lambda a, b: (pipe_count(a) >= 2)
                   & F.coalesce(b.rlike(TABLE_SEPARATOR), F.lit(False))),
        lambda hit: hit))


def content_type(text: Column) -> Column:
    """text, table or mixed, by the share of non-blank lines opening with a pipe."""
    return let(F.filter(lines(text), lambda ln: strip(ln) != ""), lambda ls: let(
        F.size(F.filter(ls, lambda ln: F.ltrim(ln).startswith("|"))),
        lambda n: F.when(n == 0, "text").when(n == F.size(ls), "table").otherwise("mixed")))


# --- tokens --------------------------------------------------------------------------------

# Function words ignored when answers are compared with evidence.
ANSWER_STOPWORDS = (
    "của", "cho", "các", "theo", "được", "trong", "ngoài", "hoặc", "và", "với", "này",
    "một", "những", "người", "bảo", "hiểm", "công", "ty", "không", "tại", "khi", "nếu",
    "là", "có", "về",
)
# Accent-free function words ignored in lexical scoring.
SEARCH_STOPWORDS = (
    "anh", "bao", "bang", "benh", "cac", "cach", "can", "cap", "chi", "cho", "co", "con",
    "cua", "cung", "du", "duoc", "giay", "han", "hay", "hoac", "khach", "khi", "khong",
    "la", "lam", "mau", "mot", "nay", "nguoi", "nhung", "noi", "phai", "qua", "quy", "sau",
    "suc", "tai", "theo", "thi", "thong", "tin", "trong", "tu", "va", "ve", "voi",
)


def lexical_tokens(text: Column) -> Column:
    """Lowercase word tokens of at least two characters."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}_]+", " "), " ")
    return F.filter(words, lambda w: F.length(w) >= 2)


def similarity_tokens(text: Column) -> Column:
    """Distinct lowercase tokens of at least five characters."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), WS + "+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 5))


def _stopword_array(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def significant_tokens(normalized: Column) -> Column:
    """Content tokens of an answer_text() result, citation marks removed first."""
    words = F.regexp_extract_all(normalized, F.lit(r"([a-z0-9à-ỹ]+)"), 1)
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*ANSWER_STOPWORDS)
                    & ~w.startswith("số"))


# A run of three or more characters that holds at least one letter.
WORD = "((?=[0-9]*[a-z])[a-z0-9]{3,})"


def search_words(text: Column) -> Column:
    """Accent-free content words in order, repeats kept."""
    words = F.regexp_extract_all(strip_marks(text), F.lit(WORD), 1)
    return F.filter(words, lambda w: ~w.isin(*SEARCH_STOPWORDS))


def block_terms(text: Column) -> Column:
    """Distinct accent-free content terms."""
    words = F.regexp_extract_all(strip_marks(text), F.lit(WORD), 1)
    return F.array_except(words, _stopword_array(SEARCH_STOPWORDS))


def top_keywords(words: Column, limit: int = 10, ties: str = "first") -> Column:
    """Most frequent words of an array; ties by first occurrence or alphabet.

    Sorting makes equal words neighbours, so counting is one pass over runs; the
    position travels along only where it decides ties.
    """
    def ranked(pairs: Column) -> Column:
        runs = islands(pairs, lambda a, b: a["w"] == b["w"])
        counted = F.transform(runs, lambda r: F.struct(
            (r["first"] - r["last"] - 1).alias("n"),
            F.get(pairs, r["first"])["i"].alias("i"),
            F.get(pairs, r["first"])["w"].alias("word")))
        return F.transform(F.slice(F.sort_array(counted), 1, limit), lambda s: s["word"])
    def ranked_by_word(ws: Column) -> Column:
        counted = F.transform(islands(ws, lambda a, b: a == b), lambda r: F.struct(
            (r["first"] - r["last"] - 1).alias("n"), F.get(ws, r["first"]).alias("word")))
        return F.transform(F.slice(F.sort_array(counted), 1, limit), lambda s: s["word"])
    if ties == "alphabet":
        return let(F.sort_array(words), ranked_by_word)
    pairs = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    return let(F.sort_array(pairs), ranked)


def token_recall(expected: Column, actual: Column) -> Column:
    """Share of the distinct expected tokens found in ``actual``; 0 when none expected."""
    return let(F.array_distinct(expected), lambda e: F.when(F.size(e) == 0, F.lit(0.0))
               .otherwise(F.size(F.array_intersect(e, actual)) / F.size(e)))


def phrase_recall(phrases: Column, normalized_text: Column) -> Column:
    """Share of non-blank normalised phrases contained in the text."""
    return let(F.filter(phrases, lambda p: p != ""), lambda ps: F.when(
        F.size(ps) == 0, F.lit(0.0)).otherwise(
        F.size(F.filter(ps, lambda p: normalized_text.contains(p))) / F.size(ps)))


# --- citations and numbers -----------------------------------------------------------------

def citation_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[(S\d+)\]"), 1)


def remove_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\[S\d+\]", "")


def numbers(text: Column) -> Column:
    """Numeric expressions without surrounding punctuation."""
    found = F.regexp_extract_all(text, F.lit(r"(\d[\d.,/%-]*)"), 1)
    bare = F.transform(found, lambda n: F.regexp_replace(n, r"^[.,;:]+|[.,;:]+$", ""))
    return F.filter(bare, lambda n: n != "")


def statements(answer: Column) -> Column:
    """Sentence-like statements, trimmed, blanks dropped."""
    parts = F.split(answer, r"(?<=[.!?。])" + WS + r"+|\n+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def merge_detached_citations(parts: Column) -> Column:
    """Attach a statement that is only citation marks to the one before it."""
    start = F.array().cast("array<string>")
    return F.aggregate(parts, start, lambda acc, s: F.when(
        s.rlike(r"^(?:\[S\d+\]\s*)+$") & (F.size(acc) > 0),
        F.concat(F.slice(acc, 1, F.size(acc) - 1),
                 F.array(F.concat_ws(" ", F.element_at(acc, -1), s))))
        .otherwise(F.concat(acc, F.array(s))))


def cite_statements(text: Column, citation: Column) -> Column:
    """Add the citation to every content statement, before its final stop."""
    def cited(s: Column) -> Column:
        mark = F.concat(F.lit(" ["), citation, F.lit("]"))
        body = F.regexp_extract(s, r"^(.+?)([.!?。]+)$", 1)
        stop = F.regexp_extract(s, r"^(.+?)([.!?。]+)$", 2)
        plain = (F.size(citation_ids(s)) > 0) | (F.length(collapse_ws(s)) < 12)
        return F.when(plain, s).when(stop != "", F.concat(F.rtrim(body), mark, stop)) \
            .otherwise(F.concat(s, mark))
    return F.array_join(F.transform(statements(text), cited), " ")


def extractive_answer(best_text: Column, citation: Column) -> Column:
    """Fallback answer: the best context, cut at 700 characters and cited."""
    text = collapse_ws(best_text)
    cut = F.when(F.length(text) > 700,
                 F.concat(F.rtrim(F.substring(text, 1, 700)), F.lit("..."))).otherwise(text)
    return F.when(best_text.isNull(),
                  F.lit("Không đủ bằng chứng trong tài liệu được truy xuất.")) \
        .otherwise(cite_statements(cut, citation))


# --- names and labels ------------------------------------------------------------------------

def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def url_site(url: Column) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(F.lower(F.parse_url(url, F.lit("HOST"))), r"^www\.", "")


def safe_filename(name: Column) -> Column:
    """A portable file name: no accents, no characters a file system refuses."""
    plain = F.regexp_replace(ascii_fold(name), r"[\\/*?:\"<>|]", "")
    return F.regexp_replace(F.trim(plain), r"\s+", "_")


def split_camel(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])", " ")


def node_label(label: Column) -> Column:
    """CamelCase node label; a clean label passes unchanged."""
    bare = strip(label)
    words = F.filter(F.split(ascii_fold(split_camel(bare)), "[^A-Za-z0-9]+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w: F.concat(
        F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), "")
    return (F.when(bare.rlike(r"^[A-Z][A-Za-z0-9]*$"), bare)
            .when(joined == "", F.lit("UnknownNode")).otherwise(joined))


def relationship_label(label: Column) -> Column:
    """UPPER_SNAKE relationship label; a clean label passes unchanged."""
    bare = strip(label)
    snake = F.regexp_replace(F.upper(ascii_fold(split_camel(bare))), "[^A-Z0-9]+", "_")
    snake = F.regexp_replace(snake, "^_+|_+$", "")
    return (F.when(bare.rlike(r"^[A-Z][A-Z0-9_]*$"), bare)
            .when(snake == "", F.lit("UNKNOWN_RELATIONSHIP")).otherwise(snake))


def label_search_text(label: Column, aliases: Column) -> Column:
    joined = F.concat_ws(" ", label, F.array_join(aliases, " "))
    words = F.regexp_replace(F.lower(ascii_fold(split_camel(joined))), "[^a-z0-9]+", " ")
    return F.trim(words)


# Term families that order schema labels before batching.
NODE_FAMILIES = {
    "accident": ("accident", "tai nan"),
    "benefit": ("benefit", "quyen loi", "chi tra", "muc boi thuong"),
    "claim": ("claim", "yeu cau boi thuong", "ho so"),
    "condition": ("condition", "benh", "tinh trang"),
    "contract": ("contract", "hop dong", "giay chung nhan"),
    "exclusion": ("exclusion", "loai tru", "khong chi tra"),
    "expense": ("expense", "chi phi", "vien phi"),
    "facility": ("facility", "hospital", "benh vien", "co so y te"),
    "limit": ("limit", "han muc", "gioi han", "so tien bao hiem"),
    "location": ("location", "dia diem", "quoc gia", "tinh", "thanh pho"),
    "person": ("person", "nguoi", "benh nhan", "khach hang"),
    "plan": ("plan", "program", "goi", "chuong trinh", "san pham"),
    "premium": ("premium", "phi bao hiem", "muc phi"),
    "provider": ("provider", "bac si", "nha cung cap"),
    "treatment": ("treatment", "dieu tri", "phau thuat", "thu thuat"),
    "waiting": ("waiting", "thoi gian cho"),
}
RELATIONSHIP_FAMILIES = {
    "applies": ("applies", "ap dung"),
    "benefit": ("benefit", "quyen loi"),
    "coverage": ("cover", "bao hiem", "chi tra"),
    "exclusion": ("exclude", "loai tru", "khong bao lanh"),
    "issue": ("issue", "phat hanh", "cap"),
    "limit": ("limit", "han muc", "gioi han"),
    "location": ("located", "toa lac", "nam tai", "thuoc"),
    "payment": ("pay", "pays", "tra tien", "boi thuong"),
    "purchase": ("purchase", "mua", "giao ket", "ky ket"),
    "service": ("service", "dich vu", "cung cap"),
    "taxonomy": ("is a", "loai hinh", "part of", "thuoc"),
    "treatment": ("treat", "dieu tri", "thuc hien"),
    "waiting": ("waiting", "thoi gian cho"),
}


def label_family(label: Column, aliases: Column, kind: str = "node") -> Column:
    families = NODE_FAMILIES if kind == "node" else RELATIONSHIP_FAMILIES
    hay = label_search_text(label, aliases)
    chain = None
    for family, terms in families.items():
        hit = hay.rlike("|".join(terms))
        chain = F.when(hit, family) if chain is None else chain.when(hit, family)
    return chain.otherwise(F.substring(hay, 1, 24))


def company_node(code: Column) -> Column:
    return F.concat(F.lit("insurance_company:"), F.upper(strip(code)))


def document_node(document_id: Column) -> Column:
    return F.concat(F.lit("insurance_document:"), slugify(document_id, "_", "unknown"))


def plan_node(company_code: Column, plan_code: Column) -> Column:
    return F.concat_ws(":", F.lit("insurance_plan"), F.upper(strip(company_code)),
                       slugify(plan_code, "_", "unknown"))


def chunk_node(document_id: Column, chunk_index: Column) -> Column:
    return F.concat_ws(":", F.lit("source_chunk"), slugify(document_id, "_", "unknown"),
                       chunk_index.cast("string"))


# --- cleaning ----------------------------------------------------------------------------------

# How generated image captions begin.
CAPTION_STARTS = ("a ", "an ", "the ", "aia logo", "circular diagram", "downward arrow", "icon ",
                  "illustration ", "man ", "map ", "qr code", "red booklet", "woman ")
IMAGE_TOKEN = r"(?i)!\[[^\]]*]\([^)]*_img\.(?:jpe?g|png|webp)\)"


def clean_image_noise(text: Column) -> Column:
    """Drop generated image lines with the captions that follow, and inline image marks.

    Lines form runs of image, blank and text lines; after an image, blank runs and
    caption paragraphs go until a real paragraph comes.  At most two blank lines
    stay together.
    """
    kept = "array<string>"

    def kind(ln: Column) -> Column:
        return F.when(ln.rlike(r"^\s*" + IMAGE_TOKEN + r"\s*$"), "image") \
            .when(strip(ln) == "", "blank").otherwise("text")

    def caption(paragraph: Column) -> Column:
        # no opening begins with one of the marks that make a paragraph more than a caption
        return F.lower(F.array_join(F.transform(paragraph, strip), " ")).rlike("^(?:" + "|".join(CAPTION_STARTS) + ")")

    def clean(ls: Column) -> Column:
        return let(F.transform(ls, kind), lambda kinds: cleaned(ls, kinds))

    def cleaned(ls: Column, kinds: Column) -> Column:
        runs = islands(kinds, lambda a, b: a == b)
        start = F.struct(F.array().cast(kept).alias("out"), F.lit(False).alias("noise"))

        def step(acc: Column, r: Column) -> Column:
            block = F.slice(ls, r["first"] + 1, r["last"] - r["first"] + 1)
            what = F.get(kinds, r["first"])
            drop = (what == "image") | (acc["noise"] & ((what == "blank") | caption(block)))
            tidy = F.transform(block, lambda ln: F.regexp_replace(F.regexp_replace(
                F.regexp_replace(ln, IMAGE_TOKEN, ""), "[ \t]{2,}", " "), r"\s+$", ""))
            return F.struct(F.when(drop, acc["out"]).otherwise(F.concat(acc["out"], tidy))
                            .alias("out"), drop.alias("noise"))
        return F.aggregate(runs, start, step, lambda acc: acc["out"])
    joined = F.array_join(let(lines(text), clean), "\n")
    joined = F.regexp_replace(F.regexp_replace(joined, r"\n{4,}", "\n\n\n"), r"^\n+|\n+$", "")
    return let(joined, lambda j: F.when(strip(j) == "", F.lit("")).otherwise(F.concat(j, F.lit("\n"))))


def first_json_object(text: Column) -> Column:
    """The first complete JSON object in a model's answer; NULL without one.

    Code fences are dropped, then the shortest prefix that parses is taken at
    the first opening brace that has one.
    """
    bare = F.regexp_replace(text, r"```(?:json)?", "")

    def from_brace(t: Column) -> Column:
        tails = let(F.split(t, r"(?=\{)", -1), lambda parts: F.filter(
            F.transform(parts, lambda p, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "")),
            lambda s: s.startswith("{")))

        def shortest(tail: Column) -> Column:
            parts = F.split(tail, r"(?<=\})", -1)
            return let(parts, lambda ps: F.aggregate(
                F.sequence(F.lit(1), F.size(ps)), F.lit(None).cast("string"),
                lambda acc, n: F.coalesce(acc, let(
                    F.array_join(F.slice(ps, F.lit(1), n), ""),
                    lambda c: F.when(F.try_parse_json(c).isNotNull() & c.endswith("}"), c)))))
        return F.aggregate(tails, F.lit(None).cast("string"),
                           lambda acc, s: F.coalesce(acc, shortest(s)))
    return let(bare, from_brace)


def sanitize_metadata(metadata: Column, dropped: tuple[str, ...], limit: int = 1000) -> Column:
    """Metadata map without heavy keys, long values cut."""
    kept = F.map_filter(metadata, lambda k, v: ~k.isin(*dropped))
    return F.transform_values(kept, lambda k, v: F.substring(v, 1, limit))
