"""Chunking methods compared in the chunk-shape study (spans over the source).

Input rows are (doc_id, text) with other columns passed through; output rows
are (doc_id, method, chunk_index, start, end, tokens, text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.arrays import (delimited, indices, islands, jaccard, let, let_all,
                                      pack_texts, piece, pieces_at, running_total, stage)
from docmill.functions.text import (block_terms, estimate_tokens, strip, strip_marks,
                                    top_keywords)
from docmill.operators.chunking import splitters as sp
from docmill.operators.chunking.markdown import header_sections
from docmill.operators.chunking.strategies import array_percentile, stage_semantic
from docmill.operators.embedding import NGRAM_EACH, EachEmbedder, content_terms

SENTENCE_END = (r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[]|[#*\-]|\n)|\n{2,}")
LEGAL_HEADING = (r"(?iu)(?:#{1,4}\s+.+|(?:Điều|Mục|Chương|Phần)\s+[0-9IVXLC]+[^\n]*)$")
# Function words left out of the density of an English text.
DENSITY_STOPWORDS = ("the", "and", "is", "of", "to", "a", "in", "that", "it", "with", "as",
                     "for")
CHARS = 4


# --- output ----------------------------------------------------------------------------------

def emit(docs: DataFrame, method: str, spans: Column | str) -> DataFrame:
    """Explode array<struct<start,end,text>>; blank texts are dropped."""
    rows = docs.select("doc_id", F.posexplode(spans).alias("chunk_index", "c"))
    text = strip(F.col("c.text"))
    return (rows.filter(text != "")
            .select("doc_id", F.lit(method).alias("method"), "chunk_index",
                    F.col("c.start").alias("start"), F.col("c.end").alias("end"),
                    estimate_tokens(text).alias("tokens"), text.alias("text")))


def spans_of_pieces(pieces: Column) -> Column:
    """Contiguous pieces of a text to array<struct<start,end,text>>."""
    return let(pieces, lambda ps: let(
        running_total(F.transform(ps, F.length)), lambda at: F.transform(ps, lambda p, i: F.struct(
            F.get(at, i).alias("start"), (F.get(at, i) + F.length(p)).alias("end"),
            p.alias("text")))))


def span(first: Column, last: Column, text: Column) -> Column:
    """struct of the source stretch from the start of ``first`` to the end of ``last``."""
    return F.struct(first["start"].alias("start"), last["end"].alias("end"),
                    F.substring(text, first["start"] + 1, last["end"] - first["start"])
                    .alias("text"))


# --- fixed windows and separators --------------------------------------------------------------

def fixed(docs: DataFrame, size_tokens: int = 300, overlap_tokens: int = 40) -> DataFrame:
    """Windows of ``size`` characters every size - overlap; all in the JVM."""
    size = size_tokens * CHARS
    step = max(1, size - overlap_tokens * CHARS)
    n = F.length("text")
    # The last window is the first one that reaches the end of the text.
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int")) * step
    starts = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step)))
    # Windows are cut inside the row: no exploded row carries the whole text.
    windows = F.transform(starts, lambda a: F.struct(
        a.alias("start"), F.substring("text", a + 1, F.lit(size)).alias("text")))
    rows = docs.filter(n > 0).select("doc_id", F.posexplode(windows).alias("i", "w"))
    text = F.col("w.text")
    return rows.select("doc_id", F.lit("fixed").alias("method"), F.col("i").alias("chunk_index"),
                       F.col("w.start").alias("start"),
                       (F.col("w.start") + F.length(text)).alias("end"),
                       estimate_tokens(text).alias("tokens"), text.alias("text"))


def _located(docs: DataFrame, method: str, parts: Column) -> DataFrame:
    """Text-only parts mapped back to source spans."""
    staged = docs.withColumn("_p", parts)
    staged = staged.withColumn("_at", sp.locate_by_anchor(F.col("text"), F.col("_p")))
    return emit(staged, method, F.zip_with("_p", "_at", lambda t, s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), t.alias("text"))))


def recursive(docs: DataFrame, size: int = 1200, overlap: int = 160, separators=sp.FINE,
              method: str = "recursive") -> DataFrame:
    return emit(docs.withColumn("_p", sp.recursive_split(F.col("text"), size, overlap,
                                                         separators)), method, "_p")


def fixed_paragraphs(docs: DataFrame, size: int = 1200, overlap: int = 160) -> DataFrame:
    return _located(docs, "databricks_fixed_size",
                    sp.character_split(F.col("text"), size, overlap))


def logical_recursive(docs: DataFrame, size: int = 1200, overlap: int = 160) -> DataFrame:
    return recursive(docs, size, overlap, sp.PROSE, "databricks_semantic")


def code_recursive(docs: DataFrame, size: int = 1200, overlap: int = 160) -> DataFrame:
    return recursive(docs, size, overlap, sp.PYTHON, "databricks_recursive_code")


def sentence(docs: DataFrame, per_chunk: int = 5) -> DataFrame:
    """A fixed number of sentence-like units per chunk."""
    staged = stage(docs, _s=delimited(F.col("text"), SENTENCE_END))
    firsts = F.when(F.size("_s") > 0, F.sequence(F.lit(0), F.size("_s") - 1, F.lit(per_chunk)))
    return emit(staged, "sentence", F.transform(firsts, lambda i: span(
        F.get("_s", i), F.get("_s", F.least(i + per_chunk, F.size("_s")) - 1), F.col("text"))))


def headings(docs: DataFrame, boundary: str = r"#{1,3}\s+.+$", method: str = "markdown",
             size: int = 1200) -> DataFrame:
    """Cut before every heading; a document without headings is split recursively."""
    staged = stage(docs, _s=spans_of_pieces(pieces_at(F.col("text"), boundary)))
    has = F.col("text").rlike(f"(?md)^{boundary}")
    plain = recursive(docs.filter(~has), size, 0, sp.FINE, method)
    return emit(staged.filter(has), method, "_s").unionByName(plain)


def legal_headings(docs: DataFrame) -> DataFrame:
    return headings(docs, LEGAL_HEADING, "regex")


# --- table-safe header sections --------------------------------------------------------------------

RULER = r"^\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?$"


def table_spans(text: Column) -> Column:
    """array<struct<start,end>> of pipe tables that have a separator row."""
    def found(ls: Column) -> Column:
        at = running_total(F.transform(ls, lambda ln: F.length(ln) + 1))
        is_row = F.transform(ls, lambda ln: strip(ln).startswith("|")
                             & (F.size(F.split(ln, r"\|", -1)) > 2))
        return let_all([at, is_row], lambda offsets, rows: F.transform(
            F.filter(islands(rows, lambda a, b: a == b), lambda r: F.get(rows, r["first"])
                     & (r["last"] > r["first"])
                     & F.exists(F.slice(ls, r["first"] + 2, r["last"] - r["first"]),
                                lambda ln: strip(ln).rlike(RULER))),
            lambda r: F.struct(F.get(offsets, r["first"]).alias("start"),
                               (F.get(offsets, r["last"]) + F.length(F.get(ls, r["last"])) + 1)
                               .alias("end"))))
    return let(F.split(text, "\n", -1), found)


def merge_spans(spans: Column) -> Column:
    """Union of spans that touch or overlap, in order."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = last.isNotNull() & (s["start"] <= last["end"])
        grown = F.struct(last["start"].alias("start"),
                         F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))) \
            .otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.sort_array(spans), empty, step)


def header_sections_table_safe(docs: DataFrame) -> DataFrame:
    """H1-H3 sections mapped to the source; a cut inside a table moves to its edge."""
    sections = F.filter(F.transform(header_sections(F.col("text"), 3), lambda s: strip(
        F.regexp_replace(s["text"], r"(?m)\A(?:#{1,3}( [^\n]*)?\s*\n)*#{1,3}( [^\n]*)?(\s*\n|\z)",
                         ""))), lambda t: t != "")
    staged = stage(docs, _p=sections, _tables=table_spans(F.col("text")))
    staged = staged.withColumn("_at", sp.locate_by_anchor(F.col("text"), F.col("_p")))

    def moved(x: Column, edge: str) -> Column:
        inside = F.filter("_tables", lambda t: (t["start"] < x) & (x < t["end"]))
        return F.coalesce(F.try_element_at(inside, F.lit(1))[edge], x)
    safe = F.transform("_at", lambda s: F.struct(
        moved(s["start"], "start").alias("start"), moved(s["end"], "end").alias("end")))
    staged = stage(staged, _safe=merge_spans(safe))
    return emit(staged, "langchain_markdown_header", F.transform("_safe", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.substring("text", s["start"] + 1, s["end"] - s["start"]).alias("text"))))


# --- adaptive sizes --------------------------------------------------------------------------------

def complexity(text: Column) -> Column:
    """Mean of lexical variety (over 0.8) and sentence length (over 200), each at most 1."""
    words = F.regexp_extract_all(strip_marks(text), F.lit(r"(?U)(\b\w+\b)"), 1)
    variety = let(words, lambda ws: F.when(F.size(ws) == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.size(F.array_distinct(ws)) / F.size(ws) / 0.8)))
    return F.when(strip(text) == "", F.lit(0.0)).otherwise(
        (variety + F.least(F.lit(1.0), F.length(strip(text)) / 200)) / 2)


def adaptive(docs: DataFrame, min_chars: int = 300, max_chars: int = 1000,
             min_overlap: int = 30, max_overlap: int = 150) -> DataFrame:
    """Sentences packed to a size that falls as the running complexity rises.

    The fold keeps indexes and sizes only; text is cut once per finished chunk.
    """
    staged = stage(docs, _s=delimited(F.col("text"), SENTENCE_END))
    staged = stage(staged, _u=F.transform("_s", lambda s: F.struct(
        F.length(strip(s["text"])).alias("n"), complexity(s["text"]).alias("c"))))
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("done"),
                     F.lit(0).alias("first"), F.lit(0).alias("size"), F.lit(0.5).alias("c"))

    def fold(us: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            u = F.get(us, i)
            open_ = i > acc["first"]
            c = F.when(open_, (acc["c"] + u["c"]) / 2).otherwise(u["c"])
            target = max_chars - c * (max_chars - min_chars)
            overlap = min_overlap + c * (max_overlap - min_overlap)
            full = open_ & (acc["size"] + u["n"] > target)
            # Trailing sentences that fit the overlap open the next chunk.
            back = F.aggregate(
                F.reverse(F.slice(us, acc["first"] + 1, i - acc["first"])),
                F.struct(F.lit(0).alias("k"), F.lit(0).alias("size"), F.lit(True).alias("go")),
                lambda b, x: let(b["go"] & (b["size"] + x["n"] <= overlap), lambda ok: F.struct(
                    (b["k"] + ok.cast("int")).alias("k"),
                    F.when(ok, b["size"] + x["n"]).otherwise(b["size"]).alias("size"),
                    ok.alias("go"))))
            return F.when(full, let(back, lambda b: F.struct(
                F.concat(acc["done"], F.array(F.struct(acc["first"].alias("a"),
                                                       (i - 1).alias("b")))).alias("done"),
                (i - b["k"]).alias("first"), (b["size"] + u["n"]).alias("size"), c.alias("c")))) \
                .otherwise(F.struct(acc["done"].alias("done"), acc["first"].alias("first"),
                                    (acc["size"] + u["n"]).alias("size"), c.alias("c")))
        return F.aggregate(indices(us), start, step, lambda acc: F.when(
            F.size(us) > 0, F.concat(acc["done"], F.array(F.struct(
                acc["first"].alias("a"), (F.size(us) - 1).alias("b"))))).otherwise(acc["done"]))
    staged = stage(staged, _r=let(F.col("_u"), fold))
    return emit(staged, "databricks_adaptive", F.transform("_r", lambda r: span(
        F.get("_s", r["a"]), F.get("_s", r["b"]), F.col("text"))))


# --- blocks and their grouping ------------------------------------------------------------------------

def block_kind(text: Column) -> Column:
    bare = strip(text)
    return (F.when(bare.rlike(r"^#{1,6}\s+"), "heading").when(bare.contains("|"), "table")
            .when(bare.rlike(r"^\s*(?:[-*+]|\d+[.)])\s+"), "list").otherwise("paragraph"))


def _paragraph_pieces(text: Column) -> Column:
    """Paragraphs with the blank lines that follow them."""
    marked = F.regexp_replace(text, r"\n((?:[ \t]*\n)+)", "\n$1﷐")
    return F.split(marked, "﷐", -1)


def _bounded(start: Column, end: Column, text: Column, limit: int) -> Column:
    """Spans of at most ``limit`` characters cut at line breaks."""
    parts = F.split(text, r"(?<=\n)", -1)
    empty = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"),
                     start.alias("a"), start.alias("b"))

    def step(acc: Column, ln: Column) -> Column:
        stop = acc["b"] + F.length(ln)
        full = (stop - acc["a"] > limit) & (acc["b"] > acc["a"])
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.struct(
                acc["a"].alias("start"), acc["b"].alias("end"))))).otherwise(acc["done"])
            .alias("done"),
            F.when(full, acc["b"]).otherwise(acc["a"]).alias("a"), stop.alias("b"))
    whole = F.array(F.struct(start.alias("start"), end.alias("end")))
    return F.when(end - start <= limit, whole).otherwise(F.aggregate(
        parts, empty, step, lambda acc: F.when(acc["b"] > acc["a"], F.concat(
            acc["done"], F.array(F.struct(acc["a"].alias("start"), acc["b"].alias("end")))))
        .otherwise(acc["done"])))


def stage_blocks(docs: DataFrame, limit: int = 1400) -> DataFrame:
    """Add ``_b``: array<struct<start,end,text,kind>> of source-preserving blocks."""
    staged = stage(docs, _p=spans_of_pieces(_paragraph_pieces(F.col("text"))))
    staged = stage(staged, _p=F.filter("_p", lambda p: strip(p["text"]) != ""))
    staged = stage(staged, _cuts=F.flatten(F.transform(
        "_p", lambda p: _bounded(p["start"], p["end"], p["text"], limit))))
    return stage(staged, _b=F.filter(F.transform("_cuts", lambda c: let(
        strip(F.substring("text", c["start"] + 1, c["end"] - c["start"])), lambda t: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), t.alias("text"),
            block_kind(t).alias("kind")))), lambda b: b["text"] != "")).drop("_p", "_cuts")


RANGES = "array<struct<a:int,b:int>>"


def _range_fold(bs: Column, split: Callable[[Column, Column], Column], max_chars: int,
                terms: bool) -> Column:
    """Group block indexes; ``split(acc, block)`` says when a block opens a new group."""
    start = F.struct(F.array().cast(RANGES).alias("done"), F.lit(0).alias("a"),
                     F.lit(0).alias("chars"), F.array().cast("array<string>").alias("terms"))

    def closed(acc: Column, last: Column) -> Column:
        return F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), last.alias("b"))))

    def step(acc: Column, i: Column) -> Column:
        b = F.get(bs, i)
        cut = (acc["chars"] > 0) & split(acc, b)
        chars = F.when(cut, 0).otherwise(acc["chars"]) + F.length(b["text"])
        kept = F.when(cut, F.array().cast("array<string>")).otherwise(acc["terms"])
        opened = F.struct(
            F.when(cut, closed(acc, i - 1)).otherwise(acc["done"]).alias("done"),
            F.when(cut, i).otherwise(acc["a"]).alias("a"), chars.alias("chars"),
            (F.array_union(kept, b["terms"]) if terms else kept).alias("terms"))
        return let(opened, lambda o: F.when(o["chars"] >= max_chars, F.struct(
            closed(o, i).alias("done"), (i + 1).alias("a"), F.lit(0).alias("chars"),
            F.array().cast("array<string>").alias("terms"))).otherwise(o))
    return F.aggregate(indices(bs), start, step, lambda acc: F.when(
        acc["chars"] > 0, closed(acc, F.size(bs) - 1)).otherwise(acc["done"]))


def semantic_ranges(bs: Column, target: int = 1400, min_chars: int = 550,
                    max_chars: int = 2600, threshold: float = 0.08) -> Column:
    """Cut on size, at a heading, or when the terms shift; blocks carry ``terms``."""
    def split(acc: Column, b: Column) -> Column:
        shift = ((acc["chars"] >= target) & (b["kind"] != "table")
                 & (jaccard(acc["terms"], b["terms"]) <= threshold))
        return ((acc["chars"] + F.length(b["text"]) > max_chars) | shift
                | ((b["kind"] == "heading") & (acc["chars"] >= min_chars)))
    return let(bs, lambda v: _range_fold(v, split, max_chars, True))


def policy_ranges(bs: Column, target: int = 1700, min_chars: int = 700, max_chars: int = 3200,
                  heading_level: int = 3) -> Column:
    """Cut on size, or at a heading up to ``heading_level`` once large enough."""
    def split(acc: Column, b: Column) -> Column:
        level = F.length(F.regexp_extract(b["text"], r"^(#{1,6})\s+", 1))
        heading = (level > 0) & (level <= heading_level)
        return ((acc["chars"] + F.length(b["text"]) > max_chars)
                | (heading & (acc["chars"] >= min_chars))
                | (heading & (acc["chars"] >= target) & (b["kind"] != "table")))
    return let(bs, lambda v: _range_fold(v, split, max_chars, False))


def contiguous(ranges: Column, n: Column) -> Column:
    """Do the ranges cover blocks 0..n-1 exactly, in order?"""
    end = F.aggregate(ranges, F.lit(0), lambda at, r: F.when(
        (r["a"] == at) & (r["b"] >= r["a"]) & (r["b"] < n), r["b"] + 1).otherwise(F.lit(-1)))
    return end == n


def hybrid_recursive_semantic(docs: DataFrame) -> DataFrame:
    """Per section: short ones whole, table-heavy ones by policy, the rest by terms."""
    staged = stage_blocks(docs)
    staged = stage(staged, _b=F.transform("_b", lambda b: F.struct(
        b["start"].alias("start"), b["end"].alias("end"), b["text"].alias("text"),
        b["kind"].alias("kind"), block_terms(b["text"]).alias("terms"))),
        _sec=spans_of_pieces(pieces_at(F.col("text"), LEGAL_HEADING)))
    staged = stage(staged, _sec=F.filter("_sec", lambda s: strip(s["text"]) != ""))
    staged = stage(staged, _in=F.transform("_sec", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        let(F.split(s["text"], "\n", -1), lambda ls: F.size(F.filter(
            ls, lambda ln: strip(ln).startswith("|"))) / F.size(ls)).alias("table_share"),
        F.filter("_b", lambda b: (b["start"] >= s["start"]) & (b["end"] <= s["end"]))
        .alias("bs"))))
    staged = stage(staged, _in=F.filter("_in", lambda s: F.size(s["bs"]) > 0))
    staged = stage(staged, _r=F.transform("_in", lambda s: F.when(
        s["end"] - s["start"] <= 2200, F.array(F.struct(
            F.lit(0).alias("a"), (F.size(s["bs"]) - 1).alias("b"))).cast(RANGES))
        .when(s["table_share"] >= 0.35, policy_ranges(s["bs"]))
        .otherwise(semantic_ranges(s["bs"]))))
    return emit(staged, "hybrid_recursive_semantic", F.flatten(F.zip_with(
        "_in", "_r", lambda s, rs: F.transform(rs, lambda r: span(
            F.get(s["bs"], r["a"]), F.get(s["bs"], r["b"]), F.col("text"))))))


def semantic_interquartile(docs: DataFrame, size: int = 1200,
                           embed_each: EachEmbedder = NGRAM_EACH) -> DataFrame:
    """Semantic groups with a threshold set by the wanted number of chunks."""
    def threshold(d: Column) -> Column:
        wanted = F.greatest(F.lit(2), F.ceil(F.length("text") / size))
        n = F.size(d)
        x = F.greatest(F.least(wanted, n), F.lit(1))
        share = F.when(n <= 1, F.lit(1.0)).otherwise((n - x) / (n - 1))
        return array_percentile(d, share)
    staged = stage_semantic(docs, "text", "_texts", threshold, 350, embed_each,
                            r"(?<=[.!?])\s+|\n{2,}")
    return _located(staged.drop("_p"), "semantic", F.col("_texts"))


def adaptive_semantic_density(docs: DataFrame, size_tokens: int = 300) -> DataFrame:
    """Blocks grouped until a heading, a term shift below 0.08 or 1.35 times the target."""
    target = max(500, min(1400, size_tokens * CHARS))
    staged = stage(docs, _p=F.filter(spans_of_pieces(_paragraph_pieces(F.col("text"))),
                                     lambda p: strip(p["text"]) != ""))
    staged = stage(staged, _b=F.transform("_p", lambda p: F.struct(
        p["start"].alias("start"), p["end"].alias("end"), strip(p["text"]).alias("text"),
        block_kind(p["text"]).alias("kind"),
        F.array_distinct(content_terms(p["text"])).alias("terms"))))

    def split(acc: Column, b: Column) -> Column:
        shift = ((F.size(acc["terms"]) > 0) & (F.size(b["terms"]) > 0)
                 & (jaccard(acc["terms"], b["terms"]) < 0.08) & (acc["chars"] >= 500))
        return (((b["kind"] == "heading") & (acc["chars"] >= 350)) | shift
                | (acc["chars"] + F.length(b["text"]) > target * 1.35))
    staged = stage(staged, _r=let(F.col("_b"), lambda v: _range_fold(v, split, 1 << 30, True)))
    return emit(staged, "adaptive_semantic_density", F.transform("_r", lambda r: span(
        F.get("_b", r["a"]), F.get("_b", r["b"]), F.col("text"))))


def late_context(docs: DataFrame, size: int = 1200, overlap: int = 160) -> DataFrame:
    """Chunks prefixed with their enclosing headings and the document's top terms."""
    context = stage(docs, _h=spans_of_pieces(pieces_at(F.col("text"), r"#{1,6}\s+.+$")),
                    _terms=F.array_join(top_keywords(
                        content_terms(F.col("text")), 8, "alphabet"), ", "))
    context = stage(context, _h=F.transform(F.filter(
        "_h", lambda h: h["text"].rlike(r"^#{1,6}\s+\S")), lambda h: F.struct(
            h["start"].alias("start"),
            F.length(F.regexp_extract(h["text"], "^(#{1,6})", 1)).alias("level"),
            strip(F.regexp_extract(h["text"], r"^#{1,6}\s+([^\n]+)", 1)).alias("title"))))
    staged = context.withColumn("_p", sp.recursive_split(F.col("text"), size, overlap, sp.PROSE))

    def enclosing(start: Column) -> Column:
        before = F.filter("_h", lambda h: h["start"] < start)
        return F.aggregate(before, F.array().cast("array<string>"), lambda acc, h: F.concat(
            F.slice(acc, F.lit(1), F.least(h["level"] - 1, F.size(acc))), F.array(h["title"])))

    def indexed(p: Column) -> Column:
        path = F.array_join(enclosing(p["start"]), " > ")
        return F.struct(p["start"].alias("start"), p["end"].alias("end"), F.concat_ws(
            "\n", F.when(path != "", F.concat(F.lit("Section context: "), path)),
            F.when(F.col("_terms") != "", F.concat(F.lit("Document terms: "), F.col("_terms"))),
            p["text"]).alias("text"))
    return emit(staged, "late_context", F.transform("_p", indexed))


# --- study scripts: metadata on top of a splitter ---------------------------------------------------

def section_density(docs: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """Logical chunks with the section title carried forward and the content-word share."""
    staged = docs.withColumn("_p", sp.recursive_split(F.col("text"), size, overlap, sp.PROSE))

    def title(text: Column) -> Column:
        found = F.filter(F.split(text, "\n", -1), lambda ln: ln.rlike(r"^(#+\s+.+|[A-Z\s]+:)$"))
        last = F.try_element_at(found, F.lit(-1))
        return F.when(last.startswith("#"), F.regexp_extract(last, r"^#+\s+(.+)$", 1)) \
            .otherwise(last)
    staged = stage(staged, _titles=F.transform("_p", lambda p: title(p["text"])))
    carried = F.aggregate("_titles", F.array().cast("array<string>"), lambda acc, t: F.concat(
        acc, F.array(F.coalesce(t, F.try_element_at(acc, F.lit(-1)), F.lit("Introduction")))))
    staged = stage(staged, _section=carried)
    rows = stage(staged, total_chunks=F.size("_p")).select(
        "doc_id", "total_chunks", F.posexplode(
        F.arrays_zip("_p", "_section")).alias("chunk_index", "c"))
    words = F.regexp_extract_all(F.lower("c._p.text"), F.lit(r"(?U)(\b\w+\b)"), 1)
    stop = F.array(*[F.lit(w) for w in DENSITY_STOPWORDS])
    density = let(words, lambda ws: F.size(F.filter(ws, lambda w: ~F.array_contains(stop, w)))
                  / F.greatest(F.lit(1), F.size(ws)))
    return rows.select("doc_id", "chunk_index", "total_chunks",
                       F.length("c._p.text").alias("chunk_size"),
                       F.col("c._section").alias("section"),
                       F.round(density, 2).alias("semantic_density"),
                       F.col("c._p.text").alias("text"))


def code_segments(docs: DataFrame, size: int = 100, overlap: int = 15,
                  language: str = "python") -> DataFrame:
    """Code chunks tagged as function, class, import or segment (first that fits)."""
    ladder = sp.PYTHON if language == "python" else sp.CODE
    split = docs.withColumn("_p", sp.recursive_split(F.col("text"), size, overlap, ladder))
    rows = stage(split, total_chunks=F.size("_p")).select(
        "doc_id", "total_chunks", F.posexplode("_p").alias("chunk_index", "c"))
    text = F.col("c.text")
    name = r"([a-zA-Z_][a-zA-Z0-9_]*)"
    function = F.regexp_extract(text, r"def\s+" + name + r"\s*\(", 1)
    klass = F.regexp_extract(text, r"class\s+" + name, 1)
    imported = F.regexp_extract(text, r"import\s+([a-zA-Z_][a-zA-Z0-9_\.]*)", 1)
    return rows.select(
        "doc_id", "chunk_index", "total_chunks",
        F.when(function != "", "function").when(klass != "", "class")
        .when(imported != "", "import").otherwise("code_segment").alias("chunk_type"),
        F.when(function != "", function).when(klass != "", klass).when(imported != "", imported)
        .otherwise(F.concat(F.lit("segment_"), F.col("chunk_index").cast("string")))
        .alias("structure_name"),
        F.size(F.split(text, "\n", -1)).alias("lines"), text.alias("text"))


def context_windows(docs: DataFrame, size: int = 500, overlap: int = 50,
                    window: int = 1) -> DataFrame:
    """Chunks prefixed with their neighbours' text; neighbours come from the array."""
    staged = docs.withColumn("_p", sp.recursive_split(F.col("text"), size, overlap, sp.DOTTED))
    staged = stage(staged, _t=F.transform("_p", lambda p: p["text"]))
    rows = stage(staged, _c=F.transform("_t", lambda t, i: F.concat_ws(" ", F.array_join(F.concat(
        F.slice("_t", F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window))),
        F.slice("_t", i + 2, F.lit(window))), " "))))
    rows = stage(rows, total_chunks=F.size("_t")).select(
        "doc_id", "total_chunks", F.posexplode(
        F.arrays_zip("_t", "_c")).alias("chunk_index", "c"))
    context = F.col("c._c")
    return rows.select(
        "doc_id", "chunk_index", "total_chunks",
        F.greatest(F.lit(0), F.col("chunk_index") - window).alias("window_start"),
        F.least(F.col("total_chunks"), F.col("chunk_index") + window + 1).alias("window_stop"),
        (F.col("total_chunks") > 1).alias("has_context"),
        F.when(F.col("total_chunks") > 1, F.concat(
            F.lit("Context: "), context, F.lit("\n\nContent: "), F.col("c._t")))
        .otherwise(F.col("c._t")).alias("text"))


def paragraph_packs(docs: DataFrame, max_chunks: int = 20, limit: int = 500) -> DataFrame:
    """Paragraphs packed below ``limit``, regrouped when there are too many packs."""
    paragraphs = F.filter(F.split("text", "\n\n", -1), lambda p: strip(p) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc: Column, p: Column) -> Column:
        full = F.length(acc["buf"]) + F.length(p) >= limit
        return F.struct(
            F.when(full & (acc["buf"] != ""), F.concat(acc["done"], F.array(strip(acc["buf"]))))
            .otherwise(acc["done"]).alias("done"),
            F.when(full, F.concat(p, F.lit("\n\n"))).otherwise(
                F.concat(acc["buf"], p, F.lit("\n\n"))).alias("buf"))
    packs = F.aggregate(paragraphs, start, step, lambda acc: F.when(
        acc["buf"] == "", acc["done"]).otherwise(
        F.concat(acc["done"], F.array(strip(acc["buf"])))))
    staged = stage(docs, _k=packs)
    per = (F.floor(F.size("_k") / max_chunks) + 1).cast("int")
    groups = F.when(F.size("_k") > max_chunks, F.transform(
        F.sequence(F.lit(0), F.size("_k") - 1, per),
        lambda i: F.array_join(F.slice("_k", i + 1, per), "\n\n"))).otherwise(F.col("_k"))
    staged = stage(staged, _g=groups)
    rows = stage(staged, total_chunks=F.size("_g")).select(
        "doc_id", "total_chunks", F.posexplode("_g").alias("chunk_index", "text"))
    return with_word_statistics(rows)


def with_word_statistics(rows: DataFrame) -> DataFrame:
    """Position, word count, distinct words and their share, as chunk metadata."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\b\w+\b)"), 1)
    counted = stage(rows, _w=words)
    distinct = F.size(F.array_distinct("_w"))
    return counted.select(
        "doc_id", "chunk_index", "total_chunks", F.length("text").alias("chunk_size"),
        F.round(F.col("chunk_index") / F.col("total_chunks"), 2).alias("document_position"),
        F.size("_w").alias("word_count"), distinct.alias("unique_words"),
        F.round(distinct / F.greatest(F.lit(1), F.size("_w")), 2).alias("word_density"), "text")


def fallback_recursive(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """What remains of model-driven chunking when no model answers."""
    split = docs.withColumn("_p", sp.recursive_split(F.col("text"), size, overlap, sp.PROSE))
    rows = stage(split, total_chunks=F.size("_p")).select(
        "doc_id", "total_chunks", F.posexplode("_p").alias("chunk_index", "c"))
    return with_word_statistics(rows.withColumn("text", F.col("c.text")).drop("c"))


def sentence_packs(docs: DataFrame, target: int = 500) -> DataFrame:
    """Sentences packed up to ``target`` characters, never cut."""
    sentences = F.filter(F.split("text", r"(?<=[.!?])\s+", -1), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"),
                     F.lit(None).cast("string").alias("buf"), F.lit(0).alias("size"))

    def step(acc: Column, s: Column) -> Column:
        full = acc["buf"].isNotNull() & (acc["size"] + F.length(s) > target)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"])
            .alias("done"),
            F.when(full, s).otherwise(F.concat_ws(" ", acc["buf"], s)).alias("buf"),
            (F.when(full, 0).otherwise(acc["size"]) + F.length(s)).alias("size"))
    packs = F.aggregate(sentences, start, step, lambda acc: F.when(
        acc["buf"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["buf"]))))
    return docs.select("doc_id", F.posexplode(packs).alias("chunk_index", "text"))


def baseline_sweep(docs: DataFrame, sizes=(100, 200, 500, 1000)) -> DataFrame:
    """Chunk count and mean length per size with a fifth of overlap."""
    out = None
    for size in sizes:
        overlap = int(size * 0.2)
        rows = docs.select(F.explode(sp.character_split(F.col("text"), size, overlap)).alias("t"))
        one = rows.agg(F.count("*").alias("num_chunks"),
                       F.round(F.avg(F.length("t")), 4).alias("avg_chunk_length")) \
            .select(F.lit(size).alias("chunk_size"), F.lit(overlap).alias("overlap"),
                    "num_chunks", "avg_chunk_length")
        out = one if out is None else out.unionByName(one)
    return out


# Size and overlap per kind of content.
CONTENT_SIZES = {"general": (400, 60), "technical": (150, 30), "narrative": (800, 100)}


def by_content_type(docs: DataFrame, content_type: str) -> DataFrame:
    if content_type not in CONTENT_SIZES:
        raise ValueError("content_type must be one of: general, technical, narrative")
    size, overlap = CONTENT_SIZES[content_type]
    return recursive(docs, size, overlap, sp.PROSE, f"content_{content_type}")


def typed_sections(docs: DataFrame) -> DataFrame:
    """Fenced code, pipe tables and text, each split its own way."""
    start = F.struct(F.array().cast("array<struct<kind:string,text:string>>").alias("out"),
                     F.lit("text").alias("kind"), F.lit("").alias("buf"))

    def closed(acc: Column) -> Column:
        return F.when(acc["buf"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(
            F.struct(acc["kind"].alias("kind"), acc["buf"].alias("text")))))

    def step(acc: Column, ln: Column) -> Column:
        opens = ln.rlike("^```(python|js|java)")
        closes = ln.startswith("```") & (acc["kind"] == "code")
        row = ln.rlike(r"^\|.*\|.*\|")
        turns = opens | closes | (row & (acc["kind"] != "table"))
        line = F.concat(ln, F.lit("\n"))
        return F.struct(
            F.when(turns, closed(acc)).otherwise(acc["out"]).alias("out"),
            F.when(opens, "code").when(closes, "text").when(row, "table")
            .otherwise(acc["kind"]).alias("kind"),
            F.when(opens | closes, F.lit("")).when(turns, line)
            .otherwise(F.concat(acc["buf"], line)).alias("buf"))
    staged = stage(docs, _k=F.aggregate(F.split("text", "\n", -1), start, step, closed))

    def only(kind: str) -> Column:
        return F.transform("_k", lambda s: F.when(s["kind"] == kind, s["text"]))
    staged = stage(staged, _code=only("code"), _text=only("text"))
    staged = (staged.withColumn("_c", sp.recursive_split_each(F.col("_code"), 100, 20, sp.PYTHON))
              .withColumn("_x", sp.recursive_split_each(F.col("_text"), 400, 50, sp.PROSE)))
    parts = F.transform("_k", lambda s, i: F.struct(
        s["kind"].alias("kind"), F.coalesce(F.get("_c", i), F.get("_x", i), F.array(s["text"]))
        .alias("texts")))
    rows = staged.select("doc_id", F.posexplode(parts).alias("section", "s"))
    rows = stage(rows, kind=F.col("s.kind"), total=F.size("s.texts"), _t=F.col("s.texts"))
    return rows.select("doc_id", "section", "kind", "total",
                       F.posexplode("_t").alias("index", "text"))


def with_nearest_heading(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks with the last heading at or before them (as-of lookup by offset)."""
    staged = stage(docs, _h=spans_of_pieces(F.split("text", r"(?=(?<!#)#{1,6}\s+)", -1)))
    staged = stage(staged, _h=F.transform(F.filter(
        "_h", lambda h: h["text"].rlike(r"^#{1,6}\s+")), lambda h: F.struct(
            h["start"].alias("start"),
            F.length(F.regexp_extract(h["text"], "^(#{1,6})", 1)).alias("level"),
            strip(F.regexp_extract(h["text"], r"^#{1,6}\s+([^\n]*)", 1)).alias("title"))))
    staged = staged.withColumn("_p", sp.recursive_split(F.col("text"), size, overlap))
    staged = stage(staged, _hit=F.transform("_p", lambda p: F.try_element_at(
        F.filter("_h", lambda h: h["start"] <= p["start"]), F.lit(-1))))
    return stage(staged, total_chunks=F.size("_p")).select(
        "doc_id", "total_chunks", F.posexplode(
        F.arrays_zip("_p", "_hit")).alias("chunk_index", "c")) \
        .select("doc_id", "chunk_index", "total_chunks", F.col("c._hit.title").alias("section"),
                F.col("c._hit.level").alias("section_level"), F.col("c._p.text").alias("text"))


def protected_structures(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Tables, code and images survive the split as units; images become their alt text.

    Each structure is cut out first, so it can never be split, and put back in
    place of its marker afterwards.
    """
    unit = r"(\|[^|\n]*\|[^|\n]*\|[\s\S]*?\n\n|```[\s\S]*?```|!\[.*?\]\(.*?\))"
    staged = stage(docs, _u=F.regexp_extract_all("text", F.lit(unit), 1),
                   _m=F.regexp_replace("text", unit, "[UNIT]"))
    staged = staged.withColumn("_p", sp.recursive_split(F.col("_m"), size, overlap))
    shown = F.transform("_u", lambda u: F.when(u.startswith("!["), F.concat(
        F.lit("[Image description: "), F.regexp_extract(u, r"^!\[(.*?)\]", 1), F.lit("]")))
        .otherwise(u))
    staged = stage(staged, _shown=shown, _marks=F.transform("_p", lambda p: F.struct(
        p["text"].alias("text"), F.size(F.split(F.substring("_m", F.lit(1), p["start"]),
                                                r"\[UNIT\]", -1)).alias("before"))))
    restored = F.transform("_marks", lambda p: F.array_join(F.transform(
        F.split(p["text"], r"\[UNIT\]", -1), lambda t, i: F.when(i == 0, t).otherwise(
            F.concat(F.coalesce(F.get("_shown", p["before"] - 2 + i), F.lit("")), t))), ""))
    return staged.select("doc_id", F.posexplode(restored).alias("chunk_index", "text"))


# --- context blocks and discovery packs -----------------------------------------------------------------

def context_blocks(docs: DataFrame, target_tokens: int = 1500, min_tokens: int = 80
                   ) -> DataFrame:
    """Large line ranges of about ``target_tokens`` words that never end beside a table.

    A short tail joins the block before it; blank edges are trimmed.
    """
    from docmill.functions.arrays import lines
    from docmill.functions.text import TABLE_SEPARATOR, contains_table, pipe_count, word_count

    staged = stage(docs, _l=lines(F.col("text")))
    staged = stage(staged, _i=F.transform("_l", lambda ln: F.struct(
        word_count(ln).alias("n"),
        ((pipe_count(ln) >= 2) | ln.rlike(TABLE_SEPARATOR)).alias("table"))))
    start = F.struct(F.array().cast("array<struct<a:int,b:int,n:int>>").alias("done"),
                     F.lit(0).alias("a"), F.lit(0).alias("n"))

    def fold(ls: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            n = acc["n"] + F.get(ls, i)["n"]
            beside = F.get(ls, i)["table"] | F.coalesce(F.get(ls, i + 1)["table"], F.lit(False))
            full = (n >= target_tokens) & ~beside
            done = F.concat(acc["done"], F.array(F.struct(
                acc["a"].alias("a"), i.alias("b"), n.alias("n"))))
            return F.struct(F.when(full, done).otherwise(acc["done"]).alias("done"),
                            F.when(full, i + 1).otherwise(acc["a"]).alias("a"),
                            F.when(full, 0).otherwise(n).alias("n"))

        def finish(acc: Column) -> Column:
            last = F.size(ls) - 1
            tail = F.struct(acc["a"].alias("a"), last.alias("b"), acc["n"].alias("n"))
            prev = F.try_element_at(acc["done"], F.lit(-1))
            joined = F.struct(prev["a"].alias("a"), last.alias("b"),
                              (prev["n"] + acc["n"]).alias("n"))
            return (F.when(acc["a"] > last, acc["done"])
                    .when((acc["n"] < min_tokens) & (F.size(acc["done"]) > 0), F.concat(
                        F.slice(acc["done"], F.lit(1), F.size(acc["done"]) - 1),
                        F.array(joined)))
                    .otherwise(F.concat(acc["done"], F.array(tail))))
        return F.aggregate(indices(ls), start, step, finish)
    staged = stage(staged, _r=let(F.col("_i"), fold))
    # Trim blank lines at both edges of every range.
    trimmed = F.transform("_r", lambda r: let(F.filter(
        F.sequence(r["a"], r["b"]), lambda i: strip(F.get("_l", i)) != ""), lambda keep: F.struct(
            F.try_element_at(keep, F.lit(1)).alias("a"),
            F.try_element_at(keep, F.lit(-1)).alias("b"), r["n"].alias("n"))))
    staged = stage(staged, _r=F.filter(trimmed, lambda r: r["a"].isNotNull()))
    staged = stage(staged, _t=F.transform("_r", lambda r: F.struct(
        (r["a"] + 1).alias("start_line"), (r["b"] + 1).alias("end_line"),
        r["n"].alias("token_count"), piece(F.col("_l"), r["a"], r["b"]).alias("text"))))
    rows = staged.select("doc_id", F.posexplode("_t").alias("chunk_index", "t")) \
        .select("doc_id", "chunk_index", "t.*")
    return rows.withColumn("contains_table", contains_table(F.col("text")))


def discovery_packs(docs: DataFrame, max_chars: int = 12000, overlap: int = 0) -> DataFrame:
    """Heading sections packed to ``max_chars``; oversized ones hard-split with overlap."""
    sections = F.filter(F.transform(pieces_at(F.col("text"), r"#{1,6}\s+.+?\s*$"), strip),
                        lambda s: s != "")
    staged = stage(docs, _k=pack_texts(sections, max_chars))
    step = max(1, max_chars - overlap)

    def hard(t: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.length(t) - max_chars) / step).cast("int")) * step
        return F.transform(F.sequence(F.lit(0), last, F.lit(step)),
                           lambda a: strip(F.substring(t, a + 1, F.lit(max_chars))))
    rows = staged.select("doc_id", F.posexplode(F.filter(F.flatten(F.transform("_k", hard)),
                                                         lambda t: t != ""))
                         .alias("chunk_index", "text"))
    return rows.select("doc_id", "chunk_index", F.length("text").alias("n_chars"),
                       F.sha2("text", 256).alias("content_hash"), "text")


def evidence_spans(docs: DataFrame, min_block: int = 180) -> DataFrame:
    """Paragraph and table blocks of at least 180 characters, with their heading.

    Large blocks are cut at line breaks near 1400 characters, never below 220.
    """
    sections = spans_of_pieces(pieces_at(F.col("text"), r"#{1,4}\s+.+$"))
    staged = stage(docs, _sec=sections)
    title = F.transform("_sec", lambda s: F.struct(
        s["start"].alias("start"),
        strip(F.regexp_extract(s["text"], r"^#{1,4}\s+([^\n]+)", 1)).alias("heading"),
        spans_of_pieces(_paragraph_pieces(s["text"])).alias("bs")))
    staged = stage(staged, _t=title)
    big = F.flatten(F.transform("_t", lambda s: F.transform(F.filter(
        s["bs"], lambda b: F.length(strip(b["text"])) >= min_block), lambda b: F.struct(
            s["heading"].alias("heading"), (s["start"] + b["start"]).alias("start"),
            (s["start"] + b["end"]).alias("end"), b["text"].alias("text")))))
    staged = stage(staged, _big=big)
    staged = stage(staged, _cut=F.transform("_big", lambda b: _line_cuts(
        b["start"], b["end"], b["text"], 1400, 220)))
    staged = stage(staged, _spans=F.flatten(F.zip_with("_big", "_cut", lambda b, cs: F.transform(
        cs, lambda c: F.struct(
            b["heading"].alias("heading"), c["start"].alias("start"), c["end"].alias("end"),
            strip(F.substring("text", c["start"] + 1, c["end"] - c["start"])).alias("text"))))))
    return staged.select("doc_id", F.posexplode("_spans").alias("span_index", "s")) \
        .select("doc_id", "span_index", "s.*")


def _line_cuts(start: Column, end: Column, text: Column, most: int, least: int) -> Column:
    empty = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"),
                     start.alias("a"), start.alias("b"))

    def step(acc: Column, ln: Column) -> Column:
        stop = acc["b"] + F.length(ln)
        full = (stop - acc["a"] > most) & (acc["b"] - acc["a"] >= least)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.struct(
                acc["a"].alias("start"), acc["b"].alias("end"))))).otherwise(acc["done"])
            .alias("done"),
            F.when(full, acc["b"]).otherwise(acc["a"]).alias("a"), stop.alias("b"))
    whole = F.array(F.struct(start.alias("start"), end.alias("end")))
    return F.when(end - start <= most, whole).otherwise(F.aggregate(
        F.split(text, r"(?<=\n)", -1), empty, step, lambda acc: F.when(
            acc["b"] - acc["a"] >= least, F.concat(acc["done"], F.array(F.struct(
                acc["a"].alias("start"), acc["b"].alias("end"))))).otherwise(acc["done"])))


METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fixed": fixed,
    "databricks_fixed_size": fixed_paragraphs,
    "recursive": recursive,
    "databricks_semantic": logical_recursive,
    "databricks_recursive_code": code_recursive,
    "databricks_adaptive": adaptive,
    "sentence": sentence,
    "markdown": headings,
    "langchain_markdown_header": header_sections_table_safe,
    "regex": legal_headings,
    "semantic": semantic_interquartile,
    "hybrid_recursive_semantic": hybrid_recursive_semantic,
}


def all_methods(docs: DataFrame) -> DataFrame:
    """Chunks of every method, one union."""
    out = None
    for method in METHODS.values():
        one = method(docs)
        out = one if out is None else out.unionByName(one)
    return out
