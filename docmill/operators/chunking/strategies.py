"""Retrieval-evaluation chunking strategies over (source_path, provider, text) rows.

Every strategy turns a document row into an array of parts with staged
columns and explodes once, so the chunk order needs no window and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.arrays import indices, let, let_all, lines, running_total, stage
from docmill.functions.text import file_stem, short_sha1, strip
from docmill.operators.chunking import markdown as md
from docmill.operators.chunking import splitters as sp
from docmill.operators.embedding import NGRAM_EACH, EachEmbedder, Embedder, cache_key, embedded, unpacked
from docmill.session import stored
from docmill.sources.index import VersionedTable


def part(text: Column, **meta: Column) -> Column:
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
    entries = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(text.alias("text"), entries.alias("meta"))


def chunk_id(strategy: str, path: Column, index: Column, start: Column, text: Column) -> Column:
    return F.concat_ws(":", F.lit(strategy), path, index.cast("string"), start.cast("string"),
                       short_sha1(text))


def assemble(docs: DataFrame, strategy: str, backward: bool = True,
             located: Callable[[Column], Column] = lambda p: p["text"]) -> DataFrame:
    """Explode ``_parts`` into chunks with source spans, lines and ids."""
    staged = stage(docs, _needles=F.transform("_parts", located))
    spans = sp.locate_parts(F.col("text"), F.col("_needles"), backward)
    zipped = (staged.withColumn("_spans", spans)
              .select("source_path", "provider",
                      F.posexplode(F.arrays_zip("_parts", "_spans")).alias("chunk_index", "c")))
    text, span = F.col("c._parts.text"), F.col("c._spans")
    meta = F.map_concat(F.col("c._parts.meta"), F.create_map(
        F.lit("offset_match"), span["offset_match"].cast("string"),
        F.lit("chunk_length"), F.length(text).cast("string")))
    return (zipped.filter(strip(text) != "")
            .select("source_path", "provider", F.lit(strategy).alias("strategy"),
                    "chunk_index", text.alias("text"), span["start"].alias("start_char"),
                    span["end"].alias("end_char"), span["start_line"].alias("start_line"),
                    span["end_line"].alias("end_line"), meta.alias("metadata"),
                    chunk_id(strategy, F.col("source_path"), F.col("chunk_index"),
                             span["start"], text).alias("chunk_id")))


def _split_each(docs: DataFrame, out: str, texts: Column, size: int, overlap: int,
                separators=sp.DEFAULT) -> DataFrame:
    staged = stage(docs, _to_split=texts)
    return staged.withColumn(
        out, sp.recursive_split_each(F.col("_to_split"), size, overlap, separators)
    ).drop("_to_split")


def _split_prose(docs: DataFrame, size: int, overlap: int,
                 tables: Callable[[Column], Column], table_kind: str) -> DataFrame:
    """``_blocks`` to ``_parts``: tables by rule, prose by the recursive splitter."""
    split = _split_each(docs, "_prose", F.transform(
        "_blocks", lambda b: F.when(b["kind"] == "prose", b["text"])), size, overlap)
    return stage(split, _parts=F.flatten(F.zip_with("_blocks", "_prose", lambda b, ps: F.transform(
        F.when(b["kind"] == "table", tables(b["text"])).otherwise(ps),
        lambda t: F.struct(t.alias("text"), F.map_concat(b["meta"], F.create_map(
            F.lit("block_type"),
            F.when(b["kind"] == "table", table_kind).otherwise("prose"))).alias("meta"))))))


def _header_meta(headers: Column) -> Column:
    titled = F.filter(headers, lambda h: h["title"] != "")
    return F.map_from_entries(F.transform(titled, lambda h: F.struct(
        F.concat(F.lit("Header "), h["level"].cast("string")).alias("key"),
        h["title"].alias("value"))))


def hierarchical_header_recursive(docs: DataFrame, size: int = 900,
                                  overlap: int = 150) -> DataFrame:
    staged = stage(docs, _sections=md.header_sections(F.col("text")),
                   _stem=file_stem(F.col("source_path")))
    staged = _split_each(staged, "_texts", F.transform(
        "_sections", lambda s: s["text"]), size, overlap)
    stem = F.col("_stem")

    def described(s: Column, ts: Column) -> Column:
        titles = md.header_titles(s["headers"])
        last = F.coalesce(F.try_element_at(titles, F.lit(-1)), stem)
        path = F.when(F.size(titles) > 0, F.array_join(titles, " > ")).otherwise(stem)
        return F.transform(ts, lambda t: part(
            t, header_path=path, header_level=F.size(titles), section_title=last,
            header_hierarchy=F.to_json(titles), parent_section_length=F.length(s["text"])))
    staged = stage(staged, _parts=F.flatten(F.zip_with("_sections", "_texts", described)))
    return assemble(staged, "hierarchical_header_recursive")


def markdown_header_recursive_table(docs: DataFrame, size: int = 900,
                                    overlap: int = 150) -> DataFrame:
    staged = stage(docs, _sections=md.header_sections(F.col("text"), 3))
    staged = stage(staged, _blocks=F.flatten(F.transform(
        "_sections", lambda s: F.transform(md.blocks(s["text"]), lambda b: F.struct(
            b["kind"].alias("kind"), b["text"].alias("text"),
            _header_meta(s["headers"]).alias("meta"))))))
    staged = _split_prose(staged, size, overlap,
                          lambda t: md.table_rows_by_size(t, size), "markdown_table")
    return assemble(staged, "markdown_header_recursive_table")


def table_as_one_hybrid(docs: DataFrame, size: int = 900, overlap: int = 150,
                        max_rows: int = 30) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    staged = stage(docs, _blocks=F.transform(md.blocks(F.col("text")), lambda b: F.struct(
        b["kind"].alias("kind"), b["text"].alias("text"), empty.alias("meta"))))
    staged = _split_prose(staged, size, overlap,
                          lambda t: md.table_whole(t, size, max_rows), "table_as_one")
    return assemble(staged, "table_as_one_hybrid")


def heading_level_table_safe(docs: DataFrame, cut_level: int = 2, max_chars: int = 6000,
                             min_chars: int = 300, max_rows: int = 50,
                             strategy: str = "heading_level_table_safe",
                             **extra: str) -> DataFrame:
    sections = md.heading_level_sections(F.col("text"), cut_level, max_chars, min_chars, max_rows)
    added = {k: F.lit(v) for k, v in extra.items()}
    staged = stage(docs.withColumn("_sections", sections), _parts=F.transform(
        "_sections", lambda s: part(
            s["text"], has_table=md.has_table(s["text"]), split_method=s["method"],
            heading_cut_level=F.lit(cut_level), **added)))
    return assemble(staged, strategy)


def markdown_element_fallback(docs: DataFrame, reason: str, cut_level: int = 2) -> DataFrame:
    """The element parser needs a model; without one its table-safe fallback runs."""
    return heading_level_table_safe(docs, cut_level, strategy="llamaindex_markdown_element",
                                    llm_fallback="true", llm_fallback_reason=reason)


# --- semantic boundaries ----------------------------------------------------------------------

SENTENCE = r"(?<=[.?!])\s+"


def array_percentile(values: Column, q: Column | float) -> Column:
    """Linear-interpolation percentile (q in 0..1) of a non-empty array."""
    def at(xs: Column) -> Column:
        place = (F.size(xs) - 1) * (q if isinstance(q, Column) else F.lit(q))
        low = F.floor(place).cast("int")
        a, b = F.get(xs, low), F.get(xs, F.least(low + 1, F.size(xs) - 1))
        return a + (b - a) * (place - low)
    return let(F.sort_array(values), at)


def semantic_groups(sentences: Column, distances: Column, threshold: Column,
                    min_chars: int | None) -> Column:
    """array<string>: sentences joined up to each distance above the threshold.

    A group still shorter than ``min_chars`` keeps growing past its boundary.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"),
                     F.lit(None).cast("string").alias("buf"))

    def fold(ss: Column, ds: Column, limit: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            grown = F.concat_ws(" ", acc["buf"], F.get(ss, i))
            ends = F.coalesce(F.get(ds, i) > limit, F.lit(False))
            if min_chars:
                ends = ends & (F.length(grown) >= min_chars)
            return F.struct(
                F.when(ends, F.concat(acc["done"], F.array(grown))).otherwise(acc["done"])
                .alias("done"),
                F.when(ends, F.lit(None)).otherwise(grown).cast("string").alias("buf"))
        return F.aggregate(indices(ss), start, step, lambda acc: F.when(
            acc["buf"].isNull(), acc["done"]).otherwise(
            F.concat(acc["done"], F.array(acc["buf"]))))
    return let_all([sentences, distances, threshold], fold)


def neighbour_windows(sentences: Column) -> Column:
    """Each sentence with the one before and the one after it."""
    return let(sentences, lambda ss: F.transform(ss, lambda s, i: F.concat_ws(
        " ", F.when(i > 0, F.get(ss, i - 1)), s, F.get(ss, i + 1))))


def stage_semantic(docs: DataFrame, text: str, out: str, threshold: Callable[[Column], Column],
                   min_chars: int | None, embed_each: Callable[[Column], Column],
                   sentence: str = SENTENCE) -> DataFrame:
    """Add ``out``: array<string> of semantically grouped sentences of ``text``."""
    staged = stage(docs, _s=F.split(F.col(text), sentence, -1))
    staged = stage(staged, _w=embed_each.prepare(neighbour_windows(F.col("_s"))))
    staged = staged.withColumn("_d", embed_each.distances(F.col("_w"))).drop("_w")
    staged = stage(staged, _t=threshold(F.col("_d")))
    return stage(staged, **{out: F.when(F.size("_s") <= 1, F.array(F.col(text))).otherwise(
        semantic_groups(F.col("_s"), F.col("_d"), F.col("_t"), min_chars))}
        ).drop("_s", "_d", "_t")


#: Windows whose vectors are asked for by a shipped list of keys; bytes of a window's key (of 32) that are moved.
FAR_WINDOWS, SHORT_KEY = 1 << 18, 16


def semantic_cached(docs: DataFrame, cache: VersionedTable, embed: Embedder, model: str, percentile: float = 0.95,
                    min_chars: int = 200, fallback: Embedder | None = None,
                    prepare: Callable[[Column], Column] = lambda texts: texts) -> DataFrame:
    """Semantic groups whose sentence windows are embedded once, whatever documents share them.

    Distinct windows that ``cache`` lacks are embedded, one by one where a batch fails, and
    stored under their key.  A window that fails even then takes its vector of the whole
    document's from ``fallback``: vectors of two models are never compared.  Without a
    fallback such a document stays in one piece.  Documents have distinct ``source_path``.
    """
    def windowed(rows: DataFrame) -> DataFrame:
        return stage(stage(rows, _s=F.split(F.col("text"), SENTENCE, -1)), _n=neighbour_windows(F.col("_s")))

    def key(w: Column) -> Column:
        return cache_key(w, "semantic", model, "sentence", "")

    def short(k: Column) -> Column:
        return F.unhex(F.substring(k, 1, 2 * SHORT_KEY))
    # only keys are kept and moved; windows are made again where they are embedded
    keyed = stage(windowed(docs.select("source_path", "text")), _w=prepare(F.col("_n")))
    keyed = stored(keyed.select("source_path", F.transform("_w", lambda w: short(key(w))).alias("_k")), "window-keys")
    keys = keyed.select("source_path", F.posexplode("_k").alias("i", "k"))
    # a window belongs to its first document, which embeds its own windows in their order:
    # neighbours are measured there, and their vectors are not moved
    misses = keys.groupBy("k").agg(F.min(F.struct("source_path", "i")).alias("o"))
    if cache.exists():
        misses = misses.join(cache.read().filter("error IS NULL").select(short(F.col("vector_key")).alias("k")).distinct(), "k", "left_anti")
    own = stored(misses.groupBy("o.source_path").agg(F.sort_array(F.collect_list("o.i")).alias("_own")), "own-windows")
    todo = windowed(docs.select("source_path", "text").join(own, "source_path"))
    todo = stage(todo, _w=prepare(F.transform("_own", lambda i: F.get("_n", i))))
    todo = stage(todo.select("_own", "_w"), _k=F.transform("_w", key))
    todo = todo.select(F.inline(F.transform("_own", lambda i, n: F.struct(
        F.get("_k", n).alias("vector_key"), F.get("_w", n).alias("text"),
        F.when((n > 0) & (F.get("_own", n - 1) == i - 1), F.get("_k", n - 1)).alias("prev_key")))))
    version = cache.write(embedded(todo, embed))
    vectors = cache.read(packed=True)
    if "prev_key" not in vectors.columns:  # a cache without a new row, of before distances were kept
        vectors = vectors.withColumns({"prev_key": F.lit(None).cast("string"), "apart": F.lit(None).cast("double")})
    known = vectors.filter("error IS NULL")
    broken = vectors.filter((F.col("batch") == version) & F.col("error").isNotNull()).select(short(F.col("vector_key")).alias("k"))
    failed = None if broken.isEmpty() else keys.join(broken, "k", "left_semi").select("source_path").distinct()
    staged = docs.join(_distances(keyed, known.withColumns({"a": short(F.col("prev_key")), "b": short(F.col("vector_key"))})), "source_path", "left")
    measured = F.coalesce("_d", F.array().cast("array<double>"))
    if failed is None:
        staged = stage(staged.withColumn("_d", measured), _s=F.split(F.col("text"), SENTENCE, -1))
    else:
        staged = windowed(staged.join(failed.withColumn("_f", F.lit(True)), "source_path", "left"))
        again = EachEmbedder(fallback).distances(F.when(F.col("_f"), prepare(F.col("_n")))) if fallback else F.array().cast("array<double>")
        staged = staged.withColumn("_a", again).withColumn("_d", F.when(F.col("_f"), F.col("_a")).otherwise(measured)).drop("_n", "_f", "_a")
    staged = stage(staged, _t=array_percentile(F.col("_d"), percentile))
    staged = stage(staged, _texts=F.when(F.size("_s") <= 1, F.array("text")).otherwise(
        semantic_groups(F.col("_s"), F.col("_d"), F.col("_t"), min_chars))).drop("_s", "_d", "_t")
    return assemble(stage(staged, _parts=F.transform("_texts", lambda t: part(t))), "semantic_embedding")


def _distances(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """(source_path, _d): the distances of each document's neighbouring windows, in their order.

    A pair that many documents share is measured once.  ``known`` has the vectors of windows ``b``, and how
    far ``apart`` they are from the window ``a`` beside which they were embedded; vectors move for other pairs only.
    """
    last = F.greatest(F.size("_k") - 1, F.lit(0))
    # a pair moves as two hashes, 128 bits
    pair = {"p": F.xxhash64("a", "b"), "q": F.xxhash64("b", "a")}
    near = known.filter("apart IS NOT NULL").select(*[c.alias(n) for n, c in pair.items()], "apart") \
        .groupBy("p", "q").agg(F.min("apart").alias("d"))
    steps = keyed.select("source_path", F.posexplode(F.zip_with(F.slice("_k", F.lit(1), last), F.slice("_k", F.lit(2), last),
                         lambda a, b: F.struct(F.xxhash64(a, b).alias("p"), F.xxhash64(b, a).alias("q")))).alias("i", "s"))
    # per document: who lies next to whom and how far, without a distance where it is not known
    found = stored(steps.select("source_path", "i", "s.p", "s.q").join(near, ["p", "q"], "left").groupBy("source_path").agg(
        F.sort_array(F.collect_list(F.struct("i", "d"))).alias("_d")), "near-pairs")
    open_steps = found.select("source_path", F.filter("_d", lambda x: x["d"].isNull()).alias("_d")).filter(F.size("_d") > 0)
    far = stored(open_steps.join(keyed, "source_path").select("source_path", F.inline(F.transform("_d", lambda x: F.struct(
        x["i"].alias("i"), F.get("_k", x["i"]).alias("a"), F.get("_k", x["i"] + 1).alias("b"))))), "far-pairs")
    own = F.transform(F.filter("_d", lambda x: x["d"].isNotNull()), lambda x: x["d"])
    if far.isEmpty():
        return found.select("source_path", own.alias("_d"))
    pairs = far.select("a", "b").distinct()
    asked = stored(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "far-windows")
    if asked.count() <= FAR_WINDOWS:  # counted: the vectors stay where they are, but for these
        asked = F.broadcast(asked)
    held = [c for c in ("embedding", "levels", "codes") if c in known.columns]
    vectors = unpacked(known.select(F.col("b").alias("k"), *held).join(asked, "k", "left_semi").dropDuplicates(["k"]))
    sides = [vectors.select(F.col("k").alias(c), F.col("embedding").alias(f"v{c}")) for c in "ab"]
    measured = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", _apart("va", "vb").alias("d"))
    rest = stored(far.join(measured, ["a", "b"]).groupBy("source_path").agg(F.collect_list(F.struct("i", "d")).alias("_f")), "far-distances")
    both = F.sort_array(F.concat(F.filter("_d", lambda x: x["d"].isNotNull()), F.coalesce("_f", F.array().cast("array<struct<i:int,d:double>>"))))
    return stored(found.join(rest, "source_path", "left").select("source_path", F.transform(both, lambda x: x["d"]).alias("_d")), "distances")


def _apart(left: str, right: str) -> Column:
    """1 - cosine of two unit vectors, summed as ``EachEmbedder.distances`` sums it."""
    @F.pandas_udf(T.DoubleType())
    def measure(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1 - float((np.asarray(x)[None] * np.asarray(y)[None]).sum(axis=1)[0]) for x, y in zip(a, b, strict=True)], dtype=float)
    return measure(left, right)


def semantic_embedding(docs: DataFrame, percentile: float = 0.95, min_chars: int = 200,
                       embed_each: EachEmbedder = NGRAM_EACH) -> DataFrame:
    staged = stage_semantic(docs, "text", "_texts", lambda d: array_percentile(d, percentile),
                            min_chars, embed_each)
    staged = stage(staged, _parts=F.transform("_texts", lambda t: part(t)))
    return assemble(staged, "semantic_embedding")


def markdown_then_semantic(docs: DataFrame, percentile: float = 0.95, min_chars: int = 200,
                           embed_each: EachEmbedder = NGRAM_EACH) -> DataFrame:
    """Sections first, then semantic groups inside each section.

    All sentence windows of a document are embedded in one call and sliced
    back per section, so the row never leaves its task.
    """
    staged = stage(docs, _sec=F.transform(md.header_sections(F.col("text")), lambda s:
                   F.struct(s["headers"].alias("headers"), s["text"].alias("text"),
                            F.split(s["text"], SENTENCE, -1).alias("sents"))))
    staged = stage(staged, _off=running_total(F.transform("_sec", lambda s: F.size(s["sents"]))),
                   _w=F.flatten(F.transform("_sec", lambda s: neighbour_windows(s["sents"]))))
    staged = stage(staged, _w=embed_each.prepare(F.col("_w")))
    staged = staged.withColumn("_all", embed_each.distances(F.col("_w"))).drop("_w")
    # A section's distances skip the one that crosses into the next section.
    staged = stage(staged, _d=F.transform("_sec", lambda s, i: F.slice(
        "_all", F.get("_off", i) + 1, F.greatest(F.size(s["sents"]) - 1, F.lit(0)))))
    staged = stage(staged.drop("_all"), _t=F.transform(
        "_d", lambda d: array_percentile(d, percentile)))
    staged = stage(staged, _parts=F.flatten(F.transform("_sec", lambda s, i: F.transform(
        F.when(F.size(s["sents"]) <= 1, F.array(s["text"])).otherwise(semantic_groups(
            s["sents"], F.get("_d", i), F.get("_t", i), min_chars)),
        lambda t: F.struct(t.alias("text"), _header_meta(s["headers"]).alias("meta"))))))
    return assemble(staged, "markdown_then_semantic")


# --- contracts: definitions, table summaries and late context -------------------------------------

SUMMARY = "**Tóm tắt bảng:**"


def enrich_tables(text: Column) -> Column:
    """Prose kept; each table row group preceded by its deterministic summary."""
    return F.array_join(F.flatten(F.transform(md.blocks(text), lambda b: F.when(
        b["kind"] == "table", F.transform(
            md.table_rows_by_size(b["text"], 1800),
            lambda t: F.concat(F.lit(SUMMARY + " "), md.table_summary(t), F.lit("\n\n"), t)))
        .otherwise(F.array(b["text"])))), "\n\n")


def _attach_summaries(items: Column) -> Column:
    """Move a summary that ends a prose block onto the table that follows it."""
    start = F.struct(F.array().cast("array<struct<kind:string,text:string>>").alias("out"),
                     F.lit("").alias("pending"))

    def step(acc: Column, b: Column) -> Column:
        paragraphs = F.split(b["text"], "\n\n", -1)
        tail = strip(F.element_at(paragraphs, -1))
        noted = (b["kind"] == "prose") & tail.startswith(SUMMARY)
        head = strip(F.array_join(F.slice(paragraphs, F.lit(1), F.size(paragraphs) - 1), "\n\n"))
        prefixed = F.when(acc["pending"] != "", F.concat(
            acc["pending"], F.lit("\n\n"), b["text"])).otherwise(b["text"])
        text = F.when(b["kind"] == "table", prefixed).when(noted, head).otherwise(b["text"])
        return F.struct(
            F.concat(acc["out"], F.array(F.struct(b["kind"].alias("kind"), text.alias("text"))))
            .alias("out"),
            F.when(b["kind"] == "table", F.lit("")).when(noted, tail)
            .otherwise(acc["pending"]).alias("pending"))
    return F.aggregate(items, start, step, lambda acc: F.when(
        acc["pending"] != "", F.concat(acc["out"], F.array(F.struct(
            F.lit("table").alias("kind"), acc["pending"].alias("text")))))
        .otherwise(acc["out"]))


def insurance_contract_hybrid_late(docs: DataFrame, size: int = 900, overlap: int = 150,
                                   max_definitions: int = 6) -> DataFrame:
    """Children of sections with table summaries and the definitions they mention."""
    staged = stage(docs, _defs=md.definitions(F.col("text")),
                   _sections=md.header_sections(F.col("text")))
    staged = stage(staged, _rich=F.transform("_sections", lambda s: F.struct(
        s["headers"].alias("headers"), enrich_tables(s["text"]).alias("text"))))
    staged = stage(staged, _split=F.transform("_rich", lambda s: F.flatten(F.transform(
        md.blocks(s["text"]), lambda b: F.when(b["kind"] == "table", F.transform(
            md.table_rows_by_size(b["text"], size), lambda t: F.struct(
                F.lit("table").alias("kind"), t.alias("text"))))
        .otherwise(F.array(F.struct(F.lit("prose").alias("kind"), b["text"].alias("text"))))))))
    staged = stage(staged, _noted=F.transform("_split", _attach_summaries))
    staged = stage(staged, _blocks=F.flatten(F.transform("_noted", lambda bs, n: F.transform(
        bs, lambda b: F.struct(
            b["kind"].alias("kind"), b["text"].alias("text"), n.alias("n"),
            md.header_path(F.get("_rich", n)["headers"]).alias("path"))))))
    staged = _split_each(staged, "_prose", F.transform(
        "_blocks", lambda b: F.when(b["kind"] == "prose", b["text"])), size, overlap)
    children = F.filter(F.flatten(F.zip_with("_blocks", "_prose", lambda b, ps: F.transform(
        F.when(b["kind"] == "table", F.array(b["text"])).otherwise(ps),
        lambda t: F.struct(t.alias("child"), b["n"].alias("n"), b["path"].alias("path"))))),
        lambda c: strip(c["child"]) != "")
    staged = stage(staged, _children=children)

    def retrieval_text(c: Column) -> Column:
        matches = F.slice(F.filter("_defs", lambda d: F.lower(c["child"]).contains(
            F.lower(d["term"]))), 1, max_definitions)
        listed = F.array_join(F.transform(matches, lambda d: F.concat(
            F.lit("- "), d["term"], F.lit(": "), d["definition"])), "\n")
        path = F.when(c["path"] == "", F.lit("/")).otherwise(c["path"])
        return F.struct(
            F.concat_ws("\n\n", F.concat(F.lit("Header path: "), path),
                        F.when(listed != "", F.concat(F.lit("Định nghĩa liên quan:\n"), listed)),
                        c["child"]).alias("text"),
            F.create_map(
                F.lit("parent_index"), c["n"].cast("string"),
                F.lit("parent_header_path"), c["path"],
                F.lit("definition_terms"), F.to_json(F.transform(matches, lambda d: d["term"])),
                F.lit("source_text"), c["child"]).alias("meta"))
    staged = stage(staged, _parts=F.transform("_children", retrieval_text))

    def source(p: Column) -> Column:
        bare = strip(F.array_join(F.filter(
            lines(p["meta"]["source_text"]),
            lambda ln: ~strip(ln).startswith(SUMMARY)), "\n"))
        return F.when(bare != "", bare).otherwise(p["meta"]["source_text"])
    return assemble(staged, "insurance_contract_hybrid_late", backward=False, located=source)


# --- boundaries proposed by a model ------------------------------------------------------------------

def aligned_cover(segment: Column, proposed: Column) -> Column:
    """Are the proposed texts an ordered verbatim cover of the segment?

    Everything between them and after them must be whitespace.
    """
    start = F.struct(F.lit(True).alias("ok"), F.lit(0).alias("at"))

    def step(acc: Column, text: Column) -> Column:
        found = F.call_function("locate", text, segment, acc["at"] + 1)
        gap = F.substring(segment, acc["at"] + 1, found - 1 - acc["at"])
        return F.struct((acc["ok"] & (found > 0) & (strip(gap) == "")).alias("ok"),
                        F.when(found > 0, found - 1 + F.length(text)).otherwise(acc["at"])
                        .cast("int").alias("at"))
    return F.aggregate(proposed, start, step, lambda acc: acc["ok"] & (
        strip(F.substring(segment, acc["at"] + 1, F.length(segment))) == ""))


def tables_intact(segment: Column, proposed: Column, max_rows: int = 50) -> Column:
    """Every source table (or each of its row groups) sits whole in one proposed text."""
    def once(table: Column) -> Column:
        return F.size(F.filter(proposed, lambda p: p.contains(strip(table)))) == 1
    tables = F.filter(md.blocks(segment), lambda b: b["kind"] == "table")
    return F.forall(tables, lambda b: once(b["text"]) | let(
        md.table_rows_by_count(b["text"], max_rows),
        lambda groups: (F.size(groups) > 1) & F.forall(groups, once)))


def deterministic_blocks(segment: Column, max_rows: int = 50) -> Column:
    """Fallback parts: prose blocks whole, tables by row groups."""
    return F.flatten(F.transform(md.blocks(segment), lambda b: F.when(
        b["kind"] == "table", F.transform(
            md.table_rows_by_count(b["text"], max_rows), lambda t: part(
                strip(t), split_method=F.lit("llm_fallback_table"), type=F.lit("table"))))
        .otherwise(F.array(part(strip(b["text"]), split_method=F.lit("llm_fallback_text"),
                                type=F.lit("text"))))))


def llm_markdown_optimal(docs: DataFrame,
                         propose_each: Callable[[Column], Column] | None = None,
                         cut_level: int = 2, max_chars: int = 6000, max_rows: int = 50
                         ) -> DataFrame:
    """Table-safe seeds re-cut at proposed boundaries where those are valid.

    ``propose_each`` maps array<string> (the segments) to array<array<string>>,
    an Arrow UDF around a model.  A proposal that rewrites text or cuts a table
    is refused and the segment's deterministic blocks are used.
    """
    seeded = docs.withColumn("_sections", md.heading_level_sections(
        F.col("text"), cut_level, max_chars, 300, max_rows))
    staged = stage(seeded, _seeds=F.transform("_sections", lambda s: s["text"]))
    staged = stage(staged, _fallback=F.transform(
        "_seeds", lambda s: deterministic_blocks(s, max_rows)))
    if propose_each is None:
        return assemble(stage(staged, _parts=F.flatten("_fallback")), "llm_markdown_optimal")
    staged = staged.withColumn("_proposed", propose_each(F.col("_seeds")))
    staged = stage(staged, _valid=F.zip_with("_seeds", "_proposed", lambda s, ps: F.coalesce(
        (F.size(ps) > 0) & aligned_cover(s, ps) & tables_intact(s, ps, max_rows), F.lit(False))))
    staged = stage(staged, _parts=F.flatten(F.transform("_valid", lambda ok, i: F.when(
        ok, F.transform(F.get("_proposed", i), lambda t: part(
            t, split_method=F.lit("llm"), type=F.lit("mixed"))))
        .otherwise(F.get("_fallback", i)))))
    return assemble(staged, "llm_markdown_optimal")


# --- registry --------------------------------------------------------------------------------------------

STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "semantic_embedding": semantic_embedding,
    "heading_level_table_safe": heading_level_table_safe,
    "markdown_header_recursive_table": markdown_header_recursive_table,
    "insurance_contract_hybrid_late": insurance_contract_hybrid_late,
    "llm_markdown_optimal": llm_markdown_optimal,
    "markdown_then_semantic": markdown_then_semantic,
    "table_as_one_hybrid": table_as_one_hybrid,
    "llamaindex_markdown_element": lambda docs, **kw: markdown_element_fallback(
        docs, kw.pop("reason", "no element parser configured"), **kw),
    "hierarchical_header_recursive": hierarchical_header_recursive,
}


def run_strategies(docs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Chunks of every selected strategy; an unknown name is an error."""
    chosen = list(STRATEGIES) if names is None else names
    unknown = [n for n in chosen if n not in STRATEGIES]
    if unknown:
        raise ValueError(f"Unknown chunking strategies: {', '.join(unknown)}")
    out = [STRATEGIES[n](docs) for n in chosen]
    merged = out[0]
    for df in out[1:]:
        merged = merged.unionByName(df)
    return merged
