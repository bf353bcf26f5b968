"""Chunks that a model proposed: exact-cover check, repair, fallback, and what to ask next.

Answers are rows of a table, (text_key, response), the key being the MD5 of the text:
equal texts share an answer, and a later run asks only for keys that have none.  A key
with several answers takes the least; a null answer counts as none.  Texts meet answers
by an equi-join on the key; everything else is local to a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.arrays import delimited, stage
from docmill.functions.text import strip
from docmill.operators.chunking import splitters as sp
from docmill.operators.chunking.research import with_word_statistics

#: The answer's form: units are counted from 1, ranges include both ends.
RANGES = "struct<chunks:array<struct<start_unit:int,end_unit:int>>>"


def text_key(text: Column) -> Column:
    return F.md5(text)


def paragraphs(text: Column) -> Column:
    """array<struct<start,end,text>>: the default source units."""
    return delimited(text, r"\n\s*\n")


def requests(docs: DataFrame, answers: DataFrame, units: Column | None = None, preview: int = 220) -> DataFrame:
    """(text_key, units) of every distinct text without an answer; a unit has id, chars, preview."""
    keyed = docs.filter(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("text_key"), "text")
    known = answers.filter(F.col("response").isNotNull()).select("text_key")
    open_ = keyed.join(known, "text_key", "left_anti").groupBy("text_key").agg(F.first("text").alias("text"))
    staged = stage(open_, _u=paragraphs(F.col("text")) if units is None else units)
    return staged.select("text_key", F.transform("_u", lambda u, i: F.struct(
        (i + 1).alias("unit_id"), F.length(u["text"]).alias("chars"),
        F.substring(strip(F.regexp_replace(u["text"], r"\s+", " ")), 1, preview).alias("preview"))).alias("units"))


def _answered(docs: DataFrame, answers: DataFrame) -> DataFrame:
    least = answers.groupBy("text_key").agg(F.min("response").alias("_response"))
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("_key"))
    return keyed.join(least, F.col("_key") == F.col("text_key"), "left").drop("_key", "text_key")


def cover_status(ranges: Column, units: Column) -> Column:
    """How ranges cover the units 1..n: valid, unknown_unit, overlapping or gapped."""
    before = F.transform(ranges, lambda r, i: F.when(i == 0, F.lit(0)).otherwise(F.get(ranges, i - 1)["end_unit"]))
    pairs = F.arrays_zip(ranges.alias("r"), before.alias("b"))
    known = F.forall(ranges, lambda r: F.coalesce(
        (r["start_unit"] >= 1) & (r["end_unit"] >= r["start_unit"]) & (r["end_unit"] <= units), F.lit(False)))
    return (F.when(~known, "unknown_unit")
            .when(F.exists(pairs, lambda p: p["r"]["start_unit"] <= p["b"]), "overlapping")
            .when(F.exists(pairs, lambda p: p["r"]["start_unit"] != p["b"] + 1)
                  | (F.element_at(ranges, -1)["end_unit"] != units), "gapped").otherwise("valid"))


def proposed_chunks(docs: DataFrame, answers: DataFrame, units: Column | None = None, repair: bool = True,
                    size: int = 1000, overlap: int = 100) -> DataFrame:
    """Chunks cut at unit ranges that an answer names: doc_id, chunk_index, status, first_unit,
    last_unit, start, end, text.

    A valid answer is used as it is.  With ``repair`` any other one gives its starts that
    are units, and a chunk runs from one start to the next (the first from unit 1), so
    that every unit is in one chunk: units of a gap join the chunk before them, and a
    chunk ends where the next one starts.  Without ``repair``, and where there is no
    answer (``missing``), none that can be read or an empty one (``unreadable``), the text is split recursively
    and the unit columns are null.  Null and blank texts give no chunk.  Rows that
    repeat a doc_id each give their chunks; other columns are ignored.
    """
    text = F.col("text")
    staged = stage(_answered(docs, answers).filter(F.length(strip(text)) > 0),
                   _u=paragraphs(text) if units is None else units,
                   _r=F.from_json("_response", RANGES)["chunks"])
    n = F.size("_u")
    staged = stage(staged, status=F.when(F.col("_response").isNull(), "missing")
                   .when(F.coalesce(F.size("_r"), F.lit(0)) <= 0, "unreadable").otherwise(cover_status(F.col("_r"), n)))
    used = (F.col("status") == "valid") | (F.lit(repair) & ~F.col("status").isin("missing", "unreadable"))
    starts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1)), F.filter(
        F.transform("_r", lambda r: r["start_unit"]), lambda s: (s >= 1) & (s <= n)))))
    staged = stage(staged, _cuts=F.when(used, starts))
    cut = F.transform("_cuts", lambda s, i: F.struct(
        s.alias("first_unit"), (F.coalesce(F.get("_cuts", i + 1), n + 1) - 1).alias("last_unit")))
    staged = stage(staged.withColumn("_plain", sp.recursive_split(F.when(F.col("_cuts").isNull(), text), size, overlap, sp.PROSE)), _c=cut)
    views = F.coalesce(
        F.transform("_c", lambda c: F.struct(
            c["first_unit"].alias("first_unit"), c["last_unit"].alias("last_unit"),
            F.get("_u", c["first_unit"] - 1)["start"].cast("int").alias("start"),
            F.get("_u", c["last_unit"] - 1)["end"].cast("int").alias("end"))),
        F.transform("_plain", lambda p: F.struct(
            F.lit(None).cast("int").alias("first_unit"), F.lit(None).cast("int").alias("last_unit"),
            p["start"].cast("int").alias("start"), p["end"].cast("int").alias("end"))))
    rows = stage(staged, _v=views).select("doc_id", "status", "text", F.posexplode("_v").alias("chunk_index", "v"))
    return rows.select("doc_id", "chunk_index", "status", "v.*",
                       F.expr("substring(text, v.start + 1, v.end - v.start)").alias("text"))


def proposed_texts(docs: DataFrame, answers: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Chunks that an answer spells out as a JSON array of strings, with their word statistics.

    Blank strings are dropped; without an answer that has any other, the text is split
    recursively.  Null and blank texts give no chunk.
    """
    staged = stage(_answered(docs, answers).filter(F.length(strip(F.col("text"))) > 0), _t=F.filter(
        F.transform(F.from_json("_response", "array<string>"), strip), lambda t: F.length(t) > 0))
    lacks = F.coalesce(F.size("_t"), F.lit(0)) <= 0
    split = staged.withColumn("_plain", sp.recursive_split(F.when(lacks, F.col("text")), size, overlap, sp.PROSE))
    rows = stage(split, _c=F.when(lacks, F.transform("_plain", lambda p: p["text"])).otherwise(F.col("_t")))
    return with_word_statistics(rows.select("doc_id", F.size("_c").alias("total_chunks"),
                                            F.posexplode("_c").alias("chunk_index", "text")))
