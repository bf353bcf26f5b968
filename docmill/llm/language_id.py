"""Language of a text by n-gram filters that answer for all languages at once.

Every n-gram of letters is hashed to three places of one table whose entries are bit
masks, a bit for each language: a Bloom filter per language, sliced by bits.  The
conjunction of the three masks names all languages that contain the n-gram.  A text
counts, language by language, how many of its n-grams carry the language's bit; the
counts are corrected for the hits that the filter's fill alone would give, and the
largest one decides.

A language contains an n-gram if enough of its training documents have it, and not far
fewer, by share, than those of some other language.  Spark counts over all training
documents and builds the table by bitwise aggregates.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import forget, written

#: Lengths of the n-grams (a space stands for either end of a word).
LENGTHS = (3, 4)
#: Places of the filter (a power of two) and hashes of an n-gram.
PLACES_LOG, HASHES = 20, 3
#: Languages of the model (the most frequent ones) and n-grams of a language (the most widespread
#: ones): they bound the table that is shipped, 64 MiB at most.
LANGUAGES, GRAMS = 1 << 9, 1 << 16
#: Least share of a language's documents, and least part of the largest share in any language.
LEAST_SHARE, LEAST_PART = 1 / 400, 1 / 4
#: Characters of a text whose n-grams are held at once; n-grams that a task counts before it hands them on.
SLICE, COUNTED = 1 << 18, 1 << 20


@functools.cache
def letters() -> np.ndarray:
    """For every code point: 2 a letter, 1 a mark that belongs to words, 0 anything else."""
    kinds = (unicodedata.category(chr(c))[0] for c in range(0x110000))
    return np.array([{"L": 2, "M": 1}.get(k, 0) for k in kinds], np.uint8)


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters than letters as one space, with a space at both ends."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    word = letters()[raw] > 0
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[0] = True
    return np.where(word, raw, 32)[keep].astype(np.uint64)


def grams(text: str) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of a text, in slices, with repeats."""
    own = codes(text)
    most = max(LENGTHS)
    for at in range(0, len(own), SLICE):
        part = own[at:at + SLICE + most - 1]
        starts = min(SLICE, len(own) - at)
        found = []
        rolled, inner, power = np.zeros(len(part), np.uint64), np.ones(len(part), bool), 1
        for n in range(1, most + 1):
            here = len(part) - n + 1
            if here <= 0:
                break
            # inner: no space strictly inside the window
            if n > 2:
                inner = inner[:here] & (part[n - 2:n - 2 + here] != 32)
            rolled = rolled[:here] + part[n - 1:] * np.uint64(power)
            power = power * 0x9E3779B97F4A7C15 % (1 << 64)
            if n in LENGTHS:
                found.append(_mixed(rolled[:starts][inner[:starts]] + np.uint64(n)))
        yield np.concatenate(found) if found else np.zeros(0, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function (text, lang) -> (lang, gram, docs): documents of a language that have an n-gram."""
    held: dict[str, list] = {}
    waiting = 0

    def merged() -> int:
        size = 0
        for lang, parts in held.items():
            whole = np.concatenate([g for g, _ in parts])
            values, at = np.unique(whole, return_inverse=True)
            totals = np.bincount(at, np.concatenate([c for _, c in parts]), len(values)).astype(np.int64)
            held[lang] = [(values, totals)]
            size += len(values)
        return size

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            for values, totals in parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(values), np.int32))), pa.array(values.view(np.int64)), pa.array(totals)],
                    ["lang", "gram", "docs"])
        held.clear()

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            own = functools.reduce(np.union1d, (np.unique(g) for g in grams(text)))
            held.setdefault(lang, []).append((own, np.ones(len(own))))
            waiting += len(own)
            if waiting > COUNTED:
                size = merged()
                if size > COUNTED // 2:
                    yield from out()
                    size = 0
                waiting = size
    merged()
    yield from out()


class Filters:
    """The table of masks, the languages of its bits, and the share of places each has set."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        fill = np.array([((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        self.false_rate = fill ** HASHES

    def containing(self, found: np.ndarray) -> np.ndarray:
        """Masks of the languages that contain each n-gram."""
        places = np.uint64((1 << PLACES_LOG) - 1)
        out = self.masks[(found & places).astype(np.int64)]
        for i in range(1, HASHES):
            out = out & self.masks[((found >> np.uint64(PLACES_LOG * i)) & places).astype(np.int64)]
        return out

    def hits(self, found: np.ndarray) -> np.ndarray:
        """N-grams that carry each language's bit."""
        used = -(-len(self.languages) // 8)
        own = np.ascontiguousarray(self.containing(found)).view(np.uint8)[:, :used]
        return np.unpackbits(own, axis=1, bitorder="little").sum(0, dtype=np.int64)[:len(self.languages)]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): ``und`` without a letter.  Equal counts go to the language with more training documents."""
        if not text or not (letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] == 2).any() or not self.languages:
            return "und", 0.0
        hits, n = np.zeros(len(self.languages), np.int64), 0
        for found in grams(text):
            hits += self.hits(found)
            n += len(found)
        true = np.maximum((hits - self.false_rate * n) / np.maximum(1 - self.false_rate, 1e-9), 0)
        best = int(true.argmax())
        return self.languages[best], float(true[best] / true.sum()) if true.sum() else 0.0


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters of the languages of ``docs``; rows with a null text or language teach nothing."""
    spark = docs.sparkSession
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = known.groupBy("lang").agg(F.count("*").alias("of")).orderBy(F.desc("of"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return Filters([], np.zeros((1 << PLACES_LOG, 1), np.uint64))
    slots = F.broadcast(spark.createDataFrame([(r.lang, i, r.of) for i, r in enumerate(sizes)], "lang string, slot int, of long"))
    counts = known.join(slots.select("lang"), "lang", "left_semi").select("text", "lang").mapInArrow(_counts, "lang string, gram long, docs long")
    share = (counts.groupBy("lang", "gram").agg(F.sum("docs").alias("docs")).join(slots, "lang")
             .withColumn("share", F.col("docs") / F.col("of")).filter(F.col("share") >= LEAST_SHARE))
    # a gram has a row for each language at most
    part = share.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).filter(F.col("share") >= F.col("most") * LEAST_PART)
    spread = part.withColumn("place", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("docs"), "gram"))).filter(F.col("place") <= GRAMS)
    places = F.array(*[F.shiftrightunsigned("gram", PLACES_LOG * i).bitwiseAND((1 << PLACES_LOG) - 1) for i in range(HASHES)])
    table = written(spread.select(F.explode(places).alias("place"), F.expr("slot div 64").alias("word"), F.expr("shiftleft(1L, slot % 64)").alias("bit"))
                    .groupBy("place", "word").agg(F.bit_or("bit").alias("mask")), "language-filter")
    # a row for each place and word of 64 languages at most
    rows = table.toArrow()
    masks = np.zeros((1 << PLACES_LOG, -(-len(sizes) // 64)), np.uint64)
    masks[rows.column("place").to_numpy(), rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    forget(table)
    return Filters([r.lang for r in sizes], masks)


def predict(docs: DataFrame, model: Filters, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the language of every whole text and a score of 0 to 1: that language's
    part of the corrected counts of all languages.

    Null texts and texts without a letter are ``und`` with score 0, as are all texts for
    filters without languages.  Existing columns of these names are replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # within LANGUAGES * 2^PLACES_LOG bits
    rows = docs.drop(pred_col, score_col)
    schema = rows.select("*", F.lit("").alias(pred_col), F.lit(0.0).alias(score_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            found = [own.predict(text) for text in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([lang for lang, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                [*batch.schema.names, pred_col, score_col])
    return rows.mapInArrow(run, schema)


def fold(doc_id: str) -> F.Column:
    """crc32 of the id as text, modulo 4 (null counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``; fold 2 teaches nothing."""
    rows = docs.select("doc_id", "text", "lang", (fold("doc_id") == 2).alias("held_out"))
    model = fit(rows.filter(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
