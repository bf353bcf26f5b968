"""Substring dedup: Rabin-Karp hashes of every fixed-length word window.

Every window of 50 words gets a rolling hash.  Windows with the same words have the
same *anchor*, the smallest rolling hash of the 25-word runs inside them, and windows
that follow each other mostly share it.  So the hashes of such a run of windows travel
together under their anchor, and a bucket of anchors counts them: the first document
of each (anchor, hash) keeps its words, later ones lose them.  An anchor's 64 bits and a
window's 48 bits tell windows apart.

Before the shuffle each task settles the windows that repeat within its own buffer, and
what remains of an anchor that stands out in a hash sample of documents is dealt by
window instead of by anchor, so that a passage of a third of all documents does not
meet in one task.  The sample serves balance alone: results do not depend on it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import fresh, packed, utf8

WINDOW = 50
#: Text bytes whose windows meet in one bucket, words buffered by a task, and word hashes a task remembers.
BUCKET_BYTES, BUFFER_WORDS, CACHE_SIZE = 4 << 20, 1 << 19, 1 << 18
#: One in so many documents is looked at for hot anchors; those seen so often are dealt by window.
SAMPLE, HOT_SEEN, MOST_HOT = 64, 50, 1 << 14
#: Base of the rolling hash; 3 modulo 8 keeps as many low bits as an odd base can.
BASE = np.uint64(0x9E3779B97F4A7C13)
LOW48 = np.uint64((1 << 48) - 1)
NOBODY = (1 << 63) - 1


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_SIZE:
            self.clear()
        self[word] = own = xxhash.xxh3_64_intdigest(word)
        return own


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash (modulo 2**64) of every run of ``length`` ids, by doubling."""
    if len(ids) < length:
        return np.zeros(0, np.uint64)
    out, done, level, width = None, 0, ids, 1
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            # a run so far, followed by a run of this width
            out = level if out is None else out[:len(ids) - done - width + 1] * _power(width) + level[done:]
            done += width
        if length >> (bit + 1):
            level = level[:-width] * _power(width) + level[width:]
            width *= 2
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return values if done == width else np.minimum(values[:len(values) - (width - done)], values[width - done:])


def window_hashes(ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, anchor) of every window of a document."""
    half = window // 2
    return rolling(ids, window), sliding_least(rolling(ids, half), window - half + 1)


def before(lengths: np.ndarray) -> np.ndarray:
    """How much comes before each of the parts."""
    return np.cumsum(lengths) - lengths


def _bucket_of(anchors: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchors * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)) % np.uint64(buckets)


SHUFFLED = "bucket long, rows binary, docs binary, starts binary, lengths binary, anchors binary, hashes binary"


def _emit(rids: np.ndarray, docs: np.ndarray, row: np.ndarray, start: np.ndarray, hashes: np.ndarray, anchors: np.ndarray,
          buckets: int, hot: np.ndarray) -> pa.RecordBatch:
    """The windows of a buffer as runs of one anchor, packed by bucket.

    Documents are sorted by id; ``row`` numbers a window's document in the buffer.  Windows of which a smaller
    document of the buffer has the same are settled here: their runs have no anchor hash
    and only report their places.
    """
    order = np.argsort(hashes, kind="stable")  # documents come sorted, so the smallest is first
    h, a, d = hashes[order], anchors[order], docs[row][order]
    head = np.ones(len(order), bool)
    head[1:] = (h[1:] != h[:-1]) | (a[1:] != a[:-1])
    least = d[np.flatnonzero(head)][np.cumsum(head) - 1]
    settled = np.empty(len(order), bool)
    settled[order] = d > least
    single = np.isin(anchors, hot)
    # a run: neighbours of one document with one anchor and one state; hot windows stand alone
    cut = np.ones(len(row), bool)
    cut[1:] = ((row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (settled[1:] != settled[:-1])
               | ((anchors[1:] != anchors[:-1]) & ~settled[1:]) | (single[1:] & ~settled[1:]))
    first = np.flatnonzero(cut)
    length = np.diff(np.append(first, len(row)))
    done = settled[first]
    key = np.where(single[first], anchors[first] ^ hashes[first], anchors[first])
    bucket = np.where(done, docs[row[first]].astype(np.uint64) % np.uint64(buckets), _bucket_of(key, buckets)).astype(np.int64)
    # settled runs before the others, so that hashes can be packed for the latter alone
    by = np.lexsort((first, ~done, bucket))
    first, length, done, bucket = first[by], length[by], done[by], bucket[by]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, int)
    out: list[tuple] = []
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
        f, n, open_ = first[lo:hi], length[lo:hi], ~done[lo:hi]
        at = np.repeat(f[open_] - before(n[open_]), n[open_]) + np.arange(int(n[open_].sum()))
        small = np.ascontiguousarray((hashes[at] & LOW48).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
        out.append((int(bucket[lo]), *(x.tobytes() for x in (
            rids[row[f]], docs[row[f]], start[f].astype(np.int32), n.astype(np.int32), anchors[f[open_]], small))))
    kinds = [pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)],
                                      ["bucket", "rows", "docs", "starts", "lengths", "anchors", "hashes"])


class Buffer:
    """Documents of a task whose windows are settled and sent together."""

    def __init__(self, window: int, buckets: int, hot: np.ndarray):
        self.window, self.buckets, self.hot, self.known = window, buckets, hot, WordHashes()
        self._clear()

    def _clear(self):
        self.parts, self.rids, self.docs, self.words = [], [], [], 0

    def add(self, rid: int, doc: int, words: list[bytes]) -> None:
        if len(words) >= self.window:
            ids = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
            self.parts.append(window_hashes(ids, self.window))
            self.rids.append(rid)
            self.docs.append(doc)
            self.words += len(words)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            order = sorted(range(len(self.docs)), key=self.docs.__getitem__)
            parts = [self.parts[i] for i in order]
            counts = [len(h) for h, _ in parts]
            yield _emit(np.array([self.rids[i] for i in order], np.int64), np.array([self.docs[i] for i in order], np.int64),
                        np.repeat(np.arange(len(counts)), counts), np.concatenate([np.arange(c) for c in counts]),
                        np.concatenate([h for h, _ in parts]), np.concatenate([a for _, a in parts]), self.buckets, self.hot)
        self._clear()


def hot_anchors(rows: DataFrame, window: int) -> np.ndarray:
    """Anchors that many documents of a sample share; at most ``MOST_HOT``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            own = []
            for text in utf8(batch.column("text")):
                words = text.split()
                ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                if len(ids) >= window:
                    own.append(np.unique(window_hashes(ids, window)[1]))
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["anchor"])

    found = (rows.filter(F.pmod(F.col("_row"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "anchor long")
             .groupBy("anchor").count().filter(F.col("count") >= HOT_SEEN).orderBy(F.desc("count"), "anchor").limit(MOST_HOT).collect())
    return np.array([r.anchor for r in found], np.int64).view(np.uint64)


def _settle(table: pa.Table) -> pa.Table:
    """Of one bucket: the places of windows that a smaller document has as well."""
    def whole(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    rows, docs, starts, lengths = whole("rows", np.int64), whole("docs", np.int64), whole("starts", np.int32), whole("lengths", np.int32)
    # in each packed row the settled runs come first, then those with anchors
    n_runs = np.array([len(b) // 8 for b in table.column("rows").to_pylist()])
    n_open = np.array([len(b) // 8 for b in table.column("anchors").to_pylist()])
    place = np.arange(len(rows)) - np.repeat(before(n_runs), n_runs)
    is_open = place >= np.repeat(n_runs - n_open, n_runs)
    out = [(rows[~is_open], docs[~is_open], starts[~is_open], lengths[~is_open])]
    rows, docs, starts, lengths = rows[is_open], docs[is_open], starts[is_open], lengths[is_open]
    anchors = whole("anchors", np.uint64)
    raw = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint8).reshape(-1, 6)
    if len(anchors):
        _, at, counts = np.unique(anchors, return_inverse=True, return_counts=True)
        shared = counts[at] > 1  # an anchor of one run has nothing to compare
        windows = np.repeat(shared, lengths)
        hashes = np.zeros((int(windows.sum()), 8), np.uint8)
        hashes[:, :6] = raw[windows]
        h = hashes.view("<u8").ravel()
        run = np.repeat(np.flatnonzero(shared), lengths[shared])
        offset = np.arange(len(run)) - np.repeat(before(lengths[shared]), lengths[shared])
        order = np.lexsort((docs[run], h, at[run]))
        run, offset, h = run[order], offset[order], h[order]
        head = np.ones(len(run), bool)
        head[1:] = (h[1:] != h[:-1]) | (at[run[1:]] != at[run[:-1]])
        least = docs[run[np.flatnonzero(head)]][np.cumsum(head) - 1] if len(run) else docs[:0]
        late = docs[run] > least
        run, offset = run[late], offset[late]
        out.append((rows[run], docs[run], starts[run] + offset.astype(np.int32), np.ones(len(run), np.int32)))
    rows, docs, starts, lengths = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((starts, docs, rows))
    rows, docs, starts, lengths = rows[order], docs[order], starts[order], lengths[order]
    # neighbouring places become one interval; then one row for each document
    cut = np.ones(len(rows), bool)
    cut[1:] = (rows[1:] != rows[:-1]) | (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + lengths[:-1])
    first = np.flatnonzero(cut)
    ends = np.maximum.reduceat(starts + lengths, first) if len(rows) else starts
    rows, docs, starts = rows[first], docs[first], starts[first]
    intervals = np.stack([starts, ends.astype(np.int32)], 1).astype("<i4") if len(rows) else np.zeros((0, 2), "<i4")
    cut = np.ones(len(rows), bool)
    cut[1:] = (rows[1:] != rows[:-1]) | (docs[1:] != docs[:-1])
    first = np.flatnonzero(cut)
    counts = np.diff(np.append(first, len(rows)))
    return pa.table({"_row": pa.array(rows[first], pa.int64()), "_doc": pa.array(docs[first], pa.int64()),
                     "found": pa.array(packed(intervals.reshape(-1), counts * 2), pa.binary())})


def covered_words(found: list[bytes] | None, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a removed window; ``found`` has (first, end) window starts."""
    marks = np.zeros(n + 1, np.int32)
    if found:
        pairs = np.frombuffer(b"".join(found), "<i4").reshape(-1, 2)
        np.add.at(marks, pairs[:, 0], 1)
        np.add.at(marks, np.minimum(pairs[:, 1] + window - 1, n), -1)
    return np.cumsum(marks[:-1]) > 0


def removals(docs: DataFrame, found: str, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with ``found``: packed intervals of removed window starts, or null.

    A row's identity is (doc_id, hash of the text): repeated rows have the same removals,
    and a null doc_id is larger than any other.
    """
    body, row, doc = F.coalesce(F.col("text"), F.lit("")), fresh("row"), fresh("doc")
    rows = docs.withColumns({row: F.xxhash64("doc_id", body), doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY))})
    texts = rows.select(F.col(row).alias("_row"), F.col(doc).alias("_doc"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(texts, window))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = Buffer(window, buckets, hot.value)
        for batch in batches:
            for rid, own, text in zip(batch.column("_row").to_pylist(), batch.column("_doc").to_pylist(),
                                      utf8(batch.column("text")), strict=True):
                buffer.add(rid, own, text.split())
                if buffer.words >= BUFFER_WORDS:
                    yield from buffer.flush()
        yield from buffer.flush()

    places = (texts.mapInArrow(hashed, SHUFFLED).groupBy("bucket").applyInArrow(_settle, "_row long, _doc long, found binary")
              .groupBy(F.col("_row").alias(row), F.col("_doc").alias(doc)).agg(F.collect_list("found").alias(found)))
    return rows.join(places, [row, doc], "left").drop(row, doc)


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    A null or empty text has no words; texts shorter than a window lose nothing; other
    columns are ignored.
    """
    places = fresh("found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, shas = [], [], []
            for text, found in zip(utf8(batch.column("text")), batch.column(places).to_pylist(), strict=True):
                words = text.split()
                if found:
                    keep = ~covered_words(found, len(words), window)
                    kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                else:
                    kept = words
                counts.append(len(words))
                gone.append(len(words) - len(kept))
                shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return removals(docs.select("doc_id", "text"), places, window).mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated windows cut from the text; the kept words of a changed text
    are joined by one space, other texts and all other columns stay as they are."""
    names, places = docs.columns, fresh("found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, text, found in zip(batch.column("text").to_pylist(), utf8(batch.column("text")),
                                        batch.column(places).to_pylist(), strict=True):
                if found:
                    words = text.split()
                    keep = ~covered_words(found, len(words), window)
                    own = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode()
                out.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return removals(docs, places, window).mapInArrow(run, docs.schema)
