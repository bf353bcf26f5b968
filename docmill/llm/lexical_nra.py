"""Ranked lexical search by sequential, impact-sorted reads without random access.

Documents become rows of (number of terms, query terms with their counts) in one pass
over whole texts; corpus statistics are aggregates of these rows.  Every task then reads
its documents in segments.  Within a segment a term's postings are sorted by impact, and
an item's lists are read from the top in rounds.  A document's score lies between the
sum of what was read of it and that sum plus the impacts at which the lists it was not
met in now stand.  Reading goes on until the segment's best documents, their order and
their final scores admit no other outcome.  A task carries its best scores from segment
to segment, so later segments often end early; tasks hand on ten rows an item.

All arithmetic is in 64-bit integers, but for the weight of a term.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import forget, utf8, written

#: What is shipped to tasks holds at most so many items, and at most so many bytes of item text
#: unless one item has more.
ITEMS, ITEM_BYTES = 1 << 10, 1 << 23
#: Postings of a segment; documents times terms of an item that are handled at once.
SEGMENT, CELLS = 1 << 19, 1 << 21
#: Postings that the first round reads of every list; each round reads twice as far.
DEPTH = 64
#: A term is a run of ASCII letters and digits and of bytes beyond ASCII; A-Z become a-z.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
POSTINGS = "doc_id long, row long, n long, terms array<int>, counts array<long>"


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order, with repeats."""
    return raw.translate(FOLD).split(b" ")


def _postings(shipped):
    """Arrow function (doc_id, row, text) -> ``POSTINGS``: how many terms a text has, and which of the items'."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            sizes, ends, terms, counts = [], [0], [], []
            for raw in utf8(batch.column("text")):
                found = Counter(terms_of(raw))
                found.pop(b"", None)
                sizes.append(found.total())
                for term in found.keys() & known.keys():
                    terms.append(known[term])
                    counts.append(found[term])
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))],
                ["doc_id", "row", "n", "terms", "counts"])
    return run


def nra(lists: list[tuple[np.ndarray, np.ndarray]], documents: int, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, postings read): every document that may be among the ``k`` best of
    this or any larger collection in which ``k`` documents already score ``floor`` or more.

    ``lists`` has (documents, impacts) of each term, impacts falling.  All documents tied
    with the last one that counts are returned, with final scores; none is zero.
    """
    lower = np.zeros(documents, np.int64)
    seen = np.zeros((documents, len(lists)), bool)
    at, depth = [0] * len(lists), DEPTH
    frontier = np.array([impacts[0] if len(impacts) else 0 for _, impacts in lists], np.int64)
    while True:
        for t, (docs, impacts) in enumerate(lists):
            here = slice(at[t], min(depth, len(docs)))
            lower[docs[here]] += impacts[here]  # a document is in a list once
            seen[docs[here], t] = True
            at[t] = here.stop
            frontier[t] = impacts[here.stop] if here.stop < len(impacts) else 0
        edge = max(floor, int(np.partition(lower, -k)[-k]) if documents > k else 0, 1)
        able = np.flatnonzero(lower + frontier.sum() >= edge)
        missing = frontier.sum() - seen[able] @ frontier
        counts = lower[able] + missing >= edge
        # an interval of length zero is final; documents that fall short need none
        if not missing[counts].any():
            found = able[counts]
            return found, lower[found], sum(at)
        depth *= 2


class _Best:
    """An item's best (score, doc_id, row) so far."""

    def __init__(self, k: int):
        self.k = k
        self.rows: list[tuple] = []

    def floor(self) -> int:
        return -self.rows[self.k - 1][0] if len(self.rows) == self.k else 0

    def add(self, found: list[tuple]) -> None:
        self.rows = sorted(self.rows + found)[:self.k]


def _search(shipped, k: int):
    """Arrow function ``POSTINGS`` -> the ``k`` best documents of a task for each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, documents, length = shipped.value
        best = [_Best(k) for _ in items]
        for part in _segments(batches):
            _search_segment(part, items, weights, documents, length, best, k)
        rows = [(i, -s, d, r) for i, own in enumerate(best) for s, _, d, r in own.rows]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "score", "doc_id", "row"])
    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows gathered until they hold ``SEGMENT`` postings (one document always fits)."""
    held, size = [], 0
    for whole in batches:
        ends = np.cumsum(np.asarray(whole.column("terms").value_lengths().fill_null(0)))
        start = 0
        while start < whole.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + SEGMENT - size, side="right")), start + (not held))
            if stop > start:
                held.append(whole.slice(start, stop - start))
                size += int(ends[stop - 1] - before)
            if stop < whole.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            start = stop
    if held:
        yield pa.Table.from_batches(held)


def _search_segment(part: pa.Table, items: list[np.ndarray], weights: np.ndarray, documents: int, length: int,
                    best: list[_Best], k: int) -> None:
    """Search a segment for all items; ``best`` takes what counts."""
    part = part.combine_chunks()
    ids, rows, sizes = (part.column(c).to_pylist() for c in ("doc_id", "row", "n"))
    lists = part.column("terms").combine_chunks()
    owner = np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
    terms = np.asarray(lists.flatten()).astype(np.int64)
    tf = np.asarray(part.column("counts").combine_chunks().flatten())
    m = 10 + 90 * np.array(sizes, np.int64) * documents // max(length, 1)
    impact = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[owner]))
    order = np.lexsort((owner, -impact, terms))
    terms, owner, impact = terms[order], owner[order], impact[order]
    starts = np.searchsorted(terms, np.arange(len(weights) + 1))
    for i, asked in enumerate(items):
        own = [(owner[starts[t]:starts[t + 1]], impact[starts[t]:starts[t + 1]]) for t in asked.tolist()]
        own = [(d, s) for d, s in own if len(d)]
        # very long items see a segment's documents in several parts
        step = max(1, CELLS // max(len(own), 1))
        for first in range(0, len(ids), step):
            lists_ = own
            if step < len(ids):
                lists_ = [(d[inside] - first, s[inside]) for d, s in own if (inside := (d >= first) & (d < first + step)).any()]
            if not lists_:
                continue
            found, scores, _ = nra(lists_, min(step, len(ids) - first), k, best[i].floor())
            # null ids come last among equal scores
            best[i].add([(-s, (ids[d] is None, ids[d] or 0, rows[d]), ids[d], rows[d])
                         for d, s in zip((found + first).tolist(), scores.tolist(), strict=True)])


def _blocks(items: DataFrame) -> list[DataFrame]:
    """The items by hash, in blocks within ``ITEMS`` and ``ITEM_BYTES`` (counted), or of one item."""
    size = F.octet_length("text")
    total = items.agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    blocks = max(1, math.ceil(total.n / ITEMS), math.ceil((total.b or 0) / ITEM_BYTES))
    while True:
        block = F.pmod(F.xxhash64("key"), F.lit(blocks))
        worst = items.groupBy(block.alias("b")).agg(F.count("*").alias("n"), F.sum(size).alias("s")).filter(
            (F.col("n") > 1) & ((F.col("n") > ITEMS) | (F.col("s") > ITEM_BYTES)))
        if worst.isEmpty():
            return [items.filter(block == b) for b in range(blocks)]
        blocks *= 2


def rank(documents: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item, scores above 0 only.

    Every row of ``documents`` is a document, also where an id repeats or is null; equal
    scores go to the smaller id (null last).  Null and empty texts hold no term.  Rows that
    repeat an item id count as one item, the one with the least text; a null item id is an
    id like any other.  Without items, documents or shared terms there are no rows.
    """
    spark = documents.sparkSession
    item_kind = dict(items.dtypes)[item_col]
    schema = f"item_id {item_kind}, rank int, doc_id long, score long"
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(item_text_col, F.lit("")).alias("text"))
    asked = written(asked.groupBy("item_id").agg(F.min("text").alias("text"))
                    .withColumn("key", F.coalesce(F.col("item_id").cast("string"), F.lit(""))), "nra-items")
    docs = documents.select(F.col(doc_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    parts = []
    for block in _blocks(asked):
        parts.append(_rank_block(docs, block.toArrow(), k, item_kind))  # within ITEMS and ITEM_BYTES
    forget(asked)
    parts = [p for p in parts if p is not None]
    return functools.reduce(DataFrame.unionByName, parts).select("item_id", "rank", "doc_id", "score") if parts \
        else spark.createDataFrame([], schema)


def _rank_block(docs: DataFrame, block: pa.Table, k: int, item_kind: str) -> DataFrame | None:
    """Ranked rows of one block of items; None where it has no terms."""
    spark = docs.sparkSession
    texts = [set(terms_of(raw)) - {b""} for raw in utf8(block.column("text"))]
    known = {term: i for i, term in enumerate(sorted(set().union(*texts)))} if texts else {}
    if not known:
        return None
    shipped = spark.sparkContext.broadcast(known)
    index = written(docs.mapInArrow(_postings(shipped), POSTINGS), "nra-postings")
    shipped.unpersist()
    total = index.filter("n > 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    # at most as many rows as the block has terms
    df = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().toPandas().itertuples(index=False, name=None))
    weights = np.array([math.floor(1000 * math.log((2 * total.n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(known))], np.int64)
    items = [np.array(sorted(known[t] for t in own), np.int64) for own in texts]
    asked = spark.sparkContext.broadcast((items, weights, total.n, total.l))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ids = F.broadcast(spark.createDataFrame(list(enumerate(block.column("item_id").to_pylist())), f"item long, item_id {item_kind}"))
    found = (index.filter(F.size("terms") > 0).mapInArrow(_search(asked, k), "item long, score long, doc_id long, row long")
             .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
    out = written(found.join(ids, "item").select("item_id", "rank", "doc_id", "score"), "nra-ranked")
    asked.unpersist()
    forget(index)
    return out
