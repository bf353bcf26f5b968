"""Hard negatives: different-label rows that score nearly as high as an anchor's positives.

Scores are integer inner products of quantised vectors, multiplied in tiles of anchors
and candidates by Strassen's recursion: int64 tiles padded with zeros, seven products of
halves instead of eight.  Sums and differences are exact; int64 wraps modulo 2^64, in
which the recursion holds as well, and no final score leaves 63 bits.

Two passes over the candidates keep a heap per anchor in every task and merge the heaps
in Spark: first the best same-label rows, then, once an anchor's positives are settled,
the best different-label rows of each positive's score window.  Anchors are shipped in
blocks of a checked size, and every block is searched against all rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import forget, hash_blocks, written

#: Anchors of a block (what is broadcast) and of a tile, candidates of a tile, and rows of a task at most.
ANCHORS, GROUP, TILE, TASK_ROWS = 1 << 14, 1 << 9, 1 << 12, 1 << 20
#: The recursion stops at tiles with a side of so many rows or columns.
LEAF = 16
#: Below every score.
NONE = np.iinfo(np.int64).min + 1
#: Inner products stay below this.
SCORE_LIMIT = 1 << 62


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A plain product; through doubles where every partial sum is an integer below 2^53."""
    largest = [max(abs(int(x.max())), abs(int(x.min()))) for x in (a, b)]
    if largest[0] * largest[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(x: np.ndarray) -> np.ndarray:
    """``x`` with a row and a column of zeros where its sides are odd."""
    return np.pad(x, [(0, n % 2) for n in x.shape]) if x.shape[0] % 2 or x.shape[1] % 2 else x


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices, modulo 2^64."""
    rows, columns = a.shape[0], b.shape[1]
    if not a.size or not b.size:
        return np.zeros((rows, columns), np.int64)
    if min(rows, a.shape[1], columns) <= LEAF:
        return _leaf(a, b)
    a, b = _even(a), _even(b)
    r, k, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :k], a[:r, k:], a[r:, :k], a[r:, k:]
    b11, b12, b21, b22 = b[:k, :c], b[:k, c:], b[k:, :c], b[k:, c:]
    m1 = strassen(a11 + a22, b11 + b22)
    m2 = strassen(a21 + a22, b11)
    m3 = strassen(a11, b12 - b22)
    m4 = strassen(a22, b21 - b11)
    m5 = strassen(a11 + a12, b22)
    m6 = strassen(a21 - a11, b11 + b12)
    m7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * r, 2 * c), np.int64)
    out[:r, :c] = m1 + m4 - m5 + m7
    out[:r, c:] = m3 + m5
    out[r:, :c] = m2 + m4
    out[r:, c:] = m1 - m2 + m3 + m6
    return out[:rows, :columns]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


class Heaps:
    """The ``k`` best (score, id) of each of ``n`` queries: higher scores first, ties by smaller id."""

    def __init__(self, scores: np.ndarray, ids: np.ndarray):
        self.scores, self.ids = scores, ids

    @classmethod
    def empty(cls, n: int, k: int) -> Heaps:
        return cls(np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max))

    def part(self, rows: slice) -> Heaps:
        """The heaps of some queries (a view)."""
        return Heaps(self.scores[rows], self.ids[rows])

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer a tile: ``scores`` is NONE where a row does not count; ``ids`` ascend."""
        k = self.scores.shape[1]
        edge = self.scores[:, -1]
        if scores.shape[1] > k:
            edge = np.maximum(edge, np.partition(scores, -k, axis=1)[:, -k])
        q, at = np.nonzero((scores >= edge[:, None]) & (scores > NONE))
        if not len(q):
            return
        touched = np.unique(q)
        who = np.concatenate([np.repeat(touched, k), q])
        score = np.concatenate([self.scores[touched].ravel(), scores[q, at]])
        held = np.concatenate([self.ids[touched].ravel(), ids[at]])
        order = np.lexsort((held, -score, who))
        place = np.arange(len(who)) - np.searchsorted(who[order], who[order])
        best = order[place < k]
        self.scores[touched], self.ids[touched] = score[best].reshape(-1, k), held[best].reshape(-1, k)

    def batch(self, *keys: np.ndarray) -> list[pa.Array]:
        """The keys of every kept row, its id and its score, as Arrow columns."""
        q, at = np.nonzero(self.scores > NONE)
        return [pa.array(c) for c in (*(key[q] for key in keys), self.ids[q, at], self.scores[q, at])]


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, vec) of the rows that take part, vec being floor(256 x) as long.

    No part take a null id, a null label, a null or empty vector, a null or non-finite
    component, a length that most vectors do not have, and components so large that an
    inner product could pass ``SCORE_LIMIT`` (2^28 for 64 of them, that is 2^20 before the
    scaling).  Rows that repeat an id count as one: the least label, then the least vector.
    """
    v = F.col(vec_col)
    fine = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    rows = vectors.filter(F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.cast("array<double>").alias("vec"))
    # sizes number few, and the first one is all that comes to the driver
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = common.d if common else 1
    most = float(math.isqrt(SCORE_LIMIT // d) - 1)
    rows = rows.filter((F.size("vec") == d) & F.forall("vec", lambda x: F.abs(x * 256) < most))
    return rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select(
        "id", "r.label", F.transform("r.vec", lambda x: F.floor(x * 256).cast("long")).alias("vec"))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, transposed vectors) of tiles of rows, ids ascending."""
    for whole in batches:
        for at in range(0, whole.num_rows, TILE):
            batch = whole.slice(at, TILE)
            order = np.argsort(batch.column("id").to_numpy())
            yield (batch.column("id").to_numpy()[order], batch.column("label").to_numpy()[order],
                   np.ascontiguousarray(_matrix(batch.column("vec"))[order].T))


def _positives(shipped, k: int):
    """Arrow function: the ``k`` best same-label rows of a task for each anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, labels, rows = shipped.value
        heaps = Heaps.empty(len(own), k)
        for ids, groups, columns in _tiles(batches):
            for at in range(0, len(own), GROUP):
                part = slice(at, at + GROUP)
                counts = (groups == labels[part, None]) & (ids != own[part, None])
                heaps.part(part).add(np.where(counts, strassen(rows[part], columns), NONE), ids)
        yield pa.RecordBatch.from_arrays(heaps.batch(own), ["anchor_id", "id", "score"])
    return run


def _windows(shipped, k: int, least: int, share: int):
    """Arrow function: the ``k`` best different-label rows of a task in each positive's window,
    which is least / share of its score up to its score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, rows, anchor, anchor_id, positive_id, top = shipped.value
        low = _scaled(top, least, share)
        heaps = Heaps.empty(len(anchor), k)
        for ids, groups, columns in _tiles(batches):
            for at in range(0, len(rows), GROUP):
                scores = strassen(rows[at:at + GROUP], columns)
                scores[groups == labels[at:at + GROUP, None]] = NONE
                first, last = np.searchsorted(anchor, [at, at + GROUP])
                for lo in range(first, last, GROUP):
                    part = slice(lo, min(lo + GROUP, last))
                    own = scores[anchor[part] - at]
                    own[(own < low[part, None]) | (own > top[part, None])] = NONE
                    heaps.part(part).add(own, ids)
        yield pa.RecordBatch.from_arrays(heaps.batch(anchor_id, positive_id, top), ["anchor_id", "positive_id", "positive_score", "id", "score"])
    return run


def _scaled(score: np.ndarray, least: int, share: int) -> np.ndarray:
    """The smallest n with least * score <= share * n, without leaving 64 bits."""
    whole, rest = score // share, score % share
    return whole * least + -(-rest * least // share)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80, share: int = 100,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides.  Each has its ``positives`` best other
    rows of its label; for each of these come the ``negatives`` best rows of other labels
    whose score is at most the positive's and at least least / share of it (which no score
    is for a negative positive's score).  Ties go to the smaller id.  ``usable`` says which
    rows take part; tables without rows, anchors, positives or negatives give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col, label_col)
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(vectors.count() / TASK_ROWS))
    rows = written(rows.repartition(tasks), "negatives-rows")
    anchors = written(rows.filter(F.col("id") % every == 0), "negatives-anchors")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    inside = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    parts = []
    for block in hash_blocks(anchors, "id", ANCHORS):
        own = block.toArrow().combine_chunks().sort_by("id").combine_chunks()  # at most ANCHORS rows
        if not own.num_rows:
            continue
        ids, labels, points = own.column("id").to_numpy(), own.column("label").to_numpy(), _matrix(own.column("vec").combine_chunks())
        shipped = spark.sparkContext.broadcast((ids, labels, points))
        near = (rows.mapInArrow(_positives(shipped, positives), "anchor_id long, id long, score long")
                .withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
                .orderBy("anchor_id", "place").toArrow())  # at most ``positives`` rows an anchor
        shipped.unpersist()
        if not near.num_rows:
            continue
        at = np.searchsorted(ids, near.column("anchor_id").to_numpy())
        asked = spark.sparkContext.broadcast((labels, points, at, *(near.column(c).to_numpy() for c in ("anchor_id", "id", "score"))))
        parts.append(written(
            rows.mapInArrow(_windows(asked, negatives, least, share), "anchor_id long, positive_id long, positive_score long, id long, score long")
            .withColumn("rank", F.row_number().over(inside)).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")),
            "negatives"))
        asked.unpersist()
    forget(anchors)
    forget(rows)
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return functools.reduce(DataFrame.unionByName, parts)
