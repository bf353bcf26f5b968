"""Approximate nearest neighbours over balanced posting lists.

Balanced bisection of a bounded sample gives the centroids; a neighbour graph over them
is searched in memory.  A vector is filed under its nearest centroid and under every
other one nearly as near, so that vectors at a boundary are found from either side.  A
query reads the lists whose centroids lie within a ratio of the nearest one's distance;
the ratio is measured in every run, on a bounded set of queries whose neighbours are
found exactly.  Distances are then exact.  Rows lie sorted by list in ranges of lists; queries
come in broadcast blocks with the lists they read, and every task keeps the nearest rows of
each query over all its lists, so that a task hands on k rows a query at most.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import hash_blocks, written

#: Documented bound of the sample that fits the centroids, vectors of a list, and most lists.
SAMPLE, LIST_SIZE, MOST_LISTS = 1 << 15, 256, 1 << 12
#: A vector is filed under centroids within this ratio of its nearest one, so many at most
#: (one file suffices for it to be found; further ones serve recall).
FILE_RATIO, FILES = 1.03, 2
#: A query reads lists within this ratio at least, or within the one at which so many
#: queries have found this share of their neighbours.
READ_RATIO, PROBES, PROBE_RECALL = 1.14, 128, 0.97
#: Neighbours in the centroid graph, entry points, and candidates a search keeps open.
DEGREE, ENTRIES, BEAM = 24, 32, 12
#: Rows of a slice, vectors handled at a time, queries of a broadcast block, rows of a task at most.
SLICE, BLOCK, QUERIES, TASK_ROWS = 1 << 12, 1 << 9, 1 << 14, 1 << 20


def bisect(rows: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids of ``lists`` parts of equal size, by repeated two-means splits."""
    parts, random = [(rows, lists)], np.random.default_rng(0)
    done = []
    while parts:
        own, k = parts.pop()
        if k <= 1 or len(own) < 2:
            done.append(own.mean(0))
            continue
        ends = own[random.choice(len(own), 2, replace=False)]
        at = len(own) * (k // 2) // k
        for _ in range(rounds):
            side = own @ (ends[1] - ends[0]) - (ends[1] @ ends[1] - ends[0] @ ends[0]) / 2
            order = np.argsort(side, kind="stable")
            ends = np.stack([own[order[:at]].mean(0), own[order[at:]].mean(0)]) if 0 < at < len(own) else ends
        parts += [(own[order[:at]], k // 2), (own[order[at:]], k - k // 2)]
    return np.array(done)


class Centroids:
    """Centroids and the graph of their neighbours."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.norms = (self.points ** 2).sum(1)
        degree = min(DEGREE, len(points) - 1)
        self.near = np.zeros((len(points), degree), np.int64)
        for at in range(0, len(points), BLOCK):
            gaps = self.norms - 2 * self.points[at:at + BLOCK] @ self.points.T
            gaps[np.arange(len(gaps)), np.arange(at, at + len(gaps))] = np.inf
            self.near[at:at + BLOCK] = np.argsort(gaps, axis=1, kind="stable")[:, :degree]
        # the last neighbours make a ring, so that every centroid can be reached
        if degree > 1:
            self.near[:, -1] = (np.arange(len(points)) + 1) % len(points)
        self.entries = np.unique(np.linspace(0, len(points) - 1, min(ENTRIES, len(points))).astype(np.int64))

    def search(self, rows: np.ndarray, ratio: float) -> np.ndarray:
        """Distances to the centroids that a graph search visits; infinite for the others.

        The search opens every visited centroid within ``ratio`` of the nearest so far,
        and the ``BEAM`` nearest in any case, until none is left.
        """
        n, k = len(rows), len(self.points)
        gaps, opened = np.full((n, k), np.inf), np.zeros((n, k), bool)
        squares = (rows ** 2).sum(1)

        def visit(q: np.ndarray, c: np.ndarray) -> None:
            inner = np.einsum("ij,ij->i", rows[q], self.points[c])
            gaps[q, c] = np.sqrt(np.maximum(squares[q] + self.norms[c] - 2 * inner, 0))

        visit(np.repeat(np.arange(n), len(self.entries)), np.tile(self.entries, n))
        while True:
            beam = np.partition(gaps, min(BEAM, k) - 1, axis=1)[:, min(BEAM, k) - 1]
            limit = np.maximum(_reach(gaps, ratio), np.where(np.isfinite(beam), beam, -1.0))
            q, c = np.nonzero((gaps <= limit[:, None]) & ~opened)
            if not len(q):
                return gaps
            opened[q, c] = True
            q, c = np.repeat(q, self.near.shape[1]), self.near[c].ravel()
            fresh = np.unique((q * k + c)[np.isinf(gaps[q, c])])
            visit(fresh // k, fresh % k)


def _reach(gaps: np.ndarray, ratio: float) -> np.ndarray:
    """Distances up to which a ratio reads (an infinite ratio reads all, also from a centroid itself)."""
    return np.full(len(gaps), np.inf) if math.isinf(ratio) else gaps.min(1) * ratio


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the vectors that take part: a dimension that most of them share, no
    null or non-finite component, not all zero; a null id takes no part either.  Rows that
    repeat an id count as one, the one with the least vector (component by component)."""
    v = F.col(vec_col)
    fine = (F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
            & F.exists(v, lambda x: x != 0))
    rows = vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("vec"))
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return written(rows.filter(F.size("vec") == (common.d if common else 0)).groupBy("id").agg(F.min("vec").alias("vec")), "ann-rows")


def fit(rows: DataFrame, n: int) -> Centroids:
    """Centroids from at most twice ``SAMPLE`` rows by the hash of the id."""
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < math.ceil(min(1.0, SAMPLE / n) * (1 << 31))
    sample = rows.filter(share).limit(2 * SAMPLE).toArrow().sort_by("id").combine_chunks()
    points = _matrix(sample.column("vec").combine_chunks()).astype(np.float64)
    lists = max(1, min(MOST_LISTS, math.ceil(n / LIST_SIZE), len(points) // 4))
    # copies of one vector fill many parts, whose centroids are then one list
    return Centroids(np.unique(bisect(points, lists).round(9), axis=0))


def _filed(centroids, ratio: float):
    """Arrow function (id, vec) -> (list, id, vec): every vector under its nearest lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = centroids.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                gaps = own.search(_matrix(batch.column("vec")).astype(np.float64), ratio)
                order = np.argsort(gaps, axis=1, kind="stable")[:, :FILES]
                best = np.take_along_axis(gaps, order, 1)
                q, place = np.nonzero(best <= best[:, :1] * ratio)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order[q, place].astype(np.int64)), batch.column("id").take(pa.array(q)), batch.column("vec").take(pa.array(q))],
                    ["list", "id", "vec"])
    return run


def _asked(centroids, counts, ratio: float, k: int):
    """Arrow function (id, vec) -> (id, vec, lists): the lists that a query reads, a bit each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sizes = centroids.value, counts.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                gaps = own.search(_matrix(batch.column("vec")).astype(np.float64), ratio)
                # by the ratio, and on through the nearest lists until one has enough rows
                enough = np.where(sizes > k, gaps, np.inf).min(1)
                limit = np.maximum(_reach(gaps, ratio), enough)
                read = (gaps <= limit[:, None]) | np.isinf(limit)[:, None]
                bits = [r.tobytes() for r in np.packbits(read, axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(bits, pa.binary())], ["id", "vec", "lists"])
    return run


class _Heaps:
    """The ``k`` nearest (distance, id) of each of ``n`` queries, every id once; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        touched = np.unique(who)
        who = np.concatenate([np.repeat(touched, k), who])
        scores, ids = np.concatenate([self.scores[touched].ravel(), scores]), np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((ids, scores, who))
        who, scores, ids = who[order], scores[order], ids[order]
        # a row filed under two lists is met twice, at the same distance
        fresh = np.ones(len(who), bool)
        fresh[1:] = (who[1:] != who[:-1]) | (ids[1:] != ids[:-1]) | np.isinf(scores[1:])
        who, scores, ids = who[fresh], scores[fresh], ids[fresh]
        best = np.arange(len(who)) - np.searchsorted(who, who) < k
        self.scores[touched], self.ids[touched] = scores[best].reshape(-1, k), ids[best].reshape(-1, k)


def _nearest(shipped, k: int):
    """Arrow function (list, id, vec) sorted by list -> (query_id, vec_id, score): of a task's rows the
    k nearest to each query that reads their lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked, reads = shipped.value
        heaps, squares = _Heaps(len(own), k), (asked ** 2).sum(1)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                lists, ids, rows = batch.column("list").to_numpy(), batch.column("id").to_numpy(), _matrix(batch.column("vec")).astype(np.float64)
                cuts = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
                for first, last in zip(cuts, cuts[1:], strict=False):
                    readers = np.flatnonzero(reads[:, lists[first] // 8] >> (7 - lists[first] % 8) & 1)
                    for some in range(0, len(readers), BLOCK):
                        _offer(heaps, readers[some:some + BLOCK], own, asked, squares, ids[first:last], rows[first:last], k)
        q, place = np.nonzero(np.isfinite(heaps.scores))
        yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(heaps.ids[q, place]), pa.array(heaps.scores[q, place])],
                                         ["query_id", "vec_id", "score"])
    return run


def _offer(heaps: _Heaps, who: np.ndarray, own: np.ndarray, asked: np.ndarray, squares: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> None:
    """Offer rows of one list to some queries; distances of those that may count are taken exactly."""
    norms = (rows ** 2).sum(1)
    rough = squares[who, None] + norms - 2 * asked[who] @ rows.T
    rough[own[who, None] == ids] = np.inf
    edge = heaps.scores[who, -1] ** 2
    if rough.shape[1] > k:
        edge = np.minimum(edge, np.partition(rough, k - 1, axis=1)[:, k - 1])
    # a margin covers the rounding of the short form
    q, at = np.nonzero((rough <= (edge + 1e-9 * (1 + squares[who] + norms.max()))[:, None]) & np.isfinite(rough))
    if len(q):
        heaps.add(who[q], np.sqrt(((rows[at] - asked[who[q]]) ** 2).sum(1)), ids[at])


def _exact(probes, k: int):
    """Arrow function (id, vec) -> (probe, id, score): the k nearest of a task's rows to each probe."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = probes.value
        near = [(np.zeros(0, np.int64), np.zeros(0))] * len(own)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids, rows = batch.column("id").to_numpy(), _matrix(batch.column("vec")).astype(np.float64)
                scores = (rows ** 2).sum(1)[:, None] - 2 * rows @ asked.T + (asked ** 2).sum(1)
                for p, (held, best) in enumerate(near):
                    edge = best[-1] if len(best) == k else np.inf
                    other = np.flatnonzero((ids != own[p]) & (scores[:, p] <= edge))
                    all_ids, score = np.append(held, ids[other]), np.append(best, scores[other, p])
                    order = np.lexsort((all_ids, score))
                    # rows that repeat an id count once
                    firsts = np.sort(np.unique(all_ids[order], return_index=True)[1])[:k]
                    near[p] = all_ids[order][firsts], score[order][firsts]
        found = np.concatenate([ids for ids, _ in near])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(own, [len(ids) for ids, _ in near])), pa.array(found), pa.array(np.concatenate([s for _, s in near]))],
            ["probe", "id", "score"])
    return run


def measured_ratio(rows: DataFrame, base: DataFrame, centroids: Centroids, every: int, k: int) -> float:
    """The least ratio, of ``READ_RATIO`` or more, at which ``PROBE_RECALL`` of the true neighbours
    of at most ``PROBES`` queries lie in lists that are read."""
    spark = rows.sparkSession
    probes = (rows.filter(F.col("id") % every == 0).orderBy(F.xxhash64("id"), "id").limit(PROBES)
              .toArrow().combine_chunks())
    if not probes.num_rows:
        return READ_RATIO
    own, asked = probes.column("id").to_numpy(), _matrix(probes.column("vec").combine_chunks()).astype(np.float64)
    nearest = Window.partitionBy("probe").orderBy("score", "id")
    true = (rows.mapInArrow(_exact(spark.sparkContext.broadcast((own, asked)), k), "probe long, id long, score double")
            .dropDuplicates(["probe", "id"]).withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k))
    # at most PROBES * k ids, each in few lists
    places = base.select("list", "id").join(F.broadcast(true.select("probe", "id")), "id").distinct().toPandas()
    gaps = np.sqrt(np.maximum((asked ** 2).sum(1)[:, None] + centroids.norms - 2 * asked @ centroids.points.T, 0))
    at = dict(zip(own.tolist(), range(len(own)), strict=True))
    needed: dict[tuple[int, int], float] = {}
    for list_, id_, probe in zip(places["list"].tolist(), places["id"].tolist(), places["probe"].tolist(), strict=True):
        least, gap = gaps[at[probe]].min(), gaps[at[probe], list_]
        ratio = 1.0 if gap <= least else gap / least if least else math.inf
        needed[probe, id_] = min(needed.get((probe, id_), math.inf), ratio)
    ordered = sorted(needed.values())
    ratio = ordered[math.ceil(PROBE_RECALL * len(ordered)) - 1] if ordered else READ_RATIO
    return max(READ_RATIO, ratio * (1 + 1e-9))


def search(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
           read_ratio: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of the rows whose id ``every`` divides.

    Nearness is the Euclidean distance in double precision, ties go to the smaller id; a
    query's own id is no candidate.  Vectors that take no part are described at ``usable``,
    which also says what repeated ids give.  Without ``read_ratio`` the ratio is measured.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centroids = fit(rows, n)
    lists, kind = len(centroids.points), dict(rows.dtypes)["vec"]
    shipped = spark.sparkContext.broadcast(centroids)  # at most MOST_LISTS points
    filed = rows.mapInArrow(_filed(shipped, FILE_RATIO), f"list long, id long, vec {kind}")
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(n / TASK_ROWS))
    # ranges of lists; a list of many rows is cut by the hash of the id
    base = written(filed.repartitionByRange(tasks, "list", F.xxhash64("id")).sortWithinPartitions("list"), "ann-base")
    counts = np.zeros(lists, np.int64)
    for r in base.groupBy("list").count().collect():  # a row for each list
        counts[r.list] = r["count"]
    if read_ratio is None:
        read_ratio = measured_ratio(rows, base, centroids, every, k)
    asked = written(rows.filter(F.col("id") % every == 0).mapInArrow(
        _asked(shipped, spark.sparkContext.broadcast(counts), read_ratio, k), f"id long, vec {kind}, lists binary"), "ann-queries")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    parts = []
    for block in hash_blocks(asked, "id", QUERIES):
        own = block.toArrow().combine_chunks()  # at most QUERIES rows
        if own.num_rows:
            reads = np.frombuffer(b"".join(own.column("lists").to_pylist()), np.uint8).reshape(own.num_rows, -1)
            given = spark.sparkContext.broadcast((own.column("id").to_numpy(), _matrix(own.column("vec").combine_chunks()).astype(np.float64), reads))
            parts.append(base.mapInArrow(_nearest(given, k), "query_id long, vec_id long, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # every block's queries are its own; a row filed twice comes from two tasks at most
    found = functools.reduce(DataFrame.unionByName, parts).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return (found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
