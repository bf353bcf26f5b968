"""A stored dense index: vectors in cells around centroids, beside the chunk batches.

The centroids are fitted once, on a bounded sample, and kept; vectors lie in folders by
cell.  A search reads the cells nearest to its queries only and keeps the best items of
every query inside each task.  How many cells a query probes is measured when the index
is made: as many as find the wanted share of the true neighbours of sampled vectors.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.operators.postings import Best
from docmill.session import hash_blocks, scratch_path
from docmill.sources.index import VersionedTable

#: Vectors that fit the centroids, cells at most, vectors of a cell before there are so many cells.
SAMPLE, MOST_CELLS, CELL_SIZE = 1 << 14, 1 << 8, 64
#: Sampled vectors whose true neighbours are found, neighbours of each, and the share of them to be found.
PROBED, NEIGHBOURS, RECALL = 128, 10, 0.97
#: Queries of a pass, and vectors handled at a time.
PASS_QUERIES, BLOCK = 1 << 12, 1 << 11


def unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def fitted(rows: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of at most ``cells`` groups by cosine (spherical k-means from a fixed start)."""
    rows = unit(rows)
    points = rows[np.random.default_rng(0).permutation(len(rows))[:cells]]
    for _ in range(rounds):
        near = (rows @ points.T).argmax(1)
        sums = np.zeros_like(points)
        np.add.at(sums, near, rows)
        points = unit(np.where(np.bincount(near, minlength=len(points))[:, None] > 0, sums, points))
    return np.unique(points.round(9), axis=0)


class VectorIndex:
    """Approximate cosine search over (item, embedding) with upserts and deletions.

    All vectors have the length of those the index was made from; null vectors, vectors of
    another length and vectors with a null or NaN component are not stored.  The latest
    entry of an item counts; of several vectors under an item in one batch the greatest.
    """

    def __init__(self, spark: SparkSession, root: str, item: str = "chunk_id"):
        self.spark, self.root, self.item = spark, root.rstrip("/"), item
        self.table = VersionedTable(spark, f"{self.root}/vectors", ["cell"])
        self.shape = VersionedTable(spark, f"{self.root}/centroids")

    # --- making ------------------------------------------------------------------------

    def create(self, vectors: DataFrame) -> int:
        """Fit centroids to ``vectors``, store them all, and measure how many cells to probe."""
        sizes = vectors.groupBy(F.size("embedding").alias("w")).count().filter("w > 0").orderBy(F.desc("count"), "w").first()
        width, n = (sizes.w, sizes["count"]) if sizes else (1, 0)
        kept = self._stored(self._fine(vectors.select(self.item, "embedding"), width))
        share = F.pmod(F.xxhash64(self.item), F.lit(1 << 31)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 31))
        sample = kept.filter(share).orderBy(self.item).limit(2 * SAMPLE).toArrow().column("embedding").combine_chunks()
        points = fitted(_matrix(sample), max(1, min(MOST_CELLS, n // CELL_SIZE))) if len(sample) else np.zeros((1, width))
        self._keep(points, len(points))
        version = self.upsert(kept)
        if len(points) > 1:
            self._keep(points, self._measured(kept, points))
        return version

    def _stored(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "vectors")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _keep(self, points: np.ndarray, probes: int) -> None:
        rows = [(i, p.tolist(), probes) for i, p in enumerate(points)]  # MOST_CELLS at most
        self.shape.write(self.spark.createDataFrame(rows, "cell int, point array<double>, probes int").coalesce(1))

    def centroids(self) -> tuple[np.ndarray, int]:
        rows = self.shape.read().filter(F.col("batch") == self.shape.versions()[-1]).orderBy("cell").collect()
        return np.array([r.point for r in rows]), rows[0].probes

    def _measured(self, vectors: DataFrame, points: np.ndarray) -> int:
        """Cells to probe so that ``RECALL`` of the neighbours of at most ``PROBED`` vectors lie in them."""
        probes = vectors.orderBy(F.xxhash64(self.item), self.item).limit(PROBED).select(F.col(self.item).alias("query_id"), "embedding")
        queries = self._stored(probes)
        true = self._ranked(self._scan(self.table.read(), queries, points, len(points), NEIGHBOURS + 1), NEIGHBOURS + 1).filter(
            F.col("query_id") != F.col(self.item))
        # PROBED * NEIGHBOURS rows at most
        cells = dict(self.table.read().join(F.broadcast(true.select(self.item).distinct()), self.item, "left_semi").select(
            self.item, "cell").toPandas().itertuples(index=False, name=None))
        asked = {r.query_id: np.argsort(-(points @ np.array(r.embedding)), kind="stable") for r in queries.collect()}
        places = sorted(int(np.flatnonzero(asked[r.query_id] == cells[r[self.item]])[0]) + 1 for r in true.collect())
        return places[min(len(places) - 1, int(RECALL * len(places)))] if places else len(points)

    def _fine(self, vectors: DataFrame, width: int) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        fine = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
        return vectors.filter(F.coalesce(fine & F.col(self.item).isNotNull(), F.lit(False))).withColumn("embedding", v)

    def upsert(self, vectors: DataFrame) -> int:
        points, _ = self.centroids()
        rows = self._fine(vectors.select(self.item, "embedding"), points.shape[1]).groupBy(self.item).agg(F.max("embedding").alias("embedding"))
        shipped = self.spark.sparkContext.broadcast(points)
        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = (_matrix(batch.column("embedding")) @ shipped.value.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], schema.names)
        placed = rows.mapInArrow(place, schema).withColumn("deleted", F.lit(False))
        return self.table.write(placed.repartitionByRange("cell", self.item).sortWithinPartitions("cell"))

    def delete(self, ids: DataFrame) -> int | None:
        if ids.isEmpty():
            return None
        return self.table.write(ids.select(self.item).distinct().select(
            self.item, F.lit(None).cast("array<double>").alias("embedding"), F.lit(True).alias("deleted"), F.lit(-1).alias("cell")))

    # --- searching -----------------------------------------------------------------------

    def live(self) -> DataFrame:
        """All entries but those that a later batch replaces or drops."""
        rows = self.table.read()
        if len(self.table.versions()) > 1:
            entries = rows.select(self.item, "batch", "deleted")
            last = entries.groupBy(self.item).agg(F.max("batch").alias("last"))
            old = self._stored(entries.join(last, self.item).filter("batch < last").select(self.item, "batch").distinct())
            rows = rows.join(old, [self.item, "batch"], "left_anti")
        return rows.filter("NOT deleted")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, item, score, rank): the best items found for (query_id, embedding), by cosine of
        unit vectors, equal scores by item.  ``probes`` cells are read a query, by default as measured."""
        points, measured = self.centroids()
        asked = self._stored(self._fine_queries(queries, points.shape[1]))
        return self._ranked(self._scan(self.live(), asked, points, probes or measured, k), k)

    def _fine_queries(self, queries: DataFrame, width: int) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        fine = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
        return queries.select("query_id", v.alias("embedding")).filter(F.coalesce(fine, F.lit(False))).dropDuplicates(["query_id"])

    def _ranked(self, found: DataFrame, k: int) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(self.item))
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def _scan(self, rows: DataFrame, queries: DataFrame, points: np.ndarray, probes: int, k: int) -> DataFrame:
        kind, item = queries.schema["query_id"].dataType, self.item
        schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField(item, rows.schema[item].dataType), T.StructField("score", T.DoubleType())])
        parts = []
        for block in hash_blocks(queries, "query_id", PASS_QUERIES):
            own = block.toArrow().combine_chunks()  # PASS_QUERIES rows at most
            if not own.num_rows:
                continue
            asked = _matrix(own.column("embedding").combine_chunks())
            near = np.argsort(-(asked @ points.T), axis=1, kind="stable")[:, :probes]
            reads = np.zeros((len(asked), len(points)), bool)
            np.put_along_axis(reads, near, True, axis=1)
            cells = np.flatnonzero(reads.any(0)).tolist()
            shipped = self.spark.sparkContext.broadcast((asked, reads))
            hits = rows.filter(F.col("cell").isin(cells)).select(item, "embedding", "cell").mapInArrow(_nearest(shipped, k, item, schema), schema)
            ids = F.broadcast(self.spark.createDataFrame(list(enumerate(own.column("query_id").to_pylist())),
                                                         T.StructType([T.StructField("q", T.IntegerType()), T.StructField("query_id", kind)])))
            parts.append(hits.join(ids, "q").select("query_id", item, "score"))
        if not parts:
            return self.spark.createDataFrame([], T.StructType([T.StructField("query_id", kind), *schema.fields[1:]]))
        return functools.reduce(DataFrame.unionByName, parts)


def _nearest(shipped, k: int, item: str, schema: T.StructType):
    """Arrow function (item, embedding, cell) -> a task's k best items of each query that probes their cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, reads = shipped.value
        best = [Best(k) for _ in asked]
        kind = None
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                batch = batch.take(pc.sort_indices(batch, sort_keys=[("cell", "ascending"), (item, "ascending")]))
                kind, cells = batch.column(item).type, np.asarray(batch.column("cell"))
                cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
                for first, last in zip(cuts, cuts[1:], strict=False):
                    own = np.flatnonzero(reads[:, cells[first]])
                    if not len(own):
                        continue
                    scores = np.round(asked[own] @ _matrix(batch.column("embedding").slice(first, last - first)).T, 6)
                    floors = np.array([-best[q].rows[-1][0] if len(best[q].rows) == k else -np.inf for q in own])
                    for row in np.flatnonzero((scores >= floors[:, None]).any(1)).tolist():
                        order = np.argsort(-scores[row], kind="stable")[:k]  # rows are in item order
                        items = batch.column(item).take(pa.array(first + order)).to_pylist()
                        best[own[row]].add(list(zip((-scores[row, order]).tolist(), items, strict=True)))
        rows = [(q, i, -s) for q, found in enumerate(best) for s, i in found.rows]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), kind, pa.float64()), strict=True)], schema.names)
    return run
