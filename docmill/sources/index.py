"""Chunk index and caches kept as Parquet tables in shared storage.

A table is a folder of numbered batches; a write adds its own batch and touches no
other, and readers see a batch only once it is complete, so a lost executor never
leaves a half-written one.  ``compact`` folds all batches into one.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.text import point_id, search_text
from docmill.operators import postings
from docmill.operators.embedding import unpacked
from docmill.operators.evaluation import latest_per_key
from docmill.session import scratch_path, swept


#: The filter fields beside the company, in the order in which a batch is sorted.
INDEXED = ("document_type", "product_line", "plan_code", "section_type", "document_id")


class VersionedTable:
    """Parquet table of batches; every write adds the next one, and keeps no shuffle files of its making."""

    def __init__(self, spark: SparkSession, root: str, partition_by: Sequence[str] = (), options: dict[str, object] | None = None):
        self.spark, self.root, self.partition_by = spark, root.rstrip("/"), list(partition_by)
        self.options = {"compression": "zstd"} | dict(options or {})

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Batches with a success marker, oldest first."""
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        names = [(s.getPath(), s.getPath().getName()) for s in fs.listStatus(path)]
        done = [int(n[6:]) for p, n in names if n.startswith("batch=") and n[6:].isdigit()
                and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(done)

    def _path(self, version: int) -> str:
        return f"{self.root}/batch={version:08d}"

    def exists(self, below: int | None = None) -> bool:
        return bool(self._before(below))

    def _before(self, below: int | None) -> list[int]:
        return [v for v in self.versions() if below is None or v < below]

    def read(self, below: int | None = None, packed: bool = False) -> DataFrame:
        """The rows of all complete batches (numbered less than ``below``) with their
        ``batch``, as one scan; an absent column is NULL.  Vectors stay ``packed`` if asked for."""
        shown = (lambda df: df) if packed else unpacked
        fs, _ = self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        versions = self._before(below)
        # a batch without rows has no part files where it is partitioned
        paths = [p for p in map(self._path, versions)
                 if any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(path(p)))]
        if not paths:
            stream = fs.open(path(f"{self.root}/_schema/{versions[-1]:08d}"))
            try:
                schema = T.StructType.fromJson(json.loads(stream.readUTF()))
            finally:
                stream.close()
            return shown(self.spark.createDataFrame([], schema.add("batch", T.IntegerType())))
        return shown(self.spark.read.option("basePath", self.root).option("mergeSchema", len(paths) > 1).parquet(*paths))

    def write(self, df: DataFrame, version: int | None = None) -> int:
        """Write the next batch, or ``version`` again."""
        version = (self.versions() or [0])[-1] + 1 if version is None else version
        fs, _ = self._fs()
        stream = fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_schema/{version:08d}"), True)
        stream.writeUTF(df.schema.json())
        stream.close()
        writer = df.write.mode("overwrite").options(**self.options)
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        with swept(df.sparkSession):
            writer.parquet(self._path(version))
        return version

    def compact(self, rows: DataFrame) -> int:
        """Put ``rows``, which stand for all that is stored, into a new batch and drop the others.

        Whoever reads between the two steps sees both and, by its own rule for the latest
        batch, the same rows.  No reader may still be at work on the former batches.
        """
        before = self.versions()
        version = self.write(rows)
        fs, _ = self._fs()
        for old in before:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(old)), True)
        return version

    def ensure(self, empty: DataFrame) -> None:
        if not self.exists():
            self.write(empty)


class ChunkIndex:
    """Chunks keyed by a stable numeric id, partitioned by company for hard filters.

    An upsert or a deletion writes its own rows only; a reader takes the latest batch of
    every id, and ids whose latest row is a deletion are gone.  The other filter fields
    are indexed by the files themselves: rows lie sorted by them, and Bloom filters of
    their values let a scan pass over row groups that cannot match.
    """

    def __init__(self, spark: SparkSession, root: str, options: dict[str, object] | None = None):
        blooms = {f"parquet.bloom.filter.enabled#{f}": "true" for f in INDEXED}
        self.table = VersionedTable(spark, root, ["company_code"], blooms | (options or {}))

    def upsert(self, chunks: DataFrame, order: str = "ingested_at", gone: DataFrame | None = None,
               version: int | None = None, distinct: bool = False) -> int:
        """Add chunks; an existing id is replaced.  The search text is the ASCII form.

        ``gone`` has chunk ids that the same batch drops; a given ``version`` is written again.
        Where ids are ``distinct`` no row is moved to find the latest of an id.
        """
        rows = chunks.withColumns({"point_id": point_id(F.col("chunk_id")), "deleted": F.lit(False),
                                   "search_text": search_text(F.col("text"))})
        if order not in rows.columns:
            rows = rows.withColumn(order, F.lit(1))
        if not distinct:
            rows = latest_per_key(rows, ["point_id"], [order])
        if gone is not None:
            rows = rows.unionByName(self._deletions(gone), allowMissingColumns=True)
        order = [f for f in ("company_code", *INDEXED) if f in rows.columns]
        return self.table.write(rows.sortWithinPartitions(*order), version)

    def delete(self, ids: DataFrame) -> int | None:
        """Drop chunk ids; nothing is written when there are none."""
        if ids.isEmpty():
            return None
        return self.table.write(self._deletions(ids))

    @staticmethod
    def _deletions(ids: DataFrame) -> DataFrame:
        return ids.select("chunk_id").distinct().select(
            "chunk_id", point_id(F.col("chunk_id")).alias("point_id"), F.lit(True).alias("deleted"),
            F.lit("").alias("company_code"))

    def read(self) -> DataFrame:
        rows = self.table.read()
        last = rows.groupBy("point_id").agg(F.max(F.struct("batch", "deleted")).alias("l")) \
            .filter("NOT l.deleted").select("point_id", F.col("l.batch").alias("batch"))
        return rows.join(last, ["point_id", "batch"], "left_semi").drop("batch", "deleted")

    def compact(self) -> int:
        return self.table.compact(self.read().withColumn("deleted", F.lit(False)))


class KeywordIndex:
    """Inverted index of posting blocks kept beside the chunks, with upserts and deletions.

    A write inverts its own chunks only.  Folders by hash of the term keep other terms'
    postings unread; within a folder rows are sorted by term.  The latest entry of an item
    counts: earlier ones are listed as dead, shard by shard, when the index is searched,
    and ``compact`` rebuilds the batches without them.
    """

    def __init__(self, spark: SparkSession, root: str, item: str = "chunk_id", text: str = "text"):
        self.spark, self.item, self.text = spark, item, text
        self.table = VersionedTable(spark, root, ["bucket"])

    def upsert(self, chunks: DataFrame) -> int:
        """Add chunks; an existing item is replaced.  One of several chunks under an item stays."""
        rows = postings.posting_blocks(chunks, self.item, self.text).withColumn("deleted", F.lit(False))
        return self._write(rows)

    def delete(self, ids: DataFrame) -> int | None:
        """Drop items; nothing is written when there are none."""
        if ids.isEmpty():
            return None
        kind = ids.schema[self.item].dataType
        empty = self.spark.createDataFrame([], postings.block_schema(kind))
        # lists of a bounded size
        shard = F.pmod(F.xxhash64(self.item), F.lit(-(-ids.count() // postings.SHARD_DOCS))).alias("shard")
        listed = ids.groupBy(shard).agg(F.collect_set(self.item).alias("items"))
        return self._write(empty.unionByName(listed, allowMissingColumns=True).withColumn("deleted", F.lit(True)))

    def _write(self, rows: DataFrame) -> int:
        return self.table.write(postings.by_folder(rows))

    def dead(self, rows: DataFrame) -> DataFrame:
        """(batch, shard, ords) of entries that a later entry or a deletion of their item replaces."""
        entries = rows.filter(F.col("bucket") == -1).select("batch", "shard", "deleted", F.posexplode("items").alias("ord", "item"))
        last = entries.groupBy("item").agg(F.max(F.struct("batch", "shard", "ord")).alias("last"))
        dead = (entries.filter("NOT deleted").join(last, "item").filter(F.struct("batch", "shard", "ord") != F.col("last"))
                .groupBy("batch", "shard").agg(F.sort_array(F.collect_list("ord")).alias("ords")))
        stored = scratch_path(self.spark, "dead")
        dead.write.parquet(stored)
        return self.spark.read.schema(dead.schema).parquet(stored)

    def search(self, queries: DataFrame, k: int = 10, **options) -> DataFrame:
        """(query_id, item, score, matched, rank) of (query_id, query); options as of BM25."""
        rows = self.table.read()
        found = postings.search_blocks(rows.filter("NOT deleted").drop("deleted"), queries, k, item=self.item, dead=self.dead(rows), **options)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(self.item))
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def compact(self, chunks: DataFrame) -> int:
        """Rebuild the index of ``chunks``, all chunks as they are now, and drop former batches."""
        rows = postings.posting_blocks(chunks, self.item, self.text).withColumn("deleted", F.lit(False))
        return self.table.compact(postings.by_folder(rows))


def source_key(config: dict[str, object], text: str = "text"):
    """Cache key of a document under a chunking configuration."""
    settings = ",".join(f"{k}={config[k]}" for k in sorted(config))
    return F.sha2(F.concat_ws("\x1f", F.lit(settings), F.sha2(text, 256)), 256)


def chunk_with_cache(docs: DataFrame, cache: VersionedTable, config: dict[str, object],
                     chunk) -> DataFrame:
    """Chunks of all documents; only texts without a valid cached entry are chunked.

    Equal texts share an entry: one of their documents is chunked and each gets the
    chunks under its own id.
    """
    keyed = docs.withColumn("cache_key", source_key(config))
    misses = keyed
    if cache.exists():
        known = cache.read().select("cache_key").distinct()
        misses = keyed.join(known, "cache_key", "left_anti")
    first = misses.groupBy("cache_key").agg(F.min("doc_id").alias("doc_id"))
    misses = misses.join(first, ["cache_key", "doc_id"], "left_semi")
    if not cache.exists() or not misses.isEmpty():
        cache.write(chunk(misses))
    found = cache.read().drop("batch", "doc_id")
    return found.join(keyed.select("cache_key", "doc_id"), "cache_key")
