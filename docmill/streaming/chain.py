"""The whole ingestion chain as a stream: decode, chunk, cache, embed, upsert, report.

Every arriving file ends in one result row.  A file that cannot be decoded, whose chunker
or embedder raises, or that has too many chunks is reported as failed and leaves the
other files of its batch, and what the index holds of it, as they were.  All writes of a
batch go under its own number, so a replayed batch overwrites itself: chunks, vectors and
results are the same after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docmill.operators.embedding import Embedder, cache_key, embedded, message
from docmill.sources.index import ChunkIndex, VersionedTable, source_key

Chunker = Callable[[str], Sequence[str]]

BINARY = "path string, modificationTime timestamp, length bigint, content binary"
#: Paths or keys (64 bytes each) that are shipped to where the texts lie.
MANY_PATHS = 1 << 16
CHUNKS = "cache_key string, chunk_index int, text string, error string"
RESULTS = ("source_path string, provider string, status string, chunk_count int, former_count int, "
           "total_chars bigint, least_chars int, most_chars int, cache_hit boolean, error string")


def file_stream(spark: SparkSession, root: str, pattern: str = "*.md", files_per_trigger: int = 100) -> DataFrame:
    """(source_path, provider, content) of files as they arrive, undecoded (Spark's file
    sources pass over files of no bytes)."""
    raw = (spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True)
           .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(root))
    rel = F.substring_index(F.url_decode("path"), "/" + root.strip("/") + "/", -1)
    return raw.select(rel.alias("source_path"), F.split(rel, "/")[0].alias("provider"), "content")


def chunked(texts: DataFrame, chunk: Chunker) -> DataFrame:
    """(cache_key, text) to chunk rows; a text whose chunker raises gives one row with the error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("cache_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    parts = list(chunk(text))
                    rows = [(key, i, part, None) for i, part in enumerate(parts)]
                except Exception as error:  # the file's own failure; anything else ends the task
                    rows = [(key, None, None, message(error))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)],
                        ["cache_key", "chunk_index", "text", "error"])
    return texts.select("cache_key", "text").mapInArrow(run, CHUNKS)


@dataclass
class IngestChain:
    """Where a chain keeps its tables and how it chunks and embeds."""

    spark: SparkSession
    root: str
    chunk: Chunker
    embed: Embedder
    chunk_config: dict[str, object] = field(default_factory=dict)
    model: str = "local"
    most_chunks: int | None = None

    def __post_init__(self):
        self.index = ChunkIndex(self.spark, f"{self.root}/chunks")
        self.cache = VersionedTable(self.spark, f"{self.root}/chunk-cache")
        self.vectors = VersionedTable(self.spark, f"{self.root}/vectors")
        self.log = VersionedTable(self.spark, f"{self.root}/results")

    def start(self, files: DataFrame, checkpoint: str | None = None) -> StreamingQuery:
        """Ingest (source_path, provider, content) rows as they arrive, then stop."""
        return (files.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint or f"{self.root}/checkpoint")
                .trigger(availableNow=True).start())

    def results(self) -> DataFrame:
        """The latest result of every file."""
        return self.log.read().groupBy("source_path").agg(F.max_by(F.struct("*"), "batch").alias("r")).select("r.*").drop("batch", "former_count")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One batch; the same number writes the same tables again.  Of several contents
        under one path the greatest counts.

        Texts are moved to be chunked, embedded and stored, once each; all else is joined on keys.
        """
        number = batch_id + 1
        again = batch.groupBy("source_path").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("source_path").alias("again")).persist()
        files = self._files(batch, again)
        keys = files.select("source_path", "provider", "cache_key", F.col("text").isNotNull().alias("read")).persist()
        try:
            self._chunks(files, number)
            self._vectors(keys, number)
            self._finish(keys, number)
        finally:
            keys.unpersist()
            again.unpersist()

    def _files(self, batch: DataFrame, again: DataFrame) -> DataFrame:
        """(source_path, provider, text, cache_key); contents are compared under the paths that come ``again``."""
        rows, several = batch.select("source_path", "provider", "content"), again.count()
        if several:
            again = F.broadcast(again) if several <= MANY_PATHS else again
            same = F.col("source_path").eqNullSafe(F.col("again"))
            most = rows.join(again, same, "left_semi").groupBy("source_path").agg(F.max(F.struct("content", "provider")).alias("f"))
            rows = rows.join(again, same, "left_anti").unionByName(most.select("source_path", "f.provider", "f.content"))
        content = F.col("content").cast("string")
        return rows.select("source_path", "provider", F.when(F.is_valid_utf8(content), content).alias("text")) \
            .withColumn("cache_key", source_key(self.chunk_config))

    def _chunks(self, files: DataFrame, number: int) -> None:
        """Chunk the texts that no former batch has chunked; equal texts once."""
        misses = files.filter("text IS NOT NULL").select("cache_key", "text").dropDuplicates(["cache_key"])
        if self.cache.exists(number):
            misses = misses.join(self.cache.read(number).filter("error IS NULL").select("cache_key").distinct(), "cache_key", "left_anti")
        self.cache.write(chunked(misses, self.chunk), number)

    def _cached(self, number: int) -> DataFrame:
        """The chunks that count for a batch, its own failures among them, under the keys of their vectors."""
        key = cache_key(F.col("text"), "chain", self.model, "document", "")
        return self.cache.read(number + 1).filter((F.col("batch") == number) | F.col("error").isNull()).withColumn("vector_key", key)

    def _vectors(self, keys: DataFrame, number: int) -> None:
        """Embed the chunk texts that no former batch has embedded; equal texts once."""
        chunks = self._cached(number).filter("text IS NOT NULL")
        wanted = chunks.filter(F.col("batch") == number).select("vector_key", "text")
        known = self.vectors.read(number).filter("error IS NULL").select("vector_key") if self.vectors.exists(number) else None
        if self.cache.exists(number):  # of former batches those whose vectors failed
            former = chunks.filter(F.col("batch") < number)
            lacking = former.join(keys.select("cache_key").distinct(), "cache_key", "left_semi").select("vector_key").distinct()
            lacking = (lacking if known is None else lacking.join(known, "vector_key", "left_anti")).persist()
            if count := lacking.count():
                asked = F.broadcast(lacking) if count <= MANY_PATHS else lacking
                wanted = wanted.unionByName(former.join(asked, "vector_key", "left_semi").select("vector_key", "text"))
        wanted = wanted.dropDuplicates(["vector_key"])
        if known is not None:
            wanted = wanted.join(known, "vector_key", "left_anti")
        self.vectors.write(embedded(wanted, self.embed), number)
        if self.cache.exists(number):
            lacking.unpersist()

    def _finish(self, keys: DataFrame, number: int) -> None:
        """Results, then the chunks of the completed files."""
        made = self.vectors.read(number + 1).filter((F.col("batch") == number) | F.col("error").isNull())
        size = F.length("text")
        sized = self._cached(number).select("cache_key", "vector_key", F.col("text").isNotNull().alias("chunk"), size.alias("chars"), "error", "batch")
        rows = keys.select("source_path", "cache_key").join(sized, "cache_key").join(
            made.select("vector_key", F.col("error").alias("vector_error")), "vector_key", "left")
        stats = rows.groupBy("source_path").agg(
            F.count_if("chunk").cast("int").alias("n"), F.sum("chars").alias("total_chars"), F.min("chars").alias("least_chars"), F.max("chars").alias("most_chars"),
            F.min("error").alias("chunk_error"), F.min("vector_error").alias("vector_error"), F.bool_and(F.col("batch") < number).alias("cache_hit"))
        n = F.coalesce("n", F.lit(0))
        too_many = F.when(n > self.most_chunks, F.concat(n.cast("string"), F.lit(f" chunks are more than {self.most_chunks}."))) \
            if self.most_chunks is not None else F.lit(None).cast("string")
        error = F.coalesce(F.when(~F.col("read"), F.lit("UnicodeError: not UTF-8")), "chunk_error", too_many, "vector_error")
        judged = keys.join(stats, "source_path", "left").withColumn("error", error)
        good = F.col("error").isNull()
        former = self.log.read(number).filter("status = 'completed'").groupBy("source_path").agg(F.max_by("chunk_count", "batch").alias("former_count")) \
            if self.log.exists(number) else self.spark.createDataFrame([], "source_path string, former_count int")
        self.log.write(judged.join(former, "source_path", "left").select(
            "source_path", "provider", F.when(good, "completed").otherwise("failed").alias("status"),
            F.when(good, n).otherwise(0).alias("chunk_count"), F.coalesce("former_count", F.lit(0)).alias("former_count"),
            *[F.when(good, F.col(c)).alias(c) for c in ("total_chars", "least_chars", "most_chars")],
            F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"), "error"), number)
        done = self.log.read(number + 1).filter((F.col("batch") == number) & (F.col("status") == "completed"))
        chunk_id = F.concat_ws(":", "source_path", F.col("chunk_index").cast("string"))
        # narrow rows find their owners and vectors before they meet the texts
        held = self._cached(number).filter("text IS NOT NULL")
        placed = keys.join(done.select("source_path"), "source_path", "left_semi").select("source_path", "provider", "cache_key") \
            .join(held.select("cache_key", "chunk_index", "vector_key"), "cache_key").join(made.select("vector_key", "embedding"), "vector_key", "left")
        chunks = held.select("cache_key", "chunk_index", "text").join(placed, ["cache_key", "chunk_index"]).select(
            chunk_id.alias("chunk_id"), F.coalesce("provider", F.lit("")).alias("company_code"), "source_path", "chunk_index", "text", "embedding")
        # chunks beyond the new end of a file that was longer before
        gone = done.filter("former_count > chunk_count").select(
            "source_path", F.explode(F.sequence("chunk_count", F.col("former_count") - 1)).alias("chunk_index")).select(chunk_id.alias("chunk_id"))
        self.index.upsert(chunks, gone=gone, version=number, distinct=True)
