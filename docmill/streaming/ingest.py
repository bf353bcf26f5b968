"""File-at-a-time ingestion as a streaming query with checkpointed progress.

Each trigger takes a bounded number of new files; a restarted query resumes
after the last committed batch.  Batches are written under their batch id, so a
replayed batch overwrites its own output and nothing is doubled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RESULTS = "source_path string, n_chars int, chunk_count bigint, status string"


def markdown_stream(spark: SparkSession, root: str, files_per_trigger: int = 100) -> DataFrame:
    """(source_path, provider, text) of Markdown files as they arrive."""
    raw = (spark.readStream.option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", files_per_trigger)
           .text(root, wholetext=True))
    path = F.col("_metadata.file_path")
    base = "/" + root.strip("/") + "/"
    rel = F.substring_index(F.url_decode(path), base, -1)
    return raw.select(rel.alias("source_path"), F.split(rel, "/")[0].alias("provider"),
                      F.col("value").alias("text"))


def ingest_stream(docs: DataFrame, chunk: Callable[[DataFrame], DataFrame], out: str,
                  checkpoint: str) -> StreamingQuery:
    """Chunk every arriving document and log one result row per file.

    An empty first batch gives the result table its schema, so that no input reads as
    no rows.
    """
    docs.sparkSession.createDataFrame([], RESULTS).write.mode("overwrite").parquet(
        f"{out}/results/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        chunks = chunk(batch)
        target = f"{out}/chunks/batch={batch_id}"
        chunks.write.mode("overwrite").parquet(target)
        written = batch.sparkSession.read.parquet(target).groupBy("source_path").agg(
            F.count("*").alias("chunk_count"))
        results = batch.select("source_path", F.length("text").alias("n_chars")).join(
            written, "source_path", "left").select(
            "source_path", "n_chars", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
            F.when(F.col("chunk_count") > 0, "success").otherwise("empty").alias("status"))
        results.write.mode("overwrite").parquet(f"{out}/results/batch={batch_id}")
    return (docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def remaining_work(items: DataFrame, done: DataFrame, signature: list[str]) -> DataFrame:
    """Items whose configuration signature has no finished record."""
    sign = F.sha2(F.to_json(F.struct(*signature)), 256)
    finished = done.filter("status = 'success'").select(sign.alias("_s")).distinct()
    return items.withColumn("_s", sign).join(finished, "_s", "left_anti").drop("_s")


def record_stream(spark: SparkSession, root: str, schema) -> DataFrame:
    """An append-only record log read as a stream of Parquet files."""
    return spark.readStream.schema(schema).parquet(root)
