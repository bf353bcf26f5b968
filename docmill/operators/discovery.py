"""Runs of an extractor that may fail or hang: attempts, time limits, resumption.

Every round is one Spark job over the chunks that are still open; its attempts are one
batch of the log, seen only once complete.  A run that is cut off goes on from the last
complete batch: what succeeded is not asked again, what failed has its attempts counted.
"""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.operators.embedding import message
from docmill.sources.index import VersionedTable

#: (text, attempt from 1) -> the found schema as text.
Extractor = Callable[[str, int], str]


class OutOfTime(Exception):
    pass


def _limited(call: Callable[[], str], seconds: float | None) -> str:
    """``call`` within a time limit (kept where the task runs in its process's main thread)."""
    if seconds is None or threading.current_thread() is not threading.main_thread():
        return call()

    def stop(*_):
        raise OutOfTime(f"longer than {seconds:g} s")
    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return call()
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def attempts(open_chunks: DataFrame, extract: Extractor, seconds: float | None) -> DataFrame:
    """(chunk_id, attempt, text) to (chunk_id, attempt, status, result, error)."""
    kind = open_chunks.schema["chunk_id"].dataType
    schema = T.StructType([T.StructField("chunk_id", kind), T.StructField("attempt", T.IntegerType()), T.StructField("status", T.StringType()),
                           T.StructField("result", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, results, errors = [], [], []
            for text, attempt in zip(batch.column("text").to_pylist(), batch.column("attempt").to_pylist(), strict=True):
                try:
                    results.append(_limited(lambda t=text, a=attempt: extract(t, a), seconds))
                    status.append("success")
                    errors.append(None)
                except OutOfTime as error:
                    status.append("timeout")
                    results.append(None)
                    errors.append(message(error))
                except Exception as error:  # the chunk's own failure
                    status.append("error")
                    results.append(None)
                    errors.append(message(error))
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("attempt"), *(pa.array(c, pa.string()) for c in (status, results, errors))],
                                             schema.names)
    return open_chunks.select("chunk_id", "attempt", "text").mapInArrow(run, schema)


def state(log: DataFrame) -> DataFrame:
    """(chunk_id, attempts, status, result, error) of the last attempt of each chunk; a success is final."""
    order = F.struct((F.col("status") == "success").cast("int"), "attempt", "batch")
    return log.groupBy("chunk_id").agg(F.max("attempt").alias("attempts"), F.max_by(F.struct("status", "result", "error"), order).alias("l")) \
        .select("chunk_id", "attempts", "l.*")


def pending(chunks: DataFrame, log: VersionedTable, most_attempts: int) -> DataFrame:
    """Chunks without a success that have attempts left, with the number of the next one."""
    if not log.exists():
        return chunks.withColumn("attempt", F.lit(1))
    known = state(log.read()).select("chunk_id", "attempts", "status")
    return chunks.join(known, "chunk_id", "left").filter(
        F.col("status").isNull() | ((F.col("status") != "success") & (F.col("attempts") < most_attempts))).withColumn(
        "attempt", F.coalesce(F.col("attempts") + 1, F.lit(1))).drop("attempts", "status")


def discover(chunks: DataFrame, log: VersionedTable, extract: Extractor, most_attempts: int = 3, seconds: float | None = None,
             rounds: int | None = None) -> DataFrame:
    """Run ``extract`` over (chunk_id, text) until every chunk succeeded or used up its attempts
    (or for at most ``rounds`` rounds); the state of all chunks, untried ones as ``pending``.

    A null text is a chunk like any other; of rows that repeat an id the greatest text counts.
    """
    chunks = chunks.groupBy("chunk_id").agg(F.max("text").alias("text"))
    for _ in range(most_attempts if rounds is None else rounds):
        still = pending(chunks, log, most_attempts)
        if still.isEmpty():
            break
        log.write(attempts(still, extract, seconds))
    none = F.lit(None).cast("string")
    if not log.exists():
        return chunks.select("chunk_id", F.lit(0).alias("attempts"), F.lit("pending").alias("status"), none.alias("result"), none.alias("error"))
    return chunks.select("chunk_id").join(state(log.read()), "chunk_id", "left").select(
        "chunk_id", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("status", F.lit("pending")).alias("status"), "result", "error")
