"""Event-time streams: windows, sessions, duplicates and attributions under a watermark.

Rows may arrive out of order by up to the watermark's delay; later ones are dropped by the
operators that keep state, and state older than the watermark is given up.  Results are
appended once they are final, so a restarted query goes on from its checkpoint and
repeats nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def deal(rows: DataFrame, order: str, folder: str, files: int) -> None:
    """Write ``rows`` as so many files, one after the other by ranges of ``order`` (a time):
    a backfill or a rehearsal of arrivals for a file stream."""
    seconds = F.unix_micros(order)
    edges = rows.select(F.percentile_approx(seconds, [i / files for i in range(1, files)], 10000)).first()[0] or []
    place = sum((F.when(seconds > e, 1).otherwise(0) for e in edges), F.lit(0))
    for i in range(files):
        rows.filter(place == i).coalesce(1).write.mode("append").parquet(folder)


def arrivals(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, time: str, keys: Sequence[str], width: str, delay: str, value: str, slide: str | None = None) -> DataFrame:
    """Count and sum of ``value`` for every window (tumbling, or sliding by ``slide``) and key."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width, slide), *keys).agg(
        F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, keys: Sequence[str], gap: str, delay: str, value: str) -> DataFrame:
    """Sessions of each key: runs of events less than ``gap`` apart."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys).agg(
        F.count("*").alias("n"), F.sum(value).alias("total")).select(
        *keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n", "total")


def distinct_events(events: DataFrame, time: str, keys: Sequence[str], delay: str) -> DataFrame:
    """The first arrival of each key; repeats within the delay are dropped, state stays bounded by it."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def attributed(causes: DataFrame, effects: DataFrame, key: str, within: str, delay: str,
               cause_time: str = "cause_ts", effect_time: str = "effect_ts") -> DataFrame:
    """Every effect joined with the causes of its key at most ``within`` before it.

    Both sides are buffered no longer than watermark and interval demand.  The sides share
    no column but ``key``.
    """
    left, right = causes.withWatermark(cause_time, delay).alias("c"), effects.withWatermark(effect_time, delay).alias("e")
    near = (F.col(f"c.{key}") == F.col(f"e.{key}")) & (F.col(effect_time) >= F.col(cause_time)) & (
        F.col(effect_time) <= F.col(cause_time) + F.expr(f"INTERVAL {within}"))
    return left.join(right, near).drop(F.col(f"e.{key}"))


def appended(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that has arrived, appending to Parquet; the rows of ``out``."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
