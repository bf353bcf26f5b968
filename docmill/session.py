"""Session construction and access to the input tables."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def build_session(app: str = "docmill", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Build a session; on a cluster the master and sizes come from the submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = (builder.master(master)
                   .config("spark.ui.enabled", "false")
                   .config("docmill.spread", re.sub(r"\D", "", master) or "8")
                   .config("spark.driver.memory", "12g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a scan to as many partitions as ``docmill.spread`` says, if it is set.

    A large table has splits enough and the setting stays unset; a session over a few
    small files sets it, because one row group cannot be split.
    """
    parts = df.sparkSession.conf.get("docmill.spread", None)
    return df.repartition(int(parts)) if parts else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows by hash of a distinct key to all cores, for work that costs more than a shuffle.

    A scan of a table of few bytes is a task or two, however many rows it holds.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def hash_blocks(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    """Rows of distinct keys by hash of the key, in blocks of at most ``most`` rows (counted)."""
    from pyspark.sql import functions as F

    blocks = max(1, -(-df.count() // most))
    while blocks > 1:
        block = F.pmod(F.xxhash64(key), F.lit(blocks))
        if (df.groupBy(block.alias("b")).count().agg(F.max("count")).first()[0] or 0) <= most:
            return [df.filter(block == b) for b in range(blocks)]
        blocks *= 2
    return [df]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        named = tempfile.mkdtemp(prefix="docmill-ckpt-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is run inside gives up its shuffle files when it ends, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, written to scratch and read again."""
    path = scratch_path(df.sparkSession, label)
    with swept(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared checkpoint folder for a written table."""
    import uuid

    return os.path.join(checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")
