"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.session import scratch_path

#: A key with more than this share of the rows is hot; at most 1000 keys can be.
HOT_SHARE = 1000


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (cuts lineage)."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that :func:`written` made and nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hash_blocks(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    """Rows of distinct keys by hash of the key, in blocks of at most ``most`` rows (counted)."""
    blocks = max(1, -(-df.count() // most))
    while True:
        block = F.pmod(F.xxhash64(key), F.lit(blocks))
        if (df.groupBy(block.alias("b")).count().agg(F.max("count")).first()[0] or 0) <= most:
            return [df.filter(block == b) for b in range(blocks)]
        blocks *= 2


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5 (null counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def join_by_key(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """Join ``left`` with the unique-key table ``right``; a hot key never lands in one task.

    ``right`` has a column ``copies`` (rows of ``left`` with that key).  Keys with more
    than a thousandth of the rows number fewer than a thousand, so they are broadcast;
    the others are shuffled and hold at most that share each.
    """
    limit = max(rows // HOT_SHARE, 1)
    hot = F.broadcast(right.filter(F.col("copies") > limit).drop("copies"))
    rest = right.filter(F.col("copies") <= limit).drop("copies")
    marked = left.join(F.broadcast(hot.select(key).withColumn("_hot", F.lit(True))), key, "left")
    return (marked.filter(F.col("_hot").isNotNull()).drop("_hot").join(hot, key)
            .unionByName(marked.filter(F.col("_hot").isNull()).drop("_hot").join(rest, key, how)))


def packed(values: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Split ``values`` by ``lengths`` and give each part's bytes."""
    raw, width = values.tobytes(), values.dtype.itemsize
    ends = np.cumsum(lengths) * width
    return [raw[e - n * width:e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def fresh(name: str) -> str:
    """A column name that no input column has."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
