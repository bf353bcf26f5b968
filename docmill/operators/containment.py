"""Which of many patterns occur in which of many texts.

A join on containment has no key to shuffle by.  Here the texts stay where they are:
distinct patterns are shipped in passes of a checked size, every task builds one
automaton of a pass and reads each whole text once for all its patterns.  Only hits
leave the task, so neither (text, pattern) pairs nor pieces of texts are moved.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.session import scratch_path

#: Patterns and their characters in one pass (or one longer pattern): they bound what is
#: shipped and the automaton, whose nodes are at most the characters.
PATTERNS, PATTERN_CHARS = 1 << 16, 1 << 20


def contained(texts: DataFrame, patterns: DataFrame, text_id: str, text: str, pattern_id: str, pattern: str) -> DataFrame:
    """(text_id, pattern_id, n, first) of every pattern in every text that contains it.

    ``n`` counts occurrences, overlapping ones as well; ``first`` is the position of the
    first one, from 0, in characters.  Case and spacing count; fold both sides to search
    without them.  Null and empty patterns occur nowhere, null texts contain nothing;
    every row of a repeated text or pattern has its own results.
    """
    wanted = patterns.select(F.col(pattern_id).alias(pattern_id), F.col(pattern).alias("_pattern")).filter("_pattern <> ''")
    spark = texts.sparkSession
    path = scratch_path(spark, "patterns")
    wanted.write.parquet(path)
    wanted = spark.read.schema(wanted.schema).parquet(path)
    distinct = wanted.select("_pattern").distinct()
    schema = T.StructType([T.StructField(text_id, texts.schema[text_id].dataType), T.StructField("_pattern", T.StringType()),
                           T.StructField("n", T.LongType()), T.StructField("first", T.IntegerType())])
    rows = texts.select(text_id, text)
    parts = []
    for block in _passes(distinct):
        own = [r[0] for r in block.collect()]  # within PATTERNS and PATTERN_CHARS
        if own:
            parts.append(rows.mapInArrow(_scan(spark.sparkContext.broadcast(own), schema), schema))
    if not parts:
        parts = [spark.createDataFrame([], schema)]
    return functools.reduce(DataFrame.unionByName, parts).join(wanted, "_pattern").select(text_id, pattern_id, "n", "first")


def _passes(distinct: DataFrame) -> list[DataFrame]:
    """Patterns by hash in passes within the bounds (counted), or of a single pattern."""
    size = F.length("_pattern")
    total = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("c")).first()
    passes = max(1, -(-total.n // PATTERNS), -(-total.c // PATTERN_CHARS))
    while passes > 1:
        place = F.pmod(F.xxhash64("_pattern"), F.lit(passes))
        over = distinct.groupBy(place.alias("p")).agg(F.count("*").alias("n"), F.sum(size).alias("c")).filter(
            (F.col("n") > 1) & ((F.col("n") > PATTERNS) | (F.col("c") > PATTERN_CHARS)))
        if over.isEmpty():
            return [distinct.filter(place == p) for p in range(passes)]
        passes *= 2
    return [distinct]


def _scan(shipped, schema: T.StructType):
    """Arrow function (id, text) -> (id, pattern, n, first)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in shipped.value:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for batch in batches:
            at, words, counts, firsts = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found: dict[str, list[int]] = {}
                for end, word in automaton.iter(text or ""):
                    own = found.get(word)
                    if own is None:
                        found[word] = [1, end + 1 - len(word)]
                    else:
                        own[0] += 1
                at += [i] * len(found)
                words += found
                counts += [n for n, _ in found.values()]
                firsts += [p for _, p in found.values()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int32())],
                schema.names)
    return run
