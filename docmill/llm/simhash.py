"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits lie on a ring of five segments.  If two fingerprints differ in
at most four bits, some segment starts a chain whose first l segments together differ
in at most floor(4 l / 5) bits for every l.  The first two links of the chain are
looked up: the first segment is equal, the second differs in at most one bit.  Each
distinct fingerprint is filed under its segment and the next one with one bit masked,
for every bit; fingerprints that meet under a key are checked along the rest of the
chain and then in full.  Groups that meet are linked to the smallest fingerprint they
reach, never pair by pair, and components follow over those links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import HOT_SHARE, utf8, written
from docmill.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: (first bit, bits) of the ring's five segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: bytes) -> int:
    """The SimHash of the word shingles of a text, repeats included; 0 for no words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        whole = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, n) + 1
        ends = np.cumsum(lengths) - 1
        starts = ends - lengths + 1
        shingles = [whole[a:b] for a, b in zip(starts[:n - SHINGLE + 1].tolist(), ends[SHINGLE - 1:].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_hash of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.fromiter(map(fingerprint, utf8(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.view(np.int64)), batch.column("text_hash")],
                                             ["doc_id", "fp", "text_hash"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
            .mapInArrow(run, "doc_id long, fp long, text_hash long"))


def _segment(values: np.ndarray, k: int) -> np.ndarray:
    first, bits = SEGMENTS[k % len(SEGMENTS)]
    return values >> np.uint64(first) & np.uint64((1 << bits) - 1)


def filed(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, fingerprint) of every chain start and masked bit of the next segment."""
    for k in range(len(SEGMENTS)):
        own, after = _segment(values, k), _segment(values, k + 1)
        for bit in range(SEGMENTS[(k + 1) % len(SEGMENTS)][1]):
            rest = after & ~np.uint64(1 << bit)
            yield (np.uint64((k << 4 | bit) << 32) | own << np.uint64(16) | rest).astype(np.int64), values


def chained(a: np.ndarray, b: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Whether the chain that starts at segment k keeps within its proportional budgets."""
    differ = a ^ b
    counts = np.stack([np.bitwise_count(_segment(differ, s)) for s in range(len(SEGMENTS))])
    spent, fine = np.zeros(len(differ), np.uint8), np.ones(len(differ), bool)
    for step in range(len(SEGMENTS)):
        spent = spent + np.take_along_axis(counts, np.broadcast_to((k + step) % len(SEGMENTS), (1, len(differ))), 0)[0]
        fine &= spent <= (step + 1) * DISTANCE // len(SEGMENTS)
    return fine


def within(a: np.ndarray, b: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Positions of the pairs that pass the chain filter and then the full check."""
    at = np.flatnonzero(chained(a, b, k))
    differ = (a ^ b)[at]
    return at[np.bitwise_count(differ) <= DISTANCE]


def link_group(values: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Links from every fingerprint of a group to the smallest one of its component in the group.

    A search from each unvisited fingerprint takes its partners out of the rest, so a
    dense group costs a few passes and gives one link a member.
    """
    rest, links = np.sort(values), []
    while len(rest) > 1:
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            at = within(rest, np.full(1, queue.pop()), k)
            if len(at):
                queue += list(rest[at])
                links += [(int(v), int(root)) for v in rest[at]]
                rest = np.delete(rest, at)
    return links


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal keys of a sorted partition; holds one run at a time."""
    left_key, left = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(keys))
        own: list[tuple[int, int]] = []
        pair = np.flatnonzero(ends - starts == 2)  # most groups: checked all at once
        a, b = values[starts[pair]], values[starts[pair] + 1]
        at = within(a, b, keys[starts[pair]] >> 36)
        own += zip(np.maximum(a, b)[at].tolist(), np.minimum(a, b)[at].tolist(), strict=True)
        for g in np.flatnonzero(ends - starts > 2).tolist():
            own += link_group(values[starts[g]:ends[g]], int(keys[starts[g]] >> 36))
        if own:
            found = np.array(own, np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([left_key, batch.column("key").to_numpy()])
        values = np.concatenate([left, batch.column("fp").to_numpy().view(np.uint64)])
        last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        yield from links(keys[:last], values[:last]) if last else ()
        left_key, left = keys[last:], values[last:]
    if len(left):
        yield from links(left_key, left)


def links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect all within four bits."""
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in filed(batch.column("fp").to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value.view(np.int64))], ["key", "fp"])

    return (prints.select("fp").mapInArrow(file, "key long, fp long").repartition("key")
            .sortWithinPartitions("key").mapInArrow(_link, "a long, b long").distinct())


def _placed(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) and other columns -> also the component, a fingerprint that all of it share."""
    prints = written(prints, "simhash-prints")
    found = components(links(prints)).withColumnRenamed("node", "fp")
    return written(prints.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-placed")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row.

    A null or empty text has fingerprint 0 and links like any other; a null doc_id is
    never the smallest (a component of such rows alone has a null id).  Repeated rows
    each give a row; other columns are ignored.
    """
    rows = written(fingerprints(docs), "simhash")
    placed = _placed(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "copies", "component").join(smallest, "component").drop("component")
    n = rows.count()
    limit = max(n // HOT_SHARE, 1)  # at most a thousand fingerprints have more copies
    hot = F.broadcast(named.filter(F.col("copies") > limit).select("fp", F.col("component_id").alias("_hot_id"), F.lit(True).alias("_hot")))
    marked = rows.join(hot, "fp", "left")
    return (marked.filter(F.col("_hot").isNotNull()).select("doc_id", "fp", F.col("_hot_id").alias("component_id"))
            .unionByName(marked.filter(F.col("_hot").isNull()).select("doc_id", "fp")
                         .join(named.filter(F.col("copies") <= limit).drop("copies"), "fp").select("doc_id", "fp", "component_id")))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, that of its smallest document.

    A row without doc_id stays only if its component has no numbered document; among
    rows of one id the smallest hash of the text decides."""
    first = F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", "text_hash")
    least = fingerprints(docs).groupBy("fp").agg(F.min(first).alias("first"))
    chosen = (_placed(least).groupBy("component").agg(F.min("first").alias("first"))
              .select(F.coalesce(F.col("first.doc_id").cast("string"), F.lit("")).alias("_key"), F.col("first.text_hash").alias("_hash")))
    own = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    kept = docs.withColumn("_key", own).withColumn("_hash", F.xxhash64("text")).join(chosen, ["_key", "_hash"], "left_semi")
    # repeated rows share their id and text; one of them stays
    one = Window.partitionBy("_key", "_hash").orderBy(F.xxhash64(*docs.columns))
    return kept.withColumn("_nth", F.row_number().over(one)).filter("_nth = 1").select(*docs.columns)
