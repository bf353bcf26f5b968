"""Byte-balanced sharding by Karmarkar-Karp differencing.

Rows with equal texts form an indivisible group.  A partial partition is a tuple of
shard sums; the two tuples of largest spread are combined again and again, the largest
sums of one meeting the smallest of the other.  Spark cuts the groups into blocks by
their hash, each block is differenced in one task, and the blocks' own tuples are
differenced in the same way, level by level, so that no task sees more than a block.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import join_by_key, written

#: Groups that one task differences, tuples that one task combines on a later level,
#: and rows that share one run of slot numbers.
BLOCK_GROUPS, BLOCK_TUPLES, SLOT_ROWS = 1 << 16, 1 << 10, 1 << 12


def difference(tuples: list[np.ndarray], k: int) -> np.ndarray:
    """For each partial partition (sums of k parts) the final part of each of its parts."""
    orders = [np.argsort(-t, kind="stable") for t in tuples]
    live = {i: t[o] for i, (t, o) in enumerate(zip(tuples, orders, strict=True))}
    heap = [(float(s[-1] - s[0]), i) for i, s in live.items()]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        sums = live.pop(a) + live.pop(b)[::-1]
        order = np.argsort(-sums, kind="stable")
        live[node := len(tuples) + len(merges)] = sums = sums[order]
        merges.append((a, b, order.astype(np.int16)))
        heapq.heappush(heap, (float(sums[-1] - sums[0]), node))
    final = np.empty((len(tuples), k), np.int32)
    places = {heap[0][1]: np.arange(k)} if heap else {}
    for node in range(len(tuples) + len(merges) - 1, -1, -1):
        place = places.pop(node)
        if node < len(tuples):
            final[node, orders[node]] = place
        else:
            a, b, order = merges[node - len(tuples)]
            own = np.empty(k, place.dtype)
            own[order] = place
            places[a], places[b] = own, own[::-1]
    return final


def _difference_groups(k: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bytes", "key"], ascending=[False, True], ignore_index=True)
        first = np.zeros((len(part), k))
        first[:, 0] = part["bytes"]
        return part.assign(part=difference(list(first), k)[:, 0])[["key", "copies", "bytes", "block", "part"]]
    return run


def _difference_blocks(k: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block", ignore_index=True)
        own = difference([np.array(s, float) for s in part["sums"]], k)
        return pd.DataFrame({"block": np.repeat(part["block"].to_numpy(), k), "part": np.tile(np.arange(k), len(part)),
                             "up": np.repeat(part["up"].to_numpy(), k), "up_part": own.ravel()})
    return run


def assign_groups(groups: DataFrame, shards: int, n_groups: int) -> DataFrame:
    """(key, copies, bytes) with one row per group -> (key, copies, shard)."""
    blocks = max(1, math.ceil(n_groups / BLOCK_GROUPS))
    dealt = written(groups.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
                    .groupBy("block").applyInPandas(
                        _difference_groups(shards), "key binary, copies long, bytes long, block long, part int"), "shard-groups")
    places, level = dealt, blocks
    while level > 1:
        above = math.ceil(level / BLOCK_TUPLES)
        sums = (places.groupBy("block", "part").agg(F.sum("bytes").alias("bytes"))
                .groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("part", "bytes"))).alias("m"))
                .select("block", (F.col("block") % above).alias("up"),
                        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)),
                                    lambda p: F.coalesce(F.col("m")[p], F.lit(0)).cast("double")).alias("sums")))
        moves = written(sums.groupBy("up").applyInPandas(
            _difference_blocks(shards), "block long, part int, up long, up_part int"), "shard-moves")
        places = places.join(moves, ["block", "part"]).select(
            "key", "copies", "bytes", F.col("up").alias("block"), F.col("up_part").alias("part"))
        level = above
    return places.select("key", "copies", F.col("part").alias("shard"))


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Put every row into one of ``shards`` shards of near-equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text and ``overhead``), text_crc32, law
    (``bytes``), shard, slot (gapless from 0 within the shard, in an order that is fixed
    by the rows) and grown_shard (null under this law).  Equal texts share a shard;
    a null text counts as empty.  Repeated rows each get a slot of their own; an empty
    table gives no rows; other columns are ignored.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + overhead).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("key")), "shard-rows")
    groups = rows.groupBy("key").agg(F.count("*").alias("copies"), F.sum("size").alias("bytes"))
    counts = groups.agg(F.count("*").alias("g"), F.sum("copies").alias("n")).first()
    n = counts.n or 0
    placed = written(join_by_key(rows, assign_groups(groups, shards, counts.g), "key", n).drop("key").withColumn(
        "run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(1, math.ceil(n / SLOT_ROWS))))), "shard-placed")
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "run").agg(F.count("*").alias("m")).select(
        "shard", "run", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32")
    return (placed.withColumn("nth", F.row_number().over(within)).join(starts, ["shard", "run"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("start") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
