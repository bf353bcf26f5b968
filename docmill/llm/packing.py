"""Best-fit packing of documents into training sequences under conflicts.

Open bins are ordered by what is left in them and carry a bitmap of their sources and
one of their duplicate clusters.  A piece goes to the tightest bin that still holds it
and has neither its source nor its cluster; the search runs from the first bin that is
large enough through its successors until one is compatible, else a bin is opened.
Documents are dealt to blocks by a hash of their id; a block is packed in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a sequence, and pieces that one task packs.
CAPACITY, BLOCK_PIECES = 2048, 1 << 14
#: Bins looked at first; the successor search widens by this factor.
SEARCH, WIDEN = 64, 4


class Bins:
    def __init__(self, most: int, capacity: int, sources: int, clusters: int):
        self.capacity, self.n, self.opened = capacity, 0, 0
        self.left, self.ids = np.zeros(most, np.int64), np.zeros(most, np.int64)  # open bins by what is left
        self.sources = np.zeros((most, sources // 64 + 1), np.uint64)
        self.clusters = np.zeros((most, clusters // 64 + 1), np.uint64)

    def _insert(self, left: int, bin_: int) -> None:
        at = int(np.searchsorted(self.left[:self.n], left, "right"))
        for a, value in ((self.left, left), (self.ids, bin_)):
            a[at + 1:self.n + 1] = a[at:self.n].copy()
            a[at] = value
        self.n += 1

    def _remove(self, at: int) -> None:
        for a in (self.left, self.ids):
            a[at:self.n - 1] = a[at + 1:self.n].copy()
        self.n -= 1

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a piece; a cluster of -1 conflicts with nothing."""
        s_word, s_bit = source // 64, np.uint64(1 << source % 64)
        c_word, c_bit = max(cluster, 0) // 64, np.uint64(0 if cluster < 0 else 1 << cluster % 64)
        at, width = int(np.searchsorted(self.left[:self.n], size)), SEARCH
        while at < self.n:
            ids = self.ids[at:min(at + width, self.n)]
            fits = np.flatnonzero((self.sources[ids, s_word] & s_bit | self.clusters[ids, c_word] & c_bit) == 0)
            if len(fits):
                at += int(fits[0])
                bin_, left = int(self.ids[at]), int(self.left[at])
                self._remove(at)
                break
            at, width = at + len(ids), width * WIDEN
        else:
            bin_, left = self.opened, self.capacity
            self.opened += 1
        self.sources[bin_, s_word] |= s_bit
        self.clusters[bin_, c_word] |= c_bit
        if left > size:
            self._insert(left - size, bin_)
        return bin_, self.capacity - left


def pack_block(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece, which come in the order in which they are placed.

    ``sources`` and ``clusters`` are small numbers; a cluster of -1 conflicts with nothing.
    """
    bins = Bins(len(sizes) + 1, capacity, int(sources.max(initial=0)), int(clusters.max(initial=0)))
    placed = [bins.place(*piece) for piece in zip(sizes.tolist(), sources.tolist(), clusters.tolist(), strict=True)]
    out = np.array(placed, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _pack(capacity: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_words", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], ignore_index=True)
        sources = pd.factorize(part["source"], use_na_sentinel=False)[0]
        many = part.groupby("cluster")["cluster"].transform("size").to_numpy() > 1
        clusters = np.full(len(part), -1)
        clusters[many] = pd.factorize(part["cluster"][many])[0]
        bins, offsets = pack_block(part["n_words"].to_numpy(), sources, clusters, capacity)
        return part.assign(bin=part["block"] * (1 << 32) + bins, offset=offsets)[
            ["doc_id", "piece", "first_word", "n_words", "source", "bin", "offset"]]
    return run


def text_cluster(text) -> F.Column:
    """Duplicate cluster of a text: equal words, whatever their case and spacing."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))), 256)


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: F.Column | None = None) -> DataFrame:
    """Pack every document: doc_id, piece, first_word, n_words, source, bin, offset.

    A document of more than ``capacity`` words is cut into full pieces and a rest, so no
    word is lost.  A document without words (or without text) has nothing to pack: one
    row with 0 words and no bin.  A null source is a source of its own.  ``cluster``
    defaults to equal words.  Repeated rows are packed once each, in different bins.
    """
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("words"),
                       (text_cluster(F.col("text")) if cluster is None else cluster.cast("string")).alias("cluster"))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0)).cast("int"))))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_word"),
                           F.least(F.col("words") - F.col("piece").cast("long") * capacity, F.lit(capacity).cast("long")).alias("n_words"),
                           "source", "cluster")
    full = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, math.ceil((full.n + (full.b or 0) / (2 * capacity)) / BLOCK_PIECES))  # a word and its space take two bytes at least
    block = F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(blocks))
    packed = pieces.filter("n_words > 0").withColumn("block", block).groupBy("block").applyInPandas(
        _pack(capacity), "doc_id long, piece int, first_word long, n_words long, source string, bin long, offset long")
    return packed.unionByName(pieces.filter("n_words = 0").drop("cluster").withColumns(
        {"bin": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")}))
