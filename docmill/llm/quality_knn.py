"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of terms: hashed byte trigrams with logarithmic counts, weighted by
inverse document frequencies that are counted over all documents, and terms for its
shape (how many of its words are distinct, how its letters and signs are mixed).  A truncated singular value
decomposition of labelled texts gives the latent space.  The labelled vectors are
broadcast; each document's exact cosine with every one of them is computed in blocks,
and its nearest neighbours vote with their similarities.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import fold_of, utf8

#: Hash buckets, latent dimensions, neighbours that vote, and documents per block.
BUCKETS, DIMENSIONS, NEIGHBOURS, BLOCK = 1 << 11, 48, 25, 256
#: Steps of the iteration that finds the latent space.
POWERS = 12
#: At most so many labelled rows of each class fit the classifier (documented bound of the model).
PER_CLASS = 1500
#: Limits of the shape terms' bins, and the weight of a shape term beside a unit vector of trigrams.
SHAPES = ((0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8), (0.02, 0.05, 0.1, 0.2, 0.5), (0.02, 0.05, 0.1, 0.2), (0.05, 0.1, 0.3, 0.6))
SHAPE_WEIGHT = 0.5
TERMS = BUCKETS + sum(len(limits) + 1 for limits in SHAPES)
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'")
UPPER = bytes(range(65, 91))
#: Similarities are raised to this power before they vote.
SHARPNESS = 8
ACCEPT = 0.3


def bag(data: bytes) -> np.ndarray:
    """Logarithmic counts of the hashed byte trigrams of a text, and its shape terms."""
    out = np.zeros(TERMS, np.float32)
    codes, words = np.frombuffer(data, np.uint8).astype(np.uint32), data.split()
    if len(codes) < 3 or not words:
        return out
    trigrams = codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]
    trigrams *= np.uint32(2654435761)
    out[:BUCKETS] = np.log1p(np.bincount(trigrams >> np.uint32(21), minlength=BUCKETS))
    n, size = len(words), len(data)
    shares = (len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
              (size - len(data.translate(None, SIGNS))) / size, (size - len(data.translate(None, UPPER))) / size)
    at = BUCKETS
    for share, limits in zip(shares, SHAPES, strict=True):
        out[at + bisect_right(limits, share)] = 1
        at += len(limits) + 1
    return out


def normed(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def weighted(bags: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Unit vectors of bags of terms, made a block at a time."""
    out = np.empty(bags.shape, np.float32)
    for at in range(0, len(bags), BLOCK):
        part = bags[at:at + BLOCK].astype(np.float32)
        out[at:at + BLOCK] = normed(np.concatenate([normed(part[:, :BUCKETS] * weights), part[:, BUCKETS:] * np.float32(SHAPE_WEIGHT)], axis=1))
    return out


def leading_axes(rows: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` leading right singular vectors, by subspace iteration from a fixed start:
    the driver never holds a square matrix of all terms."""
    wide = min(k + 16, *rows.shape)
    base = np.random.default_rng(0).standard_normal((rows.shape[1], wide)).astype(np.float32)
    for _ in range(POWERS):
        base = np.linalg.qr(rows.T @ (rows @ base))[0]
    turn = np.linalg.svd(rows @ base, full_matrices=False)[2]
    return (base @ turn.T)[:, :k]


def bucket_frequencies(docs: DataFrame) -> np.ndarray:
    """Documents in which each bucket occurs, and at the end all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for data in utf8(batch.column("text")):
                counts[:-1] += bag(data)[:BUCKETS] > 0
                counts[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(counts)], ["bucket", "n"])

    total = np.zeros(BUCKETS + 1)
    for row in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n  # a row for each bucket, whatever the corpus
    return total


class Model:
    """The latent space and the labelled vectors in it."""

    def __init__(self, weights: np.ndarray, axes: np.ndarray, vectors: np.ndarray, votes: np.ndarray, prior: float):
        self.weights, self.axes, self.vectors, self.votes, self.prior = weights, axes, vectors, votes, prior

    @classmethod
    def fit(cls, bags: np.ndarray, labels: np.ndarray, frequencies: np.ndarray, prior: float) -> Model:
        """``prior`` is the share of label 1 among all training rows."""
        weights = np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])).astype(np.float32) + 1
        if not len(labels):
            return cls(weights, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros((0, 2), np.float32), prior)
        rows = weighted(bags, weights)
        axes = leading_axes(rows, min(DIMENSIONS, len(rows)))
        # each class votes with its share of all training rows, however many of it are here
        ones = max(int(labels.sum()), 1), max(int((1 - labels).sum()), 1)
        votes = np.stack([labels * prior / ones[0], (1 - labels) * (1 - prior) / ones[1]], 1).astype(np.float32)
        return cls(weights, axes, normed(rows @ axes), votes, prior)

    def scores(self, bags: np.ndarray) -> np.ndarray:
        out = np.full(len(bags), self.prior)
        latent = normed(weighted(bags, self.weights) @ self.axes)
        some = np.flatnonzero(np.abs(latent).sum(1) > 0)
        if not len(self.vectors) or not len(some):
            return out
        cosines = latent[some] @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        force = np.clip(np.take_along_axis(cosines, near, 1), 0, 1) ** SHARPNESS
        votes = (self.votes[near] * force[:, :, None]).sum(1, dtype=np.float64)
        total = votes.sum(1)
        out[some] = np.where(total > 0, votes[:, 0] / np.where(total > 0, total, 1), self.prior)
        return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on labelled rows whose fold is not 0, at most ``per_class`` of each class by hash of the id."""
    rows = (docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0))
            .join(labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("label")), "doc_id"))
    ids = rows.select("doc_id", "label")
    counts = {r.label: r.n for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))

    def taken(label: int) -> DataFrame:
        """The first ids by hash; a threshold leaves about four times as many for the sort."""
        below = math.ceil(min(1.0, 4 * per_class / max(counts.get(label, 0), 1)) * (1 << 31))
        return ids.filter((F.col("label") == label) & (place < below)).orderBy(place, "doc_id").limit(per_class)

    chosen = F.broadcast(taken(0).unionByName(taken(1)).distinct())

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [bag(t).astype(np.float16).tobytes() for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(own, pa.binary())],
                                             ["doc_id", "label", "bag"])

    # of several texts under one id the one with the least hash teaches
    first = F.min_by(F.struct("label", "text"), F.struct(F.xxhash64("text"), "text")).alias("r")
    picked = (docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(first)
              .select("doc_id", "r.*").mapInArrow(bags, "doc_id long, label int, bag binary")
              .toArrow().sort_by("doc_id").combine_chunks())  # at most 2 * per_class rows
    matrix = np.frombuffer(b"".join(picked.column("bag").to_pylist()), np.float16).reshape(-1, TERMS)
    n = sum(counts.values())
    return Model.fit(matrix, picked.column("label").to_numpy().astype(np.float32), bucket_frequencies(docs),
                     (counts.get(1, 0) / n) if n else 0.5)


def score(docs: DataFrame, model: Model, accept: float = ACCEPT, name: str = "score") -> DataFrame:
    """Add ``name`` (0 to 1, higher: label 1 likelier) to every row.

    A null, empty or featureless text scores the share of label 1 in training.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]
    source = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = utf8(batch.column("text")), []
            for at in range(0, len(texts), BLOCK):
                own.append(given.value.scores(np.array([bag(t) for t in texts[at:at + BLOCK]])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept),
                                              pa.array(np.concatenate([*own, np.zeros(0)]), pa.float64())], [*kept, name])

    return source.mapInArrow(run, source.withColumn(name, F.lit(0.0)).schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Without labels every score is 0.5.  Repeated rows each give a row; other columns
    are ignored.
    """
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
