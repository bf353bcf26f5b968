"""Deterministic lexical embeddings, vector helpers and the embedding cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.arrays import islands, let
from docmill.functions.rows import each_row
from docmill.functions.text import SEARCH_STOPWORDS, strip_marks

VECTOR = T.ArrayType(T.FloatType())
VECTORS = "vector_key string, embedding array<double>, error string"
MEASURED = VECTORS + ", prev_key string, apart double, levels array<double>, codes string"
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


# --- vectors --------------------------------------------------------------------------

def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(vector: Column) -> Column:
    return let(F.sqrt(dot(vector, vector)), lambda n: F.when(n == 0, vector).otherwise(
        F.transform(vector, lambda x: x / n)))


def resize(vector: Column, dimensions: int) -> Column:
    """Keep the leading dimensions and normalise again."""
    return l2_normalize(F.slice(vector, 1, dimensions))


def prepare_text(text: Column, purpose: str, family: str,
                 task: str = "Given a search query, retrieve relevant passages") -> Column:
    """The text an embedding model expects for its family and purpose."""
    if family == "e5":
        prefix = "query: " if purpose == "query" else "passage: "
        return F.when(text.startswith(prefix), text).otherwise(F.concat(F.lit(prefix), text))
    if family == "instruct" and purpose == "query":
        return F.concat(F.lit(f"Instruct: {task}\nQuery:"), text)
    return text


# --- signed term hashing (all in the JVM) --------------------------------------------------

def content_terms(text: Column) -> Column:
    """Accent-free terms of at least three characters, function words dropped."""
    words = F.regexp_extract_all(strip_marks(text), F.lit("([a-z0-9_]{3,})"), 1)
    return F.filter(words, lambda w: ~w.isin(*SEARCH_STOPWORDS))


def term_bucket(term: Column, dimensions: int = 128) -> Column:
    """struct(bucket, sign) of a term: big-endian digest head modulo, parity of byte 5."""
    return let(F.sha2(term, 256), lambda h: F.struct(
        (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dimensions).cast("int")
        .alias("bucket"),
        F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0)
        .otherwise(-1.0).alias("sign")))


def term_hash_embedding(terms: Column, dimensions: int = 128) -> Column:
    """Unit vector of signed term counts.

    Sorting the (bucket, sign) pairs turns each
    bucket into one run, whose sum comes from a slice instead of a full pass.
    """
    pairs = F.sort_array(F.transform(terms, lambda t: term_bucket(t, dimensions)))

    def dense(ps: Column) -> Column:
        runs = islands(ps, lambda a, b: a["bucket"] == b["bucket"])
        sums = F.map_from_entries(F.transform(runs, lambda r: F.struct(
            F.get(ps, r["first"])["bucket"].alias("key"),
            F.aggregate(F.slice(ps, r["first"] + 1, r["last"] - r["first"] + 1), F.lit(0.0),
                        lambda acc, p: acc + p["sign"]).alias("value"))))
        return let(sums, lambda m: F.transform(
            F.sequence(F.lit(0), F.lit(dimensions - 1)),
            lambda b: F.coalesce(F.try_element_at(m, b), F.lit(0.0))))
    return l2_normalize(let(pairs, dense))


# --- character n-gram hashing ------------------------------------------------------------------

#: Characters whose n-grams are hashed at one time.
VECTOR_CHARS = 1 << 16


def _murmur3(data: bytes) -> int:
    """32-bit MurmurHash3 with seed 0, as a signed integer."""
    mask, h = 0xFFFFFFFF, 0
    body = len(data) & ~3
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & mask
        k = ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask
        h ^= k
        if i < body:
            h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@lru_cache(maxsize=200_000)
def _word_buckets(word: str, size: int) -> np.ndarray:
    """Buckets of the 3- to 5-grams of one space-padded word."""
    padded, grams = f" {word} ", []
    for n in range(3, 6):
        grams += [padded[i:i + n] for i in range(max(1, len(padded) - n + 1))]
        if len(padded) <= n:
            break
    return np.array([abs(_murmur3(g.encode())) % size for g in grams], dtype=np.int64)


def ngram_vector(text: str, size: int = 512) -> np.ndarray:
    """Unit vector of n-gram counts of an accent-free lowercase text."""
    words = text.split()
    counts = np.zeros(size)
    if words:
        counts = np.bincount(np.concatenate([_word_buckets(w, size) for w in words]),
                             minlength=size).astype(float)
    norm = np.sqrt((counts * counts).sum())
    return counts / norm if norm else counts


def _gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """``_murmur3`` of the ``n`` (3 to 5) bytes from every place on, as signed integers."""
    def mixed(k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
    size = len(data) - n + 1
    k = data[:size].copy()
    for i in range(1, min(n, 4)):
        k |= data[i:i + size] << np.uint32(8 * i)
    h = mixed(k)
    if n > 3:
        h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
    if n > 4:
        h ^= mixed(data[4:4 + size])
    h ^= np.uint32(n)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32)


def ngram_vectors(texts: Sequence[str], size: int = 512) -> np.ndarray:
    """``ngram_vector`` of every text, as rows: grams of ASCII words are hashed together.

    A gram is a run of 3 to 5 bytes without a space inside; the spaces round a word belong to it.
    """
    counts = np.zeros((len(texts), size))
    first = 0
    while first < len(texts):  # texts of VECTOR_CHARS characters, or one text
        stop, chars = first, 0
        while stop < len(texts) and (stop == first or chars + len(texts[stop]) <= VECTOR_CHARS):
            chars, stop = chars + len(texts[stop]), stop + 1
        lines = []
        for row in range(first, stop):
            words = texts[row].split()
            if not texts[row].isascii():
                for odd in (w for w in words if not w.isascii()):
                    np.add.at(counts[row], _word_buckets(odd, size), 1)
                words = [w for w in words if w.isascii()]
            lines.append(f" {' '.join(words)} ")
        raw = np.frombuffer("".join([*lines, "  "]).encode("ascii"), np.uint8)
        data, inner = raw.astype(np.uint32), raw[1:-1] != 32
        owner = np.repeat(np.arange(stop - first) * size, [len(line) for line in lines])
        places = []
        for n in (3, 4, 5):
            if n > 3:
                inner = inner[:-1] & (raw[n - 2:-1] != 32)
            bucket = np.abs(_gram_hashes(data, n)[inner].astype(np.int64))
            places.append(owner[:len(inner)][inner] + (bucket & size - 1 if size & size - 1 == 0 else bucket % size))
        counts[first:stop] += np.bincount(np.concatenate(places), minlength=(stop - first) * size).reshape(-1, size)
        first = stop
    norm = np.sqrt((counts * counts).sum(axis=1))[:, None]
    return np.divide(counts, norm, out=counts, where=norm != 0)


def ngram_embedding(text: Column, size: int = 512) -> Column:
    return each_row(lambda t: ngram_vector(t, size).tolist(), VECTOR)(strip_marks(text))


class EachEmbedder:
    """Embeds every text of an array: a JVM preparation, then one Arrow call.

    A model-backed embedder is plugged in by passing its own ``batch`` function
    (list of texts to list of vectors).
    """

    def __init__(self, batch: Callable[[list[str]], list],
                 prepare: Callable[[Column], Column] = lambda texts: texts):
        self.batch, self.prepare = batch, prepare

    def __call__(self, texts: Column) -> Column:
        batch = self.batch

        def embed(ts: list) -> list:
            return [np.asarray(v, dtype=float).tolist() for v in batch(ts)]
        return each_row(embed, T.ArrayType(VECTOR))(texts)

    def distances(self, texts: Column) -> Column:
        """array<double>: 1 - cosine of each text with the next (vectors stay in the task)."""
        batch = self.batch

        def measure(ts: list) -> list:
            m = np.asarray(batch(ts), dtype=float)
            return [] if len(m) < 2 else (1 - (m[:-1] * m[1:]).sum(axis=1)).tolist()
        return each_row(measure, T.ArrayType(T.DoubleType()))(texts)


NGRAM_EACH = EachEmbedder(ngram_vectors, lambda texts: F.transform(texts, strip_marks))


def message(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def _vector(v: Sequence[float]) -> Sequence[float]:
    return v if isinstance(v, np.ndarray) and v.ndim == 1 and v.dtype == float else [float(x) for x in v]


def embedded(texts: DataFrame, embed: Embedder, batch_size: int = 64) -> DataFrame:
    """(vector_key, text) to vectors; when a batch raises, its texts are tried one by one.

    With a column ``prev_key``, a row whose predecessor in its partition has that key also gets
    1 - cosine of the two unit vectors, ``apart``; vectors of few distinct components are packed.
    """
    def each(texts: list[str]) -> list[tuple]:
        try:
            return [(_vector(v), None) for v in embed(texts)]
        except Exception as error:
            return [(None, message(error))] if len(texts) == 1 else [r for t in texts for r in each([t])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                batch = whole.slice(at, batch_size)
                found = each(batch.column("text").to_pylist())
                vectors = [v for v, _ in found]
                if measured:
                    packs = [None if v is None else _pack(v) for v in vectors]
                    vectors = [v if p is None else None for v, p in zip(vectors, packs, strict=True)]
                columns = [batch.column("vector_key"), _lists(vectors), pa.array([e for _, e in found], pa.string())]
                if measured:
                    keys, prev = batch.column("vector_key").to_pylist(), batch.column("prev_key").to_pylist()
                    row = [last, *zip(keys, (v for v, _ in found), strict=True)]
                    columns += [batch.column("prev_key"), pa.array(_neighbours(row, prev), pa.float64()),
                                _lists([None if p is None else p[0] for p in packs]), pa.array([None if p is None else p[1] for p in packs], pa.string())]
                    last = row[-1]
                yield pa.RecordBatch.from_arrays(columns, ["vector_key", "embedding", "error", "prev_key", "apart", "levels", "codes"][:len(columns)])
    measured = "prev_key" in texts.columns
    return texts.select("vector_key", "text", *(["prev_key"] if measured else [])).mapInArrow(run, MEASURED if measured else VECTORS)


#: The sign of a packed component's first level; at most LEVELS of them are told apart by ASCII signs.
FIRST_CODE, LEVELS = 35, 90


def _pack(vector: Sequence[float]) -> tuple[np.ndarray, str] | None:
    """(distinct components, a sign for each component) where that is shorter; every bit is kept."""
    bits = np.asarray(vector, dtype=float).view(np.int64)
    held = np.sort(bits)
    levels = held[np.append(True, held[1:] != held[:-1])] if len(held) else held
    if len(levels) > LEVELS or 2 * len(levels) > len(bits) or not len(bits):
        return None
    return levels.view(float), (np.searchsorted(levels, bits) + FIRST_CODE).astype(np.uint8).tobytes().decode("ascii")


def unpacked(vectors: DataFrame) -> DataFrame:
    """Rows of ``embedded`` with every vector in ``embedding``."""
    if "codes" not in vectors.columns:
        return vectors
    whole = F.transform(F.split("codes", ""), lambda c: F.get("levels", F.ascii(c) - FIRST_CODE))
    return vectors.withColumn("embedding", F.coalesce("embedding", whole)).drop("levels", "codes")


def _lists(vectors: list[Sequence[float] | None]) -> pa.Array:
    ends = np.append(0, np.cumsum([0 if v is None else len(v) for v in vectors])).astype(np.int32)
    values = np.concatenate([np.zeros(0), *(v for v in vectors if v is not None)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array([v is None for v in vectors], pa.bool_()))


def _neighbours(row: list[tuple], prev: list) -> list[float | None]:
    """Distance of each (key, vector) from the one before it, where that has the key ``prev``."""
    out: list[float | None] = [None] * len(prev)
    at = [i for i, key in enumerate(prev) if key is not None and row[i][0] == key and row[i][1] is not None
          and row[i + 1][1] is not None and len(row[i][1]) == len(row[i + 1][1])]
    if at:
        sizes = {len(row[i][1]) for i in at}
        for size in sizes:
            own = [i for i in at if len(row[i][1]) == size]
            d = 1 - (np.asarray([row[i][1] for i in own], float) * np.asarray([row[i + 1][1] for i in own], float)).sum(axis=1)
            for i, x in zip(own, d.tolist(), strict=True):
                out[i] = x
    return out


# --- cache ----------------------------------------------------------------------------------------

def cache_key(text: Column, provider: str, model: str, purpose: str, config: str) -> Column:
    """Key of one embedding; queries and documents never share one."""
    return F.sha2(F.concat_ws("\x1f", F.lit(provider), F.lit(model), F.lit(purpose),
                              F.lit(config), text), 256)


def embed_with_cache(items: DataFrame, cache: DataFrame, embed: Callable[[Column], Column],
                     provider: str, model: str, purpose: str, config: str = "",
                     text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(items with their embedding, the newly computed cache rows).

    Distinct missing texts are embedded once; hits come from the cache by key.
    """
    keyed = items.withColumn("cache_key", cache_key(F.col(text), provider, model, purpose, config))
    misses = (keyed.select("cache_key", F.col(text).alias("_t")).dropDuplicates(["cache_key"])
              .join(cache.select("cache_key"), "cache_key", "left_anti"))
    fresh = misses.select("cache_key", embed(F.col("_t")).alias("embedding"))
    known = cache.select("cache_key", "embedding").unionByName(fresh)
    return keyed.join(known, "cache_key"), fresh


def cache_statistics(items: DataFrame, cache: DataFrame, provider: str, model: str,
                     purpose: str, config: str = "", text: str = "text") -> DataFrame:
    """Hits, misses and stale rows (a hit of another dimension than expected)."""
    keyed = items.select(cache_key(F.col(text), provider, model, purpose, config)
                         .alias("cache_key"))
    joined = keyed.join(cache.select("cache_key", F.size("embedding").alias("dims"),
                                     "dimensions"), "cache_key", "left")
    hit = F.col("dims").isNotNull()
    stale = hit & (F.col("dims") != F.col("dimensions"))
    return joined.agg(F.count_if(hit & ~stale).alias("hits"), F.count_if(~hit).alias("misses"),
                      F.count_if(stale).alias("stale"))


def fill_vectors(chunks: DataFrame, embed: Callable[[Column], Column],
                 text: str = "text") -> DataFrame:
    """Keep precomputed vectors; embed the rows that have none."""
    have = chunks.filter(F.col("embedding").isNotNull())
    lack = chunks.filter(F.col("embedding").isNull()).withColumn("embedding", embed(F.col(text)))
    return have.unionByName(lack)
