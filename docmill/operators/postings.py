"""Keyword search over posting blocks: an inverted index as a table.

Documents are gathered into shards of bounded size where they lie.  A shard is a set of
rows: one that lists its documents in item order, and one posting block for every term
(who has it, how often, how long they are), with the largest frequency and the least
length of the block.  These bound the score that the block can add, so a query passes
over shards, blocks and documents that cannot reach its present k-th best score.

Only blocks of terms that queries ask for are read and moved, once for all queries of
a pass; queries are shipped in passes of a checked size.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.arrays import stage
from docmill.functions.rows import SLICE_ROWS
from docmill.functions.text import ascii_fold, ascii_mapping
from docmill.session import hash_blocks, stored

#: Documents and tokens of a shard, and queries of a pass.
SHARD_DOCS, SHARD_TOKENS, PASS_QUERIES = 1 << 14, 1 << 22, 1 << 12
#: Folders of a stored index, by hash of the term; tasks that write the listings of documents.
BUCKETS, LISTING_TASKS = 64, 8
#: Scores are rounded to six places; a bound must fall short by more than that.
SLACK = 1e-6


def tokens(text: Column) -> Column:
    """Terms of the indexed form of a text."""
    return F.array_remove(F.split(F.lower(ascii_fold(text)), "[^a-z0-9]+"), "")


#: Letters and digits of folded texts; anything else separates terms.
TERM_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


#: A text of so many distinct odd characters is translated character by character.
ODD, MOST_ODD = re.compile("[^\\x00-\\x7f]"), 64


@functools.cache
def _ascii_of(char: str) -> str:
    return char.translate(ascii_mapping()).encode("ascii", "ignore").decode()


def _ascii(text: str) -> str:
    odd = set(ODD.findall(text))
    if len(odd) > MOST_ODD:
        return text.translate(ascii_mapping())
    for char in odd:
        text = text.replace(char, _ascii_of(char))
    return text


def words_of(text: str) -> list[bytes]:
    """``tokens`` of one text, inside a task."""
    raw = text if text.isascii() else _ascii(text)
    return raw.encode("ascii", "ignore").translate(TERM_BYTES).split()


def _worded(batches: Iterator[pa.RecordBatch], wanted: Collection[str] | None = None) -> Iterator[pa.RecordBatch]:
    """(item, text) to (item, size, words), the words among ``wanted`` if given; a null text has no size.

    Words are Python objects of a few texts at a time, never of a whole batch.
    """
    kept = None if wanted is None else {w.encode() for w in wanted}
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE_ROWS):
            batch = whole.slice(at, SLICE_ROWS)
            found = [None if t is None else words_of(t) for t in batch.column(1).to_pylist()]
            sizes = [None if f is None else len(f) for f in found]
            if kept is not None:
                found = [f and [w for w in f if w in kept] for f in found]
            ends = np.cumsum([0, *(len(f or ()) for f in found)]).astype(np.int32)
            flat = pa.array([w for f in found if f for w in f], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), flat)],
                                             ["item", "size", "words"])


def bucket_of(term: str) -> Column:
    """The index folder of a term; listings of documents lie in folder -1."""
    return F.when(F.col(term).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int"))


def by_folder(rows: DataFrame) -> DataFrame:
    """Block rows by index folder, in files sorted by term; a term lies in one file.

    Rows are placed by hashes: ranges of them would be drawn from a sample, for which all texts are inverted once more.
    """
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.withColumn("bucket", bucket_of("term"))
    within = F.pmod(F.shiftright(F.xxhash64("term"), 16), F.lit(1 << 20))
    # tasks share out the folders in their order: each has about as many rows and no more folders than it must
    task = F.floor((F.col("bucket") * (1 << 20) + within) * tasks / (BUCKETS << 20)).cast("int")
    listings = F.pmod("shard", F.lit(min(tasks, LISTING_TASKS))).cast("int")
    return placed.repartitionById(tasks, F.when(F.col("term").isNull(), listings).otherwise(task)).sortWithinPartitions("bucket", "term", "shard")


def block_schema(item: T.DataType) -> T.StructType:
    numbers = T.ArrayType(T.IntegerType())
    return T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()),
        T.StructField("items", T.ArrayType(item)), T.StructField("ords", numbers),
        T.StructField("tfs", numbers), T.StructField("lengths", numbers),
        T.StructField("most_tf", T.IntegerType()), T.StructField("least_length", T.IntegerType())])


def posting_blocks(corpus: DataFrame, item: str = "chunk_id", text: str = "text",
                   terms: Sequence[str] | None = None) -> DataFrame:
    """The rows of an inverted index of ``corpus``, sorted by term within a shard.

    The row with a null term lists the shard's items, in order, with their lengths.  With
    ``terms`` only their postings are made; lengths are whole.  A null text has no terms
    and no length.
    """
    rows = corpus.select(F.col(item).alias("item"), F.col(text).alias("text"))
    schema = block_schema(corpus.schema[item].dataType)

    shipped = None if terms is None else corpus.sparkSession.sparkContext.broadcast(list(terms))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        words = _worded(batches, None if shipped is None else shipped.value)
        for number, part in enumerate(_shards(words)):
            yield from _invert(part, first + number, schema)
    return rows.mapInArrow(build, schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in tables of at most SHARD_DOCS documents and SHARD_TOKENS tokens (or one document)."""
    held: list[pa.RecordBatch] = []
    docs = words = 0
    for batch in batches:
        ends = np.cumsum(np.asarray(batch.column("size").fill_null(0)), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, before + SHARD_TOKENS - words, side="right"))
            stop = min(max(stop, start + (not held)), start + SHARD_DOCS - docs)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                docs, words = docs + stop - start, words + int(ends[stop - 1]) - before
            if stop < batch.num_rows:
                full, held, docs, words = held, [], 0, 0
                yield _joined(full)
            start = max(stop, start)
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.Table:
    """One copy of the rows; the list is emptied."""
    whole = pa.Table.from_batches(held).combine_chunks()
    held.clear()
    return whole


def _invert(part: pa.Table, shard: int, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """The block rows of one shard."""
    order = pc.sort_indices(part.column("item").combine_chunks())
    items, words, sizes = (part.column(c).combine_chunks().take(order) for c in ("item", "words", "size"))
    n, whole = len(items), pa.array([0, len(items)], pa.int32())
    none = pa.nulls(1, pa.list_(pa.int32()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([shard]), pa.nulls(1, pa.string()), pa.ListArray.from_arrays(whole, items), none, none,
         pa.ListArray.from_arrays(whole, sizes.cast(pa.int32())), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32())], schema.names)
    doc, flat = np.asarray(pc.list_parent_indices(words)).astype(np.int64), words.flatten()
    if not len(flat):
        return
    encoded = flat.dictionary_encode()
    key, tf = np.unique(np.asarray(encoded.indices).astype(np.int64) * n + doc, return_counts=True)
    code, doc = key // n, key % n
    length = np.asarray(sizes.fill_null(0)).astype(np.int64)[doc]
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    terms = encoded.dictionary.take(pa.array(code[starts]))
    by_term = pc.sort_indices(terms)
    at = pa.array(np.append(starts, len(code)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))).take(by_term) for v in (doc, tf, length)]
    bounds = [pa.array(f.reduceat(v, starts).astype(np.int32)).take(by_term) for f, v in ((np.maximum, tf), (np.minimum, length))]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), shard)), terms.take(by_term), pa.nulls(len(starts), pa.list_(items.type)),
                                      *lists, *bounds], schema.names)


# --- scoring -----------------------------------------------------------------------------

class Best:
    """A query's k best (score, item) so far: higher scores first, then smaller items."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def floor(self) -> float:
        return -self.rows[-1][0] if len(self.rows) == self.k else 0.0

    def add(self, found: list[tuple]) -> None:
        self.rows = sorted(self.rows + found, key=lambda r: r[:2])[:self.k]


def shard_scores(lists: Sequence[tuple[float, np.ndarray, np.ndarray]], size: int, floor: float
                 ) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, postings read): whoever may score ``floor`` or more in a shard.

    ``lists`` has (bound, documents, contributions) of each query term.  Terms whose bounds
    together fall short of ``floor`` bring in no documents of their own; they are only
    looked up for documents that the other terms brought in and that can still arrive.
    """
    lists = sorted(lists, key=lambda t: t[0])
    reach = np.cumsum([bound for bound, _, _ in lists])
    floor -= SLACK
    optional = int(np.searchsorted(reach, floor, side="left")) if floor > 0 else 0
    if optional == len(lists):
        return np.zeros(0, np.int64), np.zeros(0), 0
    total, read = np.zeros(size), 0
    for _, docs, adds in lists[optional:]:
        total[docs] += adds
        read += len(docs)
    found = np.flatnonzero(total)
    for i in range(optional - 1, -1, -1):
        found = found[total[found] + reach[i] >= floor]
        _, docs, adds = lists[i]
        at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
        hit = docs[at] == found
        total[found[hit]] += adds[at[hit]]
        read += int(hit.sum())
    scores = np.round(total[found], 6)
    kept = (scores >= floor) & (scores > 0)
    return found[kept], scores[kept], read


def _search(shipped, k: int, k1: float, b: float, mean: float, schema: T.StructType):
    """Arrow function: block rows sorted by batch and shard -> a task's k best of every query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, by_term = shipped.value
        best = [Best(k) for _ in queries]
        for table in _whole_shards(batches):
            _search_shard(table, queries, by_term, best, k1, b, mean)
        rows = [(q, item, -score, matched) for q, own in enumerate(best) for score, item, matched in own.rows]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        kinds = [pa.int32(), _arrow_type(schema), pa.float64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                         ["q", "item", "score", "matched"])
    return run


def _arrow_type(schema: T.StructType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(schema["items"].dataType.elementType)


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (batch, shard) at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([np.asarray(batch.column("batch")), np.asarray(batch.column("shard"))])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for first, stop in zip(cuts, cuts[1:], strict=False):
            if stop == first:
                continue
            key = tuple(keys[:, first].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(first, stop - first))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _search_shard(table: pa.Table, queries: list, by_term: dict, best: list[Best], k1: float, b: float, mean: float) -> None:
    terms = table.column("term").to_pylist()
    items, dead, blocks = None, np.zeros(0, np.int64), {}
    for i, term in enumerate(terms):
        if term is not None:
            blocks[term] = i
        elif table.column("items")[i].is_valid:
            items = table.column("items")[i].values
        else:
            dead = np.asarray(table.column("ords")[i].values)
    if items is None:
        return
    size = len(items)
    alive = np.ones(size, bool)
    alive[dead] = False
    loaded: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def load(term: str) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a term and what it adds to each, before the query's weight."""
        if term not in loaded:
            i = blocks[term]
            docs, tf, length = (np.asarray(table.column(c)[i].values) for c in ("ords", "tfs", "lengths"))
            if len(dead):
                keep = alive[docs]
                docs, tf, length = docs[keep], tf[keep], length[keep]
            loaded[term] = docs, tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        return loaded[term]

    most_tf, least = table.column("most_tf").to_pylist(), table.column("least_length").to_pylist()
    bounds = {t: most_tf[i] * (k1 + 1) / (most_tf[i] + k1 * (1 - b + b * least[i] / mean)) for t, i in blocks.items()}
    here = sorted({q for t in blocks for q in by_term.get(t, ())})
    for q in here:
        own = [(t, w) for t, w in queries[q] if t in blocks]
        floor = best[q].floor
        if floor and sum(w * bounds[t] for t, w in own) < floor - SLACK:
            continue
        lists = [(w * bounds[t], docs, w * adds) for t, w in own for docs, adds in [load(t)] if len(docs)]
        if not lists:
            continue
        found, scores, _ = shard_scores(lists, size, floor)
        if len(found) > best[q].k:  # documents are in item order
            order = np.lexsort((found, -scores))[:best[q].k]
            found, scores = found[order], scores[order]
        if len(found):
            matched = np.zeros(len(found), int)
            for _, docs, _ in lists:
                at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                matched += docs[at] == found
            best[q].add(list(zip((-scores).tolist(), items.take(pa.array(found)).to_pylist(), matched.tolist(), strict=True)))


def _totals(listed: DataFrame, gone: DataFrame | None) -> DataFrame:
    """(n, mean): how many documents of the listings count, and the mean of their lengths."""
    none = F.array().cast("array<int>")
    rows = listed.withColumn("dead", none) if gone is None else listed.join(gone, ["batch", "shard"], "left").withColumn("dead", F.coalesce("dead", none))

    def known(lengths: Column) -> tuple[Column, Column]:
        return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))), F.size(F.filter(lengths, lambda x: x.isNotNull()))
    whole, lost = known(F.col("lengths")), known(F.transform("dead", lambda i: F.get("lengths", i)))
    sums = rows.select((F.size("lengths") - F.size("dead")).alias("n"), (whole[0] - lost[0]).alias("length"), (whole[1] - lost[1]).alias("known"))
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("length") / F.nullif(F.sum("known"), F.lit(0))).alias("mean"))


#: Shards whose bitmaps of dead documents are shipped (2 KB each).
SHIPPED_SHARDS = 1 << 14


def _bitmaps(dead: DataFrame) -> DataFrame:
    """(batch, shard, bits): the dead documents of a shard, 64 to a number."""
    words = dead.select("batch", "shard", F.explode("ords").alias("o")).groupBy("batch", "shard", F.shiftright("o", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, o & 63)")).alias("x"))
    held = F.map_from_entries(F.collect_list(F.struct("w", "x")))
    bits = stored(words.groupBy("batch", "shard").agg(held.alias("m"), F.max("w").alias("last")).select("batch", "shard", F.transform(
        F.sequence(F.lit(0), F.col("last")), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("bigint"))).alias("bits")), "dead-bits")
    return F.broadcast(bits) if bits.count() <= SHIPPED_SHARDS else bits


def _alive(ords: str, bits: str) -> Column:
    """How many of a block's documents are not dead."""
    word = lambda o: F.coalesce(F.get(bits, F.shiftright(o, 6)), F.lit(0).cast("bigint"))
    return F.when(F.col(bits).isNull(), F.size(ords)).otherwise(F.size(F.filter(ords, lambda o: F.getbit(word(o), o.bitwiseAND(F.lit(63))) == 0)))


def search_blocks(blocks: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, use_idf: bool = True,
                  average_length: float | None = None, item: str = "chunk_id", dead: DataFrame | None = None) -> DataFrame:
    """(query_id, item, score, matched): BM25 candidates, k of every task, of which the k best
    of a query are its answer; ``matched`` counts the query's distinct terms that the document has.

    ``blocks`` are block rows with a column ``batch``; ``dead`` (batch, shard, ords) lists
    documents of shards that no longer count.
    """
    spark, schema = blocks.sparkSession, blocks.schema
    asked = stage(queries.select("query_id", "query"), terms=F.array_distinct(tokens(F.coalesce("query", F.lit(""))))).select("query_id", "terms")
    listed = blocks.filter(F.col("term").isNull())
    if dead is not None:
        gone = _bitmaps(dead)
    totals = _totals(listed, None if dead is None else dead.select("batch", "shard", F.col("ords").alias("dead"))).first()
    mean = average_length or totals.mean or 1.0
    kind = queries.schema["query_id"].dataType.simpleString()
    # shards are heavy rows: adaptive execution would put a few of them into one task
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = []
    for block in hash_blocks(asked.dropDuplicates(["query_id"]), "query_id", PASS_QUERIES):
        terms = F.broadcast(block.select(F.explode("terms").alias("term")).distinct())  # of PASS_QUERIES queries
        wanted = blocks.filter(F.col("term").isNotNull()).join(terms, "term", "left_semi")
        if "bucket" in blocks.columns:  # folders of the index, BUCKETS at most
            wanted = wanted.filter(F.col("bucket").isin([r[0] for r in terms.select(bucket_of("term")).distinct().collect()]))
        counted = wanted if dead is None else wanted.join(gone, ["batch", "shard"], "left")
        held = F.size("ords") if dead is None else _alive("ords", "bits")
        counted = counted.groupBy("term").agg(F.sum(held).alias("df")).filter("df > 0")
        df = dict(counted.toPandas().itertuples(index=False, name=None))  # a row a term of the pass
        own = [(r.query_id, [t for t in r.terms if t in df]) for r in block.collect()]
        weights = {t: float(np.log1p((totals.n - f + 0.5) / (f + 0.5))) if use_idf else 1.0 for t, f in df.items()}
        by_term: dict[str, list[int]] = {}
        for q, (_, found) in enumerate(own):
            for t in found:
                by_term.setdefault(t, []).append(q)
        shipped = spark.sparkContext.broadcast(([[(t, weights[t]) for t in found] for _, found in own], by_term))
        moved = wanted.unionByName(listed)
        if dead is not None:
            moved = moved.unionByName(dead, allowMissingColumns=True)
        rows = (moved.repartition(tasks, "batch", "shard").sortWithinPartitions("batch", "shard")
                .mapInArrow(_search(shipped, k, k1, b, mean, schema),
                            T.StructType([T.StructField("q", T.IntegerType()), T.StructField(item, schema["items"].dataType.elementType),
                                          T.StructField("score", T.DoubleType()), T.StructField("matched", T.IntegerType())])))
        ids = F.broadcast(spark.createDataFrame([(i, q) for i, (q, _) in enumerate(own)], f"q int, query_id {kind}"))
        parts.append(rows.join(ids, "q").select("query_id", item, "score", "matched"))
    return functools.reduce(DataFrame.unionByName, parts)
