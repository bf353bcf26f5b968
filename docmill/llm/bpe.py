"""Byte-level BPE through a sentencepiece model that is serialised from the rank file.

Every byte is mapped to one character; a piece is the mapped form of a vocabulary
entry, its id is its rank and its score the negative rank, so that sentencepiece
merges the pair of lowest rank first.  The normaliser is the identity.  Texts are cut
into pre-tokens by a pattern and each pre-token is encoded by itself; decoding maps
ids back to the bytes of their entries.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens a worker remembers.
CACHE_SIZE = 1 << 19
#: The characters that stand for the 256 bytes start here.
FIRST_CHAR = 0x100


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate({b: FIRST_CHAR + b for b in range(256)})


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model (ModelProto) of a rank table; the id after the last is <unk>."""
    entries = sorted(ranks, key=ranks.__getitem__)
    if [ranks[e] for e in entries] != list(range(len(entries))):
        raise ValueError("ranks must run from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2
    model = bytearray()
    for rank, entry in enumerate(entries):
        model += _field(1, _field(1, mapped(entry).encode()) + _field(2, float(-rank)) + _field(3, normal))
    model += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    model += _field(2, _field(3, bpe) + _field(4, len(entries) + 1) + _field(40, len(entries))
                    + _field(41, -1) + _field(42, -1) + _field(43, -1))
    model += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(model)


class Codec:
    """Encodes pre-tokens and decodes ids; remembers recent pre-tokens."""

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ranks, self.entries = ranks, sorted(ranks, key=ranks.__getitem__)
        self.split = regex.compile(pattern).findall
        self.table = {b: FIRST_CHAR + b for b in range(256)}
        self.cache: dict[str, bytes] = {}

    def _learn(self, tokens: Iterable[str]) -> None:
        todo = []
        for token in tokens:
            data = token.encode()
            if (rank := self.ranks.get(data)) is None:
                todo.append((token, data.decode("latin-1").translate(self.table)))
            else:
                self.cache[token] = struct.pack("<I", rank)
        ids = self.processor.encode([form for _, form in todo], out_type=int, num_threads=1)
        for (token, _), own in zip(todo, ids, strict=True):
            self.cache[token] = np.array(own, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        tokens = self.split(text)
        if len(self.cache) > CACHE_SIZE:
            self.cache.clear()
        if new := set(tokens).difference(self.cache):
            self._learn(new)
        return b"".join(map(self.cache.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _shipped(docs: DataFrame, path: str, pattern: str):
    """Broadcast the model; a vocabulary file is bounded, whatever the corpus."""
    ranks = read_ranks(path)
    return docs.sparkSession.sparkContext.broadcast((serialise(ranks), ranks, pattern))


_LOADED: dict[tuple[int, str], Codec] = {}


def _codec(given) -> Codec:
    """The codec of a broadcast model; a Python worker loads it once for all its tasks."""
    model, ranks, pattern = given.value
    key = hash(model), pattern
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Codec(model, ranks, pattern)
    return _LOADED[key]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit integers) to every row.

    A null text counts as empty and gets no ids; all other columns stay as they are.
    """
    given = _shipped(docs, path, pattern)
    kept = [c for c in docs.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(given)
        for batch in batches:
            own = [codec.encode(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(own, pa.binary())], [*kept, ids])

    source = docs.select(*kept)
    return source.mapInArrow(run, source.withColumn(ids, F.lit(b"")).schema)


def decode(tokens: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add ``text`` (binary: the bytes of the ids); null ids give null."""
    given = _shipped(tokens, path, "")
    kept = [c for c in tokens.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(given)
        for batch in batches:
            own = [None if t is None else codec.decode(t) for t in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(own, pa.binary())], [*kept, text])

    source = tokens.select(*kept)
    return source.mapInArrow(run, source.withColumn(text, F.lit(b"")).schema)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a round trip over every whole text.

    Encoding and decoding happen in one pass over the rows, so that neither the texts
    nor the ids leave the task that read them.
    """
    given = _shipped(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(given)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in batch.column("text").to_pylist():
                ids = codec.encode(t or "")
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
