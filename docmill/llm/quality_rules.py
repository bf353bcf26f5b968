"""Quality rules: text statistics and zstandard compression bands.

The ratio of compressed to plain bytes is taken over the whole document and over fixed
chunks of it.  Repetitive text compresses too well, noise too badly; how far a ratio may
lie from the middle depends on the length, because short texts give a compressor little
to find.  A document is rejected when its own ratio leaves the band of its length or
when too many of its chunks leave the band of a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docmill.llm.common import utf8

#: Least bytes of a class, and the ratios between which its documents are kept.  Texts
#: below the first class are too short for a ratio to mean anything.
BANDS = ((256, 0.30, 0.97), (1024, 0.25, 0.80), (4096, 0.20, 0.70), (16384, 0.16, 0.65))
#: Bytes of a chunk and its band, for texts of two such chunks or more; shorter texts have the next size.
CHUNKS = ((4096, 0.20, 0.75), (1024, 0.25, 0.80), (256, 0.30, 0.97))
#: The share of a text that may lie in chunks outside their band, and the compression level.
CHUNK_SHARE, LEVEL = 0.25, 3
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) > 1 << 20:  # else the product below would leave 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(numbers) + ids[2:]
    _, at, counts = np.unique(windows, return_inverse=True, return_counts=True)
    covered = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(counts[at] > 1)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + 3, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in data.split(b"\n") if line.split(None, 1)]
    return len(lines) - len(set(lines))


class Bands:
    """Compression ratios of a document; one compressor serves a task."""

    def __init__(self):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress

    def ratio(self, data: bytes) -> float:
        return len(self.compress(data)) / len(data) if data else 0.0

    def measure(self, data: bytes) -> tuple[float, float, bool]:
        """(ratio of the whole, share of the text in chunks outside their band, within all bands).

        What full chunks leave over is judged by the chunk that ends with the text and counts by its own bytes."""
        ratio = self.ratio(data)
        limits = [(low, high) for least, low, high in BANDS if len(data) >= least]
        fine = not limits or limits[-1][0] <= ratio <= limits[-1][1]
        outside = 0
        for size, low, high in CHUNKS:
            if len(data) >= 2 * size:
                for end in [*range(size, len(data), size), len(data)]:
                    if not low <= self.ratio(data[end - size:end]) <= high:
                        outside += (end - 1) % size + 1
                break
        share = outside / len(data) if data else 0.0
        return ratio, share, fine and share <= CHUNK_SHARE


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the ratios behind the verdict.

    A null or empty text has no words, so the base rules fail it.  Repeated rows each
    give a row; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        for batch in batches:
            rows = []
            for data in utf8(batch.column("text")):
                words = data.split()
                n, repeats = len(words), repeated_words(words)
                # a code point begins at every byte that is not a UTF-8 continuation
                chars = sum(map(len, words)) if data.isascii() else sum(len(w.decode("utf-8", "replace")) for w in words)
                failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
                ratio, share, fine = bands.measure(data)
                rows.append((n, chars, len(data.translate(None, NOT_SYMBOLS)), duplicate_lines(data), repeats,
                             failed, fine and not failed, ratio, share))
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                     "zstd_ratio", "chunk_share_outside")
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows \
                else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "base_failed boolean, kept boolean, zstd_ratio double, chunk_share_outside double")
