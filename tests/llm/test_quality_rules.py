"""Quality rules against a plain count, and the bands on planted texts."""

import re
from collections import Counter

import numpy as np

from docmill.llm import quality_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    repeated = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated),
            n < 50 or 100 * len(repeated) > 50 * n)


def test_base_counts(awkward, sample, nothing):
    for docs in (awkward, sample):
        want = sorted((repr(r.doc_id), *plain(r.text)) for r in docs.collect())
        got = R.quality_rules(docs).collect()
        assert sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                      for r in got) == want
        assert not any(r.kept for r in got if r.base_failed)
    assert R.quality_rules(nothing).count() == 0


def test_bands():
    rng, bands = np.random.default_rng(0), R.Bands()
    syllables = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "en", "ir")]
    prose = " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(8000)).encode()
    noise = rng.integers(33, 127, 40000).astype(np.uint8).tobytes()
    for n in (300, 2000, 6000, 40000):
        assert bands.measure(prose[:n])[2]
        assert not bands.measure((b"buy now " * 6000)[:n])[2]
    assert not bands.measure(noise)[2] and not bands.measure(noise[:5000])[2]
    # a third of the text is one line over and over: the whole passes, its chunks do not
    mixed = prose[:24576] + (b"buy now " * 2000)[:12288]
    assert bands.measure(mixed)[1] > R.CHUNK_SHARE and not bands.measure(mixed)[2]
    assert bands.measure(b"")[2] and bands.measure(b"short")[2]


def test_chunks_cover_the_whole_text():
    rng, bands = np.random.default_rng(0), R.Bands()
    syllables = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "en", "ir")]
    prose = " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(3000)).encode()
    noise, line = rng.integers(33, 127, 3000).astype(np.uint8).tobytes(), b"buy now " * 600
    for data in (prose[:8192] + line[:4095], prose[:4096] + line[:4095], prose[:5000] + noise, prose[:1000] + line[:600]):
        assert not bands.measure(data)[2]
    for n in (512, 1000, 2047, 2048, 5000, 8191, 8192, 12287):
        assert bands.measure(prose[:n])[1:] == (0.0, True)


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1").collect()}
    rows = [r for r in R.quality_rules(docs).collect() if r.doc_id in good and not r.base_failed]
    assert all(r.kept for r in rows) and len(rows) > 100
