"""Substring dedup against a dictionary of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from docmill.llm import substring_dedup as S

from .conftest import DOCS, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window=50):
    """[(repr of the id, words, removed words, digest)]; a null id is larger than any other."""
    texts = [(float("inf") if r.doc_id is None else r.doc_id, r.doc_id, WORD.findall(r.text or "")) for r in rows]
    least = {}
    for at, _, own in texts:
        for i in range(len(own) - window + 1):
            key = tuple(own[i:i + window])
            least[key] = min(least.get(key, at), at)
    out = []
    for at, doc, own in texts:
        gone = {j for i in range(len(own) - window + 1) if least[tuple(own[i:i + window])] < at for j in range(i, i + window)}
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((repr(doc), len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(docs, window=50):
    return sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in S.digest(docs, window).collect())


@pytest.mark.parametrize("name", ["awkward", "sample"])
def test_same_as_all_windows(name, request):
    docs = request.getfixturevalue(name)
    assert found(docs) == plain(docs.collect())


def passages(spark, n=400):
    """A passage that a third of the documents hold, with changing surroundings, and near copies."""
    rng, hot, base = random.Random(3), words(70, 90), words(200, 91)
    rows = []
    for i in range(n):
        own = words(rng.randrange(10, 120), i, 50_000)
        if i % 3 == 0:
            at = rng.randrange(len(own))
            own = own[:at] + hot + own[at:]
        elif i % 5 == 0:
            own = base[:]
            own[rng.randrange(200)] = f"changed{i}"
        elif i % 7 == 0:
            own = own[:20] * 6  # repeats within one document alone
        rows.append((i, " ".join(own), "en", "s", 0, *["x"] * 9))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DOCS).repartition(4)


@pytest.mark.parametrize("window", [50, 51, 7, 2])
def test_hot_passages(spark, window):
    docs = passages(spark)
    assert found(docs, window) == plain(docs.collect(), window)


def test_small_buffers_and_hot_anchors(spark, monkeypatch):
    docs = passages(spark)
    monkeypatch.setattr(S, "BUFFER_WORDS", 500)
    monkeypatch.setattr(S, "BUCKET_BYTES", 1 << 12)
    monkeypatch.setattr(S, "SAMPLE", 1)
    monkeypatch.setattr(S, "HOT_SEEN", 10)
    assert len(S.hot_anchors(docs.selectExpr("xxhash64(doc_id) AS _row", "text"), 50)) > 0
    assert found(docs) == plain(docs.collect())


def test_rolling_hash_is_a_polynomial():
    ids = np.random.default_rng(0).integers(0, 1 << 63, 100).astype(np.uint64)
    for length in (1, 2, 25, 49, 50, 64):
        got = S.rolling(ids, length)
        want = [sum(int(x) * pow(int(S.BASE), length - 1 - j, 1 << 64) for j, x in enumerate(ids[i:i + length])) % (1 << 64)
                for i in range(101 - length)]
        assert got.tolist() == want
    values = np.random.default_rng(1).integers(0, 50, 60).astype(np.uint64)
    for width in (1, 2, 3, 26, 60):
        assert S.sliding_least(values, width).tolist() == [min(values[i:i + width].tolist()) for i in range(61 - width)]


def test_removal_keeps_rows_and_columns(awkward, nothing):
    out = S.remove(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[2] == "" and texts[4] is None and texts[6] == "   \n\t " and texts[3].startswith("w") is False
    assert S.digest(nothing).count() == 0 and S.remove(nothing).count() == 0


@pytest.mark.parametrize("texts", [[" ".join(words(300, 1))], [" ".join(words(60, i)) for i in range(3)], ["a b"] * 3, [None]])
def test_nothing_to_find(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *["x"] * 9) for i, t in enumerate(texts)], DOCS)
    assert found(docs) == plain(docs.collect())
