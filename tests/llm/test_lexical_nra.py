"""Ranked search against scores of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docmill.llm import lexical_nra as R

from .conftest import awkward_rows, words

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string, rank string, score int, key string"


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(documents, items, k=10):
    """The contract over all pairs: documents (doc_id, text), items {item_id: text}."""
    counts = [(d, Counter(plain_terms(t))) for d, t in documents]
    sizes = [c.total() for _, c in counts]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    out = []
    for item, text in items.items():
        scores = []
        asked = set(plain_terms(text))
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for _, c in counts) + 1))) for t in asked}
        for (d, c), size in zip(counts, sizes, strict=True):
            if size:
                m = 10 + 90 * size * n // length
                scores.append((-sum(weights[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked), d is None, d))
        best = sorted((s, null, d or 0) for s, null, d in scores if s < 0)[:k]
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(best, 1)]
    return sorted(out, key=str)


def ranked(documents, items, **options):
    return sorted((tuple(r) for r in R.rank(documents, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_reading_stops_before_the_ends():
    """One document leads both long lists: it is settled before the rest is read."""
    n = 5000
    order = np.arange(n)
    impacts = np.concatenate([[10**6], np.linspace(100, 1, n - 1).astype(np.int64)])
    found, scores, read = R.nra([(order, impacts), (order, impacts)], n, 1)
    assert found.tolist() == [0] and scores.tolist() == [2 * 10**6] and read < n / 10


@pytest.mark.parametrize("floor", [0, 40, 10**6])
def test_intervals_against_sums(floor):
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, terms, k = int(rng.integers(1, 900)), int(rng.integers(1, 6)), int(rng.integers(1, 12))
        full = rng.integers(0, 30, (n, terms)) * (rng.random((n, terms)) < 0.4)
        lists = []
        for t in range(terms):
            docs = np.flatnonzero(full[:, t])
            order = np.argsort(-full[docs, t], kind="stable")
            lists.append((docs[order], full[docs, t][order]))
        found, scores, _ = R.nra(lists, n, k, floor)
        total = full.sum(1)
        edge = max(floor, int(np.sort(total)[-k]) if n > k else 0, 1)
        assert set(np.flatnonzero(total >= edge)) <= set(found.tolist()) and (scores == total[found]).all()


@pytest.mark.parametrize("sizes", [{}, {"SEGMENT": 40, "CELLS": 64, "DEPTH": 2, "ITEMS": 3, "ITEM_BYTES": 4000}])
def test_awkward_documents(spark, awkward, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(R, name, value)
    items = {1: " ".join(words(40, 1)), 2: "Été Plage NAÏVE", 3: "same", 4: "", 5: None, 6: "line other line tail", 7: "no-such term_here", None: "one",
             8: " ".join(words(3000, 9)), 9: "\u0085 forms"}
    frame = spark.createDataFrame([(i, t, "x", 0, "y") for i, t in items.items()], ITEMS)
    frame = frame.unionByName(frame.limit(4)).unionByName(spark.createDataFrame([(3, "zzz", "x", 0, "y")], ITEMS))
    want = plain([(r[0], r[1]) for r in awkward_rows()], items)
    assert want and ranked(awkward, frame) == want


def test_common_words_and_copies(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choices(["the", "of", "a", *words(30, 6)], k=rng.randrange(1, 60)))) for i in range(400)]
    texts += [(i, "the same text of a copy") for i in range(400, 700)]
    items = {i: " ".join(rng.choices(["the", "of", "copy", *words(30, 6)], k=6)) for i in range(8)}
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    assert ranked(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")) == plain(texts, items)


def test_registered_query_on_generated_rows(spark):
    from docmill.llm.registry import queries

    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = queries()["op12_ranked_search"](spark, sf).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(texts, items)


def test_nothing_to_rank(spark, nothing, awkward):
    none = spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "same", "x", 0, "y")], ITEMS)
    blank = spark.createDataFrame([(1, " ", "x", 0, "y"), (2, None, "x", 0, "y")], ITEMS)
    assert ranked(nothing, one) == ranked(awkward, none) == ranked(awkward, blank) == ranked(nothing, none) == []
