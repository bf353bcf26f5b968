"""Hard negatives against all pairs in Python integers."""

import math
import random

import numpy as np
import pytest

from docmill.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, id string, score string, anchor_id int"


def plain(rows, every=100, k=5):
    """The contract, word by word; rows are (id, vector, label) with distinct ids."""
    made = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows]
    out = []
    for i, label, v in made:
        if i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in made if j != i]
        best = sorted((-s, j) for s, j, other in scored if other == label)[:k]
        for s, j in best:
            found = sorted((-t, n) for t, n, other in scored if other != label and 80 * -s <= 100 * t <= 100 * -s)[:k]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(found, 1)]
    return sorted(out)


def mined(frame, **options):
    return sorted(tuple(r) for r in H.mine(frame, **options).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 64, 70), (50, 17, 40), (100, 3, 5), (128, 128, 64), (0, 4, 4)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(1)
    for most in (10, 1 << 20, 1 << 40):  # the largest wraps, as int64 products do
        a, b = rng.integers(-most, most, shape[:2]), rng.integers(-most, most, shape[1:])
        assert (H.strassen(a, b) == a @ b).all()


def test_scaled_limit():
    for score in [*range(-250, 250), 10**17 + 7]:
        n = int(H._scaled(np.array([score]), 80, 100)[0])
        assert 80 * score <= 100 * n and 80 * score > 100 * (n - 1)


def test_heaps_merge_like_a_sort():
    rng = np.random.default_rng(2)
    scores, heaps = rng.integers(0, 6, (7, 40)), H.Heaps.empty(7, 4)
    for at in range(0, 40, 9):
        heaps.add(scores[:, at:at + 9], np.arange(at, min(at + 9, 40)))
    for q in range(7):
        assert heaps.ids[q].tolist() == sorted(range(40), key=lambda i: (-scores[q, i], i))[:4]


@pytest.mark.parametrize("sizes", [{}, {"ANCHORS": 2, "GROUP": 2, "TILE": 16, "LEAF": 4}])
def test_against_all_pairs(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(H, name, value)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-0.2, 1.0) for _ in range(7)], rng.randrange(3)) for i in range(420)]
    rows += [(i, rows[5][1], i % 3) for i in range(420, 500)]  # a third with one vector: ties
    frame = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], SCHEMA).repartition(5)
    want = plain(rows, every=60)
    assert want and mined(frame, every=60) == want


def test_registered_query_on_generated_rows(spark):
    from docmill.llm.registry import queries

    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None and r.label is not None]
    got = queries()["op11_hard_negatives"](spark, sf)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_rows_that_take_no_part(spark):
    rows = [(i, [1.0, i / 50], i % 2) for i in range(20)]
    odd = [(100, None, 0), (200, [1.0, None], 0), (300, [float("nan"), 1.0], 0), (400, [1.0, float("-inf")], 0), (500, [1.0, 1.0], None),
           (None, [1.0, 1.0], 0), (600, [1.0], 0), (700, [], 0), (800, [1e300, 1.0], 0)]
    frame = spark.createDataFrame([(*r, "x", "y", 0) for r in rows + odd + rows[:3]], SCHEMA)
    assert mined(frame, every=10) == plain(rows, every=10)


def test_repeated_ids(spark):
    """An id is one row: the least label, then the least vector."""
    rows = [(0, [1.0, 1.0], 0), (1, [1.0, 0.5], 0), (2, [1.0, 0.25], 1), (3, [0.9, 0.5], 1)]
    more = [(1, [1.0, 0.75], 0), (1, [9.0, 9.0], 1), (0, [1.0, 1.5], 0)] * 40
    frame = spark.createDataFrame([(*r, "x", "y", 0) for r in rows + more], SCHEMA).repartition(4)
    assert mined(frame) == plain(rows)


def test_nothing_to_mine(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, [1.0], 0, "x", "y", 0)], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, [1.0], 0, "x", "y", 0), (101, [1.0], 0, "x", "y", 0)], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, [1.0], 0, "x", "y", 0), (101, [1.0], 1, "x", "y", 0)], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, [-1.0], 0, "x", "y", 0), (1, [1.0], 0, "x", "y", 0), (2, [1.0], 1, "x", "y", 0)], SCHEMA)) == []
