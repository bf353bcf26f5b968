"""Containment join against every (text, pattern) pair."""

import random

import pytest

from docmill.operators import containment as C


def plain(texts, patterns):
    out = []
    for i, text in texts:
        for j, p in patterns:
            at = [k for k in range(len(text or "")) if p and (text or "").startswith(p, k)]
            if at:
                out.append((i, j, len(at), at[0]))
    return sorted(out, key=str)


def joined(spark, texts, patterns):
    t = spark.createDataFrame(texts, "id string, body string").repartition(3)
    p = spark.createDataFrame(patterns, "pid int, word string")
    return sorted((tuple(r) for r in C.contained(t, p, "id", "body", "pid", "word").collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"PATTERNS": 3, "PATTERN_CHARS": 6}])
def test_against_all_pairs(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(C, name, value)
    rng = random.Random(1)
    texts = [(f"t{i}", "".join(rng.choices("abé ", k=rng.randrange(0, 60)))) for i in range(60)]
    texts += [("null", None), ("empty", ""), ("twice", "abab"), ("twice", "abab"), ("long", "ab" * 5000), (None, "é"), ("wide", "😀a😀é")]
    patterns = [(i, "".join(rng.choices("abé", k=rng.randrange(1, 5)))) for i in range(25)]
    patterns += [(100, None), (101, ""), (102, "aba"), (103, "aba"), (None, "b"), (104, "😀é"), (105, "abababababababab")]
    assert joined(spark, texts, patterns) == plain(texts, patterns)


def test_nothing(spark):
    assert joined(spark, [("a", "b")], [(1, None)]) == joined(spark, [], [(1, "b")]) == joined(spark, [("a", "b")], []) == []


def test_no_nested_loop(spark, capsys):
    t = spark.createDataFrame([("a", "xyz")], "id string, body string")
    p = spark.createDataFrame([(1, "y")], "pid int, word string")
    C.contained(t, p, "id", "body", "pid", "word").explain("simple")
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
