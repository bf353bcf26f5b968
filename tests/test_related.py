"""Related quotes against all pairs, in small passes and shards."""

import random

import pytest

from docmill.operators import benchmark as bm


def plain(rows, top, threshold):
    """{(id, other, rank)} over all pairs; rows are (path, line, words)."""
    named = [(f"{p}#{n:06d}", p, frozenset(w for w in ws if len(w) >= 5)) for p, n, ws in rows]
    out = set()
    for i, path, own in named:
        scored = sorted((-round(len(own & o) / len(own | o), 6), j) for j, q, o in named
                        if q != path and own & o and len(own & o) >= threshold * len(own | o))
        out |= {(i, j, r, -s) for r, (s, j) in enumerate(scored[:top], 1)}
    return out


@pytest.mark.parametrize("top, threshold", [(2, 0.12), (1, 0.5), (3, 0.05)])
def test_against_all_pairs(spark, monkeypatch, top, threshold):
    monkeypatch.setattr(bm, "PASS_SETS", 17)
    monkeypatch.setattr(bm, "SHARD_SETS", 11)
    rng = random.Random(top)
    words = [f"word{i:02d}" for i in range(30)] + ["an", "of"]
    rows = [(f"s{rng.randrange(9)}", i, rng.sample(words, rng.randrange(1, 9))) for i in range(160)]
    # copies: one source repeats a quote often, and one quote is in every source
    rows += [("s0", 200 + i, words[:5]) for i in range(12)] + [(f"s{i}", 300 + i, words[3:9]) for i in range(9)]
    frame = spark.createDataFrame([(p, n, " ".join(ws)) for p, n, ws in rows], "source_path string, line_start int, quote string").repartition(4)
    got = {(r.id, r.other, r["rank"], r.overlap) for r in bm.related_sources(frame, top, threshold).collect()}
    assert got == plain([r for r in rows if any(len(w) >= 5 for w in r[2])], top, threshold)


def test_sufficient_serves_every_source_left_out():
    rng = random.Random(1)
    for _ in range(300):
        top = rng.randrange(1, 4)
        quotes = sorted({(-rng.randrange(5) / 5, f"q{i}", f"p{rng.randrange(4)}") for i in range(rng.randrange(1, 25))})
        kept = bm.sufficient(quotes, top)
        assert len(kept) <= top * (top + 1)
        for path in ["p0", "p1", "p2", "p3", "none"]:
            assert [q for q in quotes if q[2] != path][:top] == [q for q in kept if q[2] != path][:top]


def test_a_source_of_later_copies_only_still_asks(spark):
    rows = [(f"s{i}", 1, ["first", "second", "third"]) for i in range(6)] + [("t", 1, ["first", "second", "other"])]
    frame = spark.createDataFrame([(p, n, " ".join(ws)) for p, n, ws in rows], "source_path string, line_start int, quote string")
    got = {(r.id, r.other, r["rank"], r.overlap) for r in bm.related_sources(frame).collect()}
    assert got == plain(rows, 2, 0.12)


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("threshold", [0.12, 0.4, 1.0])
def test_only_pairs_that_may_arrive_are_counted_in_full(monkeypatch, threshold, own):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(bm, "CLASS_SETS", 150)
    monkeypatch.setattr(bm, "CLASS_ASKING", 40)
    monkeypatch.setattr(bm, "MEETINGS", 500)
    rng = np.random.default_rng(3)
    sets = [sorted({int(c) for c in 3000 - np.minimum(rng.zipf(1.3, rng.integers(1, 40)), 2999)}) for _ in range(900)]
    extra = rng.integers(0, 4, len(sets))  # tokens of one set only
    rows = pa.table({"sid": pa.array(range(900), pa.int64()), "n": pa.array([len(s) + int(e) for s, e in zip(sets, extra)], pa.int64()),
                     "codes": pa.array(sets, pa.list_(pa.int32())),
                     "offers": pa.array([[{"place": i, "source": i}] for i in range(900)]), "own": pa.array([own] * 900)})
    block, full = bm._Block(rows, threshold), []
    best = block._best
    monkeypatch.setattr(block, "_best", lambda asking, x, y, top: (full.append(len(x)), best(asking, x, y, top))[1])
    found = block.offered(rows.combine_chunks().to_batches()[0], 900).to_pylist()
    want = set()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            common = len(set(a) & set(b))
            union = len(a) + len(b) + int(extra[i] + extra[j]) - common
            if i != j and common and common >= threshold * union:
                want.add((i, j, round(common / union, 6)))
    assert {(r["sid"], r["place"], round(r["overlap"], 6)) for r in found} == want
    assert sum(full) <= 3 * len(want) + 900  # the former code made a dense pass over all 810,000 pairs


def test_quotes_and_tokens_are_cut_once(spark):
    """Each condition on a quote stripped its line again, and each use of its tokens cut it again."""
    docs = spark.createDataFrame([("p", "p/1.md", "| the " + "x" * 90 + "\n" + " the " + "policy " * 20 + " \nthe short\n" + "the " * 30)], "provider string, source_path string, text string")
    lines = bm.candidate_lines(docs, "the", "ist")
    sets = bm._token_sets(lines)
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("+$") == 1 and plan.count("{L}") == 1
    assert [(r.line_start, r.quote) for r in lines.orderBy("line_start").collect()] == [(2, "the " + ("policy " * 20).strip()), (4, ("the " * 30).strip())]
    assert [(r.id, r.path, r.tokens) for r in sets.collect()] == [("p/1.md#000002", "p/1.md", ["policy"])]
