"""Conflict-constrained best fit against a plain search, and whole documents."""

from collections import defaultdict

import numpy as np
import pytest

from docmill.llm import packing


def plain(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        fits = [b for b in bins if b["left"] >= size and source not in b["s"] and (cluster < 0 or cluster not in b["c"])]
        best = min(fits, key=lambda b: b["left"], default=None)
        if best is None:
            best = {"left": capacity, "s": set(), "c": set()}
            bins.append(best)
        out.append(best["left"])
        best["left"] -= size
        best["s"].add(source)
        if cluster >= 0:
            best["c"].add(cluster)
    return out, len(bins)


@pytest.mark.parametrize("sources", [3, 20, 200])
def test_tightest_compatible_bin(sources):
    rng = np.random.default_rng(sources)
    sizes = np.sort(rng.integers(1, 500, 1500))[::-1].copy()
    own, clusters = rng.integers(0, sources, 1500), rng.integers(-1, 90, 1500)
    bins, offsets = packing.pack_block(sizes, own, clusters, 1000)
    left, opened = plain(sizes.tolist(), own.tolist(), clusters.tolist(), 1000)
    # equally tight bins are interchangeable: the same room is used at every step
    assert (1000 - offsets).tolist() == left and bins.max() + 1 == opened


def checked(docs, capacity=packing.CAPACITY):
    rows, out = docs.collect(), packing.pack(docs, capacity).collect()
    want = sorted((repr(r.doc_id), len((r.text or "").encode().split())) for r in rows)
    per_row, bins = defaultdict(int), defaultdict(list)
    for r in out:
        per_row[repr(r.doc_id), r.piece] += 1
        assert (r.bin is None) == (r.n_words == 0)
        if r.bin is not None:
            bins[r.bin].append(r)
    assert sum(r.n_words for r in out) == sum(n for _, n in want)
    assert sorted(repr(r.doc_id) for r in out if r.piece == 0) == sorted(d for d, _ in want)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.n_words
        assert at <= capacity
        assert len({r.source for r in own}) == len(own)
        # copies never share a bin: neither a repeated row nor another text's copy
        assert len({(r.doc_id, r.first_word) for r in own}) == len(own)
    return out


def test_awkward(awkward, nothing):
    out = checked(awkward)
    assert len({r.bin for r in out if r.doc_id in (13, 14)}) == 2
    assert packing.pack(nothing).count() == 0


def test_generated(sample, monkeypatch):
    checked(sample)
    monkeypatch.setattr(packing, "BLOCK_PIECES", 64)
    checked(sample, 300)
