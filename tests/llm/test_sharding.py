"""Karmarkar-Karp shards: whole groups, gapless slots, near-equal bytes."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docmill.llm import sharding


def plain_difference(sizes, k):
    """Differencing with whole member lists."""
    tuples = [[(s, [i])] + [(0, [])] * (k - 1) for i, s in enumerate(sizes)]
    while len(tuples) > 1:
        tuples.sort(key=lambda t: t[0][0] - t[-1][0])
        a, b = tuples.pop(), tuples.pop()
        tuples.append(sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda x: -x[0]))
    return sorted(x[0] for x in tuples[0]) if tuples else []


@pytest.mark.parametrize(("n", "k"), [(1, 3), (2, 3), (40, 4), (200, 7)])
def test_same_sums_as_plain_differencing(n, k):
    sizes = np.random.default_rng(n).integers(1, 10**9, n).astype(float)
    first = np.zeros((n, k))
    first[:, 0] = sizes
    parts = sharding.difference(list(first), k)
    assert all(sorted(p) == list(range(k)) for p in parts.tolist())
    sums = np.bincount(parts[:, 0], weights=sizes, minlength=k)
    want = plain_difference(sizes.tolist(), k)
    assert max(sums) - min(sums) == pytest.approx(want[-1] - want[0])


def checked(docs, **options):
    rows, out = docs.collect(), sharding.shard_by_bytes(docs, **options).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
    texts = defaultdict(set)
    crc = {zlib.crc32((r.text or "").encode()): r.text or "" for r in rows}
    slots = defaultdict(list)
    for r in out:
        texts[crc[r.text_crc32]].add(r.shard)
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < options.get("shards", 40)
    assert all(len(s) == 1 for s in texts.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return out


def loads(out, shards):
    return np.bincount([r.shard for r in out], weights=[r.size for r in out], minlength=shards)


def test_awkward_and_empty(awkward, nothing):
    checked(awkward)
    assert sharding.shard_by_bytes(nothing).count() == 0


def test_several_blocks_and_levels(sample, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", 20)
    monkeypatch.setattr(sharding, "BLOCK_TUPLES", 2)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 16)
    out = checked(sample, shards=4)
    sums = loads(out, 4)
    assert sums.max() - sums.min() < 0.02 * sums.mean()


def test_near_equal_bytes(sample):
    sums = loads(checked(sample, shards=8), 8)
    assert sums.max() - sums.min() < 0.01 * sums.mean()
