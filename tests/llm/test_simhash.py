"""SimHash components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docmill.llm import simhash as S
from docmill.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{i: smallest index reachable} over fingerprints by all pairs."""
    values = np.array(prints, np.uint64)
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= 4):
            a, b = root(i), root(i + 1 + int(j))
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def plain(rows):
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    prints = [plain_fingerprint(r.text) for r in rows]
    return sorted((repr(r.doc_id), f"{p:016x}", repr(rows[c].doc_id)) for r, p, c in zip(rows, prints, plain_components(prints), strict=True))


def found(docs):
    return sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in S.digest(docs).collect())


@pytest.mark.parametrize("name", ["awkward", "sample"])
def test_tables(name, request):
    docs = request.getfixturevalue(name)
    assert found(docs) == plain(docs.collect())


def test_spark_has_the_same_hash(spark):
    text = "un été à la plage"
    own = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert own % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


def test_links_of_a_dense_cloud(spark):
    rng = random.Random(0)
    values = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(values)[:3] + [0]:
        for _ in range(400):  # chains and balls around a few centres
            centre = centre ^ (1 << rng.randrange(64)) if rng.random() < 0.2 else centre
            value = centre
            for _ in range(rng.randrange(7)):
                value ^= 1 << rng.randrange(64)
            values.add(value)
    ordered = sorted(values, key=lambda v: v - (1 << 64) if v >> 63 else v)  # as signed longs sort
    signed = [v - (1 << 64) if v >> 63 else v for v in ordered]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    got = {r.node: r.component for r in components(S.links(frame)).collect()}
    want = plain_components(ordered)
    groups, own = {}, {}
    for i, c in enumerate(want):
        groups.setdefault(c, set()).add(signed[i])
        own.setdefault(got.get(signed[i], signed[i]), set()).add(signed[i])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_chain_filter_loses_no_pair():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 20000).astype(np.uint64) * np.uint64(2)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b)).astype(np.uint64)
    assert np.any([S.chained(a, b, k) for k in range(5)], axis=0).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert {got.get(i, i) for i in range(201)} == {0} and got[501] == 500


def test_one_document_of_each_group_stays(awkward, nothing):
    kept = S.keep_first(awkward)
    assert kept.columns == awkward.columns
    by_doc = {r.doc_id: r for r in S.near_duplicates(awkward).collect()}
    want = sorted({r.component_id for r in by_doc.values()})
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert S.digest(nothing).count() == 0 and S.keep_first(nothing).count() == 0


def test_unnumbered_and_shared_ids_lose_no_component(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (9, texts[2]), (4, texts[3]), (4, texts[4]), (4, texts[4])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(None, texts[0]), (None, texts[1]), (9, texts[2]), (4, texts[3]), (4, texts[4])]
    assert sorted(map(repr, map(tuple, S.keep_first(frame).collect()))) == sorted(map(repr, want))
