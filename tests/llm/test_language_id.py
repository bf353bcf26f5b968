"""Language filters against plain sets of n-grams, and held-out accuracy."""

import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docmill.llm import language_id as L

from .conftest import awkward_rows

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, score string, lang_pred int, gram string"


def plain_grams(text):
    """N-grams of 3 and 4 characters without an inner space."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    joined = re.sub(" +", " ", f" {kept} ")
    return [joined[i:i + n] for n in L.LENGTHS for i in range(len(joined) - n + 1) if " " not in joined[i + 1:i + n - 1]]


def plain_sets(rows):
    """{language: n-grams it contains} of (text, lang) rows."""
    of, docs = Counter(lang for _, lang in rows), defaultdict(Counter)
    for text, lang in rows:
        docs[lang].update(set(plain_grams(text)))
    share = {lang: {g: c / of[lang] for g, c in own.items() if c / of[lang] >= L.LEAST_SHARE} for lang, own in docs.items()}
    most = Counter()
    for own in share.values():
        for g, s in own.items():
            most[g] = max(most[g], s)
    return {lang: {g for g, s in own.items() if s >= most[g] * L.LEAST_PART} for lang, own in share.items()}


def hashes(texts):
    """The hash of each n-gram: a text gives its 3-grams first, then its 4-grams."""
    out = {}
    for text in texts:
        for g, h in zip(sorted(plain_grams(text), key=len), np.concatenate(list(L.grams(text))).tolist(), strict=True):
            assert out.setdefault(g, h) == h
    return out


def made(n, seed):
    rng = random.Random(seed)
    alphabet = {"aa": "abcdef", "bb": "defghi", "cc": "ghijkañ"}
    return [(" ".join("".join(rng.choices(alphabet[lang], k=rng.randrange(1, 8))) for _ in range(rng.randrange(1, 40))).title() + "! 12", lang)
            for lang in rng.choices(list(alphabet), [5, 3, 2], k=n)]


@pytest.mark.parametrize("sliced", [1 << 18, 7])
def test_grams_of_a_text(monkeypatch, sliced):
    monkeypatch.setattr(L, "SLICE", sliced)
    texts = [t for t, _ in made(30, 1)] + ["", "a", "ab", "Straße, naïve—é́", "x" * 50, "12 34"]
    for text in texts:
        found = np.concatenate(list(L.grams(text)))
        assert len(found) == len(plain_grams(text))
        assert len(np.unique(found)) == len(set(plain_grams(text)))
    cut = np.concatenate(list(L.grams(texts[0])))
    monkeypatch.setattr(L, "SLICE", 1 << 18)
    assert np.sort(cut).tolist() == np.sort(np.concatenate(list(L.grams(texts[0])))).tolist()


def test_filters_contain_exactly_the_chosen_grams(spark, monkeypatch):
    monkeypatch.setattr(L, "COUNTED", 300)
    rows = made(300, 2)
    model = L.fit(spark.createDataFrame([(i, t, lang, "s", 0, "g") for i, (t, lang) in enumerate(rows)], DOCS).repartition(4))
    sets, known = plain_sets(rows), hashes([t for t, _ in rows])
    assert model.languages == [lang for lang, _ in Counter(lang for _, lang in rows).most_common()]
    grams = sorted(known)
    masks = model.containing(np.array([known[g] for g in grams], np.uint64))[:, 0]
    extra = 0
    for i, lang in enumerate(model.languages):
        bits = (masks >> np.uint64(i)) & np.uint64(1)
        has = np.array([g in sets[lang] for g in grams])
        assert bits[has].all()  # a Bloom filter misses nothing
        extra += int(bits[~has].sum())
    assert extra < 5
    # and the decision is the largest count over the sets
    for text, _ in made(60, 3):
        counts = [sum(g in sets[lang] for g in plain_grams(text)) for lang in model.languages]
        if sorted(counts)[-1] > sorted(counts)[-2]:
            assert model.predict(text)[0] == model.languages[int(np.argmax(counts))]


def test_false_hits_are_corrected():
    """A language whose slice is nearly full has most n-grams by chance and does not win by them."""
    rng = np.random.default_rng(0)
    masks = np.zeros((1 << L.PLACES_LOG, 1), np.uint64)
    masks[rng.random(len(masks)) < 0.95, 0] |= np.uint64(1)
    own = np.concatenate(list(L.grams("weder noch dieses wort gehört dazu")))
    some = own[: len(own) * 9 // 10]
    for i in range(L.HASHES):
        masks[((some >> np.uint64(L.PLACES_LOG * i)) & np.uint64((1 << L.PLACES_LOG) - 1)).astype(int), 0] |= np.uint64(2)
    model = L.Filters(["full", "true"], masks)
    hits = model.hits(own)
    assert hits[1] == len(some) and model.false_rate[0] > 0.8 and model.predict("weder noch dieses wort gehört dazu")[0] == "true"


def test_more_than_64_languages(spark):
    rows = [(i, f"{chr(0x4E00 + 40 * lang)}{chr(0x4E01 + 40 * lang)}{chr(0x4E02 + 40 * lang)}", f"l{lang:03d}", "s", 0, "g")
            for i, lang in enumerate([*range(150)] * 2)]
    docs = spark.createDataFrame(rows, DOCS)
    got = L.predict(docs, L.fit(docs)).select("lang", "lang_pred", "score").collect()
    assert len(got) == 300 and all(r.lang == r.lang_pred and r.score > 0.9 for r in got)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    scored = [r for r in held if r.lang is not None and re.search(r"[^\W\d_]", r.text or "")]
    assert sum(r.lang == r.lang_pred for r in scored) >= 0.99 * len(scored) > 0
    assert all(0 <= r.score <= 1 for r in rows)


def test_the_label_is_no_input(spark):
    rows = made(200, 4)
    docs = spark.createDataFrame([(i, t, lang, "s", 0, "g") for i, (t, lang) in enumerate(rows)], DOCS)
    model = L.fit(docs)
    one = L.predict(docs, model).select("doc_id", "lang_pred", "score").collect()
    two = L.predict(docs.drop("lang"), model).select("doc_id", "lang_pred", "score").collect()
    assert sorted(one) == sorted(two)


def test_awkward_documents(spark, awkward):
    got = L.identify(awkward).collect()
    assert len(got) == len(awkward_rows())
    by_text = {r[0]: r[1] for r in awkward_rows()}
    for r in got:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", by_text[r.doc_id] or ""))
            assert r.lang_pred != "und" or r.score == 0


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "abc def", None)] * 3, [(None, "12", "en")], [(1, "abc", "en")] * 2])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame([(i, t, lang, "s", 0, "g") for i, t, lang in rows], DOCS)
    got = L.identify(docs).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got} <= ({lang for _, _, lang in rows if lang} | {"und"})
