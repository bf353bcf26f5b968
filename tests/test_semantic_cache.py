"""Semantic chunking on cached vectors against the uncached method."""

import numpy as np
import pytest

from docmill.functions.text import strip_marks
from docmill.operators import embedding as em
from docmill.operators.chunking import strategies as st
from docmill.operators.embedding import ngram_vector
from docmill.sources.index import VersionedTable

WORDS = "premium claim hospital age fee bonus term rider policy cover".split()


def text_of(seed, sentences=14):
    return " ".join(" ".join(WORDS[(seed * 7 + i * i + j) % len(WORDS)] for j in range(4 + (seed + i) % 5)).capitalize() + "." for i in range(sentences))


DOCS = [(f"a/{i}.md", "a", text_of(i)) for i in range(6)] + [("b/copy.md", "b", text_of(0)), ("b/one.md", "b", "Just one."), ("b/e.md", "b", "")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "source_path string, provider string, text string").repartition(3)


def embed(texts):
    if any("Bonus" in t for t in texts):
        raise RuntimeError("no vector")
    return [ngram_vector(t) for t in texts]


def good(texts):
    return [ngram_vector(t) for t in texts]


def rows(df):
    return sorted((r.source_path, r.chunk_index, r.text) for r in df.collect())


def test_cached_equals_uncached_and_embeds_distinct_windows_once(spark, docs, tmp_path):
    cache = VersionedTable(spark, str(tmp_path / "cache"))
    want = rows(st.semantic_embedding(docs, 0.6, 40))
    assert len(want) > 12

    def run(part):
        return rows(st.semantic_cached(part, cache, good, "ngram", 0.6, 40, prepare=lambda w: st.F.transform(w, strip_marks)))
    half = docs.filter("provider = 'a'")
    assert run(half) == [r for r in want if r[0].startswith("a/")]
    first = cache.read().count()
    windows = half.select(st.F.explode(st.neighbour_windows(st.F.split("text", st.SENTENCE, -1))).alias("w")).distinct().count()
    assert first == windows  # equal windows of different documents have one row
    assert run(docs) == want
    assert cache.read().filter("batch = 2").count() == 2  # the two short texts; the copy has nothing new
    assert run(docs) == want and cache.read().filter("batch = 3").count() == 0


def test_failed_windows_take_their_document_to_the_fallback(spark, docs, tmp_path):
    cache = VersionedTable(spark, str(tmp_path / "cache"))
    want = rows(st.semantic_embedding(docs, 0.6, 40))
    broken = {d[0] for d in DOCS if "Bonus" in d[2]}
    assert broken and len(broken) < len(DOCS)
    fold = lambda w: w  # noqa: E731 - the failing word must stay as it is
    plain = rows(st.semantic_cached(docs, cache, embed, "ngram", 0.6, 40, good, fold))
    alone = rows(st.semantic_cached(docs, cache, embed, "ngram", 0.6, 40, None, fold))
    assert {r[0] for r in plain} == {r[0] for r in want}
    assert [r for r in alone if r[0] in broken] == sorted((d[0], 0, d[2]) for d in DOCS if d[0] in broken)
    assert [r for r in plain if r[0] not in broken] == [r for r in alone if r[0] not in broken]
    # a failure is tried again, and mends the cache
    mended = rows(st.semantic_cached(docs, cache, good, "ngram", 0.6, 40, None, fold))
    assert mended == plain


def test_neighbours_are_measured_where_they_are_embedded(spark, tmp_path):
    cache = VersionedTable(spark, str(tmp_path / "cache"))
    own = [(f"a/{i}.md", "a", " ".join(f"Sentence{i}x{j} of policy {WORDS[j % 10]}." for j in range(100 + i))) for i in range(3)]
    frame = spark.createDataFrame(own, "source_path string, provider string, text string")
    st.semantic_cached(frame, cache, good, "ngram", 0.6, 40, prepare=lambda w: st.F.transform(w, strip_marks))
    kept = cache.read()
    measured = kept.filter("apart IS NOT NULL")
    assert measured.count() == 99 + 100 + 101  # over slices of 64: no vector has to be moved
    by_key = {r.vector_key: r.embedding for r in kept.collect()}
    for r in measured.collect():
        assert r.apart == 1 - (np.asarray([by_key[r.prev_key]]) * np.asarray([by_key[r.vector_key]])).sum(axis=1)[0]


def test_texts_of_a_batch_have_the_vectors_of_each(monkeypatch):
    texts = ["", " ", "a", "ab", "a b", "ab cd  efg\n hij", "đường ß bcd 漢字漢字漢 xyz", "\x1c a\x00b c", *(text_of(i) for i in range(9))]
    for chars in (1, 50, 1 << 16):
        monkeypatch.setattr(em, "VECTOR_CHARS", chars)
        assert (em.ngram_vectors(texts) == np.array([ngram_vector(t) for t in texts])).all()
    assert em.ngram_vectors([]).shape == (0, 512)


def test_vectors_of_odd_lengths_and_failures_keep_their_rows(spark):
    def odd(texts):
        if "bad" in texts:
            raise ValueError("no vector")
        return [[1.0] * len(t) for t in texts]
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(["a", "bad", "abc", ""])], "vector_key string, text string").coalesce(1)
    got = {r.vector_key: (r.embedding, r.error) for r in em.embedded(frame, odd).collect()}
    assert got == {"0": ([1.0], None), "1": (None, "ValueError: no vector"), "2": ([1.0] * 3, None), "3": ([], None)}


def test_packed_vectors_keep_every_bit(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = {"counts": np.array([0.0, 3.0, 1.0, 1.0] * 40) / 7.1, "signs": np.array([0.0, -0.0, 1e-300, -1.5] * 9), "dense": rng.normal(size=64),
               "many": np.repeat(rng.normal(size=95), 3), "most": np.repeat(rng.normal(size=90), 2), "empty": np.zeros(0), "zeros": np.zeros(512)}
    frame = spark.createDataFrame([(k, k, None) for k in vectors] + [("bad", "bad", None)], "vector_key string, text string, prev_key string").coalesce(1)

    def give(texts):
        return [vectors[t] for t in texts]  # a KeyError for the unknown one
    cache = VersionedTable(spark, str(tmp_path / "cache"))
    cache.write(em.embedded(frame, give))
    got = {r.vector_key: r.embedding for r in cache.read().collect()}
    assert got.pop("bad") is None and {k: np.array(v).tobytes() for k, v in got.items()} == {k: v.tobytes() for k, v in vectors.items()}
    kept = {r.vector_key: r.codes is not None for r in cache.read(packed=True).collect()}
    assert {k for k, packed in kept.items() if packed} == {"counts", "signs", "most", "zeros"}
    cache.compact(cache.read().drop("batch"))  # vectors as they were kept before
    assert {r.vector_key: r.embedding for r in cache.read().collect()} == got | {"bad": None}


def test_windows_of_several_documents_take_their_vectors_from_the_cache(spark, docs, tmp_path):
    cache = VersionedTable(spark, str(tmp_path / "cache"))
    fold = {"prepare": lambda w: st.F.transform(w, strip_marks)}
    st.semantic_cached(docs, cache, good, "ngram", 0.6, 40, **fold)
    stored = cache.read()
    # sentences of two documents in turn: neighbours that no document had
    pieces = [text_of(i).split(". ") for i in (1, 2)]
    mixed = ". ".join(x for pair in zip(*pieces, strict=True) for x in pair)
    more = spark.createDataFrame([("c/mixed.md", "c", mixed), ("c/again.md", "c", text_of(1))], docs.schema)
    both = docs.unionByName(more)
    want = rows(st.semantic_embedding(both, 0.6, 40))
    assert rows(st.semantic_cached(both, cache, good, "ngram", 0.6, 40, **fold)) == want
    # the same from a cache that keeps no distances, as one of before
    old = VersionedTable(spark, str(tmp_path / "old"))
    old.write(stored.select("vector_key", "embedding", "error"))
    assert rows(st.semantic_cached(both, old, good, "ngram", 0.6, 40, **fold)) == want
