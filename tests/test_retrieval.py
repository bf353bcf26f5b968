import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import embedding as em
from docmill.operators import evidence as evd
from docmill.operators import retrieval as rt

TEXTS = {1: "điều trị nội trú bệnh viện", 2: "điều trị ngoại trú phòng khám khám bệnh",
         3: "phí bảo hiểm năm phí", 4: "bệnh viện quốc tế bệnh viện", 5: "the the the plan"}
QUERIES = {10: "bệnh viện nội trú", 11: "phí khám", 12: "unknown words"}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, v, "aia" if k % 2 else "bic") for k, v in TEXTS.items()]
    return spark.createDataFrame(rows, "chunk_id INT, text STRING, company_code STRING")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(QUERIES.items()), "query_id INT, query STRING")


def plain(text):
    import unicodedata

    folded = unicodedata.normalize("NFD", text.lower().replace("đ", "d"))
    return "".join(c for c in folded if not unicodedata.combining(c))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_dense_matches_matrix_product(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 8))
    base[7] = base[3]
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)],
                                  "chunk_id INT, embedding ARRAY<DOUBLE>").repartition(5)
    asked = items.filter("chunk_id < 9").withColumnRenamed("chunk_id", "query_id")
    want = []
    for q in range(9):
        scores = np.round(base @ base[q], 6)
        order = sorted(range(300), key=lambda j: (-scores[j], j))[:5]
        want += [(q, j, r) for r, j in enumerate(order, 1)]
    for block, tile in ((512, 2048), (2, 7)):  # one block and tile, then many in several passes
        monkeypatch.setattr(rt, "QUERY_BLOCK", block)
        monkeypatch.setattr(rt, "TILE_ROWS", tile)
        monkeypatch.setattr(rt, "PASS_BLOCKS", 2)
        got = rt.dense_topk(asked, items, 5)
        assert rows(got, "query_id", "chunk_id", "rank") == sorted(want)


def test_bm25_matches_formula(corpus, queries):
    docs = {k: [w for w in re.split("[^a-z0-9]+", plain(t)) if w] for k, t in TEXTS.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    want = []
    for q, text in QUERIES.items():
        scored = {}
        for term in set(plain(text).split()):
            df = sum(term in d for d in docs.values())
            for k, d in docs.items():
                tf = d.count(term)
                if tf:
                    idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                    scored[k] = scored.get(k, 0) + idf * tf * 2.2 / (
                        tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        order = sorted(scored, key=lambda k: (-round(scored[k], 6), k))[:3]
        want += [(q, k, round(scored[k], 6)) for k in order]
    assert rows(rt.bm25_topk(queries, corpus, 3), "query_id", "chunk_id", "score") == sorted(want)


def test_tfidf_matches_formula(corpus, queries):
    def grams(text):
        ws = re.findall(r"\b\w\w+\b", plain(text))
        return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]
    docs = {k: grams(t) for k, t in TEXTS.items()}
    n = len(docs)

    def vector(terms):
        v = {t: (1 + math.log(terms.count(t))) * (math.log((1 + n) / (1 + sum(
            t in d for d in docs.values()))) + 1)
            for t in set(terms) if any(t in d for d in docs.values())}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}
    want = []
    for q, text in QUERIES.items():
        mine = vector(grams(text)) if any(t in d for d in docs.values() for t in grams(text)) else {}
        scored = {k: round(sum(mine.get(t, 0) * x for t, x in vector(d).items()), 6)
                  for k, d in docs.items()}
        order = sorted((k for k in scored if scored[k] > 0), key=lambda k: (-scored[k], k))[:2]
        want += [(q, k, scored[k]) for k in order]
    assert rows(rt.tfidf_topk(queries, corpus, 2), "query_id", "chunk_id", "score") == sorted(want)


def test_fusion_adds_reciprocal_ranks(spark):
    a = spark.createDataFrame([(1, 7, 1, .9), (1, 8, 2, .8)],
                              "query_id INT, chunk_id INT, rank INT, score DOUBLE")
    b = spark.createDataFrame([(1, 8, 1, 3.), (1, 9, 2, 2.)],
                              "query_id INT, chunk_id INT, rank INT, score DOUBLE")
    got = rt.fuse({"dense": a, "sparse": b}, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [8, 7, 9]
    assert got[0].score == round(1 / 61 + 1 / 62, 6)
    assert (got[0].dense_score, got[0].sparse_score, got[2].dense_score) == (.8, 3., None)


def test_filters_and_request_checks(corpus, queries):
    kept = rt.HardFilters(company_code=["aia"]).apply(corpus)
    assert rows(kept, "chunk_id") == [(1,), (3,), (5,)]
    assert rt.HardFilters().predicate() is None
    for bad in (("", ["x"], 1, 2), ("q", [], 1, 2), ("q", ["x"], 5, 2), ("q", ["x"], 0, 2)):
        with pytest.raises(ValueError):
            rt.check_request(bad[0], rt.HardFilters(company_code=bad[1]), bad[2], bad[3])
    with pytest.raises(ValueError, match="Dense"):
        rt.hybrid_topk(queries, corpus, 3)
    assert rt.readiness(corpus)[0] == "dense vectors missing"


def test_rerank_orders_and_normalises(spark):
    found = spark.createDataFrame(
        [(1, "q", "a", 1, 2.0), (1, "q", "b", 2, 5.0), (1, "q", "c", 3, 5.0),
         (2, "q", "d", 1, 0.5), (2, "q", "e", 2, float("nan"))],
        "query_id INT, query STRING, text STRING, rank INT, s DOUBLE")
    got = rt.rerank(found, lambda q, t: F.col("s"), 2).orderBy("query_id", "rerank_rank").collect()
    assert [(r.text, r.rerank_rank) for r in got] == [("b", 1), ("c", 2), ("d", 1), ("e", 2)]
    assert got[0].rerank_score == round(1 / (1 + math.exp(-5)), 6) and got[2].rerank_score == 0.5
    with pytest.raises(ValueError):
        rt.rerank(found, k=0)


def test_hash_embedding_matches_digest(one):
    import hashlib

    vector = [0.0] * 128
    for term in ["dieu", "tri", "dieu"]:
        digest = hashlib.sha256(term.encode()).digest()
        vector[int.from_bytes(digest[:4], "big") % 128] += 1 if digest[4] % 2 == 0 else -1
    norm = math.sqrt(sum(x * x for x in vector))
    got = one(em.term_hash_embedding(F.array(*[F.lit(t) for t in ("dieu", "tri", "dieu")])))
    assert np.allclose(got, [x / norm for x in vector])


def test_ngram_vectors():
    assert em._murmur3(b"") == 0 and em._murmur3(b"hello") == 613153351
    v = em.ngram_vector("abc abc")
    assert abs(np.linalg.norm(v) - 1) < 1e-9 and not em.ngram_vector("").any()


def test_embedding_cache(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id INT, text STRING")
    empty = spark.createDataFrame([], "cache_key STRING, embedding ARRAY<FLOAT>, dimensions INT")
    out, fresh = em.embed_with_cache(items, empty, em.ngram_embedding, "p", "m", "document")
    assert out.count() == 3 and fresh.count() == 2
    full = fresh.withColumn("dimensions", F.when(F.size("embedding") > 0, 512))
    stats = em.cache_statistics(items, full, "p", "m", "document").first()
    assert (stats.hits, stats.misses, stats.stale) == (3, 0, 0)
    assert em.cache_statistics(items, full, "p", "m", "query").first().misses == 3


def evidence_rows(spark, *items):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(items)],
                                 "ord INT, source_type STRING, source_id STRING, content STRING")


def test_merge_keeps_first_and_reports_conflicts(spark):
    rows_ = evidence_rows(spark, ("sql", "1", "a"), ("sql", "1", "a"), ("doc", "2", "b"),
                          ("doc", "price_1", "5M"), ("sql", "price_1", "6M"),
                          ("sql", "price_1", "5M"))
    kept, conflicts = evd.merge(rows_)
    assert sorted(r.ord for r in kept.collect()) == [0, 2, 3, 4, 5]
    found = conflicts.collect()
    assert len(found) == 1 and "price_1" in found[0].message and "'6M" in found[0].message
    assert [r.ord for r in evd.merge(rows_, top_k=2)[0].collect()] == [0, 2]
    with pytest.raises(ValueError):
        evd.merge(rows_, top_k=0)


def test_rows_become_evidence_and_citations(spark):
    row = spark.createDataFrame([("7", "d", "f.json", "aia", "Doc", "Room", 5)],
                                "source_table_id STRING, document_id STRING, source_file_path "
                                "STRING, company_code STRING, document_name STRING, "
                                "benefit_name STRING, limit_amount BIGINT")
    e = evd.from_tool_rows(row, "search-benefits")
    got = e.first()
    assert got.content == "benefit_name: Room, limit_amount: 5" and got.source_id == "7"
    c = evd.citations(e).first()
    assert (c.company_code, c.document_name, c.page) == ("aia", "Doc", None)
    with pytest.raises(Exception, match="company_code"):
        evd.citations(evd.from_tool_rows(row.drop("company_code"), "t")).collect()
    profile = spark.createDataFrame([("u1", 30)], "user_id STRING, age INT")
    assert evd.from_profiles(profile).first().content == "user_id: u1, age: 30"


def test_context_budget(spark):
    rows_ = spark.createDataFrame([(1, i, "x" * 10) for i in range(1, 6)],
                                  "case_id INT, rank INT, text STRING")
    got = evd.context_budget(rows_, ["case_id"], "rank", 6, 15).orderBy("rank").collect()
    assert [len(r.text) for r in got] == [6, 6, 3]


def test_random_duplicates_dedupe_like_a_dict(spark):
    rng = random.Random(2)
    items = [(rng.choice("ab"), rng.choice("xyz"), rng.choice("pq")) for _ in range(200)]
    first = {}
    for i, key in enumerate(items):
        first.setdefault(key, i)
    got = {(r.source_type, r.source_id, r.content): r.ord
           for r in evd.dedupe(evidence_rows(spark, *items)).collect()}
    assert got == first


def _cosines(queries, texts, k):
    """TF-IDF rows over dicts of texts, straight from the formula; ``None`` has no terms."""
    def counts(t):
        ws = re.findall(r"\w\w+", (t or "").lower())
        return Counter(ws) + Counter(f"{a} {b}" for a, b in zip(ws, ws[1:]))
    docs = {}
    for i, t in texts:
        docs.setdefault(i, Counter()).update(counts(t))
    df = Counter(t for c in docs.values() for t in c)
    weights = lambda c: {t: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items() if t in df}
    out = set()
    for q, t in queries:
        own, scored = weights(counts(t)), []
        for i, c in docs.items():
            w = weights(c)
            dot = sum(own[t] * w[t] for t in own if t in w)
            if dot:
                scored.append((-round(dot / math.sqrt(sum(x * x for x in own.values())) / math.sqrt(sum(x * x for x in w.values())), 6), i))
        out |= {(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def test_tfidf_in_passes_with_repeated_items_and_empty_sides(spark, monkeypatch):
    monkeypatch.setattr(rt.postings, "PASS_QUERIES", 2)
    monkeypatch.setattr(rt, "WEIGHED_DOCS", 5)
    rng = random.Random(5)
    words = [f"w{i:02d}" for i in range(25)]
    texts = [(i % 60, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(70)] + [(90, None), (91, ""), (92, "x")]
    asked = [(f"q{i}", " ".join(rng.choices(words, k=6))) for i in range(7)] + [("none", "unknown terms"), ("null", None)]
    queries = spark.createDataFrame(asked, "query_id string, query string")
    corpus = spark.createDataFrame(texts, "chunk_id long, text string").repartition(3)
    found = rt.tfidf_topk(queries, corpus, 4)
    assert {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in found.collect()} == _cosines(asked, texts, 4)
    # postings meet once, by hash; neither terms nor weighted postings are moved
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [h#") == 1 and "term#" not in plan
    assert rt.tfidf_topk(queries, corpus.limit(0), 4).count() == 0 == rt.tfidf_topk(queries.limit(0), corpus, 4).count()
