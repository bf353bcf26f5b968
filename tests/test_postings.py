"""Posting-block search: pruning against plain sums, passes, stored index with changes."""

import math
import random
import re
import shutil
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import postings as P
from docmill.operators import retrieval as rt
from docmill.sources.index import KeywordIndex, VersionedTable


def plain_bm25(docs, queries, k, k1=1.2, b=0.75):
    """{query: [(item, score, matched)]} over all pairs."""
    bags = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in docs.items()}
    sized = [len(w) for i, w in bags.items() if docs[i] is not None]
    n, mean = len(bags), (sum(sized) / len(sized) if sized else 0) or 1.0
    out = {}
    for q, text in queries.items():
        scored = []
        asked = set(re.findall("[a-z0-9]+", (text or "").lower()))
        for i, words in bags.items():
            total = sum(math.log1p((n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean))
                        for t in asked if (tf := words.count(t)) for df in [sum(t in w for w in bags.values())])
            if total > 0:
                scored.append((-round(total, 6), i, len(asked & set(words))))
        if scored:
            out[q] = [(i, -s, m) for s, i, m in sorted(scored)[:k]]
    return out


def found(df, item="chunk_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.query_id), r.rank)):
        out.setdefault(r.query_id, []).append((r[item], r.score, r.matched))
    return out


def made(n, seed, words=("the", "of", "policy", "claim", "age", "fee", "bonus", "term", "rider")):
    rng = random.Random(seed)
    return {i: " ".join(rng.choices([*words, f"w{rng.randrange(40)}"], [9, 7, 3, 3, 2, 2, 1, 1, 1, 6], k=rng.randrange(1, 40))) for i in range(n)}


QUERIES = {1: "policy claim the", 2: "bonus", 3: "w1 w2 w3 the of", 4: "absent", 5: "", 6: "rider rider term"}


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([*QUERIES.items(), (7, None)], "query_id int, query string")


def frame(spark, docs, kind="int"):
    return spark.createDataFrame([(i, t) for i, t in docs.items()], f"chunk_id {kind}, text string").repartition(5)


def test_pruned_scores_equal_sums():
    rng = np.random.default_rng(1)
    skipped = 0
    for _ in range(200):
        size, terms = int(rng.integers(1, 300)), int(rng.integers(1, 6))
        full = np.round(rng.random((size, terms)) * 10.0 ** rng.integers(-2, 2, terms), 3) * (rng.random((size, terms)) < 0.4)
        lists = [(float(full[:, t].max()), np.flatnonzero(full[:, t]), full[full[:, t] > 0, t]) for t in range(terms) if full[:, t].any()]
        total = np.round(full.sum(1), 6)
        floor = float(rng.choice([0.0, np.quantile(total, 0.9), total.max(), total.max() + 1]))
        docs, scores, read = P.shard_scores(lists, size, floor)
        want = np.flatnonzero((total >= floor) & (total > 0))
        assert set(want) <= set(docs.tolist()) and np.allclose(scores, total[docs])
        skipped += sum(len(d) for _, d, _ in lists) - read
    assert skipped > 1000


def test_words_in_tasks_equal_the_column_expression(spark):
    texts = ["Bảo hiểm Đặc biệt", "½ ﬁne ﬄ Ⅷ x²", "a\u0301 ñ—ß_ÆØ", "日本 한글 b", "", "  ", "MIXED 12-3,4.x", "\u0130\u212a\ufb01", "".join(map(chr, range(0x80, 0x250)))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.tokens(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in rows} == {t: [w.decode() for w in P.words_of(t)] for t in texts}


@pytest.mark.parametrize("sizes", [{}, {"SHARD_DOCS": 3, "SHARD_TOKENS": 60, "PASS_QUERIES": 2}])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_against_all_pairs(spark, asked, monkeypatch, sizes, kind):
    for name, value in sizes.items():
        monkeypatch.setattr(P, name, value)
    docs = made(120, 2) | {500 + i: "the same policy claim" for i in range(40)} | {900: None, 901: "", 902: "The  POLICY, Claim!"}
    if kind == "string":
        docs = {f"c{i}": t for i, t in docs.items()}
    got = rt.bm25_topk(asked, frame(spark, docs, kind), 7, matched=True)
    assert found(got) == plain_bm25(docs, QUERIES, 7)


def test_no_join_of_all_documents_with_all_queries(spark, asked, capsys):
    rt.bm25_topk(asked, frame(spark, made(50, 3)), 5).explain("simple")
    plan = capsys.readouterr().out
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.fixture
def stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "SHARD_DOCS", 16)
    docs = made(90, 4)
    index = KeywordIndex(spark, str(tmp_path / "keywords"))
    index.upsert(frame(spark, docs))
    return index, docs


def test_stored_index_follows_changes(spark, asked, stored):
    index, docs = stored
    assert found(index.search(asked, 6)) == plain_bm25(docs, QUERIES, 6)
    changed = made(20, 5) | {300: "bonus bonus rider", 301: "claim"}
    index.upsert(frame(spark, changed))
    docs |= changed
    assert found(index.search(asked, 6)) == plain_bm25(docs, QUERIES, 6)
    gone = [0, 3, 300, 7777]
    index.delete(spark.createDataFrame([(i,) for i in gone], "chunk_id int"))
    docs = {i: t for i, t in docs.items() if i not in gone}
    assert found(index.search(asked, 6)) == plain_bm25(docs, QUERIES, 6)
    index.upsert(frame(spark, {3: "policy is back"}))
    docs[3] = "policy is back"
    before = found(index.search(asked, 6))
    assert before == plain_bm25(docs, QUERIES, 6)
    # a write that repeats what is stored changes nothing, and neither does compaction
    index.upsert(frame(spark, {3: "policy is back"}))
    assert found(index.search(asked, 6)) == before
    index.compact(frame(spark, docs))
    assert len(index.table.versions()) == 1 and found(index.search(asked, 6)) == before
    assert index.delete(spark.createDataFrame([], "chunk_id int")) is None


def test_several_texts_under_an_item_count_once(spark, asked, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "keywords"))
    index.upsert(spark.createDataFrame([(1, "policy"), (1, "policy"), (2, "claim")], "chunk_id int, text string").coalesce(1))
    assert found(index.search(asked, 5)) == plain_bm25({1: "policy", 2: "claim"}, QUERIES, 5)


def test_only_folders_of_the_query_terms_are_read(spark, stored):
    index, docs = stored
    one = spark.createDataFrame([(1, "bonus")], "query_id int, query string")
    bucket = spark.createDataFrame([("bonus",)], "t string").select(P.bucket_of("t")).first()[0]
    others = [f for f in Path(index.table.root).glob("batch=*/bucket=*") if f.name not in ("bucket=-1", f"bucket={bucket}")]
    assert len(others) > 10
    for folder in others:
        shutil.rmtree(folder)
    assert found(index.search(one, 3)) == plain_bm25(docs, {1: "bonus"}, 3)


def test_index_without_rows(spark, asked, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "keywords"))
    index.upsert(frame(spark, {1: None, 2: ""}))
    assert index.search(asked, 5).count() == 0
    assert rt.bm25_topk(asked, frame(spark, {}), 5).count() == 0
    assert rt.bm25_topk(asked.limit(0), frame(spark, made(5, 1)), 5).count() == 0


def test_versioned_table_is_one_scan_and_compacts(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["kind"])
    for v in range(3):
        table.write(spark.range(v + 1).withColumns({"kind": F.lit("a"), f"c{v}": F.lit(v)}))
    assert table.read()._jdf.queryExecution().toString().count("FileScan") == 1
    assert sorted((r.batch, r.id) for r in table.read().collect()) == [(v, i) for v in (1, 2, 3) for i in range(v)]
    table.compact(table.read().filter("batch = 3").drop("batch"))
    assert table.versions() == [4] and table.read().count() == 3


def test_words_are_objects_of_a_few_texts_at_a_time(monkeypatch):
    """A whole Arrow batch of words took 870 MB of a task's memory."""
    import pyarrow as pa

    from docmill.operators import postings

    monkeypatch.setattr(postings, "SLICE_ROWS", 4)
    read = []
    whole = postings.words_of
    monkeypatch.setattr(postings, "words_of", lambda t: read.append(t) or whole(t))
    texts = [None if i == 5 else f"Café w{i} two w{i % 3}" for i in range(11)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(11)), pa.array(texts, pa.string())], ["item", "text"])
    for wanted in (None, ["two", "w1", "absent"]):
        read.clear()
        out = postings._worded(iter([batch]), wanted)
        first = next(out)
        assert first.num_rows == len(read) == 4
        rows = [r for b in (first, *out) for r in b.to_pylist()]
        for r, t in zip(rows, texts, strict=True):
            words = [] if t is None else [w.decode() for w in whole(t)]
            assert r["size"] == (None if t is None else len(words))
            assert r["words"] == [w for w in words if wanted is None or w in wanted]


def test_odd_characters_one_by_one_and_all_at_once(monkeypatch):
    texts = ["Bảo hiểm Đặc biệt", "½ ﬁne ﬄ Ⅷ x²", "\u0130\u212a\ufb01 a\u0301", "".join(map(chr, range(0x80, 0x250))), "日本 b 한글"]
    got = [P.words_of(t) for t in texts]
    for most in (0, 10_000):
        monkeypatch.setattr(P, "MOST_ODD", most)
        assert [P.words_of(t) for t in texts] == got


def test_an_index_is_written_without_a_sample_of_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "SHARD_DOCS", 8)
    blocks = P.posting_blocks(frame(spark, made(60, 6))).withColumn("deleted", F.lit(False))
    placed = P.by_folder(blocks)
    assert "rangepartitioning" not in placed._jdf.queryExecution().executedPlan().toString().lower()
    rows = placed.select("bucket", "term", "shard", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == blocks.count() and {r.bucket for r in rows if r.term is None} == {-1}
    terms = {}
    for r in rows:
        if r.term is not None:
            terms.setdefault(r.term, set()).add(r.task)
    assert all(len(t) == 1 for t in terms.values()) and len({t for x in terms.values() for t in x}) > 1
    tasks = {}
    for r in rows:
        tasks.setdefault(r.task, []).append((r.bucket, r.term or "", r.shard))
    assert all(t == sorted(t) for t in tasks.values())


@pytest.mark.parametrize("shipped", [0, 1 << 14])
def test_dead_documents_are_counted_by_shard(spark, asked, tmp_path, monkeypatch, shipped):
    monkeypatch.setattr(P, "SHIPPED_SHARDS", shipped)
    docs = made(300, 7) | {1000: None, 1001: "", 1002: None}
    index = KeywordIndex(spark, str(tmp_path / "keywords"))
    index.upsert(frame(spark, docs).coalesce(1))  # one shard
    changed = {i: ("bonus" if i % 2 else None) for i in [*range(0, 300, 4), 130, 131, 1000, 1001]}
    index.upsert(frame(spark, changed))
    docs |= changed
    gone = [5, 64, 63, 128, 299, 1002, 1000]
    index.delete(spark.createDataFrame([(i,) for i in gone], "chunk_id int"))
    docs = {i: t for i, t in docs.items() if i not in gone}
    assert found(index.search(asked, 9)) == plain_bm25(docs, QUERIES, 9)
    rows = index.table.read()
    dead = index.dead(rows)
    totals = P._totals(rows.filter("NOT deleted AND term IS NULL"), dead.withColumnRenamed("ords", "dead")).first()
    sized = [len(t.split()) for t in docs.values() if t is not None]
    assert totals.n == len(docs) and abs(totals.mean - sum(sized) / len(sized)) < 1e-12
