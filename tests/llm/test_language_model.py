"""The language model: base scores, gradients, normalisation, held-out gain."""

import math
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docmill.llm import language_model as L

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def plain(rows):
    held = {r.doc_id: zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 1 for r in rows}
    counts = Counter(t for r in rows if not held[r.doc_id] for t in tokens(r.text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for r in rows:
        own = tokens(r.text)
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in own)
        out.append((repr(r.doc_id), held[r.doc_id], len(own), sum(counts[t] > 0 for t in own), total, base))
    return sorted(out)


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.collect(), L.score_texts(docs).collect()


def compare(rows, out):
    got = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out)
    want = plain(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)


def test_base(scored):
    compare(*scored)


def test_model_beats_the_base_on_held_out_texts(scored):
    own = [r for r in scored[1] if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)
    assert all(math.isfinite(r.score) and r.score < 0 for r in scored[1])


def test_rare_words_take_the_join(spark, monkeypatch, awkward):
    monkeypatch.setattr(L, "COMMON", 50)
    out = L.score_texts(awkward).collect()
    compare(awkward.collect(), out)
    assert all(math.isfinite(r.score) for r in out)


def test_no_documents_and_none_to_learn_from(spark, nothing, awkward):
    assert L.score_texts(nothing).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = spark.createDataFrame([(held, "some words"), (held, None)], "doc_id long, text string")
    out = L.score_texts(alone).collect()
    compare(alone.collect(), out)
    assert {r.train_tokens for r in out} == {0} and all(math.isfinite(r.score) for r in out)


def small_model(words=300, seed=0):
    rng = np.random.default_rng(seed)
    weights = L.initial(rng.integers(1, 50, words).astype(float), 40.0)
    return L.Gated({k: rng.standard_normal(v.shape) * 0.2 if k not in ("bo",) else v.astype(float) for k, v in weights.items()})


def test_gradients_match_differences():
    rng, net = np.random.default_rng(1), small_model()
    inputs, targets = rng.integers(0, 300, (2, 6, 4))
    fresh = np.zeros((6, 4), bool)
    fresh[0], fresh[3, 1] = True, True
    state = np.zeros((4, L.SIZE))
    grad, _, n = net.gradients(inputs, targets, np.ones((6, 4), bool), fresh, state)
    assert n == 24

    def loss():
        h, _, _ = net.states(inputs, fresh, state, keep=True)
        return -net.log_probabilities(h.reshape(-1, L.SIZE), targets.ravel())[0].sum()

    for name, value in net.w.items():
        biggest = np.unravel_index(np.abs(grad[name]).argmax(), value.shape)
        kept, step = value[biggest], 1e-2
        value[biggest] = kept + step
        above = loss()
        value[biggest] = kept - step
        below = loss()
        value[biggest] = kept
        assert (above - below) / (2 * step) == pytest.approx(grad[name][biggest], rel=0.05, abs=0.02)


def test_output_probabilities_sum_to_one():
    net = small_model(words=200)
    state = np.random.default_rng(2).standard_normal((1, L.SIZE))
    every = np.arange(200)
    logs, _ = net.log_probabilities(np.repeat(state, 200, 0), every)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-3)


def test_state_is_carried_across_windows():
    net = L.Gated({k: v.astype(np.float32) for k, v in small_model().w.items()})
    rng = np.random.default_rng(3)
    texts = [np.append(rng.integers(2, 300, n), L.END).astype(np.int32) for n in (1, 700, 5, 0, 64, 63, 300)]
    got = L.text_scores(net, texts)
    for own, text in zip(got, texts, strict=True):
        inputs = np.append(L.END, text[:-1])[:, None]
        fresh = np.zeros((len(text), 1), bool)
        fresh[0] = True
        h, _, _ = net.states(inputs, fresh, np.zeros((1, L.SIZE), np.float32))
        assert own == pytest.approx(net.log_probabilities(h[:, 0], text)[0].sum(), rel=1e-4)


def test_every_training_document_reaches_the_network(spark, monkeypatch, tmp_path):
    folder, averaged = str(tmp_path), L._averaged

    def noted(table):
        if table.column("chunk")[0].as_py() == 0:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(sum(table.column("seen").to_pylist())))
        return averaged(table)

    monkeypatch.setattr(L, "_averaged", noted)
    rows = [(i, f"one two three {i}") for i in range(100)] + [(None, f"four five {i}") for i in range(20)] + [(7, "one two three 7")]
    scored = L.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert sum(seen) == sum(r.n_tokens for r in scored if not r.held_out)
    assert len(seen) == L.ROUNDS


def test_texts_are_read_twice_whatever_the_rounds(spark):
    read = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(i, f"One two\tthree {i}") for i in range(50)], "doc_id long, text string")
    assert len(L.score_texts(docs.mapInArrow(noted, docs.schema)).collect()) == 50
    assert read.value == 100


def test_words_of_a_batch():
    texts = [" lead and Trail ", None, "", "\u0085 \x1c  mixed\x0bspace\x0c", "\u00c9T\u00c9 a", "\n\n", "x"]
    for given in (pa.array(texts), pa.array(["cut", *texts, "cut"]).slice(1, len(texts))):
        words, sizes = L.words_of(given)
        ends = np.cumsum(sizes)
        got = [[w.decode() for w in words.to_pylist()[e - n:e]] for e, n in zip(ends, sizes, strict=True)]
        assert got == [tokens(t)[:-1] for t in texts]


def test_token_ids_and_sums_of_a_table(spark, awkward):
    rows = awkward.collect()
    counts = Counter("" if t is None else t for r in rows for t in tokens(r.text))
    known = {w: n for w, n in counts.items() if n > 1}
    knowledge = L.Knowledge(sum(counts.values()), len(counts), [w.encode() for w in known], list(known.values()))
    knowledge.inside = 100
    number = {w: i for i, w in enumerate(knowledge.words.to_pylist()[:100], 2)}
    coded = L.encoded(awkward.withColumn("held_out", L.F.lit(False)).select("doc_id", "held_out", "text"), spark.sparkContext.broadcast(knowledge))
    want, got = [], []
    for r in rows:
        own = [t.encode() for t in tokens(r.text)[:-1]]
        ids = [*(number.get(w, L.OTHER) for w in own), L.END]
        want.append((ids, ids.count(L.OTHER), sum(w.decode() in known for w in own), [w for w in own if w.decode() not in known]))
    for r in coded.collect():
        ids = np.frombuffer(r.ids, L.TOKEN).tolist()
        got.append((ids, r.n_other, r.n_common, [bytes(w) for w in r.rare]))
        assert len(ids) == r.n_tokens and 0 <= r.turn < L.ROUNDS
    assert sorted(got) == sorted(want)


def test_equal_tokens_are_summed():
    rng = np.random.default_rng(4)
    for ids in (np.repeat(np.arange(5), [1, 200, 33, 32, 2]), np.zeros(100, np.int64), np.arange(7)):
        ids = rng.permutation(ids)
        parts = [rng.standard_normal((len(ids), L.SIZE)).astype(np.float32) for _ in range(2)]
        want = np.zeros((ids.max() + 1, 2 * L.SIZE))
        np.add.at(want, ids, np.concatenate(parts, 1))
        assert L._sums(parts, ids, len(want)) == pytest.approx(want, abs=1e-4)


def test_texts_are_taken_in_buffers(monkeypatch):
    monkeypatch.setattr(L, "BUFFER", 10)
    texts = [np.arange(n, dtype=L.TOKEN) for n in (3, 4, 30, 1, 1, 10, 2, 8, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts], pa.binary()), pa.array(range(len(texts)))], ["ids", "row"])
    out = list(L.buffered(iter([batch.slice(0, 4), batch.slice(4)])))
    assert [i for parts, _ in out for p in parts for i in p.column("row").to_pylist()] == list(range(len(texts)))
    assert [t.tolist() for _, own in out for t in own] == [t.tolist() for t in texts]
    assert [sum(map(len, own)) for _, own in out] == [37, 12, 10, 1]
