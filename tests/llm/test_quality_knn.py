"""Neighbour voting: exact blocked cosines, held-out accuracy, awkward tables."""

import zlib

import numpy as np
import pytest

from docmill.llm import quality_knn as Q

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_votes_equal_brute_force():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 97 + k, 200).astype(np.uint8)) for k in rng.integers(2, 20, 60)]
    bags, labels = np.array([Q.bag(t) for t in texts]), (rng.random(60) > 0.3).astype(np.float32)
    frequencies = np.append((bags[:, :Q.BUCKETS] > 0).sum(0), 60.0)
    model = Q.Model.fit(bags, labels, frequencies, labels.mean())
    vectors = Q.normed(Q.weighted(bags, model.weights) @ model.axes).astype(float)
    got = model.scores(bags)
    for i in range(60):
        cosines = vectors @ vectors[i]
        near = np.argsort(-cosines)[:Q.NEIGHBOURS]
        force = np.clip(cosines[near], 0, 1)[:, None] ** Q.SHARPNESS * model.votes[near]
        assert got[i] == pytest.approx(force[:, 0].sum() / force.sum(), abs=1e-4)


def test_latent_space_equals_a_plain_decomposition():
    rng = np.random.default_rng(1)
    rows = (rng.standard_normal((90, 12)) * 0.8 ** np.arange(12)) @ rng.standard_normal((12, 70)) + 0.001 * rng.standard_normal((90, 70))
    axes = Q.leading_axes(rows.astype(np.float32), 6)
    _, values, plain = np.linalg.svd(rows, full_matrices=False)
    assert np.allclose(axes.T @ axes, np.eye(6), atol=1e-4)
    assert np.allclose(np.abs(axes.T @ plain[:6].T), np.eye(6), atol=1e-2)
    assert np.allclose(np.linalg.norm(rows @ axes, axis=0), values[:6], rtol=1e-4)


def test_one_of_several_texts_under_an_id_teaches(spark):
    """The model does not depend on how the rows lie."""
    docs = spark.createDataFrame([(i % 12, f"text {i} of {'some' if i % 12 < 6 else 'quite other !!'} words " * 5) for i in range(60)], "doc_id long, text string")
    own = spark.createDataFrame([(i, int(i < 6), 0) for i in range(12)], LABELS)
    one, two = Q.fit(docs.repartition(3), own), Q.fit(docs.orderBy("text").repartition(5), own)
    assert (one.vectors == two.vectors).all() and (one.weights == two.weights).all()


def test_held_out_accuracy(docs, labels):
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = Q.quality(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    own = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y, _ in own if y], [s for s, y, _ in own if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([p for _, y, p in own if y]) > 0.97


def test_only_text_decides(docs, labels, spark):
    from pyspark.sql import functions as F

    want = {r.doc_id: r.score for r in Q.quality(docs, labels).collect()}
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "score": F.lit(0.5)})
    got = {r.doc_id: r.score for r in Q.quality(other, labels).collect()}
    assert got == pytest.approx(want)


def test_awkward(awkward, nothing, labels, spark):
    own = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (13, 0, 0), (14, 0, 0), (13, 0, 1), (7, None, 0), (None, 1, 0)], LABELS)
    rows = Q.quality(awkward, own).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    empty = spark.createDataFrame([], LABELS)
    assert {r.score for r in Q.quality(awkward, empty).collect()} == {0.5}
    assert Q.quality(nothing, own).count() == 0
