"""The pipeline's stages against brute force, each on its own input."""

import pytest

import corpus_pipeline as P
from docmill.llm import quality_knn, secret_scan
from docmill.llm.common import written

from .test_simhash import plain as plain_simhash
from .test_substring_dedup import plain as plain_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        done = written(stage(spark, docs, SF), f"test-{name}")
        out.append((docs.collect(), done.collect(), done.columns))
        docs = done
    return out


def test_columns(stages, sample):
    for _, _, columns in stages[:-1]:
        assert columns == sample.columns


def test_quality_keeps_clean_documents(stages, spark):
    before, after, _ = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    scores = {r.doc_id: r.score for r in quality_knn.quality(spark.read.parquet(f"{SF}/documents.parquet"),
                                                            spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert kept == {d for d, s in scores.items() if s >= 0.3}
    good = [r.doc_id for r in before if labels.get(r.doc_id) == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and len(after) < len(before)


def test_one_of_each_group(stages):
    before, after, _ = stages[1]
    assert sorted(r.doc_id for r in after) == sorted({int(c) for _, _, c in plain_simhash(before)})


def test_repeats_are_cut(stages):
    before, after, _ = stages[2]
    want = {doc: (n, gone) for doc, n, gone, _ in plain_dedup(before)}
    old = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        n, gone = want[repr(r.doc_id)]
        assert len(r.text.encode().split()) == n - gone and r.n_chars == len(r.text)
        assert gone or r.text == old[r.doc_id]


def test_secrets_are_masked(stages):
    before, after, _ = stages[3]
    scanner = secret_scan.Scanner()
    assert len(after) == len(before) and not any(scanner.scan(r.text.encode()) for r in after)
    assert sum("[SECRET]" in r.text for r in after) == sum(bool(scanner.scan(r.text.encode())) for r in before)


def test_packing_loses_no_word(stages):
    before, after, _ = stages[4]
    assert sum(r.n_words for r in after) == sum(len(r.text.encode().split()) for r in before)


def test_run_is_the_stages(spark, stages):
    assert sorted(map(repr, P.run(spark, SF).collect())) == sorted(map(repr, stages[4][1]))
