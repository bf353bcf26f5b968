"""Every registered operator on tables of one row, of null rows and of no rows."""

import public_tokenizers
import pytest

from docmill.llm import ann, bpe, language_model, packing, quality_knn, quality_rules, secret_scan, sharding, simhash, substring_dedup

from .conftest import DOCS, words

LABELS = "doc_id long, quality int, toxic int"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")

OPERATORS = {
    "bpe": lambda d, spark: bpe.digest(d, PATH, public_tokenizers.PATTERN),
    "shards": lambda d, spark: sharding.shard_by_bytes(d),
    "secrets": lambda d, spark: secret_scan.find_secrets(d),
    "packing": lambda d, spark: packing.pack(d),
    "quality": lambda d, spark: quality_knn.quality(d, spark.createDataFrame([(0, 1, 0), (1, 0, 0)], LABELS)),
    "rules": lambda d, spark: quality_rules.quality_rules(d),
    "dedup": lambda d, spark: substring_dedup.digest(d),
    "simhash": lambda d, spark: simhash.digest(d),
    "language": lambda d, spark: language_model.score_texts(d),
}
CASES = {
    "one": [(1, " ".join(words(200, 1)))],
    "nulls": [(None, None)] * 3,
    "repeated": [(1, "same words here")] * 4,
    "empties": [(i, "") for i in range(3)],
    "none": [],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(spark, name, case):
    rows = [(i, t, None, None, None, *[None] * 9) for i, t in CASES[case]]
    docs = spark.createDataFrame(rows, DOCS)
    assert len(OPERATORS[name](docs, spark).collect()) == len(rows)


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    one = ann.search(spark.createDataFrame([(0, [1.0, 2.0])], schema)).collect()
    two = ann.search(spark.createDataFrame([(0, [1.0, 2.0]), (7, [1.0, 4.0])], schema)).collect()
    assert one == [] and [tuple(r) for r in two] == [(0, 1, 7, 2.0)]
