"""Shared fixtures: an awkward table of documents and the smallest generated data."""

import random

import pytest

SF = "/root/testdata/sf0.001"

#: Extra columns whose names the operators use inside.
EXTRA = "score string, _row string, _doc string, _found string, fp string, block string, label string, key string, copies string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def words(n, seed, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward_rows():
    base = " ".join(words(300, 1))
    passage = " ".join(words(80, 2))
    texts = [
        (1, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, "   \n\t "), (None, None), (7, "one"),
        (8, "Été à la plage — naïve café ñandú"), (9, " ".join(words(20000, 3))), (10, "x" * 100_000),
        (11, " ".join(words(60, 4)) + " " + passage), (12, passage + " " + " ".join(words(60, 5))),
        (13, "same " * 400), (14, "same " * 400), (15, 'token = "0123456789abcdef0123456789abcdef01234567" end'),
        (15, 'token = "0123456789abcdef0123456789abcdef01234567" end'), (None, base), (16, "line\nline\n\nline\nother"),
        (17, "\u0085 \x1c     mixed\x0bspace\x0cforms"), (18, passage),
    ]
    return [(i, t, "en" if i else None, None if i == 3 else f"src{(i or 0) % 3}", len(t or ""), *["clash"] * 9) for i, t in texts]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def text_of(rows):
    return {r.doc_id: r.text for r in rows}
