"""Proposed chunk ranges: check, repair, fallback, cache by text."""

import hashlib
import json
import random

import pytest

from docmill.operators.chunking import proposals as pp


def key(text):
    return hashlib.md5(text.encode()).hexdigest()


def answer(*ranges):
    return json.dumps({"chunks": [{"start_unit": a, "end_unit": b} for a, b in ranges]})


def tables(spark, texts, answers):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, response string")
    return docs, spark.createDataFrame(answers, "text_key string, response string")


def chunks_of(spark, texts, answers, **how):
    rows = pp.proposed_chunks(*tables(spark, texts, answers), **how).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk_index)):
        out.setdefault(r.doc_id, []).append(r)
    return out


def brute(n, ranges):
    """Every unit goes to the last start at or before it."""
    starts = {a for a, _ in ranges if 1 <= a <= n} | {1}
    groups = {}
    for unit in range(1, n + 1):
        groups.setdefault(max(s for s in starts if s <= unit), []).append(unit)
    return [(g[0], g[-1]) for _, g in sorted(groups.items())]


def status(n, ranges):
    if any(a < 1 or b < a or b > n for a, b in ranges):
        return "unknown_unit"
    if any(b[0] <= a[1] for a, b in zip([(0, 0), *ranges], ranges)):
        return "overlapping"
    cover = [u for a, b in ranges for u in range(a, b + 1)]
    return "valid" if cover == list(range(1, n + 1)) else "gapped"


def test_ranges_equal_brute_force(spark):
    rng = random.Random(5)
    texts, answers, asked = [], [], []
    for i in range(60):
        n = rng.randint(1, 9)
        texts.append("\n\n".join(f"Đoạn {i} số {u} có chữ" for u in range(n)))
        if i % 3:
            cuts = sorted(rng.sample(range(1, n + 1), rng.randint(1, n)))
            ranges = [(a, b - 1) for a, b in zip([1, *[c for c in cuts if c > 1]], [*[c for c in cuts if c > 1], n + 1])]
        else:
            ranges = [tuple(rng.randint(0, n + 1) for _ in "ab") for _ in range(rng.randint(1, 4))]
        asked.append((n, ranges))
        answers.append((key(texts[-1]), answer(*ranges)))
    got = chunks_of(spark, texts, answers)
    for i, (n, ranges) in enumerate(asked):
        assert {r.status for r in got[i]} == {status(n, ranges)}, ranges
        assert [(r.first_unit, r.last_unit) for r in got[i]] == brute(n, ranges)
        units = texts[i].split("\n\n")
        assert [r.text for r in got[i]] == ["\n\n".join(units[r.first_unit - 1:r.last_unit]) for r in got[i]]


@pytest.mark.parametrize("response", ["not json", "{}", '{"chunks": []}', None])
def test_no_usable_answer_falls_back(spark, response):
    text = "một hai ba. " * 300
    got = chunks_of(spark, [text], [(key(text), response)])[0]
    assert {r.status for r in got} == {"missing" if response is None else "unreadable"}
    assert len(got) > 3 and all(r.first_unit is None and r.text == text[r.start:r.end] for r in got)


def test_without_repair_faulty_ranges_fall_back(spark):
    texts = ["a\n\nb\n\nc", "d\n\ne"]
    got = chunks_of(spark, texts, [(key(texts[0]), answer((1, 1))), (key(texts[1]), answer((1, 1), (2, 2)))], repair=False)
    assert [(r.status, r.first_unit, r.text) for r in got[0]] == [("gapped", None, texts[0])]
    assert [r.text for r in got[1]] == ["d", "e"]


def test_equal_texts_share_answers_and_empty_ones_give_none(spark):
    text = "a\n\nb"
    got = chunks_of(spark, [text, None, " \n ", text], [(key(text), answer((1, 1), (2, 2)))] * 2 + [(None, "x")])
    assert sorted(got) == [0, 3] and [r.text for r in got[3]] == ["a", "b"]
    assert chunks_of(spark, [], []) == {}


def test_requests_ask_once_for_what_is_open(spark):
    docs, answers = tables(spark, ["a\n\nb  c", "a\n\nb  c", "known", "failed", None], [(key("known"), answer((1, 1))), (key("failed"), None)])
    asked = {r.text_key: [(u.unit_id, u.chars, u.preview) for u in r.units] for r in pp.requests(docs, answers).collect()}
    assert asked == {key("a\n\nb  c"): [(1, 1, "a"), (2, 4, "b c")], key("failed"): [(1, 6, "failed")]}


def test_spelled_out_chunks(spark):
    docs, answers = tables(spark, ["alpha beta", "gamma " * 400, None], [(key("alpha beta"), '["alpha alpha", " ", "beta"]')])
    rows = sorted(pp.proposed_texts(docs, answers).collect(), key=lambda r: (r.doc_id, r.chunk_index))
    assert [(r.text, r.word_count, r.unique_words, r.document_position) for r in rows if r.doc_id == 0] == [("alpha alpha", 2, 1, 0.0), ("beta", 1, 1, 0.5)]
    assert len([r for r in rows if r.doc_id == 1]) >= 3 and {r.doc_id for r in rows} == {0, 1}
