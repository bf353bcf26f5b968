import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import benchmark as bm
from docmill.operators import evaluation as ev
from docmill.operators import graph as gr

CASE = ("case_id STRING, expected_sources ARRAY<STRUCT<source_path STRING, line_start INT, "
        "line_end INT, relationship STRING>>, required_source_paths ARRAY<STRING>")
HIT = "strategy STRING, case_id STRING, rank INT, source_path STRING, start_line INT, end_line INT"


def test_nearest_rank_is_exact(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < .6 else "cold", round(rng.expovariate(.01), 2))
            for _ in range(3000)] + [("one", 5.0)] + [("same", 2.0)] * 9
    df = spark.createDataFrame(data, "g STRING, v DOUBLE")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r.percentile for r in ev.nearest_rank(df, ["g"], "v", q, 16).collect()}
        want = {}
        for g in {d[0] for d in data}:
            vs = sorted(v for k, v in data if k == g)
            want[g] = vs[round((len(vs) - 1) * q)]
        assert got == want
    assert ev.nearest_rank(df, [], "v", 1.0).first().percentile == max(v for _, v in data)


def test_case_scores(spark):
    hits = spark.createDataFrame([("s", "c", 1, "c.md", 1, 2), ("s", "c", 2, "a.md", 12, 14),
                                  ("s", "c", 3, "b.md", 1, 2)], HIT)
    cases = spark.createDataFrame([("c", [("a.md", 10, 20, "primary")], ["a.md", "b.md"])], CASE)
    got = ev.score_cases(hits, cases, 3).first()
    assert (got.primary_hit_at_k, got.primary_rank_at_k, got.primary_mrr_at_k,
            got.required_source_recall_at_k, got.line_overlap_recall_at_k) == (1., 2, .5, 1., 1.)
    cut = ev.score_cases(hits, cases, 1).first()
    assert (cut.primary_hit_at_k, cut.primary_rank_at_k, cut.primary_mrr_at_k) == (0., None, 0.)


def test_rank_metrics(spark):
    found = spark.createDataFrame(
        [("c", 1, "x.md", "other"), ("c", 2, "a.md", "Mức **CHI TRẢ** 5 triệu"),
         ("c", 7, "a.md", "hạn mức")], "case_id STRING, rank INT, source_path STRING, text STRING")
    cases = spark.createDataFrame(
        [("c", "a.md", "mức chi trả", ["5 triệu", "hạn mức"]), ("d", "b.md", None, [])],
        "case_id STRING, source_path STRING, evidence_quote STRING, expected_evidence "
        "ARRAY<STRING>")
    got = {r.case_id: r for r in ev.rank_metrics(found, cases).collect()}
    c = got["c"]
    assert (c.source_rank, c.quote_rank, c.mrr_at_5, c.quote_hit_at_5) == (2, 2, .5, 1.)
    assert (c.evidence_phrase_recall_at_5, c.evidence_phrase_recall_at_10) == (.5, 1.)
    assert got["d"].source_rank is None and got["d"].quote_hit_at_5 is None


ANSWER = ("case_id STRING, answer STRING, source_path STRING, expected_answer STRING, "
          "evidence_quote STRING, expected_evidence ARRAY<STRING>, must_cite_source BOOLEAN, "
          "provider STRING, risk STRING")


def scored(spark, answer, expected="Hạn mức chi trả là 5.000.000 đồng mỗi năm"):
    answers = spark.createDataFrame([("c", answer, "a.md", expected, "", [], True, "p", "low")],
                                    ANSWER)
    contexts = spark.createDataFrame(
        [("c", "S1", "a.md", "Hạn mức chi trả là 5.000.000 đồng mỗi năm"),
         ("c", "S2", "b.md", "Phí 7.000.000")],
        "case_id STRING, citation_id STRING, source_path STRING, text STRING")
    return ev.score_answers(answers, contexts).first()


def test_answer_scoring(spark):
    good = scored(spark, "Hạn mức chi trả là 5.000.000 đồng mỗi năm [S1].")
    assert good.success and good.valid_citation_rate == 1 and good.citation_coverage == 1
    assert good.answer_quality_score == 1.0 and good.cited_context_ids == "S1"
    bad = scored(spark, "Hạn mức chi trả là 5.000.000 đồng mỗi năm [S99].")
    assert (bad.valid_citation_rate, bad.citation_coverage, bad.success) == (0, 0, False)
    assert bad.unsupported_numeric_claim_count == 1
    wrong = scored(spark, "Hạn mức chi trả là 5.000.000 đồng mỗi năm [S2].")
    assert wrong.unsupported_numeric_claim_count == 1 and not wrong.expected_source_cited


def test_judge_and_concept_metrics(spark):
    scores = spark.createDataFrame([("a", "", 1.0), ("a", "x", None), ("b", "x", None)],
                                   "strategy STRING, error STRING, relevance DOUBLE")
    got = {r.strategy: (r.cases, r.failed, r.relevance)
           for r in ev.judge_summary(scores, ["relevance"]).collect()}
    assert got == {"a": (2, 1, 1.0), "b": (1, 1, None)}
    chunks = spark.createDataFrame([("m", 0, "waiting here"), ("m", 1, "period there"),
                                    ("m", 2, "room rate")],
                                   "method STRING, chunk_index INT, text STRING")
    kept = ev.concept_integrity(chunks, ["waiting period", "room rate"], ["method"]).first()
    assert kept.concept_integrity == 0.5
    assert ev.keyword_coverage(chunks, ["ROOM", "none"], ["method"]).first()[1] == 0.5


def test_quote_snapping(one):
    text = F.array(F.lit("Điều 1"), F.lit(""), F.lit("Chi phí nội trú được chi trả"),
                   F.lit("tối đa năm triệu"))
    from docmill.functions.text import lexical_tokens

    hit = one(ev.snap_quote(text, lexical_tokens(F.lit("chi phí nội trú chi trả tối đa"))))
    assert (hit.first, hit.last) == (3, 4)
    assert one(ev.snap_quote(text, lexical_tokens(F.lit("hoàn toàn khác biệt ở đây")))) is None


def test_quality_caps_match_loop(spark):
    rng = random.Random(4)
    cases = [(i, rng.choice(["call hotline", "x"]), rng.choice(["provider_list", "claim"]),
              rng.choice(["low", "high"])) for i in range(300)]
    used, want = [0, 0, 0], []
    for i, q, t, r in cases:
        flags = (t == "provider_list", "hotline" in q, r == "low")
        if all(not f or u < c for f, u, c in zip(flags, used, (3, 4, 6))):
            want.append(i)
            used = [u + f for u, f in zip(used, flags)]
    df = spark.createDataFrame([(i, q, "", t, r) for i, q, t, r in cases],
                               "ord INT, question STRING, gold_answer STRING, task_type STRING, "
                               "risk_level STRING").repartition(4)
    got = bm.apply_quality_caps(df, "ord", 3, 4, 6)
    assert sorted(r.ord for r in got.collect()) == want


def test_interleave_and_related_sources(spark):
    rows = spark.createDataFrame([(p, i) for i, p in enumerate("aaabbc")],
                                 "provider STRING, k INT")
    got = [r.provider for r in bm.interleave(rows, ["k"]).collect()]
    assert got == ["a", "b", "c", "a", "b", "a"]
    rng = random.Random(6)
    vocab = [f"token{i:02d}" for i in range(14)]
    lines = [(f"s{i % 5}.md", i, " ".join(rng.sample(vocab, rng.randint(2, 6))))
             for i in range(60)] + [(f"s{i % 3}.md", 100 + i, "token00 token01 token02")
                                    for i in range(12)]
    df = spark.createDataFrame(lines, "source_path STRING, line_start INT, quote STRING")
    ids = {path + str(line): f"{path}#{line:06d}" for path, line, _ in lines}

    def overlap(a, b):
        x, y = set(a[2].split()), set(b[2].split())
        return len(x & y) / len(x | y)
    for top in (2, 1000):
        want = set()
        for a in lines:
            close = sorted((-round(overlap(a, b), 6), ids[b[0] + str(b[1])]) for b in lines
                           if a[0] != b[0] and overlap(a, b) >= .4)[:top]
            want |= {(ids[a[0] + str(a[1])], i, r) for r, (_, i) in enumerate(close, 1)}
        got = {(r.id, r.other, r["rank"]) for r in bm.related_sources(df, top, .4).collect()}
        assert got == want and want


def test_graph_quality_and_schema(spark):
    props = {"confidence": "0.9", "document_id": "d", "source_path": "p", "chunk_id": "d:0"}
    nodes = spark.createDataFrame([("a", "A", {}), ("b", "B", {}), ("orphan:node", "X", {}),
                                   ("document:d", "D", {})],
                                  "id STRING, entity_type STRING, props MAP<STRING,STRING>")
    edges = spark.createDataFrame([("a", "b", "MAKES_UP", props)],
                                  "src STRING, dst STRING, relationship_type STRING, "
                                  "props MAP<STRING,STRING>")
    docs = spark.createDataFrame([("d",)], "document_id STRING")
    types = spark.createDataFrame([("COVERS",)], "label STRING")
    issues = gr.quality_issues(nodes, edges, docs, types)
    assert sorted((r.issue, r.subject) for r in issues.collect()) == \
        [("invalid_relationship", "MAKES_UP"), ("orphan_node", "orphan:node")]
    report = gr.quality_report(nodes, edges, issues).first()
    assert (report.is_valid, report.node_count, report.edge_count) == (False, 4, 1)
    items = spark.createDataFrame([("QuyenLoi", 8, ["a.md", "b.md"], .9),
                                   ("Benefit", 2, ["b.md", "c.md"], .8)],
                                  "label STRING, occurrence_count BIGINT, source_files "
                                  "ARRAY<STRING>, average_confidence DOUBLE")
    canon = spark.createDataFrame([("QuyenLoi", "Benefit")],
                                  "label STRING, canonical_label STRING")
    m = gr.merge_labels(items, canon).first()
    assert (m.label, m.occurrence_count, m.average_confidence, m.source_file_count) == \
        ("Benefit", 10, .88, 3)
    kept = gr.keep_stable_labels(gr.merge_labels(items, canon), 50, 9, ["Benefit"])
    assert kept.count() == 1
    with pytest.raises(ValueError):
        gr.select_labels(items, canon, 0)


def test_graph_build_last_write_wins(spark):
    node = "STRUCT<id STRING, type STRING, properties MAP<STRING,STRING>>"
    rel = "STRUCT<source STRING, target STRING, type STRING, properties MAP<STRING,STRING>>"
    docs = spark.createDataFrame(
        [(1, [("a", "A", {"v": "1"}), ("b", "B", {})], [("a", "b", "R", {"v": "1"}),
                                                        ("a", "zz", "R", {})]),
         (2, [("a", "A", {"v": "2"}), ("x", "Odd", {})], [("a", "x", "R", {})])],
        f"ord INT, nodes ARRAY<{node}>, relationships ARRAY<{rel}>")
    types = spark.createDataFrame([("A",), ("B",)], "label STRING")
    kinds = spark.createDataFrame([("R",)], "label STRING")
    nodes, edges = gr.build_graph(docs, types, kinds)
    assert {r.id: r.props.get("v") for r in nodes.collect()} == {"a": "2", "b": None}
    assert [(r.src, r.dst) for r in edges.collect()] == [("a", "b")]
    back = gr.read_node_link(gr.node_link_json(nodes, edges))
    assert back[0].count() == 2 and back[1].first().props == {"v": "1"}


def test_scenarios_and_primary_sources(spark):
    source = "ARRAY<STRUCT<source_path STRING, relationship STRING>>"
    cases = spark.createDataFrame(
        [(1, [("x.md", "other"), ("a.md", "primary")]), (2, [("b.md", "other")]),
         (3, [("a.md", "primary")]), (4, [])], f"ord INT, expected_sources {source}")
    corpus = spark.createDataFrame([("a.md",), ("b.md",)], "source_path STRING")
    got = ev.first_primary_sources(cases, corpus, 5).collect()
    assert [r.source_path for r in got] == ["a.md", "b.md"]
    assert ev.with_scenarios(cases).count() == 20
    assert ev.with_scenarios(cases, ["vector"]).first()["mode"] == "vector"
