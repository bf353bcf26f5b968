"""No caps, no size switches: large cells, many labels, numbering, folder tables, shared folders."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.operators import evaluation as ev
from docmill.operators import graph as gr
from docmill.operators.chunking import markdown as md
from docmill.operators.numbering import ranked
from docmill.plans import load_all
from docmill.session import checkpoint_dir


def test_rank_without_one_task(spark):
    rng = random.Random(0)
    rows = [(rng.choice(["hot"] * 3 + ["a", "b", None]), rng.randrange(6), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g STRING, k INT, id INT").repartition(5)
    want = {}
    for g, k, i in rows:
        want.setdefault(g, []).append((k, i))
    places = {i: n for own in want.values() for n, (_, i) in enumerate(sorted(own))}
    assert {r.id: r.n for r in ranked(df, ["g"], ["k", "id"], "n").collect()} == places
    whole = {i: n for n, (_, i) in enumerate(sorted((k, i) for _, k, i in rows))}
    assert {r.id: r.n for r in ranked(df, [], ["k", "id"], "n").collect()} == whole
    assert ranked(df.limit(0), ["g"], ["k"], "n").count() == 0


def test_definition_with_many_cells(spark):
    cells = " | ".join(f"c{i}" for i in range(12_000))
    text = f"## Định nghĩa\n| Thuật ngữ | {cells} |\n"
    found = spark.createDataFrame([(text,)], "t STRING").select(
        F.explode(md.definitions(F.col("t"))).alias("d")).select("d.definition").first()
    assert found.definition.endswith("c11999")


def test_json_after_many_braces(spark):
    text = "{ " * 300 + '{"a": 1}'
    got = spark.createDataFrame([(text,)], "t STRING").select(tx.first_json_object(F.col("t")).alias("j"))
    assert got.first().j == '{"a": 1}'


def test_more_labels_than_any_list(spark):
    types = spark.range(12_000).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("label"))
    node = "array<struct<id:string,type:string,properties:map<string,string>>>"
    link = "array<struct<source:string,target:string,type:string,properties:map<string,string>>>"
    docs = spark.createDataFrame(
        [(1, [("a", "L11999", {}), ("b", "L3", {}), ("c", "X", {})],
          [("a", "b", "L7", {}), ("a", "c", "L7", {}), ("b", "a", "X", {})])],
        f"ord INT, nodes {node}, relationships {link}")
    nodes, edges = gr.build_graph(docs, types, types)
    assert sorted(r.id for r in nodes.collect()) == ["a", "b"]
    assert [(r.src, r.dst) for r in edges.collect()] == [("a", "b")]


def test_stream_reads_a_folder_table_and_an_empty_one(spark, tmp_path):
    docs = spark.createDataFrame([(i, "text " * i, "en", "s", 5 * i) for i in range(20)],
                                 "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    docs.repartition(4).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    run = load_all()[0]["stream_ingest_results"]
    assert run(spark, str(tmp_path / "many")).first().files == 20
    assert run(spark, str(tmp_path / "none")).first().files == 0


def test_no_temporary_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda name, default=None: default)})()
        sparkContext = type("S", (), {"master": "spark://head:7077"})()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Cluster())


def test_context_efficiency_and_judge_inputs(spark):
    found = spark.createDataFrame([("q", 1, "d", 0, 10, 10), ("q", 2, "x", 0, 30, 30), ("q", 6, "d", 0, 99, 99)],
                                  "query_id STRING, rank INT, doc_id STRING, start INT, end INT, n_chars INT")
    wanted = spark.createDataFrame([("q", "d", 4, 40)], "query_id STRING, doc_id STRING, start INT, end INT")
    assert ev.context_efficiency(found, wanted).first().context_efficiency_5 == round(6 / 40, 6)
    rows = spark.createDataFrame([("s", "c", 2, "b"), ("s", "c", 1, "a"), ("s", "gone", 1, "z")],
                                 "strategy STRING, case_id STRING, rank INT, chunk_id STRING")
    cases = spark.createDataFrame([("c", "why?")], "case_id STRING, question STRING")
    assert [tuple(r) for r in ev.judge_inputs(rows, cases).select("case_id", "question", "chunk_ids").collect()] \
        == [("c", "why?", ["a", "b"])]
