import json

import pytest
from pyspark.sql import functions as F

from docmill.operators import graph as gr
from docmill.operators.chunking import research as rs
from docmill.sources import files as src
from docmill.sources import index as ix
from docmill.streaming import ingest as ing


@pytest.fixture
def corpus_dir(tmp_path):
    for name, text in {"aia/b.md": "# B\r\ntext", "aia/a b.md": "# A", "bic/c.md": " \n",
                       "bic/benchmark/d.md": "x"}.items():
        path = tmp_path / "corpus" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8", newline="")
    return str(tmp_path / "corpus")


def test_markdown_corpus(spark, corpus_dir):
    every = src.markdown_corpus(spark, corpus_dir).collect()
    assert sorted((r.source_path, r.provider) for r in every) == [
        ("aia/a b.md", "aia"), ("aia/b.md", "aia"), ("bic/benchmark/d.md", "bic"),
        ("bic/c.md", "bic")]
    kept = src.markdown_corpus(spark, corpus_dir, exclude=src.EXCLUDED_MARKERS, normalise=True)
    assert {r.source_path: r.text for r in kept.collect()} == {
        "aia/a b.md": "# A", "aia/b.md": "# B\ntext"}
    first = src.markdown_corpus(spark, corpus_dir, limit=2, preferred=["bic/c.md"]).collect()
    assert [r.source_path for r in first] == ["bic/c.md", "aia/a b.md"]
    assert src.one_document(spark, corpus_dir, "aia/b.md").count() == 1


def test_jsonl_and_cases(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text(json.dumps({"id": "1", "query": "q", "expected_sources": [
        {"source_path": "a.md", "line_start": 1}]}) + "\n\n")
    case = src.benchmark_cases(spark, str(path)).first()
    assert (case.case_id, case.question, case.gold_answer) == ("1", "q", "")
    assert case.expected_sources[0].line_end is None
    with pytest.raises(Exception, match="required field: source_path"):
        src.production_cases(src.read_jsonl(spark, str(path), src.CASE_SCHEMA)).collect()
    bad = tmp_path / "bad.jsonl"
    bad.write_text("[1]\n")
    with pytest.raises(Exception, match="not an object"):
        src.read_jsonl(spark, str(bad), "a INT").collect()


def test_csv_and_extractions(spark, tmp_path):
    df = src.union_columns([spark.createDataFrame([(1, ["x"])], "b INT, l ARRAY<STRING>"),
                            spark.createDataFrame([(2,)], "a INT")])
    assert df.columns == ["b", "l", "a"]
    src.write_csv(df, str(tmp_path / "csv"), sorted_columns=True)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["a", "b", "l"] and '["x"]' in {r.l for r in back.collect()}
    (tmp_path / "x" / "classification_output").mkdir(parents=True)
    (tmp_path / "x" / "a.json").write_text("{}")
    (tmp_path / "x" / "classification_output" / "r.json").write_text("{}")
    assert [r.path for r in src.extraction_files(spark, str(tmp_path / "x")).collect()] == ["a.json"]


def test_index_upsert_and_delete(spark, tmp_path):
    index = ix.ChunkIndex(spark, str(tmp_path / "index"))
    schema = "chunk_id STRING, company_code STRING, text STRING"
    index.upsert(spark.createDataFrame([("a", "aia", "Bảo hiểm"), ("b", "bic", "x")], schema))
    index.upsert(spark.createDataFrame([("a", "aia", "mới")], schema))
    got = {r.chunk_id: (r.text, r.search_text) for r in index.read().collect()}
    assert got == {"a": ("mới", "moi"), "b": ("x", "x")}
    nothing = spark.createDataFrame([], "chunk_id STRING")
    assert index.delete(nothing) is None and len(index.table.versions()) == 2
    index.delete(spark.createDataFrame([("a",)], "chunk_id STRING"))
    assert [r.chunk_id for r in index.read().collect()] == ["b"]


def test_chunk_cache(spark, tmp_path):
    calls = []

    def chunk(docs):
        calls.append(1)
        return rs.fixed(docs, 2, 0).join(docs.select("doc_id", "cache_key"), "doc_id")
    docs = spark.createDataFrame([(1, "aaaabbbbcccc"), (2, "dddd")], "doc_id INT, text STRING")
    cache = ix.VersionedTable(spark, str(tmp_path / "cache"))
    first = ix.chunk_with_cache(docs, cache, {"size": 2}, chunk)
    assert first.count() == 3
    assert ix.chunk_with_cache(docs, cache, {"size": 2}, chunk).count() == 3 and len(calls) == 1
    more = docs.unionByName(spark.createDataFrame([(3, "eeee")], docs.schema))
    assert ix.chunk_with_cache(more, cache, {"size": 2}, chunk).count() == 4 and len(calls) == 2


def test_streaming_ingest_resumes(spark, corpus_dir, tmp_path):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def chunk(batch):
        named = batch.withColumn("doc_id", F.col("source_path"))
        return rs.fixed(named).withColumnRenamed("doc_id", "source_path")

    def run():
        stream = ing.markdown_stream(spark, corpus_dir, 1)
        ing.ingest_stream(stream, chunk, out, ckpt).awaitTermination()
        return spark.read.parquet(f"{out}/results").count()
    assert run() == 4
    assert run() == 4  # nothing new
    with open(f"{corpus_dir}/aia/new.md", "w") as f:
        f.write("new text")
    assert run() == 5


def test_pending_and_remaining_work(spark):
    chunks = spark.createDataFrame([("a",), ("b",), ("c",)], "chunk_id STRING")
    log = spark.createDataFrame([("a", 1, "success"), ("b", 1, "success"), ("b", 2, "error")],
                                "chunk_id STRING, offset INT, status STRING")
    assert sorted(r.chunk_id for r in gr.pending_chunks(chunks, log).collect()) == ["b", "c"]
    items = spark.createDataFrame([("s1", 900), ("s2", 900)], "strategy STRING, size INT")
    done = spark.createDataFrame([("s1", 900, "success")],
                                 "strategy STRING, size INT, status STRING")
    assert ing.remaining_work(items, done, ["strategy", "size"]).first().strategy == "s2"


def test_filters_skip_row_groups(spark, tmp_path):
    """Each filter field lets the scan pass over most row groups."""
    index = ix.ChunkIndex(spark, str(tmp_path / "index"), {"parquet.block.size": 16384, "parquet.page.row.count.limit": 200})
    n = 6000
    rows = spark.range(n).coalesce(1).select(
        F.format_string("c%05d", "id").alias("chunk_id"), F.lit("aia").alias("company_code"), F.lit("some words of a chunk").alias("text"),
        F.format_string("type%d", F.floor(F.col("id") / 1500)).alias("document_type"), F.format_string("line%d", F.floor(F.col("id") / 500)).alias("product_line"),
        F.format_string("plan%d", F.floor(F.col("id") / 200)).alias("plan_code"), F.format_string("section%d", F.floor(F.col("id") / 100)).alias("section_type"),
        F.sha2(F.floor(F.col("id") / 50).cast("string"), 256).alias("document_id"))
    index.upsert(rows)
    wanted = {"document_type": "type2", "product_line": "line7", "plan_code": "plan11", "section_type": "section40",
              "document_id": rows.filter("chunk_id = 'c03333'").first().document_id}
    for field, value in wanted.items():
        found = index.table.read().filter(F.col(field) == value)
        want = rows.filter(F.col(field) == value).count()
        assert len(found.collect()) == want == index.read().filter(F.col(field) == value).count()
        plan = found._jdf.queryExecution().executedPlan()
        read = plan.collectLeaves().head().metrics().apply("numOutputRows").value()
        assert want <= read < n / 2, (field, read)
