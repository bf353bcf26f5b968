"""The ingestion chain: failures stay with their file, replays and returns change nothing."""

import time

import pytest

from docmill.sources.index import VersionedTable
from docmill.streaming.chain import IngestChain, file_stream


def chunk(text):
    if "explode" in text:
        raise ValueError("no such table")
    return [text[i:i + 10] for i in range(0, len(text), 10)]


def embed(texts):
    if any("poison" in t for t in texts):
        raise RuntimeError("bad token")
    return [[len(t), t.count("a")] for t in texts]


FILES = {"aia/a.md": b"aaaa bbbb cccc dddd", "aia/b.md": b"explode", "bic/c.md": b"\xff\xfe broken", "bic/d.md": b"poison",
         "bic/e.md": b"x" * 95, "bic/g.md": b"aaaa bbbb cccc dddd", "bic/h.md": "Bảo hiểm sức khỏe".encode()}
GOOD = {"aia/a.md": 2, "bic/g.md": 2, "bic/h.md": 2}


@pytest.fixture
def place(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    return IngestChain(spark, str(tmp_path / "out"), chunk, embed, {"size": 10}, most_chunks=8), tmp_path / "in"


def run(spark, chain, folder, files_per_trigger=3):
    chain.start(file_stream(spark, str(folder), files_per_trigger=files_per_trigger)).awaitTermination()


def indexed(chain):
    return {r.chunk_id: (r.text, list(r.embedding)) for r in chain.index.read().collect()}


def want(files):
    return {f"{name}:{i}": (part, [len(part), part.count("a")])
            for name, data in files.items() for i, part in enumerate(chunk(data.decode()))}


def test_failures_stay_with_their_file(spark, place):
    chain, folder = place
    run(spark, chain, folder)
    got = {r.source_path: r for r in chain.results().collect()}
    assert {n: r.chunk_count for n, r in got.items() if r.status == "completed"} == GOOD
    assert {n: r.error for n, r in got.items() if r.status == "failed"} == {
        "aia/b.md": "ValueError: no such table", "bic/c.md": "UnicodeError: not UTF-8", "bic/d.md": "RuntimeError: bad token",
        "bic/e.md": "10 chunks are more than 8."}
    assert indexed(chain) == want({n: FILES[n] for n in GOOD})


def test_replay_and_restart_change_nothing(spark, place):
    chain, folder = place
    run(spark, chain, folder, 100)
    before, log = indexed(chain), sorted(chain.results().collect())
    batch = spark.createDataFrame([(n, n.split("/")[0], bytearray(d)) for n, d in FILES.items()], "source_path string, provider string, content binary")
    chain.process(batch, 0)  # the same batch again, as after a crash
    run(spark, chain, folder, 100)  # and nothing new
    assert indexed(chain) == before and sorted(chain.results().collect()) == log
    assert chain.index.table.versions() == [1]


def test_changed_files(spark, place):
    chain, folder = place
    run(spark, chain, folder, 100)
    batch = spark.createDataFrame(
        [("aia/a.md", "aia", bytearray(b"short")), ("aia/b.md", "aia", bytearray(b"mended now")), ("bic/g.md", "bic", bytearray(b"explode")),
         ("bic/new.md", "bic", bytearray(b"aaaa bbbb cccc dddd"))], "source_path string, provider string, content binary")
    chain.process(batch, 1)
    # a shorter file loses its tail, a failing one keeps what it had, and equal texts come from the cache
    now = {n: FILES[n] for n in GOOD} | {"aia/a.md": b"short", "aia/b.md": b"mended now", "bic/new.md": FILES["aia/a.md"]}
    assert indexed(chain) == want(now)
    got = {r.source_path: (r.status, r.cache_hit) for r in chain.results().collect()}
    assert got["bic/new.md"] == ("completed", True) and got["aia/a.md"] == ("completed", False) and got["bic/g.md"][0] == "failed"
    assert {r.batch for r in chain.cache.read().filter("text = 'aaaa bbbb '").collect()} == {1}


def test_first_batch_without_files(spark, place):
    chain, _ = place
    chain.process(spark.createDataFrame([], "source_path string, provider string, content binary"), 0)
    assert chain.index.read().count() == 0 and chain.results().count() == 0
    chain.process(spark.createDataFrame([("p", "x", bytearray(b"one"))], "source_path string, provider string, content binary"), 1)
    assert indexed(chain) == want({"p": b"one"})


def test_several_contents_under_a_path_and_nulls(spark, place):
    chain, _ = place
    batch = spark.createDataFrame([("p", None, bytearray(b"one")), ("p", None, bytearray(b"two")), ("q", "x", None), ("empty", "x", bytearray(b""))],
                                  "source_path string, provider string, content binary")
    chain.process(batch, 0)
    assert indexed(chain) == want({"p": b"two"})
    assert {r.source_path: r.status for r in chain.results().collect()} == {"p": "completed", "q": "failed", "empty": "completed"}
    chain.process(batch.limit(0), 1)
    assert indexed(chain) == want({"p": b"two"})


def test_contents_of_distinct_paths_are_not_moved(spark, place):
    chain, _ = place
    batch = spark.createDataFrame([(f"p{i}", "x", bytearray(b"text %d" % i)) for i in range(4)], "source_path string, provider string, content binary")
    none = spark.createDataFrame([], "again string")
    files = chain._files(batch, none)
    assert "Exchange" not in files._jdf.queryExecution().executedPlan().toString() and files.count() == 4
    assert {r.text for r in files.collect()} == {f"text {i}" for i in range(4)}


def test_paths_that_come_again_beside_others_and_without_a_path(spark, place, monkeypatch):
    chain, _ = place
    rows = [("p", "x", bytearray(b"one")), ("p", "y", bytearray(b"two")), ("q", "x", bytearray(b"only")), (None, "x", bytearray(b"a")), (None, "x", bytearray(b"b"))]
    batch = spark.createDataFrame(rows, "source_path string, provider string, content binary")
    for most in (1 << 16, 0):  # shipped paths and joined ones
        monkeypatch.setattr("docmill.streaming.chain.MANY_PATHS", most)
        again = batch.groupBy("source_path").count().filter("count > 1").selectExpr("source_path AS again")
        got = {(r.source_path, r.provider, r.text) for r in chain._files(batch, again).collect()}
        assert got == {("p", "y", "two"), ("q", "x", "only"), (None, "x", "b")}
    chain.process(batch, 0)
    assert indexed(chain) == want({"p": b"two", "q": b"only"})


def test_vectors_that_failed_before_are_tried_again(spark, place):
    chain, _ = place
    batch = spark.createDataFrame([("p", "x", bytearray(b"poison")), ("q", "x", bytearray(b"good"))], "source_path string, provider string, content binary")
    chain.process(batch, 0)
    assert indexed(chain) == want({"q": b"good"})
    chain.embed = lambda texts: [[len(t), t.count("a")] for t in texts]
    chain.process(batch.filter("source_path = 'p'"), 1)  # its chunks are those of the first batch
    assert indexed(chain) == want({"p": b"poison", "q": b"good"})
    assert chain.vectors.read().filter("batch = 2").count() == 1 and chain.cache.read().filter("batch = 2").count() == 0


def test_a_written_batch_leaves_no_shuffle_files(spark, tmp_path):
    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {b for b in map(str, (blocks.apply(i) for i in range(blocks.size()))) if b.startswith("shuffle_")}
    before = shuffled()
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(1000).repartition(3, "id"))
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and table.read().count() == 1000
    assert all("zstd" in p.name for p in (tmp_path / "t").rglob("part-*.parquet"))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
