"""Stored dense index: recall against exact search, changes, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import retrieval as rt
from docmill.sources import vector_index as V


def clustered(n, width, groups, seed=0):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((groups, width))[rng.integers(0, groups, n)] + 0.6 * rng.standard_normal((n, width))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def frame(spark, rows, kind="int"):
    name = "c{:05d}".format if kind == "string" else int
    return spark.createDataFrame([(name(i), None if v is None else list(map(float, v))) for i, v in rows.items()],
                                 f"chunk_id {kind}, embedding array<double>").repartition(4)


def asked(spark, rows):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in rows.items()], "query_id int, embedding array<double>")


def found(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize("data", ["clustered", "shapeless"])
def test_recall_against_exact_search(spark, tmp_path, monkeypatch, data):
    monkeypatch.setattr(V, "CELL_SIZE", 32)
    rows = clustered(3000, 24, 40) if data == "clustered" else clustered(3000, 24, 3000, 1)
    items = frame(spark, dict(enumerate(rows)))
    queries = asked(spark, dict(enumerate(clustered(60, 24, 40, 0) if data == "clustered" else rows[:60])))
    index = V.VectorIndex(spark, str(tmp_path / "v"))
    index.create(items)
    want = {(q, i) for q, _, i, _ in found(rt.dense_topk(queries, items, 10))}
    got = {(q, i) for q, _, i, _ in found(index.search(queries, 10))}
    points, probes = index.centroids()
    assert len(want & got) >= 0.9 * len(want) and len(points) > 50
    if data == "clustered":
        assert probes < len(points) / 2  # and most cells stay unread
    assert found(index.search(queries, 10, probes=len(points))) == found(rt.dense_topk(queries, items, 10))


def test_changes_and_ties(spark, tmp_path, monkeypatch, kind="string"):
    monkeypatch.setattr(V, "CELL_SIZE", 40)
    monkeypatch.setattr(V, "PASS_QUERIES", 3)
    monkeypatch.setattr(V, "BLOCK", 16)
    rows = dict(enumerate(clustered(200, 6, 10)))
    rows |= {i: rows[0] for i in range(200, 260)}  # equal vectors
    index = V.VectorIndex(spark, str(tmp_path / "v"))
    index.create(frame(spark, rows, kind))
    queries, every = asked(spark, {i: rows[i] for i in range(5)}), 10 ** 6

    def same():
        return found(index.search(queries, 5, probes=every)) == found(rt.dense_topk(queries, frame(spark, rows, kind), 5))
    assert same()
    moved = {0: rows[7], 5: -rows[5], 300: rows[3]}
    index.upsert(frame(spark, moved, kind))
    rows |= moved
    assert same()
    index.delete(frame(spark, {i: None for i in (200, 3, 9999)}, kind).select("chunk_id"))
    rows.pop(200), rows.pop(3)
    assert same()
    index.upsert(frame(spark, {3: rows[7]}, kind))
    rows[3] = rows[7]
    assert same()


def test_odd_vectors_and_nothing(spark, tmp_path):
    good = dict(enumerate(clustered(30, 4, 3)))
    items = frame(spark, good).unionByName(spark.createDataFrame(
        [(100, None), (101, []), (102, [1.0, 0.0]), (103, [1.0, None, 0.0, 0.0]), (104, [1.0, float("nan"), 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])],
        "chunk_id int, embedding array<double>"))
    index = V.VectorIndex(spark, str(tmp_path / "v"))
    index.create(items)
    queries = asked(spark, {1: good[1]}).unionByName(spark.createDataFrame([(2, None), (3, [1.0])], "query_id int, embedding array<double>"))
    assert found(index.search(queries, 40)) == found(rt.dense_topk(asked(spark, {1: good[1]}), frame(spark, good), 40))
    empty = V.VectorIndex(spark, str(tmp_path / "none"))
    empty.create(items.limit(0))
    assert empty.search(queries, 5).count() == 0 and index.search(queries.limit(0), 5).count() == 0


def test_only_probed_cells_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "CELL_SIZE", 16)
    rows = dict(enumerate(clustered(400, 8, 20)))
    index = V.VectorIndex(spark, str(tmp_path / "v"))
    index.create(frame(spark, rows))
    scan = index.live().filter(F.col("cell").isin([1, 2]))
    assert {int(f.split("cell=")[1].split("/")[0]) for f in index.table.read().inputFiles()} > {1, 2}
    assert "PartitionFilters: [cell" in scan._jdf.queryExecution().executedPlan().toString()
