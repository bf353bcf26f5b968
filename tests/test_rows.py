"""Row functions as Arrow UDFs: results as row by row, and few objects at a time."""

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from docmill.functions import rows
from docmill.functions import text as tx
from docmill.operators.chunking import splitters as sp


def test_a_task_holds_a_slice_and_not_a_batch(monkeypatch):
    monkeypatch.setattr(rows, "SLICE_ROWS", 8)
    called = []

    def count(t):
        called.append(t)
        return len(t)
    out = rows.each_row(count, T.IntegerType()).func(iter([pa.array(["x" * i for i in range(100)])]))
    assert next(out).to_pylist() == list(range(8)) and len(called) == 8
    assert [v for a in out for v in a.to_pylist()] == list(range(8, 100))


@pytest.mark.parametrize("rows_of_batch", [1, 7, 1000])
def test_slices_give_every_row_its_own_parts(spark, monkeypatch, rows_of_batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_of_batch)
    try:
        given = [(i, None if i % 10 == 3 else "" if i % 10 == 4 else f"doc {i}. " * (i % 7) + "Café") for i in range(300)]
        frame = spark.createDataFrame(given, "id int, text string").repartition(2)
        split = frame.withColumn("parts", sp.recursive_split("text", 12, 3))
        located = split.withColumn("at", sp.locate_parts("text", tx.F.col("parts.text"))).withColumn("nfc", tx.nfc("text"))
        for r in located.collect():
            t = given[r.id][1]
            assert (r.parts is None) == (t is None) == (r.nfc is None) == (r.at is None)
            if t is not None:
                assert [(p.start, p.end) for p in r.parts] == list(sp.recursive_spans(t, 12, 3, sp.DEFAULT))
                assert len(r.at) == len(r.parts) and r.nfc == t.replace("é", "é")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
