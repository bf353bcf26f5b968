"""Discovery runs: failures, time limits, resumption."""

import time

from docmill.operators import discovery as D
from docmill.sources.index import VersionedTable


def extract(text, attempt):
    if text is None:
        return "null"
    if text.startswith("slow"):
        time.sleep(30)
    if text.startswith("fails") and attempt <= int(text[-1]):
        raise ValueError(f"try {attempt}")
    return text.upper()


CHUNKS = [("a", "fine"), ("b", "fails 1"), ("c", "fails 2"), ("d", "fails 9"), ("e", "slow"), ("f", None), ("a", "earlier")]


def table(spark, rows=CHUNKS):
    return spark.createDataFrame(rows, "chunk_id string, text string").repartition(2)


def told(df):
    return {r.chunk_id: (r.attempts, r.status, r.result, r.error) for r in df.collect()}


WANT = {"a": (1, "success", "FINE", None), "b": (2, "success", "FAILS 1", None), "c": (3, "success", "FAILS 2", None),
        "d": (3, "error", None, "ValueError: try 3"), "e": (3, "timeout", None, "OutOfTime: longer than 0.2 s"), "f": (1, "success", "null", None)}


def test_attempts_are_limited_and_kept(spark, tmp_path):
    log = VersionedTable(spark, str(tmp_path / "log"))
    assert told(D.discover(table(spark), log, extract, 3, 0.2)) == WANT
    assert log.versions() == [1, 2, 3] and log.read().filter("chunk_id = 'a'").count() == 1
    # nothing is left to do
    assert told(D.discover(table(spark), log, extract, 3, 0.2)) == WANT and len(log.versions()) == 3


def test_a_cut_off_run_goes_on(spark, tmp_path):
    log = VersionedTable(spark, str(tmp_path / "log"))
    assert {k: v[:2] for k, v in told(D.discover(table(spark), log, extract, 3, 0.2, rounds=0)).items()} == {k: (0, "pending") for k in WANT}
    D.discover(table(spark), log, extract, 3, 0.2, rounds=1)
    # a half-written batch has no success marker and does not count
    (tmp_path / "log" / "batch=00000002").mkdir()
    (tmp_path / "log" / "batch=00000002" / "part-0.parquet").write_bytes(b"broken")
    more = [*CHUNKS, ("z", "new")]
    assert told(D.discover(table(spark, more), log, extract, 3, 0.2)) == WANT | {"z": (1, "success", "NEW", None)}


def test_no_chunks(spark, tmp_path):
    log = VersionedTable(spark, str(tmp_path / "log"))
    assert told(D.discover(table(spark, CHUNKS[:0]), log, extract)) == {}
