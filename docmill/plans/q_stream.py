"""Registered queries: event-time streams and the whole ingestion chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.plans.registry import query
from docmill.session import scratch_path, spread, table
from docmill.streaming import events as evt
from docmill.streaming.chain import IngestChain
from docmill.streaming.ingest import record_stream

# Events arrive up to an hour late, in four files; the watermark allows for two hours.
DELAY = "2 hours"
FINAL = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


def _arrivals(spark, sf, repeated=False):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    late = F.timestamp_micros(F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(3600)) * 1_000_000)
    rows = e.withColumn("arrived", late)
    if repeated:  # every fourth event comes again, within another hour
        again = rows.filter("event_id % 4 = 0").withColumn("arrived", F.col("arrived") + F.expr("INTERVAL 50 MINUTES"))
        rows = rows.unionByName(again)
    folder = scratch_path(spark, "arrivals")
    evt.deal(rows, "arrived", folder, 4)
    return evt.arrivals(spark, folder, rows.schema)


def _ran(spark, stream):
    out = scratch_path(spark, "stream")
    rows = evt.appended(stream, out, f"{out}-checkpoint")
    # as the table has them: without a zone
    return rows.select(*[F.col(n).cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(n) for n, t in rows.dtypes])


@query("stream_tumbling_counts", f"""
    SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
           event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM events GROUP BY 1, 2, 3 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {FINAL}""")
def stream_tumbling_counts(spark, sf):
    out = _ran(spark, evt.tumbling(_arrivals(spark, sf), "ts", ["event_type"], "1 hour", DELAY, "value"))
    return out.withColumn("total", F.round("total", 4))


@query("stream_sliding_counts", f"""
    SELECT s AS window_start, s + INTERVAL 2 HOUR AS window_end, count(*) AS n, round(sum(value), 4) AS total
    FROM (SELECT value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events)
    GROUP BY s HAVING window_end <= {FINAL}""")
def stream_sliding_counts(spark, sf):
    out = _ran(spark, evt.tumbling(_arrivals(spark, sf), "ts", [], "2 hours", DELAY, "value", "1 hour"))
    return out.withColumn("total", F.round("total", 4))


@query("stream_session_users", f"""
    WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE
                         THEN 0 ELSE 1 END AS cut FROM events),
    s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n,
           round(sum(value), 4) AS total
    FROM s GROUP BY user_id, k HAVING session_end <= {FINAL}""")
def stream_session_users(spark, sf):
    out = _ran(spark, evt.sessions(_arrivals(spark, sf), "ts", ["user_id"], "30 minutes", DELAY, "value"))
    return out.withColumn("total", F.round("total", 4))


@query("stream_dedupe", "SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_dedupe(spark, sf):
    stream = evt.distinct_events(_arrivals(spark, sf, True), "ts", ["event_id"], "3 hours").drop("arrived")
    return _ran(spark, stream)


@query("stream_attribution", """
    SELECT c.user_id, c.event_id AS click_id, c.ts AS cause_ts, p.event_id AS purchase_id, p.ts AS effect_ts, p.value
    FROM events c JOIN events p ON p.user_id = c.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOUR
    WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def stream_attribution(spark, sf):
    """Purchases with the clicks of the same user in the six hours before."""
    clicks = _arrivals(spark, sf).filter("event_type = 'click'").select(
        "user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("cause_ts"))
    buys = _arrivals(spark, sf).filter("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("effect_ts"), "value")
    return _ran(spark, evt.attributed(clicks, buys, "user_id", "6 HOURS", DELAY))


# --- ingestion chain --------------------------------------------------------------------------------

def _chunk(text):
    if "|" in text:
        raise ValueError("no reader for tables")
    return [text[i:i + 1000] for i in range(0, len(text), 1000)]


def _embed(texts):
    if any("%%%" in t for t in texts):
        raise RuntimeError("odd signs")
    return [[float(len(t)), float(t.count("e"))] for t in texts]


CHAIN = """WITH d AS (SELECT *, source || '/' || doc_id || '.md' AS source_path, CAST(ceil(length(text) / 1000.0) AS INTEGER) AS parts FROM documents),
    j AS (SELECT *, CASE WHEN doc_id % 11 = 3 THEN 'UnicodeError: not UTF-8' WHEN contains(text, '|') THEN 'ValueError: no reader for tables'
                         WHEN parts > 12 THEN parts || ' chunks are more than 12.'
                         WHEN list_bool_or(list_transform(range(0, parts), lambda i: contains(substr(text, i * 1000 + 1, 1000), '%%%')))
                         THEN 'RuntimeError: odd signs' END AS error FROM d)"""


def _chain(spark, sf):
    """All documents through the chain twice: the second run, without its checkpoint, repeats every batch."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    raw = F.encode("text", "UTF-8")
    files = spread(table(spark, sf, "documents")).select(
        path.alias("source_path"), F.col("source").alias("provider"),
        F.when(F.col("doc_id") % 11 == 3, F.concat(F.unhex(F.lit("FF")), raw)).otherwise(raw).alias("content"))
    root = scratch_path(spark, "chain")
    for part in (0, 1):
        files.filter(F.pmod(F.xxhash64("source_path"), F.lit(2)) == part).coalesce(8).write.mode("append").option("compression", "zstd").parquet(f"{root}/files")
    chain = IngestChain(spark, root, _chunk, _embed, {"size": 1000}, most_chunks=12)
    for run in (1, 2):
        stream = record_stream(spark, f"{root}/files", files.schema)
        chain.start(stream, f"{root}/checkpoint-{run}").awaitTermination()
    return chain


@query("stream_chain_results", CHAIN + """
    SELECT source_path, source AS provider, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status,
           CASE WHEN error IS NULL THEN parts ELSE 0 END AS chunk_count, CASE WHEN error IS NULL THEN length(text) END AS total_chars, error
    FROM j""")
def stream_chain_results(spark, sf):
    return _chain(spark, sf).results().select("source_path", "provider", "status", "chunk_count", "total_chars", "error")


@query("stream_chain_chunks", CHAIN + """
    SELECT source_path || ':' || i AS chunk_id, md5(substr(text, i * 1000 + 1, 1000)) AS text_md5,
           CAST(length(substr(text, i * 1000 + 1, 1000)) AS DOUBLE) AS first_component
    FROM (SELECT *, unnest(range(0, parts)) AS i FROM j WHERE error IS NULL)""")
def stream_chain_chunks(spark, sf):
    return _chain(spark, sf).index.read().select("chunk_id", F.md5("text").alias("text_md5"), F.col("embedding")[0].alias("first_component"))
