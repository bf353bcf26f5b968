"""Registered queries: chunking operators over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.operators import evaluation as ev
from docmill.operators.chunking import markdown as md
from docmill.operators.chunking import planning as pl
from docmill.operators.chunking import production as pr
from docmill.operators.chunking import research as rs
from docmill.operators.chunking import strategies as st
from docmill.plans.corpus import DOCS_CTE, PAGES_CTE, documents_corpus, pages_corpus
from docmill.plans.registry import query


def docs(spark, sf):
    return documents_corpus(spark, sf)


def pages(spark, sf):
    return pages_corpus(spark, sf).withColumnRenamed("page_id", "doc_id")


def digest(chunks, *keys):
    """Chunks without their text: its hash and length keep the result light."""
    keep = [c for c in chunks.columns if c not in ("text", "metadata", *keys)]
    return chunks.select(*keys, *keep, F.length("text").alias("n_chars"),
                         F.md5("text").alias("text_md5"))


FIXED_SQL = """WITH fx AS (
    SELECT doc_id, i AS chunk_index, i * 1040 AS start, substr(text, i * 1040 + 1, 1200) AS t
    FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0,
                 ceil((length(text) - 1200) / 1040.0)) AS BIGINT) + 1)) AS i
          FROM documents WHERE length(text) > 0))"""


@query("chunk_fixed", FIXED_SQL + """
    SELECT doc_id, chunk_index, start, start + length(t) AS "end",
           CAST(ceil(length(t) / 4.0) AS INT) AS tokens, length(t) AS n_chars,
           md5(t) AS text_md5, 'fixed' AS method FROM fx""")
def chunk_fixed(spark, sf):
    return digest(rs.fixed(docs(spark, sf)))


@query("chunk_fixed_statistics", FIXED_SQL + """
    SELECT d.lang, count(*) AS chunk_count, min(length(t)) AS min_chars,
           max(length(t)) AS max_chars, CAST(sum(length(t)) AS BIGINT) AS total_chars,
           round(avg(length(t)), 2) AS avg_chars,
           count(*) FILTER (len(list_filter(string_split(t, chr(10)), lambda ln:
             length(ln) - length(replace(ln, '|', '')) >= 2
             AND NOT starts_with(trim(ln), '```'))) > 0) AS table_chunk_count
    FROM fx JOIN documents d USING (doc_id) GROUP BY d.lang""")
def fixed_statistics(spark, sf):
    from docmill.session import table

    langs = table(spark, sf, "documents").select("doc_id", "lang")
    return ev.chunk_statistics(rs.fixed(docs(spark, sf)).join(langs, "doc_id"), ["lang"])


@query("chunk_fixed_coherence", FIXED_SQL + r"""
    SELECT count(*) AS total_chunks, round(avg(length(t)), 2) AS avg_chunk_size,
           round(1 - (count(*) FILTER (regexp_matches(t, '^[\p{Ll},;:)\]}]'))
                      + count(*) FILTER (NOT regexp_matches(t, '[.!?]\s*$')))
                     / (2.0 * count(*)), 2) AS chunk_coherence,
           round(1 - stddev_pop(length(t)) / greatest(1.0, avg(length(t))), 2)
             AS size_consistency, 'fixed' AS method
    FROM fx""")
def fixed_coherence(spark, sf):
    return ev.chunk_coherence(rs.fixed(docs(spark, sf)), ["method"])


LINES = f"""WITH {PAGES_CTE},
    l AS (SELECT page_id AS doc_id, i, list_extract(ls, i) AS line, len(ls) AS n
          FROM (SELECT page_id, string_split(text, chr(10)) AS ls FROM pages_md) s,
               unnest(range(1, len(ls) + 1)) AS u(i))"""
HEADS = LINES + r""",
    h AS (SELECT doc_id, i, n, length(regexp_extract(line, '^(#{1,6})\s+\S', 1)) AS level
          FROM l WHERE regexp_matches(line, '^#{1,6}\s+\S')),
    nx AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), n + 1) AS stop
           FROM h),
    s AS (SELECT nx.doc_id, nx.i, nx.level, sum(length(l.line)) AS chars
          FROM nx JOIN l ON l.doc_id = nx.doc_id AND l.i >= nx.i AND l.i < nx.stop
          GROUP BY ALL),
    a AS (SELECT CAST(level AS INT) AS level, count(*) AS heading_count,
                 round(avg(chars), 4) AS avg_chars_after FROM s GROUP BY level)"""


@query("heading_statistics", HEADS + """
    SELECT level, heading_count, avg_chars_after,
           CASE WHEN avg_chars_after < 500 THEN 'too_small_do_not_cut'
                WHEN avg_chars_after < 1500 THEN 'small_cut_then_merge'
                WHEN avg_chars_after <= 6000 THEN 'ideal_cut_here'
                ELSE 'large_cut_deeper' END AS recommendation FROM a""")
def heading_statistics(spark, sf):
    return md.heading_statistics(pages(spark, sf))


@query("heading_cut_level", HEADS + """
    SELECT coalesce(min(level) FILTER (avg_chars_after BETWEEN 1500 AND 6000),
                    arg_min(level, abs(avg_chars_after - 3000)), 2) AS cut_level FROM a""")
def heading_cut_level(spark, sf):
    return md.cut_level(md.heading_statistics(pages(spark, sf)))


@query("markdown_blocks", LINES + """,
    k AS (SELECT doc_id, i, line, length(line) - length(replace(line, '|', '')) >= 2
                 AND NOT starts_with(trim(line), '```') AS tab FROM l),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, tab ORDER BY i) AS grp FROM k),
    b AS (SELECT doc_id, tab, min(i) AS first, string_agg(line, chr(10) ORDER BY i) AS t
          FROM g GROUP BY doc_id, tab, grp)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS block,
           CASE WHEN tab THEN 'table' ELSE 'prose' END AS kind, md5(t) AS text_md5
    FROM b WHERE trim(t, chr(10) || ' ') <> ''""")
def markdown_blocks(spark, sf):
    rows = pages(spark, sf).select("doc_id", F.posexplode(md.blocks(F.col("text")))
                                   .alias("block", "b"))
    return rows.select("doc_id", F.col("block").cast("bigint").alias("block"),
                       F.col("b.kind").alias("kind"), F.md5("b.text").alias("text_md5"))


@query("markdown_tables", LINES + """,
    k AS (SELECT doc_id, i, line, starts_with(trim(line), '|') AS tab FROM l),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, tab ORDER BY i) AS grp FROM k),
    b AS (SELECT doc_id, count(*) AS n, min(i) AS first,
                 string_agg(line, chr(10) ORDER BY i) AS t
          FROM g WHERE tab GROUP BY doc_id, grp HAVING count(*) > 1)
    SELECT doc_id, md5(t) AS table_md5, 'Bảng Markdown gồm ' || (n - 2)
           || ' dòng dữ liệu với các cột: text, link.' AS summary FROM b""")
def markdown_tables(spark, sf):
    rows = pages(spark, sf).select("doc_id", F.explode(md.extract_tables(F.col("text")))
                                   .alias("t"))
    return rows.select("doc_id", F.md5("t").alias("table_md5"),
                       md.table_summary(F.col("t")).alias("summary"))


@query("chunk_discovery_sections", f"""
    WITH {DOCS_CTE}
    SELECT doc_id, i AS chunk_index, length(trim(t, chr(10) || ' ')) AS n_chars,
           sha256(trim(t, chr(10) || ' ')) AS content_hash
    FROM (SELECT doc_id, i, substr(text, i * 11800 + 1, 12000) AS t
          FROM (SELECT doc_id, trim(text, chr(10) || ' ') AS text FROM docs) d,
               unnest(range(0, CAST(greatest(0, ceil((length(text) - 12000) / 11800.0))
                                    AS BIGINT) + 1)) AS u(i))
    WHERE trim(t, chr(10) || ' ') <> ''""")
def discovery_sections(spark, sf):
    return rs.discovery_packs(docs(spark, sf), 12000, 200).drop("text")


def shaped(name, build, corpus, sql=None):
    @query(name, sql)
    def run(spark, sf):
        return digest(build(corpus(spark, sf)))


for _name, _build in st.STRATEGIES.items():
    shaped(f"strategy_{_name}", _build, pages_corpus)

def cut_sql(method: str, pattern: str) -> str:
    """Spans between heading lines, from line offsets."""
    return LINES + rf""",
    o AS (SELECT doc_id, i, line, coalesce(sum(length(line) + 1) OVER (
            PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS start FROM l),
    c AS (SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start),
            (SELECT length(text) FROM pages_md p WHERE p.page_id = o.doc_id)) AS stop
          FROM o WHERE i = 1 OR regexp_matches(line, '{pattern}')),
    t AS (SELECT c.doc_id, start, stop, trim(substr(text, CAST(start AS BIGINT) + 1,
            CAST(stop - start AS BIGINT)), chr(10) || ' ') AS t
          FROM c JOIN pages_md p ON p.page_id = c.doc_id)
    SELECT doc_id, '{method}' AS method, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1
             AS chunk_index, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end",
           CAST(ceil(length(t) / 4.0) AS INT) AS tokens, length(t) AS n_chars, md5(t) AS text_md5
    FROM t WHERE t <> ''"""


for _name, _pattern in (("markdown", r"^#{1,3}\s+.+$"), ("regex", r"^#{1,4}\s+.+$")):
    query(f"method_{_name}", cut_sql(_name, _pattern))(
        lambda spark, sf, build=rs.METHODS[_name]: digest(build(pages(spark, sf))))
for _name, _build in rs.METHODS.items():
    if _name not in ("fixed", "markdown", "regex"):
        shaped(f"method_{_name}", _build, pages if "markdown" in _name or _name == "regex"
               else docs)
# Packs as a walk over the parts of all documents at once: the state is a pack's number and size.
PACKED = {
    "sentence_packs": r"""
    WITH RECURSIVE s AS (
        SELECT doc_id, s, length(s) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i
        FROM (SELECT doc_id, unnest(parts) AS s, unnest(range(1, len(parts) + 1)) AS i FROM (
                SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))
                       AS parts FROM documents)) WHERE s <> ''),
    w AS (SELECT doc_id, i, n AS size, 0 AS pack FROM s WHERE i = 1
          UNION ALL
          SELECT s.doc_id, s.i, CASE WHEN size + n > 500 THEN n ELSE size + n END,
                 pack + CAST(size + n > 500 AS INT) FROM w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i + 1),
    t AS (SELECT doc_id, pack, string_agg(s, ' ' ORDER BY i) AS t FROM w JOIN s USING (doc_id, i) GROUP BY ALL)
    SELECT doc_id, pack AS chunk_index, length(t) AS n_chars, md5(t) AS text_md5 FROM t""",
    "paragraph_packs": f"""
    WITH RECURSIVE {PAGES_CTE}, s AS (
        SELECT page_id AS doc_id, p, length(p) AS n, row_number() OVER (PARTITION BY page_id ORDER BY i) AS i
        FROM (SELECT page_id, unnest(parts) AS p, unnest(range(1, len(parts) + 1)) AS i FROM (
                SELECT page_id, string_split(text, chr(10) || chr(10)) AS parts FROM pages_md))
        WHERE trim(p, chr(10) || chr(13) || chr(9) || ' ') <> ''),
    w AS (SELECT doc_id, i, n + 2 AS size, 0 AS pack FROM s WHERE i = 1
          UNION ALL
          SELECT s.doc_id, s.i, CASE WHEN size + n >= 500 THEN n + 2 ELSE size + n + 2 END,
                 pack + CAST(size + n >= 500 AS INT) FROM w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i + 1),
    t AS (SELECT doc_id, pack, trim(string_agg(p, chr(10) || chr(10) ORDER BY i), chr(10) || chr(13) || chr(9) || ' ')
                 AS t FROM w JOIN s USING (doc_id, i) GROUP BY ALL),
    c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS packs FROM t),
    g AS (SELECT doc_id, CASE WHEN packs > 20 THEN pack // (packs // 20 + 1) ELSE pack END AS chunk_index,
                 string_agg(t, chr(10) || chr(10) ORDER BY pack) AS t FROM c GROUP BY ALL),
    k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total_chunks,
                 regexp_extract_all(lower(t), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS words FROM g)
    SELECT doc_id, chunk_index, total_chunks, length(t) AS chunk_size,
           CAST(round(CAST(chunk_index / total_chunks AS DECIMAL(18, 10)), 2) AS DOUBLE) AS document_position,
           len(words) AS word_count, len(list_distinct(words)) AS unique_words,
           CAST(round(CAST(len(list_distinct(words)) / greatest(1, len(words)) AS DECIMAL(18, 10)), 2) AS DOUBLE)
             AS word_density, length(t) AS n_chars, md5(t) AS text_md5 FROM k""",
    "context_blocks": f"""
    WITH RECURSIVE {PAGES_CTE}, l AS (
        SELECT page_id AS doc_id, i, ls[i] AS line, len(ls) AS last,
               len(regexp_extract_all(ls[i], '[^ \\t\\n\\r]+')) AS n,
               length(ls[i]) - length(replace(ls[i], '|', '')) >= 2 AS pipes,
               regexp_matches(ls[i], '^\\s*\\|?\\s*:?-{{3,}}:?\\s*(\\|\\s*:?-{{3,}}:?\\s*)+\\|?\\s*$') AS ruler
        FROM (SELECT page_id, string_split(text, chr(10)) AS ls FROM pages_md), unnest(range(1, len(ls) + 1)) AS u(i)),
    f AS (SELECT *, pipes OR ruler AS tab, coalesce(lead(ruler) OVER (PARTITION BY doc_id ORDER BY i), false) AS under FROM l),
    e AS (SELECT *, tab OR coalesce(lead(tab) OVER (PARTITION BY doc_id ORDER BY i), false) AS beside FROM f),
    w AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS size, 0 AS block, false AS closed
          FROM l WHERE i = 1
          UNION ALL
          SELECT e.doc_id, e.i, CASE WHEN closed THEN 0 ELSE size END + n, block + CAST(closed AS INT),
                 CASE WHEN closed THEN 0 ELSE size END + n >= 1500 AND NOT beside
          FROM w JOIN e ON e.doc_id = w.doc_id AND e.i = w.i + 1),
    b AS (SELECT w.doc_id, block, i, line, n, sum(n) OVER (PARTITION BY w.doc_id, block) AS words,
                 max(block) OVER (PARTITION BY w.doc_id) AS tail FROM w JOIN l USING (doc_id, i)),
    m AS (SELECT *, CASE WHEN block = tail AND block > 0 AND words < 80 THEN block - 1 ELSE block END AS home FROM b),
    x AS (SELECT doc_id, home, min(i) FILTER (trim(line) <> '') AS a, max(i) FILTER (trim(line) <> '') AS z,
                 sum(n) AS token_count FROM m GROUP BY ALL),
    t AS (SELECT x.doc_id, home, a, z, token_count, string_agg(line, chr(10) ORDER BY i) AS t,
                 coalesce(bool_or(pipes AND under AND i < z), false) AS contains_table
          FROM x JOIN f ON f.doc_id = x.doc_id AND i BETWEEN a AND z GROUP BY ALL)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY home) - 1 AS chunk_index, a AS start_line,
           z AS end_line, CAST(token_count AS BIGINT) AS token_count, contains_table, length(t) AS n_chars, md5(t) AS text_md5
    FROM t""",
}
for _name in ("adaptive_semantic_density", "late_context", "evidence_spans", "with_nearest_heading",
              "typed_sections", "protected_structures", "paragraph_packs"):
    shaped(f"chunk_{_name}", getattr(rs, _name), pages, PACKED.get(_name))
shaped("chunk_context_blocks", rs.context_blocks, pages, PACKED["context_blocks"])
for _name in ("section_density", "code_segments", "context_windows", "fallback_recursive",
              "sentence_packs"):
    shaped(f"chunk_{_name}", getattr(rs, _name), docs, PACKED.get(_name))
for _name in rs.CONTENT_SIZES:
    shaped(f"chunk_content_{_name}", lambda d, n=_name: rs.by_content_type(d, n), docs)
shaped("plan_source_units", pl.source_units, pages)
shaped("plan_boundary_chunks", pl.boundary_chunks, docs)


@query("chunk_baseline_sweep")
def baseline_sweep(spark, sf):
    return rs.baseline_sweep(docs(spark, sf))


def indexed(spark, sf):
    """Pages with the document metadata an index entry carries."""
    return pr.chunk_markdown(pages_corpus(spark, sf).select(
        F.col("provider").alias("company_code"), F.col("source_path").alias("document_id"),
        F.lit("policy").alias("document_type"), F.col("source_path").alias("document_name"),
        F.lit("health").alias("product_line"), F.lit(None).cast("string").alias("plan_code"),
        "source_path", "text"))


@query("index_chunks")
def index_chunks(spark, sf):
    return digest(pr.validated(indexed(spark, sf)))


@query("index_payload_violations")
def index_payload_violations(spark, sf):
    broken = indexed(spark, sf).withColumn("product_line", F.when(
        F.col("has_table"), F.lit(" ")).otherwise(F.col("product_line")))
    return pr.payload_violations(broken)


@query("index_document_summary")
def index_document_summary(spark, sf):
    return pr.document_summary(indexed(spark, sf))


@query("index_report")
def index_report(spark, sf):
    return pr.index_report(indexed(spark, sf))


@query("index_metadata_quality")
def index_metadata_quality(spark, sf):
    return pr.metadata_quality(indexed(spark, sf))


@query("chunk_quality")
def chunk_quality(spark, sf):
    d = docs(spark, sf)
    both = rs.fixed(d).unionByName(rs.recursive(d)).unionByName(rs.sentence(d))
    return ev.chunk_quality(both, d)
