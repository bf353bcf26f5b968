"""Registered queries: retrieval, reranking, evidence and their evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.operators import embedding as em
from docmill.operators import evaluation as ev
from docmill.operators import evidence as evd
from docmill.operators import retrieval as rt
from docmill.plans.q_text import MARKLESS, SEARCH
from docmill.plans.registry import query
from docmill.functions.arrays import stage
from docmill.session import scratch_path, spread, table
from docmill.sources.index import KeywordIndex


# --- dense search: label centroids against all vectors ------------------------------------

def centroids(spark, sf):
    """One query per label: the unit mean of its vectors (work grows with the table)."""
    rows = table(spark, sf, "embeddings").select("label", F.posexplode("embedding")
                                                 .alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vectors = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(
        F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    return vectors.select(F.col("label").alias("query_id"), F.transform(
        "v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)))
        .alias("embedding"))


CENTROIDS = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v
                         FROM embeddings),
    m AS (SELECT label, i, avg(v[i]) AS m FROM e, unnest(range(1, 65)) AS u(i)
          GROUP BY label, i),
    c AS (SELECT label, list(m ORDER BY i) AS raw FROM m GROUP BY label),
    q AS (SELECT label AS query_id, list_transform(raw, lambda x:
            x / sqrt(list_dot_product(raw, raw))) AS v FROM c),
    s AS (SELECT query_id, vec_id, e.label, round(list_dot_product(q.v, e.v), 6) AS score
          FROM q, e),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
          AS rank FROM s)"""


@query("knn_label_centroids", CENTROIDS + """
    SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10""")
def knn_label_centroids(spark, sf):
    return rt.dense_topk(centroids(spark, sf), spread(table(spark, sf, "embeddings")), 10,
                         "vec_id")


@query("graded_retrieval_metrics", CENTROIDS + """,
    t AS (SELECT query_id, rank, CASE WHEN label = query_id THEN 1.0 ELSE 0.1 END AS rel
          FROM r WHERE rank <= 5),
    d AS (SELECT query_id, min(rank) FILTER (rel >= 0.2) AS first,
                 sum(rel / log2(rank + 1)) AS dcg, max(rel) AS coverage_5 FROM t GROUP BY 1),
    i AS (SELECT query_id, sum(rel / log2(k + 1)) AS ideal FROM (
            SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC)
                   AS k FROM t) GROUP BY 1)
    SELECT d.query_id, CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END AS hit_1,
           CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END AS hit_3,
           CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END AS hit_5,
           coalesce(1.0 / first, 0.0) AS mrr_5, dcg / ideal AS ndcg_5, coverage_5
    FROM d JOIN i USING (query_id)""")
def graded_retrieval_metrics(spark, sf):
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    found = knn_label_centroids(spark, sf).join(labels, "vec_id")
    return ev.graded_metrics(found.withColumn("relevance", F.when(
        F.col("label") == F.col("query_id"), 1.0).otherwise(0.1)))


# --- keyword search: every benchmark item against all documents ----------------------------

def questions(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def corpus(spark, sf):
    return spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("company_code"))


TOK = ("list_filter(string_split_regex(" + SEARCH + ", '[^a-z0-9]+'), lambda t: t <> '')")
BM25 = f"""WITH d AS (SELECT doc_id AS chunk_id, source, text, {TOK.format(c='text')} AS ts
                     FROM documents),
    st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
    qt AS (SELECT DISTINCT item_id AS query_id, unnest({TOK.format(c='text')}) AS term
           FROM benchmark),
    dt AS (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM d),
    p AS (SELECT chunk_id, term, dl, count(*) AS tf FROM dt
          WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    s AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5))
                 * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
          FROM qt JOIN p USING (term) JOIN f USING (term), st GROUP BY query_id, chunk_id),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)
          AS rank FROM s)"""


@query("bm25_top10", BM25 + " SELECT query_id, chunk_id, score, rank FROM b WHERE rank <= 10")
def bm25_top10(spark, sf):
    return rt.bm25_topk(questions(spark, sf), corpus(spark, sf), 10)


# The document-frequency factor inside the statement above.
IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"


@query("bm25_without_idf_top10", BM25.replace(IDF, "1.0")
       + " SELECT query_id, chunk_id, score, rank FROM b WHERE rank <= 10")
def bm25_without_idf_top10(spark, sf):
    """The collection's own form: term weights without a document-frequency modifier."""
    return rt.bm25_topk(questions(spark, sf), corpus(spark, sf), 10, use_idf=False)


STOP = ", ".join(f"'{w}'" for w in em.SEARCH_STOPWORDS)


def _hash_vectors(table_name: str, key: str) -> str:
    return f"""SELECT id, list(x ORDER BY b) AS raw FROM (
        SELECT k.id, bk.b, coalesce(sum(sg), 0.0) AS x
        FROM (SELECT {key} AS id FROM {table_name}) k CROSS JOIN (SELECT unnest(range(128)) AS b)
             bk LEFT JOIN (
          SELECT id, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 128 AS b,
                 CASE WHEN CAST(('0x' || substr(h, 9, 2)) AS BIGINT) % 2 = 0 THEN 1.0
                      ELSE -1.0 END AS sg
          FROM (SELECT id, sha256(w) AS h FROM (
                  SELECT {key} AS id, unnest(regexp_extract_all(
                         {MARKLESS.format(c='text')}, '[a-z0-9_]{{3,}}')) AS w
                  FROM {table_name}) WHERE w NOT IN ({STOP}))) t ON t.id = k.id AND t.b = bk.b
        GROUP BY k.id, bk.b) GROUP BY id"""


DENSE = BM25 + f""",
    dv AS ({_hash_vectors('documents', 'doc_id')}),
    qv AS ({_hash_vectors('benchmark', 'item_id')}),
    ds AS (SELECT qv.id AS query_id, dv.id AS chunk_id, round(coalesce(
             list_dot_product(qv.raw, dv.raw) / nullif(sqrt(list_dot_product(qv.raw, qv.raw)
             * list_dot_product(dv.raw, dv.raw)), 0), 0), 6) AS score FROM qv, dv),
    dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)
           AS rank FROM ds)"""


def embedded(df):
    return df.withColumn("embedding", em.term_hash_embedding(em.content_terms(F.col("text"))))


def dense_hash(spark, sf, k):
    """Hash vectors of documents searched with those of the benchmark items."""
    asked = questions(spark, sf).withColumn("embedding", em.term_hash_embedding(
        em.content_terms(F.col("query"))))
    return rt.dense_topk(asked, embedded(corpus(spark, sf)), k)


@query("dense_hash_top10", DENSE + """
    SELECT query_id, chunk_id, score, rank FROM dr WHERE rank <= 10""")
def dense_hash_top10(spark, sf):
    return dense_hash(spark, sf, 10)


@query("hybrid_fusion_top10", DENSE + """,
    arms AS (SELECT query_id, chunk_id, rank, score AS ds, NULL AS ss FROM dr WHERE rank <= 30
             UNION ALL SELECT query_id, chunk_id, rank, NULL, score FROM b WHERE rank <= 30),
    fu AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score,
                  max(ds) AS dense_score, max(ss) AS sparse_score FROM arms GROUP BY ALL),
    fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)
           AS rank FROM fu)
    SELECT query_id, chunk_id, score, dense_score, sparse_score, rank FROM fr
    WHERE rank <= 10""")
def hybrid_fusion(spark, sf):
    asked = questions(spark, sf).withColumn("embedding", em.term_hash_embedding(
        em.content_terms(F.col("query"))))
    return rt.clamp_scores(rt.hybrid_topk(asked, embedded(corpus(spark, sf)), 10, depth=30))


LEX = f""",
    c30 AS (SELECT b.query_id, b.chunk_id, b.rank, b.score,
              list_distinct({TOK.format(c='q.text')}) AS qs, d.ts
            FROM b JOIN benchmark q ON q.item_id = b.query_id JOIN d USING (chunk_id)
            WHERE rank <= 30),
    lx AS (SELECT query_id, chunk_id, rank, len(list_intersect(qs, ts)) / len(qs) AS raw
           FROM c30),
    rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, rank)
           AS rerank_rank FROM lx)
    SELECT query_id, chunk_id, rank, round(raw, 6) AS rerank_score, rerank_rank
    FROM rr WHERE rerank_rank <= 10"""


@query("rerank_two_stage", BM25 + LEX)
def rerank_two_stage(spark, sf):
    """The lexical second score comes from the postings; no text is folded again."""
    asked = questions(spark, sf)
    sized = stage(asked, query=F.size(F.array_distinct(rt.tokens(F.col("query")))))
    found = rt.bm25_topk(asked, corpus(spark, sf), 30, matched=True).join(sized, "query_id")
    return rt.rerank(found, lambda size, matched: matched / size, 10, "matched").select(
        "query_id", "chunk_id", "rank", "rerank_score", "rerank_rank")


# Every third document arrives with its length in place of its text, and comes again with the text;
# every seventh is deleted and every fourteenth comes back.
@query("bm25_after_upsert", BM25.replace("FROM documents)", "FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 14 = 0)", 1)
       + " SELECT query_id, chunk_id, score, rank FROM b WHERE rank <= 10")
def bm25_after_upsert(spark, sf):
    docs = corpus(spark, sf).select("chunk_id", "text")
    index = KeywordIndex(spark, scratch_path(spark, "stored-keyword-index"))
    index.upsert(docs.withColumn("text", F.when(F.col("chunk_id") % 3 == 0, F.length("text").cast("string")).otherwise(F.col("text"))))
    index.upsert(docs.filter("chunk_id % 3 = 0"))
    index.delete(docs.filter("chunk_id % 7 = 0").select("chunk_id"))
    index.upsert(docs.filter("chunk_id % 14 = 0"))
    return index.search(questions(spark, sf), 10).drop("matched")


# Null vectors, vectors of another length and vectors with a null component are no candidates.
@query("dense_odd_vectors", CENTROIDS.replace("FROM q, e)", "FROM q, e WHERE vec_id % 5 <> 0)") + """
    SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10""")
def dense_odd_vectors(spark, sf):
    v = F.col("embedding").cast("array<double>")
    odd = F.when(F.col("vec_id") % 20 == 0, F.lit(None)).when(F.col("vec_id") % 20 == 5, F.slice(v, 1, 63)) \
        .when(F.col("vec_id") % 20 == 10, F.array_append(v, F.lit(1.0))).when(F.col("vec_id") % 20 == 15, F.array_append(F.slice(v, 1, 63), F.lit(None)))
    rows = spread(table(spark, sf, "embeddings")).withColumn("embedding", odd.when(F.col("vec_id") % 5 != 0, v))
    return rt.dense_topk(centroids(spark, sf), rows, 10, "vec_id")


WITHIN = "FROM (SELECT * FROM documents WHERE source IN ('src1', 'src2', 'src3'))"


@query("filtered_hybrid_rerank", DENSE.replace("FROM documents", WITHIN) + f""",
    arms AS (SELECT query_id, chunk_id, rank, score AS ds, NULL AS ss FROM dr WHERE rank <= 30
             UNION ALL SELECT query_id, chunk_id, rank, NULL, score FROM b WHERE rank <= 30),
    fu AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score,
                  max(ds) AS dense_score, max(ss) AS sparse_score FROM arms GROUP BY ALL),
    fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)
           AS rank FROM fu),
    lx AS (SELECT fr.*, CASE WHEN len(qs) = 0 THEN 0 ELSE len(list_intersect(qs, ts)) / len(qs) END AS raw
           FROM (SELECT *, list_distinct({TOK.format(c='q.text')}) AS qs FROM fr
                 JOIN benchmark q ON q.item_id = query_id WHERE rank <= 30) fr JOIN d USING (chunk_id)),
    rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, rank)
           AS rerank_rank FROM lx)
    SELECT query_id, chunk_id, score, dense_score, sparse_score, rank, raw AS raw_rerank_score,
           rerank_rank, round(raw, 6) AS rerank_score, 'cross_encoder' AS rerank_method
    FROM rr WHERE rerank_rank <= 10""")
def filtered_hybrid_rerank(spark, sf):
    asked = questions(spark, sf).withColumn("embedding", em.term_hash_embedding(
        em.content_terms(F.col("query"))))
    return rt.filtered_hybrid_rerank(
        asked, embedded(corpus(spark, sf)),
        rt.HardFilters(company_code=["src1", "src2", "src3"])).drop("text", "query")




def _grams(key: str, name: str) -> str:
    return f"""SELECT {key} AS id, unnest(list_concat(ws, list_transform(range(1, len(ws)),
        lambda i: ws[i] || ' ' || ws[i + 1]))) AS term
    FROM (SELECT {key}, regexp_extract_all({MARKLESS.format(c='text')}, '[\\p{{L}}\\p{{N}}_]{{2,}}')
          AS ws FROM {name}) WHERE len(ws) > 0"""


TFIDF = f"""WITH dc AS (SELECT id, term, count(*) AS tf FROM ({_grams('doc_id', 'documents')})
                      GROUP BY ALL),
    qc AS (SELECT id, term, count(*) AS tf FROM ({_grams('item_id', 'benchmark')}) GROUP BY ALL),
    f AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
          FROM dc GROUP BY term),
    dw AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM dc JOIN f USING (term)),
    qw AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM qc JOIN f USING (term)),
    dn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY id),
    qn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY id),
    s AS (SELECT qw.id AS query_id, dw.id AS chunk_id,
                 round(sum(qw.w / qn.norm * dw.w / dn.norm), 6) AS score
          FROM qw JOIN qn ON qn.id = qw.id JOIN dw ON dw.term = qw.term JOIN dn ON dn.id = dw.id
          GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)
          AS rank FROM s)
    SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 5"""


@query("tfidf_top5", TFIDF)
def tfidf_top5(spark, sf):
    return rt.tfidf_topk(questions(spark, sf), corpus(spark, sf), 5)


NORM = r"trim(regexp_replace(replace(lower(nfc_normalize({c})), '**', ' '), '\s+', ' ', 'g'))"


@query("case_rank_metrics", BM25 + f""",
    r AS (SELECT query_id, rank, source, {NORM.format(c='d.text')} AS t FROM b JOIN d USING (chunk_id) WHERE rank <= 10),
    q AS (SELECT item_id AS case_id, {NORM.format(c='text')} AS quote, list_filter(string_split(
            regexp_replace(text, '\\.\\s+', '.' || chr(1), 'g'), chr(1)), lambda p: length(p) > 3) AS raw FROM benchmark),
    x AS (SELECT *, list_filter(list_transform(raw, lambda p: {NORM.format(c='p')}), lambda p: p <> '') AS ps FROM q),
    g AS (SELECT case_id, quote, raw, ps,
            min(rank) FILTER (r.source = (SELECT source FROM r f WHERE f.query_id = case_id AND f.rank = 1)) AS source_rank,
            min(rank) FILTER (quote <> '' AND contains(t, quote)) AS quote_rank,
            coalesce(string_agg(t, ' ' ORDER BY rank) FILTER (rank <= 5), '') AS top5,
            coalesce(string_agg(t, ' ' ORDER BY rank), '') AS top10
          FROM x LEFT JOIN r ON query_id = case_id GROUP BY ALL)
    SELECT case_id, source_rank, quote_rank,
           CASE WHEN source_rank <= 5 THEN 1.0 ELSE 0.0 END AS source_hit_at_5,
           CASE WHEN source_rank <= 10 THEN 1.0 ELSE 0.0 END AS source_hit_at_10,
           CASE WHEN source_rank <= 5 THEN 1.0 / source_rank ELSE 0.0 END AS mrr_at_5,
           CASE WHEN source_rank <= 10 THEN 1.0 / source_rank ELSE 0.0 END AS mrr_at_10,
           quote <> '' AS has_evidence_quote,
           CASE WHEN quote <> '' THEN CASE WHEN quote_rank <= 5 THEN 1.0 ELSE 0.0 END END AS quote_hit_at_5,
           CASE WHEN quote <> '' THEN CASE WHEN quote_rank <= 10 THEN 1.0 ELSE 0.0 END END AS quote_hit_at_10,
           len(raw) AS expected_evidence_phrase_count,
           CASE WHEN len(ps) = 0 THEN 0.0 ELSE len(list_filter(ps, lambda p: contains(top5, p))) / len(ps) END
             AS evidence_phrase_recall_at_5,
           CASE WHEN len(ps) = 0 THEN 0.0 ELSE len(list_filter(ps, lambda p: contains(top10, p))) / len(ps) END
             AS evidence_phrase_recall_at_10
    FROM g""")
def case_rank_metrics(spark, sf):
    """Benchmark items score the document search: a hit holds the item's own text."""
    asked = questions(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text",
                                                F.col("source").alias("source_path"))
    found = bm25_top10(spark, sf).join(docs, "chunk_id").withColumnRenamed("query_id", "case_id")
    best = found.filter("rank = 1").select("case_id", F.col("source_path"))
    cases = asked.select(F.col("query_id").alias("case_id"),
                         F.col("query").alias("evidence_quote"),
                         F.filter(F.split("query", r"(?<=\.)\s+"), lambda s: F.length(s) > 3)
                         .alias("expected_evidence")).join(best, "case_id", "left")
    return ev.rank_metrics(found, cases)


# --- evidence ------------------------------------------------------------------------------------

def evidence(spark, sf):
    return spread(table(spark, sf, "documents")).select(
        F.col("lang").alias("source_type"), F.col("source").alias("source_id"),
        F.col("text").alias("content"), F.col("doc_id").alias("ord"))


@query("evidence_dedupe", """
    SELECT lang AS source_type, source AS source_id, md5(text) AS content_hash,
           min(doc_id) AS ord
    FROM documents GROUP BY ALL""")
def evidence_dedupe(spark, sf):
    return evd.dedupe(evidence(spark, sf)).drop("content")


@query("evidence_conflicts", """
    WITH u AS (SELECT source, text, min(doc_id) AS ord FROM documents GROUP BY source, text),
    f AS (SELECT source, min(ord) AS first_ord, arg_min(text, ord) AS existing
          FROM u GROUP BY source)
    SELECT source AS source_id, ord, md5(text) AS content_hash,
           'Conflict detected for source_id ''' || source || '''. New content snippet: '''
           || substr(text, 1, 50) || '...''. Existing content snippet: '''
           || substr(existing, 1, 50) || '...''.' AS message
    FROM u JOIN f USING (source) WHERE ord > first_ord""")
def evidence_conflicts(spark, sf):
    return evd.conflicts(evidence(spark, sf))


@query("evidence_merge_cut", """
    SELECT source_type, source_id, content_hash, ord FROM (
      SELECT lang AS source_type, source AS source_id, md5(text) AS content_hash,
             min(doc_id) AS ord FROM documents GROUP BY ALL)
    ORDER BY ord LIMIT 50""")
def evidence_merge_cut(spark, sf):
    return evd.merge(evidence(spark, sf), top_k=50)[0].drop("content")


@query("evidence_from_rows", """
    SELECT 'sqlite_row' AS source_type, CAST(p_partkey AS VARCHAR) AS source_id,
           'id: ' || p_partkey || ', p_name: ' || p_name || ', p_size: ' || p_size AS content,
           1.0 AS confidence, 'DatabaseAgent' AS retrieved_by
    FROM part""")
def evidence_from_rows(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size",
                                           F.col("p_brand").alias("company_code"))
    return evd.from_tool_rows(rows, "search-parts").drop("metadata")


@query("evidence_citations", """
    SELECT CAST(p_partkey AS VARCHAR) AS source_id, p_brand AS company_code,
           CAST(p_size AS VARCHAR) AS document_id, p_name AS document_name,
           CAST(NULL AS VARCHAR) AS source_file_path, CAST(NULL AS VARCHAR) AS source_table_id,
           CAST(NULL AS VARCHAR) AS page
    FROM part""")
def evidence_citations(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").alias("document_id"),
        F.col("p_name").alias("document_name"), F.col("p_brand").alias("company_code"), "p_type")
    return evd.citations(evd.from_tool_rows(rows, "search-parts"))


@query("context_budget", """
    WITH t AS (SELECT conv_id, turn, text, coalesce(sum(least(length(text), 300)) OVER (
                 PARTITION BY conv_id ORDER BY turn
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM conversations)
    SELECT conv_id, turn, CAST(used AS BIGINT) AS used_before,
           md5(substr(text, 1, CAST(least(300, 900 - used) AS BIGINT))) AS text_md5
    FROM t WHERE used < 900""")
def context_budget(spark, sf):
    rows = evd.context_budget(table(spark, sf, "conversations").drop("role"), ["conv_id"],
                              "turn", 300, 900)
    return rows.select("conv_id", "turn", "used_before", F.md5("text").alias("text_md5"))


@query("labelled_contexts", """
    WITH r AS (SELECT conv_id AS case_id, turn AS rank, role AS source_path, text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY
                   coalesce(nullif(turn, 0), 999999), role, text) AS n FROM conversations)
    SELECT case_id, rank, source_path, md5(text) AS text_md5, 'S' || n AS citation_id
    FROM r WHERE n <= 5""")
def labelled_contexts(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("rank"),
        F.col("role").alias("source_path"), "text")
    return evd.labelled_contexts(rows).select("case_id", "rank", "source_path", F.md5("text")
                                              .alias("text_md5"), "citation_id")


# --- evaluation aggregates over star-schema rows -----------------------------------------------

def case_metrics(spark, sf):
    """Orders as evaluated cases: priorities are scenarios, status the benchmark version."""
    o = table(spark, sf, "orders")
    rank = (F.col("o_orderkey") % 12 + 1).cast("int")
    quoted = F.col("o_orderkey") % 3 != 0

    def hit(k):
        return F.when(rank <= k, 1.0).otherwise(0.0)
    return o.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("scenario_name"),
        F.lit("bench").alias("benchmark_file"), F.col("o_orderstatus").alias("benchmark_version"),
        (F.col("o_custkey") % 10).cast("string").alias("provider"),
        (rank <= 10).alias("success"), F.when(rank > 11, "timeout").otherwise("")
        .alias("execution_error"), hit(5).alias("source_hit_at_5"),
        hit(10).alias("source_hit_at_10"), F.when(rank <= 5, 1 / rank).otherwise(0.0)
        .alias("mrr_at_5"), F.when(rank <= 10, 1 / rank).otherwise(0.0).alias("mrr_at_10"),
        F.when(quoted, hit(4)).alias("quote_hit_at_5"),
        F.when(quoted, hit(8)).alias("quote_hit_at_10"),
        (F.col("o_orderkey") % 4).cast("int").alias("expected_evidence_phrase_count"),
        (F.col("o_orderkey") % 5 / 4).alias("evidence_phrase_recall_at_5"),
        (F.col("o_orderkey") % 3 / 2).alias("evidence_phrase_recall_at_10"),
        F.col("o_totalprice").alias("latency_ms"), hit(3).alias("pre_rerank_source_hit_at_10"))


CASES = """WITH k AS (SELECT *, o_orderkey % 12 + 1 AS rk, o_orderkey % 3 <> 0 AS qt FROM orders),
    m AS (SELECT o_orderpriority AS scenario_name, 'bench' AS group_name,
      o_orderstatus AS group_version, CAST(o_custkey % 10 AS VARCHAR) AS provider,
      rk <= 10 AS success, rk > 11 AS failed,
      CASE WHEN rk <= 5 THEN 1.0 ELSE 0.0 END AS h5, CASE WHEN rk <= 10 THEN 1.0 ELSE 0.0 END
        AS h10, CASE WHEN rk <= 5 THEN 1.0 / rk ELSE 0.0 END AS m5,
      CASE WHEN rk <= 10 THEN 1.0 / rk ELSE 0.0 END AS m10,
      CASE WHEN qt THEN CASE WHEN rk <= 4 THEN 1.0 ELSE 0.0 END END AS q5,
      CASE WHEN qt THEN CASE WHEN rk <= 8 THEN 1.0 ELSE 0.0 END END AS q10,
      CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 5 / 4 END AS p5,
      CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 3 / 2 END AS p10,
      o_totalprice AS ms, CASE WHEN rk <= 3 THEN 1.0 ELSE 0.0 END AS pre10 FROM k)"""
SUMMARY = """count(*) AS case_count, count(*) FILTER (success) AS success_case_count,
    count(*) FILTER (failed) AS error_case_count, count(q5) AS quote_case_count,
    count(p5) AS phrase_case_count, round(avg(h5), 4) AS source_hit_at_5,
    round(avg(h10), 4) AS source_hit_at_10, round(avg(m5), 4) AS mrr_at_5,
    round(avg(m10), 4) AS mrr_at_10, round(coalesce(avg(q5), 0), 4) AS quote_hit_at_5,
    round(coalesce(avg(q10), 0), 4) AS quote_hit_at_10,
    round(coalesce(avg(p5), 0), 4) AS evidence_phrase_recall_at_5,
    round(coalesce(avg(p10), 0), 4) AS evidence_phrase_recall_at_10,
    round(avg(ms), 3) AS latency_ms_avg, round(avg(pre10), 4) AS pre_rerank_source_hit_at_10,
    round(avg(h10) - avg(pre10), 4) AS source_hit_at_10_delta_vs_pre_rerank"""


@query("retrieval_summary", CASES + f""",
    g AS (SELECT coalesce(group_name, 'ALL') AS group_name,
                 coalesce(group_version, 'ALL') AS group_version, scenario_name, {SUMMARY}
          FROM m GROUP BY GROUPING SETS ((group_name, group_version, scenario_name),
                                         (scenario_name))),
    e AS (SELECT group_name, group_version, scenario_name, ms FROM m UNION ALL
          SELECT 'ALL', 'ALL', scenario_name, ms FROM m),
    n AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (
            PARTITION BY group_name, group_version, scenario_name) AS n
          FROM e WINDOW w AS (PARTITION BY group_name, group_version, scenario_name ORDER BY ms)),
    p AS (SELECT group_name, group_version, scenario_name, round(ms, 3) AS latency_ms_p95
          FROM n WHERE i = round_even((n - 1) * 0.95, 0))
    SELECT * FROM g JOIN p USING (group_name, group_version, scenario_name)""")
def retrieval_summary(spark, sf):
    return ev.retrieval_summary(case_metrics(spark, sf))


@query("provider_summary", CASES + f"""
    SELECT provider, scenario_name, {SUMMARY} FROM m GROUP BY provider, scenario_name""")
def provider_summary(spark, sf):
    return ev.provider_summary(case_metrics(spark, sf))


@query("nearest_rank_p95", """
    WITH n AS (SELECT l_returnflag, l_extendedprice AS v,
                 row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i,
                 count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT l_returnflag, v AS percentile FROM n WHERE i = round_even((n - 1) * 0.95, 0)""")
def nearest_rank_p95(spark, sf):
    return ev.nearest_rank(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.95)


def strategy_rows(spark, sf):
    """Line items as retrieved chunks of their order's case."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("strategy"), F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").alias("rank"), (F.col("l_suppkey") % 10).cast("string")
        .alias("source_path"), F.col("l_quantity").cast("int").alias("start_line"),
        (F.col("l_quantity").cast("int") + 5).alias("end_line"))
    path = (F.col("o_custkey") % 10).cast("string")
    start = (F.col("o_orderkey") % 50).cast("int")
    cases = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.array(F.struct(
            path.alias("source_path"), start.alias("line_start"), (start + 3).alias("line_end"),
            F.lit("primary").alias("relationship"))).alias("expected_sources"),
        F.array(path, F.lit("3")).alias("required_source_paths"))
    return li, cases


STRATEGY = """WITH t AS (SELECT l_returnflag AS strategy, l_orderkey AS case_id,
      l_linenumber AS rank, CAST(l_suppkey % 10 AS VARCHAR) AS sp, CAST(l_quantity AS INT) AS a,
      CAST(l_quantity AS INT) + 5 AS b FROM lineitem WHERE l_linenumber <= 5),
    c AS (SELECT o_orderkey AS case_id, CAST(o_custkey % 10 AS VARCHAR) AS pp,
                 CAST(o_orderkey % 50 AS INT) AS s FROM orders),
    x AS (SELECT strategy, case_id, pp, count(*) AS retrieved_count,
            min(rank) FILTER (sp = pp) AS rk,
            CASE WHEN pp = '3' THEN CASE WHEN bool_or(sp = '3') THEN 1.0 ELSE 0.0 END
                 ELSE (CASE WHEN bool_or(sp = pp) THEN 0.5 ELSE 0 END
                       + CASE WHEN bool_or(sp = '3') THEN 0.5 ELSE 0 END) END AS rec,
            CASE WHEN bool_or(sp = pp AND greatest(s, a) <= least(s + 3, b)) THEN 1.0
                 ELSE 0.0 END AS ov
          FROM t JOIN c USING (case_id) GROUP BY strategy, case_id, pp)"""


@query("case_source_metrics", STRATEGY + """
    SELECT strategy, case_id, pp AS primary_source_path, retrieved_count,
           CASE WHEN rk IS NULL THEN 0.0 ELSE 1.0 END AS primary_hit_at_k,
           rk AS primary_rank_at_k, coalesce(1.0 / rk, 0.0) AS primary_mrr_at_k,
           CASE WHEN pp = '3' THEN 1 ELSE 2 END AS required_source_count,
           rec AS required_source_recall_at_k, 1 AS line_expected_count,
           ov AS line_overlap_recall_at_k FROM x""")
def case_source_metrics(spark, sf):
    return ev.score_cases(*strategy_rows(spark, sf))


@query("strategy_summary", STRATEGY + """
    SELECT strategy, count(*) AS cases,
           round(avg(CASE WHEN rk IS NULL THEN 0.0 ELSE 1.0 END), 4) AS primary_hit_at_k,
           round(avg(coalesce(1.0 / rk, 0.0)), 4) AS primary_mrr_at_k,
           round(avg(rec), 4) AS required_source_recall_at_k,
           round(avg(ov), 4) AS line_overlap_recall_at_k FROM x GROUP BY strategy""")
def strategy_summary(spark, sf):
    return ev.ordered_strategies(ev.strategy_summary(case_source_metrics(spark, sf)))


@query("metric_means", """
    SELECT event_type AS metric, round(avg(value), 6) AS mean_score FROM events
    WHERE value > 5 GROUP BY event_type""")
def metric_means(spark, sf):
    return ev.metric_means(table(spark, sf, "events").select(
        F.col("event_type").alias("metric"), F.when(F.col("value") > 5, F.col("value"))
        .alias("score")))


@query("judge_summary", """
    SELECT event_type AS strategy, count(*) AS cases, count(*) FILTER (value < 1) AS failed,
           round(avg(value) FILTER (value >= 1), 4) AS relevance FROM events
    GROUP BY event_type""")
def judge_summary(spark, sf):
    bad = F.col("value") < 1
    return ev.judge_summary(table(spark, sf, "events").select(
        F.col("event_type").alias("strategy"), F.when(bad, "timeout").otherwise("").alias("error"),
        F.when(~bad, F.col("value")).alias("relevance")), ["relevance"])


@query("refinement_suggestions", """
    WITH a AS (SELECT user_id, avg(value / 10) AS r, bool_or(event_type = 'click') AS code
               FROM events GROUP BY user_id)
    SELECT user_id AS chunk_id, round(r, 6) AS avg_rating,
           'Low performance across queries' AS issue FROM a WHERE r < 3
    UNION ALL
    SELECT user_id, round(r, 6), 'Poor performance on code-related queries' FROM a
    WHERE code AND r < 4""")
def refinement_suggestions(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("chunk_id"), (F.col("value") / 10).alias("rating"),
        F.when(F.col("event_type") == "click", "find CODE").otherwise("other").alias("query"))
    return ev.refinement_suggestions(rows).select(
        "chunk_id", F.round("avg_rating", 6).alias("avg_rating"), "issue")


def scored_answers(spark, sf):
    """Every assistant turn as an answer, the user turns shortly before it as contexts."""
    from docmill.functions.text import cite_statements

    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-10, -1)
    said = F.when(F.col("role") == "user", F.struct("turn", "text"))
    turns = table(spark, sf, "conversations").withColumn("asked", F.collect_list(said).over(before)) \
        .filter("role = 'assistant'").withColumn("case_id", F.concat_ws(
            ":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    contexts = evd.labelled_contexts(turns.select("case_id", F.explode("asked").alias("a")).select(
        "case_id", (F.col("a.turn") + 1).alias("rank"), F.lit("conv").alias("source_path"),
        F.col("a.text").alias("text")))
    answers = turns.select(
        "case_id", cite_statements(F.col("text"), F.lit("S1")).alias("answer"),
        F.lit("conv").alias("source_path"), F.get("asked", F.lit(0))["text"].alias("expected_answer"),
        F.lit("").alias("evidence_quote"), F.array().cast("array<string>")
        .alias("expected_evidence"), F.lit(True).alias("must_cite_source"),
        (F.col("conv_id") % 3).cast("string").alias("provider"),
        F.when(F.col("conv_id") % 2 == 0, "low").otherwise("high").alias("risk"))
    return ev.score_answers(answers, contexts)


@query("answer_scores")
def answer_scores(spark, sf):
    return scored_answers(spark, sf).drop("answer", "expected_answer")


@query("answer_summary")
def answer_summary(spark, sf):
    return ev.answer_summary(scored_answers(spark, sf))
