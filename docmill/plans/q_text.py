"""Registered queries: text functions over whole documents, pages and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import parse as ps
from docmill.functions import text as tx
from docmill.functions.arrays import lines
from docmill.operators import embedding as em
from docmill.plans.corpus import DOCS_CTE, PAGES_CTE, documents_corpus, pages_corpus
from docmill.plans.registry import query
from docmill.session import spread, table

FOLD = (r"regexp_replace(strip_accents(translate({c}, 'đĐ', 'dD')), "
        r"'[^\x00-\x7F]', '', 'g')")
MARKLESS = "translate(strip_accents(lower({c})), 'đ', 'd')"
SEARCH = (r"trim(regexp_replace(lower(" + FOLD + r"), '\s+', ' ', 'g'))")


def docs(spark, sf):
    return spread(table(spark, sf, "documents"))


@query("text_ascii_fold", f"""
    SELECT doc_id, md5({FOLD.format(c='text')}) AS folded_md5 FROM documents""")
def ascii_fold(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(tx.ascii_fold(F.col("text")))
                                  .alias("folded_md5"))


@query("text_search_form", f"""
    SELECT doc_id, md5({SEARCH.format(c='text')}) AS form_md5 FROM documents""")
def search_form(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(tx.search_text(F.col("text")))
                                  .alias("form_md5"))


@query("text_identifiers", rf"""
    SELECT page_id, trim(regexp_replace(lower({FOLD.format(c='url')}), '[^a-z0-9]+', '_', 'g'),
                         '_') AS identifier,
           regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '')
             AS site
    FROM pages""")
def identifiers(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", tx.stable_identifier(F.col("url")).alias("identifier"),
        tx.url_site(F.col("url")).alias("site"))


@query("text_hashes", """
    SELECT doc_id, CAST(('0x' || substr(md5(text), 1, 15)) AS BIGINT) AS point_id,
           substr(sha1(text), 1, 16) AS short_sha1, sha256(text) AS content_hash
    FROM documents""")
def hashes(spark, sf):
    return docs(spark, sf).select(
        "doc_id", tx.point_id(F.col("text")).alias("point_id"),
        tx.short_sha1(F.col("text")).alias("short_sha1"),
        F.sha2("text", 256).alias("content_hash"))


@query("text_token_counts", r"""
    SELECT lang, count(*) AS docs,
           CAST(sum(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))) AS BIGINT)
             AS words,
           CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS estimated_tokens
    FROM documents GROUP BY lang""")
def token_counts(spark, sf):
    return docs(spark, sf).groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum(tx.word_count(F.col("text"))).alias("words"),
        F.sum(tx.estimate_tokens(F.col("text"))).alias("estimated_tokens"))


@query("text_statements", r"""
    SELECT doc_id, len(list_filter(string_split(
             regexp_replace(text, '([.!?。])\s+', '\1' || chr(10), 'g'), chr(10)),
             lambda s: trim(s) <> '')) AS n_statements
    FROM documents""")
def statement_counts(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(tx.statements(F.col("text")))
                                  .alias("n_statements"))


@query("text_numbers", r"""
    SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\d[\d.,/%-]*'),
             lambda n: trim(n, '.,;:')), lambda n: n <> '') AS numbers
    FROM documents""")
def numbers(spark, sf):
    return docs(spark, sf).select("doc_id", tx.numbers(F.col("text")).alias("numbers"))


@query("text_significant_tokens", r"""
    SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(
             replace(lower(text), 'ß', 'ss'), '[a-z0-9à-ỹ]+'),
             lambda w: length(w) >= 3 AND NOT starts_with(w, 'số') AND w NOT IN (""" + ", ".join(
    f"'{w}'" for w in tx.ANSWER_STOPWORDS) + r""")))) AS n_tokens
    FROM documents""")
def significant(spark, sf):
    folded = docs(spark, sf).select("doc_id", tx.answer_text(F.col("text")).alias("t"))
    return folded.select("doc_id", F.size(F.array_distinct(tx.significant_tokens(F.col("t"))))
                         .alias("n_tokens"))


@query("text_top_keywords", rf"""
    WITH words AS (
      SELECT doc_id, unnest(regexp_extract_all({MARKLESS.format(c='text')}, '[a-z0-9]{{3,}}'))
             AS word FROM documents),
    counted AS (
      SELECT doc_id, word, count(*) AS n FROM words
      WHERE word NOT IN ({", ".join(f"'{w}'" for w in tx.SEARCH_STOPWORDS)})
        AND NOT regexp_full_match(word, '[0-9]+')
      GROUP BY doc_id, word),
    ranked AS (
      SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rn
      FROM counted)
    SELECT doc_id, string_agg(word, ' ' ORDER BY rn) AS keywords FROM ranked WHERE rn <= 8
    GROUP BY doc_id""")
def keywords(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.array_join(tx.top_keywords(
        tx.search_words(F.col("text")), 8, "alphabet"), " ").alias("keywords"))
    return rows.filter("keywords <> ''")


@query("text_line_kinds", rf"""
    WITH {PAGES_CTE},
    l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line FROM pages_md)
    SELECT page_id, count(*) AS n_lines,
           count(*) FILTER (length(line) - length(replace(line, '|', '')) >= 2
                            AND NOT starts_with(trim(line), '```')) AS table_lines,
           count(*) FILTER (contains(line, '-')
                            AND regexp_replace(line, '[\s|:-]', '', 'g') = '') AS separators
    FROM l GROUP BY page_id""")
def line_kinds(spark, sf):
    rows = pages_corpus(spark, sf).select("page_id", lines(F.col("text")).alias("ls"))
    return rows.select(
        "page_id", F.size("ls").cast("bigint").alias("n_lines"),
        F.size(F.filter("ls", tx.is_table_line)).cast("bigint").alias("table_lines"),
        F.size(F.filter("ls", tx.is_table_separator)).cast("bigint").alias("separators"))


@query("text_content_type", f"""
    WITH {PAGES_CTE}, {DOCS_CTE},
    every AS (SELECT source_path, text FROM pages_md UNION ALL
              SELECT source_path, text FROM docs),
    l AS (SELECT source_path, unnest(string_split(text, chr(10))) AS line FROM every),
    c AS (SELECT source_path, count(*) AS n,
                 count(*) FILTER (starts_with(ltrim(line), '|')) AS t
          FROM l WHERE trim(line) <> '' GROUP BY source_path),
    k AS (SELECT CASE WHEN t = 0 THEN 'text' WHEN t = n THEN 'table' ELSE 'mixed' END
                 AS content_type FROM c)
    SELECT content_type, count(*) AS files FROM k GROUP BY content_type""")
def content_types(spark, sf):
    every = pages_corpus(spark, sf).select("text").unionByName(
        documents_corpus(spark, sf).select("text"))
    return every.filter(tx.strip(F.col("text")) != "").groupBy(
        tx.content_type(F.col("text")).alias("content_type")).agg(F.count("*").alias("files"))


@query("text_labels", r"""
    SELECT DISTINCT p_name, array_to_string(list_transform(string_split(p_name, ' '),
             lambda w: upper(w[1]) || lower(w[2:])), '') AS node_label,
           replace(upper(p_name), ' ', '_') AS relationship_label
    FROM part""")
def labels(spark, sf):
    names = table(spark, sf, "part").select("p_name").distinct()
    return names.select("p_name", tx.node_label(F.col("p_name")).alias("node_label"),
                        tx.relationship_label(F.col("p_name")).alias("relationship_label"))


@query("text_parse_values", """
    SELECT o_orderkey, CAST(o_orderkey % 90 AS VARCHAR) AS label_low,
           CASE o_orderstatus WHEN 'F' THEN CAST(o_orderkey % 90 AS INT)
                WHEN 'O' THEN NULL ELSE CAST(o_orderkey % 90 AS INT) END AS age_min,
           CASE o_orderstatus WHEN 'F' THEN CAST(o_orderkey % 90 + 9 AS INT)
                WHEN 'O' THEN CAST(o_orderkey % 90 AS INT) ELSE NULL END AS age_max,
           o_orderkey * 1000 AS amount
    FROM orders""")
def parse_values(spark, sf):
    low = (F.col("o_orderkey") % 90).cast("string")
    label = (F.when(F.col("o_orderstatus") == "F", F.concat_ws(
        " - ", low, (F.col("o_orderkey") % 90 + 9).cast("string")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("dưới "), low))
        .otherwise(F.concat(F.lit("từ "), low)))
    age = ps.parse_age_range(label)
    return table(spark, sf, "orders").select(
        "o_orderkey", low.alias("label_low"), age["age_min"].alias("age_min"),
        age["age_max"].alias("age_max"),
        ps.parse_numeric(F.concat(F.col("o_orderkey").cast("string"), F.lit(".000")))
        .alias("amount"))


@query("text_page_names", """
    SELECT o_orderkey, o_orderpriority AS document_name,
           CAST(o_orderkey % 50 AS INT) AS page_number,
           CAST(o_orderkey % 7 AS INT) AS table_index
    FROM orders""")
def page_names(spark, sf):
    path = F.concat_ws("/", F.lit("bic.vn"), F.col("o_orderpriority"), F.format_string(
        "table_p%d_n%d.json", F.col("o_orderkey") % 50, F.col("o_orderkey") % 7))
    page = ps.page_info(F.element_at(F.split(path, "/"), -1))
    return table(spark, sf, "orders").select(
        "o_orderkey", ps.document_name(path).alias("document_name"),
        page["page_number"].alias("page_number"), page["table_index"].alias("table_index"))


@query("vector_resize", """
    WITH cut AS (SELECT vec_id, embedding[1:16] AS v FROM embeddings)
    SELECT vec_id, round(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))
             / list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])), 4) AS squared_norm,
           round(CAST(v[1] AS DOUBLE)
             / sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))), 4) AS first
    FROM cut""")
def vector_resize(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "vec_id", em.resize(F.col("embedding"), 16).alias("v"))
    return rows.select("vec_id", F.round(em.dot(F.col("v"), F.col("v")), 4)
                       .alias("squared_norm"),
                       F.round(F.get("v", F.lit(0)).cast("double"), 4).alias("first"))
