"""Document corpora derived from the driver tables.

Web pages become Markdown by an ordered list of pattern rewrites that both
engines understand: title and headings to #, link lists to pipe tables, the
rest to paragraphs.  The rewrites are row-local and read whole pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.session import spread, table

PAGE_REWRITES: list[tuple[str, str]] = [
    (r"(?s)<script.*?</script>", ""),
    (r"(?s)<style.*?</style>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?s)<title>(.*?)</title>", "\n\n# {1}\n\n"),
    (r"<nav><ul>", "\n\n## Navigation\n\n| text | link |\n|---|---|\n"),
    (r'<li><a href="([^"]*)">([^<]*)</a></li>', "| {2} | {1} |\n"),
    (r"</ul></nav>", "\n\n"),
    (r"(?s)<h1>(.*?)</h1>", "\n\n## {1}\n\n"),
    (r"<p><b>", "\n\n### Lead\n\n"),
    (r"<br>", "\n"),
    (r"<p>", "\n\n"),
    (r"<footer>", "\n\n## Footer\n\n"),
    (r"<[^>]*>", ""),
    (r"&quot;", '"'),
    (r"&copy;", "©"),
    (r"&middot;", "·"),
    (r"&amp;", "&"),
    (r"\n{3,}", "\n\n"),
    (r"^\s+", ""),
    (r"\s+$", ""),
]


def page_markdown(html: Column) -> Column:
    for pattern, target in PAGE_REWRITES:
        html = F.regexp_replace(html, pattern, target.replace("{1}", "$1").replace("{2}", "$2"))
    return html


def _page_markdown_sql() -> str:
    text = "html"
    for pattern, target in PAGE_REWRITES:
        target = target.replace("{1}", r"\1").replace("{2}", r"\2")
        quoted = [s.replace("'", "''") for s in (pattern, target)]
        text = f"regexp_replace({text}, '{quoted[0]}', '{quoted[1]}', 'g')"
    return text


SITE_SQL = r"regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"

# Oracle twins of the two corpora.
PAGES_CTE = f"""pages_md AS (
    SELECT page_id, {SITE_SQL} AS provider,
           {SITE_SQL} || '/' || CAST(page_id AS VARCHAR) || '.md' AS source_path,
           {_page_markdown_sql()} AS text
    FROM pages)"""
DOCS_CTE = """docs AS (
    SELECT doc_id, source AS provider, source || '/' || CAST(doc_id AS VARCHAR) || '.md'
           AS source_path, text
    FROM documents)"""


def pages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, provider, source_path, text) with Markdown text."""
    site = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    return spread(table(spark, sf_dir, "pages")).select(
        "page_id", site.alias("provider"),
        F.concat(site, F.lit("/"), F.col("page_id").cast("string"), F.lit(".md"))
        .alias("source_path"), page_markdown(F.col("html")).alias("text"))


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, provider, source_path, text) of the prose documents."""
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("source").alias("provider"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
        .alias("source_path"), "text")
