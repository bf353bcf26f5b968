"""Retrieval, answer and chunk-shape evaluation as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.functions.arrays import let, lines
from docmill.functions.parse import first_match


# --- exact nearest-rank percentile ------------------------------------------------------------

def nearest_rank(df: DataFrame, groups: Sequence[str], value: str, q: float,
                 bins: int = 1024) -> DataFrame:
    """Per group the value at sorted position round((n - 1) * q), no interpolation.

    Equal-width histograms (map-side combined) find the bin that holds the
    position; only that bin's distinct values are sorted.  A group with a third
    of all rows is therefore never gathered in one task.
    """
    if not groups:
        whole = nearest_rank(df.withColumn("_all", F.lit(0)), ["_all"], value, q, bins)
        return whole.drop("_all")
    rows = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v"))
    spread = rows.groupBy(*groups).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"),
                                       F.max("_v").alias("_hi"))
    spread = spread.withColumn("_at", F.bround((F.col("_n") - 1) * F.lit(q)).cast("bigint"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width == 0, 0).otherwise(F.least(
        F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    binned = rows.join(spread, list(groups)).withColumn("_b", place)
    counts = binned.groupBy(*groups, "_b", "_at").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*groups).orderBy("_b")
    seen = counts.withColumn("_before", F.sum("_c").over(upto) - F.col("_c"))
    hit = seen.filter((F.col("_before") <= F.col("_at"))
                      & (F.col("_at") < F.col("_before") + F.col("_c")))
    inside = binned.join(hit.select(*groups, "_b", "_before"), [*groups, "_b"]) \
        .groupBy(*groups, "_at", "_before", "_v").agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*groups).orderBy("_v")
    placed = inside.withColumn("_end", F.col("_before") + F.sum("_c").over(order))
    return placed.filter((F.col("_at") < F.col("_end"))
                         & (F.col("_at") >= F.col("_end") - F.col("_c"))) \
        .select(*groups, F.col("_v").alias("percentile"))


# --- per-case rank metrics -----------------------------------------------------------------------

def rank_metrics(retrieved: DataFrame, cases: DataFrame) -> DataFrame:
    """Source, quote and phrase metrics of each case's ordered results.

    ``retrieved``: case_id, rank, source_path, text; ``cases``: case_id,
    source_path, evidence_quote, expected_evidence.  Only ranks up to ten carry
    text into the group.
    """
    normal = tx.eval_text
    wanted = cases.select(
        "case_id", F.col("source_path").alias("expected_path"),
        normal(F.coalesce("evidence_quote", F.lit(""))).alias("quote"),
        F.col("expected_evidence"))
    texts = retrieved.select("case_id", "rank", "source_path", normal(F.col("text")).alias("t"))
    joined = wanted.join(texts, "case_id", "left")
    rank = F.col("rank")
    source = F.min(F.when(F.col("source_path") == F.col("expected_path"), rank))
    quote = F.min(F.when((F.col("quote") != "") & F.col("t").contains(F.col("quote")), rank))

    def combined(k: int) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(
            rank <= k, F.struct("rank", "t")))), lambda s: s["t"]), " ")
    grouped = joined.groupBy("case_id").agg(
        source.alias("source_rank"), quote.alias("quote_rank"),
        F.first("quote").alias("quote"), F.first("expected_evidence").alias("phrases"),
        combined(5).alias("top5"), combined(10).alias("top10"))

    def hit(r: str, k: int) -> Column:
        return F.when(F.col(r) <= k, 1.0).otherwise(0.0)

    def phrase(k: str) -> Column:
        folded = F.transform("phrases", lambda p: tx.collapse_ws(F.replace(
            F.lower(p), F.lit("**"), F.lit(" "))))
        return tx.phrase_recall(folded, F.col(k))
    asked = F.col("quote") != ""
    return grouped.select(
        "case_id", "source_rank", "quote_rank",
        hit("source_rank", 5).alias("source_hit_at_5"),
        hit("source_rank", 10).alias("source_hit_at_10"),
        F.when(F.col("source_rank") <= 5, 1 / F.col("source_rank")).otherwise(0.0)
        .alias("mrr_at_5"),
        F.when(F.col("source_rank") <= 10, 1 / F.col("source_rank")).otherwise(0.0)
        .alias("mrr_at_10"), asked.alias("has_evidence_quote"),
        F.when(asked, hit("quote_rank", 5)).alias("quote_hit_at_5"),
        F.when(asked, hit("quote_rank", 10)).alias("quote_hit_at_10"),
        F.size("phrases").alias("expected_evidence_phrase_count"),
        phrase("top5").alias("evidence_phrase_recall_at_5"),
        phrase("top10").alias("evidence_phrase_recall_at_10"))


MEANS = ("source_hit_at_5", "source_hit_at_10", "mrr_at_5", "mrr_at_10")
OPTIONAL = ("quote_hit_at_5", "quote_hit_at_10")
PHRASES = ("evidence_phrase_recall_at_5", "evidence_phrase_recall_at_10")


def summary_columns(df: DataFrame) -> list[Column]:
    """The aggregate list of a retrieval summary row (percentile apart)."""
    quoted = F.count("quote_hit_at_5")
    phrased = F.col("expected_evidence_phrase_count") > 0
    out = [F.count("*").alias("case_count"), F.count_if("success").alias("success_case_count"),
           F.count_if(F.col("execution_error") != "").alias("error_case_count"),
           quoted.alias("quote_case_count"), F.count_if(phrased).alias("phrase_case_count")]
    out += [F.round(F.avg(m), 4).alias(m) for m in MEANS]
    out += [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 4).alias(m) for m in OPTIONAL]
    out += [F.round(F.coalesce(F.avg(F.when(phrased, F.col(m))), F.lit(0.0)), 4).alias(m)
            for m in PHRASES]
    out.append(F.round(F.avg("latency_ms"), 3).alias("latency_ms_avg"))
    for m in (*MEANS, *OPTIONAL, *PHRASES):
        if f"pre_rerank_{m}" in df.columns:
            before = F.coalesce(F.avg(f"pre_rerank_{m}"), F.lit(0.0))
            out += [F.round(before, 4).alias(f"pre_rerank_{m}"),
                    F.round(F.coalesce(F.avg(m), F.lit(0.0)) - before, 4)
                    .alias(f"{m}_delta_vs_pre_rerank")]
    return out


def retrieval_summary(metrics: DataFrame) -> DataFrame:
    """Per (file, version, scenario) and per scenario over all files."""
    keys = ["group_name", "group_version", "scenario_name"]
    named = metrics.select("*", F.coalesce("benchmark_file", F.lit("")).alias("group_name"),
                           F.coalesce("benchmark_version", F.lit("")).alias("group_version"))
    sets = [[F.col(k) for k in keys], [F.col("scenario_name")]]
    rows = named.groupingSets(sets, *keys).agg(*summary_columns(metrics))
    rows = rows.select(F.coalesce("group_name", F.lit("ALL")).alias("group_name"),
                       F.coalesce("group_version", F.lit("ALL")).alias("group_version"),
                       *[c for c in rows.columns if c not in ("group_name", "group_version")])
    both = named.select(*keys, "latency_ms").unionByName(named.select(
        F.lit("ALL").alias("group_name"), F.lit("ALL").alias("group_version"),
        "scenario_name", "latency_ms"))
    p95 = nearest_rank(both, keys, "latency_ms", 0.95).select(
        *keys, F.round("percentile", 3).alias("latency_ms_p95"))
    return rows.join(p95, keys, "left")


def provider_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("provider", "scenario_name").agg(*summary_columns(metrics))


# --- per-case source metrics of a chunking strategy ---------------------------------------------

def primary_source(expected: Column) -> Column:
    """The first primary source, else the first, else an empty path."""
    chosen = F.filter(expected, lambda s: s["relationship"] == "primary")
    return F.coalesce(F.try_element_at(chosen, F.lit(1))["source_path"],
                      F.try_element_at(expected, F.lit(1))["source_path"], F.lit(""))


def required_sources(required: Column, expected: Column) -> Column:
    listed = F.filter(F.coalesce(required, F.array().cast("array<string>")), lambda p: p != "")
    cited = F.filter(F.transform(expected, lambda s: s["source_path"]), lambda p: p != "")
    return F.array_distinct(F.when(F.size(listed) > 0, listed).otherwise(cited))


def score_cases(retrieved: DataFrame, cases: DataFrame, k: int = 5,
                open_end: bool = False) -> DataFrame:
    """Primary hit, reciprocal rank, required-source recall and line-overlap recall.

    ``open_end`` reads a missing end line as the start line.  Each group holds at
    most k retrieved chunks.
    """
    top = retrieved.filter(F.col("rank") <= k).groupBy("strategy", "case_id").agg(
        F.collect_list(F.struct("rank", "source_path", "start_line", "end_line")).alias("hits"))
    expected = F.col("expected_sources")
    wanted = cases.select(
        "case_id", primary_source(expected).alias("primary_source_path"),
        required_sources(F.col("required_source_paths"), expected).alias("required"),
        F.transform(expected, lambda s: F.struct(
            s["source_path"].alias("source_path"), s["line_start"].alias("a"),
            (F.coalesce(s["line_end"], s["line_start"]) if open_end else s["line_end"])
            .alias("b"))).alias("spans"))
    rows = top.join(wanted, "case_id")
    rows = rows.withColumn("spans", F.filter(
        "spans", lambda s: s["a"].isNotNull() & s["b"].isNotNull()))
    rank = F.array_min(F.transform(F.filter(
        "hits", lambda h: h["source_path"] == F.col("primary_source_path")),
        lambda h: h["rank"]))
    found = F.size(F.array_intersect("required", F.transform(
        "hits", lambda h: h["source_path"])))
    overlapping = F.size(F.filter("spans", lambda s: F.exists("hits", lambda h: (
        h["source_path"] == s["source_path"])
        & (F.greatest(s["a"], h["start_line"]) <= F.least(s["b"], h["end_line"])))))
    return rows.select(
        "strategy", "case_id", "primary_source_path", F.size("hits").alias("retrieved_count"),
        F.when(rank.isNotNull(), 1.0).otherwise(0.0).alias("primary_hit_at_k"),
        rank.alias("primary_rank_at_k"),
        F.coalesce(1 / rank, F.lit(0.0)).alias("primary_mrr_at_k"),
        F.size("required").alias("required_source_count"),
        F.when(F.size("required") > 0, found / F.size("required")).otherwise(0.0)
        .alias("required_source_recall_at_k"),
        F.size("spans").alias("line_expected_count"),
        F.when(F.size("spans") > 0, overlapping / F.size("spans")).otherwise(0.0)
        .alias("line_overlap_recall_at_k"))


def strategy_summary(case_metrics: DataFrame) -> DataFrame:
    names = ["primary_hit_at_k", "primary_mrr_at_k", "required_source_recall_at_k",
             "line_overlap_recall_at_k"]
    return case_metrics.groupBy("strategy").agg(
        F.count("*").alias("cases"),
        *[F.round(F.coalesce(F.avg(n), F.lit(0.0)), 4).alias(n) for n in names])


def ordered_strategies(summary: DataFrame, points: str = "qdrant_points",
                       line_overlap: bool = True) -> DataFrame:
    keys = [F.desc("required_source_recall_at_k"), F.desc("primary_mrr_at_k")]
    keys += [F.desc("line_overlap_recall_at_k")] if line_overlap else []
    return summary.orderBy(*keys, *([points] if points in summary.columns else []), "strategy")


def judge_summary(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean of each judged metric over the rows that have it; NULL where none has."""
    return scores.groupBy("strategy").agg(
        F.count("*").alias("cases"), F.count_if(F.col("error") != "").alias("failed"),
        *[F.round(F.avg(m), 4).alias(m) for m in metrics])


def metric_means(scores: DataFrame) -> DataFrame:
    """Mean per metric name; missing scores are skipped."""
    return scores.filter(F.col("score").isNotNull()).groupBy("metric").agg(
        F.round(F.avg("score"), 6).alias("mean_score"))


def scoring_key(config: Column, case: Column, contexts: Column) -> Column:
    """Cache key of one judged case: its inputs in a fixed field order."""
    return F.sha2(F.to_json(F.struct(config.alias("config"), case.alias("case"),
                                     contexts.alias("contexts"))), 256)


# --- graded relevance ---------------------------------------------------------------------------------

def graded_metrics(results: DataFrame) -> DataFrame:
    """hit@1/3/5, MRR@5, nDCG@5 and coverage@5 per query from (query_id, rank, relevance)."""
    top = results.filter(F.col("rank") <= 5)
    relevant = F.col("relevance") >= 0.2
    gain = F.col("relevance") / F.log2(F.col("rank") + 1)
    per = top.groupBy("query_id").agg(
        F.min(F.when(relevant, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"),
        F.max("relevance").alias("coverage_5"),
        F.sort_array(F.collect_list("relevance"), False).alias("ideal"))
    ideal = F.aggregate(F.transform("ideal", lambda r, i: r / F.log2(i + 2)),
                        F.lit(0.0), lambda acc, x: acc + x)

    def hit(k: int) -> Column:
        return F.when(F.col("first") <= k, 1.0).otherwise(0.0)
    return per.select("query_id", hit(1).alias("hit_1"), hit(3).alias("hit_3"),
                      hit(5).alias("hit_5"),
                      F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr_5"),
                      F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg_5"),
                      "coverage_5")


def retrieval_score(metrics: DataFrame) -> DataFrame:
    """Means over queries and the weighted retrieval score (0-100)."""
    names = ["hit_1", "hit_3", "hit_5", "mrr_5", "ndcg_5", "coverage_5"]
    means = metrics.agg(F.count("*").alias("queries"), *[F.avg(n).alias(n) for n in names])
    score = 100 * (0.30 * F.col("hit_1") + 0.20 * F.col("hit_3") + 0.15 * F.col("hit_5")
                   + 0.20 * F.col("mrr_5") + 0.15 * F.col("coverage_5"))
    return means.select("queries", *[F.round(n, 6).alias(n) for n in names],
                        F.round(score, 4).alias("retrieval_score"))


def overlap_chars(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def chunk_relevance(chunk: tuple[Column, Column], evidence: tuple[Column, Column]) -> Column:
    """Share of the evidence span a chunk of the same document covers."""
    size = F.greatest(F.lit(1), evidence[1] - evidence[0])
    return F.least(F.lit(1.0), overlap_chars(*chunk, *evidence) / size)


def context_efficiency(results: DataFrame, evidence: DataFrame, k: int = 5) -> DataFrame:
    """Per query: the largest evidence overlap of its first k chunks over their characters.

    ``results``: query_id, rank, doc_id, start, end, n_chars.  ``evidence``: query_id,
    doc_id, start, end.  A query without retrieved characters scores 0.
    """
    wanted = evidence.select("query_id", F.col("doc_id").alias("_d"), F.col("start").alias("_s"),
                             F.col("end").alias("_e"))
    top = results.filter(F.col("rank") <= k).join(wanted, "query_id")
    overlap = F.when(F.col("doc_id") == F.col("_d"), overlap_chars(
        F.col("start"), F.col("end"), F.col("_s"), F.col("_e"))).otherwise(0)
    per = top.groupBy("query_id").agg(F.max(overlap).alias("best"), F.sum("n_chars").alias("chars"))
    return per.select("query_id", F.round(F.when(F.col("chars") > 0, F.col("best") / F.col("chars"))
                                          .otherwise(0.0), 6).alias("context_efficiency_5"))


def judge_inputs(retrieved: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per strategy and case: the case's columns and its chunks in rank order.

    ``retrieved``: strategy, case_id, rank, chunk_id (a handful per case); chunks of
    unknown cases are left out.
    """
    grouped = retrieved.groupBy("strategy", "case_id").agg(F.sort_array(F.collect_list(
        F.struct("rank", "chunk_id"))).alias("chunks"))
    return grouped.join(cases, "case_id").withColumn(
        "chunk_ids", F.transform("chunks", lambda c: c["chunk_id"])).drop("chunks")


def overall_score(retrieval: Column, quality: Column) -> Column:
    return 0.78 * retrieval + 0.22 * quality


def rank_methods(retrieval: DataFrame, quality: DataFrame) -> DataFrame:
    """Methods by overall score: (method, retrieval_score, quality_score, overall_score, place)."""
    from docmill.operators.numbering import ranked

    both = retrieval.select("method", "retrieval_score").join(
        quality.select("method", "quality_score"), "method")
    scored = both.withColumn("overall_score", F.round(overall_score(
        F.col("retrieval_score"), F.col("quality_score")), 6)).withColumn("_o", -F.col("overall_score"))
    return ranked(scored, [], ["_o", "method"], "place").drop("_o")


# --- chunk shape -----------------------------------------------------------------------------------------

def chunk_statistics(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.length("text")
    return chunks.groupBy(*keys).agg(
        F.count("*").alias("chunk_count"),
        F.count_if(tx.contains_table_line(F.col("text"))).alias("table_chunk_count"),
        F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.sum(n).alias("total_chars"),
        F.round(F.avg(n), 2).alias("avg_chars"))


def chunk_quality(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Size bands, cut words and sentences, orphan headings, headless tables, redundancy.

    Documents are joined once by id for the two characters around each cut; the
    rest of a chunk's flags come from its own text.
    """
    text, tokens = F.col("text"), F.col("tokens")
    edges = docs.select("doc_id", F.col("text").alias("_src"))
    flagged = chunks.join(edges, "doc_id")
    inside = F.col("end") < F.length("_src")
    before, after = F.substring("_src", F.col("end"), F.lit(1)), F.substring(
        "_src", F.col("end") + 1, F.lit(1))
    blank = [" ", "\n", "\t"]
    last = F.substring(F.rtrim(text), -1, 1)
    heading_end = F.regexp_extract(text, r"(?md)\A[\s\S]*?^#{1,6}\s+.+$([\s\S]*)\z", 1)
    has_heading = text.rlike(r"(?md)^#{1,6}\s+.+$")
    pipes = F.filter(lines(text), lambda ln: F.trim(ln).startswith("|"))
    headed = let(pipes, lambda ps: (F.size(ps) >= 2) & F.trim(F.get(ps, F.lit(1))).rlike(
        r"^\|?\s*:?-{2,}:?.*$"))

    def share(condition: Column) -> Column:
        return F.avg(condition.cast("int"))
    rows = flagged.groupBy("method").agg(
        F.count("*").alias("chunk_count"), F.avg(tokens).alias("avg_tokens"),
        F.percentile(tokens, F.lit(0.5)).alias("median_tokens"),
        F.percentile(tokens, F.lit(0.95)).alias("p95_tokens"),
        F.sum(tokens).cast("bigint").alias("total_tokens"), F.sum(F.length(text)).alias("chars"),
        share(tokens.between(100, 500)).alias("good_size_ratio"),
        share(tokens < 50).alias("tiny_ratio"), share(tokens > 800).alias("oversized_ratio"),
        share(inside & ~before.isin(blank) & ~after.isin(blank)).alias("mid_word_cut_ratio"),
        share(inside & ~last.isin([".", "!", "?", "|"]) & (last != ""))
        .alias("mid_sentence_cut_ratio"),
        share(has_heading & (F.length(tx.strip(heading_end)) < 40))
        .alias("header_orphan_ratio"),
        share(text.contains("|") & ~headed & (F.size(pipes) >= 2))
        .alias("table_without_header_ratio"))
    rows = rows.withColumn("source_chars", docs.agg(F.sum(F.length("text"))).scalar()).withColumn(
        "redundancy_ratio", F.col("chars") / F.greatest(F.lit(1), F.col("source_chars")))
    penalty = (18 * F.col("tiny_ratio") + 18 * F.col("oversized_ratio")
               + 22 * F.col("mid_word_cut_ratio") + 10 * F.col("mid_sentence_cut_ratio")
               + 12 * F.col("header_orphan_ratio") + 12 * F.col("table_without_header_ratio")
               + F.greatest(F.lit(0.0), F.col("redundancy_ratio") - 1.15) * 18)
    return rows.withColumn("quality_score", F.greatest(F.lit(0.0), 100 - penalty)) \
        .drop("chars", "source_chars")


def chunk_coherence(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boundary completeness and size consistency of each method's chunks."""
    head, n = F.substring("text", 1, 1), F.length("text")
    starts = head.rlike(r"^[\p{Ll},;:)\]}]")
    ends = ~F.col("text").rlike(r"[.!?]\s*$")
    return chunks.filter(n > 0).groupBy(*keys).agg(
        F.count("*").alias("total_chunks"), F.round(F.avg(n), 2).alias("avg_chunk_size"),
        F.round(1 - (F.count_if(starts) + F.count_if(ends)) / (2 * F.count("*")), 2)
        .alias("chunk_coherence"),
        F.round(1 - F.stddev_pop(n) / F.greatest(F.lit(1.0), F.avg(n)), 2)
        .alias("size_consistency"))


def keyword_coverage(chunks: DataFrame, keywords: Sequence[str], keys: Sequence[str]
                     ) -> DataFrame:
    """Share of the keywords contained in at least one chunk."""
    low = F.lower("text")
    hits = [F.max(low.contains(k.lower()).cast("int")) for k in keywords]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return chunks.groupBy(*keys).agg(F.round(total / max(1, len(keywords)), 2)
                                     .alias("keyword_coverage"))


def concept_integrity(chunks: DataFrame, phrases: Sequence[str], keys: Sequence[str],
                      order: str = "chunk_index") -> DataFrame:
    """One minus the share of phrases found only in pieces across chunks.

    A phrase is split when a leading part stands in one chunk and its remainder
    in a later chunk without that part, and no chunk holds it whole.  Minimum and
    maximum positions decide this, so no chunk list is gathered.
    """
    low = F.lower("text")
    out = []
    for phrase in phrases:
        words = phrase.lower().split()
        whole = F.max(low.contains(" ".join(words)).cast("int")) == 1
        apart = F.lit(False)
        for i in range(1, len(words)):
            head, tail = " ".join(words[:i]), " ".join(words[i:])
            first = F.min(F.when(low.contains(head), F.col(order)))
            later = F.max(F.when(low.contains(tail) & ~low.contains(head), F.col(order)))
            apart = apart | F.coalesce(first < later, F.lit(False))
        out.append((apart & ~whole).cast("int"))
    total = out[0]
    for x in out[1:]:
        total = total + x
    return chunks.groupBy(*keys).agg(F.round(1 - total / len(phrases), 2)
                                     .alias("concept_integrity"))


def refinement_suggestions(ratings: DataFrame) -> DataFrame:
    """Chunks rated below 3, and code-related ones rated below 4."""
    per = ratings.groupBy("chunk_id").agg(
        F.avg("rating").alias("avg_rating"),
        F.max(F.lower("query").contains("code")).alias("code"))
    low = F.when(F.col("avg_rating") < 3, F.struct(
        F.lit("Low performance across queries").alias("issue"),
        F.lit("Consider refining this chunk or checking content quality").alias("suggestion")))
    code = F.when(F.col("code") & (F.col("avg_rating") < 4), F.struct(
        F.lit("Poor performance on code-related queries").alias("issue"),
        F.lit("Use code-specific chunking for this section").alias("suggestion")))
    rows = per.select("chunk_id", "avg_rating", F.explode(F.array_compact(F.array(low, code)))
                      .alias("s"))
    return rows.select("chunk_id", "avg_rating", "s.issue", "s.suggestion")


# --- answers -----------------------------------------------------------------------------------------------

GENERIC_ANSWER = "trả lời dựa trên evidence_quote"


def score_answers(answers: DataFrame, contexts: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Citation validity, coverage, grounding and the weighted quality of each answer.

    ``answers``: case_id, answer, source_path, expected_answer, evidence_quote,
    expected_evidence, must_cite_source.  ``contexts``: case_id, citation_id,
    source_path, text (a handful per case).
    """
    from docmill.functions.arrays import stage

    grouped = contexts.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(
        "citation_id", "source_path", "text"))).alias("ctx"))
    rows = answers.join(grouped, "case_id", "left").withColumn(
        "ctx", F.coalesce("ctx", F.array().cast(
            "array<struct<citation_id:string,source_path:string,text:string>>")))
    rows = rows.withColumn("_answer", tx.nfkc_casefold(F.col("answer"))).withColumn(
        "_expected", tx.nfkc_casefold(F.coalesce("expected_answer", F.lit("")))).withColumn(
        "_quote", tx.nfkc_casefold(F.coalesce("evidence_quote", F.lit("")))).withColumn(
        "_context", tx.nfkc_casefold(F.array_join(F.transform(
            "ctx", lambda c: c["text"]), "\n")))

    def statements(text: Column) -> Column:
        merged = tx.merge_detached_citations(tx.statements(text))
        return F.filter(merged, lambda s: (F.length(tx.collapse_ws(s)) >= 12)
                        & ~F.lower(s).contains("không đủ bằng chứng"))

    def tokens(folded: Column) -> Column:
        return F.array_distinct(tx.significant_tokens(F.regexp_replace(
            tx.collapse_ws(folded), r"\[s\d+\]", "")))
    generic = tx.collapse_ws(F.col("_expected")).startswith(GENERIC_ANSWER)
    gold = F.when((F.col("_quote") != "") & generic, F.col("_quote")).when(
        F.col("_expected") != "", F.col("_expected")).otherwise(F.col("_quote"))
    rows = stage(rows, cited=tx.citation_ids(F.col("answer")),
                 known=F.transform("ctx", lambda c: c["citation_id"]),
                 stmts=statements(F.col("answer")), a=tokens(F.col("_answer")),
                 g=tokens(gold), x=tokens(F.col("_context")))
    rows = stage(rows, valid=F.filter("cited", lambda c: F.array_contains("known", c)))
    unsupported = F.aggregate(F.transform("stmts", lambda s: let(
        F.array_distinct(tx.numbers(tx.remove_citations(s))), lambda ns: let(
            F.flatten(F.transform(F.filter("ctx", lambda c: F.array_contains(
                tx.citation_ids(s), c["citation_id"])), lambda c: tx.numbers(c["text"]))),
            lambda have: F.size(F.array_except(ns, have))))), F.lit(0), lambda acc, n: acc + n)
    covered = F.size(F.filter("stmts", lambda s: F.arrays_overlap(
        tx.citation_ids(s), F.col("known"))))
    phrases = F.transform(F.filter("expected_evidence", lambda p: tx.strip(p) != ""),
                          lambda p: tx.collapse_ws(F.lower(p)))
    rows = stage(
        rows,
        expected_source_cited=F.exists("ctx", lambda c: F.array_contains(
            "valid", c["citation_id"]) & (c["source_path"] == F.col("source_path"))),
        valid_citation_rate=F.when(F.size("cited") > 0, F.size("valid") / F.size("cited"))
        .otherwise(0.0),
        citation_coverage=F.when(F.size("stmts") > 0, covered / F.size("stmts")).otherwise(0.0),
        answer_gold_token_recall=tx.token_recall(F.col("g"), F.col("a")),
        answer_context_token_precision=tx.token_recall(F.col("a"), F.col("x")),
        expected_evidence_phrase_recall=F.when(F.size("expected_evidence") > 0, tx.phrase_recall(
            phrases, tx.collapse_ws(F.col("_answer")))),
        unsupported_numeric_claim_count=unsupported)
    support = F.when(F.col("unsupported_numeric_claim_count") == 0, 1.0).otherwise(0.0)
    quality = F.round(
        0.25 * F.col("expected_source_cited").cast("int")
        + 0.25 * F.col("answer_gold_token_recall")
        + 0.15 * F.coalesce("expected_evidence_phrase_recall", "answer_gold_token_recall")
        + 0.15 * F.col("citation_coverage") + 0.10 * F.col("answer_context_token_precision")
        + 0.10 * support, 4)
    cited_well = ((F.size("cited") > 0) & (F.col("valid_citation_rate") == 1.0)
                  & (F.col("citation_coverage") == 1.0))
    keep = [c for c in answers.columns if c not in ("expected_evidence",)]
    rounded = [F.round(c, 4).alias(c) for c in (
        "valid_citation_rate", "citation_coverage", "answer_gold_token_recall",
        "expected_evidence_phrase_recall", "answer_context_token_precision")]
    return rows.select(
        *keep, "expected_source_cited", (F.size("cited") > 0).alias("answer_has_citation"),
        *rounded, support.alias("numeric_claim_support"), "unsupported_numeric_claim_count",
        quality.alias("answer_quality_score"),
        ((quality >= threshold) & cited_well & (F.col("expected_source_cited")
         | ~F.col("must_cite_source"))).alias("success"),
        F.size("ctx").alias("retrieved_context_count"),
        F.array_join("valid", ",").alias("cited_context_ids"))


def answer_summary(scored: DataFrame) -> DataFrame:
    """Overall, per provider and per risk, in one grouping-sets pass."""
    aggregates = [
        F.count("*").alias("cases"), F.round(F.avg(F.col("success").cast("int")), 4)
        .alias("success_rate"), F.round(F.avg("answer_quality_score"), 4).alias("quality"),
        F.round(F.avg(F.col("expected_source_cited").cast("int")), 4).alias("source_cited"),
        F.round(F.avg("answer_gold_token_recall"), 4).alias("gold_recall"),
        F.round(F.avg("citation_coverage"), 4).alias("coverage"),
        F.sum("unsupported_numeric_claim_count").alias("unsupported_numbers")]
    rows = scored.groupingSets([[], [F.col("provider")], [F.col("risk")]], "provider", "risk") \
        .agg(F.grouping_id().alias("gid"), *aggregates)
    return rows.select(
        first_match([(F.col("gid") == 3, "overall"), (F.col("gid") == 1, "provider")], "risk")
        .alias("group_type"),
        F.coalesce(F.col("provider"), F.col("risk"), F.lit("all")).alias("group_name"),
        *[c for c in rows.columns if c not in ("provider", "risk", "gid")])


def snap_quote(lines_: Column, quote_tokens: Column, threshold: float = 0.58) -> Column:
    """Best window of one to three non-blank lines for a near quote.

    struct(text, first, last, score) with 1-based lines, or NULL below the
    threshold or for quotes of fewer than four tokens.
    """
    def best(ls: Column) -> Column:
        def of_size(w: int) -> Column:
            return F.filter(F.transform(ls, lambda ln, i: F.struct(
                F.array_join(F.transform(F.slice(ls, i + 1, F.lit(w)), lambda x: x["t"]), " ")
                .alias("text"), ln["n"].alias("first"), F.get(ls, i + w - 1)["n"].alias("last"))),
                lambda s: s["last"].isNotNull())
        windows = F.concat(of_size(1), of_size(2), of_size(3))
        asked = F.array_distinct(quote_tokens)
        scored = F.transform(windows, lambda s: let(
            F.array_distinct(tx.lexical_tokens(s["text"])), lambda c: F.struct(
                (0.7 * F.size(F.array_intersect(asked, c)) / F.greatest(F.lit(1), F.size(asked))
                 + 0.3 * F.size(F.array_intersect(asked, c))
                 / F.greatest(F.lit(1), F.size(c))).alias("score"),
                s["text"].alias("text"), s["first"].alias("first"), s["last"].alias("last"))))
        return F.aggregate(scored, F.lit(None).cast(
            "struct<score:double,text:string,first:int,last:int>"),
            lambda acc, s: F.when(acc.isNull() | (s["score"] > acc["score"]), s).otherwise(acc))
    numbered = F.filter(F.transform(lines_, lambda ln, i: F.struct(
        tx.strip(ln).alias("t"), (i + 1).alias("n"))), lambda s: s["t"] != "")
    found = let(numbered, best)
    return F.when((F.size(quote_tokens) >= 4) & (found["score"] >= threshold), found)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last record per key; max_by combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
            .select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]))




# The compared retrieval scenarios (mode, company filter, rerank).
SCENARIOS = {
    "vector": ("vector", False, False),
    "hybrid": ("hybrid", False, False),
    "hybrid_company_filter": ("hybrid", True, False),
    "hybrid_rerank": ("hybrid", False, True),
    "hybrid_company_filter_rerank": ("hybrid", True, True),
}


def with_scenarios(cases: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Every case once per scenario: the fixed scenario list is exploded in the row."""
    chosen = SCENARIOS if names is None else {n: SCENARIOS[n] for n in names}
    listed = F.array(*[F.struct(F.lit(n).alias("scenario_name"), F.lit(m).alias("mode"),
                                F.lit(c).alias("company_filter_applied"),
                                F.lit(r).alias("rerank_applied"))
                       for n, (m, c, r) in chosen.items()])
    return cases.select("*", F.inline(listed))


def first_primary_sources(cases: DataFrame, corpus: DataFrame, limit: int) -> DataFrame:
    """The first distinct primary sources, in case order, that exist in the corpus."""
    primary = cases.select("ord", primary_source(F.col("expected_sources")).alias("source_path"))
    first = primary.filter("source_path <> ''").groupBy("source_path").agg(
        F.min("ord").alias("ord"))
    return first.join(corpus.select("source_path").distinct(), "source_path", "left_semi") \
        .orderBy("ord").limit(limit)
