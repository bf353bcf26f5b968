"""Building benchmark cases: candidates, interleaving, caps, grouping, verification."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import parse as ps
from docmill.functions import text as tx
from docmill.functions.arrays import lines, stage
from docmill.operators.numbering import ranked
from docmill.session import dealt, hash_blocks, spread, stored

# Contexts per case type, in reporting order.
CONTEXTS = {"single_context": 1, "two_context": 2, "three_context": 3, "table_context": 1}
HOTLINE = "hotline|assistance@|liên hệ|email|số điện thoại|3821-6699"


def candidate_lines(docs: DataFrame, keywords: str = ps.KEYWORDS, low_value: str = ps.LOW_VALUE
                    ) -> DataFrame:
    """Lines of 80-900 characters on a known topic, outside tables, worth asking about."""
    rows = docs.select("provider", "source_path", F.posexplode(lines(F.col("text"))).alias("i", "line"))
    # a quote is no longer than its line, and is stripped once
    rows = stage(rows.filter(F.length("line") >= 80), quote=tx.strip(F.col("line")))
    kept = rows.filter(F.length("quote").between(80, 900) & ~F.col("quote").startswith("|")
                       & F.col("quote").rlike(f"(?iu){keywords}")
                       & ~F.col("quote").rlike(f"(?iu){low_value}"))
    return kept.select("provider", "source_path", ps.benchmark_document_type(F.col("source_path")).alias("document_type"),
                       (F.col("i") + 1).alias("line_start"), "quote")


def sufficient(quotes: list[tuple], top: int) -> list[tuple]:
    """Of (-overlap, id, path) in order, those among the best ``top`` for some source that is left out:
    ``top`` of a source at most, and ``top + 1`` sources."""
    kept, places = [], {}
    for quote in quotes:
        here = places.get(quote[2], 0)
        if (here and here < top) or (not here and len(places) <= top):
            kept.append(quote)
            places[quote[2]] = here + 1
    return kept


def _similar(shipped, top: int, threshold: float):
    """Arrow function (sid, n, codes, offers, own) -> what the shipped sets and a task's sets offer to each other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(shipped.value, threshold)
        for whole in batches:
            for at in range(0, whole.num_rows, SHARD_SETS):
                yield block.offered(whole.slice(at, SHARD_SETS), top)
    return run


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends with a leading zero) of a column of lists."""
    return np.asarray(column.flatten()), np.append(0, np.cumsum(np.asarray(pc.list_value_length(column)), dtype=np.int64))


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lengths[i], one after the other."""
    return np.repeat(starts - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())


class _Sets:
    """Token sets in order of their sizes; codes go from rare to frequent within a set."""

    def __init__(self, rows: pa.RecordBatch | pa.Table):
        rows = rows.take(pc.sort_indices(rows.column("n")))
        columns = {c: v if isinstance(v, pa.Array) else v.combine_chunks() for c, v in zip(rows.schema.names, rows.columns, strict=True)}
        self.sid, self.n, self.offers = np.asarray(columns["sid"]), np.asarray(columns["n"]), columns["offers"]
        self.codes, self.ends = _numbers(columns["codes"])
        self.own = np.asarray(columns["own"]) if "own" in columns else None

    def rare(self, first: int, stop: int, left_out: int) -> tuple[np.ndarray, np.ndarray]:
        """(set, code) of some sets without the most frequent codes of each."""
        lengths = np.maximum(np.diff(self.ends[first:stop + 1]) - left_out, 0)
        return np.repeat(np.arange(first, stop), lengths), self.codes[_spans(self.ends[first:stop], lengths)]


class _Block(_Sets):
    """Shipped sets, inverted class by class of their sizes.

    A pair at the threshold t shares ``t * n`` tokens or more of either set, so a set of n may leave
    out up to ``ceil(t * n) - 1`` most frequent ones: of two sets the larger of these numbers is lost
    at most, and a pair whose count falls short of what its sizes need even with those is out.  The
    other pairs are counted in full; at seven tenths of that number they are few (measured).
    """

    def __init__(self, sets: pa.Table, threshold: float):
        super().__init__(sets)
        self.threshold, self.classes = threshold, []
        for first in range(0, len(self.n), CLASS_SETS):
            stop = min(first + CLASS_SETS, len(self.n))
            lost = self._left_out(self.n[first])
            holders, codes = self.rare(first, stop, lost)
            if len(codes):
                order = np.argsort(codes)
                holders, codes = (holders[order] - first).astype(np.uint32), codes[order]
                begins = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
                self.classes.append((first, stop, lost, holders, codes[begins], np.append(begins, len(codes))))

    def _left_out(self, n: int) -> int:
        return max(7 * (int(np.ceil(self.threshold * n - 1e-9)) - 1) // 10, 0)

    def _need(self, n, m):
        """Common tokens that sets of n and m need, before rounding up."""
        return self.threshold / (1 + self.threshold) * (n + m) - 1e-9

    def offered(self, rows: pa.RecordBatch, top: int) -> pa.RecordBatch:
        asking = _Sets(rows)
        pairs = [pair for first in range(0, len(asking.n), CLASS_ASKING)
                 for pair in self._met(asking, first, min(first + CLASS_ASKING, len(asking.n)))]
        x, y = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*pairs, strict=True) if pairs else ((), ())))
        return self._best(asking, x, y, top)

    def _met(self, asking: _Sets, first: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (asking, shipped) that may reach the threshold."""
        lost = self._left_out(asking.n[first])
        owner, rare = asking.rare(first, stop, lost)
        if not len(rare):
            return
        for begin, end, lost_here, holders, known, starts in self.classes:
            least, most = self.threshold * self.n[begin] - 1e-9, asking.n[first] * self.threshold - 1e-9
            if asking.n[stop - 1] < least or self.n[end - 1] < most:
                continue
            at = np.minimum(np.searchsorted(known, rare), len(known) - 1)
            hit = known[at] == rare
            mine, at = owner[hit], at[hit]
            meets = starts[at + 1] - starts[at]
            total = np.cumsum(np.bincount(mine - first, meets, stop - first).astype(np.int64))
            spare, a = max(lost, lost_here), first
            enough = max(1, int(np.ceil(self._need(asking.n[first], self.n[begin]))) - spare)
            while a < stop:  # sets whose tokens meet MEETINGS holders, or one set
                before = total[a - first - 1] if a > first else 0
                b = max(a + 1, first + int(np.searchsorted(total, before + MEETINGS, side="right")))
                i, j = np.searchsorted(mine, [a, b])
                size = end - begin
                key = np.repeat(((mine[i:j] - a) * size).astype(np.uint32), meets[i:j])
                key += holders[_spans(starts[at[i:j]], meets[i:j])]
                key.sort()
                # runs of `enough` equal keys or more, by their last such place
                runs = np.flatnonzero(key[enough - 1:] == key[:len(key) - enough + 1])
                found, count = np.unique(key[runs], return_counts=True)
                x, y = found.astype(np.int64) // size + a, found.astype(np.int64) % size + begin
                kept = (count + enough - 1 + spare >= self._need(asking.n[x], self.n[y])) & (asking.sid[x] != self.sid[y])
                yield x[kept], y[kept]
                a = b

    def _best(self, asking: _Sets, x: np.ndarray, y: np.ndarray, top: int) -> pa.RecordBatch:
        """The quotes that suffice for each set, asking or shipped; what is of the block itself asks twice."""
        common, lengths = np.zeros(len(x), np.int64), np.diff(self.ends)[y]
        if len(x):
            width = int(max(asking.codes.max(), self.codes.max())) + 1
            own = np.repeat(np.arange(len(asking.n)), np.diff(asking.ends)) * width + asking.codes
            cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // MEETINGS, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(x)], strict=True):
                asked = np.repeat(x[a:b] * width, lengths[a:b]) + self.codes[_spans(self.ends[y[a:b]], lengths[a:b])]
                same = own[np.minimum(np.searchsorted(own, asked), len(own) - 1)] == asked
                common[a:b] = np.bincount(np.repeat(np.arange(b - a), lengths[a:b]), same, b - a)
        union = asking.n[x] + self.n[y] - common
        hit = common >= self.threshold * union
        x, y, overlap = x[hit], y[hit], np.round(common[hit] / union[hit], 6)
        both = ~asking.own[x]
        offers = pa.concat_arrays([self.offers.take(pa.array(y)), asking.offers.take(pa.array(x[both]))])
        sid, overlap = np.append(asking.sid[x], self.sid[y[both]]), np.append(overlap, overlap[both])
        held, flat = np.asarray(pc.list_value_length(offers)), offers.flatten()
        sid, overlap = np.repeat(sid, held), np.repeat(overlap, held)
        place, source = (np.asarray(flat.field(c)) for c in ("place", "source"))
        order = np.lexsort((place, -overlap, sid))
        sid, quotes = sid[order], list(zip((-overlap[order]).tolist(), place[order].tolist(), source[order].tolist(), strict=True))
        cuts = [*np.flatnonzero(np.append(True, sid[1:] != sid[:-1])[:len(sid)]).tolist(), len(sid)]
        rows = [(int(sid[a]), -o, p, s) for a, b in zip(cuts, cuts[1:], strict=False)
                for o, p, s in (quotes[a:b] if b - a <= top else sufficient(quotes[a:b], top))]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)],
            ["sid", "overlap", "place", "source"])


def interleave(candidates: DataFrame, order: Sequence[str]) -> DataFrame:
    """Round-robin over providers, the largest provider first in every round.

    The round is the candidate's rank inside its provider.
    """
    placed = ranked(candidates, ["provider"], order, "position")
    size = candidates.groupBy("provider").agg(F.count("*").alias("provider_size"))
    rows = placed.join(size, "provider")
    return rows.orderBy("position", F.desc("provider_size"), "provider")


#: Distinct token sets of a pass (what is shipped) and of a slice inside a task; sets of like sizes
#: that are shipped or ask together; meetings of tokens with holders that are counted at a time.
PASS_SETS, SHARD_SETS, CLASS_SETS, CLASS_ASKING, MEETINGS = 1 << 18, 1 << 13, 1 << 15, 1 << 9, 1 << 21


def _token_sets(candidates: DataFrame) -> DataFrame:
    """(id, path, tokens, sid) of the quotes that have tokens; each quote is cut once."""
    cut = stage(candidates.select("source_path", "line_start", "quote"), tokens=F.sort_array(tx.similarity_tokens(F.col("quote"))))
    return cut.filter(F.size("tokens") > 0).select(
        F.concat_ws("#", "source_path", F.format_string("%06d", F.col("line_start"))).alias("id"), F.col("source_path").alias("path"),
        "tokens", F.xxhash64(F.array_join("tokens", " ")).alias("sid"))


def related_sources(candidates: DataFrame, top: int = 2, threshold: float = 0.12) -> DataFrame:
    """Quotes of other sources with token Jaccard at or above the threshold, best first.

    Copies are compared once: quotes are reduced to distinct token sets, and a set offers
    the earliest quotes of its earliest sources, as many as can ever be an answer.  Tokens
    become numbers from rare to frequent; tokens of one set only just count in its size.  Sets
    meet in memory: tasks count common tokens against passes of shipped, inverted sets,
    touching only pairs that share a token, and two blocks meet once.  A set keeps the few best quotes that suffice
    whichever source asks, so neither candidate pairs nor tokens are shuffled.
    """
    spark = candidates.sparkSession
    # every later step starts here: texts are read and cut into tokens once
    keyed = stored(_token_sets(candidates), "quotes")
    # Whatever source is left out, the best `top` quotes of a set are among the first
    # `top` of its `top + 1` earliest sources.
    first = Window.partitionBy("sid", "path").orderBy("id")
    members = keyed.select("sid", "path", "id").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= top)
    early = Window.partitionBy("sid").orderBy("lead")
    lead = members.filter("r = 1").select("sid", "path", F.col("id").alias("lead")) \
        .withColumn("p", F.row_number().over(early)).filter(F.col("p") <= top + 1)
    # a quote is known by its place in the order of ids, a source by its first quote's place
    placed = ranked(members.join(lead.select("sid", "path"), ["sid", "path"]).select("sid", "path", "id"), [], ["id"], "place")
    placed = stored(placed, "quote-places")
    sources = placed.groupBy("path").agg(F.min("place").alias("source"))
    members = stored(placed.join(sources, "path"), "quote-members")
    offers = members.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("place", "source"))).alias("offers"))
    distinct = stored(keyed.groupBy("sid").agg(F.max("tokens").alias("tokens")), "token-sets")
    words = distinct.select("sid", F.explode("tokens").alias("token"))
    shared = ranked(words.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), [], ["n", "token"], "code")
    coded = words.join(shared.select("token", F.col("code").cast("int").alias("code")), "token") \
        .groupBy("sid").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    sets = stored(dealt(distinct.select("sid", F.size("tokens").cast("bigint").alias("n")).join(coded, "sid").join(offers, "sid"), "sid"), "quote-sets")
    found = "sid bigint, overlap double, place bigint, source bigint"
    parts = []
    blocks = hash_blocks(sets, "sid", PASS_SETS)
    number = F.pmod(F.xxhash64("sid"), F.lit(len(blocks)))
    for b, block in enumerate(blocks):  # sets of earlier blocks have met this one
        shipped = spark.sparkContext.broadcast(block.toArrow())  # PASS_SETS sets at most
        asking = sets.filter(number >= b).withColumn("own", number == b)
        parts.append(spread(asking).mapInArrow(_similar(shipped, top, threshold), found))
    same = members.select("sid", F.lit(1.0).alias("overlap"), "place", "source")
    # a source whose quotes are all later copies offers none, and still asks
    asking = keyed.select("sid", "path").filter("path IS NOT NULL").distinct() \
        .join(sources.withColumnRenamed("source", "own"), "path", "left")
    best = Window.partitionBy("sid", "path").orderBy(F.desc("overlap"), "place")
    answers = asking.join(functools.reduce(DataFrame.unionByName, parts, same), "sid") \
        .filter("own IS NULL OR own <> source").withColumn("rank", F.row_number().over(best)) \
        .filter(F.col("rank") <= top).select("sid", "path", "place", "overlap", "rank")
    named = members.select("place", F.col("id").alias("other"), F.col("path").alias("other_path"))
    return keyed.select("id", "sid", "path").join(answers.join(named, "place"), ["sid", "path"]) \
        .select("id", "other", "path", "other_path", "overlap", "rank")


def unique_questions(cases: DataFrame, order: str = "ord") -> DataFrame:
    """First case per whitespace-collapsed lowercase question."""
    key = F.lower(tx.collapse_ws(F.col("question")))
    rest = F.struct(*cases.columns)
    return cases.groupBy(key.alias("_k")).agg(F.min_by(rest, order).alias("c")).select("c.*")


def within_cap(cases: DataFrame, flag: Column, cap: int, order: Sequence[str]) -> DataFrame:
    """Keep unflagged cases and the first ``cap`` flagged ones in order."""
    flagged = cases.filter(flag).orderBy(*order).limit(cap)
    return cases.filter(~flag).unionByName(flagged)


def apply_quality_caps(cases: DataFrame, order: str = "ord", provider_list: int = 15,
                       hotline: int = 15, low_risk: int = 45) -> DataFrame:
    """Greedy acceptance under three interacting caps, in arrival order.

    A case that counts towards no cap is always accepted, so only the flagged
    cases meet the sequential rule; once every cap is full nothing further can
    be accepted, and the fold stops reading.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("question", F.lit("")),
                               F.coalesce("gold_answer", F.lit(""))))
    flags = cases.withColumn("_p", F.coalesce(F.col("task_type") == "provider_list", F.lit(False))) \
        .withColumn("_h", text.rlike(HOTLINE)) \
        .withColumn("_l", F.coalesce(F.col("risk_level") == "low", F.lit(False)))
    free = flags.filter("NOT (_p OR _h OR _l)").drop("_p", "_h", "_l")
    # Per combination of flags at most the largest cap can ever be accepted, so
    # that many leading cases of each of the seven combinations decide the result.
    most = max(provider_list, hotline, low_risk)
    combo = F.concat_ws("", F.col("_p").cast("int"), F.col("_h").cast("int"),
                        F.col("_l").cast("int"))
    lead = Window.partitionBy("_g").orderBy(order)
    short = flags.filter("_p OR _h OR _l").withColumn("_g", combo) \
        .withColumn("_n", F.row_number().over(lead)).filter(F.col("_n") <= most)
    caps = (provider_list, hotline, low_risk)

    def accept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        rows, used, keep = pd.concat(parts).sort_values(order), [0, 0, 0], []
        for row in rows[["_p", "_h", "_l"]].itertuples(index=False):
            ok = all(not f or u < c for f, u, c in zip(row, used, caps))
            keep.append(ok)
            used = [u + (ok and f) for u, f in zip(used, row)]
        yield rows[keep].drop(columns=["_p", "_h", "_l", "_g", "_n"])
    # At most seven combinations times the largest cap: a bounded single task.
    accepted = short.repartition(1).mapInPandas(accept, cases.schema)
    return free.unionByName(accepted)


def renumber(cases: DataFrame, prefix: str = "case_") -> DataFrame:
    """Contiguous ids in case-type order, then id."""
    position = F.coalesce(F.element_at(F.create_map(*[
        F.lit(x) for kv in zip(CONTEXTS, range(len(CONTEXTS))) for x in kv]),
        F.col("case_type")), F.lit(999))
    placed = ranked(cases.withColumn("_t", position), [], ["_t", "id"], "_n")
    return placed.withColumn("new_id", F.format_string("%s%05d", F.lit(prefix), F.col("_n") + 1)) \
        .drop("_t", "_n")


def context_candidates(blocks: DataFrame, distribution: dict[str, int], seed: int = 42
                       ) -> DataFrame:
    """Seeded case candidates: windows of adjacent blocks of one source, or table blocks.

    A start block is drawn by hash order, so a draw is reproducible and needs no
    driver-side sampling; each case type is one top-n.
    """
    unknown = [t for t in distribution if t not in CONTEXTS]
    if unknown:
        raise ValueError(f"Unsupported case type: {unknown[0]}")
    out = None
    text_blocks = blocks.filter(~F.col("contains_table"))
    size = text_blocks.groupBy("doc_id").agg(F.max("chunk_index").alias("last"),
                                             F.count("*").alias("n"))
    for case_type, count in distribution.items():
        if count < 0:
            raise ValueError(f"Negative count for {case_type}.")
        span = CONTEXTS[case_type]
        if case_type == "table_context":
            pool = blocks.filter("contains_table")
        else:
            pool = text_blocks.join(size, "doc_id").filter(
                F.col("chunk_index") + span - 1 <= F.col("last"))
        draw = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), F.lit(str(seed)), F.lit(case_type)))
        chosen = pool.select("doc_id", "chunk_index", draw.alias("draw")).orderBy(
            "draw", "doc_id", "chunk_index").limit(count)
        one = chosen.select(F.lit(case_type).alias("case_type"), "doc_id",
                            F.col("chunk_index").alias("first_block"),
                            (F.col("chunk_index") + span - 1).alias("last_block"))
        out = one if out is None else out.unionByName(one)
    return out


def group_evidence(matches: DataFrame) -> DataFrame:
    """Quotes grouped per case and block: line span, first quote, primary or supporting."""
    grouped = matches.groupBy("case_id", "chunk_id").agg(
        F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"),
        F.min_by("evidence_quote", "ord").alias("evidence_quote"),
        F.count("*").alias("quote_count"), F.min("ord").alias("ord"))
    first = grouped.groupBy("case_id").agg(F.min("ord").alias("first_ord"))
    return grouped.join(first, "case_id").withColumn("relationship", F.when(
        F.col("ord") == F.col("first_ord"), "primary").otherwise("supporting_context")) \
        .drop("first_ord")


def verify_quotes(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """Case sources whose line does not exist or differs from the quote.

    Only the lines asked for are exploded from their documents.
    """
    numbered = docs.select("source_path", F.posexplode(lines(F.col("text"))).alias("i", "line")) \
        .select("source_path", (F.col("i") + 1).alias("line_start"),
                tx.strip(F.col("line")).alias("line"))
    joined = sources.join(numbered, ["source_path", "line_start"], "left")
    error = ps.first_match([(F.col("line").isNull(), "line_out_of_range"),
                            (F.col("line") != tx.strip(F.col("evidence_quote")),
                             "quote_mismatch")])
    return joined.select("case_id", "source_path", "line_start", error.alias("error")) \
        .filter("error IS NOT NULL")


def stride_sample(candidates: DataFrame, per_doc: int, total: int, group: str = "doc_id",
                  order: str = "span_index") -> DataFrame:
    """Evenly spaced candidates per document, filled up in order to ``total``.

    A document's candidates are numbered by their own index column.
    """
    size = candidates.groupBy(group).agg(F.count("*").alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / per_doc))
    rows = candidates.join(size, group).withColumn("step", step)
    picked = (F.col(order) % F.col("step") == 0) & (F.col(order) / F.col("step") < per_doc)
    flagged = rows.withColumn("pick", F.when(picked, 0).otherwise(1))
    return flagged.orderBy("pick", group, order).limit(total).drop("n", "step", "pick")


def case_type_counts(cases: DataFrame) -> DataFrame:
    """(position, case_type, cases): configured types first, in their order, then the
    others; types that do not occur are left out."""
    place = F.coalesce(F.element_at(F.create_map(*[
        F.lit(x) for kv in zip(CONTEXTS, range(len(CONTEXTS))) for x in kv]),
        F.col("case_type")), F.lit(len(CONTEXTS)))
    return cases.select(F.coalesce("case_type", F.lit("")).alias("case_type")) \
        .groupBy("case_type").agg(F.count("*").alias("cases")) \
        .select(place.alias("position"), "case_type", "cases")


def sampled_chunks(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct chunks that cases ask for (``required_chunk_ids``), with the first case's order."""
    asked = cases.select("ord", F.posexplode("required_chunk_ids").alias("i", "chunk_id"))
    first = asked.groupBy("chunk_id").agg(F.min(F.struct("ord", "i")).alias("first_asked"))
    return chunks.join(first, "chunk_id").select(*chunks.columns, F.col("first_asked.ord").alias("first_ord"))


def evidence_items(value: Column) -> Column:
    """array<struct<chunk_id, quote>> from a JSON list of quote texts or of objects.

    An object's quote may be named ``quote`` or ``evidence_quote``; items without a quote
    drop out; a value that is no list has no items.
    """
    texts = F.from_json(value, "array<string>")

    def item(t: Column) -> Column:
        parsed = F.from_json(t, "chunk_id STRING, quote STRING, evidence_quote STRING")
        given = F.when(F.coalesce(parsed["quote"], F.lit("")) != "", parsed["quote"]).otherwise(
            parsed["evidence_quote"])
        is_object = t.startswith("{")
        return F.struct(
            F.when(is_object, tx.strip(F.coalesce(parsed["chunk_id"], F.lit("")))).otherwise("")
            .alias("chunk_id"),
            F.when(is_object, tx.strip(F.coalesce(given, F.lit("")))).otherwise(t).alias("quote"))
    items = F.transform(F.when(value.startswith("["), texts), item)
    return F.coalesce(F.filter(items, lambda i: i["quote"] != ""),
                      F.array().cast("array<struct<chunk_id:string,quote:string>>"))


def verify_cases(cases: DataFrame, docs: DataFrame) -> DataFrame:
    """(case_id, error): everything that keeps a case from being accepted.

    ``cases``: case_id, question, gold_answer, context_count, required_chunk_ids, needs_table,
    sources array<struct<chunk_id, source_path, contains_table, evidence_quote, line_start,
    line_end>>.  Only the lines that quotes point to are taken from the documents.
    """
    size = F.size(F.coalesce("sources", F.array().cast(cases.schema["sources"].dataType)))
    ids = F.filter(F.transform("sources", lambda s: s["chunk_id"]), lambda c: c != "")
    asked = F.array_distinct("required_chunk_ids")
    own = F.array_compact(F.array(
        F.when(tx.strip(F.coalesce("question", F.lit(""))) == "", "empty_question"),
        F.when(tx.strip(F.coalesce("gold_answer", F.lit(""))) == "", "empty_gold_answer"),
        F.when(size <= 0, "missing_sources"),
        F.when((size > 0) & (size != F.col("context_count")), "context_count"),
        F.when((size > 0) & (F.size(asked) > 0) & (F.array_sort(F.array_distinct(ids)) != F.array_sort(asked)),
               "chunk_ids"),
        F.when((size > 0) & F.col("needs_table") & ~F.exists("sources", lambda s: F.coalesce(
            s["contains_table"], F.lit(False))), "no_table_source")))
    general = cases.select("case_id", F.explode(own).alias("error"))
    counts = docs.select("source_path", F.size(lines(F.col("text"))).alias("n"))
    placed = cases.select("case_id", F.posexplode("sources").alias("i", "s")).select(
        "case_id", "i", "s.source_path", "s.line_start", "s.line_end",
        tx.collapse_ws(F.coalesce("s.evidence_quote", F.lit(""))).alias("quote")) \
        .join(counts, "source_path", "left")
    no_path = F.coalesce("source_path", F.lit("")) == ""
    valid = (F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start")) \
        & (F.col("line_end") <= F.col("n"))
    checked = placed.withColumn("error", ps.first_match([
        (no_path, "missing_source_path"), (F.col("n").isNull(), "unknown_source_path"),
        (F.col("quote") == "", "empty_quote"),
        (~F.coalesce(valid, F.lit(False)), "invalid_line_range")]))
    wanted = checked.filter("error IS NULL").select(
        "case_id", "i", "quote", "source_path",
        F.explode(F.sequence("line_start", "line_end")).alias("line_no"))
    numbered = docs.select("source_path", F.posexplode(lines(F.col("text"))).alias("p", "line")) \
        .select("source_path", (F.col("p") + 1).alias("line_no"), "line")
    spans = wanted.join(numbered, ["source_path", "line_no"]).groupBy("case_id", "i", "quote").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    span = tx.collapse_ws(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    lost = spans.filter(~span.contains(F.col("quote"))).select(
        "case_id", F.lit("quote_not_found").alias("error"))
    return general.unionByName(checked.filter("error IS NOT NULL").select("case_id", "error")) \
        .unionByName(lost)


def distribution_errors(cases: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(case_type, expected, found) of every type whose count differs from the plan."""
    spark = cases.sparkSession
    plan = spark.createDataFrame(list(expected.items()), "case_type STRING, expected BIGINT")
    found = case_type_counts(cases).select("case_type", F.col("cases").alias("found"))
    both = plan.join(found, "case_type", "full").select(
        "case_type", F.coalesce("expected", F.lit(0)).alias("expected"),
        F.coalesce("found", F.lit(0)).alias("found"))
    return both.filter("expected <> found")
