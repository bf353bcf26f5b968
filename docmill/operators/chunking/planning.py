"""Boundary planning over source units: valid cut bands, best path, repairs.

The best path is a dynamic program over one document's units, so that step is
a short Arrow UDF; units, cuts, checks and repairs are SQL expressions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.arrays import delimited, let, stage
from docmill.functions.rows import each_row
from docmill.functions.text import strip
from docmill.operators.chunking import splitters as sp

PLAN = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()),
                                 T.StructField("last", T.IntegerType()),
                                 T.StructField("reason", T.StringType())]))


def unit_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")


def stage_units(docs: DataFrame, max_unit_tokens: int = 180) -> DataFrame:
    """Add ``_units``: paragraphs (oversized ones split) with kind and heading path."""
    staged = stage(docs, _p=delimited(F.col("text"), r"\n\s*\n"))
    staged = stage(staged, _to_split=F.transform("_p", lambda p: strip(p["text"])))
    staged = staged.withColumn("_parts", sp.recursive_split_each(
        F.col("_to_split"), max_unit_tokens * 4, 0, sp.UNITS))
    staged = stage(staged, _flat=F.flatten("_parts"))
    staged = staged.withColumn("_at", sp.locate_parts(F.col("text"), F.col("_flat"), False))

    def kind(t: Column) -> Column:
        return (F.when(t.rlike(r"^#{1,6}\s+"), "heading")
                .when(t.contains("|") & t.contains("\n"), "table")
                .when(t.rlike(r"^(?:[-*+]|\d+[.)])\s+"), "list").otherwise("paragraph"))
    units = F.zip_with("_flat", "_at", lambda t, s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), t.alias("text"),
        unit_tokens(t).alias("tokens"), kind(t).alias("kind"),
        F.length(F.regexp_extract(t, r"^(#{1,6})\s+\S[^\n]*$", 1)).alias("level"),
        strip(F.regexp_extract(t, r"^#{1,6}\s+([^\n]+)$", 1)).alias("title")))
    staged = stage(staged, _u=units)
    stack = "array<struct<level:int,title:string>>"
    start = F.struct(F.array().cast(stack).alias("stack"),
                     F.array().cast("array<string>").alias("paths"))

    def step(acc: Column, u: Column) -> Column:
        grown = F.when(u["level"] == 0, acc["stack"]).otherwise(F.concat(
            F.filter(acc["stack"], lambda h: h["level"] < u["level"]),
            F.array(F.struct(u["level"].alias("level"), u["title"].alias("title")))))
        return let(grown.cast(stack), lambda st: F.struct(st.alias("stack"), F.concat(
            acc["paths"], F.array(F.when(F.size(st) == 0, "document").otherwise(
                F.array_join(F.transform(st, lambda h: h["title"]), " > ")))).alias("paths")))
    staged = stage(staged, _paths=F.aggregate("_u", start, step, lambda acc: acc["paths"]))
    return staged.drop("_p", "_to_split", "_parts", "_flat", "_at")


def source_units(docs: DataFrame, max_unit_tokens: int = 180) -> DataFrame:
    """One row per unit."""
    staged = stage_units(docs, max_unit_tokens)
    rows = staged.select("doc_id", F.posexplode(F.arrays_zip("_u", "_paths")).alias("unit", "c"))
    return rows.select("doc_id", "unit", F.col("c._u.kind").alias("unit_type"),
                       F.col("c._u.tokens").alias("tokens"), F.col("c._u.start").alias("start"),
                       F.col("c._u.end").alias("end"), F.col("c._paths").alias("heading_path"),
                       F.col("c._u.text").alias("text"))


def size_cost(tokens: int, low: int, target: int, preferred: int, high: int) -> float:
    """Distance of a chunk size from the preferred band; outside the limits it is steep."""
    if tokens < low or tokens > high:
        return 20.0 * max(low - tokens, tokens - high)
    return max(target - tokens, tokens - preferred, 0) / 20


def best_plan(tokens: list[int], asked: dict[int, int], low: int, target: int, preferred: int,
              high: int) -> list[tuple[int, int, str]]:
    """Cheapest cover of all units by valid cuts, solved from the last unit backwards."""
    total = [0, *accumulate(tokens)]
    n = len(tokens)
    cost, choice = [0.0] * (n + 1), [(0, "")] * n
    for first in range(n - 1, -1, -1):
        upto = max(first + 1, bisect_right(total, total[first] + high) - 1)
        since = max(first + 1, bisect_left(total, total[first] + low))
        ends = range(since, upto + 1) if since <= upto else range(upto, upto + 1)
        want, best = asked.get(first), None
        for stop in ends:
            near = 0.0 if want is None else (
                -0.5 if want == stop - 1 else min(abs(stop - 1 - want), 20) * 0.25)
            value = (size_cost(total[stop] - total[first], low, target, preferred, high)
                     + near + cost[stop] + 0.01)
            if best is None or value < best:
                best = value
                why = ("filled_missing_boundary_from_valid_band" if want is None else
                       "llm boundary inside valid band" if want == stop - 1 else
                       "optimized_to_valid_band")
                choice[first] = (stop, why)
        cost[first] = best
    plan, at = [], 0
    while at < n:
        stop, why = choice[at]
        plan.append((at, stop - 1, why))
        at = stop
    return plan


def plan_boundaries(tokens: Column, asked: Column | None = None, low: int = 80,
                    target: int = 220, preferred: int = 320, high: int = 420) -> Column:
    """array<struct<first,last,reason>> over the units of one document.

    ``asked`` is an optional map from a unit to the last unit a model wanted
    its chunk to reach.
    """
    def solve(ts: list, w: list | None) -> list[dict]:
        return [dict(zip(("first", "last", "reason"), row)) for row in best_plan(
            [int(t) for t in ts], {int(k): int(v) for k, v in dict(w or {}).items()},
            low, target, preferred, high)]
    wishes = F.create_map().cast("map<int,int>") if asked is None else asked
    return each_row(solve, PLAN)(tokens, wishes)


def middle_plan(tokens: Column, low: int, target: int, preferred: int, high: int) -> Column:
    """Deterministic plan: from each start take the middle preferred (else valid) cut."""
    def walk(ts: list) -> list[dict]:
        total, out, at = [0, *accumulate(int(t) for t in ts)], [], 0
        while at < len(ts):
            upto = max(at + 1, bisect_right(total, total[at] + high) - 1)

            def band(a: int, b: int) -> list[int]:
                return [e for e in range(at + 1, upto + 1) if a <= total[e] - total[at] <= b]
            ends = band(target, preferred) or band(low, high) or [upto]
            stop = ends[len(ends) // 2]
            out.append({"first": at, "last": stop - 1, "reason": "middle preferred cut"})
            at = stop
        return out
    return each_row(walk, PLAN)(tokens)


def boundary_chunks(docs: DataFrame, low: int = 80, target: int = 220, preferred: int = 320,
                    high: int = 420, repair: bool = True) -> DataFrame:
    """Chunks of the best plan with issue flags; short chunks join the next if they fit."""
    staged = stage_units(docs)
    staged = stage(staged, _sizes=F.transform("_u", lambda u: u["tokens"]))
    staged = staged.withColumn("_plan", plan_boundaries(F.col("_sizes"), None, low, target,
                                                        preferred, high))

    def view(first: Column, last: Column, issues: Column) -> Column:
        a, b = F.get("_u", first)["start"], F.get("_u", last)["end"]
        return let(strip(F.substring("text", a + 1, b - a)), lambda t: F.struct(
            first.alias("first"), last.alias("last"), a.alias("start"), b.alias("end"),
            unit_tokens(t).alias("tokens"), issues.alias("issues"), t.alias("text")))

    def flags(first: Column, last: Column) -> Column:
        a, b = F.get("_u", first)["start"], F.get("_u", last)["end"]
        size = unit_tokens(strip(F.substring("text", a + 1, b - a)))
        return F.array_compact(F.array(
            F.when((size < low) & (last < F.size("_u") - 1), "below_min_tokens"),
            F.when(size > preferred, "above_preferred_max"),
            F.when(size > high, "above_hard_max")))
    staged = stage(staged, _views=F.transform("_plan", lambda r: view(
        r["first"], r["last"], flags(r["first"], r["last"]))))
    if repair:
        start = F.struct(F.array().cast(
            "array<struct<first:int,last:int,issues:array<string>>>").alias("out"),
            F.lit(-1).alias("skip"))

        def step(acc: Column, i: Column) -> Column:
            cur, nxt = F.get("_views", i), F.get("_views", i + 1)
            size = F.ceil(F.length(strip(F.substring(
                "text", cur["start"] + 1, nxt["end"] - cur["start"]))) / 4)
            joins = (nxt.isNotNull() & (cur["tokens"] < low) & (size <= high))
            one = F.when(joins, F.struct(
                cur["first"].alias("first"), nxt["last"].alias("last"),
                F.array_sort(F.array_distinct(F.concat(
                    cur["issues"], nxt["issues"], F.array(F.lit("merged_below_min_with_next")))))
                .alias("issues"))).otherwise(F.struct(
                    cur["first"].alias("first"), cur["last"].alias("last"),
                    cur["issues"].alias("issues")))
            return F.when(acc["skip"] == i, acc).otherwise(F.struct(
                F.concat(acc["out"], F.array(one)).alias("out"),
                F.when(joins, i + 1).otherwise(F.lit(-1)).alias("skip")))
        order = F.when(F.size("_views") > 0, F.sequence(F.lit(0), F.size("_views") - 1)) \
            .otherwise(F.array().cast("array<int>"))
        staged = stage(staged, _fixed=F.aggregate(order, start, step, lambda acc: acc["out"]))
        staged = stage(staged, _views=F.transform("_fixed", lambda r: view(
            r["first"], r["last"], r["issues"])))
    rows = staged.select("doc_id", F.posexplode("_views").alias("chunk_index", "v"))
    return rows.select("doc_id", "chunk_index", "v.*")
