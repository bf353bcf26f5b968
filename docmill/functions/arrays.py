"""Column helpers for row-local work on arrays (no explode, no shuffle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line breaks as a text editor sees them, CR LF counting once.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\u0085  ]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once, so ``body`` may use it often without recomputing it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A one-row generator separates them from later projections.  Without it the
    optimizer may inline an array expression into the lambda that reads it (one
    evaluation per element), and an Arrow UDF cannot take nested lambdas.
    """
    values = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(values)))


def let_all(values: list[Column], body: Callable[..., Column]) -> Column:
    """Bind several values once.

    A projected column that a lambda captures may be inlined into the lambda by
    the optimizer and evaluated once per element; binding it here prevents that.
    """
    names = [f"v{i}" for i in range(len(values))]
    packed = F.struct(*[v.alias(n) for v, n in zip(values, names)])
    return let(packed, lambda s: body(*[s[n] for n in names]))


def lines(text: Column) -> Column:
    """Split into lines; a final line break opens no empty line."""
    parts = F.split(text, LINE_BREAK, -1)
    return let(parts, lambda p: F.when(
        F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def indices(array: Column) -> Column:
    """0..n-1, and an empty array for an empty input."""
    none = F.array().cast("array<int>")
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(none)


def islands(items: Column, same: Callable[[Column, Column], Column]) -> Column:
    """[first, last] index pairs of maximal runs whose neighbours are ``same``."""
    def runs(xs: Column) -> Column:
        starts = F.filter(indices(xs), lambda i: (i == 0) | ~same(xs[i - 1], xs[i]))
        return let(starts, lambda s: F.transform(s, lambda first, k: F.struct(
            first.alias("first"),
            (F.coalesce(F.get(s, k + 1), F.size(xs)) - 1).alias("last"))))
    return let(items, runs)


def piece(items: Column, first: Column, last: Column, glue: str = "\n") -> Column:
    """Items first..last (0-based, inclusive) joined back to text."""
    return F.array_join(F.slice(items, first + 1, last - first + 1), glue)


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two distinct-item arrays; 0 when either is empty."""
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right)))


def running_total(values: Column, block: int = 128) -> Column:
    """Exclusive prefix sums of an int array.

    Two levels (inside blocks, then over block totals) keep a long array cheap
    where a naive fold would copy its accumulator once per element.
    """
    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)

    def over(vs: Column) -> Column:
        count = F.ceil(F.size(vs) / block).cast("int")
        blocks = F.transform(
            F.when(count > 0, F.sequence(F.lit(0), count - 1))
            .otherwise(F.array().cast("array<int>")),
            lambda b: F.slice(vs, b * block + 1, F.lit(block)))
        return let(blocks, lambda bs: let(F.transform(bs, total), lambda sums: F.flatten(
            F.transform(bs, lambda blk, b: let(total(F.slice(sums, F.lit(1), b)), lambda base:
                        F.transform(blk, lambda _, i: base + total(F.slice(blk, F.lit(1), i))))))))
    return let(values, over)


def pieces_at(text: Column, boundary: str) -> Column:
    """Cut before every match of a zero-width or opening pattern; text is kept whole."""
    return F.split(text, f"(?md)(?=^{boundary})", -1)


# Noncharacters: they never occur in interchanged text, so they can mark cuts.
CUT, END = "﷐", "﷑"


def delimited(text: Column, separator: str) -> Column:
    """array<struct<start, end, text>> of the stretches between separators.

    Blank stretches are dropped; offsets count characters of the source.
    """
    marked = F.split(F.regexp_replace(text, f"({separator})", f"{CUT}$1{END}"), CUT, -1)
    both = F.transform(marked, lambda m, i: F.when(i == 0, F.struct(
        F.lit("").alias("sep"), m.alias("body"))).otherwise(F.struct(
            F.substring_index(m, END, 1).alias("sep"),
            F.substring(m, F.locate(END, m) + 1, F.length(m)).alias("body"))))

    def spans(bs: Column) -> Column:
        widths = F.transform(bs, lambda b: F.length(b["sep"]) + F.length(b["body"]))
        return let(running_total(widths), lambda at: F.transform(bs, lambda b, i: F.struct(
            (F.get(at, i) + F.length(b["sep"])).alias("start"),
            (F.get(at, i) + F.length(b["sep"]) + F.length(b["body"])).alias("end"),
            b["body"].alias("text"))))
    return F.filter(let(both, spans), lambda s: ~s["text"].rlike(r"^\s*$"))


def pack_texts(items: Column, limit: int, glue: str = "\n\n") -> Column:
    """Greedy packing: start a new text when adding the next would pass ``limit``."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc: Column, item: Column) -> Column:
        joined = F.when(acc["buf"] == "", item).otherwise(
            F.concat(acc["buf"], F.lit(glue), item))
        full = (acc["buf"] != "") & (F.length(joined) > limit)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"])
            .alias("done"),
            F.when(full, item).otherwise(joined).alias("buf"))
    return F.aggregate(items, start, step, lambda acc: F.when(
        acc["buf"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["buf"]))))
