"""Recursive and single-separator character splitting.

The separator recursion has no Spark expression, so the cut positions come
from a short Arrow UDF; everything around it stays in SQL expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.arrays import LINE_BREAK
from docmill.functions.rows import each_row

# Separator ladders, coarse to fine.
DEFAULT = ("\n\n", "\n", " ", "")
PROSE = ("\n\n", "\n", ". ", " ", "")
FINE = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")
UNITS = ("\n\n", "\n", ". ", "; ", ", ", " ", "")
DOTTED = ("\n\n", "\n", ".", " ", "")
PYTHON = ("\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", "")
CODE = ("\nclass ", "\ndef ", "\n\n", "\n", " ", "")

PART = T.StructType([T.StructField("text", T.StringType()),
                     T.StructField("start", T.IntegerType()),
                     T.StructField("end", T.IntegerType())])


def pack(lengths: Sequence[int], size: int, overlap: int, glue: int = 0) -> list[tuple[int, int]]:
    """Greedy windows [i, j) over pieces; each keeps up to ``overlap`` of the last."""
    windows, first, total = [], 0, 0
    for i, n in enumerate(lengths):
        if first < i and total + glue + n > size:
            windows.append((first, i))
            while first < i and (total > overlap or total + glue + n > size):
                total -= lengths[first] + (glue if i - first > 1 else 0)
                first += 1
        total += n + (glue if first < i else 0)
    if first < len(lengths):
        windows.append((first, len(lengths)))
    return windows


def cut(text: str, start: int, end: int, separator: str) -> list[tuple[int, int]]:
    """Pieces of text[start:end]; each later piece begins with its separator."""
    if not separator:
        return [(i, i + 1) for i in range(start, end)]
    marks = [start, *(m.start() for m in re.compile(re.escape(separator)).finditer(
        text, start, end)), end]
    return [(a, b) for a, b in zip(marks, marks[1:]) if a < b]


def recursive_spans(text: str, size: int, overlap: int, separators: Sequence[str],
                    start: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """Trimmed chunk spans: the coarsest separator present cuts first."""
    end = len(text) if end is None else end
    level = next((i for i, s in enumerate(separators) if not s or text.find(s, start, end) >= 0),
                 len(separators) - 1)
    finer = separators[level + 1:]
    run: list[tuple[int, int]] = []

    def flush() -> Iterator[tuple[int, int]]:
        for i, j in pack([b - a for a, b in run], size, overlap):
            yield from trimmed(text, run[i][0], run[j - 1][1])
        run.clear()

    for a, b in cut(text, start, end, separators[level]):
        if b - a < size:
            run.append((a, b))
            continue
        yield from flush()
        if finer:
            yield from recursive_spans(text, size, overlap, finer, a, b)
        else:
            yield a, b
    yield from flush()


def trimmed(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    if start < end:
        yield start, end


def recursive_split(text: Column, size: int, overlap: int = 0,
                    separators: Sequence[str] = DEFAULT) -> Column:
    """array<struct<text,start,end>> of one text."""
    separators = tuple(separators)

    def split(t: str) -> list[dict]:
        return [{"text": t[a:b], "start": a, "end": b}
                for a, b in recursive_spans(t, size, overlap, separators)]
    return each_row(split, T.ArrayType(PART))(text)


def recursive_split_each(texts: Column, size: int, overlap: int = 0,
                         separators: Sequence[str] = DEFAULT) -> Column:
    """array<array<string>>: the parts of every text; NULL texts give NULL."""
    separators = tuple(separators)

    def split(ts: list) -> list:
        return [None if t is None else
                [t[a:b] for a, b in recursive_spans(t, size, overlap, separators)] for t in ts]
    return each_row(split, T.ArrayType(T.ArrayType(T.StringType())))(texts)


def character_split(text: Column, size: int, overlap: int = 0,
                    separator: str = "\n\n") -> Column:
    """array<string>: split on one separator and regroup up to ``size``."""
    def split(t: str) -> list[str]:
        parts = [p for p in t.split(separator) if p]
        joined = (separator.join(parts[i:j]).strip() for i, j in pack(
            [len(p) for p in parts], size, overlap, len(separator)))
        return [c for c in joined if c]
    return each_row(split, T.ArrayType(T.StringType()))(text)


SPAN = T.StructType([T.StructField("start", T.IntegerType()),
                     T.StructField("end", T.IntegerType()),
                     T.StructField("start_line", T.IntegerType()),
                     T.StructField("end_line", T.IntegerType()),
                     T.StructField("offset_match", T.BooleanType())])


def _span_rows(text: str, spans: list[tuple[int, int, bool]]) -> list[dict]:
    """Spans with 1-based line numbers, looked up in the line-start offsets."""
    opens = [m.end() for m in re.finditer(LINE_BREAK, text)]
    return [{"start": a, "end": b, "offset_match": ok,
             "start_line": 1 + bisect_right(opens, a),
             "end_line": 1 + bisect_right(opens, max(a, b - 1))} for a, b, ok in spans]


def locate_parts(text: Column, parts: Column, backward: bool = True) -> Column:
    """Source spans of ordered parts.

    A part is searched a little before the previous end, then anywhere; a part
    that is not found keeps the cursor and says so in ``offset_match``.
    """
    def locate(ps: list[str], t: str) -> list[dict]:
        spans, cursor = [], 0
        for p in ps:
            floor = max(0, cursor - max(2000, 2 * len(p))) if backward else cursor
            hits = ((t.find(c, floor), len(c)) if t.find(c, floor) >= 0 or not backward
                    else (t.find(c), len(c)) for c in (p, p.strip()) if c)
            at, n = next(((i, n) for i, n in hits if i >= 0), (-1, 0))
            span = (at, at + n, True) if at >= 0 else (
                cursor, min(len(t), cursor + len(p)), False)
            cursor = max(cursor, span[1])
            spans.append(span)
        return _span_rows(t, spans)
    return each_row(locate, T.ArrayType(SPAN))(parts, text)


def locate_by_anchor(text: Column, parts: Column) -> Column:
    """Source spans of parts that may carry added context.

    Exact match after the cursor, exact match anywhere, else from the first to
    the last long line that occurs in the source, else the cursor.
    """
    ruler = re.compile(r"\|?\s*:?-{2,}:?.*")

    def find(t: str, needle: str, floor: int) -> int:
        at = t.find(needle, floor)
        return at if at >= 0 else t.find(needle)

    def locate(ps: list[str], t: str) -> list[dict]:
        spans, cursor = [], 0
        for p in ps:
            at = find(t, p, cursor)
            span = (at, at + len(p), True)
            if at < 0:
                anchors = [s for s in map(str.strip, p.splitlines())
                           if len(s) >= 24 and not ruler.fullmatch(s)]
                lead = next((s for s in anchors if t.find(s, cursor) >= 0), None) or next(
                    (s for s in anchors if s in t), None)
                span = (cursor, min(len(t), cursor + len(p)), False)
                if lead:
                    at = find(t, lead, cursor)
                    tail = next((t.find(s, at) + len(s) for s in reversed(anchors)
                                 if t.find(s, at) >= 0), 0)
                    span = (at, min(len(t), max(at + len(lead), tail)), False)
            cursor = max(cursor, span[0] + 1)
            spans.append(span)
        return _span_rows(t, spans)
    return each_row(locate, T.ArrayType(SPAN))(parts, text)
