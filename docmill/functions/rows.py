"""Python functions of one row's values as Arrow UDFs of bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that are Python objects at one time.
SLICE_ROWS = 64


def each_row(function: Callable, returns: T.DataType) -> Callable[..., Column]:
    """Column function of ``function``; a row whose first value is NULL gives NULL.

    A task holds one Arrow batch (Spark bounds its bytes) and the objects of a slice of it;
    results leave the task slice by slice, so its memory does not follow the table.
    """
    @F.arrow_udf(returns)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kind = to_arrow_type(returns)
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            for at in range(0, len(columns[0]), SLICE_ROWS):
                values = zip(*(c.slice(at, SLICE_ROWS).to_pylist() for c in columns), strict=True)
                yield pa.array([None if v[0] is None else function(*v) for v in values], kind)
    return run


def each_text(function: Callable[[str], str]) -> Callable[[Column], Column]:
    """Column function of ``function`` on strings; several in one plan share a Python worker."""
    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([None if t is None else function(t) for t in texts.slice(at, SLICE_ROWS).to_pylist()], pa.string())
                                 for at in range(0, max(len(texts), 1), SLICE_ROWS)])
    return run
