"""Token arrays with exact positions.

A text is cut into consecutive tokens by one pattern that covers every character, so the position of a
token is the sum of the lengths before it. The cutting is a built-in expression; only the running sum of
the (small, integer) lengths goes through Arrow, because a JVM fold would copy the array once per token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from ..functions.text import extract_all, line_breaks
from ..session import evaluate_once


@arrow_udf(T.ArrayType(T.IntegerType()))
def _sums_before(lengths: pa.Array) -> pa.Array:
    """Of every list the sums of what stands before each element, over a whole batch at a time."""
    count = lengths.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
    sums = np.concatenate(([0], np.cumsum(lengths.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)))
    before = (sums[:-1] - np.repeat(sums[ends[:-1]], count)).astype(np.int32)
    mask = lengths.is_null() if lengths.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(before, pa.int32()), mask=mask)


def utf16_extra(c: Column) -> Column:
    """Characters outside the basic plane: each counts twice in UTF-16 offsets."""
    return F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def with_tokens(df: DataFrame, keep: list[str], content: Column, pattern: str) -> DataFrame:
    """Adds ``tok``, ``tok_start`` (0-based code points) and ``tok_line`` (0-based line breaks before)."""
    df = evaluate_once(df, keep, tok=extract_all(content, pattern))
    return df.select(
        *keep, "tok",
        _sums_before(F.transform("tok", F.length)).alias("tok_start"),
        _sums_before(F.transform("tok", line_breaks)).alias("tok_line"),
    )


def explode_tokens(df: DataFrame, keep: list[str], **arrays: str) -> DataFrame:
    """One row per token with its neighbours, and its element of each further array column; no shuffle, tokens never leave
    the row's task."""
    cell = F.transform(
        "tok",
        lambda t, i: F.struct(
            i.alias("ord"),
            t.alias("token"),
            F.coalesce(F.get("tok", i - 1), F.lit("")).alias("before"),
            F.coalesce(F.get("tok", i + 1), F.lit("")).alias("after"),
            F.get("tok_start", i).alias("span_start"),
            (F.get("tok_line", i) + 1).alias("line"),
            *[F.get(column, i).alias(name) for name, column in arrays.items()],
        ),
    )
    return df.select(*keep, F.inline(cell))
