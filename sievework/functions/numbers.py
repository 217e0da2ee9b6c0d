"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn every NaN into NULL so that "missing" has a single meaning."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floating:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating})


def nonnull_count(*columns: str | Column) -> Column:
    """How many of ``columns`` are present in the row."""
    total = F.lit(0)
    for column in columns:
        column = F.col(column) if isinstance(column, str) else column
        total = total + column.isNotNull().cast("int")
    return total


def seeded_hash(seed: int, *columns: str | Column) -> Column:
    """A repeatable pseudo-random 64-bit number for a row, from its key columns.

    It depends on values only, never on partitions or task retries.
    """
    return F.xxhash64(F.lit(seed), *columns)


def portable_hash(seed: int, *columns: str | Column) -> Column:
    """Like ``seeded_hash``, but slower and the same in every engine that has MD5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def bin_index(column: str | Column, cuts: list) -> Column:
    """Zero-based bin of a value among ascending inner boundaries (``lo <= x < hi``).

    The boundaries ascend, so the bin is the number of boundaries not above
    the value; NULL and NaN have no bin.
    """
    column = F.col(column) if isinstance(column, str) else column
    index = F.lit(0)
    for cut in cuts:
        index = index + (column >= cut).cast("int")
    return F.when(column != F.lit(float("nan")), index)


def repair_short_year(column: str | Column, last: int = 24) -> Column:
    """Years written as 1..``last`` stand for 2001..2000+``last``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column.isin(list(range(1, last + 1))), column + 2000).otherwise(column)
