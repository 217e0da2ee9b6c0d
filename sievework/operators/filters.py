"""Row filters and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.text import is_ascii
from sievework.operators.order_stats import quantile


def equals(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose value equals ``value``; a missing value does not."""
    return df.where(F.col(column) == F.lit(value))


def differs(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose value is not ``value``; a missing value is different, so it stays."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def above(df: DataFrame, column: str, bound) -> DataFrame:
    """Rows strictly above a bound; missing values go."""
    return df.where(F.col(column) > F.lit(bound))


def above_quantile(df: DataFrame, column: str, share: float) -> DataFrame:
    """Rows strictly above the exact quantile of the column."""
    return above(df, column, quantile(df, column, share))


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    """Rows that have a value (neither NULL nor NaN) in the column."""
    return df.dropna(subset=[column])


def ascii_only(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is present and pure ASCII."""
    return df.where(is_ascii(column))


def keep_first(df: DataFrame, key: str | list[str], order_by: list[str]) -> DataFrame:
    """One row per key: the first by ``order_by``, then by the other columns.

    A minimum over whole rows, so copies are combined before the shuffle and a
    key with very many rows costs no more than any other. NULL keys are equal.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    ordered = [c for c in order_by if c not in keys] + rest
    if not ordered:
        return df.distinct()
    maps = {f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)}
    least = F.min(F.struct(*ordered))
    if maps:  # maps have no order: ties go by their sorted entries
        places = [F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in ordered]
        least = F.min_by(F.struct(*ordered), F.struct(*places))
    first = df.groupBy(*keys).agg(least.alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])
