"""Normalisation: each function returns the rescaled Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.missing import present


def z_score_norm(df: DataFrame, column: str) -> Column:
    """Distance from the mean in sample standard deviations; NULL if they are zero."""
    value = present(df, column)
    stats = df.agg(F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))).scalar()
    return (value.cast("double") - stats["mean"]) / F.nullif(stats["sd"], F.lit(0.0))


def min_max_norm(df: DataFrame, column: str) -> Column:
    """Position between minimum and maximum; 0 everywhere in a constant column."""
    value = present(df, column).cast("double")
    stats = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    flat = stats["low"] == stats["high"]
    width = F.when(~flat, stats["high"] - stats["low"])
    return F.when(value.isNotNull() & flat, 0.0).otherwise((value - stats["low"]) / width)
