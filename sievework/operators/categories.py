"""Category counts and merging of rare labels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.joins import lookup_join


def count_categories(df: DataFrame, column: str, order: list | None = None) -> DataFrame:
    """Rows ``(category, count)``; NULL is a category.

    With ``order`` only the listed categories appear, in that order, with a
    ``position``; a listed category without rows counts 0.
    """
    counts = df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("count"))
    if order is None:
        return counts
    listed = df.sparkSession.createDataFrame(list(enumerate(order)), "position int, category string")
    counts = counts.where(F.col("category").isin(list(order))).withColumn("category", F.col("category").cast("string"))
    return listed.join(F.broadcast(counts), "category", "left").select(
        "category", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), "position"
    )


def top_categories(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, missing ones apart; ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("category"))
    return counts.agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "category").limit(k)


def merge_uncommon(
    df: DataFrame,
    column: str,
    default: str = "OTHER",
    max_categories: int | None = None,
    min_count: int | None = None,
    min_pct: float | None = None,
) -> DataFrame:
    """Replace infrequent labels of a column by ``default``.

    The first criterion given decides: the ``max_categories`` most frequent
    labels stay (ties by label), or those with at least ``min_count`` rows, or
    those with at least the fraction ``min_pct`` of all rows. NULL is a label.
    The column becomes text, whatever it was.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_count"))
    at_most = None
    if max_categories is not None:
        at_most = max_categories
        kept = counts.orderBy(F.desc("_count"), column).limit(max_categories)
    elif min_count is not None:
        kept = counts.where(F.col("_count") >= min_count)
    elif min_pct is not None:
        # so many labels can hold that fraction each
        at_most = math.ceil(1 / min_pct) if min_pct > 0 else None
        total = df.agg(F.count(F.lit(1))).scalar()
        kept = counts.where(F.col("_count") >= total * F.lit(min_pct))
    else:
        raise ValueError("give max_categories, min_count or min_pct")
    kept = kept.select(column, F.lit(True).alias("_kept"))
    marked = lookup_join(df, kept, column, "left", null_safe=True, at_most=at_most)
    label = F.when(F.col("_kept"), F.col(column).cast("string")).otherwise(F.lit(default))
    return marked.withColumn(column, label).select(*df.columns)
