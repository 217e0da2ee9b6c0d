"""Profiles of a column: the relations behind density, box, bar and word plots."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.numbers import nan_to_null
from sievework.functions.text import ENGLISH_STOP_WORDS, cloud_words
from sievework.operators.categories import count_categories
from sievework.operators.order_stats import median, quantiles
from sievework.operators.phrases import word_phrases


def make_density_plot(df: DataFrame, column: str, points: int = 200, margin: float = 3.0) -> DataFrame:
    """Gaussian kernel density ``(x, density)`` on an even grid.

    Scott's bandwidth; the grid reaches ``margin`` bandwidths past both ends.
    A row adds to the grid points within 39 bandwidths only: beyond that the
    kernel is exactly zero in double precision. Sums are combined per grid
    point before the shuffle.
    """
    df = nan_to_null(df.select(column))
    n, sd, low, high = df.agg(F.count(column), F.stddev_samp(column), F.min(column), F.max(column)).first()
    if n < 2 or not sd:
        raise ValueError(f"{column} needs two different values for a density")
    width = sd * n ** (-1 / 5)
    start = low - margin * width
    step = (high - low + 2 * margin * width) / (points - 1)
    value = F.col(column).cast("double")
    first = F.greatest(F.ceil((value - 39 * width - start) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((value + 39 * width - start) / step), F.lit(points - 1)).cast("int")
    near = df.where(value.isNotNull()).select(
        value.alias("value"), F.explode(F.when(first <= last, F.sequence(first, last))).alias("point")
    )
    place = F.lit(start) + F.col("point") * F.lit(step)
    kernel = F.exp(-0.5 * F.pow((F.col("value") - place) / F.lit(width), 2))
    sums = near.groupBy("point").agg(F.sum(kernel).alias("mass"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    scale = 1.0 / (n * width * math.sqrt(2 * math.pi))
    return grid.join(F.broadcast(sums), "point", "left").select(
        place.alias("x"), (F.coalesce("mass", F.lit(0.0)) * F.lit(scale)).alias("density")
    )


def make_boxplot(df: DataFrame, column: str) -> DataFrame:
    """One row: quartiles, whiskers (furthest values within 1.5 IQR) and outlier count."""
    df = nan_to_null(df.select(column))
    q1, middle, q3 = quantiles(df, column, [0.25, 0.5, 0.75])
    reach = 1.5 * ((q3 or 0.0) - (q1 or 0.0))
    value = F.col(column)
    inside = value.between(F.lit(q1).cast("double") - reach, F.lit(q3).cast("double") + reach)
    return df.agg(
        F.lit(q1).cast("double").alias("q1"),
        F.lit(middle).cast("double").alias("median"),
        F.lit(q3).cast("double").alias("q3"),
        F.min(F.when(inside, value)).cast("double").alias("whisker_low"),
        F.max(F.when(inside, value)).cast("double").alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def make_barplot(df: DataFrame, column: str, name: str | None = None, order: list | None = None) -> DataFrame:
    """Rows ``(category, count)``, the first column renamed to ``name`` if given."""
    counts = count_categories(df, column, order)
    return counts.withColumnRenamed("category", name) if name else counts


def make_word_cloud(
    df: DataFrame, column: str, top: int = 200, stop_words: Iterable[str] = ENGLISH_STOP_WORDS, phrases: bool = False
) -> DataFrame:
    """The ``top`` most frequent words of a text column, stop words apart.

    Words are counted in lower case and in any script; numbers are left out.
    With ``phrases`` two words that belong together count as one and plurals as
    their singulars (see ``word_phrases``).
    """
    if phrases:
        return word_phrases(df, column, stop_words=stop_words).orderBy(F.desc("count"), "word").limit(top)
    terms = df.select(F.explode(cloud_words(column)).alias("word"))
    kept = terms.where(~F.col("word").isin(list(stop_words)) & ~F.col("word").rlike(r"^\p{N}+$"))
    counts = kept.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "word").limit(top)


def get_summary_stats(df: DataFrame, column: str) -> DataFrame:
    """One row ``(mean, median, mode, stdev)``; the smallest mode if several tie."""
    df = nan_to_null(df.select(column))
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).count()
    mode = counts.orderBy(F.desc("count"), "value").limit(1).select("value").scalar()
    return df.agg(
        F.avg(column).alias("mean"),
        F.lit(median(df, column)).cast("double").alias("median"),
        F.first(mode).alias("mode"),
        F.stddev_samp(column).alias("stdev"),
    )
