"""Binning into equal widths or equal frequencies, with per-bin representatives.

Fitting reduces the column to its cut values and one representative per bin
(as many values as bins asked for); applying is then a map-only expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.numbers import bin_index
from sievework.operators.order_stats import order_statistics


def frequency_ranks(rows: int, bins: int) -> list[int]:
    """Ranks at which equal-frequency bins start, the first bin apart.

    Every bin takes an even share of the rows still left, rounded half to even.
    """
    ranks, taken = [], 0
    for bins_left in range(bins, 1, -1):
        taken += round((rows - taken) / bins_left)
        ranks.append(min(taken, rows - 1))
    return ranks


def find_cuts(df: DataFrame, column: str, cut: str, bins: int) -> list:
    """The ``bins - 1`` ascending inner boundaries of a numeric column."""
    if cut == "width":
        low, high = df.agg(F.min(column), F.max(column)).first()
        if low is None:
            raise ValueError(f"{column} has no values to bin")
        step = (high - low) / bins
        return [low + i * step for i in range(1, bins)]
    if cut == "freq":
        rows, at = order_statistics(df, column, lambda n: frequency_ranks(n, bins))
        if rows == 0:
            raise ValueError(f"{column} has no values to bin")
        return [at[rank] for rank in frequency_ranks(rows, bins)]
    raise ValueError(f"unknown cut {cut!r}: use 'width' or 'freq'")


def assign_bins(df: DataFrame, column: str, cut: str, bins: int) -> Column:
    """The zero-based bin number of each value."""
    return bin_index(column, find_cuts(df, column, cut, bins))


def _represent(index: Column, values: dict[int, object], bins: int) -> Column:
    return F.get(F.array(*[F.lit(values.get(i)) for i in range(bins)]), index)


def _aggregate_bins(df: DataFrame, column: str, cut: str, bins: int, aggregate) -> Column:
    index = assign_bins(df, column, cut, bins)
    found = df.groupBy(index.alias("bin")).agg(aggregate(F.col(column)).alias("value")).collect()
    return _represent(index, {r.bin: r.value for r in found if r.bin is not None}, bins)


def make_named_bins(df: DataFrame, column: str, cut: str, names: list[str]) -> Column:
    """Each value becomes the name of its bin."""
    index = assign_bins(df, column, cut, len(names))
    return _represent(index, dict(enumerate(names)), len(names))


def make_mean_bins(df: DataFrame, column: str, cut: str, bin_count: int) -> Column:
    """Each value becomes the mean of its bin."""
    return _aggregate_bins(df, column, cut, bin_count, F.avg)


def make_min_bins(df: DataFrame, column: str, cut: str, bin_count: int) -> Column:
    """Each value becomes the smallest of its bin."""
    return _aggregate_bins(df, column, cut, bin_count, F.min)


def make_max_bins(df: DataFrame, column: str, cut: str, bin_count: int) -> Column:
    """Each value becomes the largest of its bin."""
    return _aggregate_bins(df, column, cut, bin_count, F.max)


def make_median_bins(df: DataFrame, column: str, cut: str, bin_count: int) -> Column:
    """Each value becomes the exact median of its bin.

    Bins are consecutive in sort order, so the middle of a bin is a rank of the
    whole column: one more selection serves all bins.
    """
    index = assign_bins(df, column, cut, bin_count)
    sizes = {r.bin: r.n for r in df.groupBy(index.alias("bin")).agg(F.count(column).alias("n")).collect()}
    middles, below = {}, 0
    for i in range(bin_count):
        size = sizes.get(i, 0)
        if size:
            middles[i] = (below + (size - 1) // 2, below + size // 2)
        below += size
    _, at = order_statistics(df, column, lambda n: [r for pair in middles.values() for r in pair])
    return _represent(index, {i: (float(at[a]) + float(at[b])) / 2 for i, (a, b) in middles.items()}, bin_count)
