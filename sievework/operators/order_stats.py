"""Exact order statistics without a global sort.

``percentile`` and ``median`` keep every distinct value in one aggregation
buffer, so they cannot serve a column with billions of distinct values. Here a
mergeable sketch proposes split values, one aggregate counts the rows of each
cell between splits exactly, and only the cell that holds a wanted rank is
looked at again. Nothing larger than ``window_rows`` rows ever meets in a task,
and only the wanted values reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW_ROWS = 1 << 16
SKETCH_ACCURACY = 10_000
GRID = 256


@dataclass(frozen=True)
class Span:
    """Consecutive ranks: all values in [low, high], ``below`` rows before them."""

    low: object
    high: object
    below: int
    rows: int
    ranks: tuple[int, ...]


def order_statistics(
    df: DataFrame,
    column: str,
    pick_ranks: Callable[[int], Iterable[int]],
    *,
    window_rows: int = WINDOW_ROWS,
) -> tuple[int, dict[int, object]]:
    """The row count of a numeric column and its values at zero-based ranks.

    ``pick_ranks`` gets the number of non-missing values and returns the ranks
    wanted. Missing values (NULL or NaN) have no rank.
    """
    value = F.col("value")
    values = df.select(F.col(column).alias("value")).where(value.isNotNull())
    if isinstance(values.schema["value"].dataType, (T.FloatType, T.DoubleType)):
        values = values.where(~F.isnan(value))
    grid = F.percentile_approx(value, [i / GRID for i in range(GRID + 1)], SKETCH_ACCURACY)
    rows, low, high, grid = values.agg(F.count(value), F.min(value), F.max(value), grid).first()
    if rows == 0:
        return 0, {}
    ranks = tuple(sorted(set(pick_ranks(rows))))
    # the first look at all rows also tells roughly where each rank lies
    places = [GRID * (rank + 0.5) / rows for rank in ranks]
    splits = {grid[i] for place in places for i in (int(place), min(int(place) + 1, GRID))}
    found: dict[int, object] = {}
    open_spans = [Span(low, high, 0, rows, ranks)]
    while True:
        for span in open_spans:
            if span.low == span.high:
                found.update(dict.fromkeys(span.ranks, span.low))
        open_spans = [s for s in open_spans if s.ranks and s.low != s.high]
        wide = [s for s in open_spans if s.rows > window_rows]
        if not wide:
            break
        narrow = [s for s in open_spans if s.rows <= window_rows]
        open_spans = narrow + _refine(values, wide, splits or _propose(values, wide))
        splits = set()
    if open_spans:
        found.update(_pick(values, open_spans))
    return rows, found


def _inside(values: DataFrame, spans: list[Span]) -> DataFrame:
    """Rows that lie in one of the (disjoint) spans, with the span's number."""
    within = [F.col("value").between(F.lit(s.low), F.lit(s.high)) for s in spans]
    number = reduce(lambda case, i: case.when(within[i], i), range(1, len(spans)), F.when(within[0], 0))
    return values.where(reduce(Column.__or__, within)).withColumn("span", number)


def _propose(values: DataFrame, spans: list[Span]) -> set:
    """Split values just below and above each rank, by a sketch of each span."""
    margin = 2.0 / SKETCH_ACCURACY
    sketches = []
    for i, span in enumerate(spans):
        middle = [(rank - span.below + 0.5) / span.rows for rank in span.ranks]
        shares = sorted({min(1.0, max(0.0, m + d)) for m in middle for d in (-margin, margin)})
        in_span = F.when(F.col("span") == i, F.col("value"))
        sketches.append(F.percentile_approx(in_span, shares, SKETCH_ACCURACY).alias(f"s{i}"))
    splits = {split for found in _inside(values, spans).agg(*sketches).first() for split in found}
    # a midpoint guarantees progress whatever the sketch proposes
    for span in spans:
        if isinstance(span.low, float):
            splits.add(span.low + (span.high - span.low) / 2)
        elif isinstance(span.low, int):
            splits.add(span.low + (span.high - span.low) // 2)
    return splits


def _refine(values: DataFrame, spans: list[Span], splits: set) -> list[Span]:
    """Replace each span by the exactly counted cells that hold its ranks."""
    # each split value gets a cell of its own, so a heavy duplicate is settled at once
    cell = F.lit(0)
    for split in sorted(splits):
        split = F.lit(split)
        cell = cell + (F.col("value") >= split).cast("int") + (F.col("value") > split).cast("int")
    cells = (
        _inside(values, spans)
        .groupBy("span", cell.alias("cell"))
        .agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .orderBy("span", "cell")
        .collect()
    )
    refined = []
    below = {i: span.below for i, span in enumerate(spans)}
    for row in cells:
        start = below[row.span]
        ranks = tuple(r for r in spans[row.span].ranks if start <= r < start + row.n)
        if ranks:
            refined.append(Span(row.low, row.high, start, row.n, ranks))
        below[row.span] = start + row.n
    return refined


def _pick(values: DataFrame, spans: list[Span]) -> dict[int, object]:
    """Read the wanted ranks out of spans small enough for one window each."""
    counted = _inside(values, spans).groupBy("span", "value").agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy("span").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    through = counted.withColumn("through", F.sum("n").over(ordered))
    wanted = [(i, r, r - s.below) for i, s in enumerate(spans) for r in s.ranks]
    hits = [
        F.when((F.col("span") == i) & (offset < F.col("through")) & (offset >= F.col("through") - F.col("n")), r)
        for i, r, offset in wanted
    ]
    rank = F.explode(F.array_compact(F.array(*hits))).alias("rank")
    return {row.rank: row.value for row in through.select(rank, "value").collect()}


def quantile(df: DataFrame, column: str, share: float, **options) -> float | None:
    """The exact quantile, interpolated linearly between neighbours."""
    return quantiles(df, column, [share], **options)[0]


def quantiles(df: DataFrame, column: str, shares: list[float], **options) -> list[float | None]:
    """Several exact, linearly interpolated quantiles from one selection."""

    def around(n):
        places = [share * (n - 1) for share in shares]
        return [r for p in places for r in (int(p), min(int(p) + 1, n - 1))]

    n, at = order_statistics(df, column, around, **options)
    if n == 0:
        return [None] * len(shares)
    result = []
    for share in shares:
        place = share * (n - 1)
        lower = float(at[int(place)])
        upper = float(at[min(int(place) + 1, n - 1)])
        result.append(lower + (upper - lower) * (place - int(place)))
    return result


def median(df: DataFrame, column: str, **options) -> float | None:
    """The exact median: the middle value, or the mean of the middle two."""
    n, at = order_statistics(df, column, lambda n: [(n - 1) // 2, n // 2], **options)
    return None if n == 0 else (float(at[(n - 1) // 2]) + float(at[n // 2])) / 2
