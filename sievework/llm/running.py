"""Places and running sums of rows within groups, whatever the size of a group.

Rows are dealt by range of (group, order) and written down with the number of
their range; a group's totals per range are few, so a window over them gives
what lies before a range, and a window inside each range does the rest. A group
with a third of all rows is spread over a third of the ranges. NULLs in the
order come first; group columns must not hold NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import staged


def running(df: DataFrame, groups: list[str], order: list[str], sums: dict[str, int] | None = None) -> DataFrame:
    """Add ``before``, the rows before each one in its group, and ``before_x`` for each column x of ``sums``.

    ``sums`` maps a column of longs to the modulus its running sum is kept in
    (0: none), so that sums of many large numbers stay exact. Rows that tie in the whole
    order stand in any order among themselves.
    """
    sums = sums or {}
    rest = lambda column, x: column if not sums[x] else F.pmod(column, F.lit(sums[x]))
    keep = df.columns
    ranged = df.repartitionByRange(*groups, *order) if groups else df.repartitionByRange(*order)
    ranged = staged(ranged.withColumn("_cell", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*groups, "_cell").agg(F.count(F.lit(1)).alias("_n"), *[rest(F.sum(x), x).alias(f"_of_{x}") for x in sums])
    earlier = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *groups, "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"),
        *[F.coalesce(F.sum(f"_of_{x}").over(earlier), F.lit(0)).alias(f"_of_{x}") for x in sums],
    )
    within = Window.partitionBy(*groups, "_cell").orderBy(*order)
    above = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(starts, [*groups, "_cell"])
    return placed.select(
        *keep, (F.col("_n") + F.row_number().over(within) - 1).alias("before"),
        *[rest(F.col(f"_of_{x}") + F.coalesce(F.sum(x).over(above), F.lit(0)), x).alias(f"before_{x}") for x in sums],
    )
