"""Repair of missing values: each function returns the repaired Column.

Statistics come from scalar subqueries over the same table, so repairing
several columns stays one lazy plan with one shared aggregate.
"""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.order_stats import median


def present(df: DataFrame, column: str) -> Column:
    """The column with NaN read as missing."""
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), F.col(column))
    return F.col(column)


def _comparable(values: list, kind: T.DataType) -> list:
    """The sentinels a column of this type can hold: texts as text, integers and decimals exactly, others as floats."""
    values = [v for v in values if v is not None]
    if isinstance(kind, T.StringType):
        return [str(v) for v in values]
    if not isinstance(kind, T.NumericType):
        return list(values)
    numbers = []
    for value in values:
        try:
            if isinstance(kind, (T.FloatType, T.DoubleType)):
                numbers.append(float(value))
                continue
            exact = Decimal(str(value))
        except (ValueError, InvalidOperation):
            continue
        if not exact.is_finite():
            continue
        if isinstance(kind, T.DecimalType):
            numbers.append(exact)
        elif exact == int(exact) and -(1 << 63) <= exact < 1 << 63:
            numbers.append(int(exact))
    return numbers


def blank_sentinels(df: DataFrame, sentinels: dict[str, list]) -> DataFrame:
    """Values that stand for "missing" become NULL, each in its own column."""
    blanked = {}
    for column, values in sentinels.items():
        values = _comparable(values, df.schema[column].dataType)
        if values:
            blanked[column] = F.when(~F.coalesce(F.col(column).isin(values), F.lit(False)), F.col(column))
    return df.withColumns(blanked)


def replace_missing_with_value(df: DataFrame, column: str, value) -> Column:
    """Missing values become a constant."""
    if isinstance(df.schema[column].dataType, T.StringType):
        value = str(value)
    return F.coalesce(present(df, column), F.lit(value))


def replace_missing_with_mode(df: DataFrame, column: str) -> Column:
    """Missing values become the most frequent value, the smallest if several tie."""
    counts = df.select(present(df, column).alias("value")).dropna().groupBy("value").count()
    mode = counts.orderBy(F.desc("count"), "value").limit(1).select("value").scalar()
    return F.coalesce(present(df, column), mode, F.raise_error(F.lit(f"{column} has no values, so no mode")))


def replace_missing_with_mean(df: DataFrame, column: str) -> Column:
    """Missing values become the mean of the others."""
    mean = df.agg(F.avg(present(df, column))).scalar()
    return F.coalesce(present(df, column).cast("double"), mean)


def replace_missing_with_median(df: DataFrame, column: str) -> Column:
    """Missing values become the exact median of the others."""
    return F.coalesce(present(df, column).cast("double"), F.lit(median(df, column)).cast("double"))
