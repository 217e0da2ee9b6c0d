"""Joins that stay safe when the smaller side grows or one key is hot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.session import settle, staged

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
HOT_SHARE = 1_000
SALTS = 64


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a settled table is small enough to send to every executor."""
    width = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            width = width + 32 * F.greatest(F.size(field.name), F.lit(0))
        else:
            width = width + 8
    rows, size = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    return rows <= max_rows and (size or 0) <= BROADCAST_BYTES


def hot_keys(df: DataFrame, keys: list[str], share: int = HOT_SHARE) -> list:
    """Key values that hold more than 1/``share`` of the rows: fewer than ``share``."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.where(F.col("_rows") * share > total).select(*keys).collect()


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    keys: str | list[str],
    how: str = "inner",
    *,
    null_safe: bool = False,
    settled: bool = False,
    at_most: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join rows to a lookup table with few rows per key (inner, left, left_semi).

    The table is computed once (unless it is ``settled`` already) and measured
    in rows and bytes: a small one is broadcast, a larger one is shuffled for
    ordinary keys, while the rows of hot keys are matched by broadcast where
    they lie, so no task receives a hot key's rows. There are less than
    ``HOT_SHARE`` hot keys; should their lookup rows still be too many, hot rows
    are dealt over ``SALTS`` salts and their lookup rows repeated for each. A
    table of ``at_most`` as many rows as a checkpoint holds well is settled, a
    larger or unknown one is staged as parquet. With ``null_safe`` NULL matches NULL.
    """
    keys = [keys] if isinstance(keys, str) else keys
    if not settled:
        table = settle(table) if at_most is not None and at_most <= BROADCAST_ROWS else staged(table, "lookup")
    if fits_broadcast(table, broadcast_rows):
        return _join(df, F.broadcast(table), keys, how, null_safe)
    hot = hot_keys(df, keys)
    if not hot:
        return _join(df, table, keys, how, null_safe)
    is_hot = _any_of(keys, hot)
    hot_table = table.where(is_hot)
    if fits_broadcast(hot_table, broadcast_rows):
        met = _join(df.where(is_hot), F.broadcast(hot_table), keys, how, null_safe)
    else:
        dealt = df.where(is_hot).withColumn("_salt", F.monotonically_increasing_id() % SALTS)
        copies = hot_table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        met = _join(dealt, copies, [*keys, "_salt"], how, null_safe).drop("_salt")
    return met.unionByName(
        _join(df.where(~is_hot), table.where(~is_hot), keys, how, null_safe)
    )


def _any_of(keys: list[str], rows: list) -> Column:
    """Whether the keys of a row are among the given ones; never NULL."""
    if len(keys) == 1:
        (key,) = keys
        listed = F.coalesce(F.col(key).isin([r[key] for r in rows if r[key] is not None]), F.lit(False))
        return listed | F.col(key).isNull() if any(r[key] is None for r in rows) else listed
    same = [reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(row[k])) for k in keys]) for row in rows]
    return reduce(Column.__or__, same)


def _join(df: DataFrame, table: DataFrame, keys: list[str], how: str, null_safe: bool) -> DataFrame:
    if not null_safe:
        return df.join(table, keys, how)
    right = table.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    joined = df.join(right, same, how)
    return joined if how == "left_semi" else joined.drop(*[f"_key_{k}" for k in keys])


def keep_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key also occurs in ``known`` (a semi join)."""
    return lookup_join(df, known.select(key).distinct(), key, "left_semi")


def attach_label(df: DataFrame, labels: DataFrame, key: str, label: str, suffix: str = "_GENRE") -> DataFrame:
    """Inner join on ``key`` to a label column, renamed so no term can clash with it.

    Rows without a label value are dropped; a key with several labels keeps
    them all.
    """
    renamed = labels.select(key, F.col(label).alias(f"{label}{suffix}"))
    return lookup_join(df, renamed.where(F.col(f"{label}{suffix}").isNotNull()), key, "inner")
