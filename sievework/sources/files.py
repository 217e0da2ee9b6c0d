"""CSV and parquet scans and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.numbers import nan_to_null
from sievework.sources.csv_ranges import csv_records


# Texts that a CSV file may hold for a missing value.
MISSING_TEXTS = ("", "NA", "N/A", "n/a", "#N/A", "NULL", "null", "NaN", "nan", "-NaN", "-nan", "None", "<NA>")


def parse_text(text: Column, kind: str, strict: bool) -> Column:
    """Text as a declared type; whole numbers may be written with a fraction of zero.

    A value that does not fit is an error if ``strict``, else missing.
    """
    if kind == "string":
        return text
    if kind in ("tinyint", "smallint", "int", "bigint"):
        text = F.regexp_replace(text, r"^(\s*[+-]?\d+)\.0*\s*$", "$1")
    return text.cast(kind) if strict else text.try_cast(kind)


def scan_csv(
    spark: SparkSession,
    path: str | list[str],
    columns: dict[str, str],
    multiline: bool = True,
    strict: bool = False,
    missing: tuple[str, ...] = MISSING_TEXTS,
) -> DataFrame:
    """Named columns of CSV files with a header, parsed to the declared types.

    Only these columns are parsed. The texts in ``missing`` are missing values.
    A value that does not fit its type is missing, or an error if ``strict``. A
    file whose header differs from the first one's is an error. Quoted fields may
    hold line breaks; files are split all the same (``csv_records``), at the
    price of a first pass over quotes, which ``multiline=False`` saves when no
    field holds a line break.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("enforceSchema", False)
    raw = reader.option("multiLine", multiline).csv(path)
    if multiline:
        fields = ", ".join(f"`{c.replace('`', '``')}` string" for c in raw.columns)
        parsed = F.from_csv("record", fields, {"quote": '"', "escape": '"', "multiLine": "true"})
        raw = csv_records(spark, path).select(parsed.alias("row")).select("row.*")
    absent = [c for c in columns if c not in raw.columns]
    if absent:
        raise ValueError(f"columns not in {path}: {absent}")
    known = lambda c: F.when(~F.col(f"`{c}`").isin(list(missing)), F.col(f"`{c}`"))
    return raw.select(*[parse_text(known(c), kind, strict).alias(c) for c, kind in columns.items()])


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file or folder, NaN read as missing."""
    return nan_to_null(spark.read.parquet(path))


def spread_scan(df: DataFrame) -> DataFrame:
    """Deal the rows of a plain scan to all cores if it has fewer splits than cores.

    For heavy work per row, such as tokenising, over a few small files. A large
    scan has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def save_parquet(df: DataFrame, path: str) -> None:
    """Write a table as parquet, replacing what was there."""
    df.write.mode("overwrite").parquet(path)


def append_parquet(df: DataFrame, path: str) -> None:
    """Add rows to a parquet table, whose columns must be the same in name and type."""
    try:
        there = df.sparkSession.read.parquet(path).schema
    except AnalysisException:  # nothing there yet
        there = df.schema
    kinds = lambda schema: {f.name: f.dataType.simpleString() for f in schema}
    if kinds(there) != kinds(df.schema):
        raise ValueError(f"{path} holds {there.simpleString()}, not {df.schema.simpleString()}")
    df.write.mode("append").parquet(path)


def cast_declared(df: DataFrame, types: dict[str, str], strict: bool = True, real: str = "double") -> DataFrame:
    """Cast columns to their declared ``real`` or ``nominal`` type; others pass through.

    A value that cannot be converted is an error, or missing if not ``strict``.
    Real numbers are doubles unless ``real="float"`` asks for 32 bits, which
    would change large counts.
    """
    # Names of the attribute types.
    targets = {"real": real, "nominal": "string"}
    unknown = set(types.values()) - set(targets)
    if unknown:
        raise ValueError(f"unknown attribute types: {sorted(unknown)}")
    require_columns(df, types)

    def cast(name: str, kind: str) -> Column:
        return F.col(name).cast(targets[kind]) if strict else F.col(name).try_cast(targets[kind])

    return df.withColumns({name: cast(name, kind) for name, kind in types.items()})


def require_columns(df: DataFrame, names) -> None:
    """Raise if a column is absent."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"no such columns: {absent}")


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns, which must exist."""
    require_columns(df, names)
    return df.drop(*names)


def union_chunks(chunks: list[DataFrame]) -> DataFrame:
    """All rows of several tables with the same columns."""
    return reduce(DataFrame.unionByName, chunks)
