"""Incremental ingest: new CSV files are split into growing metadata and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.filters import equals
from sievework.sources.ingest import split_text


def stream_csv(spark: SparkSession, folder: str, columns: list[str], types: dict[str, str]) -> DataFrame:
    """A stream of the CSV files in a folder; ``columns`` names all fields in file order."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    reader = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True)
    raw = reader.option("quote", '"').option("escape", '"').csv(folder)
    return raw.select(*[F.col(c).try_cast(kind).alias(c) for c, kind in types.items()])


def ingest_new_files(
    source: DataFrame, language_col: str, language: str, key: str, text_col: str, out: str, state: str
) -> None:
    """Take up files that arrived since the last run into ``out/metadata`` and ``out/text``.

    One stream feeds both: a batch is parsed once and each half replaces the
    folder ``batch=<number>`` of its table, so a batch that runs again after a
    failure adds nothing twice and both halves always hold the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, half in zip(("metadata", "text"), split_text(equals(batch, language_col, language), key, text_col)):
            half.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        batch.unpersist()

    writer = source.writeStream.trigger(availableNow=True).option("checkpointLocation", state)
    writer.foreachBatch(write).start().awaitTermination()
