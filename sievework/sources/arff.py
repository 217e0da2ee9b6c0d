"""ARFF files: export with nominal domains and a CSV body, and a scan with the header's types, as Spark jobs."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.joins import lookup_join
from sievework.session import staged
from sievework.sources.csv_ranges import line_records, ranged_lines
from sievework.sources.files import parse_text, require_columns

ARFF_TYPES = ("NUMERIC", "NOMINAL", "STRING")
# Texts that Python reads as an integer.
INTEGER_TEXT = r"^\s*[+-]?\d+(_\d+)*\s*$"


@dataclass(frozen=True)
class ArffConfig:
    """A relation name and its attributes in order: name -> NUMERIC, NOMINAL or STRING."""

    relation: str
    attributes: dict[str, str]

    @staticmethod
    def parse(source: dict | str) -> ArffConfig:
        """From a dictionary, or from the path of a JSON file."""
        if isinstance(source, str):
            with open(source, encoding="utf-8") as file:
                source = json.load(file)
        if not isinstance(source.get("relation"), str):
            raise ValueError(f"relation name must be a string: {source.get('relation')}")
        if not isinstance(source.get("attributes"), dict):
            raise ValueError("attributes must map names to types")
        types = {name: kind.upper() for name, kind in source["attributes"].items()}
        unknown = sorted(set(types.values()) - set(ARFF_TYPES))
        if unknown:
            raise ValueError(f"unknown ARFF types: {unknown}")
        return ArffConfig(source["relation"], types)


def clean_name(name: str) -> str:
    """Spaces become underscores, single quotes go."""
    return name.replace(" ", "_").replace("'", "")


def number_text(value: Column) -> Column:
    """A float in plain notation from 1e-4 up to 1e16, else with an exponent of two digits at least."""
    text, size = value.cast("string"), F.abs(value)
    plain = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.when(F.abs(power) < 10, F.concat(F.lit("0"), F.abs(power).cast("string"))).otherwise(F.abs(power).cast("string"))
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^([^E]+)E", 1), r"\.0$", "")
    short = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), digits)
    return F.when(~text.contains("E"), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(short)


def label_text(df: DataFrame, column: str) -> Column:
    """A value as an ARFF label: integers get a ``_`` prefix, outer blanks go."""
    kind, value = df.schema[column].dataType, F.col(column)
    text = value.cast("string")
    if isinstance(kind, T.BooleanType):
        labelled = F.when(value, "_True").otherwise("_False")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        name = F.when(F.isnan(value), "nan").when(value > 0, "inf").otherwise("-inf")
        finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
        labelled = F.when(finite, F.concat(F.lit("_"), number_text(value))).otherwise(name)
    elif isinstance(kind, T.NumericType):
        labelled = F.concat(F.lit("_"), text)
    else:
        labelled = F.when(text.rlike(INTEGER_TEXT), F.concat(F.lit("_"), text)).otherwise(text)
    return F.regexp_replace(F.when(value.isNotNull(), labelled).otherwise("None"), r"^\s+|\s+$", "")


def arff_body(df: DataFrame, config: ArffConfig) -> DataFrame:
    """The configured attributes, coerced and renamed, in order."""
    require_columns(df, config.attributes)
    return df.select(
        *[
            (F.col(name).cast("double") if kind == "NUMERIC" else label_text(df, name)).alias(clean_name(name))
            for name, kind in config.attributes.items()
        ]
    )


def arff_header(df: DataFrame, config: ArffConfig) -> DataFrame:
    """Rows ``(attr_pos, name, type, domain)``; a nominal domain is sorted.

    One pass unpivots all nominal columns and makes the values distinct before
    they are brought together; a domain is one line of the header by format.
    """
    kinds = list(config.attributes.items())
    listed = df.sparkSession.createDataFrame(
        [(i, clean_name(name), kind) for i, (name, kind) in enumerate(kinds)], "attr_pos int, name string, type string"
    )
    nominal = [(i, name) for i, (name, kind) in enumerate(kinds) if kind == "NOMINAL"]
    if not nominal:
        return listed.withColumn("domain", F.lit(None).cast("string"))
    cells = F.array(*[F.struct(F.lit(i).alias("attr_pos"), label_text(df, n).alias("value")) for i, n in nominal])
    values = df.select(F.explode(cells).alias("cell")).select("cell.*").distinct()
    domains = values.groupBy("attr_pos").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("domain"))
    return listed.join(domains, "attr_pos", "left").select(
        "attr_pos", "name", "type", F.concat(F.lit("{"), "domain", F.lit("}")).alias("domain")
    )


def header_lines(df: DataFrame, config: ArffConfig) -> DataFrame:
    """The header as text: rows ``(line_no, value)``."""
    attributes = arff_header(df, config).select(
        (F.col("attr_pos") + 2).alias("line_no"),
        F.concat_ws(" ", F.lit("@ATTRIBUTE"), "name", F.coalesce("domain", "type")).alias("value"),
    )
    last = len(config.attributes) + 2
    fixed = [(0, f"@RELATION {config.relation.replace(' ', '_')}"), (1, ""), (last, ""), (last + 1, "@DATA")]
    return df.sparkSession.createDataFrame(fixed, "line_no int, value string").unionByName(attributes)


def dataframe_as_arff(df: DataFrame, config: ArffConfig, path: str, missing: str = "") -> None:
    """Write ``path/header`` and ``path/body``; concatenated in that order they are the ARFF file.

    ``missing`` is what a missing number is written as ('?' is ARFF's own marker).
    """
    lines = header_lines(df, config).coalesce(1).sortWithinPartitions("line_no")
    lines.select("value").write.mode("overwrite").text(f"{path}/header")
    rows = arff_body(df, config)
    numbers = [clean_name(n) for n, kind in config.attributes.items() if kind == "NUMERIC"]
    body = rows.withColumns({n: number_text(F.col(n)) for n in numbers}).write.mode("overwrite").option("header", False)
    body = body.option("quote", '"').option("escape", '"').option("nullValue", missing).option("emptyValue", "")
    body.csv(f"{path}/body")


ATTRIBUTE = r"""(?is)^\s*@attribute\s+('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\S+)\s+(\{|\w+)"""
#: ARFF's words for types, as Spark types; a domain in braces is a nominal attribute.
SPARK_TYPES = {"numeric": "double", "real": "double", "integer": "bigint", "string": "string", "{": "string"}


def _header(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The header's lines ``(at, seq, line)`` and the lines after each ``@data``, or of files without one, which are all data."""

    def marked(batches):
        key, before = None, 0
        for batch in batches:
            file, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate(([key != (int(file[0]), int(at[0]))], (np.diff(file) != 0) | (np.diff(at) != 0))) if len(file) else np.zeros(0, bool)
            starts = np.maximum.accumulate(np.where(new, np.arange(len(file)), 0)) if len(file) else new
            seq = np.arange(len(file)) - starts + np.where(np.cumsum(new) == 0, before, 0)
            if len(file):
                key, before = (int(file[-1]), int(at[-1])), int(seq[-1]) + 1
            is_data = pc.match_substring_regex(batch.column(2), r"(?i)^\s*@data\s*$")
            told = pc.match_substring_regex(batch.column(2), r"^\s*@")
            columns = [batch.column(0), batch.column(1), pa.array(seq), is_data, batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["file", "at", "seq", "data", "line"]).filter(told)

    found = staged(lines.mapInArrow(marked, "file bigint, at bigint, seq bigint, data boolean, line binary"), "arff-header")
    ends = found.where("data").groupBy("file").agg(F.min(F.struct("at", "seq")).alias("end"))
    head = found.join(F.broadcast(ends), "file").where(F.struct("at", "seq") < F.col("end")).select("at", "seq", F.col("line").cast("string").alias("line"))
    known = lines.sparkSession.sparkContext.broadcast({r["file"]: tuple(r["end"]) for r in ends.collect()})

    def data(batches):
        key, seen = None, 0
        for batch in batches:
            file, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(at) != 0)) + 1), len(file)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e > s:
                    own = int(file[s]), int(at[s])
                    key, seen = own, seen if own == key else 0
                    end = known.value.get(own[0], (-1, 0))
                    skip = e - s if own[1] < end[0] else max(0, min(e - s, end[1] + 1 - seen)) if own[1] == end[0] else 0
                    yield batch.slice(s + skip, e - s - skip)
                    seen += e - s

    return staged(head, "arff-attributes"), lines.mapInArrow(data, "file bigint, at bigint, line binary")


def _unquoted(text: Column) -> Column:
    inner = F.regexp_replace(F.substring(text, F.lit(2), F.length(text) - 2), r"\\(.)", "$1")
    return F.when(text.rlike(r"""(?s)^('.*'|".*")$"""), inner).otherwise(text)


def read_attributes(header: DataFrame) -> tuple[list[tuple[str, str]], DataFrame]:
    """Names and types of a header's attributes in order, and ``(attr_pos, value)`` of the nominal ones.

    The driver gets names and types; domains stay a relation.
    """
    found = header.where(F.col("line").rlike(r"(?i)^\s*@attribute\b"))
    parts = found.select("at", "seq", _unquoted(F.regexp_extract("line", ATTRIBUTE, 1)).alias("name"), F.lower(F.regexp_extract("line", ATTRIBUTE, 2)).alias("type"), "line")
    listed = parts.select("at", "seq", "name", "type").orderBy("at", "seq").collect()
    unknown = sorted({r["type"] for r in listed} - set(SPARK_TYPES))
    if unknown:
        raise ValueError(f"unknown ARFF types: {unknown}")
    places = header.sparkSession.createDataFrame([(r["at"], r["seq"], i) for i, r in enumerate(listed)], "at bigint, seq bigint, attr_pos int")
    body = F.regexp_extract("line", r"(?s)\{(.*)\}", 1)
    token = F.lit(r"""\s*('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,]*)\s*(?:,|$)""")
    values = parts.where(F.col("type") == "{").join(F.broadcast(places), ["at", "seq"]).select("attr_pos", F.explode(F.regexp_extract_all(body, token, 1)).alias("value"))
    return [(r["name"], r["type"]) for r in listed], values.select("attr_pos", _unquoted(F.trim("value")).alias("value")).where("value <> ''").distinct()


def scan_arff(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """An ARFF file, or a folder written by ``dataframe_as_arff``, as a table with the header's types.

    The data lines are split over tasks by byte ranges like CSV files, also if
    texts in double quotes hold line breaks. ``?`` is missing, as is an
    empty number; an empty label or text is empty. Values in single quotes hold
    no line breaks. A number that cannot be read and a label outside its domain
    are errors, or missing if not ``strict``. Sparse rows are an error.
    """
    places = [f"{path}/header", f"{path}/body"] if _has_header_folder(spark, path) else path
    header, data = _header(ranged_lines(spark, places))
    attributes, domains = read_attributes(header)
    if not attributes:
        raise ValueError(f"no ARFF header in {path}")
    names = [n for n, _ in attributes]
    fields = ", ".join(f"`_{i}` string" for i in range(len(names)))
    data = line_records(data, header=False)
    parse = lambda quote, escape: F.from_csv("record", fields, {"quote": quote, "escape": escape, "multiLine": "true", "nullValue": "", "ignoreLeadingWhiteSpace": "false"})
    single = F.col("record").contains("'") & ~F.col("record").contains('"')
    rows = data.select(F.when(single, parse("'", "\\")).otherwise(parse('"', '"')).alias("v"), "record")
    if strict:
        rows = rows.where(F.when(F.col("record").startswith("{"), F.raise_error(F.lit("sparse ARFF rows are not read"))).otherwise(F.lit(True)))
    cells = []
    for i, (_, kind) in enumerate(attributes):
        cell = F.col(f"v._{i}")
        cell = F.when(F.trim(cell) != "?", cell).when(cell.isNull() & F.lit(SPARK_TYPES[kind] == "string"), F.lit(""))
        cells.append(parse_text(cell, SPARK_TYPES[kind], strict).alias(f"_{i}"))
    table = rows.select(*cells)
    for i, (name, kind) in enumerate(attributes):
        if kind != "{":
            continue
        allowed = domains.where(F.col("attr_pos") == i).select(F.col("value").alias(f"_{i}"), F.lit(True).alias("_known"))
        table = lookup_join(table, allowed, f"_{i}", "left")
        known = F.col("_known") | F.col(f"_{i}").isNull() | (F.col(f"_{i}") == "")
        wrong = F.raise_error(F.concat(F.lit(f"not in the domain of {name}: "), F.col(f"_{i}"))) if strict else F.lit(None)
        table = table.withColumn(f"_{i}", F.when(F.coalesce(known, F.lit(False)), F.col(f"_{i}")).otherwise(wrong.cast("string"))).drop("_known")
    return table.select(*[F.col(f"_{i}").alias(name) for i, name in enumerate(names)])


def _has_header_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/header")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
