"""Records of CSV files with line breaks inside quotes, read by many tasks per file.

Spark splits a text file into byte ranges at line ends, but whether a line starts
a record depends on all quotes before it. So the scan takes three steps:

1. Every range tells what it does to the quote state: a line leaves it as it is,
   swaps it, or ends inside or outside a quoted field whatever came before. The
   composition over a range is one of these four again.
2. Compositions are chained per file, by a window over its ranges (not its
   lines), which gives each range its true state at the start.
3. Every range emits the records that it holds whole. The lines before its first
   record and after its last whole one are its edges; edges of neighbouring
   ranges are joined, at most one record per range.

A quote opens a field only at the field's start and is written twice inside;
text between a closing quote and the next separator belongs to the field. Lines end in LF or CRLF; empty
lines outside quotes are no records. Files may differ in size and number, and a
compressed file is one range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.session import staged

#: What a stretch of lines does to the state "inside a quoted field".
KEEP, SWAP, OUTSIDE, INSIDE = range(4)
WHOLE, HEAD, TAIL = range(3)
_SHAPE = "file bigint, at bigint, kind int, first boolean, record binary"


def closing_patterns(separator: str) -> tuple[str, str]:
    """Patterns of lines that end outside quotes: if they start outside, and if they start inside."""
    sep = re.escape(separator)
    rest = rf'(?:[^"{sep}][^{sep}]*)?'  # after a closing quote, or a plain field
    tail = rf'"(?:[^"]|"")*"{rest}'
    more = rf"(?:{sep}(?:{tail}|{rest}))*$"
    return rf"(?s)^(?:{tail}|{rest}){more}", rf'(?s)^(?:[^"]|"")*"{rest}{more}'


def line_effects(lines: pa.Array, separator: str = ",") -> np.ndarray:
    """The effect of every line on the quote state."""
    outside, inside = closing_patterns(separator)
    effect = np.full(len(lines), KEEP)
    quoted = np.flatnonzero(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False))
    some = lines.take(pa.array(quoted))
    from_out = pc.match_substring_regex(some, outside).to_numpy(zero_copy_only=False)
    from_in = pc.match_substring_regex(some, inside).to_numpy(zero_copy_only=False)
    effect[quoted] = np.select([from_out & from_in, from_out & ~from_in, ~from_out & from_in], [OUTSIDE, KEEP, SWAP], INSIDE)
    return effect


def states(effects: np.ndarray, start: bool) -> np.ndarray:
    """Whether each line starts inside quotes, and last whether the end is inside."""
    swaps = np.concatenate(([0], np.cumsum(effects == SWAP)))
    fixed = np.concatenate(([0], np.where(effects >= OUTSIDE, np.arange(1, len(effects) + 1), 0)))
    last = np.maximum.accumulate(fixed)
    value = np.concatenate(([start], effects == INSIDE))
    return value[last] ^ ((swaps - swaps[last]) % 2 == 1)


def _composed(effects: np.ndarray) -> int:
    ends = bool(states(effects, False)[-1]), bool(states(effects, True)[-1])
    return {(False, True): KEEP, (True, False): SWAP, (False, False): OUTSIDE, (True, True): INSIDE}[ends]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """The lines of each range in a batch, in order."""
    file, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(at) != 0)) + 1
    for s, e in zip([0, *cuts], [*cuts, len(file)]):
        if e > s:
            yield (int(file[s]), int(at[s])), batch.column(2).slice(s, e - s)


def range_effects(batches: Iterator[pa.RecordBatch], separator: str) -> dict[tuple[int, int], int]:
    held: dict[tuple[int, int], int] = {}
    for batch in batches:
        for key, part in _runs(batch):
            held[key] = _composed(np.concatenate(([held.get(key, KEEP)], line_effects(part, separator))))
    return held


def ranged_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, at, line``: the lines of text files in order within each range, known by file and start."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("line"))


def inside_ranges(lines: DataFrame, separator: str = ",") -> set[tuple[int, int]]:
    """The ranges (file, start) that begin inside a quoted field; the driver gets no more than these."""

    def effects(batches):
        held = range_effects(batches, separator)
        columns = [pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int64()), pa.array(list(held.values()), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["file", "at", "effect"])

    ranges = staged(lines.mapInArrow(effects, "file bigint, at bigint, effect int"), "csv-ranges")
    above = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("at")
    swaps = ranges.withColumn("swaps", F.sum((F.col("effect") == SWAP).cast("int")).over(upto))
    fixed = F.when(F.col("effect") >= OUTSIDE, F.struct((F.col("effect") == INSIDE).alias("inside"), "swaps"))
    known = swaps.select("file", "at", F.coalesce(F.max("swaps").over(above), F.lit(0)).alias("swaps"), F.last(fixed, True).over(above).alias("fixed"))
    odd = (F.col("swaps") - F.coalesce("fixed.swaps", F.lit(0))) % 2 == 1
    return {tuple(r) for r in known.where(F.coalesce("fixed.inside", F.lit(False)) != odd).select("file", "at").collect()}


def _joined(lines: pa.Array, starts: np.ndarray) -> pa.Array:
    """Lines from one start to the next as one record each."""
    if len(starts) == len(lines):
        return lines
    groups = pa.ListArray.from_arrays(pa.array(np.append(starts, len(lines)).astype(np.int32)), lines)
    return pc.binary_join(groups, b"\n")


def _rows(key, kind, first, records):
    n = len(records)
    return pa.RecordBatch.from_arrays(
        [pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int64()), pa.array([kind] * n, pa.int32()),
         pa.array([first] * n, pa.bool_()), records.cast(pa.binary())],
        ["file", "at", "kind", "first", "record"],
    )


def split(batches: Iterator[pa.RecordBatch], inside: set[tuple[int, int]], separator: str, edges: bool, header: bool = True) -> Iterator[pa.RecordBatch]:
    """From lines (file, at, line) the whole records of every range, or its edges and, with ``header``, a file's first record.

    ``inside`` has the ranges that begin inside quotes.
    """
    key, now, open_, headless, first = None, False, [], False, False

    def closed():
        """The open lines as a record or, in a range that began inside quotes, as its head."""
        record = pa.array([b"\n".join(open_)], pa.binary())
        if headless and edges:
            yield _rows(key, HEAD, False, record)
        if not headless and edges == first:
            yield _rows(key, WHOLE, first, record)

    def left():
        """What a range leaves open at its end."""
        if open_ and edges:
            yield _rows(key, HEAD if headless else TAIL, first, pa.array([b"\n".join(open_)], pa.binary()))

    for batch in batches:
        for own, part in _runs(batch):
            if own != key:
                yield from left()
                key, open_, first = own, [], header and own[1] == 0
                headless = now = own in inside
            at = states(line_effects(part, separator), now)
            starts, now = np.flatnonzero(~at[:-1]), bool(at[-1])
            begun = int(starts[0]) if len(starts) else len(part)
            open_ = open_ + part.slice(0, begun).to_pylist()
            if open_ and (len(starts) or not now):
                yield from closed()
                open_, headless, first = [], False, False
            if not len(starts):
                continue
            records = _joined(part.slice(begun), starts - begun)
            if now:
                records, open_ = records[:-1], records[-1:].to_pylist()
            if first and len(records):
                if edges:
                    yield _rows(own, WHOLE, True, records[:1])
                records, first = records[1:], False
            if len(records) and not edges:
                yield _rows(own, WHOLE, False, records)
    yield from left()


def _split(lines: DataFrame, inside: set[tuple[int, int]], separator: str, edges: bool, header: bool) -> DataFrame:
    known = lines.sparkSession.sparkContext.broadcast(inside)
    return lines.mapInArrow(lambda batches: split(batches, known.value, separator, edges, header), _SHAPE)


def csv_records(spark: SparkSession, path: str | list[str], separator: str = ",") -> DataFrame:
    """``record``: the text of every record but each file's first, which must be the same in all files.

    The order of files and records is not kept.
    """
    return line_records(ranged_lines(spark, path), separator)


def line_records(lines: DataFrame, separator: str = ",", header: bool = True) -> DataFrame:
    """The records of ``ranged_lines``; with ``header`` without each file's first, else all of them."""
    inside = inside_ranges(lines, separator)
    edges = staged(_split(lines, inside, separator, True, header), "csv-edges")
    plain = lambda c: F.regexp_replace(F.col(c).cast("string"), "\r$", "").alias(c)
    chain = Window.partitionBy("file").orderBy("at", "kind")
    opened = edges.where(F.col("kind") != WHOLE).withColumn("chain", F.sum((F.col("kind") == TAIL).cast("int")).over(chain))
    pieces = F.array_sort(F.collect_list(F.struct("at", "kind", F.col("record").cast("string").alias("text"))))
    met = opened.groupBy("file", "chain").agg(F.bool_or("first").alias("first"), F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("record"))
    met = met.unionByName(edges.where(F.col("kind") == WHOLE).select("file", F.lit(0).alias("chain"), "first", F.col("record").cast("string").alias("record")))
    firsts = met.where("first").select(F.regexp_replace("record", "^\ufeff|\r$", "").alias("record")).distinct()
    if header and len(firsts.limit(2).collect()) > 1:
        raise ValueError("the files have different headers")
    records = _split(lines, inside, separator, False, header).select(plain("record"))
    return records.unionByName(met.where("not first").select(plain("record"))).where("record <> ''")
