"""Vectorised words, hashes and row keys shared by the operators.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are
64-bit polynomials over bytes, taken from prefix sums, so every word, shingle
or window of a text costs a few array operations.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in an array of bytes."""
    edges = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[data], [True])).view(np.int8)))
    return edges[0::2], edges[1::2]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of values[i] * base ** i for i in s..e-1."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges start..end of the sequence behind ``sums``; equal ranges hash alike."""
    shifted = (sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start]
    return mix(shifted + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word."""
    start, end = spans(data)
    return start, end, range_hashes(prefix_sums(_BYTE[data]), start, end)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width``-word windows; fewer words make one window, none make none."""
    if len(words) == 0:
        return words
    at = np.arange(max(1, len(words) - width + 1))
    return range_hashes(prefix_sums(words), at, np.minimum(at + width, len(words)))


def lower(text: str | bytes | None) -> np.ndarray:
    """The UTF-8 bytes of a text with A-Z lower-cased; NULL is empty."""
    data = raw(text)
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def raw(text: str | bytes | None) -> np.ndarray:
    """The UTF-8 bytes of a text; NULL is empty."""
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass") if not isinstance(text, bytes) else text, np.uint8)


def signed(hashes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(hashes, np.uint64).view(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, so that very long texts never meet in large number."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_groups(batches: Iterator[pa.RecordBatch], text_column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices whose texts hold about ``most_bytes`` together; one longer text is a slice of its own."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def row_groups(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Like ``in_groups``, for batches whose first column is a struct with the text among its fields."""
    for batch in batches:
        sized = pa.RecordBatch.from_arrays([batch.column(0).field(text), pa.array(np.arange(batch.num_rows))], ["text", "at"])
        for part in in_groups([sized], 0, most_bytes):
            yield batch.slice(part.column(1)[0].as_py(), part.num_rows)


def lean(work):
    """A function of batches that gives memory back to the system when a task is over, as workers serve many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return run


def by_row(key: str, text: str = "text") -> tuple[Column, Column]:
    """Two columns that name a document row: its id (NULL below all ids) and a hash of its text.

    Rows that agree in both are copies of one row, and every decision holds for all of them.
    """
    return (
        F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))).alias("_doc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text"),
    )


def ship(spark) -> None:
    """Send this package to Python workers once a session, for those that cannot import it."""
    if spark.conf.get("spark.sievework.shipped", "") != spark.sparkContext.applicationId:
        root = Path(__file__).resolve().parents[1]
        packed = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
        with zipfile.ZipFile(packed, "w") as file:
            for source in sorted(root.rglob("*.py")):
                file.write(source, source.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(packed))
        spark.conf.set("spark.sievework.shipped", spark.sparkContext.applicationId)


def discard(spark, path: str) -> None:
    """Delete a staged folder that later steps no longer read."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def read(spark, folder: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")
