"""Suffix-array dedup: every byte covered by a 100-byte string that starts earlier goes.

Texts are UTF-8 bytes; earlier means a smaller document (id, then text hash), or
the same document and a smaller start. Strings are judged on the input.

1. Every 100-byte window is filed under its least SEED-byte string (leftmost of
   equals), which depends on the window alone. Neighbouring windows with the same
   one form a stretch; equal windows of any two documents lie in stretches filed
   alike. Stretches filed alone are unique and end here.
2. Of equal stretches only the earliest goes on, the others are removed whole, so
   a passage that a third of all documents share costs one stretch.
3. Remaining stretches are dealt by the string they are filed under to shards.
   The windows of a string with very many different stretches meet by a 128-bit
   hash of their bytes instead, at the earliest of each kind; all others go, and
   no window of such a string comes to a shard.
4. A shard is one text whose suffixes are put in order by external induced
   sorting (see induced_sort); common prefixes of neighbours in that order, up
   to 100 bytes, give the groups of equal windows. All but the earliest of a
   group are removed.

NULL and empty texts have nothing to remove, nor do texts under 100 bytes. Rows
that agree in id and text are one document and lose the same bytes. NULL ids
come first. Other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import words as W
from sievework.llm.induced_sort import QUEUE_BYTES, suffix_order
from sievework.operators.joins import lookup_join
from sievework.session import scratch_path, staged

LENGTH = 100
SEED = 36
#: A window holds this many bytes on one side of its filing string at least.
SIDE = (LENGTH - SEED) // 2
SHARD_BYTES = 3 << 20
#: Different stretches under one string from which on their windows are grouped by their bytes.
HOT = 4_096
SEGMENT = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)


def stretches(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Filing hash, content hash, start, length in bytes and place of the filing string of the stretches of a text."""
    found = [_stretches(data[a : a + SEGMENT + LENGTH - 1], a) for a in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT)]
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(none, *found))


def _stretches(data: np.ndarray, offset: int):
    n = len(data) - LENGTH + 1
    sums = W.prefix_sums(W._BYTE[data])
    at = np.arange(len(data) - SEED + 1)
    seeds = W.range_hashes(sums, at, at + SEED)
    least = (seeds & ~_PLACE) | at.astype(np.uint64)
    width, span = LENGTH - SEED + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    where = (least & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(where, prepend=-1))
    last = np.append(first[1:], n)
    size = last - first + LENGTH - 1
    return seeds[where[first]], W.range_hashes(sums, first, first + size), first + offset, size, where[first] - first


def _filed(bodies: DataFrame) -> DataFrame:
    def file(batches):
        for batch in W.in_groups(batches, 2, 1 << 20):
            found = [stretches(W.raw(t)) for t in batch.column(2).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            seed, content, start, size, place = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(W.signed(seed)), pa.array(W.signed(content)), batch.column(0).take(row), batch.column(1).take(row), pa.array(start), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32))],
                ["seed", "content", "_doc", "_text", "start", "size", "place"],
            )

    return bodies.mapInArrow(file, "seed bigint, content bigint, _doc bigint, _text bigint, start bigint, size int, place int")


def _with_bytes(bodies: DataFrame, chosen: DataFrame) -> DataFrame:
    """``shard_key, _doc, _text, start, place, bytes`` of the chosen stretches (seed, at, size, place, hot).

    A hot stretch becomes one row per window, with place -1 and a 128-bit hash as its bytes.
    """
    lists = chosen.groupBy("at._doc", "at._text").agg(F.collect_list(F.struct("seed", "at.start", "size", "place", "hot")).alias("wanted"))
    found = bodies.join(staged(lists, "wanted"), ["_doc", "_text"]).drop_duplicates(["_doc", "_text"])

    def cut(batches):
        for batch in W.pieces(batches, 16):
            keys, docs, ties, starts, places, parts = [], [], [], [], [], []

            def add(key, doc, tie, start, place, part):
                keys.append(key)
                docs.append(doc)
                ties.append(tie)
                starts.append(start)
                places.append(place)
                parts.append(part)

            for doc, tie, text, wanted in zip(*[c.to_pylist() for c in batch.columns]):
                data = text.encode()
                for w in wanted:
                    start, size = w["start"], w["size"]
                    if not w["hot"]:
                        add(w["seed"], doc, tie, start, w["place"], data[start : start + size])
                        continue
                    for s in range(start, start + size - LENGTH + 1):
                        add(w["seed"], doc, tie, s, -1, hashlib.blake2b(data[s : s + LENGTH], digest_size=16).digest())
                    if len(keys) > 50_000:
                        yield _rows(keys, docs, ties, starts, places, parts)
                        for x in (keys, docs, ties, starts, places, parts):
                            x.clear()
            if keys:
                yield _rows(keys, docs, ties, starts, places, parts)

    return found.select("_doc", "_text", "body", "wanted").mapInArrow(cut, "shard_key bigint, _doc bigint, _text bigint, start bigint, place int, bytes binary")


def _rows(keys, docs, ties, starts, places, parts) -> pa.RecordBatch:
    columns = [*[pa.array(x, pa.int64()) for x in (keys, docs, ties, starts)], pa.array(places, pa.int32()), pa.array(parts, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["shard_key", "_doc", "_text", "start", "place", "bytes"])


def with_company(parts: list[bytes], place: np.ndarray) -> np.ndarray:
    """Which stretches can share a window with another one.

    A window holds its filing string with SIDE bytes before it or SIDE bytes
    behind it; a stretch that shares neither with another has no equal window.
    Stretches without a place (-1) stay.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(sizes) - sizes
    sums = W.prefix_sums(W._BYTE[np.frombuffer(b"".join(parts), np.uint8)])
    keep = place < 0
    for low, high in ((-SIDE, SEED), (0, SEED + SIDE)):
        real = np.flatnonzero((place + low >= 0) & (place + high <= sizes) & (place >= 0))
        at = begin[real] + place[real]
        _, group, times = np.unique(W.range_hashes(sums, at + low, at + high), return_inverse=True, return_counts=True)
        keep[real] |= times[group] > 1
    return keep


def repeated_windows(parts: list[bytes], order_key: np.ndarray, length: int = LENGTH, budget: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(part, offset) of every window of ``length`` bytes that is not the earliest of its kind.

    ``order_key``: an integer row per part (document, tie, start); the earliest window has the least of it plus its offset.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    joined = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.uint16)  # a zero ends each part
    part = np.repeat(np.arange(len(parts)), sizes)
    within = np.arange(len(joined)) - (np.cumsum(sizes) - sizes)[part]
    text[begin[part] + within] = joined.astype(np.uint16) + 1
    order = suffix_order(text, budget)
    owner = np.searchsorted(begin, order, "right") - 1
    whole = order - begin[owner] <= sizes[owner] - length
    order, owner = order[whole], owner[whole]
    same = _common(text, order, length)
    group = np.cumsum(~same)
    offset = order - begin[owner]
    rank = np.lexsort((order_key[owner, 2] + offset, order_key[owner, 1], order_key[owner, 0], group))
    later = np.concatenate(([False], group[rank][1:] == group[rank][:-1]))
    gone = rank[later]
    return owner[gone], offset[gone]


def _common(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares ``length`` symbols with the one before it; whole machine words at a time."""
    same = np.zeros(len(order), bool)
    padded = np.concatenate((text, np.zeros(4, np.uint16))).view(np.uint8)
    four = np.lib.stride_tricks.as_strided(padded, (len(text) + 1, 8), (2, 1), writeable=False)
    left = np.arange(1, len(order))
    for at in [*range(0, length - 3, 4), length - 4]:
        a = np.ascontiguousarray(four[order[left] + at]).view(np.uint64).ravel()
        b = np.ascontiguousarray(four[order[left - 1] + at]).view(np.uint64).ravel()
        left = left[a == b]
    same[left] = True
    return same


def _runs(start: np.ndarray, doc: np.ndarray, tie: np.ndarray):
    """Windows of one document that start next to each other, as intervals of bytes."""
    order = np.lexsort((start, tie, doc))
    start, doc, tie = start[order], doc[order], tie[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] != start[:-1] + 1)))[: len(start)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return doc[first], tie[first], start[first], start[last[: len(first)]] + LENGTH


def _later_windows(windows: DataFrame) -> DataFrame:
    """Intervals of the hot windows (_doc, _text, start, bytes) that are not the earliest of their kind.

    Kinds are combined before the shuffle, and rows of a hot kind meet its
    earliest place where they lie, so a window of all documents fills no task.
    """
    at = F.struct("_doc", "_text", "start")
    kinds = windows.groupBy("bytes").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("times")).where("times > 1").select("bytes", "at")
    later = lookup_join(windows, kinds, "bytes").where(at != F.col("at"))
    return later.select("_doc", "_text", "start", (F.col("start") + LENGTH).alias("end"))


def _sorted_shards(rows: DataFrame, shards: int) -> DataFrame:
    """Removed intervals from the suffix array of each shard."""

    def sort(batches):
        keys, parts = [], []
        for batch in batches:
            keys.append(np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3, 4)]))
            parts += batch.column(5).to_pylist()
        if not parts:
            return
        place = np.concatenate(keys)
        keep = np.flatnonzero(with_company(parts, place[:, 3]))
        if not len(keep):
            return
        place, parts = place[keep], [parts[i] for i in keep.tolist()]
        owner, offset = repeated_windows(parts, place)
        doc, tie, start, end = _runs(place[owner, 2] + offset, place[owner, 0], place[owner, 1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, tie, start, end)], ["_doc", "_text", "start", "end"])

    dealt = rows.repartition(shards, "shard_key")
    return dealt.mapInArrow(sort, "_doc bigint, _text bigint, start bigint, end bigint")


def removed_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_doc, _text, ranges``: the byte ranges (start, end) to remove, per document row that loses any; they may overlap."""
    W.ship(docs.sparkSession)
    bodies = docs.select(*W.by_row(key, text), F.col(text).alias("body"))
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "filed")
    _filed(bodies).write.parquet(path)
    filed = spark.read.parquet(path)
    shared = filed.groupBy("seed").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("seed")
    met = staged(filed.join(shared, "seed"), "met")
    W.discard(spark, path)  # most stretches are filed alone and end here
    first = met.groupBy("seed", "content", "size").agg(F.min(F.struct("_doc", "_text", "start")).alias("at"), F.any_value("place").alias("place"), F.count(F.lit(1)).alias("times"))
    first = staged(first, "first")
    again = met.join(first.where("times > 1").drop("place"), ["seed", "content", "size"])
    again = again.where(F.struct("_doc", "_text", "start") != F.col("at")).select("_doc", "_text", "start", (F.col("start") + F.col("size")).alias("end"))
    kinds = first.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("seed", (F.col("kinds") > HOT).alias("hot"))
    chosen = first.join(kinds, "seed").select("seed", "at", "size", "place", "hot")
    rows = staged(_with_bytes(bodies, chosen), "stretches")
    windows = rows.where("place < 0").select("_doc", "_text", "start", "bytes")
    rows = rows.where("place >= 0")
    total = rows.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    ranges = again.union(_later_windows(windows)).union(_sorted_shards(rows, shards))
    return ranges.groupBy("_doc", "_text").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def kept_bytes(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, the number of bytes removed, and the number of maximal removed runs."""
    if not ranges:
        return data, 0, 0
    change = np.zeros(len(data) + 1, np.int64)
    places = np.array(ranges, np.int64)
    np.add.at(change, places[:, 0], 1)
    np.add.at(change, places[:, 1], -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (all columns of docs), ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``n_spans``."""
    removed = staged(removed_ranges(docs, key, text), "ranges")
    plain = docs.select(*W.by_row(key, text), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("body"))
    joined = plain.join(removed, ["_doc", "_text"], "left").select("row", "body", "ranges")

    def rewrite(batches):
        for batch in W.pieces(batches):
            bodies = [(b or "").encode() for b in batch.column(1).to_pylist()]
            done = [kept_bytes(b, [(r["start"], r["end"]) for r in ranges or ()]) for b, ranges in zip(bodies, batch.column(2).to_pylist())]
            numbers = [pa.array(x, pa.int64()) for x in ([len(b) for b in bodies], [d[1] for d in done], [d[2] for d in done])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.binary()), *numbers], ["row", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(rewrite, f"row {joined.schema['row'].dataType.simpleString()}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


def op1_suffix_dedup(spark, folder: str) -> DataFrame:
    done = dedup_substrings(W.read(spark, folder, "documents").select("doc_id", "text"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
