"""Line dedup by a deletion-neighbourhood join.

Lines are compared as word sequences. A line goes if an earlier line (smaller
document id, then text hash, then line number) has the same words, or, for
lines of ``MIN_WORDS`` words and more, lies within one inserted, deleted or
replaced word of it. Lines are judged on the input, not on what is left.

Equal lines meet by a hash of their words. For the edit bound every line emits
its one-word deletions as hashed keys: equal keys for the same length and place
are one replacement, a deletion that equals a whole line is one insertion, and
every pair is verified on its words. Only lines that share one half with
another line emit anything, since one edit leaves one half as it is; and then
only deletions in the other half.

NULL and empty texts and lines without words stay. Rows that agree in id and
text are one document and keep the same lines. NULL ids come first. Columns of
other names pass through; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import words as W
from sievework.operators.joins import fits_broadcast
from sievework.session import staged

MIN_WORDS = 8
_PLACE = 0xA0761D6478BD642F
_ROWS = 1_000_000


def _tag(hashes, number, kind: int) -> np.ndarray:
    """A key of its own for each hash, length or place, and kind."""
    spread = np.atleast_1d(np.asarray(number, np.uint64)) * np.uint64(_PLACE) + np.uint64(kind)
    return W.mix(hashes ^ W.mix(spread))


def _half_keys(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Four keys per word range: its halves as a line of n words, and as the longer partner of a line of n - 1."""
    keys = []
    for less in (0, 1):
        m = end - start - less
        half = m // 2
        keys.append(_tag(W.range_hashes(sums, start, start + half), m, 1))
        keys.append(_tag(W.range_hashes(sums, end - (m - half), end), m, 2))
    return keys


class _Lines:
    """The lines with words of some texts: text index, line number, and the range of their words."""

    def __init__(self, texts: list[str | None]):
        whole = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"\n".join(whole), np.uint8)
        begin, _, self.words = W.word_hashes(data)
        self.sums = W.prefix_sums(self.words)
        breaks = np.flatnonzero(data == 10)
        at = np.cumsum([0, *[len(t) + 1 for t in whole]])[:-1]
        line = np.searchsorted(breaks, begin)
        self.start = np.flatnonzero(np.diff(line, prepend=-1))
        self.end = np.append(self.start[1:], len(line))[: len(self.start)]
        self.text = np.searchsorted(at, begin[self.start], "right") - 1
        self.number = line[self.start] - np.searchsorted(breaks, at)[self.text]

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """The half keys, a row per line, and which of them count."""
        n = self.end - self.start
        return np.stack(_half_keys(self.sums, self.start, self.end), 1), np.stack([n >= MIN_WORDS] * 2 + [n > MIN_WORDS] * 2, 1)


def _lines(docs: DataFrame) -> DataFrame:
    def lines(batches):
        for batch in W.in_groups(batches, 2, 1 << 20):
            found = _Lines(batch.column(2).to_pylist())
            whole = W.range_hashes(found.sums, found.start, found.end)
            other = W.range_hashes(W.prefix_sums(W.mix(found.words)), found.start, found.end)
            keys, real = found.halves()
            ends = np.concatenate(([0], np.cumsum(real.sum(1)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(W.signed(keys[real])))
            row = pa.array(found.text)
            columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(found.number.astype(np.int32)), pa.array(W.signed(whole)), pa.array(W.signed(other)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["_doc", "_text", "line", "h", "g", "halves"])

    return docs.mapInArrow(W.lean(lines), "_doc bigint, _text bigint, line int, h bigint, g bigint, halves array<bigint>")


def _deletions(docs: DataFrame) -> DataFrame:
    """Keys of the listed lines: 0 a deletion with its place, 1 the whole line, 2 a deletion."""

    def variants(batches):
        for batch in W.in_groups(batches, 2, 1 << 18):
            docs, ties, texts, listed = (c.to_pylist() for c in batch.columns)
            wanted = {(t, x["line"]): np.array(x["halves"], np.int64).view(np.uint64) for t, xs in enumerate(listed) for x in xs}
            found = _Lines(texts)
            keys_of, real = found.halves()
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for at, place in enumerate(zip(found.text.tolist(), found.number.tolist())):
                if place not in wanted:
                    continue
                s, e = int(found.start[at]), int(found.end[at])
                n = e - s
                live = np.isin(keys_of[at], wanted[place]) & real[at]
                where = np.zeros(n, bool)
                for less in (0, 1):
                    m = n - less
                    if live[2 * less]:
                        where[m // 2 :] = True  # the first half is shared: the edit lies behind it
                    if live[2 * less + 1]:
                        where[: n - (m - m // 2)] = True
                j = np.flatnonzero(where)
                gone = _without(found.sums, s, e, j, 1)
                every = np.arange(n + 1)
                keys = np.concatenate((_tag(gone, n * 1_000_003 + j, 3), _tag(_without(found.sums, s, e, every, 0), every, 4), _tag(gone, j, 4)))
                out[0].append(W.signed(keys))
                out[1].append(np.repeat(np.array([0, 1, 2], np.int8), (len(j), n + 1, len(j))))
                for column, value in zip(out[2:], (docs[place[0]], ties[place[0]], place[1])):
                    column.append(np.full(len(keys), value, np.int64))
            if out[0]:
                columns = [np.concatenate(c) for c in out]
                columns[4] = columns[4].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "kind", "_doc", "_text", "line"])

    return docs.mapInArrow(W.lean(variants), "key bigint, kind tinyint, _doc bigint, _text bigint, line int")


def _without(sums: np.ndarray, start: int, end: int, at: np.ndarray, words: int) -> np.ndarray:
    """Hashes of a line with ``words`` words taken out at each place; with none taken out, a hole lies there."""
    before = W.range_hashes(sums, np.full(len(at), start), start + at)
    after = W.range_hashes(sums, start + at + words, np.full(len(at), end))
    return W.mix(before * np.uint64(3) + after)


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether at most one word is inserted, deleted or replaced between two lines."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def _attach(docs: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Join by document row: the table is broadcast if it is measured small, else both are shuffled."""
    small = fits_broadcast(table, _ROWS)
    return docs.join(F.broadcast(table) if small else table, ["_doc", "_text"], how)


def _line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Words of the wanted lines (a column ``at``), joined by spaces."""
    lists = wanted.select("at.*").distinct().groupBy("_doc", "_text").agg(F.collect_list("line").alias("lines"))
    bodies = _attach(docs, staged(lists, "wanted"), "inner").drop_duplicates(["_doc", "_text"])

    def texts(batches):
        for batch in W.pieces(batches, 64):
            out = [
                ({"_doc": doc, "_text": tie, "line": i}, b" ".join(lines[i].encode().split()))
                for doc, tie, text, numbers in zip(*[c.to_pylist() for c in batch.columns])
                for lines in [text.split("\n")]
                for i in numbers
            ]
            at = pa.array([x[0] for x in out], pa.struct([("_doc", pa.int64()), ("_text", pa.int64()), ("line", pa.int32())]))
            yield pa.RecordBatch.from_arrays([at, pa.array([x[1] for x in out], pa.binary())], ["at", "words"])

    return bodies.select("_doc", "_text", "body", "lines").mapInArrow(W.lean(texts), "at struct<_doc:bigint,_text:bigint,line:int>, words binary")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The places ``at`` of pairs (at, earlier) whose lines are within the bound."""
    pairs = staged(pairs, "pairs")
    both = pairs.select("at").union(pairs.select(F.col("earlier").alias("at"))).distinct()
    texts = staged(_line_texts(docs, both), "texts")
    mine = pairs.join(texts.withColumnRenamed("words", "a"), "at")
    joined = mine.join(texts.select(F.col("at").alias("earlier"), F.col("words").alias("b")), "earlier").select("at", "a", "b")

    def verify(batches):
        for batch in batches:
            near = [within_one_edit(a.split(), b.split()) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(near, pa.bool_()))], ["at"])

    return joined.mapInArrow(W.lean(verify), "at struct<_doc:bigint,_text:bigint,line:int>").distinct()


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_doc, _text, lines``: the numbers (from 0) of the lines to remove, per document row that loses any."""
    bodies = docs.select(*W.by_row(key, text), F.col(text).alias("body"))
    lines = staged(_lines(bodies), "lines")
    at = F.struct("_doc", "_text", "line")
    first = lines.groupBy("h", "g").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n"))
    halves = lines.select("h", F.explode("halves").alias("half"))
    live = halves.groupBy("half").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("half")
    keyed = halves.join(live, "half").groupBy("h").agg(F.collect_set("half").alias("halves"))
    listed = first.join(keyed, "h").select("at.*", "halves")
    listed = listed.groupBy("_doc", "_text").agg(F.collect_list(F.struct("line", "halves")).alias("listed"))
    near = _attach(bodies, staged(listed, "listed"), "inner").drop_duplicates(["_doc", "_text"])
    keys = staged(_deletions(near.select("_doc", "_text", "body", "listed")), "deletions")
    places = keys.select("key", "kind", at.alias("at"))
    least = [F.min(F.when(F.col("kind") == k, F.col("at"))).alias(f"m{k}") for k in range(3)]
    met = places.groupBy("key").agg(*least, F.max(F.when(F.col("kind") == 0, F.col("at"))).alias("top"))
    met = met.where("m0 < top or (m1 is not null and m2 is not null)").drop("top")
    partner = F.when(F.col("kind") == 0, F.col("m0")).when(F.col("kind") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = places.join(met, "key").select("at", partner.alias("earlier")).where("earlier < at").distinct()
    close = _verified(bodies, pairs).withColumn("close", F.lit(True))
    judged = first.join(close, "at", "left").where("n > 1 or close").select("h", "g", F.col("at").alias("first"), "close")
    gone = lines.join(judged, ["h", "g"]).where((F.col("first") != at) | F.col("close"))
    return gone.groupBy("_doc", "_text").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (all columns of docs, the text without removed lines), ``n_lines`` and ``n_removed``."""
    W.ship(docs.sparkSession)
    removed = staged(removed_lines(docs, key, text), "removed")
    names = docs.columns
    plain = docs.select(*W.by_row(key, text), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = _attach(plain, removed, "left").select("row", "lines")
    schema = f"row {joined.schema['row'].dataType.simpleString()}, n_lines bigint, n_removed bigint"

    def rewrite(batches):
        for batch in W.row_groups(batches, text):
            kept, counts, losses = [], [], []
            rows = batch.column(0)
            for body, gone in zip(rows.field(text).to_pylist(), batch.column(1).to_pylist()):
                parts = body.split("\n") if body else []
                drop = set(gone or ())
                kept.append("\n".join([x for i, x in enumerate(parts) if i not in drop]) if drop else body)
                counts.append(len(parts))
                losses.append(len(drop))
            fields = [pa.array(kept, rows.field(c).type) if c == text else rows.field(c) for c in names]
            arrays = [pa.StructArray.from_arrays(fields, names), pa.array(counts, pa.int64()), pa.array(losses, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "n_lines", "n_removed"])

    return joined.mapInArrow(W.lean(rewrite), schema)


def op10_line_dedup(spark, folder: str) -> DataFrame:
    done = dedup_lines(W.read(spark, folder, "documents").select("doc_id", "text"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"))


def line_stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; a document that loses its last line with words goes."""
    done = dedup_lines(docs)
    left = F.col("row.text").rlike(r"[^\x20\x09-\x0D]")
    return done.where((F.col("n_removed") == 0) | left).select("row.*")
