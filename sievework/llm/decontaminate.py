"""Benchmark decontamination by q-gram lemma filtering.

Benchmark texts and documents are compared with A-Z lower-cased and white space
runs as one space. A benchmark text of any length is a probe as a whole; of one
with more than PROBE characters each part of PROBE characters, from every place
on, is a probe too, so a leaked part is found wherever it was cut. A probe of m characters with k = m * EDIT_PERCENT // 100 edits keeps at least
m + 1 - q (k + 1) of its q-grams, on diagonals at most 2 k apart. So q-grams
shared with a document are counted in overlapping diagonal bands, over the whole
text; the parts of a band that reach the bound are verified by banded alignment,
all places of a text at once; a part whose q-grams all lie in a row on one
diagonal is there without an edit and needs none. A text that matches as a whole is reported so.

Probes shorter than SHORT characters allow no edit; those shorter than q are
looked up as they are, between characters that are no letters or digits. NULL, empty and blank benchmark texts match nothing, nor
do NULL or empty documents. Repeated benchmark rows give one match per item id.
The benchmark is broadcast in blocks of a fixed size; each block sees all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import words as W

Q = 12
EDIT_PERCENT = 5
PROBE, SHORT = 128, 40
#: Characters of benchmark text broadcast at once.
BLOCK_CHARS = 4_000_000
SEGMENT = 1 << 20


def normal(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the compared form and the place of each in the text."""
    points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    follows = np.concatenate(([True], blank[:-1])) if len(points) else blank
    at = np.flatnonzero(~(blank & follows))
    kept = np.where(blank[at], np.uint32(0x20), points[at])
    kept = np.where((kept >= 65) & (kept <= 90), kept + np.uint32(32), kept)
    if len(kept) and kept[-1] == 0x20:
        kept, at = kept[:-1], at[:-1]
    return kept, at


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams."""
    if len(points) < q:
        return np.zeros(0, np.uint64)
    at = np.arange(len(points) - q + 1)
    return W.range_hashes(W.prefix_sums(W.mix(points.astype(np.uint64) + np.uint64(1))), at, at + q)


class Probes:
    """The q-gram index over a block of benchmark texts: whole ones, then those whose parts of PROBE characters count."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [(i, p) for i, p in ((i, normal(t)[0]) for i, t in items) if len(p)]
        whole = [(n, len(p)) for n, (_, p) in enumerate(texts)]
        parts = [(n, PROBE) for n, (_, p) in enumerate(texts) if len(p) > PROBE]
        self.text = [n for n, _ in whole + parts]
        self.span = np.array([m for _, m in whole + parts], np.int64)
        self.item = [texts[n][0] for n in self.text]
        self.points = [texts[n][1] for n in self.text]
        self.edits = [m * EDIT_PERCENT // 100 if m >= SHORT else 0 for m in self.span.tolist()]
        grams = [_grams(p, Q) for p in self.points]
        hashes = np.concatenate([np.zeros(0, np.uint64), *grams])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.zeros(0, int)
        place = np.concatenate([np.zeros(0, int), *[np.arange(len(g)) for g in grams]])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], owner[order].astype(np.int64), place[order].astype(np.int64)
        self.least = np.array([m + 1 - Q * (k + 1) for m, k in zip(self.span.tolist(), self.edits)], np.int64)
        self.step = np.array([2 * k + 1 for k in self.edits], np.int64)
        self.tiny = [i for i, p in enumerate(self.points) if len(p) < Q]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.hashes >> np.uint64(42)] = True
        self.reach = max(self.span.tolist(), default=0) + 4 * max(self.step.tolist(), default=0) + Q

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the best match of each item, as places in the text; the end is exclusive."""
        points, at = normal(text)
        texts: dict[int, tuple[bool, int, int, int]] = {}
        for start in range(0, max(len(points), 1), SEGMENT):
            part = points[start : start + SEGMENT + self.reach]
            bands, exact = self._bands(part)
            found_at = [(p, found) for p, found in exact.items()]
            found_at += [(p, self._align(p, band, places, part)) for p, band, places in bands if p not in exact]
            for probe, found in found_at:
                if found:
                    cut = int(self.span[probe]) < len(self.points[probe])
                    new = cut, found[2], found[0] + start, found[1] + start
                    text = self.text[probe]
                    if text not in texts or new[:3] < texts[text][:3]:
                        texts[text] = new
        names = dict(zip(self.text, self.item))
        best: dict[int, tuple[int, int, int]] = {}
        for text, (_, edits, s, e) in texts.items():
            old = best.get(names[text])
            if old is None or (edits, s) < (old[2], old[0]):
                best[names[text]] = (s, e, edits)
        return sorted((item, int(at[s]), int(at[e - 1]) + 1, edits) for item, (s, e, edits) in best.items())

    def _bands(self, points: np.ndarray) -> tuple[list[tuple[int, int, np.ndarray]], dict[int, tuple[int, int, int]]]:
        """(probe, band, places of the probe's parts) that hold enough shared q-grams; band j covers diagonals j * step to (j + 2) * step.

        Also (start, end, 0) of each probe's first part that is there without an edit.
        """
        grams = _grams(points, Q)
        near = np.flatnonzero(self.seen[grams >> np.uint64(42)])
        low, high = (np.searchsorted(self.hashes, grams[near], side) for side in ("left", "right"))
        times = high - low
        hit = np.repeat(near, times)
        entry = np.repeat(low - np.cumsum(times) + times, times) + np.arange(len(hit))
        probe, place = self.owner[entry], self.place[entry]
        exact = self._exact(points, probe, place, hit - place)
        band = (hit - place) // self.step[probe]
        both = np.concatenate((band, band - 1))
        probe, place = np.tile(probe, 2), np.tile(place, 2)
        order = np.lexsort((place, both, probe))
        probe, both, place = probe[order], both[order], place[order]
        new = np.concatenate(([True], (probe[1:] != probe[:-1]) | (both[1:] != both[:-1]) | (place[1:] != place[:-1])))[: len(probe)]
        probe, both, place = probe[new], both[new], place[new]
        # a part holds enough q-grams if the place of one and that of the last needed after it both lie in it
        first = np.arange(len(probe))
        last = first + np.maximum(self.least[probe], 1) - 1
        first, last = first[last < len(probe)], last[last < len(probe)]
        room = self.span[probe[first]] - Q
        enough = (probe[first] == probe[last]) & (both[first] == both[last]) & (place[last] - place[first] <= room)
        first, last, room = first[enough], last[enough], room[enough]
        probe, both = probe[first], both[first]
        low, high = np.maximum(place[last] - room, 0), place[first]
        ends = np.flatnonzero(np.concatenate(((probe[1:] != probe[:-1]) | (both[1:] != both[:-1]), [True])))[: len(probe)]
        found, at = [], 0
        for end in (ends + 1).tolist():
            p = int(probe[at])
            change = np.zeros(len(self.points[p]) + 2, np.int64)
            np.add.at(change, low[at:end], 1)
            np.add.at(change, high[at:end] + 1, -1)
            places = np.flatnonzero(np.cumsum(change) > 0)
            found.append((p, int(both[at]), places[places <= len(self.points[p]) - self.span[p]]))
            at = end
        for probe in self.tiny:
            own = self.points[probe]
            at = np.flatnonzero(points[: max(0, len(points) - len(own) + 1)] == own[0])
            ends = at + len(own)
            apart = [p for p, e in zip(at.tolist(), ends.tolist()) if np.array_equal(points[p:e], own) and self._apart(points, p, e)]
            exact |= {probe: (p, p + len(own), 0) for p in apart[:1]}
        return found, exact

    @staticmethod
    def _apart(points: np.ndarray, start: int, end: int) -> bool:
        """Whether no letter or digit goes on before the start or after the end where one stands inside."""
        word = lambda i: 0 <= i < len(points) and chr(points[i]).isalnum()
        return not (word(start - 1) and word(start)) and not (word(end - 1) and word(end))

    def _exact(self, points: np.ndarray, probe: np.ndarray, place: np.ndarray, diagonal: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Of every probe with a part that is in the text as it is, the first such place, from runs of q-grams on a diagonal."""
        order = np.lexsort((place, diagonal, probe))
        probe, place, diagonal = probe[order], place[order], diagonal[order]
        last = np.arange(len(probe)) + self.span[probe] - Q  # the part's last q-gram, if all are there
        first = np.flatnonzero(last < len(probe))
        last = last[first]
        whole = (probe[first] == probe[last]) & (diagonal[first] == diagonal[last]) & (place[last] - place[first] == self.span[probe[first]] - Q)
        out: dict[int, tuple[int, int, int]] = {}
        for i in first[whole][np.lexsort(((place + diagonal)[first[whole]], probe[first[whole]]))].tolist():
            p, s, m = int(probe[i]), int(place[i] + diagonal[i]), int(self.span[probe[i]])
            if p not in out and np.array_equal(points[s : s + m], self.points[p][place[i] : place[i] + m]):
                out[p] = s, s + m, 0
        return out

    def _align(self, probe: int, band: int, places: np.ndarray, points: np.ndarray) -> tuple[int, int, int] | None:
        """Banded alignment of the parts at these places: (start, end, edits) of the best one within its budget, the earliest of equals."""
        own, k, step, span = self.points[probe], self.edits[probe], int(self.step[probe]), int(self.span[probe])
        low, width = band * step - k, 2 * step + 2 * k + 1
        text = np.zeros(len(own) + width, np.uint32)
        a, b = max(low, 0), min(len(points), low + len(text))
        if a < b:
            text[a - low : b - low] = points[a:b]
        near = np.lib.stride_tricks.sliding_window_view(text, width)
        best = None
        for at in range(0, len(places), 2048):  # places of one probe
            some = places[at : at + 2048]
            cost, _ = self._costs(own, span, near, some, None)
            least = cost.min(1)
            limit = k if best is None else best[2]
            some = some[(least <= limit) & (least == least.min())]
            if not len(some):
                continue
            cost, begin = self._costs(own, span, near, some, low)
            end = cost.argmin(1)
            row = np.arange(len(some))
            start = np.maximum(begin[row, end], 0)
            stop = np.minimum(low + some + span + end, len(points))
            for s, e, edits in zip(start.tolist(), stop.tolist(), cost[row, end].tolist()):
                if s < e and (best is None or (edits, s) < (best[2], best[0])):
                    best = s, e, edits
        return best

    @staticmethod
    def _costs(own: np.ndarray, span: int, near: np.ndarray, places: np.ndarray, low: int | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Edits of each part (row) by the diagonal where it ends, and, given the lowest diagonal, where it begins in the document."""
        width = near.shape[1]
        kind = np.int16 if span + 2 * width < 1 << 14 else np.int32
        steps = np.arange(width, dtype=kind)
        far = kind(span + 1)
        cost = np.zeros((len(places), width), kind)
        skip = np.full_like(cost, far)
        begin = None if low is None else places[:, None] + low + np.arange(width)
        for i in range(span):
            match = cost + (near[places + i] != own[places + i, None])
            skip[:, :-1] = cost[:, 1:] + kind(1)
            value = np.minimum(match, skip) - steps
            floor = np.minimum.accumulate(value, axis=1)
            if begin is not None:
                source = np.where(match <= skip, begin, np.concatenate((begin[:, 1:], begin[:, -1:]), axis=1))
                origin = np.maximum.accumulate(np.where(value == floor, steps, kind(-1)), axis=1)
                begin = np.take_along_axis(source, origin.astype(np.int64), axis=1)
            cost = floor + steps
        return cost, begin


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of docs) and ``leaks``: item id, start, end and edits of every benchmark text found."""
    W.ship(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS) or 1
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.array().cast("array<struct<item_id:bigint,start:bigint,end:bigint,edits:int>>").alias("leaks"))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        out = _with_block(out, [(r[0], r[1]) for r in own.distinct().collect()], text)
    return out


def _with_block(rows: DataFrame, items: list[tuple[int, str]], text: str) -> DataFrame:
    probes = rows.sparkSession.sparkContext.broadcast(sorted(items))
    leak = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))

    def search(batches):
        index = Probes(probes.value)
        for batch in W.row_groups(batches, text):
            bodies = batch.column(0).field(text).to_pylist()
            found = [
                (old or []) + [dict(zip(("item_id", "start", "end", "edits"), m)) for m in index.matches(body)]
                for old, body in zip(batch.column(1).to_pylist(), bodies)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, leak)], ["row", "leaks"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, leaks {rows.schema['leaks'].dataType.simpleString()}"
    return rows.mapInArrow(W.lean(search), schema)


def op5_decontaminate(spark, folder: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    found = find_leaks(W.read(spark, folder, "documents").select("doc_id", "text"), W.read(spark, folder, "benchmark"))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def decontaminate_stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in which no benchmark text was found."""
    return find_leaks(docs, W.read(spark, folder, "benchmark")).where(F.size("leaks") == 0).select("row.*")
