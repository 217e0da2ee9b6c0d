"""Suffix order by external induced sorting.

Suffixes are sorted from a sorted few: the left-most-S suffixes induce the
larger-first (L) suffixes in an ascending sweep and those the smaller-first (S)
suffixes in a descending one; the few are sorted by a string of their names, half as
long or less: by the same routine, or in memory by doubled prefixes where that
string is short. A sweep is a monotone priority queue of
(symbol, suffix) tuples. Its far buckets go to disk when they exceed a budget,
and tuples are taken in whole batches: as many as cannot be preceded by a tuple
that they induce themselves.
"""

from __future__ import annotations

import tempfile

import numpy as np

from sievework.llm import words as W

BUCKETS = 512
LOOK = 1 << 14
QUEUE_BYTES = 64 << 20
#: Names that are sorted in memory, a few arrays of 8 bytes each; sweeps over short strings cost more than they move.
SHORT = 1 << 20
_NEVER = np.iinfo(np.int64).max


class BatchQueue:
    """Monotone queue of (key, suffix): sorted by key, first in first out among equal keys."""

    def __init__(self, most: int, budget: int = QUEUE_BYTES):
        self.span = max(1, -(-(most + 1) // BUCKETS))
        self.held: list[list] = [[] for _ in range(most // self.span + 1)]
        self.at, self.high = -1, 0
        self.keys, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.budget, self.bytes, self.file = budget, 0, None

    def push(self, keys: np.ndarray, ids: np.ndarray) -> None:
        near = keys < self.high
        if near.any():
            place = np.searchsorted(self.keys, keys[near], "right")
            order = np.argsort(keys[near], kind="stable")
            self.keys = np.insert(self.keys, place[order], keys[near][order])
            self.ids = np.insert(self.ids, place[order], ids[near][order])
            keys, ids = keys[~near], ids[~near]
        if not len(keys):
            return
        bucket = keys // self.span
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], np.stack((keys[order], ids[order]))
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)]):
            self.held[bucket[a]].append(rows[:, a:b])
            self.bytes += 16 * (b - a)
        if self.bytes > self.budget:
            self._spill()

    def _spill(self) -> None:
        """Write the farther half of the buckets to the queue's file."""
        self.file = self.file or tempfile.TemporaryFile()
        for bucket in range(len(self.held) - 1, self.at, -1):
            kept = []
            for part in self.held[bucket]:
                if isinstance(part, np.ndarray):
                    place = self.file.seek(0, 2)
                    self.file.write(np.ascontiguousarray(part).tobytes())
                    self.bytes -= part.nbytes
                    part = (place, part.shape[1])
                kept.append(part)
            self.held[bucket] = kept
            if self.bytes < self.budget // 2:
                break

    def _load(self, part) -> np.ndarray:
        if isinstance(part, np.ndarray):
            self.bytes -= part.nbytes
            return part
        self.file.seek(part[0])
        return np.frombuffer(self.file.read(16 * part[1]), np.int64).reshape(2, -1)

    def front(self) -> bool:
        """Make the least tuples available as ``keys`` and ``ids``; False when the queue is empty."""
        while not len(self.keys):
            self.at += 1
            if self.at >= len(self.held):
                if self.file:
                    self.file.close()
                return False
            self.high = (self.at + 1) * self.span
            if self.held[self.at]:
                rows = np.concatenate([self._load(p) for p in self.held[self.at]], 1)
                self.held[self.at] = []
                order = np.argsort(rows[0], kind="stable")
                self.keys, self.ids = rows[0][order], rows[1][order]
        return True

    def take(self, n: int) -> None:
        self.keys, self.ids = self.keys[n:], self.ids[n:]


def _sweep(seed_keys, seeds, key_of, allowed, budget) -> np.ndarray:
    """All suffixes in the order in which the queue gives them; each induces the one before it where that is allowed."""
    queue, out = BatchQueue(int(key_of.max(initial=0)) + 1, budget), []
    queue.push(seed_keys, seeds)
    while queue.front():
        keys, ids = queue.keys[:LOOK], queue.ids[:LOOK]
        before = ids - 1
        induces = (before >= 0) & allowed[before]
        target = np.where(induces, key_of[before], _NEVER)
        late = keys[1:] > np.minimum.accumulate(target)[:-1]
        n = int(late.argmax()) + 1 if late.any() else len(keys)
        out.append(ids[:n])
        queue.take(n)
        mine = induces[:n]
        queue.push(target[:n][mine], before[:n][mine])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _induce(text, is_s, seeds, budget) -> np.ndarray:
    """Order of all suffixes from that of the given left-most-S suffixes."""
    most, n = int(text.max()), len(text)
    up = 2 * text
    first = np.array([n - 1]) if n else np.zeros(0, np.int64)
    seeds = seeds[np.argsort(text[seeds], kind="stable")]
    # the last suffix is induced by the end of the text, which is less than all else: it is the first of its bucket
    sweep = _sweep(np.concatenate((up[first], up[seeds] + 1)), np.concatenate((first, seeds)), up, ~is_s, budget)
    larger = sweep[~is_s[sweep]][::-1]
    down = 2 * (most - text)
    return _sweep(down[larger] + 1, larger, down, is_s, budget)[::-1]


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a string of names below its length, by ranks of prefixes that double in length.

    Only suffixes that share their rank with another one are ranked again.
    """
    n, width = len(names), 1
    rank = names.astype(np.int64)
    at = np.arange(n)
    while len(at):
        behind = at + width
        following = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + following
        order = np.argsort(key)
        at, key = at[order], key[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        within = np.cumsum(fresh) - 1
        starts = np.flatnonzero(fresh)
        old = rank[at]
        # ranks of a group are those of its first place on: its old rank and how many of it come before
        group = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
        first = np.repeat(group, np.diff(np.append(group, len(at))))
        rank[at] = old + starts[within] - first
        single = np.concatenate((fresh[1:], [True])) & fresh
        at = at[~single]
        width *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _by_names(names: np.ndarray, budget: int, short: int) -> np.ndarray:
    if len(names) > short:
        return suffix_order(names, budget, short)
    return _doubled((np.cumsum(np.bincount(names)) - np.bincount(names))[names])


def suffix_order(text: np.ndarray, budget: int = QUEUE_BYTES, short: int = SHORT) -> np.ndarray:
    """Starts of all suffixes of a sequence of integers >= 0, ascending; a prefix comes before what it is a prefix of.

    Up to ``short`` names are sorted in memory.
    """
    text = np.asarray(text, np.int64)
    n = len(text)
    if n < 2:
        return np.arange(n)
    change = np.flatnonzero(text[1:] != text[:-1])
    rising = np.append(text[change + 1] > text[change], False)
    is_s = np.repeat(rising, np.diff(np.concatenate(([-1], change, [n - 1]))))
    few = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(few) > 1:
        order = _induce(text, is_s, few, budget)
        marked = np.zeros(n, bool)
        marked[few] = True
        order = order[marked[order]]
        end = np.append(few[1:] + 1, n)[np.searchsorted(few, order)]
        hashes = W.range_hashes(W.prefix_sums(W.mix(text.astype(np.uint64) + np.uint64(1))), order, end)
        hashes[end == n] = np.uint64(0)  # runs into the end of the text: like no other
        named = np.cumsum(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (end[1:] - order[1:] != end[:-1] - order[:-1])))) - 1
        names = np.empty(len(few), np.int64)
        names[np.searchsorted(few, order)] = named
        few = order if named[-1] == len(few) - 1 else few[_by_names(names, budget, short)]
    return _induce(text, is_s, few, budget)
