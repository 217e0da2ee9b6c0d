"""Conversation prefix trie: count-min screening of prefix digests, exact grouping of the rest.

A conversation is first rebuilt: it takes the first turns of the conversation
whose id is the multiple of FAMILY below its own, then its own later ones. A
node is a distinct sequence of first turns.

1. Texts are digested where they lie (MD5 of role and text), and only digests,
   word counts and ids move on. A prefix is known by the sum of the digests of
   its turns, each taken with its place: 128 bits that a running sum gives, so a
   conversation of any length is spread over tasks (see ``running``).
2. Every task counts its prefixes in a count-min sketch of ROWS rows. The sum of
   all sketches never counts too few, so a prefix of estimate one is of one
   conversation only, and so is all that follows. Such tails are emitted where
   they lie.
3. Prefixes that may be shared are grouped exactly, with sums before the
   shuffle. What a node adds to its ancestors (leaves, saved tokens) is carried
   by its smallest member, whose own prefixes are those ancestors: a sum over the
   deeper rows of each such conversation, then one sum per node.
4. The ids that end in a node are sorted in ranges and joined to pieces of text,
   and only pieces come together for the digest, one after the other.

The sketch has COUNTERS counters a prefix and row, up to WIDEST a row (in bits,
8 MB a row): the driver and executors hold that much at most. Beyond, more
prefixes are grouped exactly and results stay the same.

Turns stand in the order of ``turn`` (NULL first), then of their digest. NULL
role or text is empty. Rows without a conversation id belong to none and are left out. Rows
that repeat are turns of their own. A conversation whose rebuilt form has no
turn ends in the root. An empty table has no trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import words as W
from sievework.llm.merkle import CRC_SQL
from sievework.llm.mixing import word_count
from sievework.llm.running import running
from sievework.operators.joins import lookup_join
from sievework.session import staged

FAMILY, HEAD = 20, 4
#: The sketch: rows, counters for each prefix, most counters of a row, counters of one slice.
ROWS, COUNTERS, WIDEST, SLICE = 4, 4, 1 << 26, 1 << 16
#: Prefixes that a task gathers before it hands on their counters.
_GATHER = 1 << 20
_KEY = ["depth", "k1", "k2"]
_PARTS = ["a", "b", "c", "d"]
_NOTHING = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with borrowed heads, from ``turns`` (conv, place, digest, words).

    Gives ``conv, place, digest, words, length`` per turn and ``conv, length`` per conversation.
    """
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    lengths = staged(lengths.withColumn("base", F.col("conv") - F.pmod("conv", F.lit(FAMILY))), "lengths")
    bases = lengths.where("conv = base").select("base", F.col("own").alias("held"))
    head = F.crc32(F.col("conv").cast("string")) % HEAD
    convs = lengths.join(bases, "base", "left").withColumn("head", head)
    convs = convs.withColumn("lent", F.least("head", F.coalesce("held", F.lit(0))))
    convs = staged(convs.withColumn("length", F.col("lent") + F.greatest(F.col("own") - F.col("head"), F.lit(0))), "convs")
    later = lookup_join(turns, convs.select("conv", "head", "lent", "length"), "conv", settled=True).where("place >= head")
    later = later.select("conv", (F.col("place") - F.col("head") + F.col("lent")).alias("place"), "digest", "words", "length")
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("place") < HEAD - 1)).withColumnRenamed("conv", "base")
    borrowed = convs.where("lent > 0").select("base", "conv", "lent", "length").join(heads, "base").where("place < lent")
    return later.unionByName(borrowed.select("conv", "place", "digest", "words", "length")), convs.select("conv", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv, depth, k1, k2, p1, p2, words, length`` per rebuilt turn: the keys of its prefix and of the one before."""
    told = F.md5(F.concat(F.col("place").cast("string"), F.lit(":"), "digest"))
    parts = {x: F.conv(F.substring(told, 8 * i + 1, 8), 16, 10).cast("bigint") for i, x in enumerate(_PARTS)}
    numbers = turns.select("conv", "place", "words", "length", *[v.alias(x) for x, v in parts.items()])
    summed = running(numbers, ["conv"], ["place"], dict.fromkeys(_PARTS, 1 << 32))
    before = [F.col(f"before_{x}") for x in _PARTS]
    upto = [F.pmod(b + F.col(x), F.lit(1 << 32)) for b, x in zip(before, _PARTS)]
    pair = lambda high, low: F.shiftleft(high, 32).bitwiseOR(low)
    return summed.select(
        "conv", (F.col("place") + 1).alias("depth"), pair(*upto[:2]).alias("k1"), pair(*upto[2:]).alias("k2"),
        pair(*before[:2]).alias("p1"), pair(*before[2:]).alias("p2"), "words", "length",
    )


def width_of(rows: int, widest: int = WIDEST) -> int:
    """Counters of a row of the sketch: a power of two."""
    return min(widest, 1 << max(12, (COUNTERS * rows - 1).bit_length() if rows else 0))


def counters(k1: np.ndarray, k2: np.ndarray, width: int) -> list[np.ndarray]:
    """For every row of the sketch the counter of each key."""
    k1, k2, keep = k1.view(np.uint64), k2.view(np.uint64), np.uint64(65 - width.bit_length())
    return [(W.mix(k1 ^ (W.mix(k2 + np.uint64(2 * r + 1)))) >> keep).astype(np.int64) for r in range(ROWS)]


def screened(keys: DataFrame, rows: int, widest: int = WIDEST) -> DataFrame:
    """``keys`` (with k1, k2) and ``single``: whether the sketch proves that a key occurs once."""
    width = width_of(rows, widest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices(held):
            k1, k2 = (np.concatenate(x) for x in zip(*held))
            for r, found in enumerate(counters(k1, k2, width)):
                found = np.sort(found)
                found = found[np.concatenate(([True, True], found[2:] != found[:-2]))[: len(found)]]  # a counter stops at two
                at = np.flatnonzero(np.diff(found // SLICE, prepend=-1))
                parts = np.split((found % SLICE).astype(np.uint16), at[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r] * len(at), pa.int32()), pa.array(found[at] // SLICE, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                    ["r", "slice", "found"],
                )

        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= _GATHER:
                yield from slices(held)
                held, n = [], 0
        if n:
            yield from slices(held)

    def twice(own: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(min(width, SLICE), np.uint8)
        for part in parts["found"]:
            total = np.minimum(total + np.bincount(np.frombuffer(part, np.uint16), minlength=len(total)).astype(np.uint8), 2)
        return pd.DataFrame({"r": [own[0]], "slice": [own[1]], "bits": [np.packbits(total > 1).tobytes()]})

    counted = keys.select("k1", "k2").mapInArrow(count, "r int, slice bigint, found binary")
    table = counted.groupBy("r", "slice").applyInPandas(twice, "r int, slice bigint, bits binary").toArrow()
    sketch = np.zeros((ROWS, width // 8), np.uint8)
    for r, at, bits in zip(*(table.column(c).to_pylist() for c in ("r", "slice", "bits"))):
        sketch[r, at * SLICE // 8 : at * SLICE // 8 + len(bits)] = np.frombuffer(bits, np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(sketch)
    names = keys.columns
    first, second = names.index("k1"), names.index("k2")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = np.ones(batch.num_rows, bool)
            for r, found in enumerate(counters(batch.column(first).to_numpy(), batch.column(second).to_numpy(), width)):
                many &= (shared.value[r][found >> 3] >> (7 - (found & 7)).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(~many)], [*names, "single"])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in keys.dtypes)
    return keys.mapInArrow(screen, f"{fields}, single boolean")


def ends(rows: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256`` from ``rows`` (depth, k1, k2, conv): the digest of the ids of each node in order."""

    def runs(batch: pa.RecordBatch) -> np.ndarray:
        keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
        return np.append(np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))), len(keys))

    def pieces(batches):
        for batch in batches:
            if batch.num_rows:
                at = runs(batch)
                ids = batch.column(3).to_pylist()
                text = [",".join(map(str, ids[s:e])) for s, e in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at[:-1])) for c in batch.columns], pa.array(text, pa.string())], [*_KEY, "conv", "ids"])

    def digests(batches):
        key, hasher = None, None
        for batch in batches:
            done = []
            for *own, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if own != key:
                    if key:
                        done.append((*key, hasher.hexdigest()))
                    key, hasher = own, hashlib.sha256()
                else:
                    hasher.update(b",")
                hasher.update(ids.encode())
            yield _named(done)
        if key:
            yield _named([(*key, hasher.hexdigest())])

    def _named(done):
        columns = zip(*done) if done else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.string(),))], [*_KEY, "ends_sha256"])

    kinds = "depth bigint, k1 bigint, k2 bigint"
    order = [*_KEY, "conv"]
    sorted_ = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    joined = sorted_.mapInArrow(pieces, f"{kinds}, conv bigint, ids string")
    return joined.repartition(*_KEY).sortWithinPartitions(*order).mapInArrow(digests, f"{kinds}, ends_sha256 string")


def trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
         widest: int = WIDEST) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    W.ship(conversations.sparkSession)
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said))
    narrow = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), word_count(text).alias("words")
    )
    turns = running(staged(narrow, "turns"), ["conv"], ["turn", "digest"]).select("conv", F.col("before").alias("place"), "digest", "words")
    every, convs = rebuilt(staged(turns, "ordered"))
    rows = staged(prefixes(staged(every, "rebuilt")), "prefixes")
    rows = staged(screened(rows, rows.count(), widest), "screened")
    cuts = rows.groupBy("conv").agg(F.min(F.when(F.col("single"), F.col("depth"))).alias("cut"))
    cuts = staged(convs.join(cuts, "conv", "left").withColumn("cut", F.coalesce("cut", F.col("length") + 1)), "cuts")
    rows = lookup_join(rows.drop("single"), cuts.select("conv", "cut"), "conv", settled=True)
    zero = F.lit(0).cast("bigint")
    roots = cuts.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), zero.alias("words"), "length", "cut")
    shared = staged(rows.where("depth < cut").unionByName(roots), "shared")
    tail = ((F.col("cut") == F.col("depth") + 1) & (F.col("cut") <= F.col("length"))).cast("bigint")
    nodes = staged(shared.groupBy(*_KEY).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.any_value("p1").alias("p1"), F.any_value("p2").alias("p2"), F.sum(tail).alias("tails"),
    ), "nodes")
    above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    kids = nodes.where("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("kids"))
    nodes = nodes.join(kids, _KEY, "left").withColumn("n_children", F.col("tails") + F.coalesce("kids", F.lit(0)))
    nodes = staged(nodes.withColumn("leaves", F.col("tails") + (F.col("n_children") == 0).cast("int"))
                   .withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).drop("kids"), "nodes")
    own = nodes.where("leaves > 0 or saved > 0").select("conv", "depth", "leaves", "saved")
    reached = own.groupBy("conv").agg(F.max("depth").alias("deepest"))
    carried = shared.select("conv", *_KEY).join(reached, "conv").where("depth <= deepest").join(own, ["conv", "depth"], "left")
    carried = carried.select("conv", *_KEY, (-F.col("depth")).alias("up"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("leaves", "saved")])
    summed = running(carried, ["conv"], ["up"], {"leaves": 0, "saved": 0})
    totals = summed.groupBy(*_KEY).agg(
        F.sum(F.col("leaves") + F.col("before_leaves")).alias("n_leaves"), F.sum(F.col("saved") + F.col("before_saved")).alias("saved_tokens")
    )
    nodes = nodes.select(*_KEY, "conv", "p1", "p2", "n_convs", "n_children").join(totals, _KEY).join(ends(shared.where("depth = length")), _KEY, "left")
    nodes = nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING)))
    nodes = staged(nodes, "nodes")
    tails = rows.where("depth >= cut").select(
        "conv", "depth", "cut", "p1", "p2", F.lit(1).cast("bigint").alias("n_convs"), (F.col("depth") < F.col("length")).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(_NOTHING).alias("ends_sha256"),
    )
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    found = [F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    hung = nodes.where("depth > 0").drop("k1", "k2").unionByName(tails.where("depth = cut").drop("cut"))
    hung = lookup_join(hung, parents, ["depth", "p1", "p2"], settled=True).select(*found)
    inner = tails.where("depth > cut").withColumn("parent_conv_id", F.col("conv")).select(*found)
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint")).select(*found)
    return hung.union(inner).union(top)


def op13_prefix_trie(spark, folder: str) -> DataFrame:
    return trie(W.read(spark, folder, "conversations"))


OP13_SQL = rf"""
    with turns as (
        select conv_id as conv, row_number() over (partition by conv_id order by turn nulls first, digest) - 1 as place, digest, words
        from (
            select conv_id, turn, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) as digest,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words
            from conversations where conv_id is not null
        )
    ),
    convs as (select distinct conv, conv - conv % 20 as base, {CRC_SQL.format("conv")} % 4 as head from turns),
    joined as (
        select c.conv, 0 as part, t.place, digest, words from convs c join turns t on t.conv = c.base and t.place < c.head
        union all
        select c.conv, 1, t.place, digest, words from convs c join turns t on t.conv = c.conv and t.place >= c.head
    ),
    paths as (
        select conv, row_number() over w as depth, md5(string_agg(digest, ',') over w) as key, words,
               count(*) over (partition by conv) as length
        from joined window w as (partition by conv order by part, place rows between unbounded preceding and current row)
        union all
        select conv, 0, '', 0, (select count(*) from joined j where j.conv = convs.conv) from convs
    ),
    linked as (select *, lag(key) over (partition by conv order by depth) as parent from paths),
    nodes as (
        select depth, key, min(parent) as parent, min(conv) as conv, count(*) as n_convs, max(words) as words,
               sha256(coalesce(string_agg(conv::varchar, ',' order by conv) filter (where depth = length), '')) as ends
        from linked group by depth, key
    ),
    counted as (
        select n.*, (select count(*) from nodes c where c.depth = n.depth + 1 and c.parent = n.key) as n_children,
               (select p.conv from nodes p where p.depth = n.depth - 1 and p.key = n.parent) as parent_conv_id
        from nodes n
    ),
    totals as (
        select p.depth, p.key, sum((n_children = 0)::int) as n_leaves, sum((n_convs - 1) * n.words) as saved
        from counted n join paths p on p.conv = n.conv and p.depth <= n.depth
        group by p.depth, p.key
    )
    select conv as conv_id, depth::bigint as depth, parent_conv_id, n_convs, n_children, n_leaves::bigint as n_leaves,
           saved::bigint as saved_tokens, ends as ends_sha256
    from counted join totals using (depth, key)
"""
