"""Merkle manifest of a dataset by a butterfly exchange of subtree roots.

A document's leaf is the SHA-256 of its fields, each written as byte count,
colon and value (``-`` if NULL). Per source the leaves ascend by id; runs of
FANOUT nodes are hashed to their parent until one node is left, the source's
subroot, and the subroots form a tree of the same shape. Texts stay where they
are: only leaves move on.

1. The leaves of a source are numbered (see ``running``) and dealt to aligned
   partitions of FANOUT ** LEVELS leaves, so a partition holds a whole subtree.
   One call per partition climbs to its root.
2. Partitions swap roots round by round. In round r the partitions of FANOUT
   neighbouring blocks, each of FANOUT ** r partitions with one common root, send
   that root to their like-numbered partners in the other blocks; each partition
   then hashes the parent itself and keeps the run as a part of its proof. A
   block that is shorter than the others sends to several partners in turn.
   Further rounds do the same with sources as blocks. In the end every partition
   holds the root and the upper part of the proof of all its leaves; nothing is
   passed down a tree. Each round is one shuffle of FANOUT short rows a partition.
3. Each partition joins its own upper proof to the lower part of each leaf's,
   and folds leaves to the root again to verify them.

A NULL id stands before all ids and a NULL source before all sources; NULL
fields are ``-``, so they differ from empty texts. Rows that tie in source and
id stand in the order of their leaves; equal rows are leaves of their own. An
empty table has an empty manifest. Very long texts are hashed once, in place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import words as W
from sievework.llm.running import running
from sievework.operators.joins import lookup_join
from sievework.session import staged

FANOUT = 16
#: Levels of the tree inside one partition.
LEVELS = 3
#: Stands for a NULL id, before all others.
_NO_ID = -(1 << 63)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SOURCE = ["_some", "_source"]
_LANE = "lane bigint, rank bigint, part bigint, parts bigint, low bigint, digest string, subroot string, path array<struct<own:int,run:array<string>>>"


def field(column: Column) -> Column:
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def climb(digests: list[str], whole: bool, fanout: int = FANOUT, levels: int = LEVELS) -> list[list[str]]:
    """``digests`` and the levels above: up to one node if they are a whole tree, else ``levels`` of them."""
    climbed = [digests]
    while len(climbed[-1]) > 1 if whole else len(climbed) <= levels:
        below = climbed[-1]
        climbed.append([_hash(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return climbed


def _hash(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _merged(lanes: DataFrame, partners: Column) -> DataFrame:
    """One round: every lane sends its digest to ``partners`` (array of lanes) as the block of number ``turn`` of its run.

    Lanes keep their own row by a message to themselves.
    """
    own = F.struct(*[F.col(c) for c in lanes.columns if c not in ("lane", "turn", "partners", "wide")])
    sent = lanes.select(F.explode(partners).alias("to"), "lane", "turn", "digest", own.alias("own"))
    sent = sent.select(F.col("to"), "turn", "digest", F.when(F.col("to") == F.col("lane"), F.struct("own", F.col("turn").alias("at"))).alias("mine"))
    met = sent.groupBy("to").agg(F.array_sort(F.collect_list(F.struct("turn", "digest"))).alias("run"), F.any_value("mine", True).alias("mine"))
    run = F.transform("run", lambda x: x["digest"])
    step = F.struct(F.col("mine.at").cast("int").alias("own"), run.alias("run"))
    return met.select(
        F.col("to").alias("lane"), "mine.own.rank", "mine.own.part", "mine.own.parts", "mine.own.low",
        F.sha2(F.array_join(run, ""), 256).alias("digest"), "mine.own.subroot",
        F.concat("mine.own.path", F.array(step)).alias("path"),
    )


def _partners(first: Column, size: Column, place: Column, own_size: Column) -> Column:
    """Lanes of a block (first lane, size) that hear from the lane at ``place`` of a block of ``own_size`` lanes."""
    told = F.sequence(place, size - 1, own_size)
    return F.when(place < size, F.transform(told, lambda i: first + i)).otherwise(F.array().cast("array<bigint>"))


def exchange(lanes: DataFrame, sources: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Butterfly rounds over ``lanes`` (_LANE): first inside each source, then over the sources.

    ``sources``: rank, low (its first lane), parts. Lanes are numbered through, source after source.
    """
    most, count = sources.agg(F.max("parts"), F.count(F.lit(1))).first()
    width = 1
    while width < (most or 0):
        block = F.expr(f"part div {width}")
        first = F.expr(f"part div {width * fanout} * {fanout}")
        last = F.least(first + fanout, F.expr(f"(parts + {width - 1}) div {width}")) - 1
        size = lambda b, w=width: F.least(F.lit(w), F.col("parts") - b * w)
        place = F.col("part") % width
        told = F.flatten(F.transform(F.sequence(first, last), lambda b: F.when(  # noqa: B023
            b == block, F.array("lane")).otherwise(_partners(F.col("low") + b * width, size(b), place, size(block)))))  # noqa: B023
        active = F.col("parts") > width
        swapped = _merged(lanes.where(active).withColumn("turn", block % fanout), told)
        lanes = staged(lanes.where(~active).unionByName(swapped), "lanes")
        width *= fanout
    lanes = lanes.withColumn("subroot", F.col("digest"))
    width = 1
    while width < (count or 0):
        blocks = sources.groupBy(F.expr(f"rank div {width}").alias("block")).agg(F.min("low").alias("first"), F.sum("parts").alias("size"))
        blocks = staged(blocks.withColumn("run", F.expr(f"block div {fanout}")), "blocks")
        # few blocks make a run: what each of its blocks must know of the others
        run = blocks.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("block", "first", "size"))).alias("blocks"))
        held = lookup_join(lanes.withColumn("block", F.expr(f"rank div {width}")).withColumn("run", F.expr(f"block div {fanout}")), run, "run")
        mine = F.filter("blocks", lambda b: b["block"] == F.col("block"))[0]
        place = F.col("lane") - mine["first"]
        told = F.flatten(F.transform("blocks", lambda b: F.when(  # noqa: B023
            b["block"] == F.col("block"), F.array("lane")).otherwise(_partners(b["first"], b["size"], place, mine["size"]))))  # noqa: B023
        swapped = held.withColumn("turn", F.col("block") % fanout).withColumn("partners", told)
        lanes = staged(_merged(swapped.drop("block", "run", "blocks"), F.col("partners")), "lanes")
        width *= fanout
    return lanes


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS,
             tampered: dict[str, Column] | None = None, with_proof: bool = False,
             fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Per row: ``_doc, leaf, subroot, root, proof_sha256, folded_root, verified`` (and ``proof``).

    ``tampered`` replaces fields of a second reading of the rows, whose leaves are folded to
    ``folded_root``. ``with_proof`` adds the siblings themselves, from leaf to root: an array of
    (own place in the run, the run's other digests), several kB a row.
    """
    spark = docs.sparkSession
    W.ship(spark)
    second = [(tampered or {}).get(c, F.col(c)) for c in fields]
    leaves = docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(_NO_ID)).alias("_doc"), F.col(source).isNotNull().alias("_some"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"), leaf(F.col(c) for c in fields).alias("leaf"), leaf(second).alias("seen"),
    )
    leaves = running(staged(leaves, "leaves"), _SOURCE, ["_doc", "leaf", "seen"])
    span = fanout**levels
    leaves = leaves.withColumn("part", F.expr(f"before div {span}")).withColumn("at", (F.col("before") % span).cast("int"))
    sizes = leaves.groupBy(*_SOURCE).agg(F.max("before").alias("last"))
    leaves = staged(leaves.drop("before"), "placed")
    sizes = staged(sizes.select(*_SOURCE, F.expr(f"last div {span} + 1").alias("parts")), "sizes")
    sources = running(sizes, [], _SOURCE, {"parts": 0}).select(*_SOURCE, "parts", F.col("before").alias("rank"), F.col("before_parts").alias("low"))
    sources = staged(sources, "sources")

    def root_of(own: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        digests = rows.sort_values("at")["leaf"].tolist()
        top = climb(digests, own[3] == 1, fanout, levels)[-1]
        return pd.DataFrame([[*own, top[0]]], columns=[*_SOURCE, "part", "parts", "digest"])

    named = lookup_join(leaves, sources.select(*_SOURCE, "parts"), _SOURCE, settled=True)
    roots = named.groupBy(*_SOURCE, "part", "parts").applyInPandas(root_of, "_some boolean, _source string, part bigint, parts bigint, digest string")
    roots = lookup_join(roots.drop("parts"), sources, _SOURCE, settled=True)
    none = F.array().cast("array<struct<own:int,run:array<string>>>")
    lanes = roots.select((F.col("low") + F.col("part")).alias("lane"), "rank", "part", "parts", "low", "digest", F.lit(None).cast("string").alias("subroot"), none.alias("path"))
    done = exchange(staged(lanes, "lanes"), sources, fanout)
    upper = done.join(sources.select(*_SOURCE, "rank"), "rank").select(*_SOURCE, "part", "parts", "subroot", F.col("digest").alias("root"), "path")

    def proofs(rows: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        rows, (top,) = rows.sort_values("at"), top.itertuples(index=False)
        below = climb(rows["leaf"].tolist(), top.parts == 1, fanout, levels)[:-1]
        above = [(step["own"], [str(x) for x in step["run"]]) for step in top.path]
        shared = "".join(x for own, run in above for i, x in enumerate(run) if i != own)
        sums, folded, paths = [], [], []
        for at, seen in enumerate(rows["seen"]):
            text, digest, path = [], seen, []
            for level in below:
                start = at - at % fanout
                before, after = level[start:at], level[at + 1 : start + fanout]
                text += [*before, *after]
                path.append((at - start, [*before, *after]))
                digest = _hash([*before, digest, *after])
                at //= fanout
            for own, run in above:
                digest = _hash([*run[:own], digest, *run[own + 1 :]])
            sums.append(_hash([*text, shared]))
            folded.append(digest)
            paths.append(path + [(own, [*run[:own], *run[own + 1 :]]) for own, run in above])
        out = pd.DataFrame({"_doc": rows["_doc"], "leaf": rows["leaf"], "subroot": top.subroot, "root": top.root, "proof_sha256": sums, "folded_root": folded})
        out["verified"] = out["folded_root"] == out["root"]
        if with_proof:
            out["proof"] = [[{"own": own, "others": others} for own, others in path] for path in paths]
        return out

    schema = "_doc bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    keys = [*_SOURCE, "part"]
    pairs = leaves.groupBy(*keys).cogroup(upper.groupBy(*keys))
    done = pairs.applyInPandas(proofs, schema + (", proof array<struct<own:int,others:array<string>>>" if with_proof else ""))
    return done.withColumn("_doc", F.when(F.col("_doc") != _NO_ID, F.col("_doc")))


def op12_merkle(spark, folder: str) -> DataFrame:
    docs = W.read(spark, folder, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    struck = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(struck, F.translate("text", upper, lower)).otherwise(F.col("text"))
    return manifest(docs, tampered={"text": text}).withColumnRenamed("_doc", "doc_id")


def _field_sql(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::varchar)) || ':' || {column}::varchar, '-')"


#: The bits of a decimal id's CRC-32, eight steps a character.
CRC_SQL = """xor(4294967295::bigint, list_reduce(list_transform(split({}::varchar, ''), lambda c: ord(c)::bigint), lambda a, b:
    list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end), 4294967295::bigint))"""

OP12_SQL = f"""
    with recursive hashed as (
        select doc_id, source, sha256({" || ".join(_field_sql(c) for c in FIELDS)}) as leaf,
               case when {CRC_SQL.format("doc_id")} % 5 = 0
                    then sha256({" || ".join(_field_sql(c) for c in FIELDS[:-1])} || {_field_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")})
                    else leaf end as seen
        from documents
    ),
    placed as (
        select *, dense_rank() over (order by source nulls first) - 1 as tree, count(*) over (partition by source) as n,
               row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, row_number() over () as r
        from hashed
    ),
    nodes as (
        select tree, 0 as level, idx, n, leaf as digest from placed
        union all
        select tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' order by idx))
        from nodes where n > 1 group by tree, level, n, idx // 16
    ),
    tops as (
        select 100 as level, tree as idx, count(*) over () as n, digest from nodes where n = 1
        union all
        select level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' order by idx))
        from tops where n > 1 group by level, n, idx // 16
    ),
    every as (select * from nodes where n > 1 union all select -1, * from tops where n > 1),
    root as (select digest from tops where n = 1),
    climbs as (  -- a leaf's ancestors, the last of them the root
        select r, tree, tree as own, 0 as level, idx, n from placed
        union all
        select r, case when n > 1 then tree else -1 end, own, case when n > 1 then level + 1 else 100 end,
               case when n > 1 then idx // 16 else own end,
               case when n > 1 then (n + 15) // 16 else (select count(distinct tree) from placed) end
        from climbs where n > 1 or tree >= 0
    ),
    proofs as (
        select r, sha256(coalesce(string_agg(digest, '' order by c.level, e.idx) filter (where c.idx <> e.idx), '')) as proof
        from climbs c left join every e on c.tree = e.tree and c.level = e.level and c.idx // 16 = e.idx // 16
        group by r
    ),
    folds as (
        select r, c.level, row_number() over (partition by r order by c.level) as step from climbs c where n > 1
    ),
    folded as (
        select r, 1::bigint as step, seen as digest from placed
        union all
        select f.r, f.step + 1, sha256(string_agg(case when e.idx = c.idx then f.digest else e.digest end, '' order by e.idx))
        from folded f join folds s on s.r = f.r and s.step = f.step
        join climbs c on c.r = f.r and c.level = s.level
        join every e on c.tree = e.tree and c.level = e.level and c.idx // 16 = e.idx // 16
        group by f.r, f.step
    ),
    ends as (select r, arg_max(digest, step) as digest from folded group by r)
    select doc_id, leaf, s.digest as subroot, root.digest as root, proof as proof_sha256, ends.digest as folded_root,
           ends.digest = root.digest as verified
    from placed join proofs using (r) join ends using (r) join (select tree, digest from nodes where n = 1) s using (tree), root
"""
