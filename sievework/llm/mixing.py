"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A source's target is its weight's share of all words, but at most ``most``
times what the source has; the excess is shared again by weight. Each document
is expected in the mix target / source size times. Within a source documents
stand in the order of their size; the prefix sum of expected copies, moved by
one random offset per source, is cut at the whole numbers, and a document is
emitted once per whole number that its step crosses. Documents of like size
are neighbours in that order, so what a source gives differs from its target
by about one largest document, however its sizes are spread.

Expected copies are whole multiples of 2 ** -32 and prefix sums are kept modulo
one copy, so they are exact and do not depend on partitions. Results depend on
ids, sizes, sources and the seed only: reruns agree.

NULL and empty texts and texts of white space have size 0 and count as taken
with 0 words. A NULL source is a source of its own, the last one. Repeated rows
are documents of their own; of rows that tie in size and id, a hash of the
text says which is first. A source without words has target 0 and is left out
of the mix. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.numbers import portable_hash
from sievework.llm import words as W
from sievework.llm.running import running
from sievework.operators.joins import lookup_join
from sievework.session import staged

#: Weights of the sources in code-point order, repeating; the last source is NULL.
WEIGHTS = (5, 2, 1)
#: No source gives more than so many times its words, so no document is taken more often.
MOST = 3
SEED = 42
#: One expected copy.
ONE = 1 << 32
_SOURCE = ["_none", "_source"]


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (_none, _source, source_size) with each source's ``target``.

    All uncapped targets are one level times their weight. The level starts at
    the plain share and rises while capped sources leave an excess; each round
    is one aggregate over the sources, and the driver sees its two sums only.
    """
    ranked = running(sizes, [], _SOURCE)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("before", F.lit(len(weights))) + 1).cast("int"))
    ranked = staged(ranked.withColumn("weight", weight.cast("bigint")), "sources")
    cap = F.lit(most) * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, -1
    while True:
        capped = cap <= F.col("weight") * F.lit(level) if held >= 0 else F.lit(False)
        count, taken, open_ = ranked.agg(F.count_if(capped), F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        if count == held or not open_:
            break
        held, level = count, float(total - (taken or 0)) / float(open_)
    aim = F.least(cap.cast("double"), F.col("weight") * F.lit(level))
    return ranked.select(*_SOURCE, "source_size", aim.alias("target"))


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
           weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document row: ``_doc, _text`` (its key), ``size, source_size, target, copies``."""
    narrow = docs.select(
        *W.by_row(key, text), F.col(source).isNull().alias("_none"), F.coalesce(F.col(source), F.lit("")).alias("_source"),
        word_count(text).alias("size"), portable_hash(seed, F.col(key).cast("string")).alias("_place"),
    )
    narrow = staged(narrow, "sizes")
    sizes = narrow.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    aims = staged(targets(sizes, weights, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    step = F.floor(rate * F.lit(float(ONE))).cast("bigint")
    aimed = lookup_join(narrow, aims, _SOURCE, settled=True).withColumn("_step", step)
    placed = running(aimed, _SOURCE, ["size", "_place", "_doc", "_text"], {"_step": ONE})
    offset = F.pmod(portable_hash(seed, F.when(~F.col("_none"), F.col("_source"))), F.lit(ONE))
    start = F.pmod(F.col("before__step") + offset, F.lit(ONE))
    return placed.select("_doc", "_text", "size", "source_size", "target", F.shiftright(start + F.col("_step"), 32).alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mixed rows: ``row`` as often as the mix takes it, with ``copy`` from 1."""
    key_of = ["_doc", "_text"]
    taken = copies(docs, key, text, **options).groupBy(*key_of).agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows"))
    keyed = docs.select(*W.by_row(key, text), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = lookup_join(keyed, taken.where("_all > 0"), key_of)
    single = met.where("_rows = 1").select("row", F.col("_all").alias("_copies"))
    # rows that agree in id and text share their copies in the order of a hash
    repeated = running(met.where("_rows > 1").withColumn("_hash", F.xxhash64(F.to_json("row"))), key_of, ["_hash"])
    share = F.expr("_all div _rows") + (F.col("before") < F.col("_all") % F.col("_rows")).cast("int")
    mixed = single.union(repeated.select("row", share.alias("_copies"))).where("_copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies")).alias("copy"))


def op11_mixing(spark, folder: str) -> DataFrame:
    done = copies(W.read(spark, folder, "documents"))
    own = F.when(F.col("_doc") != -(1 << 63), F.col("_doc")).alias("doc_id")
    return done.select(own, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP11_SQL = r"""
    with sized as (
        select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
               ('0x' || left(md5(concat_ws('|', '42', doc_id)), 15))::bigint as place, text
        from documents
    ),
    sources as (
        select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place
        from sized group by source
    ),
    weighed as (select *, [5, 2, 1][((place - 1) % 3 + 1)::int] as weight, 3 * source_size as cap from sources),
    levels as (  -- capped sources come first in the order of cap / weight
        select *, ((select sum(cap) / 3 from weighed) - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))::double
                  / (sum(weight) over (o rows between current row and unbounded following))::double as level
        from weighed window o as (order by cap / weight::double, place)
    ),
    aims as (
        select source, source_size,
               least(cap::double, weight * (select min_by(level, cap / weight::double) from levels where level * weight < cap)) as target
        from weighed
    ),
    stepped as (
        select sized.*, source_size, coalesce(target, 0.0) as target,
               case when source_size > 0 then floor(target / source_size * 4294967296.0)::bigint else 0 end as step,
               ('0x' || left(md5(concat_ws('|', '42', sized.source)), 15))::bigint % 4294967296 as shift
        from sized join aims on sized.source is not distinct from aims.source
    ),
    placed as (
        select *, (sum(step) over (partition by source order by size, place, doc_id nulls first, text) - step + shift) % 4294967296 as start
        from stepped
    )
    select doc_id, size::bigint as size, source_size, target::double as target, (((start + step)::bigint >> 32) * size)::bigint as taken
    from placed
"""
