"""Mutual information of a term's count, taken as a number, with the class: the nearest-neighbour estimator.

For every document the k-th nearest document of its class (by the distance of
their counts) spans a radius; k neighbours of the class against m of all
documents within that radius measure how far the class gathers there. The
estimate is psi(N) + mean psi(k) - mean psi(class size) - mean psi(m).

Counts repeat, so k and m are all neighbours at that distance or nearer, on both
sides alike; where no two distances are equal this is the published estimator
for a number and a class. Documents of one class and count share all of this,
so cells (term, class, count) stand for documents. At count 0 cells follow from
class sizes, and classes that never see a term have a closed form. The radius
needs k cells on either side only; m is the difference of two running sums over
the term's cells. Nothing is drawn at random and no vector is dense.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.joins import lookup_join
from sievework.session import staged

_EULER = 0.5772156649015329
_TABLE = 16


def digamma(n: Column) -> Column:
    """psi of whole numbers from 1: harmonic sums below 16, the asymptotic series above."""
    sums = [-_EULER + math.fsum(1.0 / i for i in range(1, k)) for k in range(1, _TABLE)]
    x = F.lit(1.0) / n.cast("double")
    y = x * x
    series = F.log(n.cast("double")) - x / 2.0 - y * (F.lit(1.0 / 12) - y * (F.lit(1.0 / 120) - y * (F.lit(1.0 / 252) - y / 240.0)))
    return F.when(n < _TABLE, F.element_at(F.array(*[F.lit(s) for s in sums]), n.cast("int"))).otherwise(series)


def neighbour_information(counts: DataFrame, labels: DataFrame, neighbours: int = 3) -> DataFrame:
    """Rows ``(term, mi)`` in nats, from ``counts (id, term, cnt)`` and ``labels (id, label)``.

    Every labelled document counts, also those without the term (count 0).
    Classes of one document are left out; smaller classes than ``neighbours``
    use all other documents they have.
    """
    labels = staged(labels.select("id", "label"), "labels")
    sizes = staged(labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    size = F.col("size")
    documents, size_part, closed = sizes.agg(F.sum("size"), F.sum(size * digamma(size)), F.sum(size * digamma(size - 1))).first()
    documents = documents or 0
    labelled = lookup_join(lookup_join(counts, labels, "id", settled=True), sizes, "label", settled=True)
    cells = staged(labelled.groupBy("term", "label", "size", F.col("cnt").cast("bigint").alias("cnt")).agg(F.count(F.lit(1)).alias("n")), "cells")
    pairs = cells.groupBy("term", "label", "size").agg(F.sum("n").alias("seen"))
    terms = pairs.groupBy("term").agg(
        F.sum("seen").alias("seen"), F.sum("size").alias("present"), F.sum(size * digamma(size - 1)).alias("present_part")
    )
    zero = F.lit(0).cast("bigint").alias("cnt")
    every = cells.unionByName(pairs.where("size > seen").select("term", "label", "size", zero, (size - F.col("seen")).alias("n")))
    by_count = Window.partitionBy("term", "label").orderBy("cnt")
    near = [F.struct(zero.alias("d"), F.col("n").alias("n"))]
    for i in range(1, neighbours + 1):
        for shifted in (F.lag, F.lead):
            near.append(F.struct(F.abs(F.col("cnt") - shifted("cnt", i).over(by_count)).alias("d"), shifted("n", i).over(by_count).alias("n")))
    reach = every.select("*", F.filter(F.array(*near), lambda x: x["n"].isNotNull()).alias("near"))
    upto = lambda d: F.aggregate(F.filter("near", lambda x: x["d"] <= d), F.lit(0).cast("bigint"), lambda s, x: s + x["n"]) - 1
    enough = F.filter("near", lambda x: upto(x["d"]) >= F.least(F.lit(neighbours), size - 1))
    reach = reach.withColumn("radius", F.array_min(F.transform(enough, lambda x: x["d"]))).withColumn("k", upto(F.col("radius")))
    # points and the two ends of every reach, in the order of counts
    points = cells.groupBy("term", "cnt").agg(F.sum("n").alias("n")).unionByName(
        terms.where(F.col("seen") < documents).select("term", zero, (F.lit(documents) - F.col("seen")).alias("n"))
    )
    none = F.lit(None)
    events = points.select("term", F.col("cnt").alias("at"), F.lit(1).alias("turn"), "n", F.lit(0).alias("sign"), none.alias("label"), none.alias("cnt"), none.alias("docs"), none.alias("k"))
    ends = reach.select("term", "label", "cnt", F.col("n").alias("docs"), "k", F.explode(F.array(
        F.struct((F.col("cnt") - F.col("radius")).alias("at"), F.lit(0).alias("turn"), F.lit(-1).alias("sign")),
        F.struct((F.col("cnt") + F.col("radius")).alias("at"), F.lit(2).alias("turn"), F.lit(1).alias("sign")),
    )).alias("end"))
    events = events.unionByName(ends.select("term", "end.at", "end.turn", F.lit(0).cast("bigint").alias("n"), "end.sign", "label", "cnt", "docs", "k"))
    so_far = Window.partitionBy("term").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("below", F.sum("n").over(so_far)).where("sign <> 0")
    met = counted.groupBy("term", "label", "cnt", "docs", "k").agg((F.sum(F.col("sign") * F.col("below")) - 1).alias("m"))
    gathered = met.groupBy("term").agg(F.sum(F.col("docs") * (digamma(F.col("k")) - digamma(F.col("m")))).alias("gathered"))
    absent = F.lit(documents) - F.col("present")
    alone = F.when(absent > 0, F.lit(closed) - F.col("present_part") - absent * digamma(F.lit(documents) - F.col("seen") - 1)).otherwise(0.0)
    mi = digamma(F.lit(documents)) + (F.col("gathered") + alone - F.lit(size_part)) / F.lit(float(documents or 1))
    return gathered.join(terms, "term").select("term", F.greatest(mi, F.lit(0.0)).alias("mi"))
