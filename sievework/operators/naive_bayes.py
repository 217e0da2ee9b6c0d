"""Multinomial naive Bayes as relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.joins import lookup_join
from sievework.session import settle, staged


@dataclass(frozen=True)
class NaiveBayesTables:
    """``classes (label, log_prior, log_total)`` and ``weights (term, weights)``.

    A term's weight in a class is log(count + smoothing) - log(smoothing), so
    classes that never see the term weigh nothing and are not stored.
    """

    classes: DataFrame
    weights: DataFrame
    smoothing: float


def fit(counts: DataFrame, labels: DataFrame, smoothing: float = 1.0) -> NaiveBayesTables:
    """Learn from ``counts (id, term, cnt)`` and ``labels (id, label)``.

    Class priors are plain shares of the labelled documents.
    """
    labels = staged(labels.select("id", "label"), "labels")
    labelled = lookup_join(counts, labels, "id", settled=True)
    pairs = staged(labelled.groupBy("term", "label").agg(F.sum("cnt").alias("n")), "pairs")
    size = pairs.agg(F.count_distinct("term")).scalar()
    documents = labels.agg(F.count(F.lit(1))).scalar()
    totals = pairs.groupBy("label").agg(F.sum("n").alias("total"))
    classes = (
        labels.groupBy("label")
        .agg(F.count(F.lit(1)).alias("docs"))
        .join(totals, "label", "left")
        .select(
            "label",
            F.log(F.col("docs") / documents).alias("log_prior"),
            F.log(F.coalesce("total", F.lit(0)) + smoothing * size).alias("log_total"),
        )
    )
    weight = F.log(F.col("n") + smoothing) - F.log(F.lit(smoothing))
    weights = pairs.groupBy("term").agg(F.collect_list(F.struct("label", weight.alias("weight"))).alias("weights"))
    return NaiveBayesTables(settle(classes), weights, smoothing)


def scores(model: NaiveBayesTables, counts: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows ``(id, scores)``: per document an array of ``(score, label)``, classes ascending.

    Only terms seen in training count. A document without any is scored by the
    class priors. The table of classes is one small row, attached as a scalar.
    """
    ids = documents.select("id")
    known = staged(lookup_join(counts, ids, "id", "left_semi"), "known")
    known = lookup_join(known, model.weights, "term", "inner")
    # the entry without a label adds up to the document's length
    length_entry = F.struct(F.lit(None).alias("label"), F.lit(1.0).alias("weight"))
    parts = (
        known.select("id", "cnt", F.explode(F.array_append("weights", length_entry)).alias("w"))
        .groupBy("id", F.col("w.label").alias("label"))
        .agg(F.sum(F.col("cnt") * F.col("w.weight")).alias("part"))
        .groupBy("id")
        .agg(
            F.max(F.when(F.col("label").isNull(), F.col("part"))).alias("length"),
            F.map_from_entries(
                F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "part")))
            ).alias("parts"),
        )
    )
    classes = model.classes.agg(F.array_sort(F.collect_list(F.struct("label", "log_prior", "log_total")))).scalar()
    joined = ids.join(parts, "id", "left").withColumn("classes", classes)
    length = F.coalesce("length", F.lit(0.0))

    def score(c):
        start = c["log_prior"] - length * (c["log_total"] - F.log(F.lit(model.smoothing)))
        part = F.coalesce(F.try_element_at("parts", c["label"]), F.lit(0.0))
        return F.struct((start + part).alias("score"), c["label"].alias("label"))

    return joined.select("id", F.transform("classes", score).alias("scores"))


def predict(model: NaiveBayesTables, counts: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows ``(id, prediction, score)``; equal scores go to the smallest label."""
    scored = scores(model, counts, documents)
    best = F.array_max(F.transform("scores", lambda s: s["score"]))
    first = F.filter("scores", lambda s: s["score"] == F.col("best"))[0]
    return scored.withColumn("best", best).select("id", first["label"].alias("prediction"), F.col("best").alias("score"))
