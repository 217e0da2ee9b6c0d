"""Word and two-word phrase counts: phrases by a likelihood ratio, plurals folded into singulars.

Words are counted in lower case without stop words and numbers. Two neighbours
in one text, neither of them a stop word, are a phrase if they meet more often
than chance explains: Dunning's ratio of their joint count against the counts of
both words must exceed a threshold. An accepted phrase takes its occurrences from
its words. A word in -s (not -ss) is folded into the word without it if that
occurs too, and phrases likewise.

The texts are read once and become two tables of counts, aggregated before the
shuffle; everything after works on distinct words and pairs. A word that stands
in very many pairs is matched by the skew-safe lookup join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import ENGLISH_STOP_WORDS, cloud_words
from sievework.operators.joins import lookup_join
from sievework.session import staged

# Fixed value: the ratio above which two words are a phrase.
THRESHOLD = 30.0


def likelihood_ratio(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's ratio for a pair seen ``both`` times, of words seen ``first`` and ``second`` times among ``total``."""
    both, first, second, total = (c.cast("double") for c in (both, first, second, total))

    def log_likelihood(hits: Column, tries: Column, share: Column) -> Column:
        bounded = lambda x: F.log(F.greatest(x, F.lit(1e-10)))
        return bounded(share) * hits + bounded(F.lit(1.0) - share) * (tries - hits)

    rest, others = second - both, total - first
    chance, after, elsewhere = second / total, both / first, rest / others
    ratio = log_likelihood(both, first, chance) + log_likelihood(rest, others, chance)
    ratio = ratio - log_likelihood(both, first, after) - log_likelihood(rest, others, elsewhere)
    return F.when((total > first) & (total > second), ratio * -2.0).otherwise(0.0)


def fold_plurals(counts: DataFrame) -> DataFrame:
    """``counts`` with ``form``: the word or phrase that each one counts as."""
    word = F.col("word")
    plural = counts.where(word.endswith("s") & ~word.endswith("ss")).select("word", F.substring(word, F.lit(1), F.length(word) - 1).alias("single"))
    known = plural.join(counts.select(word.alias("single")), "single", "left_semi")
    return counts.join(known, "word", "left").withColumn("form", F.coalesce("single", "word")).drop("single")


def word_phrases(
    df: DataFrame, column: str, threshold: float = THRESHOLD, stop_words: Iterable[str] = ENGLISH_STOP_WORDS, plurals: bool = True
) -> DataFrame:
    """``word, count`` of all words and phrases that are left; a phrase is two words with a blank between."""
    stops = list(stop_words)
    spoken = F.filter(cloud_words(column), lambda w: ~w.rlike(r"^\p{N}+$"))
    held = df.select(spoken.alias("words"))
    stop = lambda w: w.isin(stops) if stops else F.lit(False)
    single = F.transform(F.filter("words", lambda w: ~stop(w)), lambda w: F.struct(w.alias("first"), F.lit(None).cast("string").alias("second")))
    after = F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0)))
    before = F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0)))
    pairs = F.filter(F.arrays_zip(before.alias("first"), after.alias("second")), lambda p: ~stop(p["first"]) & ~stop(p["second"]))
    cells = held.select(F.explode(F.concat(single, pairs)).alias("cell")).select("cell.first", "cell.second")
    counts = staged(cells.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")), "phrases")
    words = counts.where("second is null").select(F.col("first").alias("word"), "n")
    both = counts.where("second is not null")
    forms = staged(fold_plurals(words) if plurals else words.withColumn("form", F.col("word")), "forms")
    folded = staged(forms.groupBy("form").agg(F.sum("n").alias("n")), "folded")
    forms = forms.select("word", "form")
    phrases = both.withColumn("word", F.concat_ws(" ", "first", "second"))
    if plurals:
        parts = F.split("form", " ")
        phrases = fold_plurals(phrases).groupBy("form").agg(F.sum("n").alias("n")).select(F.col("form").alias("word"), parts[0].alias("first"), parts[1].alias("second"), "n")
    total = folded.agg(F.sum("n")).first()[0] or 0
    side = lambda name: lookup_join(forms, folded, "form", settled=True).select(
        F.col("word").alias(name), F.col("form").alias(f"{name}_form"), F.col("n").alias(f"{name}_n")
    )
    # a lookup reads its rows several times, so they are computed once before
    scored = staged(lookup_join(staged(phrases, "pairs"), side("first"), "first"), "half")
    scored = lookup_join(scored, side("second"), "second")
    ratio = likelihood_ratio(F.col("n"), F.col("first_n"), F.col("second_n"), F.lit(total))
    kept = staged(scored.where(ratio > threshold).select("word", "first_form", "second_form", "n"), "kept")
    taken = kept.select(F.explode(F.array("first_form", "second_form")).alias("form"), "n").groupBy("form").agg(F.sum("n").alias("taken"))
    left = folded.join(taken, "form", "left").select(F.col("form").alias("word"), (F.col("n") - F.coalesce("taken", F.lit(0))).alias("count"))
    return left.unionByName(kept.select("word", F.col("n").alias("count"))).where(F.col("count") > 0)
