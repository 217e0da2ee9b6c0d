"""Dictionary forms of words: suffixes are detached by rules, and forms that a dictionary knows count.

The dictionary ``(form)`` and the exceptions ``(term, mapped)`` are the user's
relations, one of each per part of speech. Everything runs on the distinct vocabulary.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.terms import map_terms
from sievework.session import staged

# The published detachment rules (suffix, what takes its place) by part of speech.
DETACHMENTS = {
    "noun": (
        ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
        ("men", "man"), ("ies", "y"),
    ),
    "verb": (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")),
    "adjective": (("er", ""), ("est", ""), ("er", "e"), ("est", "e")),
    "adverb": (),
}


def detached(word: Column, part: str = "noun") -> Column:
    """The forms of a word with one suffix detached, as an array."""
    forms = [
        F.when(word.endswith(suffix), F.concat(F.left(word, F.length(word) - len(suffix)), F.lit(new)))
        for suffix, new in DETACHMENTS[part]
    ]
    return F.filter(F.array(*forms).cast("array<string>"), lambda form: form.isNotNull())


def _of_round(forms: Column, number: int) -> Column:
    return F.transform(forms, lambda form: F.struct(F.lit(number).alias("round"), form.alias("form")))


def lemma_table(
    vocabulary: DataFrame, dictionary: DataFrame, exceptions: DataFrame | None = None, part: str = "noun", rounds: int = 3
) -> DataFrame:
    """``(term, mapped)`` for the terms of a distinct ``vocabulary (term)`` whose dictionary form is another word.

    Candidates of a term with exceptions are those and the term itself; of any
    other term itself and its forms with one suffix detached, and where the
    dictionary has none of them, forms with two detached, and so on up to
    ``rounds``. The shortest known candidate is taken, of equally short ones
    the term itself, then the first by code point. Terms without a known
    candidate, and missing ones, have no row.
    """
    words = vocabulary.select("term").where(F.col("term").isNotNull())
    plain = words
    candidates = []
    if exceptions is not None:
        own = exceptions.select("term", "mapped").where(F.col("mapped").isNotNull())
        plain = words.join(own.select("term").distinct(), "term", "left_anti")
        excepted = words.join(own, "term").select("term", F.explode(F.array("term", "mapped")).alias("form"))
        candidates.append(excepted.select("term", F.lit(0).alias("round"), "form"))
    shorter, steps = F.array(F.col("term")), []
    for number in range(1, rounds + 1):
        forms = F.flatten(F.transform(shorter, lambda form: detached(form, part)))
        shorter = F.array_distinct(forms)
        tried = F.concat(F.array(F.col("term")), shorter) if number == 1 else shorter
        steps.append(_of_round(tried, number))
    candidates.append(plain.select("term", F.explode(F.concat(*steps)).alias("c")).select("term", "c.round", "c.form"))
    tried = reduce(DataFrame.unionByName, candidates)
    known = tried.join(dictionary.select("form").distinct(), "form", "left_semi")
    best = F.min(F.struct("round", F.length("form").alias("length"), (F.col("form") != F.col("term")).alias("other"), "form"))
    chosen = known.groupBy("term").agg(best.alias("best")).select("term", F.col("best.form").alias("mapped"))
    return chosen.where(F.col("mapped") != F.col("term"))


def lemmatise(
    counts: DataFrame, dictionary: DataFrame, exceptions: DataFrame | None = None, part: str = "noun", rounds: int = 3
) -> DataFrame:
    """``counts (id, term, cnt)`` with every term replaced by its dictionary form; equal ones add up."""
    counts = staged(counts, "terms")
    return map_terms(counts, lemma_table(counts.select("term").distinct(), dictionary, exceptions, part, rounds))
