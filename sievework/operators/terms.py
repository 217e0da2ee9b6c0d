"""Bag of words as a long relation (id, term, cnt)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.stem import IRREGULAR, mark_y, stem_steps
from sievework.functions.text import ENGLISH_STOP_WORDS, words
from sievework.operators.joins import lookup_join
from sievework.session import staged


def explode_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row ``(id, term)`` per word of each text."""
    return df.select(F.col(id_col).alias("id"), F.explode(words(text_col)).alias("term"))


def drop_stop_words(terms: DataFrame, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """Rows whose term is no stop word."""
    stop_words = list(stop_words)
    return terms.where(~F.col("term").isin(stop_words)) if stop_words else terms


def count_terms(terms: DataFrame) -> DataFrame:
    """Occurrences of each term in each document."""
    return terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("cnt"))


def map_terms(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace terms by their entry in ``mapping (term, mapped)``, such as lemmas.

    Terms without an entry stay; counts of terms that become equal add up.
    """
    mapped = lookup_join(counts, mapping.select("term", "mapped"), "term", "left")
    term = F.coalesce("mapped", "term").alias("term")
    return mapped.groupBy("id", term).agg(F.sum("cnt").alias("cnt"))


def stem_words(df: DataFrame, column: str) -> DataFrame:
    """Add ``stem``, the Porter stem of a column of lower-case words."""
    word = F.col(column)
    steps = df.withColumn("stem", mark_y(word))
    for step in stem_steps():
        steps = steps.withColumn("stem", step(F.col("stem")))
    own = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    stem: Column = F.when(F.length(word) <= 2, word)
    stem = stem.when(word.isin(list(IRREGULAR)), own[word])
    return steps.withColumn("stem", stem.otherwise(F.lower("stem")))


def stem_terms(counts: DataFrame) -> DataFrame:
    """Merge terms with the same stem; each distinct term is stemmed once."""
    vocabulary = counts.select("term").distinct()
    return map_terms(counts, stem_words(vocabulary, "term").withColumnRenamed("stem", "mapped"))


def bag_of_words(
    df: DataFrame,
    id_col: str,
    text_col: str,
    *,
    stop_words: Iterable[str] = ENGLISH_STOP_WORDS,
    lemmas: DataFrame | None = None,
    stem: bool = True,
) -> DataFrame:
    """Tokenise, drop stop words, map lemmas, stem, and count terms per document."""
    counts = count_terms(drop_stop_words(explode_words(df, id_col, text_col), stop_words))
    if lemmas is not None or stem:
        counts = staged(counts, "terms")
    if lemmas is not None:
        counts = map_terms(counts, lemmas)
    return stem_terms(counts) if stem else counts


def term_totals(counts: DataFrame) -> DataFrame:
    """Occurrences of each term over all documents."""
    return counts.groupBy("term").agg(F.sum("cnt").alias("total"))


def prune_rare_terms(counts: DataFrame, min_total: int = 15) -> DataFrame:
    """Keep terms that occur at least ``min_total`` times over all documents."""
    kept = term_totals(counts).where(F.col("total") >= min_total).select("term")
    return lookup_join(counts, kept, "term", "left_semi")
