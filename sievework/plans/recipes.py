"""Reshaping of the book, movie and music tables before the configured steps."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sievework.functions.numbers import nonnull_count, repair_short_year
from sievework.functions.text import quoted_tokens, split_parts
from sievework.operators.filters import above, above_quantile, differs, keep_first
from sievework.sources.files import drop_columns


def spread(df: DataFrame, parts: list, prefix: str, total: str) -> DataFrame:
    """Add columns ``prefix_1..n`` and the number of those present as ``total``."""
    names = [f"{prefix}_{i}" for i in range(1, len(parts) + 1)]
    df = df.withColumns(dict(zip(names, parts)))
    return df.withColumn(total, nonnull_count(*names))


def preprocess_books(df: DataFrame) -> DataFrame:
    """Two author columns with their count instead of the author list."""
    df = spread(df, split_parts("authors", "/", 2), "author", "total_authors")
    return drop_columns(df, ["language", "authors", "isbn"])


# Movie list columns as (list column, name of its parts, number of parts).
MOVIE_LISTS = (
    ("keywords", "keyword", "total_keywords", 4),
    ("genres", "genre", "total_genre", 4),
    ("production_companies", "production_company", "total_production_company", 4),
    ("production_countries", "production_country", "total_production_country", 3),
)
MOVIE_DROPPED = [
    "spoken_languages", "poster_path", "original_title", "original_language",
    "imdb_id", "homepage", "backdrop_path",
]


def preprocess_movies(df: DataFrame, order_by: list[str] = ()) -> DataFrame:
    """One row per id, real titles that were not canceled, lists as fixed columns.

    Which of several rows with the same id is first is told by ``order_by``.
    """
    df = keep_first(df, "id", list(order_by))
    df = differs(differs(df, "title", "Untitled"), "status", "Canceled")
    for column, prefix, total, count in MOVIE_LISTS:
        df = spread(df, split_parts(column, ",", count), prefix, total)
    return drop_columns(df, MOVIE_DROPPED + [column for column, *_ in MOVIE_LISTS])


def preprocess_music(df: DataFrame) -> DataFrame:
    """Songs above the 0.6 quantile of views, years repaired, features as columns."""
    df = above_quantile(df, "views", 0.6)
    df = above(df.withColumn("year", repair_short_year("year")), "year", 1850)
    df = spread(df, quoted_tokens("features", 3), "feature", "total_features")
    return drop_columns(df, ["features"])
