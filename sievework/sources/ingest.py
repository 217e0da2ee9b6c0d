"""Ingest: keep one language and split wide rows into metadata and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.operators.filters import equals
from sievework.session import staged
from sievework.sources.files import save_parquet, scan_csv

# Columns of the raw movie and music files.
MOVIE_COLUMNS = {
    "id": "bigint", "title": "string", "vote_average": "double", "vote_count": "bigint",
    "status": "string", "release_date": "string", "revenue": "bigint", "runtime": "bigint",
    "adult": "string", "backdrop_path": "string", "budget": "bigint", "homepage": "string",
    "imdb_id": "string", "original_language": "string", "original_title": "string",
    "overview": "string", "popularity": "double", "poster_path": "string", "tagline": "string",
    "genres": "string", "production_companies": "string", "production_countries": "string",
    "spoken_languages": "string", "keywords": "string",
}
MUSIC_COLUMNS = {
    "title": "string", "tag": "string", "artist": "string", "year": "bigint", "views": "bigint",
    "features": "string", "lyrics": "string", "id": "bigint", "language_cld3": "string",
}


def split_text(df: DataFrame, key: str, text_col: str, drop: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Two projections of the same rows: (everything but the text, key and text)."""
    return df.drop(text_col, *drop), df.select(key, text_col)


def ingest_movies(spark: SparkSession, csv_path: str, metadata_path: str, text_path: str, multiline: bool = True):
    """English movies from CSV, parsed once, to a metadata and an overview table."""
    english = staged(equals(scan_csv(spark, csv_path, MOVIE_COLUMNS, multiline), "original_language", "en"), "movies")
    metadata, text = split_text(english, "id", "overview")
    save_parquet(metadata, metadata_path)
    save_parquet(text, text_path)


def ingest_music(spark: SparkSession, csv_path: str, metadata_path: str, text_path: str, multiline: bool = True):
    """English songs from CSV, parsed once, to a metadata and a lyrics table.

    Both tables hold exactly the English rows of one staged scan, so the metadata need
    no join with the ids that have lyrics; ``keep_known`` does that for tables
    of different origin.
    """
    english = staged(equals(scan_csv(spark, csv_path, MUSIC_COLUMNS, multiline), "language_cld3", "en"), "music")
    metadata, text = split_text(english, "id", "lyrics", drop=("language_cld3",))
    save_parquet(metadata, metadata_path)
    save_parquet(text, text_path)
