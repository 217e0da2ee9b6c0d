import pytest
from pyspark.sql import functions as F

from sievework.functions.numbers import nan_to_null, nonnull_count, repair_short_year
from sievework.functions.text import quoted_tokens, split_parts
from sievework.operators import filters
from sievework.plans.recipes import preprocess_books, preprocess_movies, preprocess_music
from sievework.sources.files import cast_declared, drop_columns, union_chunks


def values(df, *names):
    rows = [tuple(r[n] for n in names) for r in df.orderBy("i").collect()]
    return [r[0] for r in rows] if len(names) == 1 else rows


def test_differs_keeps_missing(spark):
    df = spark.createDataFrame([(0, "Untitled"), (1, None), (2, "x")], "i int, v string")
    assert values(filters.differs(df, "v", "Untitled"), "i") == [1, 2]
    assert values(filters.equals(df, "v", "x"), "i") == [2]


def test_above_drops_missing_and_bound(spark):
    df = spark.createDataFrame([(0, 1850), (1, 1851), (2, None)], "i int, v int")
    assert values(filters.above(df, "v", 1850), "i") == [1]


def test_above_quantile_is_strict(spark):
    df = spark.createDataFrame([(i, 1) for i in range(8)] + [(8, 2), (9, 3)], "i int, v int")
    assert values(filters.above_quantile(df, "v", 0.6), "i") == [8, 9]


def test_ascii_only(spark):
    df = spark.createDataFrame([(0, "plain"), (1, "é"), (2, ""), (3, None)], "i int, v string")
    assert values(filters.ascii_only(df, "v"), "i") == [0, 2]


def test_drop_missing_sees_nan(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None)], "i int, v double")
    assert values(filters.drop_missing(df, "v"), "i") == [0]
    assert values(nan_to_null(df), "v") == [1.0, None, None]


def test_keep_first(spark):
    rows = [(0, None, 5, "a"), (1, None, 4, "b"), (2, 7, 1, "c"), (3, 7, 1, "b"), (4, 8, 9, None)]
    df = spark.createDataFrame(rows, "i int, id int, rank int, v string")
    assert values(filters.keep_first(df, "id", ["rank", "v"]), "i") == [1, 3, 4]
    assert filters.keep_first(df, "id", ["rank"]).columns == df.columns
    # a hot key is no special case
    hot = spark.range(3000).select(F.col("id").alias("i"), (F.col("id") % 2).alias("id"), F.lit("x").alias("v"))
    assert values(filters.keep_first(hot, "id", ["i"]), "i") == [0, 1]


def test_split_parts(spark):
    df = spark.createDataFrame([(0, ""), (1, "a"), (2, "a, b"), (3, "a,b,c,d,e,f"), (4, None)], "i int, v string")
    parts = df.select("i", *[c.alias(f"p{n}") for n, c in enumerate(split_parts("v", ",", 4))])
    assert values(parts, "p0", "p1", "p2", "p3") == [
        ("", None, None, None),
        ("a", None, None, None),
        ("a", " b", None, None),
        ("a", "b", "c", "d"),
        (None, None, None, None),
    ]
    assert values(df.select("i", split_parts("v", ",", 2, trim=True)[1].alias("p")), "p")[2] == "b"
    dotted = spark.createDataFrame([(0, "a.b|c")], "i int, v string")
    assert values(dotted.select("i", split_parts("v", ".", 2)[1].alias("p")), "p") == ["b|c"]
    assert values(dotted.select("i", split_parts("v", "|", 2)[0].alias("p")), "p") == ["a.b"]


def test_quoted_tokens(spark):
    rows = [(0, "{}"), (1, '{"A","B \\"x\\""}'), (2, '{"a","b","c","d","e"}'), (3, None)]
    df = spark.createDataFrame(rows, "i int, v string")
    got = df.select("i", *[c.alias(f"t{n}") for n, c in enumerate(quoted_tokens("v", 3))])
    assert values(got, "t0", "t1", "t2")[0] == (None, None, None)
    assert values(got, "t0", "t1", "t2")[1][:2] == ("A", "B ")
    assert values(got, "t0", "t1", "t2")[2] == ("a", "b", "c")
    assert values(got, "t0", "t1", "t2")[3] == (None, None, None)


def test_year_repair_and_count(spark):
    years = [0, 1, 9, 10, 24, 25, 1850, None]
    df = spark.createDataFrame(list(enumerate(years)), "i int, v int")
    assert values(df.select("i", repair_short_year("v").alias("v")), "v") == [0, 2001, 2009, 2010, 2024, 25, 1850, None]
    assert values(df.select("i", nonnull_count("i", "v").alias("n")), "n") == [2] * 7 + [1]


def test_declared_types(spark):
    df = spark.createDataFrame([(0, "1.5", 7), (1, "x", 8)], "i int, a string, b int")
    loose = cast_declared(df, {"a": "real", "b": "nominal"}, strict=False)
    assert dict(cast_declared(df, {"b": "real"}, real="float").dtypes)["b"] == "float"
    assert dict(loose.dtypes)["a"] == "double" and dict(loose.dtypes)["b"] == "string"
    assert values(loose, "a", "b") == [(1.5, "7"), (None, "8")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cast_declared(df, {"a": "real"}).collect()
    with pytest.raises(ValueError, match="no such columns"):
        cast_declared(df, {"c": "real"})
    with pytest.raises(ValueError, match="unknown attribute types"):
        cast_declared(df, {"a": "date"})
    with pytest.raises(ValueError, match="no such columns"):
        drop_columns(df, ["nope"])
    assert union_chunks([df, df, df]).count() == 6


def test_books(spark):
    rows = [(0, "A", "en", "1"), (1, "A/B", "en", "1"), (2, "A/B/C", "en", "1"), (3, None, "en", "1")]
    got = preprocess_books(spark.createDataFrame(rows, "i int, authors string, language string, isbn string"))
    assert got.columns == ["i", "author_1", "author_2", "total_authors"]
    assert values(got, "author_1", "author_2", "total_authors") == [
        ("A", None, 1), ("A", "B", 2), ("A", "B", 2), (None, None, 0),
    ]


def test_movies(spark):
    columns = (
        "i id title status keywords genres production_companies production_countries spoken_languages poster_path "
        "original_title original_language imdb_id homepage backdrop_path"
    ).split()
    base = dict.fromkeys(columns, "z")
    rows = [
        base | {"i": 0, "id": 1, "title": "first", "keywords": "a, b", "production_countries": "p,q,r,s"},
        base | {"i": 1, "id": 1, "title": "copy"},
        base | {"i": 2, "id": 2, "title": "Untitled"},
        base | {"i": 3, "id": 3, "title": None, "status": None, "genres": None},
        base | {"i": 4, "id": 4, "status": "Canceled"},
    ]
    schema = ", ".join(f"{c} {'int' if c in ('i', 'id') else 'string'}" for c in columns)
    got = preprocess_movies(spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema), ["i"])
    assert values(got, "i") == [0, 3]
    assert values(got, "keyword_1", "keyword_2", "keyword_3", "total_keywords")[0] == ("a", " b", None, 2)
    assert values(got, "production_country_3", "total_production_country")[0] == ("r", 3)
    assert values(got, "genre_1", "total_genre")[1] == (None, 0)
    assert not {"spoken_languages", "genres", "keywords", "homepage"} & set(got.columns)


def test_music(spark):
    rows = [(i, 10 * i, year, '{"A","B"}') for i, year in enumerate([1, 1900, 5, 3, 1800, 2, 12, 1850, 1851, None])]
    got = preprocess_music(spark.createDataFrame(rows, "i int, views int, year int, features string"))
    assert values(got, "i", "year") == [(6, 2012), (8, 1851)]
    assert values(got, "feature_1", "feature_2", "feature_3", "total_features")[0] == ("A", "B", None, 2)
