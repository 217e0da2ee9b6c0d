import pytest
from pyspark.sql import functions as F

from sievework.operators.filters import drop_missing
from sievework.operators.missing import blank_sentinels
from sievework.plans.prepare import fix_missing

PEOPLE = [
    (0, "Mike", "A", 36),
    (1, "Jane", None, None),
    (2, "Andy", "A", 36),
    (3, None, None, 32),
    (4, "Ellen", "B", None),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "i int, name string, grp string, age int").cache()


def column(df, name):
    return [row[name] for row in df.orderBy("i").collect()]


def test_rows_without_a_name_are_removed(people):
    kept = drop_missing(people, "name").orderBy("i").collect()
    assert [tuple(r) for r in kept] == [PEOPLE[i] for i in (0, 1, 2, 4)]


def test_value(people):
    df = fix_missing(people, "grp", "replace_missing_with_value", ["AB"])
    assert column(df, "grp") == ["A", "AB", "A", "AB", "B"]
    df = fix_missing(df, "name", "replace_missing_with_value", ["Luke"])
    assert column(df, "name") == ["Mike", "Jane", "Andy", "Luke", "Ellen"]
    df = fix_missing(df, "age", "replace_missing_with_value", [29])
    assert column(df, "age") == [36, 29, 36, 32, 29]


def test_value_for_text_column_may_be_a_number(people):
    assert column(fix_missing(people, "grp", "replace_missing_with_value", [0]), "grp") == ["A", "0", "A", "0", "B"]


def test_mode(people):
    assert column(fix_missing(people, "grp", "replace_missing_with_mode"), "grp") == ["A", "A", "A", "A", "B"]
    assert column(fix_missing(people, "age", "replace_missing_with_mode"), "age") == [36, 36, 36, 32, 36]


def test_mode_tie_is_smallest_and_no_mode_raises(spark):
    df = spark.createDataFrame([(0, 2.0), (1, 1.0), (2, None), (3, float("nan"))], "i int, v double")
    assert column(fix_missing(df, "v", "replace_missing_with_mode"), "v") == [2.0, 1.0, 1.0, 1.0]
    empty = spark.createDataFrame([(0, None)], "i int, v double")
    with pytest.raises(Exception, match="no mode"):
        fix_missing(empty, "v", "replace_missing_with_mode").collect()


def test_median(people):
    assert column(fix_missing(people, "age", "replace_missing_with_median"), "age") == [36, 36, 36, 32, 36]


def test_mean(people):
    fill = (36 + 36 + 32) / 3
    assert column(fix_missing(people, "age", "replace_missing_with_mean"), "age") == [36, fill, 36, 32, fill]


def test_all_missing_stays_missing(spark):
    df = spark.createDataFrame([(0, None), (1, None)], "i int, v double")
    for strategy in ("replace_missing_with_mean", "replace_missing_with_median"):
        assert column(fix_missing(df, "v", strategy), "v") == [None, None]


def test_unknown_strategy(people):
    with pytest.raises(ValueError, match="unknown step"):
        fix_missing(people, "age", "guess")


def test_sentinels_blank_only_their_column(people):
    df = blank_sentinels(people, {"grp": ["B"], "age": [32]})
    assert column(df, "grp") == ["A", None, "A", None, None]
    assert column(df, "age") == [36, None, 36, None, None]
    assert column(df, "name") == [r[1] for r in PEOPLE]
    assert df.where(F.col("name") == "Ellen").count() == 1


def test_sentinels_of_another_type(spark):
    df = spark.createDataFrame([(0, "N/A", 1), (1, "2", 2), (2, None, 9)], "i int, t string, n int")
    blanked = blank_sentinels(df, {"t": ["N/A", 2], "n": ["N/A", 9]})
    assert column(blanked, "t") == [None, None, None]
    assert column(blanked, "n") == [1, 2, None]
    assert column(blank_sentinels(df, {"t": []}), "t") == ["N/A", "2", None]
