import pytest
from pyspark.sql import functions as F

from sievework.operators.joins import attach_label, hot_keys, keep_known, lookup_join


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows share one key, another part has none."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.col("id").cast("string"))
    return spark.range(6000).select("id", key.alias("k")).cache()


@pytest.fixture(scope="module")
def table(spark):
    keys = [("hot", 1), (None, 2)] + [(str(i), i) for i in range(0, 6000, 2)]
    return spark.createDataFrame(keys, "k string, v int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_all_strategies_agree(rows, table, how, null_safe):
    def run(limit):
        joined = lookup_join(rows, table, "k", how, null_safe=null_safe, broadcast_rows=limit)
        return sorted(map(tuple, joined.select(sorted(joined.columns)).collect()), key=repr)

    broadcast, shuffled = run(10**6), run(0)
    assert broadcast == shuffled
    expected = {"hot": 2000, None: 120}
    assert sum(1 for r in broadcast if "hot" in r) == expected["hot"]
    if how != "left":
        assert sum(1 for r in broadcast if None in r) == (80 if null_safe else 0)


def test_hot_keys_are_few_and_found(rows):
    assert [r.k for r in hot_keys(rows, ["k"], 1000) if r.k is not None] == ["hot"]
    assert len(hot_keys(rows, ["k"], 1000)) <= 1000


def test_several_keys(rows, spark):
    table = spark.createDataFrame([("hot", 0, 1), ("4", 0, 2), (None, 1, 3)], "k string, p int, v int")
    df = rows.withColumn("p", (F.col("id") % 2).cast("int"))
    wanted = lookup_join(df, table, ["k", "p"], "inner", null_safe=True).count()
    assert wanted == lookup_join(df, table, ["k", "p"], "inner", null_safe=True, broadcast_rows=0).count()
    assert wanted == df.where("(k = 'hot' and p = 0) or (k = '4' and p = 0) or (k is null and p = 1)").count()


def test_semi_join_and_label(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "n")], "id int, term string")
    known = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (9, "c")], "id int, genre string")
    assert sorted(r.id for r in keep_known(left, known, "id").collect()) == [1, 2]
    labelled = attach_label(left, known, "id", "genre")
    assert labelled.columns == ["id", "term", "genre_GENRE"]
    assert sorted(r.genre_GENRE for r in labelled.collect()) == ["a", "b"]
