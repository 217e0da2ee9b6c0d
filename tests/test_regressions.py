"""Values that once came out wrong."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sievework.operators import categories, filters, joins, missing, profile, sampling, scaling
from sievework.plans import prepare
from sievework.sources import arff, files


def test_text_nan_of_a_declared_real_is_missing(spark):
    config = {
        "raw_dataset_path": "-", "clean_dataset_path": "-", "plot_directory_path": "-",
        "attributes": {"v": {"type": "real"}}, "cleaning": [], "transforming": [{"attribute": "v", "action": "z_score_norm"}], "plotting": [],
    }
    rows = prepare.prepare(spark, config, spark.createDataFrame([("1",), ("NaN",), ("4",)], "v string")).collect()
    values = sorted((r.v for r in rows), key=lambda v: (v is None, v))
    assert values[2] is None and values[0] == pytest.approx(-math.sqrt(0.5)) and values[1] == pytest.approx(math.sqrt(0.5))


def test_nan_is_missing_in_profiles_and_scaling(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (float("nan"),), (None,)], "v double")
    assert profile.make_boxplot(df, "v").first().outliers == 0
    assert profile.get_summary_stats(df, "v").first().mean == pytest.approx(7 / 3)
    scaled = [r.v for r in df.select(scaling.min_max_norm(df, "v").alias("v")).collect()]
    assert scaled[0] == 0.0 and scaled[2] == 1.0 and scaled[3] is None


def test_integer_sentinels_are_exact(spark):
    df = spark.createDataFrame([(9007199254740993,), (9007199254740992,), (7,)], "v bigint")
    kept = [r.v for r in missing.blank_sentinels(df, {"v": [9007199254740993, None, "7.0", "x", float("nan")]}).collect()]
    assert kept == [None, 9007199254740992, None]
    df = spark.createDataFrame([(Decimal("1.10"),), (Decimal("1.20"),)], "v decimal(10,2)")
    assert [r.v for r in missing.blank_sentinels(df, {"v": [1.1]}).collect()] == [None, Decimal("1.20")]


def test_rare_numbers_merge_into_a_text_label(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "v int")
    assert sorted(r.v for r in categories.merge_uncommon(df, "v", max_categories=1).collect()) == ["1", "1", "OTHER", "OTHER"]


@pytest.mark.parametrize(
    ("value", "text"),
    [(123456789.0, "_123456789.0"), (0.0001, "_0.0001"), (1e16, "_1e+16"), (0.00001, "_1e-05"), (1.5, "_1.5"), (-2.5e7, "_-25000000.0"), (1.25e-7, "_1.25e-07"), (123456789012345.6, "_123456789012345.6")],
)
def test_double_labels_are_plain(spark, value, text):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(arff.label_text(df, "v").alias("t")).first().t == text


def test_keep_first_with_maps(spark):
    df = spark.createDataFrame([(1, {"b": 2}), (1, {"a": 1}), (2, None)], "k int, m map<string,int>")
    assert {r.k: r.m for r in filters.keep_first(df, "k", []).collect()} == {1: {"a": 1}, 2: None}


def test_csv_whole_numbers_and_missing_texts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,z\n120.0,NA,1.5\n7,text,nan\n8.5,None,2\n")
    rows = files.scan_csv(spark, str(tmp_path / "a.csv"), {"x": "bigint", "y": "string", "z": "double"}).collect()
    assert [tuple(r) for r in rows] == [(120, None, 1.5), (7, "text", None), (None, None, 2.0)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.scan_csv(spark, str(tmp_path / "a.csv"), {"x": "bigint"}, strict=True).collect()


def test_csv_files_of_another_column_order_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.scan_csv(spark, str(tmp_path), {"x": "bigint", "y": "bigint"}).collect()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_keys_beyond_the_broadcast_limit_are_salted(spark, how):
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), "id")
    table = spark.range(70).select((F.col("id") % 10).alias("k"), F.col("id").alias("w"))
    plain = sorted(map(tuple, df.join(table, "k", how).collect()))
    assert sorted(map(tuple, joins.lookup_join(df, table, "k", how, broadcast_rows=0).select(*df.join(table, "k", how).columns).collect())) == plain


def test_folds_are_dealt_alike_for_any_number_of_ranges(spark, monkeypatch):
    df = spark.range(2000).select("id", (F.col("id") % 3 > 0).cast("int").alias("label"))
    few = {r.id: r.fold for r in sampling.stratified_folds(df, "id", "label").collect()}
    monkeypatch.setattr(sampling, "RANGE_ROWS", 5)
    assert {r.id: r.fold for r in sampling.stratified_folds(df, "id", "label").collect()} == few
