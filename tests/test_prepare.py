import json

import pytest
from pyspark.sql import functions as F

from sievework.plans import prepare as p

CONFIG = {
    "preprocess_script_path": "preprocess_music",
    "attributes": {
        "id": {"type": "nominal"},
        "title": {"type": "nominal", "rename": "name"},
        "year": {"type": "real", "missing_values": [1900]},
        "views": {"type": "real"},
        "feature_1": {"type": "nominal"},
    },
    "cleaning": [
        {"attribute": "name", "missing_strategy": "remove"},
        {"attribute": "year", "missing_strategy": "replace_missing_with_mean"},
        {"attribute": "feature_1", "missing_strategy": "replace_missing_with_value", "args": ["none"]},
    ],
    "transforming": [
        {"attribute": "views", "action": "make_mean_bins", "args": ["freq", 2]},
        {"attribute": "year", "action": "min_max_norm"},
        {"attribute": "feature_1", "action": "merge_uncommon", "args": ["REST"], "kwargs": {"max_categories": 1}},
        {"attribute": "views", "action": "min_max_norm"},
    ],
    "plotting": [
        {"attribute": "views", "action": "make_boxplot", "name": "Views"},
        {"attribute": "feature_1", "action": "make_barplot", "name": "Features", "kwargs": {"name": "Feature"}},
        {"attribute": "name", "action": "make_word_cloud", "name": "Names"},
        {"attribute": "year", "action": "make_density_plot", "name": "Years"},
    ],
}


def raw(spark):
    rows = []
    for i in range(100):
        title = None if i == 99 else f"song number {i}"
        year = 1900 if i % 10 == 5 else 1950 + i % 7
        features = '{"A"}' if i % 3 else ("{}" if i % 2 else '{"B","C"}')
        rows.append((i, title, year, i, features))
    return spark.createDataFrame(rows, "id int, title string, year int, views int, features string")


def test_whole_job_from_config_file(spark, tmp_path):
    raw(spark).write.parquet(str(tmp_path / "raw"))
    config = CONFIG | {
        "raw_dataset_path": str(tmp_path / "raw"),
        "clean_dataset_path": str(tmp_path / "clean"),
        "plot_directory_path": str(tmp_path / "plots"),
    }
    (tmp_path / "config.json").write_text(json.dumps(config))
    saved = p.run_pipeline(spark, str(tmp_path / "config.json"))
    rows = {int(r.id): r for r in saved.collect()}
    # views above their 0.6 quantile (59.4), the last row has no title
    assert sorted(rows) == list(range(60, 99))
    # two bins of 20 and 19 rows, each at its mean, then scaled to 0 and 1
    assert {i: r.views for i, r in rows.items()} == {i: 0.0 if i < 80 else 1.0 for i in rows}
    assert {r.feature_1 for r in rows.values()} == {"A", "REST"}
    assert min(r.year for r in rows.values()) == 0.0 and max(r.year for r in rows.values()) == 1.0
    assert saved.where(F.col("year").isNull()).count() == 0
    assert spark.read.parquet(str(tmp_path / "plots/Views")).count() == 1
    bars = {r.Feature: r["count"] for r in spark.read.parquet(str(tmp_path / "plots/Features")).collect()}
    assert sum(bars.values()) == 39
    assert spark.read.parquet(str(tmp_path / "plots/Years")).count() == 200
    assert {r.word: r["count"] for r in spark.read.parquet(str(tmp_path / "plots/Names")).collect()}["song"] == 39


def test_steps_see_earlier_results(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 5.0), (3, None, 9.0)], "i int, a double, b double")
    steps = [
        p.Step("a", "replace_missing_with_mean"),
        p.Step("b", "replace_missing_with_mean"),
        p.Step("a", "replace_missing_with_value", (0,)),
    ]
    rows = p.run_steps(df, steps, p.CLEANERS).orderBy("i").collect()
    assert [(r.a, r.b) for r in rows] == [(1.0, 7.0), (3.0, 5.0), (2.0, 9.0)]
    # removing rows first changes the later mean, not the earlier one
    steps = [p.Step("a", "replace_missing_with_mean"), p.Step("b", "remove"), p.Step("a", "z_score_norm")]
    registry = p.CLEANERS | p.TRANSFORMS
    rows = p.run_steps(df, steps, registry).orderBy("i").collect()
    assert [r.a for r in rows] == pytest.approx([0.5**0.5, -(0.5**0.5)])


def test_neighbouring_steps_share_one_aggregate(spark, tmp_path):
    spark.range(100).selectExpr("id a", "id * 2 b", "id * 3 c").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    steps = [p.Step(c, "z_score_norm") for c in "abc"]
    result = p.run_steps(df, steps, p.TRANSFORMS)
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "stddev_samp(a" in plan and plan.count("ReusedSubquery") > 0
    group = "shared"
    spark.sparkContext.setJobGroup(group, group)
    p.run_steps(df, steps, p.TRANSFORMS).write.format("noop").mode("overwrite").save()
    # one job for the shared statistics (its stages may be submitted apart) and one for the result
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 3


def test_user_registered_step(spark):
    p.TRANSFORMS["double"] = lambda df, column: F.col(column) * 2
    try:
        df = p.transform_feature(spark.createDataFrame([(4,)], "v int"), "v", "double")
        assert df.first().v == 8
    finally:
        del p.TRANSFORMS["double"]


def test_unknown_names(spark):
    df = spark.createDataFrame([(4,)], "v int")
    with pytest.raises(ValueError, match="unknown step"):
        p.transform_feature(df, "v", "nope")
    with pytest.raises(ValueError, match="unknown step"):
        p.make_plot(df, "v", "nope")
    with pytest.raises(ValueError, match="unknown step"):
        p.load_data(spark, p.PrepareConfig({}, preprocess="nope"), df)
    with pytest.raises(ValueError, match="no such columns"):
        p.transform_feature(df, "w", "z_score_norm")


def test_preprocessor_is_optional(spark):
    config = {"attributes": {"v": {"type": "real"}}}
    assert p.prepare(spark, config, spark.createDataFrame([(4,)], "v int")).first().v == 4.0


def test_sentinels_are_blanked_before_the_cast(spark):
    config = {
        "attributes": {"v": {"type": "real", "missing_values": ["N/A"]}},
        "cleaning": [{"attribute": "v", "missing_strategy": "replace_missing_with_median"}],
    }
    df = spark.createDataFrame([("1",), ("N/A",), ("4",), ("2",)], "v string")
    assert sorted(r.v for r in p.prepare(spark, config, df).collect()) == [1.0, 2.0, 2.0, 4.0]
