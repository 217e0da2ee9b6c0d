import math
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators.binning import find_cuts, frequency_ranks
from sievework.operators.order_stats import median, order_statistics, quantile
from sievework.plans.prepare import transform_feature

NUMS = (24, -38, 9, -24, -20, -7, 64, 51, -7, -93, -55, 86, -39, -96, 64, -36, 72, -53, 93, 17, 13, -64, -10, -93)
LABELS = "A B A C A C A A B C B D A B A B C A A B D A B B E A A A B C B A A".split()
FREQ_4 = (2, 1, 2, 1, 1, 2, 3, 3, 2, 0, 0, 3, 1, 0, 3, 1, 3, 0, 3, 2, 2, 0, 1, 0)


@pytest.fixture(scope="module")
def nums(spark):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(NUMS)], "i int, v double").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(list(enumerate(LABELS)), "i int, v string").cache()


def transformed(df, action, *args, **kwargs):
    return [r.v for r in transform_feature(df, "v", action, args, kwargs).orderBy("i").collect()]


def test_z_score(nums):
    got = transformed(nums, "z_score_norm")
    assert math.isclose(got[0], 0.5268001664074762, rel_tol=1e-12)
    assert math.isclose(got[23], -1.5334433813253834, rel_tol=1e-12)
    assert abs(sum(got)) < 1e-9
    assert math.isclose(sum(g * g for g in got) / 23, 1.0, rel_tol=1e-12)


def test_z_score_edges(spark):
    constant = spark.createDataFrame([(0, 5.0), (1, 5.0)], "i int, v double")
    assert transformed(constant, "z_score_norm") == [None, None]
    assert transformed(constant.limit(1), "z_score_norm") == [None]


def test_min_max(nums):
    got = transformed(nums, "min_max_norm")
    assert got[0] == 0.6349206349206349 and got[23] == 0.015873015873015872
    assert min(got) == 0.0 and max(got) == 1.0


def test_min_max_constant_and_null(spark):
    df = spark.createDataFrame([(0, 5), (1, None), (2, 5)], "i int, v int")
    assert transformed(df, "min_max_norm") == [0.0, None, 0.0]


def test_named_bins(nums):
    names = ("low", "med", "high")
    freq = "high low med med med med high high med low low high low low high med high low high high med low med low"
    assert transformed(nums, "make_named_bins", "freq", names) == freq.split()
    width = "high low high low low low high high low low low high low low high low high low high high high low low low"
    assert transformed(nums, "make_named_bins", "width", ("low", "high")) == width.split()


@pytest.mark.parametrize(
    "action, values",
    [
        ("make_mean_bins", (-75.66666666666667, -27.833333333333332, 8.166666666666666, 71.66666666666667)),
        ("make_median_bins", (-78.5, -30, 11, 68)),
        ("make_min_bins", (-96, -39, -7, 51)),
        ("make_max_bins", (-53, -10, 24, 93)),
    ],
)
def test_representative_bins(nums, action, values):
    assert transformed(nums, action, "freq", 4) == pytest.approx([values[b] for b in FREQ_4], abs=1e-12)


def test_bins_edges(spark):
    constant = spark.createDataFrame([(0, 5), (1, 5), (2, None)], "i int, v int")
    assert transformed(constant, "make_named_bins", "width", ["a", "b", "c"]) == ["c", "c", None]
    assert transformed(constant, "make_named_bins", "freq", ["a", "b", "c"]) == ["c", "c", None]
    assert transformed(constant, "make_median_bins", "freq", 3) == [5.0, 5.0, None]
    empty = constant.where("v is null")
    for cut in ("freq", "width"):
        with pytest.raises(ValueError, match="no values"):
            transformed(empty, "make_mean_bins", cut, 3)
    with pytest.raises(ValueError, match="unknown cut"):
        transformed(constant, "make_mean_bins", "depth", 3)


def test_ties_are_never_split(spark):
    values = [1] * 10 + [2] * 3 + [3] * 2
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int")
    got = transformed(df, "make_named_bins", "freq", ["a", "b", "c"])
    assert len(set(zip(values, got))) == 3


def test_frequency_ranks_take_even_shares():
    assert frequency_ranks(24, 4) == [6, 12, 18]
    assert frequency_ranks(5, 2) == [2]  # 2.5 rounds to even
    assert frequency_ranks(7, 2) == [4]  # 3.5 rounds to even
    assert frequency_ranks(1, 3) == [0, 0]


def test_width_cuts(nums):
    step = (93 - -96) / 7
    assert find_cuts(nums, "v", "width", 7) == [-96 + i * step for i in range(1, 7)]


def test_merge_uncommon(labels):
    assert transformed(labels, "merge_uncommon", "O", min_count=2) == ["O" if e == "E" else e for e in LABELS]
    assert transformed(labels, "merge_uncommon", "O", max_categories=2) == [e if e in "AB" else "O" for e in LABELS]
    assert transformed(labels, "merge_uncommon", "O", min_pct=0.15) == [e if e in "ABC" else "O" for e in LABELS]
    with pytest.raises(ValueError, match="max_categories"):
        transformed(labels, "merge_uncommon", "O")


def test_merge_uncommon_counts_null_as_a_label(spark):
    df = spark.createDataFrame(list(enumerate([None, None, "x"])), "i int, v string")
    assert transformed(df, "merge_uncommon", "O", min_count=2) == [None, None, "O"]
    assert transformed(df, "merge_uncommon", "O", max_categories=1) == [None, None, "O"]
    assert transformed(df, "merge_uncommon", "O", min_count=1) == [None, None, "x"]


def _order_statistics_case(spark, values, kind, window_rows):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    ordered = sorted(v for v in values if v is not None and v == v)
    ranks = sorted({0, len(ordered) - 1, len(ordered) // 2, len(ordered) // 3, len(ordered) // 7})
    n, at = order_statistics(df, "v", lambda n: ranks, window_rows=window_rows)
    assert n == len(ordered)
    assert at == {r: ordered[r] for r in ranks}


@pytest.mark.parametrize("window_rows", [1, 10, 1 << 18])
def test_order_statistics_match_a_sort(spark, window_rows):
    rng = random.Random(3)
    _order_statistics_case(spark, [rng.gauss(0, 1e6) for _ in range(2000)] + [None, float("nan")], "double", window_rows)
    # a third of the rows share one value
    _order_statistics_case(spark, [7] * 700 + [rng.randrange(-50, 10**12) for _ in range(1300)], "bigint", window_rows)
    _order_statistics_case(spark, [2**60 + i // 3 for i in range(600)], "bigint", window_rows)
    _order_statistics_case(spark, [5.0] * 50, "double", window_rows)


def test_quantile_interpolates(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 10)], "v int")
    assert quantile(df, "v", 0.6) == pytest.approx(3.4)
    assert quantile(df, "v", 0.0) == 1 and quantile(df, "v", 1.0) == 10
    assert median(df.where("v < 10"), "v") == 2.5
    assert quantile(df.where(F.lit(False)), "v", 0.5) is None
