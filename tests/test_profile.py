import math
import random
import statistics
from collections import Counter

import pytest

from sievework.operators import profile
from sievework.operators.phrases import word_phrases

VALUES = [1.0, 2.0, 2.0, 3.0, 4.5, 7.0, 7.5, 8.0, 40.0]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(v,) for v in VALUES] + [(None,)], "v double").cache()


def test_density_is_a_gaussian_kernel_estimate(numbers):
    curve = profile.make_density_plot(numbers, "v").orderBy("x").collect()
    n, width = len(VALUES), statistics.stdev(VALUES) * len(VALUES) ** (-1 / 5)
    assert len(curve) == 200
    assert curve[0].x == pytest.approx(min(VALUES) - 3 * width) and curve[-1].x == pytest.approx(max(VALUES) + 3 * width)
    for point in curve:
        expected = sum(math.exp(-(((v - point.x) / width) ** 2) / 2) for v in VALUES) / (n * width * math.sqrt(2 * math.pi))
        assert point.density == pytest.approx(expected, rel=1e-12)
    step = curve[1].x - curve[0].x
    assert sum(p.density for p in curve) * step == pytest.approx(1, abs=0.01)


def test_density_far_from_any_value_is_zero(spark):
    # 10,000 values in two narrow groups: most grid points are beyond the kernel's reach
    df = spark.range(200_000).selectExpr("if(id < 100000, 0, 1000000) + id % 7 AS v")
    curve = profile.make_density_plot(df, "v").collect()
    assert len(curve) == 200 and all(p.density >= 0 for p in curve)


def test_density_needs_spread(numbers):
    with pytest.raises(ValueError, match="two different values"):
        profile.make_density_plot(numbers.where("v = 2"), "v")


def test_box(numbers):
    box = profile.make_boxplot(numbers, "v").first()
    assert (box.q1, box.median, box.q3) == (2.0, 4.5, 7.5)
    assert (box.whisker_low, box.whisker_high, box.outliers) == (1.0, 8.0, 1)


def test_bars(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string")
    assert {r.category: r["count"] for r in profile.make_barplot(df, "v").collect()} == {"a": 1, "b": 2, None: 1}
    ordered = profile.make_barplot(df, "v", name="kind", order=["z", "b"]).orderBy("position").collect()
    assert [(r.kind, r["count"]) for r in ordered] == [("z", 0), ("b", 2)]
    numbers = spark.createDataFrame([(1,), (2,), (1,)], "v int")
    ordered = profile.make_barplot(numbers, "v", order=[2, 1]).orderBy("position").collect()
    assert [(r.category, r["count"]) for r in ordered] == [("2", 1), ("1", 2)]


def test_word_cloud(spark):
    df = spark.createDataFrame([("The Dog's café 42 dog",), ("Café the x9",), (None,)], "v string")
    got = [(r.word, r["count"]) for r in profile.make_word_cloud(df, "v").collect()]
    assert sorted(got) == [("café", 2), ("dog", 2), ("x9", 1)]
    assert len(profile.make_word_cloud(df, "v", top=1).collect()) == 1


def test_summary(numbers):
    row = profile.get_summary_stats(numbers, "v").first()
    assert row.mean == pytest.approx(statistics.mean(VALUES)) and row.median == statistics.median(VALUES)
    assert row.mode == 2.0 and row.stdev == pytest.approx(statistics.stdev(VALUES))


def plain_phrases(texts, threshold, stops):
    """Over lists of words of each text."""

    def folded(counts):
        form = {w: w[:-1] if w.endswith("s") and not w.endswith("ss") and w[:-1] in counts else w for w in counts}
        out = Counter()
        for w, n in counts.items():
            out[form[w]] += n
        return out, form

    def ratio(c, c1, c2, n):
        if n <= c1 or n <= c2:
            return 0.0
        likely = lambda k, m, x: math.log(max(x, 1e-10)) * k + math.log(max(1 - x, 1e-10)) * (m - k)
        p, p1, p2 = c2 / n, c / c1, (c2 - c) / (n - c1)
        return -2 * (likely(c, c1, p) + likely(c2 - c, n - c1, p) - likely(c, c1, p1) - likely(c2 - c, n - c1, p2))

    words, form = folded(Counter(w for t in texts for w in t if w not in stops))
    pairs, _ = folded(Counter(f"{a} {b}" for t in texts for a, b in zip(t, t[1:]) if a not in stops and b not in stops))
    total, left = sum(words.values()), Counter(words)
    for pair, n in pairs.items():
        a, b = (form[w] for w in pair.split(" "))
        if ratio(n, words[a], words[b], total) > threshold:
            left[a] -= n
            left[b] -= n
            left[pair] = n
    return {w: n for w, n in left.items() if n > 0}


@pytest.mark.parametrize("threshold", [0.5, 30.0])
def test_phrases(spark, threshold):
    rng = random.Random(5)
    vocabulary = "car cars red blue glass glas boss the of new york yorks bus x2 été".split()
    texts = []
    for _ in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(12))]
        if rng.random() < 0.5:
            text += rng.choice([["new", "york"], ["red", "cars"], ["red", "car"]])
        texts.append(text)
    texts += [[], ["york"], ["new"]]
    rows = [(" ".join(t[:3]) + " 42 " + " ".join(t[3:]).upper(),) for t in texts] + [(None,)]
    got = {r.word: r["count"] for r in word_phrases(spark.createDataFrame(rows, "v string"), "v", threshold, ["the", "of"]).collect()}
    assert got == plain_phrases(texts, threshold, {"the", "of"})
    assert any(" " in w for w in got) and "cars" not in got


def test_phrases_of_nothing(spark):
    assert word_phrases(spark.createDataFrame([(None,), ("",)], "v string"), "v").collect() == []
    top = profile.make_word_cloud(spark.createDataFrame([("big cats big cats",)] * 40 + [("dog xy",)] * 90, "v string"), "v", 2, phrases=True)
    assert len(top.collect()) == 2 and "big cats" in {r.word for r in word_phrases(spark.createDataFrame([("big cats",)] * 40 + [("dog",)] * 90, "v string"), "v").collect()}


def test_phrases_are_joined_once_where_the_words_are_too_many_to_broadcast(spark, monkeypatch):
    from sievework.operators import joins, phrases

    rows = [("big cats and big cat dog", )] * 40 + [("dog of the small dogs", )] * 50 + [(None,), ("",)]
    texts = spark.createDataFrame(rows, "v string")
    expected = sorted(word_phrases(texts, "v").collect())
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    read, lookup = [], phrases.lookup_join

    def watched(df, *args, **kwargs):
        read.append(df._jdf.queryExecution().executedPlan().toString())
        return lookup(df, *args, **kwargs)

    monkeypatch.setattr(phrases, "lookup_join", watched)
    assert sorted(word_phrases(texts, "v").collect()) == expected
    # the rows that a lookup reads several times come from a file, not from joins
    assert all("Join" not in plan and "Aggregate" not in plan for plan in read[-2:])
