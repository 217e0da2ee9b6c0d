import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.operators import metrics, naive_bayes, sampling
from sievework.operators.mutual_information import mutual_information, select_terms
from sievework.operators.neighbour_information import digamma, neighbour_information

DOCS = {1: "a a b", 2: "a c", 3: "b b c", 4: "c", 5: "", 6: "a d d d", 7: "b d"}
LABELS = {1: "x", 2: "x", 3: "y", 4: "y", 5: "z", 6: "x", 7: "z"}


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(i, t, n) for i, text in DOCS.items() for t, n in Counter(text.split()).items()]
    return spark.createDataFrame(rows, "id int, term string, cnt int").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(list(LABELS.items()), "id int, label string").cache()


def test_mutual_information_is_that_of_the_joint_table(counts, labels):
    got = {r.term: r.mi for r in mutual_information(counts, labels).collect()}
    n = len(LABELS)
    for term in "abcd":
        seen = {i: DOCS[i].split().count(term) for i in DOCS}
        joint = Counter((seen[i], LABELS[i]) for i in DOCS)
        by_count, by_label = Counter(seen.values()), Counter(LABELS.values())
        mi = sum(c / n * math.log(c * n / (by_count[k] * by_label[y])) for (k, y), c in joint.items())
        assert got[term] == pytest.approx(mi, abs=1e-12)


def test_select_terms(counts, labels):
    scores = mutual_information(counts, labels)
    ranked = [r.term for r in scores.orderBy(F.round("mi", 12).desc(), "term").collect()]
    assert [r.term for r in select_terms(scores, 2).collect()] == ranked[:2]


def test_naive_bayes_scores(counts, labels):
    train = labels.where("id <= 5")
    model = naive_bayes.fit(counts, train)
    got = {r.id: {s.label: s.score for s in r.scores} for r in naive_bayes.scores(model, counts, labels).collect()}
    in_train = {i: DOCS[i].split() for i in DOCS if i <= 5}
    vocabulary = {t for words in in_train.values() for t in words}
    for i, text in DOCS.items():
        for y in "xyz":
            bag = Counter(t for j, words in in_train.items() if LABELS[j] == y for t in words)
            docs = sum(1 for j in in_train if LABELS[j] == y)
            expected = math.log(docs / 5) + sum(
                math.log((bag[t] + 1) / (sum(bag.values()) + len(vocabulary))) for t in text.split() if t in vocabulary
            )
            assert got[i][y] == pytest.approx(expected, abs=1e-12)


def test_naive_bayes_predicts_smallest_label_on_ties(spark):
    counts = spark.createDataFrame([(1, "a", 1), (2, "a", 1)], "id int, term string, cnt int")
    labels = spark.createDataFrame([(1, "q"), (2, "p")], "id int, label string")
    model = naive_bayes.fit(counts, labels)
    assert {r.prediction for r in naive_bayes.predict(model, counts, labels).collect()} == {"p"}


def test_metrics(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), ("a", "a")]
    df = spark.createDataFrame(pairs, "label string, prediction string")
    row = metrics.accuracy_and_f1(df).first()
    assert row.accuracy == pytest.approx(4 / 6)
    f1 = {"a": 2 * 2 / (3 + 3), "b": 2 * 2 / (2 + 3), "c": 0.0}
    assert row.f1 == pytest.approx((3 * f1["a"] + 2 * f1["b"] + 1 * f1["c"]) / 6)
    assert {(r.label, r.prediction): r.n for r in metrics.confusion(df).collect()} == Counter(pairs)
    per_class = {r["class"]: r for r in metrics.class_scores(df).collect()}
    assert per_class["c"].precision == 0.0 and per_class["b"].recall == 1.0
    assert metrics.majority_baseline(df, "label").first().asDict() == {"label": "a", "share": 0.5}
    top = metrics.class_distribution(df, "label", 2).collect()
    assert [(r.label, r.n, r.classes) for r in top] == [("a", 3, 3), ("b", 2, 3)]


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000)
    first = {r.id for r in sampling.sample_rows(df, 137, "id").collect()}
    assert len(first) == 137
    assert first == {r.id for r in sampling.sample_rows(df.repartition(7), 137, "id").collect()}
    assert first != {r.id for r in sampling.sample_rows(df, 137, "id", seed=1).collect()}
    assert sampling.sample_rows(df, 0, "id").count() == 0
    assert sampling.sample_rows(df, 1000, "id").count() == 1000
    with pytest.raises(ValueError, match="without replacement"):
        sampling.sample_rows(df, 1001, "id")


def test_sample_with_repeated_keys(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("k"), "id")
    sample = [r.id for r in sampling.sample_rows(df, 150, "k").collect()]
    assert len(sample) == len(set(sample)) == 150
    copies = df.select("k")
    drawn = Counter(r.k for r in sampling.sample_rows(copies, 150, "k").collect())
    assert sum(drawn.values()) == 150 and sorted(drawn.values()) == [50, 100]


@pytest.mark.parametrize("rows", [1, 4, 5, 6, 999])
def test_split_sizes(spark, rows):
    split = sampling.train_test_split(spark.range(rows), "id")
    assert split.where("is_test").count() == math.ceil(0.2 * rows)


def test_folds_are_stratified(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("aaaaab")) for i in range(2003)] + [(5000, None), (5001, None)]
    df = spark.createDataFrame(rows, "id int, label string")
    folded = sampling.stratified_folds(df, "id", "label")
    assert folded.count() == len(rows)
    sizes = Counter((r.label, r.fold) for r in folded.collect())
    for label in ("a", "b", None):
        per_fold = [sizes.get((label, f), 0) for f in range(5)]
        assert max(per_fold) - min(per_fold) <= 1


def psi(n):
    return -0.5772156649015329 + math.fsum(1 / i for i in range(1, n))


def plain_neighbour_information(values, classes, neighbours):
    """Document by document; ties at the k-th distance count on both sides."""
    keep = [i for i, c in enumerate(classes) if classes.count(c) > 1]
    total, n = 0.0, len(keep)
    for i in keep:
        own = sorted(abs(values[i] - values[j]) for j in keep if j != i and classes[j] == classes[i])
        radius = own[min(neighbours, len(own)) - 1]
        k = sum(d <= radius for d in own)
        m = sum(abs(values[i] - values[j]) <= radius for j in keep if j != i)
        total += psi(k) - psi(m) - psi(len(own) + 1)
    return max(0.0, psi(n) + total / n)


def test_digamma(spark):
    numbers = [1, 2, 3, 15, 16, 17, 100, 12345]
    found = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", digamma(F.col("n")).alias("p")).collect()
    assert {r.n: r.p for r in found} == pytest.approx({n: psi(n) for n in numbers}, abs=1e-12)


@pytest.mark.parametrize("neighbours", [1, 3])
def test_neighbour_information_is_that_of_the_documents(spark, neighbours):
    rng = random.Random(neighbours)
    classes = [rng.choice("aaabbcd") for _ in range(80)] + ["single", "pair", "pair"]
    terms = {
        "often": [rng.randrange(6) for _ in classes],
        "telling": [rng.randrange(3) + 9 * (c == "a") for c in classes],
        "apart": [i * i for i in range(len(classes))],  # no two distances are equal: the published estimator
        "rare": [int(i == 3) for i in range(len(classes))],
        "in a": [int(c == "a") for c in classes],
    }
    rows = [(i, t, v) for t, values in terms.items() for i, v in enumerate(values) if v]
    counts = spark.createDataFrame(rows, "id int, term string, cnt int")
    labels = spark.createDataFrame(list(enumerate(classes)), "id int, label string")
    got = {r.term: r.mi for r in neighbour_information(counts, labels, neighbours).collect()}
    assert got == pytest.approx({t: plain_neighbour_information(v, classes, neighbours) for t, v in terms.items()}, abs=1e-10)
    assert got["telling"] > got["often"]


def test_neighbour_information_of_no_documents(spark):
    counts = spark.createDataFrame([(1, "a", 2)], "id int, term string, cnt int")
    assert neighbour_information(counts, spark.createDataFrame([(1, "x")], "id int, label string")).collect() == []


def test_poisson_weights_have_the_moments_of_their_law(spark):
    weights = spark.range(200_000).select(metrics.poisson_weight(F.xxhash64("id")).alias("w"))
    mean, variance, none = weights.agg(F.avg("w"), F.var_samp("w"), F.avg((F.col("w") == 0).cast("int"))).first()
    assert mean == pytest.approx(1, abs=0.01) and variance == pytest.approx(1, abs=0.02) and none == pytest.approx(math.exp(-1), abs=0.005)


def test_score_intervals(spark):
    rng = random.Random(3)
    rows = [(i, (label := rng.choice("aab")), label if rng.random() < 0.8 else rng.choice("abc")) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, label string, prediction string")
    found = {r.metric: r for r in metrics.score_intervals(df, "id").collect()}
    plain = metrics.accuracy_and_f1(df).first()
    right = plain.accuracy
    assert found["accuracy"].value == pytest.approx(right) and found["f1"].value == pytest.approx(plain.f1)
    half = 1.96 * math.sqrt(right * (1 - right) / len(rows))  # of the normal approximation
    for side, at in (("low", right - half), ("high", right + half)):
        assert found["accuracy"][side] == pytest.approx(at, abs=half / 2)
    assert found["f1"].low < plain.f1 < found["f1"].high
    assert sorted(map(tuple, metrics.score_intervals(df.repartition(7), "id").collect())) == sorted(map(tuple, found.values()))
    sure = metrics.score_intervals(df.withColumn("prediction", F.col("label")), "id", replicates=5).collect()
    assert all(r.value == r.low == r.high == 1 for r in sure)
    assert metrics.score_intervals(df.limit(0), "id").collect() == []
