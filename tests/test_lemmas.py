import pytest

from sievework.operators import lemmas, terms


def lemma_of(spark, words, known, exceptions=(), part="noun", rounds=3):
    vocabulary = spark.createDataFrame([(w,) for w in words], "term string")
    dictionary = spark.createDataFrame([(w,) for w in known], "form string")
    own = spark.createDataFrame(list(exceptions), "term string, mapped string") if exceptions else None
    return {r.term: r.mapped for r in lemmas.lemma_table(vocabulary, dictionary, own, part, rounds).collect()}


def plain(word, known, part, rounds):
    """The rules by hand: shortest known form of the first round that has one."""
    forms = [word]
    for number in range(rounds):
        forms = [f[: len(f) - len(s)] + new for f in forms for s, new in lemmas.DETACHMENTS[part] if f.endswith(s)]
        found = [f for f in forms + [word] * (number == 0) if f in known]
        if found:
            return min(found, key=lambda f: (len(f), f != word, f))
    return word


NOUNS = "cats classes wolves boxes buzzes churches dishes women ponies glass bus buses unknowns dogsses s".split()
KNOWN = "cat class wolf box buzz church dish woman women pony glass bus dog".split()


def test_noun_rules(spark):
    got = lemma_of(spark, NOUNS, KNOWN)
    assert got == {
        "cats": "cat", "classes": "class", "wolves": "wolf", "boxes": "box", "buzzes": "buzz", "churches": "church",
        "dishes": "dish", "ponies": "pony", "buses": "bus", "dogsses": "dog",
    }
    assert lemma_of(spark, ["dogsses"], KNOWN, rounds=1) == {}


@pytest.mark.parametrize("part", list(lemmas.DETACHMENTS))
def test_rules_equal_a_plain_version(spark, part):
    stems = ["walk", "bake", "hop", "try", "tall", "fine", "gas"]
    words = [s + e for s in stems for e in ("", "s", "es", "ed", "d", "ing", "er", "est", "ses", "ingss")]
    known = {*stems, "bak", "walke", "hops"}
    expected = {w: plain(w, known, part, 3) for w in words}
    assert lemma_of(spark, words, known, part=part) == {w: m for w, m in expected.items() if w != m}


def test_exceptions_come_instead_of_rules(spark):
    own = [("mice", "mouse"), ("geese", "goose"), ("axes", "axis"), ("axes", "ax"), ("lives", "unheard"), ("odd", None)]
    words = ["mice", "geese", "axes", "lives", "odd", "absent"]
    assert lemma_of(spark, words, ["mouse", "axis", "ax", "life", "axe", "odd"], own) == {"mice": "mouse", "axes": "ax"}


def test_counts_of_one_lemma_add_up(spark):
    counts = spark.createDataFrame([(1, "cats", 2), (1, "cat", 1), (2, "cats", 1), (2, "xs", 4), (3, None, 1)], "id int, term string, cnt int")
    dictionary = spark.createDataFrame([("cat",), ("cat",), (None,)], "form string")
    got = {(r.id, r.term): r.cnt for r in lemmas.lemmatise(counts, dictionary).collect()}
    assert got == {(1, "cat"): 3, (2, "cat"): 1, (2, "xs"): 4, (3, None): 1}
    assert lemmas.lemmatise(counts.limit(0), dictionary).count() == 0


def test_lemma_table_feeds_the_bag_of_words(spark):
    df = spark.createDataFrame([(1, "ponies pony")], "doc int, text string")
    vocabulary = spark.createDataFrame([("ponies",), ("pony",)], "term string")
    table = lemmas.lemma_table(vocabulary, spark.createDataFrame([("pony",)], "form string"))
    got = {r.term: r.cnt for r in terms.bag_of_words(df, "doc", "text", lemmas=table, stem=False).collect()}
    assert got == {"pony": 2}
