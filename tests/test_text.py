import pytest
from pyspark.sql import functions as F

from sievework.functions.text import ENGLISH_STOP_WORDS, words
from sievework.operators import terms

# Examples from the published description of the algorithm.
STEMS = {
    "caresses": "caress", "ponies": "poni", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
    "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "relational": "relat",
    "conditional": "condit", "rational": "ration", "valenci": "valenc", "hesitanci": "hesit", "digitizer": "digit",
    "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile",
    "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous",
    "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic",
    "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt",
    "homologou": "homolog", "communism": "commun", "activate": "activ", "angulariti": "angular",
    "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil",
}
REFINED = {
    "dies": "die", "died": "die", "dying": "die", "skies": "sky", "spied": "spi", "say": "say", "enjoy": "enjoy",
    "by": "by", "as": "as", "is": "is", "using": "use", "yes": "ye", "news": "news", "apologies": "apolog",
    "geologi": "geolog", "don't": "don't", "proceed": "proceed", "flying": "fli", "crying": "cri",
}


@pytest.mark.parametrize("expected", [STEMS, REFINED])
def test_stems(spark, expected):
    df = spark.createDataFrame([(w,) for w in expected], "w string")
    got = {r.w: r.stem for r in terms.stem_words(df, "w").collect()}
    assert got == expected


def test_words(spark):
    df = spark.createDataFrame([("Don't x1 stop-me 3d O'Neil's rock'n'roll _a b",), ("",), (None,)], "t string")
    got = [r.w for r in df.select(words("t").alias("w")).collect()]
    assert got[0] == ["don't", "stop", "me", "o'neil", "s", "rock'n", "roll", "b"]
    assert got[1] == [] and got[2] is None


def test_bag_of_words(spark):
    rows = [(1, "The cats and the cat"), (2, "cats don't run; runs Running!"), (3, "the"), (4, "")]
    df = spark.createDataFrame(rows, "doc int, text string")
    got = {(r.id, r.term): r.cnt for r in terms.bag_of_words(df, "doc", "text").collect()}
    assert got == {(1, "cat"): 2, (2, "cat"): 1, (2, "run"): 3}
    raw = terms.bag_of_words(df, "doc", "text", stop_words=(), stem=False)
    assert {(r.id, r.term): r.cnt for r in raw.collect()}[(1, "the")] == 2


def test_lemmas_come_before_stems(spark):
    df = spark.createDataFrame([(1, "mice mouse geese")], "doc int, text string")
    lemmas = spark.createDataFrame([("mice", "mouse"), ("geese", "goose")], "term string, mapped string")
    got = {r.term: r.cnt for r in terms.bag_of_words(df, "doc", "text", lemmas=lemmas).collect()}
    assert got == {"mous": 2, "goos": 1}


def test_prune(spark):
    rows = [(i, "often", 3) for i in range(5)] + [(1, "rare", 14), (2, "id", 15)]
    counts = spark.createDataFrame(rows, "id int, term string, cnt int")
    assert {r.term for r in terms.prune_rare_terms(counts, 15).collect()} == {"often", "id"}
    assert {r.term: r.total for r in terms.term_totals(counts).collect()} == {"often": 15, "rare": 14, "id": 15}


def test_stop_words_are_lower_case_words(spark):
    df = spark.createDataFrame([(w,) for w in ENGLISH_STOP_WORDS], "t string")
    assert df.where(F.size(words("t")) != 1).count() == 0
    assert len(set(ENGLISH_STOP_WORDS)) == len(ENGLISH_STOP_WORDS)
