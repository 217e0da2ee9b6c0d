"""Secret scan: candidate strings by pattern, false positives removed by a random forest.

All of it is DataFrame expressions and Spark ML, without Python on the
executors. A candidate is a whole run of 12 or more token characters with a
digit in it. The forest sees its length, the transitions between kinds of
characters, their shares and entropy, how much of it dictionary words cover,
the path of its document and the words beside it.

The forest is trained on labelled findings (``path, before, candidate, after,
label``); ``labelled_findings`` makes FIT_ROWS of them by rule, and a caller may
pass own ones. NULL and empty texts and tables have no candidates; a NULL path
is empty. Repeated rows give repeated findings. Places are characters, ends
exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import words as W

_TOKEN = r"A-Za-z0-9_+/.\-"
CANDIDATE = rf"(?<![{_TOKEN}])(?=[A-Za-z_+/.\-]*+[0-9])[{_TOKEN}]{{12,}}+={{0,2}}"
NEAR = 48
FIT_ROWS = 6_000
TREES, DEPTH = 24, 7

DICTIONARY = (
    "about access account address admin alpha article author base beta body book build cache case chapter check class client "
    "code color column comment commit common company config content context copy core count create current data date default "
    "demo detail device dist document domain dummy edit email entry error event example field file final first font form "
    "format frame function general global group guide head header help home host html http image index info input install "
    "item java json label large last layout lib license line link list load local location login main manager map master "
    "member menu message method mode model module month name network node note number object option order output package "
    "page panel part patch path photo place placeholder player plugin point post press product profile project public query "
    "record release report request resource response result right root sample schema script search section server service "
    "session setting side site size small source space staff start state static status step store string style submit "
    "system table template test text theme time title tool topic total track type update upload user value version video "
    "view week width window word work world year your"
).split()
_SECRET_WORD = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|auth|credential|bearer|private)"
_PLAIN_WORD = r"(?i)(commit|sha|md5|checksum|digest|hash|integrity|uuid|guid|version|revision|blob|build|http|phone|card|call|isbn|doi|date)"
_PLAIN_PATH = r"(?i)(test|example|sample|fixture|mock|spec|lock|vendor|dist|min\.js|docs?/)"


def _times(pattern: str, text: Column) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(before: Column, text: Column, after: Column, path: Column) -> dict[str, Column]:
    """What the forest sees of a candidate."""
    size = F.length(text).cast("double")
    kinds = F.array_distinct(F.split(text, ""))
    part = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    entropy = F.aggregate(F.transform(kinds, part), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    covered = size - F.length(F.regexp_replace(F.lower(text), "(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", ""))
    close = F.regexp_extract(before, r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){0,3}$", 0)
    flag = lambda c: c.cast("double")
    return {
        "length": size,
        "digit_letter": (_times("[0-9](?=[A-Za-z])", text) + _times("[A-Za-z](?=[0-9])", text)) / size,
        "case_changes": (_times("[a-z](?=[A-Z])", text) + _times("[A-Z](?=[a-z])", text)) / size,
        "vowel_changes": (_times("(?i)[aeiou](?=[b-df-hj-np-tv-z])", text) + _times("(?i)[b-df-hj-np-tv-z](?=[aeiou])", text)) / size,
        "same_again": _times(r"(.)(?=\1)", text) / size,
        "digits": _times("[0-9]", text) / size,
        "upper": _times("[A-Z]", text) / size,
        "lower": _times("[a-z]", text) / size,
        "marks": _times(r"[_+/=.\-]", text) / size,
        "dots": _times(r"\.", text),
        "hex_only": flag(text.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "digits_only": flag(text.rlike(r"^[0-9.\-]+$")),
        "entropy": entropy,
        "dictionary": covered / size,
        "secret_word": flag(close.rlike(_SECRET_WORD)),
        "plain_word": flag(close.rlike(_PLAIN_WORD)),
        "assigned": flag(before.rlike(r"[=:]>?[\x20\x09]*[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "at_sign": flag(before.rlike("@$") | after.rlike("^@")),
        "plain_path": flag(path.rlike(_PLAIN_PATH)),
    }


def _pick(options: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(n, F.lit(len(options))) + 1).cast("int"))


def labelled_findings(spark, rows: int = FIT_ROWS, seed: int = 7) -> DataFrame:
    """Findings with known labels: keys and tokens in assignments against hashes, numbers, names and placeholders."""
    noise = lambda salt: F.xxhash64("id", F.lit(seed), F.lit(salt))
    hexes = F.sha2(F.concat_ws("-", F.lit(seed), "id").cast("binary"), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(F.concat(hexes, F.sha2(hexes, 256)))), r"[\s]", "")
    plain = F.regexp_replace(mixed, "[+/=]", "Q7")
    upper = F.upper(plain)
    digits = F.lpad(F.pmod(noise("d"), F.lit(10**16)).cast("string"), 16, "4")
    word = lambda salt: _pick(DICTIONARY, noise(salt))
    with_digit = lambda c: F.concat(c, F.pmod(noise("n"), F.lit(10)).cast("string"))
    cut = lambda c, n: F.substring(c, 1, n)
    secret = F.when(F.pmod("kind", F.lit(8)) == 0, cut(hexes, 40))
    for k, made in enumerate((cut(hexes, 32), cut(plain, 40), F.concat(F.lit("AKIA"), cut(upper, 15), F.lit("7")), with_digit(F.concat(F.lit("ghp_"), cut(plain, 35))), with_digit(F.concat(F.lit("sk-"), cut(plain, 47))), hexes, with_digit(cut(mixed, 24))), 1):
        secret = secret.when(F.pmod("kind", F.lit(8)) == k, made)
    address = F.concat_ws(".", *[F.pmod(noise(f"ip{i}"), F.lit(156)).cast("string") for i in range(3)], F.lit("104"))
    uuid = F.concat_ws("-", cut(hexes, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    harmless = [
        digits,
        F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 4), F.substring(digits, 9, 4)),
        address,
        uuid,
        cut(hexes, 40),
        hexes,
        cut(hexes, 32),
        with_digit(F.concat_ws("_", word("a"), word("b"), word("c"))),
        F.concat(word("a"), F.lit("/"), word("b"), F.lit("/"), with_digit(word("c")), F.lit(".html")),
        F.concat(word("a"), F.lit("-"), F.pmod(noise("v"), F.lit(9)).cast("string"), F.lit(".2.11.tar.gz")),
        F.concat(F.lit("2021-0"), (F.pmod(noise("m"), F.lit(9)) + 1).cast("string"), F.lit("-14T10")),
        F.concat(F.lit("your_"), word("a"), F.lit("_here_123")),
        F.concat(F.repeat(F.lit("x"), 14), F.lit("1234")),
        F.concat(word("a"), with_digit(word("b")), F.lit(".example.com")),
        F.concat(F.initcap(word("a")), F.initcap(word("b")), F.initcap(word("c")), F.lit("2Factory")),
        with_digit(F.concat(word("a"), F.lit("."), word("b"), F.lit("."))),
    ]
    other = reduce(lambda c, i: c.when(F.pmod("kind", F.lit(len(harmless))) == i, harmless[i]), range(1, len(harmless)), F.when(F.pmod("kind", F.lit(len(harmless))) == 0, harmless[0]))
    is_hash = F.pmod("kind", F.lit(len(harmless))).isin(4, 5, 6)
    before_secret = _pick(['token = "', 'TOKEN = "', "api_key: '", "password=", 'secret_key = "', "Authorization: Bearer ", 'set access_key "', "the auth token is ", 'credentials: "'], noise("before"))
    before_hash = _pick(["commit ", "sha256:", "md5 ", "checksum = ", 'integrity="sha512-', "revision: ", "blob "], noise("before"))
    before_other = _pick(["call ", "the ", "see http://", "version ", "in ", "id: ", 'name = "', "of the article ", "open ", "on ", 'token = "'], noise("before"))
    odd = F.pmod("kind", F.lit(len(harmless))).isin(11, 12)
    before = F.when(F.col("label") == 1, before_secret).when(is_hash, before_hash).when(odd, before_secret).otherwise(before_other)
    quote = F.regexp_extract(before, "[\"'`]$", 0)
    path = F.when(F.col("label") == 1, _pick(["src/app.py", "config/prod.env", "deploy.yml", "README.md", "", "src0", "notes.txt"], noise("path")))
    path = path.otherwise(_pick(["tests/test_api.py", "package-lock.json", "docs/guide.md", "src/app.py", "", "src0", "notes.txt"], noise("path")))
    made = spark.range(rows).withColumn("label", F.pmod(noise("label"), F.lit(2)).cast("double")).withColumn("kind", F.shiftright(noise("kind"), 8))
    return made.select(
        path.alias("path"), F.concat(_pick(["lorem ipsum ", "const ", "export ", "\n", "so then ", ""], noise("lead")), before).alias("before"),
        F.when(F.col("label") == 1, secret).otherwise(other).alias("candidate"), F.concat(quote, _pick([" and so", "\n", "", ";", " | x"], noise("after"))).alias("after"), "label",
    )


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """``doc_id, start, end, path, before, candidate, after`` of all candidates of all texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.coalesce(F.col(path), F.lit("")) if path else F.lit("")).alias("path"), F.monotonically_increasing_id().alias("_row"),
        F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)).alias("hits"), F.split(body, CANDIDATE, -1).alias("parts"),
    ).where(F.size("hits") > 0)
    around = F.arrays_zip(
        F.col("hits").alias("hit"),
        F.transform("parts", F.length).alias("gap"),
        F.transform("parts", lambda p: F.right(p, F.lit(NEAR))).alias("before"),
        F.slice(F.transform("parts", lambda p: F.substring(p, 1, NEAR)), 2, 1 << 30).alias("after"),
    )
    each = rows.select("doc_id", "path", "_row", F.posexplode(around).alias("_i", "_at")).where("_at.hit is not null")
    before = Window.partitionBy("_row").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("_at.hit")
    end = F.sum(F.col("_at.gap") + size).over(before)
    return each.select("doc_id", (end - size).alias("start"), end.alias("end"), "path", F.col("_at.before").alias("before"), F.col("_at.hit").alias("candidate"), F.col("_at.after").alias("after"))


def _with_features(found: DataFrame) -> DataFrame:
    made = features(F.col("before"), F.col("candidate"), F.col("after"), F.col("path"))
    wide = found.select("*", *[c.alias(f"_f_{n}") for n, c in made.items()])
    return VectorAssembler(inputCols=[f"_f_{n}" for n in made], outputCol="_features", handleInvalid="keep").transform(wide).drop(*[f"_f_{n}" for n in made])


def train(findings: DataFrame, seed: int = 7) -> RandomForestClassificationModel:
    """A forest over labelled findings (label 1.0 is a secret)."""
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction")
    return forest.fit(_with_features(findings))


def scan(docs: DataFrame, model: RandomForestClassificationModel, **columns) -> DataFrame:
    """All candidates with ``probability`` and ``is_secret``."""
    scored = model.transform(_with_features(candidates(docs, **columns)))
    probability = vector_to_array("_probability")[1]
    return scored.select("doc_id", "start", "end", "candidate", F.round(probability, 6).alias("probability"), (probability > 0.5).alias("is_secret"))


def op8_secret_scan(spark, folder: str) -> DataFrame:
    """Every candidate of ``documents`` with its verdict; the string itself as a digest."""
    found = scan(W.read(spark, folder, "documents"), train(labelled_findings(spark)))
    return found.select("doc_id", "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "is_secret")
