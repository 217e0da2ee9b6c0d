"""Quality rules: a learned decision list over statistics of each text.

Sequential covering (grow, prune, add) turns labelled statistics into an
ordered list of threshold conjunctions; the list becomes one CASE expression,
so the verdict itself runs inside Spark's generated code.

Empty and NULL texts have no words and fail the base rule. Repeated rows get
equal verdicts. Without labels of both kinds the list is empty and the base
rule alone decides. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import words as W

#: Labelled rows that the list is fitted on, at most; those with the lowest id hash.
FIT_ROWS = 6_000
COUNTS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_digits n_distinct n_marks n_bytes".split()
)
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(b"!?;:=_/\\[]{}()", np.uint8))
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def text_counts(text: str | None) -> list[int]:
    """The values of COUNTS for one text."""
    data = W.raw(text)
    _, _, hashes = W.word_hashes(data)
    if len(hashes) == 0:
        return [0] * (len(COUNTS) - 1) + [len(data)]
    seen, n_dup, n_lines = set(), 0, 0
    for line in text.split("\n"):
        if _WORD.search(line):
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    n_repeat = 0
    if len(hashes) > 3:
        _, group, times = np.unique(W.window_hashes(hashes, 3), return_inverse=True, return_counts=True)
        twice = np.zeros(len(hashes) + 3, np.int8)
        at = np.flatnonzero(times[group] > 1)
        for shift in range(3):
            twice[at + shift] = 1
        n_repeat = int(twice.sum())
    return [
        len(hashes),
        int(np.count_nonzero(~W.SPACE[data] & ((data & 0xC0) != 0x80))),
        int(np.count_nonzero(_SYMBOL[data])),
        n_dup,
        n_repeat,
        n_lines,
        int(np.count_nonzero((data >= 65) & (data <= 90))),
        int(np.count_nonzero((data >= 48) & (data <= 57))),
        len(np.unique(hashes)),
        int(np.count_nonzero(_MARK[data])),
        len(data),
    ]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as a struct ``row`` beside the columns of COUNTS."""
    W.ship(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.schema["row"].dataType
    schema = f"row {kept.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.row_groups(batches, text):
            values = np.array([text_counts(x.as_py()) for x in batch.column(0).field(text)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(values[:, i]) for i in range(len(COUNTS))]], ["row", *COUNTS]
            )

    return rows.mapInArrow(W.lean(count), schema)


def measures() -> dict[str, Column]:
    """What conditions may look at: ratios of counts, so that length alone decides little."""
    words, size = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "word_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / size,
        "digit_share": F.col("n_digits") / size,
        "distinct_share": F.col("n_distinct") / words,
        "mark_share": F.col("n_marks") / size,
        "line_words": F.col("n_words") / lines,
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.name] > self.cut if self.above else values[self.name] <= self.cut

    def column(self, columns: dict[str, Column]) -> Column:
        value = columns[self.name]
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(np.logical_and, [c.holds(values) for c in self.conditions])

    def column(self, columns: dict[str, Column]) -> Column:
        return reduce(Column.__and__, [c.column(columns) for c in self.conditions])


def _grow(values, bad, inside, max_conditions=4, cuts=64) -> list[Condition]:
    """Add the condition of the highest information gain until no good row is covered."""
    chosen: list[Condition] = []
    while len(chosen) < max_conditions and inside.any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if n0 == 0 or p0 == 0:
            break
        best, gain = None, 0.0
        for name, column in values.items():
            points = np.unique(np.quantile(column[inside & bad], np.linspace(0, 1, cuts)))
            points = np.unique(np.concatenate((points, np.quantile(column[inside & ~bad], [0, 0.005, 0.02, 0.98, 0.995, 1]))))
            own, other = np.sort(column[inside & bad]), np.sort(column[inside & ~bad])
            for above in (True, False):
                p = np.searchsorted(own, points, "right").astype(float)
                n = np.searchsorted(other, points, "right").astype(float)
                if above:
                    p, n = p0 - p, n0 - n
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0.0)
                at = int(g.argmax())
                if g[at] > gain + 1e-9:
                    gain, best = float(g[at]), Condition(name, above, _between(column[inside], points[at]))
        if best is None:
            break
        chosen.append(best)
        inside = inside & best.holds(values)
    return chosen


def _between(column: np.ndarray, cut: float) -> float:
    """Halfway to the next larger value: the cut that lies farthest from the rows it divides."""
    more = column[column > cut]
    return float((cut + more.min()) / 2) if len(more) else float(cut)


def _prune(conditions, values, bad, rows) -> list[Condition]:
    """Drop last conditions while the rule does better on rows it was not grown on."""

    def worth(n: int) -> float:
        hit = Rule(tuple(conditions[:n])).covers(values) & rows
        p, m = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - m) / (p + m) if p + m else -1.0

    return conditions[: max(range(1, len(conditions) + 1), key=lambda n: (worth(n), -n))]


def learn(values: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.9, least_rows: int = 3) -> list[Rule]:
    """Rules for the bad rows, in the order found; a rule stays if rows held back confirm it."""
    held = np.arange(len(bad)) % 3 == 2
    left, rules = np.ones(len(bad), bool), []
    while (left & bad & ~held).sum() >= least_rows and len(rules) < 16:
        grown = _grow(values, bad, left & ~held)
        if not grown:
            break
        rule = Rule(tuple(_prune(grown, values, bad, left & held)))
        hit = rule.covers(values) & left
        caught = int((hit & bad).sum())
        if caught < least_rows or caught < least_precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS) -> list[Rule]:
    """The decision list from labelled rows: label 0 is bad, 1 is good, others and NULL are ignored.

    A sample of at most ``fit_rows`` ids is used; contradictory labels of one id are ignored too.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id"))
    known = known.agg(F.min(label).alias("_label"), F.max(label).alias("_most")).where("_label = _most")
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows).select("_id", "_label")
    texts = docs.select(F.col(key).alias("_id"), F.col("text").alias("text"))
    rows = with_counts(texts.join(F.broadcast(sample), "_id").select("_id", "text", "_label"))
    columns = measures()
    fitted = rows.where((F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words"))).select(
        F.col("row._label").alias("_label"), F.col("row._id").alias("_id"), *[c.alias(n) for n, c in columns.items()]
    )
    table = fitted.drop_duplicates(["_id"]).toPandas().sort_values("_id", kind="stable")
    bad = table["_label"].to_numpy() == 0
    if not bad.any() or bad.all():
        return []
    return learn({n: table[n].to_numpy(float) for n in columns}, bad)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``row`` (all columns of docs), the counts, ``base_failed``, ``rule`` (number of the first rule that holds) and ``kept``."""
    counted = with_counts(docs, text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    columns = measures()
    number = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        number = F.when(rules[i].column(columns), F.lit(i)).otherwise(number)
    judged = counted.withColumn("base_failed", failed).withColumn("rule", number)
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op6_quality_rules(spark, folder: str) -> DataFrame:
    docs = W.read(spark, folder, "documents")
    rules = fit(docs, W.read(spark, folder, "labels"))
    judged = judge(docs.select("doc_id", "text"), rules)
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def quality_stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    rules = fit(docs, W.read(spark, folder, "labels"))
    return judge(docs, rules).where("kept").select("row.*")
