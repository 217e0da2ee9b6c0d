"""Personal data: fixed patterns, and a skip-chain conditional random field that adds spans.

The base finds e-mail, IP, card and phone strings by pattern and check. The
field then labels every word that holds a digit or an at sign (no other word
can be personal data of these kinds): unary potentials see the word's shape and
its neighbours, chain edges join neighbouring words, skip edges join repeated
words of a document (same digits, or same letters), and loopy sum-product message
passing makes their labels agree. A run of words with one label, each of at
least SURE marginal probability, becomes a span unless it meets a base span.

The field is trained by pseudo-likelihood on at most FIT_DOCS documents labelled
by the base. Without any base span in them it adds nothing.

NULL and empty texts have no spans. Places are code points, ends exclusive. All
rows are searched whole; repeated rows and ids are independent. Any other
column passes through.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import words as W

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
FIT_DOCS = 3_000
SURE = 0.9
ROUNDS, SETTLED = 30, 1e-3

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TELLING = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_EDGE = re.compile(r"^[^0-9A-Za-z+(@]*|[^0-9A-Za-z)@]*$")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not text:
        return []
    spans = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _TELLING.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            spans.append(("phone", m.start(), m.end()))
    return spans


@dataclass
class Nodes:
    """The telling words of some texts: places, features and edges."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _shape(word: str) -> list[int]:
    """Which of the shape features hold for a word."""
    digits = _NOT_DIGIT.sub("", word)
    n, dots = len(digits), word.count(".")
    steps = (1, 2, 3, 4, 5, 7, 9, 12, 16, 20)
    parts = word.strip(".,;:!?()").split(".")
    return [
        sum(n >= s for s in steps),
        11 + min(dots, 4),
        *[
            20 + i
            for i, holds in enumerate(
                (
                    "@" in word[1:-1] and "." in word.partition("@")[2],
                    word.startswith("+"),
                    word.startswith("("),
                    word.endswith(")"),
                    "-" in word,
                    n < sum(c.isalnum() for c in word),
                    len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts),
                    16 <= n <= 19 and luhn(digits),
                    n == len(word.strip(".,;:!?")),
                    len(word) > 24,
                )
            )
            if holds
        ],
    ]


_OWN = 32
FEATURES = 3 * _OWN + 1


def nodes_of(texts: list[str | None]) -> Nodes:
    owner, start, end, rows, chain, skip = [], [], [], [], [], []
    for t, text in enumerate(texts):
        if not text or not _TELLING.search(text):
            continue
        last: dict[str, int] = {}
        before_end, before = -1, -1
        for m in _WORD.finditer(text):
            word = m[0]
            if not _TELLING.search(word):
                continue
            node = len(owner)
            owner.append(t)
            start.append(m.start())
            end.append(m.end())
            rows.append(_shape(word))
            if before >= 0 and m.start() - before_end == 1:
                chain.append((before, node))
            before, before_end = node, m.end()
            digits = _NOT_DIGIT.sub("", word)
            same = digits if len(digits) >= 4 else word.strip(".,;:!?()").lower()
            if same in last:
                skip.append((last[same], node))
            last[same] = node
    features = np.zeros((len(owner), FEATURES))
    features[:, -1] = 1
    for i, held in enumerate(rows):
        features[i, held] = 1
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    chain, skip = pairs(chain), pairs(skip)
    features[chain[:, 1], _OWN : 2 * _OWN] = features[chain[:, 0], :_OWN]
    features[chain[:, 0], 2 * _OWN : 3 * _OWN] = features[chain[:, 1], :_OWN]
    ints = lambda x: np.array(x, np.int64)
    return Nodes(ints(owner), ints(start), ints(end), features, chain, skip)


@dataclass
class Field:
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """Label probabilities of every node by damped loopy message passing."""
        local = nodes.features @ self.unary
        ends = np.concatenate((nodes.chain, nodes.skip))
        source, target = np.concatenate((ends[:, 0], ends[:, 1])), np.concatenate((ends[:, 1], ends[:, 0]))
        factors = np.concatenate((np.repeat(self.chain[None], len(nodes.chain), 0), np.repeat(self.skip[None], len(nodes.skip), 0)))
        factors = np.concatenate((factors, factors.transpose(0, 2, 1)))
        reverse = np.concatenate((np.arange(len(ends), 2 * len(ends)), np.arange(len(ends))))
        sent = np.zeros((len(source), len(LABELS)))
        for _ in range(ROUNDS if len(sent) else 0):
            belief = local.copy()
            np.add.at(belief, target, sent)
            new = _log_sum((belief[source] - sent[reverse])[:, :, None] + factors, 1)
            new -= _log_sum(new, 1)[:, None]
            new = 0.5 * sent + 0.5 * new
            moved = np.abs(new - sent).max()
            sent = new
            if moved < SETTLED:
                break
        np.add.at(local, target, sent)
        return np.exp(local - _log_sum(local, 1)[:, None])


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis, keepdims=True)
    return (top + np.log(np.exp(values - top).sum(axis, keepdims=True))).squeeze(axis)


def train(nodes: Nodes, labels: np.ndarray, steps: int = 300, rate: float = 0.3, weight: float = 1e-3) -> Field:
    """Maximum pseudo-likelihood by Adam: each node given the true labels of its neighbours."""
    gold = np.eye(len(LABELS))[labels]
    shapes = [(nodes.features.shape[1], len(LABELS)), (len(LABELS),) * 2, (len(LABELS),) * 2]
    values, mean, square = ([np.zeros(s) for s in shapes] for _ in range(3))
    for step in range(1, steps + 1):
        unary, chain, skip = values
        score = nodes.features @ unary
        for edges, factor in ((nodes.chain, chain), (nodes.skip, skip)):
            np.add.at(score, edges[:, 1], gold[edges[:, 0]] @ factor)
            np.add.at(score, edges[:, 0], gold[edges[:, 1]] @ factor.T)
        error = np.exp(score - _log_sum(score, 1)[:, None]) - gold
        grads = [nodes.features.T @ error]
        for edges in (nodes.chain, nodes.skip):
            a, b = edges[:, 0], edges[:, 1]
            grads.append(gold[a].T @ error[b] + error[a].T @ gold[b])
        for i, grad in enumerate(grads):
            grad = grad / len(labels) + weight * values[i]
            mean[i] = 0.9 * mean[i] + 0.1 * grad
            square[i] = 0.999 * square[i] + 0.001 * grad**2
            values[i] = values[i] - rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return Field(*values)


def silver(nodes: Nodes, spans: list[list[tuple[str, int, int]]]) -> np.ndarray:
    """Labels of nodes by the base spans that they meet."""
    labels = np.zeros(len(nodes.text), np.int64)
    for i, (t, s, e) in enumerate(zip(nodes.text.tolist(), nodes.start.tolist(), nodes.end.tolist())):
        for kind, a, b in spans[t]:
            if a < e and s < b:
                labels[i] = LABELS.index(kind)
    return labels


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", fit_docs: int = FIT_DOCS) -> Field | None:
    """The field from the documents of lowest id hash, at most ``fit_docs`` ids, labelled by the base."""
    ids = docs.select(F.col(key).alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(fit_docs)
    telling = docs.select(F.col(key).alias("_id"), F.col(text).alias("_body")).where(F.col("_body").rlike("[0-9@]")).join(F.broadcast(ids), "_id")
    rows = telling.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_body")).limit(fit_docs).collect()
    texts = [r["_body"] for r in rows]
    spans = [base_spans(t) for t in texts]
    if not any(spans):
        return None
    nodes = nodes_of(texts)
    return train(nodes, silver(nodes, spans))


def added_spans(field: Field | None, texts: list[str | None], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Spans of the field that meet no base span."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    nodes = nodes_of(texts) if field else None
    if nodes is None or not len(nodes.text):
        return out
    probable = field.marginals(nodes)
    label = np.where(probable.max(1) >= SURE, probable.argmax(1), 0)
    joined = np.zeros(len(label), bool)
    joined[nodes.chain[:, 1]] = label[nodes.chain[:, 1]] == label[nodes.chain[:, 0]]
    heads = np.flatnonzero(~joined)
    tails = np.append(heads[1:], len(label)) - 1
    for head, tail in zip(heads.tolist(), tails.tolist()):
        if label[head]:
            t = int(nodes.text[head])
            s, e = int(nodes.start[head]), int(nodes.end[tail])
            piece = texts[t][s:e]
            left, right = (m.group() for m in list(_EDGE.finditer(piece))[:1] + list(_EDGE.finditer(piece))[-1:])
            s, e = s + len(left), e - (len(right) if len(left) < len(piece) else 0)
            if s < e and not any(a < e and s < b for _, a, b in base[t]):
                out[t].append((LABELS[label[head]], s, e))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find_pii(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """``row`` (all columns of docs), ``base`` and ``added``: arrays of kind, start, end."""
    W.ship(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("_body"))
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    made = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def search(batches):
        as_rows = lambda found: pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in found], made)
        for batch in W.pieces(batches):
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            added = added_spans(field, texts, base)
            yield pa.RecordBatch.from_arrays([batch.column(0), as_rows(base), as_rows(added)], ["row", "base", "added"])

    return rows.mapInArrow(search, f"row {rows.schema['row'].dataType.simpleString()}, base {kind}, added {kind}")


def op3_pii(spark, folder: str) -> DataFrame:
    docs = W.read(spark, folder, "documents").select("doc_id", "text")
    found = find_pii(docs, fit(docs))
    place = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    order = F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *counts,
        F.sha2(F.array_join(F.transform("base", place), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.array_sort(order), place), ",").alias("spans"),
    )
