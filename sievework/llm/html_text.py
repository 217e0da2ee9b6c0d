"""Main text of web pages by a recurrent block labeller.

A page becomes its leaf blocks in order: runs of text between tags that start a
new block, with character references decoded and white space runs as one space.
Every block has a vector of its tag path (tags, class and id words of all open
elements, hashed), of its words (hashed) and of a few measures. A bidirectional
LSTM in numpy reads the whole sequence and gives each block the probability of
being main text; blocks over one half are joined by an empty line.

The network is trained on at most FIT_PAGES pages whose blocks the markup itself
labels (an article or main element, minus containers named as boilerplate), and
on arrangements of the same blocks in other layouts, so that it does not hang on
one set of tags. Without such pages it is trained on the arrangements alone.

NULL, empty and blank pages have empty text. Every page is read whole; repeated
rows give repeated results; broken markup is read as far as it goes.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import words as W

FIT_PAGES = 300
PATH, TAG, WORDS, MEASURES, HIDDEN = 96, 32, 32, 9, 20
WIDTH = PATH + TAG + WORDS + MEASURES

#: Element names and container words of the markup language and its common use.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head title noscript template svg math iframe object canvas select textarea button option datalist audio video".split())
RAW = frozenset("script style title textarea".split())
IN_HEAD = frozenset("base basefont bgsound html link meta noframes noscript script style template title".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
CONTENT = frozenset("article main".split())
CHROME = frozenset(
    "nav header footer aside form menu dialog ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "footer menu navbar newsletter notice notification pagination popup promo related reply replies respond share sharing sidebar social sponsor "
    "sponsored subscribe toolbar widget".split()
)

_PARTS = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


@dataclass
class Block:
    text: str
    path: bytes
    tag: int
    links: float
    depth: int
    names: frozenset


def _hash(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, list[str]]] = []
    counts, held = [0] * PATH, {}
    text: list[str] = []
    linked = total = in_link = 0

    def flush():
        nonlocal linked, total
        body = " ".join(html.unescape("".join(text)).split())
        if body:
            tag = stack[-1][0] if stack else ""
            out.append(Block(body, bytes(min(c, 1) for c in counts), _hash(tag, TAG), linked / max(total, 1), len(stack), frozenset(held)))
        text.clear()
        linked = total = 0

    def push(tag, names):
        stack.append((tag, names))
        for n in names:
            counts[_hash(n, PATH)] += 1
            held[n] = held.get(n, 0) + 1

    def pop():
        for n in stack.pop()[1]:
            counts[_hash(n, PATH)] -= 1
            held[n] -= 1
            if not held[n]:
                del held[n]

    def add(piece):
        nonlocal linked, total
        if piece:
            text.append(piece)
            size = len(piece) - piece.count(" ")
            total += size
            linked += size * (in_link > 0)

    # Silent elements that are open, and what is open inside them; an end tag of an
    # element around them ends them all, and so does a tag that a head cannot hold.
    at, silent, inside = 0, [], {}
    opened: dict[str, int] = {}
    while at < len(page):
        found = _PARTS.search(page, at)
        if not silent:
            add(page[at : found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        closing, tag = found[1], (found[2] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not closing:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if silent:
            if closing and tag in silent:
                while silent.pop() != tag:
                    pass
                inside.clear()
                continue
            if closing and inside.get(tag):
                inside[tag] -= 1
                continue
            if not ((closing and opened.get(tag)) or tag == "body" or (not closing and silent[-1] == "head" and tag not in IN_HEAD)):
                if not closing and tag in SILENT:
                    silent.append(tag)
                elif not closing and tag not in VOID:
                    inside[tag] = inside.get(tag, 0) + 1
                continue
            silent.clear()
            inside.clear()
        if tag in SILENT:
            if not closing:
                silent.append(tag)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in INLINE:
            continue
        if tag == "br":
            add(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if opened.get(tag):
                while stack:
                    top = stack[-1][0]
                    pop()
                    opened[top] -= 1
                    if top == tag:
                        break
                in_link = 0
            continue
        for gone in (*CLOSES.get(tag, ()), "p"):
            if stack and stack[-1][0] == gone:
                pop()
                opened[gone] -= 1
        names = {tag}
        for m in _NAMES.finditer(found[3] or ""):
            names |= {w for w in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if w}
        push(tag, sorted(names))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block."""
    out = np.zeros((len(blocks), WIDTH), np.float32)
    if not blocks:
        return out
    out[:, :PATH] = np.frombuffer(b"".join(b.path for b in blocks), np.uint8).reshape(-1, PATH)
    out[np.arange(len(blocks)), PATH + np.array([b.tag for b in blocks])] = 1
    n = len(blocks)
    for i, block in enumerate(blocks):
        words = block.text.split()
        bag = np.bincount([zlib.crc32(w.encode()) % WORDS for w in words], minlength=WORDS)
        out[i, PATH + TAG : PATH + TAG + WORDS] = bag / np.sqrt((bag**2).sum())
        size = len(block.text)
        out[i, -MEASURES:] = (
            np.log1p(len(words)) / 5,
            np.log1p(size) / 8,
            block.links,
            min(block.depth, 20) / 20,
            i / n,
            min(sum(map(block.text.count, ".!?")), 10) / 10,
            sum(map(str.isdigit, block.text)) / size,
            block.text[-1] in ".!?:;",
            1.0,
        )
    return out


def markup_labels(blocks: list[Block]) -> np.ndarray | None:
    """1 for blocks that the markup places in the article; None if the page has no such element."""
    inside = np.array([bool(b.names & CONTENT) for b in blocks])
    chrome = np.array([bool(b.names & CHROME) for b in blocks])
    return (inside & ~chrome).astype(np.float32) if inside.any() else None


#: Layouts for training: (path of names, whether it is main text); word counts come with the blocks put there.
_CHROME_PATHS = (
    "body nav ul li", "body header", "body header div logo", "body header nav li", "body div menu ul li", "body aside", "body aside ul li",
    "body div sidebar", "body div sidebar ul li", "body div ad", "body article div ad", "body div advert", "body div cookie notice p", "body div banner",
    "body div notice", "body footer", "body footer p", "body div footer", "body form", "body form p", "body div newsletter form p", "body div comments div comment p",
    "body section comments article comment p", "body article section comments p", "body ul comments li p", "body article aside p", "body div related ul li",
    "body article div share", "body div social", "body div breadcrumbs", "body main nav ul li", "body main aside p", "body article footer p", "body main form p",
)
_CONTENT_PATHS = (
    "body article h1", "body article p", "body article h2", "body article div p", "body main p", "body main h1", "body main article p", "body article section p",
    "body div content p", "body div post p", "body div entry content p", "body div article body p", "body main div content p", "body article ul li", "body article blockquote p",
    "body article pre", "body article table tr td", "body article figure figcaption", "body main section h2", "body div post h1", "body article ol li",
)


def _placed(text: str, path: str) -> Block:
    names = path.split()
    counts = bytearray(PATH)
    for n in ("html", *names):
        counts[_hash(n, PATH)] = 1
    tag = [n for n in names if n in ("body nav ul li header div aside footer form p section article main h1 h2 blockquote pre table tr td figure figcaption ol".split())][-1]
    links = 1.0 if names[-1] == "li" and ("nav" in names or "menu" in names or "related" in names) else 0.0
    return Block(text, bytes(counts), _hash(tag, TAG), links, len(names) + 1, frozenset(names))


def arrangements(texts: list[str], pages: int, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pages of known labels: runs of chrome blocks around and within a run of content blocks."""
    rng = np.random.default_rng(seed)
    texts = texts or ["one plain sentence of a page that has no other.", "menu", "some words more or less"]
    made = []
    for _ in range(pages):
        root = ("article", "main", "div")[rng.integers(3)]
        own = [p for p in _CONTENT_PATHS if p.split()[1] == root]

        def some(paths, low, high, share):
            found = []
            for _ in range(rng.integers(low, high)):
                path = paths[rng.integers(len(paths))]
                for _ in range(rng.integers(1, 6)):
                    text = texts[rng.integers(len(texts))]
                    found.append((_placed(" ".join(text.split()[: rng.integers(1, 60)]) or "x", path) if rng.random() < share else _placed(text, path), paths is own))
            return found

        rows = some(_CHROME_PATHS, 0, 5, 0.7) + some(own, 1, 6, 0.3)
        if rng.random() < 0.4:
            rows += some(_CHROME_PATHS, 1, 2, 0.5) + some(own, 1, 3, 0.3)
        rows += some(_CHROME_PATHS, 0, 5, 0.6)
        made.append((vectors([b for b, _ in rows]), np.array([y for _, y in rows], np.float32)))
    return made


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one logistic output per block."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    @staticmethod
    def fresh(seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)
        cell = lambda: [rng.normal(0, 0.15, (WIDTH, 4 * HIDDEN)), rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)), np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)]
        weights = [*cell(), *cell(), rng.normal(0, 0.15, 2 * HIDDEN), np.zeros(1)]
        return Labeller([w.astype(np.float32) for w in weights])

    @staticmethod
    def _run(x, mask, wx, wh, b):
        """States of one direction; x is (time, pages, width), mask (time, pages)."""
        steps, pages, _ = x.shape
        h = c = np.zeros((pages, HIDDEN), np.float32)
        pre = x @ wx + b
        states = []
        for t in range(steps):
            z = pre[t] + h @ wh
            i, f, o, g = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            c2 = m * new + (1 - m) * c
            h2 = m * (o * np.tanh(new)) + (1 - m) * h
            states.append((h, c, i, f, o, g, new, m))
            h, c = h2, c2
            states[-1] += (h,)
        return states

    def forward(self, x, mask):
        w = self.weights
        left, right = self._run(x, mask, *w[0:3]), self._run(x[::-1], mask[::-1], *w[3:6])
        both = np.concatenate((np.stack([s[-1] for s in left]), np.stack([s[-1] for s in right])[::-1]), 2)
        return _sigmoid(both @ w[6] + w[7]), both, left, right

    def gradients(self, x, mask, y):
        w = self.weights
        p, both, left, right = self.forward(x, mask)
        error = (p - y) * mask / mask.sum()
        grads = [None] * 8
        grads[6], grads[7] = np.tensordot(error, both, ((0, 1), (0, 1))), np.array([error.sum()])
        spread = error[:, :, None] * w[6]
        for k, (states, xs, dh_out) in enumerate(((left, x, spread[:, :, :HIDDEN]), (right, x[::-1], spread[::-1, :, HIDDEN:]))):
            wh = w[3 * k + 1]
            dz_all, dwh = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(wh)
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t in reversed(range(len(states))):
                h0, c0, i, f, o, g, new, m, _ = states[t]
                dh = dh + dh_out[t]
                tanh = np.tanh(new)
                dnew = m * (dc + dh * o * (1 - tanh**2))
                dz = np.concatenate((dnew * g * i * (1 - i), dnew * c0 * f * (1 - f), m * dh * tanh * o * (1 - o), dnew * i * (1 - g**2)), 1)
                dz_all[t] = dz
                dwh += h0.T @ dz
                dc = dnew * f + (1 - m) * dc
                dh = dz @ wh.T + (1 - m) * dh
            grads[3 * k] = np.tensordot(xs, dz_all, ((0, 1), (0, 1)))
            grads[3 * k + 1], grads[3 * k + 2] = dwh, dz_all.sum((0, 1))
        return grads

    def label(self, pages: list[np.ndarray], batch: int = 64) -> list[np.ndarray]:
        """Probability of main text for the blocks of each page."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        for at in range(0, len(order), batch):
            group = order[at : at + batch]
            x, mask, _ = _padded([(pages[i], np.zeros(len(pages[i]), np.float32)) for i in group])
            found = self.forward(x, mask)[0]
            for j, i in enumerate(group):
                out[i] = found[: len(pages[i]), j]
        return out


def _padded(pages):
    steps = max(len(x) for x, _ in pages)
    x, y, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, (rows, labels) in enumerate(pages):
        x[: len(rows), j], y[: len(rows), j], mask[: len(rows), j] = rows, labels, 1
    return x, mask, y


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 14, rate: float = 0.01, batch: int = 32, steps: int = 96, seed: int = 3) -> Labeller:
    """Backpropagation through time with Adam; longer pages are trained in windows of ``steps`` blocks."""
    windows = [(x[a : a + steps], y[a : a + steps]) for x, y in pages for a in range(0, len(x), steps)]
    windows.sort(key=lambda p: len(p[0]))
    model, rng = Labeller.fresh(), np.random.default_rng(seed)
    groups = [_padded(windows[a : a + batch]) for a in range(0, len(windows), batch)]
    mean, square, step = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights], 0
    for _ in range(epochs):
        for k in rng.permutation(len(groups)):
            x, mask, y = groups[k]
            step += 1
            for i, g in enumerate(model.gradients(x, mask, y)):
                g = np.clip(g, -1, 1)
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                change = rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
                model.weights[i] = (model.weights[i] - change).astype(np.float32)
    return model


def fit(pages: DataFrame, key: str = "page_id", page: str = "html", fit_pages: int = FIT_PAGES) -> Labeller:
    """The labeller from the pages of lowest id hash, at most ``fit_pages``."""
    ids = pages.select(F.col(key).alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(fit_pages)
    rows = pages.select(F.col(key).alias("_id"), F.col(page).alias("_page")).join(F.broadcast(ids), "_id")
    rows = rows.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_page")).limit(fit_pages).collect()
    read = [blocks_of(r["_page"]) for r in rows]
    labelled = [(vectors(b), y) for b in read for y in [markup_labels(b) if b else None] if y is not None]
    texts = [b.text for blocks in read for b in blocks]
    return train(labelled + arrangements(texts, fit_pages))


def main_text(page: str | None, labels: np.ndarray, blocks: list[Block]) -> str:
    return "\n\n".join(b.text for b, p in zip(blocks, labels) if p > 0.5)


def extract(pages: DataFrame, model: Labeller, page: str = "html") -> DataFrame:
    """``row`` (all columns of pages) and ``main``: the main text."""
    W.ship(pages.sparkSession)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(page).alias("_page"))

    def read(batches):
        for batch in W.pieces(batches):
            bodies = batch.column(1).to_pylist()
            blocks = [blocks_of(b) for b in bodies]
            labels = model.label([vectors(b) for b in blocks])
            texts = [main_text(p, y, b) for p, y, b in zip(bodies, labels, blocks)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "main"])

    return rows.mapInArrow(read, f"row {rows.schema['row'].dataType.simpleString()}, main string")


def op7_html_text(spark, folder: str) -> DataFrame:
    pages = W.read(spark, folder, "pages")
    found = extract(pages.select("page_id", "url", "html"), fit(pages))
    return found.select("row.page_id", "row.url", F.col("main").alias("text"), F.length("main").cast("bigint").alias("n_chars"))
