"""Byte-level BPE by tree concatenation.

Text is cut into the pattern's pieces by array operations, equal pieces of a
batch are encoded once, and a piece longer than a leaf is halved recursively:
the leaves are encoded in parallel and every join re-encodes a window around
it, growing until its outer tokens equal those of both sides. A sequence whose
neighbouring tokens all occur as neighbours in some valid encoding is valid
itself, so the result equals the encoding of the whole piece.

The vocabulary file is a parameter (``byte_bpe_50k.json`` of the public
tokenizers by default), read where tasks run. NULL and empty texts have no
tokens; repeated rows are encoded alike; any other column passes through.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import words as W

LEAF_BYTES = 2_048
WINDOW_TOKENS = 16
AGREE_TOKENS = 2
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point: white space, letter, number, other."""
    table = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "\ud800" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for found in regex.finditer(pattern, every):
            table[found.start() : found.end()] = kind
    table[0x1C:0x20] = _OTHER  # separators that only Python counts as white space
    return table


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the pieces of concatenated texts start, as indices of code points.

    A piece is an optional space with a run of letters, of numbers or of other
    characters; a contraction; or white space, of which the last character
    before a word stands apart (a plain space joins the word).
    """
    kind = _classes()[points]
    start = np.empty(len(points), bool)
    start[:1] = True
    start[1:] = kind[1:] != kind[:-1]
    first = np.zeros(len(points) + 1, bool)
    first[text_starts] = True
    first = first[:-1]
    start |= first
    after_space = np.flatnonzero(start & ~first & (kind != _SPACE))
    after_space = after_space[kind[after_space - 1] == _SPACE]
    start[after_space - 1] = True
    joined = after_space[points[after_space - 1] == 0x20]
    start[joined] = False
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        padded = np.concatenate((points, [0, 0, 0]))
        inside = np.concatenate((~first, [False, False, False]))
        one, two = padded[quote + 1], padded[quote + 2]
        near = inside[quote + 1]
        short = near & np.isin(one, [ord(c) for c in "stmd"])
        long = near & inside[quote + 2] & (
            ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        )
        for at, size in ((quote[short], 2), (quote[long], 3)):
            for inner in range(1, size):
                start[at + inner] = False
            end = at + size
            start[end[end < len(points)]] = True
    return np.flatnonzero(start)


def _piece_keys(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key per piece, equal for equal pieces: from all bytes of up to 24, else from a hash of the bytes."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1), writeable=False)
    load = lambda at: np.ascontiguousarray(eight[at]).view("<u8").ravel()
    size = end - begin
    keys = load(begin)
    small = size < 8
    keys[small] &= (np.uint64(1) << (8 * size[small]).astype(np.uint64)) - np.uint64(1)
    keys = W.mix(keys + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    over = np.flatnonzero(size > 8)
    keys[over] = W.mix(keys[over] + load(end[over] - 8))
    over = over[size[over] > 16]
    keys[over] = W.mix(keys[over] + load(begin[over] + 8))
    over = over[size[over] > 24]
    if len(over):
        keys[over] = np.array([hash(data[a:b]) for a, b in zip(begin[over].tolist(), end[over].tolist())]).view(np.uint64)
    return keys


class Encoder:
    """Encodes and decodes as the tokenizer file describes, special tokens in texts included."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, encoding="utf-8") as file:
            described = json.load(file)
        model, pre = described["model"], described["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or described["normalizer"]:
            raise ValueError("only byte-level BPE without prefix space and normalizer is supported")
        shown = self._shown_bytes()
        tokens = {bytes(shown[c] for c in token): number for token, number in model["vocab"].items() if not self._special(described, token)}
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.size = max([*tokens.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * self.size
        for token, number in tokens.items():
            self.bytes_of[number] = token
        for text, number in self.special.items():
            self.bytes_of[number] = text.encode()
        self.decimal = [b"%d," % i for i in range(self.size)]
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # ids follow the order of merges, so they serve as ranks
        self._core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=tokens, special_tokens={})
        self._piece = self._core._core_bpe.encode_single_piece
        self._pool = ThreadPoolExecutor(2)

    @staticmethod
    def _special(described: dict, token: str) -> bool:
        return any(t["content"] == token for t in described["added_tokens"])

    @staticmethod
    def _shown_bytes() -> dict[str, int]:
        """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(plain)]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def encode_piece(self, piece: bytes, leaf: int = LEAF_BYTES) -> list[int]:
        """Tokens of one unsplit piece."""
        if len(piece) <= leaf:
            return self._piece(piece)
        bounds = [0, len(piece)]
        while bounds[1] > leaf:  # halve all parts until they are leaves
            bounds = sorted({*bounds, *[(a + b) // 2 for a, b in zip(bounds, bounds[1:])]})
        parts = list(self._pool.map(self._piece, [piece[a:b] for a, b in zip(bounds, bounds[1:])]))
        while len(parts) > 1:
            pairs = [self._join(a, b) for a, b in zip(parts[0::2], parts[1::2])]
            parts = pairs + ([parts[-1]] if len(parts) % 2 else [])
        return parts[0]

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        size = WINDOW_TOKENS
        while True:
            a, b = min(size, len(left)), min(size, len(right))
            window = self._piece(b"".join([self.bytes_of[t] for t in left[len(left) - a :] + right[:b]]))
            near, agree = left[len(left) - a :], AGREE_TOKENS
            if (a == len(left) or window[:agree] == near[:agree]) and (b == len(right) or window[-agree:] == right[b - agree : b]):
                return left[: len(left) - a] + window + right[b:]
            size *= 2

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        units: list[tuple[int, str]] = []
        for i, text in enumerate(texts):
            parts = self._split.split(text) if text and self._split and self._split.search(text) else [text or ""]
            units += [(i, part) for part in parts if part]
        plain = [(i, p) for i, p in units if p not in self.special]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for (i, _), ids in zip(plain, self._encode_plain([p for _, p in plain])) if len(plain) == len(units) else ():
            out[i].append(ids)
        if len(plain) != len(units):
            encoded = iter(self._encode_plain([p for _, p in plain]))
            for i, part in units:
                out[i].append(np.array([self.special[part]], np.uint32) if part in self.special else next(encoded))
        none = np.zeros(0, np.uint32)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in out]

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        whole = "".join(texts)
        data = whole.encode("utf-8")
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        text_starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        starts = piece_starts(points, text_starts)
        if len(data) == len(points):
            at = np.append(starts, len(points))
        else:
            more = (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8)
            before = np.zeros(len(points) + 1, np.int64)
            np.cumsum(more, dtype=np.int64, out=before[1:])
            at = np.append(starts, len(points))
            at = at + before[at]
        begin, end = at[:-1], at[1:]
        _, chosen, which = np.unique(_piece_keys(data, begin, end), return_index=True, return_inverse=True)
        piece, longest = self._piece, LEAF_BYTES
        found = [
            piece(data[a:b]) if b - a <= longest else self.encode_piece(data[a:b])
            for a, b in zip(begin[chosen].tolist(), end[chosen].tolist())
        ]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for ids in found for t in ids), np.uint32, int(sizes.sum()))
        offset = np.cumsum(sizes) - sizes
        counts = sizes[which]
        ends = np.cumsum(counts)
        index = np.repeat(offset[which] - (ends - counts), counts)
        index += np.arange(len(index))
        ids = flat[index]
        piece_of_text = np.searchsorted(starts, text_starts)
        token_at = np.concatenate(([0], ends))[piece_of_text]
        return [ids[a:b] for a, b in zip(token_at[:-1].tolist(), token_at[1:].tolist())]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return b"".join(map(self.decimal.__getitem__, ids.tolist()))[:-1]


@lru_cache(2)
def encoder(vocabulary: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(vocabulary)


def with_tokens(docs: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as a struct ``row``, the ids of their texts and the text decoded from them."""
    W.ship(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>, decoded string"

    def encode(batches):
        coder = encoder(vocabulary)
        for batch in W.row_groups(batches, text):
            ids = coder.encode(batch.column(0).field(text).to_pylist())
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32))
            decoded = pa.array([coder.decode(x) for x in ids], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(ends), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], ["row", "ids", "decoded"])

    return rows.mapInArrow(W.lean(encode), schema)


def op4_bpe(spark, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Digests of ids and decoded text per document, taken where the ids are made."""
    return token_digests(W.read(spark, folder, "documents").select("doc_id", "text"), vocabulary)


def token_digests(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    W.ship(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("_body"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def digest(batches):
        coder = encoder(vocabulary)
        for batch in W.in_groups(batches, 1):
            ids = coder.encode(batch.column(1).to_pylist())
            sha = lambda data: hashlib.sha256(data).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([sha(coder.decimals(x)) for x in ids], pa.string()),
                    pa.array([sha(coder.decode(x).encode()) for x in ids], pa.string()),
                ],
                names,
            )

    return rows.mapInArrow(digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def bpe_stage(spark, docs: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Documents with the ids of their text and the text decoded from them."""
    return with_tokens(docs, vocabulary).select("row.*", F.col("ids").alias("token_ids"), F.col("decoded").alias("decoded_text"))
