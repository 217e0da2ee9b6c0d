"""Token ids on disk: one zstandard frame a document, a dictionary for all of them.

A store is a folder that Spark writes, so it lies wherever Spark can write:

- ``dictionary``: one row with the dictionary, its SHA-256, the id width and the end id;
- ``blocks``: rows of consecutive documents in ascending id order. A block keeps
  the dictionary's hash, the ids of its documents, how many ids each has, where
  each frame starts in the payload, and how many ids of its shard come before.

A document is read by taking its frame alone; no other frame is decompressed.
NULL and empty texts hold the end id only. NULL document ids sort first; repeated
ids are separate documents, ordered by a hash of their text. Documents of other
columns, whatever their names, are unaffected; an empty table makes an empty store.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import bpe
from sievework.llm import words as W
from sievework.session import scratch_path, staged

#: Documents that the dictionary is trained on, at most, and ids taken of each.
DICTIONARY_DOCS = 1_000
DICTIONARY_IDS = 4_096
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 256 << 10
SHARD_BYTES = 16 << 20
MOST_SHARDS = 1 << 16
LEVEL = 3


def _serial(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, vocabulary: str, width: int, key: str, text: str) -> bytes:
    """A dictionary from the ids of a bounded sample: the rows of lowest id hash. Empty if the sample is too small."""
    chosen = docs.select(F.col(key).alias("_id")).where("_id is not null").distinct()
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(DICTIONARY_DOCS)
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_body")).join(F.broadcast(chosen), "_id").select("_body")

    def sample(batches):
        coder = bpe.encoder(vocabulary)
        for batch in W.in_groups(batches, 0):
            found = [_serial(ids[:DICTIONARY_IDS], width) for ids in coder.encode(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["ids"])

    samples = sorted(bytes(r[0]) for r in texts.mapInArrow(sample, "ids binary").limit(2 * DICTIONARY_DOCS).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in samples if len(s) >= 8]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dictionary(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int | None = 0, key: str = "doc_id", text: str = "text") -> str:
    """Encode all documents and write their store; returns ``path``."""
    W.ship(docs.sparkSession)
    spark, vocabulary = docs.sparkSession, vocabulary or bpe.default_vocabulary()
    width = 2 if bpe.encoder(vocabulary).size <= 1 << 16 else 4
    trained = train_dictionary(docs, vocabulary, width, key, text)
    digest = hashlib.sha256(trained).hexdigest()
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def frames(batches):
        coder = bpe.encoder(vocabulary)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(trained), write_content_size=True)
        for batch in W.in_groups(batches, 2):
            ids = [np.concatenate((x, end)) for x in coder.encode(batch.column(2).to_pylist())]
            found = [press.compress(_serial(x, width)) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.binary())],
                ["doc_id", "tie", "n_tokens", "n_bytes", "frame"],
            )

    plain = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("_body"))
    framed = staged(plain.mapInArrow(frames, "doc_id bigint, tie bigint, n_tokens bigint, n_bytes bigint, frame binary"), "frames")
    total = framed.agg(F.sum("n_bytes")).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-total // SHARD_BYTES)))
    ordered = framed.repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
    ordered = ordered.withColumn("shard", F.spark_partition_id()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def blocks(batches):
        rows, size, state = [], 0, {"block": 0, "start": 0, "shard": 0}

        def block():
            offsets = np.concatenate(([0], np.cumsum([len(r[2]) for r in rows]))).tolist()
            value = {
                "shard": state["shard"], "block": state["block"], "start": state["start"], "dictionary_hash": digest,
                "doc_ids": [r[0] for r in rows], "n_tokens": [r[1] for r in rows], "offsets": offsets, "payload": b"".join([r[2] for r in rows]),
            }
            state["block"] += 1
            state["start"] += sum(r[1] for r in rows)
            return pa.RecordBatch.from_pylist([value], layout)

        for batch in batches:
            for doc, n, shard, frame in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "shard", "frame")]):
                state["shard"] = shard
                rows.append((doc, n, frame))
                size += len(frame)
                if size >= BLOCK_BYTES:
                    yield block()
                    rows, size = [], 0
        if rows:
            yield block()

    layout = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("dictionary_hash", pa.string()), ("doc_ids", pa.list_(pa.int64())),
         ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())]
    )
    schema = "shard int, block int, start bigint, dictionary_hash string, doc_ids array<bigint>, n_tokens array<bigint>, offsets array<bigint>, payload binary"
    ordered.select("doc_id", "n_tokens", "shard", "frame").mapInArrow(blocks, schema).write.option("compression", "none").option("parquet.block.size", 8 << 20).parquet(f"{path}/blocks")
    about = spark.range(1).select(F.lit(digest).alias("hash"), F.lit(bytearray(trained)).alias("dictionary"), F.lit(width).alias("width"), F.lit(end_id).cast("int").alias("end_id"))
    about.coalesce(1).write.parquet(f"{path}/dictionary")
    return path


def read_store(spark, path: str, only: list[int] | None = None, digest: bool = False) -> DataFrame:
    """``doc_id, start, ids`` of all documents, or of those in a given list; ``start`` counts all ids before.

    With ``digest`` the ids give way to their number and the CRC-32 of them as little-endian 32-bit integers.
    """
    about = spark.read.parquet(f"{path}/dictionary").first()
    blocks = spark.read.parquet(f"{path}/blocks")
    per_shard = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    bases, before = [], 0
    for shard, n in sorted(per_shard.collect()):  # at most MOST_SHARDS rows
        bases.append((shard, before))
        before += n
    base = F.broadcast(spark.createDataFrame(bases, "shard int, base bigint"))
    hash_, trained, width = about["hash"], bytes(about["dictionary"]), about["width"]
    wanted = None if only is None else set(only)
    if wanted is not None:
        blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(d)).cast("bigint") for d in sorted(wanted)])))

    def documents(batches):
        loose = zstandard.ZstdDecompressor(dict_data=_dictionary(trained))
        for batch in W.pieces(batches, 1):
            row = batch.to_pylist()[0]
            if row["dictionary_hash"] != hash_:
                raise ValueError("a block was written with another dictionary")
            payload, offsets, start = memoryview(row["payload"]), row["offsets"], row["start"]
            docs, starts, ids = [], [], []
            for i, (doc, n) in enumerate(zip(row["doc_ids"], row["n_tokens"])):
                if wanted is None or doc in wanted:
                    frame = payload[offsets[i] : offsets[i + 1]]
                    docs.append(doc)
                    starts.append(start)
                    ids.append(np.frombuffer(loose.decompress(frame), f"<u{width}"))
                start += n
            sizes = [len(x) for x in ids]
            columns = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64())]
            if digest:
                columns += [pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
            else:
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", *(["n_tokens", "ids_crc32"] if digest else ["ids"])]
    based = blocks.join(base, "shard").select("dictionary_hash", "doc_ids", "n_tokens", "offsets", "payload", (F.col("start") + F.col("base")).alias("start"))
    return based.mapInArrow(documents, "doc_id bigint, start bigint, " + ("n_tokens bigint, ids_crc32 bigint" if digest else "ids array<int>"))


def op9_token_store(spark, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Writes the store of ``documents`` and returns what its files say of each document."""
    return read_store(spark, write_store(W.read(spark, folder, "documents"), scratch_path(spark, "tokens"), vocabulary), digest=True)
