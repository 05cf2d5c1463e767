"""Texts dealt into shards of bounded size, and keys that more than one shard or document has.

A shard is a set of rows that one task takes as a whole: its number follows from a hash of the text, so equal texts share
a shard and every pass over the table finds the same shards, also when a lost executor's tasks run again. Identical
texts are dropped before the shuffle, within each task, so that a text that a third of all rows have is shuffled once
a task.

shared() finds which 64-bit keys occur in two documents at least without a row for each key: a shard sends its distinct
keys as one sorted, delta-coded block a bucket of the key space, a bucket answers each shard with those that others have as well. A key that every
document has costs a bucket one entry a shard.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_by

#: Bytes of distinct text a shard has, about; keys a bucket has, about.
SHARD_BYTES = 6_000_000
BUCKET_KEYS = 1_500_000


def text_bytes(df: DataFrame, text_col: str) -> int:
    """How many bytes all texts have; decides the number of shards, nothing else."""
    return int(df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0)


def deal(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """shard, key (SHA-256 of the text), id (least of the rows that a task saw; null is the greatest) and text; texts once a task."""
    base = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), "text")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("shards")
        seen: dict[bytes, int] = {}
        for b in batches:
            keep = []
            for i, (doc, key) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if doc < seen.get(key, (1 << 63) + 1):  # a later row with a smaller id goes too, the shard takes the least
                    seen[key] = doc
                    keep.append(i)
            out = b.take(pa.array(keep, pa.int64()))
            shard = pa.array([int.from_bytes(k[:8], "little") % n_shards for k in out.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([shard, out.column(1), out.column(0), out.column(2)], ["shard", "key", "id", "text"])

    return base.mapInArrow(once, "shard long, key binary, id long, text string")


def distinct_texts(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's texts once each, with their least id, by id and key."""
    pdf = pdf.sort_values(["id", "key"], kind="mergesort")
    return pdf.drop_duplicates("key").reset_index(drop=True)


def pack(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned 64-bit values as bytes: deltas, one byte plane after the other."""
    delta = np.diff(values, prepend=np.uint64(0))
    planes = delta.astype("<u8").view(np.uint8).reshape(-1, 8).T
    top = 8
    while top > 1 and not planes[top - 1].any():
        top -= 1
    body = b"".join(zlib.compress(p.tobytes(), 1) if k >= 4 else p.tobytes() for k, p in enumerate(planes[:top]))
    sizes = [len(zlib.compress(p.tobytes(), 1)) if k >= 4 else len(p) for k, p in enumerate(planes[:top])]
    return np.array([len(values), top, *sizes], dtype="<u4").tobytes() + body


def unpack(block: bytes) -> np.ndarray:
    n, top = np.frombuffer(block, "<u4", 2)
    sizes = np.frombuffer(block, "<u4", int(top), 8)
    at = 8 + 4 * int(top)
    planes = np.zeros((8, int(n)), np.uint8)
    for k, size in enumerate(sizes.tolist()):
        raw = block[at : at + size]
        planes[k] = np.frombuffer(zlib.decompress(raw) if k >= 4 else raw, np.uint8)
        at += size
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Equal ranges of the key space."""
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)


def key_blocks(keys: np.ndarray, counts: np.ndarray, shard: int, n_buckets: int) -> pd.DataFrame:
    """A shard's message to each bucket: its sorted distinct keys and how many of its documents have each."""
    b = bucket_of(keys, n_buckets)
    edges = np.flatnonzero(np.diff(b, prepend=np.uint64(1 << 63))) if len(b) else np.zeros(0, np.int64)
    ends = np.append(edges[1:], len(b))
    rows = [(int(b[s]), shard, pack(keys[s:e]), pack_counts(counts[s:e])) for s, e in zip(edges.tolist(), ends.tolist(), strict=False)]
    return pd.DataFrame(rows, columns=["bucket", "shard", "keys", "counts"])


def pack_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_counts(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(block), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


BLOCKS = "bucket long, shard long, keys binary, counts binary"
ANSWERS = "shard long, keys binary, counts binary"


def answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's answers: for each shard those of its keys that two documents at least have, and how many have them."""
    parts = [unpack(k) for k in pdf["keys"]]
    every, n = np.concatenate(parts), np.concatenate([unpack_counts(c) for c in pdf["counts"]])
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    total = np.add.reduceat(n, new) if len(new) else n
    known, total = every[new][total > 1], total[total > 1]
    rows = []
    for shard, p in zip(pdf["shard"], parts, strict=True):
        if not len(known):
            break
        at = np.minimum(np.searchsorted(known, p), len(known) - 1)
        hit = known[at] == p
        if hit.any():
            rows.append((int(shard), pack(p[hit]), pack_counts(total[at[hit]])))
    return pd.DataFrame(rows, columns=["shard", "keys", "counts"])


def shared(dealt: DataFrame, blocks: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """shard, keys and counts: which of a shard's keys, as blocks() sends them, two documents of the table have."""
    return dealt.groupBy("shard").applyInPandas(blocks, BLOCKS).groupBy("bucket").applyInPandas(answer, ANSWERS)


def sizes(spark: SparkSession, total_bytes: int, keys_a_byte: float) -> tuple[int, int]:
    """Numbers of shards and buckets for a table of so many bytes of text."""
    return max(1, math.ceil(total_bytes / SHARD_BYTES)), max(1, math.ceil(total_bytes * keys_a_byte / BUCKET_KEYS))
