"""Media columns by content-defined chunking: each text becomes a padded payload of 8-bit samples, a chunk store keeps each
distinct chunk once, and media are rebuilt from the store and their ordered chunk lists alone, and verified.

A payload is cut where a rolling gear hash of its last 32 bytes has its top bits zero, so equal passages give equal chunks
wherever they stand. Chunk digests meet in a Spark aggregation: a digest that occurs more than once is owned by its first
occurrence by payload key and place, and only the owner's bytes are written. store() writes two tables: lists, the digests of
each payload in order, and chunks, one row for each distinct chunk with its bytes, in buckets by the key of the payload that owns
it. Reading back, a payload's own chunks come from its bucket without a shuffle, and the others by a join of the list with the
chunks that are flagged as shared.

Identical payloads are one medium (the key is the payload's SHA-256), so exact copies collapse within a task before
anything is shuffled. Payloads are compressed before their one shuffle. Joins by digest start from written tables, so a digest that a
third of all rows share is split by adaptive skew handling.

Defined results: null text is the empty payload, padded to 64 zero bytes like any empty text. Ids may be null or repeated;
rows keep their number. Only id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir

UNIT = 64
LEAST, MOST, CUT_BITS = 512, 16384, 11
RATE = 8000


def gear_table(seed: int = 1) -> np.ndarray:
    """256 numbers of 32 bits from a seed."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


_GEAR = gear_table()


def cuts(payload: bytes) -> list[int]:
    """Where chunks end: the last place is the payload's length."""
    n = len(payload)
    if n <= LEAST:
        return [n]
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    span = 1
    while span < 32:  # h[i] is the gear hash of the span bytes that end at i
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] << np.uint32(span)
        h = h + shifted
        span *= 2
    places = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    out, at = [], 0
    for p in [*places, n]:
        while p - at > MOST:
            at += MOST
            out.append(at)
        if p - at >= LEAST and p < n:
            out.append(p)
            at = p
    if at < n:
        out.append(n)
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunks(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def medium(samples: bytes) -> bytes:
    """The stored form: a RIFF/WAVE file of one channel of unsigned 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def samples_of(media: bytes) -> bytes:
    """The samples that a stored form holds."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a stored medium")
    return media[44 : 44 + struct.unpack_from("<I", media, 40)[0]]


def restore(order: list[bytes], found: dict[int, bytes]) -> bytes:
    """The stored form, from the ordered chunk list and the chunks found by place; every chunk is held against its digest."""
    parts = []
    for i, digest in enumerate(order):
        if i not in found:
            raise ValueError("a chunk is missing from the store")
        if digest_of(found[i]) != digest:
            raise ValueError("a chunk differs from its digest")
        parts.append(found[i])
    return medium(b"".join(parts))


def feature(samples: bytes) -> str:
    """Level, spread, zero crossings about the middle and the loudest of eight equal stretches."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    centred = x - 128
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    loud = [int(np.abs(s).sum()) for s in np.array_split(centred, 8)]
    return f"mean={int(x.sum()) * 1000 // len(x)};energy={int((centred**2).sum()) // len(x)};crossings={crossings};loudest={loud.index(max(loud))}"


def _payload(text: Column) -> tuple[Column, Column]:
    """The payload and its length before padding."""
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    n = F.octet_length(raw)
    pad = F.when(n == 0, F.lit(UNIT)).otherwise((UNIT - n % UNIT) % UNIT)
    zeros = F.array(*[F.lit(bytes(k)) for k in range(UNIT + 1)])
    return F.concat(raw, F.element_at(zeros, pad + 1)), n.cast("long")


@dataclass
class Stored:
    """rows: id, n_bytes and k of each row; lists: k, pos, digest; foreign: those whose bytes another payload owns;
    chunks: k, pos, digest, shared and chunk, each distinct chunk once, at its owner."""

    rows: DataFrame
    lists: DataFrame
    foreign: DataFrame
    chunks: DataFrame


def _written_in_buckets(df: DataFrame, key: str) -> DataFrame:
    """The table, written in buckets of key, as many as a shuffle has partitions."""
    spark, name = df.sparkSession, f"terravane_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).sortBy(key).option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").saveAsTable(name)
    return spark.table(name)


def _sliced(rows: Iterator[tuple], kinds: tuple[pa.DataType, ...], names: list[str], size_of, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Rows in batches of bounded bytes."""
    part: list[tuple] = []
    size = 0
    for r in rows:
        part.append(r)
        size += size_of(r)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in part], t) for j, t in enumerate(kinds)], names)
            part, size = [], 0
    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in part], t) for j, t in enumerate(kinds)], names)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Stored:
    """Write the chunk lists and the chunk store of a table's texts."""
    payload, n_bytes = _payload(F.col(text_col))
    keyed = df.select(F.col(id_col).alias("id"), n_bytes.alias("n_bytes"), payload.alias("p")).withColumn("k", F.unhex(F.sha2("p", 256)))

    def first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
        seen = set()
        for b in batches:
            for k, p in zip(b.column(0), b.column(1), strict=True):
                if (key := k.as_py()) not in seen:
                    seen.add(key)
                    yield key, p.as_py()

    def cut_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, i, digest_of(c)) for k, p in first_seen(batches) for i, c in enumerate(chunks(p)))
        return _sliced(rows, (pa.binary(), pa.int32(), pa.binary()), ["k", "pos", "digest"], lambda r: 64)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return _sliced(((k, squeeze(p)) for k, p in first_seen(batches)), (pa.binary(), pa.binary()), ["k", "z"], lambda r: len(r[1]))

    def own_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress

        def rows() -> Iterator[tuple]:
            for b in batches:
                for key, z, other, flagged in zip(*b.columns, strict=True):
                    k, skip, shared = key.as_py(), set(other.as_py() or []), set(flagged.as_py() or [])
                    yield from ((k, i, digest_of(c), i in shared, c) for i, c in enumerate(chunks(open_(z.as_py()))) if i not in skip)

        return _sliced(rows(), (pa.binary(), pa.int32(), pa.binary(), pa.bool_(), pa.binary()), ["k", "pos", "digest", "shared", "chunk"], lambda r: len(r[4]) + 64)

    lists = materialize(keyed.select("k", "p").mapInArrow(cut_list, "k binary, pos int, digest binary").dropDuplicates(["k", "pos"]))
    owners = lists.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("k", "pos")).alias("o")).where("n > 1")
    owners = materialize(owners.select("digest", F.col("o.k").alias("ok"), F.col("o.pos").alias("opos")))
    foreign = lists.join(owners, "digest").where(~((F.col("k") == F.col("ok")) & (F.col("pos") == F.col("opos")))).select("k", "pos", "digest")
    foreign = materialize(foreign)
    media = keyed.select("k", "p").mapInArrow(packed, "k binary, z binary").groupBy("k").agg(F.first("z").alias("z"))
    elsewhere = foreign.groupBy(F.col("k").alias("fk")).agg(F.collect_list("pos").alias("other"))
    flagged = owners.groupBy("ok").agg(F.collect_list("opos").alias("flagged"))
    marked = media.join(elsewhere, F.col("k") == F.col("fk"), "left").join(flagged, F.col("k") == F.col("ok"), "left").select("k", "z", "other", "flagged")
    kept = _written_in_buckets(marked.mapInArrow(own_chunks, "k binary, pos int, digest binary, shared boolean, chunk binary"), "k")
    return Stored(keyed.select("id", "n_bytes", "k"), lists, foreign, kept)


def load(stored: Stored) -> DataFrame:
    """k, media, n_chunks and n_foreign: the stored form of each distinct payload, from the lists and the chunks alone."""
    order = stored.lists.groupBy("k").agg(F.collect_list(F.struct("pos", "digest")).alias("parts"))
    own = stored.chunks.groupBy(F.col("k").alias("k1")).agg(F.collect_list(F.struct("pos", "chunk")).alias("own"))
    shared = stored.chunks.where("shared").select(F.col("digest").alias("d2"), "chunk")
    fetched = stored.foreign.join(shared, F.col("digest") == F.col("d2")).groupBy(F.col("k").alias("k2")).agg(F.collect_list(F.struct("pos", "chunk")).alias("fetched"))
    joined = own.join(order, F.col("k") == F.col("k1"), "right").join(fetched, F.col("k") == F.col("k2"), "left").select("k", "parts", "own", "fetched")

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for columns in zip(*b.columns, strict=True):
                    k, parts, own, got = (c.as_py() for c in columns)
                    digests = [x["digest"] for x in sorted(parts, key=lambda x: x["pos"])]
                    media = restore(digests, {x["pos"]: x["chunk"] for x in [*(own or []), *(got or [])]})
                    if hashlib.sha256(samples_of(media)).digest() != k:
                        raise ValueError("a medium differs from its payload")
                    yield k, media, len(digests), len(got or [])

        return _sliced(rows(), (pa.binary(), pa.binary(), pa.int32(), pa.int32()), ["k", "media", "n_chunks", "n_foreign"], lambda r: len(r[1]))

    return joined.mapInArrow(read_back, "k binary, media binary, n_chunks int, n_foreign int")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks and n_foreign,
    all but n_bytes computed from the medium that load() rebuilds."""
    stored = store(df, id_col, text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for columns in zip(*b.columns, strict=True):
                    k, kept, n, m = (c.as_py() for c in columns)
                    s = samples_of(kept)
                    yield k, len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-UNIT:]), len(kept), hashlib.sha256(kept).hexdigest(), feature(s), n, m

        kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
        return _sliced(rows(), kinds, ["k2", *names], lambda r: 400)

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks", "n_foreign"]
    fields = "k2 binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int, n_foreign int"
    measured = load(stored).mapInArrow(measure, fields)
    return stored.rows.join(measured, F.col("k") == F.col("k2")).select(F.col("id").alias(id_col), "n_bytes", *names)
