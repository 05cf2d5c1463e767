"""Writing map extracts in the PBF container: each task writes one file of whole blobs, and a folder of such files reads as one extract.

df.write.format("osm_pbf").option("entity", "node").mode("append").save(path). Nodes are written densely; ids, coordinates and references as
deltas; strings once a block. A failed or repeated task leaves no file behind that counts: files get their name when the job commits.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

BLOCK_ROWS = 8000
_KINDS = {"node": 0, "way": 1, "relation": 2}


def varint(v: int) -> bytes:
    v &= (1 << 64) - 1
    out = bytearray()
    while v >= 0x80:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def zigzag(v: int) -> bytes:
    return varint((v << 1) ^ (v >> 63))


def number(field: int, v: int) -> bytes:
    return varint(field << 3) + varint(v)


def message(field: int, body: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(body)) + body


def deltas(values: Iterable[int]) -> bytes:
    out, last = [], 0
    for v in values:
        out.append(zigzag(v - last))
        last = v
    return b"".join(out)


def blob(kind: str, raw: bytes) -> bytes:
    """A length-prefixed header and the deflated body."""
    body = number(2, len(raw)) + message(3, zlib.compress(raw, 6))
    head = message(1, kind.encode()) + number(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def header_blob(program: str = "terravane") -> bytes:
    return blob("OSMHeader", message(4, b"OsmSchema-V0.6") + message(4, b"DenseNodes") + message(16, program.encode()))


class Strings:
    """A block's string table; place 0 is empty."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {"": 0}

    def __getitem__(self, text: str | None) -> int:
        return self.at.setdefault(text or "", len(self.at))

    def table(self) -> bytes:
        return message(1, b"".join(message(1, s.encode()) for s in self.at))


def data_blob(entity: str, rows: list[tuple]) -> bytes:
    """One block of rows as the reader gives them; coordinates are kept to 100 nanodegrees, the container's step."""
    strings = Strings()
    tags = [[(strings[t["k"]], strings[t["v"]]) for t in r[-1] or []] for r in rows]
    if entity == "node":
        steps = lambda k: [r[k] // 100 for r in rows]
        runs = b"".join(b"".join(varint(k) + varint(v) for k, v in ts) + b"\0" for ts in tags)
        dense = message(1, deltas(r[0] for r in rows)) + message(8, deltas(steps(1))) + message(9, deltas(steps(2))) + message(10, runs)
        group = message(2, dense)
    else:
        parts = []
        for r, ts in zip(rows, tags, strict=True):
            body = number(1, r[0]) + message(2, b"".join(varint(k) for k, _ in ts)) + message(3, b"".join(varint(v) for _, v in ts))
            if entity == "way":
                parts.append(message(3, body + message(8, deltas(r[1] or []))))
            else:
                m = r[1] or []
                roles = b"".join(varint(strings[x["role"]]) for x in m)
                parts.append(message(4, body + message(8, roles) + message(9, deltas(x["id"] for x in m)) + message(10, b"".join(varint(x["type"]) for x in m))))
        group = b"".join(parts)
    return blob("OSMData", strings.table() + message(2, group))


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.entity = options["path"].rstrip("/"), options.get("entity", "node")
        if self.entity not in _KINDS:
            raise ValueError(f"no entity {self.entity}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from .osm_pbf import filesystem

        name = uuid.uuid4().hex
        store, inner = filesystem(self.path)
        store.create_dir(inner, recursive=True)
        temporary = f"{inner}/_{name}.tmp"
        with store.open_output_stream(temporary) as f:
            f.write(header_blob())
            rows: list[tuple] = []
            for b in iterator:
                rows += list(zip(*[c.to_pylist() for c in b.columns], strict=True))
                while len(rows) >= BLOCK_ROWS:
                    f.write(data_blob(self.entity, rows[:BLOCK_ROWS]))
                    rows = rows[BLOCK_ROWS:]
            if rows:
                f.write(data_blob(self.entity, rows))
        return Written(temporary, f"{inner}/{_KINDS[self.entity]}-{name}.osm.pbf")

    def commit(self, messages: list[Written | None]) -> None:
        from .osm_pbf import filesystem

        store, _ = filesystem(self.path)
        for m in filter(None, messages):
            store.move(m.temporary, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        from .osm_pbf import filesystem

        store, _ = filesystem(self.path)
        for m in filter(None, messages):
            store.delete_file(m.temporary)
