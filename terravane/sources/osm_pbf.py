"""A Spark data source for map extracts in the PBF container: header, nodes, ways and relations.

spark.dataSource.register(OsmPbf); spark.read.format("osm_pbf").option("entity", "node").load(path)

The driver walks the length-prefixed blob headers (a few bytes a blob); runs of blobs become partitions, which inflate and
decode in Arrow batches. option("tags", "false") leaves tags undecoded. Filters id = x and id IN (...) are evaluated while decoding,
before references and tags are built.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

MAX_HEADER, MAX_BLOB = 64 * 1024, 32 * 1024 * 1024
#: Compressed bytes of a partition, about.
PARTITION_BYTES = 32 * 1024 * 1024
BATCH_ROWS = 20_000

TAGS = "tags array<struct<k:string,v:string>>"
SCHEMAS = {
    "node": f"id long, lat_nano long, lon_nano long, {TAGS}",
    "way": f"id long, refs array<long>, {TAGS}",
    "relation": f"id long, members array<struct<id:long,type:int,role:string>>, {TAGS}",
    "header": "required_features array<string>, optional_features array<string>, writing_program string, source string",
    "block": "offset long, nodes long, dense_nodes long, dense_groups long, ways long, relations long",
}
_TAGS = pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))
ARROW = {
    "node": pa.schema([("id", pa.int64()), ("lat_nano", pa.int64()), ("lon_nano", pa.int64()), ("tags", _TAGS)]),
    "way": pa.schema([("id", pa.int64()), ("refs", pa.list_(pa.int64())), ("tags", _TAGS)]),
    "relation": pa.schema([("id", pa.int64()), ("members", pa.list_(pa.struct([("id", pa.int64()), ("type", pa.int32()), ("role", pa.string())]))), ("tags", _TAGS)]),
    "header": pa.schema([("required_features", pa.list_(pa.string())), ("optional_features", pa.list_(pa.string())), ("writing_program", pa.string()), ("source", pa.string())]),
    "block": pa.schema([(c, pa.int64()) for c in ("offset", "nodes", "dense_nodes", "dense_groups", "ways", "relations")]),
}


class Malformed(ValueError):
    """The file breaks the container's or the messages' rules."""


def varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise Malformed("a number is cut off or too long")
        x = b[at]
        at += 1
        value |= (x & 0x7F) << shift
        if x < 0x80:
            return value & (1 << 64) - 1, at
        shift += 7


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def fields(b: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a message."""
    at, n = 0, len(b)
    while at < n:
        key, at = varint(b, at)
        wire = key & 7
        if wire == 0:
            v, at = varint(b, at)
        elif wire in (1, 2, 5):
            size, at = (8, at) if wire == 1 else (4, at) if wire == 5 else varint(b, at)
            if at + size > n:
                raise Malformed("a field is cut off")
            v, at = b[at : at + size], at + size
        else:
            raise Malformed(f"wire type {wire}")
        yield key >> 3, wire, v


def packed(v: int | bytes) -> list[int]:
    if isinstance(v, int):
        return [v]
    out, at = [], 0
    while at < len(v):
        x, at = varint(v, at)
        out.append(x)
    return out


def running(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += zigzag(v)
        out.append(total)
    return out


def blobs(read, size: int) -> Iterator[tuple[str, int, int]]:  # noqa: ANN001
    """(type, offset, length) of each blob; read(offset, length) gives bytes."""
    at = 0
    while at < size:
        head = read(at, 4)
        if len(head) < 4:
            raise Malformed("a block's length is cut off")
        (n,) = struct.unpack(">I", head)
        if not 0 < n <= MAX_HEADER:
            raise Malformed(f"a block header of {n} bytes")
        kind, length = "", -1
        raw = read(at + 4, n)
        if len(raw) < n:
            raise Malformed("a block header is cut off")
        for number, _, v in fields(raw):
            if number == 1:
                kind = bytes(v).decode()
            elif number == 3:
                length = v
        if not kind or length < 0 or at + 4 + n + length > size:
            raise Malformed("a block header is incomplete")
        yield kind, at + 4 + n, length
        at += 4 + n + length


def inflate(blob: bytes) -> bytes:
    raw = data = size = None
    for number, _, v in fields(blob):
        if number == 1:
            raw = v
        elif number == 2:
            size = v
        elif number == 3:
            data = v
        elif number in (4, 5, 6, 7):
            raise Malformed("only raw and zlib blobs are read")
    if size is not None and size > MAX_BLOB:
        raise Malformed("a blob of more than 32 MiB")
    if raw is not None:
        return raw
    if data is None:
        raise Malformed("a blob without data")
    out = zlib.decompress(data)
    if size is not None and len(out) != size:
        raise Malformed("a blob has another size than it says")
    return out


class Block:
    """A primitive block: its strings, scales and groups."""

    def __init__(self, raw: bytes) -> None:
        self.strings: list[str] = []
        self.groups: list[bytes] = []
        self.granularity, self.lat0, self.lon0 = 100, 0, 0
        for number, _, v in fields(raw):
            if number == 1:
                self.strings = [bytes(s).decode("utf-8", "replace") for k, _, s in fields(v) if k == 1]
            elif number == 2:
                self.groups.append(v)
            elif number == 17:
                self.granularity = signed(v)
            elif number == 19:
                self.lat0 = signed(v)
            elif number == 20:
                self.lon0 = signed(v)

    def text(self, i: int) -> str:
        if i >= len(self.strings):
            raise Malformed("a string number past the table")
        return self.strings[i]

    def tags(self, keys: list[int], values: list[int]) -> list[dict[str, str]]:
        if len(keys) != len(values):
            raise Malformed("keys and values differ in number")
        return [{"k": self.text(k), "v": self.text(v)} for k, v in zip(keys, values, strict=True)]

    def nodes(self, ids: set[int] | None, tags: bool) -> Iterator[tuple]:
        place = lambda lat, lon: (self.lat0 + self.granularity * lat, self.lon0 + self.granularity * lon)
        for group in self.groups:
            for number, _, v in fields(group):
                if number == 1:
                    f = _collect(v, {2, 3})
                    node = zigzag(f.get(1, 0))
                    if ids is None or node in ids:
                        yield node, *place(zigzag(f.get(8, 0)), zigzag(f.get(9, 0))), self.tags(f[2], f[3]) if tags else None
                elif number == 2:
                    f = _collect(v, {1, 8, 9, 10})
                    node_ids, lats, lons, flat = running(f[1]), running(f[8]), running(f[9]), f[10]
                    if not len(node_ids) == len(lats) == len(lons):
                        raise Malformed("dense arrays differ in number")
                    at = 0
                    for node, lat, lon in zip(node_ids, lats, lons, strict=True):
                        own = []
                        while at < len(flat) and flat[at]:
                            if at + 1 >= len(flat):
                                raise Malformed("a dense tag is cut off")
                            own.append((flat[at], flat[at + 1]))
                            at += 2
                        at += 1
                        if ids is None or node in ids:
                            yield node, *place(lat, lon), self.tags([k for k, _ in own], [x for _, x in own]) if tags else None

    def ways(self, ids: set[int] | None, tags: bool) -> Iterator[tuple]:
        for group in self.groups:
            for number, _, v in fields(group):
                if number == 3:
                    f = _collect(v, {2, 3, 8}, only=ids)
                    if f is not None:
                        yield signed(f.get(1, 0)), running(f[8]), self.tags(f[2], f[3]) if tags else None

    def relations(self, ids: set[int] | None, tags: bool) -> Iterator[tuple]:
        for group in self.groups:
            for number, _, v in fields(group):
                if number == 4:
                    f = _collect(v, {2, 3, 8, 9, 10}, only=ids)
                    if f is None:
                        continue
                    if not len(f[8]) == len(f[9]) == len(f[10]):
                        raise Malformed("member arrays differ in number")
                    members = [{"id": m, "type": t, "role": self.text(r)} for r, m, t in zip(f[8], running(f[9]), f[10], strict=True)]
                    yield signed(f.get(1, 0)), members, self.tags(f[2], f[3]) if tags else None

    def counts(self) -> tuple[int, int, int, int, int]:
        n = {"nodes": 0, "dense": 0, "groups": 0, "ways": 0, "relations": 0}
        for group in self.groups:
            for number, _, v in fields(group):
                if number == 1:
                    n["nodes"] += 1
                elif number == 2:
                    n["groups"] += 1
                    n["dense"] += sum(len(packed(x)) for k, _, x in fields(v) if k == 1)
                elif number == 3:
                    n["ways"] += 1
                elif number == 4:
                    n["relations"] += 1
        return n["nodes"], n["dense"], n["groups"], n["ways"], n["relations"]


def _collect(b: bytes, lists: set[int], only: set[int] | None = None) -> dict | None:
    """Fields by number; those in lists as lists. With only, a message of another id (field 1) is given up early."""
    out: dict = {k: [] for k in lists}
    for number, _, v in fields(b):
        if number in lists:
            out[number] += packed(v)
        elif isinstance(v, int):
            out[number] = v
            if number == 1 and only is not None and signed(v) not in only:
                return None
    return out


def header(raw: bytes) -> tuple:
    features: dict[int, list[str]] = {4: [], 5: []}
    text = {16: None, 17: None}
    for number, _, v in fields(raw):
        if number in features and len(features[number]) < 32:
            features[number].append(bytes(v).decode("utf-8", "replace"))
        elif number in text:
            text[number] = bytes(v).decode("utf-8", "replace")
    return features[4], features[5], text[16], text[17]


class Blobs(InputPartition):
    def __init__(self, path: str, spans: list[tuple[str, int, int]]) -> None:
        self.path, self.spans = path, spans


def filesystem(path: str):  # noqa: ANN201
    """The store of a path, any that Arrow knows or the local disk, and the path within it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def files(path: str) -> list[str]:
    """The file of a path, or the extract files of a folder, by name."""
    from pyarrow import fs

    store, inner = filesystem(path)
    if store.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    found = [x.base_name for x in store.get_file_info(fs.FileSelector(inner)) if x.base_name.endswith(".pbf") and not x.base_name.startswith(("_", "."))]
    return [f"{path.rstrip('/')}/{name}" for name in sorted(found)]


def _open(path: str):  # noqa: ANN202
    """A random-access file."""
    store, inner = filesystem(path)
    return store.open_input_file(inner)


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.entity = options["path"], options.get("entity", "node")
        self.tags = str(options.get("tags", "true")).lower() != "false"
        self.ids: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.entity in ("node", "way", "relation") and isinstance(f, EqualTo) and f.attribute == ("id",):
                self._narrow({f.value})
            elif self.entity in ("node", "way", "relation") and isinstance(f, In) and f.attribute == ("id",):
                self._narrow(set(f.value))
            else:
                yield f

    def _narrow(self, ids: set[int]) -> None:
        self.ids = ids if self.ids is None else self.ids & ids

    def partitions(self) -> list[Blobs]:
        want = "OSMHeader" if self.entity == "header" else "OSMData"
        out: list[Blobs] = []
        for path in files(self.path):
            run, size = [], 0
            with _open(path) as f:

                def read(at: int, n: int, f=f) -> bytes:  # noqa: ANN001
                    f.seek(at)
                    return f.read(n)

                for span in blobs(read, f.size()):
                    if span[0] == want:
                        run.append(span)
                        size += span[2]
                        if size >= PARTITION_BYTES:
                            out.append(Blobs(path, run))
                            run, size = [], 0
            if run:
                out.append(Blobs(path, run))
        return out or [Blobs(self.path, [])]

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        schema = ARROW[self.entity]
        rows: list[tuple] = []
        if not partition.spans:
            return
        with _open(partition.path) as f:
            for _, at, n in partition.spans:
                f.seek(at)
                raw = inflate(f.read(n))
                if self.entity == "header":
                    rows.append(header(raw))
                elif self.entity == "block":
                    rows.append((at, *Block(raw).counts()))
                else:
                    rows += getattr(Block(raw), self.entity + "s")(self.ids, self.tags)
                while len(rows) >= BATCH_ROWS:
                    yield self.batch(rows[:BATCH_ROWS], schema)
                    rows = rows[BATCH_ROWS:]
        if rows:
            yield self.batch(rows, schema)

    @staticmethod
    def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


class OsmPbf(DataSource):
    """The format osm_pbf; option entity is node, way, relation, header or block."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("entity", "node")]

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool):  # noqa: ANN001, ANN201
        from .osm_pbf_writer import Writer

        return Writer(dict(self.options))


def register(spark) -> None:  # noqa: ANN001
    """Make the format known to a session, with filters pushed into the decoder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OsmPbf)


def summary(spark, path: str):  # noqa: ANN001, ANN201
    """Counts of a whole file, from blocks that are counted without building entities."""
    from pyspark.sql import functions as F

    blocks = spark.read.format("osm_pbf").option("entity", "block").load(path)
    return blocks.agg(F.count("*").alias("blocks"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("nodes", "dense_nodes", "dense_groups", "ways", "relations")])
