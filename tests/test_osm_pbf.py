"""The container's reader against a small encoder of our own."""

import struct
import zlib

import pytest

from terravane.sources import osm_pbf as P


def vint(v):
    v &= (1 << 64) - 1
    out = b""
    while True:
        if v < 0x80:
            return out + bytes([v])
        out += bytes([v & 0x7F | 0x80])
        v >>= 7


def zz(v):
    return vint((v << 1) ^ (v >> 63))


def field(number, value):
    if isinstance(value, int):
        return vint(number << 3) + vint(value)
    return vint(number << 3 | 2) + vint(len(value)) + value


def deltas(values):
    return b"".join(zz(b - a) for a, b in zip([0, *values], values, strict=False))


def blob(kind, raw, packed=True, size=None, number=None):
    body = field(2, len(raw) if size is None else size) + field(number or 3, zlib.compress(raw)) if packed else field(1, raw)
    head = field(1, kind.encode()) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def block(groups, strings=("", "name", "Ä", "highway", "path", "outer"), granularity=None, lat0=None):
    raw = field(1, b"".join(field(1, s.encode()) for s in strings)) + b"".join(field(2, g) for g in groups)
    if granularity is not None:
        raw += field(17, granularity)
    if lat0 is not None:
        raw += field(19, lat0)
    return raw


PLAIN = field(1, field(1, 14) + field(2, vint(1)) + field(3, vint(2)) + field(8, 2_000) + field(9, 4_000))  # zigzag of 7, 1000 and 2000
DENSE = field(2, field(1, deltas([10, 12, 11])) + field(8, deltas([5, -5, 0])) + field(9, deltas([1, 2, 3])) + field(10, vint(1) + vint(2) + vint(0) + vint(0) + vint(3) + vint(4) + vint(1) + vint(2) + vint(0)))
WAY = field(3, field(1, 99) + field(2, vint(3)) + field(3, vint(4)) + field(8, deltas([10, 11, 12, 10])))
RELATION = field(4, field(1, 5) + field(8, vint(5) + vint(0)) + field(9, deltas([99, 7])) + field(10, vint(1) + vint(0)))
HEADER = field(4, b"OsmSchema-V0.6") + field(4, b"DenseNodes") + field(16, b"writer")


@pytest.fixture(scope="module")
def reader(spark, tmp_path_factory):
    P.register(spark)
    where = tmp_path_factory.mktemp("pbf")

    def load(data, entity, **options):
        path = where / f"{abs(hash(data))}.pbf"
        path.write_bytes(data)
        return spark.read.format("osm_pbf").options(entity=entity, **options).load(str(path))

    return load


WHOLE = blob("OSMHeader", HEADER) + blob("OSMData", block([PLAIN, DENSE])) + blob("OSMData", block([WAY, RELATION]), packed=False)


def test_nodes(reader):
    rows = {r["id"]: r for r in reader(WHOLE, "node").collect()}
    assert sorted(rows) == [7, 10, 11, 12]
    assert (rows[7]["lat_nano"], rows[7]["lon_nano"]) == (100_000, 200_000)
    assert (rows[12]["lat_nano"], rows[12]["lon_nano"]) == (-500, 200)
    assert [tuple(t) for t in rows[10]["tags"]] == [("name", "Ä")] and rows[12]["tags"] == []
    assert [tuple(t) for t in rows[11]["tags"]] == [("highway", "path"), ("name", "Ä")]


def test_ways_and_relations(reader):
    (way,) = reader(WHOLE, "way").collect()
    assert (way["id"], way["refs"], [tuple(t) for t in way["tags"]]) == (99, [10, 11, 12, 10], [("highway", "path")])
    (rel,) = reader(WHOLE, "relation").collect()
    assert [tuple(m) for m in rel["members"]] == [(99, 1, "outer"), (7, 0, "")]


def test_options_and_filters(reader):
    assert {r["tags"] for r in reader(WHOLE, "node", tags="false").collect()} == {None}
    assert [r["id"] for r in reader(WHOLE, "node").where("id = 11").collect()] == [11]
    assert sorted(r["id"] for r in reader(WHOLE, "node").where("id in (7, 12, 500)").collect()) == [7, 12]
    assert reader(WHOLE, "way").where("id = 1").collect() == []


def test_header_and_summary(reader, spark, tmp_path):
    (head,) = reader(WHOLE, "header").collect()
    assert head["required_features"] == ["OsmSchema-V0.6", "DenseNodes"] and head["writing_program"] == "writer" and head["source"] is None
    path = tmp_path / "x.pbf"
    path.write_bytes(WHOLE)
    assert P.summary(spark, str(path)).first().asDict() == {"blocks": 2, "nodes": 1, "dense_nodes": 3, "dense_groups": 1, "ways": 1, "relations": 1}


def test_granularity(reader):
    (node,) = reader(blob("OSMData", block([PLAIN], granularity=1000, lat0=5)), "node").collect()
    assert (node["lat_nano"], node["lon_nano"]) == (1_000_005, 2_000_000)


@pytest.mark.parametrize(
    "data",
    [
        WHOLE[:-3],
        struct.pack(">I", 70_000) + b"x" * 70_000,
        blob("OSMData", block([PLAIN]), number=4),
        blob("OSMData", block([PLAIN]), size=3),
        blob("OSMData", block([field(2, field(1, deltas([1, 2])) + field(8, deltas([1])) + field(9, deltas([1, 2])))])),
        blob("OSMData", block([field(3, field(1, 9) + field(2, vint(3)))])),
    ],
)
def test_malformed(reader, data):
    with pytest.raises(Exception, match="(?s)Malformed|cut off|bytes|differ|size|raw and zlib"):
        df = reader(data, "node" if b"\x1a" != data[:1] else "way")
        df.collect()
        reader(data, "way").collect()


def test_empty_file(reader):
    assert reader(b"", "node").collect() == []
