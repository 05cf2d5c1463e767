"""Feeds, requests, streams and images."""

import json
import struct
import zlib

import numpy as np
import pytest

from terravane.operators import raster
from terravane.plans import api
from terravane.sources import gtfs
from terravane.sources.workspace import cut
from terravane.streaming import resident

FEED = {
    "stops.txt": 'stop_id,stop_name,stop_lat,stop_lon\nA,"Markt, Ost",52.39060009,13.0645\nB,,52.40,13.08\nC,bad,x,13\nB,Late,52.41,13.08\n',
    "routes.txt": "route_id,route_short_name,route_long_name,route_type\nr1,1,Line,0\nr2,,,bus\n",
    "trips.txt": "route_id,service_id,trip_id\nr1,s,t1\nr1,none,t2\nr2,s,t3\n",
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,8:00:00,8:00:00,A,1\nt1,8:10:00,8:10:00,B,2\nt1,8:99:00,8:20:00,A,3\nt2,9:00:00,9:00:00,A,1\nt1,9:00:00,9:00:00,Z,4\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\ns,1,1,1,1,1,0,0,20260601,20260630\n",
}


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("feed")
    for name, text in FEED.items():
        (path / name).write_text(text)
    return gtfs.load_gtfs(spark, str(path))


def test_feed(feed):
    stops = {r["stop_id"]: (r["stop_name"], r["lat_e7"]) for r in feed["stops"].collect()}
    assert stops == {"A": ("Markt, Ost", 523906000), "B": ("Late", 524100000)}
    assert [r["trip_id"] for r in feed["trips"].collect()] == ["t1"]
    assert sorted((r["stop_id"], r["arrival_sec"], r["mode"]) for r in feed["events"].collect()) == [("A", 28800, 1), ("B", 29400, 1)]
    assert feed["calendar"].first()["mask"] == 31 and feed["exceptions"].count() == 0


def test_missing_column(spark, tmp_path):
    for name, text in FEED.items():
        (tmp_path / name).write_text(text.replace("stop_lat", "lat"))
    with pytest.raises(ValueError, match="stop_lat"):
        gtfs.load_gtfs(spark, str(tmp_path))


def test_requests():
    good = api.parse('{"from": "a", "to_lat": 52.4, "to_lon": 13.08, "depart": "2026-06-03T07:50"}')
    assert good == {"from": "a", "to": (524000000, 130800000), "date": 20260603, "seconds": 28200}
    for bad in ("[]", "{", '{"from": "a"}', '{"from": "a", "to": "b"}', '{"from_lat": 1, "to": "b", "depart": "2026-06-03T07:50"}', '{"from_lat": 91, "from_lon": 0, "to": "b", "depart": "2026-06-03T07:50"}'):
        with pytest.raises(api.BadRequest):
            api.parse(bad)


def test_route(feed, spark):
    ids = {"A": 1, "B": 2}
    from pyspark.sql import functions as F

    as_long = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    tables = dict(feed)
    tables["stops"] = feed["stops"].withColumn("stop_id", as_long[F.col("stop_id")].cast("long"))
    tables["events"] = feed["events"].withColumns({"stop_id": as_long[F.col("stop_id")].cast("long"), "trip_id": F.lit(1).cast("long")})
    none = spark.createDataFrame([], "id long, lat_e7 long, lon_e7 long, city string, suburb string, postcode string, street string, housenumber string")
    got = json.loads(api.route({"from": "52.3906,13.0645", "to_lat": 52.41, "to_lon": 13.08, "depart": "2026-06-03T07:50"}, tables, none, cut))
    assert got["found"] and got["arrive_seconds"] == 29400 and [x["kind"] for x in got["legs"]] == ["ride"]
    assert json.loads(api.route({"from": "Nowhere 1", "to": "x 2", "depart": "2026-06-03T07:50"}, tables, none, cut))["ok"] is False


def test_styles_file():
    assert gtfs.read_styles("# c\nroad.width = 3 # x\nfooter.text = y\n\n", {"road.width"}) == {"road.width": "3"}
    with pytest.raises(ValueError):
        gtfs.read_styles("other = 1", {"road.width"})


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "Ring 2"), (2, "Ring 9")], "query_id int, query string").write.mode("append").parquet(str(tmp_path / "in"))
    addresses = spark.createDataFrame([(7, 1, 2, None, None, None, "Ring", "2")], "id long, lat_e7 long, lon_e7 long, city string, suburb string, postcode string, street string, housenumber string")
    stream = spark.readStream.schema("query_id int, query string").parquet(str(tmp_path / "in"))
    q = resident.resolve_stream(stream, addresses, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()] == [(1, 1, 7)]
    lines = spark.createDataFrame([("a\tb",), ("c",), ("\tb",)], "value string")
    assert [tuple(r) for r in resident.parse_lines(lines).collect()] == [("a", "b")]


def test_png():
    image = np.zeros((4, 6, 3), np.uint8)
    raster.fill(image, np.array([1, 5, 5, 1]), np.array([1, 1, 3, 3]), (9, 8, 7))
    assert (image[1:3, 1:5] == (9, 8, 7)).all() and image.sum() == 8 * 24
    raster.line(image, 0, 0, 5, 0, (1, 1, 1))
    assert (image[0] == 1).all()
    data = raster.png(image)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (6, 4)
    at = data.index(b"IDAT")
    (n,) = struct.unpack(">I", data[at - 4 : at])
    assert len(zlib.decompress(data[at + 4 : at + 4 + n])) == 4 * 7


def test_render(spark):
    rows = [(1, 0, 1, [0, 90, 90, 0], [0, 0, 90, 90]), (1, 5, 0, [0, 90], [45, 45])]
    df = spark.createDataFrame(rows, "image_id long, style int, flags int, lons array<long>, lats array<long>")
    assert raster.render(df, (0, 0, 100, 100), 20, 20).first()["png"][:4] == b"\x89PNG"
