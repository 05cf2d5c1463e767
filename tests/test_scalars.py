"""Hand-computed values of the integer functions."""

import math

import pytest
from pyspark.sql import functions as F

from terravane.functions import scalars as S
from terravane.functions import tags as T
from terravane.operators import paths as P


def one(spark, expr, schema="x long", rows=((0,),)):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(expr).collect()]


def test_e7_rounding(spark):
    values = [(49,), (50,), (-49,), (-50,), (52390600049,), (52390600050,), (300000000000,)]
    assert one(spark, S.e7_from_nano(F.col("x")), rows=values) == [0, 1, 0, -1, 523906000, 523906001, None]


def test_floor_division(spark):
    assert one(spark, S.floor_div(F.col("x"), 4000), rows=[(3999,), (-1,), (-4000,), (-4001,)]) == [0, -1, -1, -2]


def test_metres_per_degree(spark):
    assert one(spark, S.meters_per_degree_lon(F.col("x")), rows=[(523906000,), (0,), (-335000000,)]) == [67933, 111320, 92825]


@pytest.mark.parametrize(
    ("points", "direct", "edge"),
    [
        ((523906000, 130645000, 524028200, 130578430), 1433, 1433),
        ((523906000, 130645000, 523906000, 130645000), 0, 1),
        ((523906000, 130645000, 523906000, 130646000), 6, 7),
        ((-335000000, 1512000000, -335010000, 1512010000), 144, 130),
    ],
)
def test_distances(spark, points, direct, edge):
    at = [F.lit(p).cast("bigint") for p in points]
    assert one(spark, S.direct_m(*at)) == [direct]
    assert one(spark, S.edge_m(*at)) == [edge]


def test_isqrt_near_squares(spark):
    roots = [1, 2, 3, 10**4, 94906265, 94906266, 94906267, 2**30, 2**31 - 1]
    rows = [(r * r + d,) for r in roots for d in (-1, 0, 1)]
    assert one(spark, S.isqrt(F.col("x")), rows=rows) == [math.isqrt(v) for (v,) in rows]


def test_walk_seconds(spark):
    assert one(spark, S.walk_seconds(F.col("x")), rows=[(0,), (1,), (481,), (800,), (1500,)]) == [0, 1, 361, 600, 1125]


def test_times_and_coordinates(spark):
    texts = [("8:05:00",), ("25:10:00",), ("71:59:59",), ("72:00:00",), ("08:60:00",), ("08:05",), (None,)]
    assert one(spark, S.gtfs_seconds(F.col("x")), "x string", texts) == [29100, 90600, 259199, None, None, None, None]
    coords = [("52.39060009",), ("-0.00000019",), ("181",), ("1e2",), ("",)]
    assert one(spark, S.gtfs_e7(F.col("x")), "x string", coords) == [523906000, -1, None, None, None]


def test_modes_and_days(spark):
    assert one(spark, S.mode_of(F.col("x")), rows=[(t,) for t in (0, 900, 1, 400, 2, 109, 3, 700, 4, 1000)]) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert one(spark, S.mode_bit(F.col("x")), rows=[(1,), (5,), (0,), (32,)]) == [1, 16, 0, 0]
    assert one(spark, S.weekday_of(F.col("x")), rows=[(20260603,)]) == [2]
    assert one(spark, S.clock(F.col("x")), rows=[(29100,), (90600,)]) == ["08:05", "01:10 (+1d)"]


def test_tiles(spark):
    at = [F.lit(v).cast("bigint") for v in (13_064_500_000, 52_390_600_000, 180_000_000_000, -90_000_000_000)]
    assert one(spark, S.tile_id(S.tile_x(at[0], 10), S.tile_y(at[1], 10), 10)) == [2882304056259248341]
    assert one(spark, S.tile_id(S.tile_x(at[2], 10), S.tile_y(at[3], 10), 10)) == [2882304310736061439]
    assert one(spark, S.route_tile_id(F.col("x"), F.col("x") - 2), rows=[(1,)]) == [144115188881162239]


def test_compass(spark):
    turns = {(3, 1): "north", (1, 3): "east", (1, 1): "north-east", (1, -1): "north-west", (-1, 1): "south-east", (-2, -2): "south-west", (0, 0): "north-east"}
    zero = F.lit(0).cast("bigint")
    rows = [(dy, dx) for dy, dx in turns]
    df = spark.createDataFrame(rows, "dy long, dx long").select(S.compass(zero, zero, F.col("dy"), F.col("dx")))
    assert [r[0] for r in df.collect()] == list(turns.values())


def test_coordinate_text(spark):
    assert one(spark, S.coord_text(F.col("x"), 7), rows=[(-1,), (523906000,), (0,)]) == ["-0.0000001", "52.3906000", "0.0000000"]


def test_parsers():
    assert S.parse_when("2026-06-03T08:05") == (20260603, 29100)
    assert S.parse_bbox("12.9,52.32,13.05,52.48") == (12_900_000_000, 52_320_000_000, 13_050_000_000, 52_480_000_000)
    for bad in ("1999-01-01T00:00", "2026-13-01T00:00", "2026-01-01 00:00"):
        with pytest.raises(ValueError):
            S.parse_when(bad)
    for bad in ("1,2,3", "5,0,1,1", "1.1234567891,0,2,2", "181,0,182,1"):
        with pytest.raises(ValueError):
            S.parse_bbox(bad)


def tagged(spark, *tag_lists):
    return spark.createDataFrame([([tuple(t) for t in tags],) for tags in tag_lists], f"tags {T.TAGS}")


def test_styles(spark):
    cases = {
        (("natural", "coastline"), ("waterway", "river")): "water", (("waterway", "river"),): "waterway", (("waterway", "riverbank"),): "water",
        (("building", "yes"), ("highway", "primary")): None, (("highway", "cycleway"),): "path", (("highway", "trunk"),): "motorway", (): None, (("railway", "rail"),): "rail",
    }
    got = tagged(spark, *cases).select(T.style(T.getter("tags"), buildings=False)).collect()
    assert [r[0] for r in got] == list(cases.values())


def test_walkable(spark):
    cases = [[("highway", "trunk")], [("highway", "trunk"), ("foot", "yes")], [("highway", "path"), ("access", "no")], [("highway", "cycleway")], [("highway", "cycleway"), ("foot", "designated")]]
    assert [r[0] for r in tagged(spark, *cases).select(T.walkable(T.getter("tags"))).collect()] == [False, True, False, False, True]


def test_residential(spark):
    cases = [[("building", "yes")], [("building", "yes"), ("shop", "x")], [("building", "house"), ("shop", "x")], [("addr:street", "a"), ("addr:housenumber", "1")], [("building", "garage")]]
    assert [r[0] for r in tagged(spark, *cases).select(T.is_residential(T.getter("tags"))).collect()] == [True, False, True, True, False]


def test_first_tag_wins_but_any_matches(spark):
    df = tagged(spark, [("a", "1"), ("a", "2")])
    assert df.select(T.get(F.col("tags"), "a"), T.has(F.col("tags"), "a", "2")).first()[:] == ("1", True)


def test_place_scores(spark):
    df = spark.createDataFrame([("city", 8, 5), ("district", 6, 1500)], "k string, l int, m long")
    assert [r[0] for r in df.select(T.place_score(F.col("k"), F.col("l"), F.col("m"))).collect()] == [112005, 84999]


def test_steps(spark):
    df = spark.createDataFrame([([200, 200, 100, 50],), ([],)], "m array<long>")
    assert [r[0] for r in df.select(P.step_groups(F.col("m"))).collect()] == [[500, 50], []]


def test_shortest():
    edges = [(1, 2, 5), (2, 3, 5), (1, 3, 20), (3, 4, 1)]
    assert P.shortest(edges, 1, 4) == (11, [1, 2, 3, 4])
    assert P.shortest(edges, 4, 1) is None
    assert P.shortest(edges, 2, 2) == (0, [2])
