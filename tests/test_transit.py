"""Calendars, rounds and arrival searches on small timetables."""

from terravane.operators import address_search as A
from terravane.operators import transit as TR
from pyspark.sql import functions as F

EVENTS = "trip_id long, stop_id long, sequence long, arrival_sec long, departure_sec long"


def label(spark, stop=1, at=0):
    return TR.start_labels(spark.createDataFrame([(stop, 0)], "stop_id long, meters long"), at)


def as_dict(df):
    return {r["stop_id"]: (r["arrival"], r["rides"]) for r in df.collect()}


def test_service_active(spark):
    cal = spark.createDataFrame([("s", 31, 20260601, 20260630)], "service_id string, mask int, start_date int, end_date int")
    exc = spark.createDataFrame([("s", 20260603, 2), ("s", 20260606, 1)], "service_id string, date int, type int")
    on = {d: TR.active_services(cal, exc, d).count() for d in (20260603, 20260604, 20260606, 20260607, 20260701)}
    assert on == {20260603: 0, 20260604: 1, 20260606: 1, 20260607: 0, 20260701: 0}


def test_rounds_count_rides(spark):
    events = spark.createDataFrame([(1, 1, 1, 100, 100), (1, 2, 2, 200, 200), (2, 2, 1, 250, 250), (2, 3, 2, 300, 300), (3, 3, 1, 350, 350), (3, 1, 2, 400, 400)], EVENTS)
    walks = spark.createDataFrame([], "from_stop long, to_stop long, meters long, seconds long")
    assert as_dict(TR.earliest(label(spark), events, walks, 3)) == {1: (0, 0), 2: (200, 1), 3: (300, 2)}


def test_alight_needs_later_time(spark):
    events = spark.createDataFrame([(1, 1, 1, 100, 100), (1, 2, 2, 90, 90)], EVENTS)
    walks = spark.createDataFrame([], "from_stop long, to_stop long, meters long, seconds long")
    assert as_dict(TR.earliest(label(spark), events, walks, 1)) == {1: (0, 0)}


def test_walks_do_not_chain_within_a_round(spark):
    events = spark.createDataFrame([], EVENTS)
    walks = spark.createDataFrame([(1, 2, 500, 375), (2, 1, 500, 375), (2, 3, 500, 375), (3, 2, 500, 375)], "from_stop long, to_stop long, meters long, seconds long")
    assert as_dict(TR.earliest(label(spark), events, walks, 1)) == {1: (0, 0), 2: (375, 0)}
    assert as_dict(TR.earliest(label(spark), events, walks, 2)) == {1: (0, 0), 2: (375, 0), 3: (750, 0)}


def test_slack(spark):
    events = spark.createDataFrame([(1, 1, 1, 219, 219), (2, 1, 1, 220, 220)], EVENTS)
    assert [r["trip_id"] for r in TR.board_first(label(spark, at=100), events, 0, slack=120).collect()] == [2]


def test_destination_weighs_walks(spark):
    labels = spark.createDataFrame([(1, 1000, 1), (2, 1050, 1), (3, 0, 0)], "stop_id long, arrival long, rides int")
    near = spark.createDataFrame([(1, 133), (2, 80), (3, 0)], "stop_id long, meters long")
    best = TR.best_destination(labels, near).first()
    assert (best["stop_id"], best["finish"]) == (2, 1110)


def test_arrive_by_prefers_later_departure(spark):
    events = spark.createDataFrame([(1, 1, 1, 100, 100), (1, 2, 2, 500, 500), (2, 1, 1, 300, 300), (2, 2, 2, 600, 600), (3, 1, 1, 400, 400), (3, 2, 2, 900, 900)], EVENTS)
    here = spark.createDataFrame([(1, 0)], "stop_id long, meters long")
    there = spark.createDataFrame([(2, 0)], "stop_id long, meters long")
    best = TR.arrive_by(events, here, there, 700).first()
    assert (best["leave"], best["trip_id"]) == (300, 2)


def test_compact_legs():
    leg = lambda k, t, a, b: {"kind": k, "trip": t, "board": a, "alight": b, "departure": a, "arrival": b}
    got = TR.compact([leg("walk", -1, 1, 2), leg("walk", -1, 2, 3), leg("ride", 7, 3, 4), leg("ride", 7, 4, 5), leg("ride", 8, 5, 6)])
    assert [(x["kind"], x["board"], x["alight"]) for x in got] == [("walk", 1, 3), ("ride", 3, 5), ("ride", 5, 6)]


def test_normalize(spark):
    df = spark.createDataFrame([("Friedrich-Engels-Straße 22",), ("ÄB",), (None,)], "t string")
    assert [r[0] for r in df.select(A.normalize(F.col("t"))).collect()] == ["friedrich-engels-strasse 22", "Äb", None]


def test_exact_address(spark):
    addresses = spark.createDataFrame(
        [(1, None, "Ring", "2b"), (2, 5, "Ring", "2"), (3, None, "Ring", "b"), (4, None, "Ring", "2")], "id long, lat_e7 long, street string, housenumber string"
    ).withColumns({c: F.lit(None).cast("string") for c in ("city", "suburb", "postcode")})
    asked = spark.createDataFrame([(1, "Ring 2b"), (2, "Ring 2 hinten"), (3, "Ring"), (4, "")], "query_id int, query string")
    got = {r["query_id"]: (r["matches"], r["id"]) for r in A.resolve_exact(asked, addresses).collect()}
    assert got == {1: (1, 1), 2: (2, 2)}


def test_house_aliases(spark):
    df = spark.createDataFrame([("18, 20/22",)], "h string")
    assert df.select(A.house_aliases(F.col("h"))).first()[0] == ["18, 20/22", "18", "20", "22"]


def test_similar(spark):
    rows = [("hauptstrasse", "hauptsrasse"), ("ring", "rinh"), ("xauptstrasse", "hauptstrasse")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(A.similar(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_umlauts():
    assert A.umlaut_variants("strasse") == []
    assert A.umlaut_variants("muellerae") == ["müllerae", "müllerä", "muellerä"]
