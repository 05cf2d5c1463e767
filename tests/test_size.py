"""Queries whose earlier forms failed on larger tables: what they carry, and the same results as the plain forms."""

import random

from pyspark.sql import functions as F
from terravane.functions import scalars as S
from terravane.operators import addresses as AD
from terravane.operators import geometry as G
from terravane.operators import paths as P
from terravane.operators import transit as TR
from terravane.plans.catalog import QUERIES, Data, _buildings
from terravane.sources.workspace import cut, cut_by

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_building_statistics_carries_no_boxes(spark):
    df = QUERIES["building_statistics"](spark, SF)
    assert "lat_nano" not in plan_of(df)
    assert sorted(df.collect()) == sorted(AD.written_rows(_buildings(Data(spark, SF))).collect())


def test_missing_refs_are_those_of_footprints(spark):
    refs = spark.createDataFrame([(1, 0, 1), (1, 1, 9), (1, 2, 9), (2, 0, 1), (2, 1, 2), (3, 0, None), (4, 0, 1)], "way_id long, pos long, node_id long")
    nodes = spark.createDataFrame([(1, 0, 0), (2, 5, 5), (3, 6, 6)], "id long, lat_nano long, lon_nano long")
    members = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 2, 1), (2, 7, 1), (3, 7, 1), (4, 3, 0), (5, 1, 1), (5, 1, 1), (6, None, 1), (6, 4, 1)], "rel_id long, member_id long, member_type int")
    got = G.missing_refs(refs, nodes)
    key = lambda df, k: sorted((r[k], r["missing_ref_count"]) for r in df.collect())
    assert key(got, "way_id") == key(G.footprint(refs, nodes), "way_id") == [(1, 2), (2, 0), (3, 1), (4, 0)]
    assert key(G.relation_missing_refs(members, got), "rel_id") == key(G.relation_footprint(members, refs, nodes), "rel_id")


def test_paths_by_rounds_are_those_of_heaps(spark, monkeypatch):
    """Windows of more edges than a heap may hold: the same metres and the same nodes of equal paths."""
    rng = random.Random(7)
    pairs = [(a, b) for a in range(60) for b in range(60) if a < b and rng.random() < 0.08] + [(70, 71)]
    rows = [(x, y, m, a % 3, b % 3) for a, b in pairs for m in (rng.randint(1, 4), 9) for x, y in ((a, b), (b, a))]
    edges = spark.createDataFrame(rows, "from_id long, to_id long, meters long, a_tile long, b_tile long")
    asked = [(1, 0, 59, [0, 1, 2]), (2, 5, 44, [0]), (3, 8, 8, [1]), (4, 3, 70, [0, 1, 2]), (5, 10, 31, [1, 2])]
    queries = spark.createDataFrame(asked, "query long, source long, target long, tiles array<long>")
    got = [sorted((r["query"], r["meters"], r["path"]) for r in P.route_queries(queries, edges, cut, cut_by, n).collect()) for n in (10**6, 0, 250)]
    assert got[0] == got[1] == got[2] and [r[1] is None for r in got[0]] == [False, False, False, True, False]
    monkeypatch.setattr(P, "_by_heap", None)
    monkeypatch.setattr(P.route_queries, "__defaults__", (0,))
    assert QUERIES["path_nodes"](spark, SF).count() > 0


def test_transfers_are_worked_out_once_a_pair_of_places(spark):
    """Stops at one place: every pair of stops, with distances of pairs of places only."""
    rows = [(i, 523_000_000 + 30_000 * (i % 3), 128_500_000 + 30_000 * (i % 2)) for i in range(24)] + [(99, None, None)]
    stops = spark.createDataFrame(rows, "stop_id long, lat_e7 long, lon_e7 long")
    members = TR.spots(stops)
    assert members.count() == 24 and TR.spot_walks(members).count() <= 36
    got = sorted(map(tuple, TR.transfers(stops).collect()))
    a, b = (stops.select(*[F.col(c).alias(f"{s}_{c}") for c in stops.columns]) for s in "ab")
    m = S.direct_m(F.col("a_lat_e7"), F.col("a_lon_e7"), F.col("b_lat_e7"), F.col("b_lon_e7"))
    plain = a.crossJoin(b).where("a_stop_id <> b_stop_id").select("a_stop_id", "b_stop_id", m.alias("meters")).where("meters <= 800")
    assert got == sorted(map(tuple, plain.withColumn("seconds", S.walk_seconds(F.col("meters"))).collect())) and got


def _timetable(spark, seed):
    rng = random.Random(seed)
    stops = [(i, 523_000_000 + 200_000 * rng.randrange(4) + 30_000 * rng.randrange(2), 128_500_000) for i in range(20)]
    events = []
    for trip in range(60):
        at = rng.randrange(4000)
        for seq in range(rng.randint(2, 4)):
            events.append((trip, rng.randrange(20), seq, at, at + rng.randrange(3)))
            at += rng.randrange(-20, 600)
    return spark.createDataFrame(stops, "stop_id long, lat_e7 long, lon_e7 long"), spark.createDataFrame(events, "trip_id long, stop_id long, sequence long, arrival_sec long, departure_sec long")


def test_labels_by_spots_are_those_of_stops(spark):
    """Whole labels with walks between spots, in buckets, against walks between stops; the plain scan finds both right and a changed one wrong."""
    for seed in (1,):
        stops, events = _timetable(spark, seed)
        start = TR.start_labels(spark.createDataFrame([(3, 0), (5, 40)], "stop_id long, meters long"), 100)
        members = cut(TR.spots(stops))
        walks = cut_by(TR.spot_walks(members), "from_stop")
        plain = TR.earliest(start, cut(events), cut(TR.transfers(stops)), 4, cut=cut)
        got = TR.earliest(start, cut_by(events, "trip_id"), walks, 4, cut=cut, members=members, by_stop=cut_by(events, "stop_id"))
        assert sorted(got.collect()) == sorted(plain.collect()) and got.agg(F.max("rides")).first()[0] > 1
        check = lambda x, **how: TR.verify_labels(x, start, events, how.pop("w"), 4, **how).collect()
        assert check(got, w=walks, cut=cut, members=members) == check(got, w=TR.transfers(stops), cut=cut) == []
        worse = got.withColumn("arrival", F.col("arrival") + F.when(F.col("stop_id") == 5, 1).otherwise(0))
        assert [r["stop_id"] for r in check(worse, w=walks, cut=cut, members=members)] == [5]
        assert [r["stop_id"] for r in check(got.where("stop_id <> 5"), w=walks, cut=cut, members=members)] == [5]


def test_verification_gathers_nothing_in_one_task(spark):
    stops, events = _timetable(spark, 3)
    start = TR.start_labels(spark.createDataFrame([(3, 0)], "stop_id long, meters long"), 100)
    plan = TR.verify_labels(start, start, events, TR.transfers(stops), 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_trips_that_do_not_run_are_dropped_before_events_are_ordered(spark):
    plan = plan_of(Data(spark, SF).events())
    assert plan.count("Window ") == 1 and "Join LeftSemi" in plan[plan.index("Window ") :]
