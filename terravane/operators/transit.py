"""Timetables: calendars, clean events, transfers between near stops, and earliest-arrival search in rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

ACCESS_M, EGRESS_M, TRANSFER_M = 800, 1500, 800
ROUNDS, CELLS = 6, 4


def active_services(calendar: DataFrame, exceptions: DataFrame, date: int) -> DataFrame:
    """Services that run on a date: an exception of that date decides (type 1 runs), else range and weekday.

    calendar: service_id, mask (bit 0 is Monday), start_date, end_date; exceptions: service_id, date, type; the first by type where a date has several.
    """
    day = F.lit(date).cast("bigint")
    bit = F.call_function("shiftright", F.col("mask").cast("int"), S.weekday_of(day)).bitwiseAND(F.lit(1)) == 1
    regular = bit & (F.col("start_date") != 0) & (F.col("end_date") != 0) & day.between(F.col("start_date"), F.col("end_date"))
    today = exceptions.where(F.col("date") == date).groupBy("service_id").agg(F.min("type").alias("type"))
    all_ids = calendar.select("service_id").union(exceptions.select("service_id")).distinct()
    known = all_ids.join(calendar, "service_id", "left").join(today, "service_id", "left")
    return known.where(F.coalesce(F.col("type") == 1, regular, F.lit(False))).select("service_id")


def calendar_matrix(calendar: DataFrame, exceptions: DataFrame, first: int, last: int) -> DataFrame:
    """(date, service_id) of every active pair of a span of days; dates are a row each, so nothing is crossed but the calendar itself."""
    span = F.sequence(F.to_date(F.lit(str(first)), "yyyyMMdd"), F.to_date(F.lit(str(last)), "yyyyMMdd"))
    all_ids = calendar.select("service_id").union(exceptions.select("service_id")).distinct()
    days = all_ids.join(calendar, "service_id", "left").withColumn("d", F.explode(span)).withColumn("date", F.date_format("d", "yyyyMMdd").cast("int"))
    bit = F.call_function("shiftright", F.col("mask").cast("int"), F.weekday("d")).bitwiseAND(F.lit(1)) == 1
    regular = bit & (F.col("start_date") != 0) & (F.col("end_date") != 0) & F.col("date").between(F.col("start_date"), F.col("end_date"))
    by_day = exceptions.groupBy("service_id", "date").agg(F.min("type").alias("type"))
    return days.join(by_day, ["service_id", "date"], "left").where(F.coalesce(F.col("type") == 1, regular, F.lit(False))).select("date", "service_id")


def calendar_span(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """first and last: the days that calendars and exceptions span, 0 left out."""
    dates = calendar.select("start_date", "end_date").union(exceptions.select("date", "date")).toDF("a", "b")
    return dates.agg(F.min(F.when(F.col("a") != 0, F.col("a"))).alias("first"), F.max(F.when(F.col("b") != 0, F.col("b"))).alias("last"))


def exception_ranges(exceptions: DataFrame) -> DataFrame:
    """service_id, offset and count of each service's exceptions in the order of services."""
    n = exceptions.groupBy("service_id").agg(F.count("*").alias("count"))
    before = Window.orderBy("service_id").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0)))  # one row a service


def verify_labels(
    labels: DataFrame, start: DataFrame, events: DataFrame, walks: DataFrame, rounds: int = ROUNDS, slack: int = 0, cut: Callable[[DataFrame], DataFrame] | None = None, members: DataFrame | None = None
) -> DataFrame:
    """stop_id, wanted and found arrivals where labels differ from a plain scan of the timetable; no row means they agree.

    The scan follows every trip in order, with a window a trip, and walks from every stop in every round: nothing of earliest() but the
    rules. walks and members are those of earliest(). It ends early only where a round changes nothing.
    """
    c, one = F.col, F.struct
    order = Window.partitionBy("trip_id").orderBy("sequence", "departure_sec").rowsBetween(Window.unboundedPreceding, -1)
    lowest = lambda df: df.groupBy("stop_id").agg(F.min(one("arrival", "rides")).alias("l")).select("stop_id", "l.arrival", "l.rides")
    best = lowest(start.select("stop_id", "arrival", "rides"))
    members = walks.select(c("from_stop").alias("stop_id")).union(walks.select("to_stop")).distinct().withColumn("spot", c("stop_id")) if members is None else members
    for k in range(rounds):
        ready = best.where(c("rides") == k).select("stop_id", c("arrival").alias("ready"))
        scan = events.select("trip_id", "sequence", "stop_id", "arrival_sec", "departure_sec").join(ready, "stop_id", "left")
        on = F.first(F.when(c("departure_sec") >= c("ready") + slack, one("sequence", "departure_sec")), ignorenulls=True).over(order)
        off = scan.withColumn("on", on).where((c("sequence") > c("on.sequence")) & (c("arrival_sec") >= c("on.departure_sec")))
        rode = lowest(best.union(off.select("stop_id", "arrival_sec", F.lit(k + 1))))
        rode = rode if cut is None else cut(rode)
        at = rode.join(members, "stop_id").groupBy("spot").agg(F.min(one("arrival", "rides")).alias("l"))
        there = walks.join(at, c("from_stop") == c("spot")).groupBy(c("to_stop").alias("spot")).agg(F.min(one((c("l.arrival") + c("seconds")).alias("arrival"), c("l.rides").alias("rides"))).alias("l"))
        after = lowest(rode.union(there.join(members, "spot").select("stop_id", "l.arrival", "l.rides")))
        if cut is not None:
            after = cut(after)
            if not after.exceptAll(best).limit(1).count():
                break
        best = after
    wanted = best.select("stop_id", c("arrival").alias("wanted"), c("rides").alias("w"))
    both = wanted.join(labels.select("stop_id", c("arrival").alias("found"), c("rides").alias("f")), "stop_id", "full_outer")
    return both.where(~(c("wanted").eqNullSafe(c("found")) & c("w").eqNullSafe(c("f")))).select("stop_id", "wanted", "found")


def clean_events(events: DataFrame, trips: DataFrame, stops: DataFrame, routes: DataFrame, services: DataFrame) -> DataFrame:
    """Events whose trip, route, service and stop are known, with the trip's route and mode. Trips that don't run go first, below whatever orders events."""
    good = trips.join(services.select("service_id"), "service_id", "left_semi").join(routes.select("route_id", S.mode_of(F.col("route_type")).alias("mode")), "route_id")
    events = events.join(good.select("trip_id"), "trip_id", "left_semi")
    return events.join(good.select("trip_id", "route_id", "service_id", "mode"), "trip_id").join(stops.select("stop_id"), "stop_id", "left_semi")


def stop_modes(events: DataFrame) -> DataFrame:
    """The mask of modes that serve each stop."""
    return events.groupBy("stop_id").agg(F.bit_or(S.mode_bit(F.col("mode"))).alias("modes"))


def trip_ranges(events: DataFrame) -> DataFrame:
    """How many events each trip has, its first and last place in order, and its departure and arrival."""
    return events.groupBy("trip_id").agg(
        F.count("*").alias("events"), F.min("sequence").alias("first"), F.max("sequence").alias("last"),
        F.min_by("departure_sec", "sequence").alias("departs"), F.max_by("arrival_sec", "sequence").alias("arrives"),
    )


def neighbours(left: DataFrame, right: DataFrame, meters: int, cells: int = CELLS) -> DataFrame:
    """Pairs of left and right stops within a distance: right stops are copied into the cells around, so the join is on cells.

    left: stop_id, lat_e7, lon_e7; right: to_id, to_lat, to_lon. A cell joins only what is near it: no cross join, no broadcast of either side.
    """
    rows = min(cells, (meters + 1) * S.E7 // (S.METERS_PER_DEGREE * S.CELL_E7) + 1)  # a row further is further away than meters, at any latitude
    around = lambda n: F.explode(F.sequence(F.lit(-n), F.lit(n)))
    r = right.withColumn("_dy", around(rows)).withColumn("_dx", around(cells))
    r = r.select("to_id", "to_lat", "to_lon", (S.cell(F.col("to_lat")) + F.col("_dy")).alias("cy"), (S.cell(F.col("to_lon")) + F.col("_dx")).alias("cx"))
    near = left.withColumns({"cy": S.cell(F.col("lat_e7")), "cx": S.cell(F.col("lon_e7"))}).join(r, ["cy", "cx"])
    ends = [F.col(c) for c in ("lat_e7", "lon_e7", "to_lat", "to_lon")]
    close = near.where(F.abs(F.col("to_lat") - F.col("lat_e7")) <= (meters + 1) * S.E7 // S.METERS_PER_DEGREE).where(S.direct_squared(*ends) < (meters + 1) ** 2)
    return close.withColumn("meters", S.direct_m(*ends))


def spots(stops: DataFrame) -> DataFrame:
    """stop_id, lat_e7, lon_e7 and spot of each stop with a place: the least id of the stops at the same place."""
    first = stops.groupBy("lat_e7", "lon_e7").agg(F.min("stop_id").alias("spot"))
    return stops.select("stop_id", "lat_e7", "lon_e7").join(first, ["lat_e7", "lon_e7"])


def spot_walks(members: DataFrame, meters: int = TRANSFER_M) -> DataFrame:
    """from_stop, to_stop, meters and seconds of all pairs of spots within walking distance, each with itself too. members: spots() of the stops."""
    places = members.where("stop_id = spot").select("stop_id", "lat_e7", "lon_e7").distinct()
    right = places.select(F.col("stop_id").alias("to_id"), F.col("lat_e7").alias("to_lat"), F.col("lon_e7").alias("to_lon"))
    near = neighbours(places, right, meters)
    return near.select(F.col("stop_id").alias("from_stop"), F.col("to_id").alias("to_stop"), "meters", S.walk_seconds(F.col("meters")).alias("seconds"))


def transfers(stops: DataFrame, meters: int = TRANSFER_M) -> DataFrame:
    """from_stop, to_stop, meters and seconds of all pairs of different stops within walking distance, worked out once a pair of places."""
    members = spots(stops)
    ends = lambda n: members.select(F.col("spot").alias(f"{n}_stop"), F.col("stop_id").alias(f"_{n}")).hint("shuffle_hash")
    found = spot_walks(members, meters).join(ends("from"), "from_stop").join(ends("to"), "to_stop").where("_from <> _to")
    return found.select(F.col("_from").alias("from_stop"), F.col("_to").alias("to_stop"), "meters", "seconds")


def from_point(stops: DataFrame, lat_e7: int, lon_e7: int, meters: int) -> DataFrame:
    """Stops within a distance of a point; the box of the distance prunes the scan, the exact distance decides."""
    dlat = meters * S.E7 // S.METERS_PER_DEGREE + 2
    near = stops.where(F.col("lat_e7").between(lat_e7 - dlat, lat_e7 + dlat))
    at = [F.lit(lat_e7).cast("bigint"), F.lit(lon_e7).cast("bigint")]
    return near.withColumn("meters", S.direct_m(*at, F.col("lat_e7"), F.col("lon_e7"))).where(F.col("meters") <= meters)


def board_first(labels: DataFrame, events: DataFrame, ride: int, slack: int = 0) -> DataFrame:
    """Where each trip is boarded in a round: its first event that a label with exactly ride rides reaches in time."""
    ready = labels.where(F.col("rides") == ride).select("stop_id", "arrival")
    can = events.join(ready, "stop_id").where(F.col("departure_sec") >= F.col("arrival") + slack)
    return can.groupBy("trip_id").agg(F.min_by(F.struct("sequence", "departure_sec", "stop_id"), F.struct("sequence", "departure_sec", "stop_id")).alias("b")).select(
        "trip_id", F.col("b.sequence").alias("board_seq"), F.col("b.departure_sec").alias("board_dep"), F.col("b.stop_id").alias("board_stop")
    )


LABEL = ("stop_id", "arrival", "rides", "kind", "previous", "trip_id", "departed")


def _best(candidates: DataFrame) -> DataFrame:
    """The least (arrival, rides) of each stop, then by the other columns, so that ties are decided alike each time."""
    rest = [c for c in LABEL if c != "stop_id"]
    return candidates.groupBy("stop_id").agg(F.min(F.struct(*rest)).alias("l")).select("stop_id", *[F.col(f"l.{c}").alias(c) for c in rest])


def ride(labels: DataFrame, events: DataFrame, round_: int, slack: int = 0, by_stop: DataFrame | None = None) -> DataFrame:
    """Labels after boarding trips in a round: every later event of a boarded trip that doesn't run back in time is a candidate."""
    on = board_first(labels, events if by_stop is None else by_stop, round_, slack)
    off = events.join(on, "trip_id").where((F.col("sequence") > F.col("board_seq")) & (F.col("arrival_sec") >= F.col("board_dep")))
    new = off.select(
        "stop_id", F.col("arrival_sec").alias("arrival"), F.lit(round_ + 1).alias("rides"), F.lit(2).alias("kind"), F.col("board_stop").alias("previous"), "trip_id", F.col("board_dep").alias("departed")
    )
    return _best(labels.select(*LABEL).unionByName(new))


def walk_on(labels: DataFrame, walks: DataFrame, round_: int = 0, members: DataFrame | None = None) -> DataFrame:
    """Labels after one walk from the labels as they stand; walks don't chain within a round.

    A label that an earlier round left, other than one on foot from the origin, was walked from in that round, so only those of this round's ride are.
    members: stop_id and spot, with walks between spots. Of a spot only its first label is walked from, and on the spot itself the first two,
    as a stop does not walk to itself.
    """
    moved = labels if round_ == 0 else labels.where((F.col("rides") == round_ + 1) | (F.col("kind") == 3))
    walked = lambda df: df.select(
        F.col("to_stop").alias("stop_id"), (F.col("arrival") + F.col("seconds")).alias("arrival"), "rides", F.lit(3).alias("kind"), F.col("stop_id").alias("previous"),
        F.lit(-1).cast("bigint").alias("trip_id"), F.col("arrival").alias("departed"),
    )
    if members is None:
        return _best(labels.select(*LABEL).unionByName(walked(moved.join(walks, F.col("stop_id") == F.col("from_stop")))))
    first = Window.partitionBy("spot").orderBy("arrival", "rides", "stop_id")
    two = moved.join(members.select("stop_id", "spot"), "stop_id").withColumn("_k", F.row_number().over(first)).where("_k <= 2")
    paths = two.join(walks, F.col("spot") == F.col("from_stop"))
    at = members.select(F.col("spot"), F.col("stop_id").alias("to_id"))
    away = _best(walked(paths.where("_k = 1 and from_stop <> to_stop"))).withColumnRenamed("stop_id", "spot").join(at, "spot").withColumn("stop_id", F.col("to_id"))
    here = two.join(walks.where("from_stop = to_stop"), F.col("spot") == F.col("from_stop")).join(at, "spot").where("stop_id <> to_id").withColumn("to_stop", F.col("to_id"))
    return _best(labels.select(*LABEL).unionByName(away.select(*LABEL)).unionByName(walked(here)))


def start_labels(stops: DataFrame, depart: int) -> DataFrame:
    """Labels of the stops that the origin reaches on foot: stops with meters."""
    return stops.select(
        "stop_id", (F.lit(depart) + S.walk_seconds(F.col("meters"))).cast("bigint").alias("arrival"), F.lit(0).alias("rides"), F.lit(1).alias("kind"),
        F.lit(-1).cast("bigint").alias("previous"), F.lit(-1).cast("bigint").alias("trip_id"), F.lit(depart).cast("bigint").alias("departed"),
    )


def earliest(
    start: DataFrame, events: DataFrame, walks: DataFrame, rounds: int = ROUNDS, slack: int = 0, cut: Callable[[DataFrame], DataFrame] | None = None, members: DataFrame | None = None, by_stop: DataFrame | None = None
) -> DataFrame:
    """Labels after some rounds of riding and walking. cut ends the lineage of a round (a checkpoint or a written table); with it, a round
    that changes nothing is the last, as none after it would.

    members: stop_id and spot, where walks are between spots (spot_walks()); by_stop: the events again, where events are in buckets of
    trips and these in buckets of stops.
    """
    labels = start
    for k in range(rounds):
        rode = ride(labels, events, k, slack, by_stop)
        after = walk_on(rode if cut is None else cut(rode), walks, k, members)  # walks read it several times
        if cut is not None:
            after = cut(after)
            if not after.exceptAll(labels.select(*LABEL)).limit(1).count():
                break
        labels = after
    return labels


def best_destination(labels: DataFrame, near: DataFrame, need_ride: bool = True) -> DataFrame:
    """The stop with the least arrival plus twice the walk, then the least finish, then the least id; near: stop_id, meters."""
    walk = S.walk_seconds(F.col("meters"))
    reach = labels.where(F.col("rides") > (0 if need_ride else -1)).join(near.select("stop_id", "meters"), "stop_id")
    scored = reach.select("stop_id", "meters", (F.col("arrival") + walk).alias("finish"), (F.col("arrival") + 2 * walk).alias("score"))
    order = F.struct("score", "finish", "stop_id", "meters")
    return scored.agg(F.min(order).alias("b")).where("b is not null").select("b.stop_id", "b.finish", "b.score", "b.meters")


def arrive_by(events: DataFrame, origin: DataFrame, target: DataFrame, deadline: int) -> DataFrame:
    """The single ride that leaves latest and still arrives in time.

    origin and target: stop_id, meters. The last event before the alight that the origin can board counts, one window a trip.
    """
    o = origin.select(F.col("stop_id").alias("o_id"), S.walk_seconds(F.col("meters")).alias("o_walk"))
    t = target.select(F.col("stop_id").alias("t_id"), S.walk_seconds(F.col("meters")).alias("t_walk"))
    seen = events.join(o, F.col("stop_id") == F.col("o_id"), "left").join(t, F.col("stop_id") == F.col("t_id"), "left").where("o_id is not null or t_id is not null")
    board = F.when(F.col("o_walk").isNotNull() & (F.col("departure_sec") >= F.col("o_walk")), F.struct("stop_id", "departure_sec", "o_walk", "sequence"))
    w = Window.partitionBy("trip_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    rode = seen.withColumn("_b", board).withColumn("_b", F.last("_b", ignorenulls=True).over(w))
    good = rode.where("t_walk is not null and _b is not null").where(
        (F.col("sequence") > F.col("_b.sequence")) & (F.col("arrival_sec") >= F.col("_b.departure_sec")) & (F.col("arrival_sec") + F.col("t_walk") <= deadline)
    )
    out = good.select((F.col("_b.departure_sec") - F.col("_b.o_walk")).alias("leave"), "trip_id", F.col("_b.stop_id").alias("board_stop"), F.col("stop_id").alias("alight_stop"), F.col("arrival_sec").alias("arrival"))
    order = F.struct("leave", -F.col("arrival"), -F.col("trip_id"), -F.col("alight_stop"))
    return out.agg(F.max_by(F.struct("*"), order).alias("b")).where("b is not null").select("b.*")


def plan_legs(labels: DataFrame, last_stop: int, most: int = 16) -> list[dict]:
    """The legs that lead to a stop, first leg first: at most `most` look-ups of one row each, then compacted."""
    legs, at = [], last_stop
    for _ in range(most):
        row = labels.where(F.col("stop_id") == at).first()
        if row is None or row["kind"] == 1:
            break
        legs.append({"kind": "ride" if row["kind"] == 2 else "walk", "trip": row["trip_id"], "board": row["previous"], "alight": at, "departure": row["departed"], "arrival": row["arrival"]})
        at = row["previous"]
    return compact(legs[::-1])


def compact(legs: list[dict]) -> list[dict]:
    """Neighbouring legs of one trip, and neighbouring walks, become one."""
    out: list[dict] = []
    for leg in legs:
        last = out[-1] if out else None
        if last and last["alight"] == leg["board"] and last["kind"] == leg["kind"] and (leg["kind"] == "walk" or last["trip"] == leg["trip"]):
            out[-1] = last | {"alight": leg["alight"], "arrival": leg["arrival"]}
        else:
            out.append(dict(leg))
    return out
