"""Route requests and answers as JSON objects, over the tables of a feed."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import address_search as A
from ..operators import transit as TR

REQUEST = """from string, to string, from_lat double, from_lon double, to_lat double, to_lon double, from_lat_e7 long, from_lon_e7 long, to_lat_e7 long, to_lon_e7 long,
    depart string, depart_date int, depart_seconds int, address_index_only boolean"""


class BadRequest(ValueError):
    """A request that can't be answered as it stands."""


def parse(request: str | dict) -> dict:
    """A checked request: origin and target (text, or e7 coordinates), date and seconds."""
    try:
        r = json.loads(request) if isinstance(request, str) else dict(request)
    except ValueError as e:
        raise BadRequest(f"not JSON: {e}") from e
    if not isinstance(r, dict):
        raise BadRequest("a request is an object")

    def end(name: str) -> str | tuple[int, int]:
        lat, lon = r.get(f"{name}_lat"), r.get(f"{name}_lon")
        if (lat is None) != (lon is None):
            raise BadRequest(f"{name}_lat and {name}_lon go together")
        if lat is not None:
            if not (isinstance(lat, (int, float)) and isinstance(lon, (int, float)) and -90 <= lat <= 90 and -180 <= lon <= 180):
                raise BadRequest(f"{name} is off the map")
            nearest = lambda x: int(x * 1e7 + (0.5 if x >= 0 else -0.5))
            return nearest(lat), nearest(lon)
        lat, lon = r.get(f"{name}_lat_e7"), r.get(f"{name}_lon_e7")
        if (lat is None) != (lon is None):
            raise BadRequest(f"{name}_lat_e7 and {name}_lon_e7 go together")
        if lat is not None:
            if not (abs(lat) <= 900_000_000 and abs(lon) <= 1_800_000_000):
                raise BadRequest(f"{name} is off the map")
            return int(lat), int(lon)
        if not isinstance(r.get(name), str) or not r[name]:
            raise BadRequest(f"{name} is missing")
        return r[name]

    if r.get("depart") is not None:
        try:
            date, seconds = S.parse_when(r["depart"])
        except (TypeError, ValueError) as e:
            raise BadRequest(str(e)) from e
    else:
        date, seconds = r.get("depart_date"), r.get("depart_seconds")
        if date is None or seconds is None:
            raise BadRequest("depart, or depart_date and depart_seconds, are missing")
        if not 0 <= seconds < 48 * 3600:
            raise BadRequest("depart_seconds is out of range")
    return {"from": end("from"), "to": end("to"), "date": date, "seconds": seconds}


def locate(place: str | tuple[int, int], addresses: DataFrame) -> tuple[int, int] | None:
    """Coordinates of an end: as given, or of the best address."""
    if not isinstance(place, str):
        return place
    parts = place.split(",")
    if len(parts) == 2:
        try:
            lat, lon = (float(p) for p in parts)
            if -90 <= lat <= 90 and -180 <= lon <= 180:
                return round(lat * 1e7), round(lon * 1e7)
        except ValueError:
            pass
    asked = addresses.sparkSession.createDataFrame([(0, place)], "query_id int, query string")
    known = addresses.where("lat_e7 is not null")
    best = A.resolve_exact(asked, known).join(known, "id").select("lat_e7", "lon_e7").first()
    if best is None:
        scored = A.score_matches(asked, known).orderBy(F.desc("score"), "id").limit(1)
        best = scored.join(known, "id").select("lat_e7", "lon_e7").first()
    return None if best is None else (best[0], best[1])


def route(request: str | dict, tables: dict[str, DataFrame], addresses: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> str:
    """The answer to a request as one JSON object: found, times, walks and legs, or an error."""
    try:
        r = parse(request)
    except BadRequest as e:
        return json.dumps({"ok": False, "error": str(e)})
    ends = [locate(r[k], addresses) for k in ("from", "to")]
    if None in ends:
        return json.dumps({"ok": False, "error": f"no address for {'from' if ends[0] is None else 'to'}"})
    stops = tables["stops"]
    active = TR.active_services(tables["calendar"], tables["exceptions"], r["date"])
    events = cut(tables["events"].join(active, "service_id", "left_semi"))
    start = TR.start_labels(TR.from_point(stops, *ends[0], TR.ACCESS_M), r["seconds"])
    labels = cut(TR.earliest(start, events, cut(TR.transfers(stops)), cut=cut))
    best = TR.best_destination(labels, TR.from_point(stops, *ends[1], TR.EGRESS_M)).first()
    if best is None:
        return json.dumps({"ok": True, "found": False})
    legs = TR.plan_legs(labels, best["stop_id"])
    return json.dumps({"ok": True, "found": True, "depart_seconds": r["seconds"], "arrive_seconds": best["finish"], "total_seconds": best["finish"] - r["seconds"], "egress_meters": best["meters"], "legs": legs})


def answers(requests: DataFrame) -> DataFrame:
    """Requests (value: JSON text) parsed with the fixed schema; rows that aren't JSON have nulls."""
    return requests.select("value", F.from_json("value", REQUEST).alias("request")).select("value", "request.*")


def events_json(df: DataFrame, event: str, order: list[str], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """JSON lines in one envelope with a running number from 1: rows are sorted and written in parts, and the parts before a row are counted."""
    placed = cut(df.sort(*order).withColumn("_at", F.monotonically_increasing_id()))
    counts = {r["part"]: r["n"] for r in placed.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    before, so_far = {}, 0
    for part in sorted(counts):
        before[part], so_far = so_far, so_far + counts[part]
    first = F.element_at(F.create_map(*[F.lit(x) for kv in (before or {0: 0}).items() for x in kv]), F.shiftright("_at", 33))
    number = first + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    body = F.struct(F.lit(event).alias("event"), number.alias("seq"), F.struct(*df.columns).alias("data"))
    return placed.select(F.to_json(body).alias("value"))
