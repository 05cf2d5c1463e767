"""DuckDB SQL for the queries of catalog.py, written from the definitions rather than from the Spark code."""

from __future__ import annotations

import math

from ..sources.fixtures import portable_sql

BOX = (12_900_000_000, 52_320_000_000, 13_050_000_000, 52_480_000_000)
ZOOM = 12


def fx(*names: str) -> str:
    """WITH clauses for projections."""
    return ", ".join(f"fx_{n} AS ({portable_sql(n)})" for n in names)


def isqrt(x: str) -> str:
    return f"CAST(floor(sqrt(CAST({x} AS DOUBLE))) AS BIGINT)"


_COS = "[" + ", ".join(str(round(math.cos(math.radians(d)) * 1_000_000)) for d in range(91)) + "]"


def cos_q6(v: str) -> str:
    return f"(CASE WHEN {v} >= 900000000 THEN 0 ELSE {_COS}[{v} // 10000000 + 1] - (({_COS}[{v} // 10000000 + 1] - {_COS}[{v} // 10000000 + 2]) * ({v} % 10000000)) // 10000000 END)"


def per_lon(lat: str) -> str:
    return f"((111320 * {cos_q6(f'abs({lat})')} + 500000) // 1000000)"


def direct_m(a: str, b: str, c: str, d: str) -> str:
    dy, dx = f"((({c}) - ({a})) * 111320 // 10000000)", f"((({d}) - ({b})) * {per_lon(f'((({a}) + ({c})) // 2)')} // 10000000)"
    return isqrt(f"({dx} * {dx} + {dy} * {dy})")


def edge_m(a: str, b: str, c: str, d: str) -> str:
    dx, dy = f"((abs(({b}) - ({d})) * 68000 + 5000000) // 10000000)", f"((abs(({a}) - ({c})) * 111320 + 5000000) // 10000000)"
    return f"greatest({isqrt(f'({dx} * {dx} + {dy} * {dy})')}, 1)"


def e7(nano: str) -> str:
    return f"(({nano} + CASE WHEN {nano} >= 0 THEN 50 ELSE -50 END) // 100)"


def walk_s(m: str) -> str:
    return f"(({m} * 3600 + 4799) // 4800)"


def floor_div(a: str, b: int) -> str:
    return f"CAST(floor(CAST({a} AS DOUBLE) / {b}) AS BIGINT)"


def tile(col: str, shift: str, span: int) -> str:
    axis = 1 << ZOOM
    return f"least(greatest(0, least({span}, {shift})) * {axis} // {span}, {axis - 1})"


def tx(lon: str) -> str:
    return tile(lon, f"{lon} + 180000000000", 360_000_000_000)


def ty(lat: str) -> str:
    return tile(lat, f"90000000000 - {lat}", 180_000_000_000)


_IN_BOX = f"lon_nano BETWEEN {BOX[0]} AND {BOX[2]} AND lat_nano BETWEEN {BOX[1]} AND {BOX[3]}"
_BBOX = "min(lat_nano) AS min_lat, max(lat_nano) AS max_lat, min(lon_nano) AS min_lon, max(lon_nano) AS max_lon"
_STYLE = """CASE WHEN natural_ = 'coastline' OR landuse = 'reservoir' THEN 0 WHEN waterway IS NOT NULL THEN 1 WHEN landuse = 'forest' OR natural_ = 'wood' THEN 2
    WHEN leisure = 'park' OR landuse = 'meadow' THEN 3 WHEN building IS NOT NULL THEN 4 WHEN highway = 'motorway' THEN 5 WHEN highway = 'primary' THEN 6 WHEN highway = 'secondary' THEN 7
    WHEN highway IN ('footway', 'cycleway') THEN 9 WHEN highway IS NOT NULL THEN 8 WHEN railway IS NOT NULL THEN 10 END"""
_COAST = "coalesce(natural_ = 'coastline', false)"
_WALK = """coalesce(highway, '') <> '' AND coalesce(access, '') <> 'private' AND coalesce(foot, '') <> 'no' AND (coalesce(foot, '') = 'yes' OR highway IN ('footway', 'residential', 'primary', 'secondary'))"""
_WHOLE = f"""whole AS (SELECT way_id, {_BBOX}, count(*) AS ref_count FROM fx_way_ref r LEFT JOIN fx_node n ON n.id = r.node_id GROUP BY way_id HAVING count(lat_nano) = count(*) AND count(*) >= 2)"""
_REFS = f"refs AS (SELECT way_id, list(node_id ORDER BY pos) AS refs FROM fx_way_ref GROUP BY way_id)"
_CLOSED = "len(refs) >= 4 AND refs[1] = refs[len(refs)]"
_FEATURE = f"""{_WHOLE}, {_REFS}, feature AS (SELECT w.id, {_STYLE} AS style, CASE WHEN {_STYLE} IN (0, 2, 3, 4) AND {_CLOSED} AND NOT {_COAST} THEN 1 ELSE 0 END + CASE WHEN {_COAST} THEN 2 ELSE 0 END AS flags, min_lat, max_lat, min_lon, max_lon
    FROM fx_way w JOIN whole ON whole.way_id = w.id JOIN refs ON refs.way_id = w.id WHERE {_STYLE} IS NOT NULL)"""
_ASSIGN = f"""assigned AS (SELECT f.*, x.x AS tile_x, y.y AS tile_y, ({ZOOM}::BIGINT << 58) + (x.x << 29) + y.y AS tile_id FROM feature f,
    unnest(range({tx('f.min_lon')}, {tx('f.max_lon')} + 1)) AS x(x), unnest(range({ty('f.max_lat')}, {ty('f.min_lat')} + 1)) AS y(y))"""
_SEG = f"""node7 AS (SELECT id, {e7('lat_nano')} AS lat, {e7('lon_nano')} AS lon FROM fx_node),
  pairs AS (SELECT r.way_id, pos, node_id AS a, lead(node_id) OVER w AS b FROM fx_way_ref r JOIN fx_way y ON y.id = r.way_id WHERE {_WALK} WINDOW w AS (PARTITION BY r.way_id ORDER BY pos)),
  seg AS (SELECT p.way_id, p.pos, p.a, p.b, {edge_m('na.lat', 'na.lon', 'nb.lat', 'nb.lon')} AS meters FROM pairs p JOIN node7 na ON na.id = p.a JOIN node7 nb ON nb.id = p.b WHERE p.a <> p.b)"""
_EDGE = f"{_SEG}, edge AS (SELECT a AS from_id, b AS to_id, meters FROM seg UNION ALL SELECT b, a, meters FROM seg)"
_KIND = "CASE WHEN place = 'city' THEN 'city' WHEN place = 'suburb' THEN 'suburb' WHEN lv = 2 THEN 'country' WHEN lv = 4 THEN 'state' WHEN lv BETWEEN 5 AND 10 THEN 'district' ELSE 'unknown' END"
_PLACE = f"""ways AS (SELECT rel_id, count(*) AS ways FROM fx_member WHERE member_type = 1 GROUP BY rel_id),
  lv AS (SELECT id, name, place, CAST(admin_level AS INT) AS lv FROM fx_relation),
  place AS (SELECT id, name, {_KIND} AS kind, lv AS level, ways,
     CASE {_KIND} WHEN 'city' THEN 100000 WHEN 'state' THEN 80000 WHEN 'district' THEN 70000 WHEN 'suburb' THEN 50000 WHEN 'country' THEN 40000 ELSE 0 END
     + CASE WHEN lv BETWEEN 1 AND 19 THEN (20 - lv) * 1000 ELSE 0 END + least(ways, 999) AS score
     FROM lv JOIN ways ON rel_id = id WHERE lv BETWEEN 1 AND 10)"""

ORIGIN = (524_000_000, 130_000_000)
_METRIC = f"""n7 AS (SELECT id, {e7('lat_nano')} AS lat_e7, {e7('lon_nano')} AS lon_e7 FROM fx_node),
  m AS (SELECT *, (lon_e7 - {ORIGIN[1]})::BIGINT * {per_lon(f'{ORIGIN[0]}::BIGINT')} // 10000000 AS mx, (lat_e7 - {ORIGIN[0]})::BIGINT * 111320 // 10000000 AS my FROM n7),
  placed AS (SELECT *, {floor_div('mx', 4000)} AS tile_x, {floor_div('my', 4000)} AS tile_y FROM m),
  tiled AS (SELECT *, ((tile_x + 268435456) << 29) | (tile_y + 268435456) AS tile_id FROM placed)"""
DATE = 20260603
_SERVICE = f"""active AS (SELECT c.service_id FROM fx_calendar c LEFT JOIN (SELECT service_id, min(type) AS type FROM fx_exception WHERE date = {DATE} GROUP BY 1) e USING (service_id)
   WHERE coalesce(type = 1, start_date <> 0 AND end_date <> 0 AND {DATE} BETWEEN start_date AND end_date AND (mask >> (isodow(DATE '2026-06-03') - 1)) & 1 = 1))"""
_MODE = "CASE WHEN route_type = 0 OR route_type BETWEEN 900 AND 999 THEN 1 WHEN route_type = 1 OR route_type BETWEEN 400 AND 499 THEN 2 WHEN route_type = 2 OR route_type BETWEEN 100 AND 199 THEN 3 WHEN route_type = 3 OR route_type BETWEEN 700 AND 799 THEN 4 ELSE 5 END"
_EVENT = f"""{_SERVICE}, event AS (SELECT s.*, t.route_id, t.service_id, {_MODE} AS mode FROM fx_stop_time s JOIN fx_trip t USING (trip_id) JOIN active USING (service_id) JOIN fx_route USING (route_id)
   WHERE stop_id IN (SELECT stop_id FROM fx_stop))"""
_TRANSFER = f"""pair AS (SELECT a.stop_id AS from_stop, b.stop_id AS to_stop, {direct_m('a.lat_e7', 'a.lon_e7', 'b.lat_e7', 'b.lon_e7')} AS meters FROM fx_stop a, fx_stop b
   WHERE a.stop_id <> b.stop_id AND abs(a.lat_e7 - b.lat_e7) < 80000 AND abs(a.lon_e7 - b.lon_e7) < 200000),
   transfer AS (SELECT *, {walk_s('meters')} AS seconds FROM pair WHERE meters <= 800)"""
_EVENT_FX = ("stop", "trip", "stop_time", "route", "calendar", "exception")
START_STOP, DEPART, TARGET_STOP, DEADLINE = 7, 25_000, 3, 60_000


def _round(k: int, before: str) -> str:
    """Labels (stop_id, arrival, rides) after one round."""
    return f"""on{k} AS (SELECT trip_id, min(sequence) AS bs, arg_min(departure_sec, sequence) AS bd FROM event e JOIN {before} l USING (stop_id) WHERE l.rides = {k} AND departure_sec >= l.arrival GROUP BY trip_id),
  r{k} AS (SELECT stop_id, min({{'a': arrival, 'r': rides}}) AS l FROM (SELECT * FROM {before} UNION ALL
     SELECT stop_id, arrival_sec, {k + 1} FROM event JOIN on{k} USING (trip_id) WHERE sequence > bs AND arrival_sec >= bd) GROUP BY stop_id),
  v{k} AS MATERIALIZED (SELECT stop_id, l.a AS arrival, l.r AS rides FROM r{k}),
  t{k} AS (SELECT stop_id, min({{'a': arrival, 'r': rides}}) AS l FROM (SELECT * FROM v{k} UNION ALL
     SELECT to_stop, arrival + seconds, rides FROM v{k} JOIN transfer ON from_stop = stop_id) GROUP BY stop_id),
  l{k + 1} AS MATERIALIZED (SELECT stop_id, l.a AS arrival, l.r AS rides FROM t{k})"""


def _rounds(n: int) -> str:
    start = f"l0 AS (SELECT {START_STOP}::BIGINT AS stop_id, {DEPART}::BIGINT AS arrival, 0 AS rides)"
    return ", ".join([start, *[_round(k, f"l{k}") for k in range(n)]])


def _label(arrival: str, rides: str, kind: str, previous: str, trip: str, departed: str) -> str:
    parts = (("arrival", arrival), ("rides", rides), ("kind", kind), ("previous", previous), ("trip", trip), ("departed", departed))
    return "{" + ", ".join(f"'{k}': ({v})::BIGINT" for k, v in parts) + "}"


def _whole_round(k: int) -> str:
    """One round with whole labels f (arrival, rides, kind, previous, trip, departed)."""
    return f"""board{k} AS (SELECT trip_id, min({{'s': sequence, 'd': departure_sec, 'p': e.stop_id}}) AS b FROM event e JOIN f{k} USING (stop_id) WHERE l.rides = {k} AND departure_sec >= l.arrival GROUP BY trip_id),
  rode{k} AS MATERIALIZED (SELECT stop_id, min(l) AS l FROM (SELECT * FROM f{k} UNION ALL SELECT stop_id, {_label('arrival_sec', str(k + 1), '2', 'b.p', 'trip_id', 'b.d')} FROM event JOIN board{k} USING (trip_id)
     WHERE sequence > b.s AND arrival_sec >= b.d) GROUP BY stop_id),
  f{k + 1} AS MATERIALIZED (SELECT stop_id, min(l) AS l FROM (SELECT * FROM rode{k} UNION ALL SELECT to_stop, {_label('l.arrival + seconds', 'l.rides', '3', 'stop_id', '-1', 'l.arrival')} FROM rode{k} JOIN transfer ON from_stop = stop_id) GROUP BY stop_id)"""


_WHOLE_ROUNDS = ", ".join([f"f0 AS (SELECT {START_STOP}::BIGINT AS stop_id, {_label(str(DEPART), '0', '1', '-1', '-1', str(DEPART))} AS l)", *[_whole_round(k) for k in range(6)]])
_POINT = f"(SELECT lat_e7 AS plat, lon_e7 AS plon FROM fx_stop WHERE stop_id = {TARGET_STOP})"
_NORM = lambda c: f"replace(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'ß', 'ss')"
QUERIES = (
    (1, "Friedrich-Engels-Straße 22"), (2, "ring 30, NATION_3"), (3, "Am Markt 7 hinten"), (4, "Bahnhofallee 12, Nord"), (5, "Hauptstrasse 14405"),
    (6, "Hauptsrasse 31"), (7, "Bahnhofalle 44"), (8, "NATION_5 20"), (9, "Ring"), (10, "Am Markt 25/27, 14402"),
)
_ASKED = "asked(query_id, query) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUERIES) + ")"
_PARTS = f"""q AS (SELECT query_id, trim(split_part({_NORM('query')}, ',', 1), chr(9) || chr(10) || chr(13) || ' ,') AS main,
    CASE WHEN contains(query, ',') THEN trim(substr({_NORM('query')}, instr(query, ',') + 1), chr(9) || chr(10) || chr(13) || ' ,') ELSE '' END AS place FROM asked),
  parts AS (SELECT *, trim(regexp_extract(main, '^(.*[^a-z0-9])([a-z0-9]+)[^a-z0-9]*$', 1), chr(9) || chr(10) || chr(13) || ' ,') AS street,
    regexp_extract(main, '^(.*[^a-z0-9])([a-z0-9]+)[^a-z0-9]*$', 2) AS house FROM q)"""
_ADDR = f"""addr AS (SELECT id, lat_e7, {_NORM('street')} AS street, {_NORM('housenumber')} AS house, {_NORM('city')} AS city, {_NORM('suburb')} AS suburb, {_NORM('postcode')} AS postcode FROM fx_address),
  ahouse AS (SELECT addr.*, h FROM addr, unnest(list_distinct([house, split_part(house, '/', 1), CASE WHEN contains(house, '/') THEN split_part(house, '/', 2) ELSE house END])) AS u(h))"""
_PFIT = lambda p: "(" + " OR ".join(f"coalesce({f} = {p} OR (starts_with({f}, {p}) AND length({f}) > length({p}) AND {p} <> '' AND NOT regexp_matches(substr({f}, length({p}) + 1, 1), '^[a-z0-9]$')) OR (starts_with({p}, {f}) AND length({p}) > length({f}) AND NOT regexp_matches(substr({p}, length({f}) + 1, 1), '^[a-z0-9]$')), false)" for f in ("city", "suburb", "postcode")) + ")"  # noqa: E731,E501

# The tags that ways have, in order, and their columns.
WAY_TAGS = (
    ("highway", "highway"), ("foot", "foot"), ("building", "building"), ("leisure", "leisure"), ("shop", "shop"), ("natural", "natural_"), ("waterway", "waterway"), ("landuse", "landuse"),
    ("railway", "railway"), ("access", "access"), ("building:levels", "levels"), ("addr:street", "street"), ("addr:housenumber", "housenumber"), ("addr:postcode", "postcode"),
)
BUILDING_COLUMNS = (
    ("building", "building"), ("building_part", None), ("building_levels", "levels"), ("roof_levels", None), ("building_min_level", None), ("building_flats", None), ("building_apartments", None),
    ("building_use", None), ("start_date", None), ("addr_country", None), ("addr_state", None), ("addr_city", None), ("addr_suburb", None), ("addr_street", "street"),
    ("addr_housenumber", "housenumber"), ("addr_postcode", "postcode"), ("addr_place", None), ("addr_unit", None), ("addr_floor", None), ("addr_door", None), ("entrance", None), ("name", None),
    ("amenity", None), ("shop", "shop"), ("office", None), ("tourism", None), ("leisure", "leisure"), ("craft", None), ("healthcare", None), ("public_transport", None),
)
_FOOT = """min(lat_nano) + (max(lat_nano) - min(lat_nano)) // 2 AS center_lat, min(lon_nano) + (max(lon_nano) - min(lon_nano)) // 2 AS center_lon, count(*) AS ref_count, count(*) - count(lat_nano) AS missing_ref_count"""


def dec9(c: str) -> str:
    return f"printf('%d.%09d', {c} // 1000000000, {c} % 1000000000)"


def _line(kind: str, verdicts: str, **values: str) -> str:
    """A row of the building export: type, id, footprint f, three verdicts, and the columns that values gives."""
    places = [dec9(f"f.{c}") for c in ("center_lat", "center_lon", "min_lat", "min_lon", "max_lat", "max_lon")]
    return " || chr(9) || ".join([f"'{kind}'", "id", *places, "f.ref_count", "f.missing_ref_count", verdicts, *[values.get(n, "''") for n, _ in BUILDING_COLUMNS]])


_NAMES = "entity_type osm_id lat lon min_lat min_lon max_lat max_lon ref_count missing_ref_count has_address has_building residential_candidate"
_BUILDING = """e AS (SELECT *, building IS NOT NULL AS b, coalesce(building = 'house', false) AS explicit FROM fx_way),
  v AS (SELECT *, CASE WHEN (shop IS NOT NULL OR leisure IS NOT NULL) AND NOT explicit THEN false ELSE (street IS NOT NULL AND housenumber IS NOT NULL) OR b END AS r FROM e)"""
#: A box that part of the ways meet; ends of routes that are asked for.
SMALL_BOX = (12_850_000_000, 52_300_000_000, 12_851_000_000, 52_301_000_000)
ENDS = (*QUERIES, (11, "52.4, 13.05"), (12, "95.0,13.0"), (13, "Unter den Linden 999"), (14, "-1.0000001,-0.5"))
_ENDS = "asked(query_id, query) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in ENDS) + ")"
#: Walks that are asked for: query, first and last node.
PATHS = ((1, 5, 77), (2, 12, 140), (3, 33, 34), (4, 150, 9), (5, 61, 188), (6, 100, 101), (7, 7, 7), (8, 20, 170))

_LOST = "lost AS (SELECT rel_id, count(*) AS lost FROM fx_member WHERE member_type = 1 AND member_id NOT IN (SELECT way_id FROM fx_way_ref) GROUP BY 1)"
_REL_FOOT = f"""rf AS (SELECT rel_id, {_BBOX}, {_FOOT.replace(' AS missing_ref_count', ' + coalesce(any_value(lost), 0) AS missing_ref_count')}
  FROM fx_member JOIN fx_way_ref ON way_id = member_id LEFT JOIN fx_node n ON n.id = node_id LEFT JOIN lost USING (rel_id) WHERE member_type = 1 GROUP BY rel_id)"""

_COMPONENTS = f"""{fx('way_ref', 'node', 'member', 'relation')},
        border AS (SELECT DISTINCT member_id FROM fx_member JOIN fx_relation r ON r.id = rel_id WHERE member_type = 1 AND place = 'suburb' AND admin_level = '9'),
        ends AS (SELECT way_id, arg_min(node_id, pos) AS a, arg_max(node_id, pos) AS b, count(*) AS points, {_BBOX} FROM fx_way_ref JOIN border ON member_id = way_id LEFT JOIN fx_node n ON n.id = node_id
          GROUP BY way_id HAVING count(lat_nano) = count(*) AND count(*) >= 2),
        link AS (SELECT a, b FROM ends UNION SELECT b, a FROM ends),
        c(v, root) AS (SELECT a, a FROM link UNION SELECT link.b, c.root FROM c JOIN link ON link.a = c.v),
        least AS (SELECT v, min(root) AS root FROM c GROUP BY v),
        comp AS (SELECT root, min(min_lat) AS min_lat, max(max_lat) AS max_lat, min(min_lon) AS min_lon, max(max_lon) AS max_lon, sum(points)::BIGINT AS points, count(*) AS ways FROM ends JOIN least ON v = a GROUP BY root)"""

_E7 = lambda c: f"printf('%d.%07d', {c} // 10000000, {c} % 10000000)"
TILE_LINES = [("tile_found", "'yes'"), *[(f"tile_{k}", f"{c}::VARCHAR") for k, c in (("x", "tile_x"), ("y", "tile_y"), ("source_nodes", "source_nodes"), ("addresses", "addresses"), ("stops", "stops"), ("neighbor_mask", "mask"))],
              *[(f"tile_{k}", _E7(f"{k}_e7")) for k in ("min_lat", "min_lon", "max_lat", "max_lon")]]
_ROUTE_TILES = f"""{fx('node', 'stop', 'address')}, {_METRIC},
        other(what, lat, lon) AS (SELECT 's', lat_e7, lon_e7 FROM fx_stop UNION ALL SELECT 'a', lat_e7, lon_e7 FROM fx_address WHERE lat_e7 IS NOT NULL),
        om AS (SELECT what, (lon - {ORIGIN[1]})::BIGINT * {per_lon(f'{ORIGIN[0]}::BIGINT')} // 10000000 AS mx, (lat - {ORIGIN[0]})::BIGINT * 111320 // 10000000 AS my FROM other),
        oc AS (SELECT {floor_div('mx', 4000)} AS tile_x, {floor_div('my', 4000)} AS tile_y, count(*) FILTER (WHERE what = 's') AS stops, count(*) FILTER (WHERE what = 'a') AS addresses FROM om GROUP BY ALL),
        t AS (SELECT tile_id, tile_x, tile_y, count(*) AS source_nodes, min(lat_e7) AS min_lat_e7, max(lat_e7) AS max_lat_e7, min(lon_e7) AS min_lon_e7, max(lon_e7) AS max_lon_e7 FROM tiled GROUP BY ALL),
        rt AS (SELECT t.*, coalesce(stops, 0) AS stops, coalesce(addresses, 0) AS addresses FROM t LEFT JOIN oc USING (tile_x, tile_y))"""

ORACLE = {
    "entity_summary": f"""WITH {fx('node', 'way', 'way_ref', 'relation', 'member')} SELECT (SELECT count(*) FROM fx_node) AS nodes, (SELECT count(*) FROM fx_way) AS ways,
        (SELECT count(*) FROM fx_way_ref) AS way_refs, (SELECT count(*) FROM fx_relation) AS relations, (SELECT count(*) FROM fx_member) AS members""",
    "lookup_nodes_bbox_tag": f"WITH {fx('node')} SELECT id, lat_nano, lon_nano FROM fx_node WHERE {_IN_BOX} AND amenity = 'PROMO'",
    "lookup_way_by_id": f"WITH {fx('way')} SELECT id, highway FROM fx_way WHERE id = 77",
    "lookup_ways_limit": f"WITH {fx('way')} SELECT id, highway FROM fx_way WHERE highway = 'primary' ORDER BY id LIMIT 20",
    "lookup_way_bbox_any_node": f"WITH {fx('node', 'way', 'way_ref')} SELECT id, highway FROM fx_way WHERE id IN (SELECT way_id FROM fx_way_ref JOIN fx_node n ON n.id = node_id WHERE {_IN_BOX})",
    "lookup_text": f"""WITH {fx('node', 'way', 'way_ref')}, dec(id, lat, lon, tags) AS (SELECT id, printf('%d.%09d', lat_nano // 1000000000, lat_nano % 1000000000), printf('%d.%09d', lon_nano // 1000000000, lon_nano % 1000000000),
          ' name=' || name || ' amenity=' || amenity FROM fx_node WHERE {_IN_BOX}),
        n AS (SELECT way_id, count(*) AS n FROM fx_way_ref GROUP BY 1)
        SELECT 'node ' || id || ' lat=' || lat || ' lon=' || lon || tags AS value FROM dec
        UNION ALL SELECT 'way ' || id || ' refs=' || n || concat({', '.join(f"' {k}=' || {c}" for k, c in WAY_TAGS)}) FROM fx_way JOIN n ON way_id = id
          WHERE id IN (SELECT way_id FROM fx_way_ref JOIN fx_node n ON n.id = node_id WHERE {_IN_BOX})""",
    "address_rows": f"WITH {fx('way')} SELECT id, street, housenumber, postcode FROM fx_way WHERE street IS NOT NULL AND housenumber IS NOT NULL AND postcode IS NOT NULL",
    "address_incomplete": f"WITH {fx('way')} SELECT id, street, housenumber, postcode FROM fx_way WHERE coalesce(street, housenumber, postcode) IS NOT NULL",
    "address_tsv": f"""WITH {fx('way')} SELECT 'way' || chr(9) || id || chr(9) || chr(9) || chr(9) || chr(9) || chr(9) || chr(9) || street || chr(9) || housenumber || chr(9) || postcode AS value
        FROM fx_way WHERE street IS NOT NULL AND housenumber IS NOT NULL AND postcode IS NOT NULL""",
    "building_rows": f"""WITH {fx('way')}, {_BUILDING} SELECT id, true AS has_address, b AS has_building, r AS residential_candidate, {', '.join(f"{c or 'NULL'}::VARCHAR AS {n}" for n, c in BUILDING_COLUMNS)} FROM v""",
    "building_residential": f"WITH {fx('way')}, {_BUILDING} SELECT id, building FROM v WHERE r",
    "building_footprint": f"""WITH {fx('node', 'way_ref', 'way')} SELECT way_id, {_BBOX}, count(*) AS ref_count, count(*) - count(lat_nano) AS missing_ref_count,
        min(lat_nano) + (max(lat_nano) - min(lat_nano)) // 2 AS center_lat, min(lon_nano) + (max(lon_nano) - min(lon_nano)) // 2 AS center_lon
        FROM fx_way_ref r JOIN fx_way w ON w.id = way_id AND building IS NOT NULL LEFT JOIN fx_node n ON n.id = node_id GROUP BY way_id""",
    "way_bbox": f"WITH {fx('node', 'way_ref')} SELECT way_id, {_BBOX} FROM fx_way_ref JOIN fx_node n ON n.id = node_id GROUP BY way_id",
    "way_bbox_whole": f"WITH {fx('node', 'way_ref')}, {_WHOLE} SELECT way_id, min_lat, max_lat, min_lon, max_lon, ref_count FROM whole",
    "relation_bbox": f"""WITH {fx('node', 'way_ref', 'member')}, box AS (SELECT way_id, {_BBOX} FROM fx_way_ref JOIN fx_node n ON n.id = node_id GROUP BY way_id)
        SELECT rel_id, min(min_lat) AS min_lat, max(max_lat) AS max_lat, min(min_lon) AS min_lon, max(max_lon) AS max_lon, count(*) AS ways FROM fx_member JOIN box ON way_id = member_id
        WHERE member_type = 1 GROUP BY rel_id HAVING max(max_lat) > min(min_lat) AND max(max_lon) > min(min_lon)""",
    "relation_footprint": f"""WITH {fx('node', 'way_ref', 'member')}, {_LOST}, {_REL_FOOT} SELECT * FROM rf""",
    "way_centroid": f"""WITH {fx('node', 'way_ref')} SELECT way_id, (sum({e7('lat_nano')}) // count(*))::BIGINT AS lat_e7, (sum({e7('lon_nano')}) // count(*))::BIGINT AS lon_e7
        FROM fx_way_ref JOIN fx_node n ON n.id = node_id GROUP BY way_id""",
    "global_bounds": f"WITH {fx('node')} SELECT {_BBOX}, count(*) AS nodes FROM fx_node",
    "classify_ways": f"""WITH {fx('way', 'way_ref')}, {_REFS} SELECT w.id, ({_STYLE})::INT AS style, coalesce({_STYLE} IN (0, 2, 3, 4) AND {_CLOSED} AND NOT {_COAST}, false) AS area, coalesce({_WALK}, false) AS walkable
        FROM fx_way w JOIN refs ON way_id = w.id WHERE len(refs) >= 2""",
    "place_rank": f"WITH {fx('relation', 'member')}, {_PLACE} SELECT id, name, kind, level, ways, score::BIGINT AS score FROM place",
    "place_top1": f"""WITH {fx('relation', 'member', 'node', 'way_ref')}, {_PLACE},
        wide AS (SELECT rel_id FROM fx_member JOIN fx_way_ref ON way_id = member_id JOIN fx_node n ON n.id = node_id WHERE member_type = 1 GROUP BY rel_id HAVING max(lat_nano) > min(lat_nano) AND max(lon_nano) > min(lon_nano))
        SELECT name, arg_max(id, score * 1000000 - id) AS id, max(score)::BIGINT AS score FROM place WHERE id IN (SELECT rel_id FROM wide) GROUP BY name""",
    "needed_ways_semi": f"WITH {fx('way', 'member', 'relation')} SELECT id FROM fx_way WHERE id IN (SELECT member_id FROM fx_member JOIN fx_relation r ON r.id = rel_id WHERE member_type = 1 AND place = 'city')",
    "distinct_refs": f"WITH {fx('way_ref')} SELECT DISTINCT node_id FROM fx_way_ref",
    "tile_assign": f"WITH {fx('node', 'way', 'way_ref')}, {_FEATURE}, {_ASSIGN} SELECT id, tile_x, tile_y, tile_id FROM assigned",
    "tile_directory": f"WITH {fx('node', 'way', 'way_ref')}, {_FEATURE}, {_ASSIGN} SELECT tile_id, tile_x, tile_y, count(*) AS features, bit_or(1::BIGINT << style) AS layers FROM assigned GROUP BY ALL",
    "viewport_features": f"""WITH {fx('node', 'way', 'way_ref')}, {_FEATURE}, {_ASSIGN},
        seen AS (SELECT DISTINCT id, style, flags, min_lon, min_lat, max_lon, max_lat FROM assigned WHERE min_lon <= {BOX[2]} AND max_lon >= {BOX[0]} AND min_lat <= {BOX[3]} AND max_lat >= {BOX[1]}
          AND tile_x BETWEEN {tx(f'{BOX[0]}::BIGINT')} - 1 AND {tx(f'{BOX[2]}::BIGINT')} + 1 AND tile_y BETWEEN {ty(f'{BOX[3]}::BIGINT')} - 1 AND {ty(f'{BOX[1]}::BIGINT')} + 1),
        shape AS (SELECT way_id, count(*) AS n_points, md5(string_agg(lon_nano || ' ' || lat_nano, ',' ORDER BY pos)) AS shape FROM fx_way_ref JOIN fx_node n ON n.id = node_id GROUP BY way_id)
        SELECT DISTINCT style::INT AS style, flags::INT AS flags, min_lon, min_lat, max_lon, max_lat, n_points, shape FROM seen JOIN shape ON way_id = id""",
    "metric_tiles": f"WITH {_ROUTE_TILES} SELECT * FROM rt",
    "tile_info": f"""WITH {_ROUTE_TILES}, o(dx, dy, bit) AS (VALUES (-1, -1, 1), (0, -1, 2), (1, -1, 4), (-1, 0, 8), (1, 0, 16), (-1, 1, 32), (0, 1, 64), (1, 1, 128)),
        one AS (SELECT rt.*, (SELECT coalesce(sum(bit), 0)::INT FROM o JOIN rt u ON u.tile_x = dx AND u.tile_y = dy) AS mask FROM rt WHERE tile_x = 0 AND tile_y = 0),
        l AS (SELECT unnest([{', '.join(f"{{'field': '{k}', 'value': {v}}}" for k, v in TILE_LINES)}]) AS l FROM one)
        SELECT l.field AS field, l.value AS value FROM l UNION ALL SELECT 'tile_found', 'no' UNION ALL SELECT 'tile_found', 'no' WHERE NOT EXISTS (SELECT * FROM one)""",
    "tile_neighbor_mask": f"""WITH {fx('node')}, {_METRIC}, t AS (SELECT DISTINCT tile_id, tile_x, tile_y FROM tiled),
        o(dx, dy, bit) AS (VALUES (-1, -1, 1), (0, -1, 2), (1, -1, 4), (-1, 0, 8), (1, 0, 16), (-1, 1, 32), (0, 1, 64), (1, 1, 128))
        SELECT t.tile_id, coalesce(sum(bit) FILTER (WHERE u.tile_id IS NOT NULL), 0)::INT AS mask FROM t CROSS JOIN o LEFT JOIN t u ON u.tile_x = t.tile_x + dx AND u.tile_y = t.tile_y + dy GROUP BY t.tile_id""",
    "walk_segments": f"WITH {fx('node', 'way', 'way_ref')}, {_SEG} SELECT way_id, pos, a, b, meters FROM seg",
    "walk_edges": f"WITH {fx('node', 'way', 'way_ref')}, {_EDGE} SELECT from_id, to_id, meters FROM edge",
    "walk_degree_csr": f"""WITH {fx('node', 'way', 'way_ref')}, {_EDGE}, d AS (SELECT from_id, count(*) AS degree FROM edge GROUP BY 1)
        SELECT from_id, degree, coalesce(sum(degree) OVER (ORDER BY from_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM d""",
    "nearest_node": f"""WITH {fx('node')}, n AS (SELECT id, {direct_m('524000000', '130000000', e7('lat_nano'), e7('lon_nano'))} AS meters FROM fx_node) SELECT id, meters FROM n ORDER BY meters, id LIMIT 1""",
    "path_cumulative": f"""WITH {fx('node', 'way', 'way_ref')}, {_SEG} SELECT way_id, pos, meters, sum(meters) OVER (PARTITION BY way_id ORDER BY pos)::BIGINT AS walked FROM seg""",
    "shortest_path_dist": f"""WITH RECURSIVE {fx('node', 'way', 'way_ref')}, {_EDGE}, e AS MATERIALIZED (SELECT from_id, to_id, min(meters) AS m FROM edge GROUP BY ALL),
        s(id, dist) USING KEY (id) AS (SELECT (SELECT min(from_id) FROM e), 0::BIGINT UNION
          (SELECT to_id, min(s.dist + m) AS d FROM s JOIN e ON from_id = s.id LEFT JOIN recurring.s AS k ON k.id = to_id WHERE k.dist IS NULL OR s.dist + m < k.dist GROUP BY to_id))
        SELECT id, dist FROM s""",
    "path_nodes": f"""WITH RECURSIVE {fx('node', 'way', 'way_ref')}, {_METRIC}, {_SEG}, asked(query, source, target) AS (VALUES {', '.join(f'({q}, {a}::BIGINT, {b}::BIGINT)' for q, a, b in PATHS)}),
        win AS (SELECT query, source, target, least(s.tile_x, t.tile_x) - 1 AS x1, greatest(s.tile_x, t.tile_x) + 1 AS x2, least(s.tile_y, t.tile_y) - 1 AS y1, greatest(s.tile_y, t.tile_y) + 1 AS y2
          FROM asked JOIN tiled s ON s.id = source JOIN tiled t ON t.id = target),
        best AS (SELECT a, b, min(meters) AS m FROM seg GROUP BY ALL),
        inside AS (SELECT query, best.a, best.b, m FROM best JOIN tiled ta ON ta.id = best.a JOIN tiled tb ON tb.id = best.b
          JOIN win ON (ta.tile_x BETWEEN x1 AND x2 AND ta.tile_y BETWEEN y1 AND y2) OR (tb.tile_x BETWEEN x1 AND x2 AND tb.tile_y BETWEEN y1 AND y2)),
        e AS MATERIALIZED (SELECT query, a AS from_id, b AS to_id, m FROM inside UNION ALL SELECT query, b, a, m FROM inside),
        s(query, id, dist) USING KEY (query, id) AS (SELECT query, source, 0::BIGINT FROM win UNION
          (SELECT e.query, to_id, min(s.dist + m) AS d FROM s JOIN e ON e.query = s.query AND from_id = s.id LEFT JOIN recurring.s AS k ON k.query = e.query AND k.id = to_id
           WHERE k.dist IS NULL OR s.dist + m < k.dist GROUP BY e.query, to_id))
        SELECT win.query::BIGINT AS query, dist AS meters, source, target FROM win JOIN s ON s.query = win.query AND s.id = target""",
    "route_steps": f"""WITH RECURSIVE {fx('node', 'way', 'way_ref')}, {_SEG}, l AS MATERIALIZED (SELECT way_id, list(meters ORDER BY pos) AS m FROM seg GROUP BY way_id),
        run(way_id, i, total) AS (SELECT way_id, 1, m[1] FROM l UNION ALL SELECT way_id, i + 1, CASE WHEN total >= 450 THEN m[i + 1] ELSE total + m[i + 1] END FROM run JOIN l USING (way_id) WHERE i < len(m))
        SELECT way_id, (row_number() OVER (PARTITION BY way_id ORDER BY i) - 1)::INT AS step, total AS meters FROM run JOIN l USING (way_id) WHERE total >= 450 OR i = len(m)""",
    "service_active": f"WITH {fx('calendar', 'exception')}, {_SERVICE} SELECT service_id FROM active",
    "calendar_matrix": f"""WITH {fx('calendar', 'exception')}, d AS (SELECT CAST(range AS DATE) AS d, strftime(range, '%Y%m%d')::INT AS date FROM range(DATE '2026-05-30', DATE '2026-07-03', INTERVAL 1 DAY)),
        x AS (SELECT service_id, date, min(type) AS type FROM fx_exception GROUP BY ALL)
        SELECT date, service_id FROM fx_calendar CROSS JOIN d LEFT JOIN x USING (service_id, date)
        WHERE coalesce(type = 1, start_date <> 0 AND end_date <> 0 AND date BETWEEN start_date AND end_date AND (mask >> (isodow(d) - 1)) & 1 = 1)""",
    "gtfs_events_clean": f"WITH {fx(*_EVENT_FX)}, {_EVENT} SELECT trip_id, stop_id, sequence, arrival_sec, departure_sec, route_id, mode::INT AS mode FROM event",
    "stop_mode_mask": f"WITH {fx(*_EVENT_FX)}, {_EVENT} SELECT stop_id, bit_or(1::BIGINT << (mode - 1)) AS modes FROM event GROUP BY stop_id",
    "trip_event_ranges": f"""WITH {fx(*_EVENT_FX)}, {_EVENT} SELECT trip_id, count(*) AS events, min(sequence) AS first, max(sequence) AS last, arg_min(departure_sec, sequence) AS departs,
        arg_max(arrival_sec, sequence) AS arrives FROM event GROUP BY trip_id""",
    "transfer_pairs": f"WITH {fx('stop')}, {_TRANSFER} SELECT from_stop, to_stop, meters, seconds FROM transfer",
    "transit_round_1": f"WITH {fx(*_EVENT_FX)}, {_EVENT}, {_TRANSFER}, {_rounds(1)} SELECT stop_id, arrival, rides::INT AS rides FROM l1",
    "transit_earliest_6": f"WITH {fx(*_EVENT_FX)}, {_EVENT}, {_TRANSFER}, {_rounds(6)} SELECT stop_id, arrival, rides::INT AS rides FROM l6",
    "transit_best_destination": f"""WITH {fx(*_EVENT_FX)}, {_EVENT}, {_TRANSFER}, {_rounds(6)},
        near AS (SELECT stop_id, {direct_m('plat', 'plon', 'lat_e7', 'lon_e7')} AS meters FROM fx_stop, {_POINT} p),
        c AS (SELECT l6.stop_id, arrival + {walk_s('meters')} AS finish, arrival + 2 * {walk_s('meters')} AS score, meters FROM l6 JOIN near USING (stop_id) WHERE meters <= 1500 AND rides > 0)
        SELECT stop_id, finish, score, meters FROM c ORDER BY score, finish, stop_id LIMIT 1""",
    "transit_arrive_by": f"""WITH {fx(*_EVENT_FX)}, {_EVENT}, o AS (SELECT s.stop_id AS o_id, {walk_s(direct_m('p.lat_e7', 'p.lon_e7', 's.lat_e7', 's.lon_e7'))} AS ow FROM fx_stop s, fx_stop p
          WHERE p.stop_id = {START_STOP} AND {direct_m('p.lat_e7', 'p.lon_e7', 's.lat_e7', 's.lon_e7')} <= 800),
        t AS (SELECT s.stop_id AS t_id, {walk_s(direct_m('p.lat_e7', 'p.lon_e7', 's.lat_e7', 's.lon_e7'))} AS tw FROM fx_stop s, fx_stop p
          WHERE p.stop_id = {TARGET_STOP} AND {direct_m('p.lat_e7', 'p.lon_e7', 's.lat_e7', 's.lon_e7')} <= 1500),
        b AS (SELECT a.trip_id, a.sequence, a.stop_id AS alight_stop, a.arrival_sec, max(x.sequence) AS bs FROM event a JOIN t ON t_id = a.stop_id JOIN event x ON x.trip_id = a.trip_id AND x.sequence < a.sequence
          JOIN o ON o_id = x.stop_id WHERE x.departure_sec >= ow GROUP BY ALL),
        c AS (SELECT x.departure_sec - ow AS leave, b.trip_id, x.stop_id AS board_stop, alight_stop, b.arrival_sec AS arrival FROM b JOIN event x ON x.trip_id = b.trip_id AND x.sequence = bs JOIN o ON o_id = x.stop_id
          JOIN t ON t_id = alight_stop WHERE b.arrival_sec >= x.departure_sec AND b.arrival_sec + tw <= {DEADLINE})
        SELECT leave, trip_id, board_stop, alight_stop, arrival FROM c ORDER BY leave DESC, arrival, trip_id, alight_stop LIMIT 1""",
    "normalize_text": f"WITH {fx('address')} SELECT id, {_NORM('street')} AS street, {_NORM('city')} AS city FROM fx_address",
    "house_alias": f"""WITH {fx('address')}, {_ADDR} SELECT id, h AS alias FROM ahouse""",
    "address_resolve_exact": f"""WITH {fx('address')}, {_ASKED}, {_PARTS}, {_ADDR},
        spot AS (SELECT q.query_id, q.place, a.id, a.lat_e7, a.street, a.city, a.suburb, a.postcode, q.main, a.house, p.p FROM q JOIN addr a ON contains(q.main, a.house), unnest(range(1, length(q.main) + 1)) AS p(p)
          WHERE substr(q.main, p.p, length(a.house)) = a.house),
        hit AS (SELECT DISTINCT query_id, id, lat_e7 FROM spot WHERE (p = 1 OR NOT regexp_matches(substr(main, p - 1, 1), '^[a-z0-9]$'))
          AND (p + length(house) > length(main) OR NOT regexp_matches(substr(main, p + length(house), 1), '^[a-z0-9]$'))
          AND trim(substr(main, 1, p - 1), chr(9) || chr(10) || chr(13) || ' ,') = street AND (place = '' OR coalesce(place = city, false) OR coalesce(place = suburb, false) OR coalesce(place = postcode, false)))
        SELECT query_id, count(*) AS matches, arg_min(id, CASE WHEN lat_e7 IS NULL THEN 1000000000 ELSE 0 END + id) AS id FROM hit GROUP BY query_id""",
    "address_fuzzy_score": f"""WITH {fx('address')}, {_ASKED}, {_PARTS}, {_ADDR},
        m AS (SELECT query_id, id, CASE WHEN a.street = q.street THEN 120 WHEN least(strlen(a.street), strlen(q.street)) >= 8 AND substr(a.street, 1, 1) = substr(q.street, 1, 1) AND levenshtein(a.street, q.street) <= 2 THEN 110
            WHEN {_PFIT('q.street')} THEN 60 END + CASE WHEN q.place <> '' AND {_PFIT('q.place')} THEN 30 ELSE 0 END AS score
          FROM parts q JOIN ahouse a ON a.h = q.house WHERE q.street <> '')
        SELECT query_id, id, max(score)::BIGINT AS score FROM m WHERE score IS NOT NULL GROUP BY ALL""",
    "address_index_keys": f"""WITH {fx('address')}, {_ADDR}, p AS (SELECT *, unnest(list_distinct(list_filter(['', city, suburb, postcode], lambda x: x IS NOT NULL))) AS place FROM ahouse)
        SELECT street AS name, h AS house, place, count(DISTINCT id) AS addresses, arg_min(id, CASE WHEN lat_e7 IS NULL THEN 1000000000 ELSE 0 END + id) AS id FROM p GROUP BY ALL""",
    "time_parse": f"""WITH t(text) AS (VALUES ('8:05:00'), ('25:10:00'), ('71:59:59'), ('72:00:00'), ('08:60:00'), ('08:05'), ('')), x AS (SELECT text, regexp_extract_all(text, '[0-9]+') AS p, regexp_matches(text, '^[0-9]+:[0-5][0-9]:[0-5][0-9]$') AS ok FROM t)
        SELECT text, CASE WHEN ok AND p[1]::BIGINT <= 71 THEN p[1]::BIGINT * 3600 + p[2]::BIGINT * 60 + p[3]::BIGINT END AS seconds FROM x""",
    "coord_text": f"WITH {fx('stop')} SELECT stop_id, printf('%d.%07d', lat_e7 // 10000000, lat_e7 % 10000000) AS lat, printf('-%d.%07d', lon_e7 // 10000000, lon_e7 % 10000000) AS west FROM fx_stop",
    "e7_rounding": f"WITH {fx('node')} SELECT id, {e7('(lat_nano + id * 7)')} AS north, {e7('(-lat_nano - id * 7)')} AS south FROM fx_node",
    "compass": f"""WITH {fx('stop')}, p AS (SELECT a.stop_id AS a, b.stop_id AS b, b.lat_e7 - a.lat_e7 AS dy, b.lon_e7 - a.lon_e7 AS dx FROM fx_stop a JOIN fx_stop b ON b.stop_id = a.stop_id + 1)
        SELECT a, b, CASE WHEN abs(dx) * 2 < abs(dy) THEN CASE WHEN dy >= 0 THEN 'north' ELSE 'south' END WHEN abs(dy) * 2 < abs(dx) THEN CASE WHEN dx >= 0 THEN 'east' ELSE 'west' END
          ELSE CASE WHEN dy >= 0 THEN 'north' ELSE 'south' END || '-' || CASE WHEN dx >= 0 THEN 'east' ELSE 'west' END END AS direction FROM p""",
    "walk_seconds": f"WITH {fx('stop')} SELECT stop_id, {walk_s('stop_id * 13')} AS seconds, (stop_id * 13 * 3 + 249) // 250 AS minutes, {floor_div('(stop_id - 50) * 9999', 50000)} AS cell FROM fx_stop",
    "service_weekday": "SELECT DISTINCT strftime(o_orderdate, '%Y%m%d')::INT AS date, (isodow(o_orderdate) - 1)::INT AS weekday FROM orders",
    "boundary_components": f"WITH RECURSIVE {_COMPONENTS} SELECT * FROM comp",
    "far_components": f"""WITH RECURSIVE {_COMPONENTS}, p AS (SELECT * FROM comp ORDER BY points DESC, root LIMIT 1),
        g AS (SELECT c.root, c.points AS cp, p.points AS pp, greatest(0, c.min_lon - p.max_lon, p.min_lon - c.max_lon) AS glon, greatest(0, c.min_lat - p.max_lat, p.min_lat - c.max_lat) AS glat,
            p.max_lon - p.min_lon AS slon, p.max_lat - p.min_lat AS slat,
            CASE WHEN p.max_lon <= p.min_lon OR p.max_lat <= p.min_lat THEN 1 ELSE ((p.max_lon - p.min_lon) // 1000 + 1) * ((p.max_lat - p.min_lat) // 1000 + 1) END AS own,
            ((greatest(c.max_lon, p.max_lon) - least(c.min_lon, p.min_lon)) // 1000 + 1) * ((greatest(c.max_lat, p.max_lat) - least(c.min_lat, p.min_lat)) // 1000 + 1) AS grown FROM comp c, p)
        SELECT root, (glon > 0 OR glat > 0) AND cp * 2 < pp AND grown > own * 2 AND (glon > 100000000 OR glat > 100000000 OR (slon > 0 AND glon > slon // 3) OR (slat > 0 AND glat > slat // 3)) AS far FROM g""",
    "pbf_nodes": f"WITH {fx('node')} SELECT id, lat_nano, lon_nano, name, 2 AS tags FROM fx_node",
    "pbf_nodes_bare": f"WITH {fx('node')} SELECT id, lat_nano, lon_nano FROM fx_node",
    "pbf_ways": f"WITH {fx('way', 'way_ref')}, r AS (SELECT way_id, string_agg(node_id, ',' ORDER BY pos) AS refs FROM fx_way_ref GROUP BY 1) SELECT id, refs, highway, street FROM fx_way JOIN r ON way_id = id",
    "pbf_way_by_id": f"WITH {fx('way', 'way_ref')} SELECT id, (SELECT count(*) FROM fx_way_ref WHERE way_id = 77)::INT AS refs, highway FROM fx_way WHERE id = 77",
    "pbf_relations": f"WITH {fx('relation', 'member')}, m AS (SELECT rel_id, string_agg(member_id || ':1:outer', ',' ORDER BY member_id) AS members FROM fx_member GROUP BY 1) SELECT id, coalesce(members, '') AS members, name FROM fx_relation LEFT JOIN m ON rel_id = id",
    "pbf_header": "SELECT 'OsmSchema-V0.6,DenseNodes' AS required, 'terravane' AS writing_program",
    "pbf_summary": f"WITH {fx('node', 'way', 'way_ref', 'relation')} SELECT 0::BIGINT AS nodes, (SELECT count(*) FROM fx_node) AS dense_nodes, (SELECT count(DISTINCT way_id) FROM fx_way_ref) AS ways, (SELECT count(*) FROM fx_relation) AS relations",
    "gtfs_load_events": f"""WITH {fx(*_EVENT_FX)} SELECT trip_id::VARCHAR AS trip_id, stop_id::VARCHAR AS stop_id, sequence, arrival_sec, departure_sec, route_id::VARCHAR AS route_id, service_id, ({_MODE})::INT AS mode
        FROM fx_stop_time JOIN fx_trip USING (trip_id) JOIN fx_route USING (route_id) JOIN fx_calendar USING (service_id) WHERE stop_id IN (SELECT stop_id FROM fx_stop) AND departure_sec < 259200""",
    "gtfs_load_stops": f"WITH {fx('stop')} SELECT stop_id::VARCHAR AS stop_id, stop_name, lat_e7, lon_e7 FROM fx_stop",
    "gtfs_load_routes": f"WITH {fx('route')} SELECT route_id::VARCHAR AS route_id, 'R, \"' || route_id || '\"' AS route_short_name, route_id::VARCHAR AS route_long_name, route_type FROM fx_route",
    "gtfs_load_calendar": f"WITH {fx('calendar', 'exception')}, {_SERVICE} SELECT service_id FROM active",
    "calendar_span": f"""WITH {fx('calendar', 'exception')}, x AS (SELECT start_date AS a, end_date AS b FROM fx_calendar UNION ALL SELECT date, date FROM fx_exception)
        SELECT min(a) FILTER (WHERE a <> 0) AS first, max(b) FILTER (WHERE b <> 0) AS last FROM x""",
    "exception_ranges": f"""WITH {fx('exception')}, n AS (SELECT service_id, count(*) AS count FROM fx_exception GROUP BY 1)
        SELECT service_id, count, coalesce(sum(count) OVER (ORDER BY service_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM n""",
    "transit_verify": f"WITH {fx(*_EVENT_FX)}, {_EVENT}, {_TRANSFER}, {_rounds(6)} SELECT count(*) AS stops, 0::BIGINT AS wrong FROM l6",
    "address_first_matches": f"""WITH {fx('address')}, {_ASKED}, {_PARTS}, {_ADDR}, hit AS (SELECT DISTINCT query_id, id FROM parts q JOIN ahouse a ON a.h = q.house
          WHERE q.street <> '' AND (a.street = q.street OR (least(strlen(a.street), strlen(q.street)) >= 8 AND substr(a.street, 1, 1) = substr(q.street, 1, 1) AND levenshtein(a.street, q.street) <= 2) OR {_PFIT('q.street')})),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS k FROM hit)
        SELECT query_id, count(*) AS matches, string_agg(id, ',' ORDER BY id) FILTER (WHERE k <= 20) AS ids FROM n GROUP BY 1""",
    "endpoint_cascade": f"""WITH {fx('address')}, {_ENDS}, {_PARTS}, {_ADDR},
        p AS (SELECT *, unnest(list_distinct(list_filter(['', city, suburb, postcode], lambda x: x IS NOT NULL))) AS place FROM ahouse),
        idx AS (SELECT street AS name, h AS house, place, arg_min(id, CASE WHEN lat_e7 IS NULL THEN 1000000000 ELSE 0 END + id) AS id FROM p GROUP BY ALL),
        tries AS (SELECT query_id, street, house, place, 1 AS way FROM parts UNION ALL SELECT query_id, street, house, '', 2 FROM parts),
        by_index AS (SELECT query_id, way, idx.id FROM tries t JOIN idx ON idx.name = t.street AND idx.house = t.house AND idx.place = t.place),
        asked2 AS (SELECT query_id, street, house, place, 3 AS way FROM parts UNION ALL SELECT query_id, street, house, '', 4 FROM parts),
        m AS (SELECT query_id, way, id, max(CASE WHEN a.street = q.street THEN 120 WHEN least(strlen(a.street), strlen(q.street)) >= 8 AND substr(a.street, 1, 1) = substr(q.street, 1, 1) AND levenshtein(a.street, q.street) <= 2 THEN 110
            WHEN {_PFIT('q.street')} THEN 60 END + CASE WHEN q.place <> '' AND {_PFIT('q.place')} THEN 30 ELSE 0 END) AS score
          FROM asked2 q JOIN ahouse a ON a.h = q.house WHERE q.street <> '' AND a.lat_e7 IS NOT NULL GROUP BY ALL),
        top AS (SELECT query_id, way, id FROM m WHERE score IS NOT NULL QUALIFY score = max(score) OVER (PARTITION BY query_id, way)),
        lit AS (SELECT query_id, 0 AS way, CAST(round(CAST(trim(split_part(query, ',', 1)) AS DOUBLE) * 10000000) AS BIGINT) AS lat, CAST(round(CAST(trim(split_part(query, ',', 2)) AS DOUBLE) * 10000000) AS BIGINT) AS lon
          FROM (SELECT * FROM asked WHERE regexp_matches(query, '^[-0-9.]+, ?[-0-9.]+$'))),
        every AS (SELECT * FROM lit WHERE abs(lat) <= 900000000 AND abs(lon) <= 1800000000
          UNION SELECT f.query_id, f.way, a.lat_e7, a.lon_e7 FROM (SELECT * FROM by_index UNION ALL SELECT * FROM top) f JOIN fx_address a USING (id) WHERE a.lat_e7 IS NOT NULL),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id, way ORDER BY lat, lon) AS k FROM every WHERE (query_id, way) IN (SELECT query_id, min(way) FROM every GROUP BY 1))
        SELECT query_id, way, string_agg(lat || ':' || lon, ' ' ORDER BY k) FILTER (WHERE k <= 64) AS spots FROM k GROUP BY ALL""",
    "node_index": f"""WITH {fx('node', 'way_ref')}, w AS (SELECT node_id, string_agg(way_id, ',' ORDER BY way_id) AS ways FROM (SELECT DISTINCT node_id, way_id FROM fx_way_ref) GROUP BY 1)
        SELECT id, lat_nano, lon_nano, coalesce(ways, '') AS ways FROM fx_node LEFT JOIN w ON node_id = id""",
    "relation_bbox_lookup": f"""WITH {fx('node', 'way_ref', 'member', 'relation')}, box AS (SELECT way_id, {_BBOX} FROM fx_way_ref JOIN fx_node n ON n.id = node_id GROUP BY way_id)
        SELECT id, name FROM fx_relation WHERE id IN (SELECT rel_id FROM fx_member JOIN box ON way_id = member_id WHERE member_type = 1
          AND min_lon <= {SMALL_BOX[2]} AND max_lon >= {SMALL_BOX[0]} AND min_lat <= {SMALL_BOX[3]} AND max_lat >= {SMALL_BOX[1]})""",
    "building_tsv": f"""WITH {fx('way', 'node', 'way_ref', 'relation', 'member')}, {_BUILDING},
        wf AS (SELECT way_id, {_BBOX}, {_FOOT} FROM fx_way_ref LEFT JOIN fx_node n ON n.id = node_id GROUP BY way_id),
        {_LOST}, {_REL_FOOT},
        nf AS (SELECT id, brand, lat_nano AS min_lat, lat_nano AS max_lat, lat_nano AS center_lat, lon_nano AS min_lon, lon_nano AS max_lon, lon_nano AS center_lon, 1 AS ref_count, 0 AS missing_ref_count FROM fx_node WHERE starts_with(amenity, 'PROMO'))
        SELECT '{_NAMES} {' '.join(n for n, _ in BUILDING_COLUMNS)}'.replace(' ', chr(9)) AS value
        UNION ALL SELECT {_line('node', "'1' || chr(9) || '1' || chr(9) || '1'", building_part="'yes'", addr_housenumber='brand')} FROM nf f
        UNION ALL SELECT {_line('way', "'1' || chr(9) || b::INT || chr(9) || r::INT", **{n: f"coalesce({c}, '')" for n, c in BUILDING_COLUMNS if c})} FROM v JOIN wf f ON way_id = id
        UNION ALL SELECT {_line('relation', "'0' || chr(9) || '1' || chr(9) || '0'", building='place')} FROM fx_relation JOIN rf f ON rel_id = id WHERE place IS NOT NULL""",
    "building_statistics": f"""WITH {fx('way', 'node', 'way_ref', 'relation', 'member')},
        w AS (SELECT way_id, count(*) > count(n.id) AS p FROM fx_way_ref LEFT JOIN fx_node n ON n.id = node_id GROUP BY way_id),
        {_LOST}, {_REL_FOOT}, x AS (SELECT rel_id, missing_ref_count > 0 AS p FROM rf)
        SELECT 'node' AS entity_type, count(*) AS rows, 0::BIGINT AS partial FROM fx_node WHERE starts_with(amenity, 'PROMO') HAVING count(*) > 0
        UNION ALL SELECT 'way', count(*), count(*) FILTER (WHERE p) FROM fx_way JOIN w ON way_id = id
        UNION ALL SELECT 'relation', count(*), count(*) FILTER (WHERE p) FROM fx_relation JOIN x ON rel_id = id WHERE place IS NOT NULL""",
    "overlay_stop_counts": f"""WITH {fx(*_EVENT_FX)}, {_EVENT} SELECT CASE mode WHEN 1 THEN 'tram' WHEN 2 THEN 'subway' WHEN 3 THEN 'train' WHEN 4 THEN 'bus' ELSE 'other' END AS mode, count(DISTINCT stop_id) AS stops FROM event GROUP BY 1""",
    "clock_text": f"""WITH {fx('stop')}, s AS (SELECT stop_id, stop_id * 2999 AS t FROM fx_stop)
        SELECT stop_id, printf('%02d:%02d', t % 86400 // 3600, t % 3600 // 60) || CASE WHEN t >= 86400 THEN ' (+' || t // 86400 || 'd)' ELSE '' END AS clock FROM s""",
    "padded_boxes": f"""WITH {fx('node', 'way_ref')}, b AS (SELECT way_id, {_BBOX} FROM fx_way_ref JOIN fx_node n ON n.id = node_id GROUP BY way_id), p AS (SELECT *, greatest((max_lat - min_lat) // 10, 5000000) AS pad FROM b)
        SELECT way_id, min_lat - pad AS low, max_lat + pad AS high FROM p""",
    "city_scores": f"""WITH {fx('relation', 'member')}, w AS (SELECT rel_id, count(*) AS ways FROM fx_member WHERE member_type = 1 GROUP BY 1)
        SELECT id, (CASE admin_level WHEN '6' THEN 100 WHEN '8' THEN 90 WHEN '4' THEN 80 WHEN '5' THEN 60 WHEN '7' THEN 60 WHEN '9' THEN 20 WHEN '10' THEN 20 END * 1000 + least(ways, 999))::BIGINT AS score
        FROM fx_relation JOIN w ON rel_id = id WHERE admin_level IN ('4', '5', '6', '7', '8', '9', '10')""",
    "lookup_by_name": f"WITH {fx('relation')} SELECT id FROM fx_relation WHERE name = 'BUILDING'",
    "route_addresses": f"""WITH {fx('way', 'node', 'way_ref')}, c AS (SELECT way_id, (sum({e7('lat_nano')}) // count(*))::BIGINT AS lat_e7, (sum({e7('lon_nano')}) // count(*))::BIGINT AS lon_e7 FROM fx_way_ref JOIN fx_node n ON n.id = node_id GROUP BY way_id),
        m AS (SELECT *, (lon_e7 - {ORIGIN[1]})::BIGINT * {per_lon(f'{ORIGIN[0]}::BIGINT')} // 10000000 AS mx, (lat_e7 - {ORIGIN[0]})::BIGINT * 111320 // 10000000 AS my FROM c)
        SELECT id, street, housenumber, postcode, lat_e7, lon_e7, (({floor_div('mx', 4000)} + 268435456) << 29) | ({floor_div('my', 4000)} + 268435456) AS tile_id FROM fx_way LEFT JOIN m ON way_id = id
        WHERE street IS NOT NULL AND housenumber IS NOT NULL AND postcode IS NOT NULL""",
    "walk_tile_segments": f"""WITH {fx('node', 'way', 'way_ref')}, {_METRIC}, {_SEG}, t AS (SELECT unnest(list_distinct([ta.tile_id, tb.tile_id])) AS tile_id FROM seg JOIN tiled ta ON ta.id = a JOIN tiled tb ON tb.id = b)
        SELECT tile_id, count(*) AS segments FROM t GROUP BY 1""",
    "merged_graph": f"""WITH {fx('node', 'way', 'way_ref')}, {_EDGE}, place AS (SELECT lat, lon, min(id) AS place FROM node7 GROUP BY ALL), named AS (SELECT id, place FROM node7 JOIN place USING (lat, lon))
        SELECT a.place AS a, b.place AS b, min(meters) AS meters FROM edge JOIN named a ON a.id = from_id JOIN named b ON b.id = to_id WHERE a.place <> b.place GROUP BY ALL""",
    "image_heights": f"""WITH {fx('node', 'way_ref')}, b AS (SELECT way_id, {_BBOX} FROM fx_way_ref JOIN fx_node n ON n.id = node_id GROUP BY way_id),
        x AS (SELECT *, greatest(((max_lon - min_lon) * 3 + 2) // 5, 1) AS across FROM b)
        SELECT way_id, CASE WHEN max_lon > min_lon AND max_lat > min_lat THEN greatest(1, least(10000, ((max_lat - min_lat) * 800 + across // 2) // across))::INT END AS height FROM x""",
    "text_hashes": f"""WITH {fx('address')}, h AS (SELECT id, hex(encode(street)) AS h FROM fx_address)
        SELECT id, list_reduce([CASE WHEN i = 0 THEN 2166136261 ELSE ('0x' || substr(h, 2 * i - 1, 2))::BIGINT END for i in range(length(h) // 2 + 1)], lambda a, b: xor(a, b) * 16777619 % 4294967296) AS hash FROM h""",
    "transit_plan_legs": f"""WITH RECURSIVE {fx(*_EVENT_FX)}, {_EVENT}, {_TRANSFER}, {_WHOLE_ROUNDS},
        near AS (SELECT stop_id, {direct_m('plat', 'plon', 'lat_e7', 'lon_e7')} AS meters FROM fx_stop, {_POINT} p),
        best AS (SELECT f6.stop_id FROM f6 JOIN near USING (stop_id) WHERE meters <= 1500 AND l.rides > 0 ORDER BY l.arrival + 2 * {walk_s('meters')}, l.arrival + {walk_s('meters')}, f6.stop_id LIMIT 1),
        back(k, l, alight) AS (SELECT 0, l, stop_id FROM f6 JOIN best USING (stop_id) WHERE l.kind <> 1 UNION ALL
          SELECT k + 1, f6.l, f6.stop_id FROM back JOIN f6 ON f6.stop_id = back.l.previous WHERE k < 15 AND f6.l.kind <> 1),
        n AS (SELECT k, l, alight, CASE WHEN lag(l.kind) OVER w = l.kind AND (l.kind = 3 OR lag(l.trip) OVER w = l.trip) THEN 0 ELSE 1 END AS fresh FROM back WINDOW w AS (ORDER BY k DESC)),
        g AS (SELECT *, sum(fresh) OVER (ORDER BY k DESC) AS g FROM n)
        SELECT (g - 1)::INT AS leg, CASE WHEN arg_max(l.kind, k) = 2 THEN 'ride' ELSE 'walk' END AS kind, arg_max(l.trip, k) AS trip, arg_max(l.previous, k) AS board, arg_min(alight, k) AS alight,
          arg_max(l.departed, k) AS departure, arg_min(l.arrival, k) AS arrival FROM g GROUP BY g""",
    "address_index_lookup": f"""WITH {fx('address')}, {_ASKED}, {_PARTS}, {_ADDR},
        p AS (SELECT *, unnest(list_distinct(list_filter(['', city, suburb, postcode], lambda x: x IS NOT NULL))) AS place FROM ahouse),
        idx AS (SELECT street AS name, h AS house, place, count(DISTINCT id) AS addresses, arg_min(id, CASE WHEN lat_e7 IS NULL THEN 1000000000 ELSE 0 END + id) AS id FROM p GROUP BY ALL),
        tries AS (SELECT query_id, street, house, place, 0 AS pass FROM parts UNION ALL SELECT query_id, street, house, '', 1 FROM parts),
        hit AS (SELECT query_id, min({{'pass': pass, 'id': idx.id, 'addresses': addresses}}) AS b FROM tries t JOIN idx ON idx.name = t.street AND idx.house = t.house AND idx.place = t.place GROUP BY 1)
        SELECT query_id, b.id AS id, b.addresses AS addresses FROM hit""",
}
