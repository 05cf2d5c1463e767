"""Render tiles: features spread over the tiles their boxes touch, a tile directory, places and viewport queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tags as T
from .lookup import Box, boxes_meet


def assign(features: DataFrame, zoom: int = 10) -> DataFrame:
    """One row for each feature and tile that its box touches; explode stays inside the row, nothing is joined."""
    c = F.col
    xs = F.sequence(S.tile_x(c("min_lon"), zoom), S.tile_x(c("max_lon"), zoom))
    ys = F.sequence(S.tile_y(c("max_lat"), zoom), S.tile_y(c("min_lat"), zoom))
    spread = features.withColumn("tile_y", F.explode(ys)).withColumn("tile_x", F.explode(xs))
    return spread.withColumn("tile_id", S.tile_id(c("tile_x"), c("tile_y"), zoom))


def directory(assigned: DataFrame) -> DataFrame:
    """Feature count and the mask of styles of each tile."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("style").cast("int"))
    return assigned.groupBy("tile_id", "tile_x", "tile_y").agg(F.count("*").alias("features"), F.bit_or(bit).alias("layers"))


def viewport_tiles(box: Box, zoom: int = 10, halo: int = 0) -> Column:
    """A predicate on tile_x and tile_y for the tiles of a box; literals, so partitions can be pruned."""
    axis = (1 << zoom) - 1
    x = lambda lon: min(axis, max(0, (lon + 180_000_000_000) * (axis + 1) // 360_000_000_000))
    y = lambda lat: min(axis, max(0, (90_000_000_000 - lat) * (axis + 1) // 180_000_000_000))
    wide = lambda a, b: (max(0, a - halo), min(axis, b + halo))
    return F.col("tile_x").between(*wide(x(box[0]), x(box[2]))) & F.col("tile_y").between(*wide(y(box[3]), y(box[1])))


def viewport(features: DataFrame, box: Box, zoom: int = 10, halo: int = 0) -> DataFrame:
    """Features that meet a box and lie in one of its tiles (halo tiles around it count), with their tiles; the box prunes features
    before they are spread."""
    return assign(features.where(boxes_meet(box)), zoom).where(viewport_tiles(box, zoom, halo))


def collapse(seen: DataFrame, points: DataFrame) -> DataFrame:
    """Features once each by content: style, flags, box and all points in order, whether one in several tiles or two alike.

    points: id, n_points and shape, a digest of the points in order.
    """
    once = seen.select("id", "style", "flags", "min_lon", "min_lat", "max_lon", "max_lat").distinct()
    return once.join(points, "id").drop("id").distinct()


def shapes(refs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """id, n_points and shape (MD5 of "lon lat" texts in order) of the ways whose ids are given."""
    wanted = refs.join(ids.select(F.col("id").alias("way_id")).distinct(), "way_id", "left_semi")
    at = wanted.join(nodes.select(F.col("id").alias("node_id"), "lat_nano", "lon_nano"), "node_id")
    listed = at.groupBy(F.col("way_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("pos", "lon_nano", "lat_nano"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat_ws(" ", x["lon_nano"], x["lat_nano"])), ",")
    return listed.select("id", F.size("p").cast("long").alias("n_points"), F.md5(text.cast("binary")).alias("shape"))


def write_tiles(assigned: DataFrame, path: str) -> None:
    """A directory of Parquet files by tile, which viewport predicates prune."""
    assigned.repartition("tile_x", "tile_y").write.partitionBy("tile_x", "tile_y").mode("overwrite").parquet(path)


def places(relations: DataFrame, members: DataFrame) -> DataFrame:
    """The place directory: id, name, kind, level, ways and rank of relations that are places and have a way."""
    v = T.getter("tags")
    level = T.admin_level(v("admin_level"))
    rows = relations.where(T.is_place(v)).select("id", v("name").alias("name"), T.place_kind(v("place"), level).alias("kind"), level.alias("level"))
    ways = members.where("member_type = 1").groupBy(F.col("rel_id").alias("id")).agg(F.count("*").alias("ways"))
    return rows.join(ways, "id").withColumn("score", T.place_score(F.col("kind"), F.col("level"), F.col("ways")))


def best_place(found: DataFrame, boxes: DataFrame) -> DataFrame:
    """The highest rank of each name among places whose box has an extent both ways; the least id among equals. boxes: rel_id and a box."""
    wide = boxes.where("max_lat > min_lat and max_lon > min_lon").select(F.col("rel_id").alias("id"))
    return found.join(wide, "id", "left_semi").groupBy("name").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"), F.max("score").alias("score"))


# -- the metric grid of the router


def metric(nodes: DataFrame, origin_lat: int, origin_lon: int, size_m: int = 4000) -> DataFrame:
    """nodes (lat_e7, lon_e7) with metric coordinates and tile about an origin."""
    per_lon = S.meters_per_degree_lon(F.lit(origin_lat).cast("bigint"))
    mx = S.div((F.col("lon_e7").cast("bigint") - origin_lon) * per_lon, S.E7)
    my = S.div((F.col("lat_e7").cast("bigint") - origin_lat) * S.METERS_PER_DEGREE, S.E7)
    placed = nodes.withColumns({"mx": mx, "my": my})
    cells = placed.withColumns({"tile_x": S.floor_div(F.col("mx"), size_m), "tile_y": S.floor_div(F.col("my"), size_m)})
    return cells.withColumn("tile_id", S.route_tile_id(F.col("tile_x"), F.col("tile_y")))


def metric_tiles(placed: DataFrame, **others: DataFrame) -> DataFrame:
    """Each tile's source nodes and bounds, and how many rows of others (tile_id) lie in it; tiles are where nodes are."""
    tiles = _node_tiles(placed)
    for name, rows in others.items():
        counted = rows.groupBy("tile_id").agg(F.count("*").alias(name))
        tiles = tiles.join(counted, "tile_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return tiles


def _node_tiles(placed: DataFrame) -> DataFrame:
    agg = [F.count("*").alias("source_nodes"), *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat_e7", "lon_e7")]]
    return placed.groupBy("tile_id", "tile_x", "tile_y").agg(*agg)


OFFSETS = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]


def neighbor_masks(tiles: DataFrame) -> DataFrame:
    """Which of the eight neighbours of each tile exist, as bits row by row from the south-west."""
    t = tiles.select("tile_id", "tile_x", "tile_y")
    looks = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(1 << k).alias("bit")) for k, (dx, dy) in enumerate(OFFSETS)])
    asked = t.withColumn("o", F.explode(looks)).select("tile_id", (F.col("tile_x") + F.col("o.dx")).alias("nx"), (F.col("tile_y") + F.col("o.dy")).alias("ny"), F.col("o.bit").alias("bit"))
    there = t.select(F.col("tile_x").alias("nx"), F.col("tile_y").alias("ny"))
    found = asked.join(there, ["nx", "ny"]).groupBy("tile_id").agg(F.bit_or("bit").alias("mask"))
    return t.join(found, "tile_id", "left").select("tile_id", F.coalesce("mask", F.lit(0)).alias("mask"))


def tile_info(tiles: DataFrame, tile_id: int) -> DataFrame:
    """field and value lines about the tile of an id: its place, bounds, counters and neighbours; one line if there is none."""
    masks = neighbor_masks(tiles)
    coord = lambda c: S.coord_text(F.col(c), 7)
    lines = {
        "tile_found": F.lit("yes"), "tile_x": F.col("tile_x"), "tile_y": F.col("tile_y"), "tile_min_lat": coord("min_lat_e7"), "tile_min_lon": coord("min_lon_e7"), "tile_max_lat": coord("max_lat_e7"),
        "tile_max_lon": coord("max_lon_e7"), "tile_source_nodes": F.col("source_nodes"), "tile_addresses": F.col("addresses"), "tile_stops": F.col("stops"), "tile_neighbor_mask": F.col("mask"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in lines.items()])
    found = tiles.where(F.col("tile_id") == tile_id).join(masks.where(F.col("tile_id") == tile_id), "tile_id").select(F.inline(pairs))
    none = found.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("tile_found").alias("field"), F.lit("no").alias("value"))
    return found.union(none)
