"""Entity lookup: by type, id, tags, name and bounding box; limits need an order to be the same each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tags as T

Box = tuple[int, int, int, int]


def in_box(lat: Column, lon: Column, box: Box) -> Column:
    """Closed on all sides; box is min lon, min lat, max lon, max lat."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def boxes_meet(box: Box, min_lon: str = "min_lon", min_lat: str = "min_lat", max_lon: str = "max_lon", max_lat: str = "max_lat") -> Column:
    """Closed intersection; an entity without geometry doesn't meet anything."""
    c = F.col
    return F.coalesce((c(min_lon) <= box[2]) & (c(max_lon) >= box[0]) & (c(min_lat) <= box[3]) & (c(max_lat) >= box[1]), F.lit(False))


def select(df: DataFrame, ids: list[int] | None = None, tags: list[tuple[str, str | None]] = (), name: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows that have all the tags (any occurrence counts) and one of the ids; limit None is unlimited."""
    if len(tags) > 16:
        raise ValueError("at most 16 tag filters")
    for key, value in [*tags, *([("name", name)] if name is not None else [])]:
        df = df.where(T.has(F.col("tags"), key, value))
    if ids is not None:
        df = df.where(F.col("id").isin(ids))
    return df if limit is None else df.orderBy("id").limit(limit)


def nodes_in_box(nodes: DataFrame, box: Box) -> DataFrame:
    return nodes.where(in_box(F.col("lat_nano"), F.col("lon_nano"), box))


def ways_with_node_in_box(ways: DataFrame, refs: DataFrame, nodes: DataFrame, box: Box) -> DataFrame:
    """Ways with any node inside the box; segments that only cross it don't count.

    Both sides of the inner join are pruned first: the box reaches the node scan, and ways see only ids.
    """
    inside = nodes_in_box(nodes, box).select(F.col("id").alias("node_id"))
    hit = refs.join(inside, "node_id", "left_semi").select(F.col("way_id").alias("id")).distinct()
    return ways.join(hit, "id", "left_semi")


def summary(nodes: DataFrame, ways: DataFrame, refs: DataFrame, relations: DataFrame, members: DataFrame) -> DataFrame:
    """Counts of a whole extract, one row."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [one(nodes, "nodes"), one(ways, "ways"), one(refs, "way_refs"), one(relations, "relations"), one(members, "members")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # five tables of one row each
    return out


def text_row(kind: str, tags: Column, n_refs: Column | None = None) -> Column:
    """The one-line text of an entity: type, id, a node's coordinates with nine digits or a way's number of references, and its tags."""
    pairs = F.array_join(F.transform(tags, lambda x: F.concat(x["k"], F.lit("="), x["v"])), " ")
    head = [F.lit(kind), F.col("id")]
    if kind == "node":
        head += [F.concat(F.lit("lat="), S.coord_text(F.col("lat_nano"))), F.concat(F.lit("lon="), S.coord_text(F.col("lon_nano")))]
    if n_refs is not None:
        head.append(F.concat(F.lit("refs="), n_refs))
    return F.rtrim(F.concat_ws(" ", *head, pairs))
