"""Way and relation geometry: references joined with nodes, then aggregated; map-side partial aggregation keeps shuffles small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

BOX = ("min_lat", "max_lat", "min_lon", "max_lon")


def resolved(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References with their node's coordinates; null where the node is missing."""
    n = nodes.select(F.col("id").alias("node_id"), "lat_nano", "lon_nano")
    return refs.join(n, "node_id", "left")


def _box() -> list:
    return [F.min("lat_nano").alias("min_lat"), F.max("lat_nano").alias("max_lat"), F.min("lon_nano").alias("min_lon"), F.max("lon_nano").alias("max_lon")]


def way_bbox(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The box of each way's known nodes; ways without one are left out."""
    return refs.join(nodes.select(F.col("id").alias("node_id"), "lat_nano", "lon_nano"), "node_id").groupBy("way_id").agg(*_box())


def whole_bbox(refs: DataFrame, nodes: DataFrame, least_refs: int = 2) -> DataFrame:
    """The box of ways all of whose references are known and that have enough of them."""
    g = resolved(refs, nodes).groupBy("way_id").agg(*_box(), F.count("*").alias("ref_count"), F.count("lat_nano").alias("known"))
    return g.where((F.col("known") == F.col("ref_count")) & (F.col("ref_count") >= least_refs)).drop("known")


def footprint(refs: DataFrame, nodes: DataFrame, key: str = "way_id") -> DataFrame:
    """Reference and missing counts, box and its centre, cut to whole units; repeated references count each time."""
    g = resolved(refs, nodes).groupBy(key).agg(*_box(), F.count("*").alias("ref_count"), F.count_if(F.col("lat_nano").isNull()).alias("missing_ref_count"))
    mid = lambda a, b: (F.col(a) + S.div(F.col(b) - F.col(a), 2))
    return g.withColumns({"center_lat": mid("min_lat", "max_lat"), "center_lon": mid("min_lon", "max_lon")})


def member_refs(members: DataFrame, refs: DataFrame) -> DataFrame:
    """The references of each relation's way members."""
    ways = members.where("member_type = 1").select("rel_id", F.col("member_id").alias("way_id"))
    return ways.join(refs, "way_id").select("rel_id", "pos", "node_id")


def relation_footprint(members: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """footprint() of each relation's way members; a member way without references counts as one that is missing."""
    known = refs.select("way_id").distinct()
    lost = members.where("member_type = 1").join(known, F.col("member_id") == F.col("way_id"), "left_anti").groupBy("rel_id").agg(F.count("*").alias("lost"))
    found = footprint(member_refs(members, refs), nodes, "rel_id").join(lost, "rel_id", "left")
    return found.withColumn("missing_ref_count", F.col("missing_ref_count") + F.coalesce("lost", F.lit(0))).drop("lost")


def missing_refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """footprint()'s missing_ref_count of each way, without boxes: only ids move, and of those that are missing a row each."""
    lost = refs.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti")
    one = lambda df, n: df.select("way_id", F.lit(n).cast("bigint").alias("n"))
    return one(refs, 0).union(one(lost, 1)).groupBy("way_id").agg(F.sum("n").alias("missing_ref_count"))


def relation_missing_refs(members: DataFrame, way_missing: DataFrame) -> DataFrame:
    """relation_footprint()'s missing_ref_count of each relation, from missing_refs() of ways."""
    ways = members.where("member_type = 1").join(way_missing, F.col("member_id") == F.col("way_id"), "left")
    g = ways.groupBy("rel_id").agg(F.sum(F.coalesce("missing_ref_count", F.lit(1))).alias("missing_ref_count"), F.count("way_id").alias("known"))
    return g.where("known > 0").drop("known")


def relation_bbox(members: DataFrame, ways_box: DataFrame) -> DataFrame:
    """The box of a relation's way members; only where it has an extent in both directions."""
    m = members.where("member_type = 1").select("rel_id", F.col("member_id").alias("way_id"))
    agg = [F.min("min_lat").alias("min_lat"), F.max("max_lat").alias("max_lat"), F.min("min_lon").alias("min_lon"), F.max("max_lon").alias("max_lon")]
    return m.join(ways_box, "way_id").groupBy("rel_id").agg(*agg, F.count("*").alias("ways")).where("max_lat > min_lat and max_lon > min_lon")


def centroid(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The integer mean of a way's known e7 coordinates; a closed way's first node weighs twice."""
    e7 = lambda c: S.e7_from_nano(F.col(c))
    known = resolved(refs, nodes).where(F.col("lat_nano").isNotNull())
    g = known.groupBy("way_id").agg(F.sum(e7("lat_nano")).alias("a"), F.sum(e7("lon_nano")).alias("o"), F.count("*").alias("n"))
    return g.select("way_id", S.div(F.col("a"), F.col("n")).alias("lat_e7"), S.div(F.col("o"), F.col("n")).alias("lon_e7"))


def bounds(nodes: DataFrame) -> DataFrame:
    return nodes.agg(*_box(), F.count("*").alias("nodes"))
