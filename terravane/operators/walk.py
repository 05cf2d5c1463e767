"""The walking graph: segments between neighbouring references, edges both ways, per tile; degrees and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def segments(ways: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbouring resolved references of walkable ways as directed segments with metres; loops are dropped.

    nodes: id, lat_e7, lon_e7. One shuffle by node id resolves references, one by way pairs them.
    """
    walk = ways.where("walkable").select(F.col("id").alias("way_id"))
    known = refs.join(walk, "way_id", "left_semi").join(nodes.select(F.col("id").alias("node_id"), "lat_e7", "lon_e7"), "node_id", "left")
    w = Window.partitionBy("way_id").orderBy("pos")
    after = lambda c: F.lead(c).over(w)
    pairs = known.select("way_id", "pos", F.col("node_id").alias("a"), F.col("lat_e7").alias("a_lat"), F.col("lon_e7").alias("a_lon"), after("node_id").alias("b"), after("lat_e7").alias("b_lat"), after("lon_e7").alias("b_lon"))
    good = pairs.where("a_lat is not null and b_lat is not null and a <> b")
    return good.withColumn("meters", S.edge_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))


def edges(found: DataFrame, *others: str) -> DataFrame:
    """Each segment in both directions, with other columns of it."""
    turn = lambda a, b: found.select(F.col(a).alias("from_id"), F.col(b).alias("to_id"), "meters", *others)
    return turn("a", "b").unionByName(turn("b", "a"))


def tile_edges(found: DataFrame, tile_of_a: str = "a_tile", tile_of_b: str = "b_tile") -> DataFrame:
    """Segments by tile; one between two tiles is in both."""
    return found.withColumn("tile_id", F.explode(F.array_distinct(F.array(tile_of_a, tile_of_b))))


def degrees(all_edges: DataFrame) -> DataFrame:
    return all_edges.groupBy("from_id").agg(F.count("*").alias("degree"))


def offsets(counts: DataFrame, key: str = "from_id", count: str = "degree") -> DataFrame:
    """The running total before each key, as a compressed sparse row layout has it.

    Keys are dealt into ranges of about equal rows, as many as a shuffle has partitions; totals of ranges are summed first, so the
    window over all rows has one row a range, and the others are windows of one range each.
    """
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges_ = counts.approxQuantile(key, [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    ranged = counts.withColumn("_r", F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges_))]).cast("array<double>"), lambda e: e < F.col(key))))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_r").agg(F.sum(count).alias("_s")).select("_r", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("_r").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(base, "_r").withColumn("offset", (F.col("_b") + F.coalesce(F.sum(count).over(inside), F.lit(0))).cast("bigint")).drop("_r", "_b")
