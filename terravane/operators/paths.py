"""Shortest walking paths: relaxation over tables for many targets, a heap or rounds for single pairs, steps and directions."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .geometry import BOX

STEP_M = 450


def distances(edges: DataFrame, sources: DataFrame, cut: Callable[[DataFrame], DataFrame], most_rounds: int = 10_000) -> DataFrame:
    """Metres from the sources to every node they reach, by frontier relaxation.

    edges: from_id, to_id, meters; sources: id. A round joins only the nodes whose distance fell with their edges; cut ends the
    lineage of each round (a checkpoint or a written table in the shared folder).
    """
    best = edges.groupBy("from_id", "to_id").agg(F.min("meters").alias("meters"))
    best = cut(best)
    known = cut(sources.select("id", F.lit(0).cast("bigint").alias("dist"), F.lit(True).alias("fresh")))
    for _ in range(most_rounds):
        step = known.where("fresh").join(best, F.col("id") == F.col("from_id")).groupBy(F.col("to_id").alias("t")).agg(F.min(F.col("dist") + F.col("meters")).alias("d"))
        merged = known.join(step, F.col("id") == F.col("t"), "full_outer")
        better = F.col("d").isNotNull() & (F.col("dist").isNull() | (F.col("d") < F.col("dist")))
        known = cut(merged.select(F.coalesce("id", "t").alias("id"), F.when(better, F.col("d")).otherwise(F.col("dist")).alias("dist"), better.alias("fresh")))
        if not known.where("fresh").limit(1).count():
            return known.select("id", "dist")
    raise RuntimeError(f"distances still fall after {most_rounds} rounds")


def shortest(edges: list[tuple[int, int, int]], source: int, target: int) -> tuple[int, list[int]] | None:
    """Metres and nodes of the shortest path, by a binary heap; None if there is none. Ties go to the smaller node."""
    graph: dict[int, list[tuple[int, int]]] = {}
    for a, b, m in edges:
        graph.setdefault(a, []).append((b, m))
    dist, back, heap = {source: 0}, {}, [(0, source)]
    while heap:
        d, at = heapq.heappop(heap)
        if d > dist[at]:
            continue
        if at == target:
            path = [at]
            while path[-1] != source:
                path.append(back[path[-1]])
            return d, path[::-1]
        for to, m in graph.get(at, ()):
            if d + m < dist.get(to, d + m + 1):
                dist[to], back[to] = d + m, at
                heapq.heappush(heap, (d + m, to))
    return None


#: Edges that one task may search with a heap, some hundred bytes each.
HEAP_EDGES = 500_000


def route_queries(queries: DataFrame, edges: DataFrame, cut: Callable[[DataFrame], DataFrame], cut_by: Callable[[DataFrame, str], DataFrame], heap_edges: int = HEAP_EDGES) -> DataFrame:
    """query, meters and path of each query within its tile window; null where there is no path.

    queries: query, source, target, tiles (array); edges: from_id, to_id, meters (1 at least), and a_tile and b_tile, the tiles of their
    segment's ends; one of them in the window is enough. Windows of few edges are solved by a heap in one task each, larger ones by
    relaxation over tables; both give the same path. cut_by writes a table in buckets of a column.
    """
    queries, edges = cut(queries), cut_by(edges.select("from_id", "to_id", "meters", "a_tile", "b_tile"), "from_id")
    sizes = edges.groupBy("a_tile", "b_tile").agg(F.count("*").alias("n")).withColumn("tile_id", F.explode(F.array_distinct(F.array("a_tile", "b_tile"))))
    sizes = queries.withColumn("tile_id", F.explode("tiles")).join(sizes, "tile_id").groupBy("query").agg(F.sum("n").alias("n"))
    sized = cut(queries.join(sizes, "query"))
    small, large = sized.where(F.col("n") <= heap_edges).drop("n"), sized.where(F.col("n") > heap_edges).drop("n")
    found = [f(q) for q, f in ((small, lambda q: _by_heap(q, edges)), (large, lambda q: _by_relaxation(cut(q), edges, cut))) if q.limit(1).count()]
    return reduce(DataFrame.unionByName, found) if found else queries.limit(0).select("query", F.lit(None).cast("bigint").alias("meters"), F.array("source").alias("path"))


def _by_heap(queries: DataFrame, edges: DataFrame) -> DataFrame:
    tiled = edges.withColumn("tile_id", F.explode(F.array_distinct(F.array("a_tile", "b_tile")))).drop("a_tile", "b_tile")
    asked = queries.withColumn("tile_id", F.explode("tiles")).drop("tiles").join(tiled, "tile_id")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        q, s, t = int(pdf["query"].iloc[0]), int(pdf["source"].iloc[0]), int(pdf["target"].iloc[0])
        rows = sorted(set(zip(pdf["from_id"].tolist(), pdf["to_id"].tolist(), pdf["meters"].tolist(), strict=True)))
        found = shortest(rows, s, t)
        return pd.DataFrame([(q, found[0] if found else None, found[1] if found else None)], columns=["query", "meters", "path"])

    return asked.groupBy("query").applyInPandas(solve, "query long, meters long, path array<long>")


def _by_relaxation(queries: DataFrame, edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rounds over all queries at once: a round joins only the nodes whose distance fell, and none beyond the target's distance so far.

    A node's label is (distance, distance of the node before, node before), the least of all: the node that a heap would come from.
    """
    c = F.col
    label = lambda *cols: F.struct(*[x.cast("bigint").alias(n) for x, n in zip(cols, ("dist", "before", "prev"), strict=True)])
    inside = F.array_contains("tiles", c("a_tile")) | F.array_contains("tiles", c("b_tile"))
    known = cut(queries.select("query", c("source").alias("id"), label(F.lit(0), F.lit(-1), c("source")).alias("l"), F.lit(True).alias("fresh")))
    while known.where("fresh").limit(1).count():
        reached = known.select("query", c("id").alias("target"), c("l.dist").alias("most"))
        bound = cut(queries.drop("source").join(reached, ["query", "target"], "left"))
        ends = known.where("fresh").join(bound, "query").where("most is null or l.dist < most")
        step = edges.join(ends.hint("shuffle_hash"), c("from_id") == c("id")).where(inside).where("most is null or l.dist + meters <= most")
        step = step.groupBy("query", c("to_id").alias("id")).agg(F.min(label(c("l.dist") + c("meters"), c("l.dist"), c("from_id"))).alias("new"))
        merged = known.drop("fresh").join(step, ["query", "id"], "full_outer")
        fresh = c("new").isNotNull() & (c("l").isNull() | (c("new.dist") < c("l.dist")))
        known = cut(merged.select("query", "id", F.least("l", "new").alias("l"), fresh.alias("fresh")))
    labels = known.select("query", c("id").alias("head"), "l")
    ends = queries.select("query", "source", c("target").alias("head")).join(labels, ["query", "head"], "left")
    walked = cut(ends.select("query", "source", c("l.dist").alias("meters"), F.when(c("l").isNotNull(), F.array("head")).alias("path"), F.when(c("head") != c("source"), c("l.prev")).alias("head")))
    while walked.where("head is not null").limit(1).count():
        back = walked.join(labels, ["query", "head"], "left")
        path = F.when(c("head").isNull(), c("path")).otherwise(F.concat(F.array("head"), "path"))
        walked = cut(back.select("query", "source", "meters", path.alias("path"), F.when(c("head") != c("source"), c("l.prev")).alias("head")))
    return walked.select("query", "meters", "path")


def with_window(ends: DataFrame, around: int = 1) -> DataFrame:
    """query, source, target and tiles: the rectangle of tiles that both ends span, and around more on each side."""
    c = F.col
    span = lambda axis: F.sequence(F.least(c(f"source_{axis}"), c(f"target_{axis}")) - around, F.greatest(c(f"source_{axis}"), c(f"target_{axis}")) + around)
    tiles = F.flatten(F.transform(span("x"), lambda x: F.transform(span("y"), lambda y: S.route_tile_id(x, y))))
    return ends.select("query", "source", "target", tiles.alias("tiles"))


def component_boxes(ways: DataFrame, found: DataFrame) -> DataFrame:
    """root, box, points and ways of each component. ways: way_id, a, points and a box; a way closed in itself that meets no other is one alone."""
    root = ways.join(found.select(F.col("v").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    agg = [f(n).alias(n) for n, f in (("min_lat", F.min), ("max_lat", F.max), ("min_lon", F.min), ("max_lon", F.max))]
    return root.groupBy("root").agg(*agg, F.sum("points").alias("points"), F.count("*").alias("ways"))


def far_components(found: DataFrame) -> DataFrame:
    """root and far: whether a component lies apart from the one with the most points (the least root among equals): apart by its box, with less
    than half of the points, more than doubling the box, and by a tenth of a degree or a third of the first one's span."""
    first = found.agg(F.max_by(F.struct(*BOX, "points", "root"), F.struct("points", -F.col("root"))).alias("p"))  # one row
    c, p = F.col, lambda n: F.col(f"p.{n}")
    gaps = [S.gap(p(f"min_{x}"), p(f"max_{x}"), c(f"min_{x}"), c(f"max_{x}")) for x in ("lon", "lat")]
    spans = [p(f"max_{x}") - p(f"min_{x}") for x in ("lon", "lat")]
    own = S.area_score(*[p(n) for n in ("min_lon", "min_lat", "max_lon", "max_lat")])
    both = S.area_score(*[f(c(n), p(n)) for f, n in ((F.least, "min_lon"), (F.least, "min_lat"), (F.greatest, "max_lon"), (F.greatest, "max_lat"))])
    wide = reduce(or_, [(g > 100_000_000) | ((s > 0) & (g > S.div(s, 3))) for g, s in zip(gaps, spans, strict=True)])
    far = ((gaps[0] > 0) | (gaps[1] > 0)) & (c("points") * 2 < p("points")) & (both > own * 2) & wide
    return found.crossJoin(F.broadcast(first)).select("root", far.alias("far"))


def nearest(nodes: DataFrame, lat_e7: int, lon_e7: int) -> DataFrame:
    """The node nearest to a point; the least id among equals."""
    m = S.direct_m(F.lit(lat_e7).cast("bigint"), F.lit(lon_e7).cast("bigint"), F.col("lat_e7"), F.col("lon_e7"))
    best = nodes.withColumn("meters", m).agg(F.min(F.struct("meters", "id")).alias("b")).where("b is not null")
    return best.select(F.col("b.id").alias("id"), F.col("b.meters").alias("meters"))


def along(steps: DataFrame, key: str = "path_id") -> DataFrame:
    """Running metres of each path's edges."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("walked", F.sum("meters").over(w))


def step_groups(meters: Column) -> Column:
    """Sums of runs of edges: a run closes at 450 metres or at the path's end. A fold, as the sum starts anew in each run."""
    zero = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("run"))

    def add(acc: Column, m: Column) -> Column:
        run = acc["run"] + m
        full = run >= STEP_M
        return F.struct(F.when(full, F.concat(acc["out"], F.array(run))).otherwise(acc["out"]).alias("out"), F.when(full, F.lit(0).cast("bigint")).otherwise(run).alias("run"))

    return F.aggregate(meters, zero, add, lambda acc: F.when(acc["run"] > 0, F.concat(acc["out"], F.array(acc["run"]))).otherwise(acc["out"]))


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The least node that each node is connected with, by label propagation with shortcuts. edges: a, b."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root"), F.lit(True).alias("moved")))
    while label.where("moved").limit(1).count():
        l2 = label.select(F.col("v").alias("b"), F.col("root").alias("r2"))
        near = both.join(l2, "b").groupBy(F.col("a").alias("v")).agg(F.min("r2").alias("near"))
        low = cut(label.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        jump = low.select(F.col("v").alias("root"), F.col("root").alias("r3"))
        label = cut(low.join(jump, "root").select("v", F.least("root", "r3").alias("root2"), "old").select("v", F.col("root2").alias("root"), (F.col("root2") != F.col("old")).alias("moved")))
    return label.select("v", "root")
