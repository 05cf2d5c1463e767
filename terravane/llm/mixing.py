"""Mixing sources to target weights by balanced sampling with the cube method.

Each source's target is a share of the wanted total by weight, capped at a number of repeats of the source.
A document is taken floor(target / source size) times, and once more with the rest as its inclusion probability.
Which documents are taken once more is decided by the cube method, balanced on the sum of tokens and on the
number of documents:

* flight, in blocks: the probabilities of three documents at a time move along the null space of the two
  balancing constraints until one of them is 0 or 1, which leaves at most two undecided documents a block;
* the undecided documents of many blocks meet in blocks of the next level, until one block a source is left;
* landing: the last flight of a source leaves at most LANDING documents open, its smallest ones and what the
  flight couldn't decide; of all ways to decide them the one whose total of tokens is nearest to the wanted one is taken, then
  the one whose number of documents is.

A source is spread over blocks of a bounded number of documents by a hash, so one that holds a third of all
rows costs more blocks, not a larger one. Text is read once, to count words; only ids and counts are shuffled.

Defined results: null text has no words; a document of size 0 takes 0 words. A null source is a source of its
own, last in order. Repeated rows are separate documents. Order within a block is by size, hash and id, so reruns
agree; rows that tie in all of these are interchangeable. An empty table, or one without words, gives targets 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Documents a block of the first flight has, about; blocks that meet in one block of the next level.
BLOCK_ROWS = 4000
FAN_IN = 1000
#: Documents that the last block of a source leaves undecided for the landing, at most.
LANDING = 12


def targets(sources: DataFrame, weights: tuple[float, ...], factor: float, cap: float) -> DataFrame:
    """src, weight, total, rows and target of each source (src, total, rows): shares of factor times all totals by weight, in order of
    src with null last, none above cap times its total; the excess is shared anew by weight among the rest.

    Sources are numbered over sorted, written parts, of which only the counts come to the driver; each pass of the filling
    is one aggregation that returns one row.
    """
    by_name = (F.col("src").isNull(), F.col("src"))
    parts = materialize(sources.repartitionByRange(*by_name).sortWithinPartitions(*by_name).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = {r["part"]: r["n"] for r in parts.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, at = {}, 0
    for k in sorted(counts):
        before[k], at = at, at + counts[k]
    if not counts:
        return parts.select("src", F.lit(0.0).alias("weight"), "total", "rows", F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("number"))
    first = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), part)
    number = first + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    named = materialize(parts.select("src", "total", "rows", number.cast("long").alias("number"), weight.alias("weight")))
    whole = float(named.agg(F.sum("total")).first()[0] or 0)
    wanted, share = min(factor, cap) * whole, 0.0
    if whole:
        full = F.lit(False)
        while True:
            is_open = ~full & (F.col("total") > 0)
            r = named.agg(F.sum(F.when(is_open, F.col("weight"))).alias("w"), F.sum(F.when(full, cap * F.col("total"))).alias("taken")).first()
            if not r["w"]:
                break
            before_share, share = share, (wanted - float(r["taken"] or 0)) / r["w"]
            if share <= before_share:
                break
            full = F.col("weight") * F.lit(share) >= cap * F.col("total")
    return named.withColumn("target", F.when(F.col("total") > 0, F.least(F.col("weight") * F.lit(share), (cap * F.col("total")).cast("double"))).otherwise(0.0))


def flight(prob: np.ndarray, tokens: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """Move probabilities through the null space of (count, tokens) until at most two are strictly between 0 and 1."""
    p = prob.tolist()
    x = [float(t) for t in tokens]
    live: list[int] = []
    step = 0
    for i in range(len(p)):
        if 1e-9 < p[i] < 1 - 1e-9:
            live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        # the direction u with sum(u) = 0 and sum(u * tokens) = 0
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for k, v in zip(live, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
            elif v < 0:
                up, down = min(up, p[k] / -v), min(down, (1 - p[k]) / -v)
        move = up if uniform[step % len(uniform)] * (up + down) < down else -down
        step += 1
        for k, v in zip(live, u, strict=True):
            p[k] = min(1.0, max(0.0, p[k] + move * v))
        live = [k for k in live if 1e-9 < p[k] < 1 - 1e-9]
    return np.array(p)


def landing(p: np.ndarray, sizes: np.ndarray, want: tuple[float, float]) -> None:
    """Decide the undecided of p so that the totals of sizes and of documents come nearest to want, sizes first."""
    rest = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    if not len(rest):
        return
    ways = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest)) & 1).astype(float)
    fixed = np.setdiff1d(np.arange(len(p)), rest)
    off = np.abs(float((np.round(p[fixed]) * sizes[fixed]).sum()) + ways @ sizes[rest] - want[0])
    rows = np.abs(float(np.round(p[fixed]).sum()) + ways.sum(axis=1) - want[1])
    p[rest] = ways[np.lexsort((rows, np.round(off, 6)))[0]]


def _settle(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    # the largest first, so that what stays undecided is small
    pdf = pdf.sort_values(["_size", "_h", "_id", "_uid"], ascending=[False, True, True, True], kind="mergesort", na_position="last").reset_index(drop=True)
    seed = int(pdf["_b"].iloc[0]) * 2654435761 + int(pdf["_src"].iloc[0]) * 40503 + 1
    given, sizes = pdf["_p"].to_numpy(dtype=float), pdf["_size"].to_numpy(dtype=float)
    # the last block of a source leaves its smallest documents to the landing
    held = min(len(pdf), LANDING - 2) if last else 0
    p = np.concatenate([flight(given[: len(pdf) - held], sizes[: len(pdf) - held], np.random.default_rng(seed % 2**63).random(len(pdf))), given[len(pdf) - held :]])
    if last:
        landing(p, sizes, (float((given * sizes).sum()), float(given.sum())))
    out = pdf.assign(_p=np.where(p < 1e-9, 0.0, np.where(p > 1 - 1e-9, 1.0, p)))
    out["_uid"] = [f"{s}:{b}:{i}" if u == "" else u for s, b, i, u in zip(out["_src"], out["_b"], range(len(out)), out["_uid"], strict=True)]
    return out


def _settle_on(pdf: pd.DataFrame) -> pd.DataFrame:
    return _settle(pdf, False)


def _settle_last(pdf: pd.DataFrame) -> pd.DataFrame:
    return _settle(pdf, True)


def mix(
    df: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    factor: float = 1.5,
    cap: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """id, carried columns, size, source_size, target (of its source), taken (words) and repeats (times taken).

    Sources by code point, null last, weigh weights, repeating; together they get factor times all words.
    """
    # a written table gives each row a number that stays; carried columns meet their row again at the end
    base = materialize(df.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)],
        F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h"),
    ))
    rows = base.select("_row", "_id", "_source", "_size", "_h")
    per = rows.groupBy(F.col("_source").alias("src")).agg(F.sum("_size").alias("total"), F.count("*").alias("rows"))
    ratio = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0)
    least = F.least(F.lit(cap), F.floor(ratio + 1e-12)).cast("long")
    sources = materialize(targets(per, weights, factor, cap).select(
        F.col("src").alias("_s2"), F.col("number").alias("_src"), F.col("total").alias("_total"), F.col("target").alias("_target"), least.alias("_whole"),
        F.when(least < cap, F.greatest(F.lit(0.0), ratio - least)).otherwise(0.0).alias("_p"), F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("long").alias("_blocks"),
    ))
    # the planner broadcasts the sources while their size is below the session's threshold
    dealt = rows.join(sources, F.col("_source").eqNullSafe(F.col("_s2"))).drop("_s2", "_source")
    dealt = dealt.withColumns({"_b": F.pmod(F.xxhash64("_h", "_id"), F.col("_blocks")), "_uid": F.lit("")})
    state = "_src long, _b long, _id " + dict(rows.dtypes)["_id"] + ", _size long, _h long, _p double, _uid string"
    schema = dealt.schema
    blocks = int(sources.agg(F.max("_blocks")).first()[0] or 1)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return _settle(pdf, bool((pdf["_blocks"].iloc[0] == 1)))[list(schema.names)]

    done = materialize(dealt.groupBy("_src", "_b").applyInPandas(first, schema))
    settled = done
    if blocks > 1:
        undecided = done.where((F.col("_p") > 0) & (F.col("_p") < 1)).select(*[x.split()[0] for x in state.split(", ")])
        parts: list[DataFrame] = []
        while blocks > 1:
            blocks = math.ceil(blocks / FAN_IN)
            again = _settle_last if blocks == 1 else _settle_on
            level = materialize(undecided.withColumn("_b", F.expr(f"_b div {FAN_IN}")).groupBy("_src", "_b").applyInPandas(again, state))
            parts.append(level.where(F.col("_p").isin(0.0, 1.0)).select(F.col("_uid").alias("_u2"), F.col("_p").alias("_p2")))
            undecided = level.where((F.col("_p") > 0) & (F.col("_p") < 1))
        resolved = parts[0]
        for x in parts[1:]:
            resolved = resolved.union(x)
        open_rows = done.where((F.col("_p") > 0) & (F.col("_p") < 1)).join(resolved, F.col("_uid") == F.col("_u2"), "left")
        open_rows = open_rows.withColumn("_p", F.coalesce("_p2", F.lit(0.0))).drop("_u2", "_p2")
        settled = done.where(F.col("_p").isin(0.0, 1.0)).unionByName(open_rows)
    repeats = F.col("_whole") + F.col("_p").cast("long")
    out = settled.select("_row", "_id", "_size", "_total", "_target", repeats.alias("_n"))
    if carry:
        out = out.join(base.select(F.col("_row").alias("_row2"), *[f"_c{k}" for k in range(len(carry))]), F.col("_row") == F.col("_row2"))
    return out.select(
        F.col("_id").alias(id_col), *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)], F.col("_size").alias("size"), F.col("_total").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * F.col("_n")).alias("taken"), F.col("_n").alias("repeats"),
    )
