"""Toxicity: gradient-boosted trees over dense features of a whole text, calibrated by isotonic regression.

Features: densities of a fixed lexicon and of a learned one (words and word stems), how near lexicon words stand to the second person,
rates of capitals, punctuation, symbols, digits and obfuscated spellings, and lengths. Learning takes a bounded
sample of at most max_rows labelled rows (in expectation; drawn by a hash of the id, so reruns agree), splits it by the same hash into a part for the lexicon, a part
for the trees and a part for the calibration, and brings to the driver only word counts and feature rows of the
sample. The model has a fixed size and travels to the executors once; scoring is one scan in Arrow batches.

Defined results: null and empty texts are scored from zero features. Without labels of both classes the score is the
share of toxic labels, or 0. Rows with a null id are never learned from; repeated rows are scored alike. Labels that contradict
each other for an id are all learned from. Only id and text of documents and id and label of labels are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

# Common insults of the corpus's languages, and second-person pronouns.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool loser losers scum trash garbage clown pathetic worthless disgusting imbecile jerk "
    "bastard bitch crap damn shit fuck fucking asshole retard ugly filthy vermin "
    "dumm dummkopf arschloch scheisse scheiße trottel abschaum widerlich versager "
    "idiote imbécile connard merde stupide débile ordure minable salaud "
    "idiota estúpido estúpida imbécil basura mierda asqueroso escoria payaso".split()
)
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted tus vosotros".split())
#: Words between a lexicon word and a second person that still count as near.
NEAR = 5

#: Lengths of the word stems that the learned lexicon has beside whole words; a stem is written with a star.
STEMS = (4, 5, 6)

_WORD = re.compile(r"[^\W\d_]+")
_LEET = str.maketrans("013457@$!", "oieastasi")
_MASKED = re.compile(r"(?<![\w@$!*])[^\W\d_]+[013457@$!*][\w@$!*]*[^\W\d_]")

FEATURES = (
    "log_words", "fixed_density", "fixed_any", "fixed_distinct", "learned_density", "learned_any", "learned_weight", "learned_top", "learned_distinct", "near_you", "you_density", "capitals",
    "shouts", "questions", "punctuation", "symbols", "digits", "masked", "masked_hits", "mean_word", "pipes",
)

_CLASS = np.zeros((6, 256), dtype=bool)
_CLASS[0, 65:91] = True
_CLASS[1, 33] = _CLASS[2, 63] = _CLASS[5, 124] = True
_CLASS[3, [33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = True
_CLASS[4, [35, 36, 37, 38, 42, 60, 62, 64, 94, 126]] = True


def features(text: str | None, learned: dict[str, float]) -> list[float]:
    """The dense features of a whole text, in the order of FEATURES."""
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    n = max(1, len(words))
    seen = set(words)
    fixed, own = seen & INSULTS, {}
    if learned:
        for w in seen:
            found = [v for e in (w, *[f"{w[:k]}*" for k in STEMS]) if (v := learned.get(e)) is not None]
            if found:
                own[w] = max(found)
    hits = near = learned_hits = you = 0
    if not seen.isdisjoint(YOU):
        you = sum(w in YOU for w in words)
    if fixed or own:
        places = [i for i, w in enumerate(words) if w in fixed or w in own]
        hits = sum(words[i] in fixed for i in places)
        learned_hits = sum(words[i] in own for i in places)
        if you:
            near = sum(not YOU.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i in places)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    caps, shouts, questions, punct, symbols, pipes = (int(by_byte[c].sum()) for c in _CLASS)
    digits = int(by_byte[48:58].sum())
    masked = _MASKED.findall(low) if digits + symbols + shouts else []
    masked_hits = sum(m.translate(_LEET) in INSULTS for m in masked)
    size = max(1, len(raw))
    return [
        np.log1p(len(words)), hits / n, float(hits > 0), float(len(fixed)), learned_hits / n, float(learned_hits > 0), sum(own.values()) if own else 0.0, max(own.values(), default=0.0), float(len(own)), near / n, you / n, caps / size,
        shouts / n, questions / n, punct / n, symbols / n, digits / size, len(masked) / n, masked_hits / n, len(text) / n, pipes / n,
    ]


@dataclass
class Trees:
    """Trees of one depth, as arrays: a node's feature and threshold, and the value of each leaf."""

    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - (2**self.depth - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 5.0) -> Trees:
    """Second-order boosting of log loss on binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    base = min(max(y.mean(), 1e-6), 1 - 1e-6)
    start = float(np.log(base / (1 - base)))
    margin = np.full(len(y), start)
    inner = 2**depth - 1
    found = ([], [], [])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        f, t = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            at = node - first
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = at * (len(e) + 1) + code[:, j]
                g = np.bincount(key, grad, width * (len(e) + 1)).reshape(width, -1).cumsum(axis=1)
                h = np.bincount(key, hess, width * (len(e) + 1)).reshape(width, -1).cumsum(axis=1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                f[first : first + width][better] = j
                t[first : first + width][better] = e[k[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > t[node])
        leaf_of = node - inner
        g = np.bincount(leaf_of, grad, 2**depth)
        h = np.bincount(leaf_of, hess, 2**depth)
        leaf = -rate * g / (h + ridge)
        margin += leaf[leaf_of]
        for store, v in zip(found, (f, t, leaf), strict=True):
            store.append(v)
    return Trees(depth, np.array(found[0]), np.array(found[1]), np.array(found[2]), start)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing scores and the calibrated value of each."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, least score, greatest score
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    # half a count to either class keeps small blocks off 0 and 1
    xs = [v for b in blocks for v in (b[2], b[3])]
    ys = [v for b in blocks for v in ((b[0] + 0.05) / (b[1] + 0.1),) * 2]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


@dataclass
class Model:
    learned: dict[str, float] = field(default_factory=dict)
    trees: Trees | None = None
    xs: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ys: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        return np.clip(np.interp(self.trees.margin(x), self.xs, self.ys), 0.0, 1.0)


def _featured(df: DataFrame, learned: dict[str, float], columns: list[str]) -> DataFrame:
    """columns and a feature array of df's _text."""
    sent = df.sparkSession.sparkContext.broadcast(learned)  # at most max_lexicon words
    base = df.select(*columns, "_text")
    schema = ", ".join(f"{c} {t}" for c, t in base.dtypes if c != "_text") + ", x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py(), sent.value) for t in b.column(len(columns))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*columns, "x"])

    return base.mapInArrow(run, schema)


def _stems(words: Column, k: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) >= k), lambda w: F.concat(F.left(w, F.lit(k)), F.lit("*")))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 16_000, max_lexicon: int = 400
) -> Model:
    """Learn from labelled rows outside the held-out fifth."""
    truth = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & ~held_out(F.col("_id"))).distinct()
    below = lambda share, *columns: F.pmod(F.xxhash64(*columns, F.lit("draw")), F.lit(1 << 20)) < share * (1 << 20)
    truth = truth.where(below(min(1.0, max_rows / max(1, truth.count())), "_id"))
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # the sample's ids are bounded; the documents' side is filtered by a hash join against them
    rows = text.join(F.broadcast(truth), "_id")
    # ids that documents repeat bring more rows than labels: those are drawn from too, so that max_rows bounds what is learned from
    share = min(1.0, max_rows / max(1, rows.count()))
    if share < 1:
        rows = rows.where(below(share, "_id", "_text", "_y"))
    part = F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(10))
    sample = rows.distinct().withColumn("_part", part).persist()
    classes = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        sample.unpersist()
        return Model(rate=float(bool(classes.get(1))))
    # the lexicon's part: in how many different texts of either class a word stands
    distinct = sample.where("_part < 4").select("_y", "_text").distinct()
    sizes = {r["_y"]: r["n"] for r in distinct.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    split = F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}]+"))
    stems = [_stems(split, k) for k in STEMS]
    by_word = distinct.select("_y", F.explode(F.array_distinct(F.concat(split, *stems))).alias("w")).where("w <> ''")
    counts = by_word.groupBy("w").agg(F.sum("_y").alias("bad"), F.sum(1 - F.col("_y")).alias("good")).where("bad >= 8")
    ratio = F.log((F.col("bad") + 0.5) / max(1, sizes.get(1, 0))) - F.log((F.col("good") + 0.5) / max(1, sizes.get(0, 0)))
    strong = counts.withColumn("odds", ratio).where("odds > 1.5").orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "w").limit(max_lexicon)
    learned = {r["w"]: float(r["odds"]) for r in strong.collect()}
    rows = _featured(sample, learned, ["_y", "_part"]).collect()  # max_rows rows of features
    sample.unpersist()
    x, y, p = (np.array([r[k] for r in rows]) for k in ("x", "_y", "_part"))
    fit, cal = p >= 4, p >= 8
    fit &= ~cal
    if len(set(y[fit])) < 2 or len(set(y[cal])) < 2:
        fit = cal = np.ones(len(y), dtype=bool)
    order = np.lexsort(x[fit].T)  # the rows' order must not matter to sums of floats
    trees = boost(x[fit][order], y[fit][order].astype(float))
    xs, ys = isotonic(trees.margin(x[cal]), y[cal].astype(float))
    return Model(learned, trees, xs, ys)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score (0 to 1) and predicted (1 if score >= 0.5)."""
    base = df.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    sent = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            x = np.array([features(t.as_py(), m.learned) for t in b.column(2)], dtype=float).reshape(-1, len(FEATURES))
            s = m.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
