"""Language identification, words first: known words score by their log frequency in each language; a word that
no language knows falls back to the longest character n-grams of it that are known, then to shorter ones.

Learning counts the words of a sample of at most docs_per_lang labelled documents a language (in expectation; the
sample is drawn by a hash of the id, so reruns agree) with Spark aggregations, and keeps the most frequent max_words words
and max_grams n-grams of each language, so a small language keeps its vocabulary beside large ones and the model that travels
to the executors has at most (max_words + max_grams) rows a language, whatever the corpus has.
Prediction is one scan in Arrow batches without a shuffle.

Defined results: null text and text without a letter give und with score 0, as does everything if no row could be
learned from. Ties go to the language first by name. Rows with a null id are never learned from. Repeated rows are
predicted alike. lang is read only in learning; other columns are not read at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

LONGEST_GRAM = 4
#: Words are runs of letters, \p{L}; the standard library's faster engine agrees on texts without the characters of _ODD.
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")
_ODD = re.compile("[²³¹¼-¾ɐ-\U0010ffff]")
#: Words without an entry that a worker remembers the scores of, before it starts anew.
MEMORY = 150_000


@dataclass
class Model:
    """langs by name; rows of log frequency, one column a language; which row a word or an n-gram has."""

    langs: list[str]
    table: np.ndarray
    words: dict[str, int]
    grams: dict[str, int]


def _grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of a text."""
    low = (text or "").lower()
    return (_LETTERS if _ODD.search(low) else _WORD).findall(low)


def _cut(padded: Column, n: int) -> Column:
    """The n-grams of a padded word, as _grams() has them."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
    return F.filter(every, lambda g: F.length(g) == n)


def _most_frequent(counted: DataFrame, column: str, most: int, every: DataFrame) -> list:
    """Each language's most frequent entries of counted, with their counts in all languages; the tables come from the bounded sample."""
    order = Window.partitionBy("_lang").orderBy(F.desc("n"), column)
    chosen = counted.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).select(column).distinct()
    by = F.map_from_entries(F.collect_list(F.struct("_lang", "n"))).alias("by")
    return every.join(chosen, column, "left_semi").groupBy(column).agg(by).orderBy(column).collect()


def learn(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    docs_per_lang: int = 3000, max_words: int = 20_000, max_grams: int = 15_000,
) -> Model:
    """Learn from rows outside the held-out fifth that have a language."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    rows = rows.where(~held_out(F.col("_id")) & F.col("_lang").isNotNull())
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, 0)), {}, {})
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, docs_per_lang / sizes[k]))]), F.col("_lang"))
    sample = rows.where(F.pmod(F.xxhash64("_id", "_lang"), F.lit(1 << 20)) < share * (1 << 20))
    counted = sample.select("_lang", F.explode(F.split(F.lower("_text"), r"[^\p{L}]+")).alias("w")).where("w <> ''").groupBy("_lang", "w").agg(F.count("*").alias("n"))
    counted = counted.persist()
    top = _most_frequent(counted.where("n >= 2"), "w", max_words, counted)
    padded = counted.select("_lang", F.concat(F.lit("^"), "w", F.lit("$")).alias("p"), "n")
    cut = [_cut(F.col("p"), k) for k in range(1, LONGEST_GRAM + 1)]
    grams = padded.select("_lang", "n", F.explode(F.flatten(F.array(*cut))).alias("g")).groupBy("_lang", "g").agg(F.sum("n").alias("n"))
    top_grams = _most_frequent(grams, "g", max_grams, grams)
    totals = {r["_lang"]: r["n"] for r in counted.groupBy("_lang").agg(F.sum("n").alias("n")).collect()}
    counted.unpersist()

    def scores(found: list, column: str) -> tuple[dict[str, int], np.ndarray]:
        seen = np.array([[r["by"].get(k, 0) for k in langs] for r in found], dtype=float).reshape(-1, len(langs))
        whole = np.array([totals.get(k, 0) for k in langs], dtype=float)
        return {r[column]: i for i, r in enumerate(found)}, np.log((seen + 0.1) / (whole + 0.1 * max(1, len(found))))

    words, word_rows = scores(top, "w")
    gram_index, gram_rows = scores(top_grams, "g")
    return Model(langs, np.vstack([word_rows, gram_rows]), words, {g: i + len(words) for g, i in gram_index.items()})


class Scorer:
    """A worker's view of the model; remembers what it worked out for words that the model doesn't have."""

    def __init__(self, model: Model) -> None:
        self.m, self.known = model, dict(model.words)
        self.table, self.used = model.table.copy(), len(model.table)

    def unseen(self, word: str) -> np.ndarray:
        for n in range(LONGEST_GRAM, 0, -1):
            rows = [r for g in _grams(word, n) if (r := self.m.grams.get(g)) is not None]
            if rows:
                return self.m.table[rows].mean(axis=0)
        return np.zeros(len(self.m.langs))

    def row(self, word: str) -> int:
        if self.used == len(self.table):
            if self.used > len(self.m.table) + MEMORY:
                self.__init__(self.m)
                return -1
            self.table = np.vstack([self.table, np.zeros((max(1024, len(self.table) // 2), len(self.m.langs)))])
        self.table[self.used] = self.unseen(word)
        self.known[word] = self.used
        self.used += 1
        return self.used - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.m.langs:
            return "und", 0.0
        total = np.zeros(len(self.m.langs))
        rows = []
        for w in words:
            r = self.known.get(w)
            if r is None:
                r = self.row(w)
                if r < 0:  # the memory was emptied: what its rows summed to so far is kept apart
                    return self.predict_slowly(words)
            rows.append(r)
        total = self.table[rows].sum(axis=0)
        return self.best(total)

    def predict_slowly(self, words: list[str]) -> tuple[str, float]:
        total = np.zeros(len(self.m.langs))
        for w in words:
            r = self.m.words.get(w)
            total += self.unseen(w) if r is None else self.m.table[r]
        return self.best(total)

    def best(self, total: np.ndarray) -> tuple[str, float]:
        k = int(total.argmax())
        return self.m.langs[k], float(1 / np.exp(total - total[k]).sum())


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred and score."""
    base = df.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    sent = df.sparkSession.sparkContext.broadcast(model)  # at most max_words + max_grams rows a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            out = [scorer.predict(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["id", "held_out", "lang_pred", "score"]
            )

    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
