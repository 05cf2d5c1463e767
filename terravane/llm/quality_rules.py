"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression and every rule a row of a table (measure, least, most), so the whole
verdict is one projection over the scan: no shuffle, no user function, no Python worker.

Defined results: null, empty and blank texts have no words, so every measure is 0 and the base rule rejects
them. Repeated rows are judged alike, each for itself. Only the text column is read; other columns of the
input, whatever their names, don't matter. An empty table gives an empty result. The cost of a text of n
words is n log n (one sort of its 3-word windows), so very long texts stay within one row's memory.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, words

# Frequent function words of the corpus's languages.
STOP_WORDS = (
    "the of and to in is was for on that with as it be by this are from at or an "
    "der die das und von zu mit den im für nicht ein eine ist des dem auf sich "
    "le la les de du des et un une en pour que qui dans au par est "
    "el los las del y que por con una para se como su al lo"
).split()
STOP_FORMS = sorted({form for w in STOP_WORDS for form in (w, w.capitalize())})


@dataclass(frozen=True)
class Rule:
    """A text passes when least <= measure <= most; a bound that is None doesn't bind."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The production table. Ratios have n_words (never 0 once the base rule holds) or lines below the bar.
DEFAULT_RULES = (
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbol_ratio", None, 0.30),
    Rule("shout_ratio", None, 0.30),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.70),
    Rule("bullet_line_ratio", None, 0.95),
)


def _windows(w: Column, n: Column) -> Column:
    """The hash of each 3-word window of w."""
    at = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), at))


def _same(w: Column, i: Column, j: Column) -> Column:
    return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once however often body names it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that the text has at least twice."""
    # only texts with some window hash twice sort theirs; hash neighbours then count if their words are the same
    ordered = lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    )
    twin = lambda x, y: F.coalesce((y["h"] == x["h"]) & _same(w, x["i"], y["i"]), F.lit(False))
    places = lambda s: F.sort_array(
        F.transform(F.filter(s, lambda x, j: twin(x, F.get(s, j + 1)) | F.when(j > 0, twin(x, F.get(s, j - 1))).otherwise(False)), lambda x: x["i"])
    )
    covered = lambda s: F.aggregate(
        places(s),
        F.struct(F.lit(0).alias("c"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["c"] + F.least(F.lit(3), p - a["last"])).alias("c"), p.alias("last")),
        lambda a: a["c"],
    )
    return F.coalesce(let(_windows(w, F.size(w)), lambda h: let(ordered(h), covered)), F.lit(0))


def measure(text: Column, rules: tuple[Rule, ...]) -> Column:
    """A struct of the counts, the ratios and the two verdicts of one text."""

    def counts(x: Column) -> Column:
        t, w, l, d = x["t"], x["w"], x["l"], F.size(F.array_distinct(x["l"]))  # noqa: E741
        gone = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
        parts = {
            "n_words": F.size(w),
            "word_chars": F.length(F.translate(t, WS_CHARS, "")),
            "n_symbols": gone("#*$%&|<>"),
            "n_dup_lines": F.size(l) - d,
            "n_repeat_words": _repeat_words(w),
            "n_shouts": gone("!"),
            "n_stops": F.size(F.filter(w, lambda y: y.isin(STOP_FORMS))),
            "n_bullets": F.size(F.filter(l, lambda y: y.rlike(rf"^{WS}*([-•*]|\d+[.)]) "))),
            "n_lines": F.size(l),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in parts.items()])

    def verdicts(c: Column) -> Column:
        words_, lines = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["n_lines"], F.lit(1))
        ratio = {
            "mean_word_chars": c["word_chars"] / words_,
            "symbol_ratio": c["n_symbols"] / words_,
            "shout_ratio": c["n_shouts"] / words_,
            "stop_word_ratio": c["n_stops"] / words_,
            "dup_line_ratio": c["n_dup_lines"] / lines,
            "bullet_line_ratio": c["n_bullets"] / lines,
        }
        failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
        kept = ~failed
        for r in rules:
            if r.least is not None:
                kept = kept & (ratio[r.measure] >= r.least)
            if r.most is not None:
                kept = kept & (ratio[r.measure] <= r.most)
        return F.struct(*[c[k].alias(k) for k in COUNTS], *[v.alias(k) for k, v in ratio.items()], failed.alias("base_failed"), kept.alias("kept"))

    cut = lambda t: F.struct(
        t.alias("t"), words(t).alias("w"), F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")).alias("l")
    )
    return let(let(cut(F.coalesce(text, F.lit(""))), counts), verdicts)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """carry, the five counts, base_failed and kept: false if the base rule fails, else what the table says."""
    m = df.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)], measure(F.col(text_col), rules).alias("_m"))
    return m.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)], *[F.col(f"_m.{c}").alias(c) for c in (*COUNTS, "base_failed", "kept")])


def oracle_sql(rules: tuple[Rule, ...] = DEFAULT_RULES, table: str = "documents", tail: str | None = None) -> str:
    """DuckDB SQL for judge() over a table; tail replaces the last SELECT."""
    ws = r"[\x20\x09-\x0D]"
    stop = ", ".join(f"'{w}'" for w in STOP_FORMS)
    both = " AND ".join(
        [f"{r.measure} >= {r.least}" for r in rules if r.least is not None] + [f"{r.measure} <= {r.most}" for r in rules if r.most is not None]
    )
    return rf"""
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM src),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
dup AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, greatest(len(w), 1) AS nw, length(regexp_replace(t, '{ws}', '', 'g')) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, length(t) - length(replace(t, '!', '')) AS n_shouts,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: x IN ({stop}))) AS stops, greatest(len(l), 1) AS nl,
             len(list_filter(l, lambda x: regexp_matches(x, '^{ws}*([-•*]|[0-9]+[.)]) '))) AS bullets
      FROM w LEFT JOIN cov USING (rid)),
r AS (SELECT *, word_chars / nw AS mean_word_chars, n_symbols / nw AS symbol_ratio, n_shouts / nw AS shout_ratio, stops / nw AS stop_word_ratio,
             n_dup_lines / nl AS dup_line_ratio, bullets / nl AS bullet_line_ratio, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
""" + (tail or f"""SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {both} AS kept FROM r""")  # fmt: skip
