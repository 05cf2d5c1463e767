"""Secret scanning: three plain patterns, and a battery of randomness tests over the other long tokens.

The plain kinds are assign (a credential name, a separator and a value), access (an access key id) and hex (a long
run of hexadecimal digits). Any other token of at least 20 characters with both letters and digits is a candidate of the kind
random; = ends a token, except as padding, and a token that is no secret as a whole is tried again in its parts between
slashes, then between - and _. A candidate's encoding is inferred from its characters, and its symbols are tested against what
that encoding's random strings look like: chi-squared uniformity over the alphabet, a runs test about the alphabet's
middle and a lag-one serial correlation, combined by Fisher's method into one p-value.

False-discovery control is over all candidates of the table in a class of length: the Benjamini-Hochberg step over the battery's
p-values decides which candidates are rejected as not random, so that at most a share alpha of the rejected ones is random in
expectation, at every length. Short tokens give the battery little power against text, so what it keeps must also be
unlike text: the log-likelihood ratio of the symbols under uniform and under text letter frequencies has a known mean
and variance under text, and its p-value must be at most q.

Two scans in Arrow batches: the first counts p-values by length class and step of a fixed grid, a table of bounded size, the
second finds the spans. Texts are not shuffled and no group can be hot.

Defined results: null and empty texts have no spans. Offsets count code points, the end exclusive. Repeated rows
are scanned alike, and each counts as a candidate. Only the id and the text are read, whatever else the table has. An empty
table has no candidates. Tokens of letters only or of digits only are never of the kind random.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import kept_by

#: Kinds in the order that breaks ties of start.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
_LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: What the parts of a token stand between, from one attempt to the next.
_PARTS = (re.compile(r"[^/]{20,}"), re.compile(r"[^/_-]{20,}"))
#: Lengths from which classes begin, and how fine the grid of p-values is: steps of -log10(p), up to the last one.
CLASSES = (20, 24, 28, 32, 40, 48, 64, 96, 160)
STEP, LAST = 0.02, 1000
_NAMES = ("passw", "secret", "token", "api_key", "apikey")

# Relative frequency of the letters a to z in text, in per mille.
LETTER_PER_MILLE = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)

#: Inferred encodings: name, the characters allowed and the alphabet in order.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = tuple(
    (name, frozenset(alphabet), {c: i for i, c in enumerate(alphabet)})
    for name, alphabet in (
        ("hex", _DIGITS + "abcdef"),
        ("HEX", _DIGITS + "ABCDEF"),
        ("base32", _UPPER + "234567"),
        ("base36", _DIGITS + _LOWER),
        ("BASE36", _DIGITS + _UPPER),
        ("base62", _DIGITS + _UPPER + _LOWER),
        ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
        ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
    )
)


def _text_model() -> dict[str, float]:
    total = sum(LETTER_PER_MILLE)
    p = {c: 0.90 * f / total for c, f in zip(_LOWER, LETTER_PER_MILLE, strict=True)}
    p |= {c: 0.05 * f / total for c, f in zip(_UPPER, LETTER_PER_MILLE, strict=True)}
    p |= dict.fromkeys(_DIGITS, 0.03 / 10) | dict.fromkeys("+/-_=", 0.02 / 5)
    return p


_TEXT = _text_model()


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-squared: exact for an even number of degrees, else by the Wilson-Hilferty cube root."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        term = total = math.exp(-x / 2) if x < 1400 else 0.0
        for k in range(1, df // 2):
            term *= x / 2 / k
            total += term
        return min(1.0, total)
    c = 2 / (9 * df)
    return normal_sf(((x / df) ** (1 / 3) - (1 - c)) / math.sqrt(c))


def infer_encoding(token: str) -> tuple[str, dict[str, int]] | None:
    """The narrowest encoding whose alphabet has all of a token's characters; none without both letters and digits."""
    core = token.rstrip("=")
    seen = set(core)
    if not seen & set(_DIGITS) or not seen - set(_DIGITS):
        return None
    return next(((name, order) for name, allowed, order in ENCODINGS if seen <= allowed), None)


def randomness(symbols: list[int], size: int) -> float:
    """The combined p-value that symbols of an alphabet of that size are random."""
    n = len(symbols)
    bins = max(2, min(size, n // 5))  # five expected a bin at least, so short tokens get coarse bins
    counts = [0] * bins
    for s in symbols:
        counts[s * bins // size] += 1
    width = [0] * bins
    for s in range(size):
        width[s * bins // size] += 1
    chi = sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(counts, width, strict=True))
    p_chi = chi2_sf(chi, bins - 1)

    high = [2 * s >= size for s in symbols]
    n1, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    n0 = n - n1
    if n0 and n1:
        mean = 2 * n0 * n1 / n + 1
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p_runs = 2 * normal_sf(abs(runs - mean) / math.sqrt(var))
    else:
        p_runs = 2.0 ** (1 - n)

    mid = sum(symbols) / n
    spread = sum((s - mid) ** 2 for s in symbols)
    r = sum((a - mid) * (b - mid) for a, b in zip(symbols, symbols[1:], strict=False)) / spread if spread else 1.0
    p_serial = 2 * normal_sf(abs(r + 1 / n) * math.sqrt(n))
    fisher = -2 * sum(math.log(max(1e-300, min(1.0, p))) for p in (p_chi, p_runs, p_serial))
    return chi2_sf(fisher, 6)


def text_p(core: str, size: int) -> float:
    """The p-value that a token's symbols are ordinary text rather than uniform over an alphabet of that size."""
    gain = {c: math.log(1 / size / p) for c, p in _TEXT.items()}
    mean = sum(p * gain[c] for c, p in _TEXT.items())
    var = sum(p * (gain[c] - mean) ** 2 for c, p in _TEXT.items())
    return normal_sf((sum(gain[c] for c in core) - len(core) * mean) / math.sqrt(var * len(core)))


def length_class(n: int) -> int:
    return bisect.bisect_right(CLASSES, n) - 1


def step_of(p: float) -> int:
    """The step of the grid that a p-value is in: all p-values of a step are at most 10 ** -(STEP * step)."""
    return min(LAST, int(-math.log10(max(p, 1e-300)) / STEP))


def thresholds(counts: dict[tuple[int, int], int], alpha: float) -> dict[int, int]:
    """Benjamini-Hochberg by class over (class, step) counts: the least step whose candidates are rejected; LAST + 1 if none are.

    A step's p-values count as its upper end, so the grid can only reject fewer.
    """
    out = {}
    for c in {c for c, _ in counts}:
        total, so_far, out[c] = sum(n for (k, _), n in counts.items() if k == c), 0, LAST + 1
        for step in range(LAST, -1, -1):
            so_far += counts.get((c, step), 0)
            if so_far and 10 ** -(STEP * step) <= alpha * so_far / total:
                out[c] = step
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The spans of the plain kinds."""
    found = []
    low = text.lower()
    if any(k in low for k in _NAMES):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def tested(token: str) -> tuple[float, float] | None:
    """The battery's and the text test's p-value of a token; None if it is no candidate."""
    known = infer_encoding(token)
    if known is None:
        return None
    core, order = token.rstrip("="), known[1]
    return randomness([order[c] for c in core], len(order)), text_p(core, len(order))


def candidates(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, int, float, float]]:
    """(start, end, attempt, battery p, text p) of tokens outside the taken spans: whole tokens first, then their parts."""
    for m in _LONG.finditer(text):
        if any(s < m.end() and m.start() < e for s, e, _ in taken):
            continue
        done = set()
        pieces = [(m.start(), m.end(), 0)]
        pieces += [(m.start() + x.start(), m.start() + x.end(), k) for k, part in enumerate(_PARTS, 1) for x in part.finditer(m[0])]
        for s, e, attempt in pieces:
            if (s, e) not in done and (p := tested(text[s:e])):
                done.add((s, e))
                yield s, e, attempt, *p


def spans_of(text: str | None, rejected: dict[int, int], q: float = 0.001) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a text, by start and then kind; rejected comes from thresholds()."""
    if not text:
        return []
    found = base_spans(text)
    random: list[tuple[int, int, str]] = []
    for s, e, _, p, by_text in candidates(text, found):
        kept = step_of(p) < rejected.get(length_class(e - s), LAST + 1)
        if kept and by_text <= q and not any(a < e and s < b for a, b, _ in random):
            random.append((s, e, "random"))
    return sorted(found + random, key=lambda x: (x[0], KINDS.index(x[2])))


def learn(df: DataFrame, text_col: str = "text", alpha: float = 0.01) -> dict[int, int]:
    """The thresholds of all candidates of a table; at most a row for each class and step comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("secrets")
        n: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                if text := t.as_py():
                    n.update((length_class(e - s), step_of(p)) for s, e, _, p, _ in candidates(text, base_spans(text)))
        rows = sorted(n.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.int32()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.int64())], ["c", "step", "n"])

    counted = df.select(F.col(text_col).alias("text")).mapInArrow(run, "c int, step int, n long").groupBy("c", "step").agg(F.sum("n").alias("n"))
    return thresholds({(r["c"], r["step"]): r["n"] for r in counted.collect()}, alpha)


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans, an array of (kind, start, end)."""
    rejected = learn(df, text_col)
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in spans_of(t.as_py(), rejected)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["id", "spans"])

    out = base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, spans {_SPANS}")
    return out.withColumnRenamed("id", id_col)


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The table with every span of the text replaced by mask; overlapping spans become one. Nulls stay."""
    rejected = learn(df, text_col)

    k = df.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        spans = spans_of(text, rejected)
        if not spans:
            return text
        out, at = [], 0
        for s, e, _ in spans:
            if s >= at:
                out += [text[at:s], mask]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(k, b.schema.field(k), pa.array([clean(t.as_py()) for t in b.column(k)], b.schema.field(k).type))

    names = [f"c{j}" for j in range(len(df.columns))]  # by position, so no names can clash
    out = df.toDF(*names).mapInArrow(run, StructType([StructField(c, x.dataType) for c, x in zip(names, df.schema, strict=True)]))
    return out.toDF(*df.columns)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256 and spans, from scan()'s spans."""
    of = lambda *kinds: F.filter("_s", lambda x: x["kind"].isin(*kinds))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(of(kind)).cast("long").alias(f"n_{kind}")
    base: Column = of("assign", "access", "hex")
    s = scan(df, id_col, text_col).withColumnRenamed("spans", "_s")
    return s.select(id_col, n("assign"), n("access"), n("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("_s")).alias("spans"))
