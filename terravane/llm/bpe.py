"""Byte-level BPE with the ranks of a vocabulary file: encoding by recursive queries, decoding by ordered aggregation.

Each task opens an in-memory DuckDB with the merge table (left and right id in one key, merged id). A text is cut by the
vocabulary's pattern; each piece that is a token as a whole is that token, and for the others a recursive query runs over
token-position rows: a row carries the rank of the merge with its right neighbour, each word's leftmost pair of minimum
rank is contracted, rows beside a merge look up their rank anew, and words without a pair leave as finished, until none is
left. Decoding joins token rows with the vocabulary and aggregates them in order of position.

Two rules keep the query's cost near the number of bytes, for pieces of any length, and change no result: pieces are cut into
words where no vocabulary entry can cross (the two bytes there are no entry, and no entry has them with the byte before or
after), and a round contracts further pairs of the minimum rank with the leftmost one where no entry of a lower rank has the
merged token as a part. Equal words run through the query once.

Pieces repeat, so a worker remembers the tokens of two generations of MEMORY pieces; the rest of what a task holds is given
back when it ends. Texts are worked off in runs of RUN pieces and token ranges of RANGE, also inside one text, so memory follows neither
the partition nor the number of a text's pieces. The merge table is a function of the vocabulary, which is sent once. One scan, no
shuffle, and a lost executor's tasks run again from the input.

Defined results: null and empty texts have no tokens and decode to no bytes. Special-token strings in a text are ordinary
text. Repeated rows are encoded alike. Only id and text are read; an empty table gives an empty result. One word that no rule
cuts is held in the query as a whole, some hundred bytes a byte.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, kept_by

MEMORY = 250_000
RUN = 400_000
RANGE = 100_000
QUERY_BYTES = 400_000
LONG_TEXT = 2_000_000
NO_TOKEN = 1 << 19
STRETCH = 1 << 20

#: k of a row is (merged id, place, whether a round may contract the pair beside the leftmost one, bytes of the merged token),
#: so a word's minimum is its leftmost pair of minimum rank. h, nxt: where a contracted pair begins and ends.
ENCODE_SQL = """
WITH RECURSIVE s(g, id, len, k, done) AS (
  SELECT g, id, 1::BIGINT, m.k | ((g & 2147483647) << 12), false FROM start LEFT JOIN merges m ON m.lr = (id << 20 | nid)
  UNION ALL
  (WITH live AS (SELECT g, id, len, k FROM s WHERE NOT done),
   best AS (SELECT g >> 31 AS w, min(k) AS b FROM live GROUP BY 1),
   pair AS MATERIALIZED (SELECT w, g, len, k, b FROM live JOIN best ON w = g >> 31 WHERE k >> 43 = b >> 43 AND (k = b OR (k >> 11) & 1 = 1)),
   more AS (SELECT w, g, len, k, lag(g + len) OVER (PARTITION BY w ORDER BY g) AS before FROM pair WHERE w IN (SELECT w FROM pair WHERE k <> b)),
   chain AS (SELECT *, sum(CASE WHEN before = g THEN 0 ELSE 1 END) OVER (PARTITION BY w ORDER BY g) AS c FROM more),
   hit AS MATERIALIZED (
     SELECT g AS h, g + len AS nxt, k >> 43 AS m, k & 2047 AS mlen FROM pair WHERE w NOT IN (SELECT w FROM pair WHERE k <> b)
     UNION ALL SELECT g, g + len, k >> 43, k & 2047 FROM (SELECT * FROM chain QUALIFY row_number() OVER (PARTITION BY w, c ORDER BY g) % 2 = 1)),
   after AS MATERIALIZED (
     SELECT g, coalesce(x.m, id) AS id, coalesce(x.mlen, len) AS len, k, x.h IS NOT NULL OR y.h IS NOT NULL AS beside, b IS NULL AS done
     FROM live JOIN best ON w = g >> 31 LEFT JOIN hit x ON x.h = g LEFT JOIN hit y ON y.h = g + len ANTI JOIN hit z ON z.nxt = g)
   SELECT g, id, len, k, done FROM after WHERE NOT beside
   UNION ALL
   SELECT a.g, a.id, a.len, m.k | ((a.g & 2147483647) << 12), false
   FROM after a LEFT JOIN after r ON r.g = a.g + a.len LEFT JOIN merges m ON m.lr = (a.id << 20 | r.id) WHERE a.beside))
SELECT g, id FROM s WHERE done ORDER BY g
"""
#: A token's bytes as the characters of the same numbers, so that text aggregation keeps them.
DECODE_SQL = "SELECT part, string_agg(tok, '' ORDER BY pos) AS text FROM tokens JOIN vocab USING (id) GROUP BY part ORDER BY part"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """lr, the two ids of a pair, and k without its place."""
    rows = [(ranks[t[:i]], ranks[t[i:]], r, len(t)) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    left, right, merged, size = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    lowest = np.full(max(ranks.values(), default=0) + 1, 1 << 40)  # the lowest rank of which a token is a part
    np.minimum.at(lowest, left, merged)
    np.minimum.at(lowest, right, merged)
    return pa.table({"lr": left << 20 | right, "k": merged << 43 | (lowest[merged] > merged).astype(np.int64) << 11 | size})


def neighbour_tables(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of bytes are entries, and which triples stand in entries (as bits)."""
    pairs, triples = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
    for t in ranks:
        b = np.frombuffer(t, np.uint8).astype(np.int32)
        if len(t) == 2:
            pairs[b[0] << 8 | b[1]] = True
        triples[b[:-2] << 16 | b[1:-1] << 8 | b[2:]] = True
    return pairs, np.packbits(triples, bitorder="little")


class Splitter:
    """All matches of the vocabulary's pattern; with the standard library's faster engine where it agrees on all of a text's characters."""

    # The pattern in the standard library's terms: letters are [^\W\d_], and what is neither letter nor number [^\s\w] or _
    _SAME = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    _ODD = re.compile("[\x1c-\x1f\x85²³¹¼-¾ɐ-\U0010ffff]")
    _STANDARD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, pattern: str) -> None:
        self.slow, self.plain = regex.compile(pattern), pattern == self._STANDARD

    def __call__(self, text: str) -> Iterator[list[str]]:
        engine = self._SAME if self.plain and not self._ODD.search(text) else self.slow
        if len(text) <= LONG_TEXT:
            yield engine.findall(text)
            return
        found = engine.finditer(text)
        while part := [m[0] for m in islice(found, RUN)]:
            yield part


class Codec:
    """A task's vocabulary, database and memory of pieces."""

    def __init__(self, ranks: dict[bytes, int], merges: pa.Table, neighbours: tuple[np.ndarray, np.ndarray], pattern: str) -> None:
        self.ranks, self.split = ranks, Splitter(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "2GB", "temp_directory": ""})
        vocab = pa.table({"id": pa.array(ranks.values(), pa.int64()), "tok": pa.array([t.decode("latin-1") for t in ranks], pa.string())})
        for name, rows in (("merges", merges), ("vocab", vocab)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs, self.triples = neighbours
        self.old: tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray] = self._empty()
        self.index, self.ids, self.start, self.length = self._empty()

    @staticmethod
    def _empty() -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
        return {}, np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def memory(self) -> tuple:
        return self.old, (self.index, self.ids, self.start, self.length)

    @memory.setter
    def memory(self, kept: tuple) -> None:
        self.old, (self.index, self.ids, self.start, self.length) = kept

    def word_starts(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where words begin in the bytes of pieces that end at ends."""
        start = np.zeros(len(raw) + 1, bool)
        for a in range(0, len(raw), STRETCH):
            b = min(len(raw), a + STRETCH)
            part = raw[max(0, a - 2) : b + 2].astype(np.int32)
            two = self.pairs[part[:-1] << 8 | part[1:]]
            if len(part) > 2:
                code = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
                three = (self.triples[code >> 3] >> (code & 7) & 1).astype(bool)
                two[1:] |= three
                two[:-1] |= three
            at = max(0, a - 2) + 1  # the place that two[0] is about
            first, last = max(at, a), min(b, at + len(two))
            start[first:last] = ~two[first - at : last - at]
        start[0] = True
        start[ends] = True
        return np.flatnonzero(start)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pieces, one after the other, and how many each has, by the recursive query."""
        joined = b"".join(pieces)
        ends = np.cumsum([len(p) for p in pieces])
        cut = self.word_starts(np.frombuffer(joined, np.uint8), ends)
        number: dict[bytes, int] = {}
        at = cut.tolist()
        which = np.fromiter((number.setdefault(joined[a:b], len(number)) for a, b in zip(at, at[1:], strict=False)), np.int64, len(at) - 1)
        words, ids, count = list(number), [], []
        sizes = np.cumsum([len(w) for w in words])
        edges = np.unique(np.concatenate([[0], np.searchsorted(sizes, np.arange(QUERY_BYTES, sizes[-1], QUERY_BYTES)) + 1, [len(words)]]))
        for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            got, n = self.contract(words[a:b])
            ids.append(got)
            count.append(n)
        n = np.concatenate(count)
        first = np.searchsorted(cut, np.concatenate([[0], ends[:-1]]))
        return _ranges(np.concatenate(ids), (np.cumsum(n) - n)[which], n[which]), np.add.reduceat(n[which], first)

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of words that nothing crosses, in one query."""
        lens = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(lens)
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        following = np.append(ids[1:], NO_TOKEN)
        following[ends - 1] = NO_TOKEN
        w = np.repeat(np.arange(len(words), dtype=np.int64), lens)
        self.db.register("start", pa.table({"g": w << 31 | np.arange(len(ids)) - np.repeat(ends - lens, lens), "id": ids, "nid": following}))
        out = self.db.execute(ENCODE_SQL).fetchnumpy()
        self.db.unregister("start")
        return np.asarray(out["id"], dtype=np.uint32), np.bincount(np.asarray(out["g"], dtype=np.int64) >> 31, minlength=len(words))

    def learn(self, pieces: list[str]) -> None:
        """Work out and remember the tokens of pieces that are not in memory."""
        raw = [p.encode() for p in pieces]
        whole = [self.ranks.get(b) for b in raw]
        order = [k for k, r in enumerate(whole) if r is not None]
        ids = [np.array([whole[k] for k in order], dtype=np.uint32)]
        lens = [np.ones(len(order), dtype=np.int64)]
        part: list[int] = []
        size = 0
        for k, r in enumerate(whole):
            if r is None:
                part.append(k)
                size += len(raw[k])
            if part and (size >= QUERY_BYTES or k == len(whole) - 1):
                got, n = self.merge([raw[i] for i in part])
                ids.append(got)
                lens.append(n)
                order += part
                part, size = [], 0
        self._remember([pieces[k] for k in order], np.concatenate(ids), np.concatenate(lens))

    def _remember(self, pieces: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        base = len(self.start)
        self.index.update(zip(pieces, range(base, base + len(pieces)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(lens) - lens])
        self.length = np.concatenate([self.length, lens])
        self.ids = np.concatenate([self.ids, ids])

    def _coded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pieces, one after the other, and how many each has."""
        new = set(pieces).difference(self.index)
        known, ids, start, length = self.old
        again = [p for p in new if p in known]
        if again:
            at = np.array([known[p] for p in again])
            self._remember(again, _ranges(ids, start[at], length[at]), length[at])
            new.difference_update(again)
        if new:
            self.learn(list(new))
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        out = _ranges(self.ids, self.start[at], self.length[at]), self.length[at]
        if len(self.index) > MEMORY:
            self.old = self.index, self.ids, self.start, self.length
            self.index, self.ids, self.start, self.length = self._empty()
        return out

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        out: list[list[np.ndarray]] = []
        pieces: list[str] = []
        owner: list[tuple[int, int]] = []

        def work_off() -> None:
            if pieces:
                ids, lens = self._coded(pieces)
                cut = np.concatenate([[0], np.cumsum(lens)])[np.cumsum([0, *[n for _, n in owner]])]
                for (d, _), a, b in zip(owner, cut, cut[1:], strict=False):
                    out[d].append(ids[a:b])
            pieces.clear()
            owner.clear()

        for d, t in enumerate(texts):
            out.append([])
            for found in self.split(t):
                pieces += found
                owner.append((d, len(found)))
                if len(pieces) >= RUN:
                    work_off()
        work_off()
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.uint32), *x]) for x in out]

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of a list of ids, range by range."""
        return (b for _, b in self.decoded([ids]))

    def decoded(self, docs: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        """(which list, bytes of its next range of ids) of lists of ids, by ordered aggregation of token rows."""
        owner, parts, size = [], [], 0
        for d, ids in enumerate(docs):
            for at in range(0, len(ids), RANGE):
                owner.append(d)
                parts.append(ids[at : at + RANGE])
                size += len(parts[-1])
                if size >= RUN:
                    yield from self._aggregate(owner, parts)
                    owner, parts, size = [], [], 0
        if parts:
            yield from self._aggregate(owner, parts)

    def _aggregate(self, owner: list[int], parts: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        lens = np.array([len(p) for p in parts], dtype=np.int64)
        ids = np.concatenate(parts).astype(np.int64)
        self.db.register("tokens", pa.table({"part": np.repeat(np.arange(len(parts)), lens), "pos": np.arange(len(ids)), "id": ids}))
        found = self.db.execute(DECODE_SQL).fetchall()
        self.db.unregister("tokens")
        return ((owner[part], text.encode("latin-1")) for part, text in found)


def _ranges(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each pair, one after the other."""
    if not len(start):
        return values[:0]
    ends = np.cumsum(length)
    return values[np.repeat(start - (ends - length), length) + np.arange(ends[-1])]


@contextmanager
def codec(sent, key: tuple) -> Iterator[Codec]:  # noqa: ANN001
    """A codec for one task. Its database ends with the task; the memory of pieces stays with the worker, for one vocabulary."""
    kept = kept_by("bpe")
    c = Codec(*sent.value, key[-1])
    if key in kept:
        c.memory = kept[key]
    try:
        yield c
    finally:
        c.db.close()
        kept.clear()
        kept[key] = c.memory
        del c
        give_back()


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """A column's texts in lists of about LONG_TEXT characters."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t.as_py())
        size += len(part[-1])
        if size >= LONG_TEXT:
            yield part
            part, size = [], 0
    if part:
        yield part


def _vocabulary(df: DataFrame, path: str, pattern: str) -> tuple:
    """The ranks and the tables made of them for every executor, of a vocabulary file's fixed size, and what tells vocabularies apart."""
    ranks = load_ranks(path)
    digest = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((ranks, merge_table(ranks), neighbour_tables(ranks))), (digest, pattern)


def _mapped(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, fields: str, make) -> DataFrame:  # noqa: ANN001
    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sent, key = _vocabulary(df, path, pattern)
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(sent, key) as c:
            for b in batches:
                at = 0
                for part in _slices(b.column(1)):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), *make(c, part)], ["id", *names])
                    at += len(part)

    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, {fields}").withColumnRenamed("id", id_col)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids, the token ids of the whole text."""

    def make(c: Codec, part: list[str]) -> list[pa.Array]:
        return [pa.array([x.astype(np.int32) for x in c.encode(part)], pa.list_(pa.int32()))]

    return _mapped(df, id_col, text_col, path, pattern, "ids array<int>", make)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded, the bytes of the ids; null ids give no bytes."""
    base = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    sent, key = _vocabulary(df, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(sent, key) as c:
            for b in batches:
                out = [b"".join(c.decode(np.array(x.as_py() or [], dtype=np.int64))) for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "decoded"])

    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, decoded binary").withColumnRenamed("id", id_col)


def digest(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of little-endian 32-bit ids) and decoded_sha256 (of the decoded bytes)."""

    def make(c: Codec, part: list[str]) -> list[pa.Array]:
        ids = c.encode(part)
        sums = [hashlib.sha256() for _ in ids]
        for d, raw in c.decoded(ids):
            sums[d].update(raw)
        coded = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array(coded), pa.array([s.hexdigest() for s in sums])]

    return _mapped(df, id_col, text_col, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
