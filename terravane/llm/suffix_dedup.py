"""Removal of repeated passages: every byte that a 50-byte string covers which a document with a smaller id has too.

The strings that start in a document are prefixes of its suffixes, so equal strings are neighbours in the suffix order, and a string's
first document is the least id among its equal neighbours.
Suffixes are ordered in parts, each small enough for a task, by deep-shallow sorting: a multikey quicksort on 8-byte symbols, one
after the other within the runs that agree so far, down to a shallow depth, then blind tries for the runs that still share a
prefix: a node looks only at the first symbol in which a member differs from the run's first, branches there, and skips what all share.

Which suffixes meet in a part follows from their text. Each 50-byte window has a key, the least hash of the 20-byte strings
inside it, so equal windows have equal keys, and neighbouring windows mostly share one. Texts are dealt into shards (equal texts into one);
a shard learns which of its keys another document has as well, orders the windows of only these, settles repeats
within itself, and sends the windows of the first document of each content to the part of its key, as runs of neighbouring windows. So a passage that a
third of all documents have reaches a part once a shard. Parts answer which runs occur in a document with a smaller id. Every
decision is an exact comparison of bytes; hashes only decide where windows meet.

Defined results: null is the empty text. A null id counts as greater than all others. Rows that share an id do not remove from each
other. Texts shorter than 50 bytes keep all bytes. Rows keep their number. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards

WINDOW, GRAM, SYMBOL = 50, 20, 8
SHALLOW = 16
#: Distinct keys that a byte of text brings, about: two for each stretch of WINDOW - GRAM + 2 bytes.
KEYS_A_BYTE = 2 / (WINDOW - GRAM + 2)
PART_KEYS = 200_000
#: Bytes whose keys are computed at once; windows that are ordered at once.
STRETCH = 1_000_000
ORDERED = 300_000

_C = np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_C), n, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_keys(buf: np.ndarray) -> np.ndarray:
    """The key of each 50-byte window of buf (at least 50 bytes)."""
    h = {1: buf.astype(np.uint64) + np.uint64(1)}
    for n in (2, 4, 8, 16):
        half = h[n // 2]
        h[n] = half[: -(n // 2)] * _power(n // 2) + half[n // 2 :]
    k = len(buf) - GRAM + 1
    least = _mix(h[16][:k] * _power(4) + h[4][16 : 16 + k])
    width, span = WINDOW - GRAM + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    # least hashes crowd near zero; mixed once more they are spread evenly, and equal ones stay equal
    return _mix(np.minimum(least[:-rest], least[rest:]) if rest else least)


class Shard:
    """A shard's distinct texts, one after the other, and the keys of their windows."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        self.rows = shards.distinct_texts(pdf)
        raw = [t.encode() for t in self.rows["text"]]
        self.ids = self.rows["id"].to_numpy(dtype=np.int64)
        self.lens = np.array([len(r) for r in raw], dtype=np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.buf = np.frombuffer(b"".join(raw), np.uint8)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of neighbouring windows of a document with one key: key, document, first window's place and how many."""
        parts = [[], [], [], []]
        at, n = 0, len(self.lens)
        while at < n:
            end = at + 1
            while end < n and self.starts[end] + self.lens[end] - self.starts[at] <= STRETCH:
                end += 1
            first, last = int(self.starts[at]), int(self.starts[end - 1] + self.lens[end - 1])
            if last - first >= WINDOW:
                key = window_keys(self.buf[first:last])
                doc = np.repeat(np.arange(at, end), self.lens[at:end])[: len(key)]
                place = np.arange(first, first + len(key))
                good = place + WINDOW <= (self.starts + self.lens)[doc]
                key, doc, place = key[good], doc[good], place[good]
                if len(key):
                    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
                    for store, v in zip(parts, (key[new], doc[new], place[new], np.diff(np.append(new, len(key)))), strict=True):
                        store.append(v)
            at = end
        empty = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        return tuple(np.concatenate(p) if p else e for p, e in zip(parts, empty, strict=True))


def symbols(buf: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The 8 bytes at a depth of each window as one number whose order is theirs; past the window's end bytes are 0."""
    n = min(SYMBOL, WINDOW - depth)
    out = np.zeros(len(places), np.uint64)
    for j in range(n):
        out = (out << np.uint64(8)) | buf[places + (depth + j)]
    return out << np.uint64(8 * (SYMBOL - n))


def _sorted(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by group (which only rises) and key, and where in it a new (group, key) begins."""
    one = not len(group) or group[0] == group[-1]
    order = np.argsort(key, kind="quicksort") if one else np.lexsort((key, group))
    g, k = group[order], key[order]
    return order, np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])


def deep_shallow(buf: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of windows by deep-shallow sorting, and for each place in it whether the window equals its left neighbour.

    A group is a run of slots whose windows agree so far; sorting moves windows within their group's slots, and a window
    alone in its group has its slot for good.
    """
    final, same = np.empty(len(places), np.int64), np.zeros(len(places), bool)
    live = slot = np.arange(len(places))
    group = np.zeros(len(places), np.int64)

    def settle(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Windows in their new order; those alone in their group are placed. Which are not."""
        nonlocal live, slot, group
        live, number = live[order], np.cumsum(new) - 1
        count = np.bincount(number)
        many = count[number] > 1
        final[slot[~many]] = live[~many]
        live, slot, group = live[many], slot[many], number[many]
        return many

    # multikey quicksort: one symbol after the other, within groups that agree so far
    depth = 0
    while depth < SHALLOW and len(live):
        settle(*_sorted(group, symbols(buf, places[live], depth)))
        depth += SYMBOL
    # blind tries: the group's first member leads; the first symbol in which any member differs from it is the node's branch
    level = np.full(len(live), depth)
    while len(live):
        lead = np.concatenate([[True], group[1:] != group[:-1]])
        head = np.flatnonzero(lead)
        which = np.cumsum(lead) - 1
        branch = np.full(len(head), WINDOW)
        for d in range(SHALLOW, WINDOW, SYMBOL):
            look = (level[head] <= d) & (branch == WINDOW)
            if not look.any():
                continue
            at = np.flatnonzero(look[which])
            s = symbols(buf, places[live[at]], d)
            lead_s = symbols(buf, places[live[head[which[at]]]], d)
            differs = np.zeros(len(head), bool)
            differs[which[at[s != lead_s]]] = True
            branch[differs] = d
        equal = (branch == WINDOW)[which]  # no branch: the members are equal, as far as windows go
        final[slot[equal]] = live[equal]
        same[slot[equal & ~lead]] = True
        live, slot, group, at_branch = live[~equal], slot[~equal], which[~equal], branch[which][~equal]
        if not len(live):
            break
        key = np.zeros(len(live), np.uint64)
        for d in np.unique(at_branch).tolist():
            m = at_branch == d
            key[m] = symbols(buf, places[live[m]], d)
        order, new = _sorted(group, key)
        at_branch = at_branch[order]
        level = at_branch[settle(order, new)] + SYMBOL
    return final, same


def first_of(order: np.ndarray, same: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window the least id among the neighbours in suffix order that equal it."""
    out = np.empty(len(order), np.int64)
    if len(order):
        starts = np.flatnonzero(~same)
        out[order] = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.append(starts, len(order))))
    return out


def key_batches(key: np.ndarray, count: np.ndarray) -> Iterator[np.ndarray]:
    """Runs in batches of about ORDERED windows, never dividing a key: equal windows have equal keys, so batches don't need each other."""
    order = np.argsort(key, kind="stable")
    last = np.flatnonzero(np.append(key[order][1:] != key[order][:-1], True)) + 1 if len(key) else np.zeros(0, np.int64)
    total = np.cumsum(count[order])
    at = 0
    while at < len(order):
        before = total[at - 1] if at else 0
        end = int(np.searchsorted(total, before + ORDERED, side="right"))
        end = int(last[np.searchsorted(last, max(end, at + 1))])
        yield order[at:end]
        at = end


_ZSTD = zstandard.ZstdCompressor(level=1)


def _pack(*arrays: np.ndarray) -> bytes:
    body = [np.ascontiguousarray(a) for a in arrays]
    head = np.array([len(body), *[b.nbytes for b in body]], dtype="<u8").tobytes()
    return _ZSTD.compress(head + b"".join(b.tobytes() for b in body))


def _unpack(block: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    sizes = np.frombuffer(raw, "<u8", len(kinds), 8)
    out, at = [], 8 + 8 * len(kinds)
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _as_runs(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows, sorted by place, as (document, first place, how many)."""
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])])) if len(place) else np.zeros(0, np.int64)
    return doc[new], place[new], np.diff(np.append(new, len(place)))


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


#: kind 0: windows to remove (document, place, count); kind 1: runs of windows to settle in a part, with their bytes.
MESSAGES = "part long, shard long, kind int, block binary"
VERDICTS = "shard long, block binary"
RESULT = "key binary, id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string"

COLUMNS = ["key", "id", "n_bytes", "spans", "kept_sha256"]


def _remove(shard: int, part: int, doc: np.ndarray, place: np.ndarray, count: np.ndarray) -> tuple:
    return part, shard, 0, _pack(doc.astype("<i4"), place.astype("<i4"), count.astype("<i4"))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, spans (start and end of each maximal removed run, in bytes) and kept_sha256 of the bytes that stay."""
    total = shards.text_bytes(df, text_col)
    n_shards, _ = shards.sizes(df.sparkSession, total, KEYS_A_BYTE)
    n_parts = max(1, int(total * KEYS_A_BYTE / PART_KEYS) + 1)
    dealt = shards.deal(df, n_shards, id_col, text_col)

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        key, doc, _, _ = Shard(pdf).runs()
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(key))[: len(new)] - 1
        return shards.key_blocks(key[new], 1 + (doc[new] != doc[last]), int(pdf["shard"].iloc[0]), n_parts)

    def settle(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"part": pd.Series(dtype="int64"), "shard": pd.Series(dtype="int64"), "kind": pd.Series(dtype="int32"), "block": pd.Series(dtype=object)})
        if not len(pdf) or not len(answers):
            return out
        s, number = Shard(pdf), int(pdf["shard"].iloc[0])
        key, doc, place, count = s.runs()
        known = np.sort(np.concatenate([shards.unpack(k) for k in answers["keys"]]))
        hit = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
        key, doc, place, count = key[hit], doc[hit], place[hit], count[hit]
        out_docs, out_places, left = [], [], []
        for o in key_batches(key, count):
            places, docs = _expand(place[o], count[o]), np.repeat(doc[o], count[o])
            ids = s.ids[docs]
            gone = ids > first_of(*deep_shallow(s.buf, places), ids)
            out_docs.append(docs[gone])
            out_places.append(places[gone])
            # what stays of each content is in the document that has it first, perhaps several times
            left.append((places[~gone], docs[~gone], np.repeat(key[o], count[o])[~gone]))
        rows = []
        if sum(map(len, out_docs)):
            docs, places = np.concatenate(out_docs), np.concatenate(out_places)
            by = np.argsort(places)
            rows.append(_remove(number, number % n_parts, *_as_runs(docs[by], (places - s.starts[docs])[by])))
        places, docs, keys = (np.concatenate([x[j] for x in left]) if left else np.zeros(0, np.int64) for j in range(3))
        by = np.argsort(places)
        places, docs, keys = places[by], docs[by], keys[by]
        if not len(places):
            return pd.DataFrame(rows, columns=["part", "shard", "kind", "block"])
        new = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1] + 1) | (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])]))
        n = np.diff(np.append(new, len(places)))
        doc, place, key, part = docs[new], places[new], keys[new], shards.bucket_of(keys[new], n_parts).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            o = order[a:b]
            text = s.buf[_expand(place[o], n[o] + WINDOW - 1)]
            rows.append((int(part[o[0]]), number, 1, _pack(doc[o].astype("<i4"), (place[o] - s.starts[doc[o]]).astype("<i4"), n[o].astype("<i4"), s.ids[doc[o]], key[o].astype("<u8"), text)))
        return pd.DataFrame(rows, columns=["part", "shard", "kind", "block"])

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(r.shard), r.block) for r in pdf.itertuples() if r.kind == 0]
        runs = [(int(r.shard), *_unpack(r.block, "<i4", "<i4", "<i4", "<i8", "<u8", "u1")) for r in pdf.itertuples() if r.kind == 1]
        if len(runs) < 2:
            return pd.DataFrame(rows, columns=["shard", "block"])
        shard = np.repeat([r[0] for r in runs], [len(r[1]) for r in runs])
        doc, place, n, ids = (np.concatenate([r[j] for r in runs]).astype(np.int64) for j in range(1, 5))
        key, buf = np.concatenate([r[5] for r in runs]), np.concatenate([r[6] for r in runs])
        size = n + WINDOW - 1
        start = np.cumsum(size) - size
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in key_batches(key, n):
            run, places = np.repeat(b, n[b]), _expand(start[b], n[b])
            gone = ids[run] > first_of(*deep_shallow(buf, places), ids[run])
            run, places = run[gone], places[gone]
            found.append((shard[run], doc[run], place[run] + places - start[run]))
        owner, d, p = (np.concatenate([f[j] for f in found]) for j in range(3))
        by = np.lexsort((p, d, owner))
        owner, d, p = owner[by], d[by], p[by]
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(owner)), strict=True):
            rows.append((int(owner[a]), _remove(0, 0, *_as_runs(d[a:b], p[a:b]))[3]))
        return pd.DataFrame(rows, columns=["shard", "block"])

    def finish(pdf: pd.DataFrame, verdicts: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=COLUMNS)
        s = Shard(pdf)
        edge = np.zeros(len(s.buf) + 1, np.int32)
        for block in verdicts["block"]:
            doc, place, count = (a.astype(np.int64) for a in _unpack(block, "<i4", "<i4", "<i4"))
            first = s.starts[doc] + place
            np.add.at(edge, first, 1)
            np.add.at(edge, first + count + WINDOW - 1, -1)
        cover = np.cumsum(edge[:-1]) > 0
        rows = []
        for key, doc, a, n in zip(s.rows["key"], s.ids.tolist(), s.starts.tolist(), s.lens.tolist(), strict=True):
            c = cover[a : a + n]
            turns = np.flatnonzero(np.diff(c.view(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
            rows.append((key, doc, n, [{"start": x, "end": y} for x, y in turns], hashlib.sha256(s.buf[a : a + n][~c].tobytes()).hexdigest()))
        return pd.DataFrame(rows, columns=COLUMNS)

    grouped = dealt.groupBy("shard")
    answers = shards.shared(dealt, blocks)
    messages = grouped.cogroup(answers.groupBy("shard")).applyInPandas(settle, MESSAGES)
    verdicts = messages.groupBy("part").applyInPandas(judge, VERDICTS)
    done = dealt.groupBy("shard").cogroup(verdicts.groupBy("shard")).applyInPandas(finish, RESULT)
    docs = df.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("_k"))
    out = docs.join(done, F.col("_k") == F.col("key"))
    # a copy of a text whose first document has a smaller id loses everything, if it is long enough to hold a window
    whole = (F.coalesce(F.col("_id").cast("long"), F.lit((1 << 63) - 1)) > F.col("id")) & (F.col("n_bytes") >= WINDOW)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return out.select(
        F.col("_id").alias(id_col), "n_bytes", F.when(whole, everything).otherwise(F.col("spans")).alias("spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def kept_text(text: bytes, spans: list) -> bytes:
    """The bytes of a text that its spans leave."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]])


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256, from repeats()."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return repeats(df, id_col, text_col).select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def brute_force(rows: list[tuple[int, str | None]]) -> Iterator[tuple[int, int, int, int, str]]:
    """The contract's result by a dictionary of all windows; for tests."""
    first: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - WINDOW + 1):
            w = b[s : s + WINDOW]
            first[w] = min(i, first.get(w, i))
    for i, b in data:
        cover = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - WINDOW + 1):
            if first[b[s : s + WINDOW]] < i:
                cover[s : s + WINDOW] = True
        c = cover[:-1]
        spans = int(np.count_nonzero(c[1:] & ~c[:-1])) + int(len(c) > 0 and bool(c[0]))
        yield i, len(b), int(c.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~c].tobytes()).hexdigest()
