"""Jaccard join of word n-gram sets with prefix trees, and the classes that its links make.

A document's set is its distinct 5-word shingles (as 64-bit hashes of the lower-cased words). Two sets link when 100 * intersection >= 80 * union.

1. Texts are dealt into shards. Each shard asks which of the first hashes of its sets other sets have as well; a set of n
   needs ceil(0.8 n) hashes of any partner, so of its first n - ceil(0.8 n) + l hashes at least l are the partner's too.
   Sets with fewer shared ones have no partner and leave. Sets that are equal become one.
2. The rest learn how many sets have each of their hashes, drop what no other has, and are ordered globally by that
   number, most frequent first.
3. Prefix trees: sets that agree in a min-hash meet in blocks of bounded size. A block stores its ordered sets in a trie;
   a probe walks it with the overlap so far, which all sets below a node share, and turns back where that and the longest
   remainder below can't reach the least overlap that the smallest set below needs, or where a leaf is in the probe's class
   already. That finds nearly all links that matter.
4. The rest of the links, exactly: two linked sets share a hash among the rarest |set| - ceil(0.8 n) + 1 of each. Where such
   a hash has sets of different classes whose sizes and places allow a link at their rarest shared hash, the members
   outside its largest class probe trees of the others, in blocks of bounded size by hash and size band; where a hash
   has few sets, an equi-join on hash and band names the pairs first.

Classes are found by label propagation over Spark tables. A hash that a third of all rows have is one entry a shard in
1 and 2, is split into blocks in 3, and in 4 costs nothing where its sets are one class. No step collects links,
classes or sets to the driver; it only reads counts.

Defined results: null, empty and blank texts have the empty set, link with nothing and are their own class. A text of one to
four words has one shingle, the whole sequence. A null id counts as the greatest; a class without another id has a null component_id.
Rows keep their number; repeated rows are in one class. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shards
from .common import give_back, materialize

WORDS = 5
BLOCK_SETS = 400
#: Sets of a group that every one of its blocks has.
CENTERS = 4
#: Distinct first hashes that a byte of text brings, about.
KEYS_A_BYTE = 0.07
#: Hashes a shard of the second round has, about.
SHARD_HASHES = 700_000
STRETCH = 1_000_000
NO_ID = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def need(n):  # noqa: ANN001, ANN201
    """The least overlap that a set of n hashes has with any partner."""
    return (4 * n + 4) // 5


def linked(inter: int, a: int, b: int) -> bool:
    return 100 * inter >= 80 * (a + b - inter)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        p = np.ones(max(n, STRETCH + 1), np.uint64)
        p[1:] = np.uint64(base)
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for t in texts:
        raw = t.encode()
        if part and size + len(raw) > STRETCH:
            out += _sets(part)
            part, size = [], 0
        part.append(raw)
        size += len(raw) + 1
    return out + (_sets(part) if part else [])


def _sets(raw: list[bytes]) -> list[np.ndarray]:
    buf = _LOWER[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    space = _SPACE[buf]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(buf)), out=total[1:])
    word = _mix((total[end] - total[start]) * _power(_INVERSE, len(buf))[start] + (end - start).astype(np.uint64))
    at = np.cumsum([0] + [len(r) + 1 for r in raw])  # where each text begins, less the leading space
    doc = np.searchsorted(at, start - 1, side="right") - 1
    count = np.bincount(doc, minlength=len(raw))
    first = np.cumsum(count) - count
    # all runs of WORDS words; those that cross a text's end are left out
    n = max(0, len(word) - WORDS + 1)
    h = np.zeros(n, np.uint64)
    for j in range(WORDS):
        h = h * np.uint64(_BASE) + word[j : j + n]
    owner = doc[:n]
    whole = doc[WORDS - 1 : WORDS - 1 + n] == owner if n else np.zeros(0, bool)
    h, owner = _mix(h[whole]), owner[whole]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
    h, owner = h[keep], owner[keep]
    cut = np.searchsorted(owner, np.arange(len(raw) + 1))
    out = []
    for d in range(len(raw)):
        if 0 < count[d] < WORDS:
            x = np.uint64(count[d])
            for w in word[first[d] : first[d] + count[d]]:
                x = np.uint64((int(x) * _BASE + int(w)) % (1 << 64))
            out.append(_mix(np.array([x], np.uint64)))
        else:
            out.append(h[cut[d] : cut[d + 1]])
    return out


def first_hashes(n: int) -> tuple[int, int]:
    """How many first hashes of a set of n are asked about, and how many of these a set with a partner shares."""
    least = max(1, need(n) // 4)
    return n - need(n) + least, least


class Node:
    """A trie's node: the tokens that all sets below go on with, its children by first token, the sets that end here."""

    __slots__ = ("children", "ends", "least", "longest", "tokens")

    def __init__(self, tokens: np.ndarray) -> None:
        self.tokens, self.children, self.ends = tokens, {}, []
        self.least, self.longest = 1 << 60, 0  # the smallest whole size below; the most tokens below this node


class Trie:
    """Globally ordered sets, with common beginnings stored once. Tokens are numbers below size."""

    def __init__(self, size: int) -> None:
        self.root, self.size = Node(np.zeros(0, np.int64)), size

    def add(self, number: int, tokens: np.ndarray, whole: int) -> None:
        node, at = self.root, 0
        while True:
            node.least = min(node.least, whole)
            node.longest = max(node.longest, len(tokens) - at)
            if at == len(tokens):
                node.ends.append(number)
                return
            child = node.children.get(int(tokens[at]))
            if child is None:
                child = Node(tokens[at:])
                node.children[int(tokens[at])] = child
                child.least, child.ends = whole, [number]
                return
            k = min(len(child.tokens), len(tokens) - at)
            differ = np.flatnonzero(child.tokens[:k] != tokens[at : at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(child.tokens):  # split the child where the new set leaves it
                upper = Node(child.tokens[:same])
                upper.least, upper.longest = child.least, child.longest + len(child.tokens) - same
                child.tokens = child.tokens[same:]
                upper.children[int(child.tokens[0])] = child
                node.children[int(upper.tokens[0])] = upper
                child = upper
            at += same
            node = child

    def probe(self, tokens: np.ndarray, whole: int, skip) -> Iterator[tuple[int, int]]:  # noqa: ANN001
        """(set, overlap) of each stored set that can reach the overlap its link needs; skip(set) leaves sets out."""
        mask = np.zeros(self.size, bool)
        mask[tokens] = True
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if not node.children and len(node.ends) and all(skip(e) for e in node.ends):
                continue
            overlap += int(np.count_nonzero(mask[node.tokens]))
            for e in node.ends:
                yield e, overlap
            if node.children:
                least = -(-4 * (whole + node.least) // 9)  # 0.8 / 1.8 of both sizes
                if overlap + min(node.longest, len(tokens) - overlap) >= least:
                    # children that begin with one of the probe's tokens come off the stack first
                    stack += [(c, overlap) for t, c in node.children.items() if not mask[t]]
                    stack += [(c, overlap) for t, c in node.children.items() if mask[t]]


def block_links(sets: list[np.ndarray], wholes: list[int]) -> list[tuple[int, int]]:
    """Links that join a block's sets to the classes that all its links make."""
    numbered, size = _numbered(sets)
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    trie, out = Trie(size), []
    for i, tokens in enumerate(numbered):
        for j, overlap in trie.probe(tokens, wholes[i], lambda e, i=i: find(e) == find(i)):
            if find(i) != find(j) and linked(overlap, wholes[i], wholes[j]):
                parent[find(i)] = find(j)
                out.append((j, i))
        trie.add(i, tokens, wholes[i])
    return out


def _tokens(block: bytes) -> np.ndarray:
    return np.frombuffer(block, "<u8")


def _answers(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([shards.unpack(k) for k in pdf["keys"]]) if len(pdf) else np.zeros(0, np.uint64)
    counts = np.concatenate([shards.unpack_counts(c) for c in pdf["counts"]]) if len(pdf) else np.zeros(0, np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _lookup(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The count of each wanted key; 1 where it has none."""
    if not len(keys):
        return np.ones(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 1)


def _ask(parts: list[np.ndarray], shard: int, n_buckets: int) -> pd.DataFrame:
    keys, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return shards.key_blocks(keys, counts, shard, n_buckets)


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()


def sets_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key (of the text), id, n and sig of each distinct text, and tokens of those that may have a partner (written)."""
    n_shards, n_buckets = shards.sizes(df.sparkSession, shards.text_bytes(df, text_col), KEYS_A_BYTE)
    dealt = shards.deal(df, n_shards, id_col, text_col)

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        found = {_signature(s): s for s in shingle_sets(shards.distinct_texts(pdf)["text"].tolist())}
        # a set's first hashes are small; mixed once more they are spread evenly over the buckets
        return _ask([_mix(s[: first_hashes(len(s))[0]]) for s in found.values() if len(s)], int(pdf["shard"].iloc[0]), n_buckets)

    def settle(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        texts = shards.distinct_texts(pdf)
        keys, counts = _answers(answers)
        rows = []
        for key, doc, s in zip(texts["key"], texts["id"], shingle_sets(texts["text"].tolist()), strict=True):
            most, least = first_hashes(len(s)) if len(s) else (0, 1)
            shared = int(np.count_nonzero(_lookup(keys, counts, _mix(s[:most])) > 1))
            rows.append((key, int(doc), len(s), _signature(s), s.astype("<u8").tobytes() if shared >= least else None))
        give_back()
        return pd.DataFrame(rows, columns=["key", "id", "n", "sig", "tokens"])

    answers = shards.shared(dealt, blocks)
    out = dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(settle, "key binary, id long, n int, sig binary, tokens binary")
    return materialize(out)


def ordered(found: DataFrame) -> DataFrame:
    """sig, n, tokens (those that another set has, most frequent first, then by hash) and common (how frequent a set's hashes
    are on average) of the sets that may have a partner (written)."""
    sets = found.where(F.col("tokens").isNotNull()).groupBy("sig").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    total = int(found.where(F.col("tokens").isNotNull()).agg(F.sum("n")).first()[0] or 0)
    n_shards, n_buckets = max(1, total // SHARD_HASHES + 1), max(1, total // shards.BUCKET_KEYS + 1)
    dealt = sets.withColumn("shard", F.pmod(F.xxhash64("sig"), F.lit(n_shards)))

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        return _ask([_tokens(t) for t in pdf["tokens"]], int(pdf["shard"].iloc[0]), n_buckets)

    def settle(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _answers(answers)
        rows = []
        for sig, n, block in zip(pdf["sig"], pdf["n"], pdf["tokens"], strict=True):
            t = _tokens(block)
            c = _lookup(keys, counts, t)
            t, c = t[c > 1], c[c > 1]
            if len(t) >= need(int(n)):
                rows.append((sig, int(n), t[np.lexsort((t, -c))].tobytes(), float(np.log2(c).sum() / max(1, n))))
        give_back()
        return pd.DataFrame(rows, columns=["sig", "n", "tokens", "common"])

    answers = shards.shared(dealt, blocks)
    return materialize(dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(settle, "sig binary, n int, tokens binary, common double"))


def _min_hashes(sets: DataFrame, keys: int = 2) -> DataFrame:
    """sig and h: a set's least hash under each of some hash functions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [_tokens(x) for x in b.column(1).to_pylist()]
            for k in range(keys):
                h = [int(_mix(x + np.uint64(k + 1)).min().view(np.int64)) for x in t]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k] * len(h), pa.int32()), pa.array(h, pa.int64())], ["sig", "k", "h"])

    return sets.select("sig", "tokens").mapInArrow(run, "sig binary, k int, h long")


def _tree_links(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates("sig").sort_values(["common", "sig"], ascending=[False, True])
    sigs = pdf["sig"].tolist()
    found = block_links([_tokens(t) for t in pdf["tokens"]], [int(n) for n in pdf["n"]])
    return pd.DataFrame([(sigs[a], sigs[b]) for a, b in found], columns=["a", "b"])


def tree_links(sets: DataFrame) -> DataFrame:
    """Links found by the trees of sets that agree in a min-hash, in blocks of bounded size.

    A group of several blocks gives each of them its CENTERS, sets whose hashes are the most common: copies of one text are
    mostly nearer to it than to each other, so blocks of them meet there.
    """
    keys = materialize(_min_hashes(sets).join(sets.select(F.col("sig").alias("s2"), "common"), F.col("sig") == F.col("s2")).drop("s2"))
    part = F.pmod(F.xxhash64("sig"), F.lit(CENTERS))
    tops = [F.max(F.when(part == j, F.struct("common", "sig"))) for j in range(CENTERS)]
    groups = keys.groupBy("k", "h").agg(F.count("*").alias("m"), F.array_compact(F.array(*tops)).alias("tops")).where("m > 1")
    groups = materialize(groups.withColumn("blocks", F.ceil(F.col("m") / BLOCK_SETS)).withColumnsRenamed({"k": "k2", "h": "h2"}))
    met = keys.join(groups.select("k2", "h2", "blocks"), (F.col("k") == F.col("k2")) & (F.col("h") == F.col("h2")))
    placed = met.select(F.col("sig").alias("s2"), "k", "h", F.pmod(F.xxhash64("sig", "k"), F.col("blocks")).alias("block"))
    centers = groups.where("blocks > 1").select(F.explode("tops").alias("top"), F.col("k2").alias("k"), F.col("h2").alias("h"), "blocks")
    centers = centers.select(F.col("top.sig").alias("s2"), "k", "h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    return placed.unionByName(centers).join(sets, F.col("s2") == F.col("sig")).groupBy("k", "h", "block").applyInPandas(_tree_links, "a binary, b binary")


def classes(links: DataFrame) -> DataFrame:
    """v and root, the least member of its class, of all that have a link: label propagation with shortcuts (written)."""
    both = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("w")).union(links.select("b", "a")).distinct())
    label = materialize(both.groupBy("u").agg(F.min("w").alias("w")).select(F.col("u").alias("v"), F.least("u", "w").alias("root")))
    while True:
        near = both.join(label, F.col("w") == F.col("v")).groupBy("u").agg(F.min("root").alias("near"))
        lower = label.join(near, F.col("v") == F.col("u")).select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        step = materialize(lower)
        jump = step.select(F.col("v").alias("v2"), F.col("root").alias("root2"))
        label = materialize(step.join(jump, F.col("root") == F.col("v2")).select("v", F.least("root", "root2").alias("root"), (F.least("root", "root2") != F.col("old")).alias("moved")))
        if not label.where("moved").limit(1).count():
            return label.select("v", "root")
        label = label.select("v", "root")


def _heads(sets: DataFrame) -> DataFrame:
    """hsig and head: each set's rarest hashes, rarest first, as in _rare()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = []
            for whole, block in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                tokens = _tokens(block)
                heads.append(tokens[::-1][: len(tokens) - need(whole) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(heads, pa.list_(pa.int64()))], ["hsig", "head"])

    return sets.select("sig", "n", "tokens").mapInArrow(run, "hsig binary, head array<long>")


def _rare(sets: DataFrame) -> DataFrame:
    """t, sig, n, m, i and p: each set's rarest hashes, among which a partner has one too; i counts from the rarest, p is the hash before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, t, n, i, m, p = [], [], [], [], [], []
            for s, whole, block in zip(*[c.to_pylist() for c in b.columns], strict=True):
                tokens = _tokens(block)
                k = len(tokens) - need(whole) + 1
                t.append(tokens[::-1][:k].view(np.int64) if k else tokens[:0].view(np.int64))
                sig += [s] * len(t[-1])
                n += [whole] * len(t[-1])
                m += [len(tokens)] * len(t[-1])
                i += range(len(t[-1]))
                p += [None, *t[-1][:-1].tolist()][: len(t[-1])]
            flat = np.concatenate(t) if t else np.zeros(0, np.int64)
            ints = [pa.array(x, pa.int32()) for x in (n, m, i)]
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(sig, pa.binary()), *ints, pa.array(p, pa.int64())], ["t", "sig", "n", "m", "i", "p"])

    return sets.select("sig", "n", "tokens").mapInArrow(run, "t long, sig binary, n int, m int, i int, p long")


def _band(n: Column) -> Column:
    """Sizes in steps of about a tenth."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(1.1))).cast("int")


def open_sets(sets: DataFrame, found: DataFrame) -> DataFrame:
    """t, sig, n, m, i, c (class), top, lo, hi and before: where sets of different classes may meet at their rarest shared hash (written).

    lo and hi are the sizes that a partner can have whose rarest shared hash this is: the overlap is then at most m - i. A hash
    before which all its sets have one and the same other hash is nobody's rarest shared one and goes.
    """
    room = F.floor(F.lit(9) * (F.col("m") - F.col("i")) / 4) - F.col("n")
    rare = _rare(sets).withColumns({"lo": F.ceil(F.lit(4) * F.col("n") / 5).cast("int"), "hi": F.least(F.floor(F.lit(5) * F.col("n") / 4), room).cast("int")})
    rare = materialize(rare.join(found, F.col("sig") == F.col("v"), "left").withColumn("c", F.coalesce("root", "sig")).drop("v", "root"))
    # hashes with sets of two classes at least, and their largest class
    by_class = rare.groupBy("t", "c").agg(F.count("*").alias("k"), F.count("p").alias("ps"), F.min("p").alias("p1"), F.max("p").alias("p2"), F.min("n").alias("n1"), F.max("n").alias("n2"),
                                          F.min("lo").alias("lo1"), F.max("hi").alias("hi2"))
    mixed = by_class.groupBy("t").agg(
        F.count("*").alias("cs"), F.max(F.struct("k", "c")).alias("top"), ((F.sum("k") == F.sum("ps")) & (F.min("p1") == F.max("p2"))).alias("late"),
        F.min("n1").alias("n1"), F.max("n2").alias("n2"), F.min("lo1").alias("lo1"), F.max("hi2").alias("hi2"),
    )
    mixed = mixed.where((F.col("cs") > 1) & ~F.coalesce("late", F.lit(False)) & (F.col("n1") <= F.col("hi2")) & (F.col("lo1") <= F.col("n2")))
    mixed = materialize(mixed.select(F.col("t").alias("t2"), F.col("top.c").alias("top")))
    inside = rare.where("lo <= hi").join(mixed, F.col("t") == F.col("t2")).drop("t2", "p")
    inside = inside.join(_heads(sets), F.col("sig") == F.col("hsig")).withColumn("before", F.slice("head", F.lit(1), F.col("i")))
    return materialize(inside.drop("head", "hsig").withColumn("band", _band(F.col("n"))))


def open_links(sets: DataFrame, found: DataFrame) -> DataFrame:
    """a and b: the links between sets of different classes.

    The sets of a hash are split by size band. A band of up to BLOCK_SETS sets meets by an equi-join on hash and band; a larger one
    is cut into blocks of that many, each block stores its sets in a tree, and each set outside the hash's largest class
    probes the blocks of the bands that its partners can be in.
    """
    inside = open_sets(sets, found)
    count = inside.groupBy("t", "band").agg(F.count("*").alias("k")).withColumn("blocks", F.ceil(F.col("k") / BLOCK_SETS)).drop("k")
    count = materialize(count.withColumnsRenamed({"t": "t3", "band": "band3"}))
    bands = F.explode(F.sequence(_band(F.col("lo")), _band(F.col("hi")))).alias("band")
    probes = inside.where("c <> top").select("t", "sig", "n", "m", "i", "c", "lo", "hi", "before", bands)
    side = lambda p, d: d.select(*[F.col(c).alias(f"{p}{c}") for c in d.columns])
    here = (F.col("t") == F.col("t3")) & (F.col("band") == F.col("band3"))
    dealt_x, dealt_y = probes.join(count, here).drop("t3", "band3"), inside.join(count, here).drop("t3", "band3")

    few, all_ = side("x", dealt_x.where("blocks = 1").drop("blocks")), side("y", dealt_y.where("blocks = 1").drop("blocks"))
    least = F.ceil(F.lit(4) * (F.col("xn") + F.col("yn")) / 9)
    fits = F.col("yn").between(F.col("xlo"), F.col("xhi")) & F.col("xn").between(F.col("ylo"), F.col("yhi"))
    left = F.least(F.col("xm") - F.col("xi"), F.col("ym") - F.col("yi")) >= least
    once = (F.col("yc") == F.col("ytop")) | (F.col("xsig") < F.col("ysig"))
    # a pair is made where its rarest shared hash is, and nowhere else
    rarest = ~F.arrays_overlap("xbefore", "ybefore")
    pairs = few.join(all_, (F.col("xt") == F.col("yt")) & (F.col("xband") == F.col("yband")) & (F.col("xc") != F.col("yc")) & once & fits & left & rarest)
    pairs = materialize(pairs.select(F.least("xsig", "ysig").alias("x"), F.greatest("xsig", "ysig").alias("y")).distinct())

    stored = dealt_y.where("blocks > 1").select("t", "band", F.pmod(F.xxhash64("sig"), F.col("blocks")).alias("block"), "sig", "c", F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    asked = dealt_x.where("blocks > 1").select("t", "band", every, "sig", "c", "lo", "hi")
    met = materialize(stored.unionByName(asked))
    whole = sets.select(F.col("sig").alias("s2"), "n", "tokens")
    wide = met.join(whole, F.col("sig") == F.col("s2")).drop("s2").groupBy("t", "band", "block").applyInPandas(_block_probes, "a binary, b binary")
    return probe_pairs(pairs, sets).union(wide)


def _block_probes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a block: rows with hi = 0 are stored in a tree, the others probe it."""
    pdf = pdf.sort_values(["hi", "sig"], kind="mergesort")
    index, size = _numbered([_tokens(t) for t in pdf["tokens"]])
    rows = list(zip(pdf["sig"], pdf["c"], pdf["n"], pdf["lo"], pdf["hi"], index, strict=True))
    kept = [r for r in rows if r[4] == 0]
    trie = Trie(size)
    for k, r in enumerate(kept):
        trie.add(k, r[5], int(r[2]))
    out = []
    for sig, c, n, lo, hi, tokens in rows[len(kept) :]:
        skip = lambda k: kept[k][1] == c or not lo <= kept[k][2] <= hi  # noqa: B023, E731
        out += [(sig, kept[k][0]) for k, o in trie.probe(tokens, int(n), skip) if not skip(k) and linked(o, int(n), int(kept[k][2]))]
    return pd.DataFrame(out, columns=["a", "b"])


def _numbered(parts: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Sets with their hashes as numbers from 0, and how many numbers there are."""
    every, index = np.unique(np.concatenate(parts), return_inverse=True) if parts else (np.zeros(0), np.zeros(0, np.int64))
    cut = np.cumsum([0, *map(len, parts)])
    return [index[a:b] for a, b in zip(cut, cut[1:], strict=False)], len(every)


def probe_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are links: each x is probed in the trees of its partners."""
    ys = pairs.join(sets, F.col("y") == F.col("sig")).select("x", "y", F.col("n").alias("yn"), F.col("tokens").alias("yt"))
    both = ys.join(sets, F.col("x") == F.col("sig")).select("x", "n", "tokens", "y", "yn", "yt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[bytes, bytes]] = []
            rows = list(zip(*[c.to_pylist() for c in b.columns], strict=True))
            at = 0
            while at < len(rows):
                end = at
                while end < len(rows) and rows[end][0] == rows[at][0] and end - at < BLOCK_SETS:
                    end += 1
                x, n, block = rows[at][:3]
                numbered, size = _numbered([_tokens(block), *[_tokens(r[5]) for r in rows[at:end]]])
                trie = Trie(size)
                for k, r in enumerate(rows[at:end]):
                    trie.add(k, numbered[k + 1], r[4])
                out += [(x, rows[at + k][3]) for k, o in trie.probe(numbered[0], n, lambda e: False) if linked(o, n, rows[at + k][4])]
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.binary()) for j in (0, 1)], ["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def _classified(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """sets_of(), and s2 and r: the set that stands for the class of each set (written)."""
    found = sets_of(df, id_col, text_col)
    sets = ordered(found)
    first = classes(tree_links(sets))
    late = materialize(open_links(sets, first))
    # links between classes, by the classes' roots
    root = lambda d, c: d.join(first, F.col(c) == F.col("v"), "left").withColumn(c, F.coalesce("root", c)).drop("v", "root")
    merged = classes(root(root(late, "a"), "b"))
    own = found.where("n > 0").groupBy("sig").agg(F.min(F.struct("id", "key")).alias("least"))
    own = own.join(first, F.col("sig") == F.col("v"), "left").select("sig", "least", F.coalesce("root", "sig").alias("r1"))
    own = own.join(merged, F.col("r1") == F.col("v"), "left").select(F.col("sig").alias("s2"), "least", F.coalesce("root", "r1").alias("r"))
    return found, materialize(own)


def _key(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def join_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id, the least id that links reach."""
    found, own = _classified(df, id_col, text_col)
    least = own.groupBy("r").agg(F.min("least.id").alias("component")).withColumnRenamed("r", "r2")
    named = own.join(least, F.col("r") == F.col("r2")).select("s2", "component")
    by_text = found.select("key", "n", "sig").join(named, F.col("sig") == F.col("s2"), "left").select("key", "n", "component")
    docs = df.select(F.col(id_col).alias("_id"), _key(text_col).alias("_k"))
    out = docs.join(by_text, F.col("_k") == F.col("key"))
    component = F.when(F.col("n") == 0, F.col("_id").cast("long")).otherwise(F.nullif(F.col("component"), F.lit(NO_ID)))
    return out.select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with one row of each class: the least id, then the least hash of its text. Rows without words all stay."""
    found, own = _classified(df, id_col, text_col)
    first = own.groupBy("r").agg(F.min("least").alias("least")).select(F.col("least.id").alias("i2"), F.col("least.key").alias("k2"))
    # the table's own columns travel by position, so no name of theirs can clash
    text = F.coalesce(F.col(text_col), F.lit(""))
    own_columns = [F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(df.columns)]
    docs = df.select(*own_columns, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("i1"), _key(text_col).alias("k1"), text.rlike(r"[^ \t\n\x0B\f\r]").alias("worded"))
    kept = docs.where("worded").join(first, (F.col("k1") == F.col("k2")) & (F.col("i1") == F.col("i2")), "left_semi").dropDuplicates(["k1", "i1"])
    return kept.unionByName(docs.where("NOT worded")).select(*[F.col(f"c{j}").alias(c) for j, c in enumerate(df.columns)])


def brute_force(rows: list[tuple[int, str | None]]) -> Iterator[tuple[int, int, int]]:
    """The contract's result by comparing all sets that share a shingle; for tests."""
    import re

    sets: list[set] = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)} if len(w) >= WORDS else ({tuple(w)} if w else set()))
    having: dict[tuple, list[int]] = {}
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        seen: dict[int, int] = {}
        for g in s:
            for j in having.setdefault(g, []):
                seen[j] = seen.get(j, 0) + 1
            having[g].append(i)
        for j, inter in seen.items():
            if linked(inter, len(s), len(sets[j])):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    for i, (doc, _) in enumerate(rows):
        yield doc, len(sets[i]), least[find(i)] if sets[i] else doc


def oracle_sql(table: str = "documents") -> str:
    """DuckDB SQL for join_classes() of a table with doc_id and text: all pairs that share a shingle, then what links reach."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE src AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM {table}),
sh AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS g FROM src, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
pair AS (SELECT a.rid AS x, b.rid AS y, count(*) AS inter FROM sh a JOIN sh b USING (g) WHERE a.rid < b.rid GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM pair JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * inter >= 80 * (nx.n + ny.n - inter)),
both_ways AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(v, r) AS (SELECT x, x FROM both_ways UNION SELECT b.y, reach.r FROM reach JOIN both_ways b ON b.x = reach.v),
least AS (SELECT v, min(doc_id) AS component FROM reach JOIN src ON src.rid = r GROUP BY v)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id FROM src LEFT JOIN n USING (rid) LEFT JOIN least ON v = src.rid
"""
