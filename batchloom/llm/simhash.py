"""SimHash fingerprints and their exact radius join over a sharded vantage-point tree.

A fingerprint is cut into disjoint bit fields. Level i of the tree measures the Hamming distance to one vantage
point on field i and splits at a threshold. Distances on disjoint fields add up, and so do their triangle bounds:
a fingerprint within `radius` of x can only lie in a shard whose levels lie at a summed distance of at most
`radius` from x. Every fingerprint therefore lives in one home shard and visits only the shards over the near
boundaries. Inside a shard a vantage-point tree on the whole fingerprint finds the pairs. Only a spanning forest
of the pairs leaves a task, so a group of n near copies gives n rows and not n * n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import bounded, temporary
from .common import connected_components, forest, grown, materialize, only, packed, texts, unpacked

SEED = 42
#: Fingerprints that the tree's vantage points and thresholds are fitted on, at most.
TREE_SAMPLE = 4096
#: Home fingerprints aimed at in a shard.
SHARD_TARGET = 1000
MAX_LEVELS = 16
LEAF = 256
STEP = 20_000
#: Keys that may be broadcast; with more, texts are shuffled to them.
BROADCAST_ROWS = 200_000
BLOCK = 2_000_000


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle of A-Z lower-cased text, repeats included.

    Fewer words than k give one shingle of them all; none give an empty array.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < k else map(b" ".join, zip(*(words[i:] for i in range(k))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, SEED) for g in grams], dtype=np.uint64)


def majority(h: np.ndarray) -> np.uint64:
    """Bits that are set in over half of the hashes; zero for no hash."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp long). Null and wordless texts get fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for b in batches:
            fps = np.array([majority(shingle_hashes(t.as_py(), k)) for t in b.column("text")], dtype=np.uint64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class ShardTree:
    """The upper levels of the tree: per level a bit field, a vantage point on it, and a split threshold."""

    masks: tuple[int, ...]
    vantage: tuple[int, ...]
    cut: tuple[int, ...]
    radius: int

    @classmethod
    def fit(cls, sample: np.ndarray, levels: int, radius: int) -> ShardTree:
        masks, vantage, cut = [], [], []
        width = 64 // max(1, levels)
        for i in range(levels):
            mask = ((1 << width) - 1) << (i * width)
            v = int(sample[i % len(sample)]) & mask if len(sample) else 0
            d = np.bitwise_count((sample ^ np.uint64(v)) & np.uint64(mask)) if len(sample) else np.zeros(1)
            masks.append(mask)
            vantage.append(v)
            cut.append(int(np.clip(np.floor((np.median(d) + d.mean()) / 2), 0, width - 1)))
        return cls(tuple(masks), tuple(vantage), tuple(cut), radius)

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home): every shard that can hold something within the radius of each fingerprint.

        A visit to a shard numbered below the home is left out: there the partner makes the visit.
        """
        side, bound = np.zeros((len(fps), len(self.masks)), np.int64), np.zeros((len(fps), len(self.masks)), np.int64)
        for i, (m, v, t) in enumerate(zip(self.masks, self.vantage, self.cut, strict=True)):
            d = np.bitwise_count((fps ^ np.uint64(v)) & np.uint64(m)).astype(np.int64)
            side[:, i] = d > t
            bound[:, i] = np.where(d > t, d - t, t + 1 - d)
        home = (side << np.arange(len(self.masks))).sum(axis=1) if self.masks else np.zeros(len(fps), np.int64)
        rows, shards = [np.arange(len(fps))], [home]
        flips = [(np.arange(len(fps)), home, np.full(len(fps), -1), np.zeros(len(fps), np.int64))]
        for _ in range(self.radius):  # each flipped level costs one bit at least
            grown = []
            for r, s, last, spent in flips:
                for i in range(len(self.masks)):
                    ok = (last < i) & (spent + bound[r, i] <= self.radius)
                    if ok.any():
                        grown.append((r[ok], s[ok] ^ (1 << i), np.full(ok.sum(), i), spent[ok] + bound[r[ok], i]))
            flips = grown
            for r, s, *_ in grown:
                rows.append(r)
                shards.append(s)
        row, shard = np.concatenate(rows), np.concatenate(shards)
        keep = shard >= home[row]
        row, shard = row[keep], shard[keep]
        return row, shard, shard == home[row]


def tree_pairs(home: np.ndarray, guest: np.ndarray, radius: int, hi: np.ndarray | None = None, gi: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, guest) within the radius, by a vantage-point tree over the home fingerprints."""
    hi = np.arange(len(home)) if hi is None else hi
    gi = np.arange(len(guest)) if gi is None else gi
    if not len(hi) or not len(gi):
        return
    if len(hi) > LEAF:
        v = home[hi[len(hi) // 2]]
        dh, dg = np.bitwise_count(home[hi] ^ v), np.bitwise_count(guest[gi] ^ v).astype(np.int64)
        t = int(np.median(dh))
        inner = dh <= t
        if inner.all():
            t -= 1
            inner = dh <= t
        if inner.any():
            yield from tree_pairs(home, guest, radius, hi[inner], gi[dg <= t + radius])
            yield from tree_pairs(home, guest, radius, hi[~inner], gi[dg >= t + 1 - radius])
            return
    step = max(1, BLOCK // len(hi))
    for i in range(0, len(gi), step):
        g = gi[i : i + step]
        a, b = np.nonzero(np.bitwise_count(home[hi][:, None] ^ guest[g][None, :]) <= radius)
        yield hi[a], g[b]


def linked(reps: DataFrame, radius: int = 2, shard_target: int = SHARD_TARGET) -> DataFrame:
    """Distinct (fp, rep) -> (src, dst) over reps: a spanning forest, shard by shard, of all pairs within the radius."""
    n = reps.count()
    levels = min(MAX_LEVELS, max(0, int(np.ceil(np.log2(max(1, n) / shard_target)))))
    sample = reps.orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).select("fp").collect()
    tree = ShardTree.fit(np.array([r.fp for r in sample], np.int64).view(np.uint64), levels, radius)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, rep = b.column("fp").to_numpy(zero_copy_only=False), b.column("rep").to_numpy(zero_copy_only=False)
            row, shard, home = tree.route(fps.view(np.uint64))
            yield pa.record_batch([pa.array(shard), pa.array(home), pa.array(fps[row]), pa.array(rep[row])], names=["shard", "home", "fp", "rep"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _runs(batches, "shard"):
            fps, rep, home = shard["fp"].view(np.uint64), shard["rep"], shard["home"]
            at, label = np.flatnonzero(home), np.arange(len(fps))
            for a, b in tree_pairs(fps[at], fps, radius):
                label = forest(len(fps), np.concatenate([np.arange(len(fps)), at[a]]), np.concatenate([label, b]))
            far = label != np.arange(len(fps))
            if far.any():
                yield pa.record_batch([pa.array(rep[far]), pa.array(rep[label[far]])], names=["src", "dst"])

    sent = reps.select("fp", "rep").mapInArrow(visits, "shard long, home boolean, fp long, rep long")
    return sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(edges, "src long, dst long")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Groups of equal keys out of batches that are sorted by it."""
    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
        k = cols[key]
        if not len(k):
            continue
        starts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)]
        for i, j in zip(starts, starts[1:]):
            if held and held[-1][key][0] != k[i]:
                yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                held = []
            held.append({n: c[i:j] for n, c in cols.items()})
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def simhash_components(docs: DataFrame, k: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp, component_id): groups reachable over fingerprints at most `radius` bits apart.

    One row per input row, repeated rows included. Equal fingerprints are one node, so exact copies never meet
    each other in pairs. component_id is the smallest doc_id reachable, the document itself included.
    """
    fps = materialize(fingerprints(docs, k), "simhash")
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps", compact=16)
    found = connected_components(linked(reps.where("rep is not null"), radius), "simhash-links")
    named = reps.join(found, reps.rep == found.node, "left").select(F.col("fp").alias("fp_"), F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, fps.fp == named.fp_).select("doc_id", "fp", "component_id")


#: 64-bit words of a wide fingerprint.
WORDS = 4
#: Pairs of the least similarity that may share no leaf of any tree, and the bits of a tree's paths. Both are fixed:
#: whether two texts meet depends on them alone, and not on what else the input holds.
MISSED, BITS = 0.01, 14
#: Bytes of shingle sets that may be broadcast.
SET_BYTES = 4 << 20
#: Rows of a leaf up to which pairs are compared by their distance in it, all leaves at once.
LEAF_ROWS = 64
#: Rows of a leaf up to which all its pairs are looked at in the first pass; a larger one is cut by vantage points.
HOT = 4096
#: Bits of a sketch for each hash of the set, rounded up to a power of two, and the least and most of them.
PER_HASH, FEWEST, MOST = 2, 1 << 10, 1 << 16
_MIX = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
NAMES = [f"f{i}" for i in range(WORDS)]


def row_key() -> Column:
    """A row's key: equal for rows with equal doc_id and text, else different but for one in 2 ** 64."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def wide_fingerprints(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, text) -> (doc_id, key, size, f0 .. f3): the majority bits of four independent remixes of each shingle's hash.

    A shingle counts once however often it repeats, as it does in the similarity; size is the number of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for b in batches:
            out, size = np.zeros((b.num_rows, WORDS), np.uint64), np.zeros(b.num_rows, np.int32)
            for i, t in enumerate(b.column("text")):
                h = np.unique(shingle_hashes(t.as_py(), k))
                size[i] = len(h)
                for j, m in enumerate(_MIX):
                    x = (h ^ (h >> np.uint64(31))) * m
                    out[i, j] = majority(x ^ (x >> np.uint64(29)))
            yield pa.record_batch([b.column("doc_id"), b.column("key"), pa.array(size), *(pa.array(out[:, j].view(np.int64)) for j in range(WORDS))], names=["doc_id", "key", "size", *NAMES])

    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, size int, f0 long, f1 long, f2 long, f3 long")


def wide_radius(similarity: float, deviations: float = 3) -> int:
    """Differing bits, of all, that two texts with this Jaccard similarity of shingles rarely exceed.

    Equal-sized sets with similarity s have cosine 2 s / (1 + s); a bit differs with the angle over pi.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    n = 64 * WORDS
    return int(n * p + deviations * np.sqrt(n * p * (1 - p)))


def trees_for(bits: int, similarity: float, missed: float = MISSED) -> int:
    """The least number of trees over so many random bits that leave at most that share of pairs without a common leaf.

    The bits in which a pair differs are binomial, and a tree's bits are drawn without replacement.
    """
    n = 64 * WORDS
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    chance = np.array([comb(n, d) * p**d * (1 - p) ** (n - d) for d in range(n + 1)])
    meet = np.array([comb(n - d, bits) / comb(n, bits) for d in range(n + 1)])
    low, high = 0, 1
    while chance @ (1 - meet) ** high > missed:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if chance @ (1 - meet) ** middle > missed else (low, middle)
    return high


def sketch(h: np.ndarray) -> bytes:
    """Of each bin that a set's hashes fall into, whether they are odd in number: two sets differ in as many hashes, or more, as their sketches do in bits."""
    n = min(MOST, max(FEWEST, 1 << (PER_HASH * len(h) - 1).bit_length()))
    x = (h ^ (h >> np.uint64(33))) * _MIX[2]
    odd = np.bincount((x & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of a leaf's texts, and what they say of pairs whose sizes allow a link."""

    def __init__(self, marks: np.ndarray, size: np.ndarray) -> None:
        self.size, self.bytes, self.rows = size.astype(np.int64), np.array([len(m) for m in marks], np.int64), {}
        for n in np.unique(self.bytes):  # of the next length too: halves of a sketch added up are the shorter one
            own, wider = np.flatnonzero(self.bytes == n), np.flatnonzero(self.bytes == 2 * n)
            at = np.full(len(marks), -1)
            at[own], at[wider] = np.arange(len(own)), len(own) + np.arange(len(wider))
            whole, halves = (np.frombuffer(b"".join(marks[i]), np.uint64).reshape(-1, k, n // 8) for i, k in ((own, 1), (wider, 2)))
            self.rows[int(n)] = at, np.concatenate([whole[:, 0], halves[:, 0] ^ halves[:, 1]])

    def apart(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits in which the pairs' sketches differ, and how many bits these have."""
        short, away = np.minimum(self.bytes[x], self.bytes[y]), np.zeros(len(x), np.int64)
        for n, (at, rows) in self.rows.items():
            of = np.flatnonzero(short == n)
            for i in range(0, len(of), step := max(1, 4 * BLOCK // n)):
                p = of[i : i + step]
                away[p] = np.bitwise_count(rows[at[x[p]]] ^ rows[at[y[p]]]).sum(axis=1, dtype=np.int64)
        return away, 8 * short

    def alike(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs, the greatest similarity that they can have, and an estimate of it."""
        away, bits = self.apart(x, y)
        both = self.size[x] + self.size[y]
        guess = -bits / 2 * np.log(np.maximum(1 - 2 * away / bits, 1 / bits))
        return tuple(np.maximum(0, both - d) / np.maximum(1, both + d) for d in (away, guess))


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers of the edges of a lightest spanning forest: each part takes its lightest edge out, again and again."""
    label, taken, order = np.arange(n), [], np.lexsort((np.arange(len(a)), weight))
    a, b = a[order], b[order]
    at = np.arange(len(a))
    while len(at):
        la, lb = label[a[at]], label[b[at]]
        open_ = la != lb
        at, la, lb = at[open_], la[open_], lb[open_]
        if not len(at):
            break
        best = np.full(n, len(a))
        np.minimum.at(best, la, at)
        np.minimum.at(best, lb, at)
        best = np.unique(best[best < len(a)])
        taken.append(best)
        label = forest(n, np.concatenate([np.arange(n), a[best]]), np.concatenate([label, b[best]]))
    return order[np.concatenate(taken)] if taken else np.empty(0, np.int64)


def near_copies(docs: DataFrame, k: int = 5, similarity: float = 0.8, trees: int | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, key, component_id, group), a row per input row: groups of texts whose k-word shingles are that similar, or more.

    component_id is the smallest doc_id of the group (null if none has one), key the row's key, group the same for all
    rows of a group. Texts with equal fingerprints count as copies; texts without words, null ones too, are one group.
    Rows that share a doc_id and not the text are rows of their own.

    At such distances triangle bounds on one fingerprint prune nothing. So a wider fingerprint is looked up in
    shallow trees, each over its own random bits; two texts meet where all bits of one tree agree, and are candidates
    if their whole fingerprints are within wide_radius() and their sizes allow it. The trees' depth and number are
    fixed, so that at most MISSED of the pairs at the least similarity meet nowhere (trees_for), and a pair that is
    found in one input is found in any.

    Only texts whose sets of shingles are that similar are linked. The lightest spanning forest of each leaf's
    candidates is tried first; a leaf that copies fill is cut by vantage points for it, without overlap. Where
    that leaves a group of candidates in parts, each text is tried with the most similar one of other parts, and at
    last all candidates in different parts are; here leaves are searched as vantage-point
    trees, over the near boundaries. So no pair inside a part is ever sent. Sketches choose the order, and a pair is
    left untried where they show that it can't be that similar: a bound, not a guess (Sketches.apart).
    """
    fps = materialize(wide_fingerprints(docs, k), "wide")
    reps = materialize(fps.groupBy(*NAMES).agg(F.min(F.struct("key", "size")).alias("r")).select(F.col("r.key").alias("rep"), F.col("r.size").alias("size"), *NAMES), "wide-reps", compact=16)
    bits, trees = BITS, trees or trees_for(BITS, similarity)
    chosen = [np.random.default_rng(SEED + t).permutation(64 * WORDS)[:bits] for t in range(trees)]
    masks = np.zeros((trees, WORDS), np.uint64)
    for t, at in enumerate(chosen):
        for i in at:
            masks[t, i >> 6] |= np.uint64(1 << int(i & 63))
    radius = wide_radius(similarity)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.stack([b.column(n).to_numpy() for n in NAMES], axis=1).view(np.uint64)
            for t, at in enumerate(chosen):
                leaf = np.full(len(fps), t, np.int64)
                for i in at:
                    leaf = (leaf << 1) | ((fps[:, i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).astype(np.int64)
                yield pa.record_batch([pa.array(leaf), *b.columns], names=["leaf", *b.schema.names])

    def leaves(rows: DataFrame) -> DataFrame:
        sent = rows.mapInArrow(visits, "leaf long, " + ", ".join(f"{n} {t}" for n, t in rows.dtypes))
        return sent.repartition("leaf").sortWithinPartitions("leaf")

    def fit(size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y])

    def batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["src", "dst"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _whole_groups(batches, "leaf"):
            leaf, rep, size = g["leaf"], g["rep"], g["size"]
            fps = np.stack([g[n] for n in NAMES], axis=1).view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
            sizes = np.diff(np.append(starts, len(leaf)))
            small = np.repeat(sizes <= LEAF_ROWS, sizes)
            found = [(np.empty(0, np.int64),) * 3]
            for d in range(1, int(LEAF_ROWS)):
                at = np.flatnonzero((leaf[d:] == leaf[:-d]) & small[d:])
                if not len(at):
                    break
                away = np.bitwise_count(fps[at] ^ fps[at + d]).sum(axis=1, dtype=np.int64)
                near = (away <= radius) & fit(size, at, at + d)
                found.append((at[near], at[near] + d, away[near]))
            for i, n in zip(starts[sizes > LEAF_ROWS], sizes[sizes > LEAF_ROWS], strict=True):
                own = (np.empty(0, np.int64),) * 3
                for x, y in wide_pairs(fps[i : i + n], radius, overlap=n <= HOT):
                    keep = (x < y) & fit(size[i : i + n], x, y)
                    x, y = x[keep], y[keep]
                    away = np.bitwise_count(fps[i + x] ^ fps[i + y]).sum(axis=1, dtype=np.int64)
                    own = tuple(np.concatenate(c) for c in zip(own, (x, y, away), strict=True))
                    take = spanning(n, *own)  # what a leaf keeps never exceeds a forest and a block's pairs
                    own = tuple(c[take] for c in own)
                found.append((own[0] + i, own[1] + i, own[2]))
            a, b, away = (np.concatenate(c) for c in zip(*found, strict=True))
            take = spanning(len(rep), a, b, away)
            if len(take):
                yield batch(rep[a[take]], rep[b[take]])

    def across(nearest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Candidates in different parts that can be similar: the likeliest of each text, or all."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in _runs(batches, "leaf"):
                fps = np.stack([g[n] for n in NAMES], axis=1).view(np.uint64)
                rep, part, size = g["rep"], g["part"], g["size"]
                names, number, count = np.unique(part, return_inverse=True, return_counts=True)
                if len(names) < 2:
                    continue
                guests = np.flatnonzero(number != count.argmax())  # any pair has one that isn't in the largest part
                marks = Sketches(g["sketch"], size)
                best, other = np.full(len(rep), -1.0), np.zeros(len(rep), np.int64)
                for x, y in wide_pairs(fps, radius, guests=guests):
                    keep = (part[x] != part[y]) & fit(size, x, y)
                    x, y = x[keep], y[keep]
                    most, like = marks.alike(x, y)
                    keep = most >= similarity - 1e-9
                    x, y, like = x[keep], y[keep], like[keep]
                    if not nearest:
                        tree = int(g["leaf"][0]) >> bits
                        for i in range(0, len(x), STEP):  # once: in the first tree that they meet in
                            differ = fps[x[i : i + STEP]] ^ fps[y[i : i + STEP]]
                            new = ~((differ[:, None, :] & masks[None, :tree]) == 0).all(axis=2).any(axis=1)
                            pairs = batch(rep[x[i : i + STEP][new]], rep[y[i : i + STEP][new]])
                            yield pairs.append_column("like", pa.array(like[i : i + STEP][new]))
                        continue
                    for p, q in ((x, y), (y, x)):
                        order = np.lexsort((q, -like, p))
                        p, q, l = p[order], q[order], like[order]
                        first = np.concatenate([[True], p[1:] != p[:-1]]) if len(p) else np.empty(0, bool)
                        p, q, l = p[first], q[first], l[first]
                        more = l > best[p]
                        best[p[more]], other[p[more]] = l[more], q[more]
                x = np.flatnonzero(best >= 0)
                if len(x):
                    yield pa.record_batch([pa.array(rep[x]), pa.array(rep[other[x]]), pa.array(best[x])], names=["src", "dst", "like"])

        return run

    nodes = reps.select("rep", "size", *NAMES)
    tried = materialize(leaves(nodes).mapInArrow(edges, "src long, dst long").distinct(), "wide-tried", compact=16)
    parts = connected_components(similar(docs, tried, k, similarity), "wide-parts")
    groups = grown(parts, tried, "wide-groups").select(F.col("node").alias("in_"), F.col("component").alias("group_"))
    for nearest in (True, False):
        placed = groups.join(parts.select(F.col("node").alias("of_"), F.col("component").alias("part_")), F.col("in_") == F.col("of_"), "left").select("in_", "group_", F.coalesce("part_", "in_").alias("part"))
        split = placed.groupBy("group_").agg(F.min("part").alias("least_"), F.max("part").alias("most_")).where("least_ <> most_").select(F.col("group_").alias("split_"))
        open_ = materialize(placed.join(split, F.col("group_") == F.col("split_"), "left_semi").select("in_", "part"), "wide-open", compact=16)
        if open_.isEmpty():
            break
        marks = shingle_sets(docs, open_.select(F.col("in_").alias("want_")), k, True)
        rows = nodes.join(open_, F.col("rep") == F.col("in_")).join(marks, F.col("rep") == F.col("node_")).select("rep", "part", "size", F.col("set_").alias("sketch"), *NAMES)
        found = leaves(rows).mapInArrow(across(nearest), "src long, dst long, like double")
        if nearest:  # of all trees the likeliest
            found = found.groupBy("src").agg(F.max(F.struct("like", "dst")).alias("best")).select("src", F.col("best.dst").alias("dst"))
        tried = materialize(found.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "wide-tried", compact=4)
        parts = grown(parts, similar(docs, tried, k, similarity), "wide-parts")
    named = reps.join(parts, reps.rep == parts.node, "left").select(*(F.col(n).alias(n + "_") for n in NAMES), F.coalesce("component", "rep").alias("group"))
    placed = fps.join(named, [F.col(n) == F.col(n + "_") for n in NAMES]).select("doc_id", "key", "group")
    least = placed.groupBy(F.col("group").alias("group_")).agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, F.col("group") == F.col("group_")).select("doc_id", "key", "component_id", "group")


def without_copies(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, all columns, one row of each group of near copies: that with the smallest doc_id, null last.

    Rows with equal doc_id and text are copies as well, whatever their other columns; one of them stays.
    """
    with temporary() as work:  # fingerprints, candidates and sets go when the rows to keep are known
        kept = work.keep(_kept(docs, k, similarity))
    rows = packed(docs, row_key().alias("row_key_"))
    out = rows.join(kept.where("rows_ = 1"), F.col("row_key_") == F.col("key_"), "left_semi")
    if not (again := kept.where("rows_ > 1")).isEmpty():
        out = out.unionByName(rows.join(again, F.col("row_key_") == F.col("key_"), "left_semi").dropDuplicates(["row_key_"]))
    return unpacked(out, docs)


def _kept(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """(key_, rows_): keys of the rows that stay, and how many rows have each."""
    groups = materialize(near_copies(docs, k, similarity).select("doc_id", "key", "group"), "near-groups", compact=16)
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))).alias("w")).select(F.col("w.key").alias("key_"))
    counts = groups.groupBy(F.col("key").alias("k_")).agg(F.count("*").alias("rows_"))
    return materialize(first.join(counts, F.col("key_") == F.col("k_")).select("key_", "rows_"), "near-kept", compact=16)


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int, sketched: bool = False) -> DataFrame:
    """(node_, set_) of the rows with the wanted keys: their shingles' hashes, sorted, or a sketch of them."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for b in batches:
            h = (np.unique(shingle_hashes(t.as_py(), k)) for t in b.column("text"))
            yield pa.record_batch([b.column("key"), pa.array([sketch(x) if sketched else x.tobytes() for x in h], pa.binary())], names=["node_", "set_"])

    rows = texts(docs, row_key().alias("key"), F.col("text").cast("binary").alias("text"))
    found = rows.join(bounded(wanted, BROADCAST_ROWS), F.col("key") == F.col("want_"), "left_semi")
    # Written, so that both sides of later joins are plain shuffles and a text with very many pairs is split.
    return materialize(found.mapInArrow(sets, "node_ long, set_ binary").groupBy("node_").agg(F.first("set_").alias("set_")), "wide-sets")


def similar(docs: DataFrame, pairs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Those of the pairs (src, dst) of row keys whose texts have sets of shingles with that Jaccard similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("a"), b.column("b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.record_batch([b.column("src"), b.column("dst")], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    wanted = materialize(pairs.select(F.explode(F.array("src", "dst")).alias("want_")).distinct(), "wide-wanted", compact=16)  # it is read twice
    found = shingle_sets(docs, wanted, k)
    found = bounded(found, BROADCAST_ROWS, SET_BYTES)
    a, b = (found.select(F.col("node_").alias(n + "_node"), F.col("set_").alias(n)) for n in "ab")
    both = pairs.join(a, F.col("src") == F.col("a_node")).join(b, F.col("dst") == F.col("b_node"))
    return materialize(both.select("src", "dst", "a", "b").mapInArrow(check, "src long, dst long").distinct(), "wide-similar", compact=16)


def wide_pairs(fps: np.ndarray, radius: int, at: np.ndarray | None = None, guests: np.ndarray | None = None, overlap: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of wide fingerprints within the radius, by a vantage-point tree; without overlap, those that no boundary parts."""
    at = np.arange(len(fps)) if at is None else at
    guests = at if guests is None else guests
    if not len(at) or not len(guests):
        return
    if len(at) > LEAF:
        v = fps[at[len(at) // 2]]
        dh, dg = (np.bitwise_count(fps[x] ^ v).sum(axis=1, dtype=np.int64) for x in (at, guests))
        t = int(np.median(dh))
        inner = dh <= t
        if inner.all():  # more than half of them at the greatest distance
            t -= 1
            inner = dh <= t
        if inner.any() and not inner.all():
            reach = radius if overlap else 0
            yield from wide_pairs(fps, radius, at[inner], guests[dg <= t + reach], overlap)
            yield from wide_pairs(fps, radius, at[~inner], guests[dg >= t + 1 - reach], overlap)
            return
    step = max(1, BLOCK // WORDS // len(at))
    for i in range(0, len(guests), step):
        g = guests[i : i + step]
        a, b = np.nonzero(np.bitwise_count(fps[at][:, None, :] ^ fps[g][None, :, :]).sum(axis=2) <= radius)
        yield at[a], g[b]


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Batches that are sorted by a key, cut so that no group is split."""
    rest: dict[str, np.ndarray] | None = None
    for b in batches:
        cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
        if rest is not None:
            cols = {n: np.concatenate([rest[n], c]) for n, c in cols.items()}
        k = cols[key]
        cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
        if cut:
            yield {n: c[:cut] for n, c in cols.items()}
        rest = {n: c[cut:] for n, c in cols.items()}
    if rest is not None and len(rest[key]):
        yield rest
