"""Repeated passages by collinear chaining of shared word k-mers.

Seeds are the minimizers of a text's 5-word shingles, so that texts which share a run of WINDOW + 4 words share a
seed. Each seed is anchored at its first document; every other occurrence meets that anchor and the document
before it that has the seed, so a seed that a third of all documents has gives two rows per occurrence and no pairs.
Between two documents the matches that lie in the same order are chained under gap costs, with a Fenwick tree for the best chain to extend. Chains are then
aligned word by word, within the gaps and beyond the ends, and a document's aligned spans are united to passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bounded, temporary
from .common import ROW, materialize, only, packed, texts, unpacked
from .simhash import _runs, _whole_groups, row_key

K = 5
WINDOW = 8
MIN_WORDS = 50
SIMILARITY = 0.8
#: Cost of each word that a chain skips on either side; a seed scores K.
GAP = 0.1
#: Words beyond a chain's ends that its alignment may take in.
REACH = 40
#: Rows that may be broadcast; beyond, the same join shuffles.
BROADCAST_ROWS = 200_000
#: Spans of one document that go with one copy of its text, about; words of slices that are sent at a time.
SPANS, SLICE_WORDS = 1_000, 2_000_000
MATCH, MISS, DROP = 1, -2, 8
#: A match is alone if the document has no other one, with any source, this many words before or after it. The
#: passages that rest on one match alone are left out: most such matches are chance.
APART, LEAST = 2 * REACH, K + 1


SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    """32-bit hashes of words: polynomials in their bytes, for all words of a text at once."""

    def __init__(self) -> None:
        self.powers = np.ones(1, np.uint64)

    def of(self, text: bytes | None) -> np.ndarray:
        """The words of A-Z lower-cased text."""
        raw = np.frombuffer((text or b"").lower(), np.uint8)
        blank = SPACE[raw]
        edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.empty(0, np.uint32)
        lengths = ends - starts
        if (longest := int(lengths.max())) > len(self.powers):
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * longest, FACTOR))])
        firsts = np.cumsum(lengths) - lengths
        place = np.arange(firsts[-1] + lengths[-1]) - np.repeat(firsts, lengths)
        h = np.add.reduceat((raw[~blank] + np.uint64(1)) * self.powers[place], firsts)
        h = (h ^ (h >> np.uint64(32))) * FACTOR
        return (h >> np.uint64(32)).astype(np.uint32)


def shingles(h: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each K-word shingle; none for fewer words."""
    n = len(h) - K + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(K):
        out = (out ^ h[i : i + n]) * FACTOR
        out ^= out >> np.uint64(32)
    return out


def minimizers(s: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions that are the (rightmost) least of some window of shingles."""
    if len(s) <= window:
        return np.array([len(s) - 1 - s[::-1].argmin()], np.int64) if len(s) else np.empty(0, np.int64)
    least, at, width = s, np.arange(len(s)), 1
    while width < window:  # the least of twice as many shingles each time
        step = min(width, window - width)
        right = least[step:] <= least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.minimum(least[step:], least[:-step])
        width += step
    keep = np.zeros(len(s), bool)
    keep[at] = True
    return np.flatnonzero(keep)


def occurrences(values: np.ndarray) -> np.ndarray:
    """How often each value came before."""
    order = np.argsort(values, kind="stable")
    starts = np.concatenate([[True], values[order][1:] != values[order][:-1]]) if len(values) else np.empty(0, bool)
    at = np.arange(len(values))
    out = np.empty(len(values), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(starts, at, 0))
    return out


def seeds(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (seed, doc, pos, first): first marks a seed's first position in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        words = WordHashes()
        for b in batches:
            doc, pos, seed, first = [], [], [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                s = shingles(words.of(t.as_py()))
                p = minimizers(s)
                v = s[p].view(np.int64)
                n = occurrences(v)
                again = n > 0  # the second, third ... time: also a seed of its own, for texts that repeat themselves
                v = np.concatenate([v, (v[again] ^ (n[again] << 20)) * np.int64(0x5851F42D4C957F2D)])
                doc.append(np.full(len(v), d, np.int64))
                pos.append(np.concatenate([p, p[again]]))
                seed.append(v)
                first.append(np.concatenate([~again, np.ones(again.sum(), bool)]))
            cols = [np.concatenate(c) for c in (seed, doc, pos, first)]
            yield pa.record_batch([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32)), pa.array(cols[3])], names=["seed", "doc", "pos", "first"])

    rows = texts(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "seed long, doc long, pos int, first boolean")


def matches(found: DataFrame) -> DataFrame:
    """Seeds -> (doc, pos, source, source_pos): each occurrence beside the seed's first document and the one before."""
    anchors = found.where("first").groupBy("seed").agg(F.count("*").alias("n"), F.min("doc").alias("source"), F.min_by("pos", "doc").alias("source_pos")).where("n > 1")
    # As a table of its own, so that both sides of the join are plain shuffles and a seed that very many texts have is split.
    anchors = materialize(anchors.select("seed", "n", "source", "source_pos"), "anchors", compact=4)
    both = found.select("seed", "doc", "pos").join(anchors.select(F.col("seed").alias("seed_"), "n", "source", "source_pos"), F.col("seed") == F.col("seed_"))
    both = materialize(both.where("doc <> source").select("seed", "n", "doc", "pos", "source", "source_pos"), "repeats")
    return both.select("doc", "pos", "source", "source_pos").unionByName(preceding(both.where("n > 2").select("seed", "doc", "pos")))


def preceding(found: DataFrame) -> DataFrame:
    """(seed, doc, pos) -> (doc, pos, source, source_pos): each occurrence beside the seed's last document before.

    Rows are dealt by ranges of seed and document, so that no seed is a task of its own. What a range can't know of
    those before it, the last document of each range tells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        head = tail = None
        for g in _whole_groups(batches, "seed"):
            seed, doc, pos = g["seed"], g["doc"], g["pos"]
            new = np.concatenate([[True], (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])])
            starts = np.flatnonzero(new)
            before = starts[np.maximum(np.cumsum(new) - 2, 0)]
            has = (seed[before] == seed) & (doc[before] != doc)
            if head is None:
                head = seed[0]
                yield batch(g, ~has & (seed == head), before, 1)
            yield batch(g, has, before, 0)
            tail = {n: c[starts[-1] :][:1] for n, c in g.items()}
        if tail is not None:
            yield batch(tail, np.ones(1, bool), np.zeros(1, np.int64), 2)

    def batch(g: dict[str, np.ndarray], at: np.ndarray, before: np.ndarray, kind: int) -> pa.RecordBatch:
        cols = g["seed"][at], g["doc"][at], g["pos"][at], g["doc"][before[at]], g["pos"][before[at]], np.full(at.sum(), kind, np.int32)
        return pa.record_batch([pa.array(c) for c in cols], names=["seed", "doc", "pos", "source", "source_pos", "kind"])

    dealt = found.repartitionByRange("seed", "doc").sortWithinPartitions("seed", "doc", "pos")
    met = materialize(dealt.mapInArrow(run, "seed long, doc long, pos int, source long, source_pos int, kind int"), "preceding")
    tails = met.where("kind = 2").select(F.col("seed").alias("seed_"), F.col("doc").alias("last"), F.col("pos").alias("last_pos"))
    firsts = met.where("kind = 1").select("seed", "doc", "pos")
    sought = firsts.select(F.col("seed").alias("h_"), F.col("doc").alias("d_")).distinct()  # a text may have a seed very often
    sought = sought.join(tails, (F.col("h_") == F.col("seed_")) & (F.col("last") < F.col("d_"))).groupBy("h_", "d_").agg(F.max("last").alias("source"), F.max_by("last_pos", "last").alias("source_pos"))
    heads = firsts.join(sought, (F.col("seed") == F.col("h_")) & (F.col("doc") == F.col("d_")))
    cols = "doc", "pos", "source", "source_pos"
    return met.where("kind = 0").select(*cols).unionByName(heads.select(*cols))


def chains(pos: np.ndarray, other: np.ndarray) -> list[list[int]]:
    """Chains of matches (sorted by pos, then other) that grow on both sides, best first.

    Each match is in one at most, and so is each position of pos: what a better chain has there, others needn't show
    again. (A word that a text repeats meets the source's first one each time.)

    A chain scores K a match less GAP a word that it moves on, on either side. The cost is a sum of both ends'
    positions, so the best predecessor is a maximum over all matches before in both orders: a Fenwick tree's query.
    """
    n = len(pos)
    rank = (np.unique(other, return_inverse=True)[1] + 1).tolist()
    shift = (GAP * (pos + other)).tolist()
    size = max(rank, default=0)
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)
    score, before, i = [0.0] * n, [-1] * n, 0
    p = pos.tolist()
    while i < n:
        j = i
        while j < n and p[j] == p[i]:  # matches at one position can't follow each other
            best, r = (float("-inf"), -1), rank[j] - 1
            while r:
                best = max(best, tree[r])
                r &= r - 1
            gain = best[0] - shift[j]
            score[j] = K + max(0.0, gain)
            before[j] = best[1] if gain > 0 else -1
            j += 1
        for m in range(i, j):
            entry, r = (score[m] + shift[m], m), rank[m]
            while r <= size:
                if entry > tree[r]:
                    tree[r] = entry
                r += r & -r
        i = j
    used, taken, out = [False] * n, set(), []
    for m in sorted(range(n), key=lambda m: -score[m]):
        chain = []
        while m >= 0 and not used[m]:
            used[m] = True
            if p[m] not in taken:
                chain.append(m)
            m = before[m]
        taken.update(p[c] for c in chain)
        if chain:
            out.append(chain[::-1])
    return out


def within(pos: np.ndarray, other: np.ndarray, found: list[list[int]]) -> list[list[int]]:
    """Chains without the lone matches where a longer chain with the same source reaches, and without those that meet
    a place in the source that another chain has already (a phrase that only this text repeats)."""
    spans = sorted((pos[c[0]] - REACH, pos[c[-1]] + K + REACH) for c in found if len(c) > 1)
    low = np.array([s for s, _ in spans], np.int64)
    high = np.maximum.accumulate([e for _, e in spans]) if spans else low
    met, out = {other[m] for c in found if len(c) > 1 for m in c}, []
    for c in found:
        if len(c) == 1:
            i = int(np.searchsorted(low, pos[c[0]], side="right")) - 1
            if other[c[0]] in met or i >= 0 and high[i] >= pos[c[0]] + K:
                continue
            met.add(other[c[0]])
        out.append(c)
    return out


def dense(doc: np.ndarray, pos: np.ndarray, least: int) -> np.ndarray:
    """Which matches have neighbours no more than APART words away, with any sources, that together span so many words.

    In a run of equal words two matches are at most WINDOW + K words apart, also where one source ends and another
    begins, and the first and the last lie less than that from its ends: no match of such a run of 50 words is alone.
    """
    order = np.lexsort((pos, doc))
    d, p = doc[order], pos[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] - p[:-1] > APART)])
    starts = np.flatnonzero(new)
    span = p[np.append(starts[1:], len(p)) - 1] + K - p[starts]
    out = np.empty(len(doc), bool)
    out[order] = span[np.cumsum(new) - 1] >= least
    return out


def chained(found: DataFrame, least: int = LEAST) -> DataFrame:
    """Matches -> (doc, source, at, source_at): the positions of each chain.

    Matches that are alone are left out (dense).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for g in _whole_groups(batches, "doc"):
            keep = dense(g["doc"], g["pos"], least)
            doc, source, pos, other = (g[n][keep] for n in ("doc", "source", "pos", "source_pos"))
            if not len(doc):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (source[1:] != source[:-1])]))
            sizes = np.diff(np.append(starts, len(doc)))
            alone = starts[sizes == 1]
            yield batch(doc[alone], source[alone], np.arange(len(alone) + 1), pos[alone], other[alone])
            first, ends, p, q = [], [0], [], []
            for i, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                a, b = pos[i : i + n].astype(np.int64), other[i : i + n].astype(np.int64)
                for c in within(a, b, chains(a, b)):
                    first.append(i)
                    p.append(a[c])
                    q.append(b[c])
                    ends.append(ends[-1] + len(c))
            if first:
                yield batch(doc[first], source[first], np.array(ends), np.concatenate(p), np.concatenate(q))

    def batch(doc: np.ndarray, source: np.ndarray, ends: np.ndarray, p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        lists = (pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (p, q))
        return pa.record_batch([pa.array(doc), pa.array(source), *lists], names=["doc", "source", "at", "source_at"])

    dealt = found.repartition("doc").sortWithinPartitions("doc", "source", "pos", "source_pos")
    return dealt.mapInArrow(run, "doc long, source long, at array<int>, source_at array<int>")


def slices(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Word hashes of (doc, start, stop): (doc, start, stop, words), words cut at the text's end.

    Each document's spans come as lists of about SPANS, so that a text goes once with each list and not with each span,
    and a source that very many documents quote is dealt over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        words = WordHashes()
        for b in batches:
            for d, t, spans in zip(b.column("doc").to_pylist(), b.column("text"), b.column("spans"), strict=True):
                h = words.of(t.as_py())
                start, stop = (spans.values.field(n).to_numpy() for n in ("start", "stop"))
                sizes = np.cumsum(np.minimum(stop, len(h)) - np.minimum(start, len(h)))
                at = 0
                while at < len(start):
                    to = max(at + 1, int(np.searchsorted(sizes, SLICE_WORDS + (sizes[at - 1] if at else 0), "right")))
                    out = [h[i:j].tobytes() for i, j in zip(start[at:to].tolist(), stop[at:to].tolist(), strict=True)]
                    yield pa.record_batch([pa.array([d] * (to - at), pa.int64()), pa.array(start[at:to]), pa.array(stop[at:to]), pa.array(out, pa.binary())], names=["doc", "start", "stop", "words"])
                    at = to

    rows = texts(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counts = wanted.groupBy(F.col("doc").alias("of")).agg(F.ceil(F.count("*") / SPANS).alias("lists"))
    dealt = wanted.join(counts, F.col("doc") == F.col("of")).withColumn("list", F.pmod(F.xxhash64("start", "stop"), "lists"))
    lists = dealt.groupBy("doc", "list").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    both = rows.join(lists, F.col("doc_id") == F.col("doc"))
    return both.select("doc", "text", "spans").mapInArrow(run, "doc long, start int, stop int, words binary")


def align(a: np.ndarray, b: np.ndarray, at: list[int], other: list[int], similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """(start, stop, source start, source stop, similarity) of each stretch of a chain that is similar enough by itself.

    Between seeds the least edits are counted; beyond the ends single words are compared in step until the score
    falls DROP below its best. Similarity is the share of equal words among all aligned ones. A chain may lead over
    gaps that are unlike, so what counts is every longest stretch from a seed to a seed, not the whole chain.
    """
    x, y = a.tolist(), b.tolist()
    i, j = at[0], other[0]
    parts: list[tuple[int, int, int, int]] = []  # seeds: both starts, words before it and the equal ones among them
    ends: list[tuple[int, int]] = []
    for p, q in zip(at, other, strict=True):
        n = same = step = 0
        if p < i or q < j:  # seeds that overlap: only what is new counts
            step = max(i - p, j - q)
        else:
            n = max(p - i, q - j)
            same = n - _edits(x[i:p], y[j:q])
        if step < K:
            parts.append((p + step, q + step, n, same))
            i, j = p + K, q + K
            ends.append((i, j))
    out = []
    for m, o, same, all_ in stretches([(e[0] - s[0], s[2], s[3]) for s, e in zip(parts, ends, strict=True)], similarity):
        (s, t), (i, j) = parts[m][:2], ends[o]
        ahead = _extend(x[i : i + REACH], y[j : j + REACH])
        back = _extend(x[max(0, s - REACH) : s][::-1], y[max(0, t - REACH) : t][::-1])
        # What lies beyond the ends may not cost the stretch its similarity.
        v, u = max(((v, u) for v in (ahead, (0, 0)) for u in (back, (0, 0)) if same + v[1] + u[1] >= similarity * (all_ + v[0] + u[0]) - 1e-9), key=lambda w: w[0][0] + w[1][0], default=((0, 0), (0, 0)))
        out.append((s - u[0], i + v[0], t - u[0], j + v[0], (same + v[1] + u[1]) / (all_ + v[0] + u[0])))
    return out


def stretches(parts: list[tuple[int, int, int]], similarity: float) -> list[tuple[int, int, int, int]]:
    """Seeds (words, words of the gap before, equal ones among them) -> (first, last, equal words, words).

    Every stretch of seeds and the gaps between them that has the similarity and isn't within another that has it.
    With the sum of (equal - similarity * words) up to each seed, a stretch's sum mustn't fall.
    """
    before, after, at, equal, all_ = [], [], 0.0, [0], [0]
    for words, gap, same in parts:
        at += same - similarity * gap
        before.append(at)
        at += (1 - similarity) * words
        after.append(at)
        equal += [equal[-1] + same, equal[-1] + same + words]
        all_ += [all_[-1] + gap, all_[-1] + gap + words]
    top = np.maximum.accumulate(np.array(after)[::-1]) if parts else np.empty(0)  # the greatest from each seed on, last one first
    out, reach = [], -1
    for m, low in enumerate(before):
        o = len(parts) - 1 - int(np.searchsorted(top, low - 1e-9))
        if o > reach:
            reach = o
            out.append((m, o, equal[2 * o + 2] - equal[2 * m + 1], all_[2 * o + 2] - all_[2 * m + 1]))
    return out


def _edits(x: list[int], y: list[int]) -> int:
    """Edit distance of two gaps, a column of the table at a time: its steps up and down are the bits of two integers."""
    if x == y:
        return 0
    if not x or not y:
        return max(len(x), len(y))
    where: dict[int, int] = {}  # bit i of a word's mask: x[i] is that word
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, edits = full, 0, len(x)  # rows where the column's value grows by one, where it falls by one
    for c in y:
        equal = where.get(c, 0)
        v = equal | down
        h = (((equal & up) + up) ^ up) | equal
        grow, fall = down | (full & ~(h | up)), up & h
        edits += bool(grow & last) - bool(fall & last)
        grow, fall = grow << 1 | 1, fall << 1
        up, down = (fall | ~(v | grow)) & full, grow & v & full
    return edits


def _extend(x: list[int], y: list[int]) -> tuple[int, int]:
    """(words, equal words) of the best-scoring common stretch from the start."""
    score = best = same = 0
    out = (0, 0)
    for n, (c, d) in enumerate(zip(x, y), 1):
        score += MATCH if c == d else MISS
        same += c == d
        if score > best:
            best, out = score, (n, same)
        elif score < best - DROP:
            break
    return out


def _words(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words of a column of slices, and where each slice starts, with the end of the last."""
    if not len(c):
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    _, offsets, data = c.buffers()
    ends = np.frombuffer(offsets, np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64) // 4
    return np.frombuffer(data, np.uint32, ends[-1]), ends


def _extend_all(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, room: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """_extend for many pairs: from words i of x and j of y on, by step, for at most room words each."""
    n = np.arange(REACH)
    there = n < room[:, None]
    at, other = (np.where(there, k[:, None] + step * n, 0) for k in (i, j))
    same = (x[at] == y[other]) & there
    score = np.cumsum(np.where(same, MATCH, MISS), axis=1)
    best = np.maximum(np.maximum.accumulate(score, axis=1), 0)
    over = np.logical_or.accumulate(~there | (score < best - DROP), axis=1)
    score = np.where(over, 0, score)
    top = score.argmax(axis=1)
    rows = np.arange(len(i))
    good = score[rows, top] > 0
    return np.where(good, top + 1, 0), np.where(good, np.cumsum(same, axis=1)[rows, top], 0)


def align_lone(b: pa.RecordBatch, similarity: float = SIMILARITY) -> list[np.ndarray]:
    """align for chains of one match, all of them at once: doc, source, both spans and similarity."""
    (x, xs), (y, ys) = (_words(b.column(n)) for n in ("a_words", "b_words"))
    doc, source, s, ss = (b.column(n).to_numpy(zero_copy_only=False) for n in ("doc", "source", "s", "ss"))
    at, other = (b.column(n).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for n in ("at", "source_at"))
    if not len(doc):
        return [doc, source, at, at, other, other, np.empty(0)]
    i, j = at - s + xs[:-1], other - ss + ys[:-1]
    ahead = _extend_all(x, y, i + K, j + K, np.minimum(xs[1:] - i, ys[1:] - j) - K, 1)
    back = _extend_all(x, y, i - 1, j - 1, np.minimum(i - xs[:-1], j - ys[:-1]), -1)
    # What lies beyond the ends may not cost the match its similarity: the longest of four ways that doesn't.
    none = np.zeros_like(i), np.zeros_like(i)
    ways = [(v, u) for v in (ahead, none) for u in (back, none)]
    alike = [(K + v[1] + u[1]) >= similarity * (K + v[0] + u[0]) - 1e-9 for v, u in ways]
    way = np.argmax([np.where(ok, v[0] + u[0], -1) for ok, (v, u) in zip(alike, ways, strict=True)], axis=0)
    after, before = np.where(way < 2, ahead, 0), np.where(way % 2 == 0, back, 0)
    same = (K + after[1] + before[1]) / (K + after[0] + before[0])
    return [doc, source, at - before[0], at + K + after[0], other - before[0], other + K + after[0], same]


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text) -> (doc_id, start_word, end_word, source_doc_id, source_start, source_end, similarity).

    A row for each passage of min_words words or more (of A-Z lower-cased text, in positions from 0, the end not
    included) that repeats, with that similarity or more, what smaller doc_ids have; the source is the one with
    the longest part of it, ties by smaller doc_id. The first document of a passage has no row for it, nor has
    repetition inside one document. Null texts, null ids, and texts shorter than a passage have none. Rows
    that share a doc_id are versions of one document: a passage counts that any of them has.
    """
    with temporary() as work:  # seeds and matches are many times larger than chains
        found = work.keep(materialize(chained(matches(materialize(seeds(docs), "seeds"))), "chains", compact=4))
    low = lambda c: F.greatest(F.lit(0), F.expr(f"{c}[0]") - REACH)
    high = lambda c: F.element_at(c, -1) + K + REACH
    c = found.select("*", low("at").alias("s"), high("at").alias("e"), low("source_at").alias("ss"), high("source_at").alias("se"))
    wanted = c.select("doc", F.col("s").alias("start"), F.col("e").alias("stop")).unionByName(c.select(F.col("source").alias("doc"), F.col("ss").alias("start"), F.col("se").alias("stop"))).distinct()
    with temporary() as work:
        got = work.keep(materialize(slices(docs, materialize(wanted, "slices-wanted", compact=4)), "slices"))
    named = lambda p: got.select(*(F.col(n).alias(p + n) for n in got.columns))
    c = c.join(named("a_"), (F.col("doc") == F.col("a_doc")) & (F.col("s") == F.col("a_start")) & (F.col("e") == F.col("a_stop")))
    c = c.join(named("b_"), (F.col("source") == F.col("b_doc")) & (F.col("ss") == F.col("b_start")) & (F.col("se") == F.col("b_stop")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for b in batches:
            lone = pc.equal(pc.list_value_length(b.column("at")), 1)
            yield batch(align_lone(b.filter(lone), similarity))
            d = b.filter(pc.invert(lone)).to_pydict()
            out = []
            for i, (s, ss) in enumerate(zip(d["s"], d["ss"], strict=True)):
                x, y = np.frombuffer(d["a_words"][i], np.uint32), np.frombuffer(d["b_words"][i], np.uint32)
                for u, v, p, q, same in align(x, y, [z - s for z in d["at"][i]], [z - ss for z in d["source_at"][i]], similarity):
                    out.append((d["doc"][i], d["source"][i], s + u, s + v, ss + p, ss + q, same))
            yield batch(list(zip(*out)) or [()] * 7)

    def batch(cols: list) -> pa.RecordBatch:
        return pa.record_batch([*(pa.array(x, pa.int64()) for x in cols[:2]), *(pa.array(x, pa.int32()) for x in cols[2:6]), pa.array(cols[6], pa.float64())], names=["doc", "source", "start", "stop", "source_start", "source_stop", "same"])

    aligned = c.select("doc", "source", "at", "source_at", "s", "ss", "a_words", "b_words").mapInArrow(run, "doc long, source long, start int, stop int, source_start int, source_stop int, same double").where(F.col("same") >= similarity)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for g in _runs(batches, "doc"):
            open_: list[int] = []
            for i in range(len(g["doc"]) + 1):
                if open_ and (i == len(g["doc"]) or g["start"][i] > max(g["stop"][o] for o in open_[-1:]) and g["start"][i] > reach):
                    start, stop = int(g["start"][open_[0]]), int(reach)
                    if stop - start >= min_words:
                        b = max(open_, key=lambda o: (g["stop"][o] - g["start"][o], -g["source"][o]))
                        rows.append((int(g["doc"][0]), start, stop, int(g["source"][b]), int(g["source_start"][b]), int(g["source_stop"][b]), float(g["same"][b])))
                    open_ = []
                if i < len(g["doc"]):
                    reach = g["stop"][i] if not open_ else max(reach, g["stop"][i])
                    open_.append(i)
        cols = list(zip(*rows)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.record_batch([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=PASSAGE)

    dealt = aligned.repartition("doc").sortWithinPartitions("doc", "start", F.desc("stop"), "source")
    return dealt.mapInArrow(unite, "doc_id long, start_word long, end_word long, source_doc_id long, source_start long, source_end long, similarity double")


PASSAGE = ["doc_id", "start_word", "end_word", "source_doc_id", "source_start", "source_end", "similarity"]


def numbered(docs: DataFrame) -> DataFrame:
    """docs, packed, with passage_id, by which no two different texts go: the doc_id where it is the only one or its row
    the first of those that share it (by key); else, and for a null doc_id, a number above 2 ** 62."""
    keyed = packed(docs, row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    first = keyed.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("shared")).agg(F.min("row_key").alias("first"), F.max("row_key").alias("last")).where("first <> last")
    first = bounded(materialize(first.select("shared", "first"), "shared-ids", compact=16), BROADCAST_ROWS)
    both = keyed.join(first, F.col("doc_id") == F.col("shared"), "left")
    own = F.col("row_key").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    is_first = F.col("doc_id").isNotNull() & (F.col("shared").isNull() | (F.col("row_key") == F.col("first")))
    return both.select(ROW, F.when(is_first, F.col("doc_id")).otherwise(own).alias("passage_id"), "text")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the passages that earlier documents have. Rows that share a doc_id, and rows without
    one, are documents of their own; identical ones are cut alike."""
    rows = numbered(docs)
    found = repeated_passages(rows.select(F.col("passage_id").alias("doc_id"), "text"))
    return unpacked(_cut(rows, found), docs, text=F.col("text"))


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs, all columns, with the passages cut out of their texts; a document that they make wordless goes.

    Spaces before a passage stay, those after it go with it. Documents without passages stay as they are.
    """
    rows = packed(docs, F.col("doc_id").cast("long").alias("passage_id"), F.col("text"))
    return unpacked(_cut(rows, passages), docs, text=F.col("text"))


def _cut(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """(row_, passage_id, text) with passages cut out of texts."""
    cuts = passages.groupBy(F.col("doc_id").alias("cut_doc")).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("cut_spans"))
    both = rows.join(bounded(materialize(cuts, "cuts"), BROADCAST_ROWS), F.col("passage_id") == F.col("cut_doc"), "left")
    # Spaces and words in turn, from the spaces before the first word (maybe none) on. Each split stands outside
    # the lambda, which would else repeat it for every word.
    kept = F.expr(
        r"""filter(transform(zip_with(split(text, '[^\\x20\\x09-\\x0D]+'), filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> ''), (s, w) -> concat(s, w)),
            (x, i) -> IF(exists(cut_spans, c -> i >= c.start_word AND i < c.end_word), NULL, x)), x -> x IS NOT NULL)"""
    )
    both = both.withColumn("kept", F.when(F.col("cut_doc").isNotNull(), kept)).where("cut_doc IS NULL OR size(kept) > 0")
    text = F.when(F.col("cut_doc").isNull(), F.col("text")).otherwise(F.concat(F.array_join("kept", ""), F.regexp_extract("text", r"([\x20\x09-\x0D]*)\z", 1)))
    return both.select(ROW, text.alias("text"))
