"""Collocations: phrases of two to five words that occur together more often than their parts suggest.

Texts are read once into shards: a list of words and the texts as numbers in it. Each shard then becomes a count trie of
the windows of up to five words that begin at its words, serialised in sorted order and front-coded. Tries are cut by
ranges of their first two words and merged, run by run, for each range; a walk over the merged trie gives every
phrase's count and its left parts' (its ancestors). Right parts come by suffix links, a join with the phrase less its first
word, repeated.

Before tries are built, windows that can't be frequent are left out, exactly: a phrase is no more frequent than its parts,
and parts of up to four words are counted into hashed buckets of a fixed number first. A bucket's count is that of its parts together, so
what lies in a bucket below the threshold is below it. Buckets above are a bit map of a fixed size, which is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import bounded, temporary
from .common import batches_of, materialize, only, rested, texts

#: Words of a phrase, at most.
DEPTH = 5
#: Words of a shard, windows of a trie, about; words of one trie, at most.
SHARD, WINDOWS, TRIE_WORDS = 1 << 18, 1 << 19, 1 << 18
#: Buckets that a task holds before it gives them away; words to each range of tries, at most.
HELD, RANGE_WORDS = 1 << 21, 1 << 21
#: Bytes of a row group of shards and buckets.
GROUP = 8 << 20
#: Shards, and parts of tries, that go to Python at a time.
SHARD_ROWS, TRIE_ROWS = 8, 64
#: Phrases that leave Python at a time.
FOUND_ROWS = 4000
#: Bytes of a text that are split at a time.
BYTES = 1 << 22
#: Buckets of a level at most, and of one row of them, as powers of two.
BITS, ROW_BITS = 26, 20
#: Lengths whose windows are counted into buckets, with the buckets they have, as powers of two: words are few.
LEVELS = {1: 22, 2: BITS, 3: BITS, 4: BITS - 1}
#: Frequent single words that may be broadcast.
BROADCAST_WORDS = 500_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
GAP, SKIP = -1, -2
A, B, C = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
UNKNOWN = "und"

SHARDS = "names array<string>, words binary, langs binary, ids binary, totals array<struct<lang: string, n: long>>, slot int, places binary, held binary"
TRIES = "range int, names array<string>, words binary, langs binary, shared binary, depth binary, labels binary, counts binary"
FOUND = "lang string, size int, phrase string, a long, lefts array<long>, head string, tail string, body string"


class Words(dict):
    """Numbers of the words of one language in a shard; a new word gets the next one of the shard."""

    def __init__(self, lang: int, held: list[tuple[int, bytes]]) -> None:
        super().__init__({b"\n": GAP, b"": SKIP})
        self.lang, self.held = lang, held

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self.held)
        self.held.append((self.lang, word))
        return self[word]


def blocks(text: bytes) -> Iterator[bytes]:
    """The text in blocks that end at a space or a line's end, or with the text."""
    at = 0
    while at < len(text):
        end = at + BYTES
        if end < len(text):
            ends = [i for c in (b" ", b"\n") if (i := text.find(c, end)) >= 0]
            end = min(ends, default=len(text))
        yield text[at:end]
        at = end


class Shard:
    """Words as (language, word), and texts as their numbers. GAP parts pieces; a number n stored as -3 - n is read on but begins no window."""

    def __init__(self, names: list[str], words: list[tuple[int, bytes]], ids: np.ndarray) -> None:
        self.names, self.words = names, words
        self.at = np.where(ids <= -3, -3 - ids, ids)
        self.begins, self.there = ids >= 0, self.at >= 0
        self.ids = ids
        seeds = [xxhash.xxh64_intdigest(n.encode("utf-8", "surrogatepass")) for n in names]
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seeds[i]) for i, w in words), np.uint64, len(words))

    def row(self) -> dict:
        used = np.bincount(self.at[self.begins], minlength=len(self.words))
        counts = np.bincount(np.array([i for i, _ in self.words], np.int64), used, len(self.names))
        return {
            "names": self.names, "words": b"\n".join(w for _, w in self.words), "langs": narrow(np.array([i for i, _ in self.words], np.int64)), "ids": self.placed(),
            "totals": [{"lang": n, "n": int(c)} for n, c in zip(self.names, counts, strict=True)],
        }

    def placed(self) -> bytes:
        """How many words at the end are read on, gaps among them included, and numbers from 1, with 0 for a gap."""
        on = np.flatnonzero(self.ids <= -3)
        return bytes([len(self.ids) - int(on[0]) if len(on) else 0]) + narrow(self.at + 1)

    @classmethod
    def load(cls, r: dict) -> Shard:
        ids, on = wide(r["ids"][1:]).astype(np.int32) - 1, r["ids"][0]
        if on:
            ids[-on:] = np.where(ids[-on:] >= 0, -3 - ids[-on:], ids[-on:])
        return cls(r["names"], list(zip(wide(r["langs"]).tolist(), listed(r["words"]), strict=True)), ids)

    def windows(self, size: int) -> np.ndarray:
        """Hashes of the windows of so many words at each place; where such a window isn't, any number."""
        h = self.hashes[self.at] if len(self.words) else np.zeros(len(self.at), np.uint64)
        g = h * A
        for d in range(1, size):
            g[:-d] = (g[:-d] ^ (g[:-d] >> np.uint64(31))) * B + h[d:]
        return mixed(g)

    def whole(self, size: int) -> np.ndarray:
        """Places where a window of so many words is."""
        out = self.there.copy()
        for d in range(1, size):
            out[-d:] = False
            out[:-d] &= self.there[d:]
        return out


def listed(words: bytes) -> list[bytes]:
    """Words that were joined by line ends, which none of them holds; none is empty."""
    return words.split(b"\n") if words else []


def mixed(g: np.ndarray) -> np.ndarray:
    g = (g ^ (g >> np.uint64(32))) * C
    return g ^ (g >> np.uint64(29))


def bucket(h: np.ndarray, level: int = 2) -> np.ndarray:
    return (h >> np.uint64(64 - LEVELS[level])).astype(np.uint32)


def read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of (text, lang) rows."""
    names: dict[str, int] = {}
    words: list[tuple[int, bytes]] = []
    known: dict[str, Words] = {}
    ids: list[int] = []

    def owner(name: str) -> Words:
        if name not in known:
            known[name] = Words(names.setdefault(name, len(names)), words)
        return known[name]

    def made(most: int) -> Shard:
        a = np.array(ids, np.int32)
        a = a[a != SKIP]
        if most:  # the last words are read on, and begin windows in the next shard
            tail = max(0, len(a) - most)
            a[tail:] = np.where(a[tail:] >= 0, -3 - a[tail:], a[tail:])
        return Shard(list(names), list(words), a)

    for b in batches:
        for t, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
            if not t.is_valid:
                continue
            for block in blocks(t.as_buffer().to_pybytes().translate(LOWER)):
                ids += map(owner(lang).__getitem__, block.replace(b"\n", b" \n ").split(b" "))
                if len(ids) >= SHARD:
                    rest = [i for i in ids if i != SKIP][1 - DEPTH :]
                    of, old = list(names), words
                    yield made(DEPTH - 1)
                    names, words, known, ids = {}, [], {}, []
                    for i in rest:
                        name = of[old[i][0]] if i >= 0 else lang
                        ids.append(owner(name)[old[i][1]] if i >= 0 else GAP)
            ids.append(GAP)
    if ids:
        yield made(0)


class Counts:
    """Counts of numbers below 2^32, cut off at `most`, which is below 2^8: as many bytes as there are numbers, whatever their range."""

    def __init__(self, most: int) -> None:
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append(keys.astype(np.uint64) << np.uint64(8) | np.minimum(counts, self.most).astype(np.uint64))
        self.size += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers in order, and their counts."""
        every = np.sort(np.concatenate([np.zeros(0, np.uint64), *self.parts]))
        keys, n = every >> np.uint64(8), every & np.uint64(255)
        del every
        new = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
        if len(new):
            keys, n = keys[new], np.minimum(np.add.reduceat(n, new), np.uint64(self.most))
        self.parts, self.size = [keys << np.uint64(8) | n], len(keys)
        return keys.astype(np.int64), n.astype(np.uint8)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        own, n = self.merged()
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return np.where(own[at] == keys, n[at], 0) if len(own) else np.zeros(len(keys), np.uint8)


class Buckets:
    """Counts of hashed windows, cut off at `most`, of which about HELD are held at a time."""

    def __init__(self, levels: tuple[int, ...], most: int) -> None:
        self.held = {n: Counts(most) for n in levels}

    def add(self, level: int, hashes: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.held[level].add(bucket(hashes, level), counts)

    def full(self) -> bool:
        """Whether it's time for rows(): not if most of what came are the same buckets again."""
        if sum(c.size for c in self.held.values()) <= HELD:
            return False
        for c in self.held.values():
            c.merged()
        return sum(c.size for c in self.held.values()) > HELD // 2

    def rows(self) -> Iterator[dict]:
        """What is held, which is empty then."""
        for level, held in self.held.items():
            keys, n = held.merged()
            held.parts, held.size = [], 0
            if not len(keys):
                continue
            slots = keys >> ROW_BITS
            cuts = np.flatnonzero(np.diff(slots, prepend=-1))
            for i, j in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                at = keys[i:j] & ((1 << ROW_BITS) - 1)
                gaps, counts = np.diff(at, prepend=0), n[i:j]
                gaps = gaps.astype("<u2" if gaps.max() < 1 << 16 else "<u4")
                if sparse := 3 * len(at) < 1 << ROW_BITS:
                    gaps = bytes([gaps.dtype.itemsize]) + gaps.tobytes()
                else:
                    counts = np.zeros(1 << ROW_BITS, np.uint8)
                    counts[at] = n[i:j]
                yield {"slot": (level << (BITS - ROW_BITS)) + int(slots[i]), "places": gaps if sparse else None, "held": counts.tobytes()}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = SHARD_ROWS) -> Iterator[pa.RecordBatch]:
    for some in batched(rows, size):
        yield _batch(list(some), schema)


ARROW_SHARDS = pa.schema([("names", pa.list_(pa.string())), ("words", pa.binary()), ("langs", pa.binary()), ("ids", pa.binary()), ("totals", pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))), ("slot", pa.int32()), ("places", pa.binary()), ("held", pa.binary())])
ARROW_TRIES = pa.schema([("range", pa.int32()), ("names", pa.list_(pa.string())), ("words", pa.binary()), ("langs", pa.binary()), ("shared", pa.binary()), ("depth", pa.binary()), ("labels", pa.binary()), ("counts", pa.binary())])
ARROW_FOUND = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("a", pa.int64()), ("lefts", pa.list_(pa.int64())), ("head", pa.string()), ("tail", pa.string()), ("body", pa.string())])


def scanned(docs: DataFrame, least: int) -> DataFrame:
    """Shards of (text, lang), and rows of buckets of their words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        rested()
        buckets = Buckets((1, 2), least)
        for s in read_shards(batches):
            if len(s.words):
                buckets.add(1, mixed(s.hashes * A), np.bincount(s.at[s.begins], minlength=len(s.words)))
                buckets.add(2, s.windows(2)[s.whole(2) & s.begins])
            yield _batch([s.row()], ARROW_SHARDS)
            if buckets.full():
                yield from _batches(buckets.rows(), ARROW_SHARDS)
        yield from _batches(buckets.rows(), ARROW_SHARDS)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    return texts(docs, F.col("text").cast("string").alias("text"), lang.alias("lang")).mapInArrow(run, SHARDS)


def bit_maps(rows: DataFrame, least: int) -> dict[int, np.ndarray]:
    """By level, a bit for each bucket: whether it holds `least` windows. A fixed number of bytes, whatever the rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        rested()
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, places, held in zip(*(b.column(n).to_pylist() for n in ("slot", "places", "held")), strict=True):
                if slot not in sums:
                    sums[slot] = np.zeros(1 << ROW_BITS, np.uint8)
                to, n = sums[slot], np.frombuffer(held, np.uint8).astype(np.uint16)
                at = slice(None) if places is None else np.cumsum(np.frombuffer(places, f"<u{places[0]}", offset=1), dtype=np.int64)
                to[at] = np.minimum(to[at] + n, least)
        for slot, n in sums.items():
            yield pa.record_batch([pa.array([slot], pa.int32()), pa.array([np.packbits(n >= least).tobytes()], pa.binary())], names=["slot", "bits"])

    spark = rows.sparkSession
    dealt = rows.where("slot IS NOT NULL").select("slot", "places", "held").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "slot")  # by hash, as ranges would make the rows twice
    out: dict[int, np.ndarray] = {}
    step = 1 << (ROW_BITS - 3)
    with batches_of(spark, SHARD_ROWS):
        found = dealt.mapInArrow(add, "slot int, bits binary").collect()
    for r in found:
        level, k = divmod(r["slot"], 1 << (BITS - ROW_BITS))
        to = out.setdefault(level, np.zeros(1 << (LEVELS[level] - 3), np.uint8))
        to[k * step : (k + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return out


def passed(maps: dict[int, np.ndarray], level: int, hashes: np.ndarray) -> np.ndarray:
    if level not in maps:
        return np.zeros(len(hashes), bool)
    at = bucket(hashes, level)
    return (maps[level][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def open_windows(s: Shard, maps: dict[int, np.ndarray], upto: int) -> list[np.ndarray]:
    """For each length up to `upto`, the places whose window may be frequent: both its parts may be, and so may its bucket where that is known."""
    if not s.words:
        return [np.zeros(len(s.at), bool)] * upto
    fine = passed(maps, 1, mixed(s.hashes * A))
    out = [s.there & fine[s.at]]
    for d in range(2, upto + 1):
        before = out[-1]
        now = np.zeros(len(before), bool)
        now[:-1] = before[:-1] & before[1:]
        at = np.flatnonzero(now)
        if d in maps and len(at):
            now[at[~passed(maps, d, s.windows(d)[at])]] = False
        out.append(now)
    return out


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for b in batches:
        for i in range(len(b)):
            yield Shard.load({n: b.column(n)[i].as_py() for n in ("names", "words", "langs", "ids")})


def narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the greatest needs, after a byte that tells how many."""
    most = int(numbers.max(initial=0))
    size = next(n for n in (1, 2, 4, 8) if most < 1 << 8 * n)
    return bytes([size]) + numbers.astype(f"<u{size}").tobytes()


def wide(held: bytes) -> np.ndarray:
    return np.frombuffer(held, f"<u{held[0]}", offset=1).astype(np.int64)


class Trie:
    """Sorted windows with their counts: ranks from 1 in the sorted words (language, word), 0 past a window's end."""

    def __init__(self, words: list[tuple[str, bytes]], windows: np.ndarray, counts: np.ndarray) -> None:
        self.words, self.windows, self.counts = words, windows, counts

    @classmethod
    def merged(cls, runs: list[tuple[list[tuple[str, bytes]], np.ndarray, np.ndarray]]) -> Trie:
        """Runs of (words, windows as numbers from 1 in them, counts), merged. The sort finds sorted runs and merges those."""
        words = sorted({w for r in runs for w in r[0]})
        rank = {w: i + 1 for i, w in enumerate(words)}
        parts = []
        for own, windows, _ in runs:
            to = np.zeros(len(own) + 1, np.int32)
            to[1:] = [rank[w] for w in own]
            parts.append(to[windows])
        del rank
        w = np.concatenate(parts) if parts else np.zeros((0, DEPTH), np.int32)
        n = np.concatenate([r[2] for r in runs]) if runs else np.zeros(0, np.int64)
        del parts
        k = max(1, len(words).bit_length())
        a, b, c, d, e = (w[:, i].astype(np.int64) if 3 * k <= 62 else w[:, i] for i in range(DEPTH))
        keys = [e, d, c, b, a] if 3 * k > 62 else [(c << 2 * k) | (d << k) | e, (a << k) | b]
        del a, b, c, d, e
        order = np.lexsort(keys)
        del keys
        w, n = w[order], n[order]
        del order
        if len(w):
            new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]).any(1)]))
            w, n = w[new], np.add.reduceat(n, new)
        return cls(words, w, n)

    def serialised(self, ranges: int) -> Iterator[dict]:
        """The trie cut by ranges of the hash of its first two words, each part sorted and front-coded."""
        if not len(self.windows):
            return
        h = np.zeros(len(self.words) + 1, np.uint64)
        h[1:] = [xxhash.xxh64_intdigest(w, xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))) for lang, w in self.words]
        key = mixed(h[self.windows[:, 0]] * A + h[self.windows[:, 1]] * B)
        at = ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
        for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True):
            rows = order[i:j]
            w = self.windows[rows]
            depth = (w > 0).sum(1)
            shared = np.concatenate([[0], np.cumprod((w[1:] == w[:-1]) & (w[1:] > 0), axis=1).sum(1)])
            places = np.arange(DEPTH)
            labels = w[(places >= shared[:, None]) & (places < depth[:, None])]
            used, local = np.unique(labels, return_inverse=True)
            words = [self.words[u - 1] for u in used]
            names = {n: k for k, n in enumerate(dict.fromkeys(lang for lang, _ in words))}
            yield {
                "range": int(at[rows[0]]), "names": list(names), "words": b"\n".join(x for _, x in words), "langs": narrow(np.array([names[lang] for lang, _ in words], np.int64)),
                "shared": shared.astype(np.uint8).tobytes(), "depth": depth.astype(np.uint8).tobytes(), "labels": narrow(local), "counts": narrow(self.counts[rows]),
            }

    @staticmethod
    def parsed(r: dict) -> tuple[list[tuple[str, bytes]], np.ndarray, np.ndarray]:
        """A run: words, windows as numbers from 1, counts."""
        words = [(r["names"][i], w) for i, w in zip(wide(r["langs"]).tolist(), listed(r["words"]), strict=True)]
        shared, depth = (np.frombuffer(r[n], np.uint8).astype(np.int64) for n in ("shared", "depth"))
        places = np.arange(DEPTH)
        given = (places >= shared[:, None]) & (places < depth[:, None])
        w = np.zeros(given.shape, np.int32)
        w[given] = wide(r["labels"]) + 1
        last = np.maximum.accumulate(np.where(given, np.arange(len(w))[:, None], 0), axis=0)
        return words, np.where(places < depth[:, None], np.take_along_axis(w, last, 0), 0), wide(r["counts"])

    def frequent(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By length, the windows that occur `least` times, with the counts of their beginnings from two words on and their own."""
        w, n = self.windows, self.counts
        single = np.flatnonzero((w[:, 1] == 0) & (n >= least))
        yield w[single, :1], n[single][:, None]
        deep = w[:, 1] > 0
        w, n = w[deep], n[deep]
        if not len(w):
            return
        same = np.cumprod(w[1:] == w[:-1], axis=1).astype(bool)
        sums = []  # for each row, how often its beginning of two words, three words ... occurs
        for d in range(2, DEPTH + 1):
            first = np.concatenate([[True], ~same[:, d - 1]])
            at = np.flatnonzero(first)
            sums.append(np.add.reduceat(n, at)[np.cumsum(first) - 1])
            hit = np.flatnonzero(first & (w[:, d - 1] > 0) & (sums[-1] >= least))
            yield w[hit, :d], np.stack([s[hit] for s in sums], 1)


def combined(runs: Iterator[tuple[list[tuple[str, bytes]], np.ndarray, np.ndarray]]) -> Iterator[Trie]:
    """Runs of (words, windows, counts) merged into tries of half of WINDOWS different windows or TRIE_WORDS words, or more, but for the last.

    A trie takes up runs as long as it stays below, so that windows which come again and again leave a task once.
    """
    held, rows, words = [], 0, 0
    for run in runs:
        held.append(run)
        rows, words = rows + len(run[2]), words + len(run[0])
        if rows > WINDOWS // 2 or words > TRIE_WORDS // 2:
            t = Trie.merged(held)
            held, rows, words = [], 0, 0  # what is in the trie doesn't count as new
            if len(t.counts) > WINDOWS // 2 or len(t.words) > TRIE_WORDS // 2:
                yield t
            else:
                held.append((t.words, t.windows, t.counts))
    if held:
        yield Trie.merged(held)


def counted(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(text, lang) -> all phrases of up to five words that occur `least` times, with their left parts; and words by lang."""
    with temporary() as work:  # shards, buckets and tries go when phrases are counted
        found, totals = _counted(docs, least)
        return work.keep(found), work.keep(totals)


def _counted(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    most = min(least, 255)
    shards = materialize(scanned(docs, most), "phrase-shards", group=GROUP)
    totals = shards.select(F.explode("totals").alias("t")).groupBy("t.lang").agg(F.sum("t.n").alias("n"))
    totals = materialize(totals, "phrase-totals", compact=16)
    texts_ = shards.where("slot IS NULL").select("names", "words", "langs", "ids")
    maps = spark.sparkContext.broadcast(bit_maps(shards, most))  # 8 MB a level

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        rested()
        buckets = Buckets((3, 4), most)
        for s in _loaded(batches):
            fine = open_windows(s, {k: v for k, v in maps.value.items() if k < 3}, 4)
            for level in buckets.held:
                buckets.add(level, s.windows(level)[fine[level - 1] & s.begins])
            if buckets.full():
                yield from _batches(buckets.rows(), ARROW_SHARDS)
        yield from _batches(buckets.rows(), ARROW_SHARDS)

    more = texts_.mapInArrow(longer, SHARDS)  # straight to the one shuffle that reads them: each file that a task writes to a local disk starts chmod twice
    maps = spark.sparkContext.broadcast({**maps.value, **bit_maps(more, most)})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(2 * parts, -(-(totals.agg(F.sum("n")).first()[0] or 0) // RANGE_WORDS))  # however few the partitions, a range doesn't grow with the texts

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        rested()
        for t in combined(map(run, _loaded(batches))):
            yield from _batches(t.serialised(ranges), ARROW_TRIES, TRIE_ROWS)

    def run(s: Shard) -> tuple[list[tuple[str, bytes]], np.ndarray, np.ndarray]:
        fine = open_windows(s, maps.value, DEPTH)
        one = np.bincount(s.at[fine[0] & s.begins], minlength=len(s.words))
        used = np.flatnonzero(one)
        begins = np.flatnonzero(fine[1] & s.begins)
        w = np.zeros((len(used) + len(begins), DEPTH), np.int32)
        to = np.zeros(len(s.words) + 1, np.int32)
        every = np.unique(s.at[fine[0]])
        to[every] = np.arange(1, len(every) + 1)
        w[: len(used), 0] = to[used]
        w[len(used) :, 0] = to[s.at[begins]]
        for d in range(1, DEPTH):
            go = np.flatnonzero(fine[d][begins])
            w[len(used) + go, d] = to[s.at[begins[go] + d]]
        return [(s.names[s.words[i][0]], s.words[i][1]) for i in every.tolist()], w, np.concatenate([one[used], np.ones(len(begins), np.int64)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        rested()
        range_, held, waiting, rows, words = None, None, [], 0, 0

        def settle() -> Trie:
            return Trie.merged([*([(held.words, held.windows, held.counts)] if held else []), *waiting])

        for b in batches:
            for i in range(len(b)):
                r = {n: b.column(n)[i].as_py() for n in ARROW_TRIES.names}
                if r["range"] != range_:
                    if range_ is not None:
                        yield from found(settle())
                    range_, held, waiting, rows, words = r["range"], None, [], 0, 0
                waiting.append(Trie.parsed(r))
                rows, words = rows + len(waiting[-1][2]), words + len(waiting[-1][0])
                if rows > max(WINDOWS // 2, len(held.counts) if held else 0) or words > max(TRIE_WORDS, len(held.words) if held else 0):
                    held, waiting, rows, words = settle(), [], 0, 0
        if range_ is not None:
            yield from found(settle())

    def found(t: Trie) -> Iterator[pa.RecordBatch]:
        for w, n in t.frequent(least):
            for i in range(0, len(w), FOUND_ROWS):
                out = []
                for ranks, sums in zip(w[i : i + FOUND_ROWS].tolist(), n[i : i + FOUND_ROWS].tolist(), strict=True):
                    own = [t.words[k - 1][1].decode("utf-8", "surrogatepass") for k in ranks]
                    out.append({"lang": t.words[ranks[0] - 1][0], "size": len(own), "phrase": " ".join(own), "a": sums[-1], "lefts": sums[:-1], "head": own[0], "tail": " ".join(own[1:]), "body": " ".join(own[:-1])})
                yield _batch(out, ARROW_FOUND)

    with batches_of(spark, SHARD_ROWS):
        cut = materialize(texts_.mapInArrow(tries, TRIES), "phrase-tries", compact=2)
    with batches_of(spark, TRIE_ROWS):
        dealt = cut.repartitionByRange(parts, "range").sortWithinPartitions("range")
        phrases = materialize(dealt.mapInArrow(merge, FOUND), "phrases", compact=4)
    return phrases, totals


def _exact(c: Column, digits: int) -> Column:
    return c.cast(f"decimal({digits},0)")


def collocations(docs: DataFrame, least: int = 100, within: int = 100, top: int = 2000) -> DataFrame:
    """(text, lang) -> (lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases.

    A null text is empty, a null lang is "und"; rows are counted as they are, repeated ones too, and columns but these two
    aren't looked at. Words of a phrase stand in one piece. l and r are the counts of the parts at the cut with the lowest
    score, the first of equal ones. A phrase goes if a longer one that holds it occurs at least `within` per cent as
    often; as a part is no rarer than the whole, longer ones by one word tell. Words must stay below 10^17. Without a
    phrase there is no row.
    """
    spark = docs.sparkSession
    phrases, totals = counted(docs, least)
    ones = phrases.where("size = 1")
    single = ones.select(F.col("lang").alias("lang_"), F.col("phrase").alias("word_"), F.col("a").alias("a_"))
    known = ones.select("lang", "phrase", "a", F.array().cast("array<long>").alias("rights"))
    every: list[DataFrame] = []
    for size in range(2, DEPTH + 1):  # suffix links: the tail's count, and what follows the tail's own
        suffix = known.select(F.col("lang").alias("lang_"), F.col("phrase").alias("tail_"), F.concat(F.array("a"), "rights").alias("rights"))
        of = phrases.where(F.col("size") == size)
        now = of.join(bounded(suffix, BROADCAST_WORDS) if size == 2 else suffix, (F.col("lang") == F.col("lang_")) & (F.col("tail") == F.col("tail_"))).drop("lang_", "tail_")
        known = materialize(now, "phrase-links", compact=16)
        every.append(known)
    linked = every[0]
    for more in every[1:]:
        linked = linked.unionByName(more)
    longer = linked.where("size > 2")
    holds = longer.select("lang", F.col("body").alias("part"), "a").unionByName(longer.select("lang", F.col("tail").alias("part"), "a"))
    holds = holds.groupBy(F.col("lang").alias("lang_"), F.col("part").alias("part_")).agg(F.max("a").alias("most_"))
    left = linked.join(holds, (F.col("lang") == F.col("lang_")) & (F.col("phrase") == F.col("part_")), "left").where(F.coalesce(100 * F.col("most_") < within * F.col("a"), F.lit(True))).drop("lang_", "part_", "most_")
    left = left.join(bounded(single, BROADCAST_WORDS), (F.col("lang") == F.col("lang_")) & (F.col("head") == F.col("word_"))).withColumn("lefts", F.concat(F.array("a_"), "lefts")).drop("lang_", "word_", "a_")
    left = left.join(bounded(totals.withColumnRenamed("lang", "lang_"), BROADCAST_WORDS), F.col("lang") == F.col("lang_"))
    above = _exact(F.col("a"), 17) * _exact(F.col("n") * 1000, 20)

    def cut(k: Column) -> Column:
        l, r = F.element_at("lefts", k), F.element_at("rights", k)  # noqa: E741
        return F.struct(F.call_function("div", above, _exact(l, 18) * _exact(r, 18)).alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut))
    scored = left.withColumn("cut", best).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
