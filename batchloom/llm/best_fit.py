"""Documents packed into sequences of a fixed number of tokens.

An instance of bin packing is, for sequences of at most `size` tokens, a table of lengths and how often each occurs:
no more rows than `size`, however many documents there are. That table alone goes to the driver. There dominance
reduction after Martello and Toth fixes sets that some best packing holds anyway, whole multiplicities at once; what
remains is packed best-fit, longest first, again by classes of equal sequences and not one by one. The resulting plan
is a bounded table of slots: the documents of one length, numbered from 0, fill its slots in order. Numbering is a
count for each length and salt, so that a length that a third of all documents have is spread over tasks.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, only, texts
from .vocab import byte_letters

SIZE = 2048
END = 0
#: Pieces numbered by one task, about.
GROUP = 1_000
#: Pieces that pairs of bytes are merged within, as the vocabulary file's pre-tokenizer cuts them; letters lead.
PIECE = r" ?\p{L}++|'(?:s|t|re|ve|m|ll|d)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s++"


class Encoder:
    """Ids of a byte-level vocabulary file, special strings inside texts included, as the tokenizers library gives them.

    A quicker library does the work: of a byte-level vocabulary an id is its token's rank. Tests hold it to the former.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.encode = tiktoken.Encoding("bytes", pat_str=PIECE, mergeable_ranks=ranks, special_tokens=special).encode_to_numpy

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return self.encode(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all are full but the first, which has the rest."""
    first = (n - 1) % size + 1
    return [(0, first), *((i, size) for i in range(first, n, size))]


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """(doc_id, text) -> (doc_id, piece, start, length, ids_crc32): ids of whole texts and an end, cut where they pass `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = only(("ids", path), lambda: Encoder(path))
        end = np.asarray([END], "<u4").tobytes()
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, t in zip(b.column("doc_id"), b.column("text"), strict=True):
                ids = encode(t.as_py() or "") + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, size)):
                    for c, v in zip(out, (i.as_py(), k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Pattern:
    """So many sequences with the same contents: (length, how often) in the order of their places."""

    count: int
    items: list[tuple[int, int]] = field(default_factory=list)


def reduce_instance(counts: dict[int, int], size: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences that some best packing holds, and what remains of the lengths and their counts.

    A set that fits dominates another one with the same item j if the other's items can be split so that each part is
    no longer than a different item of the first. A set that dominates every set with j can be fixed. With R = size - j,
    and k the longest other item that fits beside j, that is so for
    {j} if nothing fits beside j; {j, k} if k fills R, or if no two items fit beside j, or if no three do and no two
    are longer together than k; {j, k, m} if no three fit beside j, m is the longest that fits beside j and k, and every
    two that fit beside j have a shorter one of m at most or are not longer together than k.
    """
    left = {w: n for w, n in counts.items() if n > 0}
    fixed: list[Pattern] = []

    def fix(*lengths: int) -> None:
        times = {w: lengths.count(w) for w in lengths}
        m = min(left[w] // t for w, t in times.items())
        fixed.append(Pattern(m, sorted(times.items(), reverse=True)))
        for w, t in times.items():
            left[w] -= m * t
            if not left[w]:
                del left[w]

    def dominating(j: int) -> tuple[int, ...] | None:
        have = np.array(sorted(left), np.int64)
        n = np.array([left[w] - (w == j) for w in have.tolist()])
        have, n = have[n > 0], n[n > 0]
        room = size - j
        fits = have[have <= room]
        if not len(fits):
            return (j,)
        k = int(fits[-1])
        lowest = np.repeat(have[:3], np.minimum(n[:3], 3))[:3]
        if k == room or len(lowest) < 2 or int(lowest[:2].sum()) > room:
            return (j, k)
        if len(lowest) == 3 and int(lowest.sum()) <= room:
            return None
        # the longest partner of each length, itself only where it occurs twice
        at = np.searchsorted(have, room - have, side="right") - 1
        own = (at >= 0) & (have[at] == have) & (n[at] < 2)
        at = np.where(own, at - 1, at)
        ok = at >= 0
        a, b = have[ok], have[at[ok]]
        both, short = a + b, np.minimum(a, b)
        if not len(both) or k >= int(both.max()):
            return (j, k)
        mine = at[np.searchsorted(have, k)]
        if mine < 0:
            return None
        m = int(have[mine])
        worse = both[short > m]  # of each item the longest pair whose shorter one is above m
        if len(worse) and int(worse.max()) > k:
            return None
        return (j, k, m)

    changed = True
    while changed and left:
        changed = False
        for j in sorted(left, reverse=True):
            while j in left and (found := dominating(j)) is not None:
                fix(*found)
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], size: int) -> list[Pattern]:
    """Best-fit, longest first, for counted lengths: equal sequences are one class, filled together."""
    done: list[Pattern] = []
    room: dict[int, list[Pattern]] = {}
    for w in sorted(counts, reverse=True):
        n = counts[w]
        for r in sorted(r for r in room if r >= w):
            moved = []
            while n and room[r]:
                p, each = room[r].pop(), r // w
                full, rest = divmod(min(n, p.count * each), each)
                if p.count > full + (rest > 0):
                    room[r].append(Pattern(p.count - full - (rest > 0), list(p.items)))
                for times, m in ((each, full), (rest, 1)):
                    if times and m:
                        moved.append((r - times * w, Pattern(m, [*p.items, (w, times)])))
                        n -= times * m
            for to, p in moved:
                room.setdefault(to, []).append(p)
            if not n:
                break
        if n:
            each = size // w
            for times, m in ((each, n // each), (n % each, 1)):
                if times and m:
                    room.setdefault(size - times * w, []).append(Pattern(m, [(w, times)]))
    for r in room.values():
        done += r
    return done


def plan(counts: dict[int, int], size: int) -> dict[str, np.ndarray]:
    """Slots: a row for each length and pattern. `first`: numbers of the length before; then the pattern's first sequence, how many of the length each sequence takes, and where."""
    fixed, left = reduce_instance(counts, size)
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for p in [*fixed, *best_fit(left, size)]:
        offset = 0
        for w, times in p.items:
            rows.append((w, used[w], sequence, times, offset))
            used[w] += times * p.count
            offset += w * times
        sequence += p.count
    if used != dict(counts):
        raise AssertionError("the plan doesn't hold every piece once")
    rows.sort()
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(("length", "first", "sequence", "times", "offset"))}


def numbered(rows: DataFrame, counts: dict[int, int], group: int = GROUP) -> DataFrame:
    """rows with `number`: from 0 on for each length. `row` tells rows apart, also equal ones."""
    salts = rows.sparkSession.createDataFrame([(w, -(-n // group)) for w, n in sorted(counts.items())], "w_ long, salts_ long")
    dealt = rows.join(F.broadcast(salts), F.col("length") == F.col("w_")).withColumn("salt_", F.pmod(F.xxhash64("row"), "salts_"))
    sums = dealt.groupBy(F.col("length").alias("w_"), F.col("salt_").alias("s_")).agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("w_").orderBy("s_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("w_", "s_", before.alias("before_"))
    inside = F.row_number().over(Window.partitionBy("length", "salt_").orderBy("row"))
    placed = dealt.drop("w_", "salts_").withColumn("inside_", inside).join(sums, (F.col("length") == F.col("w_")) & (F.col("salt_") == F.col("s_")))
    return placed.withColumn("number", F.col("before_") + F.col("inside_") - 1).drop("w_", "s_", "salt_", "inside_", "before_")


def pack(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """(doc_id, text) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    A null or empty text has its end alone. Every row is a document, also rows that repeat a doc_id or have none; other
    columns are not looked at. Which of several documents of one length a sequence holds depends on how Spark has split
    the input; how many sequences there are and how full each is doesn't. An empty table gives no row.
    """
    if size < 1:
        raise ValueError("a sequence holds one token at least")
    spark = docs.sparkSession
    rows = materialize(pieces(docs, path, size).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `size` rows at most
    slots = plan(counts, size)
    shared = spark.sparkContext.broadcast(slots)  # a length and a class of sequences meet once, and classes are bounded by `size`

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            length, number = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            low, high = np.searchsorted(s["length"], length, "left"), np.searchsorted(s["length"], length, "right")
            while (open_ := high - low > 1).any():  # the last slot of this length that begins at or before the number
                mid = (low + high) // 2
                up = open_ & (s["first"][np.minimum(mid, len(s["first"]) - 1)] <= number)
                low, high = np.where(up, mid, low), np.where(open_ & ~up, mid, high)
            k = number - s["first"][low]
            sequence, offset = s["sequence"][low] + k // s["times"][low], s["offset"][low] + k % s["times"][low] * length
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*keep, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered(rows, counts).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
