"""Greedy cuts of ordered rows under limits, spread over tasks even where a single run is huge.

Where the next part begins depends on where the last one did, so the cuts are a chain through all rows. A block of
consecutive rows knows, by prefix sums and binary search, for each of its rows where a part that begins there would end,
and by doubling those pointers the last beginning that a chain through any of its rows has in the block. A chain that
enters a block can do so at few places, and leaves it from fewer; for each of those the entry into a later block is looked
up there. The maps from exit to exit compose: doubling them over blocks finds the exits on the real chain in a number of
rounds that is the logarithm of the blocks that the longest run spans. Each block then cuts its rows from its own entry.

The driver sees a row for each block, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bounded, materialize, temporary

#: Rows of a block, at most.
BLOCK = 50_000
#: Blocks whose look-ups may be broadcast.
LOOKUPS = 100_000
TOKENS, BYTES, ROW, HEAD = 0, 1, 2, 3

MEASURES = ["part", "seq", "tokens", "sizes", "changes"]
BLOCKS = "part int, seq int, n int, tokens binary, sizes binary, changes binary, batch_changes binary, token_sum long, size_sum long, first_change int, first array<string>, last array<string>, batches array<string>, ids array<string>, models array<string>"
ASSIGNED = "batch_uuid string, request_uuid string, model_name string, part_index long, position long, total_tokens long, byte_size long"


@dataclass(frozen=True)
class Most:
    """What a part holds at most."""

    tokens: int
    size: int
    records: int


class Pointers:
    """Rows of a block: the next beginning after each, and the last one of a chain through each. heads: rows that must begin a part."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, heads: np.ndarray, most: Most) -> None:
        n = self.n = len(tokens)
        self.tokens, self.sizes = np.concatenate([[0], np.cumsum(tokens)]), np.concatenate([[0], np.cumsum(sizes)])
        self.heads = np.flatnonzero(heads)
        rows = np.arange(n)
        head = np.append(self.heads, n)[np.searchsorted(self.heads, rows, "right")]
        end = np.minimum(self.passing(self.tokens, self.tokens[:-1] + most.tokens), self.passing(self.sizes, self.sizes[:-1] + most.size))
        self.next = np.append(np.minimum.reduce([end, rows + min(most.records, n), head, np.full(n, n)]), n)

    @staticmethod
    def passing(sums: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The first row with which the sum is above value; the number of rows if none."""
        return np.searchsorted(sums[1:], value, "right")

    def last(self) -> np.ndarray:
        powers, at = [self.next], np.arange(self.n)
        while (powers[-1][: self.n] < self.n).any():
            powers.append(powers[-1][powers[-1]])
        for p in reversed(powers):
            at = np.where(p[at] < self.n, p[at], at)
        return at

    def cuts(self, entry: int) -> np.ndarray:
        """Beginnings in the block of the chain that enters at a row; none if that lies behind the block."""
        out = []
        while entry < self.n:
            out.append(entry)
            entry = int(self.next[entry])
        return np.array(out, np.int64)


@dataclass
class Layout:
    """Of all blocks in order: numbers, rows and sums before each, and whether its first row begins a run or a batch. Closed by the totals."""

    number: dict[tuple[int, int], int] = field(default_factory=dict)
    rows: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    begins_run: list[bool] = field(default_factory=list)
    begins_batch: list[bool] = field(default_factory=list)
    head: list[int | None] = field(default_factory=list)

    @classmethod
    def of(cls, summaries: list[Any], by_model: bool) -> Layout:
        s = sorted(summaries, key=lambda r: (r["part"], r["seq"]))
        sums = [np.concatenate([[0], np.cumsum([r[c] for r in s], dtype=np.int64)]) for c in ("n", "token_sum", "size_sum")]
        out = cls({(r["part"], r["seq"]): k for k, r in enumerate(s)}, *sums)
        before = None
        for k, r in enumerate(s):
            batch = before is None or r["first"][0] != before[0]
            run = batch or (by_model and r["first"][1] != before[1])
            out.begins_batch.append(batch)
            out.begins_run.append(run)
            out.head.append(int(out.rows[k]) if run else int(out.rows[k]) + r["first_change"] if r["first_change"] is not None else None)
            before = r["last"]
        return out

    def next_head(self) -> list[int]:
        """For each block the first row behind it that begins a run, or the number of rows."""
        out, found = [0] * len(self.head), int(self.rows[-1])
        for k in range(len(self.head) - 1, -1, -1):
            out[k] = found
            found = found if self.head[k] is None else self.head[k]
        return out

    def block_of(self, row: int) -> int:
        return int(np.searchsorted(self.rows, row, "right")) - 1

    def longest_run(self) -> int:
        """Blocks in a row without the beginning of a run, at most."""
        longest = now = 0
        for h in self.head:
            now = now + 1 if h is None else 0
            longest = max(longest, now)
        return longest


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def blocks_of(rows: DataFrame, by_model: bool, block: int) -> DataFrame:
    """(batch_uuid, created_at, request_uuid, model_name, total_tokens, byte_size) -> blocks of rows in order of batch, time and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def changed(c: pa.Array) -> np.ndarray:
            code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            return np.concatenate([[False], code[1:] != code[:-1]])

        def one(t: pa.Table) -> pa.RecordBatch:
            columns = {c: t.column(c).combine_chunks() for c in t.column_names}
            n, batch = len(t), changed(columns["batch_uuid"])
            run_ = batch | changed(columns["model_name"]) if by_model else batch
            tokens, sizes = (columns[c].to_numpy(zero_copy_only=False).astype("<i8") for c in ("total_tokens", "byte_size"))
            ends = [[columns[c][i].as_py() for c in ("batch_uuid", "model_name")] for i in (0, n - 1)]
            first = np.flatnonzero(run_)
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), columns[c].cast(pa.string())) for c in ("batch_uuid", "request_uuid", "model_name")]
            values = [pa.array([v], k) for v, k in (
                (part, pa.int32()), (seq, pa.int32()), (n, pa.int32()), (tokens.tobytes(), pa.binary()), (sizes.tobytes(), pa.binary()), (np.packbits(run_).tobytes(), pa.binary()), (np.packbits(batch).tobytes(), pa.binary()),
                (int(tokens.sum()), pa.int64()), (int(sizes.sum()), pa.int64()), (int(first[0]) if len(first) else None, pa.int32()), (ends[0], pa.list_(pa.string())), (ends[1], pa.list_(pa.string())),
            )]
            return pa.record_batch([*values, *lists], names=[c.split(" ")[0] for c in BLOCKS.split(", ")])

        for b in batches:
            held.append(b)
            while (n := sum(map(len, held))) >= block:
                t = pa.Table.from_batches(held)
                yield one(t.slice(0, block))
                seq += 1
                held = t.slice(block).combine_chunks().to_batches() if n > block else []
        if sum(map(len, held)):
            yield one(pa.Table.from_batches(held))

    order = ["batch_uuid", "created_at", "request_uuid"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.select("batch_uuid", "request_uuid", "model_name", "total_tokens", "byte_size").mapInArrow(run, BLOCKS)


def _pointers(r: dict, at: Layout, most: Most) -> tuple[int, Pointers]:
    k = at.number[r["part"], r["seq"]]
    tokens = _ints(r["tokens"])
    heads = _flags(r["changes"], len(tokens))
    heads[0] = at.begins_run[k]
    return k, Pointers(tokens, _ints(r["sizes"]), heads, most)


def _exits(blocks: DataFrame, shared: Any, most: Most) -> DataFrame:
    """(node, sure, kind, target, value): from which rows chains leave a block, and where to look the next beginning up. sure: on the real chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, behind = shared.value
        end = int(at.rows[-1])
        for b in batches:
            out: list[tuple] = []
            for i in range(len(b)):
                k, p = _pointers({c: b.column(c)[i].as_py() for c in MEASURES}, at, most)
                if not p.n or at.rows[k + 1] == end:
                    continue
                last, sure = p.last(), bool(len(p.heads))
                exits = last[p.heads[-1:]] if sure else np.unique(last[: int(p.next[0]) + 1])
                for x in exits.tolist():
                    node, row, head = int(at.rows[k]) + x, int(at.rows[k]) + x + most.records, behind[k]
                    if head <= row:
                        out.append((node, sure, HEAD, k, head))
                    else:
                        out.append((node, sure, ROW, at.block_of(row), row))
                    for kind, sums, value in ((TOKENS, at.tokens, int(at.tokens[k] + p.tokens[x]) + most.tokens), (BYTES, at.sizes, int(at.sizes[k] + p.sizes[x]) + most.size)):
                        target = int(np.searchsorted(sums[1:], value, "right"))
                        if target < len(at.head) and at.rows[target] < min(row, head):
                            out.append((node, sure, kind, target, value))
            columns = [*zip(*out, strict=True)] or [()] * 5
            kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["node", "sure", "kind", "target", "value"])

    return blocks.select(*MEASURES).mapInArrow(run, "node long, sure boolean, kind int, target int, value long")


def _answers(blocks: DataFrame, exits: DataFrame, shared: Any, most: Most) -> DataFrame:
    """(node, entry, to): the next beginning after an exit, and the exit that a chain through it has; null where a run begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, _ = shared.value
        for b in batches:
            for i in range(len(b)):
                k, p = _pointers({c: b.column(c)[i].as_py() for c in MEASURES}, at, most)
                asked = b.column("asked")[i].values
                node, kind, value = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("node", "kind", "value"))
                rows = np.select([kind == TOKENS, kind == BYTES], [p.passing(p.tokens, value - at.tokens[k]), p.passing(p.sizes, value - at.sizes[k])], value - at.rows[k])
                ok = rows < p.n
                yield pa.record_batch([pa.array(node[ok]), pa.array(at.rows[k] + rows[ok]), pa.array(at.rows[k] + p.last()[rows[ok]])], names=["node", "entry", "to"])

    asked = exits.where(F.col("kind") != HEAD).groupBy("target").agg(F.collect_list(F.struct("node", "kind", "value")).alias("asked"))
    keys = exits.sparkSession.createDataFrame([(p, s, k) for (p, s), k in shared.value[0].number.items()], "p_ int, s_ int, target_ int")
    asked = asked.join(bounded(keys, LOOKUPS), F.col("target") == F.col("target_")).select("p_", "s_", "asked")
    joined = blocks.select(*MEASURES).join(bounded(materialize(asked, "cut-lookups", compact=16), LOOKUPS), (F.col("part") == F.col("p_")) & (F.col("seq") == F.col("s_")))
    found = joined.select(*MEASURES, "asked").mapInArrow(run, "node long, entry long, to long")
    known = exits.where(F.col("kind") == HEAD).select("node", F.col("value").alias("entry"), F.lit(None).cast("long").alias("to"))
    return found.unionByName(known).groupBy("node").agg(F.min(F.struct("entry", "to")).alias("best")).select("node", "best.entry", "best.to")


def entries(blocks: DataFrame, at: Layout, most: Most) -> tuple[dict[int, int], dict[int, int]]:
    """By block: its first beginning, which may lie behind it, and the row at which the part that is open before began. Blocks that begin with a run have neither."""
    if all(at.begins_run):
        return {}, {}
    with temporary():
        shared = blocks.sparkSession.sparkContext.broadcast((at, at.next_head()))  # a few numbers a block
        exits = materialize(_exits(blocks, shared, most), "cut-exits", compact=16)
        edges = materialize(_answers(blocks, exits, shared, most), "cut-edges", compact=16)
        reached = exits.where("sure").select("node").distinct()
        jumps = edges.where("to IS NOT NULL").select("node", "to")
        for k in range(at.longest_run().bit_length()):
            if k:
                jumps = materialize(jumps.join(jumps.select(F.col("node").alias("to"), F.col("to").alias("to_")), "to").select("node", F.col("to_").alias("to")), "cut-jumps", compact=16)
            reached = materialize(reached.unionByName(reached.join(jumps, "node").select(F.col("to").alias("node"))).distinct(), "cut-reached", compact=16)
        entry: dict[int, int] = {}
        began: dict[int, int] = {}
        for r in edges.join(reached, "node").collect():  # an exit a block
            for k in range(at.block_of(r["node"]) + 1, min(at.block_of(r["entry"]), len(at.head) - 1) + 1):
                entry[k], began[k] = r["entry"], r["node"]
    return entry, began


def assigned(rows: DataFrame, most: Most, by_model: bool = True, block: int = BLOCK) -> DataFrame:
    """(batch_uuid, created_at, request_uuid, model_name, total_tokens, byte_size) -> rows with the part they are in and their place there."""
    spark = rows.sparkSession
    blocks = materialize(blocks_of(rows, by_model, block), "cut-blocks")
    at = Layout.of(blocks.select("part", "seq", "n", "token_sum", "size_sum", "first_change", "first", "last").collect(), by_model)
    entry, began = entries(blocks, at, most)
    shared = spark.sparkContext.broadcast((at, entry, began))

    def cut(r: dict) -> tuple[int, np.ndarray, np.ndarray]:
        """The block's number, its beginnings, and for each row whether a batch begins."""
        at, entry, _ = shared.value
        k, p = _pointers(r, at, most)
        batch = _flags(r["batch_changes"], p.n)
        batch[0] = at.begins_batch[k]
        return k, p.cuts(0 if at.begins_run[k] else entry[k] - int(at.rows[k])), batch

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                k, cuts, batch = cut({c: b.column(c)[i].as_py() for c in (*MEASURES, "batch_changes")})
                begin = np.flatnonzero(batch)
                n = len(cuts) if not len(begin) else int((cuts > begin[-1]).sum())
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([bool(len(begin))]), pa.array([n], pa.int64())], names=["block", "begins", "n"])

    carry, now = {}, 0
    if not all(at.begins_batch):
        for r in sorted(blocks.select(*MEASURES, "batch_changes").mapInArrow(ends, "block int, begins boolean, n long").collect(), key=lambda r: r["block"]):
            carry[r["block"]] = now
            now = r["n"] if r["begins"] else now + r["n"]
    carried = spark.sparkContext.broadcast(carry)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                r = {c: b.column(c)[i].as_py() for c in (*MEASURES, "batch_changes")}
                k, cuts, batch = cut(r)
                first, n = int(shared.value[0].rows[k]), len(batch)
                flag = np.zeros(n, np.int64)
                flag[cuts] = 1
                number = np.cumsum(flag)
                since = np.maximum.accumulate(np.where(batch, np.arange(n), -1))
                part = np.where(since >= 0, number - number[since], carried.value.get(k, 0) + number)
                start = np.maximum.accumulate(np.where(flag == 1, first + np.arange(n), -1))
                start = np.where(start >= 0, start, shared.value[2].get(k, 0))
                columns = [b.column(c)[i].values for c in ("batches", "ids", "models")]
                more = [part, first + np.arange(n) - start + 1, _ints(r["tokens"]), _ints(r["sizes"])]
                whole = pa.record_batch([*columns, *(pa.array(m, pa.int64()) for m in more)], names=[c.split(" ")[0] for c in ASSIGNED.split(", ")])
                for a in range(0, n, 10_000):
                    yield whole.slice(a, 10_000)

    return blocks.select(*MEASURES, "batch_changes", "batches", "ids", "models").mapInArrow(out, ASSIGNED)
