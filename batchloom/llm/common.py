"""Shared pieces: what workers keep, batches of texts, hashes, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch, materialize, shared_dir, temporary

__all__ = ["ROW", "batches_of", "connected_components", "forest", "grown", "materialize", "only", "packed", "rested", "shared_dir", "table", "texts", "unit", "unpacked"]

#: ASCII white space as the contracts define it; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"


_heavy: list = [None, None]


def only(key: object = None, make: Callable[[], object] = lambda: None) -> object:
    """What a Python worker keeps between tasks: one thing at a time. Another key frees what was kept before.

    Workers outlive stages, so what one operator leaves behind would else count against the next one's memory.
    """
    if _heavy[0] != key:
        _heavy[:] = [None, None]
        rested()
        _heavy[:] = [key, make()]
    return _heavy[1]


def rested() -> None:
    """Memory of this worker that became free goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


#: Rows that go to Python at a time, at most. Texts are large, and every batch is held more than once.
BATCH_ROWS = 2000


def texts(docs: DataFrame, *columns: Column) -> DataFrame:
    """These columns of docs, for a Python operator; the session's Arrow batches are cut down to BATCH_ROWS."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return docs.select(*columns)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run in here gives Python no more than so many rows at a time: rows that are large, each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The column that holds a packed row.
ROW = "row_"


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """All columns of docs but `text`, if that is among those given, as one struct, beside those given: names that an operator uses can't meet the caller's."""
    texts_ = {c for c in docs.columns if c == "text"} if "text" in docs.select(*columns).columns else set()
    return docs.select(F.struct(F.lit(0).alias("0"), *(F.col(f"`{c}`") for c in docs.columns if c not in texts_)).alias(ROW), *columns)


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs again, those named with another value of the same type."""
    return rows.select(*((changed[c].cast(docs.schema[c].dataType) if c in changed else F.col(ROW).getField(c)).alias(c) for c in docs.columns))


def unit(key: Column, seed: int) -> Column:
    """A uniform number in [0, 1) that depends on the key and the seed alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and edges a-b, each node's smallest reachable node (hooking and pointer jumping)."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def connected_components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """(src, dst) -> (node, component): the smallest node reachable, for every node that has an edge.

    Alternating large-star and small-star steps, each a grouped minimum (map-side combined) joined back on the node.
    The large star's minima are written to the shared folder first: both sides of that join are then plain shuffles,
    so that a node with very many edges is split at run time and not a task of its own. Edges are written each round. Rows with a null end and loops are ignored.
    """
    pairs = edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))
    e = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    with temporary() as work:
        return _components(e, label, max_rounds, work)


def _components(e: DataFrame, label: str, max_rounds: int, work: Scratch) -> DataFrame:
    e, before = materialize(e, label, compact=16), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m")), label, compact=16)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))  # no node has many smaller neighbours by now
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, label, compact=16)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first()
        if now == before:
            work.keep(e)
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def grown(parts: DataFrame, edges: DataFrame, label: str = "components") -> DataFrame:
    """Components (node, component), as connected_components() gives them, when edges (src, dst) are added.

    Components meet, not their nodes: edges inside one go before the rounds, and those between the same two are one.
    """
    with temporary() as work:
        own = parts.select(F.col("node").alias("node_"), F.col("component").alias("own_"))
        sides = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst")
        for end in ("src", "dst"):
            sides = sides.join(own, F.col(end) == F.col("node_"), "left").withColumn(f"{end}_in", F.coalesce("own_", end)).drop("node_", "own_")
        sides = materialize(sides, label, compact=16)
        over = sides.select(F.greatest("src_in", "dst_in").alias("src"), F.least("src_in", "dst_in").alias("dst")).where("src <> dst").distinct()
        top = connected_components(over, label).select(F.col("node").alias("node_"), F.col("component").alias("top_"))
        every = parts.select("node", "component").unionByName(sides.select(F.inline(F.array(*(F.struct(F.col(e).alias("node"), F.col(f"{e}_in").alias("component")) for e in ("src", "dst")))))).distinct()
        out = every.join(top, F.col("component") == F.col("node_"), "left").select("node", F.coalesce("top_", "component").alias("component"))
        return work.keep(materialize(out, label, compact=16))
