"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents share one copy factor, target words over source words. Its whole part is taken outright;
the fraction is rounded so that the taken words stay near the target: documents are put in order of size, and
along that order two fractional probabilities at a time transfer mass, at random and without changing either
expectation, until one is integral. Each group of that order ends with at most one fractional document. These
residuals climb a reduction tree (salted size classes, size classes, ever wider ranges of sizes, the source) and
the last one of a source is rounded alone. A group below the root has a bounded number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bounded
from .common import ROW, WORD, materialize, packed, unit, unpacked

WEIGHTS = (5.0, 2.0, 1.0)
MAX_FACTOR = 3.0
#: Sources are weighed on the driver; more than this is an error.
MAX_SOURCES = 1_000_000
#: The table of sources is broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_SOURCES = 10_000
#: Rows of the table of copies that may be broadcast; beyond, texts are shuffled to them.
BROADCAST_COPIES = 1_000_000
#: Documents of one source and size class that make one group of the tree's leaves, about.
GROUP = 1_000
SEED = 20_240_601
#: Bits that the size class loses at each level of the tree; at the last the class is the source.
LEVELS = (0, 2, 4, 8)


def fill(sizes: list[int], weights: list[float], most: float = MAX_FACTOR) -> list[float]:
    """Share sum(sizes) by weight, none above most * size; what is cut off is shared again by weight."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        scale = left / sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if scale * weights[i] > most * sizes[i]]
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
            open_.remove(i)
        if not over:
            for i in open_:
                out[i] = scale * weights[i]
            break
    return out


def source_plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_FACTOR) -> DataFrame:
    """(source, size) -> (source, source_size, target, base, p): a row per source, null one of them."""
    spark = sizes.sparkSession
    rows = sizes.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    targets = fill([r.n for r in rows], [weights[i % len(weights)] for i in range(len(rows))], most)
    plan = []
    for r, t in zip(rows, targets, strict=True):
        factor = min(most, t / r.n) if r.n else 0.0
        base = math.floor(factor + 1e-12)
        plan.append((r.source, r.n, t, base, max(0.0, factor - base) if factor - base > 1e-12 else 0.0))
    return spark.createDataFrame(plan, "source string, source_size long, target double, base int, p double")


def _round_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by keys and size; p becomes 0 or 1 for all but at most one row of each group."""
    group, held = None, None  # held: the fractional row that waits for a partner
    for d in batches:
        if not len(d):
            continue
        p, u = d["p"].to_numpy(float).copy(), d["u"].to_numpy(float)
        heads = np.ones(len(d), bool)
        for k in keys:
            c = d[k].to_numpy()
            same = (c[1:] == c[:-1]) if k == keys[0] else same & (c[1:] == c[:-1])
        heads[1:] = ~same
        out = []
        for i in range(len(d)):
            if heads[i] and (i or group != tuple(d[k].iat[0] for k in keys)):
                if isinstance(held, pd.DataFrame):
                    out.append(held)
                held = None
            if p[i] <= 0.0 or p[i] >= 1.0:
                continue
            if held is None:
                held = i
                continue
            a = float(held["p"].iat[0]) if isinstance(held, pd.DataFrame) else p[held]
            b, s = p[i], a + p[i]
            if s < 1.0 - 1e-12:  # one of the two goes to 0
                first, second = (s, 0.0) if u[i] * s < a else (0.0, s)
            elif s > 1.0 + 1e-12:  # one of the two goes to 1
                first, second = (1.0, s - 1.0) if u[i] * (2.0 - s) < 1.0 - b else (s - 1.0, 1.0)
            else:
                first, second = (1.0, 0.0) if u[i] < a else (0.0, 1.0)
            if isinstance(held, pd.DataFrame):
                held = held.assign(p=first)
                if first in (0.0, 1.0):
                    out.append(held)
                    held = None
            else:
                p[held] = first
                held = held if 0.0 < first < 1.0 else None
            p[i] = second
            if 0.0 < second < 1.0:
                held = i
        group = tuple(d[k].iat[-1] for k in keys)
        done = d.assign(p=p)
        if held is not None and not isinstance(held, pd.DataFrame):  # it may find its partner in the next batch
            held, done = done.iloc[[held]], done.drop(done.index[held])
        yield pd.concat([*out, done], ignore_index=True)
    if isinstance(held, pd.DataFrame):
        yield held


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_FACTOR, seed: int = SEED) -> DataFrame:
    """(doc_id, text, source) -> (doc_id, source, size, source_size, target, copies): one row per input row.

    size is the text's number of words, 0 for null. Null is a source of its own and comes last. A source without
    words gets no copies. Equal rows are rounded each on their own; of two such rows it isn't defined which one
    gets the copy. The result depends on the rows and the seed alone, not on partitions or order.
    """
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mixing-sizes")
    plan = source_plan(sizes, weights, most)
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    named = plan.withColumnRenamed("source", "source_")
    rows = sizes.join(named, sizes.source.eqNullSafe(named.source_), "left").drop("source_")
    rows = rows.select(
        "*",
        F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("src"),
        F.floor(4 * F.log2(F.col("size") + F.lit(1.0))).cast("int").alias("kind"),
        unit(F.col("doc_id"), seed).alias("u"),
    )
    counts = rows.groupBy("src", "kind").agg(F.count("*").alias("n")).select(F.col("src").alias("s_"), F.col("kind").alias("k_"), F.ceil(F.col("n") / GROUP).cast("int").alias("salts"))
    rows = rows.join(counts, (F.col("src") == F.col("s_")) & (F.col("kind") == F.col("k_"))).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), "salts").cast("int")).drop("s_", "k_", "salts")

    def level(df: DataFrame, keys: list[str]) -> DataFrame:
        dealt = df.repartition(*keys).sortWithinPartitions(*keys, "size", "doc_id")
        return materialize(dealt.mapInPandas(lambda b: _round_groups(b, keys), df.schema), "mixing-rounds", compact=4)

    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    now = level(rows, ["src", "kind", "salt"])
    done = now.where(~open_)
    for bits in LEVELS:
        now = level(now.where(open_).withColumn("kind", F.shiftright("kind", bits)), ["src", "kind"])
        done = done.unionByName(now.where(~open_))
    last = now.where(open_).withColumn("p", (F.col("u") < F.col("p")).cast("double"))
    whole = (F.col("base") + F.col("p").cast("int")).cast("long")
    return done.unionByName(last).select("doc_id", "source", "size", "source_size", "target", whole.alias("copies"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_FACTOR, seed: int = SEED) -> DataFrame:
    """docs, all columns: each row as often as mix() takes it, none times for many.

    Rows with equal doc_id, text and source share their copies; which of their other columns the copies have isn't
    defined.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col("source").cast("string"), F.lit("")))
    copies = mix(docs.select(key.alias("doc_id"), "text", "source"), weights, most, seed)
    copies = copies.groupBy(F.col("doc_id").alias("mixed_")).agg(F.sum("copies").cast("int").alias("copies_"), F.count("*").alias("rows_")).where("copies_ > 0")
    copies = materialize(copies, "mix-copies", compact=16)
    rows, again = packed(docs, key.alias("key_")), copies.where("rows_ > 1")
    out = rows.join(bounded(copies.where("rows_ = 1"), BROADCAST_COPIES), F.col("key_") == F.col("mixed_"))
    if not again.isEmpty():
        out = out.unionByName(rows.join(bounded(again, BROADCAST_COPIES), F.col("key_") == F.col("mixed_")).dropDuplicates(["key_"]))
    return unpacked(out.select(ROW, F.explode(F.sequence(F.lit(1), F.col("copies_")))), docs)
