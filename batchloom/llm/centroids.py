"""Lloyd's clustering with Drake's adaptive bounds, in exact integers.

Each vector keeps an upper bound on the distance to its centroid, lower bounds on the distances to the few next ones in
order, and one bound for all the rest. When centroids have moved, bounds are widened by how far; a vector whose order
they still certify isn't looked at, others are compared with as many centroids as the bounds leave open, and with all
where not even the remainder bound holds. Distances are exact; bounds are rounded outwards, and ties are never certified,
so the result is that of plain Lloyd rounds.

Vectors lie in blocks in a table that is bucketed by block; bounds lie in a second, narrow table of the same buckets, the
only one that a round writes. A round joins the two without a shuffle, and gathers what moved from one cluster to
another by a reduction tree.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, only, shared_dir

#: Vectors of a block.
BLOCK = 4096
#: Scale of components before they are cut to integers.
SCALE = 1024
#: Relative error that bounds are widened by: far above that of the few float operations between two roundings.
SLACK = 1e-12
STATE = "block long, state binary, moved array<struct<cluster: int, n: long, sums: string>>"
VECTORS = "block long, n int, ids binary, absent binary, width int, parts binary"


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles: 64-bit where they fit, else Python's integers."""
    if not len(x) or np.abs(x).max() < 2.0**50:
        return np.floor(SCALE * x).astype(np.int64)
    whole = [int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(SCALE * v) for v in x.ravel().tolist()]
    return np.array(whole, object).reshape(x.shape)


def fitting(x: np.ndarray) -> np.ndarray:
    """x in the narrowest type that holds it."""
    if x.dtype == object:
        return x
    most = int(np.abs(x).max()) if x.size else 0
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def pack(x: np.ndarray) -> tuple[int, bytes]:
    """(bytes a component, components); 0 bytes: decimal numbers."""
    x = fitting(x)
    return (0, ",".join(map(str, x.ravel().tolist())).encode()) if x.dtype == object else (x.dtype.itemsize, x.astype(f"<i{x.dtype.itemsize}").tobytes())


def unpack(width: int, parts: bytes, n: int) -> np.ndarray:
    if not width:
        return np.array([int(v) for v in parts.split(b",")], object).reshape(n, -1)
    return np.frombuffer(parts, f"<i{width}").reshape(n, -1)


class Distances:
    """Exact squared distances to centroids, in the quickest arithmetic that is exact for these numbers."""

    def __init__(self, x: np.ndarray, c: np.ndarray) -> None:
        most = max((int(abs(v).max()) for v in (x, c) if v.size), default=0)
        dim = x.shape[1]
        self.kind = np.float64 if dim * (2 * most) ** 2 < 1 << 53 else np.int64 if dim * (2 * most) ** 2 < 1 << 62 else object
        self.x, self.c = x, c.astype(self.kind)

    @property
    def bounded(self) -> bool:
        return self.kind is not object

    def to(self, rows: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        """rows x all centroids, or rows x the columns of `which`, centroid numbers for each row."""
        x = self.x[rows].astype(self.kind)
        if which is None:
            d = (x * x).sum(1)[:, None] - 2 * (x @ self.c.T) + (self.c * self.c).sum(1)[None, :]
        else:
            d = np.stack([((x - self.c[w]) ** 2).sum(1) for w in which.T], 1)
        return d if d.dtype == object else d.astype(np.int64)


def root(d: int) -> float:
    try:
        return math.sqrt(d)
    except OverflowError:
        return math.inf


@dataclass
class Bounds:
    """Of a block's vectors: cluster, upper bound, the next centroids and their lower bounds, the last for all others."""

    cluster: np.ndarray
    upper: np.ndarray
    order: np.ndarray
    lower: np.ndarray

    @classmethod
    def unknown(cls, n: int, kept: int) -> Bounds:
        return cls(np.full(n, -1, np.int32), np.full(n, np.inf), np.zeros((n, kept), np.int32), np.full((n, kept + 1), -np.inf))

    def dump(self) -> bytes:
        return b"".join([np.array([len(self.cluster), self.order.shape[1]], "<i8").tobytes(), self.cluster.tobytes(), self.order.tobytes(), self.upper.tobytes(), self.lower.tobytes()])

    @classmethod
    def load(cls, raw: bytes) -> Bounds:
        n, b = np.frombuffer(raw, "<i8", 2).tolist()
        at, out = 16, []
        for shape, kind in (((n,), "<i4"), ((n, b), "<i4"), ((n,), "<f8"), ((n, b + 1), "<f8")):
            size = int(np.prod(shape))
            out.append(np.frombuffer(raw, kind, size, at).reshape(shape).copy())
            at += size * int(kind[2])
        return cls(out[0], out[2], out[1], out[3])

    def widen(self, shift: np.ndarray) -> None:
        """Centroids have moved by `shift` each."""
        known = self.cluster >= 0
        self.upper[known] = (self.upper[known] + shift[self.cluster[known]]) * (1 + SLACK)
        if self.order.shape[1]:
            self.lower[:, :-1] -= shift[self.order]
        self.lower[:, -1] -= shift.max(initial=0.0)
        self.lower -= SLACK * np.abs(self.lower)
        self.lower = np.where(np.isnan(self.lower), -np.inf, self.lower)
        np.minimum.accumulate(self.lower[:, ::-1], axis=1, out=self.lower[:, ::-1])  # each bound holds for all after it

    def settle(self, rows: np.ndarray, which: np.ndarray, d: np.ndarray) -> None:
        """Exact distances of rows to the centroids `which` are known: the first in order is the cluster, the next lead the order."""
        at = np.lexsort((which, d), axis=1) if d.dtype != object else np.array([sorted(range(d.shape[1]), key=lambda j: (r[j], w[j])) for r, w in zip(d, which, strict=True)]).reshape(d.shape)
        d, which = np.take_along_axis(d, at, 1), np.take_along_axis(which, at, 1)
        self.cluster[rows] = which[:, 0]
        if d.dtype == object:
            self.upper[rows] = np.inf
            self.lower[rows] = -np.inf
            return
        far = np.sqrt(d.astype(np.float64))
        self.upper[rows] = far[:, 0] * (1 + SLACK)
        b = self.order.shape[1]
        m = min(b, d.shape[1] - 1)
        self.order[rows[:, None], np.arange(m)] = which[:, 1 : m + 1]
        self.lower[rows[:, None], np.arange(m)] = far[:, 1 : m + 1] * (1 - SLACK)
        if d.shape[1] > b + 1:
            self.lower[rows, b] = far[:, b + 1] * (1 - SLACK)

    def narrow(self, used: int) -> None:
        """Keep so many single bounds: the first one dropped already bounds all after it."""
        if used < self.order.shape[1]:
            self.order = self.order[:, :used].copy()
            self.lower = self.lower[:, : used + 1].copy()


def reassign(b: Bounds, dist: Distances, shift: np.ndarray) -> None:
    """One assignment step for a block."""
    k, n = len(dist.c), len(b.cluster)
    if not dist.bounded:
        rows = np.arange(n)
        b.settle(rows, np.broadcast_to(np.arange(k), (n, k)), dist.to(rows))
        return
    fresh = (b.cluster < 0).any()
    b.widen(shift)
    open_ = np.flatnonzero(~(b.upper < b.lower[:, 0]))
    if len(open_) and not fresh:  # the upper bound made exact may do
        own = b.cluster[open_][:, None]
        b.upper[open_] = np.sqrt(dist.to(open_, own)[:, 0].astype(np.float64)) * (1 + SLACK)
        open_ = open_[~(b.upper[open_] < b.lower[open_, 0])]
    if not len(open_):
        return
    kept = b.order.shape[1]
    sure = b.upper[open_, None] < b.lower[open_]
    first = np.where(sure.any(1), sure.argmax(1), kept + 1)  # so many of the ordered centroids are to be compared
    for z in np.unique(first).tolist():
        rows = open_[first == z]
        if z > kept or 2 * (z + 1) > k:
            b.settle(rows, np.broadcast_to(np.arange(k), (len(rows), k)), dist.to(rows))
        else:
            which = np.concatenate([b.cluster[rows][:, None], b.order[rows, :z]], axis=1)
            b.settle(rows, which, dist.to(rows, which))
    if not fresh:
        b.narrow(max(1, -(-k // 8), int(first[first <= kept].max(initial=0))))


def movements(x: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[dict]:
    """By cluster: vectors gained less those lost, and their sums."""
    changed = np.flatnonzero(before != after)
    if not len(changed):
        return []
    rows = x[changed].astype(object if x.dtype == object else np.int64)
    wide = object if rows.dtype == object or (rows.size and int(abs(rows).max()) >= 1 << 45) else np.int64
    out = []
    for c in np.unique(np.concatenate([before[changed], after[changed]])).tolist():
        if c >= 0:
            plus, minus = after[changed] == c, before[changed] == c
            s = rows[plus].astype(wide).sum(0) - rows[minus].astype(wide).sum(0)
            out.append({"cluster": c, "n": int(plus.sum() - minus.sum()), "sums": ",".join(map(str, np.broadcast_to(s, x.shape[1:]).tolist()))})
    return out


def gathered(moved: DataFrame) -> list[tuple[int, int, list[int]]]:
    """Movements of all blocks added up: within tasks, then those of about the root of so many tasks on the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        held: dict[int, list] = {}
        for b in batches:
            for rows in b.column("moved").to_pylist():
                for r in rows or ():
                    s = [int(v) for v in r["sums"].split(",")]
                    if (h := held.setdefault(r["cluster"], [0, s])) and h[1] is not s:
                        h[1] = [p + q for p, q in zip(h[1], s, strict=True)]
                    h[0] += r["n"]
        rows = [{"cluster": c, "n": n, "sums": ",".join(map(str, s))} for c, (n, s) in sorted(held.items())]
        if rows:
            yield pa.RecordBatch.from_pylist([{"moved": rows}], schema=pa.schema([("moved", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.string())])))]))

    kind = moved.schema["moved"].dataType.simpleString()
    parts = moved.rdd.getNumPartitions()
    once = moved.mapInArrow(add, f"moved {kind}")
    twice = once.coalesce(math.isqrt(parts)).mapInArrow(add, f"moved {kind}") if parts > 64 else once
    total: dict[int, list] = {}
    for r in twice.collect():
        for m in r["moved"]:
            t = total.setdefault(m["cluster"], [0, [0] * (m["sums"].count(",") + 1)])
            t[0] += m["n"]
            t[1] = [p + int(q) for p, q in zip(t[1], m["sums"].split(","), strict=True)]
    return [(c, n, s) for c, (n, s) in total.items()]


class Store:
    """The tables of one clustering: bucketed by block, outside the catalogue's own folder, gone when it ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.buckets, self.names = spark, int(spark.conf.get("spark.sql.shuffle.partitions")), []
        self.root = f"{shared_dir(spark)}/centroids-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, label: str) -> str:
        name = f"{label}_{uuid.uuid4().hex}"
        df.write.option("path", f"{self.root}/{name}").bucketBy(self.buckets, "block").format("parquet").saveAsTable(name)
        self.names.append(name)
        return name

    def drop(self, name: str) -> None:
        """Forget a table and delete its files."""
        self.names.remove(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(conf).delete(path, True)

    def close(self) -> None:
        for name in list(self.names):
            self.drop(name)


def vectors(rows: DataFrame, dim: int) -> DataFrame:
    """(vec_id, embedding) -> blocks of vectors of `dim` finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        ids, held, count = [], [], 0

        def block() -> pa.RecordBatch:
            i, x = pa.concat_arrays(ids), np.concatenate(held)
            width, parts = pack(x)
            absent = np.packbits(np.asarray(i.is_null())).tobytes()
            number = int.from_bytes(hashlib.blake2b(parts + absent + np.asarray(i.fill_null(0)).tobytes(), digest_size=8).digest(), "little", signed=True)
            row = {"block": number, "n": len(i), "ids": np.asarray(i.fill_null(0)).astype("<i8").tobytes(), "absent": absent, "width": width, "parts": parts}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("absent", pa.binary()), ("width", pa.int32()), ("parts", pa.binary())]))

        for b in batches:
            for at in range(0, len(b), BLOCK):
                some = b.slice(at, BLOCK)
                x = some.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), dim)
                ids.append(some.column("vec_id").combine_chunks() if isinstance(some.column("vec_id"), pa.ChunkedArray) else some.column("vec_id"))
                held.append(integers(x))
                count += len(some)
                if count >= BLOCK:
                    yield block()
                    ids, held, count = [], [], 0
        if count:
            yield block()

    return rows.mapInArrow(run, VECTORS)


def valid(table: DataFrame, dim: int) -> DataFrame:
    """(vec_id, embedding as doubles): vectors of exactly `dim` components, all there and finite."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where((F.size("embedding") == dim) & fine)


def starts(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `<salt>:<vec_id>`, in that order; equal ids by their components, no id last."""
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select(mark.alias("mark"), "embedding").orderBy(F.asc_nulls_last("mark"), "embedding").limit(k).collect()
    return [integers(np.array(r["embedding"], float)).tolist() for r in first]


def cluster(table: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, salt: str = "3") -> DataFrame:
    """(vec_id, embedding) -> (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row per kept vector.

    Kept are vectors of `dim` components without null, NaN or infinity; their components become floor(1024 * x). Lloyd
    rounds start from the first k of them (fewer vectors: fewer clusters), ties go to the smaller number, an empty
    cluster keeps its centroid. Repeated rows and ids are vectors of their own; without any kept vector there is no row.
    A distance or sum that a long can't hold is null. Other columns aren't looked at.
    """
    spark = table.sparkSession
    rows = valid(table, dim)
    centroids = starts(rows, k, salt)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    k, store = len(centroids), Store(spark)
    kept = min(k - 1, max(1, -(-k // 4)))
    try:
        blocks = store.put(vectors(rows, dim).repartition(store.buckets, "block"), "vectors")
        state, shift = None, np.zeros(k)
        counts, sums = [0] * k, [[0] * dim for _ in range(k)]

        def joined() -> DataFrame:
            v = spark.table(blocks)
            if state is None:
                return v.withColumn("state", F.lit(None).cast("binary"))
            return v.join(spark.table(state).select("block", "state").hint("merge"), "block")

        for _ in range(rounds):
            new = store.put(joined().mapInArrow(_round(np.array(centroids, object), shift, kept), STATE), "bounds")
            if state is not None:
                store.drop(state)
            state = new
            for c, n, s in gathered(spark.table(state).select("moved")):
                counts[c] += n
                sums[c] = [p + q for p, q in zip(sums[c], s, strict=True)]
            moved = [[v // counts[c] for v in sums[c]] if counts[c] else centroids[c] for c in range(k)]
            shift = np.array([root(sum((p - q) ** 2 for p, q in zip(a, b, strict=True))) * (1 + SLACK) for a, b in zip(centroids, moved, strict=True)])
            if moved == centroids:
                break  # further rounds would change nothing
            centroids = moved
        last = _last(np.array(centroids, object), shift, kept)
        out = materialize(joined().mapInArrow(last, "vec_id long, cluster int, distance decimal(38,0)"), "clusters")
    finally:
        store.close()
    inertia = out.groupBy("cluster").agg(F.try_sum("distance").alias("d"))
    marks = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    found = {r["cluster"]: r["d"] for r in inertia.collect()}  # k rows
    long_ = lambda v: None if v is None or abs(v) >= 1 << 63 else int(v)
    total = None if any(v is None for v in found.values()) else sum(found.values())
    of = spark.createDataFrame([(c, long_(found.get(c)), long_(total), m) for c, m in marks], "cluster_ int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(of), F.col("cluster") == F.col("cluster_")).select("vec_id", "cluster", F.expr("try_cast(distance AS long)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _blocks(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, shift: np.ndarray, kept: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray, Bounds, Distances]]:
    """Each block's row and vectors, the clusters before, the bounds now, and its distances."""
    only()
    small = fitting(centroids.astype(np.int64)) if max(abs(v) for v in centroids.ravel().tolist()) < 1 << 62 else centroids
    for b in batches:
        for at in range(len(b)):
            r = {n: b.column(n)[at].as_py() for n in ("block", "n", "ids", "absent", "width", "parts", "state")}
            x = unpack(r["width"], r["parts"], r["n"])
            bounds = Bounds.load(r["state"]) if r["state"] else Bounds.unknown(r["n"], kept)
            before, dist = bounds.cluster.copy(), Distances(x, small)
            reassign(bounds, dist, shift)
            yield r, x, before, bounds, dist


def _round(centroids: np.ndarray, shift: np.ndarray, kept: int) -> Rows:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.string())]))
        for r, x, before, bounds, _ in _blocks(batches, centroids, shift, kept):
            yield pa.record_batch([pa.array([r["block"]], pa.int64()), pa.array([bounds.dump()], pa.binary()), pa.array([movements(x, before, bounds.cluster)], kind)], names=["block", "state", "moved"])

    return run


def _last(centroids: np.ndarray, shift: np.ndarray, kept: int) -> Rows:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, _, _, bounds, dist in _blocks(batches, centroids, shift, kept):
            d = dist.to(np.arange(r["n"]), bounds.cluster[:, None])[:, 0]
            ids = pa.array(np.frombuffer(r["ids"], "<i8"), mask=np.unpackbits(np.frombuffer(r["absent"], np.uint8), count=r["n"]).astype(bool))
            far = pa.array([v if v < 10**38 else None for v in d.tolist()] if d.dtype == object else d, pa.decimal128(38, 0)) if d.dtype == object else pa.array(d, pa.int64()).cast(pa.decimal128(38, 0))
            yield pa.record_batch([ids, pa.array(bounds.cluster, pa.int32()), far], names=["vec_id", "cluster", "distance"])

    return run
