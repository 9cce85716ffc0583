from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from batchloom.llm import centroids, queries
from batchloom.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, block int, state string, moved int, cluster string, distance int, n int"


def plain(rows, k, rounds, dim, salt="3"):
    """Lloyd rounds over Python's integers: (vec_id, cluster, distance, its cluster's sum, all, digest) of each row."""
    kept = [(i, [math.floor(1024 * v) if abs(v) < 2**53 else int(v) * 1024 for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    mark = lambda i: (i is None, "" if i is None else hashlib.sha256(f"{salt}:{i}".encode()).hexdigest())
    c = [x for _, x in sorted(kept, key=lambda r: (*mark(r[0]), r[1]))[:k]]
    far = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y, strict=True))
    nearest = lambda x: min(range(len(c)), key=lambda j: (far(x, c[j]), j))
    for _ in range(rounds):
        at = [nearest(x) for _, x in kept]
        for j in range(len(c)):
            own = [x for (_, x), a in zip(kept, at, strict=True) if a == j]
            if own:
                c[j] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    at = [nearest(x) for _, x in kept]
    d = [far(x, c[a]) for (_, x), a in zip(kept, at, strict=True)]
    fit = lambda v: v if v < 1 << 63 else None
    return [(i, a, fit(v), fit(sum(w for w, b in zip(d, at, strict=True) if b == a)), fit(sum(d)), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, v in zip(kept, at, d, strict=True)]


def rows_of(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 1, "s", 2, "c", 3, 4) for i, x in rows], SCHEMA)


def test_query(spark, tables):
    rows = [(r.vec_id, r.embedding) for r in table(spark, tables, "embeddings").collect()]
    assert rows_of(queries.op11_centroid_clustering(spark, tables)) == sorted(plain(rows, 8, 10, 64), key=str)


@pytest.mark.parametrize("seed", range(30))
def test_bounds_never_change_the_result(seed):
    r = np.random.default_rng(seed)
    k, dim = int(r.integers(1, 25)), int(r.integers(1, 6))
    x = r.integers(-8, 9, (300, dim)).astype(np.int64)  # many ties
    c = x[:k].copy()
    b, shift = centroids.Bounds.unknown(300, min(k - 1, max(1, -(-k // 4)))), np.zeros(k)
    for _ in range(8):
        centroids.reassign(b, centroids.Distances(x, c), shift)
        assert (b.cluster == ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)).all()
        b = centroids.Bounds.load(b.dump())
        new = c.copy()
        for j in np.unique(b.cluster):
            new[j] = x[b.cluster == j].sum(0) // (b.cluster == j).sum()
        shift = np.array([centroids.root(int(v)) * (1 + centroids.SLACK) for v in ((new - c) ** 2).sum(1)])
        c = new


def test_bounds_save_comparisons(monkeypatch):
    r, seen = np.random.default_rng(3), []
    centres = r.normal(0, 4000, (16, 8))
    x = (centres[r.integers(0, 16, 4000)] + r.normal(0, 300, (4000, 8))).astype(np.int64)
    to = centroids.Distances.to
    monkeypatch.setattr(centroids.Distances, "to", lambda self, rows, which=None: seen.append(len(rows) * (16 if which is None else which.shape[1])) or to(self, rows, which))
    c, b, shift, spent = x[:16].copy(), centroids.Bounds.unknown(4000, 4), np.zeros(16), []
    for _ in range(8):
        seen.clear()
        centroids.reassign(b, centroids.Distances(x, c), shift)
        spent.append(sum(seen))
        new = np.array([x[b.cluster == j].sum(0) // max(1, (b.cluster == j).sum()) if (b.cluster == j).any() else c[j] for j in range(16)])
        shift, c = np.sqrt(((new - c) ** 2).sum(1)) * (1 + centroids.SLACK), new
    assert spent[0] == 64_000 and spent[-1] < 0.25 * spent[0]


def test_odd_vectors(spark):
    r = random.Random(4)
    rows = [(i, [float(r.randint(-3, 3)) / 4 for _ in range(3)]) for i in range(60)]
    rows += [rows[0], rows[0], (7, rows[3][1]), (None, [0.5, 0.5, 0.5]), (100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [1.0, float("nan"), 0.0]), (105, [1.0, float("inf"), 0.0]), (106, [0.0, -0.0, 0.0])]
    assert rows_of(centroids.cluster(frame(spark, rows), k=5, rounds=4, dim=3)) == sorted(plain(rows, 5, 4, 3), key=str)


def test_huge_components(spark):
    rows = [(i, [float(i % 5), 2.0**20 * i]) for i in range(40)] + [(90, [1e30, -1e30]), (91, [3e38, 1.0]), (92, [1e16 + 2, 0.5])]
    assert rows_of(centroids.cluster(frame(spark, rows), k=4, rounds=3, dim=2)) == sorted(plain(rows, 4, 3, 2), key=str)


def test_few_and_none(spark):
    rows = [(3, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])]
    assert rows_of(centroids.cluster(frame(spark, rows), k=8, rounds=10, dim=2)) == sorted(plain(rows, 8, 10, 2), key=str)
    assert centroids.cluster(frame(spark, []), k=8, dim=2).collect() == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("vectors_", "bounds_"))]


def test_rounds_join_without_a_shuffle(spark):
    store = centroids.Store(spark)
    try:
        v = store.put(spark.range(1000).withColumnRenamed("id", "block").repartition(store.buckets, "block"), "vectors")
        s = store.put(spark.table(v), "bounds")
        plan = spark.table(v).join(spark.table(s).hint("merge"), "block")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        store.close()
