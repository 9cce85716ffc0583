from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from batchloom.llm import queries, toxicity

from .conftest import documents, prose


def test_ftrl_is_the_plain_recurrence():
    m, alpha, beta, l1, l2 = toxicity.Ftrl(8, 0.5, 1.0, 0.1, 0.2), 0.5, 1.0, 0.1, 0.2
    z, n = [0.0] * 256, [0.0] * 256
    r = np.random.default_rng(0)
    for _ in range(200):
        f, y = np.unique(r.integers(0, 9, 4)).astype(np.int32), int(r.integers(0, 2))
        w = {i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2) for i in f}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in f:
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - s * w[i]
            n[i] += g * g
        m.learn(f, y)
    assert np.allclose(m.z, z) and np.allclose(m.n, n)


def test_features():
    f = toxicity.Features()
    a, b, c = (set(f.of(t).tolist()) for t in ("one two three", "ONE, two: three!", "three two one"))
    assert a == b != c and len(a) == 1 + 3 + 2 + 1
    assert f.of(None).tolist() == f.of(" .. ").tolist() == [0]


def test_learning_and_held_out(spark, tables):
    d = tables.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = queries.op4_toxicity(spark, d).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    hit = [r.toxic for r in held if r.predicted]
    assert np.mean(hit) > 0.9 and sum(hit) > 0.6 * sum(r.toxic for r in held)


def test_the_sample_is_bounded_and_results_repeat(spark):
    docs = documents(spark, [prose(i, 40) + (" vile" if i % 4 == 0 else "") for i in range(300)])
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    a, b = (toxicity.learn_weights(docs.repartition(n), labels, sample=200) for n in (2, 7))
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) and len(a[0])
    s = {r.doc_id: r.score for r in toxicity.score(docs, a).collect()}
    assert min(s[i] for i in range(0, 300, 4)) > max(s[i] for i in range(1, 300, 4))


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(6, 1), (6, 0), (7, None), (8, 5), (None, 1), (5, 0)], "doc_id long, toxic int")
    w = toxicity.learn_weights(odd, labels)
    got = toxicity.score(odd, w).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    for some, marks in ((none, labels), (odd, labels.limit(0))):
        empty = toxicity.learn_weights(some, marks)
        assert len(empty[0]) == 0
    assert {r.score for r in toxicity.score(odd, empty).collect()} == {0.5}
    assert toxicity.score(none, w).count() == 0
