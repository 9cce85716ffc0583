from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from batchloom.llm import embed_dedup, queries
from batchloom.llm.common import forest

SCHEMA = "vec_id long, embedding array<float>, label int, v string, rep string, n string"


def brute(x, ids, t=0.95):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= t
    np.fill_diagonal(hit, False)
    label = forest(len(x), *np.nonzero(hit))
    low = {}
    for g, i in zip(label, ids, strict=True):
        low[g] = min(low.get(g, i), i)
    return [(i, int(n), low[g], low[g] == i) for i, n, g in zip(ids, hit.sum(axis=1), label, strict=True)]


def data(n=900, dim=16):
    r = np.random.default_rng(5)
    x = r.normal(size=(n, dim))
    x[300:500] = x[:200] + r.normal(size=(200, dim)) * 0.08 * np.linalg.norm(x[:200], axis=1)[:, None] / 4
    x[500:640] = x[7] + r.normal(size=(140, dim)) * 0.12  # one large group of near copies
    x[640:700] = x[9]
    x[700:720] = x[10] * 3
    return np.float32(x)


@pytest.mark.parametrize("cell,block", [(40, 16), (200, 4096), (100_000, 50)])
def test_all_links_are_found(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embed_dedup, "CELL", cell)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    x = data()
    df = spark.createDataFrame([(i, v.tolist(), i % 5, "a", "b", "c") for i, v in enumerate(x)], SCHEMA).repartition(5)
    got = sorted(map(tuple, embed_dedup.near_duplicates(df).collect()))
    assert got == brute(x.astype(np.float64), range(len(x)))


def test_recall_with_less_slack(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL", 40)
    x = data()
    df = spark.createDataFrame([(i, v.tolist(), 0, "a", "b", "c") for i, v in enumerate(x)], SCHEMA)
    got, want = (sum(r[1] for r in rows) for rows in (embed_dedup.near_duplicates(df, slack=0.5).collect(), brute(x.astype(np.float64), range(len(x)))))
    assert 0.9 * want <= got <= want


def test_query_is_brute_force(spark, tables):
    rows = spark.read.parquet(f"{tables}/embeddings.parquet").orderBy("vec_id").collect()
    got = sorted(map(tuple, queries.op3_embedding_near_dedup(spark, tables).collect()))
    assert got == brute(np.array([r.embedding for r in rows], np.float64), [r.vec_id for r in rows])


def test_any_number_of_lengths(spark):
    rows = [(i, [1.0] + [0.5] * (i % 150)) for i in range(450)] + [(1000 + i, [2.0] + [1.0] * i + [0.0]) for i in range(20)]
    df = spark.createDataFrame([(i, v, None, "a", "b", "c") for i, v in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    want = {}
    for d in {len(v) for _, v in rows}:
        own = [(i, v) for i, v in rows if len(v) == d]
        want |= {i: (n, low) for i, n, low, _ in brute(np.array([v for _, v in own]), [i for i, _ in own])}
    assert got == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0]), (11, [3.0]), (12, [0.0, -1.0]), (13, [-0.0, -1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, None, "a", "b", "c") for i, v in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()}
    assert {i: got[i] for i in range(1, 7)} == {i: (0, i, True) for i in range(1, 7)}
    assert got[7] == (3, 7, True) and got[8] == (3, 7, False) and got[9] == (3, 7, False)
    assert got[10] == (1, 10, True) and got[11] == (1, 10, False)
    assert got[12] == (1, 12, True) and got[13] == (1, 12, False)
    assert got[None][0] == 0
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_what_leaves_a_task_at_a_time_is_bounded(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(3000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embed_dedup, "SENT", 100)
    monkeypatch.setattr(embed_dedup, "CELL", 40)
    seen, run = {}, type(df).mapInArrow

    def watched(self, f, schema, **k):
        if "seen binary" in schema:
            seen["most"] = run(self, lambda bs: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in f(bs)), "n long").agg({"n": "max"}).first()[0]
        return run(self, f, schema, **k)

    monkeypatch.setattr(type(df), "mapInArrow", watched)
    got = sorted(map(tuple, embed_dedup.near_duplicates(df).collect()))
    assert got == brute(x, range(len(x))) and 0 < seen["most"] <= 100


def test_a_vector_goes_to_few_tasks(spark, monkeypatch):
    sent = []
    x = np.random.default_rng(9).normal(size=(12_000, 48))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    run = type(df).mapInArrow

    def watched(self, f, schema, **k):
        out = run(self, f, schema, **k)
        if "seen binary" in schema:
            sent.append(out.count())
        return out

    monkeypatch.setattr(type(df), "mapInArrow", watched)
    rows = embed_dedup.near_duplicates(df).collect()
    assert len(rows) == len(x) and sent[0] < 8 * len(x)  # of 23 cells it visited nearly all


@pytest.mark.parametrize("block", [16, 500])
def test_all_links_are_found_over_many_cells(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "CELL", 30)
    monkeypatch.setattr(embed_dedup, "ROOT", 1)
    monkeypatch.setattr(embed_dedup, "STEP", 64)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    x = data()
    df = spark.createDataFrame([(i, v.tolist(), i % 5, "a", "b", "c") for i, v in enumerate(x)], SCHEMA).repartition(5)
    got = sorted(map(tuple, embed_dedup.near_duplicates(df).collect()))
    assert got == brute(x.astype(np.float64), range(len(x)))
