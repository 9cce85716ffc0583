from __future__ import annotations

import random

import pytest

from batchloom.llm import mixing, queries

from .conftest import documents


def test_fill():
    assert mixing.fill([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    got = mixing.fill([1, 50, 49], [5, 2, 1])
    assert got == pytest.approx([3, 97 * 2 / 3, 97 / 3]) and sum(got) == pytest.approx(100)
    r = random.Random(1)
    for _ in range(50):
        s = [r.randrange(0, 30) for _ in range(r.randrange(1, 9))]
        t = mixing.fill(s, [mixing.WEIGHTS[i % 3] for i in range(len(s))])
        assert sum(t) == pytest.approx(sum(s)) and all(x <= 3 * n + 1e-9 for x, n in zip(t, s, strict=True))
    assert mixing.fill([0, 0], [5, 2]) == [0, 0] and mixing.fill([], []) == []


def table(spark, sources):
    r, out = random.Random(7), None
    for k, (name, n) in enumerate(sources):
        d = documents(spark, [(k * 100_000 + i, "w " * r.randrange(0, 60)) for i in range(n)], source=name)
        out = d if out is None else out.unionByName(d)
    return out


def test_targets_are_met(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 40)
    docs = table(spark, [("b", 700), ("a", 30), (None, 500), ("ç", 600), ("z", 1)])
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in rows if r.source == s) for s in names]
    want = mixing.fill(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    for s, n, t in zip(names, sizes, want, strict=True):
        own = [r for r in rows if r.source == s]
        assert {r.source_size for r in own} == {n} and own[0].target == pytest.approx(t)
        factor = t / n if n else 0
        assert all(r.copies in (int(factor + 1e-9), int(factor + 1e-9) + 1) and r.copies <= 3 for r in own)
        assert abs(sum(r.size * r.copies for r in own) - t) <= max(3 * max(r.size for r in own), 0.01 * t)


def test_reruns_agree_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 40)
    docs = table(spark, [("a", 300), ("b", 200)])
    a, b = (sorted(map(tuple, mixing.mix(docs.repartition(n)).collect())) for n in (1, 7))
    assert a == b


def test_rounding_keeps_expectations():
    import pandas as pd

    d = pd.DataFrame({"g": [1] * 5 + [2] * 4, "p": [0.4] * 5 + [0.75] * 4, "u": [0.1, 0.9, 0.3, 0.6, 0.5, 0.2, 0.8, 0.4, 0.7]})
    for cuts in ([0, 9], [0, 2, 3, 7, 9], list(range(10))):
        out = pd.concat(mixing._round_groups((d.iloc[i:j] for i, j in zip(cuts, cuts[1:])), ["g"]))
        assert sorted(out.u) == sorted(d.u)
        assert out.groupby("g").p.sum().round(9).tolist() == [2.0, 3.0]
        assert set(out.p.round(9)) <= {0.0, 1.0}


def test_query(spark, tables):
    rows = {r.doc_id: r for r in queries.op9_source_mixing(spark, tables).collect()}
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "source").collect()
    assert len(rows) == len(docs) and all(rows[d.doc_id].size == len((d.text or "").encode().split()) for d in docs)
    names = sorted({d.source for d in docs}, key=lambda s: (s is None, s or ""))
    own = [[rows[d.doc_id] for d in docs if d.source == s] for s in names]
    sizes = [sum(r.size for r in o) for o in own]
    for o, n, t in zip(own, sizes, mixing.fill(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))]), strict=True):
        assert {r.source_size for r in o} == {n} and all(r.target == pytest.approx(t) and 0 <= r.taken <= 3 * r.size for r in o)
        assert abs(sum(r.taken for r in o) - t) <= 3 * max(r.size for r in o)


def test_odd_rows(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and {r.doc_id: r.size for r in rows}[1] == 0
    assert mixing.mix(none).count() == 0
    assert {r.copies for r in mixing.mix(documents(spark, [None, ""])).collect()} == {0}
