from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from batchloom.llm import quality, queries
from batchloom.llm.common import materialize

from .conftest import documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
    return (*n, n[0] < 20 or 100 * n[4] > 30 * n[0])


def check(df, docs):
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()), key=key)
    assert got == sorted(((d.doc_id, *brute(d.text)) for d in docs.collect()), key=key)


def test_counts_of_the_query(spark, tables):
    check(queries.op5_quality_rules(spark, tables), spark.read.parquet(f"{tables}/documents.parquet"))


def test_counts_of_repeats(spark):
    p = prose(1, 30)
    docs = documents(spark, [p + " " + p, "a " * 40, p + "\n" + p + "\n\n" + p, "x\n\ny\nx\n \n ", " ".join(p.split()[:8] + ["z"] + p.split()[:8]), "b " * 8, "b " * 9])
    check(quality.judge(docs), docs)


def test_odd_rows(spark, odd, none):
    check(quality.judge(odd), odd)
    assert quality.judge(none).count() == 0


def test_held_labels(spark, tables):
    d = tables.replace("sf0.001", "sf0.1")
    rows = queries.op5_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) > 0.99 * len(good) and sum(bad) < 0.1 * len(bad)


def votes(**v):
    return tuple(v.get(r.name, 0) for r in quality.RULES)


def test_estimation_trusts_rules_that_agree():
    many = [(votes(capitals=-1, shouts=-1, symbols=-1, plain=-1), 500), (votes(capitals=1, shouts=1, symbols=1, plain=1), 3000), (votes(capitals=1, shouts=1, symbols=1, plain=1, letters=-1), 60)]
    prior, rates = quality.estimate(many)
    rates = dict(zip((r.name for r in quality.RULES), rates, strict=True))
    assert 0.8 < prior < 0.9 and rates["capitals"][1][0] > 0.9 and rates["capitals"][0][0] < 0.01
    weight = {n: np.log(g[0] / b[0]) for n, (g, b) in rates.items()}  # a bad vote's
    assert weight["capitals"] < weight["letters"]
    assert all(sum(x) == pytest.approx(1) for pair in rates.values() for x in pair)


def test_nothing_seen_leaves_what_is_assumed():
    prior, rates = quality.estimate([])
    assert prior == pytest.approx(quality.PRIOR) and all(np.allclose(r, (quality.ON_GOOD, quality.ON_BAD)) for r in rates)


def brute_posterior(text_votes):
    """The same estimate, row by row in arrays, for as many rounds."""
    x = np.array(text_votes) + 1
    one = np.eye(3)[x]  # row, rule, vote
    first = np.array([quality.ON_GOOD, quality.ON_BAD])
    prior, rate = quality.PRIOR, np.broadcast_to(first[:, None, :], (2, x.shape[1], 3))
    for _ in range(quality.ROUNDS):
        logs = np.einsum("nrv,crv->nc", one, np.log(rate)) + np.log([prior, 1 - prior])
        p = 1 / (1 + np.exp(logs[:, 1] - logs[:, 0]))
        counts = np.stack([np.einsum("nrv,n->rv", one, p), np.einsum("nrv,n->rv", one, 1 - p)]) + quality.SMOOTH * first[:, None, :]
        rate = counts / counts.sum(axis=2, keepdims=True)
        prior = (p.sum() + quality.SMOOTH * quality.PRIOR) / (len(p) + quality.SMOOTH)
    logs = np.einsum("nrv,crv->nc", one, np.log(rate)) + np.log([prior, 1 - prior])
    return 1 / (1 + np.exp(logs[:, 1] - logs[:, 0]))


def test_the_verdict_is_that_of_a_brute_force_estimate(spark, tables):
    docs = spark.read.parquet(f"{tables.replace('sf0.001', 'sf0.01')}/documents.parquet")
    seen = quality.measures(docs).toPandas()
    cast = []
    for rule in quality.RULES:
        share = seen[rule.top] / seen[rule.bottom].clip(lower=1)
        cast.append(np.where(seen.n_words == 0, 0, np.where(share >= rule.bad, -1, np.where(share <= rule.good, 1, 0))))
    want = dict(zip(seen.doc_id, brute_posterior(np.array(cast).T), strict=True))
    rows = quality.judge(docs).collect()
    assert [r.p_good for r in rows] == pytest.approx([want[r.doc_id] for r in rows], abs=1e-4)
    assert all(r.kept == (not r.base_failed and r.p_good >= 0.5) for r in rows)


def test_a_bad_vote_can_be_outvoted_and_a_strong_one_wins(spark, tables):
    """The posterior is no filter that all rules must pass: some documents with a bad vote stay, and not all of them."""
    docs = spark.read.parquet(f"{tables.replace('sf0.001', 'sf0.1')}/documents.parquet")
    bad = {r.doc_id for r in materialize(quality.measures(docs), "measures").where(" OR ".join(f"{r.top} >= {r.bad} * greatest({r.bottom}, 1)" for r in quality.RULES)).collect()}
    rows = [r for r in quality.judge(docs).collect() if not r.base_failed and r.doc_id in bad]
    kept = sum(r.kept for r in rows)
    assert 0 < kept < len(rows)


def test_the_plan_has_no_python(spark, tables):
    plan = quality.measures(spark.read.parquet(f"{tables}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
