from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from batchloom.llm import common, queries, simhash
from batchloom.llm.common import connected_components, forest, shared_dir

from .conftest import documents, prose


def fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids, radius=2):
    f = np.array(fps, np.uint64)
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius)
    label = forest(len(f), a, b)
    low = {}
    for x, i in zip(label, ids, strict=True):
        low[x] = min(low.get(x, i), i)
    return [low[x] for x in label]


def test_query_is_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").orderBy("doc_id").collect()
    got = queries.op8_simhash_near_dedup(spark, tables).orderBy("doc_id").collect()
    fps = [fingerprint(d.text) for d in docs]
    assert [r.fingerprint for r in got] == [f"{f:016x}" for f in fps]
    assert [r.component_id for r in got] == components(fps, [d.doc_id for d in docs])


@pytest.mark.parametrize("radius,target", [(2, 4), (1, 2), (0, 1), (2, 10_000)])
def test_the_tree_misses_no_pair(spark, radius, target):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base:
        for _ in range(6):
            flips = r.choice(64, r.integers(0, 4), replace=False)
            fps.append(int(b) ^ sum(1 << int(i) for i in flips))
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    reps = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long").repartition(3)
    found = connected_components(simhash.linked(reps, radius, target))
    root = {x.node: x.component for x in found.collect()}
    assert [root.get(i, i) for i in range(len(fps))] == components(fps, range(len(fps)), radius)


def test_local_tree_is_exact(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    r = np.random.default_rng(2)
    f = (r.integers(0, 1 << 63, 300, dtype=np.uint64) & np.uint64(0xFFF)) | (r.integers(0, 2, 300, dtype=np.uint64) << np.uint64(40))
    got = {(int(i), int(j)) for a, b in simhash.tree_pairs(f, f, 2) for i, j in zip(a, b, strict=True)}
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 2)
    assert got == set(zip(a.tolist(), b.tolist(), strict=True))
    w = np.stack([f] * 4, axis=1)
    got = {(int(i), int(j)) for a, b in simhash.wide_pairs(w, 8) for i, j in zip(a, b, strict=True)}
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(np.bitwise_count(w[:, None] ^ w[None]).sum(axis=2) <= 8)), strict=True))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_odd_rows(spark, odd, none):
    got = simhash.simhash_components(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert sum(r.doc_id == 6 and r.component_id == 6 for r in got) == 2
    assert simhash.simhash_components(none).count() == 0
    assert simhash.near_copies(odd).count() == odd.count() and simhash.near_copies(none).count() == 0


def changed(text, every):
    w = text.split()
    return " ".join("changed" if i % every == every // 2 else x for i, x in enumerate(w))


def test_near_copies_are_found_and_others_left(spark):
    texts = [prose(i, 200) for i in range(60)]
    copies = [(1000 + i, texts[i]) for i in range(5)] + [(2000 + i, changed(texts[i], 100)) for i in range(30)]
    docs = documents(spark, [*enumerate(texts), *copies])
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == {i: i for i in range(60)} | {1000 + i: i for i in range(5)} | {2000 + i: i for i in range(30)}


def test_a_large_group_of_near_copies(spark):
    text = prose(1, 300)
    docs = documents(spark, [(i, text.replace(text.split()[i % 290], f"w{i}", 1)) for i in range(290)] + [(9999, prose(2, 300))])
    got = simhash.near_copies(docs)
    assert got.where(F.col("component_id") == 0).count() == 290


def test_deep_trees_find_as_many(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 2**-11)  # 400 texts as if they were 100 million rows with leaves of 128
    docs = documents(spark, [(i + j, changed(prose(i, 300), 60) if j else prose(i, 300)) for i in range(0, 400, 2) for j in (0, 1)])
    got = simhash.near_copies(docs).where("doc_id <> component_id").count()  # similarity 0.84
    assert got >= 185


def test_links_are_the_similar_pairs(spark):
    line, rows = prose(77, 16), []
    for i in range(0, 40, 2):  # one repeated line, and texts at 0.81 and 0.7
        rows += [(i + j, f"{(line + ' ') * 10}{prose(1000 + i + j, 104)}") for j in (0, 1)]
        rows += [(100 + i + j, changed(prose(i, 300), 50) if j else prose(i, 300)) for j in (0, 1)]
        rows += [(200 + i + j, changed(prose(500 + i, 300), 30) if j else prose(500 + i, 300)) for j in (0, 1)]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    want = {i: min(j for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in sets}
    assert {r.doc_id: r.component_id for r in simhash.near_copies(documents(spark, rows)).collect()} == want
    assert sum(i != j for i, j in want.items()) == 20


def test_parts_of_a_group_are_joined_by_any_similar_pair(spark):
    w = prose(5, 400).split()  # windows that slide on: only near ones are similar, and the last ids lie between the first
    rows = [(i if n % 2 == 0 else 100 + i, " ".join(w[10 * n : 10 * n + 150])) for i, n in enumerate((0, 2, 4, 6, 1, 3, 5))]
    assert {r.component_id for r in simhash.near_copies(documents(spark, rows)).collect()} == {0}


def test_leaves_do_not_depend_on_the_size_of_the_input(spark, monkeypatch):
    texts = [prose(i, 30) for i in range(2500)]
    run, seen = type(spark.range(0)).mapInArrow, []

    def watched(self, f, schema, **k):
        out = run(self, f, schema, **k)
        if schema.startswith("leaf long") and "sketch" not in schema:
            seen.append({(r.leaf, r.rep) for r in out.join(known, "rep").select("leaf", "rep").collect()})
        return out

    few = documents(spark, texts[:10])
    known = few.select(simhash.row_key().alias("rep"))
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", watched)
    simhash.near_copies(few)
    simhash.near_copies(documents(spark, texts))
    assert len(seen) == 2 and seen[0] == seen[1]


def test_only_the_rows_to_keep_stay_written(spark):
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    out = simhash.without_copies(documents(spark, [prose(i % 7) for i in range(20)]))
    assert {p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before} == {"near-kept"} and out.count() == 7


def test_added_edges_join_components(spark):
    r = np.random.default_rng(4)
    old, new = r.integers(0, 300, (150, 2)), r.integers(0, 320, (60, 2))
    frame = lambda e: spark.createDataFrame([(int(a), int(b)) for a, b in e], "src long, dst long")
    got = common.grown(connected_components(frame(old)), frame(new))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, connected_components(frame([*old, *new])).collect()))


def test_links_inside_a_part_meet_once(spark, monkeypatch):
    find, seen = common.connected_components, []

    def watched(edges, *a, **k):
        seen.append(edges.where("src <> dst").distinct().count())
        return find(edges, *a, **k)

    monkeypatch.setattr(common, "connected_components", watched)
    monkeypatch.setattr(simhash, "connected_components", watched)
    text = prose(1, 300)  # each tree links the group anew
    near = [(i, text.replace(text.split()[i % 290], f"w{i}", 1)) for i in range(150)]
    w = prose(5, 400).split()
    slid = [(1000 + n, " ".join(w[10 * n : 10 * n + 150])) for n in (0, 2, 4, 6, 1, 3, 5)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(documents(spark, near + slid)).collect()}
    assert got == {i: 0 for i, _ in near} | {i: 1000 for i, _ in slid}
    assert seen[0] > 150 and len(seen) > 1 and sum(seen[1:]) <= 10


def test_sketches_never_hide_a_similar_pair():
    r = np.random.default_rng(5)
    sets = []
    for n in (1, 3, 40, 480, 512, 513, 600, 5000, 40000, 90000):
        base = np.unique(r.integers(0, 2**64, n, np.uint64))
        for change in (0, 0.05, 0.11, 0.12, 0.3):
            new = r.integers(0, 2**64, int(change * n), np.uint64)
            sets.append(np.unique(np.concatenate([base[len(new) :], new, new[:3] + np.uint64(1)])))
    size = np.array([len(s) for s in sets], np.int32)
    x, y = np.triu_indices(len(sets), 1)
    keep = np.minimum(size[x], size[y]) >= 0.8 * np.maximum(size[x], size[y])
    x, y = x[keep], y[keep]
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y, strict=True)])
    real = both / (size[x] + size[y] - both)
    marks = np.empty(len(sets), object)
    marks[:] = [simhash.sketch(s) for s in sets]
    most, like = simhash.Sketches(marks, size).alike(x, y)
    assert len({len(m) for m in marks}) > 3 and (most >= real - 1e-9).all()
    known = (real > 0.5) & (size[x] > 100) & (size[x] < 10000)
    assert known.sum() > 20 and (abs(like - real)[known] < 0.05).all()


def test_texts_just_too_far_apart_are_not_tried_pair_by_pair(spark, monkeypatch):
    check, seen = simhash.similar, []

    def watched(docs, pairs, *a, **k):
        seen.append(pairs.count())
        return check(docs, pairs, *a, **k)

    monkeypatch.setattr(simhash, "similar", watched)
    words, rows = prose(1, 300).split(), []
    for i in range(60):  # any two share some 0.7 of their shingles: candidates, and no copies
        at = set(np.random.default_rng(i).permutation(60)[:5])
        rows.append((i, " ".join(f"x{i}n{j}" if j % 5 == 2 and j // 5 in at else w for j, w in enumerate(words))))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    like = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert max(like) < 0.8
    got = {r.doc_id: r.component_id for r in simhash.near_copies(documents(spark, rows)).collect()}
    assert got == {i: i for i in range(60)}
    assert len(seen) > 1 and sum(seen[1:]) <= 60
