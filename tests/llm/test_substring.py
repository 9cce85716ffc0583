from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from batchloom.llm import queries, substring

from .conftest import documents, prose


def best_chain(pos, other):
    score = []
    for j in range(len(pos)):
        s = substring.K
        for i in range(j):
            if pos[i] < pos[j] and other[i] < other[j]:
                s = max(s, substring.K + score[i] - substring.GAP * (pos[j] - pos[i] + other[j] - other[i]))
        score.append(s)
    return max(score, default=0)


def chain_score(pos, other, chain):
    return substring.K * len(chain) - substring.GAP * sum(pos[b] - pos[a] + other[b] - other[a] for a, b in zip(chain, chain[1:]))


def test_chains_are_optimal():
    r = random.Random(4)
    for _ in range(60):
        m = sorted({(r.randrange(60), r.randrange(60)) for _ in range(r.randrange(1, 40))})
        pos, other = np.array([x for x, _ in m]), np.array([y for _, y in m])
        found = substring.chains(pos, other)
        assert sorted(pos[i] for c in found for i in c) == sorted(set(pos))
        assert all(pos[a] < pos[b] and other[a] < other[b] for c in found for a, b in zip(c, c[1:]))
        assert abs(chain_score(pos, other, found[0]) - best_chain(pos, other)) < 1e-9


def test_minimizers_cover_every_window():
    for n in (0, 1, 5, 10, 11, 200):
        s = np.random.default_rng(n).integers(0, 50, n, dtype=np.uint64)
        at = set(substring.minimizers(s).tolist())
        assert all(at & set(range(i, i + substring.WINDOW)) for i in range(n - substring.WINDOW + 1)) and (n == 0) == (not at)


def test_twelve_equal_words_share_a_seed():
    r = np.random.default_rng(3)
    for _ in range(300):
        a, b = (r.integers(0, 1 << 32, 60, dtype=np.uint32) for _ in "ab")
        b[30:42] = a[10:22]
        x, y = (substring.shingles(h) for h in (a, b))
        assert np.isin(x[substring.minimizers(x)], y[substring.minimizers(y)]).any()


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def test_planted_passages(spark):
    p, q = prose(901, 70), prose(902, 60)
    fuzzy = q.split()
    for i in (14, 30, 47):
        fuzzy[i] = "changed"
    del fuzzy[22]
    docs = documents(spark, [(5, f"{prose(1)} {p} {prose(2)}"), (3, f"{p} {prose(3)}"), (7, f"{prose(4, 33)} {p.upper()}"), (8, f"{q} {prose(5)}"), (9, f"{prose(6, 20)} {' '.join(fuzzy)} {prose(7)}"), (10, prose(8)), (11, " ".join(prose(901, 70).split()[:40]) + " " + prose(9))])
    rows = substring.repeated_passages(docs).collect()
    got = covered(rows)
    assert set(got) == {5, 7, 9}
    assert got[5] == set(range(120, 190)) and got[7] == set(range(33, 103)) and got[9] == set(range(20, 79))
    assert {(r.doc_id, r.source_doc_id) for r in rows} == {(5, 3), (7, 3), (9, 8)}
    assert all(r.similarity == 1 for r in rows if r.doc_id != 9) and 0.8 <= next(r.similarity for r in rows if r.doc_id == 9) < 1


def test_two_passages_with_unlike_words_between(spark):
    rows, want = [], {}
    for i, gap in enumerate((30, 40, 80, 120, 160)):
        p, q = prose(9000 + i, 60), prose(9100 + i, 100)
        rows += [(i, f"{prose(9200 + i, 20)} {p} {prose(9300 + i, gap)} {q}"), (100 + i, f"{p} {prose(9400 + i, gap)} {q} {prose(9500 + i, 20)}")]
        want[100 + i] = set(range(60)) | set(range(60 + gap, 160 + gap))
    got = covered(substring.repeated_passages(documents(spark, rows)).collect())
    assert all(want[i] <= got.get(i, set()) for i in want)
    assert all(len(got[i] - want[i]) <= 6 for i in want if len(want[i]) < 0.8 * (max(want[i]) + 1))


def test_passages_of_frequent_lines(spark):
    rows, want = [], set()
    for i in range(30):  # each line stands in a document of its own first
        lines = [prose(20_000 + 10 * i + j, n) for j, n in enumerate((12, 15, 12, 14, 12))]
        rows += [(10 * i + j, f"{prose(21_000 + 10 * i + j, 30)} {x}") for j, x in enumerate(lines)]
        rows += [(1000 + i, f"{prose(22_000 + i, 20)} {' '.join(lines)}"), (2000 + i, f"{prose(23_000 + i, 20)} {' '.join(lines)}")]
        want.add(2000 + i)
    got = covered(substring.repeated_passages(documents(spark, rows)).collect())
    assert all(set(range(20, 85)) <= got.get(i, set()) for i in want)


def test_each_occurrence_meets_the_one_before(spark):
    rows = [(s, 10 * d + s % 3, p) for s in range(5) for d in range(40 if s == 2 else 3) for p in (d, d + 100)]
    got = {tuple(r) for r in substring.preceding(spark.createDataFrame(rows, "seed long, doc long, pos int")).collect()}
    assert got == {(d, p, d - 10, (d - 10) // 10) for _, d, p in rows if d >= 10}


def test_long_repeats_of_the_tables_are_found(spark, tables):
    d = tables.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = covered(queries.op6_substring_dedup(spark, d).collect())
    first, want = {}, {}
    for r in docs.orderBy("doc_id").collect():
        w = (r.text or "").encode().lower().split()
        for i in range(len(w) - 50):
            if first.setdefault(tuple(w[i : i + 51]), r.doc_id) != r.doc_id:
                want.setdefault(r.doc_id, set()).update(range(i, i + 51))
    missed = sum(len(v - got.get(k, set())) for k, v in want.items())
    assert missed <= 0.02 * sum(map(len, want.values())) and set(want) <= set(got)


def test_passages_are_cut_out(spark):
    docs = documents(spark, ["  a b\tc\n\nd e ", "x y", None, "only words here", ""])
    spans = spark.createDataFrame([(0, 1, 3, 9, 0, 2, 1.0), (3, 0, 3, 9, 0, 3, 1.0)], ", ".join(f"{n} {'double' if n == 'similarity' else 'long'}" for n in substring.PASSAGE))
    out = substring.without_passages(docs, spans)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: "  a\n\nd e ", 1: "x y", 2: None, 4: ""}


def test_many_copies_of_one_passage(spark):
    p = prose(5000, 80)
    docs = documents(spark, [(i, f"{prose(i, 30)} {p} {prose(1000 + i, 30)}") for i in range(150)])
    rows = substring.repeated_passages(docs).collect()
    assert len(rows) == 149 and {r.source_doc_id for r in rows} == {0}
    assert all(28 <= r.start_word <= 30 and 110 <= r.end_word <= 112 for r in rows)  # the words beside it may agree by chance


def test_a_long_text_that_very_many_quote(spark):
    """2 MB of text, quoted by 1,500 documents: it is sent a few times, not once for each."""
    long_ = prose(77, 330_000).split(" ")
    docs = documents(spark, [(0, " ".join(long_)), *((i, f"{prose(i, 20)} {' '.join(long_[200 * i : 200 * i + 70])} {prose(9000 + i, 20)}") for i in range(1, 1501))])
    rows = {r.doc_id: r for r in substring.repeated_passages(docs).collect()}
    assert len(rows) == 1500 and all(r.source_doc_id == 0 and abs(r.source_start - 200 * i) <= 3 and r.end_word - r.start_word >= 68 for i, r in rows.items())


def test_spans_of_a_document_are_the_same_in_any_lists(spark, monkeypatch):
    docs = documents(spark, [(i, prose(i, 50 + i)) for i in range(9)])
    wanted = spark.createDataFrame([(i % 9, j, j + 3 * k) for i in range(9) for j in (0, 7, 45) for k in (1, 5, 40)], "doc long, start int, stop int").distinct()
    want = sorted(map(tuple, substring.slices(docs, wanted).collect()))
    monkeypatch.setattr(substring, "SPANS", 2)
    assert sorted(map(tuple, substring.slices(docs, wanted).collect())) == want and len(want) == 81
    for d, i, j, words in want:
        assert len(words) == 4 * max(0, min(j, 50 + d) - i)


def test_odd_rows(spark, odd, none):
    assert substring.repeated_passages(odd).count() == 0
    assert substring.repeated_passages(none).count() == 0
    same = substring.without_passages(odd, substring.repeated_passages(odd))
    assert same.exceptAll(odd).isEmpty() and odd.exceptAll(same).isEmpty()
    twice = documents(spark, [(1, prose(1)), (1, prose(1)), (2, prose(1))])
    assert [(r.doc_id, r.source_doc_id) for r in substring.repeated_passages(twice.select("*", F.lit(1).alias("stop"))).collect()] == [(2, 1)]


def test_edits_are_those_of_the_whole_table():
    r = random.Random(8)
    for _ in range(300):
        x, y = ([r.randrange(4) for _ in range(r.randrange(1, 150))] for _ in "ab")
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        assert substring._edits(x, y) == row[-1]


def test_rows_are_those_of_brute_force(spark):
    """Each run of 50 equal words or more, by comparing all positions of all pairs; the words around are all different."""
    passages = [prose(900 + i, n).split() for i, n in enumerate((50, 70, 120))]
    rows = [(10 * i, " ".join([*prose(i, 30 + 7 * i).split(), *passages[i % 3], *prose(100 + i, 45).split()])) for i in range(12)]
    words = {d: t.split() for d, t in rows}
    want = set()
    for d in words:
        best = None
        for e in (e for e in words if e < d):
            for i in range(len(words[d])):
                for j in range(len(words[e])):
                    n = 0
                    while i + n < len(words[d]) and j + n < len(words[e]) and words[d][i + n] == words[e][j + n]:
                        n += 1
                    if n >= 50 and (best is None or n > best[2] - best[1]):
                        best = (d, i, i + n, e, j, j + n, 1.0)
        want |= {best} - {None}
    got = {tuple(r) for r in substring.repeated_passages(documents(spark, rows)).collect()}
    assert got == want and len(want) == 9


def test_words_have_hashes_of_their_own():
    r, words, seen = random.Random(1), substring.WordHashes(), {}
    for _ in range(2000):
        t = bytes(r.choice(b" \t\n\r\v\faAbBzZ\xc3\xa9\x00\xff") for _ in range(r.randrange(40)))
        h, want = words.of(t), t.lower().split()
        assert len(h) == len(want) and all(seen.setdefault(w, x) == x for w, x in zip(want, h))
    assert len(set(seen.values())) == len(seen) > 1000
    assert len(words.of(None)) == len(words.of(b" \n")) == 0
    assert len(set(words.of(b"x" * 300_000 + b" y " + b"X" * 300_000).tolist())) == 2


def test_minimizers_are_the_rightmost_least():
    g = np.random.default_rng(0)
    for _ in range(300):
        s = g.integers(0, g.integers(1, 40) + 1, g.integers(0, 60)).astype(np.uint64)
        for w in (1, 2, 3, 5, 8, 12):
            views = [s[i : i + w] for i in range(max(1, len(s) - w + 1))] if len(s) else []
            assert substring.minimizers(s, w).tolist() == sorted({i + len(v) - 1 - int(v[::-1].argmin()) for i, v in enumerate(views)})


def test_lone_matches_are_aligned_as_others():
    import pyarrow as pa

    g, rows = np.random.default_rng(5), []
    for n in range(2000):
        a = g.integers(0, 6, 130, dtype=np.uint32)
        b, changed = a.copy(), g.random(130) < g.random() / 2
        b[changed] = g.integers(0, 6, changed.sum())
        p = int(g.integers(0, 100))
        b[p : p + 5] = a[p : p + 5]
        s, ss = max(0, p - substring.REACH), max(0, p - int(g.integers(0, substring.REACH + 1)))
        e, ee = (min(int(g.integers(p + 5, 131)), p + 5 + substring.REACH) for _ in "ab")
        rows.append((n, n + 1, [p + 7], [p + 3], s + 7, ss + 3, a[s:e].tobytes(), b[ss:ee].tobytes()))
    kinds = pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.binary()
    names = ["doc", "source", "at", "source_at", "s", "ss", "a_words", "b_words"]
    whole = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    for batch in (whole, whole.slice(17, 500), whole.slice(0, 0)):
        want = []
        for r in batch.to_pylist():
            x, y = (np.frombuffer(r[n], np.uint32) for n in ("a_words", "b_words"))
            for u, v, p, q, same in substring.align(x, y, [r["at"][0] - r["s"]], [r["source_at"][0] - r["ss"]]):
                want.append((r["doc"], r["source"], r["s"] + u, r["s"] + v, r["ss"] + p, r["ss"] + q, same))
        assert list(zip(*(np.asarray(c).tolist() for c in substring.align_lone(batch)))) == want
