from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter
from itertools import pairwise
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from batchloom.llm import phrases, queries

from .conftest import documents


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for p in re.split("[.,;:!?\n-\r]", low) if (w := re.findall("[^ \t]+", p))]


def grams(words):
    return Counter(tuple(words[i : i + s]) for s in range(1, 6) for i in range(len(words) - s + 1))


def plain(rows, least, within, top):
    f, n = {}, Counter()
    for text, lang in rows:
        for words in pieces(text):
            f.setdefault(lang or "und", Counter()).update(grams(words))
            n[lang or "und"] += len(words)
    out = []
    for lang, counts in f.items():
        known = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in known.items():
            if any(100 * b >= within * a for q, b in known.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), " ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        out += [(lang, i + 1, *r[3:]) for i, r in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed, n=80):
    r = random.Random(seed)
    vocab = ["new", "york", "City", "the", "é", "中", "a", "b|c", "x\x00y", "　", "\x1c"]
    return [(r.choice(" .\t\n,").join(r.choice(vocab) for _ in range(r.randint(0, 30))), r.choice(["en", "de", None, "und"])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(t, x, "h", 1, "w", 2, 3, "l") for t, x in rows], "text string, lang string, head string, size int, phrase string, a int, n int, lang_ string")


@pytest.mark.parametrize(("least", "within", "top"), [(3, 100, 2000), (4, 60, 5), (2, 100, 50)])
def test_plain_counts(spark, least, within, top):
    rows = [*corpus(least), *[("New York city, new york", "en")] * 4, (None, "en"), ("", None), ("one two three four five six one two three four five six one two three four five six", "de")]
    got = sorted(map(tuple, phrases.collocations(frame(spark, rows), least, within, top).collect()))
    assert got and got == plain(rows, least, within, top)


def test_query(spark, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{Path(tables).parent / 'sf0.01' / 'documents.parquet'}'")
    got = sorted(map(tuple, queries.op12_phrase_mining(spark, str(Path(tables).parent / "sf0.01")).collect()))
    assert got and got == sorted(con.execute(queries.oracle_sql()["op12_phrase_mining"]).fetchall())


def counted_by(shards, least, ranges):
    """Phrases of shards through tries, each serialised, parsed, and merged by range."""
    by_range = {}
    for s in shards:
        maps = {}
        for level in (1, 2, 3):
            maps[level] = np.full(1 << (phrases.BITS - 3), 255, np.uint8)
        fine = phrases.open_windows(s, maps, 5)
        w = np.zeros((len(s.at), 5), np.int64)
        for d in range(5):
            go = np.flatnonzero(fine[d])
            w[go, d] = s.at[go + d] + 1
        begins = fine[0] & s.begins
        single = np.zeros((begins.sum(), 5), np.int64)
        single[:, 0] = w[begins, 0]
        w = np.concatenate([w[begins & fine[1]], single])
        words = [(s.names[i], x) for i, x in s.words]
        for r in phrases.Trie.merged([(words, w, np.ones(len(w), np.int64))]).serialised(ranges):
            by_range.setdefault(r["range"], []).append(phrases.Trie.parsed(r))
    out = Counter()
    for runs in by_range.values():
        t = phrases.Trie.merged(runs)
        for ranks, sums in t.frequent(least):
            for k, n in zip(ranks.tolist(), sums.tolist(), strict=True):
                key = (t.words[k[0] - 1][0], *(t.words[i - 1][1].decode() for i in k))
                assert key not in out
                out[key] = n[-1]
    return out


@pytest.mark.parametrize("size", [7, 50, 100_000])
def test_shards_and_ranges_don_t_matter(monkeypatch, size):
    monkeypatch.setattr(phrases, "SHARD", size)
    monkeypatch.setattr(phrases, "BYTES", 13)
    rows = [*corpus(9), ("word " * 500, "en"), ("a b c d e f g " * 80, "de")]
    batch = pa.record_batch([pa.array([t for t, _ in rows]), pa.array([x or "und" for _, x in rows])], names=["text", "lang"])
    shards = list(phrases.read_shards(iter([batch])))
    assert len(shards) > 1 or size > 1000
    shards = [phrases.Shard.load(s.row()) for s in shards]
    want = Counter()
    for text, lang in rows:
        for words in pieces(text):
            for g, n in grams(words).items():
                want[lang or "und", *g] += n
    assert counted_by(shards, 1, 5) == want
    totals = Counter()
    for s in shards:
        for t in s.row()["totals"]:
            totals[t["lang"]] += t["n"]
    assert all(n == sum(v for k, v in want.items() if len(k) == 2 and k[0] == lang) for lang, n in totals.items())


def test_tries_are_sorted():
    r = random.Random(2)
    words = [("en", bytes([97 + i])) for i in range(9)]
    w = np.array([[*(r.randint(1, 9) for _ in range(d)), *[0] * (5 - d)] for d in (r.randint(1, 5) for _ in range(500))])
    t = phrases.Trie.merged([(words[::-1], w, np.ones(500, np.int64))])
    rows = list(map(tuple, t.windows.tolist()))
    assert all(a < b for a, b in pairwise(rows)) and t.words == words and t.counts.sum() == 500


def test_buckets_never_lose_a_window():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    b = phrases.Buckets((2,), 3)
    for _ in range(3):
        b.add(2, hashes)
    assert (b.held[2][phrases.bucket(hashes)] == 3).all()
    assert sum(len(r["held"]) for r in b.rows()) > 0


def test_odd_rows(spark, odd, none):
    got = sorted(map(tuple, phrases.collocations(odd, 2, 100, 10**6).collect()))
    assert got == plain([(r.text, r.lang) for r in odd.collect()], 2, 100, 10**6)
    assert phrases.collocations(none).collect() == []
    assert phrases.collocations(documents(spark, [None, "", " . "]), 1).collect() == []


def test_rare_windows_of_four_words_stay_out_of_tries(spark, monkeypatch):
    write, depths = phrases.materialize, []

    def kept(df, label, **k):
        out = write(df, label, **k)
        if label == "phrase-tries":
            depths.extend(b for r in out.select("depth").collect() for b in r.depth)
        return out

    monkeypatch.setattr(phrases, "materialize", kept)
    rows = [(f"one two three w{i % 40}", "en") for i in range(200)] + [(f"v{i % 50} two three four", "en") for i in range(100)] + [("one two three four", "en")] * 5
    got = sorted(map(tuple, phrases.collocations(frame(spark, rows), 100).collect()))
    assert got == plain(rows, 100, 100, 2000)
    assert max(depths) == 3  # "one two three four" is there 5 times, its parts of three words often


def test_a_merge_holds_few_bytes_a_window():
    r = np.random.default_rng(3)
    words = [("en", b"w%d" % i) for i in range(500)]
    w = r.integers(1, 501, (200_000, 5)).astype(np.int32)
    tracemalloc.start()
    phrases.Trie.merged([(words, w, np.ones(len(w), np.int64))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110 * len(w)


def test_windows_that_come_again_leave_a_task_once(monkeypatch):
    monkeypatch.setattr(phrases, "WINDOWS", 1100)
    r = np.random.default_rng(5)
    words = [("en", b"w%02d" % i) for i in range(8)]
    runs = [(words, r.integers(1, 9, (400, 5)).astype(np.int32) * [1, 1, 1, 0, 0], np.ones(400, np.int64)) for _ in range(20)]
    (t,) = phrases.combined(iter(runs))
    assert len(t.counts) <= 8**3 and t.counts.sum() == 20 * 400
    parts = list(t.serialised(3))
    assert all(len(p["labels"]) - 1 <= 3 * len(p["depth"]) and len(p["counts"]) - 1 == len(p["depth"]) for p in parts)
    many = list(phrases.combined((words, r.integers(1, 9, (400, 5)).astype(np.int32), np.ones(400, np.int64)) for _ in range(20)))
    assert len(many) > 1 and sum(int(t.counts.sum()) for t in many) == 20 * 400 and max(len(t.counts) for t in many) < 2000
    for n in (0, 255, 256, 1 << 16, 1 << 40):
        assert phrases.wide(phrases.narrow(np.array([0, n]))).tolist() == [0, n]


def test_buckets_take_memory_for_what_they_hold():
    r = np.random.default_rng(6)
    tracemalloc.start()
    b = phrases.Buckets((3, 4), 100)
    for level in (3, 4):
        b.add(level, r.integers(0, 1 << 63, 100_000).astype(np.uint64))
    rows = list(b.rows())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20 and max(len(x["held"]) for x in rows) < 1 << 16
    assert not list(b.rows())


@pytest.mark.parametrize("held", [0, 3000, 1 << 21])
def test_buckets_given_away_early_count_the_same(monkeypatch, spark, held):
    monkeypatch.setattr(phrases, "HELD", held)
    hashes = np.random.default_rng(7).integers(0, 1 << 12, 30_000).astype(np.uint64) << np.uint64(51)
    b, rows, times = phrases.Buckets((2,), 9), [], 0
    for some in np.split(hashes, 20):
        b.add(2, some)
        if b.full():
            times += 1
            rows += b.rows()
            assert b.held[2].size == 0
    rows += b.rows()
    assert times == {0: 20, 3000: times, 1 << 21: 0}[held] and (held or times)
    maps = phrases.bit_maps(spark.createDataFrame([(x["slot"], x["places"], x["held"]) for x in rows], "slot int, places binary, held binary"), 9)
    keys, n = np.unique(hashes, return_counts=True)
    assert phrases.passed(maps, 2, keys).tolist() == (n >= 9).tolist() and 0 < (n >= 9).sum() < len(n)


def test_ranges_and_rows_don_t_grow_with_the_texts(spark, monkeypatch):
    write, held = phrases.materialize, {}

    def kept(df, label, **k):
        out = write(df, label, **k)
        if label in ("phrase-shards", "phrase-tries"):
            held[label] = out.drop("totals").collect()
        return out

    monkeypatch.setattr(phrases, "materialize", kept)
    monkeypatch.setattr(phrases, "RANGE_WORDS", 4)
    rows = [(f"{'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10 % 10]} end", "en") for i in range(1000)]
    got = sorted(map(tuple, phrases.collocations(frame(spark, rows), 3).collect()))
    assert got == plain(rows, 3, 100, 2000)
    assert max(r["range"] for r in held["phrase-tries"]) >= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = [r for r in held["phrase-shards"] if r["slot"] is None]
    assert shards and sum(len(r["ids"]) for r in shards) <= 4 * len(rows) + 2 * len(shards)  # three words and a gap in each text, a byte each
    assert all(len(r["held"]) < 10_000 for r in held["phrase-shards"] if r["slot"] is not None)


def test_large_rows_lie_in_small_groups(spark):
    rows = spark.range(0, 60, 1, 1).select("id", F.encode(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.sha2((i * 100 + F.col("id")).cast("string"), 256)), ""), "utf-8").alias("held"))
    for group, least in ((0, 1), (1 << 20, 4)):
        out = phrases.materialize(rows, "test-groups", group=group)
        (path,) = Path(out.scratch_path.removeprefix("file:")).glob("*.parquet")
        assert pq.ParquetFile(path).metadata.num_row_groups >= least and out.count() == 60
