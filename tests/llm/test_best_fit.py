from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from batchloom.llm import best_fit, queries
from batchloom.llm.common import table

from .conftest import documents, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()


def hold(rows, docs, library, size=2048):
    """Every document's pieces are there once, and sequences are gapless and no longer than `size`."""
    want = Counter()
    for i, text in docs:
        ids = plain(library, text)
        n, first = len(ids) // 4, (len(ids) // 4 - 1) % size + 1
        for k, (a, b) in enumerate(zip([0, *range(first, n, size)], [*range(first, n, size), n], strict=True)):
            want[i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(e <= size for e in ends.values())
    return len(ends)


def fewest(items, size):
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for b in {x: k for k, x in enumerate(bins) if x + items[i] <= size}.values():
            bins[b] += items[i]
            place(i + 1, bins)
            bins[b] -= items[i]
        place(i + 1, [*bins, items[i]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    r = random.Random(5)
    fixed_items = 0
    for _ in range(400):
        size = r.randint(4, 30)
        items = [r.randint(1, size) for _ in range(r.randint(1, 9))]
        fixed, left = best_fit.reduce_instance(Counter(items), size)
        assert all(sum(w * n for w, n in p.items) <= size for p in fixed)
        rest = [w for w, n in left.items() for _ in range(n)]
        held = Counter(w for p in fixed for w, n in p.items for _ in range(n * p.count))
        assert held + Counter(rest) == Counter(items)
        assert sum(p.count for p in fixed) + (fewest(rest, size) if rest else 0) == fewest(items, size)
        fixed_items += held.total()
    assert fixed_items > 1000


def test_best_fit_is_the_plain_one():
    r = random.Random(6)
    for _ in range(200):
        size = r.randint(4, 40)
        items = [r.randint(1, size) for _ in range(r.randint(1, 60))]
        bins = []
        for w in sorted(items, reverse=True):
            fits = [b for b in bins if b[0] >= w]
            b = min(fits, key=lambda b: b[0]) if fits else bins.append([size]) or bins[-1]
            b[0] -= w
        got = best_fit.best_fit(Counter(items), size)
        assert sorted(b[0] for b in bins) == sorted(size - sum(w * n for w, n in p.items) for p in got for _ in range(p.count))


def test_slots_stay_few():
    r = random.Random(7)
    counts = {w: r.randint(1, 10**9) for w in range(1, 2049)}
    slots = best_fit.plan(counts, 2048)
    assert len(slots["length"]) < 70_000


def test_ids_are_the_library_s(library):
    encode, r = best_fit.Encoder(PATH), random.Random(8)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u3000", "é", "1", "'s", "'LL", "<|endoftext|>", "!", "中", "\U0001f600", "\xa0", "x" * 70, "\u180e", "\u200b"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert encode(text) + b"\0\0\0\0" == plain(library, text)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000, 7)]):
        text = f"a{c} b {c}.{c}1{c}{c}"
        assert encode(text) + b"\0\0\0\0" == plain(library, text)


def test_query(spark, tables, library):
    rows = queries.op13_best_fit_packing(spark, tables).collect()
    docs = [(r.doc_id, r.text) for r in table(spark, tables, "documents").collect()]
    n = hold(rows, docs, library)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


def test_small_sequences_hot_lengths_and_long_texts(spark, library, monkeypatch):
    monkeypatch.setattr(best_fit, "GROUP", 7)
    texts = [prose(1, 3)] * 90 + [prose(i, i % 40) for i in range(60)] + [prose(9, 5000)]
    rows = best_fit.pack(documents(spark, texts), PATH, size=64).collect()
    hold(rows, list(enumerate(texts)), library, 64)


def test_odd_rows(spark, odd, none, library):
    rows = best_fit.pack(odd, PATH).collect()
    assert hold(rows, [(r.doc_id, r.text) for r in odd.collect()], library) >= 1
    assert best_fit.pack(none, PATH).count() == 0
    with pytest.raises(ValueError):
        best_fit.pack(odd, PATH, size=0)
