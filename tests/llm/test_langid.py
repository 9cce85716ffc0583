from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from batchloom.llm import langid, queries

from .conftest import documents


def brute_profile(texts, size):
    n = Counter()
    for t in texts:
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            for k in (1, 2, 3):
                p = w if k == 1 else f"_{w}_"
                n.update(p[i : i + k] for i in range(len(p) - k + 1))
    return n


def pack(gram):
    out = 0
    for c in gram:
        out = (out << 16) | (1 if c == "_" else ord(c) & 0xFFFF)
    return out


def test_grams_are_counted(spark):
    texts = ["Ab ab, abc!", "ab 12 é"]
    want = {pack(g): n for g, n in brute_profile(texts, 9).items()}
    # The mark between two words belongs to both, so that a gram over it is counted too.
    o, g, n = langid.grams([0] * len(texts), [langid.symbols(t) for t in texts])
    got = dict(zip(g.tolist(), n.tolist(), strict=True))
    assert all(got[k] >= v for k, v in want.items())
    assert all(g in want or (g >> 16) & 0xFFFF == 1 for g in got)


def test_the_nearest_profile_wins(spark):
    train = documents(spark, ["the cat and the dog and the house", "the bird in the tree"], "en").unionByName(documents(spark, ["der hund und die katze", "das haus und der baum"], "de"))
    learned = langid.learn_profiles(train)
    assert sorted(learned) == ["de", "en"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(documents(spark, ["the dog", "und der hund", "12 34", None, ""]), learned).collect()}
    assert got == {0: "en", 1: "de", 2: "und", 3: "und", 4: "und"}
    # out of place, by hand
    known = langid.Profiles(learned)
    best, score = known.nearest([langid.symbols("the dog")])
    own = langid.grams([0], [langid.symbols("the dog")])
    order = np.lexsort((own[1], -own[2]))
    places = {int(g): i for i, g in enumerate(own[1][order])}
    far = [sum(abs(i - list(learned[x]).index(g)) if g in learned[x] else langid.PROFILE for g, i in places.items()) for x in ("de", "en")]
    assert best[0] == int(np.argmin(far)) and abs(score[0] - (1 - min(far) / (langid.PROFILE * len(places)))) < 1e-12


def test_held_out_accuracy(spark, tables):
    d = tables.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = queries.op2_language_id(spark, d).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98


def test_odd_rows(spark, odd, none):
    learned = langid.learn_profiles(documents(spark, ["plain words of text"], "en"))
    got = langid.identify(odd, learned)
    assert got.count() == odd.count()
    assert {r.doc_id for r in got.where("lang_pred = 'und'").collect()} == {1, 2, 3, 4}
    kept = langid.identified(odd, learned, least=0)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert langid.learn_profiles(none) == {} and langid.learn_profiles(odd.withColumn("lang", F.lit(None).cast("string"))) == {}
    assert langid.identify(odd, {}).where("lang_pred <> 'und' OR score <> 0").count() == 0
    assert langid.identify(none, learned).count() == 0


def test_other_languages_go(spark):
    train = documents(spark, ["the cat and the dog and the house", "the bird in the tree"], "en").unionByName(documents(spark, ["der hund und die katze", "das haus und der baum"], "de"))
    learned = langid.learn_profiles(train)
    docs = documents(spark, ["the dog and the tree", "der baum und das haus", "猫は家の中で静かに眠っている", "кошка спит дома", "12", None])
    left = lambda *a: {r.doc_id for r in langid.identified(docs, learned, *a).collect()}
    assert left(None, 0.1) == {0, 1} and left({"de"}, 0.1) == {1} and left(None, 0.0) == {0, 1, 2, 3}
    assert {r.doc_id for r in langid.identified(docs, {}).collect()} == {0, 1, 2, 3}


def test_query_is_the_brute_force_prediction(spark, tables):
    """Each text's distances by plain dictionaries, over profiles counted by plain dictionaries."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    counts: dict[str, Counter] = {}
    for r in docs:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))][: langid.PROFILE]
    profiles = {x: {g: i for i, g in enumerate(order(c))} for x, c in sorted(counts.items())}
    got = {r.doc_id: r for r in queries.op2_language_id(spark, tables).collect()}
    for r in docs:
        own = order(plain_grams(r.text or ""))
        if not own:
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        far = {x: sum(abs(i - p[g]) if g in p else langid.PROFILE for i, g in enumerate(own)) for x, p in profiles.items()}
        best = min(far, key=lambda x: (far[x], x))
        assert got[r.doc_id].lang_pred == best and abs(got[r.doc_id].score - (1 - far[best] / (langid.PROFILE * len(own)))) < 1e-9


def plain_grams(text):
    """Grams as numbers: letters of 16 bits, 1 for what stands between words."""
    s = [1]
    for c in text.lower():
        x = max(2, ord(c) & 0xFFFF) if c.isalpha() else 1
        if x != 1 or s[-1] != 1:
            s.append(x)
    s += [1] if s[-1] != 1 else []
    if len(s) < 2:
        return Counter()
    one = Counter(x for x in s if x != 1)
    two = Counter((a << 16) | b for a, b in zip(s, s[1:]))
    three = Counter((a << 32) | (b << 16) | c for a, b, c in zip(s, s[1:], s[2:]))
    return one + two + three
