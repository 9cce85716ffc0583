"""The pipeline on a small corpus, stage by stage, against plain versions; and its registration."""

from __future__ import annotations

import hashlib
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from batchloom.llm import mixing

from .conftest import EXTRA, SCHEMA, prose


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    passage = prose(500, 60)
    rows = [(i, prose(i, 150), "en" if i % 2 else "de", f"s{i % 4}") for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(4)]
    rows += [(200 + i, rows[i][1].replace(rows[i][1].split()[70], "changed", 1), "en", None) for i in range(10, 16)]
    rows += [(300 + i, f"{prose(300 + i, 50)} {passage} {prose(400 + i, 50)}", "en", "s1") for i in range(6)]
    rows += [(5, prose(700, 150), "en", "s2"), (6, rows[7][1], "en", "s1"), (8, rows[8][1], "de", "s0"), (8, rows[8][1], "de", "s0"), (None, prose(701, 150), "de", "s3")]
    rows += [(950, " ".join("猫は家の中で静かに眠っている" for _ in range(30)), None, "s1")]
    rows += [(901, None, "en", "s0"), (902, "", "en", "s0"), (903, "12 34 ...", None, "s0")]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, x, s, len(t or ""), *EXTRA) for i, t, x, s in rows], SCHEMA).repartition(4).write.parquet(f"{d}/documents.parquet")
    return d, rows, passage


def test_stages(spark, corpus):
    d, rows, passage = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        assert name == "bpe_encoding" or docs.columns == columns
        path = f"{d}/out-{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    by = lambda r: (r[0] is None, r[0] or 0, r[1])
    told = sorted(((i, t) for i, t, _, _ in rows if t and any(c.isalpha() for c in t) and i != 950), key=by)
    assert sorted(((r.doc_id, r.text) for r in out["language_id"]), key=by) == told

    kept = []  # rows, not ids: one of those that are alike
    for i, t in told:
        if all(jaccard(t, u) < 0.8 for _, u in kept):
            kept.append((i, t))
    assert sorted(((r.doc_id, r.text) for r in out["simhash_near_dedup"]), key=by) == kept
    assert sum(i == 5 for i, _ in kept) == 2 and [i for i, _ in kept if i in (6, 7, 8)] == [6, 6, 8]

    cut = sorted(((r.doc_id, r.text) for r in out["substring_dedup"]), key=by)
    want = [(i, t if not 300 < (i or 0) < 400 else " ".join(t.split()[:50] + t.split()[110:])) for i, t in kept]
    assert cut == sorted(want, key=by) and all(r.n_chars == len(r.text) for r in out["substring_dedup"])

    taken = sorted(((r.doc_id, r.text) for r in out["source_mixing"]), key=by)
    assert set(taken) <= set(cut)
    source = {(r.doc_id, r.text): r.source for r in out["substring_dedup"]}
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    words = lambda rows, s: sum(len(t.split()) for i, t in rows if source[i, t] == s)
    for s, t in zip(names, mixing.fill([words(cut, s) for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))]), strict=True):
        assert abs(words(taken, s) - t) <= 160

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in taken:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), struct.pack(f"<{len(ids)}I", *ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in out["bpe_encoding"]), key=key) == sorted(want, key=key)


def test_identical_rows_of_a_mix_share_their_copies(spark):
    docs = spark.createDataFrame([(i % 20, prose(i % 20, 30), "en", f"s{i % 2}", 1, *EXTRA) for i in range(60)], SCHEMA)
    rows = corpus_pipeline.source_mixing(spark, docs, "").collect()
    for s, share in (("s0", 5 / 7), ("s1", 2 / 7)):
        assert abs(sum(len(r.text.split()) for r in rows if r.source == s) - 60 * 30 * share) <= 60


def test_an_unlabelled_corpus_keeps_what_has_letters(spark):
    docs = spark.createDataFrame([(1, "plain words", None, "s", 1, *EXTRA), (2, "猫は眠る", None, "s", 1, *EXTRA), (3, "12", None, "s", 1, *EXTRA), (4, None, None, "s", 1, *EXTRA)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [1, 2]


def test_run_is_the_stages_in_turn(spark, corpus):
    d = corpus[0]
    got = corpus_pipeline.run(spark, d)
    want = spark.read.parquet(f"{d}/out-bpe_encoding")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_registration():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= names


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
