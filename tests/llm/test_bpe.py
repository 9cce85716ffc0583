from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from batchloom.llm import bpe, queries
from batchloom.llm.vocab import vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts(n=400):
    r = random.Random(3)
    letters = "abcdeéßñ THEing's  \n\t \x1c\x85\x0b'12٣½.,!—😀中文ＡΣςİ\u0301\u200dǅŉ"
    for i in range(n):
        x = "".join(r.choice(letters) for _ in range(r.randrange(0, 60)))
        yield x[:9] + ("<|endoftext|>" if i % 5 == 0 else "<|startoftext|>" if i % 7 == 0 else "") + x[9:]


def test_lexicon_holds_its_words_and_no_others(tmp_path):
    words = {w: [i, i + 1][: 1 + i % 2] for i, w in enumerate(["a", "ab", "abc", "xbc", "bc", "é", "ébc", "walking", "talking", "king"])}
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon(words))
    x = bpe.Lexicon(str(path))
    assert {w: x.get(w.encode()) for w in words} == words
    assert all(x.get(w.encode()) is None for w in ("", "b", "abcd", "alking", "kin", "\xc3"))
    states = struct.unpack_from("<5I", path.read_bytes())[0]
    assert states < len({w.encode()[:i] for w in words for i in range(len(w.encode()) + 1)})  # suffixes are shared


def test_empty_lexicon(tmp_path):
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon({}))
    assert bpe.Lexicon(str(path)).get(b"a") is None


@pytest.mark.parametrize("listed", [[], ["the", "ing", "abc", "'s"]])
def test_encoder_is_the_library(tmp_path, monkeypatch, library, listed):
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon({w: vocabulary(PATH).encode_word(w) for w in listed}))
    monkeypatch.setattr(bpe.SparkFiles, "get", staticmethod(lambda name: name))
    e = bpe.Encoder(PATH, str(path))
    for x in texts():
        want = library.encode(x, add_special_tokens=False).ids
        got = e.encode(x)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == want, x
        assert e.decode(got) == library.decode(want, skip_special_tokens=False)


def check(rows, docs, library):
    want = []
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        want.append((d.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_query_is_the_library(spark, tables, library):
    check(queries.op1_bpe_roundtrip(spark, tables).collect(), spark.read.parquet(f"{tables}/documents.parquet").collect(), library)


def test_odd_rows(spark, odd, none, library):
    rows = bpe.transcode(odd, PATH, size=5).select("doc_id", "n_tokens", bpe.F.sha2("ids", 256), bpe.F.sha2(bpe.F.col("decoded").cast("binary"), 256)).collect()
    check(rows, odd.collect(), library)
    assert bpe.transcode(none, PATH).count() == 0
    assert bpe.transcode(odd, PATH, decoded=False).where("decoded IS NOT NULL").count() == 0


def test_lexicon_takes_the_frequent_words(spark):
    df = spark.createDataFrame([("b a b c. b",), (None,), ("B a",)], "text string")
    assert {r.word: r.n for r in bpe.count_words(df, PATH).collect()} == {"a": 2, "b": 4, "c": 1, ".": 1}


@pytest.mark.parametrize("n", [47, 48, 49, 200, 3000, 1_000_000])
def test_very_long_words_are_the_library_s(library, n):
    r = random.Random(n)
    word = "".join(r.choices("etaoinshrdlucé", k=n))
    assert vocabulary(PATH).encode_word(word) == library.encode(word, add_special_tokens=False).ids


def test_equal_pairs_are_merged_from_the_left(library):
    for word in ("a" * 300, "ab" * 151, "aab" * 77, "e" * 4097):
        assert vocabulary(PATH).encode_word(word) == library.encode(word, add_special_tokens=False).ids
