from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from batchloom.llm import queries, token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = token_count.Counter(PATH)


def count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdeing'stTHE  \n\t.,12é中😀\u3000\x1c\u0301"), st.characters(codec="utf-8", exclude_categories=["Cn"]))), st.integers(1, 30), st.integers(0, 9))
def test_counts_are_the_library_s_whatever_the_chunks(text, chunk, at):
    if at < 3:
        text = text[:at] + "<|endoftext|>" + text[at:]
    assert COUNTER.tokens(text, chunk) == count(text)


def test_state_maps_compose_associatively():
    text = "one two\n\n three's  four<|endoftext|> five " * 3
    maps = [COUNTER.map_of(text[i : i + 7]) for i in range(0, len(text), 7)]
    left = maps[0]
    for m in maps[1:]:
        left = COUNTER.compose(left, m)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = COUNTER.compose(m, right)
    total = lambda m: COUNTER.count(m.head) + m.n + COUNTER.count(m.tail)
    assert total(left) == total(right) == count(text)


def test_transducer_survives_a_reset(monkeypatch):
    monkeypatch.setattr(token_count, "MAX_STATES", 5)
    c = token_count.CountTransducer(token_count.vocabulary(PATH))
    for w in ("internationalisation", "zzzzzzzzz", " tokenizer", "internationalisation"):
        assert c.count(w) == count(w)


def rows_of(df):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    return sorted(map(tuple, df.collect()), key=key)


def want_of(docs):
    out = []
    for d in docs.collect():
        n = count(d.text or "")
        out.append((d.doc_id, len((d.text or "").encode()), n, n > 512))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_query_is_the_library(spark, tables):
    assert rows_of(queries.op7_token_counts(spark, tables)) == want_of(spark.read.parquet(f"{tables}/documents.parquet"))


def test_odd_rows(spark, odd, none):
    assert rows_of(token_count.count_tokens(odd, PATH)) == want_of(odd)
    assert token_count.count_tokens(none, PATH).count() == 0


@pytest.mark.parametrize("text,n", [("", 0), ("<|endoftext|>", 1), ("<|endoftext|><|endoftext|>", 2)])
def test_special_strings(text, n):
    assert COUNTER.tokens(text) == n
