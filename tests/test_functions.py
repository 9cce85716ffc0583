from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from batchloom.errors import ValidationError
from batchloom.functions import checks, render, tokens
from batchloom.functions.strict_json import canonical, is_lenient_object, is_strict_object
from batchloom.schemas import Limits

TEXTS = ["plain", 'a "quote" and \\ slash / and\nnew\tline\r', "é 中文 😀 \x7f", "", "  spaced  out  "]


def values(spark, items, column, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_lines_are_those_of_json_dumps(spark):
    rows = [("id", "m", mode, system, user) for mode in ("chat", None, "odd") for system in ("", "be kind", None) for user in TEXTS]
    df = spark.createDataFrame(rows, "id string, model string, mode string, s string, u string")
    got = [r[0] for r in df.select(render.request_line(*(F.col(c) for c in df.columns))).collect()]
    for line, (i, m, _, s, u) in zip(got, rows, strict=True):
        messages = ([{"role": "system", "content": s}] if s else []) + [{"role": "user", "content": u}]
        assert line == json.dumps({"custom_id": i, "method": "POST", "url": "/v1/chat/completions", "body": {"model": m, "messages": messages}}, ensure_ascii=False)


def test_embedding_lines_keep_null_and_drop_the_system_prompt(spark):
    df = spark.createDataFrame([("i", "m", " Embedding ", "s", None), ("i", "m", "embedding", "s", "x")], "id string, model string, mode string, s string, u string")
    got = [json.loads(r[0]) for r in df.select(render.request_line(*(F.col(c) for c in df.columns))).collect()]
    assert [g["body"] for g in got] == [{"model": "m", "input": None}, {"model": "m", "input": "x"}]
    assert got[0]["url"] == "/v1/embeddings"
    assert values(spark, ["é"], render.line_bytes) == [3]


def test_whitespace_tokens(spark):
    assert values(spark, ["a  b\n\tc", "", None, " x "], tokens.whitespace_tokens) == [3, 0, 0, 1]
    with pytest.raises(ValidationError):
        tokens.Tokenizers().get("nothing")


def test_vocabulary_tokens(spark, tmp_path):
    ranks = [bytes([b]) for b in range(256)] + [b"ab", b"abab"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(ranks)))
    count = tokens.vocabulary_tokens(str(path), r"\S+|\s+", (("<end>", 300),))
    assert values(spark, ["ababx", "ab<end>ab", "", None], count) == [2, 3, 0, 0]


def test_grammars(spark):
    assert values(spark, ["a", "a.b:c-d_1", "-a", "", "a" * 256, "a" * 257, "a\n", None], checks.is_resource_id) == [True, True, False, False, True, False, False, False]
    assert values(spark, [" gw ", "", "x" * 129, "a\x00b", None], checks.clean_alias) == ["gw", None, None, None, None]
    assert values(spark, ["gw", " gw"], checks.is_exact_alias) == [True, False]
    good = ["/v1/chat/completions", "/v1/embeddings", "/api/v2.1/batch_jobs"]
    bad = ["", "v1/x", "//h/v1", "/v1/", "/v1//x", "/v1/./x", "/v1/../x", "/v1?x", "/v1#f", "/v1\\x", "/v1 x", "/v1/é", "/s" * 17, "/" + "a" * 256, None]
    assert values(spark, good + bad, checks.is_endpoint_path) == [True] * len(good) + [False] * len(bad)
    urls = ["https://a.example/v1/", "HTTPS://a.example:443", "http://localhost:8080/x", "http://127.0.0.1", "http://[::1]:9/"]
    wrong = ["http://a.example", "ftp://a", "https://u@a.example", "https://a.example?q", "https://a.example#f", "https://a b", "https://a\\b", "https://a.example:0", "https://", None]
    assert values(spark, urls + wrong, checks.is_gateway_url) == [True] * len(urls) + [False] * len(wrong)
    assert values(spark, urls[:2], checks.clean_gateway_url) == ["https://a.example/v1", "https://a.example:443"]


def test_keys_are_those_of_hashlib(spark):
    raw = b"".join(len(x).to_bytes(8, "big") + x for x in (b"t", b"gw", "é".encode()))
    want = int.from_bytes(hashlib.sha256(b"dom" + raw).digest()[:8], "big", signed=True)
    df = spark.createDataFrame([("t", "gw", "é", "ffffffff-ffff-ffff-ffff-ffffffffffff")], "a string, b string, c string, u string")
    got = df.select(checks.flight_key(b"dom", F.col("a"), F.col("b"), F.col("c")), checks.lock_key(F.col("u"))).first()
    assert tuple(got) == (want, (1 << 63) - 1)


def test_retries(spark):
    now = F.lit(dt.datetime(2024, 5, 1, tzinfo=dt.UTC))
    got = values(spark, ["7", "Wed, 01 May 2024 00:01:00 GMT", "Tue, 30 Apr 2024 00:01:00 GMT", "soon", "-1", "٣", None], lambda c: checks.retry_after_seconds(c, now))
    assert got == [7.0, 60.0, 0.0, None, None, None, None]
    assert values(spark, [1, 2, 9], checks.backoff_ceiling, "int") == [0.5, 1.0, 30.0]
    rows = [("GET", 429, 1, None, True), ("GET", 425, 2, 30.0, True), ("GET", 503, 3, None, False), ("POST", 503, 1, None, False), ("GET", 500, 1, None, False), ("GET", 429, 1, 31.0, False)]
    df = spark.createDataFrame(rows, "m string, s int, a int, w double, want boolean")
    assert all(r[0] == r[1] for r in df.select(checks.should_retry(*(F.col(c) for c in "msaw")), "want").collect())


def test_progress(spark):
    df = spark.createDataFrame([(0, 0, 0), (8, 1, 0), (3, 1, 1), (1, 2, 0)], "t long, c long, f long")
    assert [r[0] for r in df.select(checks.progress_percentage(F.col("t"), F.col("c"), F.col("f"))).collect()] == [0.0, 12.5, 66.67, None]


def test_strict_json(spark):
    good, loose, bad = ['{"a": 1}', '{"a": {"b": [1.5]}}'], ['{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1e999}'], ["[1]", "{} x", "{'a': 1}", "", None, '{"a": 01}']
    assert values(spark, good + loose + bad, is_strict_object) == [True] * 2 + [False] * 9
    assert values(spark, good + loose + bad, is_lenient_object) == [True] * 5 + [False] * 6
    assert canonical('{"b": 1, "a": "é"}') == '{"a":"é","b":1}'
    assert canonical('{"a": "%s"}' % ("x" * 70_000)) == canonical('{"a": NaN}') == canonical('{"a": "\\u0000"}') == canonical(None) == "{}"


@pytest.mark.parametrize("name,value", [("per_batch", 0), ("per_batch", True), ("max_records", -1), ("buffer_percentage", 51), ("buffer_percentage", True)])
def test_limits_are_checked(name, value):
    with pytest.raises(ValidationError):
        Limits(**{name: value})


def test_effective_limit():
    assert Limits().effective() == 4_750_000_000
    assert Limits(per_batch=101, buffer_percentage=10).effective() == 90
    assert Limits().effective(7) == 7


def test_control_letters_are_those_of_json_dumps(spark):
    texts = ["".join(map(chr, range(32))) + "\x7f\u2028", "\\u001B \\\x1b\x1b\\\\\x1f", "\x0b\x0e\x0f\x1a\x1c"]
    assert values(spark, texts, render.json_text) == [json.dumps(t, ensure_ascii=False) for t in texts]


def test_only_a_real_nul_empties_metadata():
    assert canonical('{"a": "x\\\\u0000y"}') == '{"a":"x\\\\u0000y"}' and canonical('{"a": "x\\u0000y"}') == "{}"


def test_tokenizers_are_chosen_by_model(spark):
    known = tokens.Tokenizers()
    known.register("letters", lambda t: F.coalesce(F.length(t), F.lit(0)).cast("long"))
    rows = spark.createDataFrame([("a b c", "letters", "m"), ("a b c", None, "whitespace"), ("a b", " ", "letters"), (None, "letters", "m")], "t string, tokenizer_model string, model string")
    count = lambda df: [r[0] for r in df.select(known.by_model(F.col("t"), F.col("tokenizer_model"), F.col("model"))).collect()]
    assert count(rows) == [5, 3, 3, 0]
    with pytest.raises(Exception, match="unknown tokenizer: m"):
        count(rows.withColumn("tokenizer_model", F.lit(None).cast("string")))


def test_a_large_text_is_checked_line_by_line():
    from batchloom.functions import strict_json

    raw = b'{"a": 1}\n' * 300_000
    tracemalloc.start()
    assert sum(1 for _ in strict_json._lines(memoryview(raw))) == 300_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20
    cases = [b"", b"\n", b"a", b"a\n", b"a\n\n", b"a\n\nb", b"x" * 40_000 + b"\ny\n", b"x" * strict_json.CHUNK + b"\n"]
    assert [list(strict_json._lines(memoryview(c))) for c in cases] == [c.removesuffix(b"\n").split(b"\n") for c in cases]
