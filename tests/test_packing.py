from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from batchloom.errors import TokenLimitExceeded, ValidationError
from batchloom.operators import cuts, packing, payloads

SLIM = "batch_uuid string, request_uuid string, model_name string, created_at timestamp, total_tokens long, byte_size long"


def slim(spark, rows):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    return spark.createDataFrame([(b, f"r{i:03}", m, at + dt.timedelta(seconds=i // 2), t, s) for i, (b, m, t, s) in enumerate(rows)], SLIM)


def brute(rows, tokens, size, records):
    out, last, state = {}, {}, {}
    for i, (b, m, t, s) in enumerate(rows):
        part, T, S, N = state.get(b, (0, 0, 0, 0))
        if N and (m != last[b] or T + t > tokens or S + s > size or N + 1 > records):
            part, T, S, N = part + 1, 0, 0, 0
        state[b], last[b] = (part, T + t, S + s, N + 1), m
        out[f"r{i:03}"] = (part, N + 1)
    return out


def requests(spark, rows):
    """(system, user, model, mode) of one batch."""
    at = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    data = [("b", f"r{i}", m, mode, s, u, at + dt.timedelta(seconds=i)) for i, (s, u, m, mode) in enumerate(rows)]
    return packing.measured(spark.createDataFrame(data, "batch_uuid string, request_uuid string, model_name string, model_mode string, system_prompt string, user_prompt string, created_at timestamp"))


def test_one_part(spark):
    p = packing.parts(packing.pack(requests(spark, [("sys", "hello world", "m", None), ("sys", "foo bar baz", "m", None)]), 100)).collect()
    assert [(r.part_index, r.record_count, r.total_tokens, r.state) for r in p] == [(0, 2, 7, "ready")]


def test_tokens_split(spark):
    p = packing.pack(requests(spark, [(None, "a b c", "m", None), (None, "d e f", "m", None)]), 4).collect()
    assert sorted((r.part_index, r.request_uuid) for r in p) == [(0, "r0"), (1, "r1")]


def test_model_change_cuts_and_null_user_is_empty(spark):
    m = requests(spark, [("sys", "text", "e", "embedding"), (None, None, "c", "chat"), ("", "x", "e", "embedding")])
    p = packing.parts(packing.pack(m, 100), 1).orderBy("part_index").collect()
    assert [(r.model_name, r.total_tokens, r.state) for r in p] == [("e", 1, "ready"), ("c", 0, "overflow"), ("e", 1, "overflow")]
    assert '"content": ""' in m.where("model_name = 'c'").first().line


def test_oversize(spark):
    m = requests(spark, [(None, "a b c", "m", None), (None, "d", "m", None)])
    with pytest.raises(TokenLimitExceeded):
        packing.pack(m, 2)
    assert packing.pack(m, 2, on_oversize="quarantine").count() == 1
    assert [r.reason for r in packing.oversize(m, 2, 10_000).collect()] == ["TOKEN_LIMIT_EXCEEDED"]
    with pytest.raises(ValidationError):
        packing.pack(m, 2, on_oversize="drop")


def test_stats_and_limit(spark):
    stats = packing.token_stats(requests(spark, [("sys", "one two", "m", None), (None, "a b c", "m", None)]))
    r = stats.first()
    assert (r.total_tokens, r.system_tokens, r.request_count, r.avg_tokens, r.max_tokens, r.min_tokens) == (6, 1, 2, 3.0, 3, 3)
    with pytest.raises(TokenLimitExceeded):
        packing.enforce_batch_limit(stats, 5)


def test_internal_split(spark):
    m = slim(spark, [("b", "x", 2, 1), ("b", "y", 2, 1), ("b", "x", 1, 1)])
    got = packing.parts(packing.pack(m, 3, max_records=50, by_model=False)).orderBy("part_index").collect()
    assert [r.record_count for r in got] == [1, 2]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("pqr"), st.sampled_from("xy"), st.integers(0, 9), st.integers(1, 9)), max_size=40), st.integers(9, 25), st.integers(9, 30), st.integers(1, 5))
def test_packing_is_the_plain_fold(spark, rows, tokens, size, records):
    got = packing.pack(slim(spark, rows), tokens, size, records, block=7).collect()
    assert {r.request_uuid: (r.part_index, r.position) for r in got} == brute(rows, tokens, size, records)


@pytest.mark.parametrize(("block", "tokens", "size", "records"), [(1, 9, 300, 500), (3, 200, 500, 7), (5, 60, 47, 1 << 40), (16, 1 << 40, 1 << 40, 45)])
def test_one_run_over_many_blocks(spark, block, tokens, size, records):
    """Parts shorter and longer than blocks, zeros, and a second batch behind."""
    r = random.Random(block)
    rows = [("p", "x", r.choice([0, 0, r.randint(0, 9)]), r.randint(1, 9)) for _ in range(170)] + [("q", None, 1, 1)] * 40
    got = packing.pack(slim(spark, rows), tokens, size, records, block=block).collect()
    assert {x.request_uuid: (x.part_index, x.position) for x in got} == brute(rows, tokens, size, records)


def test_a_run_is_spread_over_tasks(spark):
    rows = slim(spark, [("p", "x", 1, 1)] * 500)
    blocks = cuts.blocks_of(rows, True, 50)
    found = blocks.select("part", "seq", "n", "token_sum", "size_sum", "first_change", "first", "last").collect()
    assert len({r.part for r in found}) > 1 and max(r.n for r in found) <= 50
    at = cuts.Layout.of(found, True)
    assert at.rows[-1] == 500 and sum(at.begins_run) == 1 and at.longest_run() == len(found) - 1
    assert packing.pack(rows.limit(0), 5).collect() == []


def test_the_plan_has_no_single_task(spark):
    packed = packing.pack(slim(spark, [("p", "x", 1, 1)] * 50), 7, block=9)
    assert "SinglePartition" not in packed._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 9), st.booleans()), min_size=1, max_size=60), st.integers(9, 40), st.integers(9, 40), st.integers(1, 9))
def test_pointers_are_the_plain_chain(rows, tokens, size, records):
    t, s, heads = (np.array(c) for c in zip(*rows, strict=True))
    p = cuts.Pointers(t, s, heads, cuts.Most(tokens, size, records))
    for i in range(len(rows)):
        j, T, S = i, 0, 0
        while j < len(rows) and (j == i or not heads[j]) and T + t[j] <= tokens and S + s[j] <= size and j - i < records:
            T, S, j = T + t[j], S + s[j], j + 1
        assert p.next[i] == j
        assert p.last()[i] == p.cuts(i)[-1]


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_runs_do_not_depend_on_spans(spark, block):
    r = random.Random(block)
    rows = [(r.choice("pq"), r.choice(["x", "y", None]), 1, 1) for _ in range(60)]
    got = {x.request_uuid: x.run_index for x in packing.runs(slim(spark, rows), block=block).collect()}
    want, last, n = {}, {}, {}
    for i, (b, m, _, _) in enumerate(rows):
        n[b] = n.get(b, 0) + (b in last and last[b] != m)
        last[b] = m
        want[f"r{i:03}"] = n[b]
    assert got == want


def test_latest_model_row(spark):
    at = lambda d: dt.datetime(2024, 1, d, tzinfo=dt.UTC)
    models = spark.createDataFrame([("1", "m", "a", "CHAT ", at(1)), ("2", "m", "b", " Embedding", at(2)), ("3", "m", "c", "x", None)], "endpoint_uuid string, model_id string, tokenizer_model string, model_mode string, last_verified_at timestamp")
    got = packing.with_model(spark.createDataFrame([("m",), ("n",)], "model_name string"), models).orderBy("model_name").collect()
    assert [(r.model_mode, r.tokenizer_model) for r in got] == [("embedding", "b"), (None, None)]


def test_payloads(spark):
    m = requests(spark, [(None, f"word {i}", "m", None) for i in range(5)]).withColumn("batch_file_uuid", packing.F.lit(None).cast("string"))
    packed = packing.pack(m, 4)
    lines = payloads.lines(m, packed)
    docs = payloads.documents(lines)
    want = {r.request_uuid: r.line for r in m.collect()}
    got = sorted(docs.collect(), key=lambda r: -r.line_count)
    assert sorted(r.line_count for r in got) == [1, 2, 2]
    assert sorted("".join(r.text for r in got).split("\n")[:-1]) == sorted(want.values())
    assert all(r.problem is None for r in payloads.integrity(docs).collect())
    assert payloads.assign(m, lines, expected=5).where("batch_file_uuid IS NULL").count() == 0
    with pytest.raises(ValidationError):
        payloads.assign(m, lines, expected=6)
    assert payloads.new_lines(lines, lines.limit(2)).count() == 3


def test_integrity_problems(spark):
    rows = [("ok", '{"a": 1}\n', 1), ("newline", '{"a": 1}', 1), ("count", '{"a": 1}\n', 2), ("json", '{"a": 1}\n{"a": 1, "a": 2}\n', 2), ("shape", None, 1), ("zero", "", 0), ("below", "", -1), ("one", "", 1), ("blank", "{}\n\n", 2)]
    got = {r.file_id: r.problem for r in payloads.integrity(spark.createDataFrame(rows, "file_id string, text string, line_count long")).collect()}
    assert got == {"ok": None, "newline": "newline", "count": "line_count", "json": "json", "shape": "shape", "zero": None, "below": "shape", "one": "newline", "blank": "json"}


def test_virtual_paths():
    assert payloads.virtual_file_id("memory://file_1") == "file_1"
    for bad in ("memory://", "/tmp/x", "file://x"):
        with pytest.raises(ValidationError):
            payloads.virtual_file_id(bad)
