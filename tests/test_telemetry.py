from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from batchloom.errors import GatewayError, ValidationError
from batchloom.operators import telemetry as t


@given(st.integers(0, (1 << 62) - 1))
def test_a_bucket_holds_an_eighth(value):
    b = t.bucket(value)
    low = b if b < 8 else (b % 8 + 8) << (b // 8 - 1)
    assert low <= value and (value < low + max(1, low // 8))


def test_columns_are_the_plain_ones(spark):
    values = [*range(300), *(3 << k for k in range(5, 61)), (1 << 62) - 1]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", t.bucket_of(F.col("v")).alias("b")).withColumn("low", t.floor_of(F.col("b"))).collect()
    assert all(r.b == t.bucket(r.v) and r.low <= r.v < r.low + max(1, r.low // 8) for r in got)


CALLS = "operation string, outcome string, error_type string, micros long"


def test_merged_parts_are_the_whole(spark):
    rows = [("a", "success", "ignored", i * i) for i in range(100)] + [("a", "failure", e, 5) for e in ("timeout", "Secret text", None)] + [("b", "success", None, None), ("b", "success", None, -3), (None, "success", None, 1)]
    calls = spark.createDataFrame(rows, CALLS)
    whole = t.histogram(calls)
    parts = [t.histogram(calls.where(F.pmod(F.xxhash64("micros"), F.lit(3)) == k)) for k in range(3)]
    same = lambda df: sorted(map(tuple, df.select(*whole.columns).collect()), key=str)
    assert same(t.merged(*parts)) == same(whole)
    s = {(r.operation, r.outcome, r.error_type): r for r in t.summary(whole, (0.5, 0.99, 1.0)).collect()}
    a = s["a", "success", None]
    assert (a.calls, a.total_micros, a.low, a.high) == (100, sum(i * i for i in range(100)), 0, 9801)
    for q, v in ((a.p50, 49 * 49), (a.p99, 98 * 98), (a.p100, 99 * 99)):
        assert q <= v <= q * 9 / 8 + 1
    assert s["a", "failure", "timeout"].calls == 1 and s["a", "failure", "_OTHER"].calls == 2
    assert s["b", "success", None].calls == 2 and s["b", "success", None].total_micros == 0 and s[None, "success", None].calls == 1
    assert t.summary(t.histogram(calls.limit(0))).count() == 0
    with pytest.raises(ValidationError):
        t.summary(whole, (0.0,))
    with pytest.raises(Exception, match="outcome"):
        t.histogram(spark.createDataFrame([("a", "maybe", None, 1)], CALLS)).collect()


def test_the_recorder_changes_nothing(spark):
    now, sent = [0.0], []

    def export(*call):
        sent.append(call)
        raise RuntimeError("no collector")

    r = t.Recorder(export, lambda: now[0])
    with r.observed("read"):
        now[0] += 2
        with r.observed("inner"):
            now[0] += 1
    for error in (GatewayError("https://secret", status=429), TimeoutError("x"), ConnectionResetError(), GatewayError("x"), KeyError("k")):
        with pytest.raises(type(error)), r.observed("poll"):
            raise error
    assert sent[0] == ("read", "success", None, 3_000_000) and [c[2] for c in sent[1:]] == ["rate_limited", "timeout", "connection", "_OTHER", "_OTHER"]
    s = {(x.operation, x.error_type): x.calls for x in t.summary(r.frame(spark)).collect()}
    assert s == {("read", None): 1, ("poll", "rate_limited"): 1, ("poll", "timeout"): 1, ("poll", "connection"): 1, ("poll", "_OTHER"): 2}


def test_streams_are_recorded(spark, tmp_path):
    r = t.Recorder()
    listener = t.StreamRecorder(r)
    spark.streams.addListener(listener)
    try:
        spark.range(5).write.parquet(f"{tmp_path}/in")
        q = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        for _ in range(100):
            if any(k[0] == "query" for k in r.held):
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert {k[:2] for k in r.held} == {("micro_batch", "success"), ("query", "success")}
