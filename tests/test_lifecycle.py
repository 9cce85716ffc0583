from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from batchloom.operators import lifecycle
from batchloom.streaming.lifecycle import current_stream

RAW = (
    "tenant_scope string, endpoint_alias string, remote_batch_id string, observation_order long, arrival long, input_file_id string, endpoint string, status string, output_file_id string, "
    "error_file_id string, total string, completed string, failed string, metadata string, observed_at timestamp"
)


def raw(spark, rows, **more):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    data = []
    for i, r in enumerate(rows):
        base = {"tenant_scope": "t", "endpoint_alias": "gw", "remote_batch_id": "b", "observation_order": i + 1, "arrival": i, "input_file_id": None, "endpoint": None, "status": "in_progress", "output_file_id": None, "error_file_id": None, "total": None, "completed": None, "failed": None, "metadata": None, "observed_at": at + dt.timedelta(seconds=i)} | more | r
        data.append(tuple(base.values()))
    return spark.createDataFrame(data, RAW)


def counts(total, completed, failed):
    return {"total": total, "completed": completed, "failed": failed}


def state(spark, rows):
    r = lifecycle.current(lifecycle.normalized(raw(spark, rows))).first()
    return (r.total_requests, r.total_requests_known, r.completed_requests, r.failed_requests, r.observation_order)


def test_known_totals(spark):
    seen = [counts("10", "9", "0"), counts("10", "0", "2"), counts("11", "0", "2")]
    assert state(spark, seen[:1]) == state(spark, seen[:2]) == (10, True, 9, 0, 1)
    assert state(spark, seen) == (11, True, 9, 2, 3)


def test_unknown_totals(spark):
    seen = [counts(None, "5", None), counts("invalid", None, "2"), counts("6", "0", "0"), counts("7", "0", "0")]
    assert state(spark, seen[:1]) == (0, False, 5, 0, 1)
    assert state(spark, seen[:3]) == state(spark, seen[:2]) == (0, False, 5, 2, 2)
    assert state(spark, seen) == (7, True, 5, 2, 4)


def test_order_terminal_and_merging(spark):
    rows = [
        {"observation_order": 5, "input_file_id": "in", "metadata": '{"b": 1, "a": 2}'}, {"observation_order": 4, "status": "failed"}, {"observation_order": 6, "status": "completed", "output_file_id": "out", "metadata": "{}"},
        {"observation_order": 7, "status": "in_progress"}, {"observation_order": 8, "status": "completed", "error_file_id": "err"},
    ]
    r = lifecycle.current(lifecycle.normalized(raw(spark, rows))).first()
    assert (r.batch_status, r.observation_order, r.input_file_id, r.output_file_id, r.error_file_id, r.provider_metadata) == ("completed", 8, "in", "out", "err", '{"a":2,"b":1}')
    assert (r.terminal_at - r.first_seen_at).seconds == 2 and (r.last_observed_at - r.first_seen_at).seconds == 4


def test_unknown_status_may_follow_an_open_one(spark):
    assert lifecycle.current(lifecycle.normalized(raw(spark, [{}, {"status": ""}]))).first().batch_status == "unknown"


def test_normalisation(spark):
    rows = [{"status": None, "total": "true", "completed": "-1", "failed": "1.5", "metadata": "[1]", "output_file_id": "", "endpoint": ""}, {"status": "odd"}, {"endpoint": "/v1/other"}, counts("1", "1", "1"), {"tenant_scope": " t"}, {"remote_batch_id": "a b"}, {"observation_order": 0}, {"input_file_id": "a/b"}, {"endpoint_alias": " "}]
    got = lifecycle.normalized(raw(spark, rows)).orderBy("arrival").collect()
    first = got[0]
    assert (first.batch_status, first.total_requests, first.total_requests_known, first.completed_requests, first.failed_requests, first.provider_metadata, first.output_file_id, first.batch_endpoint) == ("unknown", 0, False, 0, 0, "{}", None, None)
    assert [r.errors for r in got] == [[], ["status"], ["endpoint"], ["counts"], ["tenant_scope"], ["remote_batch_id"], ["observation_order"], ["input_file_id"], ["endpoint_alias"]]


def test_status_view(spark):
    v = lifecycle.status_view(lifecycle.current(lifecycle.normalized(raw(spark, [counts("3", "1", "1") | {"status": "completed"}])))).first()
    assert (v.progress_percentage, v.is_complete) == (66.67, True)


def test_stream_and_batch_agree(spark, tmp_path):
    rows = [{"remote_batch_id": f"b{i % 3}", "observation_order": (i * 7) % 20 + 1, "status": ("in_progress", "", "completed")[i % 5 % 3], **counts("30", str(i), "1")} for i in range(18)]
    all_ = raw(spark, rows)
    for i in range(3):  # one file, one micro-batch
        all_.where(F.col("arrival").between(6 * i, 6 * i + 5)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out: dict[str, tuple] = {}

    def keep(df, _):
        out.update({r.remote_batch_id: tuple(r) for r in df.collect()})

    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = current_stream(lifecycle.normalized(stream)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.remote_batch_id: tuple(r) for r in lifecycle.current(lifecycle.normalized(all_)).collect()}
    assert out == want and len(want) == 3
