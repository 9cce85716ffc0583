from __future__ import annotations

import contextlib

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from batchloom import cli
from batchloom.errors import CheckpointConflict, GatewayError, ValidationError
from batchloom.functions import checks
from batchloom.operators import checkpoints, lifecycle, payloads, prepare
from batchloom.schemas import Limits
from batchloom.sources.durable import DurableProvider

AT = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
FILES = "batch_uuid string, part_index long, payload_file_id string, file_path string, request_count long, total_tokens long, state string"
BATCH = "00000000-0000-0000-0000-000000000001"


def requests(spark, n, done=0):
    rows = [(f"r{i}", BATCH, "m", "", f"word number {i}", "queued", "f" if i < done else None, AT + dt.timedelta(seconds=i)) for i in range(n)]
    return spark.createDataFrame(rows, "request_uuid string, batch_uuid string, model_name string, system_prompt string, user_prompt string, request_status string, batch_file_uuid string, created_at timestamp")


@pytest.fixture(scope="module")
def models(spark):
    return spark.createDataFrame([], "endpoint_uuid string, model_id string, tokenizer_model string, model_mode string, last_verified_at timestamp")


def test_prepare_and_replay(spark, models):
    none = spark.createDataFrame([], FILES)
    p = prepare.prepare(requests(spark, 5), models, none, BATCH, Limits(max_files=1), runtime_limit=6)
    files = p.files.orderBy("part_index").collect()
    assert [(f.request_count, f.total_tokens, f.state) for f in files] == [(2, 6, "ready"), (2, 6, "overflow"), (1, 3, "overflow")]
    assert not p.replayed and p.requests.where("batch_file_uuid IS NULL").count() == 0
    assert tuple(p.totals.first()) == (BATCH, 5, 15, 1, 2)
    text = payloads.load(p.documents, files[0].payload_file_id)
    assert [json.loads(x)["custom_id"] for x in text.splitlines()] == ["r0", "r1"]
    again = prepare.prepare(p.requests, models, p.files, BATCH, Limits())
    assert again.replayed and [f.payload_file_id for f in again.files.collect()] == [f.payload_file_id for f in files]
    with pytest.raises(ValidationError):
        prepare.prepare(requests(spark, 6, done=5), models, p.files, BATCH, Limits())
    assert payloads.load(p.documents, "nothing") is None
    with pytest.raises(ValidationError):
        payloads.load(p.documents.withColumn("line_count", F.lit(9)), files[0].payload_file_id)


def test_batches_by_uuid_or_path(spark):
    b = spark.createDataFrame([(BATCH, "in.jsonl")], "batch_uuid string, input_file_path string")
    assert prepare.resolve_batch(b, BATCH) == prepare.resolve_batch(b, "in.jsonl") == BATCH
    for bad in ("other.jsonl", 5):
        with pytest.raises(ValidationError):
            prepare.resolve_batch(b, bad)


def test_stored_checkpoints(spark):
    struct = "struct<file_kind: string, file_id: string, file_line_number: long, batch_line_count: long, record_count: long, prefix_sha256: string>"
    rows = [("t", "c", "gw", "b", ("result", "f", 2, 3, 2, "0")), ("t", "c", "gw", "bad", ("result", "f", 2, 1, 2, "0"))]
    s = spark.createDataFrame(rows, f"tenant_scope string, consumer string, endpoint_alias string, batch_id string, checkpoint {struct}")
    assert checkpoints.load(s, "t", "c", "gw", "b")["record_count"] == 2
    assert checkpoints.load(s, "t", "c", "gw", "x") is None
    with pytest.raises(CheckpointConflict):
        checkpoints.load(s, "t", "c", "gw", "bad")


class Answers:
    def __init__(self, *answers):
        self.answers = list(answers)

    def __getattr__(self, name):
        return lambda *a: self.answers.pop(0)


def test_durable_calls(spark):
    seen, orders = [], iter(range(1, 99))
    answers = Answers({"id": "b1", "status": "validating", "endpoint": "/v1/embeddings"}, {"id": "b1", "status": "completed", "request_counts": {"total": 2, "completed": 2, "failed": 0}, "metadata": {"k": "v"}}, {"id": "other"}, {"id": "b1", "cancelled": False})
    d = DurableProvider(answers, "t", "gw", lambda: next(orders), seen.append, lambda: AT)
    d.create("f", "/v1/embeddings")
    d.status("b1")
    with pytest.raises(GatewayError):
        d.status("b1")
    assert d.cancel("b1")["cancelled"] is False and len(seen) == 2
    raw = spark.createDataFrame([tuple(o.values()) for o in seen], ", ".join(f"{k} {'long' if k in ('observation_order', 'arrival') else 'timestamp' if k == 'observed_at' else 'string'}" for k in seen[0]))
    states = lifecycle.current(lifecycle.normalized(raw))
    r = lifecycle.point(states, "t", "gw", "b1").first()
    assert (r.batch_status, r.total_requests, r.completed_requests, r.batch_endpoint, r.provider_metadata) == ("completed", 2, 2, "/v1/embeddings", '{"k":"v"}')
    assert lifecycle.point(states, "other", "gw", "b1").count() == 0
    assert [x.observation_order for x in lifecycle.ordered(raw.drop("observation_order"), 10, ["arrival"]).collect()] == [11, 12]


def test_failure_names(spark):
    df = spark.createDataFrame([("timeout",), ("secret text",), (None,)], "x string")
    assert [r[0] for r in df.select(checks.failure_name(F.col("x"))).collect()] == ["timeout", "_OTHER", None]


def test_command_line(tmp_path, capsys, monkeypatch):
    import io

    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO("a b\r\nç".encode())))
    assert cli.main(["count-tokens"]) == 0 and json.loads(capsys.readouterr().out) == {"tokens": 3}
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"\xff")))
    assert cli.main(["count-tokens"]) == 2 and json.loads(capsys.readouterr().err)["error"] == "VALIDATION_ERROR"
    assert cli.main(["health", str(tmp_path)]) == 0 and json.loads(capsys.readouterr().out)["ready"] is False
    with pytest.raises(ValidationError):
        cli.read_text(b"x" * (cli.MAX_TEXT + 1))


def test_scratch_tables_go_but_for_those_kept(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from batchloom.storage import materialize, temporary

    there = lambda df: Path(urlparse(df.scratch_path).path).exists()
    with temporary() as outer:
        a = materialize(spark.range(3), "a")
        with temporary() as inner:
            b, c = materialize(spark.range(4), "b"), inner.keep(materialize(spark.range(5), "c"))
        assert there(a) and not there(b) and there(c) and c.count() == 5
        outer.keep(a)
    assert there(a) and a.count() == 3 and not there(c)
    assert there(materialize(spark.range(1), "d"))
    with contextlib.suppress(RuntimeError), temporary():
        e = materialize(spark.range(2), "e")
        raise RuntimeError
    assert not there(e)
