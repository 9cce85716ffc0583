from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from batchloom.errors import ValidationError
from batchloom.operators import lifecycle
from batchloom.plans import fixtures
from batchloom.streaming import watch

from .test_lifecycle import RAW, counts, raw


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    watch.prepare(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


class Run:
    """A stream over a folder. Timers fire in micro-batches without input too, so it is stopped and doesn't end by itself."""

    def __init__(self, spark, path, schema, **seconds):
        self.spark, self.path, self.schema, self.seconds, self.out = spark, path, schema, seconds, []

    def put(self, df):
        df.coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def start(self):
        stream = lifecycle.normalized(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in"))
        self.query = watch.watched(stream, **self.seconds).writeStream.outputMode("update").foreachBatch(lambda df, _: self.out.extend(df.collect())).option("checkpointLocation", f"{self.path}/cp").trigger(processingTime="100 milliseconds").start()

    def until(self, done, seconds=60):
        end = time.time() + seconds
        while not done(self.out):
            assert self.query.isActive, self.query.exception()
            assert time.time() < end, self.out
            time.sleep(0.1)

    def rows(self):
        return self.query.lastProgress.stateOperators[0].numRowsTotal

    def stop(self):
        self.query.stop()
        self.query.awaitTermination(30)


def test_stream_equals_batch_on_events(rocks, tables, tmp_path):
    o = fixtures.observations(rocks, tables)
    run = Run(rocks, tmp_path, o.schema)
    cut = o.approxQuantile("arrival", [0.3, 0.7], 0.0)
    parts = [o.where(c) for c in (F.col("arrival") <= cut[0], (F.col("arrival") > cut[0]) & (F.col("arrival") <= cut[1]), F.col("arrival") > cut[1])]
    seen = 0
    for i, part in enumerate(parts):
        run.put(part)
        seen += lifecycle.normalized(part).where("size(errors) = 0").select(*lifecycle.KEYS).distinct().count()
        if i != 1:  # the second part comes to a stream that runs, the third after a restart
            run.start()
        run.until(lambda out: len(out) >= seen)
        if i:
            run.stop()
    key = lambda r: (r.tenant_scope, r.endpoint_alias, r.remote_batch_id)
    want = {key(r): tuple(r) for r in lifecycle.current(lifecycle.normalized(o)).collect()}
    assert {key(r): tuple(r)[:-1] for r in run.out} == want and {r.event for r in run.out} == {"observed"}


def one(spark, batch, order, status):
    return raw(spark, [{"remote_batch_id": batch, "observation_order": order, "arrival": order, "status": status, **counts("3", "1", "1")}])


def test_deadlines_and_forgetting(rocks, tmp_path):
    run = Run(rocks, tmp_path, RAW, wait_seconds=2, keep_seconds=4)
    run.put(one(rocks, "slow", 1, "in_progress").unionByName(one(rocks, "quick", 2, "completed")))
    run.start()
    run.until(lambda out: len(out) == 3)
    assert [(r.remote_batch_id, r.event) for r in sorted(run.out, key=lambda r: (r.event, r.remote_batch_id))] == [("quick", "observed"), ("slow", "observed"), ("slow", "timed_out")]
    run.put(one(rocks, "slow", 4, "completed"))  # goes on from its state
    run.until(lambda out: len(out) == 4)
    assert (run.out[3].event, run.out[3].observation_order, run.out[3].completed_requests) == ("observed", 4, 1)
    full = run.rows()
    time.sleep(5)
    run.put(one(rocks, "quick", 1, "in_progress"))  # forgotten: begins anew, although it had ended with a higher order
    run.until(lambda out: len(out) == 5)
    assert (run.out[4].remote_batch_id, run.out[4].batch_status, run.out[4].observation_order) == ("quick", "in_progress", 1)
    run.until(lambda out: len(out) == 6)
    assert run.out[5].event == "timed_out" and len(run.out) == 6 and run.rows() <= full
    run.stop()


def test_times_are_checked(rocks):
    with pytest.raises(ValidationError):
        watch.watched(lifecycle.normalized(raw(rocks, [])), wait_seconds=0)
