from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from batchloom.errors import ResultApplicationError, StoreConflict, ValidationError
from batchloom.operators import order
from batchloom.sources import leases
from batchloom.sources.manifests import Folder
from batchloom.sources.store import Merge, Store, insert, upsert
from batchloom.streaming.ledger import KEYS, Ledger

COLUMNS = "batch_id string, endpoint_alias string, file_kind string, file_id string, schema_version int, file_line_number long, batch_line_count long, record_count long, prefix_sha256 string, amount int"


def records(spark, places, batch="b1", file=("result", "f1"), amount=1, mark=""):
    return spark.createDataFrame([(batch, "gw", *file, 1, n, 2 * n, n, f"{mark}{n:x}".rjust(64, "0"), amount) for n in places], COLUMNS)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/ledger")
    s.create("totals", "batch_id string, records long, amount long", ["batch_id"], buckets=4)
    return s


def totals(fresh):
    add = upsert(["batch_id"], lambda o, n: {"records": o("records") + n("records"), "amount": o("amount") + n("amount")})
    return {"totals": Merge(fresh.groupBy("batch_id").agg(F.count("*").alias("records"), F.sum("amount").alias("amount")), add)}


def seen(store):
    return {r["batch_id"]: r["records"] for r in store.read("totals").collect()}


def test_records_have_their_effect_once(spark, store):
    apply = Ledger(store, "t", "c", totals, buckets=4)
    apply(records(spark, [1, 2]), 0)
    apply(records(spark, [1, 2]), 0)  # the same micro-batch again
    apply(records(spark, [1, 2]))  # replays without an epoch
    assert seen(store) == {"b1": 2}
    apply(records(spark, [2, 3, 4]), 1)
    apply(records(spark, [1], "b2").unionByName(records(spark, [5])), 2)
    assert seen(store) == {"b1": 5, "b2": 1}
    apply(records(spark, []), 3)
    assert store.lookup("result_progress", tenant_scope="t", consumer="c", endpoint_alias="gw", batch_id="b1").head()["record_count"] == 5


def test_what_doesn_t_continue_is_refused_whole(spark, store):
    apply = Ledger(store, "t", "c", totals, buckets=4)
    apply(records(spark, [1, 2]), 0)
    for bad in (records(spark, [4]), records(spark, [3, 5]), records(spark, [2, 3], mark="f"), records(spark, [3], file=("error", "f2")), records(spark, [3, 3]), records(spark, [3]).withColumn("prefix_sha256", F.lit("x")), records(spark, [3]).withColumn("endpoint_alias", F.lit(None).cast("string"))):
        with pytest.raises(ResultApplicationError):
            apply(records(spark, [1], "b9").unionByName(bad), 1)
    assert seen(store) == {"b1": 2}
    Ledger(store, "t", "c", totals, same_file=False, buckets=4)(records(spark, [3], file=("error", "f2")), 1)
    assert seen(store) == {"b1": 3}
    with pytest.raises(ValidationError):
        Ledger(store, "", "c", totals, buckets=4)


def test_consumers_and_tenants_don_t_disturb_each_other(spark, store):
    for tenant, consumer in (("t", "c"), ("t", "d"), ("u", "c")):
        Ledger(store, tenant, consumer, totals, buckets=4)(records(spark, [1, 2]), 0)
    assert seen(store) == {"b1": 6}
    assert store.read("result_progress").select(*KEYS).distinct().count() == 3


def test_a_crash_between_effect_and_progress_changes_nothing(spark, store, monkeypatch):
    apply = Ledger(store, "t", "c", totals, buckets=4)
    apply(records(spark, [1]), 0)
    write, done = Store._write, []

    def dies(self, snap, name, m):
        if done:
            raise RuntimeError("killed")
        done.append(name)
        return write(self, snap, name, m)

    monkeypatch.setattr(Store, "_write", dies)
    with pytest.raises(RuntimeError):
        apply(records(spark, [2, 3]), 1)
    monkeypatch.setattr(Store, "_write", write)
    assert done == ["totals"] and seen(store) == {"b1": 1}
    create = Folder.create
    monkeypatch.setattr(Folder, "create", lambda self, number, content: create(self, number, content) and (_ for _ in ()).throw(RuntimeError("killed after the manifest")))
    with pytest.raises(RuntimeError):
        apply(records(spark, [2, 3]), 1)
    monkeypatch.setattr(Folder, "create", create)
    apply(records(spark, [2, 3]), 1)
    assert seen(store) == {"b1": 3}


def test_a_late_holder_applies_nothing(spark, store):
    old = leases.acquire(spark, store.root, "c", "a", 1, lambda: 0.0)
    apply = Ledger(store, "t", "c", totals, buckets=4)
    apply(records(spark, [1]), 0, lease=old)
    assert leases.acquire(spark, store.root, "c", "b", 1, lambda: 9.0).token == 2
    with pytest.raises(StoreConflict):
        apply(records(spark, [2]), 1, lease=old)
    assert seen(store) == {"b1": 1}


def test_a_stream_restarts_where_it_was(spark, store, tmp_path):
    source, check = f"{tmp_path}/in", f"{tmp_path}/check"
    apply = Ledger(store, "t", "c", totals, buckets=4)

    def go():
        q = spark.readStream.schema(COLUMNS).parquet(source).writeStream.foreachBatch(lambda df, epoch: apply(df, epoch)).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()

    records(spark, [1, 2]).coalesce(1).write.mode("append").parquet(source)
    go()
    go()
    records(spark, [3]).coalesce(1).write.mode("append").parquet(source)
    go()
    assert seen(store) == {"b1": 3}


def test_numbers_run_through_all_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"), F.when(F.col("id") % 10 == 0, None).otherwise(F.lit("s")).alias("y"))
    out = order.numbered(rows, ["x"], "n", first=11)
    assert [(r.x, r.n) for r in out.orderBy("n").collect()] == [(x, 11 + i) for i, x in enumerate(sorted(i * 7919 % 1009 for i in range(1000)))]
    assert out.columns == ["x", "y", "n"] and order.numbered(rows.limit(0), ["x"]).count() == 0
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    same = order.numbered(spark.range(50).select(F.lit(1).alias("x")), ["x"])
    assert sorted(r.number for r in same.collect()) == list(range(1, 51))


def test_blocks_of_numbers(spark, store):
    assert [order.reserve(store, "a", 5), order.reserve(Store(spark, store.root), "a", 2), order.reserve(store, "b", 1), order.reserve(store, "a", 1)] == [1, 6, 1, 8]
    with pytest.raises(ValidationError):
        order.reserve(store, "a", 0)


def test_insert_ledger_of_lines(spark, store):
    """An effect that inserts is safe too where two batches bring the same key."""
    store.create("lines", "id string, amount int", ["id"], buckets=2)
    apply = Ledger(store, "t", "lines", lambda f: {"lines": Merge(f.select(F.concat("batch_id", F.col("record_count") % 2).alias("id"), "amount"), insert(["id"]))}, buckets=2)
    apply(records(spark, [1, 2, 3, 4]), 0)
    assert store.read("lines").count() == 2
