from __future__ import annotations

import threading
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from batchloom.errors import StoreConflict, ValidationError
from batchloom.operators import checkpoints
from batchloom.sources import leases
from batchloom.sources.manifests import Folder
from batchloom.sources.store import Merge, Store, insert, upsert

SCHEMA = "k long, v string, n int"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.create("t", SCHEMA, ["k"], buckets=8)
    return s


def rows(store, at=None):
    return sorted(map(tuple, store.read("t", at).drop("bucket_").collect()))


def changes(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def put(store, data, how=None, **more):
    return store.merge({"t": Merge(changes(store.spark, data), how or upsert(["k"]))}, **more)


def test_merges_and_snapshots(store):
    put(store, [(1, "a", 1), (2, "b", 1)])
    put(store, [(2, "B", 5), (3, None, None)])
    assert rows(store) == [(1, "a", 1), (2, "B", 5), (3, None, None)]
    assert rows(store, 2) == [(1, "a", 1), (2, "b", 1)] and rows(store, 1) == []
    put(store, [(3, "x", 1), (4, "y", 1), (4, "y", 1)], insert(["k"]))
    assert rows(store) == [(1, "a", 1), (2, "B", 5), (3, None, None), (4, "y", 1)]
    put(store, [(2, None, 3), (9, "z", 0)], upsert(["k"], lambda o, n: {"v": F.coalesce(n("v"), o("v")), "n": F.greatest(o("n"), n("n"))}))
    assert rows(store) == [(1, "a", 1), (2, "B", 5), (3, None, None), (4, "y", 1), (9, "z", 0)]
    before = store.snapshot().version
    put(store, [])
    assert rows(store)[0] == (1, "a", 1) and store.snapshot().version == before + 1


def test_bad_input(store):
    for bad in ([(None, "a", 1)], [(1, "a", 1), (1, "b", 1)]):
        with pytest.raises(ValidationError):
            put(store, bad)
    with pytest.raises(ValidationError):
        store.create("t", SCHEMA, ["k"], buckets=9)
    with pytest.raises(ValidationError):
        store.create("u", SCHEMA, ["x"])
    with pytest.raises(ValidationError):
        store.read("nothing")
    with pytest.raises(ValidationError):
        store.lookup("t", v="a")
    with pytest.raises(ValidationError):
        store.snapshot(77)
    store.create("t", SCHEMA, ["k"], buckets=8)


def test_untouched_buckets_are_neither_read_nor_written(store):
    put(store, [(i, "a", i) for i in range(100)])
    before = store.snapshot().tables["t"]["dirs"]
    seen = []

    def look(stored, new):
        seen.extend(stored.inputFiles())
        return upsert(["k"])(stored, new)

    put(store, [(5, "b", 0)], look)
    after = store.snapshot().tables["t"]["dirs"]
    moved = [b for b in before if before[b] != after[b]]
    assert len(before) == 8 and len(moved) == 1 and len(rows(store)) == 100
    assert seen and all(f"bucket_={moved[0]}/" in f for f in seen)
    one = store.lookup("t", k=5)
    assert one.collect()[0]["v"] == "b" and all(f"bucket_={moved[0]}/" in f for f in one.inputFiles())
    assert store.lookup("t", k=5000).count() == 0


def test_two_writers_race(store):
    """Ten merges each from two threads, all on one counter row: none is lost."""
    put(store, [(1, "c", 0)])
    add = upsert(["k"], lambda o, n: {"n": o("n") + n("n")})
    failed = []

    def work(name):
        own = Store(store.spark, store.root)
        try:
            for i in range(6):
                own.merge({"t": Merge(changes(store.spark, [(1, name, 1), (100 + i, name, i)]), add)})
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(x,)) for x in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert [r[2] for r in rows(store) if r[0] == 1] == [12]
    assert store.log.numbers() == list(range(1, 15))


def test_disjoint_writers_are_not_done_again(store, monkeypatch):
    put(store, [(i, "a", 0) for i in range(50)])
    done, write = [], Store._write

    def overtaken(self, snap, name, m):
        out = write(self, snap, name, m)
        done.append(snap.version)
        if len(done) == 1:  # another writer commits between data and manifest
            other = next(k for k in range(50) if self.spark.range(1).select(self._bucket(snap.tables["t"], {"k": F.lit(k)}).alias("b")).head()["b"] not in out[0])
            put(Store(self.spark, self.root), [(other, "other", 1)])
        return out

    monkeypatch.setattr(Store, "_write", overtaken)
    put(store, [(0, "mine", 1)])
    assert done == [2, 2]  # this one and the other, once each
    assert [r[1] for r in rows(store) if r[2] == 1].count("mine") == 1 and len([r for r in rows(store) if r[2] == 1]) == 2


def test_a_writer_dies_before_its_manifest(store, monkeypatch):
    put(store, [(1, "a", 1)])
    create = Folder.create

    def dies(self, number, content):
        raise RuntimeError("killed")

    monkeypatch.setattr(Folder, "create", dies)
    with pytest.raises(RuntimeError):
        put(store, [(1, "b", 2), (2, "b", 2)])
    monkeypatch.setattr(Folder, "create", create)
    assert rows(store) == [(1, "a", 1)]
    put(store, [(2, "c", 3)])
    assert rows(store) == [(1, "a", 1), (2, "c", 3)]
    assert store.vacuum() == 1
    put(store, [(2, "d", 3)])
    assert store.vacuum(keep=1) >= 1 and rows(store) == [(1, "a", 1), (2, "d", 3)]


def test_manifests_are_created_once(spark, tmp_path):
    for local in (True, False):
        f = Folder(spark, f"file://{tmp_path}/log{local}")
        f.local = local
        assert f.create(1, {"a": 1}) and not f.create(1, {"a": 2}) and f.read(1) == {"a": 1} and f.numbers() == [1]
        assert not [p for p in (Path(urlparse(str(f.path)).path)).iterdir() if p.suffix == ".tmp"]


def test_epochs_are_applied_once(store):
    add = upsert(["k"], lambda o, n: {"n": o("n") + n("n")})
    for epoch in (0, 0, 1, 0, 1):
        put(store, [(1, "a", 1)], add, epoch=("stream", epoch))
    assert rows(store) == [(1, "a", 2)]


def test_two_tables_change_together(store, monkeypatch):
    store.create("u", SCHEMA, ["k"], buckets=2)
    both = lambda: {"t": Merge(changes(store.spark, [(1, "a", 1)]), upsert(["k"])), "u": Merge(changes(store.spark, [(None, "a", 1)]), upsert(["k"]))}
    with pytest.raises(ValidationError):
        store.merge(both())
    assert rows(store) == []


def test_leases_and_fencing(spark, store):
    now = [100.0]
    clock = lambda: now[0]
    take = lambda who: leases.acquire(spark, store.root, "job", who, 10, clock)
    a = take("a")
    assert a.token == 1 and take("b") is None
    put(store, [(1, "a", 1)], lease=a)
    now[0] = 111.0
    b = take("b")
    assert b.token == 2 and take("a") is None
    with pytest.raises(StoreConflict):
        put(store, [(1, "late", 1)], lease=a)  # before the new holder has written anything
    put(store, [(1, "b", 2)], lease=b)
    with pytest.raises(StoreConflict):
        put(store, [(1, "late", 1)], lease=a)
    assert rows(store) == [(1, "b", 2)]
    assert not leases.release(spark, a) and leases.release(spark, b)
    assert take("c").token == 4
    for bad in ("", "a/b", ".x"):
        with pytest.raises(ValidationError):
            leases.acquire(spark, store.root, bad, "a", 1)


def test_of_two_who_try_at_once_one_gets_the_lease(spark, store):
    got = []
    threads = [threading.Thread(target=lambda i=i: got.append(leases.single_flight(spark, store.root, "t", "gw", "batch-1", f"w{i}", 60))) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len([x for x in got if x]) == 1
    assert leases.single_flight(spark, store.root, "t", "gw", "batch-2", "w", 60) is not None


@pytest.mark.parametrize("identity", [("", "gw", "b"), ("t", " gw", "b"), ("t", "", "b"), ("t", "g" * 129, "b"), ("t", "g\x00", "b"), ("t", "gw", "../b"), (1, "gw", "b"), ("t", None, "b"), ("t", "gw", type("S", (str,), {})("b"))])
def test_identities_are_checked(identity):
    with pytest.raises(ValidationError) as e:
        leases.flight_name(*identity)
    assert not e.value.details
    assert leases.flight_name("a", "bc", "d") != leases.flight_name("ab", "c", "d")


def checkpoint(n):
    return ("result", "f", n, 2 * n, n, f"{n:064x}")


def attempts(spark, data):
    kind = "struct<file_kind: string, file_id: string, file_line_number: bigint, batch_line_count: bigint, record_count: bigint, prefix_sha256: string>"
    rows_ = [("t", "c", "gw", b, i, checkpoint(n), None if e is None else checkpoint(e)) for i, (b, n, e) in enumerate(data)]
    return spark.createDataFrame(rows_, f"tenant_scope string, consumer string, endpoint_alias string, batch_id string, attempt long, checkpoint {kind}, expected_previous {kind}")


def test_stored_checkpoints(spark, store):
    store.create("cp", checkpoints.TABLE, checkpoints.KEYS, buckets=4)
    save = lambda data: [r["outcome"] for r in checkpoints.save(store, "cp", attempts(spark, data)).orderBy("attempt").collect()]
    assert save([("a", 1, None), ("a", 2, 1), ("b", 3, 2)]) == ["inserted", "updated", "expected_previous_missing"]
    assert save([("a", 2, None), ("a", 3, 1), ("a", 1, 2), ("a", 5, 2), ("b", 1, None)]) == ["idempotent", "expected_previous_stale", "checkpoint_regression", "updated", "inserted"]
    assert checkpoints.load(store.read("cp"), "t", "c", "gw", "a")["record_count"] == 5
    assert store.lookup("cp", tenant_scope="t", consumer="c", endpoint_alias="gw", batch_id="b").head()["checkpoint"]["record_count"] == 1


def test_two_savers_expect_the_same(spark, store):
    store.create("cp", checkpoints.TABLE, checkpoints.KEYS, buckets=4)
    checkpoints.save(store, "cp", attempts(spark, [("a", 1, None)]))
    found, failed = [], []

    def work(n):
        try:
            found.extend(r["outcome"] for r in checkpoints.save(Store(spark, store.root), "cp", attempts(spark, [("a", n, 1)])).collect())
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in (2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sorted(found) == ["expected_previous_stale", "updated"]


def test_settings_are_stored_as_they_are_read(spark, store):
    from batchloom.operators import config

    put_ = lambda rows_: config.put(store, spark.createDataFrame(rows_, config.STORED))
    put_([("optimization.auto_split", "OFF"), ("batch_size.min", " 7 "), ("own", "x ")])
    put_([("batch_size.min", "many"), ("optimization.auto_split", "yes")])
    got = dict(map(tuple, store.read("com_config").drop("bucket_").collect()))
    assert got["optimization.auto_split"] == "true" and got["own"] == "x " and got["batch_size.min"].isdigit() and got["batch_size.min"] != "7"
    for bad in ([(None, "x")], [("a", "1"), ("a", "2")]):
        with pytest.raises(ValidationError):
            put_(bad)
