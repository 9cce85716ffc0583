"""Tables with keyed merges, snapshots and atomic commits of several tables at once.

A table's rows lie in buckets by the hash of its keys. A commit is a numbered manifest that names, for each table, the
folder of each bucket; it is published only if no other commit has taken its number, so writers need no lock. A merge
reads the buckets that its changes touch, writes those anew into a folder of its own, and publishes. Where another writer
was first, a merge whose buckets and tables are untouched is published after it as it is; else it is done again on the
new snapshot. A writer that dies before its manifest leaves files that no snapshot names.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from ..errors import StoreConflict, ValidationError
from ..storage import materialize
from .leases import Lease, newest
from .manifests import Folder

#: (stored rows of the touched buckets, changes) -> rows of those buckets.
Rows = Callable[[DataFrame, DataFrame], DataFrame]
BUCKET, COMMIT = "bucket_", "commit_"


@dataclass(frozen=True)
class Merge:
    """Changes of a table and what they make of its rows. Changes need the table's key columns; none of those is null."""

    changes: DataFrame
    rows: Rows


@dataclass
class Snapshot:
    """One commit: its number, its tables, and what it remembers of streams and leases."""

    version: int = 0
    tables: dict[str, dict[str, Any]] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)
    fences: dict[str, int] = field(default_factory=dict)

    def content(self) -> dict:
        return {"tables": self.tables, "applied": self.applied, "fences": self.fences}


class Store:
    """A root folder with `log`, the manifests, and `data`. One object serves one thread at a time; any number may share a root."""

    def __init__(self, spark: SparkSession, root: str, attempts: int = 30) -> None:
        self.spark, self.root, self.attempts = spark, root.rstrip("/"), attempts
        self.log = Folder(spark, f"{self.root}/log")

    # Snapshots

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest commit, or that of a number."""
        found = self.log.numbers()
        if version is None:
            version = found[-1] if found else 0
        elif version and version not in found:
            raise ValidationError("there is no such version", version=version)
        return Snapshot(version, **self.log.read(version)) if version else Snapshot()

    def read(self, name: str, at: Snapshot | int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows, all or those of some buckets, with their bucket; only those buckets' files are listed."""
        snap = at if isinstance(at, Snapshot) else self.snapshot(at)
        table = self._table(snap, name)
        schema = StructType.fromJson(table["schema"])
        dirs = [d for b, d in sorted(table["dirs"].items()) if buckets is None or int(b) in set(buckets)]
        whole = StructType([*schema.fields, *StructType().add(COMMIT, StringType()).add(BUCKET, IntegerType()).fields])
        if not dirs:
            return self.spark.createDataFrame([], whole).drop(COMMIT)
        return self.spark.read.schema(whole).option("basePath", f"{self.root}/data").parquet(*(f"{self.root}/data/{d}" for d in dirs)).drop(COMMIT)

    def lookup(self, name: str, at: Snapshot | int | None = None, /, **keys: Any) -> DataFrame:
        """The rows under one key: a scan of one bucket."""
        snap = at if isinstance(at, Snapshot) else self.snapshot(at)
        table = self._table(snap, name)
        if set(keys) != set(table["keys"]):
            raise ValidationError("every key column needs a value", keys=table["keys"])
        one = self.spark.range(1).select(self._bucket(table, {k: F.lit(v) for k, v in keys.items()}).alias("b")).head()["b"]
        rows = self.read(name, snap, [one])
        return rows.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in keys.items()])).drop(BUCKET)

    def _table(self, snap: Snapshot, name: str) -> dict[str, Any]:
        if name not in snap.tables:
            raise ValidationError("there is no such table", table=name)
        return snap.tables[name]

    @staticmethod
    def _bucket(table: dict[str, Any], columns: dict[str, Column] | None = None) -> Column:
        """The bucket of a row. Keys are hashed in the types that the table has them in."""
        kinds = {f.name: f.dataType for f in StructType.fromJson(table["schema"])}
        values = [(columns or {}).get(k, F.col(k)).cast(kinds[k]) for k in table["keys"]]
        return F.pmod(F.xxhash64(*values), F.lit(table["buckets"])).cast("int")

    # Commits

    def create(self, name: str, schema: str | StructType, keys: list[str], buckets: int = 64) -> None:
        """Make an empty table, unless it is there in the same form already."""
        kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if not keys or not set(keys) <= set(kind.names) or {BUCKET, COMMIT} & set(kind.names):
            raise ValidationError("keys are columns of the table, and no column is called bucket_ or commit_", keys=keys)
        made = {"schema": kind.jsonValue(), "keys": keys, "buckets": buckets, "dirs": {}}
        for _ in range(self.attempts):
            snap = self.snapshot()
            if name in snap.tables:
                if {**snap.tables[name], "dirs": {}} != made:
                    raise ValidationError("the table is there in another form", table=name)
                return
            snap.tables[name] = made
            if self.log.create(snap.version + 1, snap.content()):
                return
        raise StoreConflict("other writers were always first", table=name)

    def merge(self, merges: dict[str, Merge], epoch: tuple[str, int] | None = None, lease: Lease | None = None) -> Snapshot:
        """Merge into one or more tables, all of it or nothing. Returns the snapshot that the merge was made on.

        epoch: the name of a stream and the number of its micro-batch; one that was applied before does nothing. lease:
        the merge is refused once a newer holder has taken the lease.
        """
        merges = {n: Merge(materialize(m.changes, "store-changes"), m.rows) for n, m in merges.items()}
        base, made, touched = None, {}, {}
        for attempt in range(self.attempts):
            snap = self.snapshot()
            if epoch and snap.applied.get(epoch[0], -1) >= epoch[1]:
                return snap
            self._fenced(snap, lease)
            if base is None or any(self._changed(base, snap, n, touched[n]) for n in merges):
                base, made = snap, {}
                for n, m in merges.items():
                    touched[n], made[n] = self._write(snap, n, m)
            new = Snapshot(snap.version + 1, dict(snap.tables), dict(snap.applied), dict(snap.fences))
            for n, dirs in made.items():
                kept = {b: d for b, d in snap.tables[n]["dirs"].items() if int(b) not in touched[n]}
                new.tables[n] = {**snap.tables[n], "dirs": kept | dirs}
            if epoch:
                new.applied[epoch[0]] = epoch[1]
            if lease:
                new.fences[lease.name] = lease.token
                self._fenced(snap, lease)
            if self.log.create(new.version, new.content()):
                return base
            time.sleep(random.random() * 0.05 * (attempt + 1))
        raise StoreConflict("other writers were always first", tables=sorted(merges))

    def _fenced(self, snap: Snapshot, lease: Lease | None) -> None:
        if lease and (snap.fences.get(lease.name, 0) > lease.token or newest(self.spark, lease.root, lease.name) > lease.token):
            raise StoreConflict("the lease has gone to a newer holder", lease=lease.name, token=lease.token)

    @staticmethod
    def _changed(a: Snapshot, b: Snapshot, name: str, buckets: set[int]) -> bool:
        return any(a.tables[name]["dirs"].get(str(k)) != b.tables[name]["dirs"].get(str(k)) for k in buckets)

    def _write(self, snap: Snapshot, name: str, m: Merge) -> tuple[set[int], dict[str, str]]:
        """Write the buckets that changes touch. Returns them, and the folders of those with rows."""
        table = self._table(snap, name)
        keys, columns = table["keys"], StructType.fromJson(table["schema"])
        changes = m.changes.withColumn(BUCKET, self._bucket(table))
        if changes.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).head() is not None:
            raise ValidationError("a key is null", table=name)
        touched = {r[BUCKET] for r in changes.select(BUCKET).distinct().collect()}  # as many as the table has buckets, at most
        if not touched:
            return touched, {}
        rows = m.rows(self.read(name, snap, sorted(touched)).drop(BUCKET), m.changes)
        rows = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in columns)).withColumn(BUCKET, self._bucket(table))
        commit = f"{COMMIT}={uuid.uuid4().hex}"
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/data/{commit}")
        there = [n for n in Folder(self.spark, f"{self.root}/data/{commit}").names() if n.startswith(f"{BUCKET}=")]
        dirs = {n.split("=")[1]: f"{commit}/{n}" for n in there}
        if not set(map(int, dirs)) <= touched:
            raise ValidationError("rows have keys that aren't among the changes' buckets", table=name)
        return touched, dirs

    def vacuum(self, keep: int = 10) -> int:
        """Forget all but the newest commits and delete folders that none of those names. Not while a merge runs: its files aren't named yet."""
        numbers = self.log.numbers()
        kept = numbers[-keep:]
        named = {d.split("/")[0] for v in kept for t in self.log.read(v)["tables"].values() for d in t["dirs"].values()}
        for v in numbers[: len(numbers) - len(kept)]:
            self.log.delete(f"{v:020}.json")
        data = Folder(self.spark, f"{self.root}/data")
        gone = [n for n in data.names() if n.startswith(f"{COMMIT}=") and n not in named]
        for n in gone:
            data.delete(n)
        return len(gone)


def upsert(keys: list[str], both: Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]] | None = None) -> Rows:
    """Changes replace stored rows of the same key, and new ones are added. `both` gives columns of a row that is on both sides, out of old(name) and new(name). Two changes of one key are an error."""

    def rows(stored: DataFrame, changes: DataFrame) -> DataFrame:
        once = changes.groupBy(*keys).agg(F.count("*").alias("n_")).where("n_ > 1")
        if once.head() is not None:
            raise ValidationError("a key is changed twice in one merge", keys=keys)
        o, n = stored.select(F.struct("*").alias("o_")), changes.select(F.struct(*stored.columns).alias("n_"))
        joined = o.join(n, reduce(lambda a, b: a & b, [F.col(f"o_.{k}") == F.col(f"n_.{k}") for k in keys]), "full_outer")
        merged = both(lambda c: F.col(f"o_.{c}"), lambda c: F.col(f"n_.{c}")) if both else {}
        there, fresh = F.col("o_").isNotNull(), F.col("n_").isNotNull()
        return joined.select(*(F.when(there & fresh, merged.get(c, F.col(f"n_.{c}"))).when(fresh, F.col(f"n_.{c}")).otherwise(F.col(f"o_.{c}")).alias(c) for c in stored.columns))

    return rows


def insert(keys: list[str]) -> Rows:
    """Changes whose key is stored already do nothing; of several changes of one key any one is added."""

    def rows(stored: DataFrame, changes: DataFrame) -> DataFrame:
        fresh = changes.select(*stored.columns).dropDuplicates(keys)
        return stored.unionByName(fresh.join(stored.select(*keys), keys, "left_anti").select(*stored.columns))

    return rows


def update(keys: list[str], both: Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]]) -> Rows:
    """Stored rows that a change has the keys of get the columns that `both` gives, out of old(name) and new(name); other changes do nothing. Two changes of one key are an error."""

    def rows(stored: DataFrame, changes: DataFrame) -> DataFrame:
        if changes.groupBy(*keys).agg(F.count("*").alias("n_")).where("n_ > 1").head() is not None:
            raise ValidationError("a key is changed twice in one merge", keys=keys)
        joined = stored.select(F.struct("*").alias("o_")).join(changes.select(F.struct("*").alias("n_")), reduce(lambda a, b: a & b, [F.col(f"o_.{k}") == F.col(f"n_.{k}") for k in keys]), "left")
        new = both(lambda c: F.col(f"o_.{c}"), lambda c: F.col(f"n_.{c}"))
        return joined.select(*(F.when(F.col("n_").isNotNull(), new[c]).otherwise(F.col(f"o_.{c}")).alias(c) if c in new else F.col(f"o_.{c}").alias(c) for c in stored.columns))

    return rows
