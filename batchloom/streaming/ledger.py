"""Result records applied exactly once: effects and progress are published by one manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ResultApplicationError, ValidationError
from ..functions.checks import SCOPE
from ..operators.results import valid_checkpoint
from ..sources.leases import Lease
from ..sources.store import Merge, Store

PROGRESS = "tenant_scope string, consumer string, endpoint_alias string, batch_id string, file_kind string, file_id string, file_line_number long, batch_line_count long, record_count long, prefix_sha256 string"
KEYS = ["tenant_scope", "consumer", "endpoint_alias", "batch_id"]
#: New records -> what they change, by table.
Effect = Callable[[DataFrame], dict[str, Merge]]


class Ledger:
    """For foreachBatch: each checkpointed record of a batch has its effect once for each tenant and consumer.

    A micro-batch is one commit of the store: the tables that `effect` changes and how far each batch has come. A micro-batch
    that fails anywhere leaves nothing; run again, it is applied whole, or skipped if its commit was made. Records at or before
    the stored progress are replays and skipped, if they are the same there; a gap, another record, another file (with
    same_file) or a malformed record is an error and nothing is applied. Extra columns of records reach `effect`.
    """

    def __init__(self, store: Store, tenant: str, consumer: str, effect: Effect, table: str = "result_progress", same_file: bool = True, buckets: int = 64) -> None:
        scope = store.spark.range(1).select(*(F.lit(v).rlike(SCOPE).alias(n) for n, v in (("t", tenant), ("c", consumer)))).head()
        if not scope["t"] or not scope["c"]:
            raise ValidationError("tenant and consumer are names")
        self.store, self.tenant, self.consumer, self.effect, self.table, self.same_file = store, tenant, consumer, effect, table, same_file
        store.create(table, PROGRESS, KEYS, buckets)

    def __call__(self, records: DataFrame, epoch: int | None = None, lease: Lease | None = None) -> None:
        own = valid_checkpoint(records).withColumns({"tenant_scope": F.lit(self.tenant), "consumer": F.lit(self.consumer)})
        if own.where("NOT is_valid OR endpoint_alias IS NULL OR endpoint_alias = ''").head() is not None:
            raise ResultApplicationError("a record has no valid place")
        own = own.drop("is_valid")
        names = [c.split(" ")[0] for c in PROGRESS.split(", ")]
        w = Window.partitionBy(*KEYS).orderBy(F.desc("record_count"))
        last = own.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").select(*names)
        if last.head() is None:
            return
        snap = self.store.snapshot()
        fresh = self._fresh(self._stored(snap, own), own).drop("tenant_scope", "consumer")
        merges = self.effect(fresh)
        if self.table in merges:
            raise ValidationError("progress is the ledger's own", table=self.table)
        stream = None if epoch is None else (f"{self.table}/{self.tenant}/{self.consumer}", epoch)
        version = snap.version

        def advance(stored: DataFrame, changes: DataFrame) -> DataFrame:
            """The further one of both; progress that another writer has made since then is an error."""
            o, n = stored.select(F.struct(*names).alias("o")), changes.select(F.struct(*names).alias("n"))
            seen = self._stored(version, own).select(*KEYS, "record_count")
            moved = stored.join(changes.select(*KEYS), KEYS, "left_semi").select(*KEYS, "record_count").exceptAll(seen)
            if moved.head() is not None:
                raise ResultApplicationError("another writer has applied records of the batch meanwhile")
            same = F.lit(True)
            for k in KEYS:
                same = same & (F.col(f"o.{k}") == F.col(f"n.{k}"))
            both = o.join(n, same, "full_outer")
            further = F.when(F.col("o").isNull() | (F.col("n.record_count") > F.col("o.record_count")), F.col("n")).otherwise(F.col("o"))
            return both.select(F.when(F.col("n").isNull(), F.col("o")).otherwise(further).alias("x")).select("x.*")

        self.store.merge({**merges, self.table: Merge(last, advance)}, epoch=stream, lease=lease)

    def _stored(self, at: object, own: DataFrame) -> DataFrame:
        """Progress of this consumer's batches among the records; of buckets without any, nothing is read."""
        snap = at if not isinstance(at, int) else self.store.snapshot(at)
        bucket = self.store._bucket(snap.tables[self.table])
        buckets = [r["b"] for r in own.select(bucket.alias("b")).distinct().collect()]
        return self.store.read(self.table, snap, buckets).drop("bucket_").where((F.col("tenant_scope") == self.tenant) & (F.col("consumer") == self.consumer))

    def _fresh(self, stored: DataFrame, own: DataFrame) -> DataFrame:
        s = stored.select(F.struct("*").alias("s_"))
        both = own.join(s, (own["batch_id"] == F.col("s_.batch_id")) & (own["endpoint_alias"] == F.col("s_.endpoint_alias")), "left")
        done = F.coalesce("s_.record_count", F.lit(0))
        changed = both.where((F.col("record_count") == done) & (F.col("prefix_sha256") != F.col("s_.prefix_sha256")))
        new = both.where(F.col("record_count") > done)
        span = new.groupBy("batch_id", "endpoint_alias").agg(F.min("record_count").alias("low"), F.max("record_count").alias("high"), F.count("*").alias("n"), F.max(done).alias("done"))
        if changed.head() is not None or span.where("low <> done + 1 OR high - low + 1 <> n").head() is not None:
            raise ResultApplicationError("records don't continue what is stored")
        if self.same_file and new.where("s_ IS NOT NULL AND (file_kind <> s_.file_kind OR file_id <> s_.file_id)").head() is not None:
            raise ResultApplicationError("records continue in another file")
        return new.drop("s_")
