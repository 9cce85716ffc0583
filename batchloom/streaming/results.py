"""Result records applied once: a sink that remembers how far each batch has come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ResultApplicationError

Effect = Callable[[DataFrame], None]
KEYS = ["batch_id", "endpoint_alias"]


class Applier:
    """For foreachBatch: hands each checkpointed record to `effect` once, then saves the new checkpoints.

    Records at or before the stored checkpoint are replays and skipped, if they are the same there; a gap or a
    different record is an error and nothing is applied. `effect` gets new records alone and must itself be
    idempotent for a micro-batch that fails between its end and the save. With same_file, as by default, a stream
    may not go on from its result file to its error file.
    """

    def __init__(self, load: Callable[[], DataFrame], save: Callable[[DataFrame], None], effect: Effect, same_file: bool = True) -> None:
        self.load, self.save, self.effect, self.same_file = load, save, effect, same_file

    def __call__(self, records: DataFrame, epoch: int = 0) -> None:
        stored = self.load()
        s = stored.select(*(F.col(k).alias(f"s_{k}") for k in (*KEYS, "record_count", "prefix_sha256", "file_kind", "file_id")))
        both = records.join(s, (F.col("batch_id") == F.col("s_batch_id")) & (F.col("endpoint_alias") == F.col("s_endpoint_alias")), "left")
        done = F.coalesce("s_record_count", F.lit(0))
        changed = both.where((F.col("record_count") == done) & (F.col("prefix_sha256") != F.col("s_prefix_sha256")))
        new = both.where(F.col("record_count") > done)
        gaps = new.groupBy(*KEYS).agg(F.min("record_count").alias("low"), F.max("record_count").alias("high"), F.count_distinct("record_count").alias("n"), F.max(done).alias("done"))
        gaps = gaps.where("low <> done + 1 OR high - low + 1 <> n")
        if not changed.isEmpty() or not gaps.isEmpty():
            raise ResultApplicationError("records don't continue what is stored")
        if self.same_file and not new.where("s_file_id IS NOT NULL AND (file_kind <> s_file_kind OR file_id <> s_file_id)").isEmpty():
            raise ResultApplicationError("records continue in another file")
        fresh = new.drop(*s.columns)
        if fresh.isEmpty():
            return
        self.effect(fresh)
        w = Window.partitionBy(*KEYS).orderBy(F.desc("record_count"))
        last = fresh.select(*stored.columns).withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")
        self.save(last.unionByName(stored.join(last, KEYS, "left_anti")))
