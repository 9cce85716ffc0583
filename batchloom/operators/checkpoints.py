"""Compare-and-swap of checkpoints: a fold over attempts in order, alone or onto a stored table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CheckpointConflict
from ..sources.leases import Lease
from ..sources.store import Merge, Store
from ..storage import materialize
from .fold import Row, ordered_fold

KEYS = ["tenant_scope", "consumer", "endpoint_alias", "batch_id"]
FIELDS = ("file_kind", "file_id", "file_line_number", "batch_line_count", "record_count", "prefix_sha256")
OUTCOME = "tenant_scope string, consumer string, endpoint_alias string, batch_id string, attempt long, outcome string, record_count long"


def swap(stored: Row | None, new: Row, expected: Row | None) -> tuple[Row, str]:
    """What is stored after an attempt, and its outcome. A conflict stores nothing."""
    if stored is None:
        return (None, "expected_previous_missing") if expected is not None else (new, "inserted")
    if stored == new:
        return stored, "idempotent"
    if expected != stored:
        return stored, "expected_previous_stale"
    if new["record_count"] <= stored["record_count"] or new["batch_line_count"] <= stored["batch_line_count"]:
        return stored, "checkpoint_regression"
    return new, "updated"


def outcomes(attempts: DataFrame) -> DataFrame:
    """(keys, attempt, checkpoint struct, expected_previous struct or null) -> the outcome of each attempt and what is stored then."""

    def step(stored: Any, row: Row) -> tuple[Any, list[Row]]:
        stored, outcome = swap(stored, row["checkpoint"], row["expected_previous"])
        return stored, [{**row, "outcome": outcome, "record_count": stored["record_count"] if stored else None}]

    return ordered_fold(attempts, KEYS, ["attempt"], OUTCOME, lambda: None, step)


def current(attempts: DataFrame) -> DataFrame:
    """The checkpoint stored for each key after all attempts."""
    schema = "tenant_scope string, consumer string, endpoint_alias string, batch_id string, checkpoint struct<file_kind: string, file_id: string, file_line_number: long, batch_line_count: long, record_count: long, prefix_sha256: string>"

    def step(state: Any, row: Row) -> tuple[Any, list[Row]]:
        stored, _ = swap(state[1] if state else None, row["checkpoint"], row["expected_previous"])
        return ({k: row[k] for k in KEYS}, stored), []

    return ordered_fold(attempts, KEYS, ["attempt"], schema, lambda: None, step, lambda s: [{**s[0], "checkpoint": s[1]}] if s[1] else [])


TABLE = "tenant_scope string, consumer string, endpoint_alias string, batch_id string, checkpoint struct<file_kind: string, file_id: string, file_line_number: bigint, batch_line_count: bigint, record_count: bigint, prefix_sha256: string>"


def _after(stored: DataFrame, attempts: DataFrame) -> DataFrame:
    """What is stored counts as an attempt before all others, which nothing precedes."""
    kept = stored.select(*KEYS, F.lit(None).cast(attempts.schema["attempt"].dataType).alias("attempt"), "checkpoint", F.lit(None).cast(attempts.schema["expected_previous"].dataType).alias("expected_previous"))
    return kept.unionByName(attempts.select(*KEYS, "attempt", "checkpoint", "expected_previous"))


def save(store: Store, name: str, attempts: DataFrame, lease: Lease | None = None) -> DataFrame:
    """Apply attempts to the stored checkpoints of a table and return the outcome of each.

    Attempts of one call are made in their order, on one snapshot; a call that another writer overtakes is made again on
    the new one. So of two writers that expect the same checkpoint one gets expected_previous_stale.
    """
    attempts = materialize(attempts, "checkpoint-attempts")
    base = store.merge({name: Merge(attempts, lambda stored, new: current(_after(stored, new)))}, lease=lease)
    found = outcomes(_after(store.read(name, base), attempts)) if name in base.tables else outcomes(attempts)
    return materialize(found.where("attempt IS NOT NULL"), "checkpoint-outcomes")


def load(stored: DataFrame, tenant: str, consumer: str, endpoint_alias: str, batch_id: str) -> Row | None:
    """The checkpoint under a key. A row that breaks the rules of checkpoints is an error, as are two rows."""
    key = dict(zip(KEYS, (tenant, consumer, endpoint_alias, batch_id), strict=True))
    found = stored
    for k, v in key.items():
        found = found.where(F.col(k) == v)
    rows = found.select("checkpoint.*").limit(2).collect()
    if not rows:
        return None
    c = rows[0].asDict()
    places = [c[n] for n in ("file_line_number", "batch_line_count", "record_count")]
    if len(rows) > 1 or c["file_kind"] not in ("result", "error") or any(p is None or p < 1 for p in places) or c["batch_line_count"] < max(c["file_line_number"], c["record_count"]):
        raise CheckpointConflict("the stored checkpoint is damaged", **key)
    return c
