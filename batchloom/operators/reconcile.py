"""Reconciliation: the candidates seen longest ago, without repeats, and a report of a pass over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ReconciliationError, ValidationError
from ..functions import checks
from ..schemas import MAX_CANDIDATES, MAX_JOBS
from .telemetry import error_name
from .tenancy import visible

#: What a call may say of a job.
OUTCOMES = ("polled", "retrieved", "deferred")


def _bounded(name: str, value: int, most: int) -> int:
    if type(value) is not int or not 1 <= value <= most:
        raise ValidationError(f"{name} must be from 1 to {most}", value=value)
    return value


def candidates(states: DataFrame, tenant: str | None, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """(endpoint_alias, remote_batch_id, last_observed_at) of a tenant, oldest first; finished jobs are among them."""
    _bounded("max_candidates", max_candidates, MAX_CANDIDATES)
    return visible(states, tenant).select("endpoint_alias", "remote_batch_id", "last_observed_at").orderBy("last_observed_at", "endpoint_alias", "remote_batch_id").limit(max_candidates)


def unique_prefix(scanned: DataFrame, max_jobs: int = MAX_JOBS, scan: int = MAX_CANDIDATES) -> DataFrame:
    """(position, alias, id) -> the first max_jobs different jobs of the first `scan` rows.

    If the scan ends before that many were found, and there are more rows, nothing is returned: an error is raised. So it is for
    a candidate without a valid alias or id; the error doesn't repeat them.
    """
    _bounded("max_jobs", max_jobs, MAX_JOBS)
    _bounded("scan", scan, MAX_CANDIDATES)
    head = scanned.select("position", checks.clean_alias(F.col("endpoint_alias")).alias("endpoint_alias"), "remote_batch_id").orderBy("position").limit(scan + 1)
    if head.where(F.col("endpoint_alias").isNull() | ~checks.is_resource_id(F.col("remote_batch_id"))).head() is not None:
        raise ReconciliationError("a candidate is not valid")
    w = Window.orderBy("position")  # of scan + 1 rows at most
    numbered = head.withColumn("n_", F.row_number().over(w))
    first = numbered.where(F.col("n_") <= scan).withColumn("again_", F.row_number().over(Window.partitionBy("endpoint_alias", "remote_batch_id").orderBy("position"))).where("again_ = 1")
    out = first.orderBy("position").limit(max_jobs).select("position", "endpoint_alias", "remote_batch_id")
    if numbered.where(F.col("n_") > scan).head() is not None and out.count() < max_jobs:
        raise ReconciliationError("too many repeated candidates", scanned=scan)
    return out


def outcomes(chosen: DataFrame, states: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Each chosen job as polled (not finished), retrieved (finished, with a file read), deferred (finished, none) or failed (unknown)."""
    keys = ["endpoint_alias", "remote_batch_id"]
    s = states.select(*keys, F.col("batch_status").alias("status_"))
    r = retrieved.select(*keys).distinct().withColumn("read_", F.lit(True))
    kind = F.when(F.col("status_").isNull(), "failed").when(~checks.is_terminal(F.col("status_")), "polled").when(F.col("read_"), "retrieved").otherwise("deferred")
    return chosen.join(s, keys, "left").join(r, keys, "left").select(*chosen.columns, kind.alias("outcome"))


Call = Callable[[str, str], str]


def attempted(chosen: DataFrame, call: Call, tasks: int = 8) -> DataFrame:
    """(position, endpoint_alias, remote_batch_id) -> the same, `outcome` and `failure`: one call for each job, apart from all others.

    call(alias, id) says polled, retrieved or deferred. What it raises makes that job failed, under a fixed name; other jobs go
    on. Jobs are few (unique_prefix) and dealt over tasks, as calls wait for a provider. A repeated task repeats its calls.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for r in d.itertuples(index=False):
                try:
                    said, failure = call(r.endpoint_alias, r.remote_batch_id), None
                    said, failure = (said, None) if said in OUTCOMES else ("failed", "invalid_response")
                except Exception as e:  # noqa: BLE001
                    said, failure = "failed", error_name(e)
                out.append((r.position, r.endpoint_alias, r.remote_batch_id, said, failure))
            yield pd.DataFrame(out, columns=["position", "endpoint_alias", "remote_batch_id", "outcome", "failure"])

    slim = chosen.select(F.col("position").cast("long").alias("position"), "endpoint_alias", "remote_batch_id")
    return slim.repartition(tasks, "position").mapInPandas(run, "position long, endpoint_alias string, remote_batch_id string, outcome string, failure string")


def outcome_list(found: DataFrame) -> DataFrame:
    """One row: the report, and each job's outcome in order. Jobs are few."""
    item = F.struct("position", "endpoint_alias", "remote_batch_id", "outcome")
    return found.agg(F.count("*").alias("processed"), F.count_if(F.col("outcome") == "retrieved").alias("retrieved"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.sort_array(F.collect_list(item)).alias("outcomes"))


def report(found: DataFrame) -> DataFrame:
    """One row: how many were processed, retrieved, failed."""
    return found.agg(F.count("*").alias("processed"), F.count_if(F.col("outcome") == "retrieved").alias("retrieved"), F.count_if(F.col("outcome") == "failed").alias("failed"))


def single_flight(claims: DataFrame) -> DataFrame:
    """(claim_order, worker, tenant_scope, endpoint_alias, remote_batch_id) -> the first claimer of each job holds it."""
    key = checks.flight_key(b"batchloom single flight v1", F.col("tenant_scope"), F.col("endpoint_alias"), F.col("remote_batch_id"))
    w = Window.partitionBy("tenant_scope", "endpoint_alias", "remote_batch_id").orderBy("claim_order", "worker")
    return claims.select("*", key.alias("flight_key"), (F.row_number().over(w) == 1).alias("holds"))
