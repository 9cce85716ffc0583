from __future__ import annotations

import pytest

from batchloom.errors import GatewayError, ReconciliationError
from batchloom.operators import reconcile

SCANNED = "position long, endpoint_alias string, remote_batch_id string"


def test_failures_stay_apart(spark):
    def call(alias, batch):
        if batch == "b1":
            raise GatewayError("https://secret", status=404)
        if batch == "b2":
            raise TimeoutError
        return {"b3": "polled", "b4": "retrieved", "b5": "nonsense", "b6": "deferred"}[batch]

    jobs = spark.createDataFrame([(i, "gw", f"b{i}") for i in range(1, 8)], SCANNED)
    found = reconcile.attempted(jobs, call)
    got = {r.remote_batch_id: (r.outcome, r.failure) for r in found.collect()}
    assert got == {"b1": ("failed", "not_found"), "b2": ("failed", "timeout"), "b3": ("polled", None), "b4": ("retrieved", None), "b5": ("failed", "invalid_response"), "b6": ("deferred", None), "b7": ("failed", "_OTHER")}
    r = reconcile.outcome_list(found).head()
    assert (r.processed, r.retrieved, r.failed) == (7, 1, 4) and [o.remote_batch_id for o in r.outcomes] == [f"b{i}" for i in range(1, 8)]
    assert reconcile.outcome_list(reconcile.attempted(jobs.limit(0), call)).head().processed == 0


@pytest.mark.parametrize("bad", [(" ", "b"), (None, "b"), ("gw", "a/b"), ("gw", None)])
def test_bad_candidates_are_errors(spark, bad):
    rows = spark.createDataFrame([(1, "gw", "b"), (2, *bad)], SCANNED)
    with pytest.raises(ReconciliationError) as e:
        reconcile.unique_prefix(rows)
    assert not e.value.details
