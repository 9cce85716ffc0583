"""Provider observations: normalisation, and the monotone fold into a job's current state."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.strict_json import canonical_metadata
from ..schemas import TERMINAL_STATUSES
from .fold import Row, ordered_fold
from .order import numbered
from .tenancy import visible

KEYS = ["tenant_scope", "endpoint_alias", "remote_batch_id"]
STATE = (
    "tenant_scope string, endpoint_alias string, remote_batch_id string, observation_order long, input_file_id string, batch_endpoint string, batch_status string, "
    "output_file_id string, error_file_id string, total_requests long, total_requests_known boolean, completed_requests long, failed_requests long, "
    "provider_metadata string, first_seen_at timestamp, last_observed_at timestamp, terminal_at timestamp, updated_at timestamp"
)
IDS = ("input_file_id", "batch_endpoint", "output_file_id", "error_file_id")


def _count(c: Column) -> Column:
    """Only whole numbers from 0 on count."""
    n = F.when(c.rlike(r"^[0-9]{1,18}\z"), c.try_cast("long"))
    return n


def normalized(observations: DataFrame) -> DataFrame:
    """Raw observations, counts as text -> clean ones with `errors`, an array of what is wrong (empty if nothing).

    Bad counts are 0, a bad total is unknown, bad optional ids are null, bad metadata is {}.
    """
    total = _count(F.col("total"))
    completed, failed = F.coalesce(_count(F.col("completed")), F.lit(0)), F.coalesce(_count(F.col("failed")), F.lit(0))
    status = checks.known_status(F.col("status"))
    id_or_null = lambda name: F.when(checks.optional_text(F.col(name)).isNotNull(), F.col(name))
    problems = F.filter(
        F.array(
            F.when(~checks.is_scope(F.col("tenant_scope")), "tenant_scope"),
            F.when(checks.clean_alias(F.col("endpoint_alias")).isNull(), "endpoint_alias"),
            F.when(~checks.is_resource_id(F.col("remote_batch_id")), "remote_batch_id"),
            F.when(F.coalesce(F.col("observation_order") <= 0, F.lit(True)), "observation_order"),
            F.when(status.isNull(), "status"),
            F.when(id_or_null("endpoint").isNotNull() & ~checks.is_known_endpoint(F.col("endpoint")), "endpoint"),
            *(F.when(id_or_null(n).isNotNull() & ~checks.is_resource_id(F.col(n)), n) for n in ("input_file_id", "output_file_id", "error_file_id")),
            F.when(completed + failed > total, "counts"),
        ),
        lambda x: x.isNotNull(),
    )
    return observations.select(
        "tenant_scope",
        checks.clean_alias(F.col("endpoint_alias")).alias("endpoint_alias"),
        "remote_batch_id",
        "observation_order",
        "arrival",
        id_or_null("input_file_id").alias("input_file_id"),
        id_or_null("endpoint").alias("batch_endpoint"),
        status.alias("batch_status"),
        id_or_null("output_file_id").alias("output_file_id"),
        id_or_null("error_file_id").alias("error_file_id"),
        F.coalesce(total, F.lit(0)).alias("total_requests"),
        total.isNotNull().alias("total_requests_known"),
        completed.alias("completed_requests"),
        failed.alias("failed_requests"),
        canonical_metadata("metadata").alias("provider_metadata"),
        "observed_at",
        F.when(checks.is_terminal(status), F.col("observed_at")).alias("terminal_at"),
        problems.alias("errors"),
    )


def advance(state: Row | None, seen: Row) -> Row:
    """The state after an observation; an observation that may not be applied leaves it as it is."""
    if state is None:
        new = {k: v for k, v in seen.items() if k not in ("arrival", "observed_at", "errors")}
        return new | {"first_seen_at": seen["observed_at"], "last_observed_at": seen["observed_at"], "updated_at": seen["observed_at"]}
    completed, failed, total = (max(state[n], seen[n]) for n in ("completed_requests", "failed_requests", "total_requests"))
    known = state["total_requests_known"] or seen["total_requests_known"]
    late = seen["observation_order"] <= state["observation_order"]
    reopened = state["batch_status"] in TERMINAL_STATUSES and seen["batch_status"] != state["batch_status"]
    if late or reopened or known and completed + failed > total:
        return state
    return state | {
        **{n: seen[n] if seen[n] is not None else state[n] for n in IDS},
        "observation_order": seen["observation_order"],
        "batch_status": seen["batch_status"],
        "total_requests": total,
        "total_requests_known": known,
        "completed_requests": completed,
        "failed_requests": failed,
        "provider_metadata": state["provider_metadata"] if seen["provider_metadata"] == "{}" else seen["provider_metadata"],
        "last_observed_at": seen["observed_at"],
        "updated_at": seen["observed_at"],
        "terminal_at": state["terminal_at"] or seen["terminal_at"],
    }


def current(clean: DataFrame) -> DataFrame:
    """Normalised observations, folded by job in order of arrival; those with errors are left out."""

    def step(state: Any, row: Row) -> tuple[Any, list[Row]]:
        return advance(state, row), []

    fine = clean.where("size(errors) = 0")
    return ordered_fold(fine, KEYS, ["arrival"], STATE, lambda: None, step, lambda state: [state])


def status_view(state: DataFrame) -> DataFrame:
    """States with progress_percentage and is_complete."""
    p = checks.progress_percentage(F.col("total_requests"), F.col("completed_requests"), F.col("failed_requests"))
    return state.withColumns({"progress_percentage": p, "is_complete": checks.is_terminal(F.col("batch_status"))})


def point(states: DataFrame, tenant: str | None, endpoint_alias: str, remote_batch_id: str) -> DataFrame:
    """A job's state, if the tenant has it."""
    return visible(states, tenant).where((F.col("endpoint_alias") == endpoint_alias) & (F.col("remote_batch_id") == remote_batch_id))


def ordered(observations: DataFrame, reserved: int, by: list[str]) -> DataFrame:
    """Observations of one micro-batch with the next order numbers after those reserved so far, in their order."""
    return numbered(observations, by, "observation_order", reserved + 1).orderBy("observation_order")
