"""Counts and durations of operations, as histograms that add up.

A histogram has eight buckets for each doubling, so a value is known to an eighth of itself, whatever its size, and a key
has some hundred buckets at most. Buckets of parts are added to give those of the whole. Nothing but an operation, an
outcome and the name of a known failure is kept: no identifiers, addresses, texts or messages.
"""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from ..errors import EngineError, ValidationError
from ..functions.checks import failure_name

KEYS = ["operation", "outcome", "error_type"]
HISTOGRAM = "operation string, outcome string, error_type string, bucket int, n long, total long, low long, high long"
OUTCOMES = ("success", "failure")


def bucket(value: int) -> int:
    """The bucket of a whole number from 0 on."""
    e = value.bit_length() - 4
    return value if e < 0 else 8 * e + (value >> e)


def floor_of(bucket_: Column) -> Column:
    """The smallest value of a bucket."""
    e = F.greatest(F.floor(bucket_ / 8) - 1, F.lit(0)).cast("int")
    return F.when(bucket_ < 8, bucket_.cast("long")).otherwise(F.call_function("shiftleft", (bucket_ % 8 + 8).cast("long"), e))


def bucket_of(value: Column) -> Column:
    e = F.length(F.bin(value)) - 4
    return F.when(value < 8, value).otherwise(8 * e + F.call_function("shiftright", value, e)).cast("int")


def histogram(calls: DataFrame) -> DataFrame:
    """(operation, outcome, error_type, micros) -> HISTOGRAM, a row for each key and bucket with a call.

    A null duration, or one below 0, counts as 0. An outcome that isn't known is an error; an error_type that isn't is
    _OTHER, and a success has none.
    """
    known = F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise(F.raise_error(F.lit("an outcome is success or failure")))
    micros = F.greatest(F.coalesce(F.col("micros").cast("long"), F.lit(0)), F.lit(0))
    rows = calls.select("operation", known.alias("outcome"), F.when(F.col("outcome") == "failure", F.coalesce(failure_name(F.col("error_type")), F.lit("_OTHER"))).alias("error_type"), micros.alias("micros"))
    return rows.groupBy(*KEYS, bucket_of(F.col("micros")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("micros").alias("total"), F.min("micros").alias("low"), F.max("micros").alias("high"))


def merged(*parts: DataFrame) -> DataFrame:
    """Histograms added up."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*KEYS, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def summary(h: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    """A row for each key: calls, total_micros, low, high, and p50, p99 ...: the smallest value of the bucket that the quantile's call lies in."""
    if not all(0 < q <= 1 for q in quantiles):
        raise ValidationError("a quantile lies above 0 and not above 1", quantiles=quantiles)
    w = Window.partitionBy(*KEYS)
    reached, calls = F.sum("n").over(w.orderBy("bucket")), F.sum("n").over(w)
    rows = h.withColumns({"reached": reached, "calls": calls, "value": F.greatest(floor_of(F.col("bucket")), F.col("low"))})
    named = {q: f"p{100 * q:g}".replace(".", "_") for q in quantiles}
    return rows.groupBy(*KEYS).agg(
        F.sum("n").alias("calls"), F.sum("total").alias("total_micros"), F.min("low").alias("low"), F.max("high").alias("high"),
        *(F.min(F.when(F.col("reached") >= F.ceil(F.lit(q) * F.col("calls")), F.col("value"))).alias(name) for q, name in named.items()),
    )


class Recorder:
    """Histograms of this process's operations. An exporter that fails never changes an operation's result or error.

    export: called with (operation, outcome, error_type, micros) after each operation, for a tracer or a meter.
    """

    def __init__(self, export: Callable[[str, str, str | None, int], None] | None = None, clock: Callable[[], float] = time.perf_counter) -> None:
        self.export, self.clock = export, clock
        self.held: dict[tuple[str, str, str | None, int], list[int]] = {}
        self.depth = 0

    def add(self, operation: str, outcome: str, error_type: str | None, micros: int) -> None:
        micros = max(0, micros)
        h = self.held.setdefault((operation, outcome, error_type, bucket(micros)), [0, 0, micros, micros])
        h[:] = [h[0] + 1, h[1] + micros, min(h[2], micros), max(h[3], micros)]
        if self.export:
            with contextlib.suppress(Exception):
                self.export(operation, outcome, error_type, micros)

    @contextlib.contextmanager
    def observed(self, operation: str) -> Iterator[None]:
        """One operation; those inside it aren't counted by themselves. Failures are named by the package's codes."""
        began, self.depth = self.clock(), self.depth + 1
        outcome, error = "success", None
        try:
            yield
        except BaseException as e:
            outcome, error = "failure", error_name(e)
            raise
        finally:
            self.depth -= 1
            if not self.depth:
                self.add(operation, outcome, error, round(1e6 * (self.clock() - began)))

    def frame(self, spark: SparkSession) -> DataFrame:
        """What is held, as HISTOGRAM."""
        return spark.createDataFrame([(*k, *h) for k, h in sorted(self.held.items(), key=str)], HISTOGRAM)


def error_name(error: BaseException) -> str:
    """A fixed name; nothing of the error itself."""
    if isinstance(error, TimeoutError):
        return "timeout"
    if isinstance(error, ConnectionError):
        return "connection"
    status = error.details.get("status") if isinstance(error, EngineError) else None
    by_status = {401: "unauthorized", 403: "unauthorized", 404: "not_found", 409: "conflict", 429: "rate_limited"}
    return by_status.get(status, "_OTHER") if isinstance(status, int) else "_OTHER"


class StreamRecorder(StreamingQueryListener):
    """Micro-batches and ends of streaming queries, for spark.streams.addListener. Queries are told apart by nothing but the operation's name."""

    def __init__(self, recorder: Recorder, operation: str = "micro_batch") -> None:
        self.recorder, self.operation = recorder, operation

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        return None

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        if event.progress.numInputRows:
            self.recorder.add(self.operation, "success", None, 1000 * int(event.progress.batchDuration))

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        return None

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        failed = event.exception is not None
        self.recorder.add("query", "failure" if failed else "success", "_OTHER" if failed else None, 0)
