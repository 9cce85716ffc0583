"""Order-preserving packing of requests into parts under token, byte and record limits.

Within a batch a new part begins where the model changes and where one more request would break a limit. Runs of
one model start empty; a long run is cut in blocks whose maps from entry to exit are composed (cuts.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TokenLimitExceeded, ValidationError
from ..functions.render import line_bytes, request_line
from ..functions.tokens import Tokenizer, Tokenizers, request_tokens, whitespace_tokens
from ..storage import bounded, materialize
from .cuts import BLOCK as ROWS
from .cuts import Most, assigned

ORDER = ["created_at", "request_uuid"]
#: Requests aimed at in a span of a batch.
BLOCK = 100_000
#: Models that may be broadcast; with more, requests are shuffled to them.
MODELS = 100_000


def queued(requests: DataFrame) -> DataFrame:
    """Requests that wait and belong to no file yet."""
    return requests.where("request_status = 'queued' AND batch_file_uuid IS NULL")


def has_unassigned(requests: DataFrame) -> DataFrame:
    """(batch_uuid, has_unassigned): whether any request of a batch still waits for a file."""
    waits = F.coalesce((F.col("request_status") == "queued") & F.col("batch_file_uuid").isNull(), F.lit(False))
    return requests.groupBy("batch_uuid").agg(F.bool_or(waits).alias("has_unassigned"))


def with_model(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Requests with their model's mode and tokenizer: the row verified last (null last); none leaves both null."""
    w = Window.partitionBy("model_id").orderBy(F.desc_nulls_last("last_verified_at"), F.col("endpoint_uuid"))
    mode = F.lower(F.trim("model_mode"))
    latest = models.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").select(F.col("model_id").alias("model_"), F.when(mode != "", mode).alias("model_mode"), "tokenizer_model")
    return requests.join(bounded(latest, MODELS), F.col("model_name") == F.col("model_"), "left").drop("model_")


def measured(requests: DataFrame, tokenizer: Tokenizer | Tokenizers = whitespace_tokens) -> DataFrame:
    """Requests with their line, tokens and bytes. An embedding has no system prompt.

    With Tokenizers each request is counted by its model's: tokenizer_model, else model_name; an unknown one is an error.
    """
    if isinstance(tokenizer, Tokenizers):
        known = tokenizer
        tokenizer = lambda text: known.by_model(text, F.col("tokenizer_model"), F.col("model_name"))
    system = F.when(F.coalesce(F.lower(F.trim("model_mode")) == "embedding", F.lit(False)), "").otherwise(F.coalesce("system_prompt", F.lit("")))
    line = request_line(F.col("request_uuid"), F.col("model_name"), F.col("model_mode"), system, F.col("user_prompt"))
    out = requests.withColumns({**request_tokens(system, F.coalesce("user_prompt", F.lit("")), tokenizer), "line": line})
    return out.withColumn("byte_size", line_bytes(F.col("line")))


def oversize(requests: DataFrame, max_tokens: int, max_bytes: int) -> DataFrame:
    """Requests that no part can hold, and why."""
    why = F.when(F.col("total_tokens") > max_tokens, "TOKEN_LIMIT_EXCEEDED").when(F.col("byte_size") > max_bytes, "VALIDATION_ERROR")
    return requests.withColumn("reason", why).where("reason IS NOT NULL")


def runs(requests: DataFrame, batch: str = "batch_uuid", by_model: bool = True, block: int = BLOCK) -> DataFrame:
    """run_index: how often the model has changed before, in the batch's order.

    A batch of more than `block` requests is cut into spans of time that have about as many each. Changes are
    counted inside spans and between neighbouring spans, so no task has to see a whole batch.
    """
    if not by_model:
        return requests.withColumn("run_index", F.lit(0).cast("long"))
    at = F.unix_micros("created_at")
    spans = requests.groupBy(F.col(batch).alias("b_")).agg(F.min(at).alias("low_"), F.max(at).alias("high_"), F.count("*").alias("n_"))
    width = F.greatest(F.lit(1.0), (F.col("high_") - F.col("low_")) / F.ceil(F.col("n_") / block))
    spans = spans.select("b_", "low_", width.alias("width_"))
    rows = requests.join(spans, F.col(batch).eqNullSafe(F.col("b_"))).withColumn("span_", F.floor((at - F.col("low_")) / F.col("width_"))).drop("b_", "low_", "width_")

    w = Window.partitionBy(batch, "span_").orderBy(*ORDER)
    changed = (~F.col("model_name").eqNullSafe(F.lag("model_name").over(w)) & (F.row_number().over(w) > 1)).cast("long")
    rows = rows.withColumn("changed_", changed)
    place = F.struct("created_at", "request_uuid")
    ends = rows.groupBy(F.col(batch).alias("b_"), F.col("span_").alias("s_")).agg(F.min_by(F.struct("model_name"), place).alias("first_"), F.max_by(F.struct("model_name"), place).alias("last_"), F.sum("changed_").alias("inside_"))
    order = Window.partitionBy("b_").orderBy("s_")
    cut = (~F.col("first_").eqNullSafe(F.lag("last_").over(order)) & (F.row_number().over(order) > 1)).cast("long")
    ends = ends.withColumn("cut_", cut)
    before = F.sum("cut_").over(order) + F.coalesce(F.sum("inside_").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("b_", "s_", before.alias("before_"))
    numbered = rows.join(ends, F.col(batch).eqNullSafe(F.col("b_")) & (F.col("span_") == F.col("s_")))
    inside = F.sum("changed_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return numbered.withColumn("run_index", F.col("before_") + inside).drop("b_", "s_", "span_", "changed_", "before_")


def pack(requests: DataFrame, max_tokens: int, max_bytes: int | None = None, max_records: int | None = None, batch: str = "batch_uuid", by_model: bool = True, on_oversize: str = "error", block: int = ROWS) -> DataFrame:
    """Measured requests -> (batch, request_uuid, model_name, part_index, position, total_tokens, byte_size).

    A request above a limit on its own raises, or is left out if on_oversize is "quarantine". A run is cut in blocks of
    rows side by side, however long it is.
    """
    if on_oversize not in ("error", "quarantine"):
        raise ValidationError("on_oversize is error or quarantine", value=on_oversize)
    most_bytes, most_records = max_bytes or (1 << 62), max_records or (1 << 62)
    large = (F.col("total_tokens") > max_tokens) | (F.col("byte_size") > most_bytes)
    slim = requests.select(F.col(batch).alias("batch_uuid"), "request_uuid", "model_name", "created_at", "total_tokens", "byte_size")
    slim = materialize(slim, "requests")  # texts are read and counted once
    if on_oversize == "quarantine":
        slim = slim.where(~large)
    elif (bad := slim.where(large).select("request_uuid", "total_tokens").head()) is not None:
        raise TokenLimitExceeded("a request is larger than any part", request=bad[0], tokens=bad[1])

    return assigned(slim, Most(max_tokens, most_bytes, most_records), by_model, block)


def parts(assigned_: DataFrame, max_files: int | None = None) -> DataFrame:
    """A row per part: its model, totals, and whether it is ready or overflows the job."""
    out = assigned_.groupBy("batch_uuid", "part_index").agg(F.first("model_name").alias("model_name"), F.count("*").alias("record_count"), F.sum("total_tokens").alias("total_tokens"), F.sum("byte_size").alias("byte_size"))
    return out.withColumn("state", F.when(F.lit(max_files is None) | (F.col("part_index") < F.lit(max_files or 0)), "ready").otherwise("overflow"))


def batch_totals(parts_: DataFrame) -> DataFrame:
    """Requests and tokens of each batch, ready and overflow together."""
    return parts_.groupBy("batch_uuid").agg(F.sum("record_count").alias("total_requests"), F.sum("total_tokens").alias("total_tokens"), F.count_if(F.col("state") == "ready").alias("ready_files"), F.count_if(F.col("state") == "overflow").alias("overflow_files"))


def token_stats(requests: DataFrame, batch: str = "batch_uuid") -> DataFrame:
    """Token sums, count, average and extremes of each batch."""
    t = F.col("total_tokens")
    return requests.groupBy(F.col(batch).alias("batch_uuid")).agg(
        F.sum(t).alias("total_tokens"), F.sum("system_tokens").alias("system_tokens"), F.sum("user_tokens").alias("user_tokens"), F.count("*").alias("request_count"), F.avg(t).alias("avg_tokens"), F.max(t).alias("max_tokens"), F.min(t).alias("min_tokens")
    )


def enforce_batch_limit(stats: DataFrame, limit: int) -> DataFrame:
    """stats, or TokenLimitExceeded if a batch is above the limit."""
    if (bad := stats.where(F.col("total_tokens") > limit).head()) is not None:
        raise TokenLimitExceeded("a batch is above its token limit", batch=bad["batch_uuid"], tokens=bad["total_tokens"])
    return stats


