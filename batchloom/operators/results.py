"""Result and error files as records: framing, budgets, prefix checkpoints, resumption, import."""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CheckpointConflict, ValidationError
from ..functions.strict_json import is_lenient_object, is_strict_object
from ..schemas import exact_positive
from ..sources.store import Merge, update
from .fold import Row, ordered_fold

KINDS = ("result", "error")
CHECKPOINT = "batch_id string, endpoint_alias string, file_kind string, file_id string, schema_version int, file_line_number long, batch_line_count long, record_count long, prefix_sha256 string"
DOMAIN = b"batchloom result stream v1"


def physical_lines(files: DataFrame) -> DataFrame:
    """(batch_id, file_kind, file_id, content) -> a row per line, blank ones too; the last may lack its newline.

    Lines part at \\n alone and keep a \\r. Result files come before error files; batch_line_count runs over both.
    """
    body = F.regexp_replace("content", "\n\\z", "")
    ended = F.endswith("content", F.lit("\n"))
    rank = F.when(F.col("file_kind") == "result", 0).otherwise(1)
    out = files.where("content <> ''").select("batch_id", "file_kind", "file_id", rank.alias("kind_rank"), ended.alias("ended_"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "raw"), F.size(F.split(body, "\n", -1)).alias("n_"))
    per_file = files.where("content <> ''").select(F.col("batch_id").alias("b_"), rank.alias("k_"), F.size(F.split(body, "\n", -1)).alias("n")).groupBy("b_", "k_").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("b_").orderBy("k_").rowsBetween(Window.unboundedPreceding, -1)
    before = per_file.select("b_", "k_", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    joined = out.join(before, (F.col("batch_id") == F.col("b_")) & (F.col("kind_rank") == F.col("k_")))
    number = (F.col("pos") + 1).cast("long")
    return joined.select("batch_id", "file_kind", "file_id", "kind_rank", number.alias("file_line_number"), (F.col("before") + number).alias("batch_line_count"), "raw", (F.col("ended_") | (F.col("pos") + 1 < F.col("n_"))).alias("newline_terminated"))


def records(files: DataFrame) -> DataFrame:
    """Non-blank lines, one \\r at the end removed, numbered through the batch; `is_object` by the strict rules."""
    line = F.regexp_replace("raw", "\r\\z", "")
    some = physical_lines(files).withColumn("record", line).where(F.regexp_replace("record", r"[ \t\n\r\x0b\f]", "") != "")
    w = Window.partitionBy("batch_id").orderBy("batch_line_count")
    return some.withColumn("record_count", F.row_number().over(w).cast("long")).withColumn("is_object", is_strict_object("record")).drop("raw")


def lenient_records(files: DataFrame) -> DataFrame:
    """The whole file is stripped first, empty lines are skipped, repeated names and NaN pass."""
    body = F.regexp_replace("content", r"^[ \t\n\r\x0b\f]+|[ \t\n\r\x0b\f]+\z", "")
    out = files.select("batch_id", "file_kind", "file_id", F.posexplode(F.split(body, "\n", -1)).alias("pos", "line")).where("line <> ''")
    return out.select("batch_id", "file_kind", "file_id", (F.col("pos") + 1).cast("long").alias("line_number"), F.col("line").alias("record"), is_lenient_object("line").alias("is_object"))


def over_budget(files: DataFrame, file_bytes: int = 128 << 20, line_bytes: int = 1 << 20, batch_lines: int = 100_000, batch_records: int = 100_000) -> DataFrame:
    """A row for each budget that a batch breaks, with the first line that breaks it (0 for a whole file)."""
    for name, value in (("file_bytes", file_bytes), ("line_bytes", line_bytes), ("batch_lines", batch_lines), ("batch_records", batch_records)):
        exact_positive(name, value)
    large = files.where(F.octet_length("content") > file_bytes).select("batch_id", F.lit("file_bytes").alias("budget"), F.lit(0).cast("long").alias("at_line"))
    lines = physical_lines(files)
    long_ = lines.where(F.octet_length("raw") > line_bytes).select("batch_id", F.lit("line_bytes").alias("budget"), F.col("batch_line_count").alias("at_line"))
    many = lines.where(F.col("batch_line_count") > batch_lines).select("batch_id", F.lit("batch_lines").alias("budget"), F.col("batch_line_count").alias("at_line"))
    often = records(files).where(F.col("record_count") > batch_records).select("batch_id", F.lit("batch_records").alias("budget"), F.col("batch_line_count").alias("at_line"))
    return large.unionByName(long_).unionByName(many).unionByName(often).groupBy("batch_id", "budget").agg(F.min("at_line").alias("at_line"))


def _frame(tag: bytes, payload: bytes) -> bytes:
    return len(tag).to_bytes(2, "big") + tag + len(payload).to_bytes(8, "big") + payload


def checkpoints(files: DataFrame, endpoint_alias: str, domain: bytes = DOMAIN) -> DataFrame:
    """A checkpoint for each record: its place, and a digest of everything up to it, framed without ambiguity.

    One running digest a batch, over lines in order: linear, and in constant memory.
    """

    def step(state: Any, row: Row) -> tuple[Any, list[Row]]:
        digest, file, count = state or (hashlib.sha256(_frame(b"domain", domain) + _frame(b"batch_id", row["batch_id"].encode()) + _frame(b"endpoint_alias", endpoint_alias.encode())), None, 0)
        if file != row["file_kind"]:
            digest.update(_frame(b"file_kind", row["file_kind"].encode()) + _frame(b"file_id", row["file_id"].encode()))
        digest.update(_frame(b"file_line_number", row["file_line_number"].to_bytes(8, "big")) + _frame(b"line_bytes", row["raw"].encode()) + _frame(b"newline_terminated", b"\x01" if row["newline_terminated"] else b"\x00"))
        out = []
        if row["raw"].strip(" \t\n\r\x0b\f"):
            count += 1
            out = [{**row, "endpoint_alias": endpoint_alias, "schema_version": 1, "record_count": count, "prefix_sha256": digest.copy().hexdigest()}]
        return (digest, row["file_kind"], count), out

    return ordered_fold(physical_lines(files), ["batch_id"], ["batch_line_count"], CHECKPOINT, lambda: None, step)


def resume_after(found: DataFrame, checkpoint: Row) -> DataFrame:
    """Checkpointed records after a checkpoint, which must be found again exactly."""
    own = found.where(F.col("batch_id") == checkpoint["batch_id"])
    same = own.where(F.col("record_count") == checkpoint["record_count"]).head()
    if same is None:
        raise CheckpointConflict("checkpoint not found", reason="not_found")
    if any(same[k] != v for k, v in checkpoint.items()):
        raise CheckpointConflict("checkpoint mismatch", reason="mismatch")
    return own.where(F.col("record_count") > checkpoint["record_count"])


def valid_checkpoint(c: DataFrame) -> DataFrame:
    """Checkpoints with `is_valid`."""
    ok = (
        (F.col("schema_version") == 1) & F.col("file_kind").isin(*KINDS) & F.col("batch_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,255}\z") & F.col("file_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,255}\z")
        & (F.col("file_line_number") > 0) & (F.col("record_count") > 0) & (F.col("batch_line_count") >= F.col("file_line_number")) & (F.col("batch_line_count") >= F.col("record_count"))
        & F.col("prefix_sha256").rlike(r"^[0-9a-f]{64}\z")
    )
    return c.withColumn("is_valid", F.coalesce(ok, F.lit(False)))


def summary(found: DataFrame) -> DataFrame:
    """Responses and errors of each batch."""
    r, e = F.count_if(F.col("file_kind") == "result"), F.count_if(F.col("file_kind") == "error")
    return found.groupBy("batch_id").agg(r.alias("response_count"), e.alias("error_count"), (e > 0).alias("has_errors"), (e == 0).alias("batch_succeeded"))


def imported(found: DataFrame) -> DataFrame:
    """Content and token use out of result records, by custom_id."""
    at = lambda path: F.get_json_object("record", path)
    return found.where("file_kind = 'result'").select(
        "batch_id",
        at("$.custom_id").alias("custom_id"),
        at("$.response.body.choices[0].message.content").alias("response_content"),
        *(F.coalesce(at(f"$.response.body.usage.{n}").try_cast("int"), F.lit(0)).alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")),
    )


REQUESTS = "request_uuid string, request_status string, response_content string, prompt_tokens int, completion_tokens int, total_tokens int"


def import_merge(found: DataFrame) -> Merge:
    """Imported results as an update of stored requests: what a result lacks stays as it is, a request that isn't stored is not made.

    A custom_id that comes twice in the results counts once, with the larger content.
    """
    counts = ("prompt_tokens", "completion_tokens", "total_tokens")
    once = found.where("custom_id IS NOT NULL").groupBy(F.col("custom_id").alias("request_uuid")).agg(F.max("response_content").alias("response_content"), *(F.max(n).alias(n) for n in counts))
    return Merge(once, update(["request_uuid"], lambda o, n: {"request_status": F.lit("completed"), **{c: F.coalesce(n(c), o(c)) for c in ("response_content", *counts)}}))


def require_complete(status: str, files: int) -> None:
    """Files are read of finished batches alone, and of those that have any."""
    if status not in ("completed", "failed", "expired", "cancelled"):
        raise ValidationError("the batch isn't finished", status=status)
    if files < 1:
        raise ValidationError("the batch has no file")
