"""Inputs of the engine derived from the test tables, each a rule over its keys."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.render import json_text
from ..functions.tokens import whitespace_tokens
from ..sources import digests
from ..storage import materialize, shared_dir

EPOCH = 1_704_067_200  # 2024-01-01


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def models(spark: SparkSession) -> DataFrame:
    """Three chat models, one of them verified twice, and one for embeddings."""
    t = lambda day: dt.datetime(2024, 1, day, tzinfo=dt.UTC)
    rows = [
        ("e1", "en", "words-old", "embedding", t(1)), ("e2", "en", "words", " Chat ", t(5)), ("e3", "en", "never", "embedding", None),
        ("e1", "de", "words", "chat", t(2)), ("e1", "fr", None, "", t(2)), ("e1", "es", "words", "Embedding", t(3)),
    ]
    return spark.createDataFrame(rows, "endpoint_uuid string, model_id string, tokenizer_model string, model_mode string, last_verified_at timestamp")


def requests(spark: SparkSession, d: str) -> DataFrame:
    """A queued request per document: batch = source, model = lang; one that has a label is in a file already."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select(F.col("doc_id").alias("l_")).distinct()
    done = docs.join(labels, F.col("doc_id") == F.col("l_"), "left")
    return done.select(
        F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("request_uuid"),
        F.col("source").alias("batch_uuid"),
        F.col("lang").alias("model_name"),
        F.lit("").alias("system_prompt"),
        F.col("text").alias("user_prompt"),
        F.timestamp_seconds(F.col("doc_id") + EPOCH).alias("created_at"),
        F.lit("queued").alias("request_status"),
        F.when(F.col("l_").isNotNull(), "file_done").alias("batch_file_uuid"),
    )


def chat_requests(spark: SparkSession, d: str) -> DataFrame:
    """A request per user turn; the conversation's first assistant turn serves as its system prompt."""
    c = table(spark, d, "conversations")
    first = c.where("role = 'assistant'").groupBy(F.col("conv_id").alias("c_")).agg(F.min_by("text", "turn").alias("system_prompt"))
    u = c.where("role = 'user'").join(first, F.col("conv_id") == F.col("c_"), "left")
    return u.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-t"), F.col("turn").cast("string")).alias("request_uuid"),
        F.concat(F.lit("batch-"), (F.col("conv_id") % 8).cast("string")).alias("batch_uuid"),
        F.element_at(F.array(F.lit("de"), F.lit("en"), F.lit("es")), (F.col("conv_id") % 3 + 1).cast("int")).alias("model_name"),
        "system_prompt",
        F.col("text").alias("user_prompt"),
        F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn") + EPOCH).alias("created_at"),
    )


def observations(spark: SparkSession, d: str) -> DataFrame:
    """An observation per event: a job per user, late arrivals, missing and bad counts."""
    e = table(spark, d, "events")
    user = F.col("user_id").cast("string")
    return e.select(
        F.concat(F.lit("tenant-"), (F.col("user_id") % 3).cast("string")).alias("tenant_scope"),
        F.concat(F.lit(" gw-"), (F.col("user_id") % 2).cast("string")).alias("endpoint_alias"),
        F.concat(F.lit("batch-"), user).alias("remote_batch_id"),
        (F.col("event_id") + 1).alias("observation_order"),
        ((F.col("event_id") * 7919) % 1_000_003 * 10_000_000_000 + F.col("event_id")).alias("arrival"),
        F.concat(F.lit("file-"), user).alias("input_file_id"),
        F.lit("/v1/chat/completions").alias("endpoint"),
        F.expr("CASE event_type WHEN 'signup' THEN 'validating' WHEN 'view' THEN 'in_progress' WHEN 'click' THEN 'finalizing' WHEN 'purchase' THEN IF(value > 200, 'completed', 'in_progress') ELSE IF(value > 300, 'failed', '') END").alias("status"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("out-"), F.col("event_id").cast("string"))).alias("output_file_id"),
        F.lit("").alias("error_file_id"),
        F.when(F.col("event_type") != "view", "100").alias("total"),
        F.get_json_object("props", "$.k").alias("completed"),
        F.when(F.col("value") > 100, "3").otherwise("-1").alias("failed"),
        F.when(F.col("event_type") == "click", F.col("props")).alias("metadata"),
        F.col("ts").cast("timestamp").alias("observed_at"),
    )


def result_files(spark: SparkSession, d: str) -> DataFrame:
    """A result file (assistant turns) and an error file (user turns) per conversation, with blank lines and \\r\\n."""
    c = table(spark, d, "conversations").where("role IN ('assistant', 'user')")
    turn = F.col("turn").cast("string")
    n = whitespace_tokens(F.col("text"))
    line = F.concat(
        F.lit('{"custom_id": "c'), F.col("conv_id").cast("string"), F.lit("-t"), turn, F.lit('", "response": {"body": {"choices": [{"message": {"content": '), json_text(F.col("text")),
        F.lit('}}], "usage": {"prompt_tokens": '), turn, F.lit(', "completion_tokens": '), n.cast("string"), F.lit(', "total_tokens": '), (n + F.col("turn")).cast("string"), F.lit("}}}}"),
    )
    end = F.element_at(F.array(F.lit("\n"), F.lit("\r\n"), F.lit("\n\n"), F.lit("\n")), (F.col("turn") % 4 + 1).cast("int"))
    kind = F.when(F.col("role") == "assistant", "result").otherwise("error")
    pieces = F.sort_array(F.collect_list(F.struct("turn", F.concat(line, end).alias("x"))))
    out = c.groupBy(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("batch_id"), kind.alias("file_kind")).agg(F.array_join(F.transform(pieces, lambda p: p["x"]), "").alias("content"))
    return out.select("batch_id", "file_kind", F.concat("batch_id", F.lit("."), "file_kind").alias("file_id"), "content")


def stored_result_files(spark: SparkSession, d: str) -> DataFrame:
    """The same files written to the shared folder, those of 4096 conversations one after another in one, by their places there."""
    root = f"{shared_dir(spark)}/result-files-{uuid.uuid4().hex}"
    part = F.expr("CAST(substring(batch_id, 6) AS long) DIV 4096").alias("part")
    files = materialize(result_files(spark, d).select(part, "batch_id", "file_kind", F.regexp_replace("content", r"\n\z", "").alias("value")), "result-texts")
    files.repartition("part").sortWithinPartitions("part", "batch_id", "file_kind").select("part", "value").write.option("maxRecordsPerFile", 0).partitionBy("part").text(root)
    length = (F.octet_length("value") + 1).cast("long")
    sizes = files.select("part", "batch_id", "file_kind", length.alias("length"))
    start = F.sum("length").over(Window.partitionBy("part").orderBy("batch_id", "file_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    stored = spark.read.format("binaryFile").load(root).select(F.col("part").cast("long").alias("part_"), F.col("path").alias("whole_"))
    found = sizes.withColumn("start", start).join(stored, F.col("part") == F.col("part_"))
    path = F.concat("whole_", F.lit("#bytes="), F.col("start").cast("string"), F.lit("-"), F.col("length").cast("string"))
    return found.select("batch_id", "file_kind", F.concat("batch_id", F.lit("."), "file_kind").alias("file_id"), path.alias("path"), "length")


def listed_archives(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Result files of 64 conversations each in one file, written and listed for digests, named by their number."""
    root = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    part = F.expr("CAST(substring(batch_id, 6) AS long) DIV 64").alias("part")
    rows = files.select(part, "batch_id", "file_kind", F.regexp_replace("content", r"\n\z", "").alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "batch_id", "file_kind").select("part", "value").write.partitionBy("part").text(root)
    return digests.listed(spark, root).withColumn("name", F.regexp_extract("name", "^part=([0-9]+)/", 1))


def cas_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Save attempts per user in the order of events: advances, repeats, stale and missing expectations."""
    e = table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    rank = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY event_id)").cast("long")
    e = e.withColumn("rc", rank).withColumn("rc", F.greatest(F.lit(1), F.col("rc") - F.col("k") % 3))

    def checkpoint(rc):  # noqa: ANN001, ANN202
        return F.struct(F.lit("result").alias("file_kind"), F.lit("f").alias("file_id"), rc.alias("file_line_number"), (rc * 2).alias("batch_line_count"), rc.alias("record_count"), F.sha2(rc.cast("string").cast("binary"), 256).alias("prefix_sha256"))

    expected = F.when((F.col("k") % 4).isin(1, 2) & (F.col("rc") > 1), checkpoint(F.col("rc") - 1))
    return e.select(F.lit("tenant-0").alias("tenant_scope"), F.lit("loader").alias("consumer"), F.lit("gw").alias("endpoint_alias"), F.concat(F.lit("batch-"), F.col("user_id").cast("string")).alias("batch_id"), F.col("event_id").alias("attempt"), checkpoint(F.col("rc")).alias("checkpoint"), expected.alias("expected_previous"))


def config_rows(spark: SparkSession, d: str) -> DataFrame:
    """A change of a setting per event, in forms that aren't canonical, some of them bad; other keys are a user's own."""
    e = table(spark, d, "events")
    key = "CASE event_type WHEN 'click' THEN 'batch_size.min' WHEN 'view' THEN 'optimization.auto_split' WHEN 'signup' THEN 'batch_size.max' WHEN 'purchase' THEN 'token_limits.per_batch' ELSE 'user-' || user_id END"
    value = "CASE event_type WHEN 'click' THEN ' ' || CAST(floor(value) AS STRING) || ' ' WHEN 'view' THEN IF(value > 100, 'ON', 'No') WHEN 'signup' THEN 'many ' || event_id WHEN 'purchase' THEN CAST(1000 + event_id AS STRING) ELSE 'v' || event_id END"
    return e.select(F.expr(key).alias("config_key"), F.expr(value).alias("config_value"), F.col("event_id").alias("change"))


def components(spark: SparkSession, d: str) -> DataFrame:
    """What the last event of each kind says of a component. Purchases report on one that clicks report on already; secrets have no report."""
    last = table(spark, d, "events").groupBy("event_type").agg(F.max_by("value", "event_id").alias("value"))
    name = F.expr("CASE event_type WHEN 'view' THEN 'tables' WHEN 'signup' THEN 'tokenizer' WHEN 'error' THEN 'checkpoints' ELSE 'config' END")
    return last.select(name.alias("component"), F.when(F.col("event_type") == "error", F.col("value") < 0).otherwise(F.col("value") >= 0).alias("is_ready"))
