"""JSON Lines payloads of packed parts: lines, documents, assignment, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.checks import payload_id
from ..functions.strict_json import all_strict

#: Files that go to Python at a time, at most.
BATCH_FILES = 64


def lines(requests: DataFrame, assigned: DataFrame) -> DataFrame:
    """(payload_file_id, request_uuid, sequence_no, line_text), sequence numbers from 1 within a file."""
    a = assigned.select(F.col("request_uuid").alias("r_"), payload_id(F.col("batch_uuid"), F.col("part_index")).alias("payload_file_id"), F.col("position").alias("sequence_no"))
    return requests.join(a, F.col("request_uuid") == F.col("r_")).select("payload_file_id", "request_uuid", "sequence_no", F.col("line").alias("line_text"))


def numbered_lines(lines_: DataFrame, file: str, order: list[str]) -> DataFrame:
    """Lines that have no number yet, with `sequence_no` from 1 within their file. A file is bounded by the part's record limit."""
    return lines_.withColumn("sequence_no", F.row_number().over(Window.partitionBy(file).orderBy(*order)).cast("long"))


def documents(lines_: DataFrame) -> DataFrame:
    """(file_id, text, line_count): a file's lines in order, each with its newline. A file is bounded by the part's byte limit."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("sequence_no", "line_text"))), lambda x: x["line_text"])
    return lines_.groupBy(F.col("payload_file_id").alias("file_id")).agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("text"), F.count("*").alias("line_count"))


def batch_files(parts: DataFrame) -> DataFrame:
    """A row per part as a virtual file."""
    file_id = payload_id(F.col("batch_uuid"), F.col("part_index"))
    return parts.select("batch_uuid", "part_index", file_id.alias("payload_file_id"), F.concat(F.lit("memory://"), file_id).alias("file_path"), F.col("record_count").alias("request_count"), "total_tokens", "state")


def virtual_file_id(path: str) -> str:
    if not path.startswith("memory://") or len(path) == len("memory://"):
        raise ValidationError("only memory:// files are known", path=path)
    return path[len("memory://") :]


def new_lines(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Lines that aren't stored yet, once each."""
    return fresh.dropDuplicates(["payload_file_id", "request_uuid"]).join(stored, ["payload_file_id", "request_uuid"], "left_anti")


def assign(requests: DataFrame, lines_: DataFrame, expected: int | None = None) -> DataFrame:
    """Requests with the file they are in. With `expected`, another number of requests with a file is an error."""
    named = lines_.select(F.col("request_uuid").alias("r_"), F.col("payload_file_id").alias("file_"))
    out = requests.join(named, F.col("request_uuid") == F.col("r_"), "left").withColumn("batch_file_uuid", F.coalesce("file_", "batch_file_uuid")).drop("r_", "file_")
    if expected is not None and (n := requests.join(named, F.col("request_uuid") == F.col("r_"), "left_semi").count()) != expected:
        raise ValidationError("not every request could be assigned", expected=expected, assigned=n)
    return out


def integrity(payloads: DataFrame) -> DataFrame:
    """(file_id, text, line_count) -> the same and `problem`: null, or what is wrong with the file. An empty file has no line."""
    lines_ = F.size(F.split(F.substring("text", F.lit(1), F.length("text") - 1), "\n", -1))
    problem = (
        F.when(F.col("text").isNull() | F.col("line_count").isNull() | (F.col("line_count") < 0), "shape")
        .when((F.col("text") == "") & (F.col("line_count") == 0), None)
        .when(~F.endswith("text", F.lit("\n")), "newline")
        .when(lines_ != F.col("line_count"), "line_count")
        .when(~F.col("strict_"), "json")
    )
    conf, name = payloads.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_FILES:  # a file may be large: few go to Python at a time
        conf.set(name, BATCH_FILES)
    return payloads.select("file_id", "text", "line_count").withColumn("strict_", all_strict("text")).select("file_id", "text", "line_count", problem.alias("problem"))


def load(payloads: DataFrame, file_id: str) -> str | None:
    """A stored payload's text, or None; a damaged one is an error."""
    row = integrity(payloads.where(F.col("file_id") == file_id)).head()
    if row is None:
        return None
    if row["problem"]:
        raise ValidationError("the stored payload is damaged", file=file_id, problem=row["problem"])
    return row["text"]
