"""Result files from storage, tables on disk, and payloads written out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES


def result_files(spark: SparkSession, path: str, max_bytes: int = 128 << 20) -> DataFrame:
    """<batch_id>.<kind>.jsonl files -> (batch_id, file_kind, file_id, content). Bytes stay bytes until checked.

    A file above the bound, or one that isn't UTF-8, is an error when its row is made.
    """
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    content = F.when(F.col("length") > max_bytes, F.raise_error(F.lit("file is above the size bound"))).when(~F.is_valid_utf8(F.col("content").cast("string")), F.raise_error(F.lit("file is not UTF-8"))).otherwise(F.col("content").cast("string"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(path)
    return files.select(F.regexp_extract(name, r"^(.+)\.(result|error)\.jsonl\z", 1).alias("batch_id"), F.regexp_extract(name, r"^(.+)\.(result|error)\.jsonl\z", 2).alias("file_kind"), name.alias("file_id"), content.alias("content"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines that part at \\n alone and keep a \\r."""
    return spark.read.option("lineSep", "\n").text(path)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the data model; one that was never written is empty."""
    schema = TABLES[name]
    path = f"{root}/{name}"
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_table(df: DataFrame, root: str, name: str, partition_by: tuple[str, ...] = ()) -> None:
    """Overwrite a table. `df` must not read the table itself; write a new root and switch readers to it instead."""
    columns = [c.split(" ")[0] for c in _split(TABLES[name])]
    df.select(*columns).write.mode("overwrite").partitionBy(*partition_by).parquet(f"{root}/{name}")


def _split(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def write_payloads(documents: DataFrame, path: str) -> None:
    """Payload documents as they are, a folder per file."""
    documents.select("file_id", F.regexp_replace("text", "\n\\z", "").alias("value")).write.mode("overwrite").partitionBy("file_id").text(path)
