"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from .errors import ConfigError

#: Bytes that may be broadcast.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the session has it.

    Where it is unset (tests, a laptop) a temporary folder is made and removed at exit. On a cluster that is an error:
    every executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ConfigError("spark.checkpoint.dir is unset; on a cluster it must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="batchloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables that a piece of work writes for itself alone."""

    def __init__(self) -> None:
        self.paths: dict[str, SparkSession] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """A written table that outlives the work: it belongs to whatever work surrounds this one."""
        path = df.scratch_path
        spark = self.paths.pop(path)
        outer = [w for w in _works.open if w is not self]
        if outer:
            outer[-1].paths[path] = spark
        return df


class _Works(threading.local):
    def __init__(self) -> None:
        self.open: list[Scratch] = []


_works = _Works()


@contextlib.contextmanager
def temporary() -> Iterator[Scratch]:
    """What materialize() writes in here is deleted at the end, but for what is kept. Nothing that reads it may be left to run."""
    work = Scratch()
    _works.open.append(work)
    try:
        yield work
    finally:
        _works.open.pop()
        for path, spark in work.paths.items():
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, label: str, compact: int = 0, group: int = 0) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and a lost executor costs nothing.

    compact: for narrow tables with few bytes a task; they get no more files than twice the cluster's cores, or this
    part of the shuffle partitions where that is more (a cluster may still be growing).
    group: bytes of a row group, for rows that are large, each: they are held in memory by the group, both ways.
    """
    if compact:
        spark = df.sparkSession
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // compact))
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if _works.open:
        _works.open[-1].paths[path] = df.sparkSession
    sizes = {"parquet.block.size": group, "parquet.page.size.row.check.min": 4} if group else {}  # else no size is looked at before 100 rows
    df.write.options(**sizes).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def bounded(df: DataFrame, rows: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if it has no more than so many rows and bytes; beyond, the same join shuffles.

    df is run once to tell, and again by the join: give it a written table, or what costs little.
    """
    n = F.count("*")
    held = F.sum(sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0)))
    found = df.agg(n.alias("n"), held.alias("b")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["b"] or 0) <= most else df


def _bytes(c: Column, kind: DataType) -> Column:
    """About the bytes of a value."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, ArrayType):
        inner = F.coalesce(F.size(c), F.lit(0))
        if isinstance(kind.elementType, StringType | BinaryType | ArrayType | MapType):
            return F.coalesce(F.octet_length(c.cast("string")), F.lit(0)) + 8
        return inner * (8 * len(kind.elementType) if isinstance(kind.elementType, StructType) else 8) + 8
    return F.lit(8)
