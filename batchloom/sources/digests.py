"""Digests of files of any size: block digests over byte ranges, the tree above them, and descent to what differs.

A leaf is SHA-256 of a zero byte and a block's bytes, a node SHA-256 of a one byte and its children's digests, at most
FANOUT of them, in order. The root doesn't depend on tasks or their number, and no task holds more than a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..schemas import exact_positive
from ..storage import materialize
from .ranges import _open, _schema, _uri

#: Bytes of a block, children of a node, bytes read at once, and the bound on a file's bytes unless another is given.
BLOCK, FANOUT, CHUNK, LARGEST = 8 << 20, 64, 1 << 20, 64 << 30
BLOCKS = "name string, node long, digest string"


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, length, changed) of a folder's files, below it too; `name` is the place within the folder. No content is read.

    Files without a byte aren't listed, as Spark's file sources leave them out.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    root = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().getPath()
    name = F.expr("substring(path, locate(root_, path) + length(root_))")
    return found.withColumn("root_", F.lit(root.rstrip("/") + "/")).select(name.alias("name"), "path", "length", F.unix_millis("modificationTime").alias("changed"))


def _in_bounds(files: DataFrame, most: int) -> DataFrame:
    """files, or an error that names one above the bound. Only the listing is looked at."""
    if (bad := files.where(F.col("length") > exact_positive("max_bytes", most)).orderBy("name").head()) is not None:
        raise ValidationError("file is above the size bound", name=bad["name"], length=bad["length"])
    return files


def _hashed(row: dict, low: int, high: int, digest) -> str:  # noqa: ANN001
    """The digest after [low, high) of a file, which must still be the one that was listed."""
    system, inside = fs.FileSystem.from_uri(_uri(row["path"]))
    with _open(_uri(row["path"])) as f:
        f.seek(low)
        while low < high:
            part = f.read(min(CHUNK, high - low))
            if not part:
                break
            digest.update(part)
            low += len(part)
    now = system.get_file_info(inside)
    if low < high or now.size != row["length"] or now.mtime_ns is not None and now.mtime_ns // 1_000_000 != row["changed"]:
        raise ValidationError("file changed while it was read", name=row["name"])
    return digest.hexdigest()


def whole(files: DataFrame, max_bytes: int = LARGEST) -> DataFrame:
    """(name, path, length, sha256) of whole files, each streamed by one task: SHA-256 itself can't be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                row = {n: r[n] for n in ("name", "path", "length")} | {"sha256": _hashed(r, 0, r["length"], hashlib.sha256())}
                yield pa.RecordBatch.from_pylist([row], schema=_schema("name string, path string, length long, sha256 string"))

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _in_bounds(files, max_bytes).select("name", "path", "length", "changed").repartition(parts, "path")
    return dealt.mapInArrow(run, "name string, path string, length long, sha256 string")


def blocks(files: DataFrame, block_bytes: int = BLOCK, max_bytes: int = LARGEST) -> DataFrame:
    """BLOCKS: a leaf digest for each block, read side by side."""
    exact_positive("block_bytes", block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                low = r["node"] * block_bytes
                row = {"name": r["name"], "node": r["node"], "digest": _hashed(r, low, min(low + block_bytes, r["length"]), hashlib.sha256(b"\0"))}
                yield pa.RecordBatch.from_pylist([row], schema=_schema(BLOCKS))

    last = F.expr(f"(length - 1) DIV {block_bytes}L")
    dealt = _in_bounds(files, max_bytes).where("length > 0").select("name", "path", "length", "changed", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("node"))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "path", "node").mapInArrow(run, BLOCKS)


def tree(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """BLOCKS and their tree: (level, name, node, digest, top), leaves at level 0; `top` marks a file's root.

    Each round is a grouping of at most `fanout` digests, and there are as many as the logarithm of the largest file's blocks.
    """
    if exact_positive("fanout", fanout) < 2:
        raise ValidationError("fanout must be at least 2", value=fanout)
    sizes = leaves.groupBy("name").agg(F.count("*").alias("width"))
    level = materialize(leaves.join(sizes, "name").select("name", "node", "digest", "width"), "digests-0", compact=16)
    levels = [level]
    most = level.agg(F.max("width")).first()[0] or 0
    while most > 1:
        children = F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"])
        joined = F.concat(F.lit(b"\x01"), F.unhex(F.array_join(children, "")))
        above = level.where("width > 1").groupBy("name", F.expr(f"node DIV {fanout}").alias("node"), F.expr(f"(width + {fanout - 1}) DIV {fanout}").alias("width"))
        level = materialize(above.agg(F.sha2(joined, 256).alias("digest")).select("name", "node", "digest", "width"), f"digests-{len(levels)}", compact=16)
        levels.append(level)
        most = -(-most // fanout)
    out = None
    for i, one in enumerate(levels):
        part = one.select(F.lit(i).alias("level"), "name", "node", "digest", (F.col("width") == 1).alias("top"))
        out = part if out is None else out.unionByName(part)
    return out


def roots(of: DataFrame, files: DataFrame) -> DataFrame:
    """(name, length, root), a row for each file."""
    sizes = files.select(F.col("name").alias("n_"), "length")
    return of.where("top").join(sizes, F.col("name") == F.col("n_")).select("name", "length", F.col("digest").alias("root"))


def differing(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(name, block) of the blocks that differ between two sides' trees of one block size and fanout, or that one side lacks.

    Descent: of each level only the children of nodes that differ are compared, from the lower of a file's two roots on. A
    file that one side lacks differs in all its blocks.
    """
    top = lambda side: side.where("top").select("name", "level")
    starts = materialize(top(a).unionByName(top(b)).groupBy("name").agg(F.min("level").alias("start")), "digest-starts", compact=16)
    found = starts.sparkSession.createDataFrame([], "name string, node long")
    for level in range(starts.agg(F.max("start")).first()[0] or 0, -1, -1):
        below = starts.where(F.col("start") == level).select(F.col("name").alias("s_"))
        parents = found.select(F.col("name").alias("p_"), F.col("node").alias("q_"))

        def asked(side: DataFrame) -> DataFrame:
            own = side.where(F.col("level") == level).select("name", "node", "digest")
            child = (F.col("name") == F.col("p_")) & (F.expr(f"node DIV {fanout}") == F.col("q_"))
            return own.join(below, F.col("name") == F.col("s_"), "left_semi").unionByName(own.join(parents, child, "left_semi"))

        x, y = asked(a).withColumnRenamed("digest", "x_"), asked(b).withColumnRenamed("digest", "y_")
        unequal = x.join(y, ["name", "node"], "full").where(~F.col("x_").eqNullSafe(F.col("y_"))).select("name", "node")
        found = materialize(unequal, f"differing-{level}", compact=16)
    return found.select("name", F.col("node").alias("block"))
