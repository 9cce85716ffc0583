"""Result files read in byte ranges: numbered records, budgets checked before anything is used, and offsets to go on from.

A file is never one row. Ranges of a few megabytes are counted side by side: a line belongs to the range that it begins
in. Running sums over a batch's ranges, result file first, number their lines and records, and tell where a budget is
broken; then the ranges are read again and give the records with their numbers. An offset is, for each file, the bytes,
lines and records behind it; reading goes on from there, and what was counted before isn't read again.

Files are opened by pyarrow, so their file system must be one that it knows (local, HDFS, S3).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..schemas import exact_positive
from ..storage import materialize

RANGE = 8 << 20
CHUNK = 1 << 18
BLANK = b" \t\n\r\x0b\f"
FILES = "batch_id string, file_kind string, file_id string, path string, length long"
OFFSETS = "batch_id string, file_kind string, file_id string, path string, bytes long, lines long, records long"
COUNTS = "batch_id string, file_kind string, file_id string, path string, low long, high long, bytes long, lines long, records long, long_at long, text_at long, open_tail boolean"
RECORDS = "batch_id string, file_kind string, file_id string, file_line_number long, batch_line_count long, record_count long, byte_start long, record string, newline_terminated boolean"


@dataclass(frozen=True)
class Budgets:
    """What a file, a line and a batch may have at most."""

    file_bytes: int = 128 << 20
    line_bytes: int = 1 << 20
    batch_lines: int = 100_000
    batch_records: int = 100_000

    def __post_init__(self) -> None:
        for name in ("file_bytes", "line_bytes", "batch_lines", "batch_records"):
            exact_positive(name, getattr(self, name))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """<batch_id>.<result|error>.jsonl files of a folder, as FILES. Contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    return found.select(F.regexp_extract(name, r"^(.+)\.(result|error)\.jsonl\z", 1).alias("batch_id"), F.regexp_extract(name, r"^(.+)\.(result|error)\.jsonl\z", 2).alias("file_kind"), name.alias("file_id"), "path", "length")


@dataclass
class Line:
    start: int
    end: int
    raw: bytes | None
    ended: bool


def lines_of(f: pa.NativeFile, low: int, high: int, most: int) -> Iterator[Line]:
    """Lines that begin in [low, high), without their newline; one of more than `most` bytes has no content, and is passed over in chunks."""
    at = low
    if low:
        f.seek(low - 1)
        at = low - 1
        while True:
            part = f.read(CHUNK)
            if not part:
                return
            if (i := part.find(b"\n")) >= 0:
                at += i + 1
                break
            at += len(part)
            if at >= high:
                return
    f.seek(at)
    held, base, skipped = b"", at, False  # held: bytes from base on; skipped: the line is too long and its beginning is gone
    while at < high:
        i = held.find(b"\n", max(0, at - base))
        if i >= 0:
            raw = None if skipped or base + i - at > most else held[at - base : i]
            yield Line(at, base + i + 1, raw, True)
            at, skipped = base + i + 1, False
            continue
        begun = held[at - base :] if at >= base else held
        if skipped or len(begun) > most:
            skipped, begun = True, b""
        part = f.read(CHUNK)
        if not part:
            end = f.tell()
            if end > at:
                yield Line(at, end, None if skipped else begun, False)
            return
        base = f.tell() - len(part) - len(begun)
        held = begun + part


class Slice:
    """Bytes [start, start + length) of an open file, read as a file of their own."""

    def __init__(self, f: pa.NativeFile, start: int, length: int) -> None:
        self.f, self.start, self.length = f, start, length
        f.seek(start)

    def seek(self, at: int) -> None:
        self.f.seek(self.start + at)

    def tell(self) -> int:
        return self.f.tell() - self.start

    def read(self, size: int) -> bytes:
        return self.f.read(max(0, min(size, self.length - self.tell())))

    def __enter__(self) -> Slice:
        return self

    def __exit__(self, *_: object) -> None:
        self.f.close()


def _open(path: str) -> pa.NativeFile | Slice:
    """A file; `path#bytes=start-length` is a file that lies within another."""
    whole, _, part = path.partition("#bytes=")
    system, inside = fs.FileSystem.from_uri(whole)
    f = system.open_input_file(inside)
    return Slice(f, *map(int, part.split("-"))) if part else f


def _uri(path: str) -> str:
    return "file://" + path[len("file:") :] if path.startswith("file:/") and not path.startswith("file://") else path


class Reading:
    """The ranges of files, counted. `offsets`: where an earlier reading ended; `final`: what follows the last newline is a line too."""

    def __init__(self, files: DataFrame, budgets: Budgets = Budgets(), offsets: DataFrame | None = None, range_bytes: int = RANGE, final: bool = True) -> None:
        exact_positive("range_bytes", range_bytes)
        spark = files.sparkSession
        self.budgets, self.final = budgets, final
        done = (offsets if offsets is not None else spark.createDataFrame([], OFFSETS)).select("path", F.col("bytes").alias("done_"), F.col("lines").alias("lines_"), F.col("records").alias("records_"))
        self.files = materialize(files.join(done, "path", "left").fillna(0, ["done_", "lines_", "records_"]), "result-files", compact=16)
        begin = F.when(F.col("length") > F.col("done_"), F.sequence(F.col("done_"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
        ranges = self.files.select("batch_id", "file_kind", "file_id", "path", "length", F.explode(begin).alias("low"))
        ranges = ranges.withColumn("high", F.least(F.col("low") + range_bytes, F.col("length"))).drop("length")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.counts = materialize(ranges.repartition(parts, "path", "low").mapInArrow(self._counter(), COUNTS), "result-ranges", compact=4)

    def _counter(self):  # noqa: ANN202
        most, final = self.budgets.line_bytes, self.final

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for r in b.to_pylist():
                    n = records = 0
                    end, long_at, text_at, tail = 0, None, None, False
                    with _open(_uri(r["path"])) as f:
                        for line in lines_of(f, r["low"], r["high"], most):
                            if not line.ended and not final:
                                tail = True
                                break
                            n, end = n + 1, line.end
                            if line.raw is None:
                                long_at, records = long_at or n, records + 1
                            elif line.raw.strip(BLANK):
                                records += 1
                                text_at = text_at or (n if _text(line.raw) is None else None)
                    out.append({**r, "bytes": end, "lines": n, "records": records, "long_at": long_at, "text_at": text_at, "open_tail": tail})
                yield pa.RecordBatch.from_pylist([{c.split(" ")[0]: r[c.split(" ")[0]] for c in COUNTS.split(", ")} for r in out], schema=_schema(COUNTS))

        return run

    def numbered(self) -> DataFrame:
        """Ranges with what lies before them: lines in the file, lines and records in the batch."""
        rank = F.when(F.col("file_kind") == "result", 0).otherwise(1).alias("rank")
        new = self.counts.select(*(c.split(" ")[0] for c in COUNTS.split(", ")), rank, F.lit(False).alias("past"))
        past = self.files.where("done_ > 0").select("batch_id", "file_kind", "file_id", "path", F.lit(-1).cast("long").alias("low"), F.col("done_").alias("high"), F.col("done_").alias("bytes"), F.col("lines_").alias("lines"), F.col("records_").alias("records"), *(F.lit(None).cast("long").alias(n) for n in ("long_at", "text_at")), F.lit(False).alias("open_tail"), rank, F.lit(True).alias("past"))
        both = new.unionByName(past)
        before = lambda name, *keys: F.coalesce(F.sum(name).over(Window.partitionBy(*keys).orderBy("rank", "path", "low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = both.withColumns({"batch_lines": before("lines", "batch_id"), "batch_records": before("records", "batch_id")})
        return out.withColumn("file_lines", before("lines", "batch_id", "rank", "path"))

    def broken(self) -> DataFrame:
        """(batch_id, budget, at_line): each budget that a batch breaks in what is new, and the first line that does; 0 for a whole file. text: a line that isn't UTF-8."""
        b = self.budgets
        n = materialize(self.numbered().where("NOT past"), "result-numbered", compact=16)
        at = lambda c: (F.col("batch_lines") + F.col(c))
        large = self.files.where(F.col("length") > b.file_bytes).select("batch_id", F.lit("file_bytes").alias("budget"), F.lit(0).cast("long").alias("at_line"))
        long_ = n.where("long_at IS NOT NULL").select("batch_id", F.lit("line_bytes").alias("budget"), at("long_at").alias("at_line"))
        text = n.where("text_at IS NOT NULL").select("batch_id", F.lit("text").alias("budget"), at("text_at").alias("at_line"))
        many = n.where(at("lines") > b.batch_lines).select("batch_id", F.lit("batch_lines").alias("budget"), F.greatest(F.lit(b.batch_lines).cast("long"), F.col("batch_lines")).alias("at_line")).withColumn("at_line", F.col("at_line") + 1)
        over = n.where((F.col("batch_records") + F.col("records") > b.batch_records) & (F.col("records") > 0))
        often = self._read(over).where(F.col("record_count") > b.batch_records).select("batch_id", F.lit("batch_records").alias("budget"), F.col("batch_line_count").alias("at_line"))
        out = large.unionByName(long_).unionByName(text).unionByName(many).unionByName(often)
        return out.groupBy("batch_id", "budget").agg(F.min("at_line").alias("at_line"))

    def records(self) -> DataFrame:
        """The new records, RECORDS. A broken budget is an error, raised before any record is given."""
        if (bad := self.broken().orderBy("at_line", "batch_id", "budget").head()) is not None:
            raise ValidationError("a result file breaks a budget", **bad.asDict())
        return self._read(self.numbered().where("NOT past"))

    def _read(self, ranges: DataFrame) -> DataFrame:
        most, final = self.budgets.line_bytes, self.final

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    out: list[dict] = []
                    own, n, records = r["file_lines"], r["batch_lines"], r["batch_records"]
                    with _open(_uri(r["path"])) as f:
                        for line in lines_of(f, r["low"], r["high"], most):
                            if not line.ended and not final:
                                break
                            own, n = own + 1, n + 1
                            if line.raw is not None and not line.raw.strip(BLANK):
                                continue
                            records += 1
                            out.append({"batch_id": r["batch_id"], "file_kind": r["file_kind"], "file_id": r["file_id"], "file_line_number": own, "batch_line_count": n, "record_count": records, "byte_start": line.start, "record": None if line.raw is None else _text(line.raw.removesuffix(b"\r")), "newline_terminated": line.ended})
                            if len(out) >= 2000:
                                yield pa.RecordBatch.from_pylist(out, schema=_schema(RECORDS))
                                out = []
                    yield pa.RecordBatch.from_pylist(out, schema=_schema(RECORDS))

        parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slim = ranges.select("batch_id", "file_kind", "file_id", "path", "low", "high", "file_lines", "batch_lines", "batch_records")
        return slim.repartition(parts, "path", "low").mapInArrow(run, RECORDS)

    def offsets(self) -> DataFrame:
        """Where this reading ends, as OFFSETS: of every file, also of those without anything new."""
        sums = self.counts.groupBy("path").agg(F.max("bytes").alias("b_"), F.sum("lines").alias("l_"), F.sum("records").alias("r_"))
        joined = self.files.join(sums, "path", "left").fillna(0, ["l_", "r_"])
        return joined.select("batch_id", "file_kind", "file_id", "path", F.greatest(F.coalesce("b_", F.lit(0)), "done_").alias("bytes"), (F.col("lines_") + F.col("l_")).alias("lines"), (F.col("records_") + F.col("r_")).alias("records"))


def _text(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in ddl.split(", "))])
