"""Numbers along an order, without bringing all rows into one task; and blocks of numbers reserved in a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..sources.store import Merge, Store, upsert
from ..storage import bounded, materialize

COUNTERS = "name string, reserved long"
#: Bits of a row's place in its partition, as Spark numbers rows.
PLACE_BITS = 33
#: Partitions whose offsets may be broadcast.
OFFSETS = 1_000_000


def numbered(rows: DataFrame, by: list[str], name: str = "number", first: int = 1) -> DataFrame:
    """rows with numbers from `first` on in the order of `by` (nulls first); among equal ones any order.

    Rows are dealt by ranges of the order and sorted there; a range's first number is `first` and the rows of the ranges
    before it. Only as many counts as there are ranges meet.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("row_number_", F.monotonically_increasing_id())
    dealt = materialize(dealt, "numbered")
    part = F.shiftright("row_number_", PLACE_BITS)
    before, offsets = first, []
    for r in sorted(dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["part"]):
        offsets.append((r["part"], before))
        before += r["n"]
    starts = spark.createDataFrame(offsets, "part_ long, before_ long")
    place = F.col("row_number_").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return dealt.join(bounded(starts, OFFSETS), part == F.col("part_")).withColumn(name, F.col("before_") + place).drop("part_", "before_", "row_number_")


def reserve(store: Store, name: str, count: int, table: str = "counters") -> int:
    """The first of `count` numbers that no other caller gets. Numbers of a caller that dies stay unused."""
    if type(count) is not int or count < 1:
        raise ValidationError("at least one number is reserved", count=count)
    store.create(table, COUNTERS, ["name"], buckets=16)
    change = store.spark.createDataFrame([(name, count)], COUNTERS)
    base = store.merge({table: Merge(change, upsert(["name"], lambda o, n: {"reserved": o("reserved") + n("reserved")}))})
    found = store.lookup(table, base, name=name).head()
    return (found["reserved"] if found else 0) + 1
