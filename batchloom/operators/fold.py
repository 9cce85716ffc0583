"""Folds over ordered groups, in constant memory.

Rows are dealt by key, sorted within their partition, and streamed past a state; a group is never held in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Row = dict[str, Any]
ROWS = 5_000


def ordered_fold(df: DataFrame, keys: list[str], order: list[str | Column], schema: str, start: Callable[[], Any], step: Callable[[Any, Row], tuple[Any, list[Row]]], finish: Callable[[Any], list[Row]] = lambda state: []) -> DataFrame:
    """For each key, start() gives a state, step(state, row) the next one and output rows, finish(state) the last rows."""
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    names = [f.name for f in kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        key, state, out = None, None, []
        for b in batches:
            for row in b.to_pylist():
                now = tuple(row[k] for k in keys)
                if now != key:
                    if key is not None:
                        out += finish(state)
                    key, state = now, start()
                state, made = step(state, row)
                out += made
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in out], schema=arrow)
                    out = []
        if key is not None:
            out += finish(state)
        yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in out], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)
