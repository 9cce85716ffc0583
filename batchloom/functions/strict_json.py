"""JSON objects under strict and lenient rules."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MAX_METADATA_BYTES


#: Bytes of a text that are looked at for a line's end at a time.
CHUNK = 1 << 14


def _unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
    names = dict(pairs)
    if len(names) < len(pairs):
        raise ValueError("a name is there twice")
    return names


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError("a number is too large")
    return value


def _refuse(text: str) -> None:
    raise ValueError(f"{text} is no number")


def parse_strict(text: str) -> dict[str, object]:
    """A JSON object without repeated names, NaN, Infinity or overflowing numbers."""
    value = json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse, parse_float=_finite)
    if type(value) is not dict:
        raise ValueError("not an object")
    return value


def _is_object(text: object, parse) -> bool:  # noqa: ANN001
    try:
        return isinstance(text, str) and isinstance(parse(text), dict)
    except (ValueError, RecursionError):
        return False


def is_strict_object(text: str | Column) -> Column:
    def check(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _is_object(t, parse_strict)).astype(bool)

    return F.pandas_udf(check, "boolean")(text)


def all_strict(text: str | Column) -> Column:
    """Whether each line of a text is a strict object; the newline at its end parts nothing."""

    def check(texts: pa.Array) -> pa.Array:
        return pa.array([t.is_valid and all(_is_object(x.decode("utf-8", "surrogatepass"), parse_strict) for x in _lines(memoryview(t.as_buffer()))) for t in texts], pa.bool_())

    return F.arrow_udf(check, "boolean")(text)


def _lines(raw: memoryview) -> Iterator[bytes]:
    """Lines one by one, without a copy of the whole; the newline at the end parts nothing."""
    at = 0
    end = len(raw) - (len(raw) > 0 and raw[-1] == 10)
    while at <= end:
        stop, size = end, at
        while size < end:
            part = bytes(raw[size : min(end, size + CHUNK)])
            if (i := part.find(b"\n")) >= 0:
                stop = size + i
                break
            size += len(part)
        yield bytes(raw[at:stop])
        at = stop + 1


def is_lenient_object(text: str | Column) -> Column:
    """Repeated names and NaN pass."""

    def check(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _is_object(t, json.loads)).astype(bool)

    return F.pandas_udf(check, "boolean")(text)


def canonical(text: str | None) -> str:
    """Metadata with sorted names and no spaces; {} for what is no strict object, has a NUL, or is over 64 KiB."""
    try:
        out = json.dumps(parse_strict(text or ""), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except (ValueError, RecursionError):
        return "{}"
    return "{}" if re.search(r"(?<!\\)(?:\\\\)*\\u0000", out) or len(out.encode("utf-8", "replace")) > MAX_METADATA_BYTES else out


def canonical_metadata(text: str | Column) -> Column:
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: canonical(t if isinstance(t, str) else None))

    return F.pandas_udf(convert, "string")(text)
