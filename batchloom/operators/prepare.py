"""Preparation of a batch from its queued requests to its files."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.tokens import Tokenizer, whitespace_tokens
from ..schemas import Limits
from . import packing, payloads


def resolve_batch(batches: DataFrame, key: str) -> str:
    """A UUID stands for itself; other text is looked up as an input file path."""
    if type(key) is not str:
        raise ValidationError("the batch must be text", value=key)
    try:
        uuid.UUID(key)
    except ValueError:
        row = batches.where(F.col("input_file_path") == key).select("batch_uuid").orderBy("batch_uuid").head()
        if row is None:
            raise ValidationError("unknown batch", value=key) from None
        return row[0]
    return key


def prepared(files: DataFrame, batch_uuid: str) -> DataFrame:
    """Files of a batch in order."""
    return files.where(F.col("batch_uuid") == batch_uuid).orderBy("part_index", "payload_file_id")


@dataclass(frozen=True)
class Prepared:
    """What a preparation makes: files (ready and overflow), payload documents, lines, requests with their file, totals."""

    files: DataFrame
    documents: DataFrame | None
    lines: DataFrame | None
    requests: DataFrame
    totals: DataFrame | None
    replayed: bool


def prepare(requests: DataFrame, models: DataFrame, stored_files: DataFrame, batch_uuid: str, limits: Limits, runtime_limit: int | None = None, tokenizer: Tokenizer = whitespace_tokens, on_oversize: str = "error") -> Prepared:
    """Prepare a batch once. Repeated, it returns the stored files, unless requests were added since: that is an error.

    Ids depend on batch and part alone, so a preparation that was interrupted can simply run again.
    """
    own = requests.where(F.col("batch_uuid") == batch_uuid)
    waiting = packing.queued(own)
    before = prepared(stored_files, batch_uuid)
    if not before.isEmpty():
        if not waiting.isEmpty():
            raise ValidationError("the batch is prepared, but has new requests", batch=batch_uuid)
        return Prepared(before, None, None, own, None, True)
    measured = packing.measured(packing.with_model(waiting, models), tokenizer)
    packed = packing.pack(measured, limits.effective(runtime_limit), limits.max_bytes, limits.max_records, on_oversize=on_oversize)
    parts = packing.parts(packed, limits.max_files)
    lines = payloads.lines(measured, packed)
    return Prepared(payloads.batch_files(parts), payloads.documents(lines), lines, payloads.assign(own, lines), packing.batch_totals(parts), False)
