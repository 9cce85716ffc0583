"""The provider's HTTP interface: a client with bounded reads and retries, and a batch data source over it."""

from __future__ import annotations

import datetime as dt
import json
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..errors import GatewayError, ValidationError
from ..functions.checks import ENDPOINT_PATH, GATEWAY_URL, RESOURCE_ID
from ..schemas import RETRY_STATUSES, TERMINAL_STATUSES

CONTROL_BYTES = 1 << 20
FILE_BYTES = 128 << 20
CHUNK = 64 << 10


def wait_bounds(attempt: int, base: float = 0.5, most: float = 30.0) -> tuple[float, float]:
    """The least and the longest wait after an attempt."""
    ceiling = min(base * 2 ** (attempt - 1), most)
    return ceiling / 2, ceiling


def resource_id(value: object) -> str:
    """An id that may stand in a path."""
    if not isinstance(value, str) or not re.match(RESOURCE_ID.replace(r"\z", r"\Z"), value):
        raise ValidationError("not a resource id", value=value)
    return value


def endpoint_path(value: object) -> str:
    """A path of the interface: 1 to 16 segments, 256 characters at most, no dot segments."""
    if not isinstance(value, str) or len(value) > 256 or not re.match(ENDPOINT_PATH.replace(r"\z", r"\Z"), value) or {".", ".."} & set(value.split("/")):
        raise ValidationError("not an endpoint path", value=value)
    return value


def gateway_url(value: object) -> str:
    """A base URL without a slash at its end; plain http for loopback hosts alone, so that no key goes out in clear."""
    found = re.match(GATEWAY_URL.replace(r"\z", r"\Z"), value) if isinstance(value, str) else None
    host = re.match(r"(?i:https?)://(\[[^\]/]*\]|[^/:]*)(?::([0-9]*))?", value) if found else None
    if host is None or host[2] is not None and not 1 <= int(host[2]) <= 65535:
        raise ValidationError("not a gateway URL", value=value)
    local = host[1].lower() in ("localhost", "[::1]") or re.fullmatch(r"127(?:\.[0-9]{1,3}){3}", host[1]) is not None
    if not value.lower().startswith("https") and not local:
        raise ValidationError("plain http is for loopback hosts alone", value=value)
    return value.rstrip("/")


def retry_after(header: str | None, now: dt.datetime) -> float | None:
    """Seconds that a server asks to wait: digits, or the time until a date (0 if past); None for anything else."""
    text = (header or "").strip()
    if text.isascii() and text.isdigit():
        return float(text)
    try:
        at = parsedate_to_datetime(text)
    except (TypeError, ValueError, OverflowError):
        return None
    return max(0.0, ((at if at.tzinfo else at.replace(tzinfo=dt.UTC)) - now).total_seconds())


class Provider:
    """Calls of one endpoint. Only GETs are repeated."""

    def __init__(self, base_url: str, key: str, attempts: int = 3, timeout: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> None:
        self.base_url, self.key, self.attempts, self.timeout, self.sleep = gateway_url(base_url), key, attempts, timeout, sleep

    def _call(self, method: str, path: str, body: bytes | None = None, kind: str = "application/json", most: int = CONTROL_BYTES) -> bytes:
        for attempt in range(1, self.attempts + 1):
            request = urllib.request.Request(self.base_url + path, body, {"Authorization": f"Bearer {self.key}", "Content-Type": kind}, method=method)
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:  # noqa: S310
                    if (size := r.headers.get("Content-Length", "")).isdigit() and int(size) > most:
                        raise GatewayError("the answer is above its bound", path=path)
                    out = bytearray()
                    while part := r.read(CHUNK):
                        out += part
                        if len(out) > most:
                            raise GatewayError("the answer is above its bound", path=path)
                    return bytes(out)
            except urllib.error.HTTPError as e:
                asked_s = retry_after(e.headers.get("Retry-After"), dt.datetime.now(dt.UTC)) or 0.0
                if method != "GET" or e.code not in RETRY_STATUSES or attempt == self.attempts or asked_s > 30.0:
                    raise GatewayError("the provider refused", path=path, status=e.code) from None
                self.sleep(max(asked_s, random.uniform(*wait_bounds(attempt))))
            except (urllib.error.URLError, TimeoutError) as e:
                if method != "GET" or attempt == self.attempts or "CERTIFICATE" in str(e).upper():
                    raise GatewayError("the provider can't be reached", path=path) from None
                self.sleep(random.uniform(*wait_bounds(attempt)))
        raise AssertionError

    def _object(self, raw: bytes) -> dict[str, Any]:
        try:
            out = json.loads(raw.decode("utf-8"))
        except ValueError:
            raise GatewayError("the answer is no JSON") from None
        if not isinstance(out, dict):
            raise GatewayError("the answer is no JSON object")
        return out

    def _answered(self, value: object) -> str:
        """An id in an answer."""
        try:
            return resource_id(value)
        except ValidationError:
            raise GatewayError("the answer has no id") from None

    def upload(self, name: str, content: bytes, expires_after: int | None = None) -> str:
        if expires_after is not None and not 3600 <= expires_after <= 2_592_000:
            raise ValidationError("expiry must be from an hour to 30 days", value=expires_after)
        mark = f"part-{random.getrandbits(64):016x}"
        field = lambda n, v: f'--{mark}\r\nContent-Disposition: form-data; name="{n}"\r\n\r\n{v}\r\n'.encode()
        body = field("purpose", "batch")
        if expires_after is not None:
            body += field("expires_after[anchor]", "created_at") + field("expires_after[seconds]", expires_after)
        body += f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{name}.jsonl"\r\nContent-Type: application/jsonl\r\n\r\n'.encode() + content + f"\r\n--{mark}--\r\n".encode()
        return self._answered(self._object(self._call("POST", "/files", body, f"multipart/form-data; boundary={mark}")).get("id"))

    def create(self, input_file_id: str, endpoint: str, metadata: dict[str, str] | None = None, output_expires_after: int | None = None) -> dict[str, Any]:
        body: dict[str, Any] = {"input_file_id": resource_id(input_file_id), "endpoint": endpoint_path(endpoint), "completion_window": "24h"} | ({"metadata": metadata} if metadata else {})
        if output_expires_after is not None:
            if not 3600 <= output_expires_after <= 2_592_000:
                raise ValidationError("expiry must be from an hour to 30 days", value=output_expires_after)
            body["output_expires_after"] = {"anchor": "created_at", "seconds": output_expires_after}
        out = self._object(self._call("POST", "/batches", json.dumps(body).encode()))
        self._answered(out.get("id"))
        return out

    def status(self, batch_id: str) -> dict[str, Any]:
        out = self._object(self._call("GET", f"/batches/{resource_id(batch_id)}"))
        if out.get("id") != batch_id:
            raise GatewayError("the answer is about another batch")
        if not isinstance(out.get("status"), str) or not out["status"]:
            raise GatewayError("the answer has no status")
        counts = {} if out.get("request_counts") is None else out["request_counts"]
        if type(counts) is not dict:
            raise GatewayError("the counts are no object")
        n = [counts.get(k, 0) for k in ("total", "completed", "failed")]
        if any(type(x) is not int or x < 0 for x in n) or n[1] + n[2] > n[0]:
            raise GatewayError("the counts make no sense")
        done = round((n[1] + n[2]) / n[0] * 100, 2) if n[0] else 0
        return out | {"progress_percentage": done, "is_complete": out.get("status") in TERMINAL_STATUSES}

    def cancel(self, batch_id: str) -> dict[str, Any]:
        """A refusal is returned, not raised; a provider that can't be reached is an error."""
        path = f"/batches/{resource_id(batch_id)}/cancel"
        try:
            return self._object(self._call("POST", path))
        except GatewayError as e:
            if "status" not in e.details:
                raise
            return {"id": batch_id, "cancelled": False, "error": str(e)}

    def delete(self, file_id: str) -> None:
        out = self._object(self._call("DELETE", f"/files/{resource_id(file_id)}"))
        if out.get("id") != file_id or out.get("deleted") is not True:
            raise GatewayError("the file wasn't deleted", file=file_id)

    def content(self, file_id: str, most: int = FILE_BYTES) -> bytes:
        return self._call("GET", f"/files/{resource_id(file_id)}/content", most=most)

    def wait(self, batch_id: str, interval: float, deadline: float, clock: Callable[[], float] = time.monotonic) -> dict[str, Any]:
        """Ask until the batch is finished; a batch that isn't by the deadline is an error."""
        end = clock() + deadline
        while True:
            found = self.status(batch_id)
            if found["is_complete"]:
                return found
            if (left := end - clock()) <= 0:
                raise GatewayError("the batch didn't finish in time", batch=batch_id)
            self.sleep(min(interval, left))


class ProviderFiles(DataSource):
    """Format `provider_files`: options base_url, key and batch_ids (comma-separated); one task a batch."""

    @classmethod
    def name(cls) -> str:
        return "provider_files"

    def schema(self) -> str:
        return "batch_id string, file_kind string, file_id string, content string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(b) for b in self.options["batch_ids"].split(",") if b]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        provider = Provider(self.options["base_url"], self.options["key"])
        found = provider.status(partition.value)
        if not found["is_complete"]:
            raise ValidationError("the batch isn't finished", batch=partition.value)
        for kind, field in (("result", "output_file_id"), ("error", "error_file_id")):
            if file_id := found.get(field):
                yield partition.value, kind, file_id, provider.content(file_id).decode("utf-8")
