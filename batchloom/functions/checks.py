"""Grammars, vocabularies and small conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ENDPOINTS, REMOTE_STATUSES, RETRY_STATUSES, TERMINAL_STATUSES

RESOURCE_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,255}\z"
SCOPE = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z"
#: Fixed: the first segment of a path has no dots.
ENDPOINT_PATH = r"^/[A-Za-z0-9_~-]+(?:/[A-Za-z0-9._~-]+){0,15}\z"
GATEWAY_URL = r"^(?i:https?)://(?:\[[0-9A-Fa-f:.]+\]|[^/:@?#\s\\]+)(?::[0-9]{1,5})?(?:/[^?#\s\\@]*)?\z"
UUID = r"^[0-9A-Fa-f]{8}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{12}\z"
NUL = "\x00"


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_resource_id(c: Column) -> Column:
    return _true(c.rlike(RESOURCE_ID))


def is_scope(c: Column) -> Column:
    """Tenant and consumer names."""
    return _true(c.rlike(SCOPE))


def is_uuid(c: Column) -> Column:
    return _true(c.rlike(UUID))


def clean_alias(c: Column) -> Column:
    """A trimmed endpoint alias; null if it is empty, longer than 128 characters or has a NUL."""
    t = F.regexp_replace(c, r"^[\s]+|[\s]+\z", "")
    return F.when((t != "") & (F.length(t) <= 128) & (F.instr(t, NUL) == 0), t)


def is_exact_alias(c: Column) -> Column:
    return _true(clean_alias(c) == c)


def is_endpoint_path(c: Column) -> Column:
    """1 to 16 segments, 256 characters at most, no dot segments."""
    parts = F.split(c, "/", -1)
    return _true(c.rlike(ENDPOINT_PATH) & (F.length(c) <= 256) & F.forall(parts, lambda p: (p != ".") & (p != "..")))


def is_known_endpoint(c: Column) -> Column:
    return _true(c.isin(*ENDPOINTS))


def known_status(c: Column) -> Column:
    """The status, `unknown` for null or empty, and null for what isn't in the vocabulary."""
    return F.when(F.coalesce(c, F.lit("")) == "", "unknown").when(c.isin(*REMOTE_STATUSES), c)


def is_terminal(c: Column) -> Column:
    return _true(c.isin(*TERMINAL_STATUSES))


def optional_text(c: Column) -> Column:
    return F.when((c != "") & (F.instr(c, NUL) == 0), c)


def is_gateway_url(c: Column) -> Column:
    """http(s) without user, query, fragment, white space, backslash or port 0; plain http for loopback hosts alone."""
    host = F.lower(F.regexp_extract(c, r"^(?i:https?)://(\[[^\]/]*\]|[^/:]*)", 1))
    port = F.regexp_extract(c, r"^(?i:https?)://(?:\[[^\]/]*\]|[^/:]*):([0-9]*)", 1)
    local = host.isin("localhost", "[::1]") | host.rlike(r"^127(?:\.[0-9]{1,3}){3}\z")
    shape = c.rlike(GATEWAY_URL)
    fine_port = (port == "") | F.coalesce(port.try_cast("int").between(1, 65535), F.lit(False))
    return _true(shape & fine_port & (c.rlike(r"^(?i:https)://") | local))


def clean_gateway_url(c: Column) -> Column:
    """Scheme in lower case, no slash at the end; null if it isn't fine."""
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z]+)://", 1))
    return F.when(is_gateway_url(c), F.concat(scheme, F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]+", ""), r"/+\z", "")))


def progress_percentage(total: Column, completed: Column, failed: Column) -> Column:
    """Finished share with two digits (half up), 0 without a total; null where more is finished than there is."""
    done = completed + failed
    return F.when(total == 0, F.lit(0.0)).when(done <= total, F.round(done / total * 100, 2))


def retry_after_seconds(header: Column, now: Column) -> Column:
    """ASCII digits are seconds, an HTTP date the time until then (0 if past), anything else null."""
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(header, r"^[A-Za-z]{3}, ", ""), r" GMT\z", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    until = F.greatest(F.lit(0.0), F.unix_micros(date) / 1e6 - F.unix_micros(now) / 1e6)
    return F.when(header.rlike(r"^[0-9]{1,15}\z"), header.try_cast("double")).when(header.rlike(r"^[A-Za-z]{3}, .* GMT\z"), until)


def backoff_ceiling(attempt: Column, base: float = 0.5, most: float = 30.0) -> Column:
    """The longest wait before a further attempt; the least is half of it."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def should_retry(method: Column, status: Column, attempt: Column, retry_after: Column, attempts: int = 3, most: float = 30.0) -> Column:
    """GET alone, for passing failures, while attempts are left and the server doesn't ask for a longer wait."""
    return _true((method == "GET") & status.isin(*RETRY_STATUSES) & (attempt < attempts) & (F.coalesce(retry_after, F.lit(0.0)) <= most))


def payload_id(batch: Column, part: Column) -> Column:
    """file_ and 32 hex digits that depend on batch and part alone."""
    return F.concat(F.lit("file_"), F.md5(F.concat_ws("/", batch, part.cast("string")).cast("binary")))


def lock_key(uuid: Column) -> Column:
    """The last 63 bits of a UUID."""
    low = F.right(F.regexp_replace(uuid, "-", ""), F.lit(16))
    return F.conv(low, 16, -10).cast("long").bitwiseAND(F.lit((1 << 63) - 1))


def flight_key(domain: bytes, *fields: Column) -> Column:
    """A signed 64-bit key of length-prefixed fields: the first 8 bytes, big-endian, of their SHA-256."""
    parts = [F.lit(bytearray(domain))]
    for f in fields:
        raw = f.cast("binary")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(raw)), 16, "0")), raw]
    return F.conv(F.substring(F.sha2(F.concat(*parts), 256), 1, 16), 16, -10).cast("long")


#: Fixed names of failures that reports may show.
FAILURES = ("timeout", "connection", "rate_limited", "unauthorized", "not_found", "invalid_response", "conflict")


def failure_name(c: Column, known: tuple[str, ...] = FAILURES) -> Column:
    """A failure by name; what isn't in the vocabulary is _OTHER, null stays null."""
    return F.when(c.isin(*known), c).when(c.isNotNull(), "_OTHER")
