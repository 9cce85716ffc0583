"""Request lines in JSON, spaced like Python's json.dumps, so that byte sizes agree with it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHAT_URL, EMBEDDING_URL = "/v1/chat/completions", "/v1/embeddings"


def json_text(value: Column) -> Column:
    """A string as a JSON literal, null as null; letters beyond ASCII stay as they are."""
    inner = F.to_json(F.array(value))
    inner = F.substring(inner, F.lit(2), F.length(inner) - 2)
    lower = inner  # Spark writes the hex digits of control characters in upper case
    for c in "ABCDEF":
        lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u00([01]){c}", rf"$1\\u00$2{c.lower()}")
    return F.when(value.isNull(), "null").when(inner.rlike(r"\\u00[01][A-F]"), lower).otherwise(inner)


def is_embedding(mode: Column) -> Column:
    return F.coalesce(F.lower(F.trim(mode)) == "embedding", F.lit(False))


def request_line(custom_id: Column, model: Column, mode: Column, system: Column, user: Column) -> Column:
    """Any mode but embedding is chat. Chat has a system message only if that prompt isn't empty, and null users are empty."""
    head = lambda url: F.concat(F.lit('{"custom_id": '), json_text(custom_id), F.lit(f', "method": "POST", "url": "{url}", "body": {{"model": '), json_text(model))
    message = lambda role, text: F.concat(F.lit(f'{{"role": "{role}", "content": '), json_text(text), F.lit("}"))
    system_part = F.when(F.coalesce(system, F.lit("")) != "", F.concat(message("system", system), F.lit(", "))).otherwise("")
    chat = F.concat(head(CHAT_URL), F.lit(', "messages": ['), system_part, message("user", F.coalesce(user, F.lit(""))), F.lit("]}}"))
    embedding = F.concat(head(EMBEDDING_URL), F.lit(', "input": '), json_text(user), F.lit("}}"))
    return F.when(is_embedding(mode), embedding).otherwise(chat)


def line_bytes(line: Column) -> Column:
    """UTF-8 bytes of a line and its newline."""
    return (F.octet_length(line) + 1).cast("long")
