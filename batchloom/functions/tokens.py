"""Token counts of request columns. A tokenizer is a function from a string column to a count column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ValidationError

Tokenizer = Callable[[Column], Column]


def whitespace_tokens(text: Column) -> Column:
    """Words between ASCII white space; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\x0b\f]+")), F.lit(0)).cast("long")


def vocabulary_tokens(path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()) -> Tokenizer:
    """Counts by a rank file (base64 token and rank a line) that executors can open; special strings count as one."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
        for s in parts:
            yield s.map(lambda t: len(coder.encode(t, allowed_special="all")) if t else 0)

    return count


class Tokenizers:
    """Tokenizers by name. An unknown name is an error, never another tokenizer."""

    def __init__(self) -> None:
        self._known: dict[str, Tokenizer] = {"whitespace": whitespace_tokens}

    def register(self, name: str, tokenizer: Tokenizer) -> None:
        self._known[name] = tokenizer

    def get(self, name: str) -> Tokenizer:
        if name not in self._known:
            raise ValidationError("unknown tokenizer", name=name)
        return self._known[name]

    def by_model(self, text: Column, tokenizer_model: Column, model: Column) -> Column:
        """Counts of a text by its model's tokenizer: by its tokenizer's name, else by the model's own. None is an error."""
        name = F.coalesce(F.when(F.trim(tokenizer_model) != "", F.trim(tokenizer_model)), model)
        out = None
        for known in self.available():  # each tokenizer sees its own rows' texts alone
            count = self._known[known](F.when(name == known, text))
            out = F.when(name == known, count) if out is None else out.when(name == known, count)
        return out.otherwise(F.raise_error(F.concat(F.lit("unknown tokenizer: "), F.coalesce(name, F.lit("none")))).cast("long"))

    def available(self) -> list[str]:
        return sorted(self._known)


def request_tokens(system: Column, user: Column, tokenizer: Tokenizer = whitespace_tokens) -> dict[str, Column]:
    """system_tokens, user_tokens and total_tokens of a request."""
    s, u = tokenizer(system), tokenizer(user)
    return {"system_tokens": s, "user_tokens": u, "total_tokens": s + u}
