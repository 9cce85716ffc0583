from __future__ import annotations

import random

import pytest

#: doc_id, text, lang, source, n_chars, and columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, rep string, node int, component string, words int, size string, p string, u string, kind string, seed string, start string, doc string, hashes int, key_ string, rows_ int, copies_ string, row_key_ string, cut_doc_ int, passage_id_ string, row_ string, mixed_ int, shared int, kept string, lang_ string"
EXTRA = (1, "x", 2, "y", 3, "z", "q", "w", "e", "r", "t", "d", 9, "k", 7, "c", "r", 5, "p", "o", 6, 8, "n", "l")


def prose(seed: int, n: int = 120) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


def documents(spark, texts, lang="en", source="s"):
    """Rows of (text or (doc_id, text)) with clashing extra columns."""
    rows = [(*(t if isinstance(t, tuple) else (i, t)),) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), *EXTRA) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, spaces, punctuation, a very long text, repeated rows, null ids."""
    long_ = " ".join(prose(i, 200) for i in range(60))
    return documents(spark, [(1, None), (2, ""), (3, " \n\t "), (4, "..!?"), (5, long_), (6, "short text"), (6, "short text"), (7, "é" * 30), (None, "no id here"), (8, "\x1c\x85\u3000 mixed \x00 control")])


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])
