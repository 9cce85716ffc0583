"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three letters, words padded by a mark) of a
language, a document's profile the same of the document. A document's distance to a language is the sum, over its
own n-grams, of how far out of place each is in the language's list; an n-gram that the list lacks costs the
list's length. The nearest language wins, ties by code point.
"""

from __future__ import annotations

import functools
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, only, texts

#: n-grams of a profile.
PROFILE = 300
#: A text's least score to be taken for the nearest language at all; texts in other scripts score about 0.
LEAST = 0.2
#: Letters that are counted at a time.
BLOCK = 400_000
UNKNOWN = "und"


@functools.cache
def letter_symbols() -> np.ndarray:
    """A 16-bit symbol for each code point: 1 for what is no letter, else the code point (its low 16 bits)."""
    out = np.ones(0x110000, np.int64)
    for i in range(0x110000):
        if chr(i).isalpha():
            out[i] = max(2, i & 0xFFFF)
    return out


def symbols(text: str) -> np.ndarray:
    """Lower-case letters with one mark before, between and after words; empty if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    s = letter_symbols()[points]
    s = np.concatenate([[1], s, [1]])
    s = s[np.concatenate([[True], (s[1:] != 1) | (s[:-1] != 1)])]
    return s if len(s) > 1 else s[:0]


def grams(owners: list[int], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, gram, count) of symbol arrays, sorted by owner and gram. A gram packs up to three 16-bit symbols."""
    if not texts:
        return (np.empty(0, np.int64),) * 3
    keys = []
    for o, s in zip(owners, texts, strict=True):
        one, base = s, np.int64(o) << 48
        two = (s[:-1] << 16) | s[1:]
        three = (two[:-1] << 16) | s[2:]
        keys += [base | one[one != 1], base | two, base | three]
    k = np.sort(np.concatenate(keys))
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    count = np.diff(np.append(at, len(k)))
    k = k[at]
    return k >> 48, k & ((1 << 48) - 1), count


def blocks(rows: Iterator[tuple[int, str]]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows of (owner, text) in blocks of bounded size; owners of one block are below 2 ** 14."""
    owners, texts, size = [], [], 0
    for o, t in rows:
        s = symbols(t)
        if len(s):
            owners.append(o)
            texts.append(s)
            size += len(s)
        if size > BLOCK or len(owners) >= 16_000:
            yield owners, texts
            owners, texts, size = [], [], 0
    if owners:
        yield owners, texts


def learn_profiles(docs: DataFrame, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """(text, lang) -> each language's n-grams by falling count, then gram, over all rows whose lang isn't null."""
    rows = texts(docs.where("lang is not null and text is not null"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            for owners, texts in blocks((number[x], t.as_py()) for x, t in zip(langs, b.column("text"), strict=True)):
                o, g, n = grams(owners, texts)
                for i in np.unique(o):
                    held.setdefault(names[i], []).append((g[o == i], n[o == i]))
            for x, parts in held.items():
                held[x] = [_merged(parts)]
        for x, parts in held.items():
            g, n = _merged(parts)
            yield pa.record_batch([pa.array([x] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counts = materialize(rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams", compact=4)
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= profile).select("lang", "place", "gram").collect()  # `profile` rows a language
    out: dict[str, list[int]] = {}
    for r in sorted(top):
        out.setdefault(r.lang, []).append(r.gram)
    return {x: np.array(g, np.int64) for x, g in out.items()}


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return g, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)


class Profiles:
    """All languages' ranks by gram."""

    def __init__(self, learned: dict[str, np.ndarray], profile: int = PROFILE) -> None:
        self.names, self.profile = sorted(learned), profile
        self.grams = np.unique(np.concatenate([*learned.values(), np.empty(0, np.int64)]))
        self.rank = np.full((len(self.grams) + 1, len(self.names)), profile, np.int16)  # the last row: in no list
        for i, x in enumerate(self.names):
            self.rank[np.searchsorted(self.grams, learned[x]), i] = np.arange(len(learned[x]))

    def nearest(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score) of each non-empty symbol array; the score is 1 for distance 0, 0 for the greatest."""
        owner, gram, count = grams(list(range(len(texts))), texts)
        order = np.argsort((owner << 32) - count, kind="stable")
        owner, gram = owner[order], gram[order]
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
        top = place < self.profile
        owner, gram, place = owner[top], gram[top], place[top]
        at = np.searchsorted(self.grams, gram)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != gram)] = len(self.grams)
        rank = self.rank[at]
        away = np.where(rank == self.profile, self.profile, np.abs(rank - place[:, None].astype(np.int16)))
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        sums = np.add.reduceat(away, starts, axis=0, dtype=np.int64)
        best = sums.argmin(axis=1)
        most = np.diff(np.append(starts, len(owner))) * self.profile
        return best, 1.0 - sums[np.arange(len(best)), best] / most


def held_out(doc_id: Column) -> Column:
    """Documents of which nothing is learned: crc32 of the doc_id as text leaves 2 when divided by 4. A null id isn't one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, learned: dict[str, np.ndarray], profile: int = PROFILE) -> DataFrame:
    """(doc_id, text) -> (doc_id, lang_pred, score), one row per input row, from the text alone.

    A null text, one without letters, and any text if nothing was learned give `und` and score 0.
    """
    known = Profiles(learned, profile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for b in batches:
            texts = b.column("text")
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known.names:
                for at, syms in blocks((i, t.as_py() or "") for i, t in enumerate(texts)):
                    best, s = known.nearest(syms)
                    score[at] = s
                    for i, k in zip(at, best, strict=True):
                        lang[i] = known.names[k]
            yield pa.record_batch([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, learned: dict[str, np.ndarray], languages: Collection[str] | None = None, least: float = LEAST, profile: int = PROFILE) -> DataFrame:
    """docs, all columns and as they are, whose nearest profile is one of `languages` (of all learned, if None).

    Rejected are also texts too far from every profile (score below `least`: another language, or no prose) and those
    without a letter, null ones among them. If nothing was learned no language can be told apart, and every text
    with a letter stays.
    """
    known = Profiles(learned, profile)
    fine = np.array([languages is None or x in languages for x in known.names], bool)

    def told(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only()
        for texts in parts:
            keep = np.zeros(len(texts), bool)
            for at, syms in blocks((i, t or "") for i, t in enumerate(texts)):
                if known.names:
                    lang, score = known.nearest(syms)
                    keep[at] = fine[lang] & (score >= least)
                else:
                    keep[at] = True
            yield pd.Series(keep)

    told.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return texts(docs, "*").where(F.pandas_udf(told, "boolean")(F.col("text").cast("string")))
