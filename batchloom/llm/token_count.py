"""Token counts by a finite-state tokenizer.

Byte-pair encoding of a piece is compiled, lazily, into a deterministic transducer over bytes. A state keeps, for
every suffix of the input that a token could start with, the last token before that suffix and how many tokens
the input before it has, relative to now. Reading a byte, exactly one token that ends here fits the token before
it (they don't merge further), so each transition has one successor and is annotated with the change of the token
count. A piece's count is the sum along its path.

Texts are read in chunks. A chunk's state map is independent of what comes before it from its first boundary of
non-space and space on, where every pre-tokenizer state meets; so a map is (text up to there, tokens from there
to the last such boundary, text after it). Maps compose associatively and a text's maps are combined in a tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, texts
from .vocab import Vocabulary, byte_letters, vocabulary

#: Pieces of a text; letters come first because only they and a space before them can start such a piece.
PIECE = r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII, for a quicker library.
ASCII_PIECE = r" ?[A-Za-z]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
CHUNK = 65_536
#: States, and pieces with their counts, that a worker keeps before it starts afresh.
MAX_STATES, MAX_PIECES = 300_000, 400_000
NONE = -1


class CountTransducer:
    """The lazily compiled transducer of one vocabulary."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.byte = {c: b for b, c in byte_letters().items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [NONE]
        for text, i in v.ids.items():
            if all(c in self.byte for c in text) and v.merge(list(text)) == [text]:
                node = 0
                for c in text:
                    node = self.children[node].setdefault(self.byte[c], len(self.children))
                    if node == len(self.children):
                        self.children.append({})
                        self.token.append(NONE)
                self.token[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, NONE, 0),)
        self.states: list[tuple[tuple[int, int, int], ...]] = [start]
        self.numbers = {start: 0}
        self.arcs: list[dict[int, tuple[int, int]]] = [{}]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: together they are not merged in any other way."""
        if a == NONE:
            return True
        if (found := self.fits.get((a, b))) is None:
            x, y = self.v.tokens[a], self.v.tokens[b]
            found = self.fits[a, b] = self.v.merge([*x, *y]) == [x, y]
        return found

    def compile_arc(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte: (next state, tokens emitted; negative where tokens merge)."""
        open_, last, delta = [], NONE, 0
        for node, before, rel in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            t = self.token[child]
            if t != NONE and last == NONE and self.compatible(before, t):
                last, delta = t, rel + 1
            if self.children[child]:
                open_.append((child, before, rel))
        if last == NONE:
            raise ValueError(f"no token ends with byte {byte}")
        key = ((0, last, 0), *((n, b, r - delta) for n, b, r in open_))
        if (to := self.numbers.get(key)) is None:
            to = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.arcs.append({})
        self.arcs[state][byte] = (to, delta)
        return to, delta

    def count(self, piece: str) -> int:
        if len(self.states) > MAX_STATES:
            self.reset()
        state = n = 0
        arcs = self.arcs
        for b in piece.encode("utf-8", "surrogatepass"):
            arc = arcs[state].get(b) or self.compile_arc(state, b)
            state = arc[0]
            n += arc[1]
        return n


class PieceCounts(dict):
    """Counts of the pieces met lately; a new piece runs through the transducer."""

    def __init__(self, transducer: CountTransducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> int:
        if len(self) >= MAX_PIECES:
            self.clear()
        n = self[piece] = self.transducer.count(piece)
        return n


@dataclass(frozen=True)
class StateMap:
    """What a chunk does, whatever state it is entered in. closed: it holds a boundary; else `head` is all of it."""

    head: str
    closed: bool = False
    n: int = 0
    tail: str = ""


class Counter:
    """Token counts of texts, chunk by chunk."""

    def __init__(self, path: str) -> None:
        v = vocabulary(path)
        self.pieces = PieceCounts(CountTransducer(v))
        self.find, self.find_ascii = regex.compile(PIECE).findall, re.compile(ASCII_PIECE, re.ASCII).findall
        self.boundary = regex.compile(r"(?<=\S)(?=\s)")
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(v.special, key=len, reverse=True))) if v.special else None

    def count(self, text: str) -> int:
        """Tokens of a stretch between boundaries; special strings count one each."""
        parts = self.special.split(text) if self.special else [text]
        get = self.pieces.__getitem__
        return len(parts) - 1 + sum(sum(map(get, (self.find_ascii if p.isascii() else self.find)(p))) for p in parts)

    def map_of(self, chunk: str) -> StateMap:
        first = self.boundary.search(chunk)
        if first is None:
            return StateMap(chunk)
        i = first.start()
        j = next(m.start() for m in regex.finditer(r"(?r)(?<=\S)(?=\s)", chunk))
        return StateMap(chunk[:i], True, self.count(chunk[i:j]), chunk[j:])

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if not a.closed and not b.closed:
            return self.cut(StateMap(a.head + b.head))
        if not a.closed:
            return self.cut(StateMap(a.head + b.head, True, b.n, b.tail), "head")
        if not b.closed:
            return self.cut(StateMap(a.head, True, a.n, a.tail + b.head), "tail")
        return StateMap(a.head, True, a.n + self.count(a.tail + b.head) + b.n, b.tail)

    def cut(self, m: StateMap, side: str = "") -> StateMap:
        """Boundaries that the seam of two chunks has made are used at once."""
        seam = self.map_of(m.tail if side == "tail" else m.head)
        if not seam.closed:
            return m
        if side == "tail":
            return StateMap(m.head, True, m.n + self.count(seam.head) + seam.n, seam.tail)
        if side == "head":
            return StateMap(seam.head, True, seam.n + self.count(seam.tail) + m.n, m.tail)
        return seam

    def tokens(self, text: str, chunk: int = CHUNK) -> int:
        """All tokens of a text: the maps of its chunks, composed in a tree."""
        if len(text) <= chunk:
            return self.count(text)
        maps = [self.map_of(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        m = maps[0]
        return self.count(m.head) + m.n + self.count(m.tail) if m.closed else self.count(m.head)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, n_tokens, over_limit), one row per input row; a null text is empty.

    `path` names a byte-level vocabulary file that every executor can open. Special strings inside a text are
    special tokens, as is the library's default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = only(("counts", path), lambda: Counter(path))
        for b in batches:
            n = [c.tokens(t.as_py() or "") for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
