"""Byte-pair vocabularies read from a tokenizers .json file, and the plain merge procedure."""

from __future__ import annotations

import functools
import json
from heapq import heapify, heappop, heappush


#: Symbols from which on a heap finds the next merge; below, looking at all pairs is quicker.
LONG = 48


@functools.cache
def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, else the next after U+00FF."""
    out, spare = {}, 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Vocabulary:
    """Token strings, their ids, merge ranks, special tokens and the mark that ends a word."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rank: dict[tuple[str, str], int] = {m: i for i, m in enumerate(merges)}
        self.suffix: str = model["end_of_word_suffix"] or ""
        named = self.ids | self.special
        self.tokens: list[str] = [""] * (max(named.values()) + 1)
        for t, i in named.items():
            self.tokens[i] = t
        self._letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})

    def letters(self, word: str) -> str:
        """The byte letters of a word's UTF-8 form."""
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._letters)

    def merge(self, symbols: list[str]) -> list[str]:
        """Join the adjacent pair of lowest rank, leftmost first, until no pair has a rank."""
        if len(symbols) >= LONG:
            return self.merge_long(symbols)
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def merge_long(self, symbols: list[str]) -> list[str]:
        """The same in n log n steps: a heap of the pairs that have a rank, and links over what was joined."""
        rank, n = self.rank.get, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := rank(p)) is not None]
        heapify(heap)
        out: list[str | None] = list(symbols)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if out[i] is None or j >= n or rank((out[i], out[j])) != r:
                continue  # one of the two was joined to another meanwhile
            out[i], out[j] = out[i] + out[j], None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := rank((out[i], out[k]))) is not None:
                    heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := rank((out[h], out[i]))) is not None:
                heappush(heap, (s, h))
        symbols[:] = [s for s in out if s is not None]
        return symbols

    def encode_word(self, word: str) -> list[int]:
        """Ids of one piece that pre-tokenization has cut out."""
        letters = list(self.letters(word))
        letters[-1] += self.suffix
        return [self.ids[s] for s in self.merge(letters)]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
