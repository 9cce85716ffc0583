"""Byte-pair encoding and decoding with a memory-mapped word lexicon.

The most frequent words of the corpus, each with its ids, are compiled into one file: a minimal acyclic
transducer over UTF-8 bytes (suffixes are shared), whose transitions carry integer outputs that add up to the
word's number, and the ids by number. Executors get the file through Spark's file distribution and memory-map it.
A word that the lexicon lacks is merged by rank, exactly; both ways give the same ids.
"""

from __future__ import annotations

import atexit
import mmap
import os
import re
import shutil
import struct
import tempfile
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, only, texts
from .vocab import Vocabulary, vocabulary

#: The words of a stretch; letters come first because no other alternative can start with one.
WORDS = r"\p{L}+|'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\s\p{L}\p{N}]+"
#: The same for lower-case ASCII, for a quicker library.
ASCII_WORDS = r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9]+"
#: Words that the lexicon holds at most.
LEXICON_WORDS = 200_000
#: Steps per doubling of the count at which the lexicon's least frequent words are cut off.
STEPS = 16
#: Longest word, in bytes, that the lexicon takes.
LONGEST = 64
#: Chunks that a worker counts before it sends their words on, and words outside the lexicon that it keeps before it forgets them.
HELD, RARE = 400_000, 100_000
#: Characters of text that one result batch comes from, about.
OUT_CHARS = 4_000_000


def chunks(text: str) -> list[str]:
    """The text between white space. Python also splits at U+001C to U+001F, which are no white space here."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return regex.split(r"\s+", text.strip(" \t\n\r\f\v"))
    return text.split()


class Splitter:
    """Special strings, then normalisation, then words, as the tokenizer file says."""

    def __init__(self, v: Vocabulary) -> None:
        self.find, self.find_ascii = regex.compile(WORDS).findall, re.compile(ASCII_WORDS, re.ASCII).findall
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(v.special, key=len, reverse=True)) + ")")

    def words(self, text: str) -> list[str]:
        """The words of a stretch without special strings. Lower case is taken letter by letter."""
        if text.isascii():
            return self.find_ascii(text.lower())
        return self.find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def parts(self, text: str) -> list[str]:
        """Stretches and, at odd places, special strings."""
        return self.special.split(text)


def count_words(docs: DataFrame, path: str) -> DataFrame:
    """(text) -> (word, n) over all texts. Workers count before they shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        held = Counter()
        for b in batches:
            for t in b.column("text"):
                held.update(chunks(t.as_py() or ""))
            if len(held) > HELD:
                yield from flush(held)
                held = Counter()
        yield from flush(held)

    def flush(held: Counter) -> Iterator[pa.RecordBatch]:
        s, counts = Splitter(vocabulary(path)), Counter()
        for chunk, n in held.items():
            for part in s.parts(chunk)[::2]:
                for w in s.words(part):
                    counts[w] += n
        words = [w for w in counts if len(w.encode("utf-8", "surrogatepass")) <= LONGEST]
        for i in range(0, len(words), 50_000):
            some = words[i : i + 50_000]
            yield pa.record_batch([pa.array(some, pa.string()), pa.array([counts[w] for w in some], pa.int64())], names=["word", "n"])

    return texts(docs, F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(words: dict[str, list[int]]) -> bytes:
    """The lexicon file: counts of states, arcs, words, ids; then arc starts, arc targets, arc outputs, id starts, ids, finals, labels."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    coded = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in words.items())
    path: list[list] = [[False, []]]  # the open states of the word before: final, arcs
    before = b""
    for word, _ in coded:
        shared = len(os.path.commonprefix([before, word]))
        for depth in range(len(before), shared, -1):
            path[depth - 1][1].append((before[depth - 1], settle(path.pop())))
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        before = word
    for depth in range(len(before), 0, -1):
        path[depth - 1][1].append((before[depth - 1], settle(path.pop())))
    root = settle(path[0])

    below = [0] * len(states)
    starts, targets, outputs, finals, labels = array("I", [0]), array("I"), array("I"), bytearray(), bytearray()
    for i, (final, arcs) in enumerate(states):  # targets are settled before their sources
        seen = int(final)
        for label, to in arcs:
            labels.append(label)
            targets.append(to)
            outputs.append(seen)
            seen += below[to]
        below[i] = seen
        finals.append(final)
        starts.append(len(targets))
    places, ids = array("I", [0]), array("I")
    for _, x in coded:
        ids.extend(x)
        places.append(len(ids))
    head = struct.pack("<5I", len(states), len(targets), len(coded), len(ids), root)
    return head + b"".join(x.tobytes() for x in (starts, targets, outputs, places, ids)) + bytes(finals) + bytes(labels)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, m, w, i, self.root = struct.unpack_from("<5I", self.map)
        view, at = memoryview(self.map), 20
        for name, size in (("starts", n + 1), ("targets", m), ("outputs", m), ("places", w + 1), ("ids", i)):
            setattr(self, name, view[at : at + 4 * size].cast("I"))
            at += 4 * size
        self.finals, self.labels = view[at : at + n], at + n

    def get(self, word: bytes) -> list[int] | None:
        """The word's ids, or None for a word that isn't in it."""
        state, number, starts, find, labels = self.root, 0, self.starts, self.map.find, self.labels
        for i in range(len(word)):
            arc = find(word[i : i + 1], labels + starts[state], labels + starts[state + 1]) - labels
            if arc < 0:
                return None
            number += self.outputs[arc]
            state = self.targets[arc]
        return self.ids[self.places[number] : self.places[number + 1]].tolist() if self.finals[state] else None


def distribute_lexicon(docs: DataFrame, path: str, size: int = LEXICON_WORDS) -> str:
    """Compile the corpus's most frequent words, `size` at most, and hand the file to all executors.

    Words are taken from a count on: the least, of STEPS to a doubling, from which on there are at most `size`.
    """
    spark, v = docs.sparkSession, vocabulary(path)
    counts = materialize(count_words(docs, path).withColumn("step", F.floor(F.log2("n") * STEPS).cast("int")), "word-counts", compact=4)
    least, taken = None, 0
    for r in sorted(counts.groupBy("step").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.step):
        taken += r.words
        if taken > size:
            break
        least = r.step
    top = counts.where(F.col("step") >= least).select("word").toArrow().column("word").to_pylist() if least is not None else []
    data = compile_lexicon({w: v.encode_word(w) for w in top})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    folder = os.path.realpath(tempfile.mkdtemp(prefix="lexicon-"))  # the driver hands the file out from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    file = os.path.join(folder, name)
    with open(file, "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(file)
    return name


class Encoder:
    """Texts to ids and back."""

    def __init__(self, path: str, name: str) -> None:
        self.v = vocabulary(path)
        self.split, self.lexicon = Splitter(self.v), Lexicon(SparkFiles.get(name))
        self.mark = os.path.commonprefix(list(self.v.special))  # what any special string starts with
        self.held: dict[str, bytes] = {}  # words of the lexicon that came up
        self.rare: dict[str, bytes] = {}

    def word(self, w: str) -> bytes:
        """Ids of a word that isn't held: the lexicon's, else merged."""
        if (out := self.rare.get(w)) is not None:
            return out
        keep, ids = self.held, self.lexicon.get(w.encode("utf-8", "surrogatepass"))
        if ids is None:
            keep, ids = self.rare, self.v.encode_word(w)
            if len(keep) >= RARE:
                keep.clear()
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(w) <= LONGEST:  # very long words aren't kept
            keep[w] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, miss = self.held.get, self.word
        if self.mark not in text:
            return b"".join([get(w) or miss(w) for w in self.split.words(text)])
        out = []
        for i, part in enumerate(self.split.parts(text)):
            out += [struct.pack("<I", self.v.special[part])] if i % 2 else [get(w) or miss(w) for w in self.split.words(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens, special ones too, with spaces between: the file names no decoder."""
        return " ".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def transcode(docs: DataFrame, path: str, size: int = LEXICON_WORDS, decoded: bool = True) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens, ids, decoded), one row per input row; a null text is empty.

    ids holds little-endian unsigned 32-bit integers; decoded is what they decode to (null if not asked for).
    `path` names a vocabulary file that every executor can open.
    """
    name = distribute_lexicon(docs, path, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = only(("bpe", path, name), lambda: Encoder(path, name))
        for b in batches:
            doc, ids, texts, chars = [], [], [], 0
            for d, t in zip(b.column("doc_id"), b.column("text"), strict=True):
                t = t.as_py() or ""
                doc.append(d.as_py())
                ids.append(e.encode(t))
                texts.append(e.decode(ids[-1]) if decoded else None)
                chars += len(t)
                if chars > OUT_CHARS:
                    yield batch(doc, ids, texts)
                    doc, ids, texts, chars = [], [], [], 0
            yield batch(doc, ids, texts)

    def batch(doc: list, ids: list, texts: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(doc, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
