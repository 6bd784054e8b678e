"""n-grams of documents as hashes: words are cut and hashed in batches within the tasks, Spark deals them out and counts them.

A word's hash is made once a task for each of the words met last; an n-gram is two longs made of its words' hashes, 127 bits
in all, of which two alike are not to be expected in any corpus. Texts are lower-cased by Spark; words are those of text.WORD.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Rows and bytes of one batch of texts, and words whose hashes a task holds.
BATCH_ROWS, BATCH_BYTES, HELD = 1000, 8 << 20, 400_000
#: Rows of a batch of short texts.
BATCH_TEXTS = 1 << 16
#: What stands for a null doc_id, which comes before all others.
NO_ID = -(1 << 63)
_WORD = re.compile(T.WORD)
#: Bytes in lower case, and letters beyond ASCII that are, or begin with, one of its letters there.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII_BELOW = "\u212a\u0130"


class WordHashes(dict):
    """word -> 63 bits of its hash, and a last bit that is set for stop words."""

    def __init__(self, stop: list[str]):
        super().__init__()
        self.stop = frozenset(stop)

    def __missing__(self, word: str) -> int:
        if len(self) >= HELD:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word) & ~1 | (word in self.stop)
        return out

    def of(self, words: Iterable[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_keys(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two keys of each n-gram of these words with fewer than n - 1 stop words, and where it begins; doc: the document of each word, for none crosses two.

    The last bit of the second key is 0 for n = 2 and 1 for others.
    """
    m = max(0, len(h) - n + 1)
    a, b, stops = np.full(m, n, np.uint64), np.full(m, n + 7919, np.uint64), np.zeros(m, np.uint64)
    for k in range(n):
        w = h[k : k + m]
        a, b = mix((a ^ w) * np.uint64(0x9E3779B97F4A7C15)), mix((b + w) * np.uint64(0xD6E8FEB86659FD93))
        stops += w & np.uint64(1)
    some = (stops < n - 1) & (doc[:m] == doc[len(doc) - m :])
    return a[some], b[some] & ~np.uint64(1) | np.uint64(n != 2), np.flatnonzero(some)


def gram_hashes(docs: DataFrame, sizes: tuple[int, ...], stop: list[str], ids: bool = False) -> DataFrame:
    """profile, a, b, n: n-grams of these sizes within documents, by two keys; a row for most of those that are alike in a batch.

    sizes: 2 and one other at most. Rows of one n-gram are to be added up. ids: with doc_id, the least that has it, NO_ID for null.
    """
    names = ["profile", "a", "b", "n"] + ["doc_id"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(stop)
        for batch in batches:
            of: dict = {}
            for i, (p, t) in enumerate(zip(batch.column("profile").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                of.setdefault(p, []).append((i, _WORD.findall(t or "")))
            own = batch.column("doc_id").fill_null(NO_ID).to_numpy() if ids else None
            for p, rows in of.items():
                at, texts = zip(*rows, strict=True)
                h = hashes.of(chain.from_iterable(texts))
                doc = np.repeat(np.array(at), [len(t) for t in texts])
                a, b, begin = (np.concatenate(x) for x in zip(*[gram_keys(h, doc, n) for n in sizes], strict=True))
                order = np.argsort(a)
                a, b = a[order], b[order]
                first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
                name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(first), np.int32)), pa.array([p], pa.string())).cast(pa.string())
                cols = [name, pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)), pa.array(np.diff(np.append(first, len(a))))]
                if ids:
                    cols.append(pa.array(np.minimum.reduceat(own[doc[begin[order]]], first) if len(first) else own[:0]))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return in_batches(docs, *["doc_id"] * ids).mapInArrow(run, "profile string, a long, b long, n long" + ", doc_id long" * ids)


def gram_places(docs: DataFrame, n: int, stop: list[str]) -> DataFrame:
    """profile, doc_id, a, b, at, phrase of every n-gram within documents. docs: profile, doc_id, text, first (the place of a text's first word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(stop)
        for batch in batches:
            for p, i, at, t in zip(*(batch.column(c).to_pylist() for c in ("profile", "doc_id", "first", "text")), strict=True):
                w = _WORD.findall(t or "")
                a, b, begin = gram_keys(hashes.of(w), np.zeros(len(w), np.int64), n)
                phrases = [" ".join(w[j : j + n]) for j in begin.tolist()]
                cols = [pa.array([p] * len(a), pa.string()), pa.array([i] * len(a), pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(begin + at), pa.array(phrases, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["profile", "doc_id", "a", "b", "at", "phrase"])

    return in_batches(docs, "doc_id", "first").mapInArrow(run, "profile string, doc_id long, a long, b long, at long, phrase string")


def word_edges(docs: DataFrame, n: int) -> DataFrame:
    """profile, doc_id, n (how many words), head, tail: the first and last n words of each document that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_WORD.findall(t or "") for t in batch.column("text").to_pylist()]
            cols = [batch.column("profile"), batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), *(pa.array(x, pa.list_(pa.string())) for x in ([w[:n] for w in words], [w[-n:] for w in words]))]
            yield pa.RecordBatch.from_arrays(cols, names=["profile", "doc_id", "n", "head", "tail"])

    return in_batches(docs, "doc_id").mapInArrow(run, "profile string, doc_id long, n long, head array<string>, tail array<string>").where("n > 0")


def lowered(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings with A-Z in lower case, eight zeros after them, and where each string begins and the last one ends.

    Of other letters, those that have an ASCII letter in their lower case are brought to it.
    """
    strings = strings.cast(pa.string())
    _, ends, data = strings.buffers()
    at = np.frombuffer(ends or bytes(4), np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = bytes(memoryview(data)[at[0] : at[-1]]) if data else b""
    if any(x.encode() in raw for x in _ASCII_BELOW):
        return lowered(pa.array([x and x.lower() for x in strings.to_pylist()], pa.string()))
    return _LOWER[np.frombuffer(raw + bytes(8), np.uint8)], at - at[0]


def tokens_in(strings: pa.Array, marks: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the longest runs of `marks` (ASCII) in each lower-cased string, the string of each, and how many a string has."""
    data, at = lowered(strings)
    begin, end = _runs(data, at, marks)
    n = np.diff(np.searchsorted(begin, at))
    return _hashes(data, begin, end), np.repeat(np.arange(len(n)), n), n


def _runs(data: np.ndarray, at: np.ndarray, marks: str) -> tuple[np.ndarray, np.ndarray]:
    table = np.zeros(256, bool)
    table[list(marks.encode())] = True
    there = table[data]
    before, after = np.append(False, there[:-1]), np.append(there[1:], False)
    before[at], after[at[1:] - 1] = False, False  # no run goes on in another string
    return np.flatnonzero(there & ~before), np.flatnonzero(there & ~after) + 1


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each of these runs of bytes, eight of them at a time; runs of eight bytes or fewer without zeros have one each."""
    eight = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    h, left, on = np.zeros(len(begin), np.uint64), end - begin, np.arange(len(begin))
    while len(on):
        some = np.minimum(left[on], 8).astype(np.uint64)
        x = eight[begin[on]] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * some))
        h[on] = mix((h[on] ^ x) * np.uint64(0x9E3779B97F4A7C15))
        left[on] -= 8
        on = on[left[on] > 0]
        begin = begin + 8
    return h


def in_batches(docs: DataFrame, *keep: str) -> DataFrame:
    """The lower-cased texts, to be read in batches of bounded size."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs.select("profile", *keep, F.lower("text").alias("text"))
