"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND with every passage.

Items are indexed by Spark: counts of terms, document frequencies, number and mean length are those of the whole benchmark.
Impacts are divided by an item's score for its own text, so one threshold holds for all items: a passage retrieves the items
of which it has at least RETRIEVE of the BM25 weight. Items of up to SHORT words form one index, those of up to eight times as
many the next, and so on. Documents are cut into overlapping passages of 2L words at steps of L, L being the longest item of an
index or LEAST, so that any run of L words lies whole in one passage. Every passage is a query of its distinct terms.

The postings of each term are cut into blocks of BLOCK items with their largest impact, kept for the blocks that hold the term
only; a block whose bound for a passage stays below the threshold is skipped unread, for all passages of a batch at once, and
what is left is searched by WAND with cursors, pivots and block bounds. The most frequent terms, which no item owes more than
COMMON of its score, enter those first bounds as one number for each block.

A retrieved item is a leak if OVERLAP of its five-word shingles occur in the passage, or OVERLAP of its question's and of
its answer's. An item's answer is its last sentence, the question what comes before it; an item of a single sentence is
all question. Parts of fewer than five words count as one shingle. The overlaps of question and answer are reported.

The postings are broadcast while the items' texts are no more than ITEM_BYTES together; a larger benchmark is searched in
parts of that size, one after the other, with the same result. Items without a word are never leaked, nor are those with a
null item_id, which can't be reported. Null and empty texts have no passage; a null doc_id is reported like any other;
repeated rows report alike; items that repeat are reported once for each item_id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, documents, map_batches, materialise, offsets, texts
from .toxicity import by_size

K1, B, BLOCK, RETRIEVE, OVERLAP, SHINGLE, LEAST, COMMON = 0.9, 0.4, 8, 0.6, 0.8, 5, 32, 0.2
#: Bytes of items searched at a time, words of the items of the first index, block entries added up at a time.
ITEM_BYTES, SHORT, CELLS = 8 << 20, 256, 1_000_000
_STRIP = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def term(word: bytes) -> str:
    """A word's letters and digits in lower case."""
    return _STRIP.sub("", word.decode("utf-8", "replace").lower())


def shingles(words: list) -> set[tuple]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def parsed(text: str | None) -> tuple[list[str], list[str]]:
    """The terms of an item's question and of its answer."""
    sentences = _SENTENCE.split((text or "").strip())
    q, a = (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (sentences[0], "")
    q, a = ([w for x in s.encode().split() if (w := term(x))] for s in (q, a))
    return q, a


def parsed_items(benchmark: DataFrame) -> DataFrame:
    """at (a number for each row), item_id, bytes, words, question (how many of the words) of the items with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [parsed(t) for t in batch.column("text").to_pylist()]
            cols = [pa.array([q + a for q, a in both], pa.list_(pa.string())), pa.array([len(q) for q, _ in both], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([len(t) for t in texts(batch)], pa.int64()), *cols], names=["item_id", "bytes", "words", "question"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    found = map_batches(items, run, "item_id long, bytes long, words array<string>, question int").where("size(words) > 0")
    return materialise(found.select(F.monotonically_increasing_id().alias("at"), "*"))


def postings(items: DataFrame) -> DataFrame:
    """at, term, share: the BM25 impact of each term of each item, as a share of the item's own score."""
    n, mean = items.agg(F.count("*"), F.coalesce(F.avg(F.size("words")), F.lit(1.0))).first()
    f = items.select("at", F.size("words").alias("size"), F.explode("words").alias("term")).groupBy("at", "size", "term").agg(F.count("*").alias("f"))
    df = f.groupBy("term").agg(F.count("*").alias("df"))
    impact = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / mean))
    scored = f.join(df, "term").select("at", "term", impact.alias("impact"))
    return scored.select("at", "term", (F.col("impact") / F.sum("impact").over(Window.partitionBy("at"))).alias("share"))


class Index:
    """Postings in order of term and item; blocks of BLOCK items with their largest share, for each term that they hold."""

    def __init__(self, items: list[tuple[int, list[str], int]], found: list[tuple[str, int, float]]):
        """items: item_id, words, how many of them are the question; found: term, place of the item, share."""
        self.items = [(i, words, shingles(words[:q]), shingles(words[q:])) for i, words, q in items]
        found = sorted(found)
        self.terms = {w: t for t, w in enumerate(dict.fromkeys(w for w, _, _ in found))}
        term_of = np.array([self.terms[w] for w, _, _ in found], np.int64)
        self.item, self.share = np.array([i for _, i, _ in found], np.int64), np.array([x for _, _, x in found])
        self.start = np.searchsorted(term_of, np.arange(len(self.terms) + 1))
        self.n_blocks = -(-len(items) // BLOCK)
        key = term_of * self.n_blocks + self.item // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.block, self.most = key[first] % max(1, self.n_blocks), np.maximum.reduceat(self.share, first) * (1 + 1e-9) if len(key) else self.share
        self.block_start = np.searchsorted(first, self.start)
        self.top = np.maximum.reduceat(self.most, self.block_start[:-1]) if len(key) else self.share
        # the most frequent terms, as long as no item owes them more than COMMON of its score: what all of them together may
        # add to a block's items is one number, and only the other terms are looked up for every passage
        share, self.common = np.zeros(max(len(items), 1)), np.zeros(len(self.terms), bool)
        for t in np.argsort(-np.diff(self.start), kind="stable"):
            own = slice(self.start[t], self.start[t + 1])
            if (share[self.item[own]] + self.share[own]).max() > COMMON:
                break
            share[self.item[own]] += self.share[own]
            self.common[t] = True
        self.spare = np.maximum.reduceat(share, np.arange(0, len(share), BLOCK)) * (1 + 1e-9)
        self.longest = max([LEAST, *(len(x[1]) for x in self.items)])

    def wand(self, query: list[int], open_blocks: set[int]) -> list[tuple[int, float]]:
        """All items whose shares over the query's terms add up to RETRIEVE, by document-at-a-time search with block bounds."""
        cursors = [[int(self.start[t]), int(self.start[t + 1]), float(self.top[t])] for t in query]  # place, end, bound
        out = []
        while cursors:
            cursors.sort(key=lambda c: self.item[c[0]])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[2]
                if bound >= RETRIEVE:
                    pivot = int(self.item[c[0]])
                    break
            if pivot is None:
                break
            block = pivot // BLOCK
            if block not in open_blocks:
                target = (block + 1) * BLOCK  # the bound of the whole block is too low
            elif self.item[cursors[0][0]] == pivot:
                score = float(sum(self.share[c[0]] for c in cursors if self.item[c[0]] == pivot))
                if score >= RETRIEVE:
                    out.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for c in cursors:
                if self.item[c[0]] < target:
                    c[0] += int(np.searchsorted(self.item[c[0] : c[1]], target))
            cursors = [c for c in cursors if c[0] < c[1]]
        return out

    def bounds(self, passage: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, block, bound) of the blocks a passage may retrieve from; passage, t: distinct terms of passages, in order."""
        if not len(t):
            return t, t, np.zeros(0)
        n = self.block_start[t + 1] - self.block_start[t]
        cut, out = [0, *np.flatnonzero(np.diff(passage)) + 1, len(passage)], []
        ends = offsets(n)
        i = 0
        while i < len(cut) - 1:
            # whole passages, of about CELLS block entries together
            j = max(i + 1, int(np.searchsorted(ends[cut], ends[cut[i]] + CELLS, side="right")) - 1)
            own, m = slice(cut[i], cut[j]), n[cut[i] : cut[j]]
            at = np.repeat(self.block_start[t[own]] - offsets(m)[:-1], m) + np.arange(m.sum())
            first = passage[cut[i]]
            key = np.repeat(passage[own] - first, m) * self.n_blocks + self.block[at]
            size = int(passage[cut[j] - 1] - first + 1) * self.n_blocks
            if size <= 8 * CELLS:
                total, place = np.bincount(key, self.most[at], size), np.arange(size)
            else:
                place, inverse = np.unique(key, return_inverse=True)
                total = np.bincount(inverse, self.most[at], len(place))
            hit = np.flatnonzero(total + self.spare[place % self.n_blocks] >= RETRIEVE)
            out.append((place[hit] // self.n_blocks + first, place[hit] % self.n_blocks, total[hit]))
            i = j
        p, b, x = (np.concatenate(y) for y in zip(*out, strict=True))
        return p, b, x + self.spare[b]

    def search(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """words: term ids (-1: in no item) of some texts, which begin at bounds. (text, first word, end, item, score) of what is retrieved."""
        size, text, start, end = 2 * self.longest, [], [], []
        for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            s = np.arange(a, max(a + 1, b - self.longest), self.longest) if b > a else np.zeros(0, np.int64)
            text.append(np.full(len(s), d)), start.append(s), end.append(np.minimum(s + size, b))
        text, start, end = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (text, start, end))
        rare = np.flatnonzero((words >= 0) & ~self.common[words]) if len(self.terms) else np.zeros(0, np.int64)
        lo, hi = np.searchsorted(rare, start), np.searchsorted(rare, end)
        passage = np.repeat(np.arange(len(start)), hi - lo)
        at = rare[np.arange(len(passage)) - np.repeat(offsets(hi - lo)[:-1], hi - lo) + np.repeat(lo, hi - lo)]
        key = np.unique(passage * np.int64(len(self.terms) + 1) + words[at])
        p, block, _ = self.bounds(key // (len(self.terms) + 1), key % (len(self.terms) + 1))
        out, cut = [], np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]])) if len(p) else np.zeros(1, np.int64)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            query = np.unique(words[start[p[a]] : end[p[a]]])
            for item, score in self.wand(query[query >= 0].tolist(), set(block[a:b].tolist())):
                out.append((int(text[p[a]]), int(start[p[a]]), int(end[p[a]]), item, score))
        return out


def length_class(size: int) -> int:
    k = 0
    while size > SHORT * 8**k:
        k += 1
    return k


def indexes(items: list, found: list) -> list[Index]:
    """items: rows (at, item_id, words, question); found: rows (at, term, share). An index for each class of lengths."""
    out, at = {}, {}
    for r in sorted(items, key=lambda r: (r.item_id, r.at)):
        own = out.setdefault(length_class(len(r.words)), ([], []))
        at[r.at] = own, len(own[0])
        own[0].append((r.item_id, list(r.words), r.question))
    for r in found:
        own, place = at[r.at]
        own[1].append((r.term, place, r.share))
    return [Index(*own) for _, own in sorted(out.items())]


def overlap(part: set[tuple], passage: set[tuple], words: list) -> float:
    """Share of a part's shingles in the passage; a part of fewer than SHINGLE words is looked for as it is."""
    if not part:
        return 1.0
    short = next(iter(part))
    if len(short) < SHINGLE:
        return float(any(tuple(words[i : i + len(short)]) == short for i in range(len(words) - len(short) + 1)))
    return len(part & passage) / len(part)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: the best passage of each document and leaked item."""
    items = parsed_items(benchmark)
    shares = postings(items)
    size = items.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / ITEM_BYTES))
    if parts > 1:
        shares = materialise(shares)
    out = None
    for part in range(parts):
        own, weights = (x.where(F.pmod(F.xxhash64("at"), F.lit(parts)) == part) for x in (items, shares))
        found = search(docs, indexes(own.collect(), weights.collect()))  # ITEM_BYTES of text and their terms
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def search(docs: DataFrame, index: list[Index]) -> DataFrame:
    """A row for each passage that leaks an item."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # ITEM_BYTES of items at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def coder(terms: dict[str, int]) -> Memo:
            return Memo(lambda w: terms.get(x, -1) if (x := term(w)) else -2, 200_000)

        ids = [coder(x.terms) for x in shared.value]
        for batch in batches:
            names, rows, done = batch.column("doc_id").to_pylist(), [], 0
            for group in by_size(texts(batch), 1_000_000):
                own, done = names[done : done + len(group)], done + len(group)
                split = [t.split() for t in group]
                for index, memo in zip(shared.value, ids, strict=True):
                    coded = []
                    for w in split:
                        x = np.fromiter(map(memo.__getitem__, w), np.int64, len(w))
                        coded.append((x, np.flatnonzero(x > -2)))  # words without a letter or digit are no terms
                    bounds = offsets([len(k) for _, k in coded])
                    words = np.concatenate([np.zeros(0, np.int64), *(x[k] for x, k in coded)])
                    for d, a, b, item, score in index.search(words, bounds):
                        passage = [term(split[d][i]) for i in coded[d][1][a - bounds[d] : b - bounds[d]]]
                        item_id, whole, q, ans = index.items[item]
                        s = shingles(passage)
                        x, y = overlap(q, s, passage), overlap(ans, s, passage)
                        if x >= OVERLAP and y >= OVERLAP or overlap(shingles(whole), s, passage) >= OVERLAP:
                            rows.append((own[d], item_id, score, x, y))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return map_batches(documents(docs), run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with all their columns; rows without a doc_id stay."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
