"""Substring deduplication by fixed-block anchors.

A window is `WINDOW` consecutive words of a document. Each word is removed that a window covers whose words also start in a
document with a smaller doc_id. A window of 13 words holds a whole block of 7 of any document it occurs in, if that
document is cut into blocks of 7 that don't overlap. So:

1. Each batch of documents indexes its blocks and probes with every rolling 7-word window: both are sent, as distinct
   hashes, to the part of the key space they belong to (see exchange.py), which answers with those that are a block
   somewhere and occur in two batches or more. What meets within one batch is found there.
2. Hits are extended: every 13-word window with a hit among its seven 7-word windows is looked up by its own hashes; the
   part it belongs to knows the least doc_id of each batch, and answers which windows start in a smaller one elsewhere.
   Windows that overlap make up the maximal exact repeats; their words go.

Hashes of the first step (32 bits and the part) only choose candidates. Those of the second decide: 96 bits, of two
polynomials over the words' 64-bit hashes, which leave a chance of a thousandth for one false match among 10^13 windows.
A repeat is sent once for each batch, so passages that many documents share are no larger than others; nothing is
capped, and no pairs of documents are made.

Null texts have no words. Null doc_ids count as the largest id and never are the smaller one; rows that repeat a
doc_id don't remove from each other. Batches follow the order of rows, so the input should be a stored table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, documents, map_batches, materialise, offsets, rolling, texts
from .exchange import SCHEMA, batch_key, batches_of, by_key, by_part, changed, gather, pack, pack_rows, parts, rows, unpack, unpack_rows

WINDOW, BATCH_BYTES = 13, 4_000_000
_LOW = np.uint64(0xFFFFFFFF)
_LAST = np.iinfo(np.int64).max


class Words:
    """The words of a batch's texts, laid end to end."""

    def __init__(self, batch: pa.RecordBatch, memo: Memo):
        self.split = [t.split() for t in texts(batch)]
        self.bounds = offsets([len(w) for w in self.split])
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(memo.__getitem__, w), np.uint64, len(w)) for w in self.split)])
        self.doc = np.repeat(np.arange(len(self.split)), np.diff(self.bounds))
        self.place = np.arange(len(self.doc)) - self.bounds[self.doc]
        self.left = self.bounds[self.doc + 1] - np.arange(len(self.doc))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which an n-word window of one document starts, and the windows' hashes."""
        at = np.flatnonzero(self.left >= n)
        return at, rolling(self.hashes, n)[at] if len(at) else np.zeros(0, np.uint64)


def group_any(keys: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each occurs, and whether the flag is set for any of its occurrences."""
    own, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    return own, n, np.bincount(inverse, flag, len(own)) > 0


def probes(docs: DataFrame, block: int, n_parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(xxhash.xxh64_intdigest, 200_000)
        for number, batch in enumerate(gather(batches, BATCH_BYTES)):
            w, key = Words(batch, memo), batch_key(number)
            at, h = w.windows(block)
            own, _, aligned = group_any(h, w.place[at] % block == 0)
            yield rows([(p, key, "probe", pack(np.unique((own[i] & _LOW) << np.uint64(1) | aligned[i]))) for p, i in by_part(own, n_parts)])

    return map_batches(docs, run, SCHEMA)


def shared_blocks(p: int, held: list[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
    """For each batch, its hashes that are a block in any batch and occur in two or more."""
    got = [(b, unpack(d)[0]) for b, _, d in held]
    own = [np.unique(x >> np.uint64(1)) for _, x in got]
    keys, n = np.unique(np.concatenate(own), return_counts=True)
    block = np.unique(np.concatenate([x[x & np.uint64(1) == 1] >> np.uint64(1) for _, x in got]))
    hit = np.intersect1d(keys[n > 1], block, assume_unique=True)
    yield rows([(p, b, "shared", pack(np.array([p], np.int64), x)) for (b, _), x in zip(got, (np.intersect1d(o, hit, assume_unique=True) for o in own), strict=True) if len(x)])


def member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


def least_ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([_LAST if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)


def check(hashes: np.ndarray, window: int) -> np.ndarray:
    """32 more bits of each window."""
    return (rolling(hashes, window, 0xC2B2AE3D27D4EB4F) >> np.uint64(32)).astype(np.uint32)


def group_least(keys: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows in order (keys, checks), the place of each row's among them, and the least id of each."""
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])) if len(k) else np.zeros(0, np.int64)
    inverse = np.empty(len(k), np.int64)
    inverse[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
    return k[first], c[first], inverse, np.minimum.reduceat(ids[order], first) if len(k) else ids[:0]


def extend(window: int, block: int, n_parts: int, whole_rows: bool):
    def run(_: int, held: list[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
        key = held[0][0]
        packed = next((d for _, kind, d in held if kind == "rows"), None)
        if packed is None:
            raise changed()
        batch = unpack_rows(packed)
        w = Words(batch, Memo(xxhash.xxh64_intdigest, 200_000))
        at, h = w.windows(block)
        own, n, aligned = group_any(h, w.place[at] % block == 0)
        seed = (n > 1) & aligned
        at_part = dict(by_part(own, n_parts))
        for p, d in parts_of(held, "shared"):
            if p not in at_part or not member(d, np.sort(own[at_part[p]] & _LOW)).all():
                raise changed()
            seed[at_part[p]] |= member(own[at_part[p]] & _LOW, d)
        hits = np.zeros(len(w.hashes) + 1, np.int64)
        hits[at[seed[np.searchsorted(own, h)]] + 1] = 1
        hits = np.cumsum(hits)
        at, h = w.windows(window)
        near = hits[at + window - block + 1] > hits[at]
        at, h = at[near], h[near]
        touched = np.zeros(batch.num_rows, bool)
        touched[w.doc[at]] = True
        done = np.flatnonzero(~touched)
        if len(done):
            yield rows([(key, key, "done", pack_rows(finish(batch.take(pa.array(done)), [w.split[i] for i in done], None, whole_rows)))])
        if touched.any():
            ids = least_ids(batch)
            own, checks, _, least = group_least(h, check(w.hashes, window)[at], ids[w.doc[at]])
            # the same places among the words of the documents that go on
            kept = offsets(np.diff(w.bounds)[touched])[np.cumsum(touched)[w.doc[at]] - 1] + w.place[at]
            out = [(key, key, "rows", pack_rows(batch.take(pa.array(np.flatnonzero(touched))))), (key, key, "places", pack(kept.astype(np.uint64)))]
            out += [(p, key, "window", pack(own[i], checks[i], least[i])) for p, i in by_part(own, n_parts)]
            yield rows(out)

    return run


def parts_of(held: list[tuple[int, str, bytes]], answer: str) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its answer to a batch); the part leads the blob."""
    for _, kind, d in held:
        if kind == answer:
            p, x = unpack(d)
            yield int(p[0]), x


def smaller_elsewhere(p: int, held: list[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
    """For each batch, which of its windows start in a smaller doc_id in another."""
    got = [(b, *unpack(d)) for b, _, d in held]
    if got:
        ids = np.concatenate([x[3] for x in got])
        _, _, inverse, least = group_least(*(np.concatenate([x[k] for x in got]) for k in (1, 2)), ids)
        smaller, at = least[inverse] < ids, offsets([len(x[1]) for x in got])
        yield rows([(p, b, "smaller", pack(np.array([p], np.int64), smaller[at[i] : at[i + 1]].astype(np.uint8))) for i, (b, *_) in enumerate(got)])


def finish(batch: pa.RecordBatch, split: list[list[bytes]], gone: list[np.ndarray] | None, whole_rows: bool) -> pa.RecordBatch:
    """The result's rows: counts and the hash of what is kept; or all columns with the text that is kept."""
    n = [len(w) for w in split]
    removed = [int(g.sum()) for g in gone] if gone else [0] * len(n)
    if whole_rows:
        old = batch.column("text").to_pylist()
        new = [b" ".join(x for x, g in zip(w, gone[i], strict=True) if not g).decode("utf-8", "replace") if gone and removed[i] else old[i] for i, w in enumerate(split)]
        cols = {f.name: batch.column(f.name) for f in batch.schema}
        cols["text"] = pa.array(new, pa.string())
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([None if x is None else len(x) for x in new], pa.int64()).cast(batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    kept = [b" ".join(x for x, g in zip(w, gone[i], strict=True) if not g) if gone and removed[i] else b" ".join(w) for i, w in enumerate(split)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def cover(window: int, n_parts: int, whole_rows: bool):
    def run(_: int, held: list[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
        batch = unpack_rows(next(d for _, kind, d in held if kind == "rows"))
        w = Words(batch, Memo(xxhash.xxh64_intdigest, 200_000))
        at = unpack(next(d for _, kind, d in held if kind == "places"))[0].astype(np.int64)
        h, ids = rolling(w.hashes, window)[at], least_ids(batch)[w.doc[at]]
        own, _, inverse, least = group_least(h, check(w.hashes, window)[at], ids)
        elsewhere, at_part = np.zeros(len(own), bool), dict(by_part(own, n_parts))
        for p, smaller in parts_of(held, "smaller"):
            elsewhere[at_part[p]] = smaller > 0
        bad = at[(least[inverse] < ids) | elsewhere[inverse]]
        edge = np.zeros(len(w.hashes) + 1, np.int64)
        np.add.at(edge, bad, 1)
        np.add.at(edge, bad + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        yield finish(batch, w.split, [gone[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)], whole_rows)

    return run


def dedup(docs: DataFrame, window: int = WINDOW, whole_rows: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document; or, with whole_rows, all columns of docs with the text that is kept (as it was where nothing goes, else its words joined by one space; n_chars, if there, follows it)."""
    docs = docs if whole_rows else documents(docs)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) if whole_rows else "doc_id long, n_words long, n_removed long, kept_sha256 string"
    block, n_parts = (window + 1) // 2, parts(docs)
    found = batches_of(docs, BATCH_BYTES).unionByName(by_key(probes(docs, block, n_parts), "p", n_parts, shared_blocks, SCHEMA))
    table = materialise(by_key(found, "batch", n_parts, extend(window, block, n_parts, whole_rows), SCHEMA))
    done = table.where("kind = 'done'").mapInArrow(_unpacked, schema)
    # texts and places wait in the table: only the windows are dealt out by part
    looked_up = by_key(table.where("kind = 'window'"), "p", n_parts, smaller_elsewhere, SCHEMA)
    waiting = table.where("kind in ('rows', 'places')").unionByName(looked_up)
    return done.unionByName(by_key(waiting, "batch", n_parts, cover(window, n_parts, whole_rows), schema))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for d in b.column("data").to_pylist():
            yield unpack_rows(d)


def op5(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM w),
x AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS win FROM p WHERE pos + 12 <= len(words)),
f AS (SELECT win, min(doc_id) AS first_doc FROM x GROUP BY win),
bad AS (SELECT x.doc_id, x.pos FROM x JOIN f USING (win) WHERE f.first_doc < x.doc_id),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM bad, range(0, 13) AS r(k)),
kept AS (SELECT p.doc_id, string_agg(p.words[p.pos], ' ' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL) AS t, count(g.pos) AS n FROM p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
