"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's fingerprint has a bit for each of 64 positions: set if it is set in over half of the XXH64 hashes of the
document's shingles. Fingerprints that differ in at most `distance` bits are linked; the components of the links are
the groups of near-duplicates.

Equal fingerprints are one node. The index is one hierarchy over the codes sorted by Gray rank, in which neighbours share long
bit patterns. Its upper nodes are the runs of that order which share their leading bits: as many bits as it takes for no run to
hold more than NODE codes, whatever their number, and DEPTH at least. A code goes down to every upper node from whose bits it differs in at
most `distance`; all others are pruned unseen. (Of two runs, codes of the later one go to the earlier; so a code goes to about
half of 1 + d + d(d-1)/2 runs at depth d.) Below, a tree over a run keeps in each node the bits that everything below it
shares; a search accumulates a query's differences from them on the way down and prunes whole groups once they exceed the
distance. A task holds one run, whose visitors stream past in batches; of each, only a spanning forest is passed on.

Null and empty texts have the fingerprint zero and are linked like any other. Links are between fingerprints: a row without a
doc_id links others and gets the least doc_id that it reaches; a group in which no row has one has a null component_id.
Repeated rows are repeated in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, join_hot, map_batches, materialise, offsets, small_batches, texts
from .graph import components

DISTANCE, SHINGLE, SEED, FAN, CHUNK = 2, 3, 42, 4, 2048
#: Leading bits of the upper nodes, at least and at most, and how many codes one has below it before they get more.
DEPTH, DEEPEST, NODE = 6, 28, 1 << 18


def shingle_hashes(text: bytes, n: int = SHINGLE) -> np.ndarray:
    words = text.lower().split()  # bytes: A-Z alone, and exactly the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([h(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = offsets(size)
    return np.array([h(joined[a:b], SEED) for a, b in zip(start[: -n].tolist(), (start[n:] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes) -> int:
    return majority(shingle_hashes(text))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of these hashes; 0 for none."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp)], names=["doc_id", "fp"])

    return map_batches(documents(docs), run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each code in the reflected Gray order."""
    out = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


class GrayTree:
    """A tree over codes in Gray order: level 0 are the codes; a node of a higher level covers FAN of the level below."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        own = codes[self.order]
        self.pattern, self.shared = [own], [np.full(len(own), ~np.uint64(0))]
        while len(self.pattern[-1]) > 1:
            p, s = self.pattern[-1], self.shared[-1]
            cut = np.arange(0, len(p), FAN)
            ones, some = np.bitwise_and.reduceat(p & s, cut), np.bitwise_or.reduceat(p | ~s, cut)
            self.shared.append(ones | ~some)
            self.pattern.append(ones)

    def within(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, code) positions at no more than this distance."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        for level in range(len(self.pattern) - 1, -1, -1):
            far = np.bitwise_count((queries[q] ^ self.pattern[level][node]) & self.shared[level][node])
            q, node = q[far <= distance], node[far <= distance]
            if level:
                q, node = np.repeat(q, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < len(self.pattern[level - 1])
                q, node = q[there], node[there]
        return q, self.order[node]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place of each place's part, after the parts of a[i] and b[i] have become one."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label != (up := label[label])).any():
            label = up


def forest(codes: np.ndarray, ids: np.ndarray, distance: int, tree: GrayTree) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its part) of what links between these codes and those of the tree join to a smaller id.

    ids: of the tree's codes, then of these. Few queries search at a time, and their links are united before the next.
    """
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    label, first = np.arange(len(ids)), len(ids) - len(codes)
    for i in range(0, len(codes), CHUNK):
        q, near = tree.within(codes[i : i + CHUNK], distance)
        label = unite(label, place[first + i + q], place[near])
    moved = np.flatnonzero(label < np.arange(len(ids)))
    return ids[order[moved]], ids[order[label[moved]]]


def flips(depth: int, distance: int) -> list[int]:
    """All codes of `depth` bits with at most `distance` set."""
    return [sum(1 << b for b in c) for k in range(min(depth, distance) + 1) for c in combinations(range(depth), k)]


def prefix(fp: str | Column, depth: int) -> Column:
    return F.shiftrightunsigned(fp, 64 - depth) if depth else F.lit(0).cast("long")


def upper_depth(nodes: DataFrame) -> int:
    """The least depth from DEPTH on, by steps of two, at which no upper node covers more than NODE codes; DEEPEST at most."""
    depth = DEPTH
    while depth < DEEPEST and (nodes.groupBy(prefix("fp", depth).alias("k")).count().agg(F.max("count")).first()[0] or 0) > NODE:
        depth += 2
    return depth


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """nodes: fp, rep (distinct fingerprints and a number for each). Links (a, b) between reps that span all groups."""
    depth = upper_depth(nodes)
    # the upper nodes a code may have a partner below: its differences from their bits are within the distance. Of two codes
    # the one with the larger prefix goes to the other's node.
    at = F.explode(F.array(*[prefix("fp", depth).bitwiseXOR(F.lit(x).cast("long")) for x in flips(depth, distance)])).alias("k")
    entries = nodes.select(at, "fp", "rep").withColumn("visits", F.col("k") < prefix("fp", depth)).where(F.col("k") <= prefix("fp", depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, tree, own = None, [], None, np.zeros(0, np.int64)

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def closed() -> Iterator[pa.RecordBatch]:
            """The members of an upper node are all there: the tree over them, and the links among them."""
            nonlocal tree, own, members
            codes, own = (np.concatenate(x) for x in zip(*members, strict=True))
            members, tree = [], GrayTree(codes)
            yield out(*forest(codes, np.concatenate([own, own]), distance, tree))

        for batch in batches:
            k, fp, rep, visits = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "fp", "rep", "visits"))
            if not len(k):
                continue
            cut = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (visits[1:] != visits[:-1]), [True]]))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if k[a] != now:
                    if members:
                        yield from closed()
                    now, members, tree = k[a], [], None
                if not visits[a]:
                    members.append((fp[a:b].view(np.uint64), rep[a:b]))
                    continue
                if members:
                    yield from closed()
                if tree is not None:
                    yield out(*forest(fp[a:b].view(np.uint64), np.concatenate([own, rep[a:b]]), distance, tree))
        if members:
            yield from closed()

    small_batches(nodes.sparkSession)
    return entries.repartition("k").sortWithinPartitions("k", "visits").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable) for each document."""
    fps = materialise(fingerprints(docs))
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    found = components(links(nodes.select("fp", F.col("fp").alias("rep")), distance))
    # components are of fingerprints, so that rows without an id link like any other; each is then named by its least id
    placed = materialise(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    distinct, total = placed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    named = join_hot(placed.withColumnRenamed("n", "rows"), least, "component", distinct).select("fp", "component_id", F.col("rows").alias("n"))
    return join_hot(fps, named, "fp", total).select("doc_id", "fp", "component_id")


def op2(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
