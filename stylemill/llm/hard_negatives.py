"""Hard-negative mining: blocks of anchors times blocks of candidates, as dense products of whole numbers in float64.

Components are scaled and rounded down to whole numbers, so a score is a whole number, and exact in float64 while the sum of
the absolute products stays below 2^53; blocks in which it might not are multiplied as Python integers, and a score beyond
64 bits is an error. Two passes read the candidates where they lie, and none of them moves. The first keeps for each anchor
the best POSITIVES rows of its label within a task; the second, for each anchor and positive, the best NEGATIVES rows of other
labels within the window that the positive's score opens. A row that ranks behind what its task holds already is never
looked at alone: whole blocks are compared with the last ranks held. The tasks' short lists are merged by rank.

Anchors are broadcast in waves of WAVE bytes of vectors; more anchors take more passes over the candidates, one wave after
the other, each with its result in a table. They are a stated part of all rows, so the work grows with their product.

Rows with a null id, a null label, a null vector, or a null, NaN or infinite component take no part. Vectors of different length
have no score together. Among equal scores the smaller id comes first. Rows that repeat count once (as an anchor, a positive
and a negative), and a row with the anchor's own id is none of its partners; of anchors with one id that differ, the
one with the least label, then vector, stands. An anchor without positives, or whose windows are empty, has no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, materialise, table

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Bytes of anchors broadcast at a time; anchors and candidates multiplied at a time.
WAVE, ANCHORS, CANDIDATES = 16 << 20, 256, 1024
LEAST, NONE = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of double of the rows that take part, by their ids and labels."""
    columns = F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    return vectors.where("vec_id is not null and label is not null and embedding is not null").select(*columns)


def whole_numbers(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of the rows of a batch of finite vectors, for each length that occurs; matrix: floor(scale * x)."""
    vectors = batch.column("embedding").combine_chunks() if isinstance(batch.column("embedding"), pa.ChunkedArray) else batch.column("embedding")
    cut = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    size, ids, labels = np.diff(cut), batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
    with np.errstate(over="ignore"):
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            x = np.floor(flat[cut[rows][:, None] + np.arange(n)] * scale)
            fine = np.isfinite(x).all(1)
            yield ids[rows[fine]], labels[rows[fine]], x[fine]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed: float64 where that is exact, else int64 by way of Python's integers."""
    if not a.size or not b.size or a.shape[1] * np.abs(a).max() * np.abs(b).max() < 2**53:
        return a @ b.T
    exact = [[int(v) for v in row] for row in a], [[int(v) for v in row] for row in b]
    return np.array([[sum(map(int.__mul__, x, y)) for y in exact[1]] for x in exact[0]], object).astype(np.int64)


class Best:
    """The first k (score, id) of each of n groups, higher scores first, then smaller ids; equal pairs count once."""

    def __init__(self, n: int, k: int, floor: np.ndarray | int = LEAST):
        self.k, self.score, self.id = k, np.full((n, k), LEAST), np.full((n, k), NONE)
        self.floor = np.full(n, floor) if np.isscalar(floor) else floor.copy()  # what a score must reach to be looked at

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        last, own = self.score[group, -1], self.id[group, -1]
        better = (score > last) | (score == last) & (ids < own)
        group, score, ids = group[better], score[better], ids[better]
        if not len(group):
            return
        seen = np.unique(group)
        g = np.concatenate([np.repeat(seen, self.k), group])
        s, i = np.concatenate([self.score[seen].ravel(), score]), np.concatenate([self.id[seen].ravel(), ids])
        there = i != NONE
        g, s, i = g[there], s[there], i[there]
        order = np.lexsort((i, ~s, g))  # ~s falls as s grows, without overflow
        g, s, i = g[order], s[order], i[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])])
        g, s, i = g[new], s[new], i[new]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        kept = rank < self.k
        self.score[seen], self.id[seen] = LEAST, NONE
        self.score[g[kept], rank[kept]], self.id[g[kept], rank[kept]] = s[kept], i[kept]
        full = seen[self.id[seen, -1] != NONE]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, -1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, r = np.nonzero(self.id != NONE)
        return g, self.score[g, r], self.id[g, r]


class Anchors:
    """A wave of anchors of one vector length, with the score windows of their positives once those are known."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray):
        self.ids, self.labels, self.matrix = ids, labels, matrix
        self.owner = self.positive = self.low = self.high = np.zeros(0, np.int64)

    def scored(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first anchor, places of candidates, their scores, whether labels are equal) of each pair of blocks."""
        # rows too large for exact products go by themselves, so that they don't hold up the others
        large = (matrix.shape[1] * np.abs(matrix).max(1, initial=0) * np.abs(self.matrix).max(initial=1) >= 2**53) if matrix.shape[1] else np.zeros(len(ids), bool)
        for part in (np.flatnonzero(~large), np.flatnonzero(large)):
            for c in range(0, len(part), CANDIDATES):
                own = part[c : c + CANDIDATES]
                for a in range(0, len(self.ids), ANCHORS):
                    yield a, own, products(self.matrix[a : a + ANCHORS], matrix[own]), self.labels[a : a + ANCHORS, None] == labels[own]


def positives_of(anchors: dict[int, Anchors], held: dict[int, Best], ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
    own, best = anchors[matrix.shape[1]], held[matrix.shape[1]]
    for a, c, score, same in own.scored(ids, labels, matrix):
        g, j = np.nonzero(same & (score >= best.floor[a : a + len(score), None]))
        other = own.ids[a + g] != ids[c[j]]
        best.add(a + g[other], score[g[other], j[other]].astype(np.int64), ids[c[j[other]]])


def negatives_of(anchors: dict[int, Anchors], held: dict[int, Best], ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
    own, best = anchors[matrix.shape[1]], held[matrix.shape[1]]
    for a, c, score, same in own.scored(ids, labels, matrix):
        different, (i, end) = ~same, np.searchsorted(own.owner, (a, a + len(score)))
        step = len(score)
        for w in range(i, end, step):
            window = np.arange(w, min(end, w + step))
            s = score[own.owner[window] - a]
            g, j = np.nonzero((s >= best.floor[window, None]) & (s <= own.high[window, None]) & different[own.owner[window] - a])
            best.add(window[g], s[g, j].astype(np.int64), ids[c[j]])


def search(candidates: DataFrame, anchors: dict[int, Anchors], scale: int, new: Callable[[Anchors], Best], take: Callable) -> DataFrame:
    """length, place, id, score: each task's best of each place, found by `take` among the candidates."""
    shared = candidates.sparkSession.sparkContext.broadcast(anchors)  # WAVE bytes and their positives

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: new(x) for n, x in shared.value.items()}
        for batch in batches:
            for ids, labels, matrix in whole_numbers(batch, scale):
                if len(ids) and matrix.shape[1] in held:
                    take(shared.value, held, ids, labels, matrix)
        for n, best in held.items():
            g, s, i = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), n, np.int64)), pa.array(g), pa.array(i), pa.array(s)], names=["length", "place", "id", "score"])

    return map_batches(candidates, run, "length long, place long, id long, score long")


def first(rows: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """The first k of each place, of the tasks' lists; a row that repeats in several tasks has one rank."""
    w = Window.partitionBy("length", "place").orderBy(F.col("score").desc(), "id")
    return rows.withColumn(rank, F.dense_rank().over(w)).where(F.col(rank) <= k).distinct()


def gathered(rows: DataFrame, scale: int) -> dict[int, Anchors]:
    """The anchors of a wave, by length."""
    own = rows.toArrow().combine_chunks()
    by: dict[int, list] = {}
    for batch in own.to_batches():
        for ids, labels, matrix in whole_numbers(batch, scale):
            by.setdefault(matrix.shape[1], []).append((ids, labels, matrix))
    out = {}
    for n, parts in by.items():
        ids, labels, matrix = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((*matrix.T[::-1], labels, ids))
        once = order[np.concatenate([[True], np.diff(ids[order]) != 0])] if len(order) else order
        if len(once):
            out[n] = Anchors(ids[once], labels[once], matrix[once])
    return out


def mine_wave(candidates: DataFrame, anchors: dict[int, Anchors], scale: int, low: int, high: int) -> DataFrame:
    found = first(search(candidates, anchors, scale, lambda x: Best(len(x.ids), POSITIVES), positives_of), POSITIVES)
    found = found.select("length", "place", "id", "score").toArrow().sort_by([("length", "ascending"), ("place", "ascending"), ("score", "descending"), ("id", "ascending")])
    for n, own in anchors.items():  # POSITIVES rows an anchor of the wave
        mine = found.filter(pa.compute.equal(found["length"], n))
        own.owner, own.positive, score = (mine[c].to_numpy() for c in ("place", "id", "score"))
        # low * score <= 100 * negative <= high * score
        own.low = np.array([-(-low * s // 100) for s in score.tolist()], np.int64)
        own.high = np.array([high * s // 100 for s in score.tolist()], np.int64)
        own.score = score
    kept = first(search(candidates, anchors, scale, lambda x: Best(len(x.owner), NEGATIVES, x.low), negatives_of), NEGATIVES)
    shared = candidates.sparkSession.sparkContext.broadcast({n: (x.ids[x.owner], x.positive, x.score) for n, x in anchors.items()})

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, place = (batch.column(c).to_numpy() for c in ("length", "place"))
            out = np.zeros((3, len(place)), np.int64)
            for n, own in shared.value.items():
                at = length == n
                out[:, at] = [x[place[at]] for x in own]
            yield pa.RecordBatch.from_arrays([*map(pa.array, out[:2]), batch.column("rank"), batch.column("id"), pa.array(out[2]), batch.column("score")], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return map_batches(kept.select("length", "place", "rank", "id", "score"), name, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def mine(vectors: DataFrame, is_anchor: Column, scale: int = SCALE, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of all anchors; vectors: vec_id, embedding, label."""
    candidates = usable(vectors)
    own = candidates.where(is_anchor)
    size = own.agg(F.coalesce(F.sum(F.size("embedding") * 8 + 16), F.lit(0))).first()[0]
    waves, done = max(1, math.ceil(size / WAVE)), []
    for wave in range(waves):
        found = mine_wave(candidates, gathered(own.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == wave), scale), scale, low, high)
        done.append(materialise(found) if waves > 1 else found)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings, with the labels of every seventh row moved on by one."""
    x = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(x.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


ORACLE = f"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
