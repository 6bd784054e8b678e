"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically.

One pass over the texts writes a few statistics of each document to the shared folder; everything after it reads
only those. The features z = sqrt(2/D) cos(Wx + b) approximate a Gaussian kernel over the standardised statistics.
Each partition sums its part of the normal equations Z'Z and Z'y; the parts are added up by executors, block by
block, and only the D x D total reaches the driver. Isotonic regression (pool adjacent violators) over the scores of
a calibration fold, counted in a fixed number of bins, turns ridge scores into probabilities.

Null and empty texts get the statistics of an empty text and are scored like any other; labels with null doc_id or
null quality teach nothing; repeated rows are scored alike; without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, documents, fold, map_batches, materialise, rolling, texts
from .quality_rules import SYMBOLS, dup_lines, repeat_words

FEATURES, RIDGE, SEED, BINS, BLOCK = 128, 1e-3, 7, 512, 16
NAMES = ("log_words", "word_length", "upper", "digits", "symbols", "punctuation", "other_bytes", "line_words", "distinct", "dup_lines", "repeats", "entropy", "top_word", "ends")
_CLASSES = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", SYMBOLS, b".,;:!?'\"()-", bytes(range(128, 256))), 1):
    _CLASSES[list(_chars)] = _i


def statistics(text: bytes, hashes: dict) -> list[float]:
    """NAMES of a text, all finite."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(NAMES)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASSES, weights=hist, minlength=6) / size
    p = hist[hist > 0] / size
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    h.sort()
    edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    lines = text.count(b"\n") + 1
    return [
        float(np.log1p(n)), size / n, *kinds[1:6], float(np.log1p(n / lines)), (len(edges) - 1) / n, dup_lines(text) / lines, repeat_words(words, hashes) / n,
        float(-(p * np.log2(p)).sum()), float(np.diff(edges).max()) / n, sum(text.count(x) for x in (b". ", b".\n", b"? ", b"! ")) / n,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Memo(xxhash.xxh64_intdigest, 200_000)
        for batch in batches:
            x = [statistics(t, hashes) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "x"])

    return map_batches(documents(docs), run, "doc_id long, x array<float>")


class Features:
    """Standardising, then random Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, size: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.where(sd > 1e-6, sd, 1.0)
        self.w = rng.standard_normal((len(mean), size)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2 / len(self.b)) * np.cos(np.clip((x - self.mean) / self.sd, -4, 4) @ self.w + self.b)
        return np.hstack([z, np.ones((len(x), 1))])


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)


def normal_equations(train: DataFrame, features: Features) -> np.ndarray:
    """Z'[Z y], summed by partition, then over partitions in blocks of rows."""
    d = len(features.b) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            z = features(matrix(batch))
            total += z.T @ np.hstack([z, batch.column("y").to_numpy(zero_copy_only=False)[:, None]])
        if total[-1, -2]:
            blocks = [total[i : i + BLOCK].ravel() for i in range(0, d, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.list_(pa.float64()))], names=["block", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("block").to_pylist(), batch.column("v"), strict=True):
                totals[k] = totals.get(k, 0) + np.asarray(v.values)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.list_(pa.float64()))], names=["block", "v"])

    rows = train.mapInArrow(partial, "block int, v array<double>").repartition("block").mapInArrow(add, "block int, v array<double>").collect()
    out = np.zeros((d, d + 1))
    for r in rows:  # one for each block of BLOCK rows
        out[r.block * BLOCK : (r.block + 1) * BLOCK] += np.reshape(r.v, (-1, d + 1))
    return out


def isotonic(weight: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over bins in order of the score; empty bins take what lies between their neighbours."""
    pools: list[list[float]] = []
    for i in np.flatnonzero(weight):
        pools.append([positives[i], weight[i], i, i])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, w, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + w, pools[-1][2], last]
    if not pools:
        return np.full(len(weight), 0.5)
    at = [x for s, w, a, b in pools for x in ((a, (s + 0.5) / (w + 1)), (b, (s + 0.5) / (w + 1)))]
    return np.maximum.accumulate(np.interp(np.arange(len(weight)), *zip(*at, strict=True)))


def bins(raw: np.ndarray) -> np.ndarray:
    """Ridge scores from -0.5 to 1.5 in BINS steps."""
    return np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, raw for each document. Rows of fold 0 teach nothing; fold folds-1 calibrates."""
    stats = materialise(document_statistics(docs).withColumn("fold", fold("doc_id", folds)))
    y = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    train = materialise(stats.where("fold <> 0").join(y, "doc_id").select("fold", "x", "y"))
    moments = stats.where("fold <> 0").select([F.col("x")[i].alias(n) for i, n in enumerate(NAMES)]).agg(*[f(n).alias(f"{n}_{k}") for k, f in (("m", F.avg), ("s", F.stddev_pop)) for n in NAMES]).first()
    features = Features(*(np.array([moments[f"{n}_{k}"] or 0.0 for n in NAMES]) for k in "ms"))
    eq = normal_equations(train.where(F.col("fold") < folds - 1), features)
    weights = np.linalg.solve(eq[:, :-1] + max(1.0, eq[-1, -2]) * RIDGE * np.eye(len(eq)), eq[:, -1]) if eq[-1, -2] else np.zeros(len(eq))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS))
        for batch in batches:
            k = bins(features(matrix(batch)) @ weights)
            total += [np.bincount(k, minlength=BINS), np.bincount(k, batch.column("y").to_numpy(zero_copy_only=False), BINS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS), pa.int32()), pa.array(total[0]), pa.array(total[1])], names=["bin", "n", "pos"])

    counted = train.where(F.col("fold") == folds - 1).mapInArrow(binned, "bin int, n double, pos double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()
    n, pos = np.zeros(BINS), np.zeros(BINS)
    for r in counted:  # at most BINS
        n[r.bin], pos[r.bin] = r.n, r.pos
    curve = isotonic(n, pos)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = features(matrix(batch)) @ weights
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(batch.column("fold").to_numpy() == 0), pa.array(curve[bins(raw)]), pa.array(raw)], names=["doc_id", "held_out", "score", "raw"])

    return stats.mapInArrow(score, "doc_id long, held_out boolean, score double, raw double").select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "raw")
