"""Hard negatives: against all pairs in whole numbers, with ties, repeats, awkward vectors, large numbers and several waves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylemill.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, positive_id long"


def plain(rows, every, scale=H.SCALE):
    """All pairs, in Python's integers; rows: (vec_id, vector, label)."""
    fine = {(i, tuple(math.floor(scale * x) for x in v), y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out, anchors = [], {}
    for i, v, y in sorted(fine, key=lambda r: (r[0], r[2], r[1])):
        if i % every == 0:
            anchors.setdefault((i, len(v)), (v, y))
    for (i, n), (v, y) in anchors.items():
        scored = sorted({(-sum(map(int.__mul__, v, w)), j, z == y) for j, w, z in fine if j != i and len(w) == n})
        for s, j, _ in [x for x in scored if x[2]][: H.POSITIVES]:
            near = [x for x in scored if not x[2] and H.LOW * -s <= 100 * -x[0] <= H.HIGH * -s]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k, _) in enumerate(near[: H.NEGATIVES], 1)]
    return sorted(out)


def mined(spark, rows, every, parts=3):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % every == 0).collect())


def test_against_all_pairs(spark):
    rng = random.Random(1)
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 1.5) for c in centre[i % 4]], (i * 7 + i // 50) % 5) for i in range(700)]
    want = plain(rows, 9)
    assert mined(spark, rows, 9) == want and len(want) > 500


def test_ties_repeats_and_a_common_vector(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-1, 2)) / 16 for _ in range(4)] if i % 3 else [0.25, 0.25, 0.0, 0.25], i % 3 // 2 + i % 2) for i in range(400)]
    want = plain(rows, 20)
    assert mined(spark, rows + rows[:150] + rows[::20], 20) == want and len(want) > 50


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 1.0], 1), (0, [1.0, 2.0], 0), (1, [1.0, 1.0], 1), (2, [0.7, 0.7], 2), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2),
        (None, [1.0, 1.0], 1), (7, [1.0, 1.0], None), (10, [1.0], 1), (11, [1.0], 1), (12, [0.8], 2), (20, [], 1), (21, [], 1), (22, [], 3), (30, [-1.0, -1.0], 9), (31, [-1.0, -1.0], 9), (-10, [1.0, 0.0], 3), (-9, [3.0, 1.0], 3), (-8, [2.0, 0.0], 4),
    ]
    want = plain(rows, 10)
    assert mined(spark, rows, 10) == want and {r[0] for r in want} >= {10, 20, -10}
    assert mined(spark, [], 10) == []


def test_numbers_beyond_exact_floats(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * (2e6 if i % 4 else 1.0) for _ in range(6)], i % 3) for i in range(90)]
    want = plain(rows, 10)
    assert mined(spark, rows, 10) == want and max(r[4] for r in want) > 2**53
    with pytest.raises(OverflowError):
        H.products(np.full((1, 2), 2.0**40), np.full((1, 2), 2.0**40))


def test_waves_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)], i % 4) for i in range(300)]
    whole = mined(spark, rows, 3)
    monkeypatch.setattr(H, "WAVE", 1500)
    monkeypatch.setattr(H, "ANCHORS", 7)
    monkeypatch.setattr(H, "CANDIDATES", 11)
    assert mined(spark, rows, 3, parts=2) == whole == plain(rows, 3)
