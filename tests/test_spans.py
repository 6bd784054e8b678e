"""Prefix sums, steps and chains against a walk over the rows, and how many rows a task of theirs may see."""

import random

import pytest
from pyspark.sql import functions as F

from stylemill.operators import spans, windows


def placed(spark, sizes, rows=16):
    """sizes: (group, id, size)."""
    df = spark.createDataFrame(sizes, "g string, id long, n long").repartition(5)
    return spans.prefix_sums(df, ["g"], spans.block_of(df, "id", rows), ["id"], "n")


@pytest.fixture(scope="module")
def sizes():
    rng = random.Random(7)
    ids = rng.sample(range(-5000, 90_000), 900)
    return [((None, "a", "b")[i % 3], x, rng.choice([1, 2, 7, 40, 300])) for i, x in enumerate(ids)] + [("c", 5, 3)]


def walks(sizes):
    by = {}
    for g, i, n in sorted(sizes, key=lambda x: x[1]):
        by.setdefault(g, []).append((i, n))
    for g, rows in by.items():
        start, out = 0, []
        for at, (i, n) in enumerate(rows):
            out.append((g, i, n, at, start))
            start += n
        yield out


def test_prefix_sums(spark, sizes):
    want = [r for w in walks(sizes) for r in w]
    key = lambda r: (r[0] or "", r[1])
    assert sorted((tuple(r) for r in placed(spark, sizes).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("step,most", [(50, None), (50, 5), (1, None), (1000, 40)])
def test_steps_and_chains(spark, sizes, step, most):
    rows, want, first = placed(spark, sizes).cache(), {}, set()
    for w in walks(sizes):
        for _, _, _, at, start in w:
            want[w[0][0], at] = next((a for _, _, _, a, s in w if s >= start + step), len(w))
        at, k = 0, 0
        while at < len(w) and (most is None or k < most):
            first.add((w[0][0], at, k))
            at, k = want[w[0][0], at], k + 1
    nexts = spans.steps(rows, ["g"], step)
    assert {(r.g, r["at"]): r.next for r in nexts.collect()} == want
    assert {tuple(r) for r in spans.chain(nexts, ["g"], most).collect()} == first


@pytest.mark.parametrize("budget", [1, 60, 350, 100_000])
def test_packing(spark, sizes, budget):
    want = {}
    for w in walks(sizes):
        used = batch = 0
        for k, (g, i, n, _, _) in enumerate(w):
            if k and used + n > budget:
                batch, used = batch + 1, 0
            used += n
            want[g, i] = batch
    assert {(r.g, r.id): r.batch for r in spans.packed(placed(spark, sizes), ["g"], "n", budget).collect()} == want


def test_empty(spark):
    assert spans.chain(spans.steps(placed(spark, []), ["g"], 10), ["g"]).count() == 0


def test_no_task_sees_a_profile(spark):
    """A profile of a million paragraphs: blocks of it are what window functions sort, and only one number a block meets."""
    docs = spark.range(1_000_000).select(F.lit("a").alias("profile"), F.col("id").alias("doc_id"), (F.col("id") % 7 + 1).alias("n"))
    block = spans.block_of(docs)
    assert docs.groupBy(block.alias("b")).count().agg(F.max("count")).first()[0] <= 2 * spans.BLOCK
    x = spans.prefix_sums(docs, ["profile"], block, ["doc_id"], "n")
    plan = x._jdf.queryExecution().executedPlan().toString()
    sorted_by = [line for line in plan.splitlines() if "Window [" in line and "doc_id" in line]
    assert sorted_by and all("_block" in line.split("windowspecdefinition")[1].split("ASC")[0] for line in sorted_by)
    n = x.agg(F.max("at"), F.max(F.col("start") + F.col("n")), F.countDistinct("at")).first()
    assert tuple(n) == (999_999, sum(i % 7 + 1 for i in range(1_000_000)), 1_000_000)
    near = spans.prefix_sums(docs, ["profile"], block, ["doc_id"], "n", most=3000)
    assert near.count() < 3000 + 2 * spans.BLOCK


def test_all_windows_of_a_long_profile(spark):
    sizes = [i * 37 % 90 + 1 for i in range(3000)]
    docs = spark.createDataFrame([("a", i, "word " * n) for i, n in enumerate(sizes)], "profile string, doc_id long, text string")
    got = {}
    for r in windows.membership(docs, window=200, stride=100, least=150, most=None).collect():
        got.setdefault(r.window_no, []).append(r.doc_id)
    want, start = [], 0
    while start < len(sizes):
        end, total = start, 0
        while end < len(sizes) and total < 200:
            total, end = total + sizes[end], end + 1
        if total < 150:
            break
        want.append(list(range(start, end)))
        moved = 0
        while start < len(sizes) and moved < 100:
            moved, start = moved + sizes[start], start + 1
    assert [sorted(got[k]) for k in sorted(got)] == want and len(want) > 500
