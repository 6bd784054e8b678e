"""Spans over ordered rows: prefix sums, the row where a span of a given size ends, and chains of such steps.

None of these brings a group's rows together. Sums are taken by block of neighbouring rows, added up over a group's blocks, and
carried on within each block; steps are found between neighbouring buckets of a step's size; chains are followed by pointer
doubling, in as many rounds as the logarithm of their length, each a join and an aggregation over a table of pointers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.stored import stored

#: Rows of a block, if the ids are spread evenly.
BLOCK = 1024


def block_of(docs: DataFrame, key: str = "doc_id", rows: int = BLOCK) -> Column:
    """A number for each id, in their order, so that about `rows` rows of docs share one; null for a null id."""
    low, high, n = docs.agg(F.min(key), F.max(key), F.count(key)).first()
    width = max(1, -(-(high - low + 1) * rows // n)) if n else 1
    return F.floor((F.col(key) - F.lit(low or 0)) / width)


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of keys of which some may be null."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def prefix_sums(rows: DataFrame, groups: list[str], block: Column, order: list[str], size: str, most: int | None = None) -> DataFrame:
    """rows with `at` and `start`: how many rows come before each in its group, and the sum of their `size`.

    block: numbers of blocks of neighbouring rows, as of `block_of`. most: blocks that begin with a later row than that go.
    """
    rows = rows.withColumn("_block", block)
    blocks = rows.groupBy(*groups, "_block").agg(F.sum(size).alias("_sum"), F.count("*").alias("_n"))
    before = W.partitionBy(*groups).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(*groups, "_block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_sum", "_n")])
    if most is not None:
        blocks = blocks.where(F.col("_n_before") < most)
    keys = [*groups, "_block"]
    named = blocks.select(*[F.col(k).alias(f"{k}_") for k in keys], "_sum_before", "_n_before")
    both = rows.join(named, [rows[k].eqNullSafe(named[f"{k}_"]) for k in keys]).drop(*[f"{k}_" for k in keys])
    inside = W.partitionBy(*keys).orderBy(*order)
    sums = F.col("_sum_before") + F.sum(size).over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col(size)
    return both.select(*[c for c in rows.columns if c != "_block"], (F.col("_n_before") + F.row_number().over(inside) - 1).alias("at"), sums.alias("start"))


def steps(rows: DataFrame, groups: list[str], step: int) -> DataFrame:
    """groups, at, next: the first row that starts at least `step` after row `at`; one past the last row where there is none.

    rows: of `prefix_sums`, of sizes of 1 or more, so that a bucket of `step` has no more rows than that.
    """
    buckets = rows.groupBy(*groups, F.floor(F.col("start") / step).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("start", "at"))).alias("own"))
    after = buckets.select(*[F.col(k).alias(f"{k}_") for k in groups], (F.col("bucket") - 1).alias("bucket_"), F.col("own").alias("after"))
    both = buckets.join(after, [*[buckets[k].eqNullSafe(after[f"{k}_"]) for k in groups], buckets["bucket"] == after["bucket_"]], "left")
    past = F.element_at(F.coalesce("after", "own"), -1)["at"] + 1  # what follows these buckets starts late enough
    found = lambda x: F.coalesce(F.get(F.filter("after", lambda y: y["start"] >= x["start"] + step), F.lit(0))["at"], past)
    pairs = F.transform("own", lambda x: F.struct(x["at"].alias("at"), found(x).alias("next")))
    return both.select(*groups, F.inline(pairs))


def fills(rows: DataFrame, groups: list[str], size: str, budget: int) -> DataFrame:
    """groups, at, next: the first row that no longer fits if rows from `at` on are taken while their sizes come to `budget` at most.

    A row larger than that is taken alone. rows: of `prefix_sums`, of sizes of 1 or more. The row sought is the first that ends
    beyond start + budget: it is among the ends of the bucket after that of the start, or follows them, or follows the row itself.
    """
    step = budget + 1
    ends = rows.groupBy(*groups, F.floor((F.col("start") + F.col(size)) / step).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct((F.col("start") + F.col(size)).alias("end"), "at"))).alias("ends"))
    begins = rows.groupBy(*groups, F.floor(F.col("start") / step).alias("bucket")).agg(F.collect_list(F.struct("start", "at")).alias("own"))

    def beside(left: DataFrame, off: int, name: str) -> DataFrame:
        right = ends.select(*[F.col(k).alias(f"{k}_") for k in groups], (F.col("bucket") - off).alias("bucket_"), F.col("ends").alias(name))
        return left.join(right, [*[left[k].eqNullSafe(right[f"{k}_"]) for k in groups], left["bucket"] == right["bucket_"]], "left").drop("bucket_", *[f"{k}_" for k in groups])

    both = beside(beside(begins, 0, "here"), 1, "after")
    past = F.element_at(F.coalesce("after", "here"), -1)["at"] + 1
    found = lambda x: F.coalesce(F.get(F.filter("after", lambda y: y["end"] >= x["start"] + step), F.lit(0))["at"], past)
    pairs = F.transform("own", lambda x: F.struct(x["at"].alias("at"), F.greatest(x["at"] + 1, F.coalesce(found(x), x["at"] + 1)).alias("next")))
    return both.select(*groups, F.inline(pairs))


def packed(rows: DataFrame, groups: list[str], size: str, budget: int) -> DataFrame:
    """Rows (of `prefix_sums`) with `batch`: rows of a group in their order, each batch as many as fit into `budget`, one at least."""
    rows = stored(rows)
    pointers = stored(fills(rows, groups, size, budget))
    first = chain(pointers, groups).withColumnsRenamed({k: f"{k}_" for k in groups})
    heads = pointers.join(first.withColumnRenamed("at", "at_"), [*[F.col(k).eqNullSafe(F.col(f"{k}_")) for k in groups], F.col("at") == F.col("at_")])
    # a batch has `budget` rows at most, for each has a size; the last pointer may lead past the end
    places = heads.select(*[F.col(k).alias(f"{k}_") for k in groups], F.col("k").alias("batch"), F.explode(F.sequence("at", F.col("next") - 1)).alias("at_"))
    both = rows.join(places, [*[rows[k].eqNullSafe(places[f"{k}_"]) for k in groups], rows["at"] == places["at_"]])
    return both.drop("at_", *[f"{k}_" for k in groups])


def chain(pointers: DataFrame, groups: list[str], most: int | None = None) -> DataFrame:
    """groups, at, k: the rows on the way from row 0 (k = 0) to next, and on; the first `most` of them.

    pointers: groups, at, next, a row each. Each round doubles the pointers' reach and the rows known.
    """
    table = stored(pointers.select(*groups, "at", "next", F.when(F.col("at") == 0, 0).cast("long").alias("k")))
    reach, known = 1, -1
    while (most is None or reach < most) and (now := table.where("k is not null").count()) > known:
        known = now
        b = table.select(*[F.col(k).alias(f"{k}_") for k in groups], F.col("at").alias("at_"), F.col("next").alias("next_"))
        both = table.join(b, [*[table[k].eqNullSafe(b[f"{k}_"]) for k in groups], table["next"] == b["at_"]], "left")
        far = F.struct("at", F.col("next_").alias("next"), "k")
        there = F.struct(F.col("at_").alias("at"), F.lit(None).cast("long").alias("next"), (F.col("k") + reach).alias("k"))
        pieces = both.select(*groups, F.explode(F.when(F.col("k").isNotNull() & F.col("at_").isNotNull(), F.array(far, there)).otherwise(F.array(far))).alias("x"))
        table = stored(pieces.groupBy(*groups, "x.at").agg(F.max("x.next").alias("next"), F.min("x.k").alias("k")))
        reach *= 2
    out = table.where("k is not null").select(*groups, "at", "k")
    return out.where(F.col("k") < most) if most is not None else out
