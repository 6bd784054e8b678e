"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with the same shingles are one node. Candidates come from SimHash, by op2's index: nodes whose fingerprints over their
shingles reach each other by steps of at most simhash.DISTANCE bits. Pairs of similarity 0.8 differ in about ten bits, which no index of
fingerprints finds, so MinHash adds candidates: BANDS bands of ROWS minima each; nodes that agree on a whole band, which a pair of
similarity 0.8 misses with a probability of 0.0007, a closer one with less. Each candidate component is then searched exactly: a breadth-first search by an inverted index of its shingles compares every node
reached with all that are left, so the links within it are those of the true similarities, whatever the candidates were.

Words are split at ASCII spaces, A-Z lower-cased; a text of fewer words is one shingle. Null and empty texts are alike. Links are
between texts: a row without a doc_id links others and belongs to the least doc_id that it reaches, but stays; a group in which
no row has one has a null group. Repeated rows are treated alike.

One task holds the shingles of one block. A candidate component of more than BLOCK shingles is dealt into blocks, which joins most
of it; then the candidates of still different groups are compared, by pairs of blocks, and all other texts are left out.

Texts are fetched from the documents once: those of candidate components go to a table, from which each search takes its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Memo, documents, join_hot, map_batches, materialise, maybe, mix, offsets, release, rolling, small_batches, texts, tidy
from .graph import components

SHINGLE, BANDS, ROWS, GROUP, BLOCK = 5, 24, 6, 1 << 18, 1 << 22
#: Stands for the doc_id of texts whose rows have none.
NOBODY = (1 << 63) - 1
#: Similarity, as a fraction: 4 / 5.
SHARED, OF = 4, 5
_RNG = np.random.default_rng(42)
_XOR, _FACTOR = _RNG.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64), _RNG.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, hashes: Memo) -> np.ndarray:
    """The distinct hashes of a text's shingles, in ascending order; one 0 without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    return np.unique(rolling(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), min(SHINGLE, len(words))))


def word_hashes() -> Memo:
    return Memo(xxhash.xxh64_intdigest, 200_000)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set."""
    flat, start = np.concatenate(sets), offsets([len(x) for x in sets])[:-1]
    out = np.zeros((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        for i in range(b * ROWS, (b + 1) * ROWS):
            out[:, b] = mix(out[:, b] + np.minimum.reduceat((flat ^ _XOR[i]) * _FACTOR[i], start))
    return mix(out + np.arange(BANDS, dtype=np.uint64))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, s (a hash of the set of shingles), size (their number), fp (their fingerprint), keys (those of the bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()

        def flush(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            s = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(sets).view(np.int64).ravel()))
            size = pa.array([len(x) for x in sets], pa.int64())
            fp = pa.array(np.array([simhash.majority(x) for x in sets], np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s), size, fp, keys], names=["doc_id", "s", "size", "fp", "keys"])

        for batch in batches:
            ids, sets, size = [], [], 0
            for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                ids.append(i)
                sets.append(shingles(t, hashes))
                size += len(sets[-1])
                if size > GROUP:
                    yield flush(ids, sets)
                    ids, sets, size = [], [], 0
            if ids:
                yield flush(ids, sets)

    return map_batches(documents(docs), run, "doc_id long, s long, size long, fp long, keys array<long>")


def nameless_texts(docs: DataFrame) -> DataFrame:
    """s, text: one text of each set that rows without a doc_id have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            s = np.array([xxhash.xxh64_intdigest(shingles(t, hashes).tobytes()) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s), batch.column("text").cast(pa.string())], names=["s", "text"])

    rows = map_batches(documents(docs).where("doc_id is null"), run, "s long, text string")
    return rows.groupBy("s").agg(F.max("text").alias("text"))


def search(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the least place of those it is linked with, directly or over others.

    Exact prefix filtering: shingles are ordered from the rarest of these sets on, and of two sets of the similarity asked for, the
    first |x| - ceil(4/5 |x|) + 1 shingles of each have one in common. Only those are indexed and looked up, so shingles that
    many sets share, which come last, seldom count; what they find is compared in full. A set that has its label
    leaves a shingle's list when the list is next read, so the sets of a large group are not read by each of its members.
    """
    size = np.array([len(x) for x in sets])
    own = offsets(size)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    code = rank[code]
    for i in range(len(sets)):
        code[own[i] : own[i + 1]].sort()
    lead = size - -(-SHARED * size // OF) + 1
    at = np.repeat(own[:-1] - offsets(lead)[:-1], lead) + np.arange(lead.sum())
    order = np.argsort(code[at], kind="stable")
    holder = np.repeat(np.arange(len(sets)), lead)[order]
    start = np.searchsorted(code[at][order], np.arange(len(often) + 1))
    end = start[1:].copy()  # of what is left of each list
    label, there, cell = np.full(len(sets), -1), np.zeros(len(often), bool), np.zeros(len(sets), bool)
    for seed in range(len(sets)):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        queue = [seed]
        while queue:
            q = queue.pop()
            mine, found = code[own[q] : own[q + 1]], []
            for c in mine[: lead[q]].tolist():
                a, b = start[c], end[c]
                left = holder[a:b]
                if b - a and (label[left] >= 0).any():
                    left = left[label[left] < 0]
                    end[c] = a + len(left)
                    holder[a : a + len(left)] = left
                if len(left):
                    found.append(left.copy())
            if not found:
                continue
            near = np.concatenate(found)
            near = near[(SHARED * size[near] <= OF * size[q]) & (SHARED * size[q] <= OF * size[near])]
            near = near[~cell[near]]
            cell[near] = True
            near = np.flatnonzero(cell) if len(near) * 8 > len(cell) else np.unique(near)
            cell[near] = False
            if not len(near):
                continue
            there[mine] = True
            n = size[near]
            places = np.repeat(own[near] - offsets(n)[:-1], n) + np.arange(n.sum())
            both = np.add.reduceat(there[code[places]].astype(np.int64), offsets(n)[:-1])
            there[mine] = False
            new = near[OF * both >= SHARED * (n + size[q] - both)]
            label[new] = seed
            queue += new.tolist()
    return label


def groups(members: DataFrame) -> DataFrame:
    """members: s, rep, text, block. s, own, to: each node of a block, and the representative and node of its group that come first there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, now, held = word_hashes(), None, {}

        def found() -> pa.RecordBatch:
            nodes = sorted(held)  # by representative
            first = [nodes[i] for i in search([held[x] for x in nodes])] if nodes else []
            columns = [s for _, s in nodes], [rep for rep, _ in first], [s for _, s in first]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["s", "own", "to"])

        for batch in batches:
            for c, rep, s, t in zip(batch.column("block").to_pylist(), batch.column("rep").to_pylist(), batch.column("s").to_pylist(), texts(batch), strict=True):
                if c != now:
                    yield found()
                    now, held = c, {}
                x = shingles(t, hashes)
                # rows of one doc_id may have other texts than the one it represents
                if np.uint64(xxhash.xxh64_intdigest(x.tobytes())).view(np.int64) == s:
                    held[rep, s] = x
        yield found()

    small_batches(members.sparkSession)
    rows = members.select("block", "rep", "s", "text").repartition("block").sortWithinPartitions("block")
    return rows.mapInArrow(tidy(run), "s long, own long, to long")


def labels(rows: DataFrame, *found: DataFrame) -> DataFrame:
    """rows with the least node that the links found lead to, as label."""
    links = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    linked = components(links.select(F.col("s").alias("a"), F.col("to").alias("b")))
    return rows.join(linked.select(F.col("node").alias("s"), F.col("component").alias("label")), "s", "left").withColumn("label", F.coalesce("label", "s"))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """blocks: component, block, one (its label, null for a block of several). a, b: blocks that may hold nodes of different labels."""
    l, r = blocks.select("component", F.col("block").alias("a")), blocks.select("component", F.col("block").alias("b"), "one")
    several = l.join(blocks.where("one is null").select(F.col("block").alias("a")), "a").join(r, "component").where("one is not null or a <= b")
    alone = blocks.where("one is not null")
    of = alone.select("component", "one").distinct()
    apart = of.withColumnRenamed("one", "x").join(of.withColumnRenamed("one", "y"), "component").where("x < y")
    apart = apart.join(alone.select(F.col("one").alias("x"), F.col("block").alias("a")), "x").join(alone.select(F.col("one").alias("y"), F.col("block").alias("b")), "y")
    return several.select("a", "b").unionByName(apart.select("a", "b"))


def candidates_apart(entries: DataFrame, named: DataFrame, total: int) -> DataFrame:
    """The rows of named (s, label, ...) whose node agrees on a band with one of another label; entries: k, s."""
    held = materialise(entries.join(named.select("s", "label"), "s"))
    mixed = held.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    return named.join(join_hot(held, mixed, "k", (BANDS + 1) * total).select("s").distinct(), "s", "left_semi")


def split_groups(held: DataFrame, large: DataFrame, entries: DataFrame, total: int, block: int) -> DataFrame:
    """s, own of the nodes (s, rep, size, component, parts) of candidate components that are too large for one task; held: the same with their texts.

    A dealing of all, and one of every sixteenth node across the blocks of the first, join most of a group. Nodes that are candidates
    of another label's still have to meet: a label of at least a block of them has blocks of its own, the others share some. Blocks
    of one label need no comparison with each other; every other pair of a component's blocks is searched, so no link is lost.
    """
    deal = F.when(F.pmod(F.xxhash64("s", F.lit(2)), F.lit(16)) == 0, F.array(F.lit(1), F.lit(16))).otherwise(F.array(F.lit(1)))
    dealt = held.withColumn("deal", F.explode(deal))
    dealt = dealt.withColumn("block", F.xxhash64("component", "deal", F.pmod(F.xxhash64("s", "deal"), F.ceil(F.col("parts") / F.col("deal")))))
    first = materialise(groups(dealt).where("s <> to"))
    named = materialise(candidates_apart(entries, materialise(labels(large.drop("parts"), first)), total))
    whole = F.col("size") >= block
    sizes = named.groupBy("label").agg(F.sum("size").alias("size"), F.count("*").alias("n")).select("label", F.when(whole, F.ceil(F.col("size") / block)).alias("own_parts"), "n")
    named = materialise(join_hot(named, sizes, "label", total))
    alone = named.where("own_parts is not null").select("s", "rep", "component", F.col("label").alias("one"), F.xxhash64("label", F.pmod(F.xxhash64("s"), "own_parts")).alias("block"))
    shared = named.where("own_parts is null")
    weight = shared.groupBy("component").agg(F.ceil(F.sum("size") / block).alias("parts"), F.count("*").alias("n"))
    shared = join_hot(shared, weight, "component", total)
    shared = shared.select("s", "rep", "component", F.lit(None).cast("long").alias("one"), F.xxhash64("component", F.lit(-1), F.pmod(F.xxhash64("label"), "parts")).alias("block"))
    placed = materialise(alone.unionByName(shared))
    pairs = block_pairs(placed.select("component", "block", "one").distinct()).select(F.explode(F.array_distinct(F.array("a", "b"))).alias("at"), F.xxhash64("a", "b").alias("block"))
    rows = placed.withColumnRenamed("block", "at").join(pairs, "at").select("s", "block")
    second = groups(held.join(rows, "s")).where("s <> to")
    done = materialise(labels(large.select("s", "rep"), first, materialise(second)))
    least = done.groupBy("label").agg(F.min("rep").alias("own"), F.count("*").alias("n"))
    return join_hot(done, least, "label", total).select("s", "own")


def alike(nodes: DataFrame) -> DataFrame:
    """k, s: a key that nodes (s, fp) share if the links of op2's index join their fingerprints; none for a node without a partner."""
    codes = materialise(nodes.groupBy("fp").agg(F.count("*").alias("n")))
    linked = simhash.components(simhash.links(codes.select("fp", F.col("fp").alias("rep"))))
    of = codes.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    # a fingerprint that others lead to is no node of theirs
    least = linked.select(F.col("component").alias("fp")).distinct().withColumn("led_to", F.lit(True))
    of = of.join(least, "fp", "left").where("n > 1 or component is not null or led_to")
    keyed = materialise(of.select("fp", F.xxhash64(F.lit("fp"), F.coalesce("component", "fp")).alias("k"), "n"))
    return materialise(join_hot(nodes.select("s", "fp"), keyed, "fp", nodes.count()).select("k", "s"))


def near_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, group (the least doc_id of its near copies, of theirs and so on) of each document; block: shingles a task holds."""
    found = materialise(sketches(docs))
    # size, fp and keys are those of the set, whichever row they come from
    rep = F.coalesce(F.min("doc_id"), F.lit(NOBODY)).alias("rep")
    nodes = materialise(found.groupBy("s").agg(rep, F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("n")))
    entries = nodes.select(F.explode("keys").alias("k"), "s").unionByName(alike(nodes))
    least = entries.groupBy("k").agg(F.min("s").alias("b"), F.count("*").alias("n")).where("n > 1")
    total = nodes.count()
    links = join_hot(entries.withColumnRenamed("s", "a"), least, "k", (BANDS + 1) * total).where("a <> b").select("a", "b").distinct()
    linked = components(links)
    inside = linked.select(F.col("node").alias("s"), "component").unionByName(linked.select(F.col("component").alias("s"), "component").distinct())
    inside = materialise(inside.join(nodes.select("s", "rep", "size"), "s").select("s", "rep", "size", "component"))
    weight = inside.groupBy("component").agg(F.ceil(F.sum("size") / block).alias("parts"), F.count("*").alias("n"))
    inside = materialise(join_hot(inside, weight, "component", total))
    chosen = inside.where(F.col("rep") < NOBODY).select("s", F.col("rep").alias("doc_id"), "component", "parts")
    near = maybe(documents(docs), chosen.select("doc_id"), "doc_id").where("_maybe").drop("_maybe")
    held = near.join(chosen, "doc_id").select("s", F.col("doc_id").alias("rep"), "text", "component", "parts")
    nameless = inside.where(F.col("rep") == NOBODY)
    if not nameless.isEmpty():
        held = held.unionByName(nameless_texts(docs).join(nameless, "s").select("s", "rep", "text", "component", "parts"))
    held = materialise(held)
    own = groups(held.where("parts = 1").withColumnRenamed("component", "block")).select("s", "own")
    large = inside.where("parts > 1")
    if not large.isEmpty():
        own = own.unionByName(split_groups(held.where("parts > 1"), large, entries, total, block))
    own = materialise(own)
    release(held)
    named = nodes.join(own, "s", "left").select("s", F.nullif(F.coalesce("own", "rep"), F.lit(NOBODY)).alias("group"), "n")
    rows = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_hot(found, named, "s", rows).select("doc_id", "group")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The documents that represent their group, with all their columns; rows of one doc_id count as one document, rows without stay."""
    gone = materialise(near_copies(docs).where("doc_id <> group").select("doc_id").distinct())
    marked = maybe(docs, gone, "doc_id")
    stay = marked.where("_maybe").join(gone, "doc_id", "left_anti").select(docs.columns)
    return marked.where("not _maybe").select(docs.columns).unionByName(stay)
