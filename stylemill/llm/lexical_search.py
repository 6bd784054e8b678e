"""Ranked lexical search: an inverted index in shards, searched document at a time by a heap merge of postings.

`build` cuts the documents into shards of at most SHARD_BYTES of text or SHARD_DOCS documents, where they lie, and writes for
each term of a shard one row of postings: the places of its documents in order of doc_id as differences, and the occurrences
in each, as bytes of seven bits (a number takes as many as it needs). One more row a shard has the ids and lengths of its
documents. `search` reads the rows of the terms asked for, brings those of a shard together, and merges for each item the
postings of its terms: a heap holds the next place of every list, all lists that stand at the least place make up that
document's score, and a heap of the best k keeps it if it beats the last of them. Once the k are there, lists whose largest
gains together can't beat the last one no longer drive the merge; documents that others bring look them up. The shards' lists
are merged by score, then doc_id.

A term's weight is floor(1000 ln((2N+2)/(2df+1))), what it adds to a document is weight * (10^9 tf div (1000 tf + 8m)) with
m = 100 - B + B n N div L (N documents with a term, L their terms, n the document's, B percent of length normalisation);
everything but the logarithm is in whole numbers. Counts are of all documents.

Items are searched in waves of ITEM_BYTES of text, whose terms are broadcast; each wave reads the index once more. A shard's
size bounds what a task holds, however frequent a term is.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. Null and empty texts
have no terms: such a document is not counted, such an item finds nothing. A null doc_id is ranked like any other, after
its equals; repeated rows are documents of their own, repeated items are ranked each for itself; an empty table ranks nothing.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_batches, materialise, offsets, release, small_batches, table, texts

TOP, B = 10, 90
#: Text and documents of a shard, and text of the items searched at a time.
SHARD_BYTES, SHARD_DOCS, ITEM_BYTES = 16 << 20, 1 << 16, 8 << 20
#: Bits of a heap's entry for the list it comes from.
SLOT = 24
_LOWER = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "shard long, term string, n_docs long, n_terms long, postings binary, ids binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of seven bits of whole numbers from 0 on, the lowest first, and where each number begins."""
    x = x.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        size += x >= np.uint64(1 << 7 * k)
    at = offsets(size)
    out = np.zeros(at[-1], np.uint8)
    for k in range(size.max(initial=0)):
        on = np.flatnonzero(size > k)
        out[at[on] + k] = (x[on] >> np.uint64(7 * k)) & np.uint64(127) | (size[on] > k + 1).astype(np.uint64) << np.uint64(7)
    return out, at


def decode(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(b < 128)
    start = np.concatenate([[0], end[:-1] + 1])[: len(end)]
    out = np.zeros(len(end), np.uint64)
    for k in range(int((end - start).max(initial=-1)) + 1):
        on = np.flatnonzero(start + k <= end)
        out[on] |= (b[start[on] + k] & np.uint64(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


class Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def shard_rows(shard: int, ids: list, words: list[np.ndarray], vocabulary: Vocabulary) -> pa.RecordBatch:
    """The postings of some documents, a row a term, and a row of their ids and lengths; words: numbers of each one's terms."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))  # null ids are the last places
    size = np.array([len(words[i]) for i in order], np.int64)
    key = np.concatenate([words[i] for i in order]) * len(order) + np.repeat(np.arange(len(order)), size)
    key, tf = np.unique(key, return_counts=True)
    term, place = key // len(order), key % len(order)
    first = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    step = np.diff(place, prepend=0)
    step[first[:-1]] = place[first[:-1]]
    data, at = encode(np.stack([step, tf - 1], 1).ravel())
    known = np.array([ids[i] for i in order if ids[i] is not None], np.int64)
    gaps, lengths = encode(np.diff(known))[0].tobytes() if len(known) else b"", encode(size)[0].tobytes()
    n = len(vocabulary)
    postings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at[2 * first]), pa.py_buffer(data)]).cast(pa.binary())
    names = pa.array(list(vocabulary), pa.binary()).cast(pa.string())
    one = lambda x, kind: pa.array([x], kind)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n + 1, shard, np.int64)), pa.concat_arrays([one(None, pa.string()), names]),
        pa.array(np.append(len(order), np.diff(first))), pa.array(np.append(size.sum(), np.add.reduceat(tf, first[:-1]))),
        pa.concat_arrays([one(lengths, pa.binary()), postings]), pa.concat_arrays([one(known[:1].tobytes() + gaps, pa.binary()), pa.nulls(n, pa.binary())]),
    ], names=["shard", "term", "n_docs", "n_terms", "postings", "ids"])


def build(docs: DataFrame) -> DataFrame:
    """The index, as a table: a row for each shard and term, and one without a term for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        vocabulary, ids, words, size = Vocabulary(), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                own = terms_of(text)
                if not own:
                    continue
                if ids and (size + len(text) > SHARD_BYTES or len(ids) == SHARD_DOCS):
                    yield shard_rows(shard, ids, words, vocabulary)
                    shard, vocabulary, ids, words, size = shard + 1, Vocabulary(), [], [], 0
                ids.append(doc_id)
                words.append(np.fromiter(map(vocabulary.__getitem__, own), np.int64, len(own)))
                size += len(text)
        if ids:
            yield shard_rows(shard, ids, words, vocabulary)

    return materialise(map_batches(documents(docs).withColumn("doc_id", F.col("doc_id").cast("long")), run, INDEX))


class Shard:
    """The postings of a shard for the terms asked for, as places and gains, decoded when first used."""

    def __init__(self, ids: bytes, lengths: bytes, n: int, total: int):
        known = np.frombuffer(ids[:8], np.int64)
        self.ids = np.concatenate([known, known + np.cumsum(decode(ids[8:]))]).tolist()
        size = decode(lengths)
        self.ids += [None] * (len(size) - len(self.ids))
        longest = int(size.max(initial=0))
        self.m = 100 - B + (B * size * n // total if B * longest * n < 2**63 else np.array([B * s * n // total for s in size.tolist()], np.int64))
        self.raw: dict[int, bytes] = {}
        self.lists: dict[int, tuple] = {}

    def postings(self, term: int, weight: int) -> tuple[list[int], list[int], int, dict[int, int]]:
        """Places, gains, the largest gain, and gains by place (made when first looked up)."""
        if term not in self.lists:
            x = decode(self.raw[term])
            place, tf = np.cumsum(x[::2]), x[1::2] + 1
            gain = weight * (10**9 * tf // (1000 * tf + 8 * self.m[place]))
            self.lists[term] = place.tolist(), gain.tolist(), int(gain.max()), {}
        return self.lists[term]


def top_places(lists: list[tuple], k: int) -> list[tuple[int, int]]:
    """The k best (score above 0, -place) of the merged lists, by document-at-a-time heap merge."""
    lists = sorted((x for x in lists if x[2] > 0), key=lambda x: x[2])
    reach, best, least, idle, mask = [], [], 0, 0, (1 << SLOT) - 1  # idle: so many of the weakest lists don't drive the merge
    for x in lists:
        reach.append((reach[-1] if reach else 0) + x[2])
    at = [0] * len(lists)
    heap = [x[0][0] << SLOT | s for s, x in enumerate(lists)]
    heapq.heapify(heap)
    replace, pop = heapq.heapreplace, heapq.heappop
    while heap:
        place, score = heap[0] >> SLOT, 0
        while heap and heap[0] >> SLOT == place:
            s = heap[0] & mask
            if s < idle:
                pop(heap)
                continue
            x, i = lists[s], at[s]
            score += x[1][i]
            i += 1
            if i < len(x[0]):
                at[s] = i
                replace(heap, x[0][i] << SLOT | s)
            else:
                pop(heap)
        for s in range(idle - 1, -1, -1):
            if score + reach[s] <= least:
                break
            x = lists[s]
            if not x[3]:
                x[3].update(zip(x[0], x[1], strict=True))
            score += x[3].get(place, 0)
        if score > least:  # places rise, so of equal scores the earlier stays
            if len(best) < k:
                heapq.heappush(best, (score, -place))
            else:
                replace(best, (score, -place))
            if len(best) == k:
                least = best[0][0]
                while idle < len(lists) and reach[idle] <= least:
                    idle += 1
    return best


def search_wave(index: DataFrame, items: list[tuple[int, int | None, list[bytes]]], n: int, total: int, k: int) -> DataFrame:
    """item (its number), item_id, doc_id, score: the k best of each shard; items: number, item_id, distinct terms."""
    spark = index.sparkSession
    asked = sorted({t for _, _, own in items for t in own})
    names = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(asked, pa.binary()).cast(pa.string()), "no": pa.array(range(len(asked)), pa.int64())})))  # of ITEM_BYTES of text
    df = dict(index.join(names, "term").groupBy("no").agg(F.sum("n_docs")).toArrow().to_pandas().itertuples(index=False, name=None))
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(len(asked))]
    number = {t: i for i, t in enumerate(asked)}
    shared = spark.sparkContext.broadcast((weight, [(i, item_id, [number[t] for t in own]) for i, item_id, own in items]))

    def ranked(shard: Shard) -> Iterator[tuple]:
        weight, wanted = shared.value
        for i, item_id, own in wanted:
            lists = [shard.postings(t, weight[t]) for t in own if t in shard.raw]
            for score, place in top_places(lists, k) if lists else ():
                yield i, item_id, shard.ids[-place], score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(shard: Shard) -> pa.RecordBatch:
            cols = list(zip(*ranked(shard), strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "item_id", "doc_id", "score"])

        now, shard = None, None
        for batch in batches:
            for name, no, postings, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "no", "postings", "ids")), strict=True):
                if name != now:
                    if shard:
                        yield out(shard)
                    now, shard = name, Shard(ids, postings, n, total)  # the row without a term comes first
                else:
                    shard.raw[no] = postings
        if shard:
            yield out(shard)

    heads = index.where("term is null").select("shard", F.lit(None).cast("long").alias("no"), "postings", "ids")
    rows = heads.unionByName(index.join(names, "term").select("shard", "no", "postings", "ids"))
    small_batches(spark)
    return rows.repartition("shard").sortWithinPartitions("shard", F.col("no").asc_nulls_first()).mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (item_id, text); index: of `build`."""
    n, total = index.where("term is null").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("octet_length(text) > 0")
    waves = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / ITEM_BYTES))
    found = []
    for wave in range(waves):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(waves)) == wave).toArrow()  # ITEM_BYTES
        parsed = [(i, item_id, list(dict.fromkeys(terms_of(text.encode())))) for i, (item_id, text) in enumerate(zip(*(own[c].to_pylist() for c in ("item_id", "text")), strict=True))]
        x = search_wave(index, parsed, n, max(1, total), k)
        best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        x = x.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        found.append(materialise(x) if waves > 1 else x)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item over all documents. The index goes once the result is there."""
    index = build(table(spark, sf_dir, "documents"))
    out = materialise(search(index, table(spark, sf_dir, "benchmark")))
    release(index)
    return out


_RUNS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDS = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_RUNS}'))"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY ALL),
t AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM l),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, t GROUP BY term),
q AS (SELECT DISTINCT item_id, {_WORDS} AS term FROM benchmark),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - {B} + ({B} * n * docs) // total))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN l USING (doc_id), t GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {TOP}
"""
