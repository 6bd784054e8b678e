"""LM scoring by Katz backoff with Good-Turing discounts and exactly normalised backoff weights.

Tokens are a text's words (A-Z lower-cased) and one end; every word of the training documents is a history and a successor of
its own, known by 63 bits of its hash. P(v | u) recurses from bigrams to smoothed unigrams:

    P(v | u) = d(c) c(u, v) / c(u)   if the bigram was seen c times in training; d(c) = 1 for c > 5
             = alpha(u) P(v)         else, alpha(u) spreading exactly what the discounts freed over what was not seen after u
    P(v)     = (c(v) + 0.1) / (N + 0.1 (V + 1))

A history all of whose bigrams are frequent frees nothing; one more count is made room for there, c(u) + 1. A history that was
never seen has alpha 1.

Counts come from all training documents, and nothing of theirs is collected or broadcast but N, V and the counts of counts. They
stay in tables partitioned by key, which batches of documents look up (exchange.py):

1. Each batch sends its distinct words and bigrams, with their training counts here, to the parts they belong to. A part adds up
   its table of n-grams and answers each batch with the totals. One batch of those with a bigram is told that it leads for it.
2. With the totals at hand, a batch scores all tokens but for what backoff weights decide, and sends the parts of its histories
   what the bigrams it leads for add to them: the counts of the successors, and how many have counts of 1 to 5. A part adds them
   up by history, which are the backoff weights, and answers those who asked: the batches with unseen bigrams.

Null texts are empty: their score is that of the end alone. A null doc_id counts as held out; repeated rows of training
documents are counted as often as they occur. Batches follow the order of rows, so the input should be a stored table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, documents, map_batches, materialise, mix, offsets, segment_sum, texts
from .exchange import SCHEMA, batch_key, batches_of, by_key, by_part, changed, gather, pack, pack_rows, parts, rows, unpack, unpack_rows

CUTOFF, DELTA, BATCH_BYTES = 5, 0.1, 4_000_000
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ONE = np.uint64(1)


def word_key(word: bytes) -> int:
    """Keys of words are odd, those of bigrams even."""
    return xxhash.xxh64_intdigest(word) | 1


#: No word holds a space.
END, START = np.uint64(word_key(b" ")), np.uint64(word_key(b"  "))


def in_training(ids: list, folds: int) -> np.ndarray:
    return np.array([x is not None and zlib.crc32(str(x).encode()) % folds != 0 for x in ids], bool)


class Tokens:
    """The tokens of a batch, laid end to end, and the distinct keys of their words and bigrams."""

    def __init__(self, batch: pa.RecordBatch, folds: int, memo: Memo):
        split = [t.lower().split() for t in texts(batch)]
        end = np.array([END], np.uint64)
        code = np.concatenate([np.zeros(0, np.uint64), *(x for w in split for x in (np.fromiter(map(memo.__getitem__, w), np.uint64, len(w)), end))])
        self.bounds, n = offsets([len(w) + 1 for w in split]), len(code)
        self.before = np.concatenate([code[:0], [START], code[:-1]])[:n].astype(np.uint64)  # the history of each token
        self.before[self.bounds[:-1]] = START
        bigram = mix(self.before * np.uint64(0x9E3779B97F4A7C15) + code) & ~_ONE
        self.train = in_training(batch.column("doc_id").to_pylist(), folds)
        own = np.repeat(self.train, np.diff(self.bounds))
        self.keys, self.first, place = np.unique(np.concatenate([bigram, code]), return_index=True, return_inverse=True)
        self.bigram, self.word = place[:n], place[n:]
        self.history = np.concatenate([[0], self.word[:-1]])[:n]  # the place of the history's word; of the start, that of an end, as frequent
        self.history[self.bounds[:-1]] = self.word[self.bounds[1:] - 1]
        self.counts = np.bincount(place, np.concatenate([own, own]), len(self.keys)).astype(np.int64)


def requests(docs: DataFrame, folds: int, n_parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_key, 200_000)
        for number, batch in enumerate(gather(batches, BATCH_BYTES)):
            t, key = Tokens(batch, folds, memo), batch_key(number)
            yield rows([(p, key, "need", pack(t.keys[i], t.counts[i])) for p, i in by_part(t.keys, n_parts)])

    return map_batches(docs, run, SCHEMA)


def totals(p: int, held: list[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
    """Adds up a part's table of n-grams; answers each batch with twice the total of each key, plus one if it leads for it."""
    got = sorted(((b, *unpack(d)) for b, _, d in held), key=lambda x: x[0])
    keys, first, inverse = np.unique(np.concatenate([k for _, k, _ in got]), return_index=True, return_inverse=True)
    n = np.bincount(inverse, np.concatenate([c for _, _, c in got]), len(keys)).astype(np.int64)
    answer = 2 * n[inverse]
    answer[first] += 1
    at = offsets([len(k) for _, k, _ in got])
    yield rows([(p, b, "count", pack(np.array([p], np.int64), answer[at[i] : at[i + 1]])) for i, (b, _, _) in enumerate(got)])
    word = keys & _ONE == 1
    yield rows([(p, 0, "total", pack(np.array([n[word].sum(), (n[word] > 0).sum(), *((n[~word] == r).sum() for r in range(1, CUTOFF + 2))], np.int64)))])


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discounts, Katz's way, from the counts of counts n[1..CUTOFF+1]; where they aren't in (0, 1), (r - 1/2) / r."""
    d = np.ones(CUTOFF + 2)
    common = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUTOFF + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


class Model:
    """What is known of the whole corpus: N, V and the discounts."""

    def __init__(self, tokens: int, types: int, counts_of_counts: list[int]):
        self.tokens, self.types = tokens, types
        self.total = tokens + DELTA * (types + 1)
        self.discount = discounts(np.array([0.0, *counts_of_counts]))

    def share(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of (freed counts / unseen mass) of each history, and whether it has to make room for one more count.

        sums: for each history the training counts of what was seen after it, how many words that is, how many bigrams have counts 1 to CUTOFF.
        """
        freed = sum(sums[:, 1 + r] * r * (1 - self.discount[r]) for r in range(1, CUTOFF + 1))
        room = sums[:, 2:].sum(1) == 0
        unseen = (self.tokens - sums[:, 0] + DELTA * (self.types + 1 - sums[:, 1])) / self.total
        return np.log10(np.where(room, 1.0, freed) / unseen), room


def first_scores(model: Model, folds: int, n_parts: int):
    def run(_: int, held: list[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
        key = held[0][0]
        packed = next((d for _, kind, d in held if kind == "rows"), None)
        if packed is None:
            raise changed()
        batch = unpack_rows(packed)
        t = Tokens(batch, folds, Memo(word_key, 200_000))
        answers = {-1: np.zeros(0, np.int64)} | {int(x[0][0]): x[1] for _, kind, d in held if kind == "count" for x in [unpack(d)]}
        n = np.concatenate([np.zeros(0, np.int64), *(answers.get(p, answers[-1]) for p, _ in by_part(t.keys, n_parts))])
        if len(n) != len(t.keys):
            raise changed()
        leads, n = n & 1 == 1, n >> 1
        c, cw, cu = n[t.bigram], n[t.word], n[t.history]
        word, seen = np.log10((cw + DELTA) / model.total), c > 0
        x = np.where(seen, np.log10(model.discount[np.minimum(c, CUTOFF + 1)] * np.maximum(c, 1)), word)
        # a history with a bigram of a count up to CUTOFF frees something; of the others, and where a bigram is new, its part knows
        history = np.where(t.before == START, len(n), t.history)
        frees = np.bincount(history, seen & (c <= CUTOFF), len(n) + 1) > 0
        pending = np.flatnonzero((cu > 0) & ~(seen & frees[history]))
        x -= np.where(seen & frees[history], np.log10(np.maximum(cu, 1)), 0.0)
        ask, first, place = np.unique(t.before[pending], return_index=True, return_inverse=True)
        size, per = np.diff(t.bounds), lambda v: segment_sum(v, t.bounds)
        doc = np.repeat(np.arange(len(size)), size)
        state = pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(~t.train), pa.array(size), pa.array(per((cw > 0).astype(float)).round().astype(np.int64)), pa.array(np.full(len(size), model.tokens, np.int64)), pa.array(per(word)), pa.array(per(x))],
            names=[f.split()[0] for f in RESULT.split(", ")],
        )
        out = [(key, key, "state", pack_rows(state)), (key, key, "pending", pack(doc[pending].astype(np.int32), place.astype(np.int32), seen[pending].astype(np.uint8), cu[pending][first]))]
        led = t.first[(t.keys & _ONE == 0) & leads & (n > 0)]  # a token with each bigram that this batch leads for
        own, inverse = np.unique(t.before[led], return_inverse=True)
        sums = [np.bincount(inverse, w, len(own)).astype(np.int64) for w in (cw[led], np.ones(len(led)), *(c[led] == r for r in range(1, CUTOFF + 1)))]
        out += [(p, key, "history", pack(own[i], *(s[i] for s in sums))) for p, i in by_part(own, n_parts)]
        out += [(p, key, "ask", pack(ask[i])) for p, i in by_part(ask, n_parts)]
        yield rows(out)

    return run


def backoff_weights(model: Model):
    def run(p: int, held: list[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
        """Adds up a part's histories; answers each batch that asked with their weights."""
        for b, kind, d in held:
            if kind not in ("history", "ask"):
                yield rows([(p, b, kind, d)])
        got = [unpack(d) for _, kind, d in held if kind == "history"]
        asked = [(b, *unpack(d)) for b, kind, d in held if kind == "ask"]
        if asked:
            keys, inverse = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            sums = np.stack([np.bincount(inverse, np.concatenate([g[k] for g in got]), len(keys)) for k in range(1, CUTOFF + 3)], axis=1)
            share, room = model.share(sums)
            at = [np.searchsorted(keys, k) for _, k in asked]
            yield rows([(p, b, "weight", pack(np.array([p], np.int64), share[i], room[i].astype(np.uint8))) for (b, _), i in zip(asked, at, strict=True)])

    return run


def last_scores(_: int, held: list[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
    state = unpack_rows(next(d for _, kind, d in held if kind == "state"))
    doc, place, seen, count = unpack(next(d for _, kind, d in held if kind == "pending"))
    if len(doc):
        answers = sorted(((int(x[0][0]), x[1], x[2]) for _, kind, d in held if kind == "weight" for x in [unpack(d)]), key=lambda x: x[0])
        share, room = (np.concatenate([x[k] for x in answers]) for k in (1, 2))
        weight = np.where(seen > 0, 0.0, share[place]) - np.log10(count + room)[place]
        score = state.column("score").to_numpy() + np.bincount(doc, weight, state.num_rows)
        state = state.set_column(state.schema.get_field_index("score"), "score", pa.array(score))
    yield state


def score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document."""
    docs = documents(docs)
    n_parts = parts(docs)
    table = materialise(by_key(requests(docs, folds, n_parts), "p", n_parts, totals, SCHEMA))
    names = ["tokens", "types", *(f"n{r}" for r in range(1, CUTOFF + 2))]

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d in b.column("data").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in unpack(d)[0].tolist()], names=names)

    known = table.where("kind = 'total'").mapInArrow(unpacked, ", ".join(f"{c} long" for c in names)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    model = Model(known.tokens, known.types, list(known[2:]))
    looked_up = by_key(batches_of(docs, BATCH_BYTES).unionByName(table.where("kind = 'count'")), "batch", n_parts, first_scores(model, folds, n_parts), SCHEMA)
    weighed = by_key(looked_up, "p", n_parts, backoff_weights(model), SCHEMA)
    return by_key(weighed, "batch", n_parts, last_scores, RESULT)
