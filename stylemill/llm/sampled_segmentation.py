"""SentencePiece encoding and decoding with segmentations sampled without replacement.

A text's lattice is the chain of its pre-tokens' lattices (see lattice.py). Pieces weigh by a Zipf-Mandelbrot prior over
their public merge ranks, so nothing is trained; with the backward sums of the lattice, each edge has its exact
probability given the node it leaves, and the segmentations of a text form a tree whose leaves are whole paths.

Gumbel top-k by perturbed A-star search: the largest perturbed log-probability of a set of paths is a Gumbel variable at
the set's log mass. Popping the set with the largest one yields the next sample, drawn from the set; what is left of the
set splits, at each step of the sample, into the paths that leave it there, whose maxima are Gumbel variables truncated
by the sample's. So the samples of a text are distinct, the first is an exact draw, and k of them are a draw without
replacement. The largest value left, kappa, gives each sample's inclusion score P(perturbed > kappa).
All draws are hashes of (row key, sample, position): they depend neither on partitioning nor on other rows.

An empty or null text has one segmentation, the empty one. Texts with fewer than k segmentations return them all.
Pre-tokens end where no piece of the vocabulary goes on: between letters and other characters, before spaces, at line feeds; they
are never cut, however long. A text that holds the word mark itself decodes to a space there, as the library has it, and
round_trip is false. Repeated rows get equal samples; a null doc_id is a key like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from . import lattice
from .common import documents, map_batches, mix, offsets, texts
from .toxicity import by_size

SAMPLES, SEED, GROUP, LIGHT = 2, 2024, 600_000, 80.0
#: The lattices held are started anew when they have so many edges, of 23 bytes each, or so many words.
EDGES, WORDS = 2_500_000, 75_000
_M = lattice.MARK
_PRE = regex.compile(rf"{_M}*(?:\p{{L}}+|[^\p{{L}}{_M}\n]+)|{_M}+|\n")
SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_sha256 string, round_trip boolean"


def pre_tokens(text: str) -> list[str]:
    """Runs of letters, and of other characters, with the spaces before them as word marks; and line feeds. The library's leading space comes first."""
    if not text:
        return []
    return _PRE.findall(lattice.MARK + text.replace(" ", lattice.MARK))


@cache
def vocabulary(path: str = lattice.MODEL) -> lattice.Vocabulary:
    """The vocabulary, of which no piece goes across the end of a pre-token."""
    v = lattice.vocabulary(path)
    across = [p for p in v.pieces if len(_PRE.findall(p)) != 1]
    if across:
        raise ValueError(f"pre-tokens would cut the pieces {across[:5]}")
    return v


class Nodes(dict):
    """word -> its number, and the edges of all nodes of the words met so far with their conditional probabilities.

    A node has its edges from the likeliest on, so a draw seldom looks at more than one. Started anew when the words are many.
    """

    #: base and size by word; first by node; the others by edge
    KINDS = {"base": np.int64, "size": np.int64, "first": np.int64, "node": np.int32, "length": np.uint8, "piece": np.uint16, "cum": np.float64, "log": np.float64}

    def __init__(self, v: lattice.Vocabulary, most: int = WORDS):
        super().__init__()
        self.v, self.most = v, most
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.room = {name: np.zeros(1024, kind) for name, kind in self.KINDS.items()}
        for name in self.KINDS:
            setattr(self, name, self.room[name][:0])
        self.append("first", np.zeros(1, np.int64))

    def append(self, name: str, values: np.ndarray) -> None:
        n = len(getattr(self, name))
        if n + len(values) > len(self.room[name]):
            wider = np.zeros((n + len(values)) * 5 // 4, self.KINDS[name])
            wider[:n] = self.room[name][:n]
            self.room[name] = wider
        self.room[name][n : n + len(values)] = values
        setattr(self, name, self.room[name][: n + len(values)])

    def __missing__(self, word: str) -> int:
        self[word] = out = len(self)
        self.fresh.append(word)
        return out

    def numbers(self, units: list[list[str]]) -> np.ndarray:
        """The numbers of all units of some texts, which the arrays then know."""
        if len(self) > self.most or len(self.node) > EDGES:
            self.restart()
        out = np.fromiter(chain.from_iterable(map(self.__getitem__, u) for u in units), np.int64)
        for i, j in lattice.groups(self.fresh):
            self.learn(self.fresh[i:j])
        self.fresh = []
        return out

    def learn(self, words: list[str]) -> None:
        lat = lattice.build(words, self.v)
        base = offsets(lat.size)[:-1]  # a node for each character; the last is the word's end
        node = base[lat.word] + lat.start
        first = np.searchsorted(node, np.arange(int(lat.size.sum()) + 1))
        prob = lattice.step_shares(lat, np.exp(self.v.log_prior))
        order = np.argsort(node - np.minimum(prob, 1) / 2, kind="stable")
        piece = lat.piece.copy()
        for i in np.flatnonzero(piece == len(self.v.pieces)):  # a character without a piece; if it is one byte, that byte's piece
            c = ord(words[lat.word[i]][lat.start[i]])
            piece[i] += 1 + c if c < 128 else 0
        prob, length, piece = prob[order], (lat.end - lat.start)[order], piece[order]
        total = np.add.reduceat(prob, first[:-1])
        prob /= np.where(total > 0, total, 1)[node]
        cum = np.cumsum(prob)
        cum -= np.concatenate([[0.0], cum])[first[:-1]][node]
        cum[first[1:] - 1] = 2.0
        with np.errstate(divide="ignore"):
            log = np.log(prob)
        nodes, edges = len(self.first) - 1, len(self.node)
        for name, values in {"base": base + nodes, "size": lat.size, "first": first[1:] + edges, "node": node + nodes, "length": length, "piece": piece, "cum": cum, "log": log}.items():
            self.append(name, values)

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node."""
        edge = self.first[node]
        open_ = np.flatnonzero(self.cum[edge] <= u)
        while len(open_):
            edge[open_] += 1
            open_ = open_[self.cum[edge[open_]] <= u[open_]]
        return edge

    def walk(self, word: np.ndarray, position: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random path of each word from its position to its end: the edges and which walk they belong to, in order."""
        walk, edges, owners, at = np.flatnonzero(position < self.size[word]), [], [], position.copy()
        base, size, step = self.base[word], self.size[word], 0
        steps = np.zeros(len(word), np.int64)
        while len(walk):
            u = (mix(seed[walk] + np.uint64(step)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.draw(base[walk] + at[walk], u)
            edges.append(edge)
            owners.append(walk)
            at[walk] += self.length[edge]
            steps[walk] += 1
            walk = walk[at[walk] < size[walk]]
            step += 1
        place, out = offsets(steps), np.zeros(int(steps.sum()), np.int64)
        for k, (e, w) in enumerate(zip(edges, owners, strict=True)):
            out[place[w] + k] = e
        return out, np.repeat(np.arange(len(word)), steps)


def exponential(seed: np.ndarray) -> np.ndarray:
    return -np.log1p(-((mix(seed) >> np.uint64(11)).astype(np.float64) * 2.0**-53))


class Path:
    """One sample of each of some texts: edges, their pre-tokens and the perturbed maxima of the sets of paths that leave there."""

    def __init__(self, nodes: Nodes, edges: np.ndarray, unit: np.ndarray, bounds: np.ndarray, own: np.ndarray, value: np.ndarray, seed: np.ndarray):
        self.edges, self.unit, self.bounds, self.value = edges, unit, bounds, value
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        logs = nodes.log[edges]
        run = np.concatenate([[0.0], np.cumsum(logs)])
        self.total = run[bounds[1:]] - run[bounds[:-1]]
        self.prefix = run[:-1] - run[bounds[:-1]][text]
        self.left = np.full(len(edges), -np.inf)
        self.text, self.logs, self.seed = text, logs, seed
        self.place = np.arange(len(edges)) - bounds[:-1][text]
        self.open = (self.place >= own[text]) & (logs < -1e-12)
        self.full = np.zeros(len(bounds) - 1, bool)
        self.draw(np.flatnonzero(self.open & (self.prefix > -LIGHT)))

    def draw(self, i: np.ndarray) -> None:
        location, text = self.prefix[i] + np.log(-np.expm1(self.logs[i])), self.text[i]
        self.left[i] = truncated(location, self.value[text], exponential(self.seed[text] + self.place[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))

    def best(self) -> np.ndarray:
        """The largest maximum left of each text; -inf for none.

        A variable exceeds its location by 37 at most, so sets of paths of little mass matter only where all others are as light.
        """
        out = np.full(len(self.bounds) - 1, -np.inf)
        some = np.flatnonzero(np.diff(self.bounds))
        if len(some):
            out[some] = np.maximum.reduceat(self.left, self.bounds[:-1][some])
        late = np.flatnonzero((out < 37 - LIGHT) & ~self.full)
        if len(late):
            self.full[late] = True
            more = np.flatnonzero(self.open & (self.prefix <= -LIGHT) & np.isin(self.text, late))
            if len(more):
                self.draw(more)
                return self.best()
        return out


def truncated(location: np.ndarray, bound: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Gumbel variables at these locations given that they lie below the bounds; e: exponential variables."""
    return -np.logaddexp(-bound, np.log(np.maximum(e, 1e-300)) - location)


def sample(units: list[list[str]], keys: np.ndarray, k: int, nodes: Nodes) -> tuple[list[tuple[Path, np.ndarray]], np.ndarray]:
    """Up to k distinct paths of each text: (path, which texts have it) for each rank, and kappa."""
    word, ub, n = nodes.numbers(units), offsets([len(u) for u in units]), len(units)
    text = np.repeat(np.arange(n), np.diff(ub))
    local = (np.arange(len(word)) - ub[text]).astype(np.uint64)

    def seeds(rank: int, tag: int) -> np.ndarray:
        return mix(keys + np.uint64((2 * rank + tag + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))

    def walks(rank: int, unit: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edges, owner = nodes.walk(word[unit], position, mix(seeds(rank, 0)[text[unit]] + local[unit] * np.uint64(64)))
        return edges, unit[owner]

    edges, unit = walks(0, np.arange(len(word)), np.zeros(len(word), np.int64))
    value = -np.log(exponential(seeds(0, 1) ^ np.uint64(0x5851F42D4C957F2D)))
    out = [(Path(nodes, edges, unit, np.searchsorted(unit, ub), np.zeros(n, np.int64), value, seeds(0, 1)), np.ones(n, bool))]
    used: dict[tuple[int, int], list[int]] = {}
    for rank in range(1, k):
        top = np.stack([p.best() for p, _ in out])
        source, value = top.argmax(0), top.max(0)
        there, draws = np.isfinite(value), seeds(rank, 0)
        chosen = np.zeros(n, np.int64)
        own = np.zeros(n, np.int64)
        head: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        head_unit: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        for d in np.flatnonzero(there):
            p = out[source[d]][0]
            a, b = p.bounds[d], p.bounds[d + 1]
            i = a + int(np.argmax(p.left[a:b]))
            gone = used.setdefault((int(source[d]), int(i)), [int(p.edges[i])])
            node = nodes.node[p.edges[i]]
            options = [x for x in range(nodes.first[node], nodes.first[node + 1]) if x not in gone]
            mass = np.cumsum(np.exp(nodes.log[options]))
            r = draws[d : d + 1]
            u = float(mix(r ^ np.uint64(0xD1B54A32D192ED03))[0] >> np.uint64(11)) * 2.0**-53
            edge = options[min(int(np.searchsorted(mass, u * mass[-1], side="right")), len(options) - 1)]
            gone.append(edge)
            rest = max(0.0, mass[-1] - np.exp(nodes.log[edge]))
            e = exponential(r ^ np.uint64(0xA0761D6478BD642F))
            p.left[i] = truncated(np.array([p.prefix[i] + np.log(rest)]), value[d : d + 1], e)[0] if len(options) > 1 and rest > 1e-12 else -np.inf
            chosen[d], own[d] = edge, i - a + 1
            head[d], head_unit[d] = np.append(p.edges[a:i], edge), p.unit[a : i + 1]
        at = [np.arange(head_unit[d][-1], ub[d + 1]) for d in np.flatnonzero(there)]
        begin = np.concatenate(at) if at else np.zeros(0, np.int64)
        position = np.zeros(len(begin), np.int64)
        if at:
            left = chosen[there]
            position[offsets([len(x) for x in at])[:-1]] = nodes.node[left] - nodes.base[word[[x[0] for x in at]]] + nodes.length[left]
        edges, unit = walks(rank, begin, position)
        tail = np.searchsorted(unit, np.stack([ub[:-1], ub[1:]]))
        joined = [(np.concatenate([head[d], edges[tail[0, d] : tail[1, d]]]), np.concatenate([head_unit[d], unit[tail[0, d] : tail[1, d]]])) if there[d] else (head[d], head_unit[d]) for d in range(n)]
        bounds = offsets([len(x) for x, _ in joined])
        out.append((Path(nodes, np.concatenate([x for x, _ in joined]), np.concatenate([x for _, x in joined]), bounds, own, np.where(there, value, 0.0), seeds(rank, 1)), there))
    return out, np.stack([p.best() for p, _ in out]).max(0)


class Codec:
    """Ids and bytes of the pieces of Nodes: the vocabulary's, the fallback for a longer character, the pieces of single bytes."""

    def __init__(self, v: lattice.Vocabulary):
        self.v = v
        self.ids = np.concatenate([v.ids, v.byte_ids[:128]]).astype(np.int32)
        strings = [x.replace(lattice.MARK, " ").encode() for x in v.pieces] + [b""] + [bytes([b]) for b in range(128)]
        self.length = np.array([len(x) for x in strings])
        self.at = offsets(self.length)
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.table = {int(i): x for i, x in zip(self.ids, strings, strict=True)} | {int(i): bytes([b]) for b, i in enumerate(v.byte_ids)}

    def decode_all(self, pieces: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all pieces, and where those of each text begin, with its leading space."""
        n = self.length[pieces]
        ends = offsets(n)
        out = self.flat[np.repeat(self.at[pieces] - ends[:-1], n) + np.arange(ends[-1])]
        return out.tobytes(), ends[bounds]

    def with_bytes(self, pieces: np.ndarray, chars: str, lengths: np.ndarray) -> np.ndarray:
        """The ids where a fallback stands for the byte pieces of its character."""
        at, parts, last = np.concatenate([[0], np.cumsum(lengths)]), [], 0
        for i in np.flatnonzero(pieces == len(self.v.pieces)):
            parts += [self.ids[pieces[last:i]], self.v.byte_ids[list(chars[at[i]].encode())].astype(np.int32)]
            last = i + 1
        return np.concatenate([*parts, self.ids[pieces[last:]]])

    def decode(self, ids: list[int]) -> bytes:
        """The text: the pieces' bytes without the leading space."""
        return b"".join(map(self.table.__getitem__, ids))[1:]


def encode(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, with_ids: bool = True) -> DataFrame:
    """A row for each document and sample, best perturbed value first: SCHEMA, and the ids if asked for."""
    schema = SCHEMA + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary()
        codec, nodes = Codec(v), Nodes(v)
        for batch in batches:
            doc_ids, at = batch.column("doc_id").to_pylist(), 0
            for group in by_size(texts(batch), GROUP):
                names, at = doc_ids[at : at + len(group)], at + len(group)
                keys = np.array([xxhash.xxh64_intdigest(str(x), seed) for x in names], np.uint64)
                units = [pre_tokens(t.decode("utf-8", "replace")) for t in group]
                paths, kappa = sample(units, keys, k, nodes)
                rows = []
                for rank, (p, there) in enumerate(paths):
                    pieces = nodes.piece[p.edges]
                    ids, (text, begin) = codec.ids[pieces], codec.decode_all(pieces, p.bounds)
                    bare = np.add.reduceat(np.append(pieces == len(v.pieces), False), p.bounds[:-1]) * (np.diff(p.bounds) > 0)
                    x = p.total - kappa
                    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                        inclusion = np.where(np.isfinite(kappa), np.where(x < -20, x - np.exp(x) / 2, np.log(-np.expm1(-np.exp(np.minimum(x, 30.0))))), 0.0)
                    for d in np.flatnonzero(there):
                        own, back = ids[p.bounds[d] : p.bounds[d + 1]], text[begin[d] + 1 : begin[d + 1]]
                        if bare[d]:
                            e = p.edges[p.bounds[d] : p.bounds[d + 1]]
                            own = codec.with_bytes(nodes.piece[e], "".join(units[d]), nodes.length[e].astype(np.int64))
                            back = codec.decode(own.tolist())
                        rows.append((names[d], rank + 1, len(own), float(p.total[d]), float(p.value[d]), float(inclusion[d]), hashlib.sha256(own.tobytes()).hexdigest(), back == group[d], own))
                cols = list(zip(*rows, strict=True))[: 8 + with_ids]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.bool_(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=False)], names=[x.split()[0] for x in schema.split(", ")])

    return map_batches(documents(docs), run, schema)
