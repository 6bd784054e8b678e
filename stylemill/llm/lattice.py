"""Segmentation lattices of words over a fixed public vocabulary.

A word's lattice has a node before and after each character and an edge for each vocabulary piece that matches;
characters without a piece of their own get a fallback edge. Many words are laid out in flat arrays, so that the
recursions over their lattices run in numpy, one word position at a time. Words are never cut: sums over those of more than
SCALED characters run in logarithms, over shorter ones in scaled numbers, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import sentencepiece

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: Scaled numbers stay within the floats' range up to this many characters.
SCALED = 48
#: Words and (positions x words) of one group of lattices; a longer word is a group of its own.
GROUP, CELLS = 4000, 400_000


class Trie:
    """All places at which any of some strings occurs in a text; all of them step through the text together."""

    def __init__(self, strings: list[str]):
        chars = sorted({c for s in strings for c in s})
        self.cls = np.zeros(0x110000, np.int32)  # 0: in none of the strings
        self.cls[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width, self.longest = len(chars) + 1, max(map(len, strings))
        states, keys, after = {"": 0}, [], []
        for s in strings:
            for k in range(1, len(s) + 1):
                if s[:k] not in states:
                    states[s[:k]] = len(states)
                    keys.append(states[s[: k - 1]] * self.width + int(self.cls[ord(s[k - 1])]))
                    after.append(states[s[:k]])
        order = np.argsort(keys)
        self.keys, self.after = np.array(keys, np.int64)[order], np.array(after, np.int64)[order]
        self.root = np.zeros(self.width, np.int64)
        self.root[self.keys[self.keys < self.width]] = self.after[self.keys < self.width]
        self.string = np.full(len(states), -1, np.int64)
        self.string[[states[s] for s in strings]] = np.arange(len(strings))

    def find(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, length, string) of every occurrence."""
        c = self.cls[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
        begin = np.flatnonzero(c)
        state, out = np.zeros(len(begin), np.int64), [(begin[:0], begin[:0], begin[:0])]
        for n in range(self.longest):
            if n == 0:
                state = self.root[c[begin]]
                begin, state = begin[state > 0], state[state > 0]
            else:
                key = state * self.width + c[begin + n]
                i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                on = self.keys[i] == key
                begin, state = begin[on], self.after[i[on]]
            whole = self.string[state] >= 0
            out.append((begin[whole], np.full(int(whole.sum()), n + 1), self.string[state[whole]]))
            inside = begin + n + 1 < len(c)
            begin, state = begin[inside], state[inside]
            if not len(begin):
                break
        a, b, d = (np.concatenate(x) for x in zip(*out, strict=True))
        return a, b, d


@dataclass
class Vocabulary:
    pieces: list[str]
    ids: np.ndarray  # the model's id of each piece; the last stands for fallbacks
    log_prior: np.ndarray  # Zipf-Mandelbrot over the public merge ranks
    trie: Trie
    byte_ids: np.ndarray


@cache
def vocabulary(path: str = MODEL) -> Vocabulary:
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and sp.id_to_piece(i).strip(MARK) or sp.id_to_piece(i) == MARK]
    pieces = [sp.id_to_piece(i) for i in ids]
    weight = 1 / (np.arange(len(pieces)) + 2.7)
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    return Vocabulary(pieces, np.array([*ids, -1]), np.log(np.append(weight, weight[-1] / 8) / (weight.sum() + weight[-1] / 8)), Trie(pieces), byte_ids)


@dataclass
class Lattices:
    """Edges of many words, sorted by word, then start, then end. piece: -1 for fallbacks (len(pieces) when used as an index)."""

    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    size: np.ndarray  # characters of each word


def build(words: list[str], v: Vocabulary) -> Lattices:
    """words: none of them with a line feed among other characters."""
    size = np.array([len(w) for w in words], np.int64)
    joined = "\n".join(words)
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    begin, length, piece = v.trie.find(joined)
    single = np.zeros(len(joined) + 1, bool)
    single[begin[length == 1]] = True
    single[first[1:] - 1] = True  # the line feeds between words
    single[len(joined)] = True
    bare = np.flatnonzero(~single)
    begin, length, piece = np.concatenate([begin, bare]), np.concatenate([length, np.ones(len(bare), np.int64)]), np.concatenate([piece, np.full(len(bare), len(v.pieces))])
    order = np.argsort(begin * 64 + length)
    begin, length, piece = begin[order], length[order], piece[order]
    word = np.repeat(np.arange(len(words)), size + 1)[begin]
    start = begin - first[word]
    return Lattices(word, start, start + length, piece, size)


#: Node weights are kept within the floats' range by this factor for each character.
STEP = 40.0
POWERS = STEP ** np.arange(SCALED + 1)


def groups(words: list[str]) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive words whose lattices are built together."""
    first, longest = 0, 0
    for i, w in enumerate(words):
        longest = max(longest, len(w))
        if i > first and (i - first == GROUP or (i - first + 1) * longest > CELLS):
            yield first, i
            first, longest = i, len(w)
    if words:
        yield first, len(words)


def _sums(lat: Lattices, p: np.ndarray, back: bool) -> tuple[np.ndarray, bool]:
    """Sums over the paths that end (back: begin) at each [position, word, model], and whether they are logarithms.

    Others are times STEP to the characters of the paths. p: [piece, model].
    """
    n = len(lat.size)
    logs = bool(lat.size.max(initial=0) > SCALED)
    out = np.full((int(lat.size.max(initial=0)) + 1, n, p.shape[1]), -np.inf if logs else 0.0)
    out[lat.size if back else 0, np.arange(n)] = 0.0 if logs else 1.0
    here, there = (lat.start, lat.end) if back else (lat.end, lat.start)
    order = np.argsort(here * n + lat.word)
    word, there = lat.word[order], there[order]
    with np.errstate(divide="ignore"):
        weight = np.log(p)[lat.piece[order]] if logs else p[lat.piece[order]] * POWERS[(lat.end - lat.start)[order], None]
    bounds = np.searchsorted(here[order], np.arange(len(out) + 1))
    for k in range(len(out) - 2, -1, -1) if back else range(1, len(out)):
        a, b = bounds[k], bounds[k + 1]
        if a < b:
            w = word[a:b]
            runs = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            if logs:
                out[k, w[runs]] = np.logaddexp.reduceat(out[there[a:b], w] + weight[a:b], runs, axis=0)
            else:
                out[k, w[runs]] = np.add.reduceat(out[there[a:b], w] * weight[a:b], runs, axis=0)
    return out, logs


def log_likelihood(words: list[str], v: Vocabulary, p: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations of each word, for each model."""
    parts = [np.zeros((0, p.shape[1]))]
    for i, j in groups(words):
        lat = build(words[i:j], v)
        out, logs = _sums(lat, p, back=False)
        total = out[lat.size, np.arange(j - i)]
        parts.append(total if logs else np.log(np.maximum(total, 1e-300)) - (lat.size * np.log(STEP))[:, None])
    return np.concatenate(parts)


def edge_shares(lat: Lattices, p: np.ndarray, model: np.ndarray) -> np.ndarray:
    """The probability of each edge among all segmentations of its word; model: that of each word."""
    (a, logs), (b, _) = _sums(lat, p, back=False), _sums(lat, p, back=True)
    own = model[lat.word]
    z = b[0, np.arange(len(lat.size)), model][lat.word]
    begin, rest = a[lat.start, lat.word, own], b[lat.end, lat.word, own]
    if logs:
        with np.errstate(divide="ignore"):
            return np.exp(begin + np.log(p[lat.piece, own]) + rest - z)
    return begin * p[lat.piece, own] * POWERS[lat.end - lat.start] * rest / np.maximum(z, 1e-300)


def step_shares(lat: Lattices, p: np.ndarray) -> np.ndarray:
    """The probability of each edge given the node it leaves, of one model: p[piece]."""
    b, logs = _sums(lat, p[:, None], back=True)
    b = b[:, :, 0]
    if logs:
        return np.exp(np.log(p)[lat.piece] + b[lat.end, lat.word] - b[lat.start, lat.word])
    return p[lat.piece] * POWERS[lat.end - lat.start] * b[lat.end, lat.word] / np.maximum(b[lat.start, lat.word], 1e-300)
