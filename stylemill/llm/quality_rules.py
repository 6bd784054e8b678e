"""Quality rules by compression bands.

Text that a general compressor shrinks far more, or far less, than prose of its length is rejected: zstandard
ratios (compressed size / size) of the whole document and of each fixed chunk are held against limits that depend
on the length, since a short text carries the format's overhead and offers few repeats. What is left after the last full
chunk is a chunk too, with the limits of a document of its length, so every byte is in a chunk.

Nulls and empty texts have no words and fail the base rule; a null doc_id stays null; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, documents, map_batches, rolling, texts

LEVEL = 3
CHUNK = 4096
#: (least bytes, lowest ratio kept, highest ratio kept) of a whole document; the last row whose bytes it reaches holds.
DOCUMENT_BANDS = ((0, 0.30, 1.60), (256, 0.30, 0.95), (1024, 0.27, 0.85), (4096, 0.22, 0.75), (16384, 0.18, 0.70), (65536, 0.15, 0.68))
#: The same for a chunk of CHUNK bytes, and the share of a document's bytes that may lie in chunks outside.
CHUNK_BAND, CHUNK_SHARE = (0.24, 0.80), 0.34
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_chunks_out long"


def repeat_words(words: list[bytes], hashes: dict, n: int = 8) -> int:
    """Words in n-word windows that occur twice or more in the text."""
    if len(words) <= n:
        return 0
    h = rolling(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), n)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:-n][twice] += 1
    edge[n:][twice] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def dup_lines(text: bytes) -> int:
    """\\n-split lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def limits(size: int) -> tuple[float, float]:
    return next((a, b) for least, a, b in reversed(DOCUMENT_BANDS) if size >= least)


def bands(text: bytes, zstd: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """Ratio of the whole text, its chunks, those outside their band, and whether the text is kept."""
    if not text:
        return 0.0, 0, 0, False
    ratio = len(zstd.compress(text)) / len(text)
    low, high = limits(len(text))
    inside = low <= ratio <= high
    if len(text) < CHUNK:  # the only chunk
        return ratio, 1, int(not inside), inside
    outside = bad = 0
    for i in range(0, len(text), CHUNK):
        chunk = text[i : i + CHUNK]
        least, most = CHUNK_BAND if len(chunk) == CHUNK else limits(len(chunk))
        if not least <= len(zstd.compress(chunk)) / len(chunk) <= most:
            outside, bad = outside + 1, bad + len(chunk)
    return ratio, -(-len(text) // CHUNK), outside, inside and bad <= CHUNK_SHARE * len(text)


class Judge:
    """The parts of the verdict on a text."""

    def __init__(self):
        self.zstd, self.hashes = zstandard.ZstdCompressor(level=LEVEL), Memo(xxhash.xxh64_intdigest, 200_000)

    def base(self, words: list[bytes]) -> tuple[int, bool]:
        """n_repeat_words and base_failed."""
        repeats = repeat_words(words, self.hashes)
        return repeats, len(words) < 20 or 100 * repeats > 30 * len(words)

    def keeps(self, text: bytes) -> bool:
        return not self.base(text.split())[1] and bands(text, self.zstd)[3]

    def __call__(self, text: bytes) -> tuple:
        """SCHEMA without the doc_id."""
        words = text.split()
        repeats, failed = self.base(words)
        ratio, chunks, outside, inside = bands(text, self.zstd)
        joined = b"".join(words)
        chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
        return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), dup_lines(text), repeats, failed, inside and not failed, ratio, chunks, outside


def measure(docs: DataFrame) -> DataFrame:
    """A row for each document: the base counts, the ratios and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge()
        for batch in batches:
            rows = [judge(t) for t in texts(batch)]
            cols = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64())] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_batches(documents(docs), run, SCHEMA)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns, in one pass over the texts and without a shuffle."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge()
        for batch in batches:
            yield batch.filter(pa.array([judge.keeps(t) for t in texts(batch)], pa.bool_()))

    return map_batches(docs, run, schema)


def op6(docs: DataFrame) -> DataFrame:
    return measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("ratio", 6).alias("ratio"), "n_chunks", "n_chunks_out")
