"""Token counts by the whole-token shortcut.

The vocabulary is a BPE with byte fallback whose normaliser only writes spaces as word marks, so a mark in the text is a
space. No piece holds a mark after another character, and none holds a line feed; so merges never cross a line feed or
the start of a run of spaces, and a text's count is the sum over its pre-tokens (a run of spaces and what follows up to the
next space or line feed), plus one for each line feed. The driver proves once, by encoding every vocabulary string, which
pre-tokens encode alone as one token, and broadcasts them (32,000 strings at most): they count as one without a merge;
only the others are merged by the library, once for each distinct string of a task.

Null and empty texts have no tokens; a null doc_id stays null; repeated rows count alike; texts are never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_batches, texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CACHE = 300_000
MARK = "▁"
_MARK = MARK.encode()


class Counter:
    """Token counts of UTF-8 texts. Keys of `whole` and `rest`: pre-tokens, with a leading space where they have one."""

    def __init__(self, path: str, whole: dict[bytes, int] | None = None):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.feed = len(self.sp.encode("\n"))
        self.whole = self.proved() if whole is None else whole
        self.rest: dict[bytes, int] = {}

    def proved(self) -> dict[bytes, int]:
        """The vocabulary's strings that encode alone as one token."""
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("pieces of this vocabulary cross pre-tokens")
        strings = [p.replace(MARK, " ") for p in pieces]
        return {s.encode(): 1 for s, n in zip(strings, self.merged(strings), strict=True) if n == 1}

    def merged(self, strings: list[str]) -> list[int]:
        """The library's counts of pre-tokens. A line feed before each keeps the library's own leading space away from it."""
        return [len(x) - self.feed for x in self.sp.encode(["\n" + s for s in strings], num_threads=1)]

    def pre_tokens(self, text: bytes) -> tuple[list[bytes], int]:
        out: list[bytes] = []
        lines = (b" " + text.replace(_MARK, b" ")).split(b"\n")
        for line in lines:
            if b"  " in line or line[-1:] == b" ":
                out += re.findall(rb" *[^ ]+| +", line)
            elif line:
                first, *more = line.split(b" ")
                if first:
                    out.append(first)
                out += [b" " + x for x in more]
        return out, len(lines) - 1

    def count(self, batch: list[bytes]) -> list[int]:
        split = [self.pre_tokens(t) if t else ([], 0) for t in batch]
        if len(self.rest) > CACHE:
            self.rest.clear()
        if not self.rest:
            self.rest.update(self.whole)
        new: set[bytes] = set()
        for tokens, _ in split:
            new.update(tokens)
        new.difference_update(self.rest.keys())
        fresh = list(new)
        self.rest.update(zip(fresh, self.merged([x.decode("utf-8", "replace") for x in fresh]), strict=True))
        get = self.rest.__getitem__
        return [sum(map(get, tokens)) + feeds for tokens, feeds in split]


def count_tokens(docs: DataFrame, path: str = MODEL, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document."""

    whole = docs.sparkSession.sparkContext.broadcast(Counter(path).whole)  # the vocabulary at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, whole.value)
        for batch in batches:
            t = texts(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(map(len, t), pa.int64()), pa.array(counter.count(t), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return map_batches(documents(docs), run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
