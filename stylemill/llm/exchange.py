"""Lookups of many keys for each document, with the keys of a batch of documents in one row for each part of the key space.

Looking up something for each word of a corpus would shuffle a row for each word. Instead a task gathers documents into
batches of about 4 MB, and sends each part of the key space one row with the batch's distinct keys (sorted, as differences,
compressed), and gets one row back. The documents are read a second time to meet the answers: batches follow the order of rows, so
both reads must give the same rows in the same partitions, as a stored table does. A key occurs once for each batch, however often it occurs in the corpus, so frequent keys load no part
more than others. A batch never has more of these rows than it has distinct keys.

The parts follow the input: as many as shuffle partitions, or one for each PART_BYTES of text where that is more, so that
what a task holds of one part does not grow with the corpus. Each part and each batch has a partition of its own number.

Rows of an exchange: p (the part, or the batch's number where the row is for a batch), batch, kind, data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: Bytes of text whose keys are one part.
PART_BYTES = 64 << 20
SCHEMA = "p long, batch long, kind string, data binary"
_NAMES = ["p", "batch", "kind", "data"]
_ZSTD = zstandard.ZstdCompressor(level=1)
_UNZSTD = zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: sorted uint64 as differences; bytes of equal weight lie together, so that small numbers vanish."""
    out = []
    for x in arrays:
        x = np.ascontiguousarray(x)
        if x.dtype == np.uint64:
            x = np.diff(x, prepend=np.uint64(0))
        body = _ZSTD.compress(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()) if len(x) else b""
        out.append(x.dtype.str[1:].encode() + len(x).to_bytes(8, "little") + len(body).to_bytes(8, "little") + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = np.dtype(data[at : at + 2].decode()), int.from_bytes(data[at + 2 : at + 10], "little"), int.from_bytes(data[at + 10 : at + 18], "little")
        body = _UNZSTD.decompress(data[at + 18 : at + 18 + size]) if n else b""
        x = np.frombuffer(body, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n) if n else np.zeros(0, kind)
        out.append(np.cumsum(x, dtype=np.uint64) if kind == np.uint64 else x)
        at += 18 + size
    return out


def pack_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_rows(data: bytes) -> pa.RecordBatch:
    t = pa.ipc.open_stream(data).read_all().combine_chunks()
    return t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_pylist([], t.schema)


def rows(found: list[tuple[int, int, str, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=_NAMES)


def gather(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Rows together until their texts have `most` bytes."""
    held, size = [], 0
    for b in batches:
        t = b.column(b.schema.get_field_index(column))
        step = max(1, min(b.num_rows, 256))
        for i in range(0, b.num_rows, step):
            piece = b.slice(i, step)
            held.append(piece)
            size += int(np.sum(pc.fill_null(pc.binary_length(t.slice(i, step)), 0).to_numpy(zero_copy_only=False)))
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        if whole.num_rows:
            yield whole.to_batches()[0]


def batch_key(number: int) -> int:
    """The number of a task's batch: the task's partition and the place there, the same if the task runs again."""
    return (number << 32) + TaskContext.get().partitionId()


def batches_of(docs: DataFrame, most: int) -> DataFrame:
    """The rows of each batch of documents, packed. In a union with answers it comes first, for its partitions to keep their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(gather(batches, most)):
            key = batch_key(number)
            yield rows([(key, key, "rows", pack_rows(batch))])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(run), SCHEMA)


def changed() -> ValueError:
    return ValueError("the documents were not the same when they were read again: store them as a table first")


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each of some 64-bit hashes, by its upper bits."""
    return (keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """(part, where its keys are) of sorted keys."""
    cut = np.searchsorted(part_of(keys, parts), np.arange(parts + 1, dtype=np.uint64))
    for p in np.flatnonzero(np.diff(cut)):
        yield int(p), slice(int(cut[p]), int(cut[p + 1]))


def by_key(df: DataFrame, key: str, n_parts: int, fn: Callable[[int, list[tuple[int, str, bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn(key, its rows as (batch, kind, data)) for each value of p or batch, whose rows one task reads one key at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for k, batch, kind, data in zip(b.column(key).to_pylist(), b.column("batch").to_pylist(), b.column("kind").to_pylist(), b.column("data").to_pylist(), strict=True):
                if held and k != now:
                    yield from fn(now, held)
                    held = []
                now = k
                held.append((batch, kind, data))
        if held:
            yield from fn(now, held)

    small_batches(df.sparkSession)
    return df.repartitionById(n_parts, F.pmod(key, F.lit(n_parts)).cast("int")).sortWithinPartitions(key).mapInArrow(tidy(run), schema)


def parts(docs: DataFrame) -> int:
    """The number of parts for the texts of these documents."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
