"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; whole texts travel in them, so they bound a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: A join's key is hot if it has more than one in HOT of all rows.
HOT = 2000
#: Words of 64 bits in the table of `maybe`, which bounds what is broadcast.
SIEVE = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text and the named columns only, so that further columns of the input can't clash."""
    return df.select("doc_id", *columns, "text")


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; 0 for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % folds, F.lit(0)).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, as in tests, under a folder of our own, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("stylemill.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="stylemill-")
            spark.conf.set("stylemill.checkpoint.dir", root)
    return f"{root.rstrip('/')}/stylemill-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stylemill_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the folders of tables from `materialise` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "stylemill_path", None)
        if path:
            jvm, conf = t.sparkSession._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def join_hot(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined by `key` with a table of one row a key, whose column n says how many of the `total` rows have it.

    Keys of over total / HOT rows, fewer than HOT of them, are broadcast and their rows stay where they are; only the others are
    shuffled, so no task gets more than that of one key. rows should be a stored table: both branches read it.
    """
    most = max(1, total // HOT)
    others = [c for c in table.columns if c not in (key, "n")]
    hot = table.where(F.col("n") > most).select(key, F.struct(*others).alias("_hot"))
    both = rows.join(F.broadcast(hot), key, "left")
    there = both.where("_hot is not null").select(*rows.columns, "_hot.*")
    rest = both.where("_hot is null").drop("_hot").join(table.where(F.col("n") <= most).drop("n"), key, how)
    return there.unionByName(rest.select(*rows.columns, *others))


def maybe(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows with `_maybe`, false where `key` is surely none of the ids; ids should be a stored table.

    A bit for each id's hash, in at most SIEVE words, is broadcast, so that rows without a partner need no shuffle in a join
    that follows. Where there are more ids than bits can tell apart, more rows are true; the join decides.
    """
    h = f"xxhash64(`{key}`, 7L)"
    slot, bit = F.expr(f"pmod({h}, {SIEVE}L)"), F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned({h}, 32), 64L) as int))")
    bits = ids.groupBy(slot.alias("_slot")).agg(F.bit_or(bit).alias("_bits"))
    both = rows.withColumn("_slot", slot).join(F.broadcast(bits), "_slot", "left")
    return both.select(*rows.columns, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False)).alias("_maybe"))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(tidy(fn), schema)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same, giving unused memory back when a task ends, for the next task of the worker may be of another stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what numpy and Python have freed
        if trim:
            trim(0)

    return run


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of a text column; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def rolling(word_hashes: np.ndarray, n: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hashes of all n-word windows from the words' hashes: a polynomial, then a mix of its bits."""
    if len(word_hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(word_hashes) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= np.uint64(factor)
        out += word_hashes[k : k + m]
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Memo(dict):
    """word -> value, computed when first asked for; emptied when it holds `most` entries, so memory stays bounded."""

    def __init__(self, fn: Callable, most: int = 400_000):
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.fn(key)
        return out


def offsets(lengths: list[int] | np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    return np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))]).astype(np.int64)


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]] along the first axis; 0 for empty segments."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0)
    return out
