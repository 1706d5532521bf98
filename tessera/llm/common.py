"""What the training-data operators share: shared-folder tables, Arrow text access, word hashing.

Word hashes are 64-bit and computed for a whole Arrow batch at once, without one Python
object per word. All functions here treat null text as empty text.
"""

from __future__ import annotations

import contextlib
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that are turned into arrays at once; bounds a worker's memory for texts of any length.
SLICE = 1 << 18


def by_value(name: str) -> None:
    """Executors need no copy of this package: its functions travel with the tasks."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; a local one only where it is unset."""
    # only tests leave it unset; a cluster names a folder that all machines share
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "_tessera_dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            base = spark.sparkContext._tessera_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return base


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While it lasts, what runs sends workers batches of so many rows: for whole texts, since both ends of the pipe hold whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column, mod: int):
    """crc32 of the value as text, modulo mod: the contract's folds."""
    return F.crc32(column.cast("string").cast("binary")) % mod


def tidy(run):
    """run, a function for mapInArrow, that gives the worker's free memory back to the machine when it ends: workers outlive tasks and stages."""

    def whole(batches):
        import ctypes
        import gc

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole


def row_hash(key: str, text: str):
    """Tells rows of equal key apart by their text; rows equal in both have equal results."""
    return F.xxhash64(F.col(key), F.col(text))


def without(docs: DataFrame, gone: DataFrame, key: str, text: str) -> DataFrame:
    """docs without the rows of gone(k, r): key and row_hash. Null keys are keys like others; columns of docs may have any names."""
    k, r = (f"{x}_{uuid.uuid4().hex}" for x in "kr")
    gone = gone.select(F.col("k").alias(k), F.col("r").alias(r)).distinct()
    return docs.join(gone, F.col(key).eqNullSafe(F.col(k)) & (row_hash(key, text) == F.col(r)), "left_anti")


def unit(column, salt: str = ""):
    """A repeatable uniform number in [0, 1) for each value."""
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def strings(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column; nulls are empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null("")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = a.buffers()
    o = np.frombuffer(offs, np.int64)[a.offset : a.offset + len(a) + 1]
    u = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return u[o[0] : o[-1]], o - o[0]


def spans(offs: np.ndarray, most: int = SLICE):
    """Row ranges [a, b) of at most so many bytes, or of one row."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(31))) * U64(0x7FB5D329728EA185)
    h = (h ^ (h >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def byte_values(lower: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    if lower:
        v[65:91] = v[97:123]
    return v


def space_classes() -> np.ndarray:
    """1 for bytes of a word, 0 for the blanks 0x09-0x0D and 0x20."""
    c = np.ones(256, np.uint8)
    c[[9, 10, 11, 12, 13, 32]] = 0
    return c


def _runs(u8, offs, classes, values):
    cls = classes[u8]
    w = cls > 0
    start = w.copy()
    if len(u8):
        new = np.zeros(len(u8) + 1, bool)
        new[offs] = True
        start[1:] &= (cls[1:] != cls[:-1]) | new[1:-1]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, U64), at, np.zeros(0, np.int64)
    chars = u8[w]
    first = (np.cumsum(w) - 1)[at]
    lens = np.diff(first, append=len(chars))
    pos = np.arange(len(chars)) - np.repeat(first, lens)
    power = np.ones(int(lens.max()), U64)
    power[1:] = U64(0xD6E8FEB86659FD93)
    h = np.add.reduceat(values[chars] * np.cumprod(power)[pos], first)
    return mix(h + lens.astype(U64) * U64(0xC2B2AE3D27D4EB4F)), at, lens


def runs(u8, offs, classes, values):
    """Hash, first byte and byte length of each maximal run of one class (0 separates), row by row.

    A row longer than SLICE is cut at separators; a run longer than that is taken whole.
    """
    if len(offs) > 2 or len(u8) <= SLICE:
        return _runs(u8, offs, classes, values)
    out, a = [], 0
    while a < len(u8):
        b = min(len(u8), a + SLICE)
        while b < len(u8):
            gap = np.flatnonzero(classes[u8[b : b + SLICE]] == 0)
            b = b + int(gap[0]) if len(gap) else min(len(u8), b + SLICE)
            if len(gap):
                break
        h, at, lens = _runs(u8[a:b], np.array([0, b - a]), classes, values)
        out.append((h, at + a, lens))
        a = b
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words; fewer words are one shingle, none is none."""
    if not len(h):
        return h
    n = min(k, len(h))
    acc = h[: len(h) - n + 1] + U64(n)
    for i in range(1, n):
        acc = (acc ^ (acc >> U64(29))) * U64(0x9FB21C651E98DF25) + h[i : len(h) - n + 1 + i]
    return mix(acc)


def shingles_at(h: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words at each of some places."""
    acc = h[first] + U64(n)
    for i in range(1, n):
        acc = (acc ^ (acc >> U64(29))) * U64(0x9FB21C651E98DF25) + h[first + i]
    return mix(acc)


def sum_slices(rows: DataFrame, width: int, bits: int) -> np.ndarray:
    """Adds up rows (part int, slice int, counts binary of width int64 values) to one array of 2**bits.

    What comes to the driver has this fixed size, whatever the input; rows are added first by
    a salt, so that no task gathers those of all others.
    """

    def add(key, batch):
        import zlib

        total = np.zeros(width, np.int64)
        for b in batch.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(b), np.int64)
        return pa.table({"part": pa.array([0], pa.int32()), "slice": pa.array([key[-1].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "part int, slice int, counts binary"
    first = rows.groupBy((F.col("part") % 16).alias("salt"), "slice").applyInArrow(add, schema)
    import zlib

    out = np.zeros(1 << bits, np.int64)
    for r in first.groupBy("slice").applyInArrow(add, schema).select("slice", "counts").collect():
        out[r[0] * width : (r[0] + 1) * width] = np.frombuffer(zlib.decompress(bytes(r[1])), np.int64)
    return out


def slices_of(counts: np.ndarray, width: int) -> pa.RecordBatch:
    """One task's counts, cut for sum_slices; slices of zeros are left out."""
    import zlib

    from pyspark import TaskContext

    cut = counts.astype(np.int64).reshape(-1, width)
    some = np.flatnonzero(cut.any(axis=1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(some), pa.int32()), pa.array(some), pa.array([zlib.compress(cut[i].tobytes(), 1) for i in some], pa.binary())], names=["part", "slice", "counts"])
