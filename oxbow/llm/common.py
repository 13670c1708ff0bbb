"""Helpers shared by the operators of this subpackage: staging, text buffers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A kernel works on slices of at most this many text bytes (or one longer document).
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session has none (as in tests on one machine), a temporary
    folder is set instead, and only with a local master.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    held = getattr(sc, "_oxbow_dir", None)
    if held is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = sc._oxbow_dir = "file://" + tempfile.mkdtemp(prefix="oxbow-")
        atexit.register(_remove_local, held[len("file://") :])
    return held


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/oxbow/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and
    the table outlives lost executors.  Its shuffle files can go once it is written."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._oxbow_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Remove staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_oxbow_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration() if hasattr(df.sparkSession, "_jsc") else df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner see that the shuffles of finished jobs are unreachable."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bits of a sieve: by the number of keys, up to 8 MB.
SIEVE_BITS_EACH, SIEVE_BITS_MOST = 16, 1 << 26


def sift(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be among ``keys``, and those whose key surely is not.

    A bit table of bounded size is broadcast; so texts that a join would find nothing
    for need no shuffle.  Where the table is full it holds back less, never wrongly.
    ``keys`` is a staged table.
    """
    width = 1 << 15
    n = min(SIEVE_BITS_MOST, max(width, 1 << (SIEVE_BITS_EACH * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(n))
    cell, bit = F.floor(place / width).cast("long"), F.pmod(place, F.lit(width))
    bits = keys.select(cell.alias("_cell"), bit.alias("_bit")).groupBy("_cell").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.floor(byte / F.pow(F.lit(2.0), (bit % 8).cast("int"))).cast("int") % 2 == 1, F.lit(False))
    marked = rows.withColumn("_cell", cell).join(F.broadcast(bits), "_cell", "left")  # at most SIEVE_BITS_MOST bits
    return marked.where(hit).select(rows.columns), marked.where(~hit).select(rows.columns)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null slot may still span bytes
        keep = np.asarray(column.is_valid())
        if ((at[1:] > at[:-1]) & ~keep).any():
            parts = [raw[a:b] for a, b, k in zip(at[:-1], at[1:], keep) if k]
            sizes = np.where(keep, at[1:] - at[:-1], 0)
            return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)), np.concatenate(([0], np.cumsum(sizes)))
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents with at most ``limit`` bytes together, one at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def batches(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
