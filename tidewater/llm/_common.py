"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where that is unset, a temporary folder serves a local
    master (one machine), and any other master is refused.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/tidewater"


def new_path(spark: SparkSession, name: str) -> str:
    """Where a new table may be written in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path


def part_of_stored(path: str, column: str, value: int) -> pa.Table | None:
    """On an executor: the rows of a table written by ``column`` that have this value, or None."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    from tidewater.sources.storage import store_of

    store, at = store_of(f"{path}/{column}={value}")
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return None
    return pq.read_table(at, filesystem=store, partitioning=None, use_threads=False)


def drop_stored(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps.

    Spark deletes them when the driver's heap no longer holds their plans, which can be long after the
    results were written; a collection on the driver makes it now.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a string column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def trim() -> None:
    """Give freed memory back to the system: a worker serves many stages, and two of them share an executor with a JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at their end ``trim``, as the worker may stay idle beside others."""
    yield from batches
    trim()


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of text, so that arrays stay small."""
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // most
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)
    trim()


def even_slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """``slices``, with small ones put together over batches."""
    import pyarrow.compute as pc

    waiting, held = [], 0
    for whole in batches:
        for part in slices(whole, column, most):
            size = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if waiting and held + size > most:
                yield pa.concat_batches(waiting)
                waiting, held = [], 0
            waiting.append(part)
            held += size
    if waiting:
        yield pa.concat_batches(waiting)


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get a few MB at a time in place of up to 64, which several workers and the JVM beside them would hold each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).lower() in ("67108864b", "67108864", "64mb"):  # the default; another choice stands
        spark.conf.set(key, str(BATCH_BYTES))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and where each row's begin (one more at the end)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
