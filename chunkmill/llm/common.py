"""Plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from chunkmill.functions.session import python_path

#: Rows in an Arrow batch: long documents stay a bounded share of a worker's memory.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    python_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches sent to Python workers by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.

    Where none is configured, a local session gets a new temporary folder, which goes with the driver; on a cluster, where
    executors couldn't see it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="chunkmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_temporary: list[list[str]] = []


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path below the shared folder; within temporaries() it goes at the end unless it is kept."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _temporary and not keep:
        _temporary[-1].append(path)
    return path


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Delete what was written within, but for what is kept, once all that needs it has been written itself."""
    _temporary.append([])
    try:
        yield
    finally:
        for path in _temporary.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage is cut and survives lost executors."""
    path = scratch(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write_file(uri: str, data: bytes) -> None:
    files, path = filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    with files.open_output_stream(path, compression=None) as out:
        out.write(data)


def read_file(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    files, path = filesystem(uri)
    with files.open_input_file(path) as source:
        source.seek(offset)
        return source.read() if length is None else source.read(length)


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


_caches: dict[str, Callable[[], None]] = {}


def use_cache(owner: str, clear: Callable[[], None]) -> None:
    """Let one operator at a time keep things in a Python worker: what others have kept goes when this one starts, back to the system too."""
    others = [drop for name, drop in _caches.items() if name != owner]
    for drop in others:
        drop()
    if others:
        give_back()
    _caches.clear()
    _caches[owner] = clear
