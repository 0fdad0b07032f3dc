"""Reading test tables, writing intermediate ones, and files written by tasks."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parlance.sources.storage import materialize, new_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared checkpoint folder and read it back; survives lost executors."""
    return materialize(df, name)


@contextmanager
def filtered_scans(spark: SparkSession):
    """Let Spark put a Bloom filter of a join's selective side before the shuffle of the other side, at any size.

    The filter's bits are bounded by Spark (a megabyte by default); where the keys are too many for it, more rows pass and
    are dropped by the join. Holds for frames that are written inside.
    """
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {f"{prefix}applicationSideScanSizeThreshold": "0", f"{prefix}creationSideThreshold": str(1 << 40)}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def output_folder(spark: SparkSession, name: str) -> str:
    return new_path(spark, name)


def file_system(folder: str):
    """Arrow's file system and path for a folder: local, HDFS or an object store."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def unique_name(prefix: str, suffix: str) -> str:
    """A file name no other attempt of a task uses; only names in a stored manifest count."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


def release_memory() -> None:
    """Return what a task has freed to the system: workers are reused, and otherwise keep the most they ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, function, schema: str, **options) -> DataFrame:
    """mapInArrow over non-empty batches; memory goes back when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function((batch for batch in batches if batch.num_rows), **options)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)
