"""What several operators of this folder share: tables, broadcast bounds and Arrow batches cut to size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorloom.session import write_step

# Rows of a few fixed-width columns that may be sent to every executor, some tens of megabytes at most.
BROADCAST_ROWS = 1_000_000
# Rows of whole texts that travel to a Python worker at once: both sides hold them, the JVM twice while its buffer grows.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: ``df`` as a table in the shared folder."""
    return write_step(df, f"llm-{name}")


def small_batches(spark: SparkSession) -> None:
    """From now on tables of whole texts go to Python workers in batches of ``BATCH_ROWS`` rows at most; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def discard(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more: whatever was made of it is written too, so a lost executor doesn't need it."""
    context = df.sparkSession.sparkContext
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of a few fixed-width columns, marked for broadcast only if its counted size allows it.

    Beyond the bound the same join runs as a shuffle join, with the same result.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``chars`` bytes of text per slice (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > chars:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if len(sizes) > start:
            yield batch.slice(start)
    hand_back()


def hand_back() -> None:
    """Return freed memory to the system: a Python worker lives on between tasks and stages, beside others of its executor."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)
