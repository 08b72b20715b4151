"""Session settings and the few helpers that touch cluster state.

Everything else in the package is a lazy ``DataFrame -> DataFrame`` function.
"""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Upper bound, in rows x columns of a small side, for collecting lookups such as a vocabulary.
MAX_LOOKUP_ROWS = 100_000


def build_session(app: str = "tutorloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Partition counts are left to adaptive execution: a large initial number is coalesced down on
    small inputs, so the same code serves a laptop and a cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a session in one process (``local``, ``local[n]``) without the setting gets a temporary folder of its own, which goes with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an under-split input over all cores before expensive per-row text work.

    A large table arrives in more partitions than there are cores and passes through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_step(df: DataFrame, name: str) -> DataFrame:
    """Materialise an intermediate table in the shared folder and read it back.

    Cuts the lineage of iterative operators. Unlike cached blocks the files survive lost
    executors, and the reader gets real size statistics and column pruning.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tutorloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[Column], name: str = "ranked") -> DataFrame:
    """``df`` with ``rank``, its row's number (from 1) in ``order``, which should be a total one.

    The rows are dealt by ranges of the order and sorted there; a rank is the place in the partition after the sizes of the earlier ones.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = write_step(sorted_rows.withColumn("__part", F.spark_partition_id()).withColumn("rank", place + 1), name)
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(starts), "__part").withColumn("rank", F.col("rank") + F.col("__before")).drop("__part", "__before")


def bounded_rows(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> list:
    """Collect a lookup whose size is bounded by construction, failing loudly if it is not."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"lookup exceeds {max_rows} rows")
    return rows
