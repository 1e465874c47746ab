"""Session settings the jobs rely on."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings; all of them can be changed on a live session.
SQL_SETTINGS = {
    # Stored timestamps are zone-less UTC; truncation must not see another zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split over several tasks, also where the operator after
    # the join then needs a shuffle of its own.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


# Rows of one shuffle partition should fit in a task's memory with room to sort.
SHUFFLE_PARTITION_BYTES = 256 * 1024**2


def configure(
    spark: SparkSession,
    input_bytes: int | None = None,
    partition_bytes: int = SHUFFLE_PARTITION_BYTES,
    scan_bytes: int | None = None,
) -> SparkSession:
    """Apply the settings the jobs need to a running session, for good; ``configured`` puts them back.

    With the size of the largest input, shuffles start with a partition for every
    ``partition_bytes`` of it; adaptive execution merges small ones. ``scan_bytes`` is
    the size of a scan's splits, where the session's own is not wanted.
    """
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    if input_bytes:
        now = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.shuffle.partitions", str(max(now, -(-input_bytes // partition_bytes))))
    if scan_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(scan_bytes))
    return spark


@contextmanager
def configured(spark: SparkSession, **sizes: int) -> Iterator[SparkSession]:
    """The settings of ``configure`` for the reports that run inside."""
    keys = [*SQL_SETTINGS, "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"]
    before = {key: spark.conf.get(key, None) for key in keys}
    try:
        yield configure(spark, **sizes)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def local_session(cores: str = "*", app: str = "touchline", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Intermediate tables that were written and not yet deleted, each with its way to delete it.
_written: dict[str, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or where that is unset, the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or spark.conf.get("spark.sql.warehouse.dir")


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Count a folder among the intermediate tables."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    # Taken now, since the files may have to go after the session has ended.
    _written[path] = (target.getFileSystem(spark._jsc.hadoopConfiguration()), target)


def materialise(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read, and continue from the written table.

    Unlike a cached result it outlives executors, and the readers prune columns and
    skip row groups. The table is written when the report is built, not when it is
    read. It is deleted at the end of the enclosing ``intermediate_tables``, or when
    the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/touchline/{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def distilled(build: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``build``, written; what it wrote on the way is deleted at once.

    That is its tables, and its shuffle files: Spark deletes those when the driver's JVM has collected what refers to
    them, which may otherwise take until they fill the disks.
    """
    before = set(_written)
    result = materialise(build())
    *others, _ = [path for path in _written if path not in before]
    _delete(others)
    result.sparkSession._jvm.System.gc()
    return result


def _delete(paths: list[str]) -> None:
    for path in paths:
        files, target = _written.pop(path)
        files.delete(target, True)


@contextmanager
def intermediate_tables() -> Iterator[None]:
    """Delete, at the end, the tables that ``materialise`` wrote inside; read the reports before that."""
    before = set(_written)
    try:
        yield
    finally:
        _delete([path for path in _written if path not in before])


@atexit.register
def _delete_all() -> None:
    with suppress(Py4JError, OSError):  # without a JVM there is nothing to delete with
        _delete(list(_written))
