"""Reports as stored tables: written partition by partition, renewed in place, read back as views."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from touchline.plans import leads
from touchline.session import delete_at_end, intermediate_tables, materialise, shared_folder

Tables = Mapping[str, DataFrame]

#: Folder name of the rows whose partition value is NULL, as Spark writes and reads it.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def write_partitions(df: DataFrame, path: str, partition_by: str, covers: Iterable[str | None] | None = None) -> None:
    """Replace the partitions of ``path`` that ``df`` has rows for, and no others.

    Running it again with the same rows changes nothing, and a run that fails leaves the old partitions, since the new
    ones take their place only when all are written. ``covers`` lists the partition values that the run was to renew:
    those of them that came out empty are removed, which rows alone cannot tell.
    """
    # Written before, so that a report may read the table that it renews, and the values that it has are those it wrote.
    rows = materialise(df)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)
    if covers is not None:
        spark = df.sparkSession
        asked = spark.createDataFrame([(v,) for v in covers], "value string")
        held = rows.select(F.col(partition_by).cast("string").alias("held")).distinct()
        empty = asked.join(held, F.col("value").eqNullSafe(F.col("held")), "left_anti").collect()
        _remove(spark, path, partition_by, {NO_VALUE if row["value"] is None else row["value"] for row in empty})


def _remove(spark: SparkSession, path: str, column: str, values: set[str]) -> None:
    """Delete partitions; folder names have unusual characters of a value as %XX."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(root):
        name, _, value = status.getPath().getName().partition("=")
        if name == column and unquote(value) in values:
            files.delete(status.getPath(), True)


def read_partitions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored table with the columns and types of the report."""
    # Every column may be missing in a file's rows; partition values keep the type that they had.
    loose = StructType([StructField(f.name, f.dataType, True) for f in schema])
    return spark.read.schema(loose).parquet(path).select(*schema.names)


def write_report(
    tables: Tables, report: Callable[..., DataFrame], path: str, partition_by: str | None = None,
    covers: Iterable[str | None] | None = None, **options,
) -> None:
    """Write a report as parquet; ``options`` are its parameters. Its intermediate tables go when it is done.

    Without ``partition_by`` the whole path is replaced, otherwise its partitions, see ``write_partitions``.
    """
    with intermediate_tables():
        df = report(tables, **options)
        if partition_by:
            write_partitions(df, path, partition_by, covers)
        else:
            df.write.mode("overwrite").parquet(path)


def account_group_view(tables: Tables, *, month: Column | None = None) -> DataFrame:
    """The account groups as a view over a table that was stored by closing month and then renewed.

    The months are written once, then those of accounts with an error flag again, as a daily run would.
    """
    closed = F.date_format("closedate", "yyyy-MM") if month is None else month
    groups = materialise(leads.account_group_map(tables).withColumn("month", closed))
    spark = groups.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/touchline/{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    write_partitions(groups, path, "month")
    flagged = groups.filter("test IS NOT NULL").select(F.col("month").alias("again")).distinct()
    write_partitions(groups.join(flagged, F.col("month").eqNullSafe(F.col("again")), "left_semi"), path, "month")
    name = f"account_groups_{uuid.uuid4().hex}"
    read_partitions(spark, path, groups.schema).drop("month").createOrReplaceTempView(name)
    return spark.sql(f"SELECT * FROM {name}")
