"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts can be long, so a batch of Spark's default 10,000 rows may not fit a worker.
BATCH_ROWS = 1_000

#: What separates words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_shipped: set[str] = set()


def python_workers(spark: SparkSession) -> None:
    """Send this package's code to the workers, once per application, and bound the rows of their Arrow batches.

    The archive is code only; Spark copies it from the driver to every executor.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once per row however often ``use`` reads it.

    Spark pastes an expression into the lambda that mentions it, where it would run once per element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def crc_rest(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null for a null key."""
    return F.crc32(key.cast("string")) % F.lit(modulus)


def word_list(text: Column) -> Column:
    """Words between white space, in order; none for a null text."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(inner) > 0, F.split(inner, SPACE + "+")).otherwise(F.array().cast("array<string>"))


def digest(*columns: Column) -> Column:
    """128 bits of a row's values as text, for equality joins on long texts; nulls are distinct from empty texts."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("\u0001", *parts).cast("binary"))
