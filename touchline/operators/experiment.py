"""Experiment exposure rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.joins import null_safe_join


def single_variant(df: DataFrame, user: Sequence[str], variant: str, first_of: str | None = None) -> DataFrame:
    """Rows of users who saw one variant only; exposures without a variant do not count against them.

    With ``first_of``, only the rows at the user's smallest value of that column
    remain. Adds ``min_variant``, ``max_variant`` and, with ``first_of``, ``min_exposure``.
    """
    values = [F.min(variant).alias("min_variant"), F.max(variant).alias("max_variant")]
    if first_of:
        values.append(F.min(first_of).alias("min_exposure"))
    users = df.groupBy(*user).agg(*values).filter("min_variant = max_variant")
    rows = null_safe_join(df, users, user)
    return rows.filter(F.col(first_of) == F.col("min_exposure")) if first_of else rows


def several_variants(df: DataFrame, user: str, variant: str) -> DataFrame:
    """Users (without NULL) who saw more than one variant."""
    seen = df.filter(F.col(user).isNotNull()).groupBy(user)
    return seen.agg(F.min(variant).alias("a"), F.max(variant).alias("b")).filter("a <> b").select(user)


def single_device(
    df: DataFrame, user: Sequence[str], device: str, last_device: str | None = None, **values: Column
) -> DataFrame:
    """One row per user who used exactly one known device, with that device and further aggregates.

    ``last_device`` names the column with the largest device name where ``df`` is
    already summed up and ``device`` holds the smallest.
    """
    users = df.groupBy(*user).agg(
        F.min(device).alias("device"),
        F.max(last_device or device).alias("__last"),
        *[value.alias(name) for name, value in values.items()],
    )
    return users.filter(F.col("device") == F.col("__last")).drop("__last")
