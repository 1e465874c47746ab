"""Operators on touch and pageview logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.text import is_true
from touchline.operators.joins import join_groups


def first_touch(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the earliest, ties broken by the ``tie`` columns.

    The rank filter is applied before the shuffle as well, so a busy visitor sends
    one row per input task.
    """
    order = [F.col(time).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie]]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def conversion_limits(conversions: DataFrame, user: str, date: str) -> DataFrame:
    """Per visitor: the last conversion, and whether one has no date."""
    return conversions.groupBy(user).agg(
        F.max(date).alias("__last"), F.bool_or(F.col(date).isNull()).alias("__undated")
    )


def within_limits(time: Column) -> Column:
    """A touch counts if its visitor never converted, or converted at the same time or later."""
    return F.col("__last").isNull() | F.col("__undated") | (time <= F.col("__last"))


def before_conversion(
    df: DataFrame, conversions: DataFrame, user: str, time: str, date: str, keep_limits: bool = False
) -> DataFrame:
    """Rows of ``df`` not later than some conversion of the same visitor.

    A row is kept once however many conversions follow it. "Not later than some
    conversion" is "not later than the last one", so each visitor is one row here
    and no touch meets each of its conversions.
    """
    limits = conversion_limits(conversions, user, date)
    kept = join_groups(df, limits, [user]).filter(within_limits(F.col(time)))
    return kept if keep_limits else kept.drop("__last", "__undated")


def first_qualifying_per_day(df: DataFrame, user: str, day: str, time: str) -> DataFrame:
    """Rows at the earliest time of their visitor and day; ties are kept.

    Filter the qualifying rows first.
    """
    rank = F.dense_rank().over(Window.partitionBy(user, day).orderBy(F.col(time).asc_nulls_last()))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def prior_touch(
    qualifying: DataFrame, touches: DataFrame, user: str, ordinal: str, day: str | None, how: str = "left"
) -> DataFrame:
    """Pair each qualifying touch with the touch numbered one less, on the same day if ``day`` is given.

    Columns of the earlier touch come back with the prefix ``prior_``. A numbering
    gap gives no earlier touch, so this is a join and not a lag.
    """
    earlier = touches.select(*[F.col(c).alias(f"prior_{c}") for c in touches.columns])
    on = [
        qualifying[user] == earlier[f"prior_{user}"],
        qualifying[ordinal] - 1 == earlier[f"prior_{ordinal}"],
    ]
    if day:
        on.append(qualifying[day] == earlier[f"prior_{day}"])
    return qualifying.join(earlier, on, how)


def last_page_before(
    pages: DataFrame, keys: Sequence[str], time: str, target: Column, skip: Column, tie: Sequence[str],
    bucket: Column | None = None,
) -> DataFrame:
    """Per session, the latest page not later than the session's last target page.

    ``target`` marks target pages, ``skip`` the pages that may not be returned; pages
    without a time take no part. ``bucket`` cuts a session into spans that follow each
    other, hours if not given, so that a session of very many pages is not one task's.
    A span is folded to three rows at most, and the session then is folded the same way
    from those of its spans. Pages are read and dealt once.

    They are dealt by span also where they come dealt by session already, as from a join:
    else a long session would be one task's, and a task would hold the join's sorted rows,
    the spans' and the sessions' at a time.
    """
    rows = pages.withColumns(
        {
            "__target": F.when(target, F.col(time)),
            "__open": F.when(~skip, F.col(time)),
            "__span": F.date_trunc("hour", F.col(time)) if bucket is None else bucket,
        }
    )
    # Pages without a time are neither.
    rows = rows.filter(F.coalesce("__target", "__open").isNotNull())
    in_span = _fold(rows.repartition(*keys, "__span"), [*keys, "__span"])
    folded = in_span.filter("__target = __end OR __open = __last OR __open = __answer").drop("__end", "__last", "__answer")
    found = _fold(folded, keys).filter("__open = __answer")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in tie]))
    return found.withColumn("__rank", rank).filter("__rank = 1").select(*pages.columns)


def _fold(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group, the times of its last target, its last open page, and its last open page not later than that target."""
    group = Window.partitionBy(*keys)
    ends = rows.withColumns({"__end": F.max("__target").over(group), "__last": F.max("__open").over(group)})
    return ends.withColumn("__answer", F.max(F.when(F.col("__open") <= F.col("__end"), F.col("__open"))).over(group))


def session_flags(df: DataFrame, keys: Sequence[Column], flags: Mapping[str, Column]) -> DataFrame:
    """Whether any row of a session meets each condition."""
    return df.groupBy(*keys).agg(*[F.bool_or(cond).alias(name) for name, cond in flags.items()])


def true_flags(*names: str) -> Column:
    """All named flags are true (NULL counts as false)."""
    result = F.lit(True)
    for name in names:
        result = result & is_true(F.col(name))
    return result
