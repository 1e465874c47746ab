"""Places of rows in an order, without one task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import materialise


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with ``name``: the place, from 0, of each row in the order of its group. Written.

    The rows are dealt by ranges of group and order and numbered as they lie. What a range holds of a group, one row
    for each such part, is summed up over the ranges before it; so a group may have any share of the rows. Nulls come
    first. Rows that are equal in group and order take their places in the order of the scan.
    """
    seen = rows.withColumn("__seen", F.monotonically_increasing_id())
    keys = [*group, *order, "__seen"]
    dealt = seen.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
    dealt = dealt.sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys]).drop("__seen")
    # The number's upper bits are the range, the lower ones count its rows.
    lying = materialise(
        dealt.withColumn("__place", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__place", 33))
    )
    held = lying.groupBy(*group, "__range").agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    start = held.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first"))
    start = start.select(*[F.col(k).alias(f"__{k}") for k in group], F.col("__range").alias("__at"), "__start")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in group]
    found = lying.join(start, [F.col("__range") == F.col("__at"), *same])
    return materialise(found.select(*rows.columns, (F.col("__place") + F.col("__start")).cast("long").alias(name)))
