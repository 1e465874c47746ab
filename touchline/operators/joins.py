"""Joins and group values that hold up when one key has a large part of the rows.

An unordered window such as ``max(x) OVER (PARTITION BY k)`` brings every row of a
key to one task. Here the group value is a partial aggregate, and the rows reach it
by a join whose hot keys adaptive execution can split.

It can split the left side of a left join, but not the right one; an inner join is
split on both sides, and may broadcast either. ``split_left_join`` therefore builds
a left join from an inner join and the rows it leaves out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import materialise

#: Column that numbers the rows of a left side.
ROW = "__row"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equally named keys where NULL equals NULL; the keys of the left side remain.

    Such keys are compared through expressions, so both sides get a shuffle for the
    join even if one is an aggregate over the same keys. Adaptive execution needs
    that: it does not split a hot key against a side without a shuffle of its own.
    """
    marked = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    matches = [left[k].eqNullSafe(marked[f"__{k}"]) for k in keys]
    return left.join(marked, matches, how).drop(*[f"__{k}" for k in keys])


def with_group_values(df: DataFrame, keys: Sequence[str], **values: Column) -> DataFrame:
    """``df`` with one more column per aggregate over the rows that share ``keys``."""
    groups = df.groupBy(*keys).agg(*[v.alias(name) for name, v in values.items()])
    return null_safe_join(df, groups, keys)


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join rows to one row per key, where NULL keys match nothing.

    For groups made by an aggregate over ``keys``: the hot keys of ``df`` stay splittable.
    """
    return null_safe_join(df, groups.dropna(subset=list(keys)), keys, how)


def least_row(order: Sequence[Column]) -> Column:
    """Aggregate: the smallest combination of the given columns as a struct."""
    return F.min(F.struct(*order))


def numbered(left: DataFrame) -> DataFrame:
    """``left`` with a number for each row, written: it is read for the pairs and for the rows without one."""
    return materialise(left.withColumn(ROW, F.monotonically_increasing_id()))


def with_unmatched(left: DataFrame, pairs: DataFrame) -> DataFrame:
    """Complete the inner join ``pairs`` of a ``numbered`` left side to a left join.

    Which rows have a pair is one bit each, set within the tasks and merged: a bitmap
    for every 32,768 rows. Only these bitmaps are written; the pairs themselves are
    worked out with the columns that the report reads.
    """
    bucket, bit = F.bitmap_bucket_number(ROW), F.bitmap_bit_position(ROW)
    bits = materialise(pairs.groupBy(bucket.alias("__bucket")).agg(F.bitmap_construct_agg(bit).alias("__bits")))
    placed = left.withColumns({"__at": bucket, "__bit": bit})
    met = placed.join(bits, F.col("__at") == F.col("__bucket"), "left")
    byte = F.conv(F.hex(F.substring("__bits", (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("getbit", byte, (F.col("__bit") % 8).cast("int")) == 1
    alone = met.filter(~F.coalesce(is_set, F.lit(False))).select(*left.columns)
    return pairs.unionByName(alone, allowMissingColumns=True).drop(ROW)


def split_left_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Left join for a right side in which one key may have very many rows. ``left`` may be ``numbered`` already."""
    left = left if ROW in left.columns else numbered(left)
    return with_unmatched(left, left.join(right, on))


#: Copies of a row that stay together, and copies that one task makes.
PIECE_COPIES, TASK_COPIES = 10_000, 10_000_000

#: Column with the number of copies that a row stands for.
TIMES = "__times"


def dealt_pieces(df: DataFrame, copies: str, piece: int = PIECE_COPIES, task: int = TASK_COPIES) -> DataFrame:
    """Rows that ``copied`` repeats as often as their column ``copies`` says, once where that is NULL.

    Few rows may stand for very many copies, which their own shuffle partitions, merged
    by the size of the rows, would make in a task or two. So the rows are dealt in pieces
    of ``piece`` copies at most, over a partition for every ``task`` copies.
    """
    times = F.coalesce(F.col(copies), F.lit(1)).cast("bigint")
    df = materialise(df.withColumn(TIMES, times))
    total = df.agg(F.sum(TIMES)).first()[0] or 0
    before = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(TIMES) - 1, F.lit(piece).cast("bigint")))
    pieces = df.filter(F.col(TIMES) > 0).withColumn("__before", before)
    pieces = pieces.withColumn(TIMES, F.least(F.col(TIMES) - F.col("__before"), F.lit(piece))).drop("__before")
    return pieces.repartition(max(1, -(-total // task)))


def copied(df: DataFrame) -> DataFrame:
    """Each row as often as its column ``TIMES`` says, which is 1 or more.

    As the last step of a report, behind its unions: what reads the copies then runs in
    the loop that makes them, while a union would write out each of them in between.
    """
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col(TIMES).cast("int")))).drop("__copy", TIMES)


def repeat_rows(df: DataFrame, copies: str, piece: int = PIECE_COPIES, task: int = TASK_COPIES) -> DataFrame:
    """Each row as often as its column ``copies`` says, once where that is NULL."""
    return copied(dealt_pieces(df, copies, piece, task))


#: Rows of one key and side that stay together.
PIECE_ROWS = 100_000


def star_left_join(
    left: DataFrame, key: str, rights: Mapping[str, DataFrame], piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Left join to several sides, ``{key column: rows}``, that all match the same ``key``.

    Each left row comes with every combination of its matches, as in a chain of left
    joins. All sides are dealt by the key once, and the chain stays where the rows lie.
    A key with more than ``piece_rows`` rows on some side is cut: the rows of its
    largest side are dealt over pieces, and its rows of the other sides are copied to
    each piece, so that no combination is lost or made twice. Rows without a key are
    not moved. Column names must differ; ``left`` is read more than once.
    """
    names = [key, *rights]
    sides = [left, *rights.values()]
    counted = [
        df.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
        .select("__key", F.struct(F.col("__n").alias("n"), F.lit(k).alias("side")).alias("__rows"))
        for k, df in zip(names, sides, strict=True)
    ]
    largest = reduce(DataFrame.unionAll, counted).groupBy("__key").agg(F.max("__rows").alias("__rows"))
    pieces = F.ceil(F.col("__rows.n") / piece_rows).cast("int")
    # At most one key for every ``piece_rows`` rows.
    cut = materialise(
        largest.filter(F.col("__rows.n") > piece_rows).select("__key", pieces.alias("__pieces"), F.col("__rows.side").alias("__dealt"))
    )

    def placed(df: DataFrame, k: str) -> DataFrame:
        met = df.filter(F.col(k).isNotNull()).join(cut, F.col(k) == F.col("__key"), "left").drop("__key")
        own = F.array(F.pmod(F.xxhash64(*df.columns, F.monotonically_increasing_id()), F.col("__pieces")).cast("int"))
        copies = F.sequence(F.lit(0), F.col("__pieces") - 1)
        piece = F.when(F.col("__pieces").isNull(), F.array(F.lit(0))).when(F.col("__dealt") == k, own).otherwise(copies)
        return met.withColumn("__piece", F.explode(piece)).drop("__pieces")

    joined = placed(left, key)
    for k, df in rights.items():
        right = placed(df, k).withColumnRenamed("__piece", f"__piece_{k}").drop("__dealt")
        joined = joined.join(right, (F.col(key) == F.col(k)) & (F.col("__piece") == F.col(f"__piece_{k}")), "left")
        # A copy that met nothing of the side that was dealt has its match in another piece.
        elsewhere = (F.col("__dealt") == k) & F.col(k).isNull()
        joined = joined.filter(~F.coalesce(elsewhere, F.lit(False))).drop(f"__piece_{k}")
    rest = left.filter(F.col(key).isNull())
    return joined.drop("__piece", "__dealt").unionByName(rest, allowMissingColumns=True)


def latest_before(
    asked: DataFrame, events: DataFrame, key: str, at: str, time: str, result: str
) -> DataFrame:
    """Add to each row of ``asked`` the latest event time of its key that is not after ``at``.

    Events and questions are dealt together by ranges of key and time, so a key, a day
    or an hour with very many of them lies over many ranges. The latest event so far is
    a running maximum within each range. What earlier ranges of the same key hold is
    carried in: one value for each key and range, summed up in order. No event meets a
    question, and none is compared with another of a different range.
    """
    moments = asked.select(F.col(key).alias("__key"), F.col(at).alias("__at")).distinct()
    moments = moments.filter(F.col("__key").isNotNull() & F.col("__at").isNotNull())
    happened = events.select(F.col(key).alias("__key"), F.col(time).alias("__time"))
    happened = join_groups(happened, moments.select("__key").distinct(), ["__key"], "left_semi")
    happened = happened.filter(F.col("__time").isNotNull()).distinct()
    asks = moments.select("__key", F.col("__at").alias("__moment"), F.lit(None).cast("timestamp_ntz").alias("__time"))
    both = happened.select("__key", F.col("__time").alias("__moment"), "__time").unionAll(asks)
    # Events lie before questions of the same moment.
    order = ["__moment", F.col("__time").asc_nulls_last()]
    ranged = both.repartitionByRange("__key", *order).withColumn("__range", F.spark_partition_id())
    ranged = materialise(ranged)

    # One row for each key, and one more for each range that a key goes on in.
    ends = ranged.groupBy("__key", "__range").agg(F.max("__time").alias("__end"))
    earlier = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__key", "__range", F.max("__end").over(earlier).alias("__carried"))
    carried = carried.filter(F.col("__carried").isNotNull())
    within = Window.partitionBy("__key", "__range").orderBy(*order)
    so_far = F.max("__time").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    questions = ranged.withColumn("__so_far", so_far).filter(F.col("__time").isNull())
    answers = join_groups(questions, carried, ["__key", "__range"]).select(
        "__key", F.col("__moment").alias("__at"), F.coalesce("__so_far", "__carried").alias(result)
    )
    on = (asked[key] == answers["__key"]) & (asked[at] == answers["__at"])
    return asked.join(answers, on, "left").drop("__key", "__at")
