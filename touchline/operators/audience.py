"""Who can be mailed, and who was."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.joins import join_groups


def suppressed_by_address(df: DataFrame, email: str, rules: Mapping[str, Column]) -> DataFrame:
    """Add one 0/1 column per rule: does any record with the same address meet it?

    Rows without an address are dropped.
    """
    marked = df.filter(F.col(email).isNotNull()).withColumns(
        {name: F.when(rule, 1).otherwise(0) for name, rule in rules.items()}
    )
    addresses = marked.groupBy(email).agg(*[F.max(n).alias(n) for n in rules])
    return join_groups(marked.drop(*rules), addresses, [email], "inner")


def audience_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``; NULL equals NULL."""
    return a.subtract(b)


def frequency_histogram(df: DataFrame, person: str, item: str) -> DataFrame:
    """How many people received how many different items."""
    per_person = df.select(person, item).distinct().groupBy(person).agg(F.count(item).alias("total_sent"))
    return per_person.groupBy("total_sent").agg(F.count(person).alias("count")).select("count", "total_sent")


def ids_by_group(df: DataFrame, group: str, ids: Mapping[str, Column]) -> DataFrame:
    """Long form ``(group, kind, id)`` of several id columns."""
    entries = [F.struct(F.lit(kind).alias("kind"), value.alias("id")) for kind, value in ids.items()]
    return df.select(group, F.inline(F.array(*entries)))


def joined_text(columns: Sequence[str], remove: str) -> Column:
    """Texts put together, without a filler word; missing ones are empty."""
    parts = [F.coalesce(F.replace(F.col(c), F.lit(remove), F.lit("")), F.lit("")) for c in columns]
    return F.concat(*parts)
