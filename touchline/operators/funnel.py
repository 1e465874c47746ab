"""Funnel counts and lead rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import is_true
from touchline.functions.times import day_diff, trunc
from touchline.session import materialise


def funnel_counts(
    df: DataFrame,
    keys: Sequence[str],
    stages: Mapping[str, tuple[str, Column | None]],
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Distinct ids per stage: ``{output: (id column, condition or None)}``; and whole-number ``sums`` over the rows.

    Several distinct counts in one aggregate would copy every row once per column. Here each id column is an aggregate
    of its own, first by group and id, which sums within the tasks and tells for each id which stages it reached, then
    by group. Rows without an id leave before that, so a stage that few reach moves few rows. The groups themselves, and
    the sums, come with the first column. With several id columns ``df`` is written first, with the columns it needs.
    """
    sums = dict(sums or {})
    by_id: dict[str, dict[str, Column]] = {}
    for name, (column, condition) in stages.items():
        by_id.setdefault(column, {})[name] = F.lit(True) if condition is None else condition
    flat = df.select(
        *keys,
        *[F.col(c).alias(f"__id_{k}") for k, c in enumerate(by_id)],
        *[F.col(c).isNotNull() & cond for c, conds in by_id.items() for cond in conds.values()],
        *sums.values(),
    ).toDF(*keys, *[f"__id_{k}" for k in range(len(by_id))], *[n for conds in by_id.values() for n in conds], *sums)
    flat = materialise(flat) if len(by_id) > 1 else flat

    parts = []
    for k, conditions in enumerate(by_id.values()):
        column, names = f"__id_{k}", list(conditions)
        totals = list(sums) if k == 0 else []
        rows = flat if k == 0 else flat.filter(F.col(column).isNotNull())
        reached = rows.groupBy(*keys, column).agg(
            *[F.bool_or(n).alias(n) for n in names], *[F.sum(t).alias(t) for t in totals]
        )
        parts.append(
            reached.groupBy(*keys).agg(*[F.count_if(n).alias(n) for n in names], *[F.sum(t).alias(t) for t in totals])
        )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part, allowMissingColumns=True)
    if len(parts) > 1:
        # A row per group and id column. Sums come with the first of them alone, so they stay NULL where they are.
        counts = [F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in stages]
        found = found.groupBy(*keys).agg(*counts, *[F.sum(t).alias(t) for t in sums])
    return found.select(*keys, *stages, *[F.col(t).cast("bigint").alias(t) for t in sums])


def semi_month(day: Column, month: Column) -> Column:
    """'1' for the first fifteen days of the month, '2' for the rest."""
    offset = day_diff(day, month)
    return F.when(offset < 15, F.lit("1")).when(offset > 14, F.lit("2"))


def conversion_rate(converted: Column, total: Column) -> Column:
    """Aggregate: share of rows that converted; NULL where there is nothing to divide by."""
    return F.try_divide(F.sum(converted).cast("double"), F.sum(total).cast("double"))


def credit_by_type(
    df: DataFrame, keys: Sequence[Column | str], kind: str, credit: str, columns: Mapping[str, str]
) -> DataFrame:
    """Credit summed per conversion type, one column per type: ``{output: type}``; missing types are 0."""
    sums = [
        F.sum(F.when(F.col(kind) == value, F.col(credit)).otherwise(F.lit(0.0))).alias(name)
        for name, value in columns.items()
    ]
    return df.groupBy(*keys).agg(*sums)


def milestones_long(
    df: DataFrame,
    keep_before: Sequence[str],
    keep_after: Sequence[str],
    events: Mapping[str, tuple[str, Column | None]],
) -> DataFrame:
    """Dates as events: ``{label: (date column, condition or None)}``; events without a date are dropped."""
    entries = []
    for label, (date, condition) in events.items():
        value = F.col(date) if condition is None else F.when(condition, F.col(date))
        entries.append(F.struct(value.alias("conversion_date"), F.lit(label).alias("conversion_type")))
    long = df.select(*keep_before, *keep_after, F.inline(F.array(*entries)))
    return (
        long.filter(F.col("conversion_date").isNotNull())
        .select(*keep_before, "conversion_date", "conversion_type", *keep_after)
        .distinct()
    )


def same_month(a: Column, b: Column) -> Column:
    return trunc(a, "month") == trunc(b, "month")


def won_value(stage: Column, base: Column, tax: Column, add_on_stage: Column, add_on: Column) -> Column:
    """Monthly value of a client; an add-on that is sold but has no value makes it unknown."""
    extra = F.when(add_on_stage == "Client", add_on).otherwise(F.lit(0.0))
    return F.when(stage == "Client", F.coalesce(base, F.lit(0.0)) + F.coalesce(tax, F.lit(0.0)) + extra)


@dataclass(frozen=True)
class LeadDefinition:
    """Values that decide whether a CRM record counts as a lead."""

    denied_sources: tuple[str, ...] = (
        "Outbound", "Test Lead", "Outbound Referral", "Radius", "Equity Structure Change",
        "Unassigned: Merged", "Inbound Partnership Interest", "Partnership Prospecting", "Content",
        "Re-engaged Contact", "List Upload", "NULL",
    )
    # These sources count once the person left details or converted.
    content_sources: tuple[str, ...] = ("Content", "List Upload")
    record_type: str = "RT_LEAD"
    denied_losses: tuple[str, ...] = ("Fake lead / account", "Missed Call - No Contact")
    denied_owner_role: str = "Sales Operations"

    def rules(self) -> dict[str, Column]:
        """The single conditions, by name."""

        def known(name: str) -> Column:
            return F.coalesce(F.col(name), F.lit("NULL"))

        details = F.coalesce("providedemail__c", "providedcompanydetails__c", "createdaccount__c").isNotNull()
        return {
            "source_ok": ~known("leadsource").isin(*self.denied_sources),
            "content_ok": F.col("leadsource").isin(*self.content_sources) & (details | is_true(F.col("isconverted"))),
            "record_type_ok": F.col("recordtypeid") == self.record_type,
            "loss_ok": ~known("loss_reason__c").isin(*self.denied_losses),
            "owner_ok": known("owner_role__c") != self.denied_owner_role,
            "not_deleted": ~F.col("isdeleted"),
        }

    def qualified(self) -> Column:
        r = self.rules()
        return (
            (r["source_ok"] | r["content_ok"])
            & r["record_type_ok"] & r["loss_ok"] & r["owner_ok"] & r["not_deleted"]
        )
