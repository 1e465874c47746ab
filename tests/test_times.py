from __future__ import annotations

from conftest import at, rows
from pyspark.sql import functions as F

from touchline.functions.times import (
    day_diff,
    local_since,
    period,
    period_is,
    period_since,
    period_until,
    second_diff,
    to_pacific,
    to_utc,
    trunc,
)


def test_pacific_follows_daylight_saving(make):
    df = make(
        "t timestamp_ntz",
        (at("2021-03-14 09:59:00"),),
        (at("2021-03-14 10:00:00"),),
        (at("2021-11-07 08:30:00"),),
        (at("2021-11-07 09:30:00"),),
        (at("2024-02-01 07:59:00"),),
        (at("2024-02-01 08:00:00"),),
        (None,),
    )
    assert rows(df.select(to_pacific(F.col("t")))) == [
        (None,),
        (at("2021-03-14 01:59:00"),),
        (at("2021-03-14 03:00:00"),),
        (at("2021-11-07 01:30:00"),),
        (at("2021-11-07 01:30:00"),),
        (at("2024-01-31 23:59:00"),),
        (at("2024-02-01 00:00:00"),),
    ]


def test_local_time_in_the_gap_moves_forward(make):
    df = make("t timestamp_ntz", (at("2021-03-14 02:30:00"),), (at("2021-11-15 00:00:00"),))
    assert rows(df.select(to_utc(F.col("t")))) == [(at("2021-03-14 10:30:00"),), (at("2021-11-15 08:00:00"),)]


def test_saturday_weeks(make):
    df = make("t timestamp_ntz", (at("2021-01-01 12:00:00"),), (at("2021-01-02 00:00:00"),), (at("2021-01-08 23:59:59"),))
    weeks = rows(df.select("t", period(F.col("t"), "saturday_week")))
    assert [w for _, w in weeks] == [at("2020-12-26"), at("2021-01-02"), at("2021-01-02")]


def test_periods_stay_without_zone(make):
    df = make("t timestamp_ntz", (at("2024-01-31 23:30:00"),))
    out = df.select(trunc(F.col("t"), "day").alias("d"), period(F.col("t")).alias("m"))
    assert out.dtypes == [("d", "timestamp_ntz"), ("m", "timestamp_ntz")]
    assert rows(out) == [(at("2024-01-31"), at("2024-01-01"))]


def test_differences_count_boundaries(make):
    df = make(
        "a timestamp_ntz, b timestamp_ntz",
        (at("2021-01-01 23:00:00"), at("2021-01-02 01:00:00")),
        (at("2021-01-01 00:00:00.900000"), at("2021-01-01 00:00:01.100000")),
    )
    found = rows(df.select("a", day_diff(F.col("b"), F.col("a")), second_diff(F.col("b"), F.col("a"))))
    assert [(d, s) for _, d, s in found] == [(0, 1), (1, 7200)]


def test_bounds_on_the_stored_column(spark):
    """Every way to write a bound keeps the same hours as the comparison it stands for."""
    hours = spark.range(24 * 400).select(
        (F.lit("2021-01-01 00:30:00").cast("timestamp_ntz") + F.expr("INTERVAL '1' HOUR") * F.col("id")).alias("t")
    )
    t, local = F.col("t"), to_pacific(F.col("t"))
    checks = {}
    for start in ("2021-03-14", "2021-03-14 02:30:00", "2021-07-01", "2021-11-07", "2021-11-07 01:30:00", "2021-12-31"):
        bound = F.lit(start).cast("timestamp_ntz")
        checks[f"local {start}"] = (local_since(t, start), local >= bound)
        for scope in ("day", "month", "saturday_week"):
            checks[f"local {scope} {start}"] = (local_since(t, start, scope), period(local, scope) >= bound)
            checks[f"since {scope} {start}"] = (period_since(t, start, scope), period(t, scope) >= bound)
            checks[f"until {scope} {start}"] = (period_until(t, start, scope), period(t, scope) <= bound)
    for scope, start in (("month", "2021-02-01"), ("day", "2021-02-28"), ("saturday_week", "2021-01-02")):
        checks[f"is {scope}"] = (period_is(t, scope, start), period(t, scope) == F.lit(start).cast("timestamp_ntz"))
    differing = [F.count_if(ours != theirs).alias(name) for name, (ours, theirs) in checks.items()]
    found = hours.agg(*differing).first().asDict()
    assert {name: n for name, n in found.items() if n} == {}
