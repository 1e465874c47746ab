from __future__ import annotations

from conftest import at, rows
from pyspark.sql import functions as F

from touchline.operators.joins import with_group_values
from touchline.operators.touch import (
    before_conversion,
    first_qualifying_per_day,
    first_touch,
    last_page_before,
    prior_touch,
    session_flags,
)

DAY = "2024-01-05"


def test_first_touch_breaks_ties_and_puts_unknown_times_last(make):
    df = make(
        "period string, user string, time timestamp_ntz, id int",
        ("p", "a", at(f"{DAY} 10:00:00"), 3),
        ("p", "a", at(f"{DAY} 10:00:00"), 2),
        ("p", "a", None, 1),
        ("p", "b", None, 4),
        ("q", "a", at(f"{DAY} 09:00:00"), 5),
        ("p", None, at(f"{DAY} 11:00:00"), 6),
    )
    assert [r[0] for r in rows(first_touch(df, ["period", "user"], "time", ["id"]), "id")] == [2, 4, 5, 6]


def test_first_touch_is_limited_before_the_shuffle(make):
    df = make("period string, user string, time timestamp_ntz, id int", ("p", "a", at(DAY), 1))
    plan = first_touch(df, ["period", "user"], "time", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def touches(make):
    return make(
        "id int, user string, time timestamp_ntz",
        (1, "never", at(DAY)),
        (2, "twice", at("2024-01-01")),
        (3, "twice", at("2024-01-03")),
        (4, "twice", at("2024-01-04")),
        (5, "undated", at("2024-02-01")),
        (6, None, at("2024-02-01")),
    )


def test_before_conversion_keeps_a_touch_once(make):
    conversions = make(
        "user string, date timestamp_ntz",
        ("twice", at("2024-01-02")),
        ("twice", at("2024-01-03")),
        ("undated", None),
        ("undated", at("2024-01-01")),
        (None, at("2020-01-01")),
    )
    kept = before_conversion(touches(make), conversions, "user", "time", "date")
    assert [r[0] for r in rows(kept, "id")] == [1, 2, 3, 5, 6]
    direct = touches(make).join(conversions.withColumnRenamed("user", "u"), F.col("user") == F.col("u"), "left")
    direct = direct.filter("date IS NULL OR time <= date").select("id").distinct()
    assert rows(kept, "id") == rows(direct)


def test_first_of_the_day_keeps_ties(make):
    df = make(
        "id int, user string, day string, time timestamp_ntz",
        (1, "a", "d1", at(f"{DAY} 10:00:00")),
        (2, "a", "d1", at(f"{DAY} 10:00:00")),
        (3, "a", "d1", at(f"{DAY} 11:00:00")),
        (4, "a", "d2", at(f"{DAY} 12:00:00")),
    )
    assert [r[0] for r in rows(first_qualifying_per_day(df, "user", "day", "time"), "id")] == [1, 2, 4]


def test_prior_touch_needs_the_number_before_and_the_same_day(make):
    df = make(
        "user string, n int, day string, page string",
        ("a", 1, "d1", "one"),
        ("a", 2, "d1", "two"),
        ("a", 4, "d1", "gap"),
        ("a", 5, "d2", "next day"),
    )
    found = prior_touch(df, df, "user", "n", "day")
    assert rows(found, "page", "prior_page") == [
        ("gap", None), ("next day", None), ("one", None), ("two", "one"),
    ]
    any_day = prior_touch(df, df, "user", "n", None)
    assert ("next day", "gap") in rows(any_day, "page", "prior_page")


def test_last_page_before_the_last_target(make):
    df = make(
        "user int, session int, time timestamp_ntz, kind string",
        (1, 1, at(f"{DAY} 09:00:00"), "core"),
        (1, 1, at(f"{DAY} 10:00:00"), "blog"),
        (1, 1, at(f"{DAY} 10:00:00"), "core"),
        (1, 1, at(f"{DAY} 11:00:00"), "signup"),
        (1, 1, at(f"{DAY} 12:00:00"), "core"),
        (1, 2, at(f"{DAY} 09:00:00"), "core"),
        (None, 3, at(f"{DAY} 09:00:00"), "core"),
        (None, 3, at(f"{DAY} 10:00:00"), "signup"),
    )
    target = F.col("kind") == "signup"
    found = last_page_before(df, ["user", "session"], "time", target, target, ["kind"])
    assert rows(found, "user", "session", "kind") == [(None, 3, "core"), (1, 1, "blog")]


def test_session_flags(make):
    df = make("s int, path string", (1, "/blog"), (1, None), (2, "/x"), (3, None))
    flags = session_flags(df, [F.col("s")], {"blog": F.col("path").like("%blog%")})
    assert rows(flags, "s", "blog") == [(1, True), (2, False), (3, None)]


def test_group_values_equal_a_window(make):
    df = make("k string, v int", ("a", 1), ("a", 5), (None, 2), (None, 7), ("b", None))
    found = with_group_values(df, ["k"], top=F.max("v"), n=F.count("v"))
    direct = df.selectExpr("k", "v", "max(v) OVER (PARTITION BY k) AS top", "count(v) OVER (PARTITION BY k) AS n")
    assert rows(found, "k", "v", "top", "n") == rows(direct, "k", "v", "top", "n")
