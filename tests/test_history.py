from __future__ import annotations

from conftest import at, rows
from pyspark.sql import functions as F

from touchline.operators.audience import (
    audience_difference,
    frequency_histogram,
    joined_text,
    suppressed_by_address,
)
from touchline.operators.experiment import several_variants, single_device, single_variant
from touchline.operators.history import fallback_enrich, latest_snapshot, nearest_change, sibling_structure


def test_latest_snapshot_keeps_ties_and_unknown_times(make):
    df = make("k string, t timestamp_ntz, v int",
              ("a", at("2024-01-01"), 1), ("a", at("2024-01-02"), 2), ("a", at("2024-01-02"), 3),
              ("b", None, 4), ("b", at("2024-01-02"), 5), (None, at("2024-01-01"), 6))
    found = latest_snapshot(df, ["k"], "t")
    assert [r[0] for r in rows(found, "v")] == [2, 3, 4, 6]
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_nearest_change(make):
    df = make("lead string, anchor timestamp_ntz, changed timestamp_ntz, old string, new string",
              ("exact", at("2024-01-01 10:00:00"), at("2024-01-01 10:00:00"), "o1", "n1"),
              ("near", at("2024-01-01 10:00:00"), at("2024-01-01 09:59:00"), "o2", "n2"),
              ("near", at("2024-01-01 10:00:00"), at("2024-01-01 10:01:00"), "o3", "n3"),
              ("near", at("2024-01-01 10:00:00"), at("2024-01-01 10:02:00"), "o4", "n4"),
              ("no change", at("2024-01-01 10:00:00"), None, None, None),
              ("no anchor", None, at("2024-01-01 10:00:00"), "o5", "n5"))
    found = nearest_change(df, "lead", F.col("anchor"), F.col("changed"), F.col("old"), F.col("new"), "score")
    assert rows(found, "lead", "score") == [("exact", None), ("near", "n2"), ("near", "o3")]


def test_sibling_structure(make):
    df = make("parent string, key string, channel string",
              ("good", "1", "Paid"), ("good", "2", "MBC"), ("good", "3", None),
              ("late", "1", "Paid"), ("late", "2", "Paid"), ("first", "1", "MBC"), ("none", None, "Paid"),
              ("unkeyed", "1", "Paid"), ("unkeyed", None, "Paid"))
    found = sibling_structure(df, "parent", "key", F.col("channel"), "MBC")
    verdicts = {(r["parent"], r["test"]) for r in found.collect()}
    assert verdicts == {("good", None), ("late", "error"), ("first", "error"), ("none", None), ("unkeyed", "error")}
    assert found.count() == df.count()


def test_fallback(make):
    df = make("id string, channel string, source string", ("a", None, "s"), ("b", "c", None), ("x", None, None))
    other = make("acc string, channel string, source string", ("a", "C1", "S1"), ("a", "C2", None), ("b", "C3", "S3"))
    found = fallback_enrich(df, "id", other, "acc", ["channel", "source"])
    assert rows(found, "id", "channel", "source") == [
        ("a", "C1", "s"), ("a", "C2", "s"), ("b", "c", "S3"), ("x", None, None),
    ]


def test_one_suppressed_record_suppresses_the_address(make):
    df = make("id int, email string, bad boolean", (1, "a", True), (2, "a", None), (3, "b", False), (4, None, True))
    found = suppressed_by_address(df, "email", {"no": F.col("bad")})
    assert rows(found, "id", "no") == [(1, 1), (2, 1), (3, 0)]


def test_audience(make):
    a = make("e string", ("x",), ("x",), ("y",), (None,))
    b = make("e string", ("y",), (None,))
    assert rows(audience_difference(a, b)) == [("x",)]
    sends = make("e string, m string", ("x", "1"), ("x", "1"), ("x", "2"), ("y", "1"), (None, "1"), ("z", None))
    assert rows(frequency_histogram(sends, "e", "m")) == [(1, 0), (1, 1), (1, 2)]
    texts = make("a string, b string", ("Unknown", "US"), (None, None))
    assert [r[0] for r in texts.select(joined_text(["a", "b"], "Unknown")).collect()] == ["US", ""]


def test_single_variant(make):
    df = make("user int, variant int, day int", (1, 0, 5), (1, 0, 3), (1, None, 3), (2, 0, 1), (2, 1, 2), (3, None, 1))
    assert rows(single_variant(df, ["user"], "variant"), "user", "variant", "day") == [
        (1, None, 3), (1, 0, 3), (1, 0, 5),
    ]
    assert rows(single_variant(df, ["user"], "variant", first_of="day"), "variant", "day") == [(None, 3), (0, 3)]
    assert rows(several_variants(df, "user", "variant")) == [(2,)]


def test_single_device(make):
    df = make("user int, device string, day int", (1, "m", 5), (1, "m", 3), (1, None, 1), (2, "m", 1), (2, "d", 1), (3, None, 1))
    assert rows(single_device(df, ["user"], "device", since=F.min("day")), "user", "device", "since") == [(1, "m", 1)]
