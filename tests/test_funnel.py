from __future__ import annotations

from conftest import at, rows
from pyspark.sql import functions as F

from touchline.functions.text import external, referrer_name, short_id
from touchline.operators.funnel import (
    LeadDefinition,
    conversion_rate,
    credit_by_type,
    funnel_counts,
    milestones_long,
    semi_month,
    won_value,
)


def test_counts_ignore_missing_ids(make):
    df = make("k string, id string, ok boolean", ("a", "1", True), ("a", "1", None), ("a", None, True), ("b", "2", False))
    counts = funnel_counts(df, ["k"], {"all": ("id", None), "good": ("id", F.col("ok"))})
    assert rows(counts, "k", "all", "good") == [("a", 1, 1), ("b", 1, 0)]
    assert rows(funnel_counts(df, [], {"all": ("id", None)})) == [(2,)]


def test_half_months(make):
    df = make("d timestamp_ntz", *[(at(f"2024-01-{d:02}"),) for d in (1, 15, 16, 31)], (None,))
    month = F.date_trunc("month", F.col("d")).cast("timestamp_ntz")
    assert [h for _, h in rows(df.select("d", semi_month(F.col("d"), month)))] == [None, "1", "1", "2", "2"]


def test_rate_without_a_base(make):
    df = make("k string, a int, b int", ("x", 1, 2), ("x", 0, 2), ("y", 0, 0))
    assert rows(df.groupBy("k").agg(conversion_rate(F.col("a"), F.col("b")))) == [("x", 0.25), ("y", None)]


def test_credit_of_missing_types_is_zero(make):
    df = make("k string, t string, c double", ("a", "LEAD", 0.5), ("a", "LEAD", 1.0), ("a", "OTHER", 9.0), ("b", None, 1.0))
    found = credit_by_type(df, ["k"], "t", "c", {"leads": "LEAD", "trials": "TRIAL"})
    assert rows(found, "k", "leads", "trials") == [("a", 1.5, 0.0), ("b", 0.0, 0.0)]


def test_milestones_drop_missing_dates_and_repeats(make):
    df = make("id int, a timestamp_ntz, b timestamp_ntz, won boolean, f int",
              (1, at("2024-01-01"), at("2024-02-01"), True, 0), (1, at("2024-01-01"), at("2024-02-01"), True, 0),
              (2, None, at("2024-02-01"), None, 1))
    found = milestones_long(df, ["id"], ["f"], {"first": ("a", None), "second": ("b", F.col("won"))})
    assert rows(found) == [
        (1, at("2024-01-01"), "first", 0), (1, at("2024-02-01"), "second", 0),
    ]
    assert found.columns == ["id", "conversion_date", "conversion_type", "f"]


def test_value_of_a_client(make):
    df = make("s string, a double, b double, p string, c double",
              ("Client", 1.0, None, None, None), ("Client", 1.0, 2.0, "Client", 4.0), ("Client", 1.0, 2.0, "Client", None),
              ("Open", 1.0, 2.0, "Client", 4.0))
    value = won_value(*[F.col(c) for c in "sabpc"])
    assert [r[0] for r in df.select(value).collect()] == [1.0, 7.0, None, None]


def test_lead_definition(make):
    base = {
        "leadsource": "Organic", "providedemail__c": None, "providedcompanydetails__c": None, "createdaccount__c": None,
        "isconverted": False, "recordtypeid": "RT_LEAD", "loss_reason__c": None, "owner_role__c": None,
        "isdeleted": False,
    }
    schema = ", ".join(f"{c} {'boolean' if c.startswith('is') else 'string'}" for c in base)
    cases = [
        ({}, True),
        ({"leadsource": None}, None),
        ({"leadsource": "Outbound"}, False),
        ({"leadsource": "Content"}, False),
        ({"leadsource": "Content", "createdaccount__c": "yes"}, True),
        ({"leadsource": "List Upload", "isconverted": True}, True),
        ({"leadsource": "Outbound", "isconverted": True}, False),
        ({"recordtypeid": None}, None),
        ({"loss_reason__c": "Fake lead / account"}, False),
        ({"owner_role__c": "Sales Operations"}, False),
        ({"owner_role__c": "sales operations"}, True),
        ({"isdeleted": True}, False),
    ]
    for changes, verdict in cases:
        found = make(schema, tuple({**base, **changes}.values())).select(LeadDefinition().qualified()).collect()[0][0]
        assert bool(found) == bool(verdict), changes


def test_addresses_and_referrers(make):
    df = make("e string", (None,), ("a@corp.example",), ("Test@x",), ("b@x",))
    own = ("%corp.example%", "%test%")
    assert rows(df.filter(external(F.col("e"), own, keep_null=True))) == [(None,), ("b@x",)]
    assert rows(df.filter(external(F.col("e"), own, keep_null=False))) == [("b@x",)]
    assert rows(df.filter(external(F.col("e"), own, keep_null=False, match_case=True))) == [("Test@x",), ("b@x",)]
    refs = make("r string", (None,), ("https://www.Facebook.com/?x",), ("https://a.b/c/?q=1/",), ("https://a.b/",))
    names = {"facebook": "facebook"}
    found = [r[0] for r in refs.select(referrer_name(F.col("r"), names)).collect()]
    assert found == ["null", "facebook", "https://a.b/c", "https://a.b"]
    ids = make("i string", ("123456789012345AAA",), ("short",), (None,))
    assert [r[0] for r in ids.select(short_id(F.col("i"))).collect()] == ["123456789012345", "short", None]
