"""Rows made by the thousand, and folds behind a join, are dealt over tasks."""

from __future__ import annotations

from collections import Counter

from conftest import at, rows
from pyspark.sql import functions as F

from touchline.operators.joins import TIMES, copied, dealt_pieces, repeat_rows
from touchline.operators.touch import last_page_before
from touchline.plans.ads import paid_ads_daily
from touchline.session import materialise


def test_rows_are_repeated_as_often_as_they_say(make):
    df = make("v string, n int", ("none", 0), ("one", 1), ("unknown", None), ("some", 7), ("some", 5), (None, 10), ("edge", 8))
    for piece, task in ((3, 4), (4, 10), (1, 1), (100, 100)):
        found = Counter(r["v"] for r in repeat_rows(df, "n", piece, task).collect())
        assert found == {"one": 1, "unknown": 1, "some": 12, None: 10, "edge": 8}
    assert repeat_rows(df.limit(0), "n").collect() == []


def test_copies_of_few_rows_are_made_in_many_tasks(make):
    found = repeat_rows(make("v string, n int", ("hot", 40_000), ("cold", 1)), "n", 100, 5_000)
    sizes = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 40_001 and len(sizes) >= 8 and max(sizes) < 8_000


def test_one_campaign_name_does_not_make_its_rows_in_one_task(spark, make):
    """300 ads meet 400 campaigns of their name and day: every pair is a row, and no task makes most of them."""
    day = F.lit("2024-01-01").cast("timestamp_ntz")
    n = spark.range(400).select(day.alias("day"), day.alias("_sdc_report_datetime"), F.col("id").alias("campaignid"))
    campaigns = n.select("*", F.lit("c").alias("campaign"), F.lit(1).cast("bigint").alias("impressions"), F.lit(5.0).alias("searchimprshare"))
    ads = n.limit(300).select(
        "*", F.col("campaignid").alias("adgroupid"), F.col("campaignid").alias("adid"), F.lit("c").alias("campaign"),
        F.lit("g").alias("adgroup"), F.lit("a").alias("ad"), F.lit(1_000_000).cast("bigint").alias("cost"),
        F.lit(1).cast("bigint").alias("impressions"), F.lit(1).cast("bigint").alias("clicks"), F.lit(1.0).alias("conversions"),
    )
    empty = {
        "fb_insights": "date_start timestamp_ntz, campaign_id string, adset_id string, ad_id string, campaign_name string, adset_name string,"
        " ad_name string, spend double, reach bigint, impressions bigint, clicks bigint, inline_link_clicks bigint",
        "fb_actions": "_sdc_source_key_date_start timestamp_ntz, _sdc_source_key_ad_id string, action_type string, value double",
        "bing_ads": "timeperiod timestamp_ntz, _sdc_report_datetime timestamp_ntz, campaignid bigint, adgroupid bigint, adid bigint,"
        " campaignname string, adgroupname string, spend double, impressions bigint, clicks bigint, conversions double",
    }
    tables = {k: make(v) for k, v in empty.items()} | {"google_campaigns": campaigns, "google_ads": ads}
    found = paid_ads_daily(tables)
    assert rows(found.groupBy("searchimprshare_valid", "ad_name").count()) == [(1, None, 400), (1, "a", 120_000)]
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_spans_are_dealt_also_behind_a_join_by_session(spark):
    """Pages joined by session lie by session already; a long session still is folded in many tasks."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        views = materialise(spark.range(4_000).select((F.col("id") % 5).alias("k"), "id", F.timestamp_seconds(F.col("id") * 600).cast("timestamp_ntz").alias("time")))
        sessions = materialise(spark.range(5).select(F.col("id").alias("s"), F.lit("x").alias("medium")))
        pages = views.join(sessions, F.col("k") == F.col("s")).drop("s")
        target = F.col("id") % 2 == 0
        found = last_page_before(pages, ["k"], "time", target, target, ["id"])
        text = found._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning(k#") == 3  # the join, the spans, what is left of each
        expected = [(k, max(i for i in range(4_000) if i % 5 == k and i % 2 and i < max(j for j in range(k, 4_000, 5) if j % 2 == 0))) for k in range(5)]
        assert rows(found, "k", "id") == sorted(expected)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def ad_tables(make, **given):
    """Tables of the ad report, empty but for the rows given."""
    schemas = {
        "fb_insights": "date_start timestamp_ntz, campaign_id string, adset_id string, ad_id string, campaign_name string, adset_name string,"
        " ad_name string, spend double, reach bigint, impressions bigint, clicks bigint, inline_link_clicks bigint",
        "fb_actions": "_sdc_source_key_date_start timestamp_ntz, _sdc_source_key_ad_id string, action_type string, value double",
        "bing_ads": "timeperiod timestamp_ntz, _sdc_report_datetime timestamp_ntz, campaignid bigint, adgroupid bigint, adid bigint,"
        " campaignname string, adgroupname string, spend double, impressions bigint, clicks bigint, conversions double",
        "google_ads": "day timestamp_ntz, _sdc_report_datetime timestamp_ntz, campaignid bigint, adgroupid bigint, adid bigint, campaign string,"
        " adgroup string, ad string, cost bigint, impressions bigint, clicks bigint, conversions double",
        "google_campaigns": "day timestamp_ntz, _sdc_report_datetime timestamp_ntz, campaignid bigint, campaign string, impressions bigint,"
        " searchimprshare double",
    }
    return {name: make(schema, *given.get(name, ())) for name, schema in schemas.items()}


DAY, LATER = at("2024-01-01"), at("2024-01-02")


def test_equal_rows_are_merged_and_ads_repeated(make):
    insight = (DAY, "1", "2", "3", "c", "s", "a", 1.5, 10, 20, 30, 40)
    lead = "offsite_conversion.fb_pixel_lead"
    bing = (DAY, LATER, 1, 2, 3, "c", "g", 1.0, 10, 20, 0.5)
    ad = (DAY, LATER, 1, 2, 3, "c", "g", "a", 2_000_000, 10, 20, 0.5)
    found = paid_ads_daily(
        ad_tables(
            make,
            fb_insights=[insight, insight, (None, *insight[1:])],
            fb_actions=[(DAY, "3", lead, 7.0), (DAY, "3", lead, 7.0), (DAY, "3", lead, None), (DAY, "3", lead, None), (DAY, "3", "click", 9.0),
                        (None, "3", lead, 8.0)],
            bing_ads=[bing, bing, (DAY, DAY, *bing[2:])],
            google_ads=[ad, ad, (DAY, DAY, *ad[2:]), (DAY, LATER, 1, 2, 4, "alone", *ad[6:]), (DAY, LATER, 1, 2, 5, None, *ad[6:])],
            google_campaigns=[(DAY, LATER, 1, "c", 10, 50.0), (DAY, LATER, 1, "c", 10, 50.0), (DAY, LATER, 2, "c", 30, 0.0),
                              (DAY, DAY, 2, "c", 40, 10.0), (DAY, LATER, 3, "c", 10, None), (DAY, LATER, 4, None, 10, 50.0)],
        )
    )
    count = Counter((r["platform"], r["ad_id"], r["platform_leads"], r["elig_impressions"], r["searchimprshare_valid"]) for r in found.collect())
    assert count == {
        ("facebook", 3, 7.0, None, 0): 1, ("facebook", 3, None, None, 0): 2, ("bing", 3, 0.5, None, 0): 1,
        ("google", 3, 0.5, None, 1): 6, ("google", 4, 0.5, None, 0): 1, ("google", 5, 0.5, None, 0): 1,
        ("google", None, None, 20.0, 1): 3, ("google", None, None, None, 1): 1,
    }
    assert found.count() == sum(count.values())


def test_copies_are_made_behind_the_unions(make):
    """A union would write out each copy. The newest campaigns are worked out once, so only those of one platform are left."""
    plan = paid_ads_daily(ad_tables(make))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Union")
    assert plan.count("Window [") == 1


def test_pieces_stay_few(make):
    """Rows are dealt, not copies: 25,000 copies are three rows until they are made."""
    pieces = dealt_pieces(make("v string, n int", ("some", 25_000), ("one", 1), ("none", 0)), "n")
    assert rows(pieces, "v", TIMES) == [("one", 1), ("some", 10_000), ("some", 10_000), ("some", 5_000)]
    assert copied(pieces).count() == 25_001
