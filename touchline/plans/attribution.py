"""Credit of conversions to channels, keywords and campaigns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import external
from touchline.functions.times import period_is, period_since, to_pacific, trunc, ts
from touchline.operators.channels import channel_group
from touchline.operators.funnel import credit_by_type
from touchline.operators.identity import Key, identity_join, ilike_column
from touchline.operators.joins import split_left_join

Tables = Mapping[str, DataFrame]


def keyword_conversions(
    tables: Tables, *, start: str = "2024-01-01", excluded_type: str = "REVIEW CALL", min_clients: float = 1
) -> DataFrame:
    """Lead, trial and client credit per month and search keyword, for keywords with enough clients."""
    date = F.col("conversion_date")
    month = trunc(date, "month")
    rows = tables["attributions"].filter(
        F.col("utm_term").isNotNull()
        & period_since(date, start, "month")
        & (F.col("conversion_type") != excluded_type)
    )
    columns = {"leads": "LEAD", "trials": "TRIAL", "clients": "CLIENT"}
    credit = credit_by_type(rows, [month.alias("month"), "utm_term"], "conversion_type", "conversion_credit", columns)
    return (
        credit.filter(F.col("clients") >= min_clients)
        .select("month", "leads", "trials", "clients", "utm_term")
        .orderBy(F.col("month").asc_nulls_last(), F.col("utm_term").asc_nulls_last())
    )


def conversions_by_channel_device(
    tables: Tables, *, month: str = "2024-01-01", channels: Sequence[str] = ("search_content", "search_core")
) -> DataFrame:
    """Credit by conversion type, channel and device in one month.

    Conversions meet their channel rows by lead, date, credit and type. Both sides are
    counted per combination first, so repeated rows multiply as numbers and not as rows.
    """
    date = F.col("conversion_date")
    match = ["lead_id", "conversion_date", "conversion_credit"]
    in_month = period_is(date, "month", month)
    conversions = (
        tables["attributions"].filter(in_month).groupBy(*match, "conversion_type", "device_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_channel = (
        tables["attributions_channel"].filter(in_month & F.col("channel").isin(*channels))
        .groupBy(*match, F.col("conversion_type").alias("type_pattern"), "channel")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    return (
        conversions.join(by_channel, match)
        .filter(ilike_column(F.col("conversion_type"), F.col("type_pattern")))
        .groupBy("conversion_type", "channel", "device_type")
        .agg(F.sum(F.col("conversion_credit") * F.col("n") * F.col("m")).alias("sum"))
        .orderBy(*[F.col(c).asc_nulls_last() for c in ("conversion_type", "channel", "device_type")])
    )


def bottom_funnel_actuals(tables: Tables, *, start: str = "2024-01-05") -> DataFrame:
    """Distinct conversions with their month and channel group."""
    date = F.col("conversion_date")
    return (
        tables["attributions_channel"]
        .filter(date >= ts(start))
        .select(
            "conversion_date",
            trunc(date, "month").alias("themonth"),
            "client_key", "lead_id", "opp_id", "channel", "conversion_credit", "conversion_type",
            channel_group(F.col("channel")).alias("channel1"),
        )
        .distinct()
    )


def reallocation_buckets(tables: Tables, *, buckets: Sequence[str] = ("lead", "trial", "client")) -> DataFrame:
    """Credit per day, one column per conversion type."""
    day = trunc(F.col("conversion_date"), "day").alias("conversion_date")
    columns = {f"{b}_reallocation_bucket": b for b in buckets}
    return credit_by_type(tables["reallocation"], [day], "conversion_type", "channel_credit", columns)


def quiz_campaign_attribution(
    tables: Tables,
    *,
    campaign: str = "CAMPAIGN_1",
    form: int = 2001,
    form_start: str = "2001-01-05",
    internal: Sequence[str] = ("%test%", "%corp.example%"),
    excluded: Sequence[str] = ("shared0@mail.example", "user8@mail.example"),
    scored_channel: str = "scored",
) -> DataFrame:
    """Members of a campaign, the lead each became, its conversions since joining and its consult form."""
    email = F.col("campaign_email")
    members = (
        tables["campaign_member"]
        .filter(F.col("campaignid") == campaign)
        .select(
            F.col("leadid").alias("member_lead"),
            F.col("email").alias("campaign_email"),
            to_pacific(F.col("createddate")).alias("campaign_createddate"),
        )
        .filter(external(email, internal, keep_null=False) & ~email.isin(*excluded))
        .distinct()
    )
    leads = tables["lead_data"].select(
        F.col("id").alias("known_lead"), F.col("email").alias("lead_email"), "lead_created_datetime_pstpdt", "cta"
    )
    created, joined_at = F.col("lead_created_datetime_pstpdt"), F.col("campaign_createddate")
    camp = identity_join(
        members, leads, [Key("member_lead", "known_lead"), Key("campaign_email", "lead_email")]
    ).select(
        F.coalesce("member_lead", "known_lead").alias("clean_leadid"),
        F.when(created >= joined_at, created).alias("lead_created_datetime_pstpdt"),
        "campaign_createddate",
        "cta",
    )
    credits = tables["attributions_by_channel"].select(
        "lead_id", "conversion_date", "conversion_type", "channel_1", "credit_1", "channel_2", "credit_2"
    )
    # Without a lead date only scored credit counts: a lead made before joining must not bring its other credit.
    counted = (
        (F.col("clean_leadid") == F.col("lead_id"))
        & (F.col("conversion_date") >= trunc(joined_at, "day"))
        & (created.isNotNull() | (F.col("channel_1") == scored_channel))
    )
    mail_leads = tables["mail_leads"].select(F.col("id").alias("mail_id"), "sfdcleadid")
    forms = (
        tables["mail_forms"]
        .filter((F.col("primary_attribute_value_id") == form) & (F.col("activitydate") >= ts(form_start)))
        .join(mail_leads, F.col("leadid") == F.col("mail_id"))
        .select("sfdcleadid", F.col("activitydate").alias("consult_form"))
        .distinct()
    )
    return (
        split_left_join(camp, credits, counted)
        .join(forms, F.col("clean_leadid") == F.col("sfdcleadid"), "left")
        .select(
            "clean_leadid", "lead_created_datetime_pstpdt", "campaign_createddate", "cta", "conversion_date",
            "conversion_type", "channel_1", "credit_1", "channel_2", "credit_2", "consult_form",
        )
        .distinct()
        .orderBy(
            *[
                F.col(c).asc_nulls_last()
                for c in ("lead_created_datetime_pstpdt", "clean_leadid", "conversion_date")
            ]
        )
    )


def contact_details_credit(
    tables: Tables,
    *,
    landing: str = "%site.example/go/professional-bookkeepers/%",
    start: str = "1996-04-01",
    campaign: str = "%rd%",
    email_match: str = "pattern",
) -> DataFrame:
    """Users who left contact details after landing on a page, with the lead they match and its credit."""
    time, utm = F.col("time"), F.col("utm_campaign")
    users = (
        tables["contact_events"]
        .filter(
            F.col("landing_page").ilike(landing)
            & period_since(time, start, "day")
            & (utm.ilike(campaign) | utm.isNull())
        )
        .select("user_id")
        .distinct()
    )
    web_users = tables["web_users"].select(F.col("user_id").alias("web_user"), "_email")
    people = users.join(web_users, F.col("user_id") == F.col("web_user"), "left").drop("web_user").distinct()
    leads = tables["lead_data"].select("id", F.col("email").alias("lead_email"))
    credits = tables["attributions_by_channel"].select("lead_id", "channel_1", "credit_1", "channel_2", "credit_2")
    return (
        split_left_join(
            identity_join(people, leads, [Key("_email", "lead_email", email_match)]),
            credits.distinct(),
            F.col("id") == F.col("lead_id"),
        )
        .select("user_id", "_email", "id", "channel_1", "credit_1", "channel_2", "credit_2")
        .distinct()
    )
