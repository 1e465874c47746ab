"""Referral pages, referral leads and the accounts that refer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.text import external, referrer_name, short_id
from touchline.functions.times import day_diff, local_since, period_since, to_pacific, trunc, ts
from touchline.operators.joins import join_groups, latest_before, split_left_join, with_group_values
from touchline.session import materialise

Tables = Mapping[str, DataFrame]

# Text in a referrer and the name to report, in order of priority.
REFERRERS = {
    "facebook": "facebook",
    "corp.example": "corp.example",
    "bing": "bing",
    "youtube": "youtube",
    "ebay": "ebay",
    "google": "google",
    "reddit": "reddit",
    "slack": "slack",
}


def referral_page_conversions(
    tables: Tables,
    *,
    landing: str = "%site.example/friends-of-site/%",
    start: str = "1996-01-01",
    internal: Sequence[str] = ("%test%", "%corp.example%"),
    conversion_type: str = "lead",
) -> DataFrame:
    """First view of a referral page per address, and the lead, trial and client that came of it."""
    local = to_pacific(F.col("time"))
    people = tables["identity_map"].select("heap_user_id", "inferred_email")
    # Only the earliest view of an address counts, so a session is its first view.
    views = (
        tables["pageviews"]
        .filter(F.col("landing_page").ilike(landing) & local_since(F.col("time"), start))
        .groupBy("user_id", "session_id")
        .agg(F.min(local).alias("view_day"))
        .join(people, F.col("user_id") == F.col("heap_user_id"))
        .filter(external(F.col("inferred_email"), internal, keep_null=False))
    )
    rank = F.rank().over(Window.partitionBy("inferred_email").orderBy(F.col("view_day").asc_nulls_last()))
    firsts = views.withColumn("__rank", rank).filter("__rank = 1").drop("__rank", "heap_user_id")

    view, lead = F.col("view_day"), F.col("lead")
    created = F.col("lead_created_datetime_pstpdt")
    leads = tables["lead_data"].select("id", "email", "lead_created_datetime_pstpdt")
    crm = tables["crm_lead"].select(F.col("id").alias("crm_id"), "convertedopportunityid")
    opps = tables["opportunity"].select(
        F.col("id").alias("opp"), F.col("trial_call_booked__c").alias("trial"),
        F.when(
            (F.col("stagename") == "Client") & F.col("isclosed") & F.col("iswon"), F.col("closedate")
        ).alias("client"),
    )
    credits = (
        tables["attributions_by_channel"]
        .filter(F.col("conversion_type") == conversion_type)
        .select("lead_id", "channel_1", "channel_2", "credit_1", "credit_2")
        .distinct()
    )
    trial, client = F.col("trial"), F.col("client")
    led = (
        split_left_join(firsts, leads, F.col("inferred_email") == F.col("email"))
        .withColumn("lead", F.when(view <= created, created))
        # What follows hangs on a lead made after the view.
        .join(crm, (F.col("id") == F.col("crm_id")) & lead.isNotNull(), "left")
        .join(opps, (F.col("convertedopportunityid") == F.col("opp")) & lead.isNotNull(), "left")
    )
    return (
        split_left_join(led, credits, (F.col("id") == F.col("lead_id")) & lead.isNotNull())
        .filter(((view <= trial) | trial.isNull()) & ((view <= client) | client.isNull()))
        .select(
            "user_id", "id", "session_id", "view_day", trunc(view, "month").alias("view_month"),
            "lead", trunc(lead, "month").alias("lead_month"), "trial", trunc(trial, "month").alias("trial_month"),
            "client", trunc(client, "month").alias("client_month"), day_diff(lead, view).alias("lag_days"),
            "channel_1", F.coalesce("channel_2", F.lit("null")).alias("channel_2"), "credit_1", "credit_2",
        )
        .distinct()
    )


def referral_lead_sources(
    tables: Tables, *, start: str = "1996-01-01", referrers: Mapping[str, str] = REFERRERS
) -> DataFrame:
    """Last session before a referral lead was created, with a readable referrer.

    Sessions at the same last moment are all kept; a lead without a session has one row.
    """
    raw = F.col("raw_date")
    leads = tables["lead_data"].select(F.col("id").alias("lead_id"), "email", "lead_created_datetime_pstpdt")
    sessions = tables["sessions"].select(
        "user_id", to_pacific(F.col("time")).alias("session_time"), "referrer", "landing_page", "utm_medium",
        "utm_content",
    )
    base = materialise(
        tables["attributions_crm"]
        .filter((F.col("referrals") == 1) & (F.col("lead_ind") == 1) & period_since(raw, start, "month"))
        .select("id", "raw_date")
        .distinct()
        .join(leads, F.col("id") == F.col("lead_id"), "left")
        .drop("lead_id")
    )
    # Only the sessions of people with the address of such a lead are needed.
    users = tables["web_users"].select(F.col("user_id").alias("web_user"), F.col("_email").alias("email"))
    users = join_groups(users, base.select("email").distinct(), ["email"], "left_semi")
    sessions = materialise(users.join(sessions, F.col("web_user") == F.col("user_id")).drop("web_user"))
    created = F.col("lead_created_datetime_pstpdt")
    base = latest_before(base, sessions, "email", "lead_created_datetime_pstpdt", "session_time", "latest")
    base = with_group_values(base, ["id"], last_session=F.max("latest")).drop("latest")
    seen = sessions.withColumnRenamed("email", "session_email")
    last = base.join(
        seen,
        (F.col("email") == F.col("session_email"))
        & (F.col("session_time") == F.col("last_session"))
        & (F.col("session_time") <= created),
    ).drop("session_email")
    without = base.filter(F.col("last_session").isNull())
    rows = last.unionByName(without, allowMissingColumns=True).distinct()
    return rows.select(
        "id", "raw_date", trunc(raw, "month").alias("themonth"), "session_time", "last_session",
        referrer_name(F.col("referrer"), referrers).alias("referrer"), "landing_page", "utm_medium", "utm_content",
    )


def referring_accounts(
    tables: Tables,
    *,
    as_of: str = "2002-01-01",
    record_type: str = "RT_LEAD",
    source: str = "Referred By Other Unrelated Business",
    stage: str = "Client",
) -> DataFrame:
    """Accounts that referred someone, how long they have been clients, and their last referral."""
    crm = (
        tables["crm_lead"]
        .filter(
            (F.col("recordtypeid") == record_type)
            & F.col("ambassador__referred_by_contact__c").isNotNull()
            & (F.col("leadsource") == source)
        )
        .select(F.col("id").alias("crm_id"), "referring_contact_account_id__c")
    )
    leads = tables["lead_data"]
    referrals = (
        leads.join(crm, F.col("id") == F.col("crm_id"))
        .groupBy(F.col("referring_contact_account_id__c").alias("referrer_short"))
        .agg(F.max("lead_created_datetime_pstpdt").alias("last_referral"))
    )
    accounts = tables["account"].select(F.col("id").alias("account_id"), "client_key")
    opps = tables["opportunity"].filter(F.col("stagename") == stage).select(
        F.col("id").alias("opp"), to_pacific(F.col("closedate")).alias("clientdate")
    )
    # Only the dates of an account's leads show, also the missing one of a lead without a client.
    dates = (
        leads.select(F.col("client_key").alias("lead_key"), "opp_id")
        .join(opps, F.col("opp_id") == F.col("opp"), "left")
        .select("lead_key", "clientdate")
        .distinct()
    )
    return (
        accounts.join(referrals, short_id(F.col("account_id")) == F.col("referrer_short"))
        .join(dates, F.col("client_key") == F.col("lead_key"), "left")
        .select(
            "account_id", "client_key", "clientdate", day_diff(ts(as_of), F.col("clientdate")).alias("days_old"),
            "last_referral",
        )
        .distinct()
    )
