"""The shared operators as reports of their own, row by row.

They show what an operator gives before a report sums it up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import external, referrer_name, short_id
from touchline.functions.times import local_since, period, second_diff, to_pacific, trunc
from touchline.operators.audience import audience_difference
from touchline.operators.channels import (
    OWNED_CHANNELS,
    PAID_CHANNELS,
    REST_CHANNELS,
    SEARCH_SPLITS,
    ChannelRules,
    channel_flags,
)
from touchline.operators.experiment import several_variants, single_device, single_variant
from touchline.operators.funnel import LeadDefinition, semi_month, won_value
from touchline.operators.history import latest_snapshot, nearest_change
from touchline.operators.identity import Key, identity_join
from touchline.operators.joins import latest_before
from touchline.operators.touch import (
    before_conversion,
    first_qualifying_per_day,
    first_touch,
    last_page_before,
    prior_touch,
    session_flags,
)
from touchline.plans.email import MailingRules
from touchline.plans.referrals import REFERRERS

Tables = Mapping[str, DataFrame]


def touch_periods(tables: Tables) -> DataFrame:
    """Day, Saturday week, month and half month of every touch."""
    time = F.col("time")
    month = period(time, "month")
    return tables["touches"].select(
        "touch_id", period(time, "day").alias("day"), period(time, "saturday_week").alias("week"),
        month.alias("month"), semi_month(trunc(time, "day"), month).alias("semi_month"),
        to_pacific(time).alias("pacific"),
    )


def touch_channels(tables: Tables, *, rules: ChannelRules | None = None) -> DataFrame:
    """Channel flags of every touch, by the rules in force on its day."""
    flagged = channel_flags(tables["touches"].withColumn("day", period(F.col("time"), "day")), "day", rules)
    return flagged.select(
        "touch_id", *PAID_CHANNELS, *OWNED_CHANNELS, "search_core", "search_content", *SEARCH_SPLITS,
        *REST_CHANNELS, "total",
    )


def touches_before_conversion(tables: Tables, *, conversion_type: int = 1) -> DataFrame:
    """Touches not later than some conversion of their visitor, or of visitors without one."""
    conversions = tables["attributions"].filter(F.col("conversion_type_id") == conversion_type)
    touches = tables["touches"].select("touch_id", "unique_id", "time")
    return before_conversion(touches, conversions, "unique_id", "time", "conversion_date")


def first_touches(tables: Tables, *, scope: str = "saturday_week") -> DataFrame:
    """First touch of each visitor and period."""
    touches = tables["touches"].select("touch_id", "unique_id", "time", "medium", "landing_page")
    touches = touches.withColumn("period", period(F.col("time"), scope))
    return first_touch(touches, ["period", "unique_id"], "time", ["touch_id"])


def first_touches_of_the_day(tables: Tables, *, medium: str = "ORGANIC") -> DataFrame:
    """Touches of one medium at the first moment of their visitor and day."""
    touches = tables["touches"].filter(F.col("medium") == medium)
    touches = touches.select("touch_id", "unique_id", "time", period(F.col("time"), "day").alias("day"))
    return first_qualifying_per_day(touches, "unique_id", "day", "time")


def prior_touches(tables: Tables) -> DataFrame:
    """Every touch with the touch of the same visitor and day that is numbered one less."""
    touches = tables["touches"].select(
        "touch_id", "unique_id", "total_touch_count", period(F.col("time"), "day").alias("day")
    )
    return prior_touch(touches, touches, "unique_id", "total_touch_count", "day").select("touch_id", "prior_touch_id")


def session_pages(tables: Tables) -> DataFrame:
    """Which kinds of pages each session saw."""
    path = F.col("path")
    flags = {"blog": path.ilike("%blog%"), "signup": path.ilike("%signup%"), "resource": path.ilike("%resources%")}
    return session_flags(tables["pageviews"], [F.col("user_id"), F.col("session_id")], flags)


def last_page_before_pricing(tables: Tables) -> DataFrame:
    """Last other page of a session before its last pricing page."""
    pages = tables["pageviews"].select("user_id", "session_id", "time", "path", "utm_medium")
    target = F.coalesce(F.col("path") == "/pricing/", F.lit(False))
    return last_page_before(
        pages.filter(F.col("path").isNotNull()), ["user_id", "session_id"], "time", target, target,
        ["path", "utm_medium"],
    )


def single_variant_users(tables: Tables) -> DataFrame:
    """First exposure of users who saw one variant."""
    views = tables["experiment_views"].select("user_id", "experimentvariant", "time").distinct()
    return single_variant(views, ["user_id"], "experimentvariant", first_of="time")


def mixed_variant_emails(tables: Tables, *, experiment: str = "experiment_b") -> DataFrame:
    """Addresses seen with several variants."""
    return several_variants(tables["web_users"], "_email", experiment)


def single_device_users(tables: Tables, *, start: str = "1996-01-01") -> DataFrame:
    """Users on one device, with that device and their first Pacific day."""
    views = tables["pageviews"].filter(local_since(F.col("time"), start))
    first_day = F.min(trunc(to_pacific(F.col("time")), "day"))
    return single_device(views, ["user_id"], "device_type", first_day=first_day)


def identity_matches(tables: Tables, *, email_match: str = "pattern") -> DataFrame:
    """Web users with the leads their address or client id matches."""
    people = tables["identity_map"].select("heap_user_id", "inferred_email", "inferred_person_id")
    clients = tables["client"].select(F.col("id").alias("client_id"), "principalpersonid")
    people = people.join(clients, F.col("inferred_person_id") == F.col("principalpersonid"), "left").select(
        "heap_user_id", "inferred_email", "client_id"
    )
    leads = tables["lead_data"].select(F.col("id").alias("lead_id"), F.col("email").alias("lead_email"), "client_key")
    keys = [Key("inferred_email", "lead_email", email_match), Key("client_id", "client_key")]
    return identity_join(people, leads, keys)


def latest_bing_rows(tables: Tables) -> DataFrame:
    """Rows of the newest sync of each ad and period."""
    return latest_snapshot(
        tables["bing_ads"], ["timeperiod", "adid", "adgroupname", "campaignname"], "_sdc_report_datetime"
    )


def lead_scores(tables: Tables, *, field: str = "%score%") -> DataFrame:
    """Score each lead had when it was created, with the distance of the change that tells."""
    history = (
        tables["lead_history"]
        .filter(F.col("field").ilike(field))
        .select(short_id(F.col("leadid")).alias("history_short"), "newvalue__string", "oldvalue__string", "createddate")
    )
    leads = tables["lead_data"].select("id", F.col("lead_created_datetime_pstpdt").alias("created"))
    changed = to_pacific(F.col("createddate"))
    scored = nearest_change(
        leads.join(history, short_id(F.col("id")) == F.col("history_short")),
        "id", F.col("created"), changed, F.col("oldvalue__string"), F.col("newvalue__string"), "score",
    )
    return scored.select("id", "score", second_diff(changed, F.col("created")).cast("bigint").alias("seconds"))


def sessions_before_leads(tables: Tables) -> DataFrame:
    """Latest session of the same address before each lead was created."""
    users = tables["web_users"].select(F.col("user_id").alias("web_user"), "_email")
    sessions = tables["sessions"].join(users, F.col("user_id") == F.col("web_user"))
    sessions = sessions.select("_email", to_pacific(F.col("time")).alias("session_time"))
    leads = tables["lead_data"].select("id", F.col("email").alias("_email"), "lead_created_datetime_pstpdt")
    return latest_before(
        leads, sessions, "_email", "lead_created_datetime_pstpdt", "session_time", "last_session"
    )


def unsent_addresses(tables: Tables, *, mailing: str = "%August Cohort%") -> DataFrame:
    """Mailing addresses a mailing never went to."""
    sent = tables["mail_dashboard"].filter(F.col("primary_attribute_value").ilike(mailing))
    return audience_difference(tables["mail_leads"].select("email"), sent.select("email"))


def mailing_kinds(tables: Tables, *, rules: MailingRules | None = None) -> DataFrame:
    """Distinct recipients and unsubscribes of every mailing, triggered or not."""
    rules = rules or MailingRules()
    sends = tables["mail_dashboard"].withColumns({"triggered": rules.is_trigger(), "unsub_id": rules.unsub_id()})
    return sends.groupBy("primary_attribute_value", "triggered").agg(
        F.countDistinct("sent_id").alias("recipients"), F.countDistinct("unsub_id").alias("unsubs")
    )


def referrer_names(tables: Tables, *, names: Mapping[str, str] = REFERRERS) -> DataFrame:
    """Sessions per readable referrer."""
    return tables["sessions"].groupBy(referrer_name(F.col("referrer"), names).alias("referrer")).agg(
        F.count(F.lit(1)).alias("sessions")
    )


def outside_addresses(
    tables: Tables, *, internal: Sequence[str] = ("%corp.example%", "%test%")
) -> DataFrame:
    """Users who are not staff or testers; users without an address stay."""
    users = tables["web_users"].select("user_id", "_email")
    return users.filter(external(F.col("_email"), internal, keep_null=True))


def opportunity_values(tables: Tables) -> DataFrame:
    """Monthly value of every opportunity that became a client."""
    value = won_value(
        F.col("stagename"), F.col("bookkeeping_mrr__c"), F.col("tax_mrr__c"), F.col("pro_opp_status__c"),
        F.col("pro_mrr__c"),
    )
    return tables["opportunity"].select("id", value.alias("won_mrr"))


def qualified_dropouts(tables: Tables, *, definition: LeadDefinition | None = None) -> DataFrame:
    """CRM records that meet the lead definition but are not known leads, with what they were worth."""
    known = tables["lead_data"].select(F.col("id").alias("known"))
    values = opportunity_values(tables).withColumnRenamed("id", "opp_id")
    return (
        tables["crm_lead"]
        .filter((definition or LeadDefinition()).qualified())
        .join(known, F.col("id") == F.col("known"), "left_anti")
        .join(values, F.col("convertedopportunityid") == F.col("opp_id"), "left")
        .select("id", "client_key", "email", "opp_id", "won_mrr")
    )
