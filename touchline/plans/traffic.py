"""Site traffic by channel and activity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import ilike_any, is_true
from touchline.functions.times import local_since, period, period_since, period_until, to_pacific, trunc, ts
from touchline.operators.channels import (
    OWNED_CHANNELS,
    PAID_CHANNELS,
    REST_CHANNELS,
    SEARCH_SPLITS,
    ChannelRules,
    channel_flags,
    channel_rollup,
    fold_case,
)
from touchline.operators.funnel import funnel_counts, semi_month
from touchline.operators.joins import with_group_values
from touchline.operators.touch import (
    before_conversion,
    first_qualifying_per_day,
    first_touch,
    prior_touch,
    session_flags,
    within_limits,
)
from touchline.session import materialise

Tables = Mapping[str, DataFrame]

IGNORED_LANDINGS = ("%/careers%", "%nginx%")
LEAD = 1

_TOUCH_COLUMNS = (
    "touch_id", "unique_id", "time", "total_touch_count", "source", "medium", "submedium", "utm_medium",
    "utm_source", "utm_campaign", "landing_page",
)


def _lead_conversions(tables: Tables, lead_type: int) -> DataFrame:
    return tables["attributions"].filter(F.col("conversion_type_id") == lead_type)


def _real_landing(ignored: Sequence[str]) -> Column:
    """NULL landing pages are dropped too: no pattern test holds for them."""
    return ~ilike_any(F.col("landing_page"), ignored)


def _first_touches(
    tables: Tables, scope: str, start: str, ignored: Sequence[str], lead_type: int, extra: Column | None = None
) -> DataFrame:
    """First touch of each visitor and period, unless it follows the visitor's last lead conversion.

    If the first touch of a period is too late, all others of that period are, so
    the conversions are looked up after the reduction to one row per visitor.
    """
    touches = tables["touches"].select(*_TOUCH_COLUMNS).withColumn("thedate", period(F.col("time"), scope))
    touches = touches.filter(period_since(F.col("time"), start, scope) & _real_landing(ignored))
    if extra is not None:
        touches = touches.filter(extra)
    firsts = first_touch(touches, ["thedate", "unique_id"], "time", ["touch_id"])
    return before_conversion(firsts, _lead_conversions(tables, lead_type), "unique_id", "time", "conversion_date")


def channel_uniques(
    tables: Tables,
    *,
    scope: str = "month",
    start: str = "2023-12-30",
    ignored: Sequence[str] = IGNORED_LANDINGS,
    lead_type: int = LEAD,
    rules: ChannelRules | None = None,
) -> DataFrame:
    """Unique visitors per period and channel, by the channel of their first touch."""
    firsts = channel_flags(_first_touches(tables, scope, start, ignored, lead_type), "thedate", rules)
    detail = (*PAID_CHANNELS, *OWNED_CHANNELS, "search_core", "search_content", *SEARCH_SPLITS, *REST_CHANNELS)
    sums = channel_rollup(firsts, "thedate", detail)

    def plus(names: Sequence[str]) -> Column:
        return sum([F.col(n) for n in names[1:]], F.col(names[0]))

    split = ("search", "search_core", "search_content", *SEARCH_SPLITS, "social", "email")
    return sums.select(
        F.col("thedate").alias("Week_Starting"),
        plus(PAID_CHANNELS).alias("G&P Total"),
        *PAID_CHANNELS,
        plus(OWNED_CHANNELS).alias("O&C Total"),
        *split,
        *REST_CHANNELS,
        plus((*PAID_CHANNELS, *OWNED_CHANNELS, *REST_CHANNELS)).alias("Total"),
    ).orderBy(F.col("Week_Starting").asc_nulls_last(), F.col("G&P Total").asc_nulls_last())


def search_core_daily(
    tables: Tables,
    *,
    scope: str = "month",
    start: str = "2023-12-30",
    first_day: str = "2024-01-05",
    ignored: Sequence[str] = IGNORED_LANDINGS,
    lead_type: int = LEAD,
    rules: ChannelRules | None = None,
) -> DataFrame:
    """First touches of the period that are core search visits, by the day they happened."""
    time = F.col("time")
    recent = period_since(time, first_day, "day")
    firsts = channel_flags(
        _first_touches(tables, scope, start, ignored, lead_type, recent), "thedate", rules
    )
    return (
        firsts.filter("search_core > 0")
        .groupBy(trunc(time, "day").alias("day"))
        .agg(F.sum("search_core").cast("bigint").alias("sum"))
    )


def core_traffic_last_touch(
    tables: Tables,
    *,
    scope: str = "month",
    start: str = "2024-01-01",
    end: str = "2024-01-25",
    ignored: Sequence[str] = IGNORED_LANDINGS,
    lead_type: int = LEAD,
    rules: ChannelRules | None = None,
) -> DataFrame:
    """First core visits of the day per period, and the channels of the touch just before them.

    Only the touch numbered one less counts, and only on the same day.
    """
    rules = rules or ChannelRules(any_organic_core=True)
    time = F.col("time")
    touches = (
        tables["touches"]
        .select(*[c for c in _TOUCH_COLUMNS if c != "touch_id"])
        .withColumns({"thedate": trunc(time, "day"), "theweek": period(time, scope)})
        .filter(
            period_since(time, start, "day") & period_until(time, end, "day") & _real_landing(ignored)
        )
    )
    core = fold_case(touches).filter(rules.search_core(F.col("thedate"))).select(*touches.columns)
    # As in _first_touches, the first of the day decides before conversions are looked up.
    visits = before_conversion(
        first_qualifying_per_day(core, "unique_id", "thedate", "time"),
        _lead_conversions(tables, lead_type),
        "unique_id", "time", "conversion_date", keep_limits=True,
    )
    distinct_visits = materialise(
        visits.select(
            "thedate", "theweek", "time", "unique_id", "total_touch_count", "medium", "submedium", "utm_medium",
            "source", "utm_campaign", "landing_page", "__last", "__undated",
        ).distinct()
    )

    wanted = distinct_visits.select("unique_id", "total_touch_count", "thedate", "__last", "__undated").distinct()
    before = prior_touch(wanted, touches, "unique_id", "total_touch_count", "thedate", how="inner")
    before = before.filter(within_limits(F.col("prior_time"))).select(
        F.col("unique_id").alias("visitor"),
        F.col("total_touch_count").alias("visit_number"),
        *[F.col(f"prior_{c}").alias(c) for c in touches.columns],
    )
    channels = (*PAID_CHANNELS, "search_content", *[c for c in OWNED_CHANNELS if c != "search"], *REST_CHANNELS)
    # Flags without a column in the report still tell two earlier touches apart; the search splits
    # are one value here.
    source = F.col("source")
    engine = F.when(source.isin("GOOGLE", "BING"), source).when(source.isNotNull(), "OTHER")
    flagged = channel_flags(before, "thedate", rules).select(
        "thedate", "theweek", "visitor", "visit_number", "landing_page", *channels, "search", "search_core",
        F.when(F.col("search") == 1, engine).alias("engine"),
    )
    last_touch = channel_rollup(flagged.distinct(), "theweek", channels)
    visits_per_period = distinct_visits.groupBy("theweek").agg(F.count(F.lit(1)).alias("core"))
    return visits_per_period.join(last_touch, "theweek", "left").select("theweek", "core", *channels)


def partner_semimonth_funnel(
    tables: Tables,
    *,
    utm_medium: str = "%acme%",
    utm_source: str = "%partner%",
    utm_campaign: str = "%marketplace%",
    utm_content: str = "%lead-referral-page%",
) -> DataFrame:
    """Visitors, leads, trials and clients a partner sent, per half month.

    A visitor belongs to the first Pacific day seen within the UTC month.
    """
    touches = tables["touches"].filter(
        F.col("utm_medium").ilike(utm_medium)
        & F.col("utm_source").ilike(utm_source)
        & F.col("utm_campaign").ilike(utm_campaign)
        & F.col("utm_content").ilike(utm_content)
    )
    visitor = ["utc_month", "unique_id"]
    seen = touches.groupBy(trunc(F.col("time"), "month").alias("utc_month"), "unique_id", "lead_id").agg(
        F.min(trunc(to_pacific(F.col("time")), "day")).alias("day")
    )
    days = with_group_values(seen, visitor, touch_day=F.min("day"))
    month = trunc(F.col("touch_day"), "month")
    leads = tables["lead_data"].select(F.col("id").alias("known_lead"), "opp_id")
    opps = tables["opportunity"].select(F.col("id").alias("opp"), "review_call_booked_boolean__c", "stagename")
    joined = (
        days.withColumns({"themonth": month, "semi_month": semi_month(F.col("touch_day"), month)})
        .join(leads, F.col("lead_id") == F.col("known_lead"), "left")
        .join(opps, F.col("opp_id") == F.col("opp"), "left")
    )
    return funnel_counts(
        joined,
        ["themonth", "semi_month"],
        {
            "uniques": ("unique_id", None),
            "leads": ("lead_id", None),
            "trials": ("lead_id", is_true(F.col("review_call_booked_boolean__c"))),
            "clients": ("lead_id", F.col("stagename") == "Client"),
        },
    ).orderBy(F.col("themonth").asc_nulls_last(), F.col("semi_month").asc_nulls_last())


class GrowthPatterns:
    """Page and campaign patterns of the growth report."""

    def __init__(
        self,
        refer: str = "%refer-a-friend%",
        refer_page: str = "/refer-a-friend/",
        referral_landing: str = "%friends-of-site%",
        paid_mediums: Sequence[str] = ("display", "cpc"),
        tool_landing: str = "%join.site%",
        tool_landing_not: str = "%expense-quiz%",
    ) -> None:
        path, medium, landing = F.col("path"), F.col("utm_medium"), F.col("landing_page")
        self.refer_view = path.ilike(refer) & (path != refer_page)
        self.referral_view = path.ilike(referral_landing)
        self.paid_view = medium.isin(*paid_mediums)
        self.session = {
            "tool": landing.ilike(tool_landing) & ~landing.ilike(tool_landing_not),
            "blog": path.ilike("%blog%") & ~path.ilike("%/blog/resources%"),
            "signup": path.ilike("%signup%"),
            "resource": path.ilike("%resources%"),
        }


# Column of the wide report and label of the long one.
_VIEW_ACTIVITIES = {"raf_inapp": "raf_inapp_pv", "raf_lp": "raf_lp_pv", "paid_pv": "paid_pv"}
_SESSION_ACTIVITIES = ("blog_sup", "blog_resource")


def _growth_months(
    tables: Tables, start: str, views: Mapping[str, Column], first_match: bool, patterns: GrowthPatterns
) -> DataFrame:
    """Per Pacific month: distinct users of each activity, and whether the activity or its source occurs.

    Views are bounded by the moment, sessions by the month. Both come from one pass
    over the page views: sessions first, then users, then months.
    """
    time = F.col("time")
    local = to_pacific(time)
    month = trunc(local, "month")
    pages = tables["pageviews"].filter(local_since(time, start))
    flags = {**views, **{f"in_{n}": c for n, c in patterns.session.items()}}
    sessions = session_flags(pages, [month.alias("themonth"), F.col("user_id"), F.col("session_id")], flags)
    counted = F.col("themonth") >= ts(start)
    to_signup = F.col("in_blog") & (F.col("in_tool") | F.col("in_signup"))
    to_resource = F.col("in_blog") & F.col("in_resource")
    if first_match:
        to_resource = ~F.coalesce(to_signup, F.lit(False)) & to_resource
    sessions = sessions.withColumns(
        {"blog_sup": counted & to_signup, "blog_resource": counted & to_resource, "any_session": counted}
    )
    names = [*views, *_SESSION_ACTIVITIES]
    users = session_flags(
        sessions, [F.col("themonth"), F.col("user_id")], {n: F.col(n) for n in [*names, "any_session"]}
    )
    known = F.col("user_id").isNotNull()
    return users.groupBy("themonth").agg(
        *[F.count_if(F.col(n) & known).alias(n) for n in names],
        *[F.coalesce(F.bool_or(n), F.lit(False)).alias(f"has_{n}") for n in names],
        F.bool_or("any_session").alias("any_session"),
    )


def _share_clicks(tables: Tables, start: str) -> DataFrame:
    clicks = tables["share_clicks"].filter(local_since(F.col("time"), start))
    return clicks.groupBy(trunc(to_pacific(F.col("time")), "month").alias("click_month")).agg(
        F.countDistinct("user_id").alias("raf_clicks")
    )


def growth_web_long(
    tables: Tables, *, start: str = "1996-01-01", patterns: GrowthPatterns | None = None
) -> DataFrame:
    """Distinct users per month and activity; a view or session counts for its first matching activity."""
    p = patterns or GrowthPatterns()
    no = F.lit(False)
    refer, referral = F.coalesce(p.refer_view, no), F.coalesce(p.referral_view, no)
    views = {"raf_inapp": refer, "raf_lp": ~refer & referral, "paid_pv": ~refer & ~referral & p.paid_view}
    months = _growth_months(tables, start, views, True, p)
    labels = {**_VIEW_ACTIVITIES, **{n: n for n in _SESSION_ACTIVITIES}}
    entries = [
        F.struct(F.col(f"has_{n}").alias("present"), F.col(n).alias("count"), F.lit(label).alias("web_activity"))
        for n, label in labels.items()
    ]
    activities = months.select("themonth", F.inline(F.array(*entries))).filter("present").drop("present")
    clicks = _share_clicks(tables, start)
    return activities.unionAll(
        clicks.select(F.col("click_month").alias("themonth"), F.col("raf_clicks").alias("count"), F.lit("raf_clicks"))
    )


def growth_web_wide(
    tables: Tables, *, start: str = "1996-01-01", patterns: GrowthPatterns | None = None
) -> DataFrame:
    """The activities as columns; here a view counts for every activity it matches.

    A month without a listed view has no view counts, and one without sessions has
    neither session counts nor clicks.
    """
    p = patterns or GrowthPatterns()
    views = {"raf_inapp": p.refer_view, "raf_lp": p.referral_view, "paid_pv": p.paid_view}
    months = _growth_months(tables, start, views, False, p)
    any_view = F.col("has_raf_inapp") | F.col("has_raf_lp") | F.col("has_paid_pv")
    any_session = F.col("any_session")
    clicks = _share_clicks(tables, start)
    return (
        months.filter(any_view | any_session)
        .join(clicks, any_session & (F.col("themonth") == F.col("click_month")), "left")
        .select(
            "themonth",
            *[F.when(any_view, F.col(n)).alias(n) for n in ("raf_inapp", "raf_lp")],
            "raf_clicks",
            F.when(any_view, F.col("paid_pv")).alias("paid_pv"),
            *[F.when(any_session, F.col(n)).alias(n) for n in _SESSION_ACTIVITIES],
        )
    )
