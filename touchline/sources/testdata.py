"""Marketing tables derived from the generic star-schema test data.

The test data has no marketing tables, so each logical table is defined as one
query over the base tables. The text is plain SQL that Spark and DuckDB both
accept, apart from the few expressions in ``Dialect``; the correctness check can
therefore start from the same rows on both sides. ``$name`` refers to another
table.

Column values are spread over rows by arithmetic on the keys; which rows a table
has is decided by attributes of the base tables. The touch number, too, comes from
the event key: a visitor's numbers have gaps and repeats, as in a real touch log.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession

from touchline.sources.catalog import Catalog

BASE_TABLES = ("customer", "orders", "lineitem", "events", "conversations", "nation")

SITE = "site.example"
PRICING = f"{SITE}/pricing/"
BLOG = f"{SITE}/blog/a/"
LEGACY = f"{SITE}/ecommerce/"


@dataclass(frozen=True)
class Dialect:
    """Expressions that the two engines spell differently."""

    name: str

    def ts(self, text: str) -> str:
        kind = "timestamp_ntz" if self.name == "spark" else "timestamp"
        return f"{kind} '{text}'"

    def pacific(self, expr: str) -> str:
        if self.name == "spark":
            return f"convert_timezone('UTC', 'PST8PDT', {expr})"
        return f"timezone('PST8PDT', timezone('UTC', {expr}))"

    def trunc(self, unit: str, expr: str) -> str:
        call = f"date_trunc('{unit}', {expr})"
        return f"cast({call} as timestamp_ntz)" if self.name == "spark" else f"cast({call} as timestamp)"


SPARK = Dialect("spark")
DUCKDB = Dialect("duckdb")


def pick(expr: str, *values: str | None) -> str:
    """The value at position ``expr`` (from 0); None is NULL."""
    arms = " ".join(
        f"WHEN {i} THEN " + ("CAST(NULL AS string)" if v is None else f"'{v}'")
        for i, v in enumerate(values)
    )
    return f"CASE {expr} {arms} END"


def key(letter: str, k: str) -> str:
    """18-character record id whose first 15 characters are unique."""
    return f"'{letter}' || lpad(cast({k} as string), 14, '0') || 'AAA'"


def mail(k: str) -> str:
    """Address of customer ``k``: absent, odd case, pattern characters, internal, shared, plain."""
    text = f"cast({k} as string)"
    shared = f"cast(cast(floor({k} / 22) as bigint) as string)"
    return (
        f"CASE {k} % 11 WHEN 0 THEN NULL"
        f" WHEN 1 THEN 'USER' || {text} || '@MAIL.EXAMPLE'"
        f" WHEN 2 THEN 'user_' || {text} || '@mail.example'"
        f" WHEN 3 THEN 'user' || {text} || '@corp.example'"
        f" WHEN 4 THEN 'test' || {text} || '@mail.example'"
        f" WHEN 5 THEN 'userx' || cast({k} - 3 as string) || '@mail.example'"
        f" WHEN 6 THEN 'shared' || {shared} || '@mail.example'"
        f" WHEN 7 THEN CASE {k} % 44 WHEN 7 THEN 'a%' || {text} || '@mail.example'"
        f" WHEN 18 THEN 'user' || {text} || '%@mail.example'"
        f" ELSE 'abe' || {text} || '@mail.example' END"
        f" ELSE 'user' || {text} || '@mail.example' END"
    )


def third(k: str) -> str:
    return f"cast(floor({k} / 3) as bigint)"


# One touch per shape: medium, submedium, source, utm_medium, utm_source, utm_campaign, landing page.
TOUCH_SHAPES = (
    ("GROWTH & PAID", "OTHER", "FACEBOOK", "cpc", "fb", "spring_promo", PRICING),
    ("GROWTH & PAID", "OTHER", "FACEBOOK", "cpc", "fb", "Awareness_1", PRICING),
    ("GROWTH & PAID", "OTHER", "FACEBOOK", "cpc", "fb", None, PRICING),
    ("GROWTH & PAID", "BRANDED SEARCH", "GOOGLE", "cpc", "g", "us_brand", PRICING),
    ("OTHER", "OTHER", "GOOGLE", "cpc", "g", "us_nonbrand_x", PRICING),
    ("GROWTH & PAID", "OTHER", "GOOGLE", "cpc", "g", "us_competitor_x", PRICING),
    ("GROWTH & PAID", "OTHER", "BING", "cpc", "b", "Bing - Search Non-Brand USA (Engine)", PRICING),
    ("GROWTH & PAID", "DISPLAY", "YOUTUBE", "display", "y", "x", PRICING),
    ("GROWTH & PAID", "OTHER", "YOUTUBE", "video", "y", "x", PRICING),
    ("GROWTH & PAID", "OTHER", "REDDIT", "cpc", "r", "x", PRICING),
    ("GROWTH & PAID", "PODCAST", "OTHER", "audio", None, None, PRICING),
    ("GROWTH & PAID", "OTHER", "QUORA", "cpc", "q", "x", PRICING),
    ("GROWTH & PAID", "OTHER", "GOOGLE", "CPC", "g", None, PRICING),
    ("ORGANIC", "OTHER", "GOOGLE", None, None, None, PRICING),
    ("ORGANIC", "OTHER", "BING", None, None, None, BLOG),
    ("ORGANIC", "OTHER", "UNIDENTIFIABLE SEARCH ENGINE", None, None, None, LEGACY),
    ("ORGANIC", "OTHER", "OTHER", "social", None, None, BLOG),
    ("ORGANIC", "OTHER", "OTHER", "social", None, None, PRICING),
    ("E-MAIL", "OTHER", "OTHER", "email", None, None, PRICING),
    ("OTHER", "OTHER", "OTHER", "marketing_email", None, None, PRICING),
    ("DIRECT", "OTHER", "OTHER", None, None, None, PRICING),
    ("OTHER", "OTHER", "SHOPIFY", "partner", "acme", None, PRICING),
    ("UNKNOWN", "OTHER", "OTHER", None, None, None, PRICING),
    ("OTHER", "OTHER", "OTHER", None, "xgooglex", None, PRICING),
    ("ORGANIC", "OTHER", "DUCKDUCKGO", None, None, None, PRICING),
    ("ORGANIC", "OTHER", "GOOGLE", None, None, None, f"{SITE}/careers"),
    ("DIRECT", "OTHER", "OTHER", None, None, None, None),
    ("OTHER", "OTHER", "LINKEDIN", "cpc", "l", "us_prospecting_linkedIn_rd", PRICING),
    ("OTHER", "OTHER", "GOOGLE", "organic", "g", "abc_gmb", PRICING),
    ("OTHER", "OTHER", "GOOGLE", None, "g", "NOTB", BLOG),
    ("OTHER", "OTHER", "OTHER", "display_ad", None, "x", PRICING),
    ("OTHER", "OTHER", "OTHER", "acme_referral", "partner_site", "marketplace_x", PRICING),
)

MAILINGS = ("Week_A", "x_OPR_y", "xaOPRby", "syllabus_1", "Nurture_V2_a", "August Cohort")

PATHS = (
    "/", "/blog/a/", "/blog/resources/b/", "/signup/", "/pricing/", "/go/bookkeepers/",
    "/refer-a-friend/", "/refer-a-friend/x/", "/friends-of-site/", "/about/", None, "/faq/",
)

CHANNELS = (
    "other_gp", "display", "competitor", "youtube", "non_branded_search", "branded_search", "podcast",
    "facebook", "reddit", "email", "search_content", "search_core", "social", "direct",
)

LEAD_SOURCES = (
    "Live Chat", "Content", "List Upload", "Outbound", "Organic", None,
    "Referred By Other Unrelated Business", "Freshbooks", "Test Lead",
)


def _shape_rows() -> str:
    def text(v: str | None) -> str:
        return "CAST(NULL AS string)" if v is None else f"'{v}'"

    return ", ".join(f"({i}, {', '.join(map(text, s))})" for i, s in enumerate(TOUCH_SHAPES))


@cache
def definitions(d: Dialect) -> dict[str, str]:
    """Logical table -> SQL over the base tables and each other."""
    q: dict[str, str] = {}

    # --- web behaviour, from the event stream -----------------------------------
    q["touches"] = f"""
        SELECT e.event_id AS touch_id, cast(e.user_id as string) AS unique_id, e.ts AS time,
               cast(floor(e.event_id / 150) as int) AS total_touch_count,
               s.source, s.medium, s.submedium, s.utm_medium, s.utm_source, s.utm_campaign,
               CASE WHEN s.shape = 31 THEN 'lead-referral-page' END AS utm_content,
               {pick('e.event_id % 4', None, 'https://google.example/?q=a', 'https://partner.example/',
                     'https://corp.example/x')} AS referrer,
               s.landing_page, {key('L', 'e.user_id')} AS lead_id
        FROM $events e
        JOIN (VALUES {_shape_rows()}) AS s(shape, medium, submedium, source, utm_medium, utm_source,
                                           utm_campaign, landing_page)
          ON e.event_id % 32 = s.shape"""
    q["conversion_events"] = f"""
        SELECT event_id, user_id, cast(user_id as string) AS unique_id, {key('L', 'user_id')} AS lead_id,
               CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END
                   AS conversion_type_id,
               CASE event_type WHEN 'signup' THEN 'LEAD' WHEN 'click' THEN 'TRIAL'
                    WHEN 'purchase' THEN 'CLIENT' ELSE 'REVIEW CALL' END AS conversion_type,
               ts AS conversion_date,
               CASE WHEN event_id % 2 = 1 THEN cast(0.5 as double) ELSE cast(1.0 as double) END
                   AS conversion_credit,
               {pick('event_id % 14', *CHANNELS)} AS channel
        FROM $events
        WHERE event_type IN ('click', 'purchase', 'error') OR (event_type = 'signup' AND value < 5)"""
    q["attributions"] = f"""
        SELECT unique_id, lead_id, conversion_type_id, conversion_type, conversion_date, conversion_credit,
               CASE WHEN event_id % 7 <> 0 THEN 'kw' || cast(event_id % 20 as string) END AS utm_term,
               {pick('event_id % 3', 'Desktop', 'Mobile', 'Tablet')} AS device_type
        FROM $conversion_events"""
    q["attributions_channel"] = f"""
        SELECT 'C' || cast(user_id as string) AS client_key, lead_id, {key('O', 'user_id')} AS opp_id,
               channel, lower(conversion_type) AS conversion_type, conversion_date, conversion_credit
        FROM $conversion_events"""
    saturday = f"{d.trunc('week', "conversion_date + interval '2' day")} - interval '2' day"
    q["attributions_translated"] = f"""
        SELECT 'C' || cast(user_id as string) AS lead_client_id, lead_id,
               {key('O', 'user_id')} AS opportunity_id,
               CASE WHEN channel = 'email' THEN conversion_credit ELSE cast(0 as double) END AS email,
               conversion_date, {saturday} AS thedate, conversion_type_id,
               {pick('event_id % 3', None, 'email', 'marketing_email')} AS utm_medium,
               {pick('event_id % 2', 'nurture_email', None)} AS utm_source,
               {pick('event_id % 5', 'salesnurture', 'a', 'b', None, 'c')} AS utm_campaign,
               '{PRICING}' AS landing_page, {pick('event_id % 2', None, 'https://corp.example/x')} AS referrer
        FROM $conversion_events"""
    q["attributions_by_channel"] = f"""
        SELECT lead_id, conversion_date, lower(conversion_type) AS conversion_type,
               {pick('event_id % 5', 'scored', 'email', 'facebook', 'search_core', 'direct')} AS channel_1,
               {pick('event_id % 2', None, 'social')} AS channel_2,
               conversion_credit AS credit_1,
               CASE WHEN event_id % 2 = 1 THEN 1 - conversion_credit END AS credit_2
        FROM $conversion_events"""
    q["reallocation"] = """
        SELECT conversion_date, lower(conversion_type) AS conversion_type,
               conversion_credit AS channel_credit
        FROM $conversion_events"""

    # --- web behaviour, from orders and their lines ------------------------------
    q["pageviews"] = f"""
        SELECT o.o_custkey AS user_id, o.o_orderkey AS session_id,
               o.o_orderdate + interval '1' hour * (l.l_suppkey % 24)
                   + interval '7' minute * l.l_linenumber AS time,
               {pick('l.l_partkey % 12', *PATHS)} AS path,
               CASE WHEN l.l_partkey % 12 = 3 OR l.l_partkey % 24 = 10 THEN 'Funnel 2.0 page'
                    ELSE 'Page' END AS title,
               {pick('o.o_orderkey % 6', f'{SITE}/blog/a/', f'{SITE}/', f'{SITE}/friends-of-site/',
                     f'join.{SITE}/', f'{SITE}/go/professional-bookkeepers/', None)} AS landing_page,
               {pick('l.l_suppkey % 5', None, 'cpc', 'display', 'marketing_email', 'social')} AS utm_medium,
               CASE WHEN l.l_suppkey % 5 = 3 THEN 'nurture_email' END AS utm_source,
               CASE WHEN l.l_suppkey % 5 = 3 THEN 'salesnurture'
                    WHEN l.l_suppkey % 5 = 1 THEN 'ads_rd' WHEN l.l_suppkey % 5 = 2 THEN 'other' END
                   AS utm_campaign,
               CASE WHEN l.l_suppkey % 5 = 3 THEN 'nurturelead' END AS utm_content,
               CASE WHEN o.o_custkey % 4 = 0 THEN {pick('o.o_orderkey % 2', 'Desktop', 'Mobile')}
                    ELSE {pick('o.o_custkey % 3', 'Desktop', 'Mobile', 'Tablet')} END AS device_type
        FROM $lineitem l JOIN $orders o ON l.l_orderkey = o.o_orderkey"""
    q["sessions"] = f"""
        SELECT user_id, min(time) AS time,
               {pick('session_id % 4', None, 'https://google.example/?q=a', 'https://partner.example/',
                     'https://corp.example/x')} AS referrer,
               landing_page, min(utm_medium) AS utm_medium, min(utm_content) AS utm_content
        FROM $pageviews GROUP BY user_id, session_id, landing_page"""
    q["signup_tool_views"] = """
        SELECT user_id, time, '1 - Sign Up Page' AS page_name, '1 - Sign Up Page' AS view_name, landing_page
        FROM $pageviews WHERE path = '/signup/' AND device_type = 'Mobile'"""
    q["contact_events"] = """
        SELECT user_id, time, landing_page, utm_campaign FROM $pageviews WHERE path = '/pricing/'"""
    q["share_clicks"] = "SELECT user_id, time FROM $pageviews WHERE path = '/refer-a-friend/x/'"
    q["demo_form_events"] = """
        SELECT user_id, time,
               CASE WHEN utm_medium = 'social' THEN '/other/' ELSE '/request-a-demo/' END AS path
        FROM $pageviews WHERE path = '/faq/'"""
    q["experiment_views"] = f"""
        SELECT user_id, time,
               CASE user_id % 5 WHEN 4 THEN {pick('session_id % 2', 'control', 'test')}
                    ELSE {pick('user_id % 2', 'control', 'test')} END AS experimentvariant,
               {pick('session_id % 2', 'Campaign-X', 'campaign-x')} AS campaignid
        FROM $pageviews WHERE path = '/'"""

    # --- identities, from customers ----------------------------------------------
    person = "CASE WHEN c_custkey % 4 = 1 THEN 'C' ELSE 'P' END || cast(c_custkey as string)"
    q["web_users"] = f"""
        SELECT c_custkey AS user_id, {person} AS id,
               CASE WHEN c_custkey % 7 = 3 THEN NULL ELSE {mail('c_custkey')} END AS _email,
               cast(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 1 + c_custkey % 2 END as int) AS experiment_a,
               cast(c_custkey % 2 as int) AS experiment_b,
               cast(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 3 END as int) AS experiment_c,
               cast(CASE WHEN c_custkey % 5 = 0 THEN 1 END as int) AS experiment_d
        FROM $customer"""
    q["identity_map"] = f"""
        SELECT c_custkey AS heap_user_id, {mail('c_custkey')} AS inferred_email,
               {person} AS inferred_person_id
        FROM $customer WHERE c_nationkey <> 3"""
    q["person"] = f"""
        SELECT {person} AS id, CASE WHEN c_custkey % 6 = 2 THEN NULL ELSE {mail('c_custkey')} END AS email
        FROM $customer"""
    q["client"] = f"""
        SELECT 'C' || cast(c_custkey as string) AS id, {person} AS principalpersonid
        FROM $customer WHERE c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD', 'MACHINERY')
        UNION ALL
        SELECT 'C' || cast(c_custkey + 1 as string) || 'B', {person} FROM $customer WHERE c_nationkey < 6"""

    # --- leads and opportunities --------------------------------------------------
    q["lead_clock"] = """
        SELECT c.c_custkey AS k, c.c_nationkey, c.c_mktsegment, c.c_name, c.c_acctbal, f.first_order,
               f.first_order + interval '1' day * (c.c_custkey % 400)
                   + interval '1' hour * (c.c_custkey % 24) AS created
        FROM $customer c
        JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM $orders GROUP BY o_custkey) f
          ON f.o_custkey = c.c_custkey"""
    source = pick(f"{third('k')} % 9", *LEAD_SOURCES)
    stamp = pick(f"{third('k')} % 3", "MBC", "Paid", None)
    closed = "CASE WHEN k % 7 <> 0 THEN created + interval '1' day * (k % 90) END"
    has_opp = "c_nationkey >= 8"
    q["lead_data"] = f"""
        SELECT {key('L', 'k')} AS id, {mail('k')} AS email,
               'C' || cast(k as string) || CASE WHEN k % 16 = 1 THEN 'B' ELSE '' END AS client_key,
               CASE WHEN {has_opp} THEN {key('O', 'k')} END AS opp_id, {key('A', 'k')} AS accountid,
               {pick('k % 3', 'Demo', 'Signup', None)} AS cta, {source} AS leadsource,
               {stamp} AS channel_allocation_stamp__c, created AS lead_created_datetime_pstpdt,
               created AS actual_date_created__c,
               CASE WHEN {has_opp} THEN {closed} END AS closedate,
               CASE WHEN {has_opp} AND k % 6 IN (1, 5) THEN c_acctbal END AS won_mrr,
               k % 4 = 0 AS catch_up_only_team__c
        FROM $lead_clock WHERE c_mktsegment <> 'BUILDING'"""
    q["opportunity"] = f"""
        SELECT {key('O', 'k')} AS id, {key('A', 'k')} AS accountid,
               {pick('k % 6', 'Open', 'Client', 'Closed Lost', 'Open', 'Onboarded with Retro', 'Client')}
                   AS stagename,
               {source} AS leadsource, {pick('k % 5', 'RT_NEW', 'RT_RETRO', 'RT_OTHER', 'RT_NEW', 'RT_RETRO')}
                   AS recordtypeid,
               CASE WHEN k % 4 = 1 THEN 'C' ELSE 'P' END || cast(k as string) AS client_key,
               {pick('k % 2', 'Client', 'None')} AS pro_opp_status__c, {closed} AS closedate,
               CASE WHEN k % 4 <> 0 THEN created + interval '1' day * (k % 50) END AS trial_call_booked__c,
               CASE WHEN k % 4 <> 0 THEN created + interval '1' day * (k % 50) + interval '1' hour END
                   AS review_call_booked,
               CASE WHEN k % 4 <> 0 THEN created + interval '1' day * (k % 55) END AS review_call_date_time__c,
               k % 6 IN (1, 5) AS iswon, k % 6 IN (1, 2, 5) AS isclosed, k % 4 <> 0
                   AS review_call_booked_boolean__c,
               CASE WHEN k % 5 <> 1 THEN c_acctbal END AS bookkeeping_mrr__c,
               CASE WHEN k % 5 <> 1 THEN c_acctbal / 4 END AS tax_mrr__c,
               CASE WHEN k % 5 <> 1 THEN c_acctbal / 8 END AS pro_mrr__c
        FROM $lead_clock WHERE {has_opp}"""
    q["crm_lead"] = f"""
        SELECT {key('L', 'k')} AS id, {mail('k')} AS email, 'C' || cast(k as string) AS client_key,
               {source} AS leadsource, {pick('k % 3', 'Open', 'Qualified', 'Lost')} AS status,
               {pick('k % 6', 'RT_LEAD', 'RT_LEAD', 'RT_LEAD', 'RT_LEAD', 'RT_LEAD', 'RT_PARTNER')}
                   AS recordtypeid,
               '555-' || cast(k as string) AS phone,
               {pick('k % 13', 'Fake lead / account', 'Price', 'Missed Call - No Contact')} AS loss_reason__c,
               {pick('k % 11', 'Sales Operations', 'Sales', 'Support')} AS owner_role__c,
               'U' || cast(k % 10 as string) AS ownerid,
               CASE WHEN {has_opp} THEN {key('O', 'k')} END AS convertedopportunityid,
               {pick('k % 4', 'Demo', 'Signup', None, 'Quiz')} AS cta__c,
               {pick('k % 5', 'Tax Info Call', 'Signup', None, 'Demo', 'Quiz')} AS test_1__c,
               {stamp} AS channel_allocation_stamp__c,
               CASE WHEN k % 5 = 0 THEN 'yes' END AS providedemail__c,
               CASE WHEN k % 8 = 0 THEN 'yes' END AS providedcompanydetails__c,
               CASE WHEN k % 10 = 3 THEN 'yes' END AS createdaccount__c,
               {pick('k % 3', 'A', 'B', None)} AS team_suf2__c,
               {pick('k % 4', 'Hot', 'Warm', 'Cold', None)} AS lead_score_rating__c,
               cast(k % 100 as string) AS lead_scoring_lead__c,
               'A' || lpad(cast(k - k % 5 as string), 14, '0') AS referring_contact_account_id__c,
               CASE WHEN k % 2 = 0 THEN 'Contact ' || cast(k as string) END
                   AS ambassador__referred_by_contact__c,
               k % 4 = 1 AS isconverted, k % 17 = 0 AS isdeleted, created AS actual_date_created__c,
               created + interval '3' day AS potential_date__c,
               CASE WHEN k % 4 = 1 THEN created + interval '9' day END AS converteddate,
               CASE WHEN k % 3 <> 0 THEN created + interval '1' day * (k % 60) END AS nurture_date__c,
               CASE WHEN k % 4 <> 0 THEN created + interval '1' day * (k % 90) END
                   AS re_engagement_datetime__c,
               CASE WHEN k % 6 <> 0 THEN first_order + interval '1' day * (k % 10) END
                   AS lead_assignment_date__c,
               CASE WHEN k % 9 <> 0 THEN first_order + interval '1' day * (k % 8) END
                   AS first_lead_assignment_date__c,
               CASE WHEN k % 5 = 0 THEN first_order + interval '1' day * (k % 300) END
                   AS mql_first_date_time__c,
               CASE WHEN k % 7 = 0 THEN first_order + interval '1' day * (k % 400) END
                   AS mql_last_date_time__c
        FROM $lead_clock"""
    q["crm_user"] = "SELECT 'U' || cast(n_nationkey as string) AS id FROM $nation"
    q["account"] = f"""
        SELECT {key('A', 'c_custkey')} AS id,
               CASE WHEN c_custkey % 10 <> 0 THEN {key('A', 'c_custkey - c_custkey % 10')} END AS parentid,
               CASE WHEN c_custkey % 23 <> 0 THEN 'C' || cast(c_custkey as string) END AS client_key,
               c_name AS name, CASE WHEN c_custkey % 20 IN (10, 13) THEN 'RT_PARTNER' ELSE 'RT_CLIENT' END
                   AS recordtypeid,
               {mail('c_custkey')} AS primary_contact_email__c, c_custkey % 19 = 0 AS isdeleted
        FROM $customer"""
    q["lead_history"] = f"""
        SELECT {key('L', 'o_custkey')} AS leadid,
               {pick('o_orderkey % 3', 'Lead_Score', 'Status', 'score_total')} AS field,
               {pick('o_orderkey % 5', 'A', 'B', 'C', 'D', 'E')} AS newvalue__string,
               {pick('(o_orderkey + 1) % 5', 'A', 'B', 'C', 'D', 'E')} AS oldvalue__string,
               o_orderdate AS createddate
        FROM $orders"""
    q["scored_funnel"] = """
        SELECT l.prefix AS ls_sal_lead_id, l.lead_created_datetime_pstpdt AS ls_sal_lead_conversion,
               o.trial_call_booked__c AS ls_sal_trial_conversion,
               CASE WHEN o.iswon THEN o.closedate END AS ls_sal_client_conversion
        FROM (SELECT left(id, 15) AS prefix, opp_id, lead_created_datetime_pstpdt FROM $lead_data) l
        LEFT JOIN $opportunity o ON l.opp_id = o.id"""
    q["lead_attributions"] = """
        SELECT email, opp_id AS opportunity_id, lead_created_datetime_pstpdt FROM $lead_data"""
    q["attributions_crm"] = """
        SELECT l.id, l.lead_created_datetime_pstpdt AS raw_date,
               CASE WHEN l.leadsource LIKE 'Referred%' OR l.leadsource = 'Organic' THEN 1 ELSE 0 END AS referrals,
               CASE WHEN l.cta IS NULL THEN 0 ELSE 1 END AS lead_ind
        FROM $lead_data l"""
    q["campaign_member"] = f"""
        SELECT CASE WHEN k % 2 = 0 THEN {key('L', 'k')} END AS leadid, {mail('k')} AS email,
               CASE WHEN c_acctbal < 6000 THEN 'CAMPAIGN_1' ELSE 'CAMPAIGN_2' END AS campaignid,
               created + interval '1' day * (k % 20) - interval '10' day AS createddate
        FROM $lead_clock"""

    # --- mailings -------------------------------------------------------------------
    q["mail_leads"] = f"""
        SELECT 'M' || cast(k as string) AS id, CASE WHEN k % 9 <> 0 THEN {key('L', 'k')} END AS sfdcleadid,
               CASE WHEN k % 29 = 0 THEN 'pair' || cast(cast(floor(k / 58) as bigint) as string)
                    || '@mail.example' ELSE {mail('k')} END AS email,
               {pick('k % 17', 'Partner List', 'List Upload', 'Test Lead', 'Freshbooks', None, 'Organic')}
                   AS leadsource,
               CASE WHEN k % 37 = 5 THEN 'Accountant' END AS leadsource__c,
               {pick('k % 31', 'Vendor', 'Client', 'Trial with CC', 'Partner')} AS account_type__c,
               {pick('k % 21', 'TRUE', 'FALSE', 'FALSE', 'FALSE')} AS emailinvalid,
               {pick('k % 41', 'TRUE', 'FALSE')} AS email_opt_out_formula__c,
               {pick('k % 43', 'True', 'true', 'yes', 'no')} AS email_opt_out__c,
               {pick('k % 47', 'TRUE', 'FALSE')} AS do_not_contact__c,
               {pick('k % 3', 'TRUE', 'FALSE', None)} AS reseller__c,
               {pick('k % 4', 'TRUE', 'FALSE')} AS reseller_lead__c,
               {pick('k % 33', 'Catch Up', 'Keep up', 'KEEP_UP', 'CATCH_UP', 'Gone')} AS account_status__c,
               {pick('k % 53', 'TRUE', 'FALSE')} AS pro_email_opt_out__c,
               {pick('k % 7', None, 'RT_LEAD', 'RT_PARTNER', 'RT_OTHER', 'RT_LEAD', None, 'RT_LEAD')}
                   AS recordtypeid,
               {pick('k % 5', 'RT_LEAD', 'RT_PARTNER', 'RT_OTHER', None, 'RT_LEAD')} AS recordtypeid_lead,
               {pick('k % 8', None, 'Unknown', 'US', 'USA', 'Canada', 'AUSTRALIA', 'United States',
                     'united_states')} AS country,
               {pick('k % 6', None, None, 'Unknown', 'France', 'US', None)} AS country__c,
               {pick('k % 9', None, 'United State', None)} AS country__c_account,
               {pick('k % 10', 'U.S.', None, 'Unknown')} AS inferredcountry,
               {pick('k % 4', '12', '12a', '1234567890')} AS client_key,
               CASE WHEN k % 27 = 1 THEN TRUE WHEN k % 27 < 20 THEN FALSE END AS unsubscribed
        FROM (SELECT c_custkey AS k FROM $customer) c"""
    mailing = pick("event_id % 6", *MAILINGS)
    person_id = "'M' || cast(user_id as string)"
    q["mail_dashboard"] = f"""
        SELECT {d.pacific('ts')} AS email_sent, {mailing} AS primary_attribute_value,
               {person_id} AS sent_id,
               CASE WHEN event_type IN ('view', 'click', 'purchase') THEN {person_id} END AS opened_id,
               CASE WHEN event_type = 'click' THEN {person_id} END AS clicked_id,
               {mail('user_id')} AS email, {pick('event_id % 9', '/unsub', '/read', '/read')} AS link,
               CASE WHEN user_id % 4 <> 0 THEN {key('L', 'user_id')} END AS sal_lead_id,
               CASE WHEN event_type IN ('view', 'click', 'purchase')
                    THEN {d.pacific('ts')} + interval '1' hour END AS opened_date_pstpdt,
               CASE WHEN event_id % 13 <> 0 THEN {d.pacific('ts')}
                    + interval '1' day * (event_id % 40) - interval '5' day END AS sal_lead_created
        FROM $events"""
    for table, condition in {
        "mail_delivered": "TRUE",
        "mail_opened": "event_type IN ('view', 'click', 'purchase')",
        "mail_clicked": "event_type = 'click'",
        "mail_bounced": "event_type = 'error' AND value < 30",
        "mail_bounced_soft": "event_type = 'error' AND value >= 30",
    }.items():
        q[table] = f"""
        SELECT {person_id} AS leadid, {mailing} AS primary_attribute_value, ts AS activitydate
        FROM $events WHERE {condition}"""
    q["mail_forms"] = f"""
        SELECT 'M' || cast(conv_id as string) AS leadid,
               cast(2000 + turn % 2 as bigint) AS primary_attribute_value_id,
               {d.ts('2001-01-01 00:00:00')} + interval '1' day * conv_id + interval '1' hour * turn
                   AS activitydate,
               CASE WHEN turn % 3 = 0 THEN 'q=' || cast(conv_id as string) END AS query_parameters,
               {pick('conv_id % 2', None, 'https://partner.example/')} AS referrer_url, role AS form_fields
        FROM $conversations"""

    # --- ad reports: one platform per return flag --------------------------------------
    month = d.trunc("month", "l_shipdate")
    q["fb_insights"] = """
        SELECT l_shipdate AS date_start, cast(l_partkey % 5 as string) AS campaign_id,
               cast(l_partkey % 20 as string) AS adset_id, cast(l_partkey as string) AS ad_id,
               'fb campaign ' || cast(l_partkey % 5 as string) AS campaign_name,
               'adset ' || cast(l_partkey % 20 as string) AS adset_name,
               'ad ' || cast(l_partkey as string) AS ad_name, l_extendedprice AS spend,
               cast(l_suppkey as bigint) AS reach, cast(l_quantity * 100 as bigint) AS impressions,
               cast(l_quantity as bigint) AS clicks, cast(l_linenumber as bigint) AS inline_link_clicks
        FROM $lineitem WHERE l_returnflag = 'A'"""
    q["fb_actions"] = f"""
        SELECT l_shipdate AS _sdc_source_key_date_start,
               cast(l_partkey as string) AS _sdc_source_key_ad_id,
               {pick('l_linenumber % 3', 'offsite_conversion.fb_pixel_lead', 'link_click', 'comment')}
                   AS action_type,
               l_quantity AS value
        FROM $lineitem WHERE l_returnflag = 'A'"""
    q["bing_ads"] = f"""
        SELECT {month} AS timeperiod, l_shipdate AS _sdc_report_datetime, l_partkey % 5 AS campaignid,
               l_partkey % 20 AS adgroupid, l_partkey % 200 AS adid,
               'campaign ' || cast(l_partkey % 5 as string) AS campaignname,
               'group ' || cast(l_partkey % 20 as string) AS adgroupname, l_extendedprice AS spend,
               cast(l_quantity * 100 as bigint) AS impressions, cast(l_quantity as bigint) AS clicks,
               l_quantity AS conversions
        FROM $lineitem WHERE l_returnflag = 'N'"""
    names = pick("l_partkey % 5", "camp a", "camp b", "camp c", "camp a", "camp b")
    q["google_ads"] = f"""
        SELECT {month} AS day, l_shipdate AS _sdc_report_datetime, l_partkey % 5 AS campaignid,
               l_partkey % 20 AS adgroupid, l_partkey % 200 AS adid, {names} AS campaign,
               'group ' || cast(l_partkey % 20 as string) AS adgroup,
               'ad ' || cast(l_partkey % 200 as string) AS ad,
               cast(round(l_extendedprice * 1000000) as bigint) AS cost,
               cast(l_quantity * 100 as bigint) AS impressions, cast(l_quantity as bigint) AS clicks,
               l_quantity AS conversions
        FROM $lineitem WHERE l_returnflag = 'R'"""
    q["google_campaigns"] = f"""
        SELECT {month} AS day, l_shipdate AS _sdc_report_datetime, l_partkey % 5 AS campaignid,
               {names} AS campaign, cast(l_quantity * 100 as bigint) AS impressions,
               CASE WHEN l_suppkey % 3 <> 0 THEN cast(1 + l_suppkey % 100 as double) END AS searchimprshare
        FROM $lineitem WHERE l_returnflag = 'R'"""
    return q


_REFERENCE = re.compile(r"\$(\w+)")


def references(sql: str) -> list[str]:
    """Names of the tables a definition reads, in order of appearance."""
    return list(dict.fromkeys(_REFERENCE.findall(sql)))


def render(sql: str) -> str:
    """Definition text with plain table names."""
    return _REFERENCE.sub(r"\1", sql)


def _frame(spark: SparkSession, catalog: Catalog, sql: str) -> DataFrame:
    frames = {name: catalog[name] for name in references(sql)}
    return spark.sql(_REFERENCE.sub(r"{\1}", sql), **frames)


def catalog(spark: SparkSession, root: str) -> Catalog:
    """All logical tables, derived lazily from the parquet files under ``root``."""
    result = Catalog({n: partial(spark.read.parquet, f"{root.rstrip('/')}/{n}.parquet") for n in BASE_TABLES})
    for name, sql in definitions(SPARK).items():
        result.add(name, partial(_frame, spark, result, sql))
    return result
