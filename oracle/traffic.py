"""Traffic reports."""

from __future__ import annotations

PACIFIC = "timezone('PST8PDT', timezone('UTC', {}))"


def pacific(expr: str) -> str:
    return PACIFIC.format(expr)


_TESTS = """
    medium = 'GROWTH & PAID' AS paid, medium = 'OTHER' AS misc, medium = 'ORGANIC' AS organic,
    submedium = 'OTHER' AS plain, utm_medium = 'cpc' AS cpc,
    source IN ('GOOGLE', 'BING', 'OTHER') AS engine, source IN ('GOOGLE', 'OTHER', 'YOUTUBE') AS video,
    regexp_matches(utm_campaign, '(?is)awareness') AS c_aware,
    regexp_matches(utm_campaign, '(?is).brand') AS c_brand,
    regexp_matches(utm_campaign, '(?is).nonbrand') AS c_nonbrand,
    regexp_matches(utm_campaign, '(?is)competitor|quickbooks') AS c_rival,
    regexp_matches(utm_campaign, '(?is).(competitor|quickbooks)') AS c_rival_tag,
    utm_campaign = 'Bing - Search Brand USA (Engine)' AS c_named_brand,
    utm_campaign = 'Bing - Search Non-Brand USA (Engine)' AS c_named_nonbrand,
    regexp_matches(landing_page, '(?is)/careers') AS l_careers,
    regexp_matches(landing_page, '(?is)blog|syllabus') AS l_words,
    (contains(landing_page, 'site.example/blog') OR contains(landing_page, 'site.example/syllabus')
     OR ({day} <= TIMESTAMP '2024-01-15' AND landing_page IN
         ('site.example/ecommerce/', 'site.example/fitness/', 'site.example/healthcare/', 'site.example/ecommerce/how-to-reduce-shipping-costs/', 'site.example/ecommerce/omnichannel-retailing-guide/', 'site.example/ecommerce/sales-tax-guide-online-sellers/', 'site.example/ecommerce/sales-tax-nexus-guide/', 'site.example/ecommerce/subscription-box-business/', 'site.example/ecommerce/tax-deductions-ecommerce/', 'site.example/ecommerce/sales-tax-basics/', 'site.example/fitness/how-to-find-more-clients-crossfit/', 'site.example/healthcare/tax-reductions-therapists/'))) AS l_content,
    (utm_medium IS NULL OR lower(utm_medium) <> 'social') AS not_social,
    source IN ('GOOGLE', 'BING', 'UNIDENTIFIABLE SEARCH ENGINE', 'SYLLABUS') AS known_engine
"""

_CHANNELS = {
    "facebook": "paid AND plain AND source = 'FACEBOOK' AND NOT c_aware",
    "branded_search": """(paid OR misc) AND ((submedium = 'BRANDED SEARCH' AND utm_medium NOT ILIKE '%display%')
        OR (plain AND engine AND cpc AND (c_brand OR c_named_brand) AND NOT c_nonbrand AND NOT c_named_nonbrand))""",
    "non_branded_search": """(paid OR misc) AND cpc AND NOT c_rival AND ((submedium = 'NON-BRANDED SEARCH'
        AND c_nonbrand) OR (plain AND engine AND (c_nonbrand OR c_named_nonbrand)))""",
    "display": """((paid OR misc) AND submedium = 'DISPLAY')
        OR (plain AND source <> 'YOUTUBE' AND utm_medium ILIKE '%display%')
        OR (paid AND plain AND source = 'FACEBOOK' AND c_aware)""",
    "youtube": "paid AND source = 'YOUTUBE' AND submedium <> 'COMPETITOR'",
    "reddit": "paid AND source = 'REDDIT'",
    "podcast": "paid AND submedium = 'PODCAST' AND (landing_page IS NULL OR NOT l_careers)",
    "competitor": "(paid OR misc) AND c_rival_tag",
    "other_gp": """(paid AND source = 'CAPTERRA') OR (paid AND plain AND source = 'QUORA')
        OR (paid AND plain AND engine AND lower(utm_medium) = 'cpc'
            AND (utm_campaign IS NULL OR NOT (c_nonbrand OR c_brand OR c_rival_tag)))
        OR (misc AND plain AND cpc AND ((source IN ('OTHER', 'BING') AND NOT contains(lower(utm_campaign), 'brand'))
            OR (source = 'LINKEDIN' AND utm_campaign = 'us_prospecting_linkedIn_rd')))
        OR (misc AND plain AND source = 'GOOGLE' AND contains(lower(utm_campaign), 'gmb'))""",
    "social": """l_words AND ((organic AND lower(utm_medium) = 'social')
        OR (misc AND video AND contains(lower(utm_medium), 'social')))""",
    "email": "medium = 'E-MAIL' OR (misc AND (lower(utm_medium) = 'email' OR utm_medium = 'marketing_email'))",
    "direct": """medium = 'DIRECT' OR (organic AND plain AND (source = 'CAPTERRA' OR l_careers))
        OR (misc AND plain AND source IN ('OTHER', 'SHOPIFY')
            AND (utm_medium IS NULL
                 OR utm_medium IN ('partner', 'referral', 'GuestPost', 'guestpost', 'Guide', 'article'))
            AND (utm_source IS NULL
                 OR NOT regexp_matches(utm_source, 'dribbble|producthunt|google|financesonline|hustle')))""",
    "unknown": "medium = 'UNKNOWN'",
    "direct_social": """NOT l_words AND contains(lower(utm_medium), 'social')
        AND (organic OR (misc AND video))""",
    "search_content": """l_content AND ((organic AND known_engine AND not_social)
        OR (misc AND plain AND source = 'GOOGLE' AND lower(utm_campaign) = 'notb'))""",
}

PAID = [
    "facebook", "branded_search", "non_branded_search", "display", "youtube", "reddit", "podcast",
    "competitor", "other_gp",
]
REST = ["direct", "unknown", "direct_social"]


def flagged(table: str, day: str, core_any_source: bool = False) -> str:
    """Select adding the 0/1 channel columns to a table of touches."""
    core = "organic AND not_social AND NOT l_content AND NOT l_careers"
    if not core_any_source:
        core += " AND known_engine"
    rules = {**_CHANNELS, "search_core": core}
    flags = ", ".join(f"coalesce({rule}, FALSE)::INT AS {name}" for name, rule in rules.items())
    return f"""
        SELECT *, coalesce(search AND source = 'GOOGLE', FALSE)::INT AS google,
               coalesce(search AND source = 'BING', FALSE)::INT AS bing,
               coalesce(search AND source NOT IN ('GOOGLE', 'BING'), FALSE)::INT AS other_search
        FROM (SELECT *, (search_core + search_content = 1) AS search
              FROM (SELECT *, {flags} FROM (SELECT *, {_TESTS.format(day=day)} FROM {table})))"""


def kept_touches(period: str, where: str) -> str:
    """Touches joined with every lead conversion, as long as one allows them."""
    return f"""
        SELECT t.*, {period} AS bucket, l.conversion_date AS lead_date
        FROM $touches t
        LEFT JOIN (SELECT * FROM $attributions WHERE conversion_type_id = 1) l ON l.unique_id = t.unique_id
        WHERE (l.conversion_date IS NULL OR t.time <= l.conversion_date)
          AND lower(t.landing_page) NOT LIKE '%/careers%' AND lower(t.landing_page) NOT LIKE '%nginx%'
          AND {where}"""


def first_touches(period: str, where: str) -> str:
    return f"""
        SELECT * FROM ({kept_touches(period, where)})
        QUALIFY row_number() OVER (PARTITION BY bucket, unique_id ORDER BY time, touch_id) = 1"""


MONTH = "date_trunc('month', t.time)::TIMESTAMP"
SATURDAY = "(date_trunc('week', t.time + INTERVAL 2 DAY)::TIMESTAMP - INTERVAL 2 DAY)"


def uniques(period: str) -> str:
    detail = [
        *PAID, "search_core", "search_content", "google", "bing", "other_search", "social", "email", *REST,
    ]
    sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in detail)
    paid, rest = " + ".join(PAID), " + ".join(REST)
    return f"""
        WITH firsts AS ({first_touches(period, f"{period} >= TIMESTAMP '2023-12-30'")}),
        flags AS ({flagged('firsts', 'bucket')}),
        sums AS (SELECT bucket, {sums}, sum(search::INT)::BIGINT AS search FROM flags GROUP BY bucket)
        SELECT bucket AS "Week_Starting", {paid} AS "G&P Total", {', '.join(PAID)},
               search + social + email AS "O&C Total", search, search_core, search_content, google, bing,
               other_search, social, email, {', '.join(REST)},
               {paid} + search + social + email + {rest} AS "Total"
        FROM sums"""


_SEARCH_CORE = f"""
    WITH firsts AS ({first_touches(
        MONTH, f"{MONTH} >= TIMESTAMP '2023-12-30' AND t.time >= TIMESTAMP '2024-01-05'")}),
    flags AS ({flagged('firsts', 'bucket')})
    SELECT date_trunc('day', time)::TIMESTAMP AS day, sum(search_core)::BIGINT AS sum
    FROM flags WHERE search_core = 1 GROUP BY 1"""

_LAST = [*PAID, "search_content", "social", "email", *REST]


def core_traffic(period: str) -> str:
    day = "date_trunc('day', t.time)::TIMESTAMP"
    bounds = f"t.time >= TIMESTAMP '2024-01-01' AND {day} <= TIMESTAMP '2024-01-25'"
    return f"""
    WITH kept AS (SELECT DISTINCT * EXCLUDE (lead_date) FROM ({kept_touches(period, bounds)})),
    dated AS (SELECT *, date_trunc('day', time)::TIMESTAMP AS day FROM kept),
    flags AS ({flagged('dated', 'day', core_any_source=True)}),
    visits AS (
        SELECT DISTINCT day, bucket, time, unique_id, total_touch_count, medium, submedium, utm_medium, source,
               utm_campaign, landing_page
        FROM (SELECT *, min(time) OVER (PARTITION BY unique_id, day) AS earliest FROM flags WHERE search_core = 1)
        WHERE time = earliest),
    earlier AS (
        SELECT DISTINCT f.day, f.bucket, v.unique_id, v.total_touch_count AS n, f.landing_page,
               {', '.join('f.' + c for c in [*_LAST, 'search', 'search_core', 'google', 'bing', 'other_search'])}
        FROM visits v JOIN flags f
          ON f.unique_id = v.unique_id AND f.day = v.day AND f.total_touch_count = v.total_touch_count - 1),
    last_sums AS (SELECT bucket, {', '.join(f'sum({c})::BIGINT AS {c}' for c in _LAST)} FROM earlier GROUP BY bucket),
    visit_sums AS (SELECT bucket, count(*) AS core FROM visits GROUP BY bucket)
    SELECT v.bucket AS theweek, v.core, {', '.join('l.' + c for c in _LAST)}
    FROM visit_sums v LEFT JOIN last_sums l ON l.bucket = v.bucket"""


_PARTNER = f"""
    WITH mine AS (
        SELECT *, {pacific('time')} AS local FROM $touches
        WHERE utm_medium ILIKE '%acme%' AND utm_source ILIKE '%partner%'
          AND utm_campaign ILIKE '%marketplace%' AND utm_content ILIKE '%lead-referral-page%'),
    days AS (
        SELECT unique_id, lead_id,
               min(date_trunc('day', local)::TIMESTAMP)
                   OVER (PARTITION BY date_trunc('month', time), unique_id) AS first_day
        FROM mine)
    SELECT date_trunc('month', first_day)::TIMESTAMP AS themonth,
           CASE WHEN day(first_day) <= 15 THEN '1' WHEN day(first_day) > 15 THEN '2' END AS semi_month,
           count(DISTINCT unique_id) AS uniques, count(DISTINCT lead_id) AS leads,
           count(DISTINCT lead_id) FILTER (o.review_call_booked_boolean__c) AS trials,
           count(DISTINCT lead_id) FILTER (o.stagename = 'Client') AS clients
    FROM days
    LEFT JOIN $lead_data d ON d.id = days.lead_id
    LEFT JOIN $opportunity o ON o.id = d.opp_id
    GROUP BY 1, 2"""

_PAGES = f"""
    pages AS (SELECT *, {pacific('time')} AS local, date_trunc('month', {pacific('time')})::TIMESTAMP AS month
              FROM $pageviews),
    views AS (
        SELECT *, (path ILIKE '%refer-a-friend%' AND path <> '/refer-a-friend/') AS refer,
               path ILIKE '%friends-of-site%' AS landing, utm_medium IN ('display', 'cpc') AS paid
        FROM pages WHERE local >= TIMESTAMP '1996-01-01'),
    visits AS (
        SELECT month, user_id, session_id,
               bool_or(landing_page ILIKE '%join.site%' AND landing_page NOT ILIKE '%expense-quiz%') AS tool,
               bool_or(path ILIKE '%blog%' AND path NOT ILIKE '%/blog/resources%') AS blog,
               bool_or(path ILIKE '%signup%') AS signup, bool_or(path ILIKE '%resources%') AS resource
        FROM pages WHERE month >= TIMESTAMP '1996-01-01' GROUP BY 1, 2, 3),
    clicks AS (
        SELECT date_trunc('month', {pacific('time')})::TIMESTAMP AS month, user_id
        FROM $share_clicks WHERE {pacific('time')} >= TIMESTAMP '1996-01-01')"""

_GROWTH_LONG = f"""
    WITH {_PAGES}
    SELECT month AS themonth, count(DISTINCT user_id) AS count,
           CASE WHEN refer THEN 'raf_inapp_pv' WHEN landing THEN 'raf_lp_pv' ELSE 'paid_pv' END AS web_activity
    FROM views WHERE refer OR landing OR paid GROUP BY 1, 3
    UNION
    SELECT month, count(DISTINCT user_id),
           CASE WHEN blog AND (tool OR signup) THEN 'blog_sup' ELSE 'blog_resource' END AS activity
    FROM visits WHERE blog AND (tool OR signup OR resource) GROUP BY 1, 3
    UNION
    SELECT month, count(DISTINCT user_id), 'raf_clicks' FROM clicks GROUP BY 1"""

_GROWTH_WIDE = f"""
    WITH {_PAGES},
    single AS (
        SELECT month, count(DISTINCT user_id) FILTER (refer) AS raf_inapp,
               count(DISTINCT user_id) FILTER (landing) AS raf_lp, count(DISTINCT user_id) FILTER (paid) AS paid_pv
        FROM views WHERE refer OR landing OR paid GROUP BY month),
    multi AS (
        SELECT month, count(DISTINCT user_id) FILTER (blog AND (tool OR signup)) AS blog_sup,
               count(DISTINCT user_id) FILTER (blog AND resource) AS blog_resource
        FROM visits GROUP BY month),
    clicked AS (SELECT month, count(DISTINCT user_id) AS raf_clicks FROM clicks GROUP BY month)
    SELECT coalesce(m.month, s.month) AS themonth, raf_inapp, raf_lp, raf_clicks, paid_pv, blog_sup, blog_resource
    FROM multi m FULL JOIN single s ON m.month = s.month LEFT JOIN clicked c ON c.month = m.month"""

QUERIES: dict[str, str] = {
    "channel_uniques": uniques(MONTH),
    "channel_uniques_weekly": uniques(SATURDAY),
    "search_core_daily": _SEARCH_CORE,
    "core_traffic_last_touch": core_traffic(MONTH),
    "core_traffic_last_touch_weekly": core_traffic(SATURDAY),
    "partner_semimonth_funnel": _PARTNER,
    "growth_web_long": _GROWTH_LONG,
    "growth_web_wide": _GROWTH_WIDE,
}
