"""Experiment reports."""

from __future__ import annotations

from oracle.traffic import pacific

_CORE = """('/', '/how-it-works/', '/catch-up-bookkeeping-services/', '/pricing/',
    '/small-business-bookkeeping-services/', '/small-business-tax/', '/small-business-financial-reports/',
    '/small-business-bookkeeping-software/', '/faq/', '/customer-reviews/', '/about/')"""

_SESSION_LAST_PAGE = f"""
    WITH pages AS (
        SELECT *, {pacific('time')} AS seen,
               (contains(lower(path), 'signup') OR starts_with(lower(title), 'funnel 2.0')) AS to_signup
        FROM $pageviews),
    bucketed AS (
        SELECT *, CASE WHEN path = '/go/bookkeepers/' AND utm_medium = 'cpc' THEN 'paid'
                       WHEN contains(lower(path), 'blog') THEN 'blog'
                       WHEN path IN {_CORE} THEN 'core' WHEN to_signup THEN 'signup' END AS bucket
        FROM pages WHERE seen >= TIMESTAMP '1996-09-01'),
    last_signup AS (
        SELECT user_id, session_id, max(seen) AS at
        FROM bucketed WHERE to_signup AND bucket IS NOT NULL GROUP BY ALL),
    chosen AS (
        SELECT b.user_id, b.session_id, b.seen, b.bucket
        FROM bucketed b JOIN last_signup s
          ON s.user_id IS NOT DISTINCT FROM b.user_id AND s.session_id IS NOT DISTINCT FROM b.session_id
        WHERE b.seen <= s.at AND b.bucket <> 'signup'
        QUALIFY row_number() OVER (PARTITION BY b.user_id, b.session_id ORDER BY b.seen DESC, b.path) = 1)
    SELECT c.user_id, c.session_id, c.seen AS pageview_time, i.inferred_email,
           (i.inferred_email IS NOT NULL AND l.lead_created_datetime_pstpdt IS NULL)::INT AS drop_out,
           CASE WHEN l.lead_created_datetime_pstpdt >= c.seen THEN l.lead_created_datetime_pstpdt END
               AS lead_datetime_pstpdt,
           CASE WHEN o.review_call_booked >= date_trunc('day', c.seen) THEN o.review_call_booked END AS trial_date,
           CASE WHEN o.stagename = 'Client' AND o.closedate >= date_trunc('day', c.seen) THEN o.closedate END
               AS client_date,
           c.bucket, u.experiment_a AS core_experiment, u.experiment_b AS blog_experiment,
           u.experiment_c AS paid_control_experiment, u.experiment_d AS paid_variation_experiment,
           r.team_suf2__c
    FROM chosen c
    LEFT JOIN $web_users u ON u.user_id = c.user_id
    LEFT JOIN $identity_map i ON i.heap_user_id = c.user_id
    LEFT JOIN $lead_data l ON l.client_key = i.inferred_person_id
    LEFT JOIN $opportunity o ON o.client_key = i.inferred_person_id
    LEFT JOIN $crm_lead r ON r.client_key = i.inferred_person_id"""


def _outside(column: str, *texts: str) -> str:
    """NULL addresses stay."""
    return f"NOT regexp_matches(coalesce(lower({column}), ''), '{'|'.join(texts)}')"


_SINGLE_VARIANT = f"""
    WITH pages AS (
        SELECT user_id, session_id, path, date_trunc('day', {pacific('time')})::TIMESTAMP AS day
        FROM $pageviews WHERE {pacific('time')} >= TIMESTAMP '1996-05-20'),
    both_pages AS (
        SELECT day, user_id FROM pages GROUP BY day, user_id, session_id
        HAVING bool_or(contains(path, 'blog')) AND bool_or(contains(path, 'signup'))),
    tool AS (
        SELECT date_trunc('day', {pacific('time')})::TIMESTAMP AS day, user_id FROM $signup_tool_views
        WHERE page_name = '1 - Sign Up Page' AND view_name = '1 - Sign Up Page'
          AND contains(landing_page, 'blog') AND {pacific('time')} >= TIMESTAMP '1996-05-20'),
    shown AS (
        SELECT b.day, b.user_id, 0 AS variation
        FROM both_pages b JOIN $web_users u ON u.user_id = b.user_id AND u.experiment_b = 0
        UNION SELECT day, user_id, 1 FROM tool),
    people AS (
        SELECT DISTINCT s.*, i.inferred_email, i.inferred_person_id
        FROM shown s LEFT JOIN $identity_map i ON i.heap_user_id = s.user_id
        WHERE {_outside('i.inferred_email', 'test', 'corp.example', 'ignore')}),
    firsts AS (
        SELECT p.* FROM people p
        JOIN (SELECT user_id, min(day) AS day, count(DISTINCT variation) AS n FROM people GROUP BY 1) f
          ON f.user_id IS NOT DISTINCT FROM p.user_id AND f.day = p.day AND f.n = 1)
    SELECT f.day AS pageview_date, f.user_id, c.id AS client_id, f.inferred_person_id, f.variation,
           l.lead_created_datetime_pstpdt, o.trial_call_booked__c,
           {pacific('o.closedate')} AS closedate_pstpdt, o.stagename, o.iswon,
           (f.inferred_email IS NOT NULL AND l.email IS NULL)::INT AS dropoff
    FROM firsts f
    LEFT JOIN $client c ON c.principalpersonid = f.inferred_person_id
    LEFT JOIN $lead_data l ON (f.inferred_email ILIKE l.email OR l.client_key = c.id)
         AND l.lead_created_datetime_pstpdt >= f.day
    LEFT JOIN $opportunity o ON o.id = l.opp_id AND o.trial_call_booked__c >= f.day
         AND {pacific('o.closedate')} >= f.day"""

_EXPOSURE = f"""
    WITH views AS (
        SELECT DISTINCT v.user_id, {pacific('v.time')} AS seen, v.experimentvariant, i.inferred_email,
               CASE v.experimentvariant WHEN 'control' THEN 0 WHEN 'test' THEN 1 END AS variant
        FROM $experiment_views v LEFT JOIN $identity_map i ON i.heap_user_id = v.user_id
        WHERE lower(v.campaignid) = 'campaign-x' AND {pacific('v.time')} >= TIMESTAMP '1996-05-13'
          AND {_outside('i.inferred_email', 'test', 'corp.example')}),
    ranged AS (
        SELECT *, min(variant) OVER w AS low, max(variant) OVER w AS high, min(seen) OVER w AS first_seen
        FROM views WINDOW w AS (PARTITION BY user_id))
    SELECT DISTINCT v.seen AS pageview_date, v.experimentvariant, v.user_id, v.inferred_email,
           l.lead_created_datetime_pstpdt, o.trial_call_booked__c, {pacific('o.closedate')} AS closedate,
           o.stagename, o.iswon, v.variant AS clean_variant, v.low AS min_variant, v.high AS max_variant,
           v.first_seen AS min_pageview
    FROM ranged v
    LEFT JOIN $lead_attributions l
      ON v.inferred_email ILIKE l.email AND l.lead_created_datetime_pstpdt >= v.seen
    LEFT JOIN $opportunity o ON o.id = l.opportunity_id AND o.trial_call_booked__c >= v.seen
    WHERE v.seen = v.first_seen AND v.low = v.high"""


def lead_rules(prefix: str = "") -> dict[str, str]:
    p = prefix
    return {
        "source_ok": f"""({p}leadsource IS NOT NULL AND {p}leadsource NOT IN ('Outbound', 'Test Lead',
            'Outbound Referral', 'Radius', 'Equity Structure Change', 'Unassigned: Merged',
            'Inbound Partnership Interest', 'Partnership Prospecting', 'Content', 'Re-engaged Contact',
            'List Upload', 'NULL'))""",
        "content_ok": f"""({p}leadsource IN ('Content', 'List Upload') AND ({p}providedemail__c IS NOT NULL
            OR {p}providedcompanydetails__c IS NOT NULL OR {p}createdaccount__c IS NOT NULL
            OR coalesce({p}isconverted, FALSE)))""",
        "record_type_ok": f"{p}recordtypeid = 'RT_LEAD'",
        "loss_ok": f"coalesce({p}loss_reason__c, '') NOT IN ('Fake lead / account', 'Missed Call - No Contact')",
        "owner_ok": f"coalesce({p}owner_role__c, '') <> 'Sales Operations'",
        "not_deleted": f"NOT {p}isdeleted",
    }


def qualified(prefix: str = "") -> str:
    r = lead_rules(prefix)
    rest = " AND ".join(r[k] for k in ("record_type_ok", "loss_ok", "owner_ok", "not_deleted"))
    return f"({r['source_ok']} OR coalesce({r['content_ok']}, FALSE)) AND {rest}"


def _leads(start: str) -> str:
    return f"""
    leads AS (
        SELECT l.id, l.client_key, l.email AS own_email, r.email AS crm_email, l.opp_id, l.won_mrr,
               l.actual_date_created__c AS created, l.catch_up_only_team__c AS catch_up,
               coalesce(o.review_call_booked_boolean__c, FALSE)::INT AS trial
        FROM $lead_data l LEFT JOIN $crm_lead r ON r.id = l.id LEFT JOIN $opportunity o ON o.id = l.opp_id
        WHERE l.actual_date_created__c >= TIMESTAMP '{start}'),
    dropouts AS (
        SELECT r.id, r.client_key, r.email, r.actual_date_created__c AS created FROM $crm_lead r
        WHERE r.id NOT IN (SELECT id FROM leads) AND {qualified('r.')})"""


_PER_USER = """
    per_user AS (
        SELECT user_id, count(DISTINCT device_type) AS devices, min(device_type) AS device,
               min({'at': lead_created, 'id': lead_id}) FILTER (lead_id IS NOT NULL) AS first_lead,
               min({'at': dropout_created, 'id': dropout_id}) FILTER (dropout_id IS NOT NULL) AS first_dropout,
               max(won_mrr) AS mrr, max(coalesce(trial, 0)) AS trial
        FROM joined GROUP BY user_id)"""

_REPORT = """
    SELECT variation_id, device, count(DISTINCT first_dropout.id) AS dropouts, count(DISTINCT user_id) AS viewers,
           count(DISTINCT first_lead.id) AS leads, sum(trial)::BIGINT AS trials,
           count(mrr)::BIGINT AS clients"""


def _clean(column: str) -> str:
    return f"({column} NOT LIKE '%corp.example%' AND {column} NOT LIKE '%test%')"


_FUNNEL_ILIKE = f"""
    WITH {_leads('1996-02-26')},
    people AS (
        SELECT u.user_id, u._email AS email, u.experiment_a AS variation_id, p.email AS person_email,
               c.id AS client_id
        FROM $web_users u LEFT JOIN $person p ON p.id = u.id LEFT JOIN $client c ON c.principalpersonid = p.id
        WHERE u.experiment_a IS NOT NULL
          AND (p.email IS NULL OR u._email IS NULL OR ({_clean('p.email')} AND {_clean('u._email')}))),
    views AS (
        SELECT user_id, device_type, date_trunc('day', {pacific('time')})::TIMESTAMP AS view_day
        FROM $pageviews WHERE path = '/' AND {pacific('time')} >= TIMESTAMP '1996-02-26'),
    joined AS (
        SELECT v.user_id, v.device_type, p.person_email, p.variation_id, l.id AS lead_id,
               l.created AS lead_created, l.won_mrr, l.trial, d.id AS dropout_id, d.created AS dropout_created,
               coalesce(m.path ILIKE '%request-a-demo%' AND p.variation_id = 2, FALSE)::INT AS demo
        FROM views v JOIN people p ON p.user_id = v.user_id
        LEFT JOIN leads l ON l.created >= v.view_day AND (l.client_key = p.client_id
             OR p.person_email ILIKE l.crm_email OR p.email ILIKE l.crm_email)
        LEFT JOIN $demo_form_events m
          ON m.user_id = v.user_id AND date_trunc('day', {pacific('m.time')}) >= v.view_day
        LEFT JOIN dropouts d ON d.created >= v.view_day AND (d.client_key = p.client_id
             OR p.person_email ILIKE d.email OR p.email ILIKE d.email)),
    {_PER_USER}
    {_REPORT}, sum(demo)::BIGINT AS demos
    FROM (SELECT DISTINCT user_id, person_email, variation_id, demo FROM joined)
    JOIN per_user USING (user_id) WHERE devices = 1 GROUP BY variation_id, device"""

_FUNNEL_EXCLUSIONS = f"""
    WITH {_leads('1996-11-15')},
    sample AS (SELECT user_id, _email AS email, experiment_b AS variation_id FROM $web_users
               WHERE experiment_b IS NOT NULL),
    bad AS (SELECT email FROM sample WHERE email IS NOT NULL GROUP BY email
            HAVING count(DISTINCT variation_id) > 1),
    people AS (
        SELECT s.*, lower(i.inferred_email) AS person_email, c.id AS client_id
        FROM sample s LEFT JOIN $identity_map i ON i.heap_user_id = s.user_id
        LEFT JOIN $client c ON c.principalpersonid = i.inferred_person_id),
    kept AS (
        SELECT * FROM people
        WHERE person_email IS NULL OR email IS NULL
           OR ({_clean('person_email')} AND {_clean('email')}
               AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.email IN (people.email, people.person_email)))),
    views AS (
        SELECT user_id, device_type, date_trunc('day', {pacific('time')})::TIMESTAMP AS view_day
        FROM $pageviews
        WHERE path = '/' AND time >= timezone('UTC', timezone('PST8PDT', TIMESTAMP '1996-11-15'))),
    retro AS (
        SELECT DISTINCT l.client_key, l.own_email AS email
        FROM leads l JOIN $opportunity o ON o.id = l.opp_id
        WHERE o.stagename = 'Onboarded with Retro' AND o.recordtypeid = 'RT_RETRO' AND l.catch_up),
    joined AS (
        SELECT v.user_id, v.device_type, v.view_day, p.person_email, p.variation_id, l.id AS lead_id,
               l.created AS lead_created, l.won_mrr, l.trial, d.id AS dropout_id, d.created AS dropout_created,
               EXISTS (SELECT 1 FROM retro r WHERE r.client_key = p.client_id OR r.email = p.person_email
                       OR r.email = p.email) AS comeback
        FROM views v JOIN kept p ON p.user_id = v.user_id
        LEFT JOIN leads l ON l.created >= v.view_day AND (l.client_key = p.client_id
             OR l.crm_email = p.person_email OR l.crm_email = p.email OR l.own_email = p.person_email)
        LEFT JOIN dropouts d ON d.created >= v.view_day AND d.created >= TIMESTAMP '1996-11-15'
             AND (d.client_key = p.client_id OR lower(d.email) = p.person_email OR lower(d.email) = p.email)),
    {_PER_USER}
    {_REPORT}
    FROM (SELECT DISTINCT user_id, person_email, variation_id, lead_created, view_day, comeback FROM joined)
    JOIN per_user USING (user_id) WHERE devices = 1 GROUP BY variation_id, device"""

QUERIES: dict[str, str] = {
    "ab_session_last_page": _SESSION_LAST_PAGE,
    "ab_single_variant": _SINGLE_VARIANT,
    "ab_funnel_ilike": _FUNNEL_ILIKE,
    "ab_funnel_exclusions": _FUNNEL_EXCLUSIONS,
    "ab_exposure_attribution": _EXPOSURE,
}
