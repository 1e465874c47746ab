"""Credit reports."""

from __future__ import annotations

from oracle.traffic import PAID, pacific

_KEYWORDS = """
    SELECT date_trunc('month', conversion_date)::TIMESTAMP AS month,
           coalesce(sum(conversion_credit) FILTER (conversion_type = 'LEAD'), 0) AS leads,
           coalesce(sum(conversion_credit) FILTER (conversion_type = 'TRIAL'), 0) AS trials,
           coalesce(sum(conversion_credit) FILTER (conversion_type = 'CLIENT'), 0) AS clients, utm_term
    FROM $attributions
    WHERE utm_term IS NOT NULL AND conversion_type <> 'REVIEW CALL'
      AND date_trunc('month', conversion_date) >= TIMESTAMP '2024-01-01'
    GROUP BY 1, utm_term
    HAVING sum(conversion_credit) FILTER (conversion_type = 'CLIENT') >= 1"""

_CHANNEL_DEVICE = """
    SELECT a.conversion_type, c.channel, a.device_type, sum(a.conversion_credit) AS sum
    FROM $attributions a
    JOIN $attributions_channel c
      ON c.lead_id = a.lead_id AND a.conversion_type ILIKE c.conversion_type
     AND c.conversion_date = a.conversion_date AND c.conversion_credit = a.conversion_credit
    WHERE date_trunc('month', a.conversion_date) = TIMESTAMP '2024-01-01'
      AND c.channel IN ('search_content', 'search_core')
    GROUP BY ALL"""

_ACTUALS = f"""
    SELECT DISTINCT conversion_date, date_trunc('month', conversion_date)::TIMESTAMP AS themonth, client_key,
           lead_id, opp_id, channel, conversion_credit, conversion_type,
           CASE WHEN list_contains({PAID!r}, channel) THEN 'Paid'
                WHEN channel IN ('email', 'search_content', 'search_core', 'social') THEN 'Inbound'
                ELSE channel END AS channel1
    FROM $attributions_channel WHERE conversion_date >= TIMESTAMP '2024-01-05'"""

_BUCKETS = """
    SELECT date_trunc('day', conversion_date)::TIMESTAMP AS conversion_date,
           coalesce(sum(channel_credit) FILTER (conversion_type = 'lead'), 0) AS lead_reallocation_bucket,
           coalesce(sum(channel_credit) FILTER (conversion_type = 'trial'), 0) AS trial_reallocation_bucket,
           coalesce(sum(channel_credit) FILTER (conversion_type = 'client'), 0) AS client_reallocation_bucket
    FROM $reallocation GROUP BY 1"""

_QUIZ = f"""
    WITH members AS (
        SELECT m.leadid, m.email, {pacific('m.createddate')} AS joined, l.id, l.cta,
               l.lead_created_datetime_pstpdt AS created
        FROM $campaign_member m LEFT JOIN $lead_data l ON l.id = m.leadid OR l.email = m.email
        WHERE m.campaignid = 'CAMPAIGN_1' AND m.email IS NOT NULL
          AND NOT regexp_matches(lower(m.email), 'test|corp\\.example')
          AND m.email NOT IN ('shared0@mail.example', 'user8@mail.example')),
    camp AS (
        SELECT coalesce(leadid, id) AS lead, CASE WHEN created >= joined THEN created END AS created, joined, cta
        FROM members),
    forms AS (
        SELECT l.sfdcleadid, f.activitydate FROM $mail_forms f JOIN $mail_leads l ON l.id = f.leadid
        WHERE f.primary_attribute_value_id = 2001 AND f.activitydate >= TIMESTAMP '2001-01-05')
    SELECT DISTINCT c.lead AS clean_leadid, c.created AS lead_created_datetime_pstpdt,
           c.joined AS campaign_createddate, c.cta, a.conversion_date, a.conversion_type, a.channel_1, a.credit_1,
           a.channel_2, a.credit_2, f.activitydate AS consult_form
    FROM camp c
    LEFT JOIN $attributions_by_channel a
      ON a.lead_id = c.lead AND a.conversion_date >= date_trunc('day', c.joined)
     AND (c.created IS NOT NULL OR a.channel_1 = 'scored')
    LEFT JOIN forms f ON f.sfdcleadid = c.lead"""

_CONTACT = """
    SELECT DISTINCT e.user_id, u._email, l.id, a.channel_1, a.credit_1, a.channel_2, a.credit_2
    FROM $contact_events e
    LEFT JOIN $web_users u ON u.user_id = e.user_id
    LEFT JOIN $lead_data l ON u._email ILIKE l.email
    LEFT JOIN $attributions_by_channel a ON a.lead_id = l.id
    WHERE lower(e.landing_page) LIKE '%site.example/go/professional-bookkeepers/%'
      AND e.time >= TIMESTAMP '1996-04-01' AND (e.utm_campaign IS NULL OR lower(e.utm_campaign) LIKE '%rd%')"""

QUERIES: dict[str, str] = {
    "keyword_conversions": _KEYWORDS,
    "conversions_by_channel_device": _CHANNEL_DEVICE,
    "bottom_funnel_actuals": _ACTUALS,
    "reallocation_buckets": _BUCKETS,
    "quiz_campaign_attribution": _QUIZ,
    "contact_details_credit": _CONTACT,
}
