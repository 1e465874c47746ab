"""Referrals."""

from __future__ import annotations

from oracle.traffic import pacific

_CONVERSIONS = f"""
    WITH views AS (
        SELECT p.user_id, p.session_id, i.inferred_email AS email, {pacific('p.time')} AS seen
        FROM $pageviews p JOIN $identity_map i ON i.heap_user_id = p.user_id
        WHERE lower(p.landing_page) LIKE '%site.example/friends-of-site/%'
          AND {pacific('p.time')} >= TIMESTAMP '1996-01-01'
          AND NOT regexp_matches(lower(i.inferred_email), 'test|corp\\.example')),
    firsts AS (
        SELECT * FROM (SELECT *, min(seen) OVER (PARTITION BY email) AS first_seen FROM views)
        WHERE seen = first_seen),
    led AS (
        SELECT f.*, l.id, CASE WHEN l.lead_created_datetime_pstpdt >= f.seen THEN l.lead_created_datetime_pstpdt END
               AS lead
        FROM firsts f LEFT JOIN $lead_data l ON l.email = f.email),
    followed AS (
        SELECT led.*, o.trial_call_booked__c AS trial,
               CASE WHEN o.stagename = 'Client' AND o.isclosed AND o.iswon THEN o.closedate END AS client,
               a.channel_1, a.channel_2, a.credit_1, a.credit_2
        FROM led
        LEFT JOIN $crm_lead c ON c.id = led.id AND led.lead IS NOT NULL
        LEFT JOIN $opportunity o ON o.id = c.convertedopportunityid
        LEFT JOIN $attributions_by_channel a
          ON a.lead_id = led.id AND led.lead IS NOT NULL AND a.conversion_type = 'lead')
    SELECT DISTINCT user_id, id, session_id, seen AS view_day, date_trunc('month', seen)::TIMESTAMP AS view_month,
           lead, date_trunc('month', lead)::TIMESTAMP AS lead_month, trial,
           date_trunc('month', trial)::TIMESTAMP AS trial_month, client,
           date_trunc('month', client)::TIMESTAMP AS client_month,
           date_diff('day', seen, lead)::INT AS lag_days, channel_1, coalesce(channel_2, 'null') AS channel_2,
           credit_1, credit_2
    FROM followed
    WHERE coalesce(seen <= trial, TRUE) AND coalesce(seen <= client, TRUE)"""

_SOURCES = f"""
    WITH candidates AS (
        SELECT DISTINCT a.id, l.email, l.lead_created_datetime_pstpdt, a.raw_date, s.user_id,
               {pacific('s.time')} AS session_time, s.referrer, s.landing_page, s.utm_medium, s.utm_content
        FROM $attributions_crm a
        LEFT JOIN $lead_data l ON l.id = a.id
        LEFT JOIN $web_users u ON u._email = l.email
        LEFT JOIN $sessions s
          ON s.user_id = u.user_id AND {pacific('s.time')} <= l.lead_created_datetime_pstpdt
        WHERE a.referrals = 1 AND a.lead_ind = 1 AND date_trunc('month', a.raw_date) >= TIMESTAMP '1996-01-01'),
    lasts AS (SELECT *, max(session_time) OVER (PARTITION BY id) AS last_session FROM candidates)
    SELECT id, raw_date, date_trunc('month', raw_date)::TIMESTAMP AS themonth, session_time, last_session,
           CASE WHEN referrer IS NULL THEN 'null'
                ELSE CASE WHEN contains(lower(referrer), 'facebook') THEN 'facebook'
                     WHEN contains(lower(referrer), 'corp.example') THEN 'corp.example'
                     WHEN contains(lower(referrer), 'bing') THEN 'bing'
                     WHEN contains(lower(referrer), 'youtube') THEN 'youtube'
                     WHEN contains(lower(referrer), 'ebay') THEN 'ebay'
                     WHEN contains(lower(referrer), 'google') THEN 'google'
                     WHEN contains(lower(referrer), 'reddit') THEN 'reddit'
                     WHEN contains(lower(referrer), 'slack') THEN 'slack'
                     ELSE regexp_replace(split_part(referrer, '?', 1), '/$', '') END END AS referrer,
           landing_page, utm_medium, utm_content
    FROM lasts WHERE session_time = last_session OR last_session IS NULL"""

_ACCOUNTS = f"""
    WITH referrals AS (
        SELECT c.referring_contact_account_id__c AS short, max(l.lead_created_datetime_pstpdt) AS last_referral
        FROM $lead_data l JOIN $crm_lead c ON c.id = l.id
        WHERE c.recordtypeid = 'RT_LEAD' AND c.ambassador__referred_by_contact__c IS NOT NULL
          AND c.leadsource = 'Referred By Other Unrelated Business'
        GROUP BY 1)
    SELECT DISTINCT a.id AS account_id, a.client_key, {pacific('o.closedate')} AS clientdate,
           date_diff('day', {pacific('o.closedate')}, TIMESTAMP '2002-01-01')::INT AS days_old, r.last_referral
    FROM $account a JOIN referrals r ON r.short = substr(a.id, 1, 15)
    LEFT JOIN $lead_data l ON l.client_key = a.client_key
    LEFT JOIN $opportunity o ON o.id = l.opp_id AND o.stagename = 'Client'"""

QUERIES: dict[str, str] = {
    "referral_page_conversions": _CONVERSIONS,
    "referral_lead_sources": _SOURCES,
    "referring_accounts": _ACCOUNTS,
}
