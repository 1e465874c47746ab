"""Mailings, forms and contactability."""

from __future__ import annotations

from oracle.traffic import pacific

_CAMPAIGN = """
    SELECT primary_attribute_value, count(DISTINCT leadid) AS delivered_emails,
           (SELECT count(DISTINCT leadid) FROM $mail_opened o
            WHERE o.primary_attribute_value = d.primary_attribute_value) AS opened_emails,
           (SELECT count(DISTINCT leadid) FROM $mail_clicked c
            WHERE c.primary_attribute_value = d.primary_attribute_value) AS recipients_who_clicked
    FROM $mail_delivered d WHERE primary_attribute_value ILIKE '%August Cohort%'
    GROUP BY primary_attribute_value"""

_CONVERSIONS = """
    SELECT t.lead_client_id, t.lead_id, t.opportunity_id, m.email AS mkto_email, c.email AS sf_email, t.email,
           m.client_key
    FROM $attributions_translated t
    LEFT JOIN $crm_lead c ON c.id = t.lead_id
    LEFT JOIN $mail_leads m ON m.sfdcleadid = t.lead_id
    WHERE t.email > 0 AND t.conversion_type_id = 2
      AND date_trunc('month', t.conversion_date) = TIMESTAMP '2024-01-01'"""

_LEADS = """
    SELECT t.lead_id, l.email, t.utm_medium, t.utm_source, t.utm_campaign, t.landing_page, t.referrer,
           t.conversion_type_id
    FROM $attributions_translated t LEFT JOIN $lead_data l ON l.id = t.lead_id
    WHERE t.thedate = TIMESTAMP '2024-01-06' AND t.email > 0"""

_WITHIN = """
    SELECT email FROM $mail_dashboard
    WHERE contains(lower(primary_attribute_value), 'nurture_v2') AND opened_id IS NOT NULL
      AND sal_lead_id IS NOT NULL AND sal_lead_created IS NOT NULL
      AND date_diff('day', opened_date_pstpdt, sal_lead_created) <= 14
    GROUP BY email"""

_SENT = """
    WITH sent AS (
        SELECT *, coalesce(contains(lower(primary_attribute_value), 'syllabus')
                           OR contains(lower(primary_attribute_value), '_opr_'), FALSE) AS triggered,
               CASE WHEN contains(lower(link), 'unsub') AND NOT contains(lower(primary_attribute_value), '_opr_')
                    THEN sent_id END AS unsub
        FROM $mail_dashboard WHERE date_trunc('month', email_sent) = TIMESTAMP '2024-01-01')"""

_CONTACTED = f"{_SENT} SELECT count(DISTINCT sent_id) AS count FROM sent WHERE NOT triggered"

_ENGAGED = f"{_SENT} SELECT count(DISTINCT opened_id) AS count FROM sent WHERE NOT triggered AND unsub IS NULL"

_UNENGAGED = f"""
    {_SENT},
    regular AS (SELECT *, count(opened_id) OVER (PARTITION BY sent_id) AS opens
                FROM sent WHERE NOT triggered AND unsub IS NULL)
    SELECT count(DISTINCT sent_id) AS count FROM regular WHERE opens = 0"""

_FREQUENCY = f"""
    {_SENT}
    SELECT count(email) AS count, total_sent FROM (
        SELECT email, count(DISTINCT primary_attribute_value) AS total_sent FROM sent
        WHERE NOT contains(lower(primary_attribute_value), 'syllabus') GROUP BY email)
    GROUP BY total_sent"""

_ZERO = """
    SELECT count(DISTINCT email) AS count FROM (
        SELECT email FROM $mail_leads
        WHERE coalesce(unsubscribed, FALSE) = FALSE AND coalesce(emailinvalid, 'FALSE') = 'FALSE'
        EXCEPT
        SELECT email FROM $mail_dashboard WHERE date_trunc('month', email_sent) = TIMESTAMP '2024-01-01')"""


def _bounced(table: str) -> str:
    return f"""(SELECT count(DISTINCT (b.leadid, b.primary_attribute_value)) FROM sent s JOIN {table} b
        ON b.leadid = s.sent_id AND b.primary_attribute_value = s.primary_attribute_value
       AND date_trunc('day', {pacific('b.activitydate')}) = date_trunc('day', s.email_sent))"""


_TOTALS = f"""
    {_SENT},
    mailings AS (
        SELECT count(DISTINCT sent_id) AS sent, count(DISTINCT opened_id) AS opened,
               count(DISTINCT clicked_id) AS clicked, count(DISTINCT unsub) AS unsubs
        FROM sent GROUP BY primary_attribute_value)
    SELECT sum(sent)::BIGINT AS total_sent, sum(opened)::BIGINT AS total_opened,
           sum(clicked)::BIGINT AS total_clicked, sum(unsubs)::BIGINT AS total_unsubs,
           {_bounced('$mail_bounced')} AS total_hard_bounces,
           {_bounced('$mail_bounced_soft')} AS total_soft_bounces
    FROM mailings"""

_UTM = """
    WITH found AS (
        SELECT DISTINCT l.id, o.review_call_booked_boolean__c AS booked, o.stagename
        FROM (SELECT DISTINCT user_id FROM $pageviews
              WHERE utm_medium = 'marketing_email' AND utm_source = 'nurture_email'
                AND utm_campaign = 'salesnurture' AND utm_content = 'nurturelead') v
        JOIN $web_users u ON u.user_id = v.user_id
        JOIN $lead_data l ON u._email ILIKE l.email
        LEFT JOIN $opportunity o ON o.id = l.opp_id)
    SELECT count(DISTINCT id) AS leads, count(DISTINCT id) FILTER (booked) AS trials,
           count(DISTINCT id) FILTER (stagename IN ('Client', 'Onboarded with Retro')) AS clients
    FROM found"""

_AUDIENCE = """
    SELECT DISTINCT email FROM $mail_dashboard
    WHERE primary_attribute_value ILIKE '%x\\_OPR\\_%' ESCAPE '\\'"""

_CONTACTABLE_ROWS = """
    WITH base AS (
        SELECT *, replace(coalesce(country, ''), 'Unknown', '') || replace(coalesce(country__c, ''), 'Unknown', '')
               || replace(coalesce(country__c_account, ''), 'Unknown', '')
               || replace(coalesce(inferredcountry, ''), 'Unknown', '') AS whole_country
        FROM $mail_leads),
    shared_rule AS (
        SELECT *, coalesce(leadsource__c = 'Accountant', FALSE) OR coalesce(unsubscribed, FALSE)
               OR coalesce(emailinvalid = 'TRUE', FALSE) OR coalesce(email_opt_out_formula__c = 'TRUE', FALSE)
               OR coalesce(do_not_contact__c = 'TRUE', FALSE) OR coalesce(pro_email_opt_out__c = 'TRUE', FALSE)
               OR coalesce(account_type__c IN ('Vendor', 'Business Partner', 'Cancelled - Follow Up Needed',
                    'Parent', 'Initial Referral', 'Qualified', 'Agreement Sent / Received', 'Legal Review',
                    'Partner', 'Terminated'), FALSE)
               OR coalesce(contains(lower(email), 'corp.example'), FALSE)
               OR coalesce(leadsource IN ('Partner List', 'List Upload', 'Test Lead'), FALSE)
               OR coalesce(email_opt_out__c IN ('True', 'true', 'yes'), FALSE)
               OR coalesce(leadsource = 'Freshbooks' AND (reseller__c = 'TRUE' OR reseller_lead__c = 'TRUE'), FALSE)
               AS blocked
        FROM base),
    abroad AS (
        SELECT email FROM base WHERE whole_country <> ''
          AND NOT regexp_matches(whole_country, 'US|U\\.S\\.|United State|united.states')),
    wrong_type AS (
        SELECT email FROM base
        WHERE (recordtypeid IS NULL AND recordtypeid_lead IS NULL)
           OR (recordtypeid NOT IN ('RT_LEAD', 'RT_PARTNER') AND recordtypeid_lead NOT IN ('RT_LEAD', 'RT_PARTNER'))),
    everyone AS (SELECT email FROM abroad UNION SELECT email FROM wrong_type),
    no_contact AS (SELECT email FROM shared_rule WHERE blocked UNION SELECT email FROM everyone),
    no_prospect AS (
        SELECT email FROM shared_rule
        WHERE blocked OR account_type__c IN ('Client Care - Active', 'Client', 'Client Care - Churning',
                'Trial with CC', 'Reactivation - Trial with CC')
           OR account_status__c IN ('Catch Up', 'Keep up', 'KEEP_UP', 'CATCH_UP')
        UNION SELECT email FROM everyone)
    SELECT DISTINCT id,
           CASE WHEN regexp_full_match(client_key, '[0-9]{1,9}') THEN client_key END AS client_key, email,
           (NOT EXISTS (SELECT 1 FROM no_contact n WHERE n.email = b.email))::INT AS contactable_ind,
           (NOT EXISTS (SELECT 1 FROM no_prospect n WHERE n.email = b.email))::INT AS prospect_ind
    FROM base b WHERE email IS NOT NULL"""


def _count_prospects(value: int) -> str:
    return f"SELECT count(DISTINCT id) AS count FROM ({_CONTACTABLE_ROWS}) WHERE prospect_ind = {value}"


_FORMS = """
    SELECT f.activitydate, l.sfdcleadid, l.email, f.query_parameters, f.referrer_url, f.form_fields
    FROM $mail_forms f LEFT JOIN $mail_leads l ON l.id = f.leadid
    WHERE f.primary_attribute_value_id = 2000"""

_FORM_FUNNEL = """
    SELECT s.sfdcleadid, c.cta__c, o.trial_call_booked__c, o.closedate, o.stagename, o.iswon
    FROM (SELECT DISTINCT l.sfdcleadid FROM $mail_forms f JOIN $mail_leads l ON l.id = f.leadid
          WHERE f.primary_attribute_value_id = 2000 AND l.sfdcleadid IS NOT NULL) s
    LEFT JOIN $crm_lead c ON c.id = s.sfdcleadid
    LEFT JOIN $opportunity o ON o.id = c.convertedopportunityid"""

QUERIES: dict[str, str] = {
    "email_campaign_metrics": _CAMPAIGN,
    "email_channel_conversions": _CONVERSIONS,
    "email_leads": _LEADS,
    "email_to_sales_within": _WITHIN,
    "email_contacted": _CONTACTED,
    "email_engaged": _ENGAGED,
    "email_unengaged": _UNENGAGED,
    "email_frequency": _FREQUENCY,
    "email_zero_sends": _ZERO,
    "email_totals": _TOTALS,
    "email_utm_funnel": _UTM,
    "mailing_audience": _AUDIENCE,
    "contactable": _CONTACTABLE_ROWS,
    "email_contactable": _count_prospects(0),
    "email_prospect": _count_prospects(1),
    "form_fills": _FORMS,
    "form_fill_funnel": _FORM_FUNNEL,
}
