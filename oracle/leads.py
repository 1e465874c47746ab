"""Lead cohorts, milestones, scores and account structure."""

from __future__ import annotations

from oracle.experiments import lead_rules, qualified
from oracle.traffic import pacific

_CHAT = """
    WITH chat AS (
        SELECT id, opp_id, date_trunc('month', lead_created_datetime_pstpdt)::TIMESTAMP AS month
        FROM $lead_data WHERE leadsource = 'Live Chat')
    SELECT month, count(DISTINCT c.id) AS leads,
           count(DISTINCT o.id) FILTER (date_trunc('month', o.trial_call_booked__c) = month) AS trials,
           count(DISTINCT o.id) FILTER (date_trunc('month', o.closedate) = month
                                        AND o.stagename = 'Client' AND o.iswon) AS clients
    FROM chat c LEFT JOIN $opportunity o ON o.id = c.opp_id GROUP BY month"""

_NURTURED = f"""
    WITH nurtured AS (
        SELECT l.id AS lead_id, o.id AS opp_id, c.nurture_date__c AS nurture, c.re_engagement_datetime__c AS again,
               l.lead_created_datetime_pstpdt AS created, o.trial_call_booked__c AS trial,
               {pacific('o.closedate')} AS client, o.stagename = 'Client' AND o.iswon AND o.isclosed AS is_client,
               coalesce(c.re_engagement_datetime__c > c.nurture_date__c, FALSE)::INT AS reengaged
        FROM $lead_data l JOIN $crm_lead c ON c.id = l.id
        LEFT JOIN $opportunity o ON o.id = c.convertedopportunityid
        WHERE c.nurture_date__c IS NOT NULL
          AND coalesce(c.nurture_date__c < o.trial_call_booked__c, TRUE)
          AND coalesce(c.nurture_date__c < {pacific('o.closedate')}, TRUE))
    SELECT DISTINCT lead_id, opp_id, moment AS conversion_date, label AS conversion_type, reengaged
    FROM (SELECT lead_id, opp_id, reengaged,
                 unnest([nurture, again, created, trial, CASE WHEN is_client THEN client END]) AS moment,
                 unnest(['nurture', 'reengagement', 'lead', 'trial', 'client']) AS label
          FROM nurtured)
    WHERE moment IS NOT NULL"""

_SCORES = f"""
    WITH dated AS (
        SELECT f.*, c.test_1__c AS cta, {pacific('h.createddate')} AS changed, h.newvalue__string AS new_value,
               h.oldvalue__string AS old_value,
               {pacific('coalesce(c.lead_assignment_date__c, c.first_lead_assignment_date__c)')} AS assigned,
               {pacific('coalesce(c.mql_first_date_time__c, c.mql_last_date_time__c)')} AS qualified
        FROM $scored_funnel f
        LEFT JOIN $lead_history h ON f.ls_sal_lead_id = substr(h.leadid, 1, 15) AND h.field ILIKE '%score%'
        LEFT JOIN $crm_lead c ON f.ls_sal_lead_id = substr(c.id, 1, 15)
        WHERE f.ls_sal_lead_conversion >= TIMESTAMP '1995-04-01'),
    distances AS (
        SELECT *, date_diff('second', CASE WHEN assigned < qualified THEN qualified ELSE assigned END, changed)
               AS distance
        FROM dated),
    nearest AS (
        SELECT *, min(abs(distance)) OVER (PARTITION BY ls_sal_lead_id) AS least FROM distances)
    SELECT CASE WHEN distance > 0 THEN old_value WHEN distance < 0 THEN new_value END AS assignment_lead_score,
           count(ls_sal_trial_conversion) / count(ls_sal_lead_conversion)::DOUBLE AS lt,
           count(ls_sal_lead_conversion) AS leads, count(ls_sal_trial_conversion) AS trials,
           count(ls_sal_client_conversion) AS clients
    FROM nearest
    WHERE abs(distance) = least AND (cta IS NULL OR NOT contains(lower(cta), 'tax info call'))
    GROUP BY 1"""

_ACCOUNTS = """
    WITH children AS (
        SELECT a.id, a.parentid, a.client_key, a.name, count(a.id) OVER (PARTITION BY a.parentid) AS total_child
        FROM $account a JOIN $account p ON p.id = a.parentid
        WHERE a.recordtypeid = 'RT_CLIENT' AND p.recordtypeid = 'RT_CLIENT' AND a.isdeleted = FALSE),
    placed AS (
        SELECT c.*, l.channel_allocation_stamp__c AS stamp, l.leadsource, l.closedate,
               rank() OVER (PARTITION BY c.parentid ORDER BY c.client_key ASC NULLS LAST) AS position
        FROM children c LEFT JOIN $lead_data l ON l.accountid = c.id),
    tested AS (
        SELECT *, CASE WHEN stamp IS NULL THEN 0 WHEN position = 1 THEN (stamp = 'MBC')::INT
                       ELSE (stamp <> 'MBC')::INT END AS wrong
        FROM placed),
    won AS (
        SELECT DISTINCT o.id, o.accountid, o.leadsource, r.channel_allocation_stamp__c AS stamp
        FROM $opportunity o LEFT JOIN $crm_lead r ON r.convertedopportunityid = o.id
        WHERE o.accountid IN (SELECT id FROM placed WHERE closedate IS NULL)
          AND o.recordtypeid IN ('RT_NEW', 'RT_RETRO') AND (o.iswon OR o.stagename = 'Client')
          AND o.leadsource NOT IN ('Equity Structure Change', 'Test Lead'))
    SELECT t.id, t.parentid, t.client_key, t.name, t.total_child, coalesce(t.stamp, w.stamp) AS channel,
           coalesce(t.leadsource, w.leadsource) AS leadsource, t.closedate,
           CASE WHEN sum(t.wrong) OVER (PARTITION BY t.parentid) > 0 THEN 'error' END AS test
    FROM tested t LEFT JOIN won w ON w.accountid = t.id"""

_AUDIT = f"""
    SELECT id, leadsource, providedemail__c, providedcompanydetails__c, createdaccount__c, isconverted, status,
           recordtypeid, phone, loss_reason__c, owner_role__c, potential_date__c, converteddate, isdeleted,
           {', '.join(f'coalesce({rule}, FALSE)::INT AS {name}' for name, rule in lead_rules().items())},
           coalesce({qualified()}, FALSE)::INT AS is_lead
    FROM $crm_lead"""

QUERIES: dict[str, str] = {
    "chat_cohort_funnel": _CHAT,
    "nurtured_lead_events": _NURTURED,
    "score_at_assignment": _SCORES,
    "account_group_map": _ACCOUNTS,
    "account_group_view": _ACCOUNTS,
    "lead_definition_audit": _AUDIT,
}
