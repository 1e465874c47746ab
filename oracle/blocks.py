"""The shared operators, row by row."""

from __future__ import annotations

from oracle.experiments import qualified
from oracle.traffic import PAID, REST, flagged, pacific

_PERIODS = f"""
    SELECT touch_id, date_trunc('day', time)::TIMESTAMP AS day,
           date_trunc('day', time)::TIMESTAMP - to_days((isodow(time)::INT + 1) % 7) AS week,
           make_timestamp(year(time), month(time), 1, 0, 0, 0) AS month,
           CASE WHEN day(time) < 16 THEN '1' WHEN day(time) >= 16 THEN '2' END AS semi_month,
           {pacific('time')} AS pacific
    FROM $touches"""

_FLAGS = [*PAID, "search", "social", "email", *REST]

_CHANNELS = f"""
    WITH dated AS (SELECT *, date_trunc('day', time)::TIMESTAMP AS day FROM $touches),
    flags AS ({flagged('dated', 'day')}),
    numbers AS (SELECT * REPLACE (coalesce(search, FALSE)::INT AS search) FROM flags)
    SELECT touch_id, {', '.join(_FLAGS)}, search_core, search_content, google, bing, other_search,
           {' + '.join(_FLAGS)} AS total
    FROM numbers"""

_BEFORE = """
    SELECT touch_id, unique_id, time FROM $touches t
    WHERE NOT EXISTS (SELECT 1 FROM $attributions a WHERE a.conversion_type_id = 1 AND a.unique_id = t.unique_id)
       OR EXISTS (SELECT 1 FROM $attributions a WHERE a.conversion_type_id = 1 AND a.unique_id = t.unique_id
                  AND (a.conversion_date IS NULL OR t.time <= a.conversion_date))"""

_SATURDAY = "date_trunc('day', time)::TIMESTAMP - to_days((isodow(time)::INT + 1) % 7)"

_FIRST = f"""
    SELECT touch_id, unique_id, time, medium, landing_page, {_SATURDAY} AS period FROM $touches
    QUALIFY touch_id = first(touch_id) OVER (PARTITION BY {_SATURDAY}, unique_id
                                             ORDER BY time NULLS LAST, touch_id)"""

_FIRST_OF_DAY = """
    SELECT touch_id, unique_id, time, day
    FROM (SELECT *, date_trunc('day', time)::TIMESTAMP AS day FROM $touches WHERE medium = 'ORGANIC')
    QUALIFY time IS NOT DISTINCT FROM min(time) OVER (PARTITION BY unique_id, day)"""

_PRIOR = """
    SELECT t.touch_id, p.touch_id AS prior_touch_id
    FROM $touches t
    LEFT JOIN $touches p ON p.unique_id = t.unique_id AND p.total_touch_count + 1 = t.total_touch_count
         AND date_trunc('day', p.time) = date_trunc('day', t.time)"""

_SESSIONS = """
    SELECT user_id, session_id, bool_or(contains(lower(path), 'blog')) AS blog,
           bool_or(contains(lower(path), 'signup')) AS signup, bool_or(contains(lower(path), 'resources')) AS resource
    FROM $pageviews GROUP BY user_id, session_id"""

_LAST_PAGE = """
    SELECT user_id, session_id, time, path, utm_medium
    FROM (SELECT *, max(time) FILTER (path = '/pricing/') OVER (PARTITION BY user_id, session_id) AS target
          FROM $pageviews)
    WHERE path <> '/pricing/' AND time <= target
    QUALIFY row_number() OVER (PARTITION BY user_id, session_id
                               ORDER BY time DESC, path, utm_medium NULLS LAST) = 1"""

_SINGLE_VARIANT = """
    SELECT DISTINCT user_id, experimentvariant, time, low AS min_variant, high AS max_variant, time AS min_exposure
    FROM (SELECT *, min(experimentvariant) OVER w AS low, max(experimentvariant) OVER w AS high,
                 min(time) OVER w AS first_time
          FROM $experiment_views WINDOW w AS (PARTITION BY user_id))
    WHERE low = high AND time = first_time"""

_MIXED = """
    SELECT DISTINCT a._email FROM $web_users a JOIN $web_users b
      ON a._email = b._email AND a.experiment_b < b.experiment_b"""

_DEVICE = f"""
    SELECT user_id, any_value(device_type) AS device,
           min(date_trunc('day', {pacific('time')}))::TIMESTAMP AS first_day
    FROM $pageviews WHERE {pacific('time')} >= TIMESTAMP '1996-01-01'
    GROUP BY user_id HAVING count(DISTINCT device_type) = 1"""

_IDENTITY = """
    SELECT p.heap_user_id, p.inferred_email, c.id AS client_id, l.id AS lead_id, l.email AS lead_email, l.client_key
    FROM $identity_map p
    LEFT JOIN $client c ON c.principalpersonid = p.inferred_person_id
    LEFT JOIN $lead_data l ON p.inferred_email ILIKE l.email OR l.client_key = c.id"""

_SNAPSHOT = """
    SELECT * FROM $bing_ads b
    WHERE NOT EXISTS (
        SELECT 1 FROM $bing_ads n
        WHERE n.timeperiod IS NOT DISTINCT FROM b.timeperiod AND n.adid IS NOT DISTINCT FROM b.adid
          AND n.adgroupname IS NOT DISTINCT FROM b.adgroupname
          AND n.campaignname IS NOT DISTINCT FROM b.campaignname
          AND coalesce(n._sdc_report_datetime, TIMESTAMP '9999-01-01')
              > coalesce(b._sdc_report_datetime, TIMESTAMP '9999-01-01'))"""

_SCORES = f"""
    WITH changes AS (
        SELECT l.id, h.newvalue__string AS new_value, h.oldvalue__string AS old_value,
               date_diff('second', l.lead_created_datetime_pstpdt, {pacific('h.createddate')}) AS seconds
        FROM $lead_data l JOIN $lead_history h ON substr(h.leadid, 1, 15) = substr(l.id, 1, 15)
        WHERE h.field ILIKE '%score%')
    SELECT id, CASE sign(seconds) WHEN 1 THEN old_value WHEN -1 THEN new_value END AS score, seconds
    FROM changes QUALIFY abs(seconds) = min(abs(seconds)) OVER (PARTITION BY id)"""

_SESSIONS_BEFORE = f"""
    SELECT l.id, l.email AS _email, l.lead_created_datetime_pstpdt, max({pacific('s.time')}) AS last_session
    FROM $lead_data l
    LEFT JOIN $web_users u ON u._email = l.email
    LEFT JOIN $sessions s ON s.user_id = u.user_id AND {pacific('s.time')} <= l.lead_created_datetime_pstpdt
    GROUP BY ALL"""

_UNSENT = """
    SELECT email FROM $mail_leads
    EXCEPT SELECT email FROM $mail_dashboard WHERE primary_attribute_value LIKE '%August Cohort%'"""

_KINDS = """
    SELECT primary_attribute_value,
           coalesce(regexp_matches(primary_attribute_value, '(?i)syllabus|_opr_'), FALSE) AS triggered,
           count(DISTINCT sent_id) AS recipients,
           count(DISTINCT sent_id) FILTER (contains(link, 'unsub')
               AND NOT contains(lower(primary_attribute_value), '_opr_')) AS unsubs
    FROM $mail_dashboard GROUP BY ALL"""

_REFERRERS = """
    SELECT CASE WHEN referrer IS NULL THEN 'null'
                ELSE CASE WHEN contains(lower(referrer), 'facebook') THEN 'facebook'
                     WHEN contains(lower(referrer), 'corp.example') THEN 'corp.example'
                     WHEN contains(lower(referrer), 'bing') THEN 'bing'
                     WHEN contains(lower(referrer), 'youtube') THEN 'youtube'
                     WHEN contains(lower(referrer), 'ebay') THEN 'ebay'
                     WHEN contains(lower(referrer), 'google') THEN 'google'
                     WHEN contains(lower(referrer), 'reddit') THEN 'reddit'
                     WHEN contains(lower(referrer), 'slack') THEN 'slack'
                     ELSE regexp_replace(split_part(referrer, '?', 1), '/$', '') END END AS referrer, count(*) AS sessions
    FROM $sessions GROUP BY 1"""

_OUTSIDE = """
    SELECT user_id, _email FROM $web_users
    WHERE NOT regexp_matches(coalesce(lower(_email), ''), 'corp\\.example|test')"""

_VALUES = """
    SELECT id, CASE WHEN stagename = 'Client' THEN coalesce(bookkeeping_mrr__c, 0) + coalesce(tax_mrr__c, 0)
                    + CASE WHEN pro_opp_status__c = 'Client' THEN pro_mrr__c ELSE 0 END END AS won_mrr
    FROM $opportunity"""

_DROPOUTS = f"""
    SELECT r.id, r.client_key, r.email, o.id AS opp_id, o.won_mrr
    FROM $crm_lead r LEFT JOIN ({_VALUES}) o ON o.id = r.convertedopportunityid
    WHERE r.id NOT IN (SELECT id FROM $lead_data) AND {qualified('r.')}"""

QUERIES: dict[str, str] = {
    "touch_periods": _PERIODS,
    "touch_channels": _CHANNELS,
    "touches_before_conversion": _BEFORE,
    "first_touches": _FIRST,
    "first_touches_of_the_day": _FIRST_OF_DAY,
    "prior_touches": _PRIOR,
    "session_pages": _SESSIONS,
    "last_page_before_pricing": _LAST_PAGE,
    "single_variant_users": _SINGLE_VARIANT,
    "mixed_variant_emails": _MIXED,
    "single_device_users": _DEVICE,
    "identity_matches": _IDENTITY,
    "latest_bing_rows": _SNAPSHOT,
    "lead_scores": _SCORES,
    "sessions_before_leads": _SESSIONS_BEFORE,
    "unsent_addresses": _UNSENT,
    "mailing_kinds": _KINDS,
    "referrer_names": _REFERRERS,
    "outside_addresses": _OUTSIDE,
    "opportunity_values": _VALUES,
    "qualified_dropouts": _DROPOUTS,
}
