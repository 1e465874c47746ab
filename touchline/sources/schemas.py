"""Declared columns of the logical tables.

Timestamps are zone-less. They hold UTC, except columns whose name ends in
``_pstpdt`` and ``email_sent``, which already hold Pacific time.
"""

from __future__ import annotations

# Logical name -> columns, as a DDL string that a DataFrame reader takes as schema.
SCHEMAS: dict[str, str] = {
    "touches": """touch_id long, unique_id string, time timestamp_ntz, total_touch_count int,
        source string, medium string, submedium string, utm_medium string, utm_source string,
        utm_campaign string, utm_content string, referrer string, landing_page string, lead_id string""",
    "attributions": """unique_id string, lead_id string, conversion_type_id int, conversion_type string,
        conversion_date timestamp_ntz, conversion_credit double, utm_term string, device_type string""",
    "attributions_channel": """client_key string, lead_id string, opp_id string, channel string,
        conversion_type string, conversion_date timestamp_ntz, conversion_credit double""",
    "attributions_translated": """lead_client_id string, lead_id string, opportunity_id string, email double,
        conversion_date timestamp_ntz, thedate timestamp_ntz, conversion_type_id int, utm_medium string,
        utm_source string, utm_campaign string, landing_page string, referrer string""",
    "attributions_by_channel": """lead_id string, conversion_date timestamp_ntz, conversion_type string,
        channel_1 string, channel_2 string, credit_1 double, credit_2 double""",
    "attributions_crm": "id string, raw_date timestamp_ntz, referrals int, lead_ind int",
    "lead_attributions": "email string, opportunity_id string, lead_created_datetime_pstpdt timestamp_ntz",
    "pageviews": """user_id long, session_id long, time timestamp_ntz, path string, title string,
        landing_page string, utm_medium string, utm_source string, utm_campaign string,
        utm_content string, device_type string""",
    "web_users": "user_id long, id string, _email string, experiment_a int, experiment_b int, "
    "experiment_c int, experiment_d int",
    "sessions": """user_id long, time timestamp_ntz, referrer string, landing_page string,
        utm_medium string, utm_content string""",
    "signup_tool_views": "user_id long, time timestamp_ntz, page_name string, view_name string, landing_page string",
    "contact_events": "user_id long, time timestamp_ntz, landing_page string, utm_campaign string",
    "share_clicks": "user_id long, time timestamp_ntz",
    "demo_form_events": "user_id long, time timestamp_ntz, path string",
    "experiment_views": "user_id long, time timestamp_ntz, experimentvariant string, campaignid string",
    "identity_map": "heap_user_id long, inferred_email string, inferred_person_id string",
    "person": "id string, email string",
    "client": "id string, principalpersonid string",
    "lead_data": """id string, email string, client_key string, opp_id string, accountid string, cta string,
        leadsource string, channel_allocation_stamp__c string, lead_created_datetime_pstpdt timestamp_ntz,
        actual_date_created__c timestamp_ntz, closedate timestamp_ntz, won_mrr double,
        catch_up_only_team__c boolean""",
    "opportunity": """id string, accountid string, stagename string, leadsource string, recordtypeid string,
        client_key string, pro_opp_status__c string, closedate timestamp_ntz,
        trial_call_booked__c timestamp_ntz, review_call_booked timestamp_ntz,
        review_call_date_time__c timestamp_ntz, iswon boolean, isclosed boolean,
        review_call_booked_boolean__c boolean, bookkeeping_mrr__c double, tax_mrr__c double,
        pro_mrr__c double""",
    "crm_lead": """id string, email string, client_key string, leadsource string, status string,
        recordtypeid string, phone string, loss_reason__c string, owner_role__c string, ownerid string,
        convertedopportunityid string, cta__c string, test_1__c string, channel_allocation_stamp__c string,
        providedemail__c string, providedcompanydetails__c string, createdaccount__c string,
        team_suf2__c string, lead_score_rating__c string, lead_scoring_lead__c string,
        referring_contact_account_id__c string, ambassador__referred_by_contact__c string,
        isconverted boolean, isdeleted boolean, actual_date_created__c timestamp_ntz,
        potential_date__c timestamp_ntz, converteddate timestamp_ntz, nurture_date__c timestamp_ntz,
        re_engagement_datetime__c timestamp_ntz, lead_assignment_date__c timestamp_ntz,
        first_lead_assignment_date__c timestamp_ntz, mql_first_date_time__c timestamp_ntz,
        mql_last_date_time__c timestamp_ntz""",
    "lead_history": "leadid string, field string, newvalue__string string, oldvalue__string string, "
    "createddate timestamp_ntz",
    "scored_funnel": "ls_sal_lead_id string, ls_sal_lead_conversion timestamp_ntz, "
    "ls_sal_trial_conversion timestamp_ntz, ls_sal_client_conversion timestamp_ntz",
    "account": """id string, parentid string, client_key string, name string, recordtypeid string,
        primary_contact_email__c string, isdeleted boolean""",
    "crm_user": "id string",
    "campaign_member": "leadid string, email string, campaignid string, createddate timestamp_ntz",
    "mail_leads": """id string, sfdcleadid string, email string, leadsource string, leadsource__c string,
        account_type__c string, emailinvalid string, email_opt_out_formula__c string, email_opt_out__c string,
        do_not_contact__c string, reseller__c string, reseller_lead__c string, account_status__c string,
        pro_email_opt_out__c string, recordtypeid string, recordtypeid_lead string, country string,
        country__c string, country__c_account string, inferredcountry string, client_key string,
        unsubscribed boolean""",
    "mail_delivered": "leadid string, primary_attribute_value string, activitydate timestamp_ntz",
    "mail_opened": "leadid string, primary_attribute_value string, activitydate timestamp_ntz",
    "mail_clicked": "leadid string, primary_attribute_value string, activitydate timestamp_ntz",
    "mail_bounced": "leadid string, primary_attribute_value string, activitydate timestamp_ntz",
    "mail_bounced_soft": "leadid string, primary_attribute_value string, activitydate timestamp_ntz",
    "mail_forms": """leadid string, primary_attribute_value_id long, activitydate timestamp_ntz,
        query_parameters string, referrer_url string, form_fields string""",
    "mail_dashboard": """email_sent timestamp_ntz, primary_attribute_value string, sent_id string,
        opened_id string, clicked_id string, email string, link string, sal_lead_id string,
        opened_date_pstpdt timestamp_ntz, sal_lead_created timestamp_ntz""",
    "fb_insights": """date_start timestamp_ntz, campaign_id string, adset_id string, ad_id string,
        campaign_name string, adset_name string, ad_name string, spend double, reach long,
        impressions long, clicks long, inline_link_clicks long""",
    "fb_actions": "_sdc_source_key_date_start timestamp_ntz, _sdc_source_key_ad_id string, "
    "action_type string, value double",
    "bing_ads": """timeperiod timestamp_ntz, _sdc_report_datetime timestamp_ntz, campaignid long,
        adgroupid long, adid long, campaignname string, adgroupname string, spend double,
        impressions long, clicks long, conversions double""",
    "google_ads": """day timestamp_ntz, _sdc_report_datetime timestamp_ntz, campaignid long, adgroupid long,
        adid long, campaign string, adgroup string, ad string, cost long, impressions long, clicks long,
        conversions double""",
    "google_campaigns": """day timestamp_ntz, _sdc_report_datetime timestamp_ntz, campaignid long,
        campaign string, impressions long, searchimprshare double""",
    "reallocation": "conversion_date timestamp_ntz, conversion_type string, channel_credit double",
}
