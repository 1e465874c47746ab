"""The jobs, by name. Each takes the logical tables and keyword parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import partial

from pyspark.sql import DataFrame

from touchline.plans import ads, attribution, blocks, email, experiments, leads, referrals, sinks, traffic

JOBS: dict[str, Callable[..., DataFrame]] = {
    "channel_uniques": traffic.channel_uniques,
    "channel_uniques_weekly": partial(traffic.channel_uniques, scope="saturday_week"),
    "search_core_daily": traffic.search_core_daily,
    "core_traffic_last_touch": traffic.core_traffic_last_touch,
    "core_traffic_last_touch_weekly": partial(traffic.core_traffic_last_touch, scope="saturday_week"),
    "partner_semimonth_funnel": traffic.partner_semimonth_funnel,
    "growth_web_long": traffic.growth_web_long,
    "growth_web_wide": traffic.growth_web_wide,
    "ab_session_last_page": experiments.ab_session_last_page,
    "ab_single_variant": experiments.ab_single_variant,
    "ab_funnel_ilike": experiments.ab_funnel_ilike,
    "ab_funnel_exclusions": experiments.ab_funnel_exclusions,
    "ab_exposure_attribution": experiments.ab_exposure_attribution,
    "keyword_conversions": attribution.keyword_conversions,
    "conversions_by_channel_device": attribution.conversions_by_channel_device,
    "bottom_funnel_actuals": attribution.bottom_funnel_actuals,
    "reallocation_buckets": attribution.reallocation_buckets,
    "quiz_campaign_attribution": attribution.quiz_campaign_attribution,
    "contact_details_credit": attribution.contact_details_credit,
    "email_campaign_metrics": email.email_campaign_metrics,
    "email_channel_conversions": email.email_channel_conversions,
    "email_leads": email.email_leads,
    "email_to_sales_within": email.email_to_sales_within,
    "email_contacted": email.email_contacted,
    "email_engaged": email.email_engaged,
    "email_unengaged": email.email_unengaged,
    "email_frequency": email.email_frequency,
    "email_zero_sends": email.email_zero_sends,
    "email_totals": email.email_totals,
    "email_contactable": email.email_contactable,
    "email_prospect": email.email_prospect,
    "email_utm_funnel": email.email_utm_funnel,
    "mailing_audience": email.mailing_audience,
    "contactable": email.contactable,
    "form_fills": email.form_fills,
    "form_fill_funnel": email.form_fill_funnel,
    "chat_cohort_funnel": leads.chat_cohort_funnel,
    "nurtured_lead_events": leads.nurtured_lead_events,
    "score_at_assignment": leads.score_at_assignment,
    "account_group_map": leads.account_group_map,
    "account_group_view": sinks.account_group_view,
    "lead_definition_audit": leads.lead_definition_audit,
    "paid_ads_daily": ads.paid_ads_daily,
    "referral_page_conversions": referrals.referral_page_conversions,
    "referral_lead_sources": referrals.referral_lead_sources,
    "referring_accounts": referrals.referring_accounts,
    "touch_periods": blocks.touch_periods,
    "touch_channels": blocks.touch_channels,
    "touches_before_conversion": blocks.touches_before_conversion,
    "first_touches": blocks.first_touches,
    "first_touches_of_the_day": blocks.first_touches_of_the_day,
    "prior_touches": blocks.prior_touches,
    "session_pages": blocks.session_pages,
    "last_page_before_pricing": blocks.last_page_before_pricing,
    "single_variant_users": blocks.single_variant_users,
    "mixed_variant_emails": blocks.mixed_variant_emails,
    "single_device_users": blocks.single_device_users,
    "identity_matches": blocks.identity_matches,
    "latest_bing_rows": blocks.latest_bing_rows,
    "lead_scores": blocks.lead_scores,
    "sessions_before_leads": blocks.sessions_before_leads,
    "unsent_addresses": blocks.unsent_addresses,
    "mailing_kinds": blocks.mailing_kinds,
    "referrer_names": blocks.referrer_names,
    "outside_addresses": blocks.outside_addresses,
    "opportunity_values": blocks.opportunity_values,
    "qualified_dropouts": blocks.qualified_dropouts,
}


def create_views(tables: Mapping[str, DataFrame], names: Iterable[str], prefix: str = "") -> None:
    """Expose reports as temporary views, for SQL on top of them.

    Steps that a report writes run now, so a view shows the data of this moment; call again to renew it.
    """
    for name in names:
        JOBS[name](tables).createOrReplaceTempView(f"{prefix}{name}")


def write_report(
    tables: Mapping[str, DataFrame], name: str, path: str, partition_by: str | None = None,
    covers: Iterable[str | None] | None = None, **options,
) -> None:
    """Write a report as parquet, whole or by partitions; see ``sinks``."""
    sinks.write_report(tables, JOBS[name], path, partition_by, covers, **options)
