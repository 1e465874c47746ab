"""Mailings, forms and who can be contacted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import any_of, is_true
from touchline.functions.times import day_diff, period_is, to_pacific, trunc
from touchline.operators.audience import (
    audience_difference,
    frequency_histogram,
    ids_by_group,
    joined_text,
    suppressed_by_address,
)
from touchline.operators.funnel import funnel_counts
from touchline.operators.identity import distinct_values, fold_case, keyed, pattern_pairs, to_patterns
from touchline.operators.joins import join_groups, split_left_join
from touchline.session import materialise

Tables = Mapping[str, DataFrame]

MAILING = "primary_attribute_value"


def email_campaign_metrics(tables: Tables, *, mailing: str = "%August Cohort%") -> DataFrame:
    """Distinct leads per mailing who got it, opened it and clicked in it.

    Each activity is counted on its own and the counts are joined, so deliveries do
    not meet every open and click of their mailing.
    """

    def leads(table: str, name: str, key: str) -> DataFrame:
        rows = tables[table].filter(F.col(MAILING).ilike(mailing))
        return rows.groupBy(F.col(MAILING).alias(key)).agg(F.countDistinct("leadid").alias(name))

    delivered = leads("mail_delivered", "delivered_emails", MAILING)
    opened = leads("mail_opened", "opened_emails", "opened_mailing")
    clicked = leads("mail_clicked", "recipients_who_clicked", "clicked_mailing")
    return (
        delivered.join(opened, F.col(MAILING) == F.col("opened_mailing"), "left")
        .join(clicked, F.col(MAILING) == F.col("clicked_mailing"), "left")
        .select(MAILING, "delivered_emails", "opened_emails", "recipients_who_clicked")
        .fillna(0)
    )


def email_channel_conversions(
    tables: Tables, *, month: str = "2024-01-01", conversion_type: int = 2
) -> DataFrame:
    """Conversions of one type and month with e-mail credit, with the addresses both systems hold."""
    crm = tables["crm_lead"].select(F.col("id").alias("crm_id"), F.col("email").alias("sf_email"))
    mail = tables["mail_leads"].select("sfdcleadid", F.col("email").alias("mkto_email"), "client_key")
    conversions = (
        tables["attributions_translated"]
        .filter(
            (F.col("email") > 0)
            & period_is(F.col("conversion_date"), "month", month)
            & (F.col("conversion_type_id") == conversion_type)
        )
        .join(crm, F.col("lead_id") == F.col("crm_id"), "left")
        .select("lead_client_id", "lead_id", "opportunity_id", "sf_email", "email")
    )
    return split_left_join(conversions, mail, F.col("lead_id") == F.col("sfdcleadid")).select(
        "lead_client_id", "lead_id", "opportunity_id", "mkto_email", "sf_email", "email", "client_key"
    )


def email_leads(tables: Tables, *, period: str = "2024-01-06") -> DataFrame:
    """Conversions of one period with e-mail credit and where they came from."""
    leads = tables["lead_data"].select("id", F.col("email").alias("lead_email"))
    return (
        tables["attributions_translated"]
        .filter((F.col("thedate") == F.lit(period).cast("timestamp_ntz")) & (F.col("email") > 0))
        .join(leads, F.col("lead_id") == F.col("id"), "left")
        .select(
            "lead_id", F.col("lead_email").alias("email"), "utm_medium", "utm_source", "utm_campaign",
            "landing_page", "referrer", "conversion_type_id",
        )
    )


def email_to_sales_within(tables: Tables, *, mailing: str = r"%Nurture\_V2%", days: int = 14) -> DataFrame:
    """Addresses that opened a mailing at most so many days before sales took the lead, or after."""
    return (
        tables["mail_dashboard"]
        .filter(
            F.col(MAILING).ilike(mailing)
            & F.col("opened_id").isNotNull()
            & F.col("sal_lead_id").isNotNull()
            & F.col("sal_lead_created").isNotNull()
            & (day_diff(F.col("sal_lead_created"), F.col("opened_date_pstpdt")) <= days)
        )
        .select("email")
        .distinct()
    )


@dataclass(frozen=True)
class MailingRules:
    """Patterns that tell triggered mailings and unsubscribe links apart."""

    newsletter: str = "%syllabus%"
    # The escaped underscores are literal.
    triggered: str = r"%\_OPR\_%"
    unsubscribe_link: str = "%unsub%"

    def is_trigger(self) -> Column:
        name = F.col(MAILING)
        return F.coalesce(name.ilike(self.newsletter) | name.ilike(self.triggered), F.lit(False))

    def unsub_id(self) -> Column:
        left = F.col("link").ilike(self.unsubscribe_link) & ~F.col(MAILING).ilike(self.triggered)
        return F.when(left, F.col("sent_id"))


def _sends(tables: Tables, month: str) -> DataFrame:
    return tables["mail_dashboard"].filter(period_is(F.col("email_sent"), "month", month))


def _regular_sends(tables: Tables, month: str, rules: MailingRules | None) -> DataFrame:
    rules = rules or MailingRules()
    return _sends(tables, month).withColumn("unsub_id", rules.unsub_id()).filter(~rules.is_trigger())


MONTH = "2024-01-01"


def email_contacted(tables: Tables, *, month: str = MONTH, rules: MailingRules | None = None) -> DataFrame:
    """Distinct recipients of mailings that were not triggered."""
    return _regular_sends(tables, month, rules).agg(F.countDistinct("sent_id").alias("count"))


def email_engaged(tables: Tables, *, month: str = MONTH, rules: MailingRules | None = None) -> DataFrame:
    """Distinct openers who did not unsubscribe."""
    sends = _regular_sends(tables, month, rules).filter("unsub_id IS NULL")
    return sends.agg(F.countDistinct("opened_id").alias("count"))


def email_unengaged(tables: Tables, *, month: str = MONTH, rules: MailingRules | None = None) -> DataFrame:
    """Recipients who opened nothing."""
    sends = _regular_sends(tables, month, rules).filter("unsub_id IS NULL")
    opens = sends.groupBy("sent_id").agg(F.count("opened_id").alias("opens"))
    return opens.filter("opens = 0").agg(F.count("sent_id").alias("count"))


def email_frequency(tables: Tables, *, month: str = MONTH, newsletter: str = "%syllabus%") -> DataFrame:
    """Number of people by number of different mailings, newsletters left out."""
    sends = _sends(tables, month).filter(~F.col(MAILING).ilike(newsletter))
    return frequency_histogram(sends, "email", MAILING)


def email_zero_sends(tables: Tables, *, month: str = "2024-01-01") -> DataFrame:
    """Mailable addresses that nothing was sent to in the month."""
    invalid = F.col("emailinvalid")
    mailable = tables["mail_leads"].filter(
        (F.col("unsubscribed").isNull() | ~F.col("unsubscribed")) & ((invalid == "FALSE") | invalid.isNull())
    )
    unsent = audience_difference(mailable.select("email"), _sends(tables, month).select("email"))
    return unsent.agg(F.count("email").alias("count"))


def email_totals(tables: Tables, *, month: str = MONTH, rules: MailingRules | None = None) -> DataFrame:
    """Distinct recipients per mailing who were sent to, opened, clicked, unsubscribed or bounced, summed up."""
    rules = rules or MailingRules()
    sends = _sends(tables, month).withColumn("unsub_id", rules.unsub_id())
    kinds = {"sent": "sent_id", "opened": "opened_id", "clicked": "clicked_id", "unsubs": "unsub_id"}
    parts = ids_by_group(sends, MAILING, {kind: F.col(c) for kind, c in kinds.items()})
    sent = sends.select(
        F.col("sent_id").alias("leadid"), MAILING, trunc(F.col("email_sent"), "day").alias("sent_day")
    ).distinct()
    for kind, table in {"hard_bounces": "mail_bounced", "soft_bounces": "mail_bounced_soft"}.items():
        bounces = tables[table].withColumn("sent_day", trunc(to_pacific(F.col("activitydate")), "day"))
        bounced = join_groups(bounces, sent, ["leadid", MAILING, "sent_day"], "left_semi")
        parts = parts.unionAll(bounced.select(MAILING, F.lit(kind).alias("kind"), F.col("leadid").alias("id")))
    # Sends without an id stay so that a month with sends differs from one without.
    ids = parts.filter(F.col("id").isNotNull() | (F.col("kind") == "sent")).distinct()
    names = [*kinds, "hard_bounces", "soft_bounces"]
    counts = [F.count_if((F.col("kind") == n) & F.col("id").isNotNull()) for n in names]
    return ids.agg(
        *[F.when(F.count(F.lit(1)) > 0, c).alias(f"total_{n}") for n, c in zip(names, counts, strict=True)]
    )


def email_utm_funnel(
    tables: Tables,
    *,
    utm_medium: str = "marketing_email",
    utm_source: str = "nurture_email",
    utm_campaign: str = "salesnurture",
    utm_content: str = "nurturelead",
    client_stages: Sequence[str] = ("Client", "Onboarded with Retro"),
    email_match: str = "pattern",
) -> DataFrame:
    """Leads, trials and clients whose address belongs to a user who came from a mailing."""
    visitors = (
        tables["pageviews"]
        .filter(
            (F.col("utm_medium") == utm_medium)
            & (F.col("utm_source") == utm_source)
            & (F.col("utm_campaign") == utm_campaign)
            & (F.col("utm_content") == utm_content)
        )
        .select("user_id")
        .distinct()
    )
    users = materialise(tables["web_users"].join(visitors, "user_id", "left_semi").select("_email"))
    leads = tables["lead_data"].select("id", "email", "opp_id")
    wanted = keyed(users, [], [("email", "_email")]).distinct()
    addresses = keyed(leads, ["id", "opp_id"], [("email", "email")])
    if email_match == "pattern":
        pairs = pattern_pairs(distinct_values((users, "_email")), distinct_values((leads, "email")))
        wanted = to_patterns(wanted, pairs, "email")
    else:
        wanted, addresses = fold_case(wanted, "email"), fold_case(addresses, "email")
    opps = tables["opportunity"].select(F.col("id").alias("opp"), "review_call_booked_boolean__c", "stagename")
    found = addresses.join(wanted, ["key_kind", "key"], "left_semi")
    return funnel_counts(
        found.join(opps, F.col("opp_id") == F.col("opp"), "left"),
        [],
        {
            "leads": ("id", None),
            "trials": ("id", is_true(F.col("review_call_booked_boolean__c"))),
            "clients": ("id", F.col("stagename").isin(*client_stages)),
        },
    )


def mailing_audience(tables: Tables, *, mailing: str = r"%x\_OPR\_%") -> DataFrame:
    """Distinct addresses a mailing went to."""
    return tables["mail_dashboard"].filter(F.col(MAILING).ilike(mailing)).select("email").distinct()


@dataclass(frozen=True)
class ContactRules:
    """Values that make an address not contactable."""

    internal: str = "%corp.example%"
    account_types: tuple[str, ...] = (
        "Vendor", "Business Partner", "Cancelled - Follow Up Needed", "Parent", "Initial Referral", "Qualified",
        "Agreement Sent / Received", "Legal Review", "Partner", "Terminated",
    )
    prospect_account_types: tuple[str, ...] = (
        "Client Care - Active", "Client", "Client Care - Churning", "Trial with CC", "Reactivation - Trial with CC",
    )
    prospect_account_states: tuple[str, ...] = ("Catch Up", "Keep up", "KEEP_UP", "CATCH_UP")
    lead_sources: tuple[str, ...] = ("Partner List", "List Upload", "Test Lead")
    opt_out_values: tuple[str, ...] = ("True", "true", "yes")
    reseller_source: str = "Freshbooks"
    partner_source: str = "Accountant"
    record_types: tuple[str, ...] = ("RT_LEAD", "RT_PARTNER")
    # Matched in this case. A country text may contain several countries.
    home_country: tuple[str, ...] = ("%US%", "%U.S.%", "%United States%", "%united_states%", "%United State%")
    unknown_country: str = "Unknown"

    def no_contact(self) -> Column:
        source = F.col("leadsource")
        resold = (F.col("reseller__c") == "TRUE") | (F.col("reseller_lead__c") == "TRUE")
        return any_of(
            [
                F.col("leadsource__c") == self.partner_source,
                is_true(F.col("unsubscribed")),
                *[
                    F.col(c) == "TRUE"
                    for c in ("emailinvalid", "email_opt_out_formula__c", "do_not_contact__c", "pro_email_opt_out__c")
                ],
                F.col("account_type__c").isin(*self.account_types),
                F.col("email").ilike(self.internal),
                source.isin(*self.lead_sources),
                F.col("email_opt_out__c").isin(*self.opt_out_values),
                resold & (source == self.reseller_source),
            ]
        )

    def no_prospect(self) -> Column:
        return any_of(
            [
                self.no_contact(),
                F.col("account_type__c").isin(*self.prospect_account_types),
                F.col("account_status__c").isin(*self.prospect_account_states),
            ]
        )

    def wrong_type(self) -> Column:
        """Both record types known and neither accepted, or both missing."""
        own, lead = F.col("recordtypeid"), F.col("recordtypeid_lead")
        neither = ~own.isin(*self.record_types) & ~lead.isin(*self.record_types)
        return neither | (own.isNull() & lead.isNull())

    def abroad(self) -> Column:
        columns = ("country", "country__c", "country__c_account", "inferredcountry")
        country = joined_text(columns, self.unknown_country)
        return (country != "") & ~any_of([country.like(p) for p in self.home_country])


def contactable(tables: Tables, *, rules: ContactRules | None = None) -> DataFrame:
    """Each mailing record with a clean account number and whether its address may be mailed.

    One suppressed record suppresses every record of the same address.
    """
    rules = rules or ContactRules()
    marked = suppressed_by_address(
        tables["mail_leads"],
        "email",
        {
            "__contact": rules.no_contact() | rules.abroad() | rules.wrong_type(),
            "__prospect": rules.no_prospect() | rules.abroad() | rules.wrong_type(),
        },
    )
    number = F.col("client_key")
    is_number = number.rlike("^[0-9]+$") & (F.char_length(number) < 10)
    return marked.select(
        "id",
        F.when(is_number, number).alias("client_key"),
        "email",
        (1 - F.col("__contact")).alias("contactable_ind"),
        (1 - F.col("__prospect")).alias("prospect_ind"),
    ).distinct()


def _contactable_view(tables: Tables, rules: ContactRules | None) -> DataFrame:
    """The stored report if the catalog has it as ``contactable``, else computed now."""
    return tables["contactable"] if "contactable" in tables else contactable(tables, rules=rules)


def email_contactable(tables: Tables, *, rules: ContactRules | None = None) -> DataFrame:
    """Distinct records that are not prospects (the report's own name for the first group is kept)."""
    found = _contactable_view(tables, rules).filter("prospect_ind = 0")
    return found.agg(F.countDistinct("id").alias("count"))


def email_prospect(tables: Tables, *, rules: ContactRules | None = None) -> DataFrame:
    """Distinct records that are prospects."""
    found = _contactable_view(tables, rules).filter("prospect_ind = 1")
    return found.agg(F.countDistinct("id").alias("count"))


def form_fills(tables: Tables, *, form: int = 2000) -> DataFrame:
    """Submissions of one form with the CRM id of who sent it."""
    leads = tables["mail_leads"].select("id", "sfdcleadid", "email")
    return (
        tables["mail_forms"]
        .filter(F.col("primary_attribute_value_id") == form)
        .join(leads, F.col("leadid") == F.col("id"), "left")
        .select("activitydate", "sfdcleadid", "email", "query_parameters", "referrer_url", "form_fields")
    )


def form_fill_funnel(tables: Tables, *, form: int = 2000) -> DataFrame:
    """Distinct leads who sent a form, with their trial, closing date and stage."""
    senders = form_fills(tables, form=form).select("sfdcleadid").filter("sfdcleadid IS NOT NULL").distinct()
    crm = tables["crm_lead"].select("id", "cta__c", "convertedopportunityid")
    opps = tables["opportunity"].select(
        F.col("id").alias("opp"), "trial_call_booked__c", "closedate", "stagename", "iswon"
    )
    return (
        senders.join(crm, F.col("sfdcleadid") == F.col("id"), "left")
        .join(opps, F.col("convertedopportunityid") == F.col("opp"), "left")
        .select("sfdcleadid", "cta__c", "trial_call_booked__c", "closedate", "stagename", "iswon")
    )
