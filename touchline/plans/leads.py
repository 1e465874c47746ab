"""Lead cohorts, milestones, scores and account structure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import short_id
from touchline.functions.times import to_pacific, trunc, ts
from touchline.operators.funnel import LeadDefinition, conversion_rate, funnel_counts, milestones_long, same_month
from touchline.operators.joins import join_groups, split_left_join, with_group_values
from touchline.operators.history import fallback_enrich, nearest_change, sibling_structure

Tables = Mapping[str, DataFrame]


def chat_cohort_funnel(tables: Tables, *, source: str = "Live Chat") -> DataFrame:
    """Leads of one source per month, and how many became trials and clients in the same month."""
    created = F.col("lead_created_datetime_pstpdt")
    opps = tables["opportunity"].select(
        F.col("id").alias("opp"), "trial_call_booked__c", "closedate", "stagename", "iswon"
    )
    leads = tables["lead_data"].filter(F.col("leadsource") == source)
    leads = leads.select("id", "opp_id", "lead_created_datetime_pstpdt")
    won = same_month(created, F.col("closedate")) & (F.col("stagename") == "Client") & F.col("iswon")
    cohort = leads.join(opps, F.col("opp_id") == F.col("opp"), "left").withColumn("month", trunc(created, "month"))
    return funnel_counts(
        cohort,
        ["month"],
        {
            "leads": ("id", None),
            "trials": ("opp", same_month(created, F.col("trial_call_booked__c"))),
            "clients": ("opp", won),
        },
    )


def nurtured_lead_events(tables: Tables) -> DataFrame:
    """Milestones of leads that were nurtured before they became a trial or client, one event per row."""
    crm = tables["crm_lead"].select(
        F.col("id").alias("crm_id"), "nurture_date__c", "re_engagement_datetime__c", "convertedopportunityid"
    )
    opps = tables["opportunity"].select(
        F.col("id").alias("opp_id"), F.col("trial_call_booked__c").alias("trial_date"),
        to_pacific(F.col("closedate")).alias("client_date"), "stagename", "iswon", "isclosed",
    )
    nurtured, again = F.col("nurture_date__c"), F.col("re_engagement_datetime__c")
    trial, client = F.col("trial_date"), F.col("client_date")
    leads = (
        tables["lead_data"]
        .select(F.col("id").alias("lead_id"), F.col("lead_created_datetime_pstpdt").alias("lead_date"))
        .join(crm.filter(nurtured.isNotNull()), F.col("lead_id") == F.col("crm_id"))
        .join(opps, F.col("convertedopportunityid") == F.col("opp_id"), "left")
        .filter(((nurtured < trial) | trial.isNull()) & ((nurtured < client) | client.isNull()))
        .withColumn("reengaged", F.when(again > nurtured, 1).otherwise(0))
    )
    return milestones_long(
        leads,
        ["lead_id", "opp_id"],
        ["reengaged"],
        {
            "nurture": ("nurture_date__c", None),
            "reengagement": ("re_engagement_datetime__c", None),
            "lead": ("lead_date", None),
            "trial": ("trial_date", None),
            "client": ("client_date", (F.col("stagename") == "Client") & F.col("iswon") & F.col("isclosed")),
        },
    )


def score_at_assignment(
    tables: Tables,
    *,
    start: str = "1995-04-01",
    field: str = "%score%",
    excluded_cta: str = "%Tax Info Call%",
) -> DataFrame:
    """Leads, trials and clients by the score a lead had when it was assigned.

    Where a lead qualified after its assignment, the time it qualified counts.
    """
    dates = {
        name: to_pacific(F.col(name))
        for name in (
            "lead_assignment_date__c", "first_lead_assignment_date__c", "mql_first_date_time__c",
            "mql_last_date_time__c",
        )
    }
    assigned = F.coalesce("lead_assignment_date__c", "first_lead_assignment_date__c")
    qualified = F.coalesce("mql_first_date_time__c", "mql_last_date_time__c")
    crm = tables["crm_lead"].select(
        short_id(F.col("id")).alias("crm_short"),
        F.col("test_1__c").alias("cta"),
        *[c.alias(n) for n, c in dates.items()],
    )
    anchors = (
        tables["scored_funnel"]
        .filter(F.col("ls_sal_lead_conversion") >= ts(start))
        .join(crm, F.col("ls_sal_lead_id") == F.col("crm_short"))
        .select(
            "ls_sal_lead_id", "cta",
            F.when(assigned < qualified, qualified).otherwise(assigned).alias("anchor"),
            *[
                F.when(F.col(f"ls_sal_{stage}_conversion").isNotNull(), 1).otherwise(0).alias(f"{stage}s")
                for stage in ("lead", "trial", "client")
            ],
        )
    )
    history = (
        tables["lead_history"]
        .filter(F.col("field").ilike(field))
        .select(
            short_id(F.col("leadid")).alias("history_short"), "newvalue__string", "oldvalue__string",
            to_pacific(F.col("createddate")).alias("score_changed_at"),
        )
    )
    # Leads without an anchor or a change have no distance and drop out, so inner joins do.
    scored = nearest_change(
        anchors.filter(F.col("anchor").isNotNull()).join(history, F.col("ls_sal_lead_id") == F.col("history_short")),
        "ls_sal_lead_id",
        F.col("anchor"),
        F.col("score_changed_at"),
        F.col("oldvalue__string"),
        F.col("newvalue__string"),
        "assignment_lead_score",
    )
    cta = F.col("cta")
    return (
        scored.filter(cta.isNull() | ~cta.ilike(excluded_cta))
        .groupBy("assignment_lead_score")
        .agg(
            conversion_rate(F.col("trials"), F.col("leads")).alias("lt"),
            *[F.sum(c).cast("bigint").alias(c) for c in ("leads", "trials", "clients")],
        )
        .orderBy(F.col("assignment_lead_score").asc_nulls_last())
    )


def account_group_map(
    tables: Tables,
    *,
    record_type: str = "RT_CLIENT",
    follow_up_channel: str = "MBC",
    opportunity_types: Sequence[str] = ("RT_NEW", "RT_RETRO"),
    excluded_sources: Sequence[str] = ("Equity Structure Change", "Test Lead"),
) -> DataFrame:
    """Accounts that share a parent, with channel and source, and an error flag for the whole group.

    Accounts without a closing date take channel and source from a won opportunity.
    Account ids must be unique.
    """
    accounts = tables["account"].filter(F.col("recordtypeid") == record_type)
    parents = accounts.select(F.col("id").alias("parent"))
    children = (
        accounts.filter(F.col("parentid").isNotNull() & F.col("isdeleted").eqNullSafe(False))
        .join(parents, F.col("parentid") == F.col("parent"), "left_semi")
        .select("id", "parentid", "client_key", "name")
    )
    children = with_group_values(children, ["parentid"], total_child=F.count("id"))
    leads = tables["lead_data"].select(
        "accountid", F.col("channel_allocation_stamp__c").alias("channel"), "leadsource", "closedate"
    )
    placed = split_left_join(children, leads, F.col("id") == F.col("accountid")).drop("accountid")
    checked = sibling_structure(placed, "parentid", "client_key", F.col("channel"), follow_up_channel)

    # Only accounts with a row that has no closing date have a fallback; it then applies to all their rows.
    open_accounts = placed.filter(F.col("closedate").isNull()).select(F.col("id").alias("accountid")).distinct()
    stamps = tables["crm_lead"].select(
        F.col("convertedopportunityid").alias("lead_opp"), F.col("channel_allocation_stamp__c").alias("channel")
    )
    won = (
        tables["opportunity"]
        .filter(
            F.col("recordtypeid").isin(*opportunity_types)
            & (F.col("iswon") | (F.col("stagename") == "Client"))
            & ~F.col("leadsource").isin(*excluded_sources)
        )
        .select("id", "accountid", "leadsource")
    )
    won = (
        join_groups(won, open_accounts, ["accountid"], "left_semi")
        .join(stamps, F.col("id") == F.col("lead_opp"), "left")
        .select("id", "accountid", "leadsource", "channel")
        .distinct()
    )
    return (
        fallback_enrich(checked, "id", won, "accountid", ["channel", "leadsource"])
        .select("id", "parentid", "client_key", "name", "total_child", "channel", "leadsource", "closedate", "test")
        .orderBy(F.col("parentid").asc_nulls_last(), F.col("closedate").asc_nulls_last())
    )


def lead_definition_audit(tables: Tables, *, definition: LeadDefinition | None = None) -> DataFrame:
    """The fields that decide whether a CRM record is a lead, with one flag per rule."""
    definition = definition or LeadDefinition()
    flags = {**definition.rules(), "is_lead": definition.qualified()}
    return tables["crm_lead"].select(
        "id", "leadsource", "providedemail__c", "providedcompanydetails__c", "createdaccount__c", "isconverted",
        "status", "recordtypeid", "phone", "loss_reason__c", "owner_role__c", "potential_date__c",
        "converteddate", "isdeleted",
        *[F.when(rule, 1).otherwise(0).alias(name) for name, rule in flags.items()],
    )
