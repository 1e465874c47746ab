"""Experiment reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import all_of, external
from touchline.functions.times import local_since, to_pacific, to_utc, trunc, ts
from touchline.operators.experiment import several_variants, single_device, single_variant
from touchline.operators.funnel import LeadDefinition, funnel_counts
from touchline.operators.joins import join_groups, least_row, null_safe_join, numbered, star_left_join
from touchline.operators.identity import (
    Key,
    distinct_times_since,
    distinct_values,
    fold_case,
    identity_join,
    keyed,
    pattern_pairs,
    to_patterns,
)
from touchline.operators.touch import last_page_before, session_flags, true_flags
from touchline.session import materialise

Tables = Mapping[str, DataFrame]

INTERNAL = ("%corp.example%", "%test%", "%ignore%")
OWN_AND_TEST = ("%corp.example%", "%test%")

CORE_PAGES = (
    "/", "/how-it-works/", "/catch-up-bookkeeping-services/", "/pricing/", "/small-business-bookkeeping-services/",
    "/small-business-tax/", "/small-business-financial-reports/", "/small-business-bookkeeping-software/",
    "/faq/", "/customer-reviews/", "/about/",
)


def ab_session_last_page(
    tables: Tables,
    *,
    start: str = "1996-09-01",
    core_pages: Sequence[str] = CORE_PAGES,
    paid_page: str = "/go/bookkeepers/",
    signup_title: str = "Funnel 2.0%",
    experiments: Mapping[str, str] | None = None,
) -> DataFrame:
    """Last core, blog or paid page of each session before its last sign-up page, and what followed."""
    experiments = experiments or {
        "core_experiment": "experiment_a",
        "blog_experiment": "experiment_b",
        "paid_control_experiment": "experiment_c",
        "paid_variation_experiment": "experiment_d",
    }
    time, path = F.col("time"), F.col("path")
    local = to_pacific(time)
    signup = path.ilike("%signup%") | F.col("title").ilike(signup_title)
    bucket = (
        F.when((path == paid_page) & (F.col("utm_medium") == "cpc"), "paid")
        .when(path.ilike("%blog%"), "blog")
        .when(path.isin(*core_pages), "core")
        .when(signup, "signup")
    )
    pages = (
        tables["pageviews"]
        .filter(local_since(time, start))
        .select(
            "user_id", "session_id", "path", local.alias("pageview_time"), bucket.alias("bucket"),
            F.coalesce(signup, F.lit(False)).alias("signup_page"),
        )
        .filter(F.col("bucket").isNotNull())
    )
    last = last_page_before(
        pages, ["user_id", "session_id"], "pageview_time", F.col("signup_page"), F.col("bucket") == "signup", ["path"]
    )
    users = tables["web_users"].select(
        F.col("user_id").alias("web_user"), *[F.col(c).alias(n) for n, c in experiments.items()]
    )
    people = tables["identity_map"].select("heap_user_id", "inferred_email", "inferred_person_id")
    leads = tables["lead_data"].select(F.col("client_key").alias("lead_key"), "lead_created_datetime_pstpdt")
    opps = tables["opportunity"].select(
        F.col("client_key").alias("opp_key"), "review_call_booked", "closedate", "stagename"
    )
    crm = tables["crm_lead"].select(F.col("client_key").alias("crm_key"), "team_suf2__c")
    created, day = F.col("lead_created_datetime_pstpdt"), trunc(F.col("pageview_time"), "day")
    named = last.join(users, F.col("user_id") == F.col("web_user"), "left").join(
        people, F.col("user_id") == F.col("heap_user_id"), "left"
    )
    # One person may own very many of these records.
    named = star_left_join(
        materialise(named), "inferred_person_id", {"lead_key": leads, "opp_key": opps, "crm_key": crm}
    )
    return (
        named.select(
            "user_id",
            "session_id",
            "pageview_time",
            "inferred_email",
            F.when(F.col("inferred_email").isNotNull() & created.isNull(), 1).otherwise(0).alias("drop_out"),
            F.when(created >= F.col("pageview_time"), created).alias("lead_datetime_pstpdt"),
            F.when(F.col("review_call_booked") >= day, F.col("review_call_booked")).alias("trial_date"),
            F.when((F.col("closedate") >= day) & (F.col("stagename") == "Client"), F.col("closedate")).alias(
                "client_date"
            ),
            "bucket",
            *experiments,
            "team_suf2__c",
        )
    )


def ab_single_variant(
    tables: Tables,
    *,
    start: str = "1996-05-20",
    experiment: str = "experiment_b",
    page_name: str = "1 - Sign Up Page",
    internal: Sequence[str] = INTERNAL,
    email_match: str = "pattern",
) -> DataFrame:
    """First exposure of users who saw only the control or only the variation, with lead and opportunity."""
    time = F.col("time")
    local = to_pacific(time)
    day = trunc(local, "day").alias("pageview_date")
    people = tables["identity_map"].select("heap_user_id", "inferred_email", "inferred_person_id")

    def identified(df: DataFrame, variation: int) -> DataFrame:
        joined = df.distinct().join(people, F.col("user_id") == F.col("heap_user_id"), "left")
        joined = joined.filter(external(F.col("inferred_email"), internal, keep_null=True))
        return joined.select(
            "pageview_date", "user_id", "inferred_email", "inferred_person_id", F.lit(variation).alias("variation")
        )

    sessions = session_flags(
        tables["pageviews"].filter(local_since(time, start)),
        [F.col("user_id"), F.col("session_id"), day],
        {"blog": F.col("path").ilike("%blog%"), "signup": F.col("path").ilike("%signup%")},
    ).filter(true_flags("blog", "signup"))
    control_users = tables["web_users"].filter(F.col(experiment) == 0).select("user_id")
    control = sessions.select("pageview_date", "user_id").join(control_users, "user_id")
    tool = (
        tables["signup_tool_views"]
        .filter(
            F.col("page_name").ilike(page_name)
            & (F.col("view_name") == page_name)
            & F.col("landing_page").ilike("%blog%")
            & local_since(time, start)
        )
        .select(day, "user_id")
    )
    exposures = identified(control, 0).unionAll(identified(tool, 1)).distinct()
    firsts = single_variant(exposures, ["user_id"], "variation", first_of="pageview_date").select(*exposures.columns)

    clients = tables["client"].select(F.col("id").alias("client_id"), "principalpersonid")
    rows = firsts.join(clients, F.col("inferred_person_id") == F.col("principalpersonid"), "left").drop(
        "principalpersonid"
    )
    rows = numbered(rows)
    leads = tables["lead_data"].select(
        F.col("email").alias("lead_email"), F.col("client_key").alias("lead_key"), "lead_created_datetime_pstpdt",
        F.col("opp_id").alias("lead_opp"),
    )
    with_leads = identity_join(
        rows,
        leads,
        [Key("inferred_email", "lead_email", email_match), Key("client_id", "lead_key")],
        F.col("lead_created_datetime_pstpdt") >= F.col("pageview_date"),
    )
    opps = tables["opportunity"].select(
        F.col("id").alias("opp"), "trial_call_booked__c", to_pacific(F.col("closedate")).alias("closedate_pstpdt"),
        "stagename", "iswon",
    )
    later = (
        (F.col("lead_opp") == F.col("opp"))
        & (F.col("trial_call_booked__c") >= F.col("pageview_date"))
        & (F.col("closedate_pstpdt") >= F.col("pageview_date"))
    )
    dropped = F.col("inferred_email").isNotNull() & F.col("lead_email").isNull()
    return with_leads.join(opps, later, "left").select(
        "pageview_date", "user_id", "client_id", "inferred_person_id", "variation", "lead_created_datetime_pstpdt",
        "trial_call_booked__c", "closedate_pstpdt", "stagename", "iswon",
        F.when(dropped, 1).otherwise(0).alias("dropoff"),
    )


def ab_exposure_attribution(
    tables: Tables,
    *,
    campaign: str = "campaign-x",
    start: str = "1996-05-13",
    internal: Sequence[str] = OWN_AND_TEST,
    email_match: str = "pattern",
) -> DataFrame:
    """First view of users exposed to one variant, with a lead created and a call booked since."""
    local = to_pacific(F.col("time"))
    people = tables["identity_map"].select("heap_user_id", "inferred_email")
    views = (
        tables["experiment_views"]
        .filter((F.lower("campaignid") == campaign.lower()) & local_since(F.col("time"), start))
        .select("user_id", local.alias("pageview_date"), "experimentvariant")
        .distinct()
        .join(people, F.col("user_id") == F.col("heap_user_id"), "left")
        .drop("heap_user_id")
        .filter(external(F.col("inferred_email"), internal, keep_null=True))
        .withColumn(
            "clean_variant",
            F.when(F.col("experimentvariant") == "control", 0).when(F.col("experimentvariant") == "test", 1),
        )
    )
    firsts = single_variant(views, ["user_id"], "clean_variant", first_of="pageview_date")
    firsts = numbered(firsts.withColumnRenamed("min_exposure", "min_pageview").distinct())
    leads = tables["lead_attributions"].select(
        F.col("email").alias("lead_email"), F.col("opportunity_id").alias("lead_opp"), "lead_created_datetime_pstpdt"
    )
    with_leads = identity_join(
        firsts,
        leads,
        [Key("inferred_email", "lead_email", email_match)],
        F.col("lead_created_datetime_pstpdt") >= F.col("pageview_date"),
    )
    opps = tables["opportunity"].select(
        F.col("id").alias("opp"), "trial_call_booked__c", to_pacific(F.col("closedate")).alias("closedate"),
        "stagename", "iswon",
    )
    later = (F.col("lead_opp") == F.col("opp")) & (F.col("trial_call_booked__c") >= F.col("pageview_date"))
    return (
        with_leads.join(opps, later, "left")
        .select(
            "pageview_date", "experimentvariant", "user_id", "inferred_email", "lead_created_datetime_pstpdt",
            "trial_call_booked__c", "closedate", "stagename", "iswon", "clean_variant", "min_variant",
            "max_variant", "min_pageview",
        )
        .distinct()
    )


# --- funnel by variation and device ---------------------------------------------------

_KINDS = ("key_kind", "key")
_DISTINCT = {"viewers": ("user_id", None), "dropouts": ("first_dropout_id", None), "leads": ("first_lead_id", None)}


def _known_leads(tables: Tables, start: str) -> DataFrame:
    """Leads created since the start, with their CRM address and whether a call was booked."""
    crm = tables["crm_lead"].select(F.col("id").alias("crm_id"), F.col("email").alias("crm_email"))
    opps = tables["opportunity"].select(F.col("id").alias("opp"), "review_call_booked_boolean__c")
    return (
        tables["lead_data"]
        .filter(F.col("actual_date_created__c") >= ts(start))
        .join(crm, F.col("id") == F.col("crm_id"), "left")
        .join(opps, F.col("opp_id") == F.col("opp"), "left")
        .select(
            "id", "client_key", "email", "crm_email", "opp_id", "won_mrr", "catch_up_only_team__c",
            F.col("actual_date_created__c").alias("created"),
            F.when(F.col("review_call_booked_boolean__c"), 1).otherwise(0).alias("trial"),
        )
    )


def _dropouts(tables: Tables, leads: DataFrame, definition: LeadDefinition) -> DataFrame:
    """CRM records that meet the lead definition but never became a known lead."""
    known = leads.select(F.col("id").alias("lead_id"))
    return (
        tables["crm_lead"]
        .filter(definition.qualified())
        .join(known, F.col("id") == F.col("lead_id"), "left_anti")
        .select("id", "client_key", "email", F.col("actual_date_created__c").alias("created"))
    )


def _home_views(tables: Tables, time_bound: Column, path: str) -> DataFrame:
    """The days each user saw the page, with the smallest and largest device name of the day."""
    day = trunc(to_pacific(F.col("time")), "day").alias("view_day")
    pages = tables["pageviews"].filter((F.col("path") == path) & time_bound)
    return pages.groupBy("user_id", day).agg(
        F.min("device_type").alias("device"), F.max("device_type").alias("last_device")
    )


def _single_device_viewers(views: DataFrame) -> DataFrame:
    """Users who saw the page on exactly one device, with that device and their view days."""
    return single_device(
        views, ["user_id"], "device", "last_device", since=F.min("view_day"), last_view=F.max("view_day")
    )


def _by_key_and_day(
    records: DataFrame, keys: Sequence[tuple[str, str]], *values: Column, fold: str | None = None
) -> DataFrame:
    """Records reduced to one row per identity key and day created.

    A view day is compared with a creation time, which is the same as comparing
    days; so however many records share a key, it has one row per day here.
    """
    columns = {k for _, k in keys}
    rows = keyed(records, [c for c in records.columns if c not in columns], keys)
    rows = fold_case(rows, fold) if fold else rows
    return rows.groupBy(*_KINDS, trunc(F.col("created"), "day").alias("day")).agg(
        least_row([F.col("created"), F.col("id")]).alias("first"), *values
    )


def _since(people: DataFrame, by_day: DataFrame, *values: Column) -> DataFrame:
    """Per user, the first record and further aggregates over records since the user's first view.

    ``people`` has ``user_id``, ``since`` and the identity keys. Users who share a
    key and a first day share one lookup.
    """
    asked = people.select(*_KINDS, "since").distinct()
    found = (
        asked.join(by_day, [*_KINDS])
        .filter(F.col("day") >= F.col("since"))
        .groupBy(*_KINDS, "since")
        .agg(F.min("first").alias("first"), *values)
    )
    users = join_groups(people, found, [*_KINDS, "since"], "inner").groupBy("user_id")
    return users.agg(F.min("first").getField("id").alias("first_id"), *values)


def _lead_values() -> list[Column]:
    return [F.max("won_mrr").alias("won_mrr"), F.max("trial").alias("trial")]


def ab_funnel_ilike(
    tables: Tables,
    *,
    start: str = "1996-02-26",
    experiment: str = "experiment_a",
    path: str = "/",
    demo_path: str = "%request-a-demo%",
    demo_variation: int = 2,
    internal: Sequence[str] = OWN_AND_TEST,
    definition: LeadDefinition | None = None,
    email_match: str = "pattern",
) -> DataFrame:
    """Dropouts, viewers, leads, trials, clients and demos by variation and device.

    Viewers of the page on a single device are matched to leads by client id or by
    address. A person counts once per address and demo flag.
    """
    definition = definition or LeadDefinition()
    sample = (
        tables["web_users"]
        .filter(F.col(experiment).isNotNull())
        .select("user_id", "id", F.col("_email").alias("email"), F.col(experiment).alias("variation_id"))
    )
    persons = tables["person"].select(F.col("id").alias("person_id"), F.col("email").alias("person_email"))
    clients = tables["client"].select(F.col("id").alias("client_id"), "principalpersonid")
    email, person_email = F.col("email"), F.col("person_email")
    outside = all_of([external(c, internal, keep_null=False, match_case=True) for c in (person_email, email)])
    people = (
        sample.join(persons, F.col("id") == F.col("person_id"), "left")
        .filter(person_email.isNull() | email.isNull() | outside)
        .join(clients, F.col("person_id") == F.col("principalpersonid"), "left")
        .select("user_id", "variation_id", "email", "person_email", "client_id")
    )
    views = _home_views(tables, local_since(F.col("time"), start, "day"), path)
    people = materialise(people.join(_single_device_viewers(views), "user_id"))

    leads = materialise(_known_leads(tables, start))
    dropouts = materialise(_dropouts(tables, leads, definition))
    keys = keyed(people, ["user_id", "since"], [("client", "client_id"), ("email", "email"), ("email", "person_email")])
    addresses = distinct_values((leads, "crm_email"), (dropouts, "email"))
    fold = None
    if email_match == "pattern":
        texts = distinct_values((people, "email"), (people, "person_email"))
        keys = to_patterns(keys, pattern_pairs(texts, addresses), "email")
    else:
        fold = "email"
        keys = fold_case(keys, fold)
    lead_keys = [("client", "client_key"), ("email", "crm_email")]
    lead_days = _by_key_and_day(leads.drop("email", "opp_id"), lead_keys, *_lead_values(), fold=fold)
    dropout_days = _by_key_and_day(dropouts, [("client", "client_key"), ("email", "email")], fold=fold)
    by_lead = _since(keys, lead_days, *_lead_values()).withColumnRenamed("first_id", "first_lead_id")
    by_dropout = _since(keys, dropout_days).withColumnRenamed("first_id", "first_dropout_id")

    # A view pairs with every form of its user on the same day or later, or with none. Which demo
    # flags that gives follows from the extreme days alone.
    is_demo = F.coalesce(F.col("path").ilike(demo_path), F.lit(False))
    day = trunc(to_pacific(F.col("time")), "day")
    forms = tables["demo_form_events"].groupBy("user_id").agg(
        F.max(day).alias("last_form"),
        F.max(F.when(is_demo, day)).alias("last_demo"),
        F.max(F.when(~is_demo, day)).alias("last_other"),
    )
    in_demo = F.col("variation_id") == demo_variation
    shown = in_demo & (F.col("last_demo") >= F.col("since"))
    not_shown = (
        ~in_demo
        | F.col("last_form").isNull()
        | (F.col("last_view") > F.col("last_form"))
        | (F.col("last_other") >= F.col("since"))
    )
    flags = F.filter(F.array(F.when(shown, 1), F.when(not_shown, 0)), lambda x: x.isNotNull())
    rows = (
        people.join(forms, "user_id", "left")
        .select("user_id", "person_email", "variation_id", "device", F.explode(flags).alias("demo"))
        .distinct()
        .join(by_lead, "user_id", "left")
        .join(by_dropout, "user_id", "left")
    )
    return (
        funnel_counts(
            rows,
            ["variation_id", "device"],
            _DISTINCT,
            {
                "trials": F.coalesce("trial", F.lit(0)),
                "clients": F.when(F.col("won_mrr").isNotNull(), 1).otherwise(0),
                "demos": F.col("demo"),
            },
        )
        .select("variation_id", "device", "dropouts", "viewers", "leads", "trials", "clients", "demos")
        .orderBy(F.col("variation_id").asc_nulls_last(), F.col("device").asc_nulls_last())
    )


def _rows_per_person(
    people: DataFrame, views: DataFrame, leads: DataFrame, lead_keys: Sequence[tuple[str, str]],
    retro: DataFrame, retro_keys: Sequence[tuple[str, str]], person_keys: Sequence[tuple[str, str]],
) -> DataFrame:
    """How many distinct (address, returning flag, view day, lead creation time) each user and variation has.

    A view day without a later lead counts as one row without a creation time. People
    with the same addresses and client are one profile; a user has a group of profiles
    per variation, address and flag. Creation times are counted per group and day, and
    never listed per person.
    """
    profile = ["client_id", "person_email", "email"]
    profiles = people.select(*profile).distinct()
    profile_keys = keyed(profiles, profile, person_keys).distinct()
    returning = (
        join_groups(profile_keys, keyed(retro, [], retro_keys).distinct(), [*_KINDS], "left_semi")
        .select(*profile).distinct().withColumn("returning", F.lit(1))
    )
    profiles = null_safe_join(profiles, returning, profile, "left").fillna(0, ["returning"])
    times = keyed(leads, ["created"], lead_keys).distinct()

    group = ["user_id", "variation_id", "person_email", "returning"]
    rest = [c for c in profile if c not in group]
    members = null_safe_join(people.select("user_id", "variation_id", *profile).distinct(), profiles, profile)
    members = materialise(members.select(*group, *rest))

    # A time found through two profiles of a group counts once, and a view day has a row without a
    # time as soon as one profile has no later lead.
    group_keys = keyed(members, group, person_keys).distinct()
    group_days = members.select(*group).distinct().join(views.select("user_id", "view_day"), "user_id")
    matched = distinct_times_since(group_keys, group_days, times, group)
    key_ends = times.groupBy(*_KINDS).agg(F.max(trunc(F.col("created"), "day")).alias("last_day"))
    profile_ends = join_groups(profile_keys, key_ends, [*_KINDS], "inner").groupBy(*profile).agg(F.max("last_day").alias("last_day"))
    ends = (
        null_safe_join(members, profile_ends, profile, "left")
        .groupBy(*group)
        .agg(F.min("last_day").alias("earliest_end"), F.bool_or(F.col("last_day").isNull()).alias("never"))
    )
    unmatched = null_safe_join(group_days, ends, group).filter(
        F.col("never") | (F.col("view_day") > F.col("earliest_end"))
    )
    parts = matched.select("user_id", "variation_id", "n").unionAll(
        unmatched.select("user_id", "variation_id", F.lit(1).cast("bigint").alias("n"))
    )
    return parts.groupBy("user_id", "variation_id").agg(F.sum("n").alias("rows"))


def ab_funnel_exclusions(
    tables: Tables,
    *,
    start: str = "1996-11-15",
    experiment: str = "experiment_b",
    path: str = "/",
    internal: Sequence[str] = OWN_AND_TEST,
    retro_record_type: str = "RT_RETRO",
    definition: LeadDefinition | None = None,
    strict_exclusions: bool = False,
    per_user: bool = False,
) -> DataFrame:
    """Dropouts, viewers, leads, trials and clients by variation and device, by equal addresses.

    Addresses that saw several variations are excluded, but people with only one of
    the two addresses are kept regardless; ``strict_exclusions`` excludes those too.
    Trials and clients are summed over a person's distinct view days and lead dates;
    ``per_user`` counts each user once.
    """
    definition = definition or LeadDefinition()
    sample = (
        tables["web_users"]
        .filter(F.col(experiment).isNotNull())
        .select("user_id", F.col("_email").alias("email"), F.col(experiment).alias("variation_id"))
    )
    excluded = several_variants(sample, "email", "variation_id").toDF("excluded")
    people_map = tables["identity_map"].select(
        "heap_user_id", F.col("inferred_person_id").alias("person_id"),
        F.lower("inferred_email").alias("person_email"),
    )
    clients = tables["client"].select(F.col("id").alias("client_id"), "principalpersonid")
    email, person_email = F.col("email"), F.col("person_email")
    people = sample.join(people_map, F.col("user_id") == F.col("heap_user_id"), "left")
    people = people.join(excluded.toDF("bad_email"), email == F.col("bad_email"), "left")
    people = people.join(excluded.toDF("bad_person"), person_email == F.col("bad_person"), "left")
    several = F.col("bad_email").isNotNull() | F.col("bad_person").isNotNull()
    outside = all_of([external(c, internal, keep_null=False, match_case=True) for c in (person_email, email)])
    kept = person_email.isNull() | email.isNull() | (outside & ~several)
    if strict_exclusions:
        kept = kept & ~several
    people = (
        people.filter(kept)
        .join(clients, F.col("person_id") == F.col("principalpersonid"), "left")
        .select("user_id", "variation_id", "email", "person_email", "client_id")
    )
    views = _home_views(tables, F.col("time") >= to_utc(ts(start)), path)
    views = materialise(views)
    people = materialise(people.join(_single_device_viewers(views), "user_id"))

    leads = materialise(_known_leads(tables, start))
    dropouts = (
        _dropouts(tables, leads, definition)
        .filter(F.col("created") >= ts(start))
        .withColumn("email", F.lower("email"))
    )
    # "crm" keys meet the CRM address of a lead, "own" keys its own address.
    person_keys = [("client", "client_id"), ("crm", "person_email"), ("crm", "email"), ("own", "person_email")]
    lead_keys = [("client", "client_key"), ("crm", "crm_email"), ("own", "email")]
    either_keys = [("client", "client_id"), ("any", "person_email"), ("any", "email")]
    record_keys = [("client", "client_key"), ("any", "email")]
    lead_days = _by_key_and_day(leads.drop("opp_id"), lead_keys, *_lead_values())
    dropout_days = _by_key_and_day(dropouts, record_keys)
    to_leads = keyed(people, ["user_id", "since"], person_keys)
    to_dropouts = keyed(people, ["user_id", "since"], either_keys)
    by_lead = _since(to_leads, lead_days, *_lead_values()).withColumnRenamed("first_id", "first_lead_id")
    by_dropout = _since(to_dropouts, dropout_days).withColumnRenamed("first_id", "first_dropout_id")

    rows = (
        people.select("user_id", "variation_id", "device").distinct()
        .join(by_lead, "user_id", "left")
        .join(by_dropout, "user_id", "left")
    )
    if per_user:
        rows = rows.withColumn("rows", F.lit(1).cast("bigint"))
    else:
        # Only people with a trial or a value add to the sums.
        by_lead = materialise(by_lead)
        counted = by_lead.filter("trial = 1 OR won_mrr IS NOT NULL").select("user_id")
        retro_opps = tables["opportunity"].filter(
            (F.col("stagename") == "Onboarded with Retro") & (F.col("recordtypeid") == retro_record_type)
        )
        retro = leads.filter("catch_up_only_team__c").join(
            retro_opps.select(F.col("id").alias("opp_id")), "opp_id", "left_semi"
        )
        inflation = _rows_per_person(
            people.join(counted, "user_id", "left_semi"),
            views.join(counted, "user_id", "left_semi"),
            leads, lead_keys, retro, [("client", "client_key"), ("own", "email"), ("crm", "email")], person_keys,
        )
        rows = rows.join(inflation, ["user_id", "variation_id"], "left")
    return (
        funnel_counts(
            rows,
            ["variation_id", "device"],
            _DISTINCT,
            {
                "trials": F.when(F.col("trial") == 1, F.col("rows")).otherwise(0),
                "clients": F.when(F.col("won_mrr").isNotNull(), F.col("rows")).otherwise(0),
            },
        )
        .select("variation_id", "device", "dropouts", "viewers", "leads", "trials", "clients")
        .orderBy(F.col("variation_id").asc_nulls_last(), F.col("device").asc_nulls_last())
    )
