"""Small random logical tables with colliding keys, NULLs, ties and pattern characters.

One value of each pool is drawn a third of the time, so every key has a hot value.
"""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pyarrow as pa

from touchline.sources.schemas import SCHEMAS
from touchline.sources.testdata import CHANNELS, LEAD_SOURCES, MAILINGS, PATHS, TOUCH_SHAPES

ARROW = {
    "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "timestamp_ntz": pa.timestamp("us"),
}


def record_ids(letter: str, n: int) -> list[str]:
    return [f"{letter}{i:014d}AAA" for i in range(n)]


LEADS, OPPS, ACCOUNTS = record_ids("L", 9), record_ids("O", 7), record_ids("A", 12)
CLIENTS = [f"C{i}" for i in range(6)] + ["12", "12a", "1234567890"]
PEOPLE = [f"P{i}" for i in range(6)] + CLIENTS[:3]
MAIL_IDS = [f"M{i}" for i in range(9)]
EMAILS = [
    "hot@x", "user_2@x", "userx2@x", "USER_2@X", "a%@x", "abc@x", "Test1@x", "test2@x", "x@corp.example",
    "shared0@mail.example", "%2@x", "user8@mail.example", "Hot@x",
]
LANDINGS = [
    "site.example/pricing/", "site.example/blog/a/", "site.example/ecommerce/", "site.example/careers",
    "site.example/friends-of-site/", "join.site.example/", "site.example/go/professional-bookkeepers/",
]
DAYS = ["1996-12-31", "1997-03-01", "1997-03-02", "1997-04-06", "2024-01-05", "2024-01-06", "2024-01-14", "2024-02-01"]
TIMES = [datetime.fromisoformat(d) + timedelta(hours=h) for d in DAYS for h in (0, 7, 8, 9, 23)]

POOLS = {
    "user_id": list(range(8)), "heap_user_id": list(range(9)), "session_id": list(range(5)),
    "unique_id": [str(i) for i in range(6)], "total_touch_count": list(range(1, 6)),
    "conversion_credit": [0.5, 1.0], "channel_credit": [0.5, 1.0], "credit_1": [0.5, 1.0], "credit_2": [0.5],
    "conversion_type_id": [1, 2, 3, 4], "channel": [*CHANNELS, "direct"], "channel_1": ["scored", "email"],
    "channel_2": ["social", "direct"], "utm_term": ["kw1", "kw2"], "device_type": ["Desktop", "Mobile"],
    "lead_id": LEADS, "leadid": LEADS, "sfdcleadid": LEADS, "sal_lead_id": LEADS, "opp_id": OPPS,
    "opportunity_id": OPPS, "convertedopportunityid": OPPS, "accountid": ACCOUNTS, "parentid": ACCOUNTS[:3],
    "referring_contact_account_id__c": [a[:15] for a in ACCOUNTS], "client_key": CLIENTS,
    "lead_client_id": CLIENTS, "principalpersonid": PEOPLE, "inferred_person_id": PEOPLE,
    "ls_sal_lead_id": [i[:15] for i in LEADS],
    "_email": EMAILS, "inferred_email": EMAILS, "email": EMAILS, "primary_contact_email__c": EMAILS,
    "landing_page": LANDINGS, "path": [*[p for p in PATHS if p], "/request-a-demo/", "/", "/"],
    "title": ["Funnel 2.0 page", "Page"], "utm_medium": ["cpc", "display", "marketing_email", "social"],
    "utm_source": ["nurture_email", "partner"], "utm_campaign": ["salesnurture", "ads_rd"],
    "utm_content": ["nurturelead", "lead-referral-page"],
    "referrer": ["https://google.example/?q=a", "https://google.example/facebook-ads", "https://y.example/a//", "https://partner.example/", "https://x.example/a?b"],
    "page_name": ["1 - Sign Up Page"], "view_name": ["1 - Sign Up Page", "2"],
    "experimentvariant": ["control", "test", "other"], "campaignid": ["campaign-x", "Campaign-X", "CAMPAIGN_1"],
    "experiment_a": [1, 2], "experiment_b": [0, 1], "experiment_c": [1], "experiment_d": [1],
    "leadsource": [s for s in LEAD_SOURCES if s], "channel_allocation_stamp__c": ["MBC", "Paid"],
    "stagename": ["Client", "Onboarded with Retro", "Open"], "recordtypeid": ["RT_LEAD", "RT_CLIENT", "RT_RETRO"],
    "recordtypeid_lead": ["RT_LEAD", "RT_PARTNER", "RT_OTHER"], "field": ["Lead_Score", "Status"],
    "newvalue__string": ["A", "B"], "oldvalue__string": ["C", "D"], "loss_reason__c": ["Fake lead / account", "Price"],
    "owner_role__c": ["Sales Operations", "Sales"], "test_1__c": ["Tax Info Call", "Demo"],
    "emailinvalid": ["TRUE", "FALSE"], "email_opt_out_formula__c": ["TRUE", "FALSE"],
    "email_opt_out__c": ["True", "yes", "no"], "do_not_contact__c": ["TRUE", "FALSE"],
    "reseller__c": ["TRUE", "FALSE"], "reseller_lead__c": ["TRUE", "FALSE"], "pro_email_opt_out__c": ["TRUE", "FALSE"],
    "account_type__c": ["Vendor", "Client", "Other"], "account_status__c": ["KEEP_UP", "Gone"],
    "country": ["Unknown", "US", "Canada", "AUSTRALIA"], "country__c": ["Unknown", "France"],
    "country__c_account": ["United State", "UnitedxStates"], "inferredcountry": ["united_states", "unitedxstates"],
    "leadsource__c": ["Accountant", "Other"], "primary_attribute_value": list(MAILINGS),
    "primary_attribute_value_id": [2000, 2001], "sent_id": MAIL_IDS, "opened_id": MAIL_IDS, "clicked_id": MAIL_IDS,
    "link": ["/unsub", "/read"], "referrals": [1, 0], "lead_ind": [1, 0],
    "action_type": ["offsite_conversion.fb_pixel_lead", "link_click"], "ad_id": ["1", "2"], "campaign_id": ["1", "2"],
    "adset_id": ["1", "2"], "_sdc_source_key_ad_id": ["1", "2"], "searchimprshare": [10.0, 50.0, 0.0],
    "campaign": ["c1", "c2"], "campaignname": ["c1", "c2"], "adgroupname": ["g1", "g2"],
}

OVERRIDES = {
    "attributions": {"conversion_type": ["LEAD", "TRIAL", "CLIENT", "REVIEW CALL"]},
    "attributions_channel": {"conversion_type": ["lead", "trial", "client", "l_ad"]},
    "attributions_by_channel": {"conversion_type": ["lead", "trial"]},
    "reallocation": {"conversion_type": ["lead", "trial", "client", "review call"]},
    "attributions_translated": {"email": [0.0, 0.5, 1.0]},
    "attributions_crm": {"id": LEADS},
    "fb_insights": {"platform": ["x"]},
    "mail_delivered": {"leadid": MAIL_IDS}, "mail_opened": {"leadid": MAIL_IDS}, "mail_clicked": {"leadid": MAIL_IDS},
    "mail_bounced": {"leadid": MAIL_IDS}, "mail_bounced_soft": {"leadid": MAIL_IDS}, "mail_forms": {"leadid": MAIL_IDS},
    "web_users": {"id": PEOPLE}, "crm_user": {"id": ["U1"]},
    "campaign_member": {"campaignid": ["CAMPAIGN_1", "CAMPAIGN_2"]},
    "account": {"recordtypeid": ["RT_CLIENT", "RT_CLIENT", "RT_OTHER"]},
    "mail_leads": {"recordtypeid": ["RT_LEAD", "RT_PARTNER", "RT_OTHER"]},
    "opportunity": {"recordtypeid": ["RT_NEW", "RT_RETRO", "RT_RETRO"]},
}

# Tables whose first column is a key.
UNIQUE = {
    "touches": list(range(60)), "web_users": list(range(8)), "person": PEOPLE, "client": [*CLIENTS, "D1", "D2"],
    "lead_data": LEADS, "opportunity": OPPS, "crm_lead": LEADS, "account": ACCOUNTS, "mail_leads": MAIL_IDS,
}


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in " ".join(SCHEMAS[table].split()).split(", ")]


def random_tables(seed: int, size: int = 60) -> dict[str, pa.Table]:
    rng = random.Random(seed)

    def draw(pool: list, missing: float):
        if rng.random() < missing:
            return None
        return pool[0] if rng.random() < 0.33 else rng.choice(pool)

    tables = {}
    for table in SCHEMAS:
        columns = columns_of(table)
        n = len(UNIQUE[table]) if table in UNIQUE else size
        values: dict[str, list] = {}
        for i, (name, kind) in enumerate(columns):
            if i == 0 and table in UNIQUE:
                values[name] = list(UNIQUE[table])
                continue
            pool = OVERRIDES.get(table, {}).get(name) or POOLS.get(name)
            if pool is None or (isinstance(pool[0], str) and kind != "string"):
                pool = {
                    "string": ["s1", "s2"], "long": [1, 2, 3], "int": [1, 2], "double": [1.0, 2.5, 4.0],
                    "boolean": [True, False], "timestamp_ntz": TIMES,
                }[kind]
            values[name] = [draw(pool, 0.1) for _ in range(n)]
        if table == "touches":
            shapes = [rng.choice(TOUCH_SHAPES) for _ in range(n)]
            names = ("medium", "submedium", "source", "utm_medium", "utm_source", "utm_campaign", "landing_page")
            for j, name in enumerate(names):
                values[name] = [s[j] for s in shapes]
            for k in range(0, n, 4):
                for name, v in {"utm_medium": "acme", "utm_source": "partner", "utm_campaign": "marketplace",
                                "utm_content": "lead-referral-page"}.items():
                    values[name][k] = v
        schema = pa.schema([(name, ARROW[kind]) for name, kind in columns])
        tables[table] = pa.table(values, schema=schema)
    return tables
