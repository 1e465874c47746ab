"""Channel classification of touches.

A channel is a list of alternatives; an alternative is a set of column tests that
must all hold. The rule set is data, so another site can change names, patterns
and lists without touching the operator.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import all_of, any_of
from touchline.functions.times import ts

# Columns that rules match without regard to case; each is put in lower case once per touch.
FOLDED = ("utm_medium", "utm_campaign", "landing_page")


@dataclass(frozen=True)
class Text:
    """A column as it is and, where rules need it, in lower case."""

    exact: Column
    lower: Column


def text(name: str) -> Text:
    return Text(F.col(name), F.col(f"__lower_{name}" if name in FOLDED else name))


Test = Callable[[Text], Column]


def equals(value: str) -> Test:
    return lambda t: t.exact == value


def differs(value: str) -> Test:
    return lambda t: t.exact != value


def among(*values: str) -> Test:
    return lambda t: t.exact.isin(*values)


def like(*patterns: str) -> Test:
    """Matches one of the patterns, in any case."""
    return lambda t: any_of([t.lower.like(p.lower()) for p in patterns])


def unlike(*patterns: str) -> Test:
    """Matches none of the patterns, in any case; unknown for NULL."""
    return lambda t: all_of([~t.lower.like(p.lower()) for p in patterns])


def either(*tests: Test) -> Test:
    return lambda t: any_of([test(t) for test in tests])


def both(*tests: Test) -> Test:
    return lambda t: all_of([test(t) for test in tests])


def absent(t: Text) -> Column:
    return t.exact.isNull()


def without_text(*texts: str) -> Test:
    """Contains none of the texts, in exactly this case; unknown for NULL."""
    return lambda t: all_of([~t.exact.contains(part) for part in texts])


Alternative = Mapping[str, Test]


def matches(alternatives: Sequence[Alternative]) -> Column:
    return any_of([all_of([test(text(name)) for name, test in alt.items()]) for alt in alternatives])


@dataclass(frozen=True)
class ChannelSettings:
    """Site-specific values of the channel rules."""

    content_sections: tuple[str, ...] = ("%site.example/blog%", "%site.example/syllabus%")
    content_words: tuple[str, ...] = ("%blog%", "%syllabus%")
    careers: str = "%/careers%"
    # Pages that counted as content up to a date, before they moved.
    legacy_pages: tuple[str, ...] = (
        "site.example/ecommerce/",
        "site.example/fitness/",
        "site.example/healthcare/",
        "site.example/ecommerce/how-to-reduce-shipping-costs/",
        "site.example/ecommerce/omnichannel-retailing-guide/",
        "site.example/ecommerce/sales-tax-guide-online-sellers/",
        "site.example/ecommerce/sales-tax-nexus-guide/",
        "site.example/ecommerce/subscription-box-business/",
        "site.example/ecommerce/tax-deductions-ecommerce/",
        "site.example/ecommerce/sales-tax-basics/",
        "site.example/fitness/how-to-find-more-clients-crossfit/",
        "site.example/healthcare/tax-reductions-therapists/",
    )
    legacy_until: str = "2024-01-15"
    brand_campaign: str = "Bing - Search Brand USA (Engine)"
    non_brand_campaign: str = "Bing - Search Non-Brand USA (Engine)"
    prospecting_campaign: str = "us_prospecting_linkedIn_rd"
    rival: str = "quickbooks"
    local_listing: str = "%gmb%"
    not_direct_sources: tuple[str, ...] = ("dribbble", "producthunt", "google", "financesonline", "hustle")
    direct_mediums: tuple[str, ...] = ("partner", "referral", "GuestPost", "guestpost", "Guide", "article")


# Fixed values of the touch table.
PAID, OTHER, ORGANIC = "GROWTH & PAID", "OTHER", "ORGANIC"
ENGINES = ("GOOGLE", "BING", "OTHER")
ORGANIC_ENGINES = ("GOOGLE", "BING", "UNIDENTIFIABLE SEARCH ENGINE", "SYLLABUS")

PAID_CHANNELS = (
    "facebook", "branded_search", "non_branded_search", "display", "youtube", "reddit", "podcast",
    "competitor", "other_gp",
)
OWNED_CHANNELS = ("search", "social", "email")
REST_CHANNELS = ("direct", "unknown", "direct_social")
SEARCH_SPLITS = ("google", "bing", "other_search")


@dataclass(frozen=True)
class ChannelRules:
    """The channels as lists of alternatives, for one site's settings."""

    settings: ChannelSettings = field(default_factory=ChannelSettings)
    # With any organic source the visit counts as core, not only with a search engine.
    any_organic_core: bool = False

    def paid(self) -> dict[str, list[Alternative]]:
        s = self.settings
        paid, other, plain = equals(PAID), equals(OTHER), equals(OTHER)
        paid_or_other, engine = among(PAID, OTHER), among(*ENGINES)
        click = equals("cpc")
        rivals = ("%competitor%", f"%{s.rival}%")
        # The underscore in these patterns stands for any character.
        brand, non_brand = like("%_brand%"), like("%_nonbrand%")
        rival_tag = ("%_competitor%", f"%_{s.rival}%")
        return {
            "facebook": [
                {"medium": paid, "submedium": plain, "source": equals("FACEBOOK"),
                 "utm_campaign": unlike("%awareness%")},
            ],
            "branded_search": [
                {"medium": paid_or_other, "submedium": equals("BRANDED SEARCH"), "utm_medium": unlike("%display%")},
                {"medium": paid_or_other, "submedium": plain, "source": engine, "utm_medium": click,
                 "utm_campaign": both(either(brand, equals(s.brand_campaign)), unlike("%_nonbrand%"),
                                      differs(s.non_brand_campaign))},
            ],
            "non_branded_search": [
                {"medium": paid_or_other, "submedium": equals("NON-BRANDED SEARCH"), "utm_medium": click,
                 "utm_campaign": both(non_brand, unlike(*rivals))},
                {"medium": paid_or_other, "submedium": plain, "source": engine, "utm_medium": click,
                 "utm_campaign": both(either(non_brand, equals(s.non_brand_campaign)), unlike(*rivals))},
            ],
            "display": [
                {"medium": paid_or_other, "submedium": equals("DISPLAY")},
                {"source": differs("YOUTUBE"), "submedium": plain, "utm_medium": like("%display%")},
                {"medium": paid, "submedium": plain, "source": equals("FACEBOOK"),
                 "utm_campaign": like("%awareness%")},
            ],
            "youtube": [{"medium": paid, "source": equals("YOUTUBE"), "submedium": differs("COMPETITOR")}],
            "reddit": [{"medium": paid, "source": equals("REDDIT")}],
            "podcast": [
                {"medium": paid, "submedium": equals("PODCAST"),
                 "landing_page": either(absent, unlike(s.careers))},
            ],
            "competitor": [{"medium": paid_or_other, "utm_campaign": like(*rival_tag)}],
            "other_gp": [
                {"medium": paid, "source": equals("CAPTERRA")},
                {"medium": paid, "submedium": plain, "source": equals("QUORA")},
                {"medium": paid, "submedium": plain, "source": engine, "utm_medium": like("cpc"),
                 "utm_campaign": either(absent, unlike("%_nonbrand%", "%_brand%", *rival_tag))},
                {"medium": other, "submedium": plain, "source": among("OTHER", "BING"), "utm_medium": click,
                 "utm_campaign": unlike("%brand%")},
                {"medium": other, "submedium": plain, "source": equals("LINKEDIN"), "utm_medium": click,
                 "utm_campaign": equals(s.prospecting_campaign)},
                {"medium": other, "submedium": plain, "source": equals("GOOGLE"),
                 "utm_campaign": like(s.local_listing)},
            ],
        }

    def owned(self) -> dict[str, list[Alternative]]:
        s = self.settings
        other, plain = equals(OTHER), equals(OTHER)
        words = like(*s.content_words)
        video = among("GOOGLE", "OTHER", "YOUTUBE")
        return {
            "social": [
                {"medium": equals(ORGANIC), "utm_medium": like("social"), "landing_page": words},
                {"medium": other, "source": video, "utm_medium": like("%social%"), "landing_page": words},
            ],
            "email": [
                {"medium": equals("E-MAIL")},
                {"medium": other, "utm_medium": either(like("email"), equals("marketing_email"))},
            ],
            "direct": [
                {"medium": equals("DIRECT")},
                {"medium": equals(ORGANIC), "submedium": plain, "source": equals("CAPTERRA")},
                {"medium": equals(ORGANIC), "submedium": plain, "landing_page": like(s.careers)},
                {"medium": other, "submedium": plain, "source": among("OTHER", "SHOPIFY"),
                 "utm_medium": either(absent, among(*s.direct_mediums)),
                 "utm_source": either(absent, without_text(*s.not_direct_sources))},
            ],
            "unknown": [{"medium": equals("UNKNOWN")}],
            "direct_social": [
                {"medium": equals(ORGANIC), "utm_medium": like("%social%"),
                 "landing_page": unlike(*s.content_words)},
                {"medium": other, "source": video, "utm_medium": like("%social%"),
                 "landing_page": unlike(*s.content_words)},
            ],
        }

    def _content_page(self, period: Column) -> Column:
        """Landing page belongs to the content part of the site in that period."""
        s = self.settings
        page = F.col("landing_page")
        section = any_of([page.like(p) for p in s.content_sections])
        return section | ((period <= ts(s.legacy_until)) & page.isin(*s.legacy_pages))

    def _organic(self, any_source: bool) -> Column:
        not_social = F.coalesce(text("utm_medium").lower, F.lit("")) != "social"
        organic = (F.col("medium") == ORGANIC) & not_social
        return organic if any_source else organic & F.col("source").isin(*ORGANIC_ENGINES)

    def search_core(self, period: Column) -> Column:
        """Organic visit that lands on the core part of the site (needs ``fold_case``)."""
        on_careers = like(self.settings.careers)(text("landing_page"))
        return self._organic(self.any_organic_core) & ~self._content_page(period) & ~on_careers

    def search_content(self, period: Column) -> Column:
        """Organic visit that lands on the content part of the site."""
        promoted = matches(
            [{"medium": equals(OTHER), "submedium": equals(OTHER), "source": equals("GOOGLE"),
              "utm_campaign": like("notb")}]
        )
        return (self._organic(False) | promoted) & self._content_page(period)


def fold_case(df: DataFrame) -> DataFrame:
    """Add the lower-case columns the rules read."""
    return df.withColumns({f"__lower_{c}": F.lower(c) for c in FOLDED})


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def channel_flags(df: DataFrame, period: str, rules: ChannelRules | None = None) -> DataFrame:
    """Add one 0/1 column per channel, the search splits and ``total``.

    Flags are not exclusive: ``total`` tells how many channels a touch falls in.
    ``period`` is the column compared with the date the legacy pages moved.
    """
    rules = rules or ChannelRules()
    at = F.col(period)
    flags = {name: matches(alternatives) for name, alternatives in {**rules.paid(), **rules.owned()}.items()}
    flags["search_core"] = rules.search_core(at)
    flags["search_content"] = rules.search_content(at)
    df = fold_case(df).withColumns({name: _flag(cond) for name, cond in flags.items()})

    searched = F.col("search_core") + F.col("search_content") == 1
    source = F.col("source")
    df = df.withColumns(
        {
            "search": _flag(searched),
            "google": _flag(searched & (source == "GOOGLE")),
            "bing": _flag(searched & (source == "BING")),
            "other_search": _flag(searched & ~source.isin("GOOGLE", "BING")),
        }
    )
    parts = [F.col(c) for c in (*PAID_CHANNELS, *OWNED_CHANNELS, *REST_CHANNELS)]
    return df.withColumn("total", sum(parts[1:], parts[0])).drop(*[f"__lower_{c}" for c in FOLDED])


def channel_rollup(df: DataFrame, period: str, flags: Sequence[str]) -> DataFrame:
    """Touches per period and channel."""
    return df.groupBy(period).agg(*[F.sum(f).cast("bigint").alias(f) for f in flags])


# How channels of the attribution table group for reporting.
CHANNEL_GROUPS = {
    "Paid": (
        "other_gp", "display", "competitor", "youtube", "non_branded_search", "branded_search", "podcast",
        "facebook", "reddit",
    ),
    "Inbound": ("email", "search_content", "search_core", "social"),
}


def channel_group(channel: Column, groups: Mapping[str, Sequence[str]] = CHANNEL_GROUPS) -> Column:
    """Name of the group a channel belongs to, or the channel itself."""
    member = [F.when(channel.isin(*names), F.lit(group)) for group, names in groups.items()]
    return F.coalesce(*member, channel)
