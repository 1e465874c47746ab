"""One row per touch shape, with the flags it must get."""

from __future__ import annotations

import pytest
from conftest import at
from pyspark.sql import functions as F

from touchline.operators.channels import (
    OWNED_CHANNELS,
    PAID_CHANNELS,
    REST_CHANNELS,
    SEARCH_SPLITS,
    ChannelRules,
    channel_flags,
    channel_group,
    channel_rollup,
)
from touchline.sources.testdata import TOUCH_SHAPES

EXPECTED = {
    0: {"facebook"}, 1: {"display"}, 2: set(), 3: {"branded_search"}, 4: {"non_branded_search"},
    5: {"competitor"}, 6: {"non_branded_search"}, 7: {"display", "youtube"}, 8: {"youtube"}, 9: {"reddit"},
    10: {"podcast"}, 11: {"other_gp"}, 12: {"other_gp"}, 13: {"search_core", "search", "google"},
    14: {"search_content", "search", "bing"}, 15: {"search_core", "search", "other_search"}, 16: {"social"},
    17: {"direct_social"}, 18: {"email"}, 19: {"email"}, 20: {"direct"}, 21: {"direct"}, 22: {"unknown"},
    23: set(), 24: set(), 25: {"direct"}, 26: {"direct"}, 27: {"other_gp"}, 28: {"other_gp"},
    29: {"search_content", "search", "google"}, 30: {"display"}, 31: set(),
}
SCHEMA = (
    "shape int, medium string, submedium string, source string, utm_medium string, utm_source string, "
    "utm_campaign string, landing_page string, day timestamp_ntz"
)
FLAGS = (*PAID_CHANNELS, *OWNED_CHANNELS, *REST_CHANNELS, *SEARCH_SPLITS, "search_core", "search_content")


def flagged(make, day: str, rules: ChannelRules | None = None):
    shapes = make(SCHEMA, *[(i, *shape, at(day)) for i, shape in enumerate(TOUCH_SHAPES)])
    found = channel_flags(shapes, "day", rules).collect()
    return {r["shape"]: {f for f in FLAGS if r[f]} for r in found}, {r["shape"]: r["total"] for r in found}


def test_shapes_after_the_pages_moved(make):
    flags, totals = flagged(make, "2024-01-20")
    assert flags == EXPECTED
    assert totals[7] == 2 and totals[2] == 0 and totals[13] == 1


def test_legacy_page_before_the_move(make):
    flags, _ = flagged(make, "2024-01-15")
    assert flags == {**EXPECTED, 15: {"search_content", "search", "other_search"}}


def test_core_with_any_organic_source(make):
    flags, _ = flagged(make, "2024-01-20", ChannelRules(any_organic_core=True))
    assert flags[24] == {"search_core", "search", "other_search"}
    assert {k: v for k, v in flags.items() if k != 24} == {k: v for k, v in EXPECTED.items() if k != 24}


@pytest.mark.parametrize(
    ("changes", "channel", "value"),
    [
        ({"medium": "GROWTH & PAID", "source": "GOOGLE", "utm_medium": "cpc", "utm_campaign": "nonbrand"},
         "branded_search", 1),  # the underscore of %_brand% is any character, %_nonbrand% needs one before
        ({"medium": "OTHER", "source": "OTHER", "utm_medium": None, "utm_source": "Google"}, "direct", 1),
        ({"medium": "OTHER", "source": "OTHER", "utm_medium": None, "utm_source": "google"}, "direct", 0),
        ({"medium": "GROWTH & PAID", "submedium": "PODCAST", "landing_page": None}, "podcast", 1),
        ({"medium": "ORGANIC", "utm_medium": "xsocialx", "landing_page": "site.example/Blog"}, "social", 0),
        ({"medium": "OTHER", "source": "YOUTUBE", "utm_medium": "xSocialx", "landing_page": "a/Blog"}, "social", 1),
        ({"medium": None, "source": None, "submedium": None}, "total", 0),
    ],
)
def test_single_rules(make, changes, channel, value):
    base = {
        "shape": 0, "medium": None, "submedium": "OTHER", "source": "OTHER", "utm_medium": None, "utm_source": None,
        "utm_campaign": None, "landing_page": "site.example/pricing/", "day": at("2024-02-01"),
    }
    row = {**base, **changes}
    df = make(SCHEMA, tuple(row.values()))
    assert channel_flags(df, "day").select(channel).collect()[0][0] == value


def test_rollup_and_group(make):
    df = make("p int, x int, y int", (1, 1, 0), (1, 1, 1), (2, 0, 0))
    assert sorted(map(tuple, channel_rollup(df, "p", ["x", "y"]).collect())) == [(1, 2, 1), (2, 0, 0)]
    names = make("c string", ("reddit",), ("email",), ("direct",), (None,))
    groups = {r[0]: r[1] for r in names.select("c", channel_group(F.col("c"))).collect()}
    assert groups == {"reddit": "Paid", "email": "Inbound", "direct": "direct", None: None}
