from __future__ import annotations

import re

import pytest
from conftest import at, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from touchline.operators.identity import Key, identity_join, ilike_column, pattern_pairs


def ilike(text: str, pattern: str) -> bool:
    """Brute force: backslash makes the next character literal, a final one stands for itself."""
    out, i = "", 0
    pattern = pattern.lower()
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"_": ".", "%": ".*"}.get(c, re.escape(c))
        i += 1
    return re.fullmatch(out, text.lower(), re.S) is not None


TEXTS = ["", "a", "user_2@x", "userx2@x", "USER_2@X", "a%b", "acb", "a\\", "a_", "ab\nc", "übel_1", "übelx1", "aab"]
PATTERNS = [
    "", "a", "user_2@x", "USERX2@x", "a%b", "a\\%b", "%", "_", "__", "%b", "a%", "a\\", "a\\_", "\\a", "a\\\\",
    "ab_c", "übel_1", "%_%", "_%b", "a_b", "%er%2%", "\\\\", "%%", "____2@_",
]


def as_columns(make, texts, patterns):
    return (
        make("text string", *[(t,) for t in sorted(set(texts))]),
        make("pattern string", *[(p,) for p in sorted(set(patterns))]),
    )


def expected(texts, patterns):
    return sorted((t, p) for t in set(texts) for p in set(patterns) if ilike(t, p))


def test_pattern_pairs_against_brute_force(make):
    pairs = pattern_pairs(*as_columns(make, TEXTS, PATTERNS))
    assert sorted(map(tuple, pairs.collect())) == expected(TEXTS, PATTERNS)


def test_pattern_test_on_a_row(make):
    df = make("t string, p string", *[(t, p) for t in TEXTS for p in PATTERNS], (None, "a"), ("a", None))
    hits = df.filter(ilike_column(F.col("t"), F.col("p")))
    assert sorted(map(tuple, hits.collect())) == expected(TEXTS, PATTERNS)


words = st.lists(st.text("aB_%\\.\ue000\ue001\ue002", max_size=5), min_size=1, max_size=25)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=words, patterns=words)
def test_pattern_pairs_random(make, texts, patterns):
    pairs = pattern_pairs(*as_columns(make, texts, patterns))
    assert sorted(map(tuple, pairs.collect())) == expected(texts, patterns)


def test_pattern_pairs_have_no_nested_loop(make):
    plan = pattern_pairs(*as_columns(make, TEXTS, PATTERNS))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


LONG = [f"customer{k:06}@mail.example" for k in range(0, 3_000, 7)] + ["shop-000014", "a000014b", "00014"]
INNER = [f"%{k:0{n}}%" for k in (14, 21, 700) for n in range(2, 9)] + ["%r0000%4@mail%", "customer00_014%", "%@mail.example", "c%e"]


def test_pattern_pairs_by_long_runs(make):
    """Runs of many lengths that share their grams, some of which no text has."""
    pairs = pattern_pairs(*as_columns(make, LONG, INNER))
    assert sorted(map(tuple, pairs.collect())) == expected(LONG, INNER)


def test_shared_grams_cost_no_candidates(spark, make):
    """A thousand patterns that share every gram, met by a thousand texts: places become pairs only where they match."""
    texts = spark.range(1_000).select(F.format_string("aaa%06daaa", "id").alias("text"))
    patterns = spark.range(1_000).select(F.format_string("%%a%06da%%", "id").alias("pattern"))
    pairs = pattern_pairs(texts, patterns)
    tested = pairs.collect()
    assert sorted(tested) == [(f"aaa{k:06}aaa", f"%a{k:06}a%") for k in range(1_000)]
    joins = [n for n in metrics(pairs) if n[0].endswith("Join")]
    assert joins and max(rows for _, rows in joins) <= 30_000


def metrics(df) -> list[tuple[str, int]]:
    """Names and output rows of the operators that ran."""
    out = []

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in node.getClass().getSimpleName():
            return walk(node.plan())
        found = node.metrics().get("numOutputRows")
        if found.isDefined():
            out.append((node.nodeName(), found.get().value()))
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))
        return None

    walk(df._jdf.queryExecution().executedPlan())
    return out


def identities(make):
    left = make(
        "lid int, email string, client string, seen timestamp_ntz",
        (1, "user_2@x", "c1", at("2021-01-05")),
        (2, "USERX2@x", None, at("2021-01-05")),
        (3, None, None, at("2021-01-05")),
        (4, "nobody@x", "c9", at("2021-01-05")),
        (5, "a%b", "c2", None),
        (6, "user_2@x", "c2", at("2021-03-01")),
    )
    right = make(
        "rid int, mail string, client_key string, created timestamp_ntz",
        (10, "user_2@x", "c1", at("2021-01-06")),
        (11, "user_2@x", None, at("2021-01-04")),
        (12, "a%b", "c2", at("2021-02-01")),
        (13, None, "c9", at("2021-01-05")),
        (14, "USERX2@X", "c1", at("2021-01-05")),
    )
    return left, right


KEYS = [Key("email", "mail", "pattern"), Key("client", "client_key")]


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("kind", ["pattern", "equal", "exact_ci"])
def test_identity_join_equals_the_direct_join(make, how, kind):
    left, right = identities(make)
    keys = [Key("email", "mail", kind), KEYS[1]]
    later = F.col("created") >= F.col("seen")
    email = {
        "pattern": F.expr("email ILIKE mail"), "equal": F.expr("email = mail"),
        "exact_ci": F.expr("lower(email) = lower(mail)"),
    }[kind]
    direct = left.join(right, (email | (F.col("client") == F.col("client_key"))) & later, how)
    found = identity_join(left, right, keys, later, how)
    assert rows(found) == rows(direct)


def test_pair_matched_by_two_keys_appears_once(make):
    left, right = identities(make)
    found = identity_join(left, right, KEYS, how="inner")
    assert len(rows(found, "lid", "rid")) == len(set(rows(found, "lid", "rid")))
    assert (1, 10) in rows(found, "lid", "rid")


def test_equal_left_rows_stay_apart(make):
    left, right = identities(make)
    twice = left.unionAll(left)
    found = identity_join(twice, right, KEYS)
    assert rows(found) == sorted(rows(identity_join(left, right, KEYS)) * 2, key=lambda r: [(v is not None, str(v)) for v in r])


def test_column_names_must_differ(make):
    left, _ = identities(make)
    with pytest.raises(ValueError):
        identity_join(left, left, KEYS)
