"""Every job against its plain SQL on small random tables full of collisions and hot keys."""

from __future__ import annotations

import re

import duckdb
import pyarrow.parquet as pq
import pytest
from compare import differences
from random_tables import random_tables

from oracle import QUERIES
from touchline.plans import JOBS
from touchline.sources import Catalog, testdata

SEEDS = (1, 4)


@pytest.fixture(scope="module", params=SEEDS)
def world(request, spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp(f"tables-{request.param}")
    con = duckdb.connect()
    for name, table in random_tables(request.param).items():
        (folder / name).mkdir()
        pq.write_table(table, folder / name / "part.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}/part.parquet'")
    return Catalog.from_parquet(spark, str(folder)), con


@pytest.mark.parametrize("name", JOBS)
def test_same_rows(world, name):
    catalog, con = world
    _, problems = differences(JOBS[name](catalog), con, testdata.render(QUERIES[name]))
    assert problems == []


def equal_in_any_case(sql: str) -> str:
    """The plain SQL with pattern matches between columns replaced by equality in any case."""
    return re.sub(r"([\w.]+) ILIKE ((?:l|d)\.(?:crm_)?email)", r"lower(\1) = lower(\2)", sql)


@pytest.mark.parametrize(
    "name",
    ["ab_single_variant", "ab_exposure_attribution", "ab_funnel_ilike", "contact_details_credit", "email_utm_funnel",
     "identity_matches"],
)
def test_equality_in_any_case(world, name):
    catalog, con = world
    sql = equal_in_any_case(testdata.render(QUERIES[name]))
    assert sql != testdata.render(QUERIES[name])
    _, problems = differences(JOBS[name](catalog, email_match="exact_ci"), con, sql)
    assert problems == []


def test_each_user_once(world):
    catalog, con = world
    sql = testdata.render(QUERIES["ab_funnel_exclusions"])
    once = "SELECT DISTINCT user_id, variation_id FROM joined"
    sql = re.sub(r"SELECT DISTINCT user_id, person_email[^)]*FROM joined", once, sql)
    assert once in sql
    _, problems = differences(JOBS["ab_funnel_exclusions"](catalog, per_user=True), con, sql)
    assert problems == []


def test_strict_exclusions(world):
    catalog, con = world
    sql = testdata.render(QUERIES["ab_funnel_exclusions"])
    strict = """FROM people
        WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.email IN (people.email, people.person_email)) AND (person_email"""
    start = sql.index("FROM people\n        WHERE person_email")
    end = sql.index("views AS (", start)
    clause = sql[start:end].replace("FROM people\n        WHERE person_email", strict, 1).rstrip().rstrip(",")
    sql = sql[:start] + clause + "),\n    " + sql[end:]
    _, problems = differences(JOBS["ab_funnel_exclusions"](catalog, strict_exclusions=True), con, sql)
    assert problems == []
