"""Every job against its plain SQL over the same tables, and none may be empty."""

from __future__ import annotations

import pytest
from compare import differences, duck

import __spark_entry__ as spark_entry
from touchline import plans
from touchline.session import intermediate_tables

ROOT = "/root/testdata/sf0.01"
# The training-data operators, where present, have tests of their own.
JOBS = {name: job for name, job in spark_entry.queries().items() if name in plans.JOBS}
SQL = {name: sql for name, sql in spark_entry.oracle_sql().items() if name in plans.JOBS}


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


def test_every_job_has_a_counterpart():
    assert set(JOBS) == set(SQL)


@pytest.mark.parametrize("name", JOBS)
def test_same_rows(spark, con, name):
    with intermediate_tables():
        count, problems = differences(JOBS[name](spark, ROOT), con, SQL[name])
    assert problems == []
    assert count > 0


def test_entry(spark):
    frame = spark_entry.entry(spark)
    assert frame.columns[0] == "Week_Starting"
    assert frame.count() > 0
