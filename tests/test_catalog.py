from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F
from random_tables import random_tables

from touchline.plans import JOBS, create_views, write_report
from touchline.plans.sinks import read_partitions, write_partitions
from touchline.session import SHUFFLE_PARTITION_BYTES, configure
from touchline.sources import Catalog
from touchline.sources.schemas import SCHEMAS


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("warehouse")
    for name, table in random_tables(3, 20).items():
        (root / name).mkdir()
        pq.write_table(table, root / name / "part.parquet")
    return root


def test_tables_are_read_on_use(spark, folder):
    tables = Catalog.from_parquet(spark, str(folder))
    assert set(tables) == set(SCHEMAS) and len(tables) == len(SCHEMAS)
    assert tables["client"].columns == ["id", "principalpersonid"]
    assert tables["client"] is tables["client"]
    Catalog.from_parquet(spark, "/nowhere")  # nothing is read yet


def test_renamed_columns(spark, folder):
    stored = Catalog.from_parquet(spark, str(folder))["client"].withColumnRenamed("principalpersonid", "owner")
    tables = Catalog({"client": stored}, {"client": {"owner": "principalpersonid"}})
    assert tables["client"].columns == ["id", "principalpersonid"]


def test_views_and_metastore_names(spark, folder):
    tables = Catalog.from_parquet(spark, str(folder))
    tables.create_views("in_")
    named = Catalog.from_tables(spark, {n: f"in_{n}" for n in SCHEMAS})
    assert rows(JOBS["chat_cohort_funnel"](named)) == rows(JOBS["chat_cohort_funnel"](tables))
    create_views(tables, ["contactable"], "report_")
    assert spark.table("report_contactable").count() == JOBS["contactable"](tables).count()


def test_stored_report_is_read_back(spark, folder, tmp_path):
    tables = Catalog.from_parquet(spark, str(folder))
    expected = rows(JOBS["email_prospect"](tables))
    write_report(tables, "contactable", str(tmp_path / "contactable"), partition_by="prospect_ind")
    tables.add("contactable", spark.read.parquet(str(tmp_path / "contactable")))
    tables.add("mail_leads", tables["mail_leads"].filter(F.lit(False)))
    assert rows(JOBS["email_prospect"](tables)) == expected


def test_shuffles_follow_the_input(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        configure(spark, input_bytes=1000 * SHUFFLE_PARTITION_BYTES)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "1000"
        configure(spark, input_bytes=1)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "1000"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def stored(spark, path):
    return sorted((str(r["day"]), r["v"]) for r in spark.read.parquet(path).collect())


def test_only_the_written_partitions_are_replaced(spark, make, tmp_path):
    path = str(tmp_path / "days")
    first = make("day string, v int", ("2024-01-01", 1), ("2024-01-01", 2), ("2024/02", 3), (None, 4))
    write_partitions(first, path, "day")
    write_partitions(first, path, "day")  # again: nothing doubles
    assert stored(spark, path) == [("2024-01-01", 1), ("2024-01-01", 2), ("2024/02", 3), ("None", 4)]
    write_partitions(make("day string, v int", ("2024-01-01", 7)), path, "day")
    assert stored(spark, path) == [("2024-01-01", 7), ("2024/02", 3), ("None", 4)]
    # What a run covers and has no rows for goes; what it does not cover stays.
    write_partitions(make("day string, v int", ("2024-01-02", 8)), path, "day", covers=["2024-01-02", "2024/02", None])
    assert stored(spark, path) == [("2024-01-01", 7), ("2024-01-02", 8)]


def test_a_partition_is_renewed_from_its_own_table(spark, make, tmp_path):
    path = str(tmp_path / "own")
    df = make("v int, day string", (1, "a"), (2, "b"))
    write_partitions(df, path, "day")
    grown = read_partitions(spark, path, df.schema).filter("day = 'a'").selectExpr("v + 10 AS v", "day")
    write_partitions(grown, path, "day")
    again = read_partitions(spark, path, df.schema)
    assert again.columns == ["v", "day"]
    assert sorted(map(tuple, again.collect())) == [(2, "b"), (11, "a")]
