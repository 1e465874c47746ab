"""Plans: no nested loops, filters at the scan, hot keys split."""

from __future__ import annotations

import contextlib
import io
import random
from datetime import timedelta
from pathlib import Path

import pytest
from conftest import at, rows
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from touchline import plans
from touchline.operators.audience import suppressed_by_address
from touchline.operators.identity import distinct_times_since
from touchline.operators.joins import join_groups, latest_before, split_left_join, star_left_join, with_group_values
from touchline.operators.touch import before_conversion, last_page_before
from touchline.session import configure, configured, distilled, intermediate_tables, materialise, shared_folder

ROOT = "/root/testdata/sf0.001"
JOBS = {name: job for name, job in spark_entry.queries().items() if name in plans.JOBS}


def plan(df, mode: str = "formatted") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.mark.parametrize("name", JOBS)
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(JOBS[name](spark, ROOT))
    for bad in ("NestedLoopJoin", "CartesianProduct", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text


@pytest.mark.parametrize(
    ("name", "column"),
    [("channel_uniques", "ts"), ("search_core_daily", "ts"), ("core_traffic_last_touch", "ts"),
     ("bottom_funnel_actuals", "ts"), ("keyword_conversions", "ts")],
)
def test_date_bounds_reach_the_scan(spark, name, column):
    assert f"GreaterThanOrEqual({column}," in plan(JOBS[name](spark, ROOT))


def test_first_touch_plan(spark):
    text = plan(JOBS["channel_uniques"](spark, ROOT), "simple")
    assert text.count("WindowGroupLimit") == 2


def test_unused_joins_disappear(spark):
    assert "Join" not in plan(JOBS["bottom_funnel_actuals"](spark, ROOT), "simple")


def small_partitions(spark):
    """Settings under which a few megabytes count as a large partition."""
    return {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    }


def hot_rows(spark):
    """A third of the rows has the key 7."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") == 1, F.lit(None)).otherwise(F.xxhash64("id"))
    facts = spark.range(300_000, numPartitions=16).select(key.alias("k"), F.xxhash64("id", F.lit(3)).alias("v"))
    return facts.withColumns({"email": F.col("k").cast("string"), "time": F.timestamp_seconds(F.col("v") % 1_000_000_000).cast("timestamp_ntz")})


HOT = {
    "group values": lambda f: with_group_values(f, ["k"], top=F.max("v")),
    "conversions": lambda f: before_conversion(
        f, f.select("k", F.col("time").alias("date")), "k", "time", "date"
    ),
    "addresses": lambda f: suppressed_by_address(f, "email", {"bad": F.col("v") > 0}),
    "groups": lambda f: join_groups(f, f.groupBy("k").agg(F.count("v").alias("n")), ["k"]),
}


@pytest.mark.parametrize("name", HOT)
def test_hot_key_is_split(spark, name):
    settings = small_partitions(spark)
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = HOT[name](hot_rows(spark))
        digest = found.select(F.xxhash64(*found.columns).cast("decimal(38,0)").alias("x")).agg(F.sum("x"))
        digest.collect()
        assert "skew=true" in digest._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_split_left_join_is_a_left_join(make):
    left = make("a int, x string", (1, "p"), (1, "p"), (2, None), (None, "q"), (3, "r"))
    right = make("b int, y string", (1, "one"), (1, "uno"), (None, "null"), (3, None))
    on = F.col("a") == F.col("b")
    assert rows(split_left_join(left, right, on)) == rows(left.join(right, on, "left"))


def test_latest_before_against_brute_force(make):
    rng = random.Random(5)
    base = at("2024-01-01")

    def moment():
        return None if rng.random() < 0.1 else base + timedelta(minutes=20 * rng.randrange(200))

    def key():
        return None if rng.random() < 0.1 else rng.choice(["hot", "hot", "a", "b", "none"])

    asked = [(i, key(), moment()) for i in range(60)]
    events = [(k, moment()) for k in (key() for _ in range(80)) if k != "none"]
    found = latest_before(
        make("id int, k string, at timestamp_ntz", *asked), make("k string, time timestamp_ntz", *events),
        "k", "at", "time", "last",
    )
    expected = [
        (i, k, t, max((e for ek, e in events if k and t and ek == k and e and e <= t), default=None))
        for i, k, t in asked
    ]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == expected


def test_last_page_reads_once_and_cuts_a_hot_session(spark):
    """A third of the pages is one session: no task folds it alone, and the page views are read and dealt once."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hour = F.col("id") % 400 * 60_000
        key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 900)
        pages = spark.range(120_000, numPartitions=16).select(
            key.alias("k"), F.timestamp_seconds(hour + F.col("id") % 977).cast("timestamp_ntz").alias("time"), F.xxhash64("id").alias("v")
        )
        pages = materialise(pages)
        target = F.col("v") % 2 == 0
        found = last_page_before(pages, ["k"], "time", target, target, ["v"])
        text = plan(found, "simple")
        assert text.count("FileScan") == 1 and "Join" not in text
        assert text.count("Exchange hashpartitioning") == 2  # spans, then what is left of each
        ends = pages.filter(target).groupBy("k").agg(F.max("time").alias("end")).toDF("j", "end")
        seen = pages.filter(~target).join(ends, F.col("k").eqNullSafe(F.col("j"))).filter("time <= end")
        assert rows(found, "k", "time") == rows(seen.groupBy("k").agg(F.max("time")))
    finally:
        configure(spark)


@pytest.mark.parametrize("seed", range(4))
def test_last_page_against_brute_force(make, seed):
    rng = random.Random(seed)
    base = at("2024-01-01")
    moment = lambda: None if rng.random() < 0.05 else base + timedelta(minutes=25 * rng.randrange(20))
    pages = [(rng.choice([1, 2, 3, None]), moment(), rng.choice("tab"), i) for i in range(40)]
    df = make("s int, time timestamp_ntz, kind string, id int", *pages)
    expected = []
    for session in {s for s, *_ in pages}:
        mine = [p for p in pages if p[0] == session and p[1] is not None]
        ends = [t for _, t, kind, _ in mine if kind == "t"]
        if seen := [p for p in mine if ends and p[1] <= max(ends) and p[2] != "a"]:
            expected.append(max(seen, key=lambda p: (p[1], -p[3])))
    found = last_page_before(df, ["s"], "time", F.col("kind") == "t", F.col("kind") == "a", ["id"])
    assert rows(found) == rows(make("s int, time timestamp_ntz, kind string, id int", *expected))


def test_latest_before_with_all_events_in_one_hour(spark):
    """One key, one hour: ranges share the events, and carry what earlier ones hold."""
    second = lambda n: F.timestamp_seconds(1_704_067_200 + n / 20).cast("timestamp_ntz")
    events = spark.range(60_000).select(F.lit("hot").alias("k"), second(F.col("id")).alias("time")).filter("id % 7 = 0")
    asked = spark.range(60_000).select("id", F.lit("hot").alias("k"), second(F.col("id") + 0.5).alias("at"))
    folder = Path(shared_folder(spark)) / "touchline"
    with intermediate_tables():
        before = set(folder.glob("*"))
        found = latest_before(asked, events, "k", "at", "time", "last")
        wrong = found.filter(~F.col("last").eqNullSafe(second(F.col("id") - F.col("id") % 7)))
        assert found.count() == 60_000 and wrong.count() == 0
        (ranged,) = [f for f in folder.glob("*") if f not in before]
        sizes = [r["count"] for r in spark.read.parquet(str(ranged)).groupBy("__range").count().collect()]
    assert sum(sizes) == 60_000 + 8_572


@pytest.mark.parametrize("name", ["ab_funnel_ilike", "ab_funnel_exclusions", "email_utm_funnel", "partner_semimonth_funnel"])
def test_distinct_counts_copy_no_rows(spark, name):
    assert "Expand" not in plan(JOBS[name](spark, ROOT), "simple")


def test_left_join_by_bitmaps(spark, make):
    """Many rows of several partitions, of which some have a pair, some several and some none; the pairs are not written."""
    left = spark.range(200_000, numPartitions=5).select("id", (F.col("id") % 1_000).alias("k"))
    right = spark.range(2_000).select((F.col("id") % 700 * 3).alias("j"), "id").toDF("j", "n")
    folder = Path(shared_folder(spark)) / "touchline"
    with intermediate_tables():
        before = set(folder.glob("*"))
        found = split_left_join(left, right, F.col("k") == F.col("j"))
        new = [f for f in folder.glob("*") if f not in before]
        assert sorted(spark.read.parquet(str(f)).columns for f in new) == [["__bucket", "__bits"], ["id", "k", "__row"]]
        sums = lambda df: tuple(df.agg(F.count("*"), F.count("j"), F.sum(F.xxhash64("id", "k", "j", "n").cast("decimal(38,0)"))).first())
        assert sums(found) == sums(left.join(right, F.col("k") == F.col("j"), "left"))


@pytest.mark.parametrize("piece_rows", [1, 3, 1_000])
def test_star_left_join_is_a_chain_of_left_joins(make, piece_rows):
    """Each side is the largest of some key; a key without rows on one side; repeated rows; rows without a key."""
    rng = random.Random(3)
    keys = lambda n, *hot: [rng.choice([*hot, *hot, "a", "b", "c", "d", None]) for _ in range(n)]
    left = make("k string, x int", *[(k, i % 4) for i, k in enumerate(keys(14, "left"))], ("alone", 1), ("a", 1), ("a", 1))
    one = make("k1 string, y int", *[(k, i % 5) for i, k in enumerate(keys(17, "a"))], ("left", 1))
    two = make("k2 string, z int", *[(k, i % 5) for i, k in enumerate(keys(11, "b"))], ("left", 2))
    three = make("k3 string, w int", ("a", 1), ("a", 1), ("c", 3))
    chain = left
    sides = {"k1": one, "k2": two, "k3": three}
    for key, right in sides.items():
        chain = chain.join(right, F.col("k") == F.col(key), "left")
    assert rows(star_left_join(left, "k", sides, piece_rows)) == rows(chain)


def test_star_left_join_deals_a_hot_key(spark):
    """A key with a third of all rows on one side is spread over many tasks; the chain shuffles each side once."""
    settings = small_partitions(spark) | {"spark.sql.adaptive.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        hot = hot_rows(spark).select("k", "v")
        other = spark.range(20, numPartitions=2).select(F.lit(7).cast("long").alias("j"), "id")
        found = star_left_join(materialise(hot), "k", {"j": other}, piece_rows=2_000)
        per_task = found.groupBy(F.spark_partition_id()).agg(F.count_if(F.col("id").isNotNull()).alias("n")).collect()
        assert sum(r["n"] for r in per_task) == 20 * hot.filter("k = 7").count()
        assert max(r["n"] for r in per_task) < 0.4 * 20 * 100_000
        assert plan(found, "simple").count("Exchange hashpartitioning(k") == 1
    finally:
        for key in settings:
            spark.conf.unset(key)
        configure(spark)


@pytest.mark.parametrize("broad_pairs", [0, 6, 100_000])
@pytest.mark.parametrize("seed", [11, 12])
def test_distinct_times_against_brute_force(make, seed, broad_pairs):
    rng = random.Random(seed)
    day = at("2024-01-01")
    keys = [("c", "1"), ("c", "2"), ("e", "hot"), ("e", "x"), ("e", "y")]
    times = {(*rng.choice([*keys, *[keys[2]] * 3]), day + timedelta(hours=6 * rng.randrange(40))) for _ in range(60)}
    units = {(rng.choice(["u", "v", "w", None]), *rng.choice(keys)) for _ in range(12)}
    asked = {(u, day + timedelta(days=d)) for u in ("u", "v", "w", None) for d in (0, 2, 5, 9, 20)}
    found = distinct_times_since(
        make("unit string, key_kind string, key string", *units),
        make("unit string, view_day timestamp_ntz", *asked),
        make("key_kind string, key string, created timestamp_ntz", *times),
        ["unit"],
        broad_pairs,
    )
    expected = {}
    for unit, since in asked:
        mine = {t for kind, k, t in times if (unit, kind, k) in units and t >= since}
        if mine:
            expected[unit, since] = len(mine)
    assert {(r["unit"], r["view_day"]): r["n"] for r in found.collect()} == expected


def test_distinct_times_of_a_unit_of_many_keys(spark):
    """One unit of 10,000 keys with 20 times each, beside units that share two keys of 5,000 times: rows, not their squares."""
    day = F.lit(at("2024-01-01")).cast("timestamp_ntz")
    many = spark.range(10_000).select(F.lit("big").alias("unit"), F.lit("k").alias("key_kind"), F.col("id").cast("string").alias("key"))
    few = spark.range(6_000).select(F.format_string("u%d", "id").alias("unit"), F.lit("hot").alias("key_kind"), F.explode(F.array(F.lit("p"), F.lit("q"))).alias("key"))
    at_hour = lambda n: F.timestamp_seconds(1_704_067_200 + 3_600 * n).cast("timestamp_ntz").alias("created")
    of_many = spark.range(200_000).select(F.lit("k").alias("key_kind"), (F.col("id") % 10_000).cast("string").alias("key"), at_hour(F.col("id") % 997 * (F.floor(F.col("id") / 10_000) % 2))).distinct()
    of_hot = spark.range(10_000).select(F.lit("hot").alias("key_kind"), F.when(F.col("id") < 5_000, "p").otherwise("q").alias("key"), at_hour(F.col("id") % 7_000))
    units = materialise(many.unionAll(few))
    asked = units.select("unit", day.alias("view_day")).distinct()
    found = distinct_times_since(units, asked, materialise(of_many.unionAll(of_hot)), ["unit"])
    assert {(r["unit"] == "big", r["n"]) for r in found.collect()} == {(True, 997), (False, 7_000)}
    assert found.count() == 6_001


def test_written_tables_go_when_the_report_is_done(spark, make):
    df = make("a int, s struct<t: timestamp_ntz, i: string>", (1, (at("2024-01-01"), "x")), (None, None))
    folder = Path(shared_folder(spark)) / "touchline"
    before = set(folder.glob("*"))
    with intermediate_tables():
        assert rows(materialise(df)) == rows(df)
        assert len(set(folder.glob("*")) - before) == 1
    assert set(folder.glob("*")) == before


def test_tables_on_the_way_go_at_once(spark, make):
    df = make("a int", (1,), (2,))
    folder = Path(shared_folder(spark)) / "touchline"
    before = set(folder.glob("*"))
    with intermediate_tables():
        found = distilled(lambda: materialise(materialise(df).filter("a > 1")).selectExpr("a + 1 AS b"))
        assert len(set(folder.glob("*")) - before) == 1
        assert rows(found) == [(3,)]


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with configured(spark, input_bytes=10**14):
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) > 370_000
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
