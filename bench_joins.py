"""Time the join on several identity keys next to the direct OR / ILIKE join.

Also times patterns that differ before a wildcard and share the domain behind it, in growing numbers, and patterns whose
runs between wildcards have 1, 5 and 20 different lengths.
Prints one JSON line. Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1).
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import functions as F

from touchline.operators.identity import Key, identity_join, pattern_pairs
from touchline.session import local_session, materialise
from touchline.sources import testdata

ROOT = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def domain_patterns(spark) -> dict[str, float]:
    """Seconds to match 20,000 addresses with patterns like ``u17%@mail.example``."""
    texts = materialise(spark.range(20_000).select(F.format_string("u%d@mail.example", "id").alias("text")))
    seconds = {}
    for number in (500, 500, 1_000, 2_000, 4_000):  # the first run compiles
        patterns = materialise(spark.range(number).select(F.format_string("u%d%%@mail.example", "id").alias("pattern")))
        begin = time.perf_counter()
        pairs = pattern_pairs(texts, patterns).count()
        seconds[f"{number} patterns, {pairs} pairs"] = round(time.perf_counter() - begin, 2)
    return seconds


def run_lengths(spark) -> dict[str, float]:
    """Seconds to match 20,000 addresses with 2,000 patterns like ``%0017@mail%``."""
    address = F.format_string("customer%022d@mail.example", "id")
    texts = materialise(spark.range(20_000).select(address.alias("text")))
    seconds = {}
    for lengths in (1, 1, 5, 20):  # the first run compiles
        number = F.lpad((F.col("id") * 7).cast("string"), 22, "0")
        run = F.concat(F.right(number, (F.col("id") % lengths + 3).cast("int")), F.lit("@mail"))
        some = spark.range(2_000).select(F.concat(F.lit("%"), run, F.lit("%")).alias("pattern")).distinct()
        patterns = materialise(some)
        begin = time.perf_counter()
        pairs = pattern_pairs(texts, patterns).count()
        seconds[f"{lengths} lengths, {pairs} pairs"] = round(time.perf_counter() - begin, 2)
    return seconds


def main() -> None:
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="touchline-bench-joins")
    tables = testdata.catalog(spark, ROOT)
    clients = tables["client"].select(F.col("id").alias("client_id"), "principalpersonid")
    people = materialise(
        tables["identity_map"]
        .join(clients, F.col("inferred_person_id") == F.col("principalpersonid"), "left")
        .select("heap_user_id", "inferred_email", "client_id")
    )
    leads = materialise(
        tables["lead_data"].select(F.col("id").alias("lead_id"), F.col("email").alias("lead_email"), "client_key")
    )
    either = F.expr("inferred_email ILIKE lead_email OR client_id = client_key")
    ways = {
        "rewritten": lambda: identity_join(
            people, leads, [Key("inferred_email", "lead_email", "pattern"), Key("client_id", "client_key")]
        ),
        "direct": lambda: people.join(leads, either, "left"),
    }
    seconds, counts = {}, {}
    for name, way in ways.items():
        counts[name] = way().count()
        begin = time.perf_counter()
        way().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "left join on address pattern or client id",
                "unit": "sec",
                "seconds": seconds,
                "rows": counts,
                "left": people.count(),
                "right": leads.count(),
                "sf": Path(ROOT).name,
                "domain patterns": domain_patterns(spark),
                "run lengths": run_lengths(spark),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
