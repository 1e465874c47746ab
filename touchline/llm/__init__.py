"""Operators for building training data, one module each. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import (
    bpe,
    language,
    licenses,
    merkle,
    mixing,
    neardup,
    negatives,
    ownership,
    packing,
    pages,
    quality,
    sketch,
    toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator, over its whole table."""
    return {
        "op1_secret_scan": ownership.op1_secret_scan,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_bpe_round_trip": bpe.op6_bpe_round_trip,
        "op7_main_text": pages.op7_main_text,
        "op8_near_duplicates": neardup.op8_near_duplicates,
        "op9_language_id": language.op9_language_id,
        "op10_fingerprints": sketch.op10_fingerprints,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_source_mix": mixing.op13_source_mix,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {
        "op1_secret_scan": ownership.ORACLE,
        "op3_quality_rules": quality.ORACLE,
        "op5_license_scan": licenses.ORACLE,
        "op10_fingerprints": sketch.ORACLE,
        "op11_merkle_manifest": merkle.ORACLE,
        "op12_hard_negatives": negatives.ORACLE,
    }
