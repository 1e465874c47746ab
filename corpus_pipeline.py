"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before kept and returns what it keeps, with the columns of ``documents``;
the last returns the place of every piece of text. Every stage's result is written to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import language, neardup, ownership, packing, quality
from touchline.llm.common import table
from touchline.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language identification", language.stage),
    ("quality rules", quality.stage),
    ("near duplicates", neardup.stage),
    ("secret scan", ownership.stage),
    ("packing", packing.stage),
]

#: Automata, component search and bin packing have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
