"""The pipeline against a plain version of each stage on its own input."""

from __future__ import annotations

import re

import corpus_pipeline
from llm.test_operators import base_spans, shingles

from touchline.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        docs = spark.createDataFrame(list(kept[name].values()), docs.schema)
        after = kept[name]
        if name == "language identification":
            assert set(after) == {k for k, r in before.items() if re.search(r"[^\W\d_]", r["text"])}
        if name == "quality rules":
            assert set(after) < set(before) and len(after) > 0.7 * len(before)
        if name == "near duplicates":
            sets = [shingles(r["text"]) for r in after.values()]
            for k, a in enumerate(sets):
                for b in sets[:k]:
                    assert 100 * len(a & b) < quality_limit(a, b)
        if name == "secret scan":
            assert set(after) == set(before)
            assert all(base_spans(r["text"]) == "" for r in after.values())
            assert all(after[k]["text"] == r["text"] for k, r in before.items() if not base_spans(r["text"]) and "[" not in after[k]["text"])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in last} == set(after)


def quality_limit(a, b):
    return 85 * len(a | b)


def test_run_and_policy(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "bin_id", "n_words"} <= set(rows[0].asDict())
    assert "few_words" in quality.POLICIES["v2"]
