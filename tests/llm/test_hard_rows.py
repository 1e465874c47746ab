"""Every operator and every stage on rows with nulls, empty and long texts, ties, repeats, clashing columns, and on none."""

from __future__ import annotations

import pytest
from llm.hard import TEXTS, documents, written

import corpus_pipeline
from touchline.llm import pages, queries

DOCUMENT_QUERIES = sorted(set(queries()) - {"op4_best_fit_packing", "op7_main_text", "op12_hard_negatives"})


def labels(spark, empty=False):
    rows = [] if empty else [(k, k % 2, k % 2) for k in range(len(TEXTS))] + [(3, 0, None), (None, 1, 1), (5, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full, none = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("none")
    return (
        written(spark, full, documents(spark), labels(spark)),
        written(spark, none, documents(spark, empty=True), labels(spark, empty=True)),
    )


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_every_row_has_a_result(spark, folders, name):
    found = queries()[name](spark, folders[0]).collect()
    given = documents(spark).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    assert sorted(map(key, found)) == sorted(map(key, given))


@pytest.mark.parametrize("name", [*DOCUMENT_QUERIES, "op4_best_fit_packing"])
def test_no_rows(spark, folders, name):
    assert queries()[name](spark, folders[1]).collect() == []


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_a_stage_keeps_the_columns(spark, folders, stage):
    for docs in (documents(spark), documents(spark, empty=True)):
        kept = stage[1](spark, docs, folders[0])
        assert kept.dtypes == docs.dtypes
        kept.collect()


def test_packing(spark, folders):
    """Every row has its pieces, long texts several; each word once."""
    found = queries()["op4_best_fit_packing"](spark, folders[0]).collect()
    given = documents(spark).collect()
    assert sorted({str(r["doc_id"]) for r in found}) == sorted({str(r["doc_id"]) for r in given})
    assert sum(r["n_words"] for r in found) == sum(len((r["text"] or "").split()) - (r["text"] or "").count("\u3000") for r in given)
    assert sum(r["piece"] == 0 for r in found) == len(given)


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>Some text</p>"), (3, "u", "no tags"), (3, "u", "no tags")]
    given = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = pages.main_text(given, pages.learn(given)).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in found) == [
        (0, "Some text"), (1, ""), (2, ""), (3, "no tags"), (3, "no tags")
    ]
    assert pages.main_text(given.limit(0), {}).collect() == []
