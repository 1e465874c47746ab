"""Groups of near duplicates that take several blocks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from touchline.llm import neardup
from touchline.session import materialise

WORDS = [f"w{k}" for k in range(120)]


def changed(*places):
    return " ".join(f"x{k}" if k in places else w for k, w in enumerate(WORDS))


def shingles(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(texts, limit):
    """Smallest number reachable, by comparing all with all."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    linked = [
        (a, b) for a in root for b in root if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b])
    ]
    for _ in texts:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_copies_chains_and_strangers(spark, monkeypatch, size):
    """Copies of one text, a chain whose ends are far apart, and pairs in a group that its pivot is not linked with."""
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", size)
    texts = [changed(k) for k in range(2, 118, 4)]
    texts += [changed(*range(k)) for k in range(0, 60, 3)]
    texts += [changed(*range(40, 80), k) for k in (5, 20, 100)] + [changed(*range(0, 120, 9))] * 2
    texts += ["quite another text " * 3, "w1 w2", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, shared=85).collect()}
    assert [found[k] for k in range(len(texts))] == brute(texts, 85)


def test_near_copies_cost_rows_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 20)
    rows = [(bytes([k // 256, k % 256]), 100) for k in range(1_000)]
    met = spark.createDataFrame(rows, "same binary, n_shingles long").select(F.lit(rows[0][0]).alias("frame"), "same", "n_shingles")
    frames = materialise(met.groupBy("frame").agg(neardup._block_count(F.lit(True)).alias("blocks")))
    assert neardup._with_pivots(met, frames).count() == 999 + 50

    def left(n_tied):
        tied = met.where(F.col("same").isin([r[0] for r in rows[1 : n_tied + 1]])).select("frame", "same", F.lit(True).alias("tied"))
        return neardup._others(met, frames, tied)

    assert left(999).count() == 0
    some = left(979).collect()  # 20 free ones in one block: it meets itself and 49 blocks of tied ones
    assert len(some) == 20 * 50 + 980
    assert all(r["low"] == 0 for r in some)
