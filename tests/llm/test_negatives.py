"""Hard negatives against plain loops over Python integers, and the packed products by themselves."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from touchline.llm import negatives
from touchline.llm.negatives import Packed, best, hard_negatives, integers

SCHEMA = "vec_id long, embedding array<double>, label int, row string, positives string, block string"
INF, NAN = float("inf"), float("nan")


def plain(rows):
    taking = []
    for at, (key, vector, label) in enumerate(rows):
        if None in (key, vector, label) or any(x is None or math.isnan(x) or math.isinf(x) for x in vector):
            continue
        taking.append((at, key, label, [math.floor(256 * x) if abs(x) < 2**53 else 256 * int(x) for x in vector]))
    out = []
    for at, key, label, vector in taking:
        if key % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(vector, v, strict=False)), k, l) for a, k, l, v in taking if a != at]
        for own, positive, _ in sorted(s for s in scored if s[2] == label)[:5]:
            near = sorted(s for s in scored if s[2] != label and -80 * own <= -100 * s[0] <= -100 * own)[:5]
            out += [(key, positive, rank, k, -own, -s) for rank, (s, k, _) in enumerate(near, 1)]
    return sorted(out)


def found(spark, rows):
    given_rows = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives(given_rows, F.col("vec_id") % 100 == 0).collect())


def drawn(seed, n, dim, labels, spread=0.3):
    r = random.Random(seed)
    return [(k, [r.gauss(0.1, spread) for _ in range(dim)], r.randrange(labels)) for k in range(n)]


def test_random_rows(spark, monkeypatch):
    """Blocks and packs much smaller than the table, so that anchors meet many of each."""
    monkeypatch.setattr(negatives, "BLOCK_COMPONENTS", 16 * 40)
    rows = drawn(1, 700, 16, 4)
    want = plain(rows)
    assert want and found(spark, rows) == want


def test_ties_and_repeats(spark):
    """A third of the rows is one vector; keys repeat, also that of an anchor."""
    rows = drawn(2, 300, 6, 3)
    rows += [(1000 + k, rows[0][1], k % 3) for k in range(150)]
    rows += [rows[0], rows[1], rows[100]]
    want = plain(rows)
    assert want and found(spark, rows) == want


def test_hard_rows(spark):
    rows = drawn(3, 120, 4, 2)
    rows += [
        (None, [0.5] * 4, 1), (200, None, 1), (300, [0.1] * 4, None), (400, [0.1, None, 0.1, 0.1], 0),
        (500, [NAN, 0.0, 0.0, 0.0], 0), (600, [INF] * 4, 1), (700, [], 1), (800, [0.4, 0.3], 0), (900, [0.0] * 4, 1),
        (1000, [9.0] * 7, 1), (1100, [1.0] * 4, 77),
    ]
    want = plain(rows)
    assert want and found(spark, rows) == want
    assert found(spark, []) == []
    assert found(spark, [(100, [0.5], 1)]) == []


@pytest.mark.parametrize("size", [1e4, 1e9, 1e15, 1e40])
def test_exact_at_any_size(size):
    """Fields widen with the components; no product runs over."""
    random = np.random.default_rng(4)
    rows = integers(random.normal(0, size, (50, 9)))
    packed = Packed(rows)
    for anchor in integers(random.normal(0, size, (5, 9))).tolist():
        want = [sum(int(a) * int(b) for a, b in zip(anchor, row, strict=True)) for row in rows.tolist()]
        assert packed.scores(anchor).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-600, 600), min_size=3, max_size=3), min_size=1, max_size=20), st.lists(st.integers(-600, 600), min_size=3, max_size=3))
def test_packed_scores(rows, anchor):
    assert Packed(np.array(rows, np.int64)).scores(anchor).tolist() == [sum(map(int.__mul__, r, anchor)) for r in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=30), st.integers(1, 6))
def test_best(scores, most):
    want = sorted(range(len(scores)), key=lambda k: (-scores[k], k))[:most]
    places = np.arange(len(scores))
    assert best(np.array(scores, np.int64), places, most).tolist() == want
    assert best(np.array(scores, object), places, most).tolist() == want
