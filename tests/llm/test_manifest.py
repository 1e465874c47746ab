"""The Merkle manifest against one made in plain Python, and its records and proofs by themselves."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from llm.hard import documents
from pyspark.sql import functions as F

from touchline.llm import merkle
from touchline.llm.common import crc_rest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests):
    """The root, and for each leaf its siblings to the left and right by level."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for k, node in enumerate(at):
            first = node // 8 * 8
            paths[k].append((digests[first:node], digests[node + 1 : first + 8]))
            at[k] = node // 8
        digests = [h(*digests[k : k + 8]) for k in range(0, len(digests), 8)]
    return digests[0], paths


def plain(rows):
    trees = {}
    for r in rows:
        values = (r["doc_id"], r["source"], r["lang"], r["n_chars"])
        lowered = None if r["text"] is None else r["text"].translate(LOWER)
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        own = leaf(*values, r["text"])
        trees.setdefault(r["lang"], []).append((r["doc_id"], own, leaf(*values, lowered) if tampered else own))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    made = {k: tree([own for _, own, _ in sorted(trees[k], key=order)]) for k in names}
    root, tops = tree([made[k][0] for k in names])
    out = []
    for place, name in enumerate(names):
        subroot, paths = made[name]
        for (doc_id, own, now), path in zip(sorted(trees[name], key=order), paths, strict=True):
            path = path + tops[place]
            for left, right in path:
                now = h(*left, now, *right)
            out.append((doc_id, own, subroot, root, h(*[d for s in path for side in s for d in side]), now, now == root))
    return out


def found(docs):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [tuple(r) for r in merkle.audit(docs, F.coalesce(crc_rest(F.col("doc_id"), 3) == 0, F.lit(False)), lowered).collect()]


def test_hard_rows(spark):
    docs = documents(spark)
    assert sorted(found(docs), key=str) == sorted(plain(docs.collect()), key=str)
    assert found(documents(spark, empty=True)) == []


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_sizes(spark, n):
    """One tree of n leaves beside small ones; more trees than a node has children."""
    rows = [(k, f"Text {k}", "en", "s", 5) for k in range(n)]
    rows += [(1000 + k, "Übrig", f"l{k}" if k % 2 else None, None, None) for k in range(0 if n == 1 else 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(found(docs)) == sorted(plain(docs.collect()))


def test_records_hold_each_digest_once(spark):
    """Repeated rows make equal nodes; a request for some leaves descends through the nodes above them alone."""
    rows = [(7, "same", "en", "s", 4)] * 64 + [(k, "x", "de", "s", 1) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    digest = merkle.leaf_digest(*[F.col(c) for c in merkle.COLUMNS])
    made = merkle.manifest(docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("key"), digest.alias("leaf")))
    for level in [*made.levels, *made.upper]:
        assert level.count() == level.select("digest").distinct().count()
    assert made.levels[0].count() == 1 + 4  # 8 equal runs of one tree, 4 of the other
    asked = made.leaves.where("tree = '=de' and rank in (3, 29)").select("tree", F.col("rank").alias("node"))
    paths = merkle.descend(made, asked)
    ends = paths.select("node", merkle.folded(F.col("digest"), F.col("path")).alias("up"), F.size("path").alias("n")).collect()
    assert {(r["node"], r["up"], r["n"]) for r in ends} == {(3, made.root.hex(), 3), (29, made.root.hex(), 3)}
