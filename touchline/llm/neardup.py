"""Near duplicates by MinHash with tensored banding.

Two collections of ``n`` half keys are made per text, each of ``ROWS`` minimum hashes. Every pair of a half from
the first and a half from the second is the key of one table: ``n`` squared tables from ``2 * n * ROWS`` hashes, where
independent tables would need ``n`` times as many. Texts at the limit of similarity ``s`` meet in a table with
probability ``(1 - (1 - s**ROWS)**n)**2``; ``n`` follows from the limit so that this is at least ``MEET``.

Texts that meet are compared on their full shingle sets in blocks of bounded size: a block tells which of its texts hang
together, never the pairs. A group of several blocks is first compared with one of its texts, its pivot. Those that are
linked with the pivot hang together, so only the others are then compared, with each other and with those. A group of near
copies so costs work in proportion to its size, and no link between texts that met is lost. Equal word sequences are one
class before all that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import python_workers, table
from touchline.llm.graph import components
from touchline.llm.shingles import shingle_set, split
from touchline.session import distilled, materialise

#: Similarity: at least this many hundredths of the union are shared. The contract of the query op 8 sets its own limit.
SHARED = 80
OP8_SHARED = 85
#: Minimum hashes in a half key, and the least probability that two texts at the limit meet.
ROWS = 3
MEET = 0.9998
#: A block of texts to compare holds about this many shingles and texts.
BLOCK_SHINGLES = 500_000
BLOCK_TEXTS = 1_000
#: Shingles that are hashed at once.
PIECE = 1 << 17

_JOIN = np.uint64(0x9E3779B97F4A7C15)


def halves_for(shared: int) -> int:
    """Half keys of a collection: 10 for a limit of 85, 13 for 80."""
    return math.ceil(math.log(1 - math.sqrt(MEET)) / math.log(1 - (min(shared, 99) / 100) ** ROWS))


@cache
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(8)
    flips = random.integers(0, 1 << 63, n, dtype=np.uint64)
    return flips, random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def half_keys(sets: list[np.ndarray], n_halves: int) -> np.ndarray:
    """``2 * n_halves`` half keys for each set, none of them empty."""
    flips, factors = _hashes(2 * n_halves * ROWS)
    lengths = np.array([len(s) for s in sets])
    ends = np.cumsum(lengths)
    least = np.full((2 * n_halves * ROWS, len(sets)), np.uint64(2**64 - 1))
    first = 0
    while first < len(sets):
        begin = ends[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + PIECE)))
        flat = np.concatenate(sets[first:last])
        starts = ends[first:last] - lengths[first:last] - begin
        for k in range(len(least)):
            least[k, first:last] = np.minimum.reduceat((flat ^ flips[k]) * factors[k], starts)
        first = last
    keys = np.repeat(np.arange(2 * n_halves, dtype=np.uint64)[:, None], len(sets), 1)
    for k in range(ROWS):
        keys = (keys ^ least[k :: ROWS]) * _JOIN
        keys ^= keys >> np.uint64(31)
    return keys.T


def _signed(batches: Iterator[pa.RecordBatch], n_halves: int, carry: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [split(t) for t in batch.column("text").to_pylist()]
        sets = [shingle_set(w) for w in words]
        some = [k for k, s in enumerate(sets) if len(s)]
        halves: list[np.ndarray | None] = [None] * len(sets)
        if some:
            for k, keys in zip(some, half_keys([sets[k] for k in some], n_halves).view(np.int64), strict=True):
                halves[k] = keys
        same = [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in words]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("row"),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(same, pa.binary()),
                pa.array(halves, pa.list_(pa.int64())),
                *[batch.column(c) for c in carry],
            ],
            names=["doc_id", "row", "n_words", "n_shingles", "same", "halves", *carry],
        )


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [split(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary()),
                pa.array([shingle_set(w).view(np.int64) for w in words], pa.list_(pa.int64())),
            ],
            names=["same", "shingles"],
        )


def _joined(sets: list[np.ndarray], sides: np.ndarray, limit: int) -> np.ndarray:
    """For each set the first set that links reach. Sets of different sides are compared, or all if there is one side."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = times[column] > 1  # a shingle of one set alone is in no intersection
    renumbered = np.cumsum(times > 1) - 1
    column, owner = renumbered[column[common]], owner[common]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 2048
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        shared += held @ held.T
    inter = shared.astype(np.int64)
    linked = 100 * inter >= limit * (sizes[:, None] + sizes[None, :] - inter)
    if sides.min() != sides.max():
        linked &= sides[:, None] != sides[None, :]
    np.fill_diagonal(linked, True)
    label = np.arange(len(sets))
    while True:
        least = np.where(linked, label[None, :], len(sets)).min(1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _compared(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Links that join the texts of each block; the rows of a block follow each other."""

    def links(group: list[tuple]) -> tuple[list[bytes], list[bytes]]:
        if len(group) < 2:
            return [], []
        sides = np.array([side for _, side, _ in group])
        label = _joined([s for _, _, s in group], sides, limit)
        moved = np.flatnonzero(label != np.arange(len(group)))
        return [group[k][0] for k in moved], [group[label[k]][0] for k in moved]

    key, group = None, []
    for batch in batches:
        frames, lows, highs, sides, same = (batch.column(k).to_pylist() for k in range(5))
        shingles = batch.column(5)
        out: tuple[list[bytes], list[bytes]] = ([], [])
        for k, now in enumerate(zip(frames, lows, highs, strict=True)):
            if now != key:
                for whole, part in zip(out, links(group), strict=True):
                    whole.extend(part)
                key, group = now, []
            group.append((same[k], sides[k], shingles[k].values.to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["a", "b"])
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in links(group)], names=["a", "b"])


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id", shared: int = SHARED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``doc_id``, ``row`` (hash of key and text), ``n_words``, ``n_shingles``, ``same`` (128 bits of the words),
    ``halves``, and the columns of ``carry`` as text."""
    python_workers(docs.sparkSession)
    n_halves = halves_for(shared)
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.xxhash64(F.col(key), F.col(text)).alias("row"),
        F.col(text).alias("text"),
        *[F.col(c).cast("string").alias(f"carried_{c}") for c in carry],
    )
    names = tuple(f"carried_{c}" for c in carry)
    kinds = "".join(f", {n} string" for n in names)
    return rows.mapInArrow(
        lambda batches: _signed(batches, n_halves, names),
        "doc_id long, row long, n_words long, n_shingles long, same binary, halves array<bigint>" + kinds,
    ).withColumnsRenamed(dict(zip(names, carry, strict=True)))


def meetings(classes: DataFrame, n_halves: int) -> DataFrame:
    """``frame`` and ``same``: classes that share a table key with the class ``frame``, which is the least under that key.

    Classes that share no half of the first collection share no key; they drop out before the keys are spelt out.
    """
    halves = classes.select("same", F.posexplode(F.slice("halves", 1, n_halves)).alias("i", "u"))
    # What is joined with a table that was grouped by the same key is written first: only where both sides have a
    # shuffle of their own can adaptive execution split a hot key.
    busy = materialise(halves.groupBy("i", "u").agg(F.count("*").alias("n")).where("n > 1").select("i", "u"))
    # Halves of the second collection come to those that are left only.
    left = halves.join(busy, ["i", "u"], "left_semi")
    others = classes.select("same", F.slice("halves", n_halves + 1, n_halves).alias("vs"))
    keyed = left.join(others, "same").select(
        "same", F.explode(F.transform("vs", lambda v, j: F.xxhash64("i", "u", j, v))).alias("key")
    )
    keyed = materialise(keyed)
    least = keyed.groupBy("key").agg(F.min("same").alias("frame"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(materialise(least.select("key", "frame")), "key").select("frame", "same").distinct()


def _block_count(where: Column) -> Column:
    """Blocks for the members of a frame that fulfil ``where``; none for no members."""
    shingles, texts = F.sum(F.when(where, F.col("n_shingles"))), F.count(F.when(where, 1))
    return F.greatest(F.ceil(shingles / BLOCK_SHINGLES), F.ceil(texts / BLOCK_TEXTS)).cast("int")


def _with_pivots(met: DataFrame, frames: DataFrame) -> DataFrame:
    """The members of large frames once each, in blocks on side 1, and the frame's pivot on side 0 of every block."""
    members = met.where("same <> frame").join(frames, "frame")
    numbers = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("low")
    pivots = frames.select("frame", numbers, F.lit(0).alias("high"), F.lit(0).alias("side"), F.col("frame").alias("same"))
    dealt = F.pmod(F.hash("same", "frame"), F.col("blocks")).alias("low")
    return members.select("frame", dealt, F.lit(0).alias("high"), F.lit(1).alias("side"), "same").union(pivots)


def _others(met: DataFrame, frames: DataFrame, tied: DataFrame) -> DataFrame:
    """Members of large frames once for every pair of blocks that is still to compare.

    Blocks of free texts are numbered from 0, those of the tied ones after them; two blocks of tied texts are no pair.
    Where all are tied, nothing is left.
    """
    marked = met.join(frames.select("frame"), "frame").join(tied, ["frame", "same"], "left")
    marked = materialise(marked.withColumn("tied", F.coalesce("tied", F.col("same") == F.col("frame"))))
    counts = marked.groupBy("frame").agg(
        _block_count(~F.col("tied")).alias("free"), F.coalesce(_block_count(F.col("tied")), F.lit(0)).alias("bound")
    )
    dealt = marked.join(materialise(counts.where("free > 0")), "frame")
    number = F.hash("same", "frame")
    side = F.when(F.col("tied"), F.col("free") + F.pmod(number, F.col("bound"))).otherwise(F.pmod(number, F.col("free")))
    last = F.when(F.col("tied"), F.col("free")).otherwise(F.col("free") + F.col("bound")) - 1
    other = F.explode(F.sequence(F.lit(0), last)).alias("other")
    return dealt.select("frame", "same", side.alias("side"), other).select(
        "frame", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "same"
    )


def _links(blocks: DataFrame, sets: DataFrame, shared: int) -> DataFrame:
    """Links ``a``, ``b`` that join the texts of each block, between its sides if it has two; ``b`` is the first by side."""
    whole = blocks.join(sets, "same").select("frame", "low", "high", "side", "same", "shingles")
    dealt = whole.repartition("frame", "low", "high").sortWithinPartitions("frame", "low", "high", "side")
    return dealt.mapInArrow(lambda batches: _compared(batches, shared), "a binary, b binary")


def near_links(docs: DataFrame, signed: DataFrame, text: str = "text", key: str = "doc_id", shared: int = SHARED) -> DataFrame:
    """Links ``a``, ``b`` between classes, enough to join all classes that links of the full sets join.

    ``signed`` is ``signatures(docs)`` for the same limit ``shared``, written.
    """
    classes = materialise(
        signed.where("n_shingles > 0")
        .groupBy("same")
        .agg(F.min("row").alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("halves").alias("halves"))
    )
    met = materialise(meetings(classes, halves_for(shared)).join(classes.select("same", "n_shingles"), "same"))
    # Written, so that its size is known: where it is small, texts are looked up as they are read, not shuffled.
    rows = materialise(classes.join(met.select("same").distinct(), "same", "left_semi").select("row"))
    texts = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"))
    sets = materialise(
        texts.join(rows, "row", "left_semi")
        .dropDuplicates(["row"])
        .select("text")
        .mapInArrow(_shingled, "same binary, shingles array<bigint>")
    )
    frames = materialise(met.groupBy("frame").agg(_block_count(F.lit(True)).alias("blocks")))
    one, zero = frames.where("blocks = 1"), F.lit(0)
    small = met.join(one, "frame").select("frame", zero.alias("low"), zero.alias("high"), zero.alias("side"), "same")
    large = frames.where("blocks > 1")
    star = materialise(_links(_with_pivots(met, large), sets, shared))
    tied = star.select(F.col("b").alias("frame"), F.col("a").alias("same"), F.lit(True).alias("tied"))
    return star.union(_links(small.union(_others(met, large, tied)), sets, shared))


def grouped(docs: DataFrame, text: str = "text", key: str = "doc_id", shared: int = SHARED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row ``doc_id``, ``row``, ``n_words``, ``n_shingles``, ``root`` (128 bits that name its component),
    ``component_id`` and the columns of ``carry`` as text; rows without words have no root and are their own component."""
    signed = materialise(signatures(docs, text, key, shared, carry))
    # What the links are found with is deleted as soon as they are, and so is what joins them.
    links = distilled(lambda: near_links(docs, signed, text, key, shared))
    rooted = distilled(lambda: components(links).select(F.col("node").alias("same"), "root"))
    ids = signed.where("n_shingles > 0").groupBy("same").agg(F.min("doc_id").alias("least"))
    placed = materialise(ids.join(rooted, "same", "left").select("same", "least", F.coalesce("root", "same").alias("root")))
    ends = materialise(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    found = placed.join(ends, "root").select("same", "root", "component_id")
    own = ["doc_id", "row", "n_words", "n_shingles", *carry]
    some = signed.where("n_shingles > 0").select(*own, "same").join(found, "same", "left")
    none = signed.where("n_shingles = 0").select(
        *own, F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("component_id")
    )
    return some.drop("same").unionByName(none)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shared: int = OP8_SHARED) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    The component is the smallest key that links reach, itself included. A null or empty text has no shingles and is
    linked with nothing; its component is its own key. Repeated rows are copies of each other. Null keys take part
    without being a smallest key; a component of null keys alone has a null id. ``kept`` says whether the key is the
    component's.
    """
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return grouped(docs, text, key, shared).select("doc_id", "n_shingles", "component_id", same.alias("kept"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"), shared=OP8_SHARED)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, with all its columns: the one of the smallest key, nulls last.

    Of repeated rows one stays. Texts without words are in no component and all stay.
    """
    rows = grouped(docs, shared=SHARED).where("root is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    chosen = rows.groupBy("root").agg(first.alias("first")).select("first.row")
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    packed = docs.where(wordy).select(F.struct("*").alias("whole"), F.xxhash64("doc_id", "text").alias("row"))
    # Both are dealt by the row's hash, so that taking one of equal rows needs no further shuffle.
    single = packed.join(chosen, "row").groupBy("row", "whole.doc_id").agg(F.first("whole").alias("whole"))
    return single.select("whole.*").union(docs.where(~wordy))
