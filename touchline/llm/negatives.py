"""Hard negatives by exact integer scores from Kronecker-packed products.

Components are scaled to integers. The components of thousands of candidates, each raised by a bias so that none is
negative, stand in separate fields of one wide integer, one such integer for each component. An anchor's component
multiplies all of them at once; the sum of these products over the components holds every candidate's raw score in its
field, and taking off what the biases added leaves the exact scores. Fields are as wide as the largest possible sum
needs, so nothing ever runs over into the next field.

Rows are dealt into blocks of bounded size, and anchors go to each block, so a task holds one block and reads the
anchors one after another. A block returns its best rows for each anchor; the best of all blocks are found by rank.
Positives are looked for among the blocks of the anchor's own label, then negatives among all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import python_workers, table
from touchline.session import materialise

#: Components become the floor of this many times their value.
SCALE = 256
#: Positives of an anchor and negatives of a positive.
POSITIVES = NEGATIVES = 5
#: A negative has at least this many hundredths of the positive's score, and at most all of it.
LEAST = 80
#: A block of rows holds about this many components; a pack is that part of a block that one wide integer holds.
BLOCK_COMPONENTS = 1 << 20
PACK_ROWS = 4_096

_LONG = 2**63 - 1
#: Scores below this are worked out in 64 bits; beyond it Python's integers are.
_SAFE = 2**55

_FOUND = "anchor_row long, anchor_id long, place int, positive_id long, positive_score long, score long, vec_id long, row long"


def integers(values: np.ndarray) -> np.ndarray:
    """The floor of ``SCALE`` times each value: 64-bit integers, or Python's where one would not fit."""
    if values.size and np.abs(values).max() >= 2.0**53:
        # From there on doubles are whole numbers.
        whole = [int(x) * SCALE if abs(x) >= 2.0**53 else int(np.floor(x * SCALE)) for x in values.ravel()]
        return np.array(whole, object).reshape(values.shape)
    return np.floor(values * SCALE).astype(np.int64)


class Packed:
    """Candidates, a row each, packed column by column into wide integers."""

    def __init__(self, rows: np.ndarray) -> None:
        if rows.size and np.abs(rows).max() * rows.shape[1] >= 2**62:
            rows = rows.astype(object)
        self.n, self.dim = rows.shape
        self.bias = max(0, -int(rows.min())) if rows.size else 0
        self.biased = rows + self.bias
        self.most = int(self.biased.max()) if rows.size else 0
        self.sums = rows.sum(1) if self.dim else np.zeros(self.n, np.int64)
        self.far = int(np.abs(self.sums).max()) if self.n else 0
        self.known: dict[int, list[int]] = {}

    def columns(self, width: int) -> list[int]:
        """For each component the candidates' biased values, one in each field of ``width`` bits."""
        if width not in self.known:
            if width <= 64:
                kind = "<u4" if width == 32 else "<u8"
                spelt = [self.biased[:, j].astype(kind).tobytes() for j in range(self.dim)]
            else:
                spelt = [b"".join(int(v).to_bytes(width // 8, "little") for v in self.biased[:, j]) for j in range(self.dim)]
            self.known[width] = [int.from_bytes(s, "little") for s in spelt]
        return self.known[width]

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The inner product of ``anchor`` and each candidate."""
        shift = max(0, -min(anchor, default=0))
        lifted = [a + shift for a in anchor]
        total = sum(lifted)
        field = self.most * total
        small = max(field, shift * self.far, self.bias * total) < _SAFE
        width = 32 if field < 2**32 else 64 if small else 64 * (field.bit_length() // 64 + 1)
        product = sum(map(mul, lifted, self.columns(width)))
        size = width // 8
        spelt = product.to_bytes(size * self.n, "little")
        if width <= 64:
            raw = np.frombuffer(spelt, "<u4" if width == 32 else "<u8").astype(np.int64)
        else:
            raw = np.array([int.from_bytes(spelt[k : k + size], "little") for k in range(0, len(spelt), size)], object)
        sums = self.sums
        if not small:
            raw, sums = raw.astype(object), sums.astype(object)
        return raw - shift * sums - self.bias * total


def best(scores: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """Those ``most`` of ``places`` with the highest scores, in that order; of equal scores the first places."""
    if len(places) <= 1:
        return places
    there = scores[places]
    if there.dtype == object or np.abs(there).max() >= 2**62 // len(scores):
        return places[sorted(range(len(places)), key=lambda k: (-there[k], places[k]))[:most]]
    key = places - there * len(scores)  # unlike for unlike places
    if len(places) > most:
        chosen = np.argpartition(key, most - 1)[:most]
        places, key = places[chosen], key[chosen]
    return places[np.argsort(key)]


def _matrix(column: pa.Array) -> list[np.ndarray]:
    """Each row's components as doubles."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Block:
    """The candidates of a block, by key."""

    def __init__(self, ids: list[int], rows: list[int], labels: list[int], vectors: list[np.ndarray]) -> None:
        self.ids, self.rows, self.labels = (np.array(x, np.int64) for x in (ids, rows, labels))
        self.dim = max(map(len, vectors), default=0)
        self.packs = []
        for first in range(0, len(vectors), PACK_ROWS):
            part = vectors[first : first + PACK_ROWS]
            held = np.zeros((len(part), self.dim))
            for row, vector in zip(held, part, strict=True):
                row[: len(vector)] = vector
            self.packs.append(Packed(integers(held)))

    def scores(self, vector: np.ndarray) -> np.ndarray:
        anchor = integers(vector[: self.dim]).tolist()
        anchor += [0] * (self.dim - len(anchor))
        parts = [p.scores(anchor) for p in self.packs]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def positives(self, row: int, label: int, vector: np.ndarray) -> list[tuple[int, None, None, int, int, int]]:
        scores = self.scores(vector)
        places = np.flatnonzero((self.labels == label) & (self.rows != row))
        return [(0, None, None, *self._told(scores, k)) for k in best(scores, places, POSITIVES)]

    def negatives(self, label: int, vector: np.ndarray, positives: list[dict]) -> list[tuple[int, int, int, int, int, int]]:
        scores = self.scores(vector)
        limits = [p["score"] for p in positives]
        within = (self.labels != label) & (scores <= max(limits)) & (100 * scores >= LEAST * min(limits))
        near = np.flatnonzero(within)
        out = []
        for place, p in enumerate(positives):
            there = scores[near]
            chosen = near[(there <= p["score"]) & (100 * there >= LEAST * p["score"])]
            out += [(place, p["vec_id"], p["score"], *self._told(scores, k)) for k in best(scores, chosen, NEGATIVES)]
        return out

    def _told(self, scores: np.ndarray, k: int) -> tuple[int, int, int]:
        return max(-_LONG, min(_LONG, int(scores[k]))), int(self.ids[k]), int(self.rows[k])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each anchor finds in its block. The rows of a block follow each other, candidates by key and then anchors."""
    key, block, kept = None, None, ([], [], [], [])
    names = [part.split()[0] for part in _FOUND.split(", ")]
    for batch in batches:
        keys, anchors, ids, rows, labels = (batch.column(k).to_pylist() for k in range(5))
        vectors, positives = _matrix(batch.column(5)), batch.column(6).to_pylist()
        out: list[tuple] = []
        for k, now in enumerate(keys):
            if now != key:
                key, block, kept = now, None, ([], [], [], [])
            if not anchors[k]:
                for whole, part in zip(kept, (ids[k], rows[k], labels[k], vectors[k]), strict=True):
                    whole.append(part)
                continue
            if block is None:
                block, kept = Block(*kept), ([], [], [], [])
            if positives[k] is None:
                found = block.positives(rows[k], labels[k], vectors[k])
            else:
                found = block.negatives(labels[k], vectors[k], positives[k])
            out += [(rows[k], ids[k], *f) for f in found]
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        kinds = [pa.int32() if name == "place" else pa.int64() for name in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _meet(candidates: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """The best ``most`` rows for each anchor and place. Both sides have ``block``; an anchor has a row for each of its blocks."""
    own = ["block", "vec_id", "row", "label", "vector", "positives"]
    none = F.lit(None).cast("array<struct<score:bigint,vec_id:bigint>>")
    both = candidates.withColumn("positives", none).select(*own, F.lit(False).alias("anchor")).unionAll(
        anchors.select(*own, F.lit(True).alias("anchor"))
    )
    dealt = both.select("block", "anchor", *own[1:]).repartition("block").sortWithinPartitions("block", "anchor", "vec_id", "row")
    found = dealt.mapInArrow(_met, _FOUND)
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def taking_part(rows: DataFrame, vector: str, label: Column, key: str) -> DataFrame:
    """``vec_id``, ``row``, ``label`` and ``vector`` of the rows that take part, written.

    Rows without a key, a label or a vector, or with a component that is null, infinite or not a number, take none.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    taking = rows.where(F.col(key).isNotNull() & label.isNotNull() & x.isNotNull() & finite)
    named = taking.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("vector"))
    return materialise(named.withColumn("row", F.monotonically_increasing_id()))


def hard_negatives(rows: DataFrame, anchors: Column, vector: str = "embedding", label: Column | None = None, key: str = "vec_id") -> DataFrame:
    """For each anchor and each of its positives, its hard negatives by rank.

    ``anchors`` is a condition on ``vec_id``. An anchor's positives are the ``POSITIVES`` other rows of its label with
    the highest scores; the negatives of a positive are the ``NEGATIVES`` best rows of other labels whose score is
    between ``LEAST`` hundredths of the positive's and all of it. Equal scores come by key. An anchor without a positive,
    and a positive without a negative, give no row. Repeated rows are rows each, also as anchors. A vector that is
    shorter than another has zeros at its end, an empty one only zeros. A score beyond 64 bits is told as the largest
    or smallest one. Other columns take no part.
    """
    python_workers(rows.sparkSession)
    taking = taking_part(rows, vector, F.col("label") if label is None else label, key)
    n, dim = taking.agg(F.count("*"), F.max(F.size("vector"))).first()
    block_rows = max(1, BLOCK_COMPONENTS // max(1, dim or 0))
    deal = F.xxhash64("row")
    asked = materialise(taking.where(anchors))
    # Blocks of the labels that have an anchor; written first, so that the join can split a label of very many rows.
    slots = materialise(
        taking.groupBy("label").agg(F.ceil(F.count("*") / block_rows).alias("slots"))
        .join(asked.select("label").distinct(), "label", "left_semi")
    )
    block = F.xxhash64("label", "slot").alias("block")
    own = taking.join(slots, "label").withColumn("slot", F.pmod(deal, "slots"))
    to_all = asked.join(slots, "label").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    none = F.lit(None).cast("array<struct<score:bigint,vec_id:bigint>>").alias("positives")
    found = _meet(own.select("*", block), to_all.select("*", block, none), POSITIVES)
    ranked = F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id")))
    by_anchor = found.groupBy(F.col("anchor_row").alias("row")).agg(ranked.alias("ranked"))
    positives = F.transform("ranked", lambda p: F.struct(p["score"], p["vec_id"])).alias("positives")
    judged = materialise(asked.join(by_anchor, "row").select("vec_id", "row", "label", "vector", positives))
    blocks = -(-n // block_rows)
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, blocks) - 1).cast("long"))).alias("block")
    last = _meet(taking.withColumn("block", F.pmod(deal, F.lit(max(1, blocks)))), judged.select("*", everywhere), NEGATIVES)
    return last.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose key is divisible by 100, against all rows."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


ORACLE = f"""
with taking as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as materialized (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from taking a join taking b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES}
)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and {LEAST} * positive_score <= 100 * score and score <= positive_score
qualify rank <= {NEGATIVES}
"""
