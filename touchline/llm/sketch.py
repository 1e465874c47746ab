"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds every shingle hash below a fixed share of the hash range, so its size follows the document's, sketches
of parts merge into the sketch of the whole, and the share of one sketch inside another estimates containment, however
unequal the documents are. A text whose hashes all lie above the limit keeps its smallest one.

Shingles are of five words; a shorter text is one shingle. A word's hash is taken from its MD5, a shingle's is a
polynomial of its words' hashes in two lanes modulo a prime, so that SQL can compute both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.common import python_workers, table
from touchline.llm.shingles import WIDTH, split
from touchline.session import materialise

#: One in this many hashes is below the limit.
SCALE = 16
PRIME = 2**31 - 1
BASES = (1_000_003, 998_244_353)
LIMIT = PRIME // SCALE
#: Words whose hashes a worker remembers.
KNOWN_WORDS = 500_000


class _WordLanes(dict):
    """Both lanes of each word's hash in one integer."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        digits = hashlib.md5(word, usedforsecurity=False).hexdigest()
        value = self[word] = (int(digits[:8], 16) % PRIME << 31) | int(digits[8:16], 16) % PRIME
        return value


_lanes = _WordLanes()


def fingerprint(text: str | None) -> np.ndarray:
    """The sorted hashes that the sketch of a text holds; none without words."""
    words = split(text)
    if not words:
        return np.empty(0, np.int64)
    both = np.fromiter(map(_lanes.__getitem__, words), np.int64, len(words))
    width = min(WIDTH, len(words))
    length = len(words) - width + 1
    first, second = np.zeros(length, np.int64), np.zeros(length, np.int64)
    for k in range(width):
        part = both[k : k + length]
        first = (first * BASES[0] + (part >> 31) + 1) % PRIME
        second = (second * BASES[1] + (part & PRIME) + 1) % PRIME
    low = first < LIMIT
    whole = (first << 31) | second
    return np.unique(whole[low]) if low.any() else whole.min(keepdims=True)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the smaller sketch that the other holds; 1 between two empty sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the shingles of both: hashes below the limit, else the smallest."""
    both = np.union1d(a, b)
    low = both[both >> 31 < LIMIT]
    return low if len(low) else both[:1]


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as much of the beginning of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.binary()),
        ("fingerprint", pa.binary()),
        ("edited_fingerprint", pa.binary()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
_RESULT_SQL = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _row(key: int | None, text: str, own: np.ndarray, following: str, next_own: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = own if changed == text else fingerprint(changed)
    return (
        key,
        len(text),
        hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(),
        own.astype(">i8").tobytes(),
        other.astype(">i8").tobytes(),
        likeness(own, other),
        likeness(own, next_own),
    )


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition with their successors. The first and the last row carry their text for the joint."""
    place = TaskContext.get().partitionId()
    schema = pa.schema([*_RESULT, ("place", pa.int64()), ("head", pa.string()), ("tail", pa.string())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
        )

    held: tuple | None = None  # the row whose successor is not known yet, its sketch, whether it is the first
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = fingerprint(text)
            if held is not None:
                key0, text0, own0, first = held
                rows.append((*_row(key0, text0, own0, text, own), place, text0 if first else None, None))
            held = (key, text, own, held is None)
        if rows:
            yield out(rows)
    if held is not None:
        key, text, _, first = held
        yield out([(key, *[None] * 6, place, text if first else None, text)])


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(k, a, fingerprint(a), b, fingerprint(b)) for k, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[n] for r in rows], f.type) for n, f in enumerate(_RESULT)], schema=_RESULT
        )


def in_turn(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row's sketch, and the one of its text edited with the next row's, by descending key.

    Null keys come last, equal keys in the order of a hash of the text; equal rows are interchangeable. A null text is
    empty. After the last row comes the first; a row that is alone is followed by itself.

    The texts are shuffled once, by ranges of the key. Each range works through its rows in order and hands on its
    first and last text; the ranges are then joined at these, two rows a range.
    """
    python_workers(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    order = [F.desc_nulls_last("doc_id"), F.asc("tie")]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("tie"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    done = materialise(ranged.mapInArrow(_along, f"{_RESULT_SQL}, place long, head string, tail string"))
    heads = done.where("head is not null").select("place", F.col("head").alias("following"))
    tails = done.where("tail is not null").select("place", "doc_id", F.col("tail").alias("text"))
    # A number for each range; only these go through one task.
    everywhere = Window.orderBy("place")
    whole = everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = heads.select("place").select(
        "place", F.coalesce(F.lead("place").over(everywhere), F.first("place").over(whole)).alias("next")
    )
    joints = (
        tails.join(turns, "place")
        .join(heads.withColumnRenamed("place", "next"), "next")
        .select("doc_id", "text", "following")
        .mapInArrow(_joint, _RESULT_SQL)
    )
    return done.where("tail is null").select(joints.columns).union(joints)


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, in hexadecimal digits, 16 for each hash."""
    found = in_turn(table(spark, sf_dir, "documents"))
    texts = [_hex(F.col(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    return found.select("doc_id", "n_chars", *texts, "near_edited", "near_next")


def _duck_sketch(source: str) -> str:
    """Sketches of the texts ``t`` of a table with a row number ``r``, by ``r``."""
    step = lambda lane, k: f"(({{}}) * {BASES[lane]} + w[i + {k}].h{lane} + 1) % {PRIME}"

    def poly(lane: int, width: int) -> str:
        text = "0::bigint"
        for k in range(width):
            text = step(lane, k).format(text)
        return text

    cases = " ".join(f"when {n} then {{{n}}}" for n in range(1, WIDTH))
    lanes = [
        f"case len(w) {cases.format('', *[poly(lane, n) for n in range(1, WIDTH)])} else {poly(lane, WIDTH)} end"
        for lane in (0, 1)
    ]
    return rf"""
  select r, list_sort(case when len(list_filter(hs, lambda h: h // 2147483648 < {LIMIT})) > 0
                          then list_filter(hs, lambda h: h // 2147483648 < {LIMIT}) else [list_min(hs)] end) as f
  from (
    select r, list_distinct(list(h)) as hs from (
      select r, ({lanes[0]}) * 2147483648 + ({lanes[1]}) as h
      from (
        select r, w, unnest(range(1, greatest(len(w) - {WIDTH - 2}, 2))) as i from (
          select r, list_transform(
              regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'),
              lambda x: {{'h0': ('0x' || substr(md5(x), 1, 8))::bigint % {PRIME},
                          'h1': ('0x' || substr(md5(x), 9, 8))::bigint % {PRIME}}}) as w
          from {source}) where len(w) > 0))
    group by r)"""


_LIKE = """case when a.f is null and {0}.f is null then 1.0 when a.f is null or {0}.f is null then 0.0
       else len(list_intersect(a.f, {0}.f))::double / least(len(a.f), len({0}.f)) end"""
_DUCK_HEX = "coalesce(array_to_string(list_transform({0}.f, lambda x: printf('%016x', x)), ''), '')"

ORACLE = rf"""
with docs as materialized (
  select row_number() over (order by doc_id desc) as r, doc_id, coalesce(text, '') as t from documents
), turns as materialized (
  select r, doc_id, t, coalesce(lead(r) over (order by r), 1) as nr,
         coalesce(lead(t) over (order by r), first(t) over (order by r)) as nt
  from docs
), changed as materialized (
  select r, left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2) as t from turns
), own as materialized ({_duck_sketch("docs")}
), other as materialized ({_duck_sketch("changed")}
)
select doc_id, length(turns.t)::bigint as n_chars, sha256(changed.t) as edited_sha256,
       {_DUCK_HEX.format("a")} as fingerprint, {_DUCK_HEX.format("b")} as edited_fingerprint,
       {_LIKE.format("b")} as near_edited, {_LIKE.format("c")} as near_next
from turns join changed using (r) left join own a using (r) left join other b using (r) left join own c on c.r = turns.nr
"""
