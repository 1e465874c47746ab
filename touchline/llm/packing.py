"""Best-fit packing of documents into training sequences, with conflicts.

A sequence (bin) holds ``CAPACITY`` words. It never holds two pieces of one source, nor two of one cluster of
duplicates. Documents longer than a bin are cut into pieces. The pieces are put in order by a hash of key and text and
dealt in turn into shards of bounded size, so that neither the layout of the files nor copies of one row decide where
one goes. Each shard is packed on its own, largest piece first: its bins are ordered by what is left in them and carry
bitmaps of their sources and clusters. The search begins at the bin that the piece would fill best and goes on to the next
larger rest until a bin has neither the source nor the cluster; if there is none, a bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import neardup
from touchline.llm.common import python_workers, table, word_list
from touchline.llm.ranks import ranked

#: Words of a sequence.
CAPACITY = 2_048
#: Pieces of a shard, about. The search passes over bins in conflict, so the work of a shard grows with its square.
SHARD_PIECES = 2_000

_PLACED = "doc_id long, piece int, first_word long, n_words long, bin_id long, slot int, left_over long"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each piece, in the order given. ``sources`` and ``clusters`` are bitmaps of one bit, or none."""
    order: list[tuple[int, int]] = []  # what is left, bin
    held: list[tuple[int, int]] = []  # bitmaps of sources and clusters
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        at = bisect_left(order, (size, -1))
        while at < len(order) and (held[order[at][1]][0] & source or held[order[at][1]][1] & cluster):
            at += 1
        if at < len(order):
            left, chosen = order.pop(at)
            held[chosen] = (held[chosen][0] | source, held[chosen][1] | cluster)
        else:
            left, chosen = capacity, len(held)
            held.append((source, cluster))
        insort(order, (left - size, chosen))
        out.append(chosen)
    return out


def _bits(values: pd.Series) -> list[int]:
    """One bit for each value that occurs twice or more; values that occur once conflict with nothing."""
    codes = values.map(values.value_counts()).gt(1)
    places = {v: k for k, v in enumerate(values[codes].unique())}
    return [1 << places[v] if v in places else 0 for v in values]


def _packed(capacity: int):
    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n_words", "rank"], ascending=[False, True], kind="stable")
        bins = best_fit(shard["n_words"].tolist(), _bits(shard["source"]), _bits(shard["cluster"]), capacity)
        shard["bin_id"] = shard["shard"].astype("int64") * (1 << 32) + pd.Series(bins, shard.index, dtype="int64")
        by_bin = shard.groupby("bin_id")
        shard["slot"] = by_bin.cumcount().astype("int32")
        shard["left_over"] = capacity - by_bin["n_words"].transform("sum")
        return shard[["doc_id", "piece", "first_word", "n_words", "bin_id", "slot", "left_over"]]

    return pack


def sizes(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``row`` (hash of key and text), ``source`` and ``n_words`` of every row, without clusters."""
    return docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.xxhash64(F.col(key), F.col(text)).alias("row"),
        F.col(source).cast("string").alias("source"),
        F.size(word_list(F.col(text))).cast("long").alias("n_words"),
        F.lit(None).cast("string").alias("cluster"),
    )


def near_sizes(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The same, with the component of near duplicates as the cluster of every row with words; texts are split once."""
    found = neardup.grouped(docs, text, key, neardup.SHARED, (source,))
    return found.select("doc_id", "row", F.col(source).alias("source"), "n_words", F.hex("root").alias("cluster"))


def pieces(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every row of ``sizes`` or ``near_sizes``.

    A null or empty text is one piece of no words, which conflicts with pieces of its source only. Null sources are one
    source. A text of any length is cut into as many pieces as it fills. Repeated rows are documents each. Other columns
    take no part.
    """
    last = F.greatest(F.ceil(F.col("n_words") / capacity), F.lit(1)).cast("int") - 1
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    first = F.col("piece").cast("long") * capacity
    return cut.select(
        "doc_id", "row", F.coalesce("source", F.lit("")).alias("source"), "cluster", "piece", first.alias("first_word"),
        F.least(F.lit(capacity).cast("long"), F.col("n_words") - first).alias("n_words"),
    )


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Each piece with its bin, its place in the bin and the words the bin has left over.

    Only the sizes, sources and cluster names of the pieces are shuffled. A cluster or source of any size is dealt over
    all shards, and so are copies of one row, which follow each other in the order. A shard never has more than
    ``SHARD_PIECES``; what its last bins have left over is the price of that, and falls with the size of the shard.
    """
    python_workers(cut.sparkSession)
    placed = ranked(cut, [], ["row", "piece", "source", "cluster"])
    shards = max(1, -(-placed.count() // SHARD_PIECES))
    dealt = placed.withColumn("shard", F.pmod("rank", F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_packed(capacity), _PLACED)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document. Near duplicates, linked at a similarity of 0.8, are one cluster."""
    return pack(pieces(near_sizes(table(spark, sf_dir, "documents"))))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of the documents that the stages before kept; near duplicates are gone by then."""
    return pack(pieces(sizes(docs)))
