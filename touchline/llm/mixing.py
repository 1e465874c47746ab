"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the copies the mix takes of it on average, so that each source's words come to its target.
Of all such rates those are sought that differ least, in relative entropy, from taking every document once, and that
nowhere exceed ``CAP``. The dual of this convex problem has one multiplier for each source, and the rates are
exponentially tilted, ``min(CAP, exp(multiplier * words))``. Newton iterations find the multipliers of all sources at
once: each is one grouping of (source, size) classes, which is all that rates depend on, kept inside a bracket by
halving it where a step would leave it. Sums are over whole numbers, so that they do not depend on their order.

Rates are then rounded to copies. From the largest size of a source to the smallest, each class takes the whole copies
that bring the words taken nearest to the words due so far; what one class is over or under, the next ones make up for.
Within a class some documents get a copy more than others; a hash puts them in order.

Everything is built from DataFrame functions. Texts are read once for their sizes; after that only keys and sizes move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import let, table, word_list
from touchline.llm.ranks import ranked
from touchline.session import materialise

#: Weights of the sources in their order, repeating; words of the mix as a share of all words; copies at most.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: A source is done when the words due are this near its target, or after so many iterations.
NEAR = 0.5
ITERATIONS = 100
#: Sums count in this part of a word.
UNIT = 1 << 16
#: Classes that are rounded as one array; their results are appended whole.
RUN = 256

_SUM = "decimal(38,0)"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``sources`` (``source``, ``source_size``, ...) with ``target``, the words that the mix takes of each. Written.

    Sources by code point, null last, have the weights in turn. A target stops at ``cap`` times the size; what is over
    goes to the others by weight until none is above.
    """
    placed = ranked(sources.withColumn("__null", F.col("source").isNull()), [], ["__null", "source"], "place").drop("__null")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    weighed = materialise(placed.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        # The level only rises, so each round stops more sources; it ends when a round stops no further one.
        over = F.col("most") < level * F.col("weight")
        stopped, taken, left = weighed.agg(
            F.count_if(over), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if stopped == full or not left:
            break
        level, full = (share * total - (taken or 0)) / left, stopped
    return materialise(
        weighed.withColumn("target", F.least(F.col("most").cast("double"), F.lit(float(level)) * F.col("weight"))).drop("most")
    )


def rates(classes: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """``source`` and ``factor``: the multiplier of each source with words and a target, for sizes in words. Written.

    ``classes`` is ``source``, ``size`` (above 0) and ``n``; ``sources`` has ``source_size`` and ``target``. A source
    whose target is ``cap`` times its size has no finite multiplier; its factor is infinite.
    """
    limit = F.log(F.lit(float(cap)))
    ratio = F.col("target") / F.col("source_size")
    least = classes.groupBy("source").agg(F.min("size").alias("least"))
    joined = least.withColumnRenamed("source", "__s").join(sources, F.col("__s").eqNullSafe(F.col("source"))).drop("__s")
    # Below the bracket every rate is too low, even the shortest document's; above it every rate is the cap.
    state = materialise(
        joined.where("target > 0 and source_size > 0").select(
            "source", "target",
            F.when(F.col("target") >= cap * F.col("source_size"), F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("factor"),
            F.least(F.lit(0.0), F.log(ratio) / F.col("least")).alias("low"),
            F.when(ratio > 1, limit / F.col("least")).otherwise(F.lit(0.0)).alias("high"),
            (F.col("target") >= cap * F.col("source_size")).alias("done"),
        )
    )
    for _ in range(ITERATIONS):
        if state.where("not done").isEmpty():
            break
        state = materialise(_newton(classes, state, cap))
    return state.select("source", "factor")


def _rate(factor: Column, size: Column, cap: int) -> Column:
    """The exponent is held at the cap's first, so that nothing overflows."""
    return F.when(factor * size >= F.log(F.lit(float(cap))), F.lit(float(cap))).otherwise(F.exp(factor * size))


def _whole(value: Column) -> Column:
    return F.round(value * UNIT).cast(_SUM)


def _newton(classes: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """One step of every open source, on the logarithm of the words due; half the bracket where the step would leave it."""
    open_ = state.where("not done")
    met = classes.withColumnRenamed("source", "__s").join(open_, F.col("__s").eqNullSafe(F.col("source"))).drop("__s")
    rate = _rate(F.col("factor"), F.col("size"), cap)
    due = F.col("n") * F.col("size") * rate
    bends = F.when(rate < cap, due * F.col("size")).otherwise(F.lit(0.0))
    summed = met.groupBy("source", "target", "factor", "low", "high").agg(
        F.sum(_whole(due)).cast("double").alias("due"), F.sum(_whole(bends)).cast("double").alias("slope")
    )
    now, goal = F.col("due") / UNIT, F.col("target")
    low = F.when(now < goal, F.col("factor")).otherwise(F.col("low"))
    high = F.when(now > goal, F.col("factor")).otherwise(F.col("high"))
    narrowed = summed.withColumns({"low": low, "high": high, "near": F.abs(now - goal) <= NEAR})
    step = F.col("factor") - F.log(now / goal) * F.col("due") / F.nullif("slope", F.lit(0.0))
    inside = (step > F.col("low")) & (step < F.col("high"))
    onward = F.when(F.col("near"), F.col("factor")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
    moved = narrowed.select("source", "target", onward.alias("factor"), "low", "high", F.col("near").alias("done"))
    return state.where("done").unionByName(moved)


def copies(classes: DataFrame, sources: DataFrame, factors: DataFrame, cap: int = CAP) -> DataFrame:
    """``source``, ``size``, ``n`` and ``taken``, the copies that all documents of the class have together. Written.

    The classes of one source are one array. It is short: ``k`` different sizes need ``k * k / 2`` words or more.
    """
    known = sources.select("source", "target").withColumnRenamed("source", "__s").join(
        factors, F.col("__s").eqNullSafe(F.col("source"))
    ).drop("__s")
    sized = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "n")), False).alias("sizes"))
    met = sized.withColumnRenamed("source", "__s").join(known, F.col("__s").eqNullSafe(F.col("source"))).drop("__s")

    def due(c: Column) -> Column:
        return c["n"] * c["size"] * _rate(F.col("factor"), c["size"], cap)

    # What the rates are short of the target, by the limit of the iterations, is due from the start.
    expected = F.aggregate("sizes", F.lit(0.0), lambda a, c: a + due(c))
    kind = "array<struct<size:bigint,n:bigint,taken:bigint>>"

    def step(state: Column, c: Column) -> Column:
        owed = state["owed"] + due(c)
        taken = F.greatest(F.lit(0), F.least(F.round(owed / c["size"]).cast("long"), c["n"] * cap)).cast("long")
        row = F.struct(c["size"].alias("size"), c["n"].alias("n"), taken.alias("taken"))
        return F.struct((owed - taken * c["size"]).alias("owed"), F.array_append(state["out"], row).alias("out"))

    def run(state: Column, k: Column) -> Column:
        begin = F.struct(state["owed"].alias("owed"), F.array().cast(kind).alias("out"))
        part = F.slice("sizes", k + 1, F.lit(RUN))
        return let(
            F.aggregate(part, begin, step),
            lambda done: F.struct(done["owed"].alias("owed"), F.array_append(state["out"], done["out"]).alias("out")),
        )

    start = F.struct((F.col("target") - expected).alias("owed"), F.array().cast(f"array<{kind}>").alias("out"))
    runs = F.sequence(F.lit(0), F.size("sizes") - 1, F.lit(RUN))
    rounded = F.aggregate(runs, start, run, lambda state: F.flatten(state["out"]))
    return materialise(met.select("source", F.inline(rounded)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Per row: ``doc_id``, ``size`` in words, ``source_size``, ``target`` (of its source), ``copies`` and ``taken`` words.

    A null or empty text has no words, and no copies. Null sources are one source, the last. Repeated rows are documents
    each, and may have unlike copies; null keys take part. Other columns take none. ``weights`` are above 0.
    """
    sizes = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.size(word_list(F.col("text"))).cast("long").alias("size"),
        )
    )
    classes = materialise(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    some = classes.where("size > 0")
    taken = copies(some, sources, rates(some, sources, cap), cap)
    # A class may hold any share of the documents; they are put in order by ranges.
    placed = ranked(sizes.withColumn("dealt", F.xxhash64("doc_id")), ["source", "size"], ["dealt", "doc_id"])
    by_source = sources.select(F.col("source").alias("__s"), "source_size", "target")
    per_class = taken.select(F.col("source").alias("__c"), F.col("size").alias("__size"), "n", F.col("taken").alias("whole"))
    known = placed.join(by_source, F.col("source").eqNullSafe(F.col("__s"))).join(
        per_class, F.col("source").eqNullSafe(F.col("__c")) & (F.col("size") == F.col("__size")), "left"
    )
    # Whole copies for all, then one more for the first documents of the order.
    each = F.floor(F.col("whole") / F.col("n")) + (F.col("rank") < F.col("whole") % F.col("n")).cast("long")
    return known.select("doc_id", "size", "source_size", "target", F.coalesce(each, F.lit(0)).cast("long").alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size")
    )


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents"))
