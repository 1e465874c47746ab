"""Toxicity by class-conditional Kneser-Ney models.

Two models of the letters of words, one of toxic and one of ordinary texts, each tell how likely a letter is after the
``ORDER - 1`` before it. Both back off to one shared model: the counts of both classes together, and below them their
continuation counts. The less a class has seen of a context, the more the shared model speaks for it, so a rare
expression speaks for neither class. The log-likelihoods are compared per word: as the mean over the text, for the
word that speaks most for toxic, and as the mean of the ``STRONGEST`` such words.

The models are tables that keep every n-gram, however rare, and grow with the labelled texts: counts, contexts, the
levels of the shared model and the ratios are groupings and joins. Every different word of the corpus meets its n-grams
in a join. Texts meet the ratios of their words in a join, too; only the most frequent words are looked up on the way,
with the same values, since one of them would be a hot key. ``Ratios`` and ``Judge`` are the same models in memory,
which the tests hold the tables against.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from touchline.llm.common import crc_rest, python_workers, table
from touchline.session import distilled, materialise

#: Letters of an n-gram.
ORDER = 6
DISCOUNT = 0.75
#: Occurrences that the shared model counts for in every context of a class.
STRENGTH = 20.0
#: Words whose ratios are averaged beside the highest and the mean.
STRONGEST = 3
#: Labelled texts that the final decision is fitted on, at most about this many.
FIT_ROWS = 20_000
#: Words whose log-likelihood ratio a worker remembers.
KNOWN_WORDS = 500_000
#: The most frequent words, whose ratios the workers look up; all others meet theirs in a join. Changes no result.
FREQUENT = 200_000
#: Contexts, of a few letters each, whose n-grams are looked up in the same way.
FREQUENT_CONTEXTS = 20_000
#: Letters of such a word at most.
FREQUENT_LETTERS = 40
#: Ratios are added up in this part of one.
PART = 1 << 32
#: Different words that a worker counts before it hands them on.
COUNTED_WORDS = 200_000

START, END = "^", "$"
_WORDS = re.compile(r"[^\W\d_]+")
_LOOKED = "doc_id long, label int, total double, top array<double>, n_words long, others array<struct<word: string, times: bigint>>"


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def grams(word: str) -> list[str]:
    padded = START * (ORDER - 1) + word + END
    return [padded[k : k + ORDER] for k in range(len(padded) - ORDER + 1)]


def shared_backoff(types: list[str]) -> dict[str, float]:
    """Probability of the last letter after the others, for each suffix of the n-grams: interpolated Kneser-Ney from
    continuation counts, that is, from how many different letters come before a sequence."""
    known: dict[str, float] = {}
    levels: list[set[str]] = [set(types)]
    for _ in range(ORDER - 1):
        levels.append({g[1:] for g in levels[-1]})
    letters = len({g[-1] for g in types}) + 1
    below = defaultdict(lambda: 1 / letters)
    for length in range(1, ORDER):
        before: dict[str, int] = defaultdict(int)
        for g in levels[ORDER - length - 1]:
            before[g[1:]] += 1
        total: dict[str, int] = defaultdict(int)
        kinds: dict[str, int] = defaultdict(int)
        for g, n in before.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        level = {
            g: (n - DISCOUNT) / total[g[:-1]] + DISCOUNT * kinds[g[:-1]] / total[g[:-1]] * below[g[1:]]
            for g, n in before.items()
        }
        known.update(level)
        below = defaultdict(lambda: 1 / letters, level)
    return known


class Ratios:
    """Log-likelihood ratios of n-grams, and of the contexts for n-grams that neither class has."""

    def __init__(self, counts: list[tuple[str, int, int]]) -> None:
        below = shared_backoff([g for g, _, _ in counts])
        # Of each context: occurrences and kinds of following letters, by class and in all.
        seen: dict[str, list[int]] = defaultdict(lambda: [0] * 6)
        for gram, *both in counts:
            s = seen[gram[:-1]]
            for k, n in enumerate((*both, sum(both))):
                s[k] += n
                s[3 + k] += n > 0
        # What a context of a class leaves to the shared model.
        left = {h: [(DISCOUNT * s[3 + k] + STRENGTH) / (s[k] + STRENGTH) for k in (0, 1)] for h, s in seen.items()}
        self.context = {h: math.log(a / b) for h, (a, b) in left.items()}
        self.gram = {}
        for gram, *both in counts:
            h = gram[:-1]
            s = seen[h]
            shared = (sum(both) - DISCOUNT + DISCOUNT * s[5] * below[gram[1:]]) / s[2]
            p = [max(n - DISCOUNT, 0) / (s[k] + STRENGTH) + left[h][k] * shared for k, n in enumerate(both)]
            self.gram[gram] = math.log(p[0] / p[1])

    def of_word(self, word: str) -> float:
        gram, context = self.gram, self.context
        return sum([gram[g] if g in gram else context.get(g[:-1], 0.0) for g in grams(word)])


class Judge:
    """Measures of texts; remembers words."""

    def __init__(self, ratios: Ratios) -> None:
        self.ratios = ratios
        self.known: dict[str, float] = {}

    def measure(self, text: str | None) -> tuple[float, float, float, int]:
        """Log-likelihood ratio a word, that of the highest word, the mean of the strongest, and the number of words."""
        found = words(text)
        if not found:
            return 0.0, 0.0, 0.0, 0
        known = self.known
        new = set(found).difference(known)
        if new:
            if len(known) > KNOWN_WORDS:
                known.clear()
                new = set(found)
            of_word = self.ratios.of_word
            known.update({w: of_word(w) for w in new})
        values = np.fromiter(map(known.__getitem__, found), float, len(found))
        top = np.partition(values, -STRONGEST)[-STRONGEST:] if len(found) > STRONGEST else values
        return float(values.mean()), float(top.max()), float(top.sum()) / STRONGEST, len(found)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word``, ``part`` and ``n``: how often each word stands in the column ``text`` of the rows of each ``part``."""
    python_workers(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int | None, Counter] = defaultdict(Counter)

        def counted() -> pa.RecordBatch:
            rows = [(w, part, n) for part, c in counts.items() for w, n in c.items()]
            counts.clear()
            columns = zip(*rows, strict=True) if rows else ([],) * 3
            kinds = (pa.string(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "part", "n"])

        for batch in batches:
            for text, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[part].update(words(text))
            if sum(map(len, counts.values())) > COUNTED_WORDS:
                yield counted()
        yield counted()

    found = texts.select("text", F.col("part").cast("int")).mapInArrow(run, "word string, part int, n long")
    return found.groupBy("word", "part").agg(F.sum("n").alias("n"))


def class_counts(labelled: DataFrame, text: str = "text", label: str = "toxic", fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """``gram``, ``toxic`` and ``ordinary``: how often the words of each class's texts hold each n-gram, in the texts
    beyond fold 1 and in all.

    Words are counted first, so an n-gram is spelt out once per different word.
    """
    part = 2 * (F.col(fold) == 1).cast("int") + (F.col(label) == 1).cast("int")
    by_part = word_counts(labelled.select(F.col(text).alias("text"), part.alias("part")))
    kinds = ("ordinary", "toxic", "ordinary_1", "toxic_1")
    wide = by_part.groupBy("word").agg(*[F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(kinds)])
    summed = materialise(spelt(wide).groupBy("gram").agg(*[F.sum(c).alias(c) for c in kinds]))
    whole = summed.select("gram", *[(F.col(c) + F.col(f"{c}_1")).alias(c) for c in ("toxic", "ordinary")])
    return summed.select("gram", "toxic", "ordinary"), whole


def spelt(given: DataFrame) -> DataFrame:
    """Each row once for every n-gram of its ``word``: the other columns and ``gram``. The word itself stays behind."""
    python_workers(given.sparkSession)
    others = [f for f in given.schema.fields if f.name != "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(w) for w in batch.column(0).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(g) for g in found]))
            columns = [c.take(rows) for c in batch.columns[1:]]
            spelling = pa.array([g for f in found for g in f], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, spelling], names=[*batch.schema.names[1:], "gram"])

    schema = StructType([*others, StructField("gram", StringType())])
    return given.select("word", *[f.name for f in others]).mapInArrow(run, schema)


def backoff(types: DataFrame) -> DataFrame:
    """``gram`` and ``p`` of the sequences of ``ORDER - 1`` letters: ``shared_backoff`` of the different n-grams."""
    letters = types.select(F.right("gram", F.lit(1)).alias("last")).distinct().count() + 1
    levels = [types.select("gram")]
    for _ in range(ORDER - 1):
        shorter = F.substring("gram", 2, ORDER).alias("gram")
        levels.append(materialise(levels[-1].groupBy(shorter).agg(F.count("*").alias("n"))))
    below = None
    for length, level in enumerate(reversed(levels[1:]), 1):
        level = level.withColumn("context", F.substring("gram", 1, length - 1))
        seen = materialise(level.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")))
        level = level.join(seen, "context")
        if below is None:
            level = level.withColumn("lower", F.lit(1 / letters))
        else:
            level = level.withColumn("suffix", F.substring("gram", 2, ORDER)).join(
                below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix"
            )
        p = (F.col("n") - DISCOUNT) / F.col("total") + DISCOUNT * F.col("kinds") / F.col("total") * F.col("lower")
        below = materialise(level.select("gram", p.alias("p")))
    return below


def ratio_table(counts: DataFrame) -> DataFrame:
    """The values of ``Ratios`` by ``context``, in whole numbers of ``PART``: ``letters``, the ratio of each n-gram by its
    last letter, and ``ratio``, that of any other letter; and ``seen``, how often the classes have the context.

    ``counts`` is ``gram``, ``toxic`` and ``ordinary``, written; an n-gram that neither class has is left out. A context
    has no more letters than there are.
    """
    counts = counts.where("toxic + ordinary > 0")
    below = backoff(counts)

    def left(of: str) -> Column:
        return (DISCOUNT * F.col(f"{of}_kinds") + STRENGTH) / (F.col(f"{of}_seen") + STRENGTH)

    counts = counts.withColumn("context", F.substring("gram", 1, ORDER - 1)).withColumn("suffix", F.substring("gram", 2, ORDER))
    seen = counts.groupBy("context").agg(
        F.sum("toxic").alias("toxic_seen"),
        F.sum("ordinary").alias("ordinary_seen"),
        F.sum((F.col("toxic") > 0).cast("long")).alias("toxic_kinds"),
        F.sum((F.col("ordinary") > 0).cast("long")).alias("ordinary_kinds"),
        F.count("*").alias("kinds"),
    )
    # Last by context, which the grouping then shares.
    joined = counts.join(below.withColumnRenamed("gram", "suffix"), "suffix").join(seen, "context")
    both = F.col("toxic") + F.col("ordinary")
    shared = (both - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("p")) / (F.col("toxic_seen") + F.col("ordinary_seen"))

    def likely(of: str) -> Column:
        own = F.greatest(F.col(of) - DISCOUNT, F.lit(0.0)) / (F.col(f"{of}_seen") + STRENGTH)
        return own + left(of) * shared

    def parts(ratio: Column) -> Column:
        return F.round(ratio * PART).cast("long")

    letter = F.struct(F.substring("gram", ORDER, 1), parts(F.log(likely("toxic") / likely("ordinary"))))
    return joined.groupBy("context").agg(
        F.map_from_entries(F.collect_list(letter)).alias("letters"),
        F.max(parts(F.log(left("toxic") / left("ordinary")))).alias("ratio"),
        F.max(F.col("toxic_seen") + F.col("ordinary_seen")).alias("seen"),
    )


def word_ratios(vocabulary: DataFrame, ratios: DataFrame) -> DataFrame:
    """``word``, ``n`` and ``ratio`` of each word of ``vocabulary`` (``word``, ``n``). ``ratios`` is written.

    The n-grams of the most frequent contexts, which would be hot keys, are looked up where words are spelt; all others
    meet theirs in a join. The values are the same, and added up in whole numbers, so their order does not matter.
    """
    spark = vocabulary.sparkSession
    python_workers(spark)
    often = ratios.orderBy(F.desc("seen"), "context").limit(FREQUENT_CONTEXTS).select("context", "letters", "ratio").collect()
    shared = spark.sparkContext.broadcast({r["context"]: (r["ratio"], r["letters"]) for r in often})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            sums, rest = [], []
            for word in batch.column(0).to_pylist():
                total, others = 0, []
                for gram in grams(word):
                    met = known(gram[:-1])
                    if met is None:
                        others.append(gram)
                    else:
                        total += met[1].get(gram[-1], met[0])
                sums.append(total)
                rest.append(others)
            columns = [batch.column(0), batch.column(1), pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "parts", "rest"])

    spelled = vocabulary.select("word", "n").mapInArrow(run, "word string, n long, parts long, rest array<string>")
    looked = materialise(spelled.withColumn("id", F.monotonically_increasing_id()))
    others = looked.select("id", F.explode("rest").alias("gram"))
    others = others.select("id", F.substring("gram", 1, ORDER - 1).alias("context"), F.substring("gram", ORDER, 1).alias("last"))
    met = others.join(ratios, "context").select("id", F.coalesce(F.try_element_at("letters", "last"), "ratio").alias("parts"))
    summed = met.groupBy("id").agg(F.sum("parts").alias("more"))
    whole = F.col("parts") + F.coalesce("more", F.lit(0))
    return looked.join(summed, "id", "left").select("word", "n", (whole / PART).alias("ratio"))


def measured(docs: DataFrame, model: Callable[[], DataFrame], label: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, the label given, and the measures of the text; 0 for a text that is null or has no words.

    ``model`` makes the ``ratio_table``; what it writes is deleted as soon as the words have their ratios.
    """
    spark = docs.sparkSession
    python_workers(spark)
    corpus = word_counts(docs.select(F.col(text).alias("text"), F.lit(0).alias("part"))).select("word", "n")

    ratios = distilled(lambda: word_ratios(corpus, distilled(model)))
    often = ratios.where(F.length("word") <= FREQUENT_LETTERS).orderBy(F.desc("n"), "word").limit(FREQUENT)
    shared = spark.sparkContext.broadcast({r["word"]: r["ratio"] for r in often.select("word", "ratio").collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            totals, tops, numbers, others = [], [], [], []
            for given in batch.column(2).to_pylist():
                found = words(given)
                values = np.array([known(w, math.nan) for w in found], float)
                absent = np.isnan(values)
                rare = Counter(found[k] for k in np.flatnonzero(absent))
                values = values[~absent]
                top = np.partition(values, -STRONGEST)[-STRONGEST:] if len(values) > STRONGEST else values
                totals.append(float(values.sum()))
                tops.append(top.tolist())
                numbers.append(len(found))
                others.append([{"word": w, "times": n} for w, n in rare.items()])
            kinds = (pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())])))
            columns = [pa.array(c, k) for c, k in zip((totals, tops, numbers, others), kinds, strict=True)]
            names = ["doc_id", "label", "total", "top", "n_words", "others"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    given = docs.select(F.col(key).cast("long").alias("doc_id"), label.cast("int").alias("label"), F.col(text))
    looked = materialise(given.mapInArrow(run, _LOOKED).withColumn("row", F.monotonically_increasing_id()))
    rare = looked.select("row", F.inline("others")).join(ratios.select("word", "ratio").hint("shuffle_merge"), "word")
    by_row = rare.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("ratio", "times")), False).alias("met"))
    rows = looked.drop("others").join(by_row.hint("shuffle_merge"), "row", "left")
    total = F.col("total") + F.coalesce(
        F.aggregate("met", F.lit(0.0), lambda a, x: a + x["ratio"] * x["times"]), F.lit(0.0)
    )
    repeated = F.flatten(
        F.transform(
            F.slice("met", 1, STRONGEST),
            lambda x: F.array_repeat(x["ratio"], F.least(x["times"], F.lit(STRONGEST)).cast("int")),
        )
    )
    top = F.concat("top", F.coalesce(repeated, F.array().cast("array<double>")))
    rows = rows.select(
        "doc_id", "label", "n_words", total.alias("total"), F.slice(F.sort_array(top, False), 1, STRONGEST).alias("top")
    )
    strongest = F.aggregate("top", F.lit(0.0), lambda a, x: a + x) / STRONGEST
    some = F.col("n_words") > 0
    return rows.select(
        "doc_id",
        "label",
        F.when(some, F.col("total") / F.col("n_words")).otherwise(0.0).alias("mean"),
        F.when(some, F.get("top", F.lit(0))).otherwise(0.0).alias("highest"),
        F.when(some, strongest).otherwise(0.0).alias("strongest"),
        "n_words",
    )


#: What the decision looks at: the ratios, and the length, on which the highest of many words depends.
_INPUTS = ("mean", "highest", "strongest", "ln(n_words + 1)")


def fit(rows: list) -> list[float]:
    """Logistic regression with a small penalty, by Newton's method: the constant, then a factor for each input."""
    if not rows:
        return [0.0] * (1 + len(_INPUTS))
    x = np.array([[r["mean"], r["highest"], r["strongest"], math.log(r["n_words"] + 1)] for r in rows])
    y = np.array([float(r["label"]) for r in rows])
    middle, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - middle) / spread]
    factors = np.zeros(z.shape[1])
    penalty = np.diag([1e-6, *[0.01] * len(_INPUTS)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ factors, -30, 30)))
        slope = z.T @ (y - p) - penalty @ factors
        bend = (z * (p * (1 - p))[:, None]).T @ z + penalty
        step = np.linalg.solve(bend, slope)
        factors += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    scaled = factors[1:] / spread
    return [float(factors[0] - scaled @ middle), *map(float, scaled)]


def score(docs: DataFrame, labels: DataFrame, fold: Column, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Per row: the key, ``held_out`` (its fold is 0), ``score`` and ``predicted``.

    Rows of fold 0 are never learned from. The decision is fitted on fold 1 with counts of the folds beyond, so that it
    sees texts as unknown to the models as new ones; the models that score then count all folds but 0. A row without a
    label is only scored; of several labels of a key the highest counts. A null key is in no fold.
    """
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("label_key")).agg(F.max(label).alias("toxic_label"))
    texts = docs.select(F.col(key).alias("label_key"), F.col(text).alias("label_text"), fold.alias("fold"))
    # Labels grow with the texts, so both are always dealt by key, also where the labels would still fit a broadcast.
    known = (
        texts.where("fold <> 0")
        .join(marks.hint("shuffle_merge"), "label_key")
        .select("label_key", "label_text", "toxic_label", "fold")
    )
    known = materialise(known)
    tuning = known.where("fold = 1")
    share = FIT_ROWS / max(1, tuning.count())
    drawn = tuning.where(F.pmod(F.xxhash64("label_key"), F.lit(1 << 30)) < share * (1 << 30))
    first, counts = class_counts(known, "label_text", "toxic_label")
    # Of the first model nothing is left but these few measures.
    drawn_measures = distilled(
        lambda: measured(drawn, lambda: ratio_table(first), F.col("toxic_label"), "label_text", "label_key")
    )
    factors = fit(drawn_measures.where("n_words > 0").orderBy("doc_id").collect())
    judged = measured(docs, lambda: ratio_table(counts), F.lit(None), text, key)
    logit = F.lit(factors[0])
    for factor, value in zip(factors[1:], _INPUTS, strict=True):
        logit = logit + F.lit(factor) * F.expr(value)
    likely = F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-logit)))
    return judged.select("doc_id", likely.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labelled ones whose crc32 is not a multiple of 5."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, table(spark, sf_dir, "labels"), crc_rest(F.col("doc_id"), 5))
    held_out = F.coalesce(crc_rest(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
