"""Joining people across systems by any of several keys.

Two shapes make Spark fall back to comparing every row with every other: a
condition that is an OR of keys, and ``ILIKE`` between two columns. Both are
rewritten here to equality joins with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.times import trunc
from touchline.operators.joins import ROW, join_groups, null_safe_join, numbered, with_unmatched
from touchline.session import materialise


def _tokens(pattern: Column) -> Column:
    """A pattern in lower case as its wildcards and characters; an escaped character keeps its backslash."""
    return F.regexp_extract_all(F.lower(pattern), F.lit(r"(?s)\\.|."), F.lit(0))


def _wild(token: Column) -> Column:
    return token.isin("%", "_")


def _characters(tokens: Column) -> Column:
    """What literal tokens stand for. A backslash at the end of a pattern stands for itself."""
    return F.array_join(F.transform(tokens, lambda t: F.right(t, F.lit(1))), "")


def _plain(pattern: Column) -> Column:
    """The pattern in lower case with every literal ``_``, ``%`` and backslash escaped, and nothing else."""

    def spelt(token: Column) -> Column:
        char = F.right(token, F.lit(1))
        return F.when(char.isin("%", "_", "\\"), F.concat(F.lit("\\"), char)).otherwise(char)

    return F.array_join(F.transform(_tokens(pattern), lambda t: F.when(_wild(t), t).otherwise(spelt(t))), "")


def ilike_column(text: Column, pattern: Column) -> Column:
    """``text ILIKE pattern`` for a pattern column, also where a pattern ends in a backslash."""
    return F.like(F.lower(text), _plain(pattern))


def _inner_runs(tokens: Column) -> Column:
    """The literal runs between wildcards."""

    def step(runs: Column, token: Column) -> Column:
        grown = F.concat(F.element_at(runs, -1), F.right(token, F.lit(1)))
        return F.when(_wild(token), F.concat(runs, F.array(F.lit("")))).otherwise(
            F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(grown))
        )

    runs = F.aggregate(tokens, F.array(F.lit("")), step)
    return F.array_distinct(F.filter(runs, lambda r: r != ""))


#: Characters of a gram, and what stands before and behind a text and so in the grams at its ends.
GRAM = 3
HEAD, TAIL = "\u0001" * (GRAM - 1), "\u0002" * (GRAM - 1)


def _grams(part: Column, size: int) -> Column:
    """The grams of a literal part, each with its place from 1."""
    places = F.sequence(F.lit(1), F.length(part) - size + 1)
    spelt = F.transform(places, lambda i: F.struct(F.substr(part, i, F.lit(size)).alias("gram"), i.alias("at")))
    return F.when(F.length(part) >= size, spelt).otherwise(F.array().cast("array<struct<gram:string,at:int>>"))


def _listed(gram: Column, kind: str, at: Column, a: Column, b: Column) -> Column:
    """An entry of the index: what a text that matches has besides the gram, and where the gram stands in it."""
    return F.struct(
        gram.alias("gram"), F.lit(kind).alias("kind"), at.cast("int").alias("at"), a.alias("a"), b.alias("b"),
        F.length(a).alias("a_size"), F.length(b).alias("b_size"),
    )


def _entries(prefix: Column, suffix: Column, runs: Column) -> Column:
    """Every entry a pattern could be listed under.

    ``head`` and ``tail`` are grams at the ends, with their distance from the start or the end of the text between its
    marks; they stand for both ends at once. ``run`` are grams of a run between wildcards, with their place in the run.
    A pattern of runs shorter than a gram is listed under the run itself, one of wildcards alone under nothing.
    """
    none = F.lit("")
    head, tail = F.concat(F.lit(HEAD), prefix), F.concat(suffix, F.lit(TAIL))
    heads = F.transform(F.filter(_grams(head, GRAM), lambda g: prefix != ""), lambda g: _listed(g["gram"], "head", g["at"], prefix, suffix))
    tails = F.transform(
        F.filter(_grams(tail, GRAM), lambda g: suffix != ""),
        lambda g: _listed(g["gram"], "tail", F.length(tail) - g["at"], prefix, suffix),
    )
    inner = F.flatten(
        F.transform(runs, lambda r: F.transform(_grams(r, GRAM), lambda g: _listed(g["gram"], "run", g["at"], r, none)))
    )
    short = F.transform(runs, lambda r: _listed(r, "run", F.lit(1), r, none))
    every = F.concat(heads, tails, inner)
    return F.when(F.size(every) > 0, every).when(F.size(short) > 0, short).otherwise(
        F.array(_listed(none, "all", F.lit(1), none, none))
    )


def _spelt(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """``text``, ``gram`` and ``at``: what begins at each place of a text between its marks; ``sizes`` has the sizes in use.

    That is one size, but for patterns that have no run as long as a gram.
    """
    marked = F.concat(F.lit(HEAD), F.lower("text"), F.lit(TAIL))
    every = F.explode(F.array(*[F.lit(k) for k in range(GRAM + 1)])).alias("size")
    # No more than a row for each size up to that of a gram.
    placed = texts.select("text", marked.alias("marked"), every).join(F.broadcast(sizes), "size", "left_semi")
    last = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.length("marked") - F.col("size") + 1)
    placed = placed.select("text", "marked", "size", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    return placed.select("text", "at", F.substr("marked", F.col("at"), F.col("size")).alias("gram"))


def pattern_pairs(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """All pairs ``(text, pattern)`` with ``text ILIKE pattern``.

    Each input has one column of distinct values without NULL. A pattern without wildcards is equality. Any other must
    hold what stands before its first and after its last wildcard at the text's ends, both at once, and each run of
    literals between. An index of grams of ``GRAM`` characters lists each pattern once, under that gram of these parts
    which the fewest texts have; one that no text has ends the search. Texts are spelt out once per place. A place whose
    gram is listed is then compared by position: the run around it, or both ends of the text, must equal the listed
    pattern's as a whole, again by an equality join. So patterns that share a gram, such as that of a domain, cost a text
    one row per form in which the gram is listed, not one per pattern. What is left is tested.
    """
    t = materialise(texts.toDF("text"))
    p = patterns.toDF("pattern").withColumn("tokens", _tokens(F.col("pattern")))
    tokens = F.col("tokens")
    p = p.withColumn("wild", F.transform(tokens, _wild))
    first = F.array_position("wild", True)
    last = F.size(tokens) + 1 - F.array_position(F.reverse("wild"), True)
    parts = p.select(
        "pattern",
        (first == 0).alias("plain"),
        _characters(F.when(first == 0, tokens).otherwise(F.slice(tokens, F.lit(1), first.cast("int") - 1))).alias("prefix"),
        _characters(F.slice(tokens, last.cast("int") + 1, F.size(tokens))).alias("suffix"),
        _inner_runs(F.slice(tokens, F.greatest(first, F.lit(1)).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))).alias("runs"),
    )
    prefix, none = F.col("prefix"), F.lit("")
    entries = F.when(F.col("plain"), F.array(_listed(none, "equal", F.lit(1), prefix, none))).otherwise(
        _entries(prefix, F.col("suffix"), F.col("runs"))
    )
    listed = materialise(parts.select("pattern", F.inline(entries)))
    plain = listed.filter("kind = 'equal'").select("pattern", F.col("a").alias("low"))
    equal = t.withColumn("low", F.lower("text")).join(plain, "low").select("text", "pattern")
    sought = listed.filter("kind <> 'equal'")
    grams = sought.select("gram").distinct()
    sizes = grams.select(F.length("gram").alias("size")).distinct()
    held = _spelt(t, sizes).join(grams, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    entry = ["gram", "kind", "at", "a", "b", "a_size", "b_size"]
    counted = join_groups(sought, held, ["gram"]).withColumn("n", F.coalesce("n", F.lit(0)))
    best = counted.groupBy("pattern").agg(F.min(F.struct("n", *entry)).alias("best")).filter("best.n > 0")
    chosen = materialise(best.select("pattern", *[F.col(f"best.{c}").alias(c) for c in entry]))

    forms = chosen.select("gram", "kind", F.col("at").alias("place"), "a_size", "b_size").distinct()
    text = F.lower("text")
    # Places count from the marks before the text; a run begins so many characters before the gram's own place.
    begins = F.col("at") - F.length(F.lit(HEAD)) - F.col("place") + 1
    from_end = F.length(text) + F.length(F.lit(HEAD + TAIL)) - F.col("at")
    fits = (
        F.when(F.col("kind") == "head", F.col("at") == F.col("place"))
        .when(F.col("kind") == "tail", from_end == F.col("place"))
        .when(F.col("kind") == "run", (begins > 0) & (begins + F.col("a_size") - 1 <= F.length(text)))
        .otherwise(F.lit(True))
    )
    a = F.when(F.col("kind") == "run", F.substr(text, begins, F.col("a_size"))).otherwise(F.left(text, F.col("a_size")))
    b = F.when(F.col("kind") == "run", F.lit("")).otherwise(F.right(text, F.col("b_size")))
    met = _spelt(t, sizes).join(forms, "gram").filter(fits & (F.length(text) >= F.col("a_size") + F.col("b_size")))
    key = ["kind", "a", "b"]
    met = met.select("text", "kind", a.alias("a"), b.alias("b")).distinct()
    found = met.join(chosen.select("pattern", *key), key).filter(ilike_column(F.col("text"), F.col("pattern")))
    return equal.unionAll(found.select("text", "pattern"))


@dataclass(frozen=True)
class Key:
    """One way to match: ``equal``, ``exact_ci`` (equal in any case) or ``pattern`` (left ILIKE right)."""

    left: str
    right: str
    kind: str = "equal"

    def holds(self) -> Column:
        """The condition on a joined row; unknown becomes false."""
        left, right = F.col(self.left), F.col(self.right)
        if self.kind == "equal":
            test = left == right
        elif self.kind == "exact_ci":
            test = F.lower(left) == F.lower(right)
        else:
            test = ilike_column(left, right)
        return F.coalesce(test, F.lit(False))


def distinct_values(*columns: tuple[DataFrame, str]) -> DataFrame:
    """Distinct non-NULL values of several columns as one column ``value``."""
    parts = [df.select(F.col(c).alias("value")) for df, c in columns]
    return reduce(DataFrame.unionAll, parts).filter("value IS NOT NULL").distinct()


def _matches(left: DataFrame, right: DataFrame, keys: Sequence[Key], residual: Column | None) -> DataFrame:
    """Matching pairs of rows, each once: a later key adds only what no earlier key matched."""
    parts = []
    for i, key in enumerate(keys):
        rows = left.filter(F.col(key.left).isNotNull())
        if key.kind == "pattern":
            pairs = pattern_pairs(distinct_values((left, key.left)), distinct_values((right, key.right)))
            pairs = materialise(pairs.toDF("__text", "__pattern"))
            rows = rows.join(pairs, rows[key.left] == pairs["__text"])
            on = F.col("__pattern") == F.col(key.right)
        elif key.kind == "exact_ci":
            on = F.lower(key.left) == F.lower(key.right)
        else:
            on = F.col(key.left) == F.col(key.right)
        if residual is not None:
            on = on & residual
        for earlier in keys[:i]:
            on = on & ~earlier.holds()
        parts.append(rows.join(right, on).select(*left.columns, *right.columns))
    return reduce(DataFrame.unionAll, parts)


def identity_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[Key],
    residual: Column | None = None,
    how: str = "left",
) -> DataFrame:
    """Join where any of the keys matches and ``residual`` holds.

    A pair that matches by several keys appears once. Column names of the two sides
    must differ. The left side is read once per key, so it is written first, unless it
    is ``numbered`` already.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    if how not in ("inner", "left"):
        raise ValueError(f"join type {how!r} is not supported")
    left = left if ROW in left.columns else numbered(left)
    pairs = _matches(left, right, keys, residual)
    return pairs.drop(ROW) if how == "inner" else with_unmatched(left, pairs)


def keyed(df: DataFrame, keep: Sequence[str], keys: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per non-NULL identity key of a row: the ``keep`` columns, ``key_kind`` and ``key``.

    ``keys`` lists ``(kind, column)``; the same kind may come from several columns.
    """
    entries = [F.struct(F.lit(kind).alias("key_kind"), F.col(c).alias("key")) for kind, c in keys]
    return df.select(*keep, F.inline(F.array(*entries))).filter("key IS NOT NULL")


def to_patterns(rows: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """Replace each key of one kind by the patterns it matches; keys of other kinds stay."""
    others = rows.filter(F.col("key_kind") != kind)
    texts = rows.filter(F.col("key_kind") == kind)
    mapped = texts.join(pairs, texts["key"] == pairs["text"]).drop("key", "text")
    return others.unionAll(mapped.withColumnRenamed("pattern", "key").select(*rows.columns))


def fold_case(rows: DataFrame, kind: str) -> DataFrame:
    """Keys of one kind in lower case."""
    folded = F.when(F.col("key_kind") == kind, F.lower("key")).otherwise(F.col("key"))
    return rows.withColumn("key", folded)


#: A key that would give more pairs of a unit and a time than this is counted once for all units that share it.
BROAD_PAIRS = 100_000


def distinct_times_since(
    units: DataFrame, asked: DataFrame, times: DataFrame, unit: Sequence[str], broad_pairs: int = BROAD_PAIRS
) -> DataFrame:
    """How many different times any key of a unit has on or after a day.

    ``units`` holds the keys of each unit (a person or group of people), ``asked`` the
    days to count from, ``times`` distinct ``created`` times per key. Gives ``unit``,
    ``view_day`` and ``n`` where there are any.

    The times of a unit are a set, built in two steps, first within the tasks, by unit
    and time; so neither a unit of very many keys nor a time that many keys share comes
    to one task, and a unit's keys need no order. Only a key with many units and many
    times would multiply them: such broad keys of a unit are one set, known by a code in
    which their order does not count, and its times are listed once for all units that
    have that set. A unit's other times then count where its broad set does not have
    them. Where the line is drawn changes no result.
    """
    key, code = ["key_kind", "key"], ["code", "check"]
    unit = list(unit)
    sizes = times.groupBy(*key).agg(F.count(F.lit(1)).alias("n_times"))
    shared = units.groupBy(*key).agg(F.count(F.lit(1)).alias("n_units"))
    pairs = F.col("n_times") * F.col("n_units")
    known = sizes.join(shared, key).select(*key, (pairs > broad_pairs).alias("broad"))
    held = materialise(join_groups(units, known, key, "inner"))
    narrow = held.filter("NOT broad").select(*unit, *key).join(times, key).select(*unit, "created").distinct()

    # Two codes of the set of broad keys.
    codes = [F.bit_xor(F.xxhash64(*key)).alias("code"), F.bit_xor(F.xxhash64(F.lit(1), *key)).alias("check")]
    sets = materialise(held.filter("broad").groupBy(*unit).agg(*codes))
    in_sets = null_safe_join(held.filter("broad"), sets, unit).select(*code, *key).distinct()
    listed = materialise(in_sets.join(times, key).select(*code, "created").distinct())
    beside = null_safe_join(narrow, sets, unit, "left").join(listed, [*code, "created"], "left_anti")

    def by_day(found: DataFrame, of: Sequence[str]) -> DataFrame:
        return found.groupBy(*of, trunc(F.col("created"), "day").alias("created_day")).agg(F.count(F.lit(1)).alias("n"))

    def since(wanted: DataFrame, days: DataFrame, of: Sequence[str]) -> DataFrame:
        met = null_safe_join(wanted, days, of).filter(F.col("created_day") >= F.col("view_day"))
        return met.groupBy(*of, "view_day").agg(F.sum("n").alias("n"))

    wanted = asked.select(*unit, "view_day").distinct()
    own = since(wanted, by_day(beside, unit), unit)
    with_set = null_safe_join(wanted, sets, unit)
    of_sets = since(with_set.select(*code, "view_day").distinct(), by_day(listed, code), code)
    broad = join_groups(with_set, of_sets, [*code, "view_day"], "inner").select(*unit, "view_day", "n")
    both = own.unionByName(broad).groupBy(*unit, "view_day")
    return both.agg(F.sum("n").cast("bigint").alias("n"))
