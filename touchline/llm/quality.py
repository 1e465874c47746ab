"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger stores its measurements and one bit per failed rule; a policy is
a versioned set of rules, applied afterwards with a bitwise AND, and an ablation is an aggregate over the distinct bit
masks. All of it is built from DataFrame functions, one scan, no shuffle except the one of the ablation's few masks.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import SPACE, let, table, word_list


@dataclass(frozen=True)
class Rule:
    """A failure condition over the measurements, in SQL that Spark and DuckDB both read."""

    name: str
    fails: str


#: The position of a rule is its bit. New rules go to the end, so that stored ledgers keep their meaning.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("capitals", "2 * n_capitals > word_chars"),
    Rule("exclamations", "2 * n_exclamations > n_words"),
)

#: Policies by version: the rules that reject a document.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": tuple(rule.name for rule in RULES),
}

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_capitals",
    "n_exclamations",
)


def _mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    return sum(1 << bit for bit, rule in enumerate(rules) if rule.name in names)


def _repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that occurs twice or more.

    Windows are compared by a 64-bit hash. Sorted by (hash, place), equal windows are neighbours; the covered words are
    then the sum of the steps between their places, at most 3 each. Linear memory, n log n time, for any text length.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(
            places, lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(places, k - 1)))
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def places(pairs: Column) -> Column:
        again = F.filter(
            pairs,
            lambda p, k: (p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"]),
        )
        return F.sort_array(F.transform(again, lambda p: p["i"]))

    def of_windows(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(pairs, lambda p: let(places(p), covered))
        )

    def count(w: Column) -> Column:
        windows = F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        )
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, of_windows))

    return let(words, count)


def ledger(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``carry``, every measurement (long) and ``failed``, the bits of the failed rules.

    A null or empty text has no words and no lines: all measurements are 0. Repeated rows are measured each; other
    columns of ``docs`` are not read.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = docs.select(
        *[F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)], t.alias("t"), word_list(t).alias("w")
    )
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    measured = words.select(
        *[F.col(f"carry_{k}").alias(c) for k, c in enumerate(carry)],
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_exclamations"),
    )
    bits = [F.when(F.expr(rule.fails), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, rule in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed.cast("long"))


def passes(failed: Column, policy: str = "v2") -> Column:
    """Whether a policy keeps a document with these failure bits."""
    return failed.bitwiseAND(F.lit(_mask(POLICIES[policy])).cast("long")) == 0


def ablation(measured: DataFrame) -> DataFrame:
    """For each policy and rule of it: documents kept, kept without the rule, and rejected by the rule alone.

    The ledger is first counted by its distinct bit masks, of which there are 2 to the number of rules at most.
    """
    masks = measured.groupBy("failed").agg(F.count("*").alias("n"))
    uses = [(version, rule.name, _mask(names), 1 << bit) for version, names in POLICIES.items()
            for bit, rule in enumerate(RULES) if rule.name in names]
    policy = F.explode(
        F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"),
                           F.lit(b).cast("long").alias("bit")) for v, r, m, b in uses])
    ).alias("use")
    hit = F.col("failed").bitwiseAND(F.col("use.mask"))
    counted = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return (
        masks.select("failed", "n", policy)
        .groupBy(F.col("use.policy").alias("policy"), F.col("use.rule").alias("rule"))
        .agg(
            counted(hit == 0).alias("kept"),
            counted(hit.bitwiseAND(F.bitwise_not(F.col("use.bit"))) == 0).alias("kept_without"),
            counted(hit == F.col("use.bit")).alias("by_rule_alone"),
            F.bit_or(hit).alias("failed_bits"),
        )
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, with the verdicts of the base rules and of the current policy."""
    measured = ledger(table(spark, sf_dir, "documents"))
    base = ~passes(F.col("failed"), "base")
    return measured.select(
        "doc_id", *MEASURES, "failed", base.alias("base_failed"), (~base & passes(F.col("failed"))).alias("kept")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the current policy keeps, with all their columns."""
    packed = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    judged = ledger(packed, carry=("row",))
    return judged.where(passes(F.col("failed"))).select("row.*")


ORACLE = rf"""
with words as materialized (
  select row_number() over () as r, doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), windows as (
  select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from words, unnest(range(1, len(w) - 1)) as u(i)
), again as (
  select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from windows) where n > 1
), covered as (
  select r, count(distinct i + k) as n from again, unnest([0, 1, 2]) as v(k) group by r
), lines as (
  select r, t, doc_id, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as x
  from words
), measured as (
  select doc_id, len(w)::bigint as n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
         (len(x) - len(list_distinct(x)))::bigint as n_dup_lines,
         coalesce(n, 0)::bigint as n_repeat_words, len(x)::bigint as n_lines,
         len(regexp_extract_all(t, '[A-Z]'))::bigint as n_capitals,
         len(regexp_extract_all(t, '!'))::bigint as n_exclamations
  from lines left join covered using (r)
), judged as (
  select *, ({" + ".join(f"case when {rule.fails} then {1 << bit} else 0 end" for bit, rule in enumerate(RULES))})::bigint
         as failed
  from measured
)
select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, failed = 0 as kept from judged
"""
