"""Secret scans by corpus-wide ownership.

Each document is searched for key assignments, access keys, long hexadecimal runs and other long mixed tokens. The
hash of every candidate value is counted over the whole corpus: how many distinct repositories and owners hold it.
A value that many owners hold is a copied example; a value that looks random and that few owners, repositories and
places hold is a live-looking credential.

Everything is built from DataFrame functions. Texts are scanned once; what is shuffled are the candidates, as hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import let, table
from touchline.session import materialise

#: Kinds in their order. The last is found by ownership alone and kept only where one owner holds the value.
KINDS = ("assign", "access", "hex", "owned")

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# A run of hexadecimal digits, or what follows AKIA, is matched whole, so its least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"

#: A value that this many owners hold is a copied example. One that fewer hold, but so many repositories or places, is
#: shared; so a copy or two of a document leave its secret one of its own.
COPIED_OWNERS = 3
SHARED_REPOS = 5
SHARED_PLACES = 20
#: A live-looking value has at least this many different characters.
LIVE_CHARACTERS = 8

_SPAN = "struct<rank:int,first:int,end:int,hash:string,lively:boolean,mixed:boolean>"


def _matches(text: Column, pattern: str, rank: int, group: int, least: int) -> Column:
    """Spans of a pattern's matches, left to right: code points, end exclusive; the value is ``group``.

    The text is split at the matches. Each match begins after the pieces and matches before it.
    """

    def spans(pieces: Column, whole: Column, values: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

        def step(state: Column, k: Column) -> Column:
            first = state["at"] + F.length(F.get(pieces, k))
            end = first + F.length(F.get(whole, k))
            value = F.get(values, k)
            span = F.struct(
                F.lit(rank).alias("rank"),
                first.alias("first"),
                end.alias("end"),
                F.sha2(value, 256).alias("hash"),
                (F.size(F.array_distinct(F.split(value, ""))) > LIVE_CHARACTERS - 1).alias("lively"),
                (value.rlike("[A-Za-z]") & value.rlike("[0-9]")).alias("mixed"),
            ).cast(_SPAN)
            grown = F.when(F.length(value) >= least, F.array_append(state["out"], span)).otherwise(state["out"])
            return F.struct(end.alias("at"), grown.alias("out"))

        places = F.sequence(F.lit(0), F.size(whole) - 1)
        return F.aggregate(places, start, step, lambda state: state["out"])

    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda whole: let(
            F.split(text, pattern, -1),
            lambda pieces: let(
                F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: spans(pieces, whole, v)
            ),
        ),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _owned(text: Column, base: Column) -> Column:
    """Long runs with letters and digits that no base span covers."""
    runs = F.filter(_matches(text, RUN, 3, 0, 20), lambda r: r["mixed"])
    return F.filter(runs, lambda r: ~F.exists(base, lambda b: (b["first"] <= r["first"]) & (r["end"] <= b["end"])))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "lang", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``carry``, ``owner``, ``repo``, ``base`` (spans of the first three kinds) and ``extra`` (the fourth).

    A null or empty text has no spans. A null owner or repository counts as one owner or repository of its own.
    """
    plain = docs.select(
        F.struct(*carry).alias("carried"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo"),
    )
    based = plain.withColumn(
        "base",
        F.concat(
            _matches(F.col("t"), ASSIGN, 0, 2, 6),
            _matches(F.col("t"), ACCESS, 1, 0, 20),
            _matches(F.col("t"), HEX, 2, 0, 24),
        ),
    )
    return based.select("carried", "owner", "repo", "base", _owned(F.col("t"), F.col("base")).alias("extra"))


def ownership(scanned: DataFrame) -> DataFrame:
    """For each candidate hash: distinct owners, and distinct repositories, which belong to an owner each.

    Three aggregates, each summed within the tasks first, so a value that a third of the corpus holds is a row per task.
    """
    held = scanned.select(
        "owner", "repo", F.explode(F.transform(F.concat("base", "extra"), lambda s: s["hash"])).alias("hash")
    )
    repos = held.groupBy("hash", "owner", "repo").agg(F.count("*").alias("places"))
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("places").alias("places"))
    return owners.groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("places").alias("places")
    )


def judge(scanned: DataFrame, owned: DataFrame) -> DataFrame:
    """Each scanned row with ``spans``: its spans by start and kind, with ``owners``, ``repos`` and ``verdict`` of the value.

    The verdict is copied (``COPIED_OWNERS`` or more), live (looks random, and neither many repositories nor many places
    hold it) or shared. Spans of the last kind stay only if live. Each repeated row counts as a place. A row without candidates takes part under a key of its own, so that such rows meet nowhere.
    """
    numbered = scanned.withColumn("row", F.monotonically_increasing_id())
    none = F.array(F.struct(F.lit(-1).alias("rank"), F.lit(0).alias("first"), F.lit(0).alias("end"),
                            F.concat(F.lit("-"), F.col("row").cast("string")).alias("hash"), F.lit(False).alias("lively"), F.lit(False).alias("mixed")))
    every = F.concat("base", "extra")
    # What the row carries travels with its first candidate only.
    spread = numbered.select(
        "row", "carried", F.posexplode(F.when(F.size(every) > 0, every).otherwise(none)).alias("place", "s")
    ).select("row", F.when(F.col("place") == 0, F.col("carried")).alias("carried"), "s.*")
    verdict = (
        F.when(F.col("owners") >= COPIED_OWNERS, "copied")
        .when((F.col("repos") >= SHARED_REPOS) | (F.col("places") >= SHARED_PLACES), "shared")
        .when(F.col("lively"), "live")
        .otherwise("shared")
    )
    known = spread.join(owned, "hash", "left").withColumn("verdict", verdict)
    stays = (F.col("rank") >= 0) & ((F.col("rank") < 3) | (F.col("verdict") == "live"))
    span = F.struct("first", "rank", "end", "verdict", "owners", "repos")
    return (
        known.groupBy("row")
        .agg(
            F.first("carried", ignorenulls=True).alias("carried"),
            F.sort_array(F.collect_list(F.when(stays, span))).alias("spans"),
        )
        .select("carried", "spans")
    )


def _written(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["first"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _count(spans: Column, field: str, value: int | str) -> Column:
    return F.size(F.filter(spans, lambda s: s[field] == value)).cast("long")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans, with the verdicts on their values over the whole corpus."""
    scanned = materialise(scan(table(spark, sf_dir, "documents")))
    # Written, so that the join deals both sides itself and can split the candidates of one value.
    owned = materialise(ownership(scanned))
    judged = judge(scanned, owned).select(F.col("carried.doc_id").alias("doc_id"), "spans")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return judged.select(
        "doc_id",
        *[_count(F.col("spans"), "rank", r).alias(f"n_{KINDS[r]}") for r in range(3)],
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        *[_count(F.col("spans"), "verdict", v).alias(f"n_{v}") for v in ("live", "copied", "shared")],
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["owners"])), F.lit(0)).cast("long").alias("most_owners"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["repos"])), F.lit(0)).cast("long").alias("most_repos"),
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced: by [SECRET], or by [EXAMPLE] if it is a copied value."""

    def cover(state: Column, s: Column) -> Column:
        mark = F.when(s["verdict"] == "copied", "[EXAMPLE]").otherwise("[SECRET]")
        gap = F.substring(text, state["at"] + 1, s["first"] - state["at"])
        return F.when(
            s["first"] >= state["at"],
            F.struct(s["end"].alias("at"), F.concat(state["out"], F.array(gap, mark)).alias("out")),
        ).otherwise(F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        spans,
        start,
        cover,
        lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text))),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and ``n_chars`` set to the new length where they had any.

    Documents without a candidate pass without a shuffle; the others travel once, with their first candidate.
    """
    packed = docs.select(F.struct("*").alias("row"), "text", "source", "lang")
    any_run = "|".join((ASSIGN, ACCESS, HEX, RUN))
    suspect = F.coalesce(F.col("text").rlike(any_run), F.lit(False))
    clean = packed.where(~suspect).select("row.*")
    scanned = scan(packed.where(suspect), carry=("row",))
    owned = materialise(ownership(scanned))
    judged = judge(scanned, owned).select(F.col("carried.row").alias("row"), "spans")
    new = {"text": F.col("new"), "n_chars": F.when(F.size("spans") > 0, F.length("new")).otherwise(F.col("row.n_chars"))}
    redacted = judged.withColumn("new", redact(F.col("row.text"), F.col("spans"))).select(
        *[new.get(f.name, F.col("row")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema]
    )
    return clean.union(redacted)


def _duck_matches(pattern: str, rank: int, group: int, least: int) -> str:
    """The same search, by cutting the text at its matches."""
    return rf"""
  select r, {rank} as rank, begins as first, begins + length(m) as stop, v from (
    select r, m, v, (sum(length(g) + length(m)) over (partition by r order by k) - length(m))::bigint as begins from (
      select r, unnest(range(len(m))) as k, unnest(m) as m, unnest(v) as v, unnest(list_slice(g, 1, len(m))) as g from (
        select r, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {group}) as v,
               string_split_regex(t, '{pattern}') as g
        from docs))) where length(v) >= {least}"""


_SQL = {name: pattern.replace("'", "''") for name, pattern in (("a", ASSIGN), ("k", ACCESS), ("h", HEX), ("o", RUN))}

ORACLE = rf"""
with docs as materialized (
  select row_number() over () as r, doc_id, coalesce(source, '') as owner, coalesce(lang, '') as repo,
         coalesce(text, '') as t
  from documents
), base as ({_duck_matches(_SQL["a"], 0, 2, 6)}
  union all {_duck_matches(_SQL["k"], 1, 0, 20)}
  union all {_duck_matches(_SQL["h"], 2, 0, 24)}
), runs as ({_duck_matches(_SQL["o"], 3, 0, 20)}
), spans as (
  select * from base
  union all
  select * from runs
  where regexp_matches(v, '[A-Za-z][+/_=-]*[0-9]|[0-9][+/_=-]*[A-Za-z]')
    and not exists (from base b where b.r = runs.r and b.first <= runs.first and runs.stop <= b.stop)
), owned as (
  select v, count(distinct owner) as owners, count(distinct (owner, repo)) as repos, count(*) as places from spans join docs using (r) group by v
), judged as (
  select r, rank, first, stop, owners, repos,
         case when owners >= {COPIED_OWNERS} then 'copied'
              when repos >= {SHARED_REPOS} or places >= {SHARED_PLACES} then 'shared'
              when len(list_distinct(string_split(v, ''))) >= {LIVE_CHARACTERS} then 'live'
              else 'shared' end as verdict,
         ['assign', 'access', 'hex', 'owned'][rank + 1] || ':' || first || ':' || stop as said
  from spans join owned using (v)
), kept as (
  select * from judged where rank < 3 or verdict = 'live'
), grouped as (
  select r, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access,
         count(*) filter (rank = 2) as n_hex, string_agg(said, ',' order by first, rank) filter (rank < 3) as base,
         string_agg(said, ',' order by first, rank) as spans, count(*) filter (verdict = 'live') as n_live,
         count(*) filter (verdict = 'copied') as n_copied, count(*) filter (verdict = 'shared') as n_shared,
         max(owners) as most_owners, max(repos) as most_repos
  from kept group by r
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
       coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
       coalesce(n_live, 0)::bigint as n_live, coalesce(n_copied, 0)::bigint as n_copied,
       coalesce(n_shared, 0)::bigint as n_shared, coalesce(most_owners, 0)::bigint as most_owners,
       coalesce(most_repos, 0)::bigint as most_repos
from docs left join grouped using (r)
"""
