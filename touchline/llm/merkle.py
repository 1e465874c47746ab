"""A content-addressed Merkle manifest of a dataset, and proofs by descent through it.

Every row is a leaf, a hash of its columns. The leaves of one language, in the order of their keys, are the lowest level
of a tree whose nodes hash runs of ``ARITY`` digests; the roots of these trees, in the order of the languages, are the
lowest level of one more tree. What is stored are records from a digest to its children, one for each different digest.

A proof descends from the root: the digits of a leaf's rank, to the base ``ARITY``, say which child to take at each
record, and the children not taken are collected. Leaves below one node descend together, so that a level costs one row
for each of its nodes and not one for each leaf. The collected segments then are reversed, from the leaf up.

Digests are 32 bytes in tables and lower-case hex text where they are hashed or returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import crc_rest, table
from touchline.llm.ranks import ranked
from touchline.session import materialise

#: Children of a node.
ARITY = 8
#: Bytes of a digest.
SIZE = 32

_SEGMENT = "array<struct<before:binary,after:binary>>"


def hashed(*parts: Column) -> Column:
    """32 bytes of SHA-256 of the parts' text, one after another."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def text_of(digests: Column) -> Column:
    """One or more digests as lower-case hex text."""
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    """A value with its length in bytes, so that no two rows of values read the same; ``-`` if null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return hashed(*[field(v) for v in values])


@dataclass(frozen=True)
class Manifest:
    """Records of a dataset, by the height of their digest above the leaves of its tree.

    ``leaves`` has the columns of the rows given and ``rank``; ``trees`` has ``tree``, ``n`` leaves, ``subroot``,
    ``height`` and ``place`` among the trees. ``levels[h - 1]`` holds ``digest`` and ``children`` of height ``h``;
    ``upper`` is the same for the tree over the subroots. ``root`` is null without rows.
    """

    leaves: DataFrame
    trees: DataFrame
    levels: list[DataFrame]
    upper: list[DataFrame]
    root: bytes | None


def _height(n: int) -> int:
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def _built(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Records of each height, and ``tree``, ``digest`` and ``height`` of every root.

    ``nodes`` is ``tree``, ``node`` (place from 0), ``digest`` and ``n``, the nodes of the tree on this level; ``most``
    is the largest ``n``. A run of ``ARITY`` nodes is one group; a tree that has come down to one node stays as it is.
    """
    levels, roots = [], [nodes.where("n = 1").select("tree", "digest", F.lit(0).alias("height"))]
    for height in range(1, _height(most) + 1):
        runs = (
            nodes.where("n > 1")
            .groupBy("tree", F.floor(F.col("node") / ARITY).alias("node"))
            .agg(F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("run"), F.first("n").alias("n"))
        )
        children = F.concat(*[F.coalesce(F.get("run", F.lit(k))["digest"], F.lit(b"")) for k in range(ARITY)])
        joined = runs.select("tree", "node", children.alias("children"), F.ceil(F.col("n") / ARITY).alias("n"))
        nodes = materialise(joined.withColumn("digest", hashed(text_of(F.col("children")))))
        levels.append(nodes.groupBy("digest").agg(F.first("children").alias("children")))
        roots.append(nodes.where("n = 1").select("tree", "digest", F.lit(height).alias("height")))
    found = roots[0]
    for more in roots[1:]:
        found = found.unionAll(more)
    return levels, found


def manifest(rows: DataFrame) -> Manifest:
    """The manifest of ``rows``: ``tree`` (text, may be null), ``key``, ``leaf`` (a digest) and any other columns.

    Trees come in the order of their names, null first, by bytes; leaves of a tree in the order of ``key``, null first,
    and of their digests; repeated rows are leaves each. No name may be ``rank``.
    """
    named = rows.withColumn("tree", F.when(F.col("tree").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "tree")))
    # Written first: dealing by ranges reads its input twice, and texts should be hashed once.
    leaves = ranked(materialise(named), ["tree"], ["key", "leaf"])
    sizes = materialise(leaves.groupBy("tree").agg(F.count("*").alias("n")))
    n_trees, most = sizes.agg(F.count("*"), F.max("n")).first()
    if not n_trees:
        return Manifest(leaves, sizes.selectExpr("*", "binary('') subroot", "0 height", "0L place"), [], [], None)
    nodes = leaves.select("tree", F.col("rank").alias("node"), F.col("leaf").alias("digest")).join(sizes, "tree")
    levels, subroots = _built(nodes, most)
    trees = ranked(sizes.join(subroots.withColumnRenamed("digest", "subroot"), "tree"), [], ["tree"], "place")
    single = trees.select(F.lit("").alias("tree"), F.col("place").alias("node"), F.col("subroot").alias("digest"), F.lit(n_trees).alias("n"))
    upper, roots = _built(single, n_trees)
    return Manifest(leaves, trees, levels, upper, bytes(roots.first()["digest"]))


def _wanted(requests: DataFrame, heights: int) -> list[DataFrame]:
    """For each height from 1: ``tree``, ``node`` and ``digits``, the children of the node that lead to a request."""
    found, below = [], requests.select("tree", "node")
    for height in range(1, heights + 1):
        up = F.floor(F.col("node") / ARITY).alias("node")
        level = below.groupBy("tree", up).agg(F.collect_set((F.col("node") % ARITY).cast("int")).alias("digits"))
        below = materialise(level) if height < heights else level
        found.append(below)
    return found


def _step(frontier: DataFrame, records: DataFrame, wanted: DataFrame) -> DataFrame:
    """One level down: each node that is asked for becomes its wanted children, with the others added to the path."""
    met = frontier.join(wanted, ["tree", "node"]).join(records, "digest")
    taken = met.select("tree", "node", "path", "children", F.explode("digits").alias("digit"))
    at = F.col("digit") * SIZE
    beside = F.struct(
        F.substring("children", F.lit(1), at).alias("before"),
        F.substring("children", at + SIZE + 1, F.lit(ARITY * SIZE)).alias("after"),
    )
    return taken.select(
        "tree",
        (F.col("node") * ARITY + F.col("digit")).alias("node"),
        F.substring("children", at + 1, F.lit(SIZE)).alias("digest"),
        F.array_append("path", beside).cast(_SEGMENT).alias("path"),
    )


def descend(made: Manifest, requests: DataFrame) -> DataFrame:
    """``tree``, ``node``, ``digest`` and ``path`` of each leaf asked for; ``path`` leads from the leaf to the root.

    ``requests`` is ``tree``, as ``made.leaves`` has it, and ``node``, the rank of a leaf; each leaf once.
    """
    spark = requests.sparkSession
    start = "tree string, node long, digest binary, path " + _SEGMENT
    if made.root is None:
        return spark.createDataFrame([], start)
    asked = made.trees.join(requests.select("tree").distinct(), "tree", "left_semi")
    frontier = spark.createDataFrame([("", 0, made.root, [])], start)
    wanted = _wanted(asked.select(F.lit("").alias("tree"), F.col("place").alias("node")), len(made.upper))
    for height in range(len(made.upper), 0, -1):
        frontier = materialise(_step(frontier, made.upper[height - 1], wanted[height - 1]))
    entered = frontier.join(asked.select("place", F.col("tree").alias("below"), "height"), F.col("node") == F.col("place"))
    entered = materialise(entered.select(F.col("below").alias("tree"), F.lit(0).cast("long").alias("node"), "digest", "path", "height"))
    wanted = _wanted(requests, len(made.levels))
    frontier = entered.where(F.col("height") == len(made.levels)).drop("height")
    for height in range(len(made.levels), 0, -1):
        lower = _step(frontier, made.levels[height - 1], wanted[height - 1])
        frontier = lower.unionAll(entered.where(F.col("height") == height - 1).drop("height"))
        if height > 1:
            frontier = materialise(frontier)
    return frontier.withColumn("path", F.reverse("path"))


def proof_digest(path: Column) -> Column:
    """One digest over all siblings of a path, from the leaf up, as hex text."""
    beside = F.array_join(F.transform(path, lambda s: text_of(F.concat(s["before"], s["after"]))), "")
    return F.sha2(beside.cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to, as hex text."""
    return F.aggregate(
        path,
        text_of(leaf),
        lambda low, s: F.sha2(F.concat(text_of(s["before"]), low, text_of(s["after"])).cast("binary"), 256),
    )


#: The columns of a document in a leaf.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def audit(docs: DataFrame, tampered: Column, new_text: Column) -> DataFrame:
    """Every document's proof, and whether it still leads to the root with ``new_text`` where ``tampered`` holds.

    ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``, digests as hex text.
    A null value of any column is ``-`` in the leaf, an empty text ``0:``; texts are hashed whole. Null languages are a
    tree, null keys come first in theirs, repeated rows are leaves each. Other columns take no part. Without rows there
    is no root and no result.
    """
    own = [F.col(c) for c in COLUMNS]
    now = F.when(tampered, leaf_digest(*own[:-1], new_text))
    rows = docs.select(
        F.col("lang").cast("string").alias("tree"), F.col("doc_id").alias("key"), leaf_digest(*own).alias("leaf"), now.alias("now")
    )
    made = manifest(rows)
    proofs = descend(made, made.leaves.select("tree", F.col("rank").alias("node")))
    asked = made.leaves.select("tree", F.col("rank").alias("node"), "key", "leaf", "now")
    met = asked.join(proofs, ["tree", "node"]).join(made.trees.select("tree", "subroot"), "tree")
    root = F.lit(made.root.hex() if made.root else None).cast("string")
    up = folded(F.coalesce("now", "leaf"), F.col("path"))
    return met.select(
        F.col("key").alias("doc_id"),
        text_of(F.col("leaf")).alias("leaf"),
        text_of(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        up.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof against the manifest of all; a third is tampered with by lower-casing A to Z."""
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return audit(docs, F.coalesce(crc_rest(F.col("doc_id"), 3) == 0, F.lit(False)), lowered)


#: Levels that the SQL spells out: enough for 8 ** 12 leaves a language.
_SQL_LEVELS = 12


def _duck_tree(name: str, leaves: str) -> str:
    """Levels of the trees in ``leaves`` (tree, node, digest, and n, the tree's nodes on this level), one after another."""
    out = [f"{name}_0 as materialized (select * from {leaves})"]
    for k in range(1, _SQL_LEVELS + 1):
        out.append(f"""{name}_{k} as materialized (
  select tree, node // {ARITY} as node, sha256(string_agg(digest, '' order by node)) as digest, (any_value(n) + {ARITY - 1}) // {ARITY} as n
  from {name}_{k - 1} where n > 1 group by tree, node // {ARITY}
  union all select tree, node, digest, n from {name}_{k - 1} where n = 1)""")
    return ",\n".join(out)


def _duck_fold(name: str, start: str) -> str:
    """The rows of ``start`` (r, tree, node, own, beside) with the siblings of each level, and their own digest carried up.

    Nodes of a level, in the order of their places, are read with the run's others to their left and right.
    """
    out = [f"{name}_fold_0 as materialized (select * from {start})"]
    for k in range(_SQL_LEVELS):
        out.append(f"""{name}_fold_{k + 1} as materialized (
  select r, tree, case when n = 1 then node else node // {ARITY} end as node,
         case when n = 1 then own else sha256(lefts || own || rights) end as own,
         case when n = 1 then beside else beside || lefts || rights end as beside
  from {name}_fold_{k} join (
    select tree, node, n,
           coalesce(string_agg(digest, '') over (partition by tree, node // {ARITY} order by node rows between unbounded preceding and 1 preceding), '') as lefts,
           coalesce(string_agg(digest, '') over (partition by tree, node // {ARITY} order by node rows between 1 following and unbounded following), '') as rights
    from {name}_{k}) using (tree, node))""")
    return ",\n".join(out)


def _duck_leaf(text: str) -> str:
    values = ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v}))::varchar || ':' || {v}, '-')" for v in values) + ")"


def _duck_crc() -> str:
    """crc32 of ``s``, bit by bit."""
    step = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    for _ in range(7):
        step = f"list_transform([{step}], lambda x: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)[1]"
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(s, ''), lambda c: ascii(c)::bigint)),
      lambda crc, byte: list_transform([xor(crc, byte)], lambda x: {step})[1]))"""


ORACLE = f"""
with docs as materialized (
  select row_number() over () as r, doc_id, '=' || lang as tree, {_duck_leaf("text")} as leaf, doc_id::varchar as s,
         {_duck_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as changed
  from documents
), marked as materialized (
  select r, doc_id, coalesce(tree, '') as tree, leaf, case when s is not null and {_duck_crc()} % 3 = 0 then changed else leaf end as now
  from docs
), places as materialized (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as node, count(*) over (partition by tree) as n
  from marked
), leaves as (select tree, node, leaf as digest, n from places
), {_duck_tree("low", "leaves")}, subroots as materialized (
  select tree, digest as subroot, row_number() over (order by tree) - 1 as node, count(*) over () as n from low_{_SQL_LEVELS}
), tops as (select '' as tree, node, subroot as digest, n from subroots
), {_duck_tree("high", "tops")}, start as (select r, tree, node, now as own, '' as beside from places
), {_duck_fold("low", "start")}, between_trees as (
  select r, '' as tree, s.node, own, beside from low_fold_{_SQL_LEVELS} f join subroots s on f.tree = s.tree
), {_duck_fold("high", "between_trees")}
select p.doc_id, leaf, subroot, h.digest as root, sha256(beside) as proof_sha256, own as folded_root, own = h.digest as verified
from places p join high_fold_{_SQL_LEVELS} f on p.r = f.r join subroots s on s.tree = p.tree cross join high_{_SQL_LEVELS} h
"""
