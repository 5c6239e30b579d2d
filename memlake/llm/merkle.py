"""A Merkle manifest of a data set: nested-struct rollup of rank digits.

Each row is a leaf; rows of a group (source) are ranked by id, and a rank's base-`arity` digits are its path in the
group's tree. A tier takes `digits` of them: rows of one block meet in one task, and the digit columns are grouped
away one after another, each child struct nested in its parent's, so a block of arity^digits leaves becomes one row
that holds its whole subtree. Block roots are the nodes of the next tier, until each group has one; the groups' roots
are the leaves of one more tree. Proofs come down the same way: one transform over the nested structs collects a
leaf's siblings, one explode emits its rows. Within a block there is no join; between tiers, one row of a block meets
one row with its siblings above, since one nested row for a whole source would have no bound.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after another."""
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """The leaf digest of a row of documents, with another text if one is given."""
    return digest(*(_field(F.col(c) if c != "text" or text is None else text) for c in FIELDS))


class Tier(NamedTuple):
    """One row a block: grp, n (nodes of the group in this tier), block, node, depth, tree."""

    rows: DataFrame
    digits: int


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows (grp, row and others) with `rank` from 0 by `order`, then row, within grp and `n`, the group's size.

    Rows are dealt and sorted by ranges, so no group needs a task of its own; a task's first rank of a group is the
    sum of the group's rows in the tasks before. Equal rows are told apart by `row`.
    """
    by = [F.col(c).asc_nulls_first() for c in ("grp", *order, "row")]
    dealt = keep(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "ranked")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    runs = dealt.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    each = Window.partitionBy("grp")
    before = F.sum("here").over(each.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("grp", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("here").over(each).alias("n"))
    return dealt.join(runs, ["grp", "part"]).withColumn("rank", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def _depth(n: Column, arity: int, digits: int) -> Column:
    """Levels that a group of n nodes has in a tier: all `digits`, or in its last tier as many as join n nodes."""
    return sum((F.when(n > arity**j, 1).otherwise(0) for j in range(1, digits)), F.when(n > 1, 1).otherwise(0))


def _rolled(nodes: DataFrame, arity: int, digits: int) -> DataFrame:
    """nodes (grp, n, rank, node, item) as one row a block: its digits are grouped away from the last to the first."""
    split = [F.pmod(F.floor(F.col("rank") / F.lit(arity**j)), F.lit(arity)).cast("int").alias(f"d{j}") for j in range(digits)]
    block = F.floor(F.col("rank") / F.lit(arity**digits)).alias("block")
    rows = nodes.select("grp", "n", block, _depth(F.col("n"), arity, digits).alias("depth"), *split, "node", F.col("item").alias("tree"))
    rows = rows.repartition("grp", "block")  # stays as it is for all groupings that follow
    for j in range(digits):
        above = [f"d{i}" for i in range(digits - 1, j, -1)]
        kid = F.struct(F.col(f"d{j}").alias("d"), F.col("node"), F.col("tree"))
        rows = rows.groupBy("grp", "block", "n", "depth", *above).agg(F.array_sort(F.collect_list(kid)).alias("tree"))
        joined = F.sha2(F.array_join(F.col("tree.node"), ""), 256)
        rows = rows.withColumn("node", F.when(F.col("depth") > j, joined).otherwise(F.col("tree")[0]["node"]))
    return rows.select("grp", "n", "block", "depth", "node", "tree")


def rollup(nodes: DataFrame, arity: int = 3, digits: int = 5) -> list[Tier]:
    """Tiers from the leaves up; the last has one row a group, whose node is the group's root.

    nodes: grp, n, rank, node (hex) and item, which the leaves carry. No rows: one empty tier.
    """
    most, tiers = nodes.agg(F.max("n")).first()[0] or 1, []
    while True:
        tiers.append(Tier(keep(_rolled(nodes, arity, digits), "tier"), digits))
        most = -(-most // arity**digits)
        if most == 1:
            return tiers
        up = tiers[-1].rows
        nodes = up.select("grp", F.ceil(F.col("n") / F.lit(arity**digits)).alias("n"), F.col("block").alias("rank"), "node", F.lit(None).cast("int").alias("item"))


def _leaves(tree: Column, depth: Column, above: Column, level: int, path: tuple[Column, ...] = ()) -> Column:
    """The leaves of a nested tree, each with its siblings: those of the path down to it, from below, then `above`."""

    def one(kid: Column) -> Column:
        side = lambda keep_if: F.array_join(F.transform(F.filter(tree, keep_if), lambda x: x["node"]), "")
        steps = (F.struct(side(lambda x: x["d"] < kid["d"]).alias("left"), side(lambda x: x["d"] > kid["d"]).alias("right")), *path)
        if level:
            return _leaves(kid["tree"], depth, above, level - 1, steps)
        return F.struct(kid["d"].alias("d"), kid["node"].alias("node"), kid["tree"].alias("item"), F.concat(F.slice(F.array(*steps), F.lit(1), depth), above).alias("steps"))

    found = F.transform(tree, one)
    return F.flatten(found) if level else found


def proofs(tiers: list[Tier], tops: DataFrame, arity: int = 3) -> DataFrame:
    """grp, node, item, steps and tops' other columns, one row a leaf.

    tops: grp, block (0), steps (siblings above the group's root, from below) and others. A step is (left, right): the
    hex digests that stand before and after the node's own in what is hashed into its parent.
    """
    carried = [c for c in tops.columns if c not in ("grp", "block", "steps")]
    for tier in reversed(tiers):
        met = tier.rows.join(tops, ["grp", "block"])
        rows = met.select("grp", "block", *carried, F.posexplode(_leaves(F.col("tree"), F.col("depth"), F.col("steps"), tier.digits - 1)).alias("at", "leaf"))
        place = F.col("block") * F.lit(arity**tier.digits) + F.col("at")  # only the last run of each level is short
        tops = rows.select("grp", place.alias("block"), *carried, "leaf.node", "leaf.item", "leaf.steps")
        if tier is not tiers[0]:
            tops = tops.drop("node", "item")
    return tops.drop("block")


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf digest and its siblings give."""
    return F.aggregate(steps, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, arity: int = 3, digits: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A source's leaves ascend by doc_id (null first; rows with one id by their digests; repeated rows are alike), each
    run of `arity` nodes becomes the digest of its members, and so on to the source's subroot; sources ascend in
    UTF-8 order, null first and the empty string second, and their subroots give the root likewise. tampered: the
    text after tampering, of which the folded root is made; without it the texts are as they are. Columns other than
    those of FIELDS are ignored. No rows: an empty result. A single row: no siblings, its leaf is subroot and root.
    """
    own = leaf(docs)
    changed = F.when(~tampered.eqNullSafe(F.col("text")), leaf(docs, tampered)) if tampered is not None else F.lit(None).cast("string")
    group = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    rows = keep(docs.select(group.alias("grp"), "doc_id", own.alias("node"), changed.alias("changed")).withColumn("row", F.monotonically_increasing_id()), "leaves")
    at = ranked(rows, "doc_id", "node").select("grp", "n", "rank", "node", F.struct("doc_id", "changed").alias("item"))
    sources = rollup(keep(at, "at"), arity, digits)
    subroots = sources[-1].rows.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "node", F.lit(0).alias("row"))
    over = rollup(keep(ranked(subroots, "source").select("grp", "n", "rank", "node", F.col("source").alias("item")), "subroots"), arity, digits)
    none = F.array().cast("array<struct<left:string,right:string>>")
    top = over[-1].rows.select("grp", F.lit(0).cast("long").alias("block"), F.col("node").alias("root"), none.alias("steps"))
    tops = proofs(over, top, arity).select(F.col("item").alias("grp"), F.lit(0).cast("long").alias("block"), "root", F.col("node").alias("subroot"), "steps")
    found = proofs(sources, tops, arity)
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.coalesce(F.col("item.changed"), F.col("node")), F.col("steps"))
    out = found.select(F.col("item.doc_id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_breaks(docs: DataFrame) -> Column:
    """The tampering of the check query: texts of rows whose crc32(doc_id) is even lose their line feeds."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
