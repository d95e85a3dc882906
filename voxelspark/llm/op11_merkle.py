"""Merkle manifest of a dataset: a tree per group, a tree over the groups' roots, proofs, and recomputation from changed leaves.

A digest H is the lower-case hex SHA-256 of its inputs one after the other, digests as hex text. A leaf is H of a row's columns,
each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. In a group leaves ascend by their order column. While a tree has
several nodes, every ``arity`` consecutive ones (a run; the last may be shorter, even one) become their H. What remains is the
subroot; subroots in the order of their groups (null first, then bytewise) make a tree in the same way, whose last node is the root.

Every level is one equijoin of its nodes with themselves: a node's siblings have computed indices, its own with the last bit
flipped in a binary tree, otherwise those at slot offsets 1 to arity - 1 in its run. Rows at slot zero then emit their run: its text,
that is its digests one after the other, and its digest, the parent. A proof needs nothing else: a node's siblings are its run's
text without its own slot. Going down, each run hands the texts above it to the runs (at last the leaves) below it by an equijoin on
its index, so what a hot group's rows have in common is sent once a run, never once a row.

Places are found without a window over a group: leaves are sorted by ranges, and counts per (range, group) give each
range's first place in each group. All groups climb together: jobs follow the logarithm of the largest group. Every level's table is
in the shared folder.

Edge cases: nulls in any column are ``-``; a null order value comes first; equal order values go by leaf digest, equal rows are a
leaf each (they differ in place, so in proof); empty and very long texts are hashed whole; a lone leaf is its own subroot, a
lone subroot the root, and a tree of one leaf has the empty proof; other columns are not read; an empty table gives no rows and a null root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelspark.llm.common import table
from voxelspark.plans.iterate import Scratch

HEX = 64


def encoded(column: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def siblings(index: Column, arity: int) -> Column:
    """Indices of the other places of a node's run; some may be past the tree's end."""
    if arity == 2:
        return F.array(index.bitwiseXOR(F.lit(1)))
    slot = F.pmod(index, F.lit(arity))
    return F.transform(F.sequence(F.lit(1), F.lit(arity - 1)), lambda k: index - slot + F.pmod(slot + k, F.lit(arity)))


def level_up(nodes: DataFrame, arity: int) -> DataFrame:
    """(tree, index, text, digest, n) of the runs of ``nodes`` (tree, index, digest, n: its tree's nodes on their level), n on the runs' level."""
    zero = nodes.where(F.col("index") % arity == 0).withColumn("first", F.col("index"))
    asked = zero.select("tree", "first", "n", F.explode(siblings(F.col("first"), arity)).alias("index")).where("index < n")
    found = asked.join(nodes.select("tree", "index", "digest"), ["tree", "index"])
    members = found.unionByName(zero).groupBy("tree", "first", "n").agg(F.array_sort(F.collect_list(F.struct("index", "digest"))).alias("_s"))  # arity of them at most
    run = members.select("tree", "first", "n", F.array_join(F.col("_s.digest"), "").alias("text"))
    up = lambda c: F.ceil(F.col(c) / arity).cast("long")
    return run.select("tree", up("first").alias("index"), "text", digest(F.col("text")).alias("digest"), up("n").alias("n"))


def climb(scratch: Scratch, nodes: DataFrame, arity: int) -> list[DataFrame]:
    """The settled runs of each level of all trees, lowest first: (tree, index, text, digest, n). nodes: tree, index, digest, n."""
    levels, now = [], nodes.where("n > 1")
    while not now.isEmpty():
        levels.append(scratch.settle(level_up(now, arity)))
        now = levels[-1].where("n > 1").select("tree", "index", "digest", "n")
    return levels


def ranked(scratch: Scratch, rows: DataFrame, order: list[str], by: str | None = None) -> DataFrame:
    """``rows`` with ``index`` (from 0, in the order of ``by``, then ``order``, inside each value of ``by``) and ``n``, the rows of that value.

    Rows are sorted by ranges, and each has the number of its range and its place there. A range's first place in a group is the
    sum of the group's counts in the ranges before: a row per (range, group).
    """
    keys = [*([by] if by else []), *order]
    put = scratch.settle(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    group = F.col(by) if by else F.lit("")
    put = put.withColumns({"_range": F.shiftright("_at", 33), "_group": group})
    counts = put.groupBy("_range", "_group").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_start"))
    inside = Window.partitionBy("_group").orderBy("_range")
    counts = scratch.settle(counts.withColumns({"_base": F.coalesce(F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_n").over(Window.partitionBy("_group"))}).drop("_n"))
    return put.join(counts, ["_range", "_group"]).withColumn("index", F.col("_base") + F.col("_at") - F.col("_start")).drop("_at", "_range", "_group", "_base", "_start")


@dataclass
class Manifest:
    """leaves: the rows with ``leaf``, tree (the group's place), index and n. groups: (tree, group key, n, subroot). levels, tops: runs of
    the groups' trees and of the tree over them, lowest first. root: one row at most."""

    leaves: DataFrame
    groups: DataFrame
    levels: list[DataFrame]
    tops: list[DataFrame]
    root: DataFrame
    arity: int


def build_manifest(rows: DataFrame, columns: list[str], group: str, order: str, arity: int = 16, changed: dict[str, Column] | None = None, keep: tuple[str, ...] = ()) -> Manifest:
    """The manifest of ``rows``, whose leaves hash ``columns``. ``changed``: other values for columns, hashed into ``changed_leaf`` beside
    ``leaf`` (the same where nothing changes); ``keep``: columns that leaves keep besides ``order``."""
    scratch = Scratch(rows.sparkSession, "merkle")
    other = digest(*(encoded((changed or {}).get(c, F.col(c))) for c in columns)) if changed else digest(*(encoded(F.col(c)) for c in columns))
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("_key")  # null first, then bytewise
    leaf = digest(*(encoded(F.col(c)) for c in columns))
    hashed = scratch.settle(rows.select(*dict.fromkeys([order, *keep]), key, leaf.alias("leaf"), other.alias("changed_leaf"), F.monotonically_increasing_id().alias("_nth")))
    placed = scratch.settle(ranked(scratch, hashed, [order, "leaf", "_nth"], "_key").drop("_nth"))
    groups = ranked(scratch, placed.where("index = 0").select("_key", F.col("leaf").alias("_first"), F.col("n").alias("_rows")), ["_key"])
    groups = scratch.settle(groups.select("_key", "_first", "_rows", F.col("index").alias("tree"), F.col("n").alias("trees")))
    return grow(scratch, placed, groups, arity)


def grow(scratch: Scratch, placed: DataFrame, groups: DataFrame, arity: int) -> Manifest:
    levels = climb(scratch, placed.select(F.col("_key").alias("tree"), "index", F.col("leaf").alias("digest"), "n"), arity)
    ends = [x.where("n = 1").select(F.col("tree").alias("_key"), F.col("digest").alias("_end")) for x in levels]
    joined = groups.withColumn("_end", F.lit(None).cast("string")) if not ends else groups.join(_union(ends), "_key", "left")
    groups = scratch.settle(joined.select("_key", "_rows", "tree", "trees", F.coalesce("_end", "_first").alias("subroot")))
    tops = climb(scratch, groups.select(F.lit("").alias("tree"), F.col("tree").alias("index"), F.col("subroot").alias("digest"), F.col("trees").alias("n")), arity)
    root = tops[-1].select(F.col("digest").alias("root")) if tops else groups.select(F.col("subroot").alias("root"))
    return Manifest(placed, groups, levels, tops, root, arity)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def without(text: Column, slot: Column) -> Column:
    """A run's text without the digest at ``slot``: the siblings."""
    return F.concat(text.substr(F.lit(1), slot * HEX), text.substr(slot * HEX + HEX + 1, F.length(text)))


def with_own(text: Column, slot: Column, own: Column) -> Column:
    return F.concat(text.substr(F.lit(1), slot * HEX), own, text.substr(slot * HEX + HEX + 1, F.length(text)))


def inherited(levels: list[DataFrame], top: DataFrame, arity: int) -> DataFrame:
    """(tree, index, path, *above) of the lowest runs: path has the texts of the run and of those above it. top: what each tree's last run
    hands down, (tree, *above)."""
    above = [c for c in top.columns if c != "tree"]
    now = None
    for runs in reversed(levels):
        own = runs.select("tree", "index", "n", F.array("text").alias("path"))
        ends = own.where("n = 1").join(top, "tree").select("tree", "index", "path", *above)
        if now is not None:
            up = now.select("tree", F.col("index").alias("_up"), F.col("path").alias("_path"), *above)
            inner = own.where("n > 1").withColumn("_up", F.floor(F.col("index") / arity)).join(up, ["tree", "_up"])
            ends = ends.unionByName(inner.select("tree", "index", F.concat("path", "_path").alias("path"), *above))
        now = ends
    return now


def proofs(m: Manifest) -> DataFrame:
    """m's leaves with ``path`` (texts of the runs from its own to its group's last), ``tops`` (those over its subroot), tree, subroot and root."""
    none = F.array().cast("array<string>")
    root = m.root.withColumn("_", F.lit(0))
    hung = m.groups.withColumn("_", F.lit(0)).join(F.broadcast(root), "_").drop("_")  # a row
    if m.tops:
        roof = inherited(m.tops, m.root.select(F.lit("").alias("tree")), m.arity)
        over = hung.withColumn("_up", F.floor(F.col("tree") / m.arity)).join(roof.select(F.col("index").alias("_up"), F.col("path").alias("tops")), "_up").drop("_up")
    else:
        over = hung.withColumn("tops", none)
    handed = over.select(F.col("_key").alias("tree"), F.col("tree").alias("place"), "tops", "subroot", "root")
    alone = m.leaves.where("n = 1").join(handed.withColumnRenamed("tree", "_key"), "_key").withColumn("path", none)
    if not m.levels:
        return alone
    down = inherited(m.levels, handed, m.arity).select(F.col("tree").alias("_key"), F.col("index").alias("_up"), "path", "place", "tops", "subroot", "root")
    inside = m.leaves.where("n > 1").withColumn("_up", F.floor(F.col("index") / m.arity)).join(down, ["_key", "_up"]).drop("_up")
    return alone.unionByName(inside)


def sibling_texts(arity: int) -> Column:
    """Column on rows of ``proofs``: the siblings from the leaf's level to the top, one after the other."""

    def along(texts: Column, place: Column) -> Column:
        step = lambda s, t: F.struct((s["at"] / arity).cast("long").alias("at"), F.concat(s["out"], without(t, F.pmod(s["at"], F.lit(arity)))).alias("out"))
        return F.aggregate(texts, F.struct(place.cast("long").alias("at"), F.lit("").alias("out")), step)["out"]

    return F.concat(along(F.col("path"), F.col("index")), along(F.col("tops"), F.col("place")))


def folded(leaf: Column, arity: int) -> Column:
    """Column on rows of ``proofs``: the root that ``leaf`` gives with the row's siblings."""

    def along(start: Column, texts: Column, place: Column) -> Column:
        step = lambda s, t: F.struct((s["at"] / arity).cast("long").alias("at"), F.sha2(with_own(t, F.pmod(s["at"], F.lit(arity)), s["own"]), 256).alias("own"))
        return F.aggregate(texts, F.struct(place.cast("long").alias("at"), start.alias("own")), step)["own"]

    return along(along(leaf, F.col("path"), F.col("index")), F.col("tops"), F.col("place"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    m = build_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", changed={"text": F.when(tampered, lower_ascii(F.col("text"))).otherwise(F.col("text"))})
    told = proofs(m).withColumns({"proof_sha256": F.sha2(sibling_texts(m.arity), 256), "folded_root": folded(F.col("changed_leaf"), m.arity)})
    return told.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
