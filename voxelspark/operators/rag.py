"""Region adjacency graphs: building, cutting at thresholds, contracting and relabelling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.functions.roi import Roi
from voxelspark.operators.blocks import pair_counts_in_blocks, parts_for
from voxelspark.operators.labels import centers, dense_rank_of, with_entry
from voxelspark.operators.voxels import FACES, HALF_2, crop
from voxelspark.plans.iterate import Scratch, connected_components
from voxelspark.sources.schema import AXES, POS

#: Edges that one group may hold: a graph of no more is done in one pass.
WHOLE = 500_000


def ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    """Endpoints as u <= v."""
    return df.withColumns({"u": F.least(a, b), "v": F.greatest(a, b)})


def build_rag(voxels: DataFrame, label: str = "label", connectivity: int = 2, include_background: bool = False) -> DataFrame:
    """(u, v, n): labels that touch, u < v, and in how many voxel pairs. connectivity 1: faces; 2: faces and edges.

    Tasks follow the voxels, about a million each, so a task's memory stays the same at every size.
    """
    kept = Scratch(voxels.sparkSession, "rag").settle((voxels if include_background else voxels.where(F.col(label) != 0)).select(*POS, label))
    parts = parts_for(kept, kept.count())
    pairs = pair_counts_in_blocks(kept, FACES if connectivity == 1 else HALF_2, label, parts)
    return (pairs if parts is None else pairs.repartition(4 * parts, "u", "v")).groupBy("u", "v").agg(F.sum("n").alias("n"))


def edge_centers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the mean of their endpoints' centres."""
    both = with_endpoints(edges, nodes)
    return both.select(*edges.columns, *(((F.col(f"u_{a}") + F.col(f"v_{a}")) / 2).alias(f"center_{a}") for a in AXES))


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both endpoints' centres as u_<axis>, v_<axis>; edges whose endpoint has no centre go."""
    for end in ("u", "v"):
        edges = edges.join(nodes.select(F.col("id").alias(end), *(F.col(f"center_{a}").alias(f"{end}_{a}") for a in AXES)), end)
    return edges


def cut(edges: DataFrame, threshold: float) -> DataFrame:
    """Edges that a cut at ``threshold`` keeps: scored at or below it."""
    return edges.where(F.col("merge_score").isNotNull() & (F.col("merge_score") <= threshold))


def components_at(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(fragment, segment): the smallest fragment of each component; a node without such edges is its own."""
    found = connected_components(cut(edges, threshold), "u", "v", whole=WHOLE)
    return nodes.select(F.col("id").alias("fragment")).distinct().join(found, F.col("fragment") == F.col("node"), "left").select("fragment", F.coalesce("component", "fragment").alias("segment"))


def local_forest(t: pa.Table) -> pa.Table:
    """The edges of a bounded table that are in its minimum spanning forest by (merge_score, u, v)."""
    score, u, v = (t.column(c).to_numpy() for c in ("merge_score", "u", "v"))
    order = np.lexsort((v, u, score))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    one, two, root, kept = at[: len(u)][order].tolist(), at[len(u) :][order].tolist(), list(range(len(nodes))), []
    for k, (a, b) in enumerate(zip(one, two, strict=True)):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(k)
    return t.take(pa.array(order[np.array(kept, np.int64)]))


def spanning_forest(edges: DataFrame, max_rounds: int = 60, whole: int = WHOLE) -> DataFrame:
    """The minimum spanning forest by (merge_score, u, v).

    Unscored edges don't count. The forest has the components of the whole graph at every threshold, and fewer edges than nodes.
    Edges are dealt to groups of about ``whole``; an edge that its group's forest leaves out is in no forest. Once that no longer
    thins them, rounds: every component takes its least edge out, then those join. A graph of at most ``whole`` edges is one group.
    """
    scratch = Scratch(edges.sparkSession, "forest")
    scored = edges.where("merge_score is not null and u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("merge_score").alias("merge_score"))
    left = scratch.settle(scored.select(F.col("u").cast("long"), F.col("v").cast("long"), F.col("merge_score").cast("double")))
    n = left.count()
    for turn in range(max_rounds):
        parts = -(-n // max(1, whole))
        thin = left.groupBy(F.pmod(F.xxhash64("u", "v", F.lit(turn)), F.lit(max(1, parts)))).applyInArrow(local_forest, "u long, v long, merge_score double")
        left, older = scratch.settle(thin), left
        scratch.drop(older)
        n, had = left.count(), n
        if parts <= 1:
            return left
        if n > 0.8 * had:
            break
    open_ = scratch.settle(left.withColumns({"cu": F.col("u"), "cv": F.col("v")}))
    forest = None
    for _ in range(max_rounds):
        if open_.isEmpty():
            return forest if forest is not None else open_.select("u", "v", "merge_score")
        key = F.struct("merge_score", "u", "v")
        both = open_.select(F.col("cu").alias("c"), key.alias("e")).unionByName(open_.select(F.col("cv").alias("c"), key.alias("e")))
        best = scratch.settle(both.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        forest = best if forest is None else forest.unionByName(best)
        # which components the new edges join
        joined = open_.join(best.select("u", "v"), ["u", "v"], "left_semi").select("cu", "cv")
        found = connected_components(joined, "cu", "cv", whole=whole)
        for end in ("cu", "cv"):
            open_ = open_.join(found.select(F.col("node").alias(end), F.col("component").alias("_c")), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
        open_ = scratch.settle(open_.where("cu <> cv").select("u", "v", "merge_score", "cu", "cv"))
    raise RuntimeError(f"the forest did not settle in {max_rounds} rounds")


def segment_sweep(nodes: DataFrame, edges: DataFrame, thresholds: Sequence[float], forest: DataFrame | None = None, fan: int = 8) -> DataFrame:
    """lut(threshold, fragment, segment) for every threshold; one that is given twice counts once.

    The range of thresholds is split ``fan`` ways, round by round. A round finds components at the thresholds between the parts, all of
    them at once; above such a threshold its components stand for their nodes, and below it no higher edge matters. So an edge is in
    one part of a round, rounds grow with the logarithm of the thresholds, and no round has more than ``fan`` - 1 times the edges.
    """
    cuts = sorted({float(t) for t in thresholds})
    count, fan = len(cuts), max(2, fan)
    forest = spanning_forest(edges) if forest is None else forest
    # ids may be any 64-bit number: they are numbered in their order, and (number, threshold) is one key
    scratch = Scratch(edges.sparkSession, "sweep")
    every = nodes.select(F.col("id").alias("fragment")).distinct()
    if not cuts:
        return every.where("false").select(F.lit(None).cast("decimal(6,4)").alias("threshold"), "fragment", F.col("fragment").alias("segment"))
    ends = forest.select(F.explode(F.array("u", "v")).alias("fragment"))
    number = scratch.settle(dense_rank_of(every.unionByName(ends).distinct(), "fragment", "n"))
    for end in ("u", "v"):
        forest = forest.join(number.select(F.col("fragment").alias(end), F.col("n").alias(f"n{end}")), end)
    listed = F.array(*(F.lit(t) for t in cuts))
    first = F.size(F.filter(listed, lambda t: t < F.col("merge_score")))  # the lowest threshold that keeps the edge
    now = forest.select(F.col("nu").alias("a"), F.col("nv").alias("b"), first.alias("j")).where(F.col("j") < count)
    asked = every.join(number, "fragment").select("fragment", "n", F.lit(0).alias("part"))
    parts, found_at = [(0, count)], []
    at = lambda values, k: F.element_at(F.array(*values), k + 1)
    while parts:
        mids = [[low + k for k in range(high - low)] if high - low < fan else [low + (high - low) * k // fan for k in range(1, fan)] for low, high in parts]
        inner = [[low, *(m + 1 for m in ms)] for (low, _), ms in zip(parts, mids, strict=True)]
        outer = [[*ms, high] for (_, high), ms in zip(parts, mids, strict=True)]
        after = [(low, high) for lows, highs in zip(inner, outer, strict=True) for low, high in zip(lows, highs, strict=True) if low < high]
        place = {low: k for k, (low, _) in enumerate(after)}
        # by threshold: those of this round that keep its edges; the nearest one below, within its part; the part that it goes to
        used, below, open_ = [[] for _ in cuts], [-1] * count, [False] * count
        for (low, high), ms in zip(parts, mids, strict=True):
            for j in range(low, high):
                used[j], below[j], open_[j] = [m for m in ms if m >= j], max((m for m in ms if m < j), default=-1), j not in ms
        keep = at([F.array(*map(F.lit, u)) if u else F.array().cast("array<int>") for u in used], F.col("j"))
        keyed = now.select("a", "b", F.explode(keep).alias("k"))
        found = connected_components(keyed.select((F.col("a") * count + F.col("k")).alias("a"), (F.col("b") * count + F.col("k")).alias("b")), whole=WHOLE)
        named = found.select("node", F.expr(f"component div {count}").alias("_c"))
        each = asked.select("fragment", "n", F.explode(at([F.array(*map(F.lit, m)) for m in mids], F.col("part"))).alias("k")).withColumn("node", F.col("n") * count + F.col("k"))
        answer = each.join(named, "node", "left").select("k", "fragment", F.coalesce("_c", "n").alias("n"))
        if after:
            answer = scratch.settle(answer)
        found_at.append(answer)
        if not after:
            break
        part = lambda lows, k: at([F.lit(place.get(low, -1)) for low in lows], k)  # noqa: B023, E731
        low_end = asked.select("fragment", "n", part([low for low, _ in parts], F.col("part")).alias("part"))
        asked = low_end.unionByName(answer.select("fragment", "n", part(range(1, count + 1), F.col("k")).alias("part"))).where("part >= 0")
        now = now.withColumn("_m", at([F.lit(m) for m in below], F.col("j"))).where(at([F.lit(o) for o in open_], F.col("j")))
        for end in ("a", "b"):
            to = named.select("node", F.col("_c").alias("_to"))
            now = now.join(to, F.when(F.col("_m") >= 0, F.col(end) * count + F.col("_m")) == to["node"], "left").withColumn(end, F.coalesce("_to", end)).drop("node", "_to")
        now, asked, parts = scratch.settle(now.where("a <> b").select("a", "b", "j")), scratch.settle(asked), after
    least = found_at[0]
    for more in found_at[1:]:
        least = least.unionByName(more)
    back = least.join(number.select("n", F.col("fragment").alias("segment")), "n")
    return back.select(at([F.lit(t) for t in cuts], F.col("k")).cast("decimal(6,4)").alias("threshold"), "fragment", "segment")


def contract(nodes: DataFrame, edges: DataFrame, lut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with ``labels``, edges): each segment one node, edges between segments unscored."""
    grouped = lut.groupBy(F.col("segment").alias("id")).agg(F.sort_array(F.collect_list("fragment")).alias("labels"))
    to = lambda end: lut.select(F.col("fragment").alias(end), F.col("segment").alias(f"s{end}"))
    between = edges.join(to("u"), "u").join(to("v"), "v").where("su <> sv")
    return grouped, between.select(F.least("su", "sv").alias("u"), F.greatest("su", "sv").alias("v"), F.lit(None).cast("double").alias("merge_score"), F.lit(False).alias("agglomerated")).distinct()


def relabel(voxels: DataFrame, lut: DataFrame, label: str = "label", unmatched: str = "zero", into: str | None = None) -> DataFrame:
    """Labels through (fragment, segment). A label that the table doesn't have becomes 0 (``zero``) or stays (``keep``).

    Whether the table is broadcast is left to its measured size. Background, null or 0, meets no row of the table, and its voxels
    are spread over all tasks by their position.
    """
    if unmatched not in ("zero", "keep"):
        raise ValueError(unmatched)
    found = with_entry(voxels, label, lut.select("fragment", F.col("segment").alias("_s")), "_s", "fragment")
    other = F.lit(0).cast("long") if unmatched == "zero" else F.col(label)
    return found.withColumn("_s", F.coalesce("_s", other)).withColumn(into or label, F.col("_s")).drop("_s")


def segmentation(voxels: DataFrame, nodes: DataFrame, edges: DataFrame, threshold: float, label: str = "label") -> DataFrame:
    """Voxels with segments numbered 1..n in the order of their smallest fragment."""
    lut = components_at(nodes, edges, threshold)
    number = dense_rank_of(lut.select("segment").distinct(), "segment", "number")
    return relabel(voxels, lut.join(number, "segment").select("fragment", F.col("number").alias("segment")), label)


def local_segmentation(voxels: DataFrame, nodes: DataFrame, edges: DataFrame, roi: Roi, threshold: float, label: str = "label") -> DataFrame:
    """Segmentation of one box from the fragments in it and the edges between them; ValueError if it has none."""
    inside = crop(voxels, roi)
    own = nodes.join(inside.select(F.col(label).alias("id")).where("id <> 0").distinct(), "id", "left_semi")
    if own.isEmpty():
        raise ValueError("no fragments in the box")
    ids = own.select("id")
    between = edges.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi")
    return relabel(inside, components_at(own, between, threshold), label)


def with_attribute(edges: DataFrame, name: str, value) -> DataFrame:
    return edges.withColumn(name, F.lit(value))


def with_defaults(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Missing attributes: merge_score null, agglomerated false, labels [id]."""
    if "merge_score" not in edges.columns:
        edges = edges.withColumn("merge_score", F.lit(None).cast("double"))
    edges = edges.withColumn("agglomerated", F.coalesce("agglomerated", F.lit(False)) if "agglomerated" in edges.columns else F.lit(False))
    alone = F.array("id")
    return nodes.withColumn("labels", F.coalesce("labels", alone) if "labels" in nodes.columns else alone), edges


def segment_rag(lut: DataFrame, edges: DataFrame, segment: int, threshold: float) -> DataFrame:
    """(u, v, weight): edges at or below the threshold between fragments of one segment; weight 1 - merge_score."""
    own = lut.where(F.col("segment") == segment).select(F.col("fragment").alias("u"))
    return cut(edges, threshold).join(own, "u", "left_semi").join(own.withColumnRenamed("u", "v"), "v", "left_semi").select("u", "v", (1 - F.col("merge_score")).alias("weight"))


def numbered(lut: DataFrame) -> DataFrame:
    """(segment, number): 1..n."""
    return dense_rank_of(lut.select("segment").distinct(), "segment", "number")


def nodes_of(voxels: DataFrame, label: str = "label", offset=(0, 0, 0), voxel_size=(1, 1, 1)) -> DataFrame:
    return centers(voxels, label, offset, voxel_size)


def latest(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of the highest version per key; of equal versions the one whose other columns come last in their order."""
    rest = [F.col(c).desc() for c, kind in df.dtypes if c not in (*keys, version) and not kind.startswith("map")]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(version).desc(), *rest))).where("_n = 1").drop("_n")
