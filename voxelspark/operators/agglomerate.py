"""Edge scores from affinities, and hierarchical merging that settles groups of nodes on their own.

Mean and quantile of pooled samples are reducible: pooling two edges never gives less than the smaller score. Edges of one score
are told apart by the largest pair of fragments that went into them, which pooling never lowers either. So two nodes that are each
other's best edge are merged by the greedy order too, whatever happens elsewhere: a group of nodes that sees all their edges can
merge such pairs to the end, with edges to other groups as lower bounds, and the outcome is that of merging the lowest edge first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.operators.voxels import FACES, neighbours
from voxelspark.functions.roi import halo_blocks
from voxelspark.operators.labels import dense_rank_of
from voxelspark.plans.iterate import Scratch
from voxelspark.sources.schema import POS

BINS = 256
#: Edges of a group that are turned into Python objects at once.
LOADED = 4096


@dataclass(frozen=True)
class MeanScore:
    """1 - mean affinity; the state is (sum, count)."""

    def pool(self, samples: DataFrame) -> DataFrame:
        return samples.groupBy("u", "v").agg(F.struct(F.sum("aff").alias("total"), F.count(F.lit(1)).alias("n")).alias("state"))

    def again(self, edges: DataFrame) -> DataFrame:
        return edges.groupBy("u", "v").agg(F.struct(F.sum("state.total").alias("total"), F.sum("state.n").alias("n")).alias("state"))

    def score(self) -> Column:
        return 1 - F.col("state.total") / F.col("state.n")

    # the same for an edge at a time, inside a group of nodes
    def load(self, state: pa.Array) -> list:
        return list(zip(pc.struct_field(state, "total").to_pylist(), pc.struct_field(state, "n").to_pylist(), strict=True))

    def add(self, a, b):
        return a[0] + b[0], a[1] + b[1]

    def value(self, state) -> float:
        return 1 - state[0] / state[1]


@dataclass(frozen=True)
class QuantileScore:
    """1 - the q-quantile of affinities in 256 bins; the state is a map of bin to count. initmax: an edge starts from its largest."""

    q: float = 0.5
    initmax: bool = False

    def _of(self, binned: DataFrame) -> DataFrame:
        return binned.groupBy("u", "v").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bin", "n")))).alias("state"))

    def pool(self, samples: DataFrame) -> DataFrame:
        binned = samples.select("u", "v", F.least(F.lit(BINS - 1), F.floor(F.col("aff") * BINS)).cast("int").alias("bin"))
        if self.initmax:
            return self._of(binned.groupBy("u", "v").agg(F.max("bin").alias("bin"), F.lit(1).cast("long").alias("n")))
        return self._of(binned.groupBy("u", "v", "bin").agg(F.count(F.lit(1)).alias("n")))

    def again(self, edges: DataFrame) -> DataFrame:
        return self._of(edges.select("u", "v", F.explode("state").alias("bin", "n")).groupBy("u", "v", "bin").agg(F.sum("n").alias("n")))

    def score(self) -> Column:
        entries = F.array_sort(F.map_entries("state"))
        need = F.aggregate(entries, F.lit(0).cast("long"), lambda s, e: s + e["value"]) * F.lit(self.q)
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("bin"))
        found = F.aggregate(entries, start, lambda s, e: F.struct((s["seen"] + e["value"]).alias("seen"), F.when((s["bin"] < 0) & (s["seen"] + e["value"] >= need), e["key"]).otherwise(s["bin"]).alias("bin")))
        return 1 - found["bin"] / F.lit(float(BINS - 1))

    # the same for an edge at a time, inside a group of nodes
    def load(self, state: pa.Array) -> list:
        return [dict(x) for x in state.to_pylist()]

    def add(self, a, b):
        return {k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()}

    def value(self, state) -> float:
        need, seen = sum(state.values()) * self.q, 0
        for k in sorted(state):
            seen += state[k]
            if seen >= need:
                break
        return 1 - k / float(BINS - 1)


#: Names of the published score table.
SCORES = {"mean": MeanScore()} | {f"hist_quant_{q}": QuantileScore(q / 100) for q in (10, 25, 50, 75, 90)} | {f"hist_quant_{q}_initmax": QuantileScore(q / 100, True) for q in (10, 25, 50, 75, 90)}


def edge_affinities(voxels: DataFrame, label: str = "label", channels: Sequence[str] = ("aff_z", "aff_y", "aff_x")) -> DataFrame:
    """(u, v, aff): the affinity of each voxel to its predecessor along an axis, where that one is of another fragment."""
    packed = voxels.select(*POS, F.struct(label, *channels).alias("_v"))
    apart = lambda v, o: pc.not_equal(pc.struct_field(v, label), pc.struct_field(o, label))
    pairs = neighbours(packed, FACES, "_v", "_o", apart)
    aff = F.element_at(F.array(*(F.col(f"_v.{c}") for c in channels)), F.col("channel") + 1)
    a, b = F.col(f"_v.{label}"), F.col(f"_o.{label}")
    return pairs.where((a > 0) & (b > 0)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), aff.alias("aff")).where("aff is not null")


def edge_scores(samples: DataFrame, how=None) -> DataFrame:
    """(u, v, merge_score) of affinity samples."""
    how = how or MeanScore()
    return how.pool(samples).select("u", "v", how.score().alias("merge_score"))


def edges_of_group(t: pa.Table, how) -> tuple[list[list], dict, set]:
    """([u, v, state, score, tie] of every edge, height by node, the nodes inside) of a group's rows, one for each end ``n`` inside.

    An edge with both ends inside has two rows; only one becomes Python objects, LOADED rows at a time, as these take many times
    the bytes of the columns.
    """
    n, u = t.column("n").to_numpy(), t.column("u").to_numpy()
    inside = np.unique(n)
    t = t.filter(pa.array((n == u) | ~np.isin(u, inside)))
    edges, heights = [], {}
    for at in range(0, len(t), LOADED):
        part = t.slice(at, LOADED)
        column = {c: part.column(c).to_pylist() for c in ("u", "v", "score", "hu", "hv")}
        tie, states = part.column("tie").combine_chunks(), how.load(part.column("state").combine_chunks())
        ties = zip(*(pc.struct_field(tie, c).to_pylist() for c in ("u", "v")), strict=True)
        edges += map(list, zip(column["u"], column["v"], states, column["score"], ties, strict=True))
        heights |= dict(zip(column["u"], column["hu"], strict=True)) | dict(zip(column["v"], column["hv"], strict=True))
    return edges, heights, set(inside.tolist())


def settle_group(edges: list[list], heights: dict, inside: set, how, threshold: float) -> tuple[list, list]:
    """(merges: (a, b, score, round), moved: (node, its segment, height)) of what the nodes ``inside`` can merge by themselves.

    edges: [u, v, state, score, tie] of all edges that touch a node inside. Edges come by score. One that leaves the group holds its
    end, as that end's best is elsewhere; so does one whose other end is held. All others merge.
    """
    near, at, name, heap, merges = defaultdict(dict), {}, {}, [], []
    for k, (u, v, _, score, tie) in enumerate(edges):
        near[u][v] = near[v][u] = k
        if score < threshold:
            heap.append((score, tie, k))
    heapify(heap)
    held, height, gone = near.keys() - inside, dict(heights), set()
    while heap:
        score, _, k = heappop(heap)
        if k in gone:
            continue
        a, b = edges[k][:2]
        if a in held or b in held:
            held |= {a, b}
            continue
        a, b = (a, b) if len(near[a]) >= len(near[b]) else (b, a)  # the one with fewer edges moves
        one, other = sorted((name.get(a, a), name.get(b, b)))
        merges.append((one, other, score, max(height[a], height[b])))
        at[b], name[a], height[a] = a, one, max(height[a], height[b]) + 1
        del near[a][b], near[b][a]
        for c, old in near.pop(b).items():
            del near[c][b]
            if (also := near[a].get(c)) is None:
                edges[old][:2] = a, c
                near[a][c] = near[c][a] = old
                continue
            gone |= {old, also}
            state, tie = how.add(edges[also][2], edges[old][2]), max(edges[also][4], edges[old][4])
            edges[also][2] = edges[old][2] = None
            near[a][c] = near[c][a] = len(edges)
            edges.append([a, c, state, how.value(state), tie])
            if edges[-1][3] < threshold:
                heappush(heap, (edges[-1][3], tie, len(edges) - 1))
    moved = []
    for n in {*at, *name}:
        top = n
        while top in at:
            top = at[top]
        moved.append((n, name[top], height[top]))
    return merges, moved


def _settled_groups(edges: DataFrame, threshold: float, how, groups: int, whole: int) -> DataFrame:
    """(a, b, score, round) of merges and (a: node, b: its segment, height) of nodes that moved, from groups of nodes by ranges of ids.

    Ids are near each other where blocks number their fragments. A node with more than ``whole`` edges is in no group.
    """
    ends = edges.select(F.explode(F.array("u", "v")).alias("n"), "*")
    if groups > 1:
        hubs = ends.groupBy("n").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > whole).select("n")
        ends = ends.join(hubs, "n", "left_anti").repartitionByRange(groups, "n")
    else:
        ends = ends.coalesce(1)

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        edges, heights, inside = edges_of_group(pa.Table.from_batches(held), how)
        held.clear()
        merges, moved = settle_group(edges, heights, inside, how, threshold)
        rows = [(*m, None) for m in merges] + [(a, b, None, None, h) for a, b, h in moved]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], ["a", "b", "score", "round", "height"])

    return ends.mapInArrow(run, "a long, b long, score double, round int, height int")


def _contracted(edges: DataFrame, moved: DataFrame, how) -> DataFrame:
    """Edges between the segments that nodes ``moved`` to (node, segment, height), pooled and scored again."""
    for end in ("u", "v"):
        edges = edges.join(moved.select(F.col("node").alias(end), F.col("segment").alias("_to"), F.col("height").alias("_h")), end, "left")
        edges = edges.withColumns({end: F.coalesce("_to", end), f"h{end}": F.coalesce("_h", f"h{end}")}).drop("_to", "_h")
    low, high = (pick(F.struct("u", F.col("hu").alias("h")), F.struct(F.col("v").alias("u"), F.col("hv").alias("h"))) for pick in (F.least, F.greatest))
    edges = edges.where("u <> v").select(low.alias("_a"), high.alias("_b"), "state", "tie").select(F.col("_a.u").alias("u"), F.col("_b.u").alias("v"), F.col("_a.h").alias("hu"), F.col("_b.h").alias("hv"), "state", "tie")
    other = edges.groupBy("u", "v").agg(*(F.max(c).alias(c) for c in ("tie", "hu", "hv")))
    return how.again(edges.select("u", "v", "state")).join(other, ["u", "v"]).withColumn("score", how.score())


def agglomerate(samples: DataFrame, threshold: float, how=None, max_rounds: int = 500, max_merges: int | None = None, whole: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(history (a, b, c, score, round), lut (fragment, segment)): merges below ``threshold``; c is the smaller of a and b.

    round: the merge's height in the tree of merges, 0 where both are fragments. The lut has the fragments that merged.

    A round settles groups of nodes with about ``whole`` edges each, a task a group; then pairs that are each other's best across
    groups merge by joins, so hubs and borders move on too. Edges are pooled after either. It ends when no such pair is left, or
    when all edges were in one group. However large groups are, merges, scores and rounds are the same. Scores without methods for
    an edge at a time (``load``, ``add``, ``value``) go by joins alone.

    max_merges: the first so many merges in the order of score, which is that of merging the lowest edge first.
    """
    how, spark = how or MeanScore(), samples.sparkSession
    scratch = Scratch(spark, "agglomerate")
    pooled = how.pool(samples).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "state").withColumn("score", how.score())
    edges = scratch.settle(pooled.withColumns({"tie": F.struct("u", "v"), "hu": F.lit(0), "hv": F.lit(0)}))
    steps, lut = [], None
    for k in range(max_rounds):
        if hasattr(how, "value"):
            groups = max(1, -(-edges.count() // max(1, whole)))
            done = scratch.settle(_settled_groups(edges, threshold, how, groups, whole))
            steps.append(done.where("height is null").select("a", "b", "score", "round"))
            moved = done.where("height is not null").select(F.col("a").alias("node"), F.col("b").alias("segment"), "height")
            if groups == 1:
                lut = moved.select(F.col("node").alias("fragment"), "segment") if not k else None
                break
            after = scratch.settle(_contracted(edges, moved, how))
            scratch.drop(edges)
            edges = after
        key = F.struct("score", "tie", "u", "v", F.greatest("hu", "hv").alias("h"))
        best = edges.select(F.explode(F.array("u", "v")).alias("n"), key.alias("e")).groupBy("n").agg(F.min("e").alias("e"))
        # an edge that is the best of both its ends is the minimum of two nodes
        mutual = best.where(F.col("e.score") < threshold).groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        merges = scratch.settle(mutual.select(F.col("e.u").alias("a"), F.col("e.v").alias("b"), "e.score", F.col("e.h").alias("round")))
        if merges.isEmpty():
            break
        steps.append(merges)
        moved = merges.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("segment"), (F.col("round") + 1).alias("height"))
        after = scratch.settle(_contracted(edges, moved, how))
        scratch.drop(edges)
        edges = after
    else:
        raise RuntimeError(f"merging did not settle in {max_rounds} rounds")
    history = steps[0] if steps else spark.createDataFrame([], "a long, b long, score double, round int")
    for step in steps[1:]:
        history = history.unionByName(step)
    if max_merges is not None:
        history, lut = scratch.settle(history.orderBy("score", "round", "a", "b").limit(max_merges)), None
    history = history.select("a", "b", F.col("a").alias("c"), "score", "round")
    return history, _segments(history, scratch) if lut is None else lut


def _segments(history: DataFrame, scratch: Scratch) -> DataFrame:
    """(fragment, segment): a name goes into a smaller one once, so the last name comes by doubling pointers."""
    now = scratch.settle(history.select(F.col("b").alias("fragment"), F.col("a").alias("segment")))
    while True:
        further = now.toDF("segment", "_to")
        after = scratch.settle(now.join(further, "segment", "left").select("fragment", F.coalesce("_to", "segment").alias("segment"), F.col("_to").isNotNull().alias("_far")))
        ended = after.where("_far").isEmpty()
        scratch.drop(now)
        now = after.drop("_far")
        now._settled_at = after._settled_at
        if ended:
            return now.unionByName(now.select(F.col("segment").alias("fragment"), "segment").distinct())


def merge_tree(history: DataFrame) -> DataFrame:
    """(node, parent, score, level): every merge is a node, numbered after the largest leaf in the order of its round.

    level: 1 + the larger of its children's, leaves 0. Jobs grow with the logarithm of the highest level, not with the rounds.
    """
    scratch = Scratch(history.sparkSession, "tree")
    top = history.agg(F.max(F.greatest("a", "b"))).first()[0]
    ranked = dense_rank_of(history.select(F.struct("round", "score", "a", "b").alias("k")), "k", "_n")
    merges = scratch.settle(ranked.select("k.*", (F.col("_n") + F.lit(top or 0)).alias("node")))
    # the last merge of a name before this round made the tree node that now stands under that name
    before = Window.partitionBy("name").orderBy("round")
    names = merges.select(F.col("a").alias("name"), "round", "node").unionByName(merges.select(F.col("b").alias("name"), "round", "node"))
    under = names.withColumn("child", F.coalesce(F.lag("node").over(before), "name"))
    links = scratch.settle(under.select(F.col("child").alias("node"), F.col("node").alias("parent")))
    leaves = links.select("node").join(merges.select("node"), "node", "left_anti").distinct()
    every = leaves.unionByName(merges.select("node")).withColumn("level", F.lit(0))
    # the farthest node below, of those less than 1, 2, 4, ... steps away
    steps, levels = 1, scratch.settle(every)
    for jump in jumps(links, scratch):
        far = jump.join(levels, "node").groupBy(F.col("up").alias("node")).agg((F.max("level") + steps).alias("_l"))
        levels = scratch.settle(levels.join(far, "node", "left").select("node", F.greatest("level", F.coalesce("_l", "level")).cast("int").alias("level")))
        steps *= 2
    return levels.join(links, "node", "left").join(merges.select("node", "score"), "node", "left").select("node", "parent", "score", "level")


def jumps(tree: DataFrame, scratch: Scratch) -> Iterator[DataFrame]:
    """(node, up) for nodes that have an ancestor 1, then 2, 4, ... steps above; of a tree with ``node`` and ``parent``."""
    now = scratch.settle(tree.where("parent is not null").select("node", F.col("parent").alias("up")))
    while not now.isEmpty():
        yield now
        now = scratch.settle(now.join(now.select(F.col("node").alias("up"), F.col("up").alias("_u")), "up").select("node", F.col("_u").alias("up")))


def ancestors(tree: DataFrame) -> DataFrame:
    """(node, ancestor) for every node and all above it, itself included, by pointer doubling."""
    scratch = Scratch(tree.sparkSession, "ancestors")
    have = tree.select("node", F.col("node").alias("ancestor"))  # all less than 1, 2, 4, ... steps above
    for jump in jumps(tree, scratch):
        far = have.join(jump.select(F.col("node").alias("ancestor"), "up"), "ancestor").select("node", F.col("up").alias("ancestor"))
        have = scratch.settle(have.unionByName(far))
    return have


def find_merges(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """(u, v, merge_score): the score at which u and v first were one node, null if never: the lowest common ancestor's.

    u and v are leaves; an id that never merged may be the number of a merge, which it is not. Pointers of 1, 2, 4, ... steps are a
    row a node each; both ends are brought to one depth, then climb as long as they differ. Tables of nodes and pairs are joined as
    often as the depth has binary digits; nobody's list of ancestors is written.
    """
    scratch = Scratch(pairs.sparkSession, "lowest")
    tree = scratch.settle(tree.select("node", "parent", "score", "level"))
    pairs = scratch.settle(pairs.select("u", "v"))
    leaves, step = tree.where("level = 0").select("node"), []
    # ancestors up to 1, 2, 4, ... steps above, and the one that many steps above
    depth = scratch.settle(tree.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    while not depth.where("up is not null").isEmpty():
        step.append(depth.where("up is not null").select("node", "up"))
        above = depth.toDF("up", "_u", "_d")
        depth = scratch.settle(depth.join(above, "up", "left").select("node", F.col("_u").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")))
    asked = pairs.select("u", "v").where("u <> v").distinct()
    for end in ("u", "v"):
        leaf = depth.join(leaves, "node", "left_semi")
        asked = asked.join(leaf.select(F.col("node").alias(end), F.col("depth").alias(f"d{end}")), end)
    deep = F.col("du") >= F.col("dv")
    now = asked.select("u", "v", F.when(deep, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(deep, F.col("v")).otherwise(F.col("u")).alias("b"), F.abs(F.col("du") - F.col("dv")).alias("apart"))
    now = scratch.settle(now)
    for k, jump in enumerate(step):
        now = now.join(jump.toDF("a", "up"), "a", "left").withColumn("a", F.when(F.col("apart").bitwiseAND(F.lit(1 << k)) != 0, F.col("up")).otherwise(F.col("a"))).drop("up")
        if k % 4 == 3:
            now = scratch.settle(now)
    for k, jump in enumerate(reversed(step)):
        both = now.join(jump.toDF("a", "ua"), "a", "left").join(jump.toDF("b", "ub"), "b", "left")
        climb = F.coalesce(F.col("ua") != F.col("ub"), F.lit(False))
        now = both.select("u", "v", F.when(climb, F.col("ua")).otherwise(F.col("a")).alias("a"), F.when(climb, F.col("ub")).otherwise(F.col("b")).alias("b"))
        if k % 2:
            now = scratch.settle(now)
    up = tree.where("parent is not null").select("node", "parent")
    meet = now.join(up.toDF("a", "pa"), "a").join(up.toDF("b", "pb"), "b").where("pa = pb")
    least = meet.select("u", "v", F.col("pa").alias("node")).join(tree.select("node", F.col("score").alias("merge_score")), "node").select("u", "v", "merge_score")
    return pairs.select("u", "v").join(least, ["u", "v"], "left")


def mark_edges(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Edges with merge_score by find_merges, and agglomerated."""
    edges = Scratch(edges.sparkSession, "marked").settle(edges.drop("merge_score", "agglomerated"))  # they are read three times
    return edges.join(find_merges(edges, tree).distinct(), ["u", "v"], "left").withColumn("agglomerated", F.lit(True))


def _merged_in_blocks(voxels: DataFrame, block, context, threshold: float, label: str, how) -> tuple[DataFrame, DataFrame]:
    """(keyed: block and id of each number, history over numbers) of merges inside each block's read box alone."""
    blocks = ["block_z", "block_y", "block_x"]
    halo = halo_blocks(voxels, block, context)
    names = halo.select(*blocks, F.col(label).alias("id")).where("id <> 0").distinct()
    scratch = Scratch(voxels.sparkSession, "blockwise")
    keyed = scratch.settle(dense_rank_of(names.select(F.struct(*blocks, "id").alias("k")), "k", "number").select("k.*", "number"))
    inside = halo.join(keyed.withColumnRenamed("id", label), [*blocks, label])
    # neighbours within a block: the block is part of the position
    size = [b + 2 * c for b, c in zip(block, context, strict=True)]
    spread = inside.select(*(((F.col(f"block_{a}") * (2 * s)) + F.col(a) - F.col(f"block_{a}") * b + c).alias(a) for a, s, b, c in zip(POS, size, block, context, strict=True)), "number", "aff_z", "aff_y", "aff_x")
    return keyed, agglomerate(edge_affinities(spread, "number"), threshold, how)[0]


def agglomerate_blockwise(voxels: DataFrame, block, context, threshold: float, label: str = "label", how=None) -> DataFrame:
    """History of merges inside each block's read box alone: fragments are told apart by block while they merge.

    Columns: block_z, block_y, block_x, a, b, score, round. Seams differ from a run over the whole volume, and a merge near one is
    in the history of every block that sees it; ``blockwise_scores`` gives each edge once.
    """
    keyed, history = _merged_in_blocks(voxels, block, context, threshold, label, how)
    blocks = ["block_z", "block_y", "block_x"]
    back = keyed.select(*blocks, F.col("id").alias("_a"), F.col("number").alias("a"))
    return history.join(back, "a").join(keyed.select(F.col("id").alias("_b"), F.col("number").alias("b")), "b").select(*blocks, F.col("_a").alias("a"), F.col("_b").alias("b"), "score", "round")


def blockwise_scores(voxels: DataFrame, edges: DataFrame, nodes: DataFrame, block, context, threshold: float, label: str = "label", how=None) -> DataFrame:
    """Edges with merge_score, the score at which their ends became one node in the block that owns them (null if never), and
    agglomerated. An edge's owner is the block whose own box, without the context, holds the centre of its u (in voxels): each
    edge is in the result once, those whose u has no centre are not."""
    keyed, history = _merged_in_blocks(voxels, block, context, threshold, label, how)
    blocks = ["block_z", "block_y", "block_x"]
    owner = nodes.select(F.col("id").alias("u"), *(F.floor(F.col(f"center_{a}") / b).cast("int").alias(f"block_{a}") for a, b in zip(POS, block, strict=True)))
    own = edges.drop("merge_score", "agglomerated").join(owner, "u")
    for end in ("u", "v"):
        own = own.join(keyed.select(*blocks, F.col("id").alias(end), F.col("number").alias(f"_{end}")), [*blocks, end], "left")
    own = Scratch(voxels.sparkSession, "owned").settle(own)
    asked = own.where("_u is not null and _v is not null").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    found = find_merges(asked, merge_tree(history)).distinct().toDF("_u", "_v", "merge_score")
    return own.join(found, ["_u", "_v"], "left").drop("_u", "_v", *blocks).withColumn("agglomerated", F.lit(True))


def node_descriptor_scores(own: DataFrame, target: DataFrame, channels: Sequence[str], label: str = "label") -> DataFrame:
    """(id, score): sum over a label's voxels and channels of the squared difference to the target."""
    other = target.select(*POS, *(F.col(c).alias(f"_t{c}") for c in channels))
    square = sum(((F.col(c) - F.col(f"_t{c}")) ** 2 for c in channels), F.lit(0.0))
    return own.join(other, POS).groupBy(F.col(label).alias("id")).agg(F.sum(square).alias("score"))


def with_target(voxels: DataFrame, target: DataFrame, channels: Sequence[str]) -> DataFrame:
    """``voxels`` with the target's channels as _t<channel>, null where it has no row; the target has a row a position."""
    return voxels.join(target.select(*POS, *(F.col(c).alias(f"_t{c}") for c in channels)), POS, "left")


def edge_descriptor_scores(voxels: DataFrame, edges: DataFrame, target: DataFrame | None, sigma, voxel_size=(1, 1, 1), dims: int = 3) -> DataFrame:
    """(u, v, score): s(u + v) - s(u) - s(v), negative where the merged object is nearer to the target descriptors; of edges whose ends
    both have voxels with a target. Only voxels of one end near the other one count: all others' descriptors stay, and so do scores
    of ends that are nowhere near each other, which are 0. target: None where ``voxels`` hold its channels already (``with_target``)."""
    from voxelspark.operators.shape import changes_by_joining, channel_names

    channels = [f"_t{c}" for c in channel_names(dims)]
    if target is not None:
        voxels = Scratch(voxels.sparkSession, "descriptor").settle(with_target(voxels, target, channel_names(dims)))
    known = voxels.where("label <> 0").dropna(subset=channels).select("label").distinct()
    asked = edges.select("u", "v").where("u <> v").distinct()
    for end in ("u", "v"):
        asked = asked.join(known.withColumnRenamed("label", end), end, "left_semi")
    asked = Scratch(voxels.sparkSession, "descriptor").settle(asked.select("u", "v"))
    change = changes_by_joining(voxels, asked, channels, sigma, voxel_size, dims).groupBy("u", "v").agg(F.sum("change").alias("_c"))
    return asked.join(change, ["u", "v"], "left").select("u", "v", F.coalesce("_c", F.lit(0.0)).alias("score"))


def agglomerate_by_descriptors(voxels: DataFrame, edges: DataFrame, target: DataFrame, sigma, voxel_size=(1, 1, 1), dims: int = 3, threshold: float = 0.0, max_merges: int | None = None, max_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(history, lut) of merges that bring objects nearer to the target, in rounds of mutual best edges below ``threshold``.

    This score is not reducible: the outcome can differ from that of merging the lowest edge first. Rounds go on until no merge is
    left, as each takes a node away; RuntimeError if ``max_rounds`` are given and not enough.

    An edge's score depends on the voxels of its two ends alone. So a round scores the edges that the last one's merges touched,
    reading those ends' voxels; all others keep theirs. The target is joined to the voxels once; they get their segment when read.
    """
    from voxelspark.operators.rag import relabel
    from voxelspark.operators.shape import channel_names

    scratch, history, lut, done = Scratch(voxels.sparkSession, "bydescriptor"), None, None, 0
    asked, kept = scratch.settle(edges.select("u", "v").distinct()), None
    if set(channel_names(dims)) <= set(target.columns):  # joined once, for all rounds
        voxels, target = scratch.settle(with_target(voxels.where("label <> 0"), target, channel_names(dims))), None
    for k in count():
        part = voxels if lut is None else relabel(voxels, lut, unmatched="keep")
        if kept is not None:
            part = part.join(asked.select(F.explode(F.array("u", "v")).alias("label")).distinct(), "label", "left_semi")
        part = part if kept is None else scratch.settle(part)
        # ties are ties, whatever the order of sums: they go by u and v
        fresh = edge_descriptor_scores(part, asked, target, sigma, voxel_size, dims).withColumn("score", F.round("score", 9))
        scored = scratch.settle(fresh if kept is None else kept.unionByName(fresh))
        if kept is not None:
            scratch.drop(part)
        key = F.struct("score", "u", "v")
        best = scored.select(F.col("u").alias("n"), key.alias("e")).unionByName(scored.select(F.col("v").alias("n"), key.alias("e"))).groupBy("n").agg(F.min("e").alias("e"))
        picked = best.where(F.col("e.score") < threshold).groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("e.u", "e.v", "e.score")
        if max_merges is not None:
            picked = picked.orderBy("score", "u", "v").limit(max_merges - done)
        merges = scratch.settle(picked)
        n = merges.count()
        if not n:
            break
        if max_rounds is not None and k >= max_rounds:
            raise RuntimeError(f"merging did not settle in {max_rounds} rounds")
        done += n
        step = merges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("u").alias("c"), "score", F.lit(k).alias("round"))
        history = step if history is None else history.unionByName(step)
        to = merges.select(F.col("v").alias("fragment"), F.col("u").alias("segment"))
        older = None if lut is None else lut.join(to.select(F.col("fragment").alias("segment"), F.col("segment").alias("_to")), "segment", "left").select("fragment", F.coalesce("_to", "segment").alias("segment"))
        lut = scratch.settle(to if older is None else older.unionByName(to))
        if max_merges is not None and done >= max_merges:
            break
        touched = merges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("u").alias("to")), F.struct(F.col("v").alias("node"), F.col("u").alias("to")))).alias("t")).select("t.*")
        moved = scored
        for end in ("u", "v"):
            moved = moved.join(touched.withColumnsRenamed({"node": end, "to": f"_{end}"}), end, "left")
        moved = scratch.settle(moved)
        kept = moved.where("_u is null and _v is null").select("u", "v", "score")
        ends = moved.where("_u is not null or _v is not null").select(F.coalesce("_u", "u").alias("a"), F.coalesce("_v", "v").alias("b")).where("a <> b")
        asked = scratch.settle(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    spark = voxels.sparkSession
    if history is None:
        return spark.createDataFrame([], "a long, b long, c long, score double, round int"), spark.createDataFrame([], "fragment long, segment long")
    return history, lut.unionByName(lut.select(F.col("segment").alias("fragment"), "segment").distinct())
