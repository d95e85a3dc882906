"""Scores of a segmentation against voxel labels or skeletons. ``by`` columns (a threshold, say) run many at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.plans.iterate import Scratch
from voxelspark.sources.schema import AXES


def site_fragments(sites: DataFrame, fragments: DataFrame, offset=(0, 0, 0), voxel_size=(1, 1, 1), label: str = "label") -> DataFrame:
    """(id, fragment): the fragment under each site, 0 for background or none. World positions become voxel keys: an equi-join."""
    key = [f"_{a}" for a in AXES]
    at = sites.select("id", *(F.floor((F.col(a) - o) / s).cast("int").alias(k) for a, o, s, k in zip(AXES, offset, voxel_size, key, strict=True)))
    under = fragments.select(*(F.col(a).alias(k) for a, k in zip(AXES, key, strict=True)), F.col(label).alias("fragment"))
    return at.join(under, key, "left").select("id", F.coalesce("fragment", F.lit(0).cast("long")).alias("fragment"))


def background_sites(site_lut: DataFrame) -> DataFrame:
    return site_lut.agg(F.count(F.lit(1)).alias("sites"), F.coalesce(F.sum((F.col("fragment") == 0).cast("long")), F.lit(0)).alias("background"))


def site_segments(site_lut: DataFrame, lut: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, id, segment) of sites on a fragment; the table of segments is cut to their fragments first."""
    inside = site_lut.where("fragment <> 0")
    used = lut.join(inside.select("fragment").distinct(), "fragment", "left_semi")
    return inside.join(used, "fragment").select(*by, "id", "segment")


def contingency(df: DataFrame, a: str, b: str, ignore: Sequence[int] = (), by: Sequence[str] = ()) -> DataFrame:
    """(*by, a, b, n) counts of label pairs, without pairs whose ``a`` is ignored. Counts are made before they are shuffled."""
    kept = df.where(~F.col(a).isin(list(ignore))) if ignore else df
    return kept.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _with_marginals(table: DataFrame, by: Sequence[str]) -> DataFrame:
    a = table.groupBy(*by, "a").agg(F.sum("n").alias("na"))
    b = table.groupBy(*by, "b").agg(F.sum("n").alias("nb"))
    total = table.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = table.join(a, [*by, "a"]).join(b, [*by, "b"])
    return joined.join(total, list(by)) if by else joined.crossJoin(F.broadcast(total))  # one row


def _voi(over: Column) -> Column:
    return -(F.col("n") / F.col("total")) * F.log2(F.col("n") / over)


def rand_voi(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(voi_split, voi_merge, rand_split, rand_merge) from a contingency table, logarithms to base 2."""
    m = _with_marginals(table, by)
    joint = m.groupBy(*by).agg(F.sum(_voi(F.col("na"))).alias("voi_split"), F.sum(_voi(F.col("nb"))).alias("voi_merge"), F.sum(F.col("n").cast("double") ** 2).alias("_nn"))
    square = lambda side, into: table.groupBy(*by, side).agg(F.sum("n").alias("_n")).groupBy(*by).agg(F.sum(F.col("_n").cast("double") ** 2).alias(into))
    sa, sb = square("a", "_aa"), square("b", "_bb")
    all_ = joint.join(sa, list(by)).join(sb, list(by)) if by else joint.crossJoin(F.broadcast(sa)).crossJoin(F.broadcast(sb))  # one row each
    return all_.select(*by, "voi_split", "voi_merge", (F.col("_nn") / F.col("_aa")).alias("rand_split"), (F.col("_nn") / F.col("_bb")).alias("rand_merge"))


def voi_per_cluster(table: DataFrame, side: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, cluster, voi): ``a`` gives each component's split term, ``b`` each segment's merge term."""
    over = F.col("na") if side == "a" else F.col("nb")
    return _with_marginals(table, by).groupBy(*by, F.col(side).alias("cluster")).agg(F.sum(_voi(over)).alias("voi"))


def worst_clusters(clusters: DataFrame, k: int = 10) -> DataFrame:
    return clusters.orderBy(F.desc("voi"), "cluster").limit(k)


def bone_lengths(bones: DataFrame, sites: DataFrame) -> DataFrame:
    """Bones (source, target) with component_id and Euclidean length; those with an end that isn't a site go."""
    out = bones.select("source", "target")
    for end in ("source", "target"):
        extra = [F.col("component_id")] if end == "source" else []
        out = out.join(sites.select(F.col("id").alias(end), *(F.col(a).alias(f"{end}_{a}") for a in AXES), *extra), end)
    square = sum(((F.col(f"source_{a}") - F.col(f"target_{a}")) ** 2 for a in AXES), F.lit(0.0))
    return out.select("source", "target", "component_id", F.sqrt(square).alias("length"))


def skeleton_lengths(bones: DataFrame) -> DataFrame:
    return bones.groupBy("component_id").agg(F.sum("length").alias("length"))


def _ends(bones: DataFrame, segments: DataFrame, by: Sequence[str]) -> DataFrame:
    one = segments.select(*by, F.col("id").alias("source"), F.col("segment").alias("s"))
    two = segments.select(*by, F.col("id").alias("target"), F.col("segment").alias("t"))
    return bones.join(one, "source").join(two, [*by, "target"])


def merging_pairs(sites: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, segment, component_id): each component that a segment has sites of, once."""
    return segments.where("segment <> 0").join(sites.select("id", "component_id"), "id").select(*by, "segment", "component_id").distinct()


def merging_counts(sites: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, segment, n): segments with sites of more than one component, and of how many."""
    return merging_pairs(sites, segments, by).groupBy(*by, "segment").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def merging_segments(sites: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, segment, components): the same with the components as a sorted list, which a giant merge makes long; the counting
    statistics use ``merging_counts``."""
    return merging_pairs(sites, segments, by).groupBy(*by, "segment").agg(F.sort_array(F.collect_list("component_id")).alias("components")).where(F.size("components") > 1)


def runs(bones: DataFrame, sites: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, component_id, segment, length): error-free runs, bones with both ends in one segment that merges nothing."""
    inside = _ends(bones, segments, by).where("s = t and s <> 0").groupBy(*by, "component_id", F.col("s").alias("segment")).agg(F.sum("length").alias("length"))
    return inside.join(merging_counts(sites, segments, by).select(*by, "segment"), [*by, "segment"], "left_anti")


def expected_run_length(bones: DataFrame, sites: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, erl, max_erl, normalized): sum of squared runs over the total length; max_erl has every component whole.
    """
    found = runs(bones, sites, segments, by).groupBy(*by).agg(F.sum(F.col("length") ** 2).alias("_r"))
    if by:
        found = segments.select(*by).distinct().join(found, list(by), "left")
    best = skeleton_lengths(bones).agg(F.sum("length").alias("_t"), F.sum(F.col("length") ** 2).alias("_b"))
    both = found.crossJoin(F.broadcast(best)).withColumn("_r", F.coalesce("_r", F.lit(0.0)))  # one row
    return both.select(*by, (F.col("_r") / F.col("_t")).alias("erl"), (F.col("_b") / F.col("_t")).alias("max_erl"), (F.col("_r") / F.col("_b")).alias("normalized"))


def split_pairs(bones: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, component_id, a, b): pairs of segments, a < b, that bones of a component run between, each once."""
    return _ends(bones, segments, by).where("s <> t").select(*by, "component_id", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()


def split_counts(bones: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, component_id, n): components with such pairs, and how many."""
    return split_pairs(bones, segments, by).groupBy(*by, "component_id").agg(F.count(F.lit(1)).alias("n"))


def split_stats(bones: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, component_id, pairs): the same with the sorted (a, b) pairs as a list."""
    return split_pairs(bones, segments, by).groupBy(*by, "component_id").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("pairs"))


def merges_needed(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, merges_needed) of ``split_counts``."""
    return counts.groupBy(*by).agg(F.sum(F.col("n") - 1).alias("merges_needed"))


def unsplittable_fragments(sites: DataFrame, site_lut: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, segment, fragment, components): fragments of merging segments that hold sites of more than one component."""
    merging = merging_counts(sites, segments, by).select(*by, "segment")
    full = segments.join(site_lut, "id").join(sites.select("id", "component_id"), "id").join(merging, [*by, "segment"], "left_semi")
    return full.groupBy(*by, "segment", "fragment").agg(F.countDistinct("component_id").alias("components")).where("components > 1")


def report(sites: DataFrame, bones: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, segments, components, merging_segments, split_skeletons, segments_per_component)."""
    full = segments.where("segment <> 0").join(sites.select("id", "component_id"), "id")
    base = full.groupBy(*by).agg(F.countDistinct("segment").alias("segments"), F.countDistinct("component_id").alias("components"))
    merging = merging_counts(sites, segments, by).groupBy(*by).agg(F.count(F.lit(1)).alias("merging_segments"))
    splits = split_counts(bones, segments, by).groupBy(*by).agg(F.count(F.lit(1)).alias("split_skeletons"))
    join = (lambda a, b: a.join(b, list(by), "left")) if by else (lambda a, b: a.crossJoin(F.broadcast(b)))  # one row
    out = join(join(base, merging), splits)
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("merging_segments", "split_skeletons")]
    return out.select(*by, "segments", "components", *zero, (F.col("segments") / F.col("components")).alias("segments_per_component"))


def balance_weights(df: DataFrame, flag: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``weight``: total / (classes * count) of a 0/1 class, so that both weigh the same. The counts are written first, so
    the join knows their size and broadcasts them where they are few."""
    counts = Scratch(df.sparkSession, "balance").settle(df.groupBy(*by, flag).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_c"))
    both = counts.join(total, list(by)) if by else counts.crossJoin(F.broadcast(total))  # one row
    return df.join(both, [*by, flag]).withColumn("weight", F.col("_t") / (F.col("_c") * F.col("_n"))).drop("_n", "_t", "_c")


def weighted_mse(df: DataFrame, prediction: str, target: str, weight: str) -> DataFrame:
    """(loss): mean of weight * squared error where weight > 0; if all such terms are 0, the mean over all rows."""
    term = F.col(weight) * (F.col(prediction) - F.col(target)) ** 2
    got = df.agg(F.avg(F.when(term != 0, term)).alias("_some"), F.avg(F.when(F.col(weight) > 0, term)).alias("_over"), F.avg(term).alias("_all"))
    return got.select(F.when(F.col("_some").isNull(), F.col("_all")).otherwise(F.col("_over")).alias("loss"))


def synapse_voi(sites: DataFrame, segments: DataFrame, synapses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """rand_voi over the sites that are an end of a synapse."""
    ends = synapses.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    own = segments.join(ends, "id", "left_semi").join(sites.select("id", "component_id"), "id")
    return rand_voi(contingency(own, "component_id", "segment", by=by), by)

