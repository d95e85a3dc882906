"""Queries of shape descriptors, fragments, region graphs, merging, scores and samples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from voxelspark.functions import roi as R
from voxelspark.operators import agglomerate as A
from voxelspark.operators import batch as BN
from voxelspark.operators import evaluate as EV
from voxelspark.operators import fragments as FR
from voxelspark.operators import labels as L
from voxelspark.operators import rag as G
from voxelspark.operators import samples as SM
from voxelspark.operators import shape as SH
from voxelspark.operators import voxels as V
from voxelspark.plans import views as W
from voxelspark.plans.iterate import shared_folder
from voxelspark.plans.queries_voxels import r6
from voxelspark.sources import volumes as VOL
from voxelspark.sources.graph import RagStore
from voxelspark.streaming import blocks as B

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


height = W.height


def frags(spark, d):
    return W.plane(spark, d).select("z", "y", "x", F.col("frag").alias("label"), "gt", "raw")


def kernel_sql(sd: float) -> str:
    r = int(3 * sd + 0.5)
    return f"(SELECT d, exp(-0.5 * (d / {float(sd)}) ** 2) / (SELECT sum(exp(-0.5 * (e / {float(sd)}) ** 2)) FROM range({-r}, {r + 1}) t(e)) AS w FROM range({-r}, {r + 1}) t(d))"


def descriptor_sql(view: str, sigma: float, where: str = "label <> 0", probe: str = "TRUE") -> str:
    """2-D descriptors of ``view``(label, y, x) at voxel size 1."""
    return f"""m AS (SELECT a.label, a.y, a.x, sum(ky.w * kx.w) AS n, sum(ky.w * kx.w * ky.d) AS my, sum(ky.w * kx.w * kx.d) AS mx, sum(ky.w * kx.w * ky.d * ky.d) AS syy,
 sum(ky.w * kx.w * kx.d * kx.d) AS sxx, sum(ky.w * kx.w * ky.d * kx.d) AS syx FROM {view} a, {kernel_sql(sigma)} ky, {kernel_sql(sigma)} kx JOIN {view} b
 ON b.label = a.label AND b.y = a.y + ky.d AND b.x = a.x + kx.d WHERE a.{where} AND {probe} GROUP BY 1, 2, 3),
 c AS (SELECT label, y, x, n, my / n AS oy, mx / n AS ox, greatest(syy / n - (my / n) ** 2, 1e-3) AS vy, greatest(sxx / n - (mx / n) ** 2, 1e-3) AS vx, syx / n - my * mx / (n * n) AS cyx FROM m),
 described AS (SELECT label, y, x, least(1, greatest(0, oy / {sigma} * 0.5 + 0.5)) AS offset_y, least(1, greatest(0, ox / {sigma} * 0.5 + 0.5)) AS offset_x,
 least(1, greatest(0, vy / {sigma * sigma})) AS var_yy, least(1, greatest(0, vx / {sigma * sigma})) AS var_xx,
 least(1, greatest(0, cyx / sqrt(vy * vx) * 0.5 + 0.5)) AS pearson_yx, least(1, greatest(0, n)) AS size FROM c)"""


FRAG_VIEW = "f AS (SELECT frag AS label, y, x, gt, raw FROM v1)"
CH2 = ["offset_y", "offset_x", "var_yy", "var_xx", "pearson_yx", "size"]
CH2_SQL = ", ".join(f"round({c}, 5) AS {c}" for c in CH2)
SIGMA2 = (1, 2, 2)


def r5(*columns):
    return [F.round(F.col(c), 5).alias(c) for c in columns]


@query("f1_shape_descriptors", f"WITH {W.V1}, {FRAG_VIEW}, {descriptor_sql('f', 2)} SELECT label, y, x, {CH2_SQL} FROM described")
def f1(spark, d):
    return SH.shape_descriptors(frags(spark, d), SIGMA2, dims=2).select("label", "y", "x", *r5(*CH2))


def descriptor_sql_3d(view: str, sigma: float) -> str:
    """CTE ``described``: 3-D descriptors of ``view``(label, z, y, x) at voxel size 1."""
    r, axes = int(3 * sigma + 0.5), "zyx"
    d = {a: f"(b.{a} - a.{a})" for a in axes}
    w = " * ".join(f"exp(-0.5 * ({d[a]} / {float(sigma)}) ** 2)" for a in axes) + f" / (SELECT sum(exp(-0.5 * (e / {float(sigma)}) ** 2)) FROM range({-r}, {r + 1}) t(e)) ** 3"
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    first, second = ", ".join(f"sum(w * d{a}) AS m{a}" for a in axes), ", ".join(f"sum(w * d{a} * d{b}) AS s{a}{b}" for a, b in pairs)
    cov = lambda a, b: f"(s{a}{b} / n - m{a} * m{b} / (n * n))"
    cut = lambda e: f"round(least(1, greatest(0, {e})), 5)"
    chan = [f"{cut(f'm{a} / n / {sigma} * 0.5 + 0.5')} AS offset_{a}" for a in axes] + [f"{cut(f'v{a} / {sigma * sigma}')} AS var_{a}{a}" for a in axes]
    chan += [f"{cut(f'{cov(a, b)} / sqrt(v{a} * v{b}) * 0.5 + 0.5')} AS pearson_{a}{b}" for a, b in pairs if a != b] + [f"{cut('n')} AS size"]
    return f"""k AS (SELECT a.label, a.z, a.y, a.x, {", ".join(f"{d[a]} AS d{a}" for a in axes)}, {w} AS w FROM {view} a JOIN {view} b ON a.label <> 0 AND a.label = b.label AND {" AND ".join(f"abs({d[a]}) <= {r}" for a in axes)}),
 m AS (SELECT label, z, y, x, sum(w) AS n, {first}, {second} FROM k GROUP BY 1, 2, 3, 4), c AS (SELECT *, {", ".join(f"greatest({cov(a, a)}, 1e-3) AS v{a}" for a in axes)} FROM m),
 described AS (SELECT z, y, x, label, {", ".join(chan)} FROM c)"""


@query("f1_shape_descriptors_3d", f"WITH {W.V2}, {descriptor_sql_3d('v2', 1.5)} SELECT * FROM described")
def f1_3d(spark, d):
    """All ten channels, axis by axis."""
    found = SH.shape_descriptors(W.block(spark, d), (1.5, 1.5, 1.5))
    return found.select("z", "y", "x", "label", *r5(*SH.channel_names(3)))


@query("f2_sphere", f"""WITH {W.V1}, {FRAG_VIEW}, k AS (SELECT dy, dx FROM range(-3, 4) a(dy), range(-3, 4) b(dx) WHERE dy * dy + dx * dx <= 9),
 m AS (SELECT a.label, a.y, a.x, count(*) AS n, CAST(sum(dy) AS DOUBLE) AS my, CAST(sum(dx) AS DOUBLE) AS mx, CAST(sum(dy * dy) AS DOUBLE) AS syy FROM f a, k JOIN f b ON b.label = a.label AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3)
 SELECT label, y, x, round(least(1, greatest(0, my / n / 1.5 * 0.5 + 0.5)), 5) AS offset_y, round(least(1, greatest(0, mx / n / 1.5 * 0.5 + 0.5)), 5) AS offset_x,
 round(least(1, greatest(0, greatest(syy / n - (my / n) ** 2, 1e-3) / 9)), 5) AS var_yy, CAST(least(1, n) AS DOUBLE) AS size FROM m""")
def f2(spark, d):
    return SH.shape_descriptors(frags(spark, d), (3, 3, 3), mode="sphere", dims=2).select("label", "y", "x", *r5("offset_y", "offset_x", "var_yy"), "size")


@query("f3_labels", f"WITH {W.V1}, {FRAG_VIEW}, g AS (SELECT * FROM f WHERE label IN (1, 2, 30, 31)), {descriptor_sql('g', 2)} SELECT label, y, x, {CH2_SQL} FROM described")
def f3(spark, d):
    return SH.shape_descriptors(frags(spark, d), SIGMA2, dims=2, labels=[1, 2, 30, 31]).select("label", "y", "x", *r5(*CH2))


@query("f4_roi", f"WITH {W.V1}, {FRAG_VIEW}, {descriptor_sql('f', 2, probe='a.y >= 2 AND a.y < 9 AND a.x >= 13 AND a.x < 47')} SELECT label, y, x, {CH2_SQL} FROM described")
def f4(spark, d):
    return SH.shape_descriptors(frags(spark, d), SIGMA2, dims=2, roi=R.Roi((0, 2, 13), (1, 7, 34))).select("label", "y", "x", *r5(*CH2))


@query("f5_components", f"WITH {W.V1}, {FRAG_VIEW}, {descriptor_sql('f', 2)} SELECT label, y, x, round(offset_y, 5) AS offset_y, round(offset_x, 5) AS offset_x, round(size, 5) AS size FROM described")
def f5(spark, d):
    return SH.shape_descriptors(frags(spark, d), SIGMA2, dims=2, components="015").select("label", "y", "x", *r5("offset_y", "offset_x", "size"))


@query("f6_downsample", f"""WITH {W.V1}, f AS (SELECT gt AS label, y, x FROM v1 WHERE gt <> 0), g AS (SELECT label, y // 2 AS y, x // 2 AS x FROM f WHERE y % 2 = 0 AND x % 2 = 0),
 {descriptor_sql('g', 2)} SELECT f.label, f.y, f.x, round(coalesce(offset_y, 0), 5) AS offset_y, round(coalesce(var_xx, 0), 5) AS var_xx, round(coalesce(pearson_yx, 0), 5) AS pearson_yx
 FROM f LEFT JOIN described ON described.label = f.label AND described.y = f.y // 2 AND described.x = f.x // 2""")
def f6(spark, d):
    p = W.plane(spark, d).select("z", "y", "x", F.col("gt").alias("label"))
    return SH.shape_descriptors(p, (4, 4, 4), dims=2, downsample=2).select("label", "y", "x", *r5("offset_y", "var_xx", "pearson_yx"))


@query("f7_context", "SELECT o_orderkey, o_orderkey % 50 - 24 AS lo, o_orderkey % 50 + 100 + 24 AS hi FROM orders")
def f7(spark, d):
    c = int(SH.context((8, 8, 8))[0])
    lo, hi = R.box_grow(F.col("o_orderkey") % 50, F.col("o_orderkey") % 50 + 100, c, c)
    return W.table(spark, d, "orders").select("o_orderkey", lo.alias("lo"), hi.alias("hi"))


@query("f8_descriptor_target", f"""WITH {W.V1}, f AS (SELECT gt AS label, y, x, raw FROM v1), {descriptor_sql('f', 2)}
 SELECT f.label, f.y, f.x, round(coalesce(offset_y, 0), 5) AS offset_y, round(coalesce(size, 0), 5) AS size, CAST(f.x < 100 AND f.y % 3 > 0 AS INT) AS weight FROM f LEFT JOIN described ON f.label = described.label AND f.y = described.y AND f.x = described.x""")
def f8(spark, d):
    p = W.plane(spark, d).select("z", "y", "x", F.col("gt").alias("label"))
    mask, known = p.select("z", "y", "x", (F.col("x") < 100).alias("masked")), p.select("z", "y", "x", (F.col("y") % 3 > 0).alias("masked"))
    return SH.descriptor_target(p, SIGMA2, labels_mask=mask, unlabelled=known, dims=2).select("label", "y", "x", *r5("offset_y", "size"), "weight")


@query("f9_unmask_background", f"WITH {W.V1} SELECT y, x, gt > 0 OR NOT (x < 60) AS masked FROM v1")
def f9(spark, d):
    return W.plane(spark, d).select("y", "x", SH.unmask_background(F.col("gt") > 0, F.col("x") < 60).alias("masked"))


@query("g1_boundary_mask", "SELECT l_orderkey, l_linenumber, (l_discount * 10 + l_tax * 12.5 + l_quantity / 50) / 3 > 0.5 AS masked FROM lineitem")
def g1(spark, d):
    chan = F.array(F.col("l_discount") * 10, F.col("l_tax") * 12.5, F.col("l_quantity") / 50)
    return W.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", FR.boundary_mask(chan).alias("masked"))


@query("e1_line_window", f"WITH {W.V1} SELECT y, x, max(CASE WHEN gt = 0 THEN x END) OVER (PARTITION BY y ORDER BY x) AS before, min(CASE WHEN gt = 0 THEN x END) OVER (PARTITION BY y ORDER BY x DESC) AS after FROM v1")
def e1(spark, d):
    mask = W.plane(spark, d).select("z", "y", "x", (F.col("gt") > 0).alias("masked"))
    return FR.nearest_background(mask, "masked", "x").select("y", "x", "before", "after")


@query("g2_distance_transform", f"WITH {W.V1} SELECT a.y, a.x, round(sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)), 6) AS distance FROM v1 a, v1 b WHERE b.gt = 0 GROUP BY 1, 2")
def g2(spark, d):
    mask = W.plane(spark, d).select("z", "y", "x", (F.col("gt") > 0).alias("masked"))
    return FR.distance_transform(mask, axes=("y", "x")).select("y", "x", *r6("distance"))


def plane_distance(spark, d):
    return FR.distance_transform(W.plane(spark, d).select("z", "y", "x", (F.col("gt") > 0).alias("masked")), axes=("y", "x"))


DIST = f"{W.V1}, dist AS (SELECT a.y, a.x, round(sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)), 6) AS d FROM v1 a, v1 b WHERE b.gt = 0 GROUP BY 1, 2)"
SEED = """top AS (SELECT a.y, a.x, a.y * 125 + a.x AS id FROM dist a WHERE a.d > 0 AND a.d >= (SELECT max(b.d) FROM dist b WHERE b.d > 0 AND b.y BETWEEN a.y - 3 AND a.y + 2 AND b.x BETWEEN a.x - 3 AND a.x + 2)),
 te AS (SELECT a.id AS u, b.id AS v FROM top a JOIN top b ON (a.y = b.y + 1 AND a.x = b.x) OR (a.y = b.y AND a.x = b.x + 1))"""


@query("g3_seeds", f"WITH RECURSIVE {DIST}, {SEED}, {W.roots_sql('SELECT u, v FROM te', 'SELECT id FROM top')} SELECT y, x, root + 1 AS seed FROM top JOIN comp ON node = id")
def g3(spark, d):
    found = plane_distance(spark, d).select("z", "y", "x", F.round("distance", 6).alias("distance"))
    return FR.seeds(found, (1, height(spark, d), W.WIDTH), min_seed_distance=6, axes=("y", "x"), masked_only=True).select("y", "x", "seed")


@query("g4_watershed")
def g4(spark, d):
    return FR.watershed(plane_distance(spark, d), (1, height(spark, d), W.WIDTH), min_seed_distance=6, axes=("y", "x")).select("y", "x", "fragment")


def aff_plane(spark, d):
    p = W.plane_affinities(spark, d)
    return p.select("z", "y", "x", F.lit(1.0).alias("aff_z"), *(F.coalesce(c, F.lit(1.0)).alias(c) for c in ("aff_y", "aff_x")))


@query("g5_fragments_from_affinities")
def g5(spark, d):
    p = aff_plane(spark, d).withColumn("chan", F.array("aff_z", "aff_y", "aff_x"))
    return FR.fragments_from_affinities(p, (1, height(spark, d), W.WIDTH), in_xy=True, min_seed_distance=4)


@query("g6_fragments_from_descriptors")
def g6(spark, d):
    found = SH.shape_descriptors(W.plane(spark, d).select("z", "y", "x", F.col("gt").alias("label")), SIGMA2, dims=2, components="01")
    centred = found.select("z", "y", "x", *((F.col(c) - 0.5).alias(c) for c in ("offset_y", "offset_x")))
    return FR.fragments_from_descriptors(centred, (1, height(spark, d), W.WIDTH), ("offset_y", "offset_x"), 1.0, 6, ("y", "x")).select("y", "x", "fragment")


@query("g7_extract_fragments")
def g7(spark, d):
    _, nodes = FR.extract_fragments(aff_plane(spark, d), (1, height(spark, d), W.WIDTH), epsilon=0.3, filter_below=0.2, in_xy=True, min_seed_distance=4)
    return nodes


@query("g7_block_labels", f"WITH {W.V1} SELECT y, x, CASE WHEN gt = 0 THEN 0 ELSE dense_rank() OVER (PARTITION BY y // 7, x // 10, gt = 0 ORDER BY gt) + (y // 7 * 13 + x // 10) * 70 END AS label FROM v1")
def g7_blocks(spark, d):
    p = W.plane(spark, d).select("z", "y", "x", F.col("gt").alias("fragment"))
    return FR.block_labels(p, (1, height(spark, d), W.WIDTH), (1, 7, 10))[0].select("y", "x", "label")


@query("g8_label_components", f"WITH RECURSIVE {W.V1}, hi AS (SELECT y, x, y * 125 + x AS id FROM v1 WHERE raw > 300000), he AS (SELECT a.id AS u, b.id AS v FROM hi a JOIN hi b ON (a.y = b.y + 1 AND a.x = b.x) OR (a.y = b.y AND a.x = b.x + 1)), {W.roots_sql('SELECT u, v FROM he', 'SELECT id FROM hi')} SELECT y, x, root + 1 AS component FROM hi JOIN comp ON node = id")
def g8(spark, d):
    p = W.plane(spark, d).select("z", "y", "x", (F.col("raw") > 300_000).cast("long").alias("hi"))
    return L.label_components(p, "hi", (1, height(spark, d), W.WIDTH)).select("y", "x", "component")


@query("g9_pre_agglomerate")
def g9(spark, d):
    p = W.plane_affinities(spark, d)
    return FR.pre_agglomerate(p, p.select("z", "y", "x", F.col("frag").alias("fragment")), 0.5).select("y", "x", "fragment")


@query("g10_grow_boundary", f"WITH {W.V1} SELECT y, x, CASE WHEN EXISTS (SELECT 1 FROM v1 b WHERE b.frag <> v1.frag AND ((b.y = v1.y AND abs(b.x - v1.x) = 1) OR (b.x = v1.x AND abs(b.y - v1.y) = 1))) THEN 0 ELSE frag END AS frag FROM v1")
def g10(spark, d):
    return L.grow_boundary(W.plane(spark, d).select("z", "y", "x", "frag"), "frag").select("y", "x", "frag")


@query("g11_median", f"WITH {W.V1} SELECT a.y, a.x, round(median(b.raw), 4) AS filtered FROM v1 a JOIN v1 b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2")
def g11(spark, d):
    return FR.stencil(W.plane(spark, d), "raw", "median").select("y", "x", F.round("filtered", 4).alias("filtered"))


@query("g11_sobel", f"""WITH {W.V1} SELECT a.y, a.x, round(sqrt(sum((b.y - a.y) * (2 - abs(b.x - a.x)) * b.raw) ** 2 + sum((b.x - a.x) * (2 - abs(b.y - a.y)) * b.raw) ** 2), 3) AS filtered
 FROM v1 a JOIN v1 b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2""")
def g11s(spark, d):
    return FR.stencil(W.plane(spark, d), "raw", "sobel").select("y", "x", F.round("filtered", 3).alias("filtered"))


@query("g11_gaussian", f"WITH {W.V1} SELECT a.y, a.x, round(sum(ky.w * kx.w * b.raw), 3) AS filtered FROM v1 a, {kernel_sql(1.0)} ky, {kernel_sql(1.0)} kx JOIN v1 b ON b.y = a.y + ky.d AND b.x = a.x + kx.d GROUP BY 1, 2")
def g11g(spark, d):
    return FR.stencil(W.plane(spark, d), "raw", "gaussian").select("y", "x", F.round("filtered", 3).alias("filtered"))


@query("g11_li_threshold")
def g11l(spark, d):
    p = W.plane(spark, d)
    return p.select("y", "x", (F.col("raw") > FR.li_threshold(p, "raw")).alias("above"))


@query("h1_build_rag", f"""WITH {W.V2}, o(dz, dy, dx) AS (VALUES (-1, 0, 0), (0, -1, 0), (0, 0, -1), (-1, -1, 0), (-1, 1, 0), (-1, 0, -1), (-1, 0, 1), (0, -1, -1), (0, -1, 1))
 SELECT least(a.label, b.label) AS u, greatest(a.label, b.label) AS v, count(*) AS n FROM v2 a, o JOIN v2 b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.label <> b.label AND a.label <> 0 AND b.label <> 0 GROUP BY 1, 2""")
def h1(spark, d):
    return G.build_rag(W.block(spark, d))


@query("h2_edge_centers", f"WITH {W.GRAPH1} SELECT u, v, round((a.center_y + b.center_y) / 2, 6) AS center_y, round((a.center_x + b.center_x) / 2, 6) AS center_x FROM e1 JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v")
def h2(spark, d):
    return G.edge_centers(W.plane_edges(spark, d), W.plane_nodes(spark, d)).select("u", "v", *r6("center_y", "center_x"))


@query("h3_components", f"WITH RECURSIVE {W.GRAPH1}, {W.roots_sql('SELECT u, v FROM e1 WHERE merge_score <= 0.62')} SELECT node AS fragment, root AS segment FROM comp")
def h3(spark, d):
    return G.components_at(W.plane_nodes(spark, d), W.plane_edges(spark, d), 0.62)


SWEEP = (0.5, 0.58, 0.62, 0.66)


@query("h4_segment_sweep", f"""WITH RECURSIVE {W.GRAPH1}, t(t) AS (VALUES {', '.join(f'({x})' for x in SWEEP)}), te AS (SELECT t, u AS a, v AS b FROM e1, t WHERE merge_score <= t UNION ALL SELECT t, v, u FROM e1, t WHERE merge_score <= t),
 reach AS (SELECT CAST(t AS DOUBLE) AS t, id AS root, id AS node FROM nodes, t UNION SELECT reach.t, reach.root, te.b FROM reach JOIN te ON reach.node = te.a AND reach.t = te.t)
 SELECT t AS threshold, node AS fragment, min(root) AS segment FROM reach GROUP BY 1, 2""")
def h4(spark, d):
    return G.segment_sweep(W.plane_nodes(spark, d), W.plane_edges(spark, d), SWEEP).withColumn("threshold", F.col("threshold").cast("double"))


@query("h4_spanning_forest", f"WITH RECURSIVE {W.GRAPH1}, {W.roots_sql('SELECT u, v FROM e1')} SELECT (SELECT count(*) FROM nodes) - count(DISTINCT root) AS edges FROM comp")
def h4f(spark, d):
    return G.spanning_forest(W.plane_edges(spark, d)).agg(F.count(F.lit(1)).alias("edges"))


@query("h5_contract", f"WITH {W.GRAPH1}, {W.THIRDS} SELECT DISTINCT least(a.segment, b.segment) AS u, greatest(a.segment, b.segment) AS v FROM e1 JOIN lut a ON a.fragment = u JOIN lut b ON b.fragment = v WHERE a.segment <> b.segment")
def h5(spark, d):
    n = W.plane_nodes(spark, d)
    return G.contract(n, W.plane_edges(spark, d), W.thirds(n))[1].select("u", "v")


@query("h5_contract_nodes", f"WITH {W.V1}, {W.NODES1}, {W.THIRDS} SELECT segment AS id, string_agg(CAST(fragment AS VARCHAR), ',' ORDER BY fragment) AS labels FROM lut GROUP BY 1")
def h5n(spark, d):
    n = W.plane_nodes(spark, d)
    return G.contract(n, W.plane_edges(spark, d), W.thirds(n))[0].select("id", F.concat_ws(",", F.transform("labels", lambda c: c.cast("string"))).alias("labels"))


@query("h6_segmentation", f"WITH RECURSIVE {W.GRAPH1}, {W.roots_sql('SELECT u, v FROM e1 WHERE merge_score <= 0.62')}, r AS (SELECT root, dense_rank() OVER (ORDER BY root) AS n FROM (SELECT DISTINCT root FROM comp)) SELECT y, x, CAST(n AS BIGINT) AS label FROM v1 JOIN comp ON frag = node JOIN r USING (root)")
def h6(spark, d):
    return G.segmentation(frags(spark, d), W.plane_nodes(spark, d), W.plane_edges(spark, d), 0.62).select("y", "x", "label")


LOCAL = "y >= 2 AND y < 10 AND x >= 20 AND x < 80"


@query("h7_local_segmentation", f"""WITH RECURSIVE {W.GRAPH1}, inside AS (SELECT * FROM v1 WHERE {LOCAL}), own AS (SELECT DISTINCT frag AS id FROM inside),
 {W.roots_sql('SELECT u, v FROM e1 WHERE merge_score <= 0.62 AND u IN (SELECT id FROM own) AND v IN (SELECT id FROM own)', 'SELECT id FROM own')} SELECT y, x, root AS label FROM inside JOIN comp ON frag = node""")
def h7(spark, d):
    return G.local_segmentation(frags(spark, d), W.plane_nodes(spark, d), W.plane_edges(spark, d), R.Roi((0, 2, 20), (1, 8, 60)), 0.62).select("y", "x", "label")


@query("h8_edge_attributes", f"WITH {W.GRAPH1} SELECT u, v, false AS agglomerated, 7 AS tag FROM e1")
def h8(spark, d):
    _, e = G.with_defaults(W.plane_nodes(spark, d), W.plane_edges(spark, d))
    return G.with_attribute(e, "tag", 7).select("u", "v", "agglomerated", "tag")


@query("h9_segment_rag", f"WITH {W.GRAPH1}, s AS (SELECT id AS fragment FROM nodes WHERE (id - 1) // 40 = 0) SELECT u, v, round(1 - merge_score, 6) AS weight FROM e1 WHERE merge_score <= 0.7 AND u IN (SELECT fragment FROM s) AND v IN (SELECT fragment FROM s)")
def h9(spark, d):
    return G.segment_rag(W.thirds(W.plane_nodes(spark, d), 40), W.plane_edges(spark, d), 1, 0.7).select("u", "v", *r6("weight"))


@query("i1_edge_affinities", f"WITH {W.GRAPH1} SELECT u, v, round(aff, 6) AS aff FROM samples")
def i1(spark, d):
    return W.plane_samples(spark, d).select("u", "v", *r6("aff"))


@query("i2_edge_score_mean", f"WITH {W.GRAPH1} SELECT u, v, round(merge_score, 6) AS merge_score FROM e1")
def i2(spark, d):
    return A.edge_scores(W.plane_samples(spark, d)).select("u", "v", *r6("merge_score"))


@query("i2_edge_score_quantile", f"""WITH {W.GRAPH1}, b AS (SELECT u, v, least(255, CAST(floor(aff * 256) AS INT)) AS bin FROM samples), c AS (SELECT u, v, bin, sum(count(*)) OVER (PARTITION BY u, v ORDER BY bin) AS upto, sum(count(*)) OVER (PARTITION BY u, v) AS total FROM b GROUP BY 1, 2, 3)
 SELECT u, v, round(1 - min(bin) FILTER (WHERE upto >= 0.75 * total) / 255.0, 6) AS merge_score FROM c GROUP BY 1, 2""")
def i2q(spark, d):
    return A.edge_scores(W.plane_samples(spark, d), A.SCORES["hist_quant_75"]).select("u", "v", *r6("merge_score"))


@query("i2_edge_score_initmax", f"WITH {W.GRAPH1} SELECT u, v, round(1 - max(least(255, CAST(floor(aff * 256) AS INT))) / 255.0, 6) AS merge_score FROM samples GROUP BY 1, 2")
def i2m(spark, d):
    return A.edge_scores(W.plane_samples(spark, d), A.SCORES["hist_quant_50_initmax"]).select("u", "v", *r6("merge_score"))


@query("i3_agglomerate")
def i3(spark, d):
    return A.agglomerate(W.plane_samples(spark, d), 0.62)[0].select("a", "b", "c", *r6("score"), "round")


@query("i4_merge_tree")
def i4(spark, d):
    return A.merge_tree(A.agglomerate(W.plane_samples(spark, d), 0.6)[0]).select("node", "parent", *r6("score"), "level")


@query("i5_find_merge")
def i5(spark, d):
    tree = A.merge_tree(A.agglomerate(W.plane_samples(spark, d), 0.6)[0])
    return A.find_merges(W.plane_edges(spark, d), tree).select("u", "v", *r6("merge_score"))


@query("i6_mark_edges")
def i6(spark, d):
    tree = A.merge_tree(A.agglomerate(W.plane_samples(spark, d), 0.6)[0])
    return A.mark_edges(W.plane_edges(spark, d), tree).select("u", "v", "n", *r6("merge_score"), "agglomerated")


@query("i7_blockwise_agglomeration")
def i7(spark, d):
    return A.agglomerate_blockwise(W.plane_affinities(spark, d).select("z", "y", "x", F.col("frag").alias("label"), "aff_z", "aff_y", "aff_x"), (1, 60, 60), (0, 5, 5), 0.6).select("block_y", "block_x", "a", "b", *r6("score"), "round")


@query("i7_blockwise_scores")
def i7_scores(spark, d):
    v = W.plane_affinities(spark, d).select("z", "y", "x", F.col("frag").alias("label"), "aff_z", "aff_y", "aff_x")
    return A.blockwise_scores(v, W.plane_edges(spark, d), W.plane_nodes(spark, d), (1, 60, 60), (0, 5, 5), 0.6).select("u", "v", "n", *r6("merge_score"), "agglomerated")


NODE_SCORE = " + ".join(f"(a.{c} - b.{c}) ** 2" for c in CH2)


def target_descriptors(spark, d):
    return SH.shape_descriptors(W.plane(spark, d).select("z", "y", "x", F.col("gt").alias("label")), SIGMA2, dims=2)


@query("i8_node_descriptor_score", f"""WITH {W.V1}, {FRAG_VIEW}, {descriptor_sql('f', 2)}, own AS (SELECT * FROM described), g AS (SELECT gt AS label, y, x FROM v1),
 {descriptor_sql('g', 2).replace('m AS', 'm2 AS').replace('FROM m)', 'FROM m2)').replace(' c AS', ' c2 AS').replace('FROM c)', 'FROM c2)').replace('described AS', 'target AS')}
 SELECT a.label AS id, round(sum({NODE_SCORE}), 4) AS score FROM own a JOIN target b ON a.y = b.y AND a.x = b.x GROUP BY 1""")
def i8(spark, d):
    return A.node_descriptor_scores(SH.shape_descriptors(frags(spark, d), SIGMA2, dims=2), target_descriptors(spark, d), CH2).select("id", F.round("score", 4).alias("score"))


OWN_TARGET = f"""{FRAG_VIEW}, {descriptor_sql('f', 2)}, own AS (SELECT * FROM described), g AS (SELECT gt AS label, y, x FROM v1),
 {descriptor_sql('g', 2).replace('m AS', 'm2 AS').replace('FROM m)', 'FROM m2)').replace(' c AS', ' c2 AS').replace('FROM c)', 'FROM c2)').replace('described AS', 'target AS')}"""
ALONE = f"alone AS (SELECT a.label AS id, sum({NODE_SCORE}) AS score FROM own a JOIN target b ON a.y = b.y AND a.x = b.x GROUP BY 1)"


@query("i9_edge_descriptor_score", f"""WITH {W.GRAPH1}, {OWN_TARGET}, {ALONE}, pairs AS (SELECT u, v, row_number() OVER (ORDER BY u, v) AS pair FROM e1), p AS (SELECT pair AS label, y, x FROM pairs JOIN f ON f.label = pairs.u OR f.label = pairs.v),
 {descriptor_sql('p', 2).replace('m AS', 'm3 AS').replace('FROM m)', 'FROM m3)').replace(' c AS', ' c3 AS').replace('FROM c)', 'FROM c3)').replace('described AS', 'merged AS')},
 joint AS (SELECT a.label AS pair, sum({NODE_SCORE}) AS score FROM merged a JOIN target b ON a.y = b.y AND a.x = b.x GROUP BY 1)
 SELECT pairs.u, pairs.v, round(joint.score - one.score - two.score, 4) AS score FROM pairs JOIN joint USING (pair) JOIN alone one ON one.id = pairs.u JOIN alone two ON two.id = pairs.v""")
def i9(spark, d):
    return A.edge_descriptor_scores(frags(spark, d), W.plane_edges(spark, d), target_descriptors(spark, d), SIGMA2, dims=2).select("u", "v", F.round("score", 4).alias("score"))


@query("i10_agglomerate_by_descriptor")
def i10(spark, d):
    v = frags(spark, d).select("z", "y", "x", "label")
    return A.agglomerate_by_descriptors(v, W.plane_edges(spark, d), target_descriptors(spark, d), SIGMA2, dims=2)[0].select("a", "b", "c", F.round("score", 4).alias("score"), "round")


@query("i11_after_merge", f"WITH {W.V1}, {W.NODES1}, {W.THIRDS}, g AS (SELECT segment AS label, y, x FROM v1 JOIN lut ON frag = fragment), {descriptor_sql('g', 2)} SELECT label, y, x, {CH2_SQL} FROM described")
def i11(spark, d):
    """Labels after merges, and their descriptors."""
    merged = G.relabel(frags(spark, d).select("z", "y", "x", "label"), W.thirds(W.plane_nodes(spark, d)), unmatched="keep")
    return SH.shape_descriptors(merged, SIGMA2, dims=2).select("label", "y", "x", *r5(*CH2))


@query("c8_ancestor_join", f"""WITH RECURSIVE {W.V1}, {W.NODES1}, tree AS (SELECT id AS node, CASE WHEN id >= 3 THEN id // 3 END AS parent FROM nodes),
 up AS (SELECT node, node AS ancestor FROM tree UNION ALL SELECT up.node, tree.parent FROM up JOIN tree ON up.ancestor = tree.node WHERE tree.parent IS NOT NULL) SELECT node, ancestor FROM up""")
def c8(spark, d):
    """Every node of a tree of fragments with all above it; a fragment's parent is the one of a third of its number."""
    return A.ancestors(W.plane_nodes(spark, d).select(F.col("id").alias("node"), F.expr("case when id >= 3 then id div 3 end").alias("parent")))


@query("c8_merge_ancestors")
def c8_merges(spark, d):
    return A.ancestors(A.merge_tree(A.agglomerate(W.plane_samples(spark, d), 0.6)[0]))


@query("d6_contingency", f"WITH {W.V1} SELECT gt AS a, frag AS b, count(*) AS n FROM v1 WHERE gt <> 0 GROUP BY 1, 2")
def d6(spark, d):
    return EV.contingency(W.plane(spark, d), "gt", "frag", (0,))


PJ = f"{W.V1}, j AS (SELECT gt AS a, frag AS b, count(*) AS n FROM v1 WHERE gt <> 0 GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS total FROM j)"
VOI = "round(-sum(n / total * log2(n / na)), 6) AS voi_split, round(-sum(n / total * log2(n / nb)), 6) AS voi_merge"


@query("d7_rand_voi", f"WITH {PJ} SELECT {VOI}, round(sum(n * n) / (SELECT sum(s * s) FROM (SELECT sum(n) s FROM j GROUP BY a)), 6) AS rand_split, round(sum(n * n) / (SELECT sum(s * s) FROM (SELECT sum(n) s FROM j GROUP BY b)), 6) AS rand_merge FROM m")
def d7(spark, d):
    return EV.rand_voi(EV.contingency(W.plane(spark, d), "gt", "frag", (0,))).select(*r6("voi_split", "voi_merge", "rand_split", "rand_merge"))


@query("d8_voi_per_cluster", f"WITH {PJ} SELECT a AS cluster, round(-sum(n / total * log2(n / na)), 6) AS voi FROM m GROUP BY 1")
def d8(spark, d):
    return EV.voi_per_cluster(EV.contingency(W.plane(spark, d), "gt", "frag", (0,)), "a").select("cluster", *r6("voi"))


@query("d9_worst_clusters", f"WITH {PJ}, c AS (SELECT b AS cluster, round(-sum(n / total * log2(n / nb)), 6) AS voi FROM m GROUP BY 1) SELECT * FROM c ORDER BY voi DESC, cluster LIMIT 10")
def d9(spark, d):
    return EV.worst_clusters(EV.voi_per_cluster(EV.contingency(W.plane(spark, d), "gt", "frag", (0,)), "b").select("cluster", *r6("voi")))


@query("d10_skeleton_lengths", f"WITH {W.BONES} SELECT component_id, round(sum(length), 4) AS length FROM bones GROUP BY 1")
def d10(spark, d):
    s = W.sites(spark, d).select("id", F.lit(0.0).alias("z"), F.lit(0.0).alias("y"), F.col("value").alias("x"), "component_id")
    return EV.skeleton_lengths(EV.bone_lengths(W.bones(spark, d), s)).select("component_id", F.round("length", 4).alias("length"))


def skeleton(spark, d):
    """(sites, bones, site lut, segments) of two tables of segments told apart by ``size``."""
    n, s = W.plane_nodes(spark, d), W.sites(spark, d)
    lut = W.thirds(n)
    site_lut = EV.site_fragments(s, W.plane(spark, d), label="frag")
    return s, W.bones(spark, d), site_lut, EV.site_segments(site_lut, lut)


MERGING = "merging AS (SELECT segment, count(DISTINCT component_id) AS c FROM seg JOIN sites USING (id) WHERE segment <> 0 GROUP BY 1 HAVING count(DISTINCT component_id) > 1)"
ENDS = "ends AS (SELECT b.component_id, b.length, s.segment AS s, t.segment AS t FROM bones b JOIN seg s ON s.id = b.source JOIN seg t ON t.id = b.target)"
#: Few components, so that some segments merge nothing.
COARSE = W.SKELETON.replace("user_id AS component_id, event_id AS source", "event_id // 40 AS component_id, event_id AS source").replace("user_id AS component_id,\n user_id % 3", "event_id // 40 AS component_id,\n user_id % 3").replace("PARTITION BY user_id", "PARTITION BY event_id // 40")


def coarse_skeleton(spark, d):
    from pyspark.sql import Window

    line = Window.partitionBy("component_id").orderBy("ts", "event_id")
    e = W.table(spark, d, "events").withColumn("component_id", F.floor(F.col("event_id") / 40).cast("long"))
    bones = e.select("component_id", F.col("event_id").alias("source"), F.lead("event_id").over(line).alias("target"), F.abs(F.col("value") - F.lead("value").over(line)).alias("length")).where("target is not null")
    s = W.sites(spark, d).withColumn("component_id", F.floor(F.col("id") / 40).cast("long"))
    site_lut = EV.site_fragments(s, W.plane(spark, d), label="frag")
    return s, bones, site_lut, EV.site_segments(site_lut, W.thirds(W.plane_nodes(spark, d)))


@query("d11_expected_run_length", f"""WITH {COARSE}, {MERGING}, {ENDS}, runs AS (SELECT component_id, s, sum(length) AS length FROM ends WHERE s = t AND s <> 0 AND s NOT IN (SELECT segment FROM merging) GROUP BY 1, 2), whole AS (SELECT sum(length) AS l FROM bones GROUP BY component_id)
 SELECT round(coalesce(sum(length * length), 0) / (SELECT sum(l) FROM whole), 4) AS erl, round((SELECT sum(l * l) / sum(l) FROM whole), 4) AS max_erl FROM runs""")
def d11(spark, d):
    s, bones, _, seg = coarse_skeleton(spark, d)
    return EV.expected_run_length(bones, s, seg).select(F.round("erl", 4).alias("erl"), F.round("max_erl", 4).alias("max_erl"))


@query("d12_split_stats", f"WITH {COARSE}, {ENDS} SELECT component_id, count(DISTINCT (least(s, t), greatest(s, t))) AS pairs FROM ends WHERE s <> t GROUP BY 1")
def d12(spark, d):
    _, bones, _, seg = coarse_skeleton(spark, d)
    return EV.split_counts(bones, seg).withColumnRenamed("n", "pairs")


@query("d13_merge_stats", f"WITH {COARSE}, {MERGING} SELECT segment, c AS components FROM merging")
def d13(spark, d):
    s, _, _, seg = coarse_skeleton(spark, d)
    return EV.merging_counts(s, seg).withColumnRenamed("n", "components")


@query("d14_merges_needed", f"WITH {COARSE}, {ENDS} SELECT CAST(sum(n - 1) AS BIGINT) AS merges_needed FROM (SELECT count(DISTINCT (least(s, t), greatest(s, t))) AS n FROM ends WHERE s <> t GROUP BY component_id)")
def d14(spark, d):
    _, bones, _, seg = coarse_skeleton(spark, d)
    return EV.merges_needed(EV.split_counts(bones, seg))


@query("d12_split_pairs", f"WITH {COARSE}, {ENDS} SELECT component_id, string_agg(p, ',' ORDER BY a, b) AS pairs FROM (SELECT DISTINCT component_id, least(s, t) AS a, greatest(s, t) AS b, least(s, t) || '-' || greatest(s, t) AS p FROM ends WHERE s <> t) GROUP BY 1")
def d12_pairs(spark, d):
    _, bones, _, seg = coarse_skeleton(spark, d)
    return EV.split_stats(bones, seg).select("component_id", F.concat_ws(",", F.transform("pairs", lambda p: F.concat_ws("-", p["a"].cast("string"), p["b"].cast("string")))).alias("pairs"))


@query("d13_merging_components", f"WITH {COARSE}, {MERGING} SELECT segment, string_agg(c, ',' ORDER BY c) AS components FROM (SELECT DISTINCT segment, component_id AS c FROM seg JOIN sites USING (id) WHERE segment IN (SELECT segment FROM merging)) GROUP BY 1")
def d13_lists(spark, d):
    s, _, _, seg = coarse_skeleton(spark, d)
    return EV.merging_segments(s, seg).select("segment", F.concat_ws(",", F.transform("components", lambda c: c.cast("string"))).alias("components"))


@query("d11_runs", f"WITH {COARSE}, {MERGING}, {ENDS} SELECT component_id, s AS segment, round(sum(length), 4) AS length FROM ends WHERE s = t AND s <> 0 AND s NOT IN (SELECT segment FROM merging) GROUP BY 1, 2")
def d11_runs(spark, d):
    """The runs that the expected run length is made of."""
    s, bones, _, seg = coarse_skeleton(spark, d)
    return EV.runs(bones, s, seg).select("component_id", "segment", F.round("length", 4).alias("length"))


@query("d15_unsplittable_fragments", f"WITH {COARSE}, {MERGING} SELECT segment, fragment, count(DISTINCT component_id) AS components FROM seg JOIN site_lut USING (id) JOIN sites USING (id) WHERE segment IN (SELECT segment FROM merging) GROUP BY 1, 2 HAVING count(DISTINCT component_id) > 1")
def d15(spark, d):
    s, _, site_lut, seg = coarse_skeleton(spark, d)
    return EV.unsplittable_fragments(s, site_lut, seg)


@query("d16_report_counts", f"""WITH {COARSE}, {MERGING}, {ENDS} SELECT count(DISTINCT segment) AS segments, count(DISTINCT component_id) AS components, (SELECT count(*) FROM merging) AS merging_segments,
 (SELECT count(DISTINCT component_id) FROM ends WHERE s <> t) AS split_skeletons, round(count(DISTINCT segment) / count(DISTINCT component_id), 6) AS segments_per_component FROM seg JOIN sites USING (id) WHERE segment <> 0""")
def d16(spark, d):
    s, bones, _, seg = coarse_skeleton(spark, d)
    return EV.report(s, bones, seg).select("segments", "components", "merging_segments", "split_skeletons", *r6("segments_per_component"))


@query("d17_balance_weights", f"WITH {W.V1}, c AS (SELECT gt > 0 AS f, count(*) AS n FROM v1 GROUP BY 1) SELECT y, x, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM v1 JOIN c ON f = (gt > 0)")
def d17(spark, d):
    return EV.balance_weights(W.plane(spark, d).select("y", "x", (F.col("gt") > 0).alias("f")), "f").select("y", "x", *r6("weight"))


@query("d18_weighted_mse", "SELECT round(avg(l_tax * (l_discount - l_quantity / 50) ** 2) FILTER (WHERE l_tax > 0), 6) AS loss FROM lineitem")
def d18(spark, d):
    return EV.weighted_mse(W.table(spark, d, "lineitem").withColumn("t", F.col("l_quantity") / 50), "l_discount", "t", "l_tax").select(*r6("loss"))


@query("d21_synapse_voi", f"WITH {COARSE}, ends2 AS (SELECT source AS id FROM bones UNION SELECT target FROM bones), j AS (SELECT component_id AS a, segment AS b, count(*) AS n FROM seg JOIN sites USING (id) WHERE id IN (SELECT id FROM ends2) GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS total FROM j) SELECT {VOI} FROM m")
def d21(spark, d):
    s, bones, _, seg = coarse_skeleton(spark, d)
    return EV.synapse_voi(s, seg, bones).select(*r6("voi_split", "voi_merge"))


@query("d_sweep_scores", f"""WITH {W.V1}, {W.NODES1}, j AS (SELECT k, gt AS a, CAST((frag - 1) // k * k + 1 AS BIGINT) AS b, count(*) AS n FROM v1, (VALUES (2), (3), (10)) t(k) WHERE gt <> 0 GROUP BY 1, 2, 3),
 m AS (SELECT *, sum(n) OVER (PARTITION BY k, a) AS na, sum(n) OVER (PARTITION BY k, b) AS nb, sum(n) OVER (PARTITION BY k) AS total FROM j) SELECT k, {VOI} FROM m GROUP BY k""")
def d_sweep(spark, d):
    """Scores of several segmentations in one job."""
    n = W.plane_nodes(spark, d)
    lut = None
    for k in (2, 3, 10):
        one = W.thirds(n, k).withColumn("k", F.lit(k))
        lut = one if lut is None else lut.unionByName(one)
    both = EV.contingency(W.plane(spark, d), "gt", "frag", (0,))
    table = both.join(lut, F.col("b") == F.col("fragment")).groupBy("k", "a", F.col("segment").alias("s")).agg(F.sum("n").alias("n")).withColumnRenamed("s", "b")
    return EV.rand_voi(table, ["k"]).select("k", *r6("voi_split", "voi_merge"))


@query("j1_affinities_from_labels", f"WITH {W.V1} SELECT a.y, a.x, CAST(coalesce(a.gt > 0 AND a.gt = b.gt, false) AS INT) AS aff_1, CAST(coalesce(a.gt > 0 AND a.gt = c.gt, false) AS INT) AS aff_2 FROM v1 a LEFT JOIN v1 b ON b.y = a.y - 1 AND b.x = a.x LEFT JOIN v1 c ON c.y = a.y AND c.x = a.x - 1")
def j1(spark, d):
    return SM.affinities_from_labels(W.plane(spark, d), label="gt").select("y", "x", "aff_1", "aff_2")


@query("j2_random_crops", f"""WITH {W.V1}, e AS (SELECT min(y) ly, max(y) hy, min(x) lx, max(x) hx FROM v1),
 o AS (SELECT crop, CAST(floor({W.uniform_sql(4, 'crop')} * greatest(1, hy + 1 - ly - 8 + 1)) + ly AS INT) AS lo_y, CAST(floor({W.uniform_sql(5, 'crop')} * greatest(1, hx + 1 - lx - 8 + 1)) + lx AS INT) AS lo_x FROM range(0, 720) t(crop), e)
 SELECT crop, 0 AS lo_z, lo_y, lo_x, count(*) / 64 AS share FROM o JOIN v1 ON gt > 0 AND y >= lo_y AND y < lo_y + 8 AND x >= lo_x AND x < lo_x + 8 GROUP BY 1, 3, 4 HAVING count(*) / 64 >= 0.9 ORDER BY crop LIMIT 10""")
def j2(spark, d):
    return SM.random_crops(W.plane(spark, d).withColumn("m", F.col("gt") > 0), 10, (1, 8, 8), "m", 0.9, 3)


@query("j3_choose_source", f"SELECT o_orderkey, CASE WHEN {W.uniform_sql(1, 'o_orderkey')} < 0.125 THEN 'a' WHEN {W.uniform_sql(1, 'o_orderkey')} < 0.375 THEN 'b' ELSE 'c' END AS source FROM orders")
def j3(spark, d):
    return SM.choose_source(W.table(spark, d, "orders").select("o_orderkey"), {"a": 1, "b": 2, "c": 5}, 1, "o_orderkey")


@query("j4_mirror_transpose", f"""WITH {W.V1}, s AS (SELECT y // 125 AS sample, z, y % 125 AS y, x, frag FROM v1), b AS (SELECT *, {W.drawn_sql(5, 'sample')} AS bits FROM s),
 f AS (SELECT sample, frag, bits, z, CASE WHEN bits & 2 > 0 THEN 124 - y ELSE y END AS y, CASE WHEN bits & 4 > 0 THEN 124 - x ELSE x END AS x FROM b)
 SELECT frag, CAST(sample AS BIGINT) AS sample, z, CAST(CASE WHEN bits & 8 > 0 THEN x ELSE y END AS INT) AS y, CAST(CASE WHEN bits & 8 > 0 THEN y ELSE x END AS INT) AS x FROM f""")
def j4(spark, d):
    p = W.plane(spark, d).select("z", "y", "x", "frag", F.floor(F.col("y") / 125).alias("sample")).withColumn("y", (F.col("y") % 125).cast("int"))
    return SM.mirror_transpose(p, (1, 125, 125), 5)


@query("j5_intensity_jitter", f"""WITH {W.V1}, s AS (SELECT z, y, x, raw / 500000 AS raw, y // 12 AS sample FROM v1)
 SELECT y, x, round(greatest(0, least(1, raw * ({W.uniform_sql(6, 'sample')} * (1.1 - 0.9) + 0.9) + ({W.uniform_sql(7, 'sample')} * (0.1 - -0.1) + -0.1) + ({W.uniform_sql(8, 'sample', 'z', 'y', 'x')} - 0.5) * 2 * 0.01)), 6) AS raw FROM s""")
def j5(spark, d):
    p = W.plane(spark, d).select("z", "y", "x", (F.col("raw") / 500_000).alias("raw"), F.floor(F.col("y") / 12).alias("sample"))
    return SM.intensity_jitter(p, "raw", 5, noise=0.01).select("y", "x", *r6("raw"))


@query("j6_pad", f"WITH {W.V1}, g AS (SELECT 0 AS z, CAST(y AS INT) y, CAST(x AS INT) x FROM (SELECT unnest(range(-3, (SELECT max(y) + 4 FROM v1))) AS y), range(-3, 128) b(x)) SELECT g.y, g.x, coalesce(frag, 0) AS frag FROM g LEFT JOIN v1 USING (z, y, x)")
def j6(spark, d):
    return SM.padded(W.plane(spark, d), R.Roi((0, 0, 0), (1, height(spark, d), W.WIDTH)), (0, 3, 3), "frag").select("y", "x", "frag")


@query("j7_sparse_labels", f"WITH {W.V1}, k AS (SELECT y, x, gt, gt > 0 AND {W.uniform_sql(2, 'gt')} < 0.3 AS keep FROM v1) SELECT y, x, CASE WHEN keep THEN gt ELSE 0 END AS label, CAST(keep AS INT) AS unlabelled FROM k")
def j7(spark, d):
    return SM.sparse_labels(W.plane(spark, d).select("z", "y", "x", F.col("gt").alias("label")), 0.3, 2).select("y", "x", "label", "unlabelled")


@query("j8_split", "SELECT c_name, CASE WHEN n <= 10 THEN 'test' WHEN n <= 20 THEN 'validation' ELSE 'train' END AS split FROM (SELECT c_name, row_number() OVER (ORDER BY c_name) AS n FROM customer)")
def j8(spark, d):
    return SM.split(W.table(spark, d, "customer").select("c_name"), "c_name").select("c_name", "split")


@query("j9_pad_to_multiple", "SELECT l_orderkey, l_linenumber, CAST(ceil(l_quantity / 16.0) * 16 AS BIGINT) AS size FROM lineitem")
def j9(spark, d):
    return W.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", SM.up_to_multiple(F.col("l_quantity"), 16).alias("size"))


@query("j10_stack", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 10 AS BIGINT) AS batch, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 10 AS BIGINT) AS place FROM orders")
def j10(spark, d):
    return SM.stacked(W.table(spark, d, "orders").select("o_orderkey"), 10, "o_orderkey").select("o_orderkey", "batch", "place")


@query("j11_sample_pipeline")
def j11(spark, d):
    p = W.plane(spark, d).select("z", "y", "x", F.col("gt").alias("label"), "raw", (F.col("y") % 3 > 0).cast("int").alias("known"))
    found = SM.training_samples(p, SIGMA2, (1, 10, 10), W.height(spark, d) // 2, 4, dims=2, seed=3, unlabelled="known")
    return found.select("batch", "place", "z", "y", "x", "label", *r6("raw"), "aff_1", "aff_2", *r6("aff_weight"), *r5("offset_y", "size"), "weight")


@query("j12_autocontext", f"WITH {W.V1}, {FRAG_VIEW}, {descriptor_sql('f', 2)} SELECT f.y, f.x, round(raw, 4) AS raw, {CH2_SQL.replace('round(', 'round(described.')} FROM f JOIN described ON f.y = described.y AND f.x = described.x")
def j12(spark, d):
    p = frags(spark, d)
    return SM.autocontext(p.select("z", "y", "x", F.round("raw", 4).alias("raw")), SH.shape_descriptors(p, SIGMA2, dims=2), CH2).select("y", "x", "raw", *r5(*CH2))


@query("b14_map_blocks", f"""WITH {W.V1}, h AS (SELECT y, x, raw, block_y, unnest(range(CAST(floor((x - 4) / 60.0) AS BIGINT), (x + 4) // 60 + 1)) AS block_x FROM
 (SELECT y, x, raw, unnest(range(CAST(floor((y - 4) / 60.0) AS BIGINT), (y + 4) // 60 + 1)) AS block_y FROM v1)), m AS (SELECT block_y, block_x, avg(raw) AS mean FROM h GROUP BY 1, 2)
 SELECT y, x, round(raw - mean, 2) AS centred FROM v1 JOIN m ON y // 60 = block_y AND x // 60 = block_x""")
def b14(spark, d):
    """A user function per block and its context: each voxel minus its block's mean."""

    def fn(read, _):
        t = read["raw"]
        raw = t.column("raw").to_numpy().astype(float)
        return t.append_column("centred", pa.array((raw - raw.mean()).round(2)))

    voxels = W.plane(spark, d).select("z", "y", "x", "raw")
    return B.map_blocks({"raw": B.BlockInput(voxels, (0, 4, 4))}, fn, "centred double", (1, 60, 60)).select("y", "x", "centred")


def halo_sql(view: str, columns: str, size: int, context: int, block: int = 60) -> str:
    """Voxels of ``size`` world units with the blocks whose context holds them."""
    per = lambda a: f"unnest(range(CAST(floor(({a} * {size} - {context}) / {block}.0) AS BIGINT), ({a} * {size} + {context}) // {block} + 1)) AS block_{a}"
    return f"(SELECT y, x, {columns}, block_y, {per('x')} FROM (SELECT y, x, {columns}, {per('y')} FROM {view}))"


@query("b14_two_sources", f"""WITH {W.V1}, coarse AS (SELECT y // 10 AS y, x // 10 AS x, gt FROM v1 WHERE y % 10 = 0 AND x % 10 = 0), r AS (SELECT block_y, block_x, max(raw) AS top FROM {halo_sql("v1", "raw", 1, 4)} GROUP BY 1, 2),
 g AS (SELECT block_y, block_x, count(*) FILTER (WHERE gt > 0) AS objects, count(*) AS places FROM {halo_sql("coarse", "gt", 10, 20)} GROUP BY 1, 2)
 SELECT y, x, CAST(floor(raw / (2 * top) * 255 + 1e-7) AS INT) AS bright, coalesce(objects, 0) AS objects, coalesce(places, 0) AS places FROM v1 JOIN r ON y // 60 = r.block_y AND x // 60 = r.block_x LEFT JOIN g ON r.block_y = g.block_y AND r.block_x = g.block_x""")
def b14_two(spark, d):
    """Raw values and ten times coarser objects, each with its own context; brightness comes as bytes."""

    def fn(read, _):
        raw, objects = read["raw"], read["objects"].column("gt").to_numpy()
        bright = raw.column("raw").to_numpy().astype(float)
        t = raw.append_column("bright", pa.array(bright / (2 * bright.max()) + 1e-7 / 255))
        for name, n in (("objects", int((objects > 0).sum())), ("places", len(objects))):
            t = t.append_column(name, pa.array([n] * len(t), pa.int64()))
        return t

    p = W.plane(spark, d)
    inputs = {"raw": B.BlockInput(p.select("z", "y", "x", "raw"), (0, 4, 4)), "objects": B.BlockInput(V.downsampled(p.select("z", "y", "x", "gt"), (1, 10, 10)), (0, 20, 20), (1, 10, 10))}
    return B.map_blocks(inputs, fn, "bright double, objects long, places long", (1, 60, 60), as_bytes=["bright"]).select("y", "x", "bright", "objects", "places")


@query("k3_batch_nodes", f"""WITH {W.V1}, {FRAG_VIEW}, {descriptor_sql('f', 2, probe='a.y >= 3 AND a.y < 40 AND a.x >= 20 AND a.x < 90')}, m2 AS (SELECT min(raw) AS low, max(raw) AS high FROM f WHERE y >= -3 AND y < 46 AND x >= 14 AND x < 96)
 SELECT described.y, described.x, described.label, round((raw - low) / (high - low), 5) AS raw, {CH2_SQL.replace('round(', 'round(described.')} FROM described JOIN f ON f.y = described.y AND f.x = described.x, m2""")
def k3(spark, d):
    """A batch of one box through nodes: the descriptors ask for their context, the volumes are read in the grown box alone."""
    box = R.Roi((0, 3, 20), (1, 37, 70))
    normalised = BN.Each(lambda df: V.minmax(df.withColumn("_all", F.lit(0)), "raw", ("_all",), "raw").drop("_all"), "raw", "raw", reach=(0, 6, 6))
    batch = BN.batch({"raw": frags(spark, d).select("z", "y", "x", "raw"), "labels": frags(spark, d).select("z", "y", "x", "label")}, [normalised, BN.AddDescriptors("labels", "descriptors", SIGMA2, dims=2)], {"raw": box, "labels": box, "descriptors": box})
    return batch["descriptors"].join(batch["raw"], ["z", "y", "x"]).select("y", "x", "label", *r5("raw", *CH2))


BY_BLOCK = f"WITH {W.V1} SELECT CAST(y // 20 AS INT) AS block_id, count(*) AS voxels, count(DISTINCT frag) AS labels FROM v1 GROUP BY 1"


@query("b15_process_new_blocks", BY_BLOCK)
def b15(spark, d):
    """Blocks that arrive as files; the second run finds nothing new."""
    at = f"{shared_folder(spark)}/blocks-{spark.sparkContext._jvm.System.nanoTime()}"
    p = W.plane(spark, d).select(F.floor(F.col("y") / 20).cast("int").alias("block_id"), "z", "y", "x", F.col("frag").alias("label"))
    p.repartition("block_id").write.parquet(f"{at}/in")
    for _ in range(2):
        B.process_new_blocks(spark, f"{at}/in", p.schema, f"{at}/out", f"{at}/log", B.block_summary)
    return spark.read.parquet(f"{at}/out").select(F.col("block_id").cast("int").alias("block_id"), "voxels", "labels")


@query("a5_write_volume", f"WITH {W.V1} SELECT y, x, frag FROM v1")
def a5(spark, d):
    """Owned voxels written by block and read back."""
    at = f"{shared_folder(spark)}/volume-{spark.sparkContext._jvm.System.nanoTime()}"
    p = R.halo_blocks(W.plane(spark, d).select("z", "y", "x", "frag"), (40, 50), (4, 5), ("y", "x")).drop("block_y", "block_x")
    VOL.write_volume(p, at, (1, 40, 50))
    return VOL.read_volume(spark, at).select("y", "x", "frag")


@query("a12_write_graph", f"WITH {W.GRAPH1} SELECT u, v, round(merge_score, 6) AS merge_score FROM e1 WHERE u IN (SELECT id FROM nodes WHERE center_y < 50)")
def a12(spark, d):
    """Nodes and owned edges written to a store, twice, and read back."""
    at = f"{shared_folder(spark)}/graph-{spark.sparkContext._jvm.System.nanoTime()}"
    store = RagStore(spark, at, "w")
    edges = W.plane_edges(spark, d).select("u", "v", "merge_score", F.lit(False).alias("agglomerated"))
    for _ in range(2):
        store.write_nodes(W.plane_nodes(spark, d))
        store.write_edges(edges, high=(None, 50, None))
    return RagStore(spark, at).edges().select("u", "v", *r6("merge_score"))


@query("a16_lut_store", f"WITH {W.V1}, {W.NODES1}, {W.THIRDS} SELECT fragment, segment FROM lut")
def a16(spark, d):
    at = f"{shared_folder(spark)}/lut-{spark.sparkContext._jvm.System.nanoTime()}"
    n = W.plane_nodes(spark, d)
    for t, k in (("0.2000", 3), ("0.4000", 7)):
        VOL.write_lut(W.thirds(n, k).withColumn("threshold", F.lit(t).cast("decimal(6,4)")), at, "test", "mean")
    return VOL.read_lut(spark, at, "test", "mean", "0.2")


@query("q_affinity_to_score", f"""WITH RECURSIVE {W.GRAPH1}, t(t) AS (VALUES {', '.join(f'({x})' for x in SWEEP)}), te AS (SELECT t, u AS a, v AS b FROM e1, t WHERE merge_score <= t UNION ALL SELECT t, v, u FROM e1, t WHERE merge_score <= t),
 reach AS (SELECT CAST(t AS DOUBLE) AS t, id AS root, id AS node FROM nodes, t UNION SELECT reach.t, reach.root, te.b FROM reach JOIN te ON reach.node = te.a AND reach.t = te.t),
 lut AS (SELECT t, node AS fragment, min(root) AS segment FROM reach GROUP BY 1, 2), j AS (SELECT t, gt AS a, segment AS b, count(*) AS n FROM v1 JOIN lut ON frag = fragment WHERE gt <> 0 GROUP BY 1, 2, 3),
 m AS (SELECT *, sum(n) OVER (PARTITION BY t, a) AS na, sum(n) OVER (PARTITION BY t, b) AS nb, sum(n) OVER (PARTITION BY t) AS total FROM j),
 sa AS (SELECT t, sum(s * s) AS q FROM (SELECT t, sum(n) s FROM j GROUP BY t, a) GROUP BY t), sb AS (SELECT t, sum(s * s) AS q FROM (SELECT t, sum(n) s FROM j GROUP BY t, b) GROUP BY t)
 SELECT t AS threshold, {VOI}, round(sum(n * n) / min(sa.q), 6) AS rand_split, round(sum(n * n) / min(sb.q), 6) AS rand_merge FROM m JOIN sa USING (t) JOIN sb USING (t) GROUP BY t""")
def flagship(spark, d):
    """Affinities to scores: edges, a sweep over thresholds, relabelled voxels and their Rand and VOI terms per threshold."""
    lut = G.segment_sweep(W.plane_nodes(spark, d), W.plane_edges(spark, d), SWEEP)
    both = EV.contingency(W.plane(spark, d), "gt", "frag", (0,))
    table = both.join(lut, F.col("b") == F.col("fragment")).groupBy("threshold", "a", F.col("segment").alias("s")).agg(F.sum("n").alias("n")).withColumnRenamed("s", "b")
    return EV.rand_voi(table, ["threshold"]).select(F.col("threshold").cast("double").alias("threshold"), *r6("voi_split", "voi_merge", "rand_split", "rand_merge"))
