"""Queries of sources, projections, joins and label statistics, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelspark.functions import roi as R
from voxelspark.operators import evaluate as EV
from voxelspark.operators import labels as L
from voxelspark.operators import rag as G
from voxelspark.operators import voxels as V
from voxelspark.plans import views as W
from voxelspark.sources import graph as S
from voxelspark.sources import volumes as VOL

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


def r6(*columns):
    return [F.round(F.col(c), 6).alias(c) for c in columns]


BOX = R.Roi((0, 2, 10), (1, 60, 70))
IN_BOX = "z >= 0 AND z < 1 AND y >= 2 AND y < 62 AND x >= 10 AND x < 80"


@query("a1_read_volume", f"WITH {W.V1} SELECT z, y, x, frag, raw FROM v1")
def a1(spark, d):
    return W.plane(spark, d).select("z", "y", "x", "frag", "raw")


@query("a2_crop_roi", f"WITH {W.V1} SELECT z, y, x, frag FROM v1 WHERE {IN_BOX}")
def a2(spark, d):
    return V.crop(W.plane(spark, d), BOX).select("z", "y", "x", "frag")


@query("a3_common_roi", f"""WITH {W.V1}, {W.V2} SELECT greatest(a.lz, b.lz) AS lo_z, least(a.hz, b.hz) AS hi_z, greatest(a.ly, b.ly) AS lo_y, least(a.hy, b.hy) AS hi_y,
 greatest(a.lx, b.lx) AS lo_x, least(a.hx, b.hx) AS hi_x FROM (SELECT min(z) lz, max(z) + 1 hz, min(y) ly, max(y) + 1 hy, min(x) lx, max(x) + 1 hx FROM v1) a,
 (SELECT min(z) lz, max(z) + 1 hz, min(y) ly, max(y) + 1 hy, min(x) lx, max(x) + 1 hx FROM v2) b""")
def a3(spark, d):
    return V.common_extent(W.plane(spark, d), W.block(spark, d))


@query("a4_read_dense", f"""WITH {W.V2}, grid AS (SELECT CAST(z AS INT) z, CAST(y AS INT) y, CAST(x AS INT) x FROM range(1, 4) a(z), (SELECT unnest(range(0, (SELECT max(y) + 1 FROM v2))) AS y), range(0, 125) c(x))
 SELECT grid.z, grid.y, grid.x, coalesce(label, 0) AS label FROM grid LEFT JOIN v2 USING (z, y, x)""")
def a4(spark, d):
    return V.dense(W.block(spark, d), R.Roi((1, 0, 0), (3, W.height(spark, d, "lineitem", "l_orderkey"), W.WIDTH)), "label", 0)


@query("a6_nodes_in_roi", f"WITH {W.V1}, {W.NODES1} SELECT id, center_z, round(center_y, 6) AS center_y, round(center_x, 6) AS center_x FROM nodes WHERE center_y >= 3 AND center_y < 40 AND center_x >= 20")
def a6(spark, d):
    return S.nodes_in(W.plane_nodes(spark, d), (None, 3, 20), (None, 40, None)).select("id", "center_z", *r6("center_y", "center_x"))


@query("a7_nodes_with_ids", f"WITH {W.V1}, {W.NODES1} SELECT id, round(center_y, 6) AS center_y, round(center_x, 6) AS center_x FROM nodes WHERE id IN (SELECT s_suppkey FROM supplier)")
def a7(spark, d):
    ids = W.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return S.nodes_with(W.plane_nodes(spark, d), ids).select("id", *r6("center_y", "center_x"))


@query("a8_edges_of_nodes", f"WITH {W.GRAPH1} SELECT u, v, n, round(merge_score, 6) AS merge_score FROM e1 WHERE u IN (SELECT id FROM nodes WHERE center_y < 20)")
def a8(spark, d):
    return S.edges_of(W.plane_edges(spark, d), S.nodes_in(W.plane_nodes(spark, d), high=(None, 20, None))).select("u", "v", "n", *r6("merge_score"))


@query("a9_sub_rag", f"""WITH {W.GRAPH1}, own AS (SELECT * FROM nodes WHERE center_y < 20), e AS (SELECT * FROM e1 WHERE u IN (SELECT id FROM own))
 SELECT id, round(center_y, 6) AS center_y FROM own UNION ALL SELECT DISTINCT v, NULL FROM e WHERE v NOT IN (SELECT id FROM own)""")
def a9(spark, d):
    nodes, _ = S.sub_rag(S.nodes_in(W.plane_nodes(spark, d), high=(None, 20, None)), W.plane_edges(spark, d))
    return nodes.select("id", *r6("center_y"))


@query("a10_num_nodes", f"WITH {W.V1}, {W.NODES1} SELECT count(*) AS num_nodes FROM nodes WHERE center_y < 20")
def a10(spark, d):
    return S.nodes_in(W.plane_nodes(spark, d), high=(None, 20, None)).agg(F.count(F.lit(1)).alias("num_nodes"))


@query("a11_has_edges", f"WITH {W.GRAPH1} SELECT count(*) > 0 AS has_edges FROM e1 WHERE u IN (SELECT id FROM nodes WHERE center_y < 20)")
def a11(spark, d):
    found = S.has_edges(S.nodes_in(W.plane_nodes(spark, d), high=(None, 20, None)), W.plane_edges(spark, d))
    return spark.range(1).select(F.lit(found).alias("has_edges"))


@query("a13_owned_edges", f"WITH {W.GRAPH1} SELECT u, v, round(merge_score, 6) AS merge_score FROM e1 WHERE u IN (SELECT id FROM nodes WHERE center_y >= 5 AND center_y < 50 AND center_x >= 10)")
def a13(spark, d):
    turned = W.plane_edges(spark, d).select(F.col("v").alias("u"), F.col("u").alias("v"), "merge_score")
    return S.owned_edges(turned, W.plane_nodes(spark, d), (None, 5, 10), (None, 50, None)).select("u", "v", *r6("merge_score"))


@query("a15_unique_keys", "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def a15(spark, d):
    return S.repeated_keys(W.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a17_upsert_scores", """SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM customer
 UNION ALL SELECT s_suppkey + 10000000, 'new' FROM supplier""")
def a17(spark, d):
    old = W.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    new = old.where("k % 3 = 0").select("k", F.lit("new").alias("v")).unionByName(W.table(spark, d, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("k"), F.lit("new").alias("v")))
    return S.upsert(old, new, ["k"])


@query("a18_read_skeletons", f"""WITH {W.SITES}, {W.BONES}, own AS (SELECT * FROM sites WHERE masked AND y >= 1 AND y < 60)
 SELECT source, target, round(length, 6) AS length FROM bones WHERE source IN (SELECT id FROM own) AND target IN (SELECT id FROM own)""")
def a18(spark, d):
    s = W.sites(spark, d)
    box = R.Roi((0, 1, 0), (1, 59, W.WIDTH))
    _, bones = VOL.read_skeletons(s.select("id", "z", "y", "x"), s.select("id", "masked"), s.select("id", "component_id"), W.bones(spark, d), box)
    return bones.select("source", "target", *r6("length"))


@query("a19_synaptic_sites", f"WITH {W.BONES} SELECT source AS id FROM bones UNION SELECT target FROM bones")
def a19(spark, d):
    return VOL.synaptic_sites(W.bones(spark, d))


@query("a20_lookup", f"WITH {W.V1}, {W.NODES1} SELECT DISTINCT frag AS id FROM v1 WHERE gt % 5 = 1")
def a20(spark, d):
    return W.plane(spark, d).where("gt % 5 = 1").select(F.col("frag").alias("id")).distinct()


@query("a20_sample", f"WITH {W.V1}, {W.NODES1} SELECT id, center_z, round(center_y, 6) AS center_y, round(center_x, 6) AS center_x FROM nodes ORDER BY md5(concat_ws(':', id, '7')), id LIMIT 50")
def a20_sample(spark, d):
    return VOL.sample_rows(W.plane_nodes(spark, d), 50, "id", 7).select("id", "center_z", *r6("center_y", "center_x"))


@query("a21_open_blocks", f"""WITH {W.V1} SELECT DISTINCT y // 10 AS block_id FROM v1 WHERE y // 10 NOT IN (SELECT n_nationkey FROM nation)""")
def a21(spark, d):
    blocks = W.plane(spark, d).select(F.floor(F.col("y") / 10).cast("int").alias("block_id")).distinct()
    return VOL.open_blocks(blocks, W.table(spark, d, "nation").select(F.col("n_nationkey").alias("block_id")))


@query("b1_voxel_world", f"WITH {W.V1} SELECT y, x, 100 + 8 * CAST(y AS BIGINT) AS wy, 40 + 4 * CAST(x AS BIGINT) AS wx, CAST(y AS BIGINT) AS by, CAST(x AS BIGINT) AS bx FROM v1")
def b1(spark, d):
    p = W.plane(spark, d).select("y", "x", R.world(F.col("y").cast("long"), 100, 8).alias("wy"), R.world(F.col("x").cast("long"), 40, 4).alias("wx"))
    return p.withColumns({"by": R.voxel(F.col("wy") + 7, 100, 8), "bx": R.voxel(F.col("wx") + 3, 40, 4)})


@query("b2_scale_affinity", "SELECT o_orderkey, round((o_orderkey % 256) / 255.0, 6) AS aff FROM orders")
def b2(spark, d):
    return W.table(spark, d, "orders").select("o_orderkey", F.round(V.affinity_from_bytes(F.col("o_orderkey") % 256), 6).alias("aff"))


@query("b3_scale_shift", "SELECT l_orderkey, l_linenumber, round(l_discount * 2 - 1, 6) AS scaled, CAST(floor(CAST(l_discount AS DOUBLE) * 255 + 1e-9) AS INT) AS byte FROM lineitem")
def b3(spark, d):
    return W.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(V.scaled(F.col("l_discount"), 2, -1), 6).alias("scaled"), V.to_byte(F.col("l_discount") + 1e-9 / 255).alias("byte"))


@query("b4_minmax_normalize", "WITH m AS (SELECT l_returnflag, min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_returnflag, round((l_extendedprice - lo) / (hi - lo), 6) AS normalized FROM lineitem JOIN m USING (l_returnflag)")
def b4(spark, d):
    return V.minmax(W.table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "l_returnflag", *r6("normalized"))


@query("b5_apply_mask", f"WITH {W.V1} SELECT z, y, x, CASE WHEN gt > 0 AND x < 100 THEN frag ELSE 0 END AS frag FROM v1")
def b5(spark, d):
    p = W.plane(spark, d)
    mask = p.where("x < 100").select("z", "y", "x", (F.col("gt") > 0).alias("masked"))
    return V.masked(p.select("z", "y", "x", "frag"), "frag", mask).select("z", "y", "x", "frag")


@query("b6_upsample_to", f"WITH {W.V1}, c AS (SELECT y // 10 AS cy, x // 10 AS cx, min(gt) AS coarse FROM v1 WHERE y % 10 = 0 AND x % 10 = 0 GROUP BY 1, 2) SELECT z, y, x, coarse FROM v1 LEFT JOIN c ON y // 10 = cy AND x // 10 = cx")
def b6(spark, d):
    p = W.plane(spark, d)
    coarse = V.downsampled(p.select("z", "y", "x", F.col("gt").alias("coarse")), (1, 10, 10))
    return V.upsampled(p.select("z", "y", "x"), coarse, "coarse", (1, 10, 10)).select("z", "y", "x", "coarse")


@query("b7_downsample_nn", f"WITH {W.V1} SELECT z, CAST(y // 3 AS INT) AS y, CAST(x // 3 AS INT) AS x, frag FROM v1 WHERE y % 3 = 0 AND x % 3 = 0")
def b7(spark, d):
    return V.downsampled(W.plane(spark, d), (1, 3, 3)).select("z", "y", "x", "frag")


@query("b8_upsample_repeat", f"""WITH {W.V1} SELECT 0 AS z, CAST(y * 2 + i AS INT) AS y, CAST(x * 3 + j AS INT) AS x, frag FROM v1, range(0, 2) a(i), range(0, 3) b(j)""")
def b8(spark, d):
    return V.repeated(W.plane(spark, d), R.Roi((0, 0, 0), (1, 2 * W.height(spark, d), 3 * W.WIDTH)), (1, 2, 3), "frag")


@query("b9_mask_ids", f"WITH {W.V1} SELECT z, y, x, CASE WHEN frag IN (1, 5, 9, 27) THEN 0 ELSE frag END AS masked_out, CASE WHEN frag IN (1, 5, 9, 27) THEN frag ELSE 0 END AS kept FROM v1")
def b9(spark, d):
    p = W.plane(spark, d).withColumn("kept", F.col("frag"))
    return V.without_ids(V.without_ids(p, "frag", [1, 5, 9, 27]), "kept", [1, 5, 9, 27], keep=True).select("z", "y", "x", F.col("frag").alias("masked_out"), "kept")


@query("b10_label_masks", f"WITH {W.V1} SELECT y, x, CAST(gt > 0 AS INT) AS foreground, 1 AS all_ones, CAST(gt = 0 AS INT) AS complement FROM v1")
def b10(spark, d):
    return W.plane(spark, d).select("y", "x", *(c.alias(n) for n, c in V.label_masks(F.col("gt")).items()))


@query("b11_drop_sections", f"WITH {W.V2} SELECT z, y, x, CASE WHEN z IN (2, 5) THEN 0 ELSE label END AS label FROM v2")
def b11(spark, d):
    return V.without_sections(W.block(spark, d), "label", [2, 5]).select("z", "y", "x", "label")


@query("b12_select_components", "SELECT l_orderkey, l_linenumber, l_quantity AS c0, l_tax AS c2 FROM lineitem")
def b12(spark, d):
    names = ["l_quantity", "l_discount", "l_tax"]
    return W.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.col(names[k]).alias(f"c{k}") for k in V.component_channels("02", 3)))


@query("b13_threshold_markers", "SELECT o_orderkey, CASE WHEN o_orderkey % 256 < 30 THEN 1 WHEN o_orderkey % 256 > 150 THEN 2 ELSE 0 END AS marker FROM orders")
def b13(spark, d):
    return W.table(spark, d, "orders").select("o_orderkey", V.markers(F.col("o_orderkey") % 256).alias("marker"))


@query("b16_halo_blocks", f"""WITH {W.V1}
 SELECT y, x, CAST(block_y AS INT) AS block_y, CAST(block_x AS INT) AS block_x, y // 40 = block_y AND x // 50 = block_x AS owned
 FROM (SELECT y, x, block_y, unnest(range(CAST(floor((x - 5) / 50.0) AS BIGINT), (x + 5) // 50 + 1)) AS block_x FROM
 (SELECT y, x, unnest(range(CAST(floor((y - 4) / 40.0) AS BIGINT), (y + 4) // 40 + 1)) AS block_y FROM v1))""")
def b16(spark, d):
    return R.halo_blocks(W.plane(spark, d).select("y", "x"), (40, 50), (4, 5), ("y", "x")).select("y", "x", "block_y", "block_x", "owned")


@query("b17_roi_algebra", """WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, l_orderkey % 97 AS lo, l_orderkey % 97 + l_linenumber * 5 AS hi, 20 AS lo2, 60 AS hi2 FROM lineitem)
 SELECT k, n, lo - 3 AS grow_lo, hi + 4 AS grow_hi, greatest(lo, lo2) AS cut_lo, greatest(greatest(lo, lo2), least(hi, hi2)) AS cut_hi, least(lo, lo2) AS both_lo, greatest(hi, hi2) AS both_hi,
 CAST(floor(lo / 8.0) * 8 AS BIGINT) AS snap_lo, CAST(ceil(hi / 8.0) * 8 AS BIGINT) AS snap_hi, CAST(ceil(lo / 8.0) * 8 AS BIGINT) AS shrink_lo, CAST(floor(hi / 8.0) * 8 AS BIGINT) AS shrink_hi FROM b""")
def b17(spark, d):
    b = W.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_orderkey") % 97).alias("lo"), (F.col("l_orderkey") % 97 + F.col("l_linenumber") * 5).alias("hi"))
    lo, hi, lo2, hi2 = F.col("lo"), F.col("hi"), F.lit(20).cast("long"), F.lit(60).cast("long")
    pairs = {"grow": R.box_grow(lo, hi, 3, 4), "cut": R.box_intersect(lo, hi, lo2, hi2), "both": R.box_union(lo, hi, lo2, hi2), "snap": R.box_snap(lo, hi, 8), "shrink": R.box_snap(lo, hi, 8, "shrink")}
    return b.select("k", "n", *(c.alias(f"{name}_{end}") for name, pair in pairs.items() for end, c in zip(("lo", "hi"), pair, strict=True)))


@query("b18_threshold_list", "SELECT l_quantity AS quantity, CAST(i AS DOUBLE) / 50 AS threshold, count(*) AS n FROM lineitem, range(0, 50) t(i) WHERE l_discount * 10 >= CAST(i AS DOUBLE) / 50 GROUP BY 1, 2")
def b18(spark, d):
    cuts = F.broadcast(R.thresholds(spark, 0.0, 1.0, 0.02).select(F.col("threshold").cast("double")))  # 50 rows
    per = W.table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("quantity"), "l_discount").agg(F.count(F.lit(1)).alias("n"))
    return per.join(cuts, F.col("l_discount") * 10 >= F.col("threshold")).groupBy("quantity", "threshold").agg(F.sum("n").alias("n"))


@query("b19_clip01", "SELECT o_orderkey, greatest(0.0, least(1.0, o_totalprice / 200000 - 0.5)) AS v FROM orders")
def b19(spark, d):
    return W.table(spark, d, "orders").select("o_orderkey", V.clip01(F.col("o_totalprice") / 200_000 - 0.5).alias("v"))


@query("b20_reorder_axes", f"WITH {W.V2} SELECT z, y, x, label FROM v2")
def b20(spark, d):
    return V.reordered(W.block(spark, d).select("x", "y", "z", "label"))


@query("c1_relabel", f"WITH {W.V1}, {W.NODES1}, {W.THIRDS} SELECT z, y, x, coalesce(CASE WHEN frag % 7 <> 0 THEN segment END, 0) AS zero, coalesce(CASE WHEN frag % 7 <> 0 THEN segment END, frag) AS keep FROM v1 LEFT JOIN lut ON frag = fragment")
def c1(spark, d):
    lut = W.thirds(W.plane_nodes(spark, d)).where("fragment % 7 <> 0")
    p = W.plane(spark, d).select("z", "y", "x", F.col("frag").alias("zero"), F.col("frag").alias("keep"))
    return G.relabel(G.relabel(p, lut, "zero"), lut, "keep", "keep").select("z", "y", "x", "zero", "keep")


@query("c2_site_fragment_lut", f"WITH {W.SKELETON} SELECT id, fragment FROM site_lut")
def c2(spark, d):
    return EV.site_fragments(W.sites(spark, d), W.plane(spark, d), label="frag")


@query("c2_background_sites", f"WITH {W.V1}, {W.SITES} SELECT count(*) AS sites, count(*) FILTER (WHERE coalesce(gt, 0) = 0) AS background FROM sites s LEFT JOIN v1 v ON s.y = v.y AND s.x = v.x")
def c2b(spark, d):
    return EV.background_sites(EV.site_fragments(W.sites(spark, d), W.plane(spark, d), label="gt"))


@query("c3_site_segment", f"WITH {W.SKELETON} SELECT id, segment FROM seg")
def c3(spark, d):
    return EV.site_segments(EV.site_fragments(W.sites(spark, d), W.plane(spark, d), label="frag"), W.thirds(W.plane_nodes(spark, d)))


@query("c4_neighbour_join", f"WITH {W.V1} SELECT a.y, a.x, 0 AS channel, a.frag, b.frag AS other FROM v1 a JOIN v1 b ON b.y = a.y - 1 AND b.x = a.x UNION ALL SELECT a.y, a.x, 1, a.frag, b.frag FROM v1 a JOIN v1 b ON b.y = a.y AND b.x = a.x - 1")
def c4(spark, d):
    return V.neighbours(W.plane(spark, d), ((0, -1, 0), (0, 0, -1)), "frag").select("y", "x", "channel", "frag", "other")


@query("c4_line_neighbour", f"WITH {W.V2} SELECT a.z, a.y, a.x, b.label AS before FROM v2 a LEFT JOIN v2 b ON b.z = a.z - 1 AND b.y = a.y AND b.x = a.x")
def c4_line(spark, d):
    return V.line_before(W.block(spark, d), "z", "label", "before").select("z", "y", "x", "before")


@query("c5_kernel_join", f"""WITH {W.V1}, k AS (SELECT dy, dx, CAST(1 AS DOUBLE) AS w FROM range(-3, 4) a(dy), range(-3, 4) b(dx) WHERE dy * dy + dx * dx <= 9)
 SELECT a.y, a.x, count(*) AS near, CAST(sum(dy) AS BIGINT) AS sy, CAST(sum(dx) AS BIGINT) AS sx FROM v1 a, k JOIN v1 b ON b.frag = a.frag AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2""")
def c5(spark, d):
    p = W.plane(spark, d).select(F.col("frag").alias("label"), "z", "y", "x")
    return V.kernel_join(p, p, V.ball((0, 3, 3))).groupBy("y", "x").agg(F.count(F.lit(1)).alias("near"), F.sum("dy").alias("sy"), F.sum("dx").alias("sx"))


@query("c6_semi_anti", f"WITH {W.SITES}, {W.BONES} SELECT id FROM sites WHERE id IN (SELECT source FROM bones) AND id NOT IN (SELECT target FROM bones)")
def c6(spark, d):
    b = W.bones(spark, d)
    return W.sites(spark, d).select("id").join(b.select(F.col("source").alias("id")), "id", "left_semi").join(b.select(F.col("target").alias("id")), "id", "left_anti")


@query("c7_endpoint_centers", f"WITH {W.GRAPH1} SELECT u, v, round(a.center_y, 6) AS u_y, round(b.center_x, 6) AS v_x FROM e1 JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v")
def c7(spark, d):
    return G.with_endpoints(W.plane_edges(spark, d), W.plane_nodes(spark, d)).select("u", "v", *r6("u_y", "v_x"))


@query("c9_points_in_boxes", f"WITH {W.SITES} SELECT y // 16 AS block, count(*) AS n FROM sites WHERE x >= 8 AND x < 104 GROUP BY 1")
def c9(spark, d):
    s = V.crop(W.sites(spark, d), R.Roi((0, 0, 8), (1, W.height(spark, d, "events", "event_id"), 96)))
    return s.groupBy(F.floor(F.col("y") / 16).cast("int").alias("block")).agg(F.count(F.lit(1)).alias("n"))


@query("d1_fragment_centers", f"WITH {W.V2} SELECT label AS id, round(100 + 8 * avg(z), 6) AS center_z, round(4 * avg(y), 6) AS center_y, round(4 * avg(x), 6) AS center_x FROM v2 WHERE label <> 0 GROUP BY 1")
def d1(spark, d):
    return L.centers(W.block(spark, d), offset=(100, 0, 0), voxel_size=(8, 4, 4)).select("id", *r6("center_z", "center_y", "center_x"))


@query("d2_bounding_box", f"WITH {W.V2} SELECT label AS id, min(z) AS min_z, max(z) AS max_z, min(y) AS min_y, max(y) AS max_y, min(x) AS min_x, max(x) AS max_x FROM v2 WHERE label <> 0 GROUP BY 1")
def d2(spark, d):
    return L.bounding_boxes(W.block(spark, d))


@query("d3_filter_fragments", f"WITH {W.V1}, m AS (SELECT frag, avg(raw) AS mean FROM v1 GROUP BY 1) SELECT z, y, x, CASE WHEN mean < 230000 THEN 0 ELSE frag END AS frag FROM v1 JOIN m USING (frag)")
def d3(spark, d):
    return L.filter_fragments(W.plane(spark, d), "raw", 230_000, "frag").select("z", "y", "x", "frag")


@query("d4_unique_labels", f"WITH {W.V1} SELECT DISTINCT gt AS id FROM v1")
def d4(spark, d):
    return L.unique_labels(W.plane(spark, d), "gt")


@query("d5_remove_small", f"WITH {W.V1}, s AS (SELECT gt, count(*) AS n FROM v1 GROUP BY 1) SELECT z, y, x, CASE WHEN gt <> 0 AND n < 95 THEN 0 ELSE gt END AS gt FROM v1 JOIN s USING (gt)")
def d5(spark, d):
    return L.without_small(W.plane(spark, d), 95, "gt").select("z", "y", "x", "gt")


PARTS = """p AS (SELECT y, x, gt, y * 125 + x AS id FROM v1 WHERE raw > 150000 AND gt <> 0), pe AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON a.gt = b.gt AND ((a.y = b.y + 1 AND a.x = b.x) OR (a.y = b.y AND a.x = b.x + 1)))"""


@query("d5_remove_small_parts", f"WITH RECURSIVE {W.V1}, {PARTS}, {W.roots_sql('SELECT u, v FROM pe', 'SELECT id FROM p')}, big AS (SELECT root FROM comp GROUP BY 1 HAVING count(*) >= 5) SELECT v1.y, v1.x, CASE WHEN root IN (SELECT root FROM big) THEN v1.gt ELSE 0 END AS gt FROM v1 LEFT JOIN comp ON node = y * 125 + x")
def d5p(spark, d):
    p = W.plane(spark, d).select("z", "y", "x", F.when(F.col("raw") > 150_000, F.col("gt")).otherwise(F.lit(0)).cast("long").alias("gt"))
    return L.without_small_parts(p, 5, (1, W.height(spark, d), W.WIDTH), "gt").select("y", "x", "gt")


HOLES = """p AS (SELECT y * 125 + x AS id, y, x FROM v1 WHERE NOT raw > 150000), pe AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON (a.y = b.y + 1 AND a.x = b.x) OR (a.y = b.y AND a.x = b.x + 1))"""


@query("d5_remove_small_holes", f"WITH RECURSIVE {W.V1}, {HOLES}, {W.roots_sql('SELECT u, v FROM pe', 'SELECT id FROM p')}, small AS (SELECT root FROM comp GROUP BY 1 HAVING count(*) < 4) SELECT v1.y, v1.x, raw > 150000 OR coalesce(root IN (SELECT root FROM small), false) AS masked FROM v1 LEFT JOIN comp ON node = y * 125 + x")
def d5h(spark, d):
    p = W.plane(spark, d).select("z", "y", "x", (F.col("raw") > 150_000).alias("masked"))
    return L.without_small_holes(p, 4, (1, W.height(spark, d), W.WIDTH)).select("y", "x", "masked")


@query("d5_label_sizes", f"WITH {W.V1} SELECT gt AS id, count(*) AS size FROM v1 GROUP BY 1")
def d5s(spark, d):
    return L.label_sizes(W.plane(spark, d), "gt")


@query("d19_renumber", f"WITH {W.V2} SELECT label AS id, CAST(dense_rank() OVER (ORDER BY label) AS BIGINT) AS number FROM (SELECT DISTINCT label FROM v2 WHERE label <> 0)")
def d19(spark, d):
    return L.renumbered(W.block(spark, d))[1]


@query("d20_block_unique_ids", f"WITH {W.V1} SELECT y, x, CASE WHEN gt > 0 THEN gt + y // 10 * 100000 ELSE gt END AS gt FROM v1")
def d20(spark, d):
    return W.plane(spark, d).select("y", "x", L.block_unique(F.col("gt"), F.floor(F.col("y") / 10), 100_000).alias("gt"))


@query("e2_max_filter", f"WITH {W.V1} SELECT a.y, a.x, max(b.raw) AS highest FROM v1 a, range(-2, 2) s(dy), range(-2, 2) t(dx) JOIN v1 b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2")
def e2(spark, d):
    from voxelspark.operators.fragments import max_filter

    return max_filter(W.plane(spark, d), "raw", 4, ("y", "x")).select("y", "x", "highest")


@query("e3_latest_per_key", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def e3(spark, d):
    return G.latest(W.table(spark, d, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


@query("e4_component_numbering", f"WITH {W.V1}, {W.NODES1}, {W.THIRDS} SELECT segment, CAST(dense_rank() OVER (ORDER BY segment) AS BIGINT) AS number FROM (SELECT DISTINCT segment FROM lut)")
def e4(spark, d):
    return G.numbered(W.thirds(W.plane_nodes(spark, d)))


@query("e6_concat_distinct", f"WITH {W.GRAPH1} SELECT u AS id FROM e1 UNION SELECT v FROM e1")
def e6(spark, d):
    e = W.plane_edges(spark, d)
    return e.select(F.col("u").alias("id")).unionByName(e.select(F.col("v").alias("id"))).distinct()
