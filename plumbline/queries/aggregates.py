"""Robust aggregates over the known room and the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import intervals95 as E
from ..operators import robust, windows
from ..plans.known_room import POINTS_SQL, points_mm
from . import query, table

P = f"WITH {POINTS_SQL}"


@query(
    P + """, up AS (SELECT h_mm FROM points WHERE nh = 1), m0 AS (SELECT min(h_mm) AS lo, max(h_mm) AS hi FROM up),
b AS (SELECT least(floor((h_mm - lo) / 10.0), greatest(ceil((hi - lo) / 10.0), 1) - 1) AS bin, count(*) AS n FROM up, m0 GROUP BY 1),
pk AS (SELECT lo + (bin + 0.5) * 10 AS mode FROM b, m0 ORDER BY n DESC, bin LIMIT 1),
fl AS (SELECT avg(h_mm::DOUBLE) AS f FROM up, pk WHERE abs(h_mm - mode) < 30),
dn AS (SELECT h_mm FROM points, fl WHERE nh = -1 AND h_mm > f + 1800), m1 AS (SELECT min(h_mm) AS lo, max(h_mm) AS hi FROM dn),
b1 AS (SELECT least(floor((h_mm - lo) / 10.0), greatest(ceil((hi - lo) / 10.0), 1) - 1) AS bin, count(*) AS n FROM dn, m1 GROUP BY 1),
pk1 AS (SELECT lo + (bin + 0.5) * 10 AS mode FROM b1, m1 ORDER BY n DESC, bin LIMIT 1),
ce AS (SELECT avg(h_mm::DOUBLE) AS c FROM dn, pk1 WHERE abs(h_mm - mode) < 30)
SELECT round((SELECT f FROM fl), 6) AS floor_mm, round(CASE WHEN (SELECT count(*) FROM dn) >= 500 THEN (SELECT c FROM ce) END, 6) AS ceiling_mm, (SELECT count(*) FROM dn) AS ceiling_n"""
)
def floor_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points_mm(spark, sf_dir)
    d = robust.floor_and_ceiling(p, "h_mm", "nh", width=10, reach=30, rise=1800, least=500)
    return d.select(F.round("floor", 6).alias("floor_mm"), F.round("ceiling", 6).alias("ceiling_mm"), "ceiling_n")


@query(
    P + """, w AS (SELECT nu, nv, CASE WHEN nu <> 0 THEN u_mm ELSE v_mm END AS x FROM points WHERE nu <> 0 OR nv <> 0),
e AS (SELECT nu, nv, min(x) AS lo, max(x) AS hi FROM w GROUP BY ALL),
b AS (SELECT nu, nv, least(floor((x - lo) / 10.0), greatest(ceil((hi - lo) / 10.0), 1) - 1) AS bin, lo, count(*) AS n FROM w JOIN e USING (nu, nv) GROUP BY ALL)
SELECT nu, nv, lo + (bin + 0.5) * 10 AS mode, n FROM b QUALIFY row_number() OVER (PARTITION BY nu, nv ORDER BY n DESC, bin) = 1"""
)
def wall_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points_mm(spark, sf_dir).filter("nu <> 0 or nv <> 0").withColumn("x", F.when(F.col("nu") != 0, F.col("u_mm")).otherwise(F.col("v_mm")))
    return robust.histogram_mode(p, "x", 10.0, ["nu", "nv"])


@query(
    """WITH d AS (SELECT l_returnflag AS k, ((4 * atan2((l_partkey % 51 - 25)::DOUBLE, l_quantity - 25)) % (2 * pi()) + 2 * pi()) % (2 * pi()) AS a FROM lineitem WHERE l_quantity <> 25 OR l_partkey % 51 <> 25),
h AS (SELECT k, (floor(a / (2 * pi() / 720))::BIGINT) % 720 AS bin, count(*) AS n FROM d GROUP BY ALL),
g AS (SELECT o, exp(-0.5 * (o / 3.0) * (o / 3.0)) AS w FROM range(-12, 13) t(o)), gs AS (SELECT o, w / (SELECT sum(w) FROM g) AS w FROM g),
s AS (SELECT k, ((bin + o) % 720 + 720) % 720 AS bin, sum(n * w) AS s FROM h, gs GROUP BY ALL),
p AS (SELECT k, (bin + 1) * (2 * pi() / 720) AS peak FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(s, 9) DESC, bin) = 1)
SELECT k, round(atan2(avg(sin(a)), avg(cos(a))) / 4, 9) AS yaw FROM d JOIN p USING (k) WHERE abs(atan2(sin(a - peak), cos(a - peak))) < 0.15 GROUP BY k"""
)
def yaw_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_quantity") - 25).alias("dx"), (F.col("l_partkey") % 51 - 25).cast("double").alias("dz"))
    return robust.manhattan_yaw(d, "dx", "dz", ["k"]).select("k", F.round("yaw", 9).alias("yaw"))


@query(
    P + """ SELECT frame_id, u_mm, v_mm, h_mm, range_mm, l_orderkey, l_linenumber, l_partkey FROM points
QUALIFY row_number() OVER (PARTITION BY floor(u_mm / 20), floor(v_mm / 20), floor(h_mm / 20) ORDER BY range_mm, frame_id, l_orderkey, l_linenumber, l_partkey, u_mm, v_mm, h_mm) = 1"""
)
def voxel_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points_mm(spark, sf_dir).select("frame_id", "u_mm", "v_mm", "h_mm", "range_mm", "l_orderkey", "l_linenumber", "l_partkey")
    return robust.voxel_nearest(p, ["u_mm", "v_mm", "h_mm"], 20, ["range_mm", "frame_id", "l_orderkey", "l_linenumber", "l_partkey", "u_mm", "v_mm", "h_mm"])


@query(P + " SELECT s, round(quantile_cont(h_mm::DOUBLE, 0.03), 6) AS p3, round(quantile_cont(h_mm::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(h_mm::DOUBLE, 0.97), 6) AS p97 FROM points WHERE nh = 0 AND h_mm > 100 GROUP BY s")
def height_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = robust.percentiles(points_mm(spark, sf_dir).filter("nh = 0 and h_mm > 100"), "h_mm", [0.03, 0.5, 0.97], ["s"])
    return d.select("s", *[F.round(c, 6).alias(c) for c in ("p3", "p50", "p97")])


@query(
    P + """, w AS (SELECT nu, nv, CASE WHEN nu <> 0 THEN u_mm ELSE v_mm END AS x FROM points WHERE nu <> 0 OR nv <> 0), b AS (SELECT *, floor(x / 500)::BIGINT AS bin FROM w),
m AS (SELECT nu, nv, bin, median(x) AS med FROM b GROUP BY ALL)
SELECT nu, nv, bin, med AS median, round(avg(x::DOUBLE), 6) AS mean, round(stddev_pop(x::DOUBLE), 6) AS std, count(*) AS n FROM b JOIN m USING (nu, nv, bin) WHERE abs(x - med) < 30 GROUP BY ALL"""
)
def wall_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points_mm(spark, sf_dir).filter("nu <> 0 or nv <> 0").withColumn("x", F.when(F.col("nu") != 0, F.col("u_mm")).otherwise(F.col("v_mm"))).withColumn("bin", F.floor(F.col("x") / 500))
    d = robust.inlier_stats(p, "x", 30, ["nu", "nv", "bin"])
    return d.select("nu", "nv", "bin", "median", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(P + " SELECT s, floor(u_mm / 50)::BIGINT AS r, floor(v_mm / 50)::BIGINT AS c, count(DISTINCT least(floor((h_mm - 200) / 150.0), 14)) / 15.0::DOUBLE AS coverage FROM points WHERE s IN (2, 3, 6) AND h_mm > 200 AND h_mm < 2400 GROUP BY ALL")
def height_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points_mm(spark, sf_dir).filter("s in (2, 3, 6)").withColumns({"r": F.floor(F.col("u_mm") / 50), "c": F.floor(F.col("v_mm") / 50)})
    return robust.height_coverage(p, ["s", "r", "c"], F.col("h_mm"), 200, 2400, 150)


@query(
    """WITH r AS (SELECT l_suppkey % 20 AS capture, l_partkey % 40 AS view, l_extendedprice / (900 + l_quantity * 1000) AS ratio FROM lineitem), v AS (SELECT capture, view, median(ratio) AS m, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 3)
SELECT capture, round(median(m), 9) AS scale, round(quantile_cont(m, 0.16), 9) AS p16, round(quantile_cont(m, 0.84), 9) AS p84, round(sqrt(quantile_cont(m, 0.84) / quantile_cont(m, 0.16)) - 1, 9) AS spread, count(*) AS views FROM v GROUP BY capture"""
)
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("capture"), (F.col("l_partkey") % 40).alias("view"), (F.col("l_extendedprice") / (900 + F.col("l_quantity") * 1000)).alias("ratio"))
    d = robust.robust_scale(r, "ratio", "view", ["capture"], least=3)
    return d.select("capture", *[F.round(c, 9).alias(c) for c in ("scale", "p16", "p84", "spread")], "views")


@query(
    """WITH d AS (SELECT l_suppkey AS view, l_extendedprice AS conf, l_orderkey, l_linenumber, l_partkey FROM lineitem), q AS (SELECT view, quantile_cont(conf, 0.15) AS a, quantile_cont(conf, 0.4) AS b, count(*) AS n FROM d GROUP BY view)
SELECT d.view, CASE WHEN n < 30 THEN 0 WHEN conf < a THEN 0 WHEN conf < b THEN 1 ELSE 2 END AS level, count(*) AS n FROM d JOIN q USING (view) GROUP BY ALL"""
)
def confidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("view"), F.col("l_extendedprice").alias("conf"))
    return robust.confidence_levels(d, "conf", "view", least=30).groupBy("view", "level").agg(F.count("*").alias("n"))


@query(
    """WITH h AS (SELECT l_returnflag AS k, l_quantity::BIGINT - 1 AS bin, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT k, o AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT k FROM h) x CROSS JOIN range(0, 50) t(o) LEFT JOIN h USING (k) WHERE h.bin = o OR h.bin IS NULL),
g AS (SELECT o, exp(-0.5 * (o / 1.2) * (o / 1.2)) AS w FROM range(-5, 6) t(o)), gs AS (SELECT o, w / (SELECT sum(w) FROM g) AS w FROM g),
t AS (SELECT k, bin, o, w, CASE WHEN bin + o < 0 THEN -1 - (bin + o) WHEN bin + o >= 50 THEN 99 - (bin + o) ELSE bin + o END AS src FROM (SELECT DISTINCT k, x AS bin FROM h, range(0, 50) r(x)), gs)
SELECT t.k, t.bin, round(sum(coalesce(h.n, 0) * w), 6) AS s FROM t LEFT JOIN h ON h.k = t.k AND h.bin = t.src GROUP BY ALL HAVING sum(coalesce(h.n, 0)) > 0"""
)
def smoothed_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k"), (F.col("l_quantity").cast("long") - 1).alias("bin")).agg(F.count("*").alias("n"))
    return robust.smoothed(h, 50, 1.2, ["k"]).select("k", F.col("bin").cast("long").alias("bin"), F.round("s", 6).alias("s"))


@query(
    """WITH h AS (SELECT l_returnflag AS k, l_quantity::BIGINT AS bin, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL)
SELECT k, bin, n FROM h QUALIFY n > max(n) OVER (PARTITION BY k ORDER BY bin RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) - 1e-9 AND n > 30"""
)
def quantity_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k"), F.col("l_quantity").cast("long").alias("bin")).agg(F.count("*").cast("double").alias("n"))
    return robust.local_peaks(h, "bin", "n", ["k"])


@query(
    P + """, w AS (SELECT 'u' AS axis, u_mm / 1000.0::DOUBLE AS x FROM points WHERE nu <> 0 UNION ALL SELECT 'v', v_mm / 1000.0::DOUBLE FROM points WHERE nv <> 0),
e AS (SELECT axis, min(x) AS lo, greatest(ceil((max(x) - min(x)) / 0.01), 1)::BIGINT - 1 AS last FROM w GROUP BY axis),
h AS (SELECT axis, least(floor((x - lo) / 0.01), last)::BIGINT AS bin, count(*) AS n FROM w JOIN e USING (axis) GROUP BY ALL),
dn AS (SELECT e.axis, b.bin, lo, coalesce(n, 0) AS n FROM e, LATERAL (SELECT unnest(range(0, last + 1)) AS bin) b LEFT JOIN h ON h.axis = e.axis AND h.bin = b.bin),
p AS (SELECT axis, quantile_cont(n::DOUBLE, 0.99) AS p FROM dn GROUP BY axis), pk AS (SELECT axis, lo + (bin + 0.5) * 0.01 AS c FROM dn JOIN p USING (axis) WHERE n > p),
dd AS (SELECT w.axis, x, min(abs(x - c)) AS d FROM w JOIN pk USING (axis) GROUP BY w.axis, x), c AS (SELECT w.axis, median(d) AS m FROM w JOIN dd ON dd.axis = w.axis AND dd.x = w.x WHERE d < 0.1 GROUP BY w.axis)
SELECT round(avg(m), 6) AS crispness FROM c"""
)
def crispness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points_mm(spark, sf_dir)
    w = p.filter("nu <> 0").select(F.lit("u").alias("axis"), (F.col("u_mm") / 1000.0).alias("x")).unionByName(p.filter("nv <> 0").select(F.lit("v").alias("axis"), (F.col("v_mm") / 1000.0).alias("x")))
    return robust.crispness(w, "x", "axis").select(F.round("crispness", 6).alias("crispness"))


@query(
    """SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, rn::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn <= 3"""
)
def topk_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
    return windows.top_k(d, ["l_partkey"], [F.desc("l_extendedprice"), F.desc("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_quantity")], 3, "rank").drop("l_quantity")


@query("SELECT l_suppkey, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS l_orderkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_suppkey")
def best_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.top_by(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_extendedprice"], [F.col("l_extendedprice"), F.col("l_orderkey")])


@query(
    """SELECT l_suppkey, round(1.96 * sqrt(lo * lo + hi * hi + (0.002 * len) * (0.002 * len)), 9) AS length_ci, round(hypot_, 9) AS sigma FROM (
SELECT l_suppkey, avg(l_quantity) AS len, sqrt(pow(3 * stddev_pop(l_discount) / sqrt(count(*)), 2) + 0.006 * 0.006) AS lo, sqrt(pow(3 * stddev_pop(l_tax) / sqrt(count(*)), 2) + 0.006 * 0.006) AS hi, sqrt(pow(3 * stddev_pop(l_tax) / sqrt(count(*)), 2) + 0.004 * 0.004) AS hypot_ FROM lineitem GROUP BY l_suppkey)"""
)
def length_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("len"), F.stddev_pop("l_discount").alias("a"), F.stddev_pop("l_tax").alias("b"), F.count("*").alias("n"))
    ci = E.length_ci(F.col("len"), E.face_sigma(F.col("a"), F.col("n")), E.face_sigma(F.col("b"), F.col("n")))
    return g.select("l_suppkey", F.round(ci, 9).alias("length_ci"), F.round(E.floor_sigma(F.col("b"), F.col("n")), 9).alias("sigma"))


@query(
    """WITH u AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) GROUP BY ALL), w AS (SELECT label, list(v ORDER BY i) AS w FROM u GROUP BY label),
l AS (SELECT vec_id, w.label AS k, list_sum(list_transform(range(1, 65), lambda j: embedding[j]::DOUBLE * w.w[j])) * 8 AS z FROM embeddings, w),
s AS (SELECT vec_id, k, z, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM l)
SELECT vec_id, arg_max(k, (round(z, 9), -k))::INTEGER AS predicted, round(max(e / t), 6) AS p FROM (SELECT *, sum(e) OVER (PARTITION BY vec_id) AS t FROM s) GROUP BY vec_id"""
)
def probe_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear probe whose weights are the labels' centroids: ten rows, broadcast."""
    e = table(spark, sf_dir, "embeddings")
    u = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    w = u.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"] * 8).alias("w"))
    w = w.agg(F.transform(F.sort_array(F.collect_list(F.struct("label", "w"))), lambda x: x["w"]).alias("_w"), F.sort_array(F.collect_list("label")).alias("_k"))
    p = e.crossJoin(F.broadcast(w)).withColumn("_p", G.linear_probe(F.col("embedding"), F.col("_w"), F.transform("_k", lambda _: F.lit(0.0))))
    best = G.let(F.col("_p"), lambda x: F.struct(G.argmax(x).alias("i"), F.array_max(x).alias("p")))
    return p.select("vec_id", "_k", best.alias("_b")).select("vec_id", F.col("_k")[F.col("_b.i")].alias("predicted"), F.round("_b.p", 6).alias("p"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / n) * (x::DOUBLE / n)))), 9) AS norm, round(embedding[1]::DOUBLE / n, 6) AS first FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)")
def normalised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = G.l2_normalised(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(G.array_dot(v, v)), 9).alias("norm"), F.round(v[0], 6).alias("first"))


@query(
    """WITH p AS (SELECT list(embedding ORDER BY vec_id) AS p FROM embeddings WHERE vec_id < 6),
l AS (SELECT vec_id, list_transform(p, lambda q: 100 * list_sum(list_transform(range(1, 65), lambda j: embedding[j]::DOUBLE * q[j]::DOUBLE))) AS z FROM embeddings, p WHERE vec_id >= 6)
SELECT vec_id, round(list_sum(list_transform(z[1:2], lambda x: exp(x - list_max(z)))) / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 6) AS gate FROM l"""
)
def zero_shot_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six prompt vectors, broadcast."""
    e = table(spark, sf_dir, "embeddings")
    p = e.filter("vec_id < 6").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("_p"))
    return e.filter("vec_id >= 6").crossJoin(F.broadcast(p)).select("vec_id", F.round(G.zero_shot_gate(F.col("embedding"), F.col("_p"), 2), 6).alias("gate"))


@query(
    """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, count(*) AS n, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"""
)
def cube_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.count("*").alias("n"), F.grouping_id().alias("level"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(x, 6) AS x, round(y, 6) AS y, d AS z FROM (
SELECT *, (l_partkey % 256 - 128.0) * d / 210.0 AS x, (l_suppkey % 192 - 96.0) * d / 210.0 AS y FROM (SELECT *, l_quantity / 10 AS d FROM lineitem)) WHERE d > 0.15 AND d < 4"""
)
def back_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").withColumn("d", F.col("l_quantity") / 10).filter("d > 0.15 and d < 4")
    x, y, z = G.back_project(F.col("l_partkey") % 256, F.col("l_suppkey") % 192, F.col("d"), F.lit(210.0), F.lit(210.0), F.lit(128.0), F.lit(96.0))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), z.alias("z"))


@query(
    """WITH q AS (SELECT event_id, (event_id % 7 - 3)::DOUBLE AS x, (event_id % 5 - 2)::DOUBLE AS y, (event_id % 3 - 1)::DOUBLE AS z, (event_id % 11 + 1)::DOUBLE AS w FROM events), s AS (SELECT *, 2.0 / (x*x + y*y + z*z + w*w) AS s FROM q)
SELECT event_id, round((1 - s*(y*y + z*z)) * 1 + s*(x*y - z*w) * 2 + s*(x*z + y*w) * 3, 6) AS px, round(s*(x*y + z*w) * 1 + (1 - s*(x*x + z*z)) * 2 + s*(y*z - x*w) * 3, 6) AS py, round(s*(x*z - y*w) * 1 + s*(y*z + x*w) * 2 + (1 - s*(x*x + y*y)) * 3, 6) AS pz FROM s"""
)
def rotated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    q = [((F.col("event_id") % m) + o).cast("double") for m, o in ((7, -3), (5, -2), (3, -1), (11, 1))]
    p = G.to_world((F.lit(1.0), F.lit(2.0), F.lit(3.0)), G.quaternion_rotation(*q))
    return e.select("event_id", *[F.round(c, 6).alias(n) for c, n in zip(p, ("px", "py", "pz"), strict=True)])


@query(
    """SELECT o_orderkey, round(((d + 45) % 90 + 90) % 90 - 45, 6) AS snapped, round(o_totalprice / 2 / tan(0.6), 4) AS focal, round(2 * atan(o_totalprice / 2 / 1000), 9) AS fov, least(greatest(floor((o_totalprice - 1000) / 500), 0), 99)::BIGINT AS cell FROM (SELECT *, o_totalprice / 100 - 500 AS d FROM orders)"""
)
def scalar_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(G.snap_right_angle(p / 100 - 500), 6).alias("snapped"), F.round(G.focal_from_fov(p, F.lit(1.2)), 4).alias("focal"), F.round(G.fov_from_focal(p, F.lit(1000)), 9).alias("fov"), G.grid_index(p, 1000, 500, 100).alias("cell"))
