"""Spatial, band, interval, nearest and as-of joins; set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, revisits, spatial
from ..plans.known_room import POINTS_SQL, points_mm
from . import query, table

P = f"WITH {POINTS_SQL}"
ROOMS = [(1, 0, 2500, 0, 3000), (2, 2500, 4000, 0, 3000), (3, 400, 1600, 400, 1600)]
ROOMS_SQL = "r AS (SELECT * FROM (VALUES " + ", ".join(str(x) for x in ROOMS) + ") t(room, u0, u1, v0, v1))"


def rooms_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(ROOMS, "room int, u0 long, u1 long, v0 long, v1 long"))  # three literal rows


@query(P + f""", {ROOMS_SQL}, h AS (SELECT l_orderkey, l_linenumber, l_partkey, frame_id, u_mm, v_mm, h_mm, min(room) AS room FROM points, r WHERE u_mm BETWEEN u0 - 50 AND u1 + 50 AND v_mm BETWEEN v0 - 50 AND v1 + 50 GROUP BY ALL)
SELECT room, count(*) AS n, CAST(sum(h_mm) AS BIGINT) AS h FROM h GROUP BY room""")
def points_in_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points_mm(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "frame_id", "u_mm", "v_mm", "h_mm").distinct()
    hit = spatial.point_in_rectangles(p, rooms_table(spark), "u_mm", "v_mm", "room", "room", pad=50, size=500)
    return hit.groupBy("room").agg(F.count("*").alias("n"), F.sum("h_mm").alias("h"))


@query(
    """WITH c AS (SELECT c_custkey, c_nationkey AS k, c_custkey * 53 % 1000 AS x FROM customer), s AS (SELECT s_suppkey, s_nationkey AS k, s_suppkey * 37 % 1000 AS y FROM supplier)
SELECT c_custkey, arg_min(s_suppkey, (abs(x - y), s_suppkey)) AS supplier, min(abs(x - y)) AS off FROM c JOIN s ON c.k = s.k AND abs(x - y) < 60 GROUP BY c_custkey"""
)
def band_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), (F.col("c_custkey") * 53 % 1000).alias("x"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), (F.col("s_suppkey") * 37 % 1000).alias("y"))
    m = spatial.nearest_in_band(c, s, "c_custkey", "s_suppkey", "x", "y", 60, ["k"])
    return m.select("c_custkey", F.col("s_suppkey").alias("supplier"), F.abs(F.col("x") - F.col("y")).alias("off"))


SURFACES = [(1, "u", 1, 0.0, 0.0, 3.0), (2, "u", -1, 4.0, 0.0, 3.0), (3, "u", 1, 2.5, 0.0, 1.2), (4, "u", 1, 2.5, 2.1, 3.0), (5, "v", 1, 0.0, 0.0, 4.0), (6, "v", -1, 3.0, 0.0, 4.0)]


@query(
    P + """, q AS (SELECT 'u' AS axis, u_mm / 1000.0::DOUBLE AS x, v_mm / 1000.0::DOUBLE AS along, nu::DOUBLE AS n, h_mm / 1000.0::DOUBLE AS h FROM points WHERE nu <> 0 UNION ALL SELECT 'v', v_mm / 1000.0::DOUBLE, u_mm / 1000.0::DOUBLE, nv::DOUBLE, h_mm / 1000.0::DOUBLE FROM points WHERE nv <> 0),
d AS (SELECT DISTINCT * FROM q), s AS (SELECT * FROM (VALUES """ + ", ".join(str(x) for x in SURFACES) + """) t(surface_id, axis, sign, coord, a, b)),
j AS (SELECT d.*, min(surface_id) AS surface_id FROM d JOIN s ON d.axis = s.axis AND sign(n) = s.sign AND abs(x - coord::DOUBLE) < 0.05::DOUBLE AND abs(n) > 0.8 AND h > 0.02::DOUBLE AND along BETWEEN a::DOUBLE - 0.1::DOUBLE AND b::DOUBLE + 0.1::DOUBLE GROUP BY ALL)
SELECT surface_id, count(*) AS n, round(sum(h), 3) AS h FROM j GROUP BY surface_id"""
)
def first_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points_mm(spark, sf_dir)
    side = lambda a, b, n, axis: p.filter(F.col(n) != 0).select(F.lit(axis).alias("axis"), (F.col(a) / 1000.0).cast("double").alias("at"), (F.col(b) / 1000.0).cast("double").alias("along"), F.col(n).cast("double").alias("n"), (F.col("h_mm") / 1000.0).cast("double").alias("h"))
    d = side("u_mm", "v_mm", "nu", "u").unionByName(side("v_mm", "u_mm", "nv", "v")).distinct()
    s = spark.createDataFrame(SURFACES, "surface_id int, axis string, sign int, coord double, a double, b double")
    return spatial.first_surface(d, F.broadcast(s)).groupBy("surface_id").agg(F.count("*").alias("n"), F.round(F.sum("h"), 3).alias("h"))


SPAN = "SELECT o_orderkey AS id, o_custkey AS k, epoch(o_orderdate)::BIGINT // 86400 AS a, epoch(o_orderdate)::BIGINT // 86400 + 1 + o_orderkey % 45 AS b FROM orders"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), day.alias("a"), (day + 1 + F.col("o_orderkey") % 45).alias("b"))


@query(f"WITH s AS ({SPAN}) SELECT x.id AS left_id, y.id AS right_id, least(x.b, y.b) - greatest(x.a, y.a) AS overlap FROM s x JOIN s y ON x.k = y.k AND x.id < y.id AND least(x.b, y.b) - greatest(x.a, y.a) > 0")
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    r = s.select("k", F.col("id").alias("right_id"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    return spatial.overlap_join(s.withColumnRenamed("id", "left_id"), r, ["k"], 30).filter("left_id < right_id").select("left_id", "right_id", "overlap")


@query(f"""WITH s AS ({SPAN}), d AS (SELECT o_custkey AS k, o_orderkey AS x, epoch(o_orderdate)::BIGINT // 86400 AS t FROM orders) SELECT d.x, count(*) AS n FROM d JOIN s ON d.k = s.k AND t BETWEEN a AND b AND s.id <> d.x GROUP BY d.x""")
def orders_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    d = s.select("k", F.col("id").alias("x"), F.col("a").alias("t"))
    return spatial.range_join(d, s, "t", "a", "b", 30, ["k"]).filter("id <> x").groupBy("x").agg(F.count("*").alias("n"))


RECTS = "SELECT p_partkey AS region, p_partkey * 7919 % 1000 / 10.0::DOUBLE AS u0, p_partkey * 104729 % 900 / 10.0::DOUBLE AS v0, p_partkey * 7919 % 1000 / 10.0::DOUBLE + 2 + p_partkey % 7 AS u1, p_partkey * 104729 % 900 / 10.0::DOUBLE + 2 + p_partkey % 5 AS v1 FROM part"


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    u, v = (k * 7919 % 1000 / 10.0).cast("double"), (k * 104729 % 900 / 10.0).cast("double")
    return table(spark, sf_dir, "part").select(k.alias("region"), u.alias("u0"), v.alias("v0"), (u + 2 + k % 7).alias("u1"), (v + 2 + k % 5).alias("v1"))


@query(f"WITH r AS ({RECTS}), j AS (SELECT x.region AS a, y.region AS b, (least(x.u1, y.u1) - greatest(x.u0, y.u0)) * (least(x.v1, y.v1) - greatest(x.v0, y.v0)) AS area FROM r x JOIN r y ON x.region < y.region AND x.u0 < y.u1 AND y.u0 < x.u1 AND x.v0 < y.v1 AND y.v0 < x.v1) SELECT a, b, round(area, 6) AS area FROM j WHERE area > 0.25")
def overlapping_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.overlap_area(rectangles(spark, sf_dir), "region", size=8.0, digits=6)


FRAMES = "f AS (SELECT frame_id, min(u_mm) AS u, min(v_mm) AS v, min(h_mm) AS h, frame_id * 0.1::DOUBLE AS t FROM points WHERE s IN (0, 1, 2, 3) GROUP BY frame_id)"
ALL_FRAMES = "f AS (SELECT l_orderkey AS id, u_mm AS u, v_mm AS v, frame_id AS t FROM points WHERE nh = 1 GROUP BY ALL)"


@query(P + f""", {ALL_FRAMES}, g AS (SELECT min(id) AS id, u, v, t FROM f GROUP BY u, v, t), h AS (SELECT *, row_number() OVER (ORDER BY id, u, v, t) AS n FROM g),
j AS (SELECT x.n, min((x.u - y.u) * (x.u - y.u) + (x.v - y.v) * (x.v - y.v)) AS d2 FROM h x JOIN h y ON abs(x.u - y.u) < 60 AND abs(x.v - y.v) < 60 AND abs(x.t - y.t) >= 200 AND (x.u - y.u) * (x.u - y.u) + (x.v - y.v) * (x.v - y.v) < 3600 GROUP BY x.n)
SELECT count(*) AS n, CAST(sum(d2) AS BIGINT) AS d2, median(d2) AS median FROM j""")
def revisit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each floor point's nearest point seen 200 frames or more apart, within 60 mm."""
    p = points_mm(spark, sf_dir).filter("nh = 1").groupBy(F.col("u_mm").alias("u"), F.col("v_mm").alias("v"), F.col("frame_id").alias("t")).agg(F.min("l_orderkey").alias("id"))
    p = p.withColumn("n", F.xxhash64("id", "u", "v", "t"))
    d = revisits.revisit_distance(p, "n", ("u", "v"), "t", 60, 200)
    return d.agg(F.count("*").alias("n"), F.sum("d2").cast("long").alias("d2"), F.median("d2").alias("median"))


@query(
    """WITH a AS (SELECT event_id, user_id AS k, (event_id * 7919) % 10000 AS x, (event_id * 104729) % 10000 AS y FROM events WHERE event_type = 'click'), b AS (SELECT event_id, user_id AS k, (event_id * 7919) % 10000 AS x, (event_id * 104729) % 10000 AS y FROM events WHERE event_type = 'view')
SELECT a.event_id, arg_min(b.event_id, ((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.event_id)) AS near_event_id, min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d2 FROM a JOIN b ON a.k = b.k AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 2000*2000 GROUP BY a.event_id"""
)
def nearest_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), (F.col("event_id") * 7919 % 10000).alias("x"), (F.col("event_id") * 104729 % 10000).alias("y"), "event_type")
    of = lambda t: e.filter(F.col("event_type") == t).drop("event_type")
    return spatial.nearest_within(of("click"), of("view"), "event_id", "event_id", ("x", "y"), 2000, keys=["k"]).select("event_id", "near_event_id", "d2")


@query(
    """WITH k AS (SELECT user_id, epoch_us(ts) AS t, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL), q AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'),
p AS (SELECT q.user_id, q.t, max(k.t) AS t0 FROM q LEFT JOIN k ON q.user_id = k.user_id AND k.t <= q.t GROUP BY ALL), n AS (SELECT q.user_id, q.t, min(k.t) AS t1 FROM q LEFT JOIN k ON q.user_id = k.user_id AND k.t >= q.t GROUP BY ALL)
SELECT p.user_id, p.t, round(coalesce(a.v + (b.v - a.v) * ((p.t - t0)::DOUBLE / nullif(t1 - t0, 0)), a.v, b.v), 6) AS v FROM p JOIN n USING (user_id, t) LEFT JOIN k a ON a.user_id = p.user_id AND a.t = t0 LEFT JOIN k b ON b.user_id = p.user_id AND b.t = t1"""
)
def interpolated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value", "event_type")
    k = e.filter("event_type = 'view'").groupBy("user_id", "t").agg(F.avg("value").alias("v"))
    q = e.filter("event_type = 'click'").select("user_id", "t").distinct()
    return spatial.asof_interpolated(k, q, "t", ["v"], ["user_id"]).select("user_id", "t", F.round("v", 6).alias("v"))


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(range(1, 65), lambda j: q.embedding[j]::DOUBLE * e.embedding[j]::DOUBLE)) AS s FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, round(s, 6) AS score FROM r WHERE rank <= 5"""
)
def exact_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact nearest vectors of a stated query set, in blocks."""
    e = table(spark, sf_dir, "embeddings")
    return spatial.top_neighbours(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, sqrt(greatest(2 - 2 * list_sum(list_transform(range(1, 65), lambda j: q.embedding[j]::DOUBLE * e.embedding[j]::DOUBLE)), 0)) AS d FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM s), t AS (SELECT query_id, max(vec_id) FILTER (WHERE rank = 1) AS vec_id, max(d) FILTER (WHERE rank = 1) AS d1, max(d) FILTER (WHERE rank = 2) AS d2 FROM r WHERE rank <= 2 GROUP BY query_id)
SELECT query_id, vec_id, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM t WHERE d1 < 0.97 * d2"""
)
def ratio_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    n = spatial.top_neighbours(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 2).withColumn("dist", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))))
    return spatial.ratio_test(n, 0.97).select("query_id", "vec_id", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS x, 100 + s_suppkey % 40 AS y FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_custkey % 97 = s_suppkey % 97), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
w(node, seen) AS (SELECT DISTINCT x, x FROM b UNION SELECT w.node, b.y FROM w JOIN b ON w.seen = b.x) SELECT node::BIGINT AS node, min(seen)::BIGINT AS component FROM w GROUP BY node"""
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    e = c.join(s, (c["c_nationkey"] == s["s_nationkey"]) & (c["c_custkey"] % 97 == s["s_suppkey"] % 97)).select(F.col("c_nationkey").cast("long").alias("a"), (100 + F.col("s_suppkey") % 40).cast("long").alias("b"))
    return graph.connected_components(e)


@query("SELECT DISTINCT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b FROM customer JOIN supplier ON c_custkey % 1000 = s_suppkey WHERE c_nationkey <> s_nationkey")
def ordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    p = F.array_sort(F.array("c_nationkey", "s_nationkey"))
    return c.join(s, c["c_custkey"] % 1000 == s["s_suppkey"]).filter("c_nationkey <> s_nationkey").select(p[0].alias("a"), p[1].alias("b")).distinct()


@query("(SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 100000) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders")
    return c.intersect(o.filter("o_totalprice > 100000").select(F.col("o_custkey").alias("k"))).subtract(o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")))


@query("SELECT c_nationkey, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS active, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS idle FROM customer GROUP BY c_nationkey")
def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    n = c.join(o, "c_custkey", "left_semi").withColumn("x", F.lit(1)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("x", F.lit(0)))
    return n.groupBy("c_nationkey").agg(F.count_if(F.col("x") == 1).alias("active"), F.count_if(F.col("x") == 0).alias("idle"))
