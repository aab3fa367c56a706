"""Sparse rasters: set algebra, morphology, components, holes, rays, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, plan2d, raster
from ..plans.known_room import POINTS_SQL, points_mm
from . import query, table

P = f"WITH {POINTS_SQL}"
#: A raster for each supplier, so that rasters grow in number with the data and stay as dense as they are.
CELLS = "c AS (SELECT DISTINCT l_suppkey AS k, l_orderkey * 31 % 60 AS r, l_partkey * 17 % 60 AS c FROM lineitem)"
OTHER = "o AS (SELECT DISTINCT l_suppkey AS k, l_partkey * 31 % 60 AS r, l_orderkey * 17 % 60 AS c FROM lineitem)"
SPARSE = "c AS (SELECT DISTINCT l_suppkey AS k, l_orderkey * 31 % 90 AS r, l_partkey * 17 % 90 AS c FROM lineitem)"


def _hits(spark: SparkSession, sf_dir: str, r: str, c: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.expr(r).alias("r"), F.expr(c).alias("c"))


def _raster(spark: SparkSession, sf_dir: str, r: str, c: str) -> DataFrame:
    return _hits(spark, sf_dir, r, c).distinct()


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raster(spark, sf_dir, "l_orderkey * 31 % 60", "l_partkey * 17 % 60")


def other_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raster(spark, sf_dir, "l_partkey * 31 % 60", "l_orderkey * 17 % 60")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raster(spark, sf_dir, "l_orderkey * 31 % 90", "l_partkey * 17 % 90")


DISK = "d AS (SELECT i, unnest(range(-round(3 * sqrt(1 - (i / 3.0) * (i / 3.0)))::BIGINT, round(3 * sqrt(1 - (i / 3.0) * (i / 3.0)))::BIGINT + 1)) AS j FROM range(-3, 4) t(i))"
BOX = "b AS (SELECT i, j FROM range(-1, 2) t(i), range(-1, 2) u(j))"


@query(P + " SELECT floor(v_mm / 100)::BIGINT AS r, floor(u_mm / 100)::BIGINT AS c FROM points WHERE nh = 1 AND abs(h_mm) < 40 GROUP BY ALL")
def floor_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.rasterised(points_mm(spark, sf_dir).filter("nh = 1 and abs(h_mm) < 40"), "u_mm", "v_mm", 100)


@query(f"WITH {CELLS}, {DISK} SELECT DISTINCT k, r + i AS r, c + j AS c FROM c, d")
def dilated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.dilated(cells(spark, sf_dir), raster.disk(3))


@query(f"WITH {CELLS}, {BOX}, f AS (SELECT DISTINCT k, r + i AS r, c + j AS c FROM c, b), e AS (SELECT f.k, f.r, f.c FROM f, b JOIN f g ON g.k = f.k AND g.r = f.r + i AND g.c = f.c + j GROUP BY ALL HAVING count(*) = 9) SELECT * FROM e")
def closed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.closed(cells(spark, sf_dir), raster.box(1))


@query(f"WITH {CELLS}, {BOX}, f AS (SELECT DISTINCT k, r + i AS r, c + j AS c FROM c, b), e AS (SELECT f.k, f.r, f.c FROM f, b JOIN f g ON g.k = f.k AND g.r = f.r + i AND g.c = f.c + j GROUP BY ALL HAVING count(*) = 9), e2 AS (SELECT e.k, e.r, e.c FROM e, b JOIN e g ON g.k = e.k AND g.r = e.r + i AND g.c = e.c + j GROUP BY ALL HAVING count(*) = 9) SELECT DISTINCT k, r + i AS r, c + j AS c FROM e2, b")
def opened_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.opened(raster.closed(cells(spark, sf_dir), raster.box(1)), raster.box(1))


@query("WITH h AS (SELECT l_suppkey % 5 AS k, l_orderkey * 31 % 60 AS r, l_partkey * 17 % 60 AS c, count(*) AS n FROM lineitem GROUP BY ALL) SELECT k, r + i AS r, c + j AS c, CAST(sum(n) AS BIGINT) AS n FROM h, range(-1, 2) t(i), range(-1, 2) u(j) GROUP BY ALL")
def boxed_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("k"), (F.col("l_orderkey") * 31 % 60).alias("r"), (F.col("l_partkey") * 17 % 60).alias("c")).agg(F.count("*").alias("n"))
    return raster.boxed_sum(d, "n")


@query(f"WITH {CELLS}, {OTHER} SELECT 'or' AS op, count(*) AS n FROM (SELECT * FROM c UNION SELECT * FROM o) UNION ALL SELECT 'and', count(*) FROM (SELECT * FROM c INTERSECT SELECT * FROM o) UNION ALL SELECT 'minus', count(*) FROM (SELECT * FROM c EXCEPT SELECT * FROM o)")
def mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.set_sizes(_hits(spark, sf_dir, "l_orderkey * 31 % 60", "l_partkey * 17 % 60"), _hits(spark, sf_dir, "l_partkey * 31 % 60", "l_orderkey * 17 % 60"))


NEAR_8, NEAR_4 = "abs(i) <= 1 AND abs(j) <= 1", "abs(i) + abs(j) <= 1"


def _components_sql(near: str, where: str = "") -> str:
    return f"""WITH RECURSIVE {SPARSE}, s AS (SELECT i, j FROM range(-1, 2) t(i), range(-1, 2) u(j) WHERE {near}), n AS (SELECT a.k, a.r * 1048576 + a.c AS x, b.r * 1048576 + b.c AS y FROM c a CROSS JOIN s JOIN c b ON a.k = b.k AND b.r = a.r + i AND b.c = a.c + j),
w(k, x, y) AS (SELECT k, r * 1048576 + c, r * 1048576 + c FROM c UNION SELECT w.k, w.x, n.y FROM w JOIN n ON n.k = w.k AND n.x = w.y),
m AS (SELECT k, x // 1048576 AS r, x % 1048576 AS c, min(y) AS component FROM w GROUP BY k, x)
SELECT k, r, c, component FROM m {where}"""


@query(_components_sql(NEAR_8))
def components_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cell_components(sparse(spark, sf_dir), "r", "c", ["k"], diagonal=True).select("k", "r", "c", "component")


@query(_components_sql(NEAR_4))
def components_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cell_components(sparse(spark, sf_dir), "r", "c", ["k"], diagonal=False).select("k", "r", "c", "component")


@query(_components_sql(NEAR_8, "QUALIFY max(c) OVER (PARTITION BY k, component) - min(c) OVER (PARTITION BY k, component) + 1 >= 4"))
def long_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    comp = graph.cell_components(sparse(spark, sf_dir), "r", "c", ["k"], diagonal=True)
    return raster.long_components(comp, "c", 4, ["k"]).select("k", "r", "c", "component")


@query(
    f"""WITH RECURSIVE {CELLS}, g AS (SELECT k, min(r) - 1 AS r0, max(r) + 1 AS r1, min(c) - 1 AS c0, max(c) + 1 AS c1 FROM c GROUP BY k), e AS (SELECT k, r, unnest(range(c0, c1 + 1)) AS c, r0, c0, r1, c1 FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM g)), f AS (SELECT e.* FROM e ANTI JOIN c ON c.k = e.k AND c.r = e.r AND c.c = e.c),
o(k, r, c) AS (SELECT k, r, c FROM f WHERE r = r0 OR r = r1 OR c = c0 OR c = c1 UNION SELECT f.k, f.r, f.c FROM o CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(i, j) JOIN f ON f.k = o.k AND f.r = o.r + i AND f.c = o.c + j)
SELECT k, r, c FROM c UNION SELECT f.k, f.r, f.c FROM f ANTI JOIN o ON o.k = f.k AND o.r = f.r AND o.c = f.c"""
)
def filled_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.filled_holes(cells(spark, sf_dir), ["k"])


@query("WITH r AS (SELECT p_partkey AS region, p_partkey * 37 % 100 AS u0, p_partkey * 11 % 80 AS v0, p_partkey * 37 % 100 + 1 + p_partkey % 3 AS u1, p_partkey * 11 % 80 + 1 + p_partkey % 4 AS v1 FROM part) SELECT region, r, unnest(range(ceil(u0 / 0.5 - 0.5)::BIGINT, ceil(u1 / 0.5 - 0.5)::BIGINT)) AS c FROM (SELECT *, unnest(range(ceil(v0 / 0.5 - 0.5)::BIGINT, ceil(v1 / 0.5 - 0.5)::BIGINT)) AS r FROM r)")
def rectangle_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    r = table(spark, sf_dir, "part").select(k.alias("region"), (k * 37 % 100).alias("u0"), (k * 11 % 80).alias("v0"), (k * 37 % 100 + 1 + k % 3).alias("u1"), (k * 11 % 80 + 1 + k % 4).alias("v1"))
    return raster.rectangle_cells(r, 0.5, ["region"])


@query(f"WITH {CELLS}, {OTHER} SELECT c.k, c.r // 10 AS region, round(avg(CASE WHEN o.k IS NULL THEN 0 ELSE 1 END), 9) AS share FROM c LEFT JOIN o ON o.k = c.k AND o.r = c.r AND o.c = c.c GROUP BY ALL")
def seen_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raster.overlap_share(cells(spark, sf_dir).withColumn("region", F.floor(F.col("r") / 10)), other_cells(spark, sf_dir), ["k"], "region")
    return d.select("k", "region", F.round("share", 9).alias("share"))


RAYS = "y AS (SELECT l_suppkey AS k, floor(l_partkey % 500 / 10.0)::BIGINT AS c0, floor(l_orderkey % 500 / 10.0)::BIGINT AS r0, floor(l_partkey * 7 % 500 / 10.0)::BIGINT AS c1, floor(l_orderkey * 11 % 500 / 10.0)::BIGINT AS r1 FROM lineitem)"


@query(f"WITH {RAYS}, n AS (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0)) AS n FROM y), e AS (SELECT *, unnest(range(0, n - 2)) AS i FROM n WHERE n > 3) SELECT DISTINCT k, round(r0 + (r1 - r0) * i / n)::BIGINT AS r, round(c0 + (c1 - c0) * i / n)::BIGINT AS c FROM e")
def carved_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 500).alias("u0"), (F.col("l_orderkey") % 500).alias("v0"), (F.col("l_partkey") * 7 % 500).alias("u1"), (F.col("l_orderkey") * 11 % 500).alias("v1"))
    return raster.ray_cells(r, 10.0, ["k"])


@query(f"WITH {CELLS}, f AS (SELECT DISTINCT k, r + i AS r, c + j AS c FROM c, range(-1, 2) t(i), range(-1, 2) u(j)), o AS (SELECT DISTINCT f.k, f.r + i AS r, f.c + j AS c FROM f, range(-1, 2) t(i), range(-1, 2) u(j)), z AS (SELECT o.* FROM o ANTI JOIN f ON f.k = o.k AND f.r = o.r AND f.c = o.c) SELECT f.k, f.r, f.c, round(min(sqrt((f.r - z.r) ** 2 + (f.c - z.c) ** 2)), 9) AS distance FROM f JOIN z ON z.k = f.k GROUP BY ALL")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raster.distance_transform(raster.dilated(cells(spark, sf_dir), raster.box(1)), ["k"])
    return d.select("k", "r", "c", F.round("distance", 9).alias("distance"))


@query()
def flooded_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raster.dilated(cells(spark, sf_dir), raster.box(1))
    m = F.when((F.col("r") % 15 == 7) & (F.col("c") % 15 == 7), F.col("r") * 100 + F.col("c")).otherwise(0)
    return raster.watershed(d.withColumn("marker", m), ["k"])


@query(P + """, e AS (SELECT DISTINCT floor(v_mm / 50)::BIGINT AS r, floor(u_mm / 50)::BIGINT AS c FROM points WHERE nh = 1), x AS (SELECT * FROM (VALUES (0, 0, 1250), (1, 1250, 2500), (2, 2500, 4000)) t(i, u0, u1)), y AS (SELECT * FROM (VALUES (0, 0, 1500), (1, 1500, 3000)) t(j, v0, v1))
SELECT i, j, round(count(e.r) * 2500.0 / ((u1 - u0) * (v1 - v0)), 9)::DOUBLE AS fr FROM x CROSS JOIN y LEFT JOIN e ON (c + 0.5) * 50 >= u0 AND (c + 0.5) * 50 < u1 AND (r + 0.5) * 50 >= v0 AND (r + 0.5) * 50 < v1 GROUP BY i, j, u0, u1, v0, v1""")
def cell_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = spark.createDataFrame([("u", i, x) for i, x in enumerate((0.0, 1.25, 2.5, 4.0))] + [("v", i, x) for i, x in enumerate((0.0, 1.5, 3.0))], "axis string, ord int, coord double")
    e = raster.rasterised(points_mm(spark, sf_dir).filter("nh = 1"), "u_mm", "v_mm", 50)
    return plan2d.cell_fractions(plan2d.complex_cells(cuts, []), e, 0.05, []).select("i", "j", F.round("fr", 9).alias("fr"))
