"""A known-truth capture derived from lineitem: a 4.00 x 3.00 m room, ceiling 2.60 m, a partition at u = 2.50 m with a door gap between
v = 1.20 and 2.10 m, and clutter 0.70 m high. All columns are whole millimetres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_K0 = "(l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 1299709) % 1000003"


def points_mm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, l_partkey, frame_id, range_mm, s (surface), u_mm, v_mm, h_mm, nu, nv, nh: one pass, no shuffle."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    k = F.expr(_K0)
    four = F.struct((k % 8).alias("s"), (F.floor(k / 8) % 4000).alias("a"), F.floor(k / 32000).alias("b"), (F.col("l_suppkey") % 7 - 3).alias("e"))
    # generated, so that filters on what derives from them don't repeat their expressions until methods are too long to be compiled
    d = d.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.explode(F.array(four)).alias("_p")).select("*", "_p.*")
    part = F.floor(F.col("a") * 3 / 4)
    s, a, b, e = (F.col(c) for c in "sabe")
    d = d.filter(~((s == 6) & part.between(1200, 2100)) & ~((s == 7) & (b % 2 == 1)))
    return d.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_orderkey") % 400).alias("frame_id"),
        (300 + F.col("l_quantity") * 70).alias("range_mm"),
        "s",
        F.when(s.isin(0, 1, 4, 5), a).when(s == 2, e).when(s == 3, 4000 + e).when(s == 6, 2500 + e).otherwise(500 + a % 1000).alias("u_mm"),
        F.when(s == 0, e).when(s == 1, 3000 + e).when(s.isin(2, 3, 6), part).when(s.isin(4, 5), b * 96).otherwise(500 + b * 30).alias("v_mm"),
        F.when(s == 4, e).when(s == 5, 2600 + e).when(s == 7, 700 + e).otherwise(b * 84).alias("h_mm"),
        F.when(s == 2, 1).when(s == 3, -1).when(s == 6, F.when(b % 2 == 0, 1).otherwise(-1)).otherwise(0).alias("nu"),
        F.when(s == 0, 1).when(s == 1, -1).otherwise(0).alias("nv"),
        F.when(s.isin(4, 7), 1).when(s == 5, -1).otherwise(0).alias("nh"),
    )


#: The same in SQL, for the oracles' WITH clause.
POINTS_SQL = f"""k0 AS (SELECT {_K0} AS k, CAST(l_suppkey % 7 AS BIGINT) - 3 AS e, l_orderkey % 400 AS frame_id, l_quantity AS rq, l_orderkey, l_linenumber, l_partkey FROM lineitem),
k1 AS (SELECT *, k % 8 AS s, CAST(floor(k / 8) AS BIGINT) % 4000 AS a, CAST(floor(k / 32000) AS BIGINT) AS b FROM k0),
points AS (SELECT l_orderkey, l_linenumber, l_partkey, frame_id, 300 + rq * 70 AS range_mm, s,
  CASE WHEN s IN (0,1,4,5) THEN a WHEN s = 2 THEN e WHEN s = 3 THEN 4000 + e WHEN s = 6 THEN 2500 + e ELSE 500 + a % 1000 END AS u_mm,
  CASE WHEN s = 0 THEN e WHEN s = 1 THEN 3000 + e WHEN s IN (2,3,6) THEN CAST(floor(a * 3 / 4) AS BIGINT) WHEN s IN (4,5) THEN b * 96 ELSE 500 + b * 30 END AS v_mm,
  CASE WHEN s = 4 THEN e WHEN s = 5 THEN 2600 + e WHEN s = 7 THEN 700 + e ELSE b * 84 END AS h_mm,
  CASE WHEN s = 2 THEN 1 WHEN s = 3 THEN -1 WHEN s = 6 THEN CASE WHEN b % 2 = 0 THEN 1 ELSE -1 END ELSE 0 END AS nu,
  CASE WHEN s = 0 THEN 1 WHEN s = 1 THEN -1 ELSE 0 END AS nv,
  CASE WHEN s IN (4,7) THEN 1 WHEN s = 5 THEN -1 ELSE 0 END AS nh
  FROM k1 WHERE NOT (s = 6 AND floor(a * 3 / 4) BETWEEN 1200 AND 2100) AND NOT (s = 7 AND b % 2 = 1))"""


def points_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In metres, as plan points: capture_id, frame_id, u, v, h, nu, nv, ny, range."""
    p = points_mm(spark, sf_dir)
    m = lambda c: (F.col(c) / 1000.0).cast("double")
    return p.select(F.lit("known").alias("capture_id"), "frame_id", m("u_mm").alias("u"), m("v_mm").alias("v"), m("h_mm").alias("h"), F.col("nu").cast("double").alias("nu"), F.col("nv").cast("double").alias("nv"), F.col("nh").cast("double").alias("ny"), m("range_mm").alias("range"))
