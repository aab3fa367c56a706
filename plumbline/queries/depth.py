"""Depth frames made from the tables, written as capture folders of PNG files and read back through the capture source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images
from ..operators.graph import shared_dir
from ..sources import captures, depth_source
from . import query, table

ROWS, COLS = 12, 16


def frames_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture for every twenty-fifth supplier, a frame for 8000 orders; the deepest line of a pixel counts. Everything is whole millimetres."""
    d = table(spark, sf_dir, "lineitem")
    key = [(F.col("l_suppkey") % 25).alias("k"), F.floor(F.col("l_orderkey") / 8000).alias("frame_id"), ((F.col("l_partkey") % ROWS) * COLS + F.col("l_orderkey") % COLS).cast("int").alias("i")]
    mm = (500 + F.col("l_quantity") * 50 + F.col("l_linenumber")).cast("int")
    pixels = d.groupBy(*key).agg(F.max(mm).alias("mm"), F.max(F.col("l_linenumber") % 3).cast("byte").alias("level"))
    got = pixels.groupBy("k", "frame_id").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("mm", "level")))).alias("m"))  # at most ROWS x COLS
    at = F.sequence(F.lit(0), F.lit(ROWS * COLS - 1))
    depth = F.transform(at, lambda i: (F.coalesce(F.try_element_at("m", i)["mm"], F.lit(0)) / 1000).cast("float"))
    conf = F.transform(at, lambda i: F.coalesce(F.try_element_at("m", i)["level"], F.lit(0).cast("byte")))
    number = {"timestamp": F.col("frame_id") / 10, "x": F.col("k") * 1.0, "y": F.lit(1.5), "z": F.col("frame_id") * 0.5, "qx": F.lit(0.0), "qy": F.lit(0.6), "qz": F.lit(0.0), "qw": F.lit(0.8), "fx": F.lit(64.0), "fy": F.lit(48.0), "cx": F.lit(32.0), "cy": F.lit(24.0)}
    return got.select(F.concat(F.lit("c"), "k").alias("capture_id"), "frame_id", F.lit(COLS).alias("w"), depth.alias("depth"), conf.alias("conf"), *[c.cast("double").alias(n) for n, c in number.items()])


@query(
    """WITH p AS (SELECT 'c' || (l_suppkey % 25) AS capture_id, l_orderkey // 8000 AS frame, (l_partkey % 12) AS r, (l_orderkey % 16) AS c, max((500 + l_quantity * 50 + l_linenumber)::INTEGER) AS mm, max(l_linenumber % 3) AS level FROM lineitem GROUP BY ALL),
f AS (SELECT capture_id, frame, row_number() OVER (PARTITION BY capture_id ORDER BY frame) - 1 AS frame_id FROM (SELECT DISTINCT capture_id, frame FROM p))
SELECT capture_id, frame_id, count(*) AS n, sum(mm)::BIGINT AS mm, sum((c - 8) * mm)::BIGINT AS right_mm16, sum((r - 6) * mm)::BIGINT AS down_mm12 FROM p JOIN f USING (capture_id, frame) WHERE level > 0 AND capture_id <> 'c3' GROUP BY ALL"""
)
def depth_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to PNG folders and back: pixels with confidence, back-projected, with the intrinsics brought from 64 x 48 to the depth image's size."""
    where = f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}"
    depth_source.write_captures(frames_of(spark, sf_dir), where).write.format("noop").mode("overwrite").save()
    depth_source.register(spark)
    frames = spark.read.format("depth_frames").option("rgb_width", 64).option("rgb_height", 48).load(where).filter("capture_id <> 'c3' AND frame_id >= 0")
    p = captures.pixels(frames).filter("conf > 0 AND depth > 0")
    right, down = (F.col("col") - F.col("cx")) * F.col("depth") / F.col("fx"), (F.col("row") - F.col("cy")) * F.col("depth") / F.col("fy")
    return p.groupBy("capture_id", "frame_id").agg(F.count("*").alias("n"), F.sum(F.round(F.col("depth") * 1000)).cast("long").alias("mm"), F.sum(F.round(right * 16000)).cast("long").alias("right_mm16"), F.sum(F.round(down * 12000)).cast("long").alias("down_mm12"))


@query(
    """WITH p AS (SELECT 'c' || (l_suppkey % 25) AS k, l_orderkey // 8000 AS f, (l_partkey % 12) AS r, (l_orderkey % 16) AS c, max((500 + l_quantity * 50 + l_linenumber)::INTEGER) AS mm FROM lineitem GROUP BY ALL),
g AS (SELECT k, f, r, c, coalesce(p.mm, 0) AS mm FROM (SELECT k, f, r, c FROM (SELECT DISTINCT k, f FROM p), range(12) a(r), range(16) b(c)) LEFT JOIN p USING (k, f, r, c)),
n AS (SELECT k, f, r, c, -4 * mm AS v FROM g UNION ALL SELECT g.k, g.f, t.r, t.c, g.mm FROM (SELECT r, c, unnest([{'y': r - 1, 'x': c}, {'y': r + 1, 'x': c}, {'y': r, 'x': c - 1}, {'y': r, 'x': c + 1}]) AS o FROM range(12) a(r), range(16) b(c)) t
  JOIN g ON g.r = CASE WHEN o.y < 0 THEN 1 WHEN o.y > 11 THEN 10 ELSE o.y END AND g.c = CASE WHEN o.x < 0 THEN 1 WHEN o.x > 15 THEN 14 ELSE o.x END),
l AS (SELECT k, f, r, c, sum(v)::DOUBLE AS v FROM n GROUP BY ALL) SELECT k AS capture_id, f AS frame_id, round(var_pop(v) / 1e6, 4) AS sharpness FROM l GROUP BY ALL"""
)
def frame_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The depth frames' sharpness, as if they were pictures: the variance of their Laplacian."""
    f = frames_of(spark, sf_dir).withColumn("mm", F.transform("depth", lambda x: F.round(x * 1000)))
    return f.select("capture_id", "frame_id", F.round(images.sharpness("mm", "w") / 1e6, 4).alias("sharpness"))
