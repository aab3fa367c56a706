"""Islands, merging, gaps, coverage, folds, naming, sampling and windows over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tables
from ..operators import intervals, windows
from ..plans.known_room import POINTS_SQL, points_mm
from . import query, table
from .joins import SPAN, spans

P = f"WITH {POINTS_SQL}"


@query(
    P + """, c AS (SELECT nu, floor(v_mm / 50)::BIGINT AS col FROM points WHERE s = 6 AND h_mm > 200 AND h_mm < 2400 GROUP BY ALL HAVING count(DISTINCT least(floor((h_mm - 200) / 100.0), 21)) / 22.0 >= 0.3),
g AS (SELECT *, CASE WHEN col - lag(col) OVER (PARTITION BY nu ORDER BY col) <= 5 THEN 0 ELSE 1 END AS new FROM c), r AS (SELECT *, sum(new) OVER (PARTITION BY nu ORDER BY col) AS run FROM g)
SELECT nu, min(col) * 50.0::DOUBLE AS a, (max(col) + 1) * 50.0::DOUBLE AS b FROM r GROUP BY nu, run HAVING (max(col) + 1 - min(col)) * 50 >= 250"""
)
def wall_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.robust import height_coverage

    p = points_mm(spark, sf_dir).filter("s = 6").withColumn("col", F.floor(F.col("v_mm") / 50))
    c = height_coverage(p, ["nu", "col"], F.col("h_mm"), 200, 2400, 100).filter("coverage >= 0.3")
    return intervals.closed_runs(c, "col", ["nu"], 2, 50.0, 250.0)


@query(f"""WITH s AS ({SPAN}), m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), r AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT k, min(a) AS a, max(b) AS b, count(*) AS n FROM r GROUP BY k, run""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged(spans(spark, sf_dir), "a", "b", ["k"], 2)


@query(f"""WITH s AS ({SPAN}), m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), r AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m),
u AS (SELECT k, min(a) AS a, max(b) AS b FROM r GROUP BY k, run) SELECT * FROM (SELECT k, b AS a, lead(a) OVER (PARTITION BY k ORDER BY a) AS b FROM u) WHERE b - a BETWEEN 10 AND 200""")
def span_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gaps(intervals.merged(spans(spark, sf_dir), "a", "b", ["k"], 0).drop("n"), ["k"], least=10, most=200)


@query(f"""WITH s AS ({SPAN}), m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), r AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m),
u AS (SELECT k, min(a) AS pa, max(b) AS pb FROM r GROUP BY k, run), t AS (SELECT DISTINCT k, x * 200 AS a, x * 200 + 200 AS b FROM (SELECT k, unnest([a // 200, a // 200 + 1]) AS x FROM s))
SELECT t.k, t.a, t.b, round(coalesce(sum(greatest(0, least(t.b, pb) - greatest(t.a, pa))), 0) / 200.0, 6)::DOUBLE AS covered FROM t LEFT JOIN u USING (k) GROUP BY ALL""")
def span_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    parts = intervals.merged(s, "a", "b", ["k"], 0).drop("n")
    x = F.explode(F.array(F.floor(F.col("a") / 200), F.floor(F.col("a") / 200) + 1))
    t = s.select("k", x.alias("x")).distinct().select("k", (F.col("x") * 200).alias("a"), (F.col("x") * 200 + 200).alias("b"))
    return intervals.coverage(t, parts, ["k"], ["a", "b"], 50).withColumn("covered", F.round("covered", 6))


CUT_LINES_SQL = """WITH RECURSIVE d AS (SELECT c_nationkey AS k, (c_custkey * 7919 % 10000) / 100.0::DOUBLE AS c, (1 + c_custkey % 5)::DOUBLE AS w, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey * 7919 % 10000, 1 + c_custkey % 5) AS rn FROM customer),
f(k, rn, ord, c, w) AS (SELECT k, rn, 0, c, w FROM d WHERE rn = 1 UNION ALL SELECT d.k, d.rn, CASE WHEN d.c - f.c < 0.6 THEN f.ord ELSE f.ord + 1 END, CASE WHEN d.c - f.c < 0.6 THEN (f.c * f.w + d.c * d.w) / (f.w + d.w) ELSE d.c END, CASE WHEN d.c - f.c < 0.6 THEN f.w + d.w ELSE d.w END FROM f JOIN d ON d.k = f.k AND d.rn = f.rn + 1)
SELECT k, ord, round(arg_max(c, rn), 6) AS coord, arg_max(w, rn) AS weight FROM f GROUP BY k, ord"""


@query(CUT_LINES_SQL)
def cut_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered fold: each position joins the line before while it is near that line's running weighted mean."""
    d = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), (F.col("c_custkey") * 7919 % 10000 / 100.0).cast("double").alias("c"), (1 + F.col("c_custkey") % 5).cast("double").alias("w"))
    return intervals.cut_lines(d, "c", "w", ["k"], 0.6).select("k", "ord", F.round("coord", 6).alias("coord"), "weight")


@query(CUT_LINES_SQL)
def cut_lines_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold through a table function."""
    d = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), (F.col("c_custkey") * 7919 % 10000 / 100.0).cast("double").alias("c"), (1 + F.col("c_custkey") % 5).cast("double").alias("w"))
    m = tables.merged_lines(d.asTable().partitionBy("k").orderBy("c", "w"), F.lit(0.6))
    return m.select(F.col("key").cast("int").alias("k"), "ord", F.round("coord", 6).alias("coord"), "weight")


@query("SELECT o_orderkey, greatest(abs(o_custkey % 60 - o_orderkey % 50), abs(o_orderkey * 7 % 60 - o_custkey * 3 % 50)) + 1 AS n FROM orders")
def line_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of exact lines, one for each step of the longer side. Equal lines are drawn once."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (k % 50).alias("r0"), (c * 3 % 50).alias("c0"), (c % 60).alias("r1"), (k * 7 % 60).alias("c1"))
    return tables.with_line_cells(o, ("r0", "c0", "r1", "c1"), F.count_distinct("r", "c").alias("n")).select("o_orderkey", "n")


@query(
    """WITH e AS (SELECT DISTINCT l_suppkey AS k, l_partkey % 200 AS ord FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT *, ord - row_number() OVER (PARTITION BY k ORDER BY ord) AS g FROM e)
SELECT k, min(ord) AS a, max(ord) + 1 AS b, count(*) AS n FROM r GROUP BY k, g"""
)
def opening_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 200).alias("ord")).distinct().withColumns({"a": F.col("ord"), "b": F.col("ord") + 1})
    return intervals.opening_runs(e, "ord", ["k"], "a", "b")


@query(
    """WITH s AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderkey % 1000 AS a, o_orderkey % 1000 + 50 AS b FROM orders WHERE o_orderkey % 3 = 0), w AS (SELECT o_custkey AS k, o_orderkey * 7 % 1000 AS wa, o_orderkey * 7 % 1000 + 20 AS wb FROM orders WHERE o_orderkey % 3 <> 0)
SELECT s.k, s.id, greatest(any_value(s.a), coalesce(max(wb) FILTER (WHERE wb <= (s.a + s.b) / 2), -1)) AS a, least(any_value(s.b), coalesce(min(wa) FILTER (WHERE wa >= (s.a + s.b) / 2), 100000)) AS b FROM s LEFT JOIN w USING (k) GROUP BY s.k, s.id"""
)
def tightened_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"))
    s = o.filter("id % 3 = 0").withColumns({"a": F.col("id") % 1000, "b": F.col("id") % 1000 + 50})
    w = o.filter("id % 3 <> 0").select("k", (F.col("id") * 7 % 1000).alias("a"), (F.col("id") * 7 % 1000 + 20).alias("b"))
    return intervals.tightened(s, w, ["k"], ["id"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, round(o_totalprice / 10000.0, 0) ORDER BY o_orderkey DESC) = 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return intervals.last_wins(o, [F.col("o_custkey"), F.round(F.col("o_totalprice") / 10000.0, 0)], [F.col("o_orderkey")])


@query(P + """, c AS (SELECT DISTINCT s, floor(h_mm / 400)::BIGINT AS r, floor(v_mm / 50)::BIGINT AS c FROM points WHERE s IN (2, 6)), n AS (SELECT *, lead(c) OVER (PARTITION BY s, r ORDER BY c) AS nx FROM c)
SELECT s, r, unnest(range(c, CASE WHEN nx - c <= 22 THEN nx ELSE c + 1 END)) AS c FROM n""")
def bridged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = points_mm(spark, sf_dir).filter("s in (2, 6)").select("s", F.floor(F.col("h_mm") / 400).alias("r"), F.floor(F.col("v_mm") / 50).alias("c"))
    return intervals.bridged(c, "c", ["s", "r"], 22)


@query("SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_nationkey, t) = 1 THEN t ELSE t || ' ' || row_number() OVER (PARTITION BY c_nationkey, t ORDER BY c_custkey) END AS name, 'R' || row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS id FROM (SELECT *, 'Type' || (c_custkey % 30) AS t FROM customer)")
def named_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("t", F.concat(F.lit("Type"), (F.col("c_custkey") % 30).cast("string")))
    d = windows.suffixed(c, "t", [F.col("c_custkey")], ["c_nationkey"])
    return windows.numbered(d, [F.col("c_custkey")], ["c_nationkey"], "R").select("c_custkey", "name", "id")


@query("SELECT event_id, unnest(range(greatest(floor((event_id - 24) / 16) + 1, 0)::BIGINT, floor(event_id / 16)::BIGINT + 1)) AS w FROM events")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.explode(windows.sliding(F.col("event_id"), 24, 8)).alias("w"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1200000000 THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS events, epoch_us(min(ts)) AS first_us FROM s GROUP BY ALL""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windows.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 1200)
    return d.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.unix_micros(F.min(F.col("ts").cast("timestamp"))).alias("first_us"))


@query("SELECT user_id, floor(event_id / 60)::BIGINT AS segment, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", windows.segment_of(F.col("event_id"), 60).alias("segment")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) WHERE n % 10 = 0")
def every_tenth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.every(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), [F.col("ts"), F.col("event_id")], ["user_id"], 10).select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events) WHERE c <= 24 OR list_contains(list_transform(range(0, 24), lambda i: floor(i * (c - 1) / 23)::BIGINT), n)")
def even_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.evenly(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), [F.col("ts"), F.col("event_id")], ["user_id"], 24).select("user_id", "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the limit is the feature."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(12)


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC)::INTEGER AS by_quantity FROM lineitem")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.sum("l_quantity").over(w).cast("long").alias("so_far"), F.rank().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_quantity"))).alias("by_quantity"))


def key_frames_sql(gap_s: float, frame: str) -> str:
    """The rule step by step: one recursion a frame of each user."""
    return f"""WITH RECURSIVE f AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, value % 1 / 10 AS shift, value AS q, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE user_id IS NOT NULL),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::DOUBLE AS last_t, 0::DOUBLE AS moved, 0::BIGINT AS since, []::STRUCT(q DOUBLE, m BIGINT)[] AS l, NULL::BIGINT AS best FROM f),
w AS (SELECT * FROM s UNION ALL
  SELECT user_id, n, CASE WHEN due THEN t ELSE last_t END, CASE WHEN due THEN 0 ELSE moved END, CASE WHEN due THEN 0 ELSE since END, CASE WHEN due THEN [] ELSE l END, CASE WHEN due THEN -(list_max(l)).m END
  FROM (SELECT f.user_id, f.n, f.t, w.last_t, w.moved + f.shift AS moved, w.since + 1 AS since, list_append(w.l, {{'q': f.q, 'm': -f.event_id}})[-3:] AS l, w.last_t IS NULL OR (w.since + 1 >= 2 AND (w.moved + f.shift >= 0.12 OR f.t - w.last_t >= {gap_s})) AS due
    FROM w JOIN f ON f.user_id = w.user_id AND f.n = w.n + 1))
SELECT user_id, best AS {frame} FROM w WHERE best IS NOT NULL"""


@query(key_frames_sql(3600.0, "frame"))
def key_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key frames of each user's events, as frames: a sequential rule, tested against the stream."""
    e = table(spark, sf_dir, "events").filter("user_id is not null").select("user_id", F.col("event_id").alias("frame"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), (F.col("value") % 1 / 10).alias("shift"), F.col("value").alias("sharp"))
    return windows.keyframes(e, ["user_id"], "frame", "ts", "shift", "sharp", gap_s=3600.0)


@query(key_frames_sql(3600.0, "frame_id"))
def key_frames_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a table function, which holds a few numbers a user."""
    e = table(spark, sf_dir, "events").filter("user_id is not null").select("user_id", F.col("event_id").alias("frame"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), (F.col("value") % 1 / 10).alias("shift"), F.col("value").alias("sharp"))
    k = tables.key_frames(e.asTable().partitionBy("user_id").orderBy("frame"), F.lit(0.12), F.lit(3600.0), F.lit(3), F.lit(2))
    return k.select(F.col("key").cast("long").alias("user_id"), "frame_id")


@query()
def farthest_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value"), (F.col("event_id") % 97).cast("double").alias("y"))
    return windows.farthest_points(e, ["user_id"], ["value", "y"], ["event_id"], 8)
