"""Streaming queries: each drains a stream over the events files and is held against its batch form."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_dir
from ..streaming import ordered, streams
from . import query, table
from .runs import key_frames_sql


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(where).schema
    # a stream reads a folder: the events file, by its name
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _name() -> str:
    return f"stream_{uuid.uuid4().hex}"


@query("SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.tumbling(streams.timed(_events(spark, sf_dir), "ts", "1 hour"), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")])
    d = streams.drained(s, _name(), "complete")
    return d.select(F.unix_micros("window.start").alias("hour_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT epoch_us(w) AS start_us, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), CASE WHEN hour(ts) < 12 THEN date_trunc('day', ts) - INTERVAL 12 HOUR ELSE date_trunc('day', ts) + INTERVAL 12 HOUR END]) AS w FROM events) GROUP BY w")
def sliding_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.sliding(streams.timed(_events(spark, sf_dir), "ts", "1 day"), "ts", "1 day", "12 hours", [], [F.count("*").alias("n")])
    return streams.drained(s, _name(), "complete").select(F.unix_micros("window.start").alias("start_us"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1200000000 THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, epoch_us(min(ts)) AS first_us, count(*) AS n FROM s GROUP BY user_id, session""")
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.sessions(streams.timed(_events(spark, sf_dir), "ts", "1 hour"), "ts", "20 minutes", ["user_id"], [F.count("*").alias("n")])
    return streams.drained(s, _name(), "complete").select("user_id", F.unix_micros("session_window.start").alias("first_us"), "n")


@query("SELECT e.event_id, c.c_nationkey FROM events e JOIN customer c ON c.c_custkey = e.user_id")
def looked_up_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    return streams.drained(_events(spark, sf_dir).join(c, "user_id").select("event_id", "c_nationkey"), _name())


@query("SELECT count(DISTINCT (user_id, event_type, date_trunc('minute', ts))) AS n FROM events")
def first_seen_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = streams.timed(_events(spark, sf_dir), "ts", "40 days").withColumn("m", F.date_trunc("minute", "ts"))
    d = streams.drained(streams.first_seen(e, ["user_id", "event_type", "m"]).select("event_id"), _name())
    return d.agg(F.count("*").alias("n"))


@query(key_frames_sql(3600.0, "frame_id"))
def keyframe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", F.col("event_id").alias("frame_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts_s"), (F.col("value") % 1 / 10).alias("shift"), F.col("value").alias("sharpness"))
    return streams.drained(streams.keyframes(e, "user_id", gap_s=3600.0), _name())


#: What a file of _out_of_order holds, about; tables of less than three times so much have one file a batch.
ROWS_A_FILE = 200_000


def _out_of_order(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """A stream of the events in three batches, in which rows come up to two days out of order, and one far event at the end, so that the watermark passes all others;
    and what makes another such stream. A batch must be whole, so each has as many files as a batch takes."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    end = spark.range(2).select((F.lit(-1) - F.col("id")).alias("event_id"), F.timestamp_micros(F.lit(1_800_000_000_000_000)).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.when(F.col("id") == 0, "click").otherwise("view").alias("event_type"), F.lit(0.0).alias("value"))
    part = F.least(F.floor((F.dayofmonth("ts") + F.col("event_id") % 2) / 11), F.lit(2))
    counts = {r[0]: r[1] for r in e.groupBy(part).count().collect()}
    files = max(1, min(counts.get(i, 0) for i in range(3)) // ROWS_A_FILE)
    where = f"{shared_dir(spark)}/{_name()}"
    for i in range(3):
        rows = e.filter(part == i)
        rows = rows.unionByName(end) if i == 2 else rows
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(where)
    stream = lambda: streams.read_stream(spark, where, e.schema, files)
    return stream(), stream


@query(
    """WITH f AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL), q AS (SELECT user_id, ts, min(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL),
a AS (SELECT f.event_id, max(p.ts) AS t, arg_max(p.v, p.ts) AS v FROM f JOIN p ON f.user_id = p.user_id AND p.ts <= f.ts AND p.ts >= f.ts - INTERVAL 6 HOUR GROUP BY ALL), b AS (SELECT f.event_id, min(q.ts) AS t, arg_min(q.v, q.ts) AS v FROM f JOIN q ON f.user_id = q.user_id AND q.ts >= f.ts AND q.ts <= f.ts + INTERVAL 6 HOUR GROUP BY ALL)
SELECT f.user_id, f.event_id, round(coalesce(a.v + (b.v - a.v) * coalesce((epoch_us(f.ts) - epoch_us(a.t))::DOUBLE / nullif(epoch_us(b.t) - epoch_us(a.t), 0), 0), a.v, b.v), 6) AS value FROM f LEFT JOIN a ON f.event_id = a.event_id LEFT JOIN b ON f.event_id = b.event_id WHERE a.t IS NOT NULL OR b.t IS NOT NULL"""
)
def posed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks between the views around them, as two streams that are joined by time."""
    e, again = _out_of_order(spark, sf_dir)
    s = ordered.between_poses(e.filter("event_type = 'click'"), again().filter("event_type = 'view'"), "user_id", "event_id", "ts", ["value"], reach="6 hours", late="3 days")
    return streams.drained(s, _name()).select("user_id", "event_id", F.round("value", 6).alias("value"))


@query(key_frames_sql(3600.0, "frame_id"))
def ordered_keyframe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key frames of each user's events in the order of their times, which they don't come in."""
    e, _ = _out_of_order(spark, sf_dir)
    frames = e.select("user_id", F.col("event_id").alias("frame_id"), "ts", (F.col("value") % 1 / 10).alias("shift"), F.col("value").alias("sharpness")).filter("user_id is not null")
    with ordered.keyed_state(spark):
        return streams.drained(ordered.keyframes(frames, "user_id", late="3 days", gap_s=3600.0), _name())
