"""Daily sightings of object classes by capture, kept up to date as event files arrive.

Each run takes the event files that came since the last one (a file stream with its checkpoint, available now) and adds one increment a batch: counts, sums,
first and last times and the best sighting of every day, capture and class, written under the batch's number, so that a batch that runs twice counts once.
Then it rebuilds those days of the report whose increments are newer than the report says it holds (the column ``through``), by dynamic partition overwrite.
A run that dies anywhere is mended by the next one: the checkpoint knows the files, the increments know the batches, the report knows its increments.

Output under ``output``: ``increments`` (by batch and day) and ``report`` (by day). Checkpoint and output belong together; delete both to begin anew.
Rows without a time, capture or class are counted in the log and left out; a missing value counts as a sighting with no confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import windows

from .common import log_of, main, stream_path, table_or_empty

log = log_of("sightings")
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
_MEASURES = "capture_id long, class string, n long, total decimal(38,6), first_ts timestamp_ntz, last_ts timestamp_ntz, best struct<value:double,event_id:long>"
INCREMENTS = f"{_MEASURES}, batch long, day string"
REPORT = "capture_id long, class string, n long, total double, first_ts timestamp_ntz, last_ts timestamp_ntz, best_event long, best_value double, rank int, through long, day string"


def increment(events: DataFrame) -> DataFrame:
    """Mergeable measures of each day, capture and class. Of equal values the earlier event is the better sighting."""
    row = F.struct(F.col("value").alias("value"), F.col("event_id").alias("event_id"))
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").alias("capture_id"), F.col("event_type").alias("class")).agg(
        F.count("*").alias("n"),
        F.sum(F.col("value").cast("decimal(28,6)")).alias("total"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max_by(row, F.struct("value", -F.col("event_id"))).alias("best"),
    )


def take_new(spark: SparkSession, events: str, output: str, checkpoint: str, files_per_batch: int) -> list[int]:
    """Writes an increment for each batch of new files; the numbers of the batches."""
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        seen = batch.persist()
        whole = F.col("ts").isNotNull() & F.col("user_id").isNotNull() & F.col("event_type").isNotNull()
        read, usable = seen.agg(F.count("*"), F.count_if(whole)).first()
        rows = increment(seen.filter(whole)).withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(f"{output}/increments")
        seen.unpersist()
        log.info("batch %d: read %d events, left out %d", number, read, read - usable)
        done.append(number)

    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(stream_path(events))
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return done


def publish(spark: SparkSession, output: str) -> int:
    """Rebuilds the days of the report that have newer increments; how many."""
    increments = table_or_empty(spark, f"{output}/increments", INCREMENTS)
    held = table_or_empty(spark, f"{output}/report", REPORT).groupBy("day").agg(F.max("through").alias("_held"))
    stale = increments.groupBy("day").agg(F.max("batch").alias("through")).join(held, "day", "left").filter("_held IS NULL OR _held < through").select("day", "through").persist()
    days = stale.count()
    if days:
        best = F.max_by("best", F.struct(F.col("best.value"), -F.col("best.event_id")))
        rows = increments.join(stale, "day").groupBy("day", "capture_id", "class").agg(
            F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), best.alias("_b"), F.max("through").alias("through")
        )
        ranked = windows.top_k(rows, ["day", "capture_id"], [F.desc("n"), F.col("class")], 2**31 - 1, "rank")
        report = ranked.select("capture_id", "class", "n", "total", "first_ts", "last_ts", F.col("_b.event_id").alias("best_event"), F.col("_b.value").alias("best_value"), "rank", "through", "day")
        report.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{output}/report")
    stale.unpersist()
    log.info("report: wrote %d days", days)
    return days


def run(spark: SparkSession, events: str, output: str, checkpoint: str, files_per_batch: int = 64) -> DataFrame:
    """Brings the daily sightings report up to date with the event files that are there; returns the report."""
    batches = take_new(spark, events, output, checkpoint, files_per_batch)
    log.info("took %d new batches from %s", len(batches), events)
    publish(spark, output)
    return table_or_empty(spark, f"{output}/report", REPORT)


if __name__ == "__main__":
    main("sightings", run, {"events": "folder, file or pattern of event files (Parquet)", "output": "folder of increments and report", "checkpoint": "folder of the stream's progress"})
