"""Sinks: plan documents as JSON, text summaries, photo manifests, tables of geometry to draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "plumbline.plan/1.0"


def plan_documents(captures: DataFrame, rooms: DataFrame, openings: DataFrame, adjacent: DataFrame, key: str = "capture_id") -> DataFrame:
    """One nested row a capture: schema, tier, rooms, openings, adjacency, footprint."""

    def listed(d: DataFrame, name: str) -> DataFrame:
        """The rows of each capture, in the order of their columns (maps don't count)."""
        cols = [c for c in d.columns if c != key]
        order = F.struct(*[c for c in cols if not isinstance(d.schema[c].dataType, T.MapType)]).alias("o")
        before = lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0)
        rows = F.array_sort(F.collect_list(F.struct(order, F.struct(*cols).alias("v"))), before)
        return d.groupBy(key).agg(F.transform(rows, lambda x: x["v"]).alias(name))

    out = captures
    for d, name in ((rooms, "rooms"), (openings, "openings"), (adjacent, "adjacency")):
        out = out.join(listed(d, name), key, "left")
    return out.withColumn("schema", F.lit(SCHEMA))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def as_json(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def summaries(regions: DataFrame, rooms: DataFrame, inspected: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, summary: a line for what was inspected and one for each region, largest first, with the room's name."""
    r = regions.join(rooms.select(key, "room", "name"), [key, "room"], "left")
    line = F.format_string("%s: %s in %s, %.2f m2", F.col("damage_id"), F.col("class"), F.coalesce("name", F.col("room").cast("string"), F.lit("?")), F.col("area"))
    lines = r.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("area")).alias("o"), F.col("damage_id"), line.alias("l")))).alias("_l"))
    d = inspected.join(lines, key, "left")
    head = F.format_string("%.1f m2 inspected, %d regions", F.col("area"), F.coalesce(F.size("_l"), F.lit(0)))
    return d.select(key, F.concat_ws("\n", F.array(head), F.transform(F.coalesce("_l", F.expr("cast(array() as array<struct<o:double,damage_id:string,l:string>>)")), lambda x: x["l"])).alias("summary"))


def photo_manifest(frames: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, room, photos: which frames make a room's photo set."""
    return frames.groupBy(key, "room").agg(F.sort_array(F.collect_list("frame_id")).alias("photos"))
