"""One run from a capture's tables to its report: drift, plan, objects, damage, names, document and summary, as the options ask for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import priors
from ..functions.intervals95 import TIERS
from ..operators import polygons, register, rooms, windows
from ..sources import sinks
from ..sources.captures import Options
from .capture import PlanTables, plan_capture
from .damage import Damage, scan_damage
from .drift import corrections


@dataclass
class Capture:
    """What a run reads, each table with the key column. points: u, v, h, nu, nv, ny and frame_id; cameras: frame_id, u, v; detections: u, v, class, conf;
    pixels, probs and surfaces as scan_damage takes them, surfaces with a middle u, v from which their room is looked up."""

    points: DataFrame
    cameras: DataFrame | None = None
    detections: DataFrame | None = None
    pixels: DataFrame | None = None
    probs: DataFrame | None = None
    surfaces: DataFrame | None = None


@dataclass
class Report:
    plan: PlanTables
    rooms: DataFrame
    openings: DataFrame
    drift: DataFrame | None
    damage: Damage | None
    documents: DataFrame
    summaries: DataFrame | None


def straightened(capture: Capture, key: str, mode: str, *, segment: int = priors.DRIFT_SEGMENT, fps: float = 60.0) -> tuple[DataFrame, DataFrame | None]:
    """(points, drift report): in captures whose walls get better by it, all points moved by their frame's correction."""
    if mode == "off" or capture.cameras is None:
        return capture.points, None
    facing = F.greatest(F.abs("nu"), F.abs("nv"))
    axis = F.when(F.abs("nu") >= F.abs("nv"), "u").otherwise("v")
    walls = capture.points.filter((F.abs("ny") < 0.3) & (F.col("h") > 0.1) & (facing > 0.85)).select(key, F.col("frame_id").cast("long").alias("frame"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"), axis.alias("axis"))
    walls = walls.withColumn("at", F.when(F.col("axis") == "u", F.col("u")).otherwise(F.col("v"))).checkpoint()
    eyes = capture.cameras.select(key, F.col("frame_id").cast("long").alias("frame"), F.col("u").alias("cu"), F.col("v").alias("cv"))
    frames, _, report = corrections(walls, eyes, [key], segment=segment, fps=fps, mode=mode)
    report = report.checkpoint()
    frames = frames.join(report.filter("apply").select(key), key, "left_semi").withColumnRenamed("frame", "frame_id")
    p = capture.points.join(frames, [key, "frame_id"], "left").withColumns({"_u": F.col("u"), "_v": F.col("v")})
    turned, moved = register.corrected(p, "u", "v", "cu", "cv", "yaw", "du", "dv"), F.col("yaw").isNotNull()
    c, s = F.cos("yaw"), F.sin("yaw")
    new = {"u": F.col("u"), "v": F.col("v"), "nu": c * F.col("nu") - s * F.col("nv"), "nv": s * F.col("nu") + c * F.col("nv")}
    old = {"u": "_u", "v": "_v", "nu": "nu", "nv": "nv"}
    return turned.withColumns({x: F.when(moved, e).otherwise(F.col(old[x])) for x, e in new.items()}).select(*capture.points.columns).checkpoint(), report


def run(capture: Capture, options: Options | None = None, key: str = "capture_id", **more) -> Report:
    """Everything the options ask for, for every capture in the tables. ``more`` goes to plan_capture."""
    options = options or Options()
    keys, model = [key], TIERS[options.tier or "lidar"]
    points, drift = straightened(capture, key, options.drift)
    if options.step:
        points = points.filter(F.col("frame_id") % options.step == 0)
    plan = plan_capture(points, keys, model=model, cameras=capture.cameras, fixtures=capture.detections if options.detect else None, **more)
    kinds = windows.suffixed(plan.types.select(key, "room", "type"), "type", [F.col("room")], keys)
    kinds = windows.numbered(kinds, [F.col("room")], keys, "R")
    seen = rooms.sightings(plan.objects.filter("room IS NOT NULL").select(key, "room", "class", F.lit(1.0).alias("conf")), keys)
    table = plan.rooms.join(kinds, [key, "room"]).join(plan.ceilings.select(key, "room", "ceiling", F.col("ci95").alias("ceiling_ci95")), [key, "room"], "left").join(seen, [key, "room"], "left").join(plan.outlines, [key, "room"], "left").checkpoint()
    openings = windows.numbered(plan.openings, [F.col(c) for c in ("axis", "coord", "a")], keys, "O").checkpoint()
    damage = summaries = None
    if options.damage and capture.pixels is not None and capture.probs is not None and capture.surfaces is not None:
        surfaces = capture.surfaces
        if "room" not in surfaces.columns:
            surfaces = polygons.points_in_polygons(surfaces, plan.outlines, "u", "v", "room", "room", pad=0.15, keys=keys, how="left")
        damage = scan_damage(capture.pixels, capture.probs, surfaces, table.select(key, "room", "type"), plan.adjacency, plan.windows, keys)
        found = damage.regions.select(key, "damage_id", "class", "room", F.col("area.value").alias("area"))
        summaries = sinks.summaries(found, table, damage.inspected, key)
    head = plan.footprint.withColumn("tier", F.lit(options.tier or "lidar"))
    documents = sinks.plan_documents(head, table, openings.select(key, "id", "kind", "axis", "coord", "a", "b", "room_a", "room_b", "width"), plan.adjacency, key)
    return Report(plan, table, openings, drift, damage, documents, summaries)
