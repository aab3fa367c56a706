"""Drift correction: segments are laid on what was seen at other times, the chain is relaxed, frames are corrected, and a gate decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import priors
from ..operators import register, revisits, robust, selection, spatial, windows


def ghosting(points: DataFrame, keys: list[str], radius: float = 0.15, apart: float = priors.REVISIT_S) -> DataFrame:
    """keys, ghosting: the median distance to the nearest point seen long before or after. points: id, u, v, t."""
    d = revisits.revisit_distance(points, "id", ("u", "v"), "t", radius, apart, keys)
    return selection.quantiles(d.checkpoint(), F.sqrt("d2"), [0.5], keys, ["ghosting"])


def corrections(points: DataFrame, cameras: DataFrame, keys: list[str], *, segment: int = priors.DRIFT_SEGMENT, fps: float = 60.0, mode: str = "auto") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, walls, report): the cameras' frames with their corrections yaw, du, dv; the wall points so corrected; and what that does to ghosting and
    crispness, how many segments were anchored, and whether it applies. points: keys, frame, u, v, axis, at (wall points); cameras: keys, frame, cu, cv. The
    corrections are those of the segments' middles, interpolated to the frames."""
    seg = points.withColumn("segment", windows.segment_of(F.col("frame"), segment).cast("long"))
    found = register.anchors(seg.select(*keys, "segment", "u", "v"), keys=keys, segment_s=segment / fps)
    every = seg.select(*keys, "segment").distinct().join(found, [*keys, "segment"], "left").checkpoint()
    graph = register.pose_graph(every, keys=keys, values=["yaw", "du", "dv"], weight="weight").checkpoint().withColumn("frame", (F.col("segment") * segment + segment // 2).cast("long"))
    at = spatial.asof_interpolated(graph.drop("segment"), cameras, "frame", ["yaw", "du", "dv"], keys)
    new = register.corrected(points.join(at, [*keys, "frame"]), "u", "v", "cu", "cv", "yaw", "du", "dv").drop("cu", "cv", "yaw", "du", "dv")
    new = new.withColumn("at", F.when(F.col("axis") == "u", F.col("u")).otherwise(F.col("v")))
    both = [_state(d, keys, fps) for d in (points, new)]
    r = both[0].select(*keys, F.col("ghosting").alias("ghosting_raw"), F.col("crispness").alias("crispness_raw")).join(both[1], keys).withColumn("_mode", F.lit(mode))
    bent = graph.groupBy(*keys).agg(F.max(F.hypot("du", "dv")).alias("max_correction"), F.max(F.degrees(F.abs("yaw"))).alias("max_yaw_deg"))
    r = r.join(every.groupBy(*keys).agg(F.count("*").alias("segments"), F.count("weight").alias("anchors")), keys).join(bent, keys)
    return at, new, register.drift_gate(r, "ghosting_raw", "ghosting", "crispness_raw", "crispness", "_mode").drop("_mode")


def correct_drift(points: DataFrame, cameras: DataFrame, keys: list[str], *, segment: int = priors.DRIFT_SEGMENT, fps: float = 60.0, mode: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(points, report): the wall points, corrected in the captures where it applies; see corrections()."""
    _, new, report = corrections(points, cameras, keys, segment=segment, fps=fps, mode=mode)
    yes = report.filter("apply").select(*keys)
    kept = new.join(yes, keys, "left_semi").unionByName(points.join(yes, keys, "left_anti").select(*new.columns))
    return kept, report


def _state(points: DataFrame, keys: list[str], fps: float) -> DataFrame:
    p = points.withColumns({"t": F.col("frame") / fps, "id": F.xxhash64(*keys, "frame", "u", "v")})
    g = ghosting(p.select(*keys, "id", "u", "v", "t"), keys)
    return g.join(robust.crispness(points, "at", "axis", keys), keys)
