"""Photo tier: rooms measured folder by folder are put into one plan through the links between their photos."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import priors
from ..operators import plan2d, register, spatial


def placed_rooms(links: DataFrame, room_areas: DataFrame, key: str = "capture_id", *, residual: float = priors.LINK_RESIDUAL, inliers: int = 200) -> DataFrame:
    """key, room, parent, step, yaw, du, dv (null: unplaced): from the largest room on, the best-scored link to a placed room places the
    next; its transform is composed with that room's, turned to the nearest right angle. links: room_a, room_b, yaw, du, dv (b's
    coordinates in a's), inliers, residual; room_areas: room, area. The order of
    placing is that of one capture's links; the transforms are composed for all captures at once."""
    good = links.filter((F.col("residual") <= residual) & (F.col("inliers") >= inliers)).withColumn("score", register.link_score(F.col("inliers"), F.col("residual")))
    kind = room_areas.schema["room"].dataType.simpleString()

    def place(k0: tuple, areas: pd.DataFrame, ls: pd.DataFrame) -> pd.DataFrame:
        order = areas.sort_values(["area", "room"], ascending=[False, True])["room"].tolist()
        placed = {order[0]}
        rows = [(order[0], None, 0, 0.0, 0.0, 0.0)]
        near: dict = {}
        for r in ls.itertuples():
            near.setdefault(r.room_a, []).append((r.score, r.room_b, r.yaw, r.du, r.dv))
            c, s = math.cos(r.yaw), math.sin(r.yaw)  # the inverse, for b as parent
            near.setdefault(r.room_b, []).append((r.score, r.room_a, -r.yaw, -(c * r.du + s * r.dv), s * r.du - c * r.dv))
        front = [(-x[0], 0, k, order[0], x) for k, x in enumerate(near.get(order[0], ()))]
        heapq.heapify(front)
        while front:  # the best link of a placed room; of equal ones that of the room placed first
            _, _, _, p, (_, room, yaw, du, dv) = heapq.heappop(front)
            if room in placed:
                continue
            placed.add(room)
            rows.append((room, p, len(rows), round(yaw / (math.pi / 2)) * (math.pi / 2), du, dv))
            for k, x in enumerate(near.get(room, ())):
                heapq.heappush(front, (-x[0], len(rows) - 1, k, room, x))
        rows += [(r, None, None, None, None, None) for r in order if r not in placed]
        out = pd.DataFrame(rows, columns=["room", "parent", "step", "yaw", "du", "dv"])
        out["step"] = out["step"].astype("Int64")
        out.insert(0, key, k0[0])
        return out

    schema = f"`{key}` {room_areas.schema[key].dataType.simpleString()}, room {kind}, parent {kind}, step int, yaw double, du double, dv double"
    steps = room_areas.groupBy(key).cogroup(good.groupBy(key)).applyInPandas(place, schema).checkpoint()
    tree = steps.filter("step IS NOT NULL").select(key, "room", "parent", register.plan_transform(F.col("yaw"), F.col("du"), F.col("dv")).alias("m"))
    poses = register.composed_poses(tree, [key], "room").select(key, "room", F.atan2(F.col("m")[4], F.col("m")[0]).alias("yaw"), F.col("m")[3].alias("du"), F.col("m")[7].alias("dv"))
    return steps.select(key, "room", "parent", "step").join(poses, [key, "room"], "left")


def plan_photo_rooms(rects: DataFrame, links: DataFrame, key: str = "capture_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rects in plan coordinates with placed, overlaps, adjacency). rects: room, u0, u1, v0, v1 in the room's own coordinates. Rooms that no
    link reaches stand in a row beside the plan."""
    areas = rects.groupBy(key, "room").agg(F.sum((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))).alias("area"), (F.max("u1") - F.min("u0")).alias("width"), F.min("u0").alias("_u0"))
    pose = placed_rooms(links, areas.select(key, "room", "area"), key)
    p = rects.join(pose.filter("step is not null").select(key, "room", "yaw", "du", "dv"), [key, "room"])
    c, s = F.round(F.cos("yaw")), F.round(F.sin("yaw"))  # right angles only
    at = lambda u, v: (c * F.col(u) - s * F.col(v) + F.col("du"), s * F.col(u) + c * F.col(v) + F.col("dv"))
    (a, b), (d, e) = at("u0", "v0"), at("u1", "v1")
    placed = p.select(key, "room", F.least(a, d).alias("u0"), F.greatest(a, d).alias("u1"), F.least(b, e).alias("v0"), F.greatest(b, e).alias("v1"), F.lit(True).alias("placed"))
    end = placed.groupBy(key).agg(F.max("u1").alias("_end"))
    rest = plan2d.side_by_side(areas.join(pose.filter("step is null").select(key, "room"), [key, "room"]), [F.col("room")], [key]).join(end, key)
    moved = rects.join(rest.select(key, "room", (F.col("_end") + 1.0 + F.col("offset") - F.col("_u0")).alias("_by")), [key, "room"])
    aside = moved.select(key, "room", (F.col("u0") + F.col("_by")).alias("u0"), (F.col("u1") + F.col("_by")).alias("u1"), "v0", "v1", F.lit(False).alias("placed"))
    out = placed.unionByName(aside)
    overlaps = spatial.overlap_area(out, "room", keys=[key])
    near = pose.filter("parent is not null").select(key, F.array_sort(F.array("room", "parent")).alias("_p")).select(key, F.col("_p")[0].alias("a"), F.col("_p")[1].alias("b")).distinct()
    return out, overlaps, near


def global_ceiling(ceilings: DataFrame, key: str = "capture_id") -> DataFrame:
    return ceilings.groupBy(key).agg(F.median("ceiling").alias("ceiling"), F.count("ceiling").alias("rooms"))


