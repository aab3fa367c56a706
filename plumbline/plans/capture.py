"""Plans: from a capture's points to its measured rooms; from photo folders to one plan; damage of a capture."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import priors
from ..functions.geometry import grid_index
from ..functions.intervals95 import LIDAR, ErrorModel, floor_sigma, measured, opening_ci
from ..operators import graph, plan2d, polygons, raster, robust, rooms, spatial

POINT_COLUMNS = ["u", "v", "h", "nu", "nv", "ny"]


@dataclass
class PlanTables:
    floor: DataFrame
    faces: DataFrame
    cells: DataFrame
    edges: DataFrame
    rooms: DataFrame
    openings: DataFrame
    adjacency: DataFrame
    ceilings: DataFrame
    windows: DataFrame
    outlines: DataFrame
    features: DataFrame
    types: DataFrame
    footprint: DataFrame
    objects: DataFrame


def instances(fixtures: DataFrame, rects: DataFrame, keys: list[str], *, least: float = 0.3) -> DataFrame:
    """keys, class, instance, u, v, views, room (null: in none): detections over ``least`` become objects, the surest first; one seen once is none."""
    d = fixtures.filter(F.col("conf") > least).select(*keys, "class", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"), (-F.col("conf")).alias("_o"))
    found = graph.greedy_instances(d, [*keys, "class"], ("u", "v"), ["_o", "u", "v"])
    return spatial.point_in_rectangles(found, rects, "u", "v", "room", "room", pad=0.05, keys=keys, how="left")


def plan_coordinates(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points (x, y, z, nx, ny, nz) in plan coordinates: height above the floor's mode, turned to the walls' directions."""
    fl = robust.floor_and_ceiling(points, "y", "ny", keys).select(*keys, "floor")
    yaw = robust.manhattan_yaw(points.filter(F.abs("ny") < 0.3), "nx", "nz", keys)
    p = points.join(fl, keys).join(yaw, keys) if keys else points.crossJoin(F.broadcast(fl)).crossJoin(F.broadcast(yaw))
    c, s = F.cos("yaw"), F.sin("yaw")
    turn = lambda a, b: (c * F.col(a) + s * F.col(b), c * F.col(b) - s * F.col(a))
    (u, v), (nu, nv) = turn("x", "z"), turn("nx", "nz")
    return p.withColumns({"u": u, "v": v, "h": F.col("y") - F.col("floor"), "nu": nu, "nv": nv}).drop("floor", "yaw")


def _evidence(points: DataFrame, floor: DataFrame, cameras: DataFrame | None, res: float, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(cells with floor, furniture tops or free space near the floor or the way, closed; cells of the camera's way)."""
    cell = lambda d: d.select(*keys, grid_index(F.col("v"), 0.0, res).alias("r"), grid_index(F.col("u"), 0.0, res).alias("c")).distinct()
    seen, walked = cell(floor), None
    sure = seen
    if cameras is not None:
        walked = raster.dilated(cell(cameras), raster.disk(max(1, round(0.1 / res)))).checkpoint()
        sure = raster.union(seen, walked)
    near = raster.dilated(sure, raster.disk(max(1, round(0.6 / res))))
    extra = cell(points.filter((F.col("ny") > 0.9) & F.col("h").between(0.08, 1.3)))
    if cameras is not None and "frame_id" in points.columns:
        hits = points.filter(F.col("h").between(0.4, 1.6)).select(*keys, "frame_id", F.col("u").alias("u1"), F.col("v").alias("v1")).join(cameras.select(*keys, "frame_id", F.col("u").alias("u0"), F.col("v").alias("v0")), [*keys, "frame_id"])
        extra = raster.union(extra, raster.ray_cells(hits, res, keys, stop_short=max(1, round(0.06 / res))))
    return raster.closed(raster.union(sure, raster.both(extra, near)), raster.disk(max(1, round(0.08 / res)))), walked


def _spaces(cells: DataFrame, edges: DataFrame, seen: DataFrame, walked: DataFrame | None, res: float, keys: list[str]) -> DataFrame:
    """Rooms cut at necks, then large ones by their cores; then voids go and slivers join their neighbours; numbered anew."""
    group = (F.col("room").cast("long") * F.lit(1 << 20) + F.col("part")).alias("_g")
    renamed = lambda d: graph.settled(plan2d.numbered(d.withColumn("_g", group).drop("room", "part"), "_g", keys, 0.0))
    cut = renamed(cells.join(plan2d.neck_splits(cells, edges, keys), [*keys, "room", "i", "j"]))
    cut = renamed(plan2d.split_by_cores(cut, edges, keys, res))
    by = [*keys, "room"]
    mask = raster.rectangle_cells(cut, res, by).checkpoint()
    region = cut.groupBy(*by).agg(F.sum((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))).alias("area"))
    region = region.join(raster.inscribed_width(mask, by, res).withColumnRenamed("inscribed_width", "width"), by).join(raster.overlap_share(mask, seen, keys, "room").withColumnRenamed("share", "seen"), by)
    region = region.join(raster.overlap_share(mask, walked, keys, "room").withColumnRenamed("share", "walked"), by) if walked is not None else region.withColumn("walked", F.lit(0.0))
    to = plan2d.cleaned_regions(region.withColumn("room", F.col("room").cast("long")).withColumnRenamed("room", "region"), plan2d.borders(cut, edges, keys), keys)
    named = cut.join(to.select(*keys, F.col("region").cast("int").alias("room"), "to"), [*keys, "room"]).drop("room")
    return plan2d.numbered(named, "to", keys, 0.0)


def plan_capture(points: DataFrame, keys: list[str], *, band: tuple[float, float] | None = None, res: float = 0.05, model: ErrorModel = LIDAR, cover: float = 0.55, cameras: DataFrame | None = None, fixtures: DataFrame | None = None) -> PlanTables:
    """points: keys, u, v, h, nu, nv, ny (plan coordinates) and, for free space, frame_id; cameras: keys, frame_id, u, v; fixtures: keys, u, v,
    class, conf (detections in single frames, which are gathered to objects). Faces, cut lines, the complex, rooms parted by barriers, necks and cores,
    openings, windows, outlines, dimensions, ceilings, features and types. Each key is a capture with a band of heights of its own; without keys give points a constant one."""
    walls = plan2d.wall_families(points, band or plan2d.height_bands(points, keys).checkpoint(), keys)
    faces, parts = plan2d.wall_faces(walls, keys, cover=cover)
    parts = parts.checkpoint()
    floor = points.filter((F.col("ny") > 0.9) & (F.abs("h") < 0.04))
    seen, walked = _evidence(points, floor, cameras, res, keys)
    seen = seen.checkpoint()
    bounds = points.groupBy(*keys).agg(F.min("u").cast("double").alias("u0"), F.max("u").cast("double").alias("u1"), F.min("v").cast("double").alias("v0"), F.max("v").cast("double").alias("v1"))
    cuts = plan2d.cut_coordinates(faces, bounds, keys)
    cells = plan2d.cell_fractions(plan2d.complex_cells(cuts, keys), seen, res, keys).checkpoint()
    edges = graph.settled(plan2d.classified_edges(plan2d.complex_edges(cells, keys), parts, keys))
    cells = plan2d.filled(cells, edges, keys).checkpoint()
    closed = plan2d.barrier(plan2d.oriented_walls(walls, keys, res), keys, int(priors.DOOR_MAX / res))
    found = graph.settled(plan2d.rooms_by_barrier(cells, edges, closed, res, keys))
    found = graph.settled(_spaces(found, edges, seen, walked, res, keys))
    openings = plan2d.room_openings(edges, found, keys)
    width = F.col("b") - F.col("a")
    openings = openings.withColumn("width", measured(width, opening_ci(F.col("kind"), width, model)))
    if walked is not None:
        mid = (F.col("a") + F.col("b")) / 2
        at = {"r": F.floor(F.when(F.col("axis") == "u", mid).otherwise(F.col("coord")) / res), "c": F.floor(F.when(F.col("axis") == "u", F.col("coord")).otherwise(mid) / res)}
        way = walked.select(*keys, "r", "c").distinct().withColumn("_walked", F.lit(True))
        openings = openings.withColumns(at).join(way, [*keys, "r", "c"], "left").withColumn("walked_through", F.coalesce("_walked", F.lit(False))).drop("r", "c", "_walked")
    openings = openings.checkpoint()
    bound = rooms.edge_faces(plan2d.boundary_edges(found, keys), faces, keys)
    measured_rooms = rooms.room_areas(found, rooms.room_dimensions(bound, keys, model), keys)
    rects = found.select(*keys, "room", "u0", "u1", "v0", "v1")
    down = points.filter(F.col("ny") < -0.95).select(*keys, "u", "v", "h", F.monotonically_increasing_id().alias("_id"))
    inside = spatial.point_in_rectangles(down, rects, "u", "v", "room", "room", keys=keys)
    floors = floor.groupBy(*keys).agg(floor_sigma(F.stddev_pop("h"), F.count("*")).alias("floor_sigma"))
    areas = found.groupBy(*keys, "room").agg(F.sum((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))).alias("area"))
    ceilings = rooms.room_ceilings(inside, areas, keys, floors, model)
    windows = plan2d.exterior_windows(plan2d.windows_of(parts, _wall_points(points, keys), keys), faces, found, keys, model)
    below = points.filter((F.col("ny") > 0.9) & (F.col("h") < -0.12) & (F.col("h") > -3.5))
    features = rooms.room_features(found, openings, keys, res=res, below=below, seen=seen, walked=walked)
    if fixtures is not None:
        objects = instances(fixtures, rects, keys).checkpoint()
    else:
        objects = found.select(*keys, F.lit("").alias("class"), F.lit(0).alias("instance"), F.lit(0.0).alias("u"), F.lit(0.0).alias("v"), F.lit(0).alias("views"), "room").limit(0)
    counted = objects.filter("room IS NOT NULL").groupBy(*keys, "room", "class").agg(F.count("*").alias("n"))
    return PlanTables(floor, faces, found, edges, measured_rooms, openings, plan2d.adjacency(openings, keys), ceilings, windows, polygons.simplified(plan2d.outlines(found, keys), 0.005), features, rooms.space_types(features, counted, keys), rooms.footprint(found, keys), objects)


def _wall_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points of vertical surfaces at any height over the floor, by axis."""
    return plan2d.wall_families(points, (0.1, 99.0), keys)
