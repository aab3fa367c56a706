"""From wall points to rooms: faces, cut lines, the cell complex, its edges, rooms, outlines, openings and windows.

Coordinates are plan metres (u, v) and height h. A room is a set of complex cells (rectangles), so that areas, overlaps and outlines are
arithmetic on intervals. All tables carry the capture's keys; the complex of one capture has hundreds of cells.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import priors
from ..functions.intervals95 import LIDAR, ErrorModel, measured, opening_ci
from . import intervals, raster, robust, spatial
from .graph import cell_components, connected_components


def height_bands(points: DataFrame, keys: list[str], *, least: float = 0.25, most: float = 9.0, below: float = 0.15, rise: float = 1.8, enough: int = 2000) -> DataFrame:
    """keys, band_lo, band_hi: each capture's band of wall heights, up to the 97th percentile of its vertical surfaces or a little below its
    ceiling, if there is one, whichever is lower. points: plan coordinates (h, ny)."""
    high = robust.selection.quantiles(points.filter((F.abs("ny") < 0.3) & (F.col("h") > 0.1)), "h", [0.97], keys, ["_top"])
    down = robust.trimmed_mode(points.filter((F.col("ny") < -0.95) & (F.col("h") > rise)), "h", 0.01, 0.03, keys).filter(F.col("n") >= enough).select(*keys, F.col("value").alias("_ceiling"))
    both = high.join(down, keys, "left") if keys else high.join(F.broadcast(down), F.lit(True), "left")
    top = F.least(F.coalesce("_top", F.lit(most)), F.coalesce(F.col("_ceiling") - below, F.lit(most)))
    return both.select(*keys, F.lit(least).alias("band_lo"), top.cast("double").alias("band_hi"))


def wall_families(points: DataFrame, h_band: tuple[float, float] | DataFrame, keys: list[str], *, vertical: float = 0.3, facing: float = 0.85) -> DataFrame:
    """Points on walls as (axis, sign, at, along, h, band_lo, band_hi): axis u for planes of constant u; at is the plane's coordinate. The
    band is one for all, or each key's (height_bands)."""
    p = points.filter(F.abs("ny") < vertical)
    if isinstance(h_band, DataFrame):
        p = p.join(F.broadcast(h_band), keys) if keys else p.crossJoin(F.broadcast(h_band))  # a row of two numbers for each key
    else:
        p = p.withColumns({"band_lo": F.lit(float(h_band[0])), "band_hi": F.lit(float(h_band[1]))})
    p = p.filter((F.col("h") > F.col("band_lo")) & (F.col("h") < F.col("band_hi")))
    side = lambda n, at, along, axis: F.struct(F.col(n).cast("double").alias("n"), F.lit(axis).alias("axis"), F.signum(n).cast("int").alias("sign"), F.col(at).cast("double").alias("at"), F.col(along).cast("double").alias("along"))
    w = p.select(*keys, F.explode(F.array(side("nu", "u", "v", "u"), side("nv", "v", "u", "v"))).alias("_s"), F.col("h").cast("double").alias("h"), "band_lo", "band_hi").filter(F.abs("_s.n") > facing)
    return w.select(*keys, "_s.axis", "_s.sign", "_s.at", "_s.along", "h", "band_lo", "band_hi")


def wall_faces(walls: DataFrame, keys: list[str], *, width: float = 0.01, least: int = 60, reach: float = 0.03, column: float = 0.05, h_step: float = 0.15, cover: float = priors.WALL_COVERAGE, solid: float = priors.WALL_SOLID) -> tuple[DataFrame, DataFrame]:
    """(faces, face_intervals): peaks of the smoothed histogram of each family, with the mean, spread and count of what lies within
    ``reach`` of the peak, and the solid intervals: columns along the wall, closed over small gaps, whose height is covered."""
    fam = [*keys, "axis", "sign"]
    hist = robust.histogram(walls, "at", width, fam)
    ends = hist.groupBy(*fam).agg(F.first("lo").alias("lo"), F.greatest(F.ceil((F.first("hi") - F.first("lo")) / width), F.lit(1)).cast("long").alias("bins"))
    s = robust.smoothed(hist.join(ends.select(*fam, "bins"), fam).select(*fam, "bin", "n", "bins"), F.col("bins"), 1.2, fam)
    peaks = robust.local_peaks(s.withColumn("bin", F.col("bin").cast("long")), "bin", "s", fam, 4, 30.0)
    peaks = peaks.join(ends, fam).select(*fam, (F.col("lo") + (F.col("bin") + 0.5) * width).alias("peak")).checkpoint()  # some dozens a capture
    near = walls.withColumn("_b", F.floor(F.col("at") / reach)).join(peaks.withColumn("_b", F.explode(F.sequence(F.floor((F.col("peak") - reach) / reach), F.floor((F.col("peak") + reach) / reach)))), [*fam, "_b"]).filter(F.abs(F.col("at") - F.col("peak")) < reach).drop("_b").checkpoint()  # read several times for medians and columns
    face = [*fam, "peak"]
    stats = robust.inlier_stats(near, "at", reach, face).filter(F.col("n") >= least)
    cols = robust.height_coverage(near.withColumn("col", F.floor(F.col("along") / column)), [*face, "col"], F.col("h"), F.col("band_lo"), F.col("band_hi"), h_step).filter(F.col("coverage") >= cover)
    runs = intervals.closed_runs(cols, "col", face, 2, column, 0.25).checkpoint()
    length = runs.groupBy(*face).agg(F.sum(F.col("b") - F.col("a")).alias("length")).filter(F.col("length") >= solid)
    faces = stats.join(length, face).select(*keys, "axis", "sign", "peak", F.col("mean").alias("coord"), "std", "n", "length")
    order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    faces = faces.withColumn("face_id", F.row_number().over(order.orderBy("axis", "coord", "sign", "peak"))).checkpoint()
    parts = runs.join(faces.select(*face, "face_id", "coord"), face).select(*keys, "face_id", "axis", "sign", "coord", "a", "b")
    return faces.drop("peak"), parts


def cut_coordinates(faces: DataFrame, bounds: DataFrame, keys: list[str], merge: float = 0.035, pad: float = 0.05) -> DataFrame:
    """keys, axis, ord, coord: the faces' merged planes and the observed bounds (u0, u1, v0, v1), padded."""
    lines = intervals.cut_lines(faces, "coord", "length", [*keys, "axis"], merge).select(*keys, "axis", "coord")
    ends = bounds.select(*keys, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), (F.col(c) + s * pad).alias("coord")) for a, c, s in (("u", "u0", -1), ("u", "u1", 1), ("v", "v0", -1), ("v", "v1", 1))])).alias("_e")).select(*keys, "_e.*")
    w = Window.partitionBy(*keys, "axis").orderBy("coord")
    return lines.unionByName(ends).distinct().withColumn("ord", F.row_number().over(w) - 1)


def complex_cells(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, j, u0, u1, v0, v1: products of consecutive cuts."""
    nxt = cuts.withColumn("_to", F.lead("coord").over(Window.partitionBy(*keys, "axis").orderBy("ord"))).filter(F.col("_to").isNotNull())
    one = lambda axis, n, a, b: nxt.filter(F.col("axis") == axis).select(*keys, F.col("ord").alias(n), F.col("coord").alias(a), F.col("_to").alias(b))
    u, v = one("u", "i", "u0", "u1"), one("v", "j", "v0", "v1")
    return u.join(v, keys) if keys else u.crossJoin(F.broadcast(v))  # the cuts of one capture


def cell_fractions(cells: DataFrame, evidence: DataFrame, res: float, keys: list[str]) -> DataFrame:
    """cells with fr: the share of a cell's area with evidence (raster r, c), by four lookups in the evidence's summed-area table."""
    lo, hi = (lambda c: F.ceil(F.col(c) / res - 0.5)), (lambda c: F.ceil(F.col(c) / res - 0.5) - 1)
    boxes = cells.select(*keys, "i", "j", lo("v0").alias("r0"), hi("v1").alias("r1"), lo("u0").alias("c0"), hi("u1").alias("c1"))
    n = raster.box_sums(evidence.select(*keys, "r", "c"), boxes, keys, ["i", "j"]).withColumnRenamed("n", "_n")
    area = (F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))
    return cells.join(n, [*keys, "i", "j"], "left").withColumn("fr", F.coalesce(F.col("_n") * res * res / area, F.lit(0.0))).drop("_n")


def complex_edges(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, axis, line, ord, i, j, i2, j2, coord, a, b: edges between neighbouring cells; axis is that of the line they lie on."""
    other = cells.select(*keys, F.col("i").alias("i2"), F.col("j").alias("j2"))
    right = cells.withColumns({"i2": F.col("i") + 1, "j2": F.col("j")}).join(other, [*keys, "i2", "j2"]).select(*keys, F.lit("u").alias("axis"), F.col("i2").alias("line"), F.col("j").alias("ord"), "i", "j", "i2", "j2", F.col("u1").alias("coord"), F.col("v0").alias("a"), F.col("v1").alias("b"))
    up = cells.withColumns({"i2": F.col("i"), "j2": F.col("j") + 1}).join(other, [*keys, "i2", "j2"]).select(*keys, F.lit("v").alias("axis"), F.col("j2").alias("line"), F.col("i").alias("ord"), "i", "j", "i2", "j2", F.col("v1").alias("coord"), F.col("u0").alias("a"), F.col("u1").alias("b"))
    return right.unionByName(up)


def jambs(parts: DataFrame, lines: DataFrame, keys: list[str], *, least: float = 0.8, reach: float = 0.1, half: float = 0.005) -> DataFrame:
    """keys, axis, line, a, b: where the long faces that run across a line meet it, or end just before it: what a door beside a corner closes
    against. lines: axis, line, coord; parts: the faces' solid intervals."""
    size = 1.0
    long = parts.groupBy(*keys, "face_id").agg(F.sum(F.col("b") - F.col("a")).alias("_len")).filter(F.col("_len") >= least).drop("_len")
    p = parts.join(long, [*keys, "face_id"], "left_semi").select(*keys, F.when(F.col("axis") == "u", "v").otherwise("u").alias("axis"), F.col("coord").alias("_at"), (F.col("a") - reach).alias("_lo"), (F.col("b") + reach).alias("_hi"))
    p = p.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor(F.col("_hi") / size))))
    on = lines.withColumn("_bin", F.floor(F.col("coord") / size)).join(p, [*keys, "axis", "_bin"]).filter((F.col("coord") >= F.col("_lo")) & (F.col("coord") <= F.col("_hi")))
    return on.select(*keys, "axis", "line", (F.col("_at") - half).alias("a"), (F.col("_at") + half).alias("b")).distinct()


def classified_edges(edges: DataFrame, parts: DataFrame, keys: list[str], *, near: float = 0.04, touch: float = 0.03, cover: float = 0.5, door: tuple[float, float] = (priors.DOOR_MIN, priors.DOOR_MAX), collinear: float = 0.5) -> DataFrame:
    """edges with covered, gap_a, gap_b and kind: door if the line's wall has a gap at the edge's middle, bounded on both sides by wall or jambs
    (on one by wall of the line itself), of a door's width, on a line with enough wall; wall if solid intervals cover over half of the
    edge; else open."""
    line = [*keys, "axis", "line"]
    lines = edges.select(*line, "coord").distinct()
    p = parts.select(*keys, "axis", F.col("coord").alias("_pc"), F.col("a").alias("_pa"), F.col("b").alias("_pb"))
    p = p.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("_pc") - near) / near), F.floor((F.col("_pc") + near) / near))))
    on = lines.withColumn("_bin", F.floor(F.col("coord") / near)).join(p, [*keys, "axis", "_bin"]).filter(F.abs(F.col("coord") - F.col("_pc")) < near)
    on = intervals.merged(on.select(*line, F.col("_pa").alias("a"), F.col("_pb").alias("b")), "a", "b", line)
    walls = on.groupBy(*line).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_w"))
    across = jambs(parts, lines, keys).groupBy(*line).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_j"))
    none = F.expr("cast(array() as array<struct<a:double,b:double>>)")
    e = edges.join(walls, line, "left").join(across, line, "left").withColumns({"_w": F.coalesce("_w", none), "_j": F.coalesce("_j", none)})
    e = e.withColumn("_j", F.concat("_w", "_j"))
    mid = (F.col("a") + F.col("b")) / 2
    part = F.aggregate("_w", F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0.0), F.least(F.col("b"), x["b"]) - F.greatest(F.col("a"), x["a"])))
    lo = F.array_max(F.transform(F.filter("_j", lambda x: x["b"] <= mid + 1e-9), lambda x: x["b"]))
    hi = F.array_min(F.transform(F.filter("_j", lambda x: x["a"] >= mid - 1e-9), lambda x: x["a"]))
    total = F.aggregate("_w", F.lit(0.0), lambda s, x: s + x["b"] - x["a"])
    e = e.withColumns({"covered": part / (F.col("b") - F.col("a")), "gap_a": lo, "gap_b": hi, "_t": total})
    gap = F.col("gap_b") - F.col("gap_a")
    free = ~F.exists("_w", lambda x: (x["a"] < mid) & (x["b"] > mid))
    own = F.exists("_w", lambda x: (x["b"] - x["a"] > 0.02) & ((F.abs(x["b"] - F.col("gap_a")) < touch) | (F.abs(x["a"] - F.col("gap_b")) < touch)))
    doorway = F.coalesce(free & own & (gap >= door[0] - 1e-9) & (gap <= door[1] + 1e-9) & (F.col("_t") >= collinear), F.lit(False))
    kind = F.when(doorway, "door").when(F.col("covered") > cover, "wall").otherwise("open")
    return e.withColumn("kind", kind).drop("_w", "_j", "_t")


def filled(cells: DataFrame, edges: DataFrame, keys: list[str], *, inside: float = 0.5, rounds: int = 4, some: float = 0.08) -> DataFrame:
    """cells with inside: those with fr over ``inside``; then, in so many synchronous rounds, those with three inside neighbours over open
    edges, or two and a little evidence."""
    now = cells.withColumn("inside", F.col("fr") > inside)
    cid = ["i", "j"]
    links = edges.filter(F.col("kind") == "open").select(*keys, "i", "j", "i2", "j2")
    links = links.unionByName(links.select(*keys, F.col("i2").alias("i"), F.col("j2").alias("j"), F.col("i").alias("i2"), F.col("j").alias("j2")))
    for _ in range(rounds):
        on = now.filter("inside").select(*keys, F.col("i").alias("i2"), F.col("j").alias("j2"))
        n = links.join(on, [*keys, "i2", "j2"]).groupBy(*keys, *cid).agg(F.count("*").alias("_n"))
        now = now.join(n, [*keys, *cid], "left").withColumn("inside", F.col("inside") | (F.coalesce("_n", F.lit(0)) >= 3) | ((F.coalesce("_n", F.lit(0)) >= 2) & (F.col("fr") > some))).drop("_n")
    return now


def numbered(cells: DataFrame, group: str, keys: list[str], least: float = priors.SPACE_MIN_AREA) -> DataFrame:
    """cells with room (1, 2, ... in the order of the groups' lowest cells) for their group; cells of no group, and groups under ``least``, go."""
    r = cells.filter(F.col(group).isNotNull())
    g = r.groupBy(*keys, group).agg(F.sum((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))).alias("_area"), F.min(F.struct("i", "j")).alias("_first")).filter(F.col("_area") >= least)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    g = g.select(*keys, F.col(group).alias("_g"), F.row_number().over(w.orderBy("_first")).alias("_room"))
    out = r.withColumn("_g", F.col(group)).join(g, [*keys, "_g"]).drop("_g", group)
    return out.withColumnRenamed("_room", "room")


def rooms_of(cells: DataFrame, edges: DataFrame, keys: list[str], least: float = priors.SPACE_MIN_AREA) -> DataFrame:
    """Inside cells with room: joined over open edges; rooms under ``least`` go."""
    name = lambda i, j: (F.col(i) * F.lit(1 << 20) + F.col(j)).cast("long")
    ins = cells.filter("inside").withColumn("node", name("i", "j"))
    links = edges.filter(F.col("kind") == "open").select(*keys, name("i", "j").alias("a"), name("i2", "j2").alias("b"))
    ok = ins.select(*keys, "node")
    links = links.join(ok.withColumnRenamed("node", "a"), [*keys, "a"], "left_semi").join(ok.withColumnRenamed("node", "b"), [*keys, "b"], "left_semi")
    comp = connected_components(links, keys=keys)
    r = ins.join(comp, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))
    return numbered(r, "component", keys, least).drop("node")


def rooms_by_barrier(cells: DataFrame, edges: DataFrame, closed: DataFrame, res: float, keys: list[str], *, core: float = 0.6, half: float = 0.05, least: float = priors.SPACE_MIN_AREA) -> DataFrame:
    """Inside cells with room: the plan's raster without its barrier (closed: keys, r, c) and without the wall and door edges falls into
    connected pieces; a cell belongs to the piece, of ``core`` square metres or more, that holds most of it, a cell without one to the
    neighbour with the longest open edge."""
    ins = cells.filter("inside")
    own = raster.rectangle_cells(ins, res, [*keys, "i", "j"])
    grow = max(half, res)
    c, a, b = F.col("coord"), F.col("a"), F.col("b")
    wall = edges.filter("kind <> 'open'").select(*keys, F.when(F.col("axis") == "u", c - grow).otherwise(a).alias("u0"), F.when(F.col("axis") == "u", c + grow).otherwise(b).alias("u1"), F.when(F.col("axis") == "u", a).otherwise(c - grow).alias("v0"), F.when(F.col("axis") == "u", b).otherwise(c + grow).alias("v1"))
    cell = [*keys, "r", "c"]
    free = own.join(closed.select(*cell).unionByName(raster.rectangle_cells(wall, res, keys)).distinct(), cell, "left_anti").checkpoint()
    piece = cell_components(free.select(*cell).distinct(), "r", "c", keys, diagonal=False)
    large = piece.groupBy(*keys, "component").agg(F.count("*").alias("_n")).filter(F.col("_n") * res * res >= core).drop("_n")
    most = free.join(piece.join(large, [*keys, "component"], "left_semi"), cell).groupBy(*keys, "i", "j", "component").agg(F.count("*").alias("_n"))
    most = most.groupBy(*keys, "i", "j").agg(F.max_by("component", F.struct("_n", -F.col("component"))).alias("room"))
    labelled = orphans_joined(ins.join(most, [*keys, "i", "j"], "left"), edges, keys)
    return numbered(labelled.withColumnRenamed("room", "piece"), "piece", keys, least)


def borders(cells: DataFrame, edges: DataFrame, keys: list[str], region: str = "room") -> DataFrame:
    """keys, a, b, length: how long different regions of cells border on each other; a is the lower one."""
    of = lambda i, j, n: cells.select(*keys, F.col("i").alias(i), F.col("j").alias(j), F.col(region).cast("long").alias(n))
    e = edges.select(*keys, "i", "j", "i2", "j2", (F.col("b") - F.col("a")).alias("_len"))
    e = e.join(of("i", "j", "_x"), [*keys, "i", "j"]).join(of("i2", "j2", "_y"), [*keys, "i2", "j2"]).filter("_x <> _y")
    return e.groupBy(*keys, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).agg(F.sum("_len").alias("length"))


def orphans_joined(cells: DataFrame, edges: DataFrame, keys: list[str], rounds: int = 3) -> DataFrame:
    """cells (room null: orphan): an orphan takes the room it shares the longest open edge with; synchronous rounds, ties to the lower room."""
    e = edges.filter(F.col("kind") == "open").select(*keys, "i", "j", "i2", "j2", (F.col("b") - F.col("a")).alias("len"))
    e = e.unionByName(e.select(*keys, F.col("i2").alias("i"), F.col("j2").alias("j"), F.col("i").alias("i2"), F.col("j").alias("j2"), "len"))
    now = cells
    for _ in range(rounds):
        has = now.filter(F.col("room").isNotNull()).select(*keys, F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("room").alias("_room"))
        shared = e.join(has, [*keys, "i2", "j2"]).groupBy(*keys, "i", "j", "_room").agg(F.sum("len").alias("len"))
        best = shared.groupBy(*keys, "i", "j").agg(F.max_by("_room", F.struct("len", -F.col("_room"))).alias("_room"))
        now = now.join(best, [*keys, "i", "j"], "left").withColumn("room", F.coalesce("room", "_room")).drop("_room")
    return now


def room_openings(edges: DataFrame, rooms: DataFrame, keys: list[str], least: float = 0.45) -> DataFrame:
    """keys, axis, coord, a, b, room_a, room_b, kind (door up to a door's width, else opening): runs of edges without wall between the same two
    rooms; a is the lower room."""
    r = lambda i, j, n: rooms.select(*keys, F.col("i").alias(i), F.col("j").alias(j), F.col("room").alias(n))
    e = edges.filter(F.col("kind") != "wall").join(r("i", "j", "_r1"), [*keys, "i", "j"]).join(r("i2", "j2", "_r2"), [*keys, "i2", "j2"]).filter("_r1 <> _r2")
    e = e.withColumns({"room_a": F.least("_r1", "_r2"), "room_b": F.greatest("_r1", "_r2")})
    runs = intervals.opening_runs(e.withColumns({"lo": F.coalesce("gap_a", "a"), "hi": F.coalesce("gap_b", "b")}), "ord", [*keys, "axis", "line", "coord", "room_a", "room_b"], "lo", "hi")
    kind = F.when(F.col("b") - F.col("a") <= priors.DOOR_MAX + 1e-9, "door").otherwise("opening")
    return runs.filter(F.col("b") - F.col("a") >= least).select(*keys, "axis", "coord", "a", "b", "room_a", "room_b", kind.alias("kind"))


def adjacency(openings: DataFrame, keys: list[str]) -> DataFrame:
    pair = F.array_sort(F.array("room_a", "room_b"))
    return openings.select(*keys, pair[0].alias("a"), pair[1].alias("b")).filter("a <> b").distinct()


def boundary_edges(rooms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, room, axis, coord, a, b, side: unit edges of a room's cells that no other cell of the room shares; side points outwards."""
    four = F.array(
        F.struct(F.lit("u").alias("axis"), F.col("i").alias("line"), F.col("j").alias("ord"), F.col("u0").alias("coord"), F.col("v0").alias("a"), F.col("v1").alias("b"), F.lit(-1).alias("side")),
        F.struct(F.lit("u").alias("axis"), (F.col("i") + 1).alias("line"), F.col("j").alias("ord"), F.col("u1").alias("coord"), F.col("v0").alias("a"), F.col("v1").alias("b"), F.lit(1).alias("side")),
        F.struct(F.lit("v").alias("axis"), F.col("j").alias("line"), F.col("i").alias("ord"), F.col("v0").alias("coord"), F.col("u0").alias("a"), F.col("u1").alias("b"), F.lit(-1).alias("side")),
        F.struct(F.lit("v").alias("axis"), (F.col("j") + 1).alias("line"), F.col("i").alias("ord"), F.col("v1").alias("coord"), F.col("u0").alias("a"), F.col("u1").alias("b"), F.lit(1).alias("side")),
    )
    e = rooms.select(*keys, "room", F.explode(four).alias("_e")).select(*keys, "room", "_e.*")
    return e.groupBy(*keys, "room", "axis", "line", "ord").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("coord", "a", "b", "side")]).filter("_n = 1").drop("_n", "line", "ord")


def outlines(rooms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, room, polygon: the outer ring of each room, collinear vertices dropped, counter-clockwise from the lowest (u, v)."""
    head = "".join(f"`{k}` {rooms.schema[k].dataType.simpleString()}, " for k in keys)

    def ring(pdf: pd.DataFrame) -> pd.DataFrame:
        nxt: dict[tuple[float, float], list[tuple[float, float]]] = {}
        for axis, c, a, b, side in pdf[["axis", "coord", "a", "b", "side"]].itertuples(index=False):
            p, q = ((c, a), (c, b)) if axis == "u" else ((a, c), (b, c))
            if (axis == "u") == (side < 0):
                p, q = q, p
            nxt.setdefault(p, []).append(q)
        start = p = min(nxt)
        path, before = [start], None
        while True:
            options = nxt[p]
            if before is not None and len(options) > 1:  # at a corner that touches itself, turn left
                turn = lambda q: math.atan2((p[0] - before[0]) * (q[1] - p[1]) - (p[1] - before[1]) * (q[0] - p[0]), (p[0] - before[0]) * (q[0] - p[0]) + (p[1] - before[1]) * (q[1] - p[1]))  # noqa: B023, E731
                options.sort(key=turn)
            q = options.pop()
            before, p = p, q
            if p == start:
                break
            path.append(p)
        n = len(path)
        keep = [x for k, x in enumerate(path) if abs((x[0] - path[k - 1][0]) * (path[(k + 1) % n][1] - x[1]) - (x[1] - path[k - 1][1]) * (path[(k + 1) % n][0] - x[0])) > 1e-9]
        row = {k: [pdf[k].iloc[0]] for k in keys} | {"room": [pdf["room"].iloc[0]], "polygon": [[list(map(float, x)) for x in keep]]}
        return pd.DataFrame(row)

    return boundary_edges(rooms, keys).groupBy(*keys, "room").applyInPandas(ring, f"{head}room int, polygon array<array<double>>")


def cleaned_regions(regions: DataFrame, borders: DataFrame, keys: list[str], *, seen: float = 0.12, walked: float = 0.02, void: float = 6.0, width: float = priors.SPACE_MIN_WIDTH, area: float = priors.SPACE_MIN_AREA, shared: float = 0.3) -> DataFrame:
    """keys, region, to (null: dropped): unseen, unwalked regions under ``void`` go; then, one at a time from the smallest on, slivers (too
    narrow or too small) join the neighbour with the longest border, if over ``shared``. regions: region, area, width, seen, walked;
    borders: a, b, length. A capture's regions, in one task, as each change restarts the search."""
    head = "".join(f"`{k}` {regions.schema[k].dataType.simpleString()}, " for k in keys)

    def run(key: tuple, reg: pd.DataFrame, bor: pd.DataFrame) -> pd.DataFrame:
        live = {r.region: [r.area, r.width] for r in reg.itertuples() if not (r.seen < seen and r.walked < walked and r.area < void)}
        to = {r: (r if r in live else None) for r in reg["region"]}
        edge: dict[tuple, float] = {}
        for r in bor.itertuples():
            if r.a in live and r.b in live:
                k = (min(r.a, r.b), max(r.a, r.b))
                edge[k] = edge.get(k, 0) + r.length
        changed = True
        while changed:
            changed = False
            for r in sorted(live, key=lambda x: (live[x][0], x)):
                if live[r][1] >= width and live[r][0] >= area:
                    continue
                near = sorted(((n, -(set(k) - {r}).pop(), (set(k) - {r}).pop()) for k, n in edge.items() if r in k), reverse=True)
                if not near or near[0][0] <= shared:
                    continue
                other = near[0][2]
                live[other] = [live[other][0] + live[r][0], max(live[other][1], live[r][1])]
                del live[r]
                to = {x: other if y == r else y for x, y in to.items()}
                joined: dict[tuple, float] = {}
                for (a, b), n in edge.items():
                    a, b = other if a == r else a, other if b == r else b
                    if a != b:
                        joined[min(a, b), max(a, b)] = joined.get((min(a, b), max(a, b)), 0) + n
                edge, changed = joined, True
                break
        out = pd.DataFrame({"region": list(to), "to": pd.array([to[r] for r in to], dtype="Int64")})
        for k, v in zip(reversed(keys), reversed(key), strict=True):
            out.insert(0, k, v)
        return out

    fresh = lambda d: d.select(*[F.col(c).alias(c) for c in d.columns])  # noqa: E731  new columns: both tables may stem from one
    return fresh(regions).groupBy(*keys).cogroup(fresh(borders).groupBy(*keys)).applyInPandas(run, f"{head}region long, to long")


def neck_splits(rooms: DataFrame, edges: DataFrame, keys: list[str], *, most: float = priors.NECK_MAX, least_area: float = priors.NECK_MIN_AREA) -> DataFrame:
    """rooms' cells with part: a room is cut along the narrowest line whose cross-section (of edges without wall, doors too) is at most ``most`` and that
    leaves two parts of ``least_area`` or more; every part that the cut leaves is looked at again, small ones too. A room has a few hundred cells."""
    e = edges.filter(F.col("kind") != "wall").select(*keys, "axis", "line", "i", "j", "i2", "j2", (F.col("b") - F.col("a")).alias("len"))
    fresh = lambda *names: rooms.select(*[F.col(c).alias(c) for c in names])  # noqa: E731  new columns: cells and edges stem from the same table
    ra = fresh(*keys, "i", "j", "room")
    e = e.join(ra, [*keys, "i", "j"]).join(ra.select(*keys, F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("room").alias("_r2")), [*keys, "i2", "j2"]).filter("room = _r2").drop("_r2")
    cells = fresh(*keys, "room", "i", "j", "u0", "u1", "v0", "v1").select(*keys, "room", "i", "j", ((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))).alias("cell_area"))
    head = "".join(f"`{k}` {rooms.schema[k].dataType.simpleString()}, " for k in keys)

    def run(key: tuple, cs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        area = {(r.i, r.j): r.cell_area for r in cs.itertuples()}
        links = [((r.i, r.j), (r.i2, r.j2), (r.axis, r.line), r.len) for r in es.itertuples()]

        def parts(members: set, without: tuple | None) -> list[set]:
            near: dict = {m: [] for m in members}
            for a, b, line, _ in links:
                if a in members and b in members and line != without:
                    near[a].append(b)
                    near[b].append(a)
            out, left = [], set(members)
            while left:
                stack, own = [left.pop()], set()
                while stack:
                    x = stack.pop()
                    own.add(x)
                    for y in near[x]:
                        if y in left:
                            left.remove(y)
                            stack.append(y)
                out.append(own)
            return sorted(out, key=lambda s: (-sum(area[c] for c in s), min(s)))

        def split(members: set) -> list[set]:
            width: dict[tuple, float] = {}
            for a, b, line, n in links:
                if a in members and b in members:
                    width[line] = width.get(line, 0) + n
            for line in sorted((x for x in width if width[x] <= most), key=lambda x: (width[x], x)):
                p = parts(members, line)
                if len(p) > 1 and sum(area[c] for c in p[1]) >= least_area:
                    return [q for part in p for q in split(part)]
            return [members]

        found = sorted(split(set(area)), key=min) if area else []
        rows = [(c[0], c[1], k) for k, s in enumerate(found) for c in sorted(s)]
        out = pd.DataFrame(rows, columns=["i", "j", "part"])
        for k, v in zip(reversed([*keys, "room"]), reversed(key), strict=True):
            out.insert(0, k, v)
        return out

    kind = rooms.schema["room"].dataType.simpleString()
    return cells.groupBy(*keys, "room").cogroup(e.groupBy(*keys, "room")).applyInPandas(run, f"{head}room {kind}, i int, j int, part int")


def core_splits(cells: DataFrame, keys: list[str], res: float, *, from_area: float = 15.0, radii: tuple[float, ...] = (0.65, 0.75, 0.85), boundary: float = 2.2, least_area: float = 3.0, least_core: float = 0.0) -> DataFrame:
    """Raster cells (keys, r, c) of regions with part: for the first radius at which the cells farther than it from the wall fall into several cores (of
    ``least_core`` or more), the region is flooded from them; kept if the parts are large and no two share a long border, and then every part is looked
    at again. A region is a room: one task each."""
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*keys, "r", "c").schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        import numpy as np

        def around(i: int, j: int, of: np.ndarray) -> list[tuple[int, int]]:
            return [(a, b) for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if 0 <= a < of.shape[0] and 0 <= b < of.shape[1] and of[a, b]]

        def cores(inner: np.ndarray) -> tuple[np.ndarray, int]:
            label, n = np.zeros(inner.shape, np.int64), 0
            for i, j in zip(*np.nonzero(inner), strict=True):
                if label[i, j]:
                    continue
                own, stack = [(i, j)], [(i, j)]
                label[i, j] = n + 1
                while stack:
                    for p in around(*stack.pop(), inner):
                        if not label[p]:
                            label[p] = n + 1
                            own.append(p)
                            stack.append(p)
                if len(own) * res * res >= least_core:
                    n += 1
                else:
                    label[tuple(zip(*own, strict=True))] = -1  # too small; taken back below
            return np.maximum(label, 0), n

        def flooded(m: np.ndarray) -> np.ndarray | None:
            """Numbers (1, 2, ...) of the parts of a mask, if it falls into parts."""
            if m.sum() * res * res < from_area:
                return None
            depth = raster._distance(m) * res
            for radius in radii:
                label, n = cores(depth >= radius)
                if n < 2:
                    continue
                front = [(-depth[i, j], k, i, j) for k, (i, j) in enumerate(zip(*np.nonzero(label), strict=True))]
                heapq.heapify(front)
                k = len(front)
                while front:
                    _, _, i, j = heapq.heappop(front)
                    for p in around(i, j, m):
                        if not label[p]:
                            label[p] = label[i, j]
                            k += 1
                            heapq.heappush(front, (-depth[p], k, *p))
                label[m & (label == 0)] = 1  # what no core reaches (behind walls inside the region) stays with the first
                sizes = np.bincount(label[m], minlength=n + 1)[1:] * res * res
                pairs = [(label[1:], label[:-1]), (label[:, 1:], label[:, :-1])]
                shared = np.concatenate([np.stack((np.minimum(x, y), np.maximum(x, y)))[:, (x != y) & (x > 0) & (y > 0)] for x, y in pairs], 1)
                longest = np.unique(shared, axis=1, return_counts=True)[1].max(initial=0) * res
                if sizes.min() >= least_area and 0 < longest <= boundary:
                    return label
            return None

        pdf = pdf.sort_values(["r", "c"])
        m, r, c = raster._mask(pdf)
        found, todo, n = np.zeros(m.shape, np.int64), [m], 0
        while todo:
            now = todo.pop()
            label = flooded(now)
            if label is None:
                found[now] = n
                n += 1
            else:
                todo += [label == k for k in range(label.max(), 0, -1)]
        return pdf[[*keys, "r", "c"]].assign(part=found[r, c])

    return cells.groupBy(*keys).applyInPandas(run, f"{head}, part long")


def split_by_cores(rooms: DataFrame, edges: DataFrame, keys: list[str], res: float, *, from_area: float = 15.0) -> DataFrame:
    """rooms' cells with part: large rooms are rastered, walls inside them burnt in, and split by their cores; a cell goes with most of its raster."""
    by = [*keys, "room"]
    fresh = rooms.select(*[F.col(c).alias(c) for c in rooms.columns])  # new columns: rooms and edges stem from the same table
    size = F.sum((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0")))
    large = fresh.join(fresh.groupBy(*by).agg(size.alias("_area")).filter(F.col("_area") >= from_area).select(*by), by, "left_semi").checkpoint()
    if large.isEmpty():
        return rooms.withColumn("part", F.lit(0).cast("long"))
    w = edges.filter(F.col("kind") == "wall").select(*keys, "axis", F.col("coord").cast("double").alias("coord"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    at = lambda axis, lo, hi: F.when(F.col("axis") == axis, F.col("coord") + (res if hi else -res)).otherwise(F.col("b" if hi else "a"))
    walls = raster.rectangle_cells(w.select(*keys, at("u", 0, 0).alias("u0"), at("u", 0, 1).alias("u1"), at("v", 0, 0).alias("v0"), at("v", 0, 1).alias("v1")), res, keys)
    fine = raster.rectangle_cells(large, res, [*by, "i", "j"]).checkpoint()
    free = fine.select(*by, "r", "c").distinct().join(walls.select(*[F.col(c).alias(c) for c in (*keys, "r", "c")]), [*keys, "r", "c"], "left_anti")
    parts = core_splits(free, by, res, from_area=from_area * 0.9, least_core=1.0)  # the burnt walls take some of the area
    votes = fine.join(parts, [*by, "r", "c"]).groupBy(*by, "i", "j", "part").agg(F.count("*").alias("_n"))
    most = votes.groupBy(*by, "i", "j").agg(F.max_by("part", F.struct("_n", -F.col("part"))).alias("part"))
    return rooms.join(most, [*by, "i", "j"], "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))


def windows_of(parts: DataFrame, points: DataFrame, keys: list[str], *, least: float = 0.5, most: float = priors.WINDOW_MAX, low: tuple[float, float] = (0.25, 0.85), high: tuple[float, float] = (1.1, 1.8), low_points: int = 30, share: float = 0.3, near: float = 0.06, inset: float = 0.05) -> DataFrame:
    """keys, face_id, axis, coord, a, b, sill: gaps between a face's solid intervals with wall below (points on the plane) and little above."""
    g = intervals.gaps(parts, [*keys, "face_id", "axis", "coord"], least=least, most=most)
    p = points.select(*keys, "axis", F.floor(F.col("at") / near).alias("_b"), "at", "along", "h")
    j = g.withColumn("_b", F.explode(F.sequence(F.floor((F.col("coord") - near) / near), F.floor((F.col("coord") + near) / near)))).join(p, [*keys, "axis", "_b"])
    j = j.filter((F.abs(F.col("at") - F.col("coord")) < near) & (F.col("along") > F.col("a") + inset) & (F.col("along") < F.col("b") - inset))
    is_low = F.col("h").between(*low)
    s = j.groupBy(*keys, "face_id", "axis", "coord", "a", "b").agg(F.count_if(is_low).alias("_low"), F.count_if(F.col("h").between(*high)).alias("_high"), F.percentile(F.when(is_low, F.col("h")), 0.98).alias("sill"))
    return s.filter((F.col("_low") > low_points) & (F.col("_high") < share * F.col("_low"))).drop("_low", "_high")


def exterior_windows(windows: DataFrame, faces: DataFrame, rooms: DataFrame, keys: list[str], model: ErrorModel = LIDAR, *, inner: float = 0.15, outer: float = 0.25) -> DataFrame:
    """windows with room and width {value, ci95}: those with a room just in front of the face and none behind it."""
    w = windows.join(faces.select(*keys, "face_id", "sign"), [*keys, "face_id"])
    mid = (F.col("a") + F.col("b")) / 2
    for name, at in (("in", F.col("coord") + inner * F.col("sign")), ("out", F.col("coord") - outer * F.col("sign"))):
        w = w.withColumns({f"_u_{name}": F.when(F.col("axis") == "u", at).otherwise(mid), f"_v_{name}": F.when(F.col("axis") == "u", mid).otherwise(at)})
    r = rooms.select(*keys, "room", "u0", "u1", "v0", "v1")
    hit = spatial.point_in_rectangles(w, r, "_u_in", "_v_in", "room", "room", keys=keys)
    behind = spatial.point_in_rectangles(w.select(*keys, "face_id", "a", "_u_out", "_v_out"), r, "_u_out", "_v_out", "room", "room", keys=keys)
    out = hit.join(behind.select(*keys, "face_id", "a"), [*keys, "face_id", "a"], "left_anti")
    width = F.col("b") - F.col("a")
    return out.select(*windows.columns, "room", measured(width, opening_ci(F.lit("window"), width, model)).alias("width"))


def wall_solids(rooms: DataFrame, keys: list[str], shell: float = 0.20) -> DataFrame:
    """keys, room, u0, u1, v0, v1: the rooms' rectangles grown by the outer wall's thickness."""
    return rooms.select(*keys, "room", *[(F.col(c) + s * shell).alias(c) for c, s in (("u0", -1), ("u1", 1), ("v0", -1), ("v1", 1))])


def partitions(rooms: DataFrame, keys: list[str], thick: float = 0.11) -> DataFrame:
    """keys, room_a, room_b, u0, u1, v0, v1: a band of an inner wall's thickness on every unit edge that two rooms share. rooms: room, i, j, u0 to v1."""
    e = boundary_edges(rooms, keys).groupBy(*keys, "axis", "coord", "a", "b").agg(F.min("room").alias("room_a"), F.max("room").alias("room_b"), F.count_distinct("room").alias("_n"))
    return e.filter("_n = 2").select(*keys, "room_a", "room_b", opening_rectangle(F.col("axis"), F.col("coord"), F.col("a"), F.col("b"), thick).alias("_r")).select(*keys, "room_a", "room_b", "_r.*")


def wall_cells(rooms: DataFrame, keys: list[str], res: float, *, shell: float = 0.20, gap: float = 0.40) -> DataFrame:
    """keys, r, c: the raster of a plan's outer walls: gaps between rooms narrower than ``gap`` (walls with two faces), and the shell round them and the rooms."""
    inside = raster.rectangle_cells(rooms, res, keys).checkpoint()
    filled = raster.closed(inside, raster.box(max(1, round(gap / 2 / res)))).checkpoint()
    return raster.minus(raster.dilated(filled, raster.box(max(1, round(shell / res)))), inside)


def opening_rectangle(axis: Column, coord: Column, a: Column, b: Column, thick: float = 0.11) -> Column:
    t = thick / 2
    along_v = F.struct((coord - t).alias("u0"), (coord + t).alias("u1"), a.alias("v0"), b.alias("v1"))
    return F.when(axis == "u", along_v).otherwise(F.struct(a.alias("u0"), b.alias("u1"), (coord - t).alias("v0"), (coord + t).alias("v1")))


def side_by_side(rooms: DataFrame, order: list[Column], keys: list[str], gap: float = 0.5) -> DataFrame:
    """rooms (width) with offset: laid out in a row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rooms.withColumn("offset", F.coalesce(F.sum(F.col("width") + gap).over(w), F.lit(0.0)))


def oriented_walls(walls: DataFrame, keys: list[str], res: float, *, h_step: float = 0.15, cover: float = 0.4) -> DataFrame:
    """keys, axis, r, c: cells of each wall family in whose surroundings (three by three) enough of the height is covered."""
    at_u = F.col("axis") == "u"
    u, v = F.when(at_u, F.col("at")).otherwise(F.col("along")), F.when(at_u, F.col("along")).otherwise(F.col("at"))
    cells = walls.withColumns({"r": F.floor(v / res), "c": F.floor(u / res)})
    cov = robust.height_coverage(cells, [*keys, "axis", "r", "c"], F.col("h"), F.col("band_lo"), F.col("band_hi"), h_step)
    return raster.boxed_sum(cov, "coverage").filter(F.least(F.col("coverage"), F.lit(1.0)) > cover).drop("coverage")


def barrier(oriented: DataFrame, keys: list[str], gap: int, grow: int = 1) -> DataFrame:
    """keys, r, c: walls with the gaps along them bridged (doors closed), grown and closed."""
    side = lambda axis, along, line: intervals.bridged(raster.dilated(oriented.filter(F.col("axis") == axis).select(*keys, "r", "c"), [(0, 0)]), along, [*keys, line], gap).select(*keys, "r", "c")
    lines = raster.union(side("u", "r", "c"), side("v", "c", "r"))
    return raster.closed(raster.dilated(lines, raster.disk(grow)), raster.box(2))
