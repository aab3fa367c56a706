"""Damage: views of surface tiles, votes over views, regions, hidden-damage rules and the scope of repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import priors
from ..functions import geometry
from .graph import cell_components
from .windows import top_k


def tile_views(pixels: DataFrame, tile: list[str], keys: list[str], *, least_px: int = priors.MIN_TILE_PIXELS, share: float = 0.5, most: float = priors.MAX_VIEW_DISTANCE, tile_m: float = priors.TILE) -> DataFrame:
    """keys, frame, tile, x0, x1, y0, y1, d, cos, n, score: a tile in a frame is a view if its box is large, near and half full.
    pixels: frame, tile, x, y, d, cos, fx, fy, width, height."""
    v = pixels.groupBy(*keys, "frame", *tile).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.median("d").alias("d"), F.median("cos").alias("cos"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("fx", "fy", "width", "height")])
    inside = (F.col("x0") > 1) & (F.col("y0") > 1) & (F.col("x1") < F.col("width") - 2) & (F.col("y1") < F.col("height") - 2)
    side = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 1
    v = v.filter(inside & (side >= least_px) & (F.col("d") <= most) & (F.col("n") >= share * geometry.expected_pixels(tile_m, F.col("cos"), F.col("d"), F.col("fx"), F.col("fy"))))
    return v.withColumn("score", geometry.view_score(F.col("cos"), F.col("d"))).drop("fx", "fy", "width", "height")


def best_views(views: DataFrame, tile: list[str], keys: list[str], k: int = priors.MIN_VIEWS) -> DataFrame:
    return top_k(views, [*keys, *tile], [F.desc("score"), F.desc("frame"), F.desc("d")], k, "rank")


def voted(probs: DataFrame, tile: list[str], keys: list[str], classes: list[str], plain: str = "plain", *, report: dict[str, str] | None = None, surface: float = priors.MIN_SURFACE, views: int = 2, agree: int = priors.MIN_AGREEING, defect: float = priors.MIN_DEFECT) -> DataFrame:
    """keys, tile, class, told (the class that the model tells apart), confidence (what the mean leaves of plain), views: of views on a
    surface (surface_p) the mean probabilities; a tile is damaged if enough views do not say plain and plain has too little of the mean.
    probs: probs (array, in the classes' order), surface_p; report: the class reported for a told one, itself if it isn't there."""
    report = report or {}
    at = classes.index(plain)
    p = probs.filter(F.col("surface_p") >= surface)
    mean = F.array(*[F.avg(F.col("probs")[i]) for i in range(len(classes))])
    g = p.groupBy(*keys, *tile).agg(mean.alias("_m"), F.count("*").cast("int").alias("views"), F.count_if(geometry.argmax(F.col("probs")) != at).alias("_agree"))
    others = F.array(*[F.struct(F.col("_m")[i].alias("p"), F.lit(-i).alias("i"), F.lit(c).alias("told"), F.lit(report.get(c, c)).alias("class")) for i, c in enumerate(classes) if i != at])
    g = g.filter((F.col("views") >= views) & (F.col("_agree") >= agree) & (1 - F.col("_m")[at] >= defect)).withColumn("_t", F.array_max(others))
    return g.select(*keys, *tile, F.col("_t.class").alias("class"), F.col("_t.told").alias("told"), (1 - F.col("_m")[at]).alias("confidence"), "views")


def regions(tiles: DataFrame, keys: list[str], tile_m: float = priors.TILE) -> DataFrame:
    """keys, surface_id, class, component, area {value, ci95}, extents, confidence, views, severity: 8-connected tiles of one class and surface.
    A side is exposed if no damaged tile of any class lies there. A crack is major if more of its tiles were told as major cracks than as
    minor ones; other classes have no severity. tiles: surface_id, a, b, class, confidence, views and, for severity, told."""
    if "told" not in tiles.columns:
        tiles = tiles.withColumn("told", F.col("class"))
    by = [*keys, "surface_id", "class"]
    comp = cell_components(tiles.select(*by, F.col("a").alias("r"), F.col("b").alias("c")), "r", "c", by, diagonal=True)
    t = tiles.join(comp.select(*by, F.col("r").alias("a"), F.col("c").alias("b"), "component"), [*by, "a", "b"])
    on = [*keys, "surface_id", "a", "b"]
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))]))
    near = t.select(*keys, "surface_id", "class", "component", "a", "b", sides.alias("_s")).select(*keys, "surface_id", "class", "component", (F.col("a") + F.col("_s.i")).alias("a"), (F.col("b") + F.col("_s.j")).alias("b"))
    exposed = near.join(tiles.select(*on).distinct(), on, "left_anti").groupBy(*by, "component").agg(F.count("*").alias("exposed"))
    g = t.groupBy(*by, "component").agg(F.count("*").alias("n"), ((F.max("a") - F.min("a") + 1) * tile_m).alias("extent_a"), ((F.max("b") - F.min("b") + 1) * tile_m).alias("extent_b"), (F.min("a") * tile_m).alias("a0"), (F.min("b") * tile_m).alias("b0"), F.avg("confidence").alias("confidence"), F.sum("views").cast("int").alias("views"), (F.count_if(F.col("told") == "major_crack") > F.count_if(F.col("told") == "minor_crack")).alias("_major"))
    g = g.withColumn("severity", F.when(F.col("class") == "crack", F.when(F.col("_major"), "major").otherwise("minor")))
    g = g.join(exposed, [*by, "component"], "left").withColumn("exposed", F.coalesce("exposed", F.lit(0)))
    area = F.col("n") * tile_m * tile_m
    return g.select(*by, "component", F.struct(area.alias("value"), (0.5 * F.col("exposed") / 4 * tile_m * tile_m + 0.1 * area).alias("ci95")).alias("area"), "extent_a", "extent_b", "a0", "b0", "confidence", "views", "severity")


def inspected(views: DataFrame, tile: list[str], keys: list[str], tile_m: float = priors.TILE) -> DataFrame:
    return views.select(*keys, *tile).distinct().groupBy(*keys).agg(F.count("*").alias("tiles"), (F.count("*") * tile_m * tile_m).alias("area"))


def evidence(views: DataFrame, region_tiles: DataFrame, tile: list[str], keys: list[str]) -> DataFrame:
    """keys, region, frame, tiles: the frame of each region's best-scored tile and the tiles whose best view it is."""
    best = top_k(views, [*keys, *tile], [F.desc("score"), F.desc("frame"), F.desc("d")], 1)
    t = region_tiles.join(best, [*keys, *tile])
    f = t.groupBy(*keys, "region").agg(F.max_by("frame", F.struct("score", "frame")).alias("frame"))
    return t.join(f, [*keys, "region", "frame"]).groupBy(*keys, "region", "frame").agg(F.sort_array(F.collect_list(F.struct(*tile))).alias("tiles"))


def concealed_flags(regions_: DataFrame, rooms: DataFrame, adjacent: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, damage_id, rule: which rules of hidden damage a region meets (several may apply).
    regions_: damage_id, class, kind (wall, ceiling), room, axis, coord, a0, a1, height, extent, severity; rooms: room, type;
    adjacent: a, b; windows: axis, coord, a, b."""
    wet = rooms.filter(F.col("type").isin(priors.WET_TYPES)).select(*keys, "room")
    ends = adjacent.select(*keys, F.col("a").alias("room"), F.col("b").alias("_n")).unionByName(adjacent.select(*keys, F.col("b").alias("room"), F.col("a").alias("_n")))
    near_wet = ends.join(wet.withColumnRenamed("room", "_n"), [*keys, "_n"], "left_semi").select(*keys, "room")
    by_water = wet.unionByName(near_wet).distinct().withColumn("_wet", F.lit(True))
    w = windows.select(*keys, "axis", F.col("coord").alias("_wc"), F.col("a").alias("_wa"), F.col("b").alias("_wb")).distinct().withColumn("_bin", F.explode(F.sequence(F.floor((F.col("_wc") - 0.1) / 0.1), F.floor((F.col("_wc") + 0.1) / 0.1))))
    place = [*keys, "axis", "coord", "a0", "a1"]
    r = regions_.select(*place).distinct().withColumn("_bin", F.floor(F.col("coord") / 0.1))  # equal places meet equal windows once
    near = r.join(w, [*keys, "axis", "_bin"]).filter((F.abs(F.col("coord") - F.col("_wc")) <= 0.1) & (F.col("a0") < F.col("_wb") + 0.6) & (F.col("a1") > F.col("_wa") - 0.6)).select(*place).distinct()
    by_window = regions_.join(near, place, "left_semi").select(*keys, "damage_id").distinct().withColumn("_win", F.lit(True))
    d = regions_.join(by_water, [*keys, "room"], "left").join(by_window, [*keys, "damage_id"], "left")
    moist, wall = F.col("class").isin(priors.MOIST_CLASSES), F.col("kind") == "wall"
    rules = F.array(
        F.when((F.col("kind") == "ceiling") & moist, F.lit("R1-ceiling-moisture")),
        F.when(wall & moist & (F.col("height") < 0.4), F.lit("R2-rising-damp")),
        F.when(wall & moist & F.col("_wet"), F.lit("R3-wet-room-wall")),
        F.when(wall & (F.col("class") == "mould") & F.col("_win"), F.lit("R4-condensation")),
        F.when((F.col("class") == "crack") & ((F.col("extent") > 0.5) | (F.col("severity").eqNullSafe("major"))), F.lit("R5-structural-crack")),
        F.when(F.col("class") == "spalling", F.lit("R6-spalling")),
    )
    return d.select(*keys, "damage_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))


def scope_items(regions_: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """keys, damage_id, action, qty, unit: a repair for each region of a class that has one, and one investigation a flag."""
    spark = regions_.sparkSession
    table = F.broadcast(spark.createDataFrame(priors.REPAIRS, ["class", "action", "_k", "_least", "unit"]))
    r = regions_.join(table, "class")
    qty = F.when(F.col("unit") == "m", F.col("extent")).otherwise(F.greatest(F.col("area") * F.col("_k"), F.col("_least")))
    repair = r.select(*keys, "damage_id", "action", F.bround(qty, 2).alias("qty"), "unit")
    look = flags.select(*keys, "damage_id", F.concat(F.lit("Investigate ("), F.col("rule"), F.lit(")")).alias("action"), F.lit(1.0).alias("qty"), F.lit("ea").alias("unit"))
    return repair.unionByName(look)


def pixel_votes(tiles: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """keys, x, y, class: pixels (of a coarse grid) at least ``least`` of whose tiles are damaged, with the class of the highest mean."""
    cells = tiles.withColumn("x", F.explode(F.sequence("x0", F.col("x0") + F.col("size") - 1))).withColumn("y", F.explode(F.sequence("y0", F.col("y0") + F.col("size") - 1)))
    n = cells.groupBy(*keys, "x", "y").agg(F.count("*").alias("_all"), F.count_if(F.col("class") != "plain").alias("_bad"))
    c = cells.filter("class <> 'plain'").groupBy(*keys, "x", "y", "class").agg(F.sum("p").alias("_s"))
    top = c.groupBy(*keys, "x", "y").agg(F.max_by("class", F.struct("_s", "class")).alias("class"))
    return n.filter(F.col("_bad") >= least * F.col("_all")).join(top, [*keys, "x", "y"]).select(*keys, "x", "y", "class")

