"""Room measurements with intervals, ceilings, features, space typing, names; photo-tier room picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import priors
from ..functions.intervals95 import LIDAR, ErrorModel, area_ci, ceiling_ci, face_sigma, length_ci, measured
from . import intervals, spatial


def edge_faces(edges: DataFrame, faces: DataFrame, keys: list[str], reach: float = 0.03) -> DataFrame:
    """Boundary edges with the face on their line (the one with most points) as face; measured says whether there is one."""
    e = spatial.band_match(edges, faces.select(*keys, "axis", F.col("coord").alias("face_coord"), "std", "n", "face_id"), ["room", "coord", "a", "b"], "coord", "face_coord", reach, [-F.col("n"), F.col("face_id")], [*keys, "axis"], "face")
    return e.withColumn("measured", F.col("face").isNotNull())


def room_dimensions(edges: DataFrame, keys: list[str], model: ErrorModel = LIDAR) -> DataFrame:
    """keys, room, axis, length, extent: distance between the principal lines of the two sides of a room, and of its outermost edges, with
    intervals and whether walls bound them. edges: room, axis, coord, a, b, side, face, measured."""
    e = edges.withColumn("len", F.col("b") - F.col("a"))
    by = [*keys, "room", "axis"]
    main = intervals.principal_line(e, "coord", "len", "measured", [*by, "side"])
    sig = face_sigma(F.col("face.std"), F.col("face.n"), F.col("measured"), model)
    near = e.withColumn("_s", F.coalesce(sig, F.lit(0.05 + model.face)))
    s = main.withColumnRenamed("coord", "_line").withColumnRenamed("measured", "_m").join(near, [*by, "side"]).filter(F.abs(F.col("coord") - F.col("_line")) < 0.04)
    s = s.groupBy(*by, "side").agg(F.first("_line").alias("line"), F.first("_m").alias("bounded"), F.max_by("_s", F.struct("len", -F.col("coord"))).alias("sigma"))
    out = _outer(near, by)
    both = s.join(out, [*by, "side"])
    side = lambda k: both.filter(F.col("side") == k).select(*by, *[F.col(c).alias(f"{c}{'lo' if k < 0 else 'hi'}") for c in ("line", "bounded", "sigma", "outer", "outer_bounded", "outer_sigma")])
    d = side(-1).join(side(1), by)
    length, ext = F.col("linehi") - F.col("linelo"), F.col("outerhi") - F.col("outerlo")
    return d.select(*by, length.alias("length"), length_ci(length, F.col("sigmalo"), F.col("sigmahi"), model).alias("length_ci"), (F.col("boundedlo") & F.col("boundedhi")).alias("bounded"), ext.alias("extent"), length_ci(ext, F.col("outer_sigmalo"), F.col("outer_sigmahi"), model).alias("extent_ci"), (F.col("outer_boundedlo") & F.col("outer_boundedhi")).alias("extent_bounded"))


def _outer(edges: DataFrame, by: list[str]) -> DataFrame:
    far = F.struct(F.col("coord") * F.col("side"), F.col("len"))
    return edges.groupBy(*by, "side").agg(F.max_by("coord", far).alias("outer"), F.max_by("measured", far).alias("outer_bounded"), F.max_by("_s", far).alias("outer_sigma"))


def room_areas(cells: DataFrame, dims: DataFrame, keys: list[str]) -> DataFrame:
    """keys, room, area {value, ci95}, and length_u, length_v, extent_u, extent_v likewise."""
    area = cells.groupBy(*keys, "room").agg(F.sum((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))).alias("_area"))
    one = lambda axis: dims.filter(F.col("axis") == axis).select(*keys, "room", *[F.col(c).alias(f"{c}_{axis}") for c in ("length", "length_ci", "bounded", "extent", "extent_ci")])
    r = area.join(one("u"), [*keys, "room"], "left").join(one("v"), [*keys, "room"], "left")
    ci = area_ci(F.col("_area"), F.col("extent_u"), F.col("extent_ci_u"), F.col("extent_v"), F.col("extent_ci_v"))
    return r.select(*keys, "room", measured(F.col("_area"), ci, 3).alias("area"), *[measured(F.col(f"{c}_{a}"), F.col(f"{c}_ci_{a}")).alias(f"{c}_{a}") for c in ("length", "extent") for a in ("u", "v")], (F.col("bounded_u") & F.col("bounded_v")).alias("bounded"))


def room_ceilings(points: DataFrame, areas: DataFrame, keys: list[str], floors: DataFrame | None = None, model: ErrorModel = LIDAR, *, band: tuple[float, float] = (1.9, 4.5), width: float = 0.01, top: int = 40, reach: float = 0.03, cell: float = 0.25, least: int = 150, cover: float = priors.CEILING_COVERAGE, rise: float = 0.05) -> DataFrame:
    """keys, room, ceiling (mean of the level's points), ci95, n, coverage: of the fullest height bins of down-facing points those whose level
    has enough points over enough of the room; in the order of their counts, a later one wins if its level is higher by ``rise``. No such
    level: no row. points: room, u, v, h; areas: room, area; floors: keys, floor_sigma (4 mm without)."""
    by = [*keys, "room"]
    p = points.filter((F.col("h") >= band[0]) & (F.col("h") < band[1])).withColumn("_bin", F.floor((F.col("h") - band[0]) / width))
    bins = p.groupBy(*by, "_bin").agg(F.count("*").alias("_n"))
    from .windows import top_k

    cand = top_k(bins, by, [F.desc("_n"), F.desc("_bin")], top, "_rank").withColumn("_level", band[0] + (F.col("_bin") + 0.5) * width)
    q = p.withColumn("_k", F.floor(F.col("h") / reach))
    j = cand.withColumn("_k", F.explode(F.sequence(F.floor((F.col("_level") - reach) / reach), F.floor((F.col("_level") + reach) / reach)))).drop("_bin").join(q, [*by, "_k"]).filter(F.abs(F.col("h") - F.col("_level")) < reach)
    lev = j.groupBy(*by, "_rank").agg(F.first("_level").alias("_level"), F.count("*").alias("n"), F.avg("h").alias("ceiling"), F.stddev_pop("h").alias("_std"), F.count_distinct(F.struct(F.floor(F.col("u") / cell), F.floor(F.col("v") / cell))).alias("_cells"))
    lev = lev.join(areas.select(*by, "area"), by).withColumn("coverage", F.least(F.col("_cells") * cell * cell / F.col("area"), F.lit(1.0))).filter((F.col("n") >= least) & (F.col("coverage") >= cover))
    item = F.struct("_rank", "_level", "ceiling", "_std", "n", "coverage")
    folded = lev.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("_l"))  # at most ``top``
    best = F.aggregate(F.slice("_l", 2, top), F.element_at("_l", 1), lambda b, x: F.when(x["_level"] > b["_level"] + rise, x).otherwise(b))
    got = folded.select(*by, best.alias("_b")).select(*by, "_b.*")
    if floors is not None:
        got = got.join(floors.select(*keys, "floor_sigma"), keys, "left") if keys else got.join(F.broadcast(floors.select("floor_sigma")), F.lit(True), "left")
    sigma = F.coalesce("floor_sigma", F.lit(0.004)) if floors is not None else F.lit(0.004)
    return got.select(*by, "ceiling", ceiling_ci(F.col("ceiling"), F.col("_std"), F.col("n"), sigma, model).alias("ci95"), "n", "coverage")


def room_features(cells: DataFrame, openings: DataFrame, keys: list[str], *, res: float = 0.05, below: DataFrame | None = None, seen: DataFrame | None = None, walked: DataFrame | None = None) -> DataFrame:
    """keys, room, area, long_side, short_side, elongation (of the smallest rotated rectangle, its sides to the millimetre: a threshold isn't missed by what means of many points differ in), inscribed_width, n_openings, degree, below_points, seen, walked. below: points (u, v) of surfaces below the floor's level; seen, walked: rasters (r, c) of floor
    evidence and of the camera's way. What isn't given counts as nothing."""
    from . import polygons, raster

    by = [*keys, "room"]
    g = cells.groupBy(*by).agg(F.sum((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))).alias("area"))
    corners = cells.select(*by, F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a in ("u0", "u1") for b in ("v0", "v1")])).alias("_c")).select(*by, "_c.*")
    g = g.join(polygons.rotated_rectangles(polygons.hulls(corners, by, "u", "v"), by), by)
    ends = openings.select(*keys, F.explode(F.array(F.struct(F.col("room_a").alias("room"), F.col("room_b").alias("other")), F.struct(F.col("room_b").alias("room"), F.col("room_a").alias("other")))).alias("_e")).select(*keys, "_e.*")
    o = ends.filter("room is not null").groupBy(*by).agg(F.count("*").alias("n_openings"), F.count_distinct("other").alias("degree"))
    mask = raster.rectangle_cells(cells, res, by).checkpoint()
    g = g.join(o, by, "left").join(raster.inscribed_width(mask, by, res), by, "left")
    if below is not None:
        hit = spatial.point_in_rectangles(below.select(*keys, "u", "v", F.monotonically_increasing_id().alias("_id")), cells.select(*by, "u0", "u1", "v0", "v1"), "u", "v", "room", "room", keys=keys)
        g = g.join(hit.groupBy(*by).agg(F.count("*").alias("below_points")), by, "left")
    else:
        g = g.withColumn("below_points", F.lit(0).cast("long"))
    for name, cover in (("seen", seen), ("walked", walked)):
        if cover is not None:
            g = g.join(raster.overlap_share(mask, cover, keys, "room").withColumnRenamed("share", name), by, "left")
        else:
            g = g.withColumn(name, F.lit(0.0))
    g = g.fillna(0, ["n_openings", "degree", "below_points", "seen", "walked"])
    return g.select(*by, "area", "long_side", "short_side", (F.round("long_side", 3) / F.greatest(F.round("short_side", 3), F.lit(0.1))).alias("elongation"), "inscribed_width", "n_openings", "degree", "below_points", "seen", "walked")


def _table(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, names))  # a fixed table of priors.py


def space_types(features: DataFrame, fixtures: DataFrame, keys: list[str]) -> DataFrame:
    """keys, room, type, score: structure first (corridor, closet), then fixtures with weights and size priors; a type needs a decisive
    fixture, enough evidence and a clear lead. features: room, area, inscribed_width, elongation, n_openings, degree, below_points;
    fixtures: room, class, n."""
    spark = features.sparkSession
    by = [*keys, "room"]
    ev = fixtures.join(_table(spark, priors.FIXTURE_WEIGHTS, ["class", "type", "weight"]), "class").select(*by, "type", (F.col("weight") * F.least("n", F.lit(3))).alias("s"))
    dec = fixtures.join(_table(spark, priors.DECISIVE, ["class", "type"]), "class").select(*by, "type").distinct()
    stairs = features.filter(F.col("below_points") > priors.STAIR_POINTS).select(*by)
    other = dec.filter("type <> 'Stairs'").select(*by).distinct()
    ev = ev.unionByName(stairs.select(*by, F.lit("Stairs").alias("type"), F.lit(4.0).alias("s")))
    dec = dec.unionByName(stairs.join(other, by, "left_anti").select(*by, F.lit("Stairs").alias("type"))).distinct()
    score = ev.groupBy(*by, "type").agg(F.sum("s").alias("s")).join(features.select(*by, "area"), by).join(_table(spark, priors.PLAUSIBLE_AREA, ["type", "lo", "hi"]), "type", "left")
    score = score.withColumn("s", F.col("s") * F.when(F.col("area").between(F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(1e9))), 1.0).otherwise(priors.IMPLAUSIBLE))
    best = score.join(dec, [*by, "type"], "left_semi").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("s"), F.col("type"))), asc=False).alias("_b"))
    has = fixtures.groupBy(*by).agg(F.collect_set("class").alias("_has"))
    f = features.join(best, by, "left").join(has, by, "left")
    empty = F.expr("cast(array() as array<struct<s:double,type:string>>)")
    f = f.withColumns({"_b": F.coalesce("_b", empty), "_has": F.coalesce("_has", F.expr("cast(array() as array<string>)"))})
    top, second = F.try_element_at("_b", F.lit(1)), F.try_element_at("_b", F.lit(2))
    s1, s2 = F.coalesce(top["s"], F.lit(0.0)), F.coalesce(second["s"], F.lit(0.0))
    pair = F.array_sort(F.array(top["type"], second["type"]))
    named = F.when((top["type"] == "Bathroom") & (F.col("area") < 2.5) & ~F.arrays_overlap("_has", F.array(F.lit("shower"), F.lit("bathtub"))), "WC").when((s2 >= priors.MIN_TYPE_SCORE) & (pair == F.array(F.lit("Kitchen"), F.lit("Living"))), "Living / Kitchen").when((F.size("_b") == 1) | (s1 >= priors.MIN_TYPE_MARGIN * s2), top["type"])
    hall = F.when((F.col("degree") >= 3) & (F.col("area") < 15) & (F.size("_has") == 0), "Hall").otherwise("Room")
    kind = (
        F.when((F.col("inscribed_width") < priors.CORRIDOR_MAX_WIDTH) & (F.col("elongation") >= priors.CORRIDOR_MIN_ELONGATION) & (s1 < 4), "Corridor")
        .when((F.col("area") < priors.CLOSET_MAX_AREA) & (F.col("n_openings") <= 1) & (s1 < 3), "Closet")
        .otherwise(F.coalesce(F.when(s1 >= priors.MIN_TYPE_SCORE, named), hall))
    )
    return f.select(*by, kind.alias("type"), s1.alias("score"))


def sightings(objects: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """keys, room, fixtures: map of class to count. objects: room, class, conf."""
    n = objects.filter(F.col("conf") > least).groupBy(*keys, "room", "class").agg(F.count("*").cast("int").alias("n"))
    return n.groupBy(*keys, "room").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "n")))).alias("fixtures"))


def majority(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """keys, label, votes (map): the commonest label, the first in the alphabet of equals."""
    n = df.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").cast("int").alias("_n"))
    g = n.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("m"), F.col(label).alias("l")))).alias("_v"))
    return g.select(*keys, F.element_at("_v", 1)["l"].alias(label), F.map_from_entries(F.transform("_v", lambda x: F.struct(x["l"], -x["m"]))).alias("votes"))


def footprint(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Area of the union of complex cells."""
    d = cells.select(*keys, "u0", "u1", "v0", "v1").distinct()
    return d.groupBy(*keys).agg(F.sum((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))).alias("footprint"))


def union_area(rects: DataFrame, keys: list[str]) -> DataFrame:
    """Area of the union of any rectangles of a plan: coordinates are cut at every edge, and each slab's intervals merged."""
    cuts = rects.select(*keys, F.explode(F.array("u0", "u1")).alias("x")).distinct()
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    slabs = cuts.withColumn("x1", F.lead("x").over(w.orderBy("x"))).filter("x1 is not null").withColumn("_bin", F.explode(F.sequence(F.floor("x"), F.floor("x1"))))
    r = rects.withColumn("_bin", F.explode(F.sequence(F.floor("u0"), F.floor("u1"))))
    j = slabs.join(r, [*keys, "_bin"]).filter((F.col("u0") <= F.col("x")) & (F.col("u1") >= F.col("x1"))).select(*keys, "x", "x1", "v0", "v1").distinct()
    m = intervals.merged(j, "v0", "v1", [*keys, "x", "x1"], 0.0)
    return m.groupBy(*keys).agg(F.sum((F.col("x1") - F.col("x")) * (F.col("b") - F.col("a"))).alias("area"))


def picked_rooms(rooms: DataFrame, cameras: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's (photo folder's) room with most cameras inside; without any, the largest. rooms: room, area and rectangles; cameras: camera, u, v."""
    hit = spatial.point_in_rectangles(cameras.select(*keys, "camera", "u", "v"), rooms.select(*keys, "room", "u0", "u1", "v0", "v1"), "u", "v", "room", "room", keys=keys)
    n = hit.groupBy(*keys, "room").agg(F.count("*").alias("_n"))
    areas = rooms.groupBy(*keys, "room").agg(F.sum((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))).alias("area"))
    r = areas.join(n, [*keys, "room"], "left").withColumn("cameras", F.coalesce("_n", F.lit(0)))
    return r.groupBy(*keys).agg(F.max_by(F.struct("room", "area", "cameras"), F.struct("cameras", "area", -F.col("room"))).alias("_r")).select(*keys, "_r.*")


def largest(rooms: DataFrame, keys: list[str], area: str = "area", room: str = "room") -> DataFrame:
    return rooms.groupBy(*keys).agg(F.max_by(room, F.struct(F.col(area), -F.col(room))).alias(room))


def cross_room_matches(matches: DataFrame, keys: list[str], *, least: int = 25, k: int = 4) -> DataFrame:
    """Each room's k best photos of other rooms: photo, room, other (room), inliers. Links, not photo pairs, are given."""
    from .windows import top_k

    best = matches.filter((F.col("room") != F.col("other")) & (F.col("inliers") >= least)).groupBy(*keys, "room", "other", "photo").agg(F.max("inliers").alias("inliers"))
    return top_k(best, [*keys, "room"], [F.desc("inliers"), F.col("photo"), F.col("other")], k, "rank")
