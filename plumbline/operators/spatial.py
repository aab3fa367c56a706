"""Spatial joins as equi-joins on cells: ranges, bands, rectangles and neighbourhoods are cut into bins, joined by bin, and then tested
exactly. Catalyst thus hashes or sorts by bin, where a bare range condition would become a nested loop over both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bins(lo: Column, hi: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str | Column, hi: str | Column, width: float, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Pairs with lo <= at <= hi and equal keys; columns of both sides (the keys once). ``how``: inner or left_semi."""
    keys = keys or []
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    r = ranges.withColumns({"_lo": _c(lo), "_hi": _c(hi)}).withColumn("_bin", _bins(F.col("_lo"), F.col("_hi"), width))
    if how == "left_semi":
        r = r.select(*keys, "_bin", "_lo", "_hi")
        same = F.lit(True)
        for k in [*keys, "_bin"]:
            same = same & (p[k] == r[k])
        return p.join(r, same & (p[at] >= r["_lo"]) & (p[at] <= r["_hi"]), "left_semi").drop("_bin")
    return p.join(r, [*keys, "_bin"]).filter((F.col(at) >= F.col("_lo")) & (F.col(at) <= F.col("_hi"))).drop("_bin", "_lo", "_hi")


def point_in_rectangles(points: DataFrame, rects: DataFrame, u: str, v: str, region: str, order: str, *, pad: float = 0.0, size: float = 0.5, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """points with the first region (by ``order``) one of whose rectangles (u0, u1, v0, v1), padded, holds them; row for row. A point lies in
    one bin, whose rectangles come as one sorted list: those of a plan that reach into a bin of ``size`` are few. ``how``: inner or left."""
    keys = keys or []
    r = rects.select(*keys, F.col(order).alias("_ord"), F.col(region).alias("_region"), (F.col("u0") - pad).alias("_u0"), (F.col("u1") + pad).alias("_u1"), (F.col("v0") - pad).alias("_v0"), (F.col("v1") + pad).alias("_v1"))
    r = r.withColumn("_bu", _bins(F.col("_u0"), F.col("_u1"), size)).withColumn("_bv", _bins(F.col("_v0"), F.col("_v1"), size))
    bins = r.groupBy(*keys, "_bu", "_bv").agg(F.sort_array(F.collect_list(F.struct("_ord", "_region", "_u0", "_u1", "_v0", "_v1"))).alias("_rects"))
    p = points.withColumns({"_bu": F.floor(F.col(u) / size), "_bv": F.floor(F.col(v) / size)})
    inside = F.filter("_rects", lambda x: F.col(u).between(x["_u0"], x["_u1"]) & F.col(v).between(x["_v0"], x["_v1"]))
    hit = p.join(bins, [*keys, "_bu", "_bv"], how).withColumn("_first", F.try_element_at(inside, F.lit(1)))
    hit = hit if how == "left" else hit.filter(F.col("_first").isNotNull())
    return hit.select(*points.columns, F.col("_first._region").alias(region))


def band_match(left: DataFrame, right: DataFrame, left_id: list[str], at: str, to: str, reach: float, order: list[Column], keys: list[str], take: str, condition: Column | None = None) -> DataFrame:
    """left with ``take``: the struct of the right row within ``reach`` (and the condition) that comes first by ``order``; null if none."""
    r = right.withColumn("_bin", _bins(F.col(to) - reach, F.col(to) + reach, reach))
    row = F.struct(*[c for c in right.columns if c not in keys])
    lefts = left.withColumn("_bin", F.floor(F.col(at) / reach))
    j = lefts.join(r, [*keys, "_bin"]).filter(F.abs(F.col(at) - F.col(to)) < reach)
    j = j if condition is None else j.filter(condition)
    got = j.groupBy(*dict.fromkeys([*keys, *left_id])).agg(F.min_by(row, F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])).alias(take))
    return left.join(got, list(dict.fromkeys([*keys, *left_id])), "left")


def first_surface(points: DataFrame, surfaces: DataFrame, *, reach: float = 0.05, normal: float = 0.8, least_h: float = 0.02, margin: float = 0.1) -> DataFrame:
    """points (axis, at, along, n, h) with the least surface (surface_id, axis, sign, coord, a, b) they lie on: within ``reach`` of its
    plane, facing its way, above the floor, within its interval."""
    s = surfaces.select("axis", F.col("sign").cast("int").alias("_sign"), F.struct("surface_id", "coord", "a", "b").alias("_s"))
    s = s.withColumn("_bin", _bins(F.col("_s.coord") - reach, F.col("_s.coord") + reach, reach))
    bins = s.groupBy("axis", "_sign", "_bin").agg(F.sort_array(F.collect_list("_s")).alias("_surfaces"))  # those of a plan that reach into a bin are few
    p = points.filter((F.abs(F.col("n")) > normal) & (F.col("h") > least_h)).withColumns({"_bin": F.floor(F.col("at") / reach), "_sign": F.signum("n").cast("int")})
    on = F.filter("_surfaces", lambda x: (F.abs(F.col("at") - x["coord"]) < reach) & F.col("along").between(x["a"] - margin, x["b"] + margin))
    first = p.join(bins, ["axis", "_bin", "_sign"]).withColumn("surface_id", F.try_element_at(on, F.lit(1))["surface_id"])
    return first.filter("surface_id IS NOT NULL").select(*points.columns, "surface_id")


def shapes(df: DataFrame, row_id: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of equal shape (the columns ``by``) behave alike in a join: the shapes (by, _shape: the least id of one), and each row's shape
    (row_id, _shape). What holds for a shape is found once and given to its rows."""
    kinds = df.groupBy(*by).agg(F.min(row_id).alias("_shape"))
    return kinds, df.select(row_id, *by).join(kinds, by).select(row_id, "_shape")


#: Ids that one row of ``blocks`` holds, and the tasks over which the bins of such rows are dealt: what these make of a row is far more than the row.
BLOCK, BLOCK_TASKS = 64, 256


def blocks(df: DataFrame, row_id: str, by: list[str], size: int = BLOCK) -> DataFrame:
    """by, _shape (the least id of a shape), _ids: rows of equal shape (the columns ``by``), up to ``size`` to an array. Pairs of arrays meet in a
    join in place of pairs of rows and are spread where they meet (``spread``), so pairs of rows are neither shuffled nor held."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(row_id))
    d = df.select(*by, row_id).withColumns({"_shape": F.first(row_id).over(w), "_block": F.floor((F.row_number().over(w) - 1) / size)})
    nulls = F.array_repeat(F.lit(None).cast(df.schema[row_id].dataType), F.count_if(F.col(row_id).isNull()).cast("int"))
    return d.groupBy(*by, "_shape", "_block").agg(F.concat(F.collect_list(row_id), nulls).alias("_ids")).drop("_block")


def spread(pairs: DataFrame, left: str, right: str, a: str, b: str) -> DataFrame:
    """pairs (in at most BLOCK_TASKS partitions) with a row for each two ids (a, b) of the arrays ``left`` and ``right``. The coalesce, which moves
    nothing, keeps the join out of the code that spreads: a join would hold what all pairs of a left row make, this holds what one pair makes, and
    other columns are worked out once a pair of arrays."""
    return pairs.coalesce(BLOCK_TASKS).withColumn(a, F.explode(left)).withColumn(b, F.explode(right)).drop(left, right)


def _dealt(left: DataFrame, right: DataFrame, by: list[str], tasks: int | None) -> DataFrame:
    """The two joined by equal ``by``; with ``tasks`` over so many tasks, however small the sides are, and neither side broadcast."""
    if tasks is None:
        return left.join(right, by)
    return left.repartition(tasks, *by).hint("merge").join(right.repartition(tasks, *by), by)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], size: float, least: float = 0.0, within: tuple[Column, Column, float, float] | None = None, tasks: int | None = None) -> DataFrame:
    """Pairs of intervals (left a, b; right ra, rb) of equal keys that overlap by more than ``least``, with overlap. A pair that shares
    several bins is kept in the first. ``within`` (a left value, a right one, lo, hi) asks for a right value from lo to hi above the left one, and
    bins the pairs by it as well; test the ends exactly after. ``tasks``: over how many tasks the bins are dealt."""
    lf = left.withColumn("_bin", _bins(F.col("a"), F.col("b"), size))
    rf = right.withColumn("_bin", _bins(F.col("ra"), F.col("rb"), size))
    by = [*keys, "_bin"]
    if within is not None:
        at, to, lo, hi = within
        wide = (hi - lo) / 2
        lf, rf, by = lf.withColumn("_step", F.floor(at / wide)), rf.withColumn("_step", _bins(to - hi, to - lo, wide)), [*by, "_step"]
    j = _dealt(lf, rf, by, tasks).withColumn("overlap", F.least("b", "rb") - F.greatest("a", "ra"))
    return j.filter((F.col("overlap") > least) & (F.col("_bin") == F.floor(F.greatest("a", "ra") / size))).drop("_bin", "_step")


def _shared(one: DataFrame, two: DataFrame, keys: list[str], size: float, tasks: int | None = None) -> DataFrame:
    """Pairs of rectangles (a_u0, ...; b_u0, ...) that share some area, with area; a pair is kept in the first of its bins."""
    bins = lambda d, n: d.withColumn("_bu", _bins(F.col(f"{n}_u0"), F.col(f"{n}_u1"), size)).withColumn("_bv", _bins(F.col(f"{n}_v0"), F.col(f"{n}_v1"), size))
    j = _dealt(bins(one, "a"), bins(two, "b"), [*keys, "_bu", "_bv"], tasks)
    u0, v0 = F.greatest("a_u0", "b_u0"), F.greatest("a_v0", "b_v0")
    j = j.filter((F.col("_bu") == F.floor(u0 / size)) & (F.col("_bv") == F.floor(v0 / size)))
    du, dv = F.least("a_u1", "b_u1") - u0, F.least("a_v1", "b_v1") - v0
    return j.filter((du > 0) & (dv > 0)).withColumn("area", du * dv)


def overlap_area(rects: DataFrame, region: str, *, size: float = 1.0, least: float = 0.25, keys: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """keys, a, b, area: pairs of regions (a < b) whose rectangles share more than ``least``; rectangles of a region don't overlap. Two regions of
    one rectangle each need no sum: equal rectangles are compared once, with arrays of their regions, and the pairs of regions are made where these
    meet. ``digits`` of the area are kept, if given."""
    keys = keys or []
    sides = ["u0", "u1", "v0", "v1"]
    area = F.col("area") if digits is None else F.round("area", digits)
    n = rects.groupBy(*keys, F.col(region).alias("_id")).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in sides])
    kinds = blocks(n.filter("_n = 1 AND _id IS NOT NULL"), "_id", [*keys, *sides])
    named = lambda d, to, *more: d.select(*keys, *more, *[F.col(c).alias(f"{to}_{c}") for c in sides])
    of = lambda to, shape: named(kinds, to, F.col("_shape").alias(shape), F.col("_ids").alias(f"_{to}s"))
    pairs = _shared(of("a", "_x"), of("b", "_y"), keys, size, BLOCK_TASKS).filter((F.col("_x") <= F.col("_y")) & (F.col("area") > least))
    pairs = pairs.select(*keys, (F.col("_x") < F.col("_y")).alias("_differ"), "_as", "_bs", area.alias("area"))
    ends = [F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")]
    plain = spread(pairs, "_as", "_bs", "_a", "_b").filter(F.col("_differ") | (F.col("_a") < F.col("_b"))).select(*keys, *ends, "area")
    counted = rects.select(*keys, F.col(region).alias("_id"), *sides).join(n.select(*keys, "_id", "_n"), [*keys, "_id"])
    several = named(counted.filter("_n > 1"), "a", F.col("_id").alias("_a"))
    mixed = _shared(several, named(counted, "b", F.col("_id").alias("_b"), (F.col("_n") > 1).alias("_more")), keys, size)
    mixed = mixed.filter((F.col("_a") < F.col("_b")) | ~F.col("_more"))
    return plain.unionByName(mixed.groupBy(*keys, *ends).agg(F.sum("area").alias("area")).filter(F.col("area") > least).withColumn("area", area))


def nearest_in_band(left: DataFrame, right: DataFrame, left_id: str, right_id: str, at: str, to: str, reach: float, keys: list[str]) -> DataFrame:
    """keys, left_id, at, right_id, to: each left row's nearest right row within ``reach``, ties to the lower id; rows with none go. Rows at one
    place have the same nearest: each place is matched once, against the least id of each place."""
    places = right.groupBy(*keys, to).agg(F.min(right_id).alias(right_id))
    order = [F.abs(F.col(at) - F.col(to)), F.col(right_id)]
    best = band_match(left.select(*keys, at).distinct(), places, [at], at, to, reach, order, keys, "_m").filter("_m is not null")
    return left.join(best.select(*keys, at, F.col(f"_m.{right_id}").alias(right_id), F.col(f"_m.{to}").alias(to)), [*keys, at]).select(*keys, left_id, at, right_id, to)


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, xy: tuple[str, ...], radius: float, *, keys: list[str] | None = None, condition: Column | None = None) -> DataFrame:
    """left_id, right_id, d2: each left row's nearest right row nearer than ``radius`` (ties to the lower id). The right side is copied to
    the cells around its own, the left side stays in one cell. ``condition`` may use l_<column> and r_<column>."""
    keys = keys or []
    lf = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in keys])
    rt = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    cells = []
    for i, c in enumerate(xy):
        lf = lf.withColumn(f"_c{i}", F.floor(F.col(f"l_{c}") / radius))
        rt = rt.withColumn(f"_c{i}", F.explode(F.array(*[F.floor(F.col(f"r_{c}") / radius) + k for k in (-1, 0, 1)])))
        cells.append(f"_c{i}")
    d2 = sum(((F.col(f"l_{c}") - F.col(f"r_{c}")) * (F.col(f"l_{c}") - F.col(f"r_{c}")) for c in xy), start=F.lit(0))
    j = lf.join(rt, [*keys, *cells]).withColumn("_d2", d2).filter(F.col("_d2") < radius * radius)
    j = j if condition is None else j.filter(condition)
    best = j.groupBy(*keys, F.col(f"l_{left_id}").alias(left_id)).agg(F.min(F.struct("_d2", f"r_{right_id}")).alias("_b"))
    return best.select(*keys, left_id, F.col(f"_b.r_{right_id}").alias(f"near_{right_id}"), F.col("_b._d2").alias("d2"))


#: Bytes of query vectors that are broadcast; more are shuffled.
BROADCAST_BYTES = 64 << 20


def top_neighbours(vectors: DataFrame, queries: DataFrame, vec_id: str, vector: str, k: int, block: int = 4096, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k greatest dot products, exactly. Queries are a stated set, compared in blocks with every
    block of rows; a block sends k rows a query onwards. The blocks of queries are broadcast up to a checked size, else both sides are
    shuffled by block."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    q = queries.select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("_qv"))
    size = q.agg(F.count("*").alias("n"), F.sum(F.size("_qv")).alias("values")).first()
    parts = max(1, -(-size["n"] // 1024))
    qb = q.withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).groupBy("_qb").agg(F.collect_list(F.struct("query_id", "_qv")).alias("_qs"))  # about 1024 a block
    blocks = vectors.select(F.col(vec_id).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, block):
                part = b.slice(i, block)
                whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([whole(part.column(0)), whole(part.column(1).flatten())], ["_ids", "_m"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids = b.column("_ids")[r].values.to_numpy()
                m = b.column("_m")[r].values.to_numpy().reshape(len(ids), -1)
                qs = b.column("_qs")[r].values
                asked = qs.field("query_id").to_numpy()
                s = qs.field("_qv").flatten().to_numpy().reshape(len(asked), -1) @ m.T
                s[asked[:, None] == ids[None, :]] = -np.inf
                keep = min(k, len(ids))
                edge = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
                i, j = np.nonzero((s >= edge[:, None]) & (s > -np.inf))  # ties at the edge are settled by id later
                yield pa.RecordBatch.from_arrays([pa.array(asked[i]), pa.array(ids[j]), pa.array(s[i, j])], ["query_id", "vec_id", "score"])

    qb = F.broadcast(qb) if (size["values"] or 0) * 8 <= broadcast_bytes else qb
    pairs = blocks.mapInArrow(matrix, "_ids array<bigint>, _m array<double>").withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(qb, "_qb").drop("_qb")
    got = pairs.mapInArrow(score, "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ratio_test(neighbours: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Queries whose best distance is under ``ratio`` times their second (query_id, rank, vec_id, dist of the two nearest)."""
    two = neighbours.filter(F.col("rank") <= 2).groupBy("query_id").agg(F.min_by("vec_id", "rank").alias("vec_id"), F.min(F.struct("rank", "dist"))["dist"].alias("d1"), F.max(F.struct("rank", "dist"))["dist"].alias("d2"), F.count("*").alias("_n"))
    return two.filter((F.col("_n") == 2) & (F.col("d1") < ratio * F.col("d2"))).drop("_n")


def asof_interpolated(keyed: DataFrame, at: DataFrame, time: str, values: list[str], keys: list[str]) -> DataFrame:
    """at with the values interpolated linearly between the keyed rows before and after, held constant beyond the ends."""
    both = keyed.select(*keys, time, *values, F.lit(True).alias("_key")).unionByName(at.select(*keys, time).distinct().withColumns({**{v: F.lit(None).cast(keyed.schema[v].dataType) for v in values}, "_key": F.lit(False)}))
    back = Window.partitionBy(*keys).orderBy(time, F.desc("_key")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(time, "_key").rowsBetween(0, Window.unboundedFollowing)
    row = F.when(F.col("_key"), F.struct(time, *values))
    d = both.withColumn("_p", F.last(row, ignorenulls=True).over(back)).withColumn("_n", F.first(row, ignorenulls=True).over(ahead)).filter(~F.col("_key"))
    share = F.try_divide(F.col(time) - F.col(f"_p.{time}"), F.col(f"_n.{time}") - F.col(f"_p.{time}"))
    out = d.select(*keys, time, *[F.coalesce(F.col(f"_p.{v}") + (F.col(f"_n.{v}") - F.col(f"_p.{v}")) * share, F.col(f"_p.{v}"), F.col(f"_n.{v}")).alias(v) for v in values])
    return at.join(out, [*keys, time], "left")


def pixels_in_boxes(pixels: DataFrame, boxes: DataFrame, keys: list[str], box_id: str, size: int = 32) -> DataFrame:
    """Pairs of pixels (x, y) and the inner 40 % of boxes (x0, y0, x1, y1)."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hx, hy = (F.col("x1") - F.col("x0")) * 0.2, (F.col("y1") - F.col("y0")) * 0.2
    b = boxes.withColumns({"_a0": cx - hx, "_a1": cx + hx, "_b0": cy - hy, "_b1": cy + hy})
    b = b.withColumn("_bx", _bins(F.col("_a0"), F.col("_a1"), size)).withColumn("_by", _bins(F.col("_b0"), F.col("_b1"), size))
    p = pixels.withColumns({"_bx": F.floor(F.col("x") / size), "_by": F.floor(F.col("y") / size)})
    return p.join(b, [*keys, "_bx", "_by"]).filter(F.col("x").between(F.col("_a0"), F.col("_a1")) & F.col("y").between(F.col("_b0"), F.col("_b1"))).drop("_bx", "_by", "_a0", "_a1", "_b0", "_b1")


def lifted_detections(pixels: DataFrame, boxes: DataFrame, keys: list[str], box_id: str, *, least_depth: float = 0.1, most_depth: float = 4.5, least_pixels: int = 3) -> DataFrame:
    """keys, box_id, depth, pixels: the median depth of the inner part of each box; boxes with too few pixels or too far away go. Equal pixels
    count together, and equal boxes are looked up once."""
    ids = boxes.groupBy(*keys, box_id).agg(F.sort_array(F.collect_list(F.struct("x0", "y0", "x1", "y1"))).alias("_boxes"))  # a box has one row
    kinds = ids.groupBy(*keys, "_boxes").agg(F.min(box_id).alias("_shape"))
    alike = pixels.filter(F.col("depth") > least_depth).groupBy(*keys, "x", "y", "depth").agg(F.count("*").alias("_n"))
    j = pixels_in_boxes(alike, kinds.select(*keys, "_shape", F.explode("_boxes").alias("_b")).select(*keys, "_shape", "_b.*"), keys, "_shape")
    depths = j.groupBy(*keys, "_shape", "depth").agg(F.sum("_n").alias("_n"))
    got = depths.groupBy(*keys, "_shape").agg(F.percentile("depth", 0.5, F.col("_n")).alias("depth"), F.sum("_n").alias("pixels")).filter((F.col("pixels") >= least_pixels) & (F.col("depth") <= most_depth))
    return ids.join(kinds, [*keys, "_boxes"]).join(got, [*keys, "_shape"]).select(*keys, box_id, "depth", "pixels")
