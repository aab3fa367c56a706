"""Polygons of any shape: points in them, their cells, hulls, smallest rotated rectangles, simplification.

A polygon is a row with a ring: array<array<double>> of (u, v), closed from the last vertex to the first, in either direction; inside is what an odd
number of edges lies to the right of, so holes are rings of their own in the same polygon only by even-odd counting of one ring's edges. Rings with fewer
than three vertices have no inside. Null rings and null vertices are left out. Points are never copied: a bin's polygons come as one list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RING = "array<array<double>>"


def ring_edges(polygons: DataFrame, keep: list[str], ring: str = "polygon") -> DataFrame:
    """keep, u0, v0, u1, v1: a row for each edge."""
    ok = F.filter(ring, lambda p: F.try_element_at(p, F.lit(1)).isNotNull() & F.try_element_at(p, F.lit(2)).isNotNull())
    d = polygons.select(*keep, ok.alias("_ring")).filter("size(_ring) > 0")
    following = F.concat(F.slice("_ring", 2, F.size("_ring")), F.slice("_ring", 1, 1))
    e = d.select(*keep, F.explode(F.arrays_zip(F.col("_ring").alias("p"), following.alias("q"))).alias("_e"))
    return e.select(*keep, *[F.col(f"_e.{p}")[i].cast("double").alias(n) for p, i, n in (("p", 0, "u0"), ("p", 1, "v0"), ("q", 0, "u1"), ("q", 1, "v1"))])


def area(ring: str | Column) -> Column:
    """The ring's area, whatever its direction (shoelace)."""
    r = F.col(ring) if isinstance(ring, str) else ring
    following = F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    return F.abs(F.aggregate(F.zip_with(r, following, lambda p, q: p[0] * q[1] - q[0] * p[1]), F.lit(0.0), lambda a, x: a + x)) / 2


def _spans(lo: Column, hi: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))


def _crosses(e: Column, u: Column, v: Column) -> Column:
    """Whether an edge crosses the ray from (u, v) to greater u; an edge holds its lower end and not its upper one."""
    return ((e["v0"] > v) != (e["v1"] > v)) & (u < (e["u1"] - e["u0"]) * (v - e["v0"]) / (e["v1"] - e["v0"]) + e["u0"])


def _distance2(e: Column, u: Column, v: Column) -> Column:
    """Squared distance of (u, v) from an edge."""
    du, dv = e["u1"] - e["u0"], e["v1"] - e["v0"]
    long2 = du * du + dv * dv
    at = F.when(long2 > 0, F.least(F.greatest(((u - e["u0"]) * du + (v - e["v0"]) * dv) / long2, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    x, y = u - (e["u0"] + at * du), v - (e["v0"] + at * dv)
    return x * x + y * y


def _covers(edges: Column, bu: Column, bv: Column, size: float) -> Column:
    """Whether a polygon holds a whole bin: no edge of its strip comes near the bin, and the bin's middle is inside."""
    gap = size * 1e-6
    u0, u1, v0, v1 = bu * size - gap, (bu + 1) * size + gap, bv * size - gap, (bv + 1) * size + gap

    def meets(e: Column) -> Column:
        lo, hi = F.least(e["v0"], e["v1"]), F.greatest(e["v0"], e["v1"])
        u_at = lambda v: e["u0"] + (e["u1"] - e["u0"]) * (v - e["v0"]) / (e["v1"] - e["v0"])
        flat = e["v0"] == e["v1"]
        a = F.when(flat, e["u0"]).otherwise(u_at(F.greatest(lo, v0)))
        b = F.when(flat, e["u1"]).otherwise(u_at(F.least(hi, v1)))
        return (hi >= v0) & (lo <= v1) & (F.greatest(a, b) >= u0) & (F.least(a, b) <= u1)

    x, y = (bu + 0.5) * size, (bv + 0.5) * size
    return ~F.exists(edges, meets) & (F.size(F.filter(edges, lambda e: _crosses(e, x, y))) % 2 == 1)


def points_in_polygons(points: DataFrame, polygons: DataFrame, u: str, v: str, region: str, order: str, *, ring: str = "polygon", pad: float = 0.0, size: float = 0.5, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """points with the first polygon (by ``order``) that holds them or, with a pad, lies within it of them; row for row. ``how``: inner or left.

    A polygon's edges are dealt to the strips of ``size`` that they (padded) reach into, as a ray to the right meets only edges of its own strip; the strips
    are cut at the polygon's sides into bins, and a point looks into one bin. What comes after a polygon that covers a whole bin is not looked at there, so
    that a bin's list is short however many polygons lie on one another.
    """
    keys = keys or []
    by = [*keys, "_ord", "_region"]
    named = polygons.select(*keys, F.col(order).alias("_ord"), F.col(region).alias("_region"), F.col(ring).alias("_ring0"))
    e = ring_edges(named, by, "_ring0")
    strips = e.withColumn("_bv", _spans(F.least("v0", "v1") - pad, F.greatest("v0", "v1") + pad, size))
    strips = strips.groupBy(*by, "_bv").agg(F.collect_list(F.struct("u0", "v0", "u1", "v1")).alias("_edges"), F.min(F.least("u0", "u1")).alias("_lo"), F.max(F.greatest("u0", "u1")).alias("_hi"))
    bins = strips.withColumn("_bu", _spans(F.col("_lo") - pad, F.col("_hi") + pad, size)).withColumn("_whole", _covers(F.col("_edges"), F.col("_bu"), F.col("_bv"), size))
    at = [*keys, "_bu", "_bv"]
    whole = bins.filter("_whole").groupBy(*at).agg(F.min("_ord").alias("_last"))
    bins = bins.join(whole, at, "left").filter("_last IS NULL OR _ord IS NULL OR _ord <= _last")
    bins = bins.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("_ord", "_region", "_edges"))).alias("_polygons"))
    x, y = F.col(u).cast("double"), F.col(v).cast("double")
    place = [*keys, *dict.fromkeys([u, v])]
    p = points.select(*place).distinct().withColumns({"_bu": F.floor(x / size), "_bv": F.floor(y / size)})  # equal places are looked up once

    def holds(g: Column) -> Column:
        inside = F.size(F.filter(g["_edges"], lambda e: _crosses(e, x, y))) % 2 == 1
        return inside | F.exists(g["_edges"], lambda e: _distance2(e, x, y) <= pad * pad) if pad > 0 else inside

    hit = p.join(bins, at).withColumn("_first", F.try_element_at(F.filter("_polygons", holds), F.lit(1))).filter(F.col("_first").isNotNull())
    return points.join(hit.select(*place, F.col("_first._region").alias("_region")), place, how).select(*points.columns, F.col("_region").alias(region))


def polygon_cells(polygons: DataFrame, res: float, keep: list[str], *, ring: str = "polygon", origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """keep, r, c: cells whose centres lie in the polygons, row by row between every other crossing. A row meets a polygon's crossings of that row only."""
    e = ring_edges(polygons, keep, ring).filter("v0 <> v1")
    lo, hi = (F.ceil((f("v0", "v1") - origin[1]) / res - 0.5) for f in (F.least, F.greatest))
    e = e.withColumns({"_lo": lo, "_hi": hi}).filter("_hi > _lo").withColumn("r", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)))
    y = (F.col("r") + 0.5) * res + origin[1]
    x = e.withColumn("_x", F.col("u0") + (y - F.col("v0")) / (F.col("v1") - F.col("v0")) * (F.col("u1") - F.col("u0")))
    rows = x.groupBy(*keep, "r").agg(F.sort_array(F.collect_list("_x")).alias("_xs")).filter("size(_xs) > 1")
    pairs = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor(F.size("_xs") / 2).cast("int") - 1)))
    ends = [F.ceil((F.get("_xs", 2 * F.col("_i") + k) - origin[0]) / res - 0.5) for k in (0, 1)]
    pairs = pairs.withColumns({"_a": ends[0], "_b": ends[1]}).filter("_b > _a")
    return pairs.select(*keep, "r", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)).alias("c")).distinct()


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of (n, 2) points, counter-clockwise from the least, without collinear vertices: a monotone chain over each side."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows: np.ndarray) -> list:
        out: list = []
        for x, y in rows.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def smallest_rectangle(corners: np.ndarray) -> tuple[float, float, float, float]:
    """(area, long, short, angle) of the rectangle of least area round a hull (counter-clockwise); one of its sides lies on an edge. For each edge the three
    vertices that touch the other sides are looked up by the edges' angles. Of equal areas the longer one counts, then the lesser angle (0 to a right angle)."""
    if len(corners) < 2:
        return 0.0, 0.0, 0.0, 0.0
    step = np.roll(corners, -1, 0) - corners
    length = np.hypot(step[:, 0], step[:, 1])
    d = step / length[:, None]
    if len(corners) == 2:
        return 0.0, float(length[0]), 0.0, float(np.arctan2(d[0, 1], d[0, 0]) % (np.pi / 2))
    angle = np.unwrap(np.arctan2(d[:, 1], d[:, 0]))
    turn = angle[0] + (angle - angle[0]) % (2 * np.pi)  # ascending over one turn
    everywhere = np.concatenate((turn, turn + 2 * np.pi))

    def farthest(direction: np.ndarray) -> np.ndarray:
        """The vertex that lies farthest in a direction: where an edge of a lesser and one of a greater angle than its normal's meet."""
        want = turn[0] + (direction + np.pi / 2 - turn[0]) % (2 * np.pi)
        return corners[np.searchsorted(everywhere, want) % len(corners)]

    along = (d * (farthest(turn) - farthest(turn + np.pi))).sum(1)
    normal = np.stack((-d[:, 1], d[:, 0]), 1)
    across = (normal * (farthest(turn + np.pi / 2) - corners)).sum(1)
    areas, long, short = along * across, np.maximum(along, across), np.minimum(along, across)
    tilt = np.round(turn % (np.pi / 2), 9) % np.round(np.pi / 2, 9)
    i = np.lexsort((tilt, -np.round(long, 9), np.round(areas, 9)))[0]
    return float(areas[i]), float(long[i]), float(short[i]), float(tilt[i])


def _hulls_of(t: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    if keys:
        for k, g in t.groupby(keys, dropna=False, sort=False):
            yield k, hull(g[["_u", "_v"]].to_numpy(float))
    elif len(t):
        yield (), hull(t[["_u", "_v"]].to_numpy(float))


def hulls(points: DataFrame, keys: list[str], u: str, v: str, *, held: int = 20_000) -> DataFrame:
    """keys, hull (ring): convex hulls of any number of points. Each task first keeps the hulls of what it has seen of every key (sending them on when they
    have over ``held`` vertices together), so that a key's hull is made of few vertices from each task. Points with a null or NaN coordinate don't count."""
    p = points.select(*keys, F.col(u).cast("double").alias("_u"), F.col(v).cast("double").alias("_v")).filter("_u IS NOT NULL AND _v IS NOT NULL AND NOT isnan(_u) AND NOT isnan(_v)")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: pd.DataFrame | None = None
        schema = None
        for batch in batches:
            schema = batch.schema
            t = batch.to_pandas()
            t = t if have is None else pd.concat((have, t), ignore_index=True)
            rows = []
            for k, ring in _hulls_of(t, keys):
                part = pd.DataFrame({c: [x] * len(ring) for c, x in zip(keys, k, strict=True)})
                part["_u"], part["_v"] = ring[:, 0], ring[:, 1]
                rows.append(part)
            have = pd.concat(rows, ignore_index=True) if rows else None
            if have is not None and len(have) > held:
                yield pa.RecordBatch.from_pandas(have, schema, preserve_index=False)
                have = None
        if have is not None:
            yield pa.RecordBatch.from_pandas(have, schema, preserve_index=False)

    schema = T.StructType([*p.select(*keys).schema.fields, T.StructField("hull", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def whole(t: pa.Table) -> pa.Table:
        ring = hull(np.stack([t.column(c).to_numpy() for c in ("_u", "_v")], 1))
        first = t.slice(0, 1)
        return pa.table({**{k: first.column(k) for k in keys}, "hull": pa.array([ring.tolist()], pa.list_(pa.list_(pa.float64())))})

    few = p.mapInArrow(partial, p.schema)
    return few.groupBy(*keys).applyInArrow(whole, schema) if keys else few.groupBy(F.lit(0).alias("_all")).applyInArrow(whole, schema)


def rotated_rectangles(rings: DataFrame, keep: list[str], ring: str = "hull") -> DataFrame:
    """keep, rect_area, long_side, short_side, angle: the rectangle of least area, in any direction, round each ring."""

    @F.arrow_udf("struct<rect_area:double,long_side:double,short_side:double,angle:double>")
    def box(column: pa.Array) -> pa.Array:
        out = []
        for r in column.to_pylist():
            p = np.array([x for x in r or [] if x and None not in x[:2]], float).reshape(-1, 2)
            out.append(dict(zip(("rect_area", "long_side", "short_side", "angle"), smallest_rectangle(hull(p)), strict=True)) if len(p) else None)
        return pa.array(out, pa.struct([(c, pa.float64()) for c in ("rect_area", "long_side", "short_side", "angle")]))

    return rings.select(*keep, box(F.col(ring)).alias("_b")).select(*keep, "_b.*")


def _kept(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of a line stay: the ends, and of each part the one farthest from the part's chord, while it is over the tolerance."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, to = line[b] - line[a], line[a + 1 : b] - line[a]
        long2 = float(chord @ chord)
        at = np.clip(to @ chord / long2, 0, 1) if long2 else np.zeros(len(to))
        off = np.hypot(*(to - at[:, None] * chord).T)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplified(polygons: DataFrame, tolerance: float, ring: str = "polygon") -> DataFrame:
    """The polygons with rings of fewer vertices, none of the dropped ones farther than the tolerance from its chord; the first vertex and the one farthest
    from it stay. A ring that would keep under three vertices stays as it is."""

    @F.arrow_udf(_RING)
    def fewer(column: pa.Array) -> pa.Array:
        out = []
        for r in column.to_pylist():
            if r is not None and len(r) > 3:
                p = np.array(r, float)
                far = int(np.argmax(np.hypot(*(p - p[0]).T)))
                line = np.vstack((p, p[:1]))
                keep = np.concatenate((_kept(line[: far + 1], tolerance)[:-1], _kept(line[far:], tolerance)[:-1])) if far else np.ones(len(p), bool)
                r = p[keep].tolist() if keep.sum() > 2 else r
            out.append(r)
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    return polygons.withColumn(ring, fewer(F.col(ring)))
