"""Nearest points seen at another time, on clouds of any density, through k-d leaves with boxes and time extremes.

Points are put in Morton order by range partitioning, and each task cuts what it gets into k-d leaves of at most ``LEAF`` points, at medians of the longer
side. A point first meets its own leaf, which bounds how far its nearest can be. Leaves are then looked up by the bins that their boxes lie in, and a leaf
is visited only if its box is nearer than the bound and its times reach far enough from the point's: both ends prune. A visit meets at most LEAF points, so
the work grows with the rows and not with how many of them share a cell. Leaves that many points visit are split among groups of at most ``VISITS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpoint_dir

LEAF, CHUNK, VISITS = 512, 65_536, 32_768
_ROW = ["_u", "_v", "_t"]


def morton(x: Column, y: Column, size: float) -> Column:
    """The bits of both cell numbers in turn (32 of each)."""

    def spread(c: Column) -> Column:
        c = F.least(F.greatest(F.floor(c / size) + F.lit(1 << 31), F.lit(0)), F.lit((1 << 32) - 1)).cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def kd_leaves(u: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """The number (0, 1, ...) of each point's leaf: halves at the median of the longer side until none has over ``most`` points."""
    out, todo, n = np.zeros(len(u), np.int64), [np.arange(len(u))], 0
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out[rows] = n
            n += 1
            continue
        x = u[rows] if np.ptp(u[rows]) >= np.ptp(v[rows]) else v[rows]
        half = np.argpartition(x, len(rows) // 2)
        todo += [rows[half[len(rows) // 2 :]], rows[half[: len(rows) // 2]]]
    return out


def nearest_apart(a: np.ndarray, b: np.ndarray, apart: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row (u, v, t) of a the squared distance and place of the nearest of b that is ``apart`` in time; the first of equals; infinite if none."""
    d2 = (a[:, None, 0] - b[None, :, 0]) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2
    d2[np.abs(a[:, None, 2] - b[None, :, 2]) < apart] = np.inf
    at = np.argmin(d2, 1)
    return d2[np.arange(len(a)), at], at


def leaves(points: DataFrame, keys: list[str], radius: float, apart: float) -> DataFrame:
    """points (keys, _id, _u, _v, _t) with _leaf and, from within the leaf, _d2 and _near (null: none within the radius)."""
    kind = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    names = [*keys, "_id", *_ROW]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held: list[pd.DataFrame] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            if not held:
                return
            # within a leaf rows stand by id, so that the first of equal distances has the least
            d = pd.concat(held, ignore_index=True).sort_values("_id", kind="stable", ignore_index=True)
            held = []
            x = d[_ROW].to_numpy(float)
            leaf = kd_leaves(x[:, 0], x[:, 1], LEAF)
            best, near = np.full(len(d), np.inf), np.zeros(len(d), np.int64)
            order = np.argsort(leaf, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
                d2, at = nearest_apart(x[rows], x[rows], apart)
                best[rows], near[rows] = d2, rows[at]
            found = best < radius * radius
            ids = pa.array(d["_id"])
            out = {**{c: pa.array(d[c]) for c in names}, "_leaf": pa.array(leaf + number), "_d2": pa.array(best, mask=~found), "_near": ids.take(pa.array(near, mask=~found))}
            number += int(leaf.max()) + 1
            yield pa.RecordBatch.from_pydict(out).cast(schema) if schema else pa.RecordBatch.from_pydict(out)

        schema, now = None, None
        for batch in batches:
            if schema is None:
                own = batch.schema
                schema = pa.schema([*(own.field(c) for c in names), pa.field("_leaf", pa.int64()), pa.field("_d2", pa.float64()), pa.field("_near", own.field("_id").type)])
            t = batch.select(names).to_pandas()
            groups = t.groupby(keys, dropna=False, sort=False) if keys else [((), t)]
            for k, g in groups:
                k = tuple(None if x != x else x for x in (k if isinstance(k, tuple) else (k,)))
                if k != now or sum(map(len, held)) >= CHUNK:
                    yield from close()
                    now = k
                held.append(g)
        yield from close()

    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    z = points.withColumn("_z", morton(F.col("_u"), F.col("_v"), radius / 16))
    ranged = z.repartitionByRange(n, *keys, "_z").sortWithinPartitions(*keys, "_z").select(*names)
    return ranged.mapInArrow(cut, ", ".join(f"`{c}` {kind[c]}" for c in names) + f", _leaf long, _d2 double, _near {kind['_id']}").checkpoint()


def visits(cut: DataFrame, keys: list[str], radius: float, apart: float) -> DataFrame:
    """keys, _to (leaf), _id, _u, _v, _t, _r2: which other leaves each point has to look into, and how near something there must be."""
    box = cut.groupBy(*keys, F.col("_leaf").alias("_to")).agg(*[f(c).alias(f"{c}{i}") for c in _ROW for i, f in enumerate((F.min, F.max))])
    size = radius / 2
    bins = lambda d, lo_u, hi_u, lo_v, hi_v: d.withColumn("_bu", F.explode(F.sequence(F.floor(lo_u / size), F.floor(hi_u / size)))).withColumn("_bv", F.explode(F.sequence(F.floor(lo_v / size), F.floor(hi_v / size))))
    b = bins(box, F.col("_u0"), F.col("_u1"), F.col("_v0"), F.col("_v1"))
    p = cut.select(*keys, "_leaf", "_id", *_ROW, F.coalesce("_d2", F.lit(radius * radius)).alias("_r2")).withColumn("_r", F.sqrt("_r2") * (1 + 1e-9))
    p = bins(p, F.col("_u") - F.col("_r"), F.col("_u") + F.col("_r"), F.col("_v") - F.col("_r"), F.col("_v") + F.col("_r"))
    j = p.join(b, [*keys, "_bu", "_bv"]).filter(F.col("_leaf") != F.col("_to"))
    off = lambda c: F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0.0))
    near = off("_u") * off("_u") + off("_v") * off("_v") <= F.col("_r2")
    late = F.greatest(F.abs(F.col("_t") - F.col("_t0")), F.abs(F.col("_t") - F.col("_t1"))) >= apart
    once = (F.col("_bu") == F.floor(F.greatest(F.col("_u") - F.col("_r"), F.col("_u0")) / size)) & (F.col("_bv") == F.floor(F.greatest(F.col("_v") - F.col("_r"), F.col("_v0")) / size))
    return j.filter(near & late & once).select(*keys, "_to", "_id", *_ROW, "_r2")


def revisit_distance(points: DataFrame, point_id: str, xy: tuple[str, str], time: str, radius: float, apart: float, keys: list[str] | None = None) -> DataFrame:
    """keys, point_id, near_<point_id>, d2: each point's nearest point, nearer than ``radius``, that was seen at least ``apart`` earlier or later; of equal
    distances the least id. Points without a place or a time don't take part; ids are unique in a key."""
    keys = keys or []
    checkpoint_dir(points.sparkSession)
    p = points.select(*keys, F.col(point_id).alias("_id"), *[F.col(c).cast("double").alias(a) for c, a in zip((*xy, time), _ROW, strict=True)]).dropna(subset=_ROW)
    kind = {f.name: f.dataType.simpleString() for f in p.schema.fields}
    cut = leaves(p, keys, radius, apart)
    asked = visits(cut, keys, radius, apart).checkpoint()
    shares = asked.groupBy("_to").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("_parts"))
    asked = asked.join(shares, "_to").withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
    there = cut.select(F.col("_leaf").alias("_to"), "_id", *_ROW).join(shares, "_to").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    there = there.select(*[F.col(c).alias(f"r{c}") for c in ("_to", "_part", "_id", *_ROW)])  # both sides come from one table

    def visit(target: pa.Table, guests: pa.Table) -> pa.Table:
        target = target.sort_by("r_id")
        a, b = (np.stack([t.column(f"{r}{c}").to_numpy() for c in _ROW], 1) for t, r in ((guests, ""), (target, "r")))
        r2 = guests.column("_r2").to_numpy()
        best, at = np.full(len(a), np.inf), np.zeros(len(a), np.int64)
        for i in range(0, len(a), 2048):
            best[i : i + 2048], at[i : i + 2048] = nearest_apart(a[i : i + 2048], b, apart)
        ok = (best <= r2) & (best < radius * radius)
        rows = pa.array(np.flatnonzero(ok))
        return pa.table({**{k: guests.column(k).take(rows) for k in keys}, "_id": guests.column("_id").take(rows), "_d2": pa.array(best[ok]), "_near": target.column("r_id").take(pa.array(at[ok]))})

    found = there.groupBy("r_to", "r_part").cogroup(asked.groupBy("_to", "_part")).applyInArrow(visit, ", ".join(f"`{c}` {kind[c]}" for c in [*keys, "_id"]) + f", _d2 double, _near {kind['_id']}")
    both = cut.filter("_d2 IS NOT NULL").select(*keys, "_id", "_d2", "_near").unionByName(found)
    best = both.groupBy(*keys, "_id").agg(F.min(F.struct("_d2", "_near")).alias("_b"))
    return best.select(*keys, F.col("_id").alias(point_id), F.col("_b._near").alias(f"near_{point_id}"), F.col("_b._d2").alias("d2"))
