"""Registration: similarity transforms from moments, robust refits, trimmed 2-D ICP, pose graphs, gravity, drift correction."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import priors
from .graph import checkpoint_dir
from .selection import quantiles


@dataclass
class Similarity:
    """b = scale * rotation @ a + shift"""

    scale: float
    rotation: np.ndarray
    shift: np.ndarray

    def residual(self, a: list[str], b: list[str]):
        r = self.scale * self.rotation
        d2 = F.lit(0.0)
        for i in range(3):
            e = sum((F.col(a[j]) * float(r[i, j]) for j in range(3)), start=F.lit(float(self.shift[i]))) - F.col(b[i])
            d2 = d2 + e * e
        return F.sqrt(d2)


def umeyama(pairs: DataFrame, a: list[str], b: list[str], *, with_scale: bool = True) -> Similarity:
    """The least-squares similarity of point pairs: one pass over the pairs for 16 moments, a 3x3 decomposition on the driver."""
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in [*a, *b]], *[F.sum(F.col(x) * F.col(y)).alias(f"p_{x}_{y}") for x in a for y in b], F.sum(sum(F.col(x) * F.col(x) for x in a)).alias("q")]
    m = pairs.agg(*sums).first()
    n = m["n"]
    ma, mb = (np.array([m[f"s_{c}"] for c in cols], float) / n for cols in (a, b))
    cov = np.array([[m[f"p_{x}_{y}"] for x in a] for y in b], float) / n - np.outer(mb, ma)
    var = float(m["q"]) / n - ma @ ma
    u, s, vt = np.linalg.svd(cov)
    flip = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1])
    rotation = u @ flip @ vt
    scale = float((s * np.diag(flip)).sum() / var) if with_scale and var > 0 else 1.0
    return Similarity(scale, rotation, mb - scale * rotation @ ma)


def robust_similarity(pairs: DataFrame, a: list[str], b: list[str], *, rounds: int = 4, keep: float = 0.7, with_scale: bool = True) -> Similarity:
    """Refits to the pairs within the residuals' quantile ``keep``, so many times."""
    fit = umeyama(pairs, a, b, with_scale=with_scale)
    for _ in range(rounds - 1):
        d = pairs.withColumn("_r", fit.residual(a, b))
        limit = quantiles(d, "_r", [keep]).first()
        fit = umeyama(d.filter(F.col("_r") <= (limit[0] if limit else 0.0)), a, b, with_scale=with_scale)
    return fit


def gravity(normals: DataFrame, n: list[str], guess: tuple[float, float, float]) -> np.ndarray:
    """The mean of normals near the guess, refined within cosines of 0.8, 0.9 and 0.97."""
    up = np.array(guess, float) / np.linalg.norm(guess)
    for least in (0.8, 0.9, 0.97):
        cos = sum(F.col(c) * float(up[i]) for i, c in enumerate(n))
        m = normals.filter(cos > least).agg(*[F.avg(c) for c in n]).first()
        if m[0] is None:
            break
        up = np.array(list(m), float) / np.linalg.norm(list(m))
    return up


def _nearest(src: np.ndarray, dst: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point of src the nearest point of dst within reach and its distance (-1 and infinity without one), by cells of that size."""
    span = 1 << 31
    name = lambda x: x[:, 0] * span + x[:, 1]
    cells = np.floor(dst / reach).astype(np.int64)
    order = np.argsort(name(cells), kind="stable")
    keys, home = name(cells)[order], np.floor(src / reach).astype(np.int64)
    best, dist = np.full(len(src), -1), np.full(len(src), np.inf)
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            k = name(home + [a, b])
            lo, hi = np.searchsorted(keys, k), np.searchsorted(keys, k, "right")
            n = hi - lo
            who = np.repeat(np.arange(len(src)), n)
            if not len(who):
                continue
            j = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            d = np.hypot(*(dst[j] - src[who]).T)
            first = (np.cumsum(n) - n)[n > 0]
            least = np.minimum.reduceat(d, first)
            at = np.flatnonzero(d == np.repeat(least, n[n > 0]))
            own, one = np.unique(who[at], return_index=True)
            better = least < dist[own]
            best[own[better]], dist[own[better]] = j[at[one]][better], least[better]
    far = dist >= reach
    best[far], dist[far] = -1, np.inf
    return best, dist


def icp_2d(src: np.ndarray, dst: np.ndarray, *, rounds: int = 25, reach: float = 0.15, trim: float = 0.8, least: int = 50) -> tuple[float, np.ndarray, float]:
    """Yaw, shift and inlier share that lay src on dst about src's centroid; the best ``trim`` of the pairs within ``reach`` count."""
    centre = src.mean(0)
    yaw, shift, share = 0.0, np.zeros(2), 0.0
    for _ in range(rounds):
        r = np.array([[np.cos(yaw), -np.sin(yaw)], [np.sin(yaw), np.cos(yaw)]])
        moved = (src - centre) @ r.T + centre + shift
        idx, dist = _nearest(moved, dst, reach)
        ok = idx >= 0
        share = float(ok.mean())
        if ok.sum() < least:
            break
        ok &= dist <= np.quantile(dist[ok], trim)
        a, b = moved[ok], dst[idx[ok]]
        ca, cb = a.mean(0), b.mean(0)
        u, v = a - ca, b - cb
        turn = np.arctan2((u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]).sum(), (u * v).sum())
        rt = np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
        # the composition, written about src's centroid again
        shift = rt @ (centre + shift - ca) + cb - centre
        yaw += turn
        if abs(turn) < 1e-5 and np.hypot(*(cb - ca)) < 1e-4:
            break
    return float(yaw), shift, share


def anchors(points: DataFrame, *, keys: list[str], segment_s: float, apart: float = priors.REVISIT_S, most_yaw: float = 4.0, most_shift: float = 0.25, least_share: float = 0.5, least: int = 200, overlap: float = 0.3) -> DataFrame:
    """keys, segment, yaw, du, dv, weight: what of each segment lies within ``overlap`` of the segments at least ``apart`` seconds away (so many
    points at least) laid on these; implausible moves go. The weight is the share of inliers times that of the overlap. The map of a
    capture is voxel-reduced before, which bounds a key."""
    head = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mids = {s: (s + 0.5) * segment_s for s in pdf["segment"].unique()}
        mid = pdf["segment"].map(mids).to_numpy()
        xy = pdf[["u", "v"]].to_numpy(float)
        rows = []
        for s in sorted(mids):
            own, far = xy[pdf["segment"].to_numpy() == s], xy[np.abs(mid - mids[s]) >= apart]
            if len(own) < least or not len(far):
                continue
            near = _nearest(own, far, overlap)[0] >= 0
            if near.sum() < least:
                continue
            yaw, t, share = icp_2d(own[near], far)
            if abs(np.degrees(yaw)) <= most_yaw and np.hypot(*t) <= most_shift and share >= least_share:
                rows.append((int(s), yaw, float(t[0]), float(t[1]), share * float(near.mean())))
        out = pd.DataFrame(rows, columns=["segment", "yaw", "du", "dv", "weight"]).astype({"segment": "int64", "yaw": float, "du": float, "dv": float, "weight": float})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return points.groupBy(*keys).applyInPandas(run, f"{head}{', ' * bool(keys)}segment long, yaw double, du double, dv double, weight double")


def thomas(lower: np.ndarray, diag: np.ndarray, upper: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solves a tridiagonal system for several right-hand sides."""
    n = len(diag)
    d, y = diag.astype(float).copy(), rhs.astype(float).copy()
    for i in range(1, n):
        w = lower[i - 1] / d[i - 1]
        d[i] -= w * upper[i - 1]
        y[i] -= w * y[i - 1]
    y[-1] /= d[-1]
    for i in range(n - 2, -1, -1):
        y[i] = (y[i] - upper[i] * y[i + 1]) / d[i]
    return y


def pose_graph(segments: DataFrame, *, keys: list[str], values: list[str], weight: str | None = None, odometry: float = priors.SIGMA_ODOMETRY, icp: float = priors.SIGMA_ICP) -> DataFrame:
    """keys, segment, values: corrections that vary little from segment to segment and agree with the anchors (null values: no anchor), each as
    much as its weight says (one without a column of weights); the chain's normal equations are tridiagonal."""
    head = ", ".join(f"`{k}` {segments.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment")
        n, a, b = len(pdf), 1 / odometry**2, 1 / icp**2
        seen = pdf[values[0]].notna().to_numpy() * (pdf[weight].fillna(0).to_numpy(float) if weight else 1.0)
        off = np.full(n - 1, -a)
        diag = np.full(n, 2 * a)
        diag[[0, -1]] = a if n > 1 else 0
        diag = diag + b * seen + 1e-9
        x = thomas(off, diag, off, b * np.nan_to_num(pdf[values].to_numpy(float)) * seen[:, None])
        out = pdf[["segment"]].assign(**{v: x[:, i] for i, v in enumerate(values)})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return segments.groupBy(*keys).applyInPandas(run, f"{head}{', ' * bool(keys)}segment long, {', '.join(f'{v} double' for v in values)}")


def corrected(points: DataFrame, u: str, v: str, cu: str, cv: str, yaw: str, du: str, dv: str) -> DataFrame:
    """points turned about their camera (cu, cv) and moved."""
    x, y = F.col(u) - F.col(cu), F.col(v) - F.col(cv)
    c, s = F.cos(yaw), F.sin(yaw)
    return points.withColumns({u: F.col(cu) + c * x - s * y + F.col(du), v: F.col(cv) + s * x + c * y + F.col(dv)})


def drift_gate(rows: DataFrame, ghost_raw: str, ghost: str, crisp_raw: str, crisp: str, mode: str | None = None) -> DataFrame:
    """rows with apply: correct if ghosting falls by 5 % and crispness worsens by under 5 %, or if the mode says so."""
    auto = (F.col(ghost) < 0.95 * F.col(ghost_raw)) & (F.col(crisp) < 1.05 * F.col(crisp_raw))
    if mode is None:
        return rows.withColumn("apply", F.coalesce(auto, F.lit(False)))
    return rows.withColumn("apply", F.when(F.col(mode) == "on", True).when(F.col(mode) == "off", False).otherwise(F.coalesce(auto, F.lit(False))))


def link_score(inliers, residual):
    return inliers / (1 + 10 * residual)


def offset_search(faces: DataFrame, other: DataFrame, *, step: float = 0.1, half: int = 24, radius: float = 0.1, sample: int | None = None) -> DataFrame:
    """k, du, dv, share: for four quarter turns and a grid of offsets, how many of the points (u, v) land within the radius of another
    point; the best first. Offsets times points is joined by cell, not compared with every point."""
    k = faces.select("u", "v").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    x = F.when(F.col("k") == 0, F.col("u")).when(F.col("k") == 1, -F.col("v")).when(F.col("k") == 2, -F.col("u")).otherwise(F.col("v"))
    y = F.when(F.col("k") == 0, F.col("v")).when(F.col("k") == 1, F.col("u")).when(F.col("k") == 2, -F.col("v")).otherwise(-F.col("u"))
    t = k.select("k", x.alias("x"), y.alias("y")).withColumn("i", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("j", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    t = t.select("k", "i", "j", F.floor((F.col("x") + F.col("i") * step) / radius).alias("cx"), F.floor((F.col("y") + F.col("j") * step) / radius).alias("cy"))
    cells = other.select(F.explode(F.array(*[F.struct((F.floor(F.col("u") / radius) + a).alias("cx"), (F.floor(F.col("v") / radius) + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("c")).select("c.*").distinct()
    n = faces.count()
    hit = t.join(cells, ["cx", "cy"], "left_semi").groupBy("k", "i", "j").agg((F.count("*") / n).alias("share"))
    return hit.select("k", (F.col("i") * step).alias("du"), (F.col("j") * step).alias("dv"), "share")


def plan_registration(faces: DataFrame, other: DataFrame, *, reach: float = 0.3, **search) -> DataFrame:
    """k, yaw, du, dv, share, inliers: the best quarter turn and offset of offset_search(), refined by ICP: a point p of faces lands on
    R(yaw) (quarter turn k of p) + (du, dv); share is the search's, inliers ICP's. Points are two plans' sampled walls: some thousand each, which one task holds;
    without points in common there is no row."""
    best = offset_search(faces, other, **search).orderBy(F.desc("share"), "k", "du", "dv").limit(1)
    side = lambda d, which: d.select(F.lit(which).alias("side"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    both = side(faces, 0).unionByName(side(other, 1)).join(F.broadcast(best), F.lit(True))  # one row

    def refine(pdf: pd.DataFrame) -> pd.DataFrame:
        k, t0 = int(pdf["k"].iloc[0]), pdf[["du", "dv"]].iloc[0].to_numpy(float)
        a, b = (pdf.loc[pdf["side"] == s, ["u", "v"]].to_numpy(float) for s in (0, 1))
        quarter = np.array([[1, 0], [0, 1]]) if k == 0 else np.array([[0, -1], [1, 0]]) if k == 1 else np.array([[-1, 0], [0, -1]]) if k == 2 else np.array([[0, 1], [-1, 0]])
        moved = a @ quarter.T + t0
        yaw, shift, share = icp_2d(moved, b, reach=reach)
        r, centre = np.array([[np.cos(yaw), -np.sin(yaw)], [np.sin(yaw), np.cos(yaw)]]), moved.mean(0)
        t = r @ t0 + centre - r @ centre + shift
        return pd.DataFrame({"k": [k], "yaw": [yaw], "du": [t[0]], "dv": [t[1]], "share": [float(pdf["share"].iloc[0])], "inliers": [share]})

    return both.groupBy("k", "share").applyInPandas(refine, "k int, yaw double, du double, dv double, share double, inliers double")


#: A transform as the 12 numbers of the first three rows of its matrix, row by row: scale and rotation (or any linear part), then the shift.
IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def after(outer: Column, inner: Column) -> Column:
    """The transform that does ``inner`` first, then ``outer`` (arrays of 12)."""
    cell = lambda i, j: sum((outer[4 * i + k] * inner[4 * k + j] for k in range(1, 3)), start=outer[4 * i] * inner[j])
    return F.array(*[cell(i, j) + (outer[4 * i + 3] if j == 3 else 0.0) for i in range(3) for j in range(4)])


def plan_transform(yaw: Column, du: Column, dv: Column) -> Column:
    """A turn about the vertical and a shift in the plan (u, v, height)."""
    c, s, one, no = F.cos(yaw), F.sin(yaw), F.lit(1.0), F.lit(0.0)
    return F.array(c, -s, no, du, s, c, no, dv, no, no, one, no)


def composed_poses(tree: DataFrame, keys: list[str], node: str = "node", parent: str = "parent", transform: str = "m", *, rounds: int = 64) -> DataFrame:
    """keys, node, root, m: each node's transform to its root, from its transform to its parent. A root has a null parent (or one without a row, which is the
    frame of reference then) and its own transform counts.

    Pointers double: a node that knows the way to an ancestor takes over the ancestor's way, so a chain of n nodes takes log2(n) rounds, each a join of the
    nodes on their way with all. Composition isn't commutative, so ways are always taken on the outside. A cycle is an error.
    """
    checkpoint_dir(tree.sparkSession)
    now = tree.select(*keys, F.col(node).alias("_n"), F.col(parent).alias("_p"), F.coalesce(F.col(parent), F.col(node)).alias("_root"), F.col(transform).alias("_m")).checkpoint()
    for _ in range(rounds):
        on_way = now.filter("_p IS NOT NULL")
        if on_way.isEmpty():
            return now.select(*keys, F.col("_n").alias(node), F.col("_root").alias("root"), F.col("_m").alias(transform))
        far = now.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_n").alias("_an"), F.col("_p").alias("_ap"), F.col("_root").alias("_ar"), F.col("_m").alias("_am"))
        same = F.col("_p") == F.col("_an")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        j = on_way.join(far, same, "left")
        known = F.col("_an").isNotNull()
        step = j.select(*keys, "_n", F.when(known, F.col("_ap")).alias("_p"), F.when(known, F.col("_ar")).otherwise(F.col("_root")).alias("_root"), F.when(known, after(F.col("_am"), F.col("_m"))).otherwise(F.col("_m")).alias("_m"))
        now = now.filter("_p IS NULL").unionByName(step).checkpoint()
    raise ValueError("the parents form a cycle, or a chain beyond 2 to the power of the rounds")
