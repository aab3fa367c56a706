"""Robust aggregates: histogram modes, trimmed and circular means, percentile bands, inlier statistics, coverage, voxel reduction.

Every operator takes its keys as column names and aggregates with map-side combination; histograms are sums by bin, so that what is
shuffled is a row for each key and bin, not for each value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import selection


def _least(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    return values.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))


def _join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return a.join(b, keys, how) if keys else a.crossJoin(F.broadcast(b))  # without keys b is one row


def histogram(df: DataFrame, value: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """keys, bin, n, lo, hi: bins of ``width`` from each key's least value on, the last one closed on the right."""
    keys = keys or []
    d = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    d = _join(d, _least(d, keys, "_v"), keys)
    last = F.greatest(F.ceil((F.col("_hi") - F.col("_lo")) / width), F.lit(1)) - 1
    bin_ = F.least(F.floor((F.col("_v") - F.col("_lo")) / width), last)
    return d.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"), F.first("_lo").alias("lo"), F.first("_hi").alias("hi"))


def histogram_mode(df: DataFrame, value: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """keys, mode (the centre of the fullest bin, the lowest of equals), n."""
    keys = keys or []
    h = histogram(df, value, width, keys)
    out = h.groupBy(*keys).agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"), F.max("n").alias("n"), F.first("lo").alias("lo"))
    return out.select(*keys, (F.col("lo") + (F.col("bin") + 0.5) * width).alias("mode"), "n")


def trimmed_mode(df: DataFrame, value: str, width: float, reach: float, keys: list[str] | None = None) -> DataFrame:
    """keys, value (mean of what lies nearer than ``reach`` to the mode; the mode if nothing does), n, std."""
    keys = keys or []
    m = histogram_mode(df, value, width, keys).drop("n")
    d = _join(df.filter(F.col(value).isNotNull()), m, keys)
    near = F.abs(F.col(value) - F.col("mode")) < reach
    x = F.when(near, F.col(value).cast("double"))
    return d.groupBy(*keys).agg(F.coalesce(F.avg(x), F.first("mode")).alias("value"), F.count(x).alias("n"), F.stddev_pop(x).alias("std"))


def floor_and_ceiling(points: DataFrame, y: str = "y", ny: str = "ny", keys: list[str] | None = None, *, width: float = 0.01, reach: float = 0.03, rise: float = 1.8, least: int = 2000) -> DataFrame:
    """keys, floor, ceiling (null with fewer than ``least`` points), ceiling_n. The floor is of up-facing points, the ceiling of
    down-facing ones at least ``rise`` above it. No up-facing point: no row for the key."""
    keys = keys or []
    up = trimmed_mode(points.filter(F.col(ny) > 0.95), y, width, reach, keys).select(*keys, F.col("value").alias("floor"))
    down = _join(points.filter(F.col(ny) < -0.95), up, keys).filter(F.col(y) > F.col("floor") + rise)
    top = trimmed_mode(down, y, width, reach, keys).select(*keys, F.col("value").alias("_c"), F.col("n").alias("_n"))
    count = down.groupBy(*keys).agg(F.count("*").alias("ceiling_n"))
    out = _join(_join(up, top, keys, "left"), count, keys, "left") if keys else up.join(F.broadcast(top), F.lit(True), "left").join(F.broadcast(count), F.lit(True), "left")
    return out.select(*keys, "floor", F.when(F.col("ceiling_n") >= least, F.col("_c")).alias("ceiling"), F.coalesce("ceiling_n", F.lit(0)).alias("ceiling_n"))


def circular_bins(df: DataFrame, angle4: Column, keys: list[str], bins: int) -> DataFrame:
    i = F.pmod(F.floor(F.pmod(angle4, F.lit(2 * math.pi)) / (2 * math.pi / bins)), F.lit(bins)).cast("int")
    return df.groupBy(*keys, i.alias("bin")).agg(F.count("*").alias("n"))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [(i - r, x / sum(w)) for i, x in enumerate(w)]


def smoothed(hist: DataFrame, bins: Column | int, sigma: float, keys: list[str] | None = None, *, wrap: bool = False, bin_col: str = "bin", n_col: str = "n") -> DataFrame:
    """keys, bin, s: a histogram's bins 0..bins-1 (absent ones are zero) through a Gaussian, wrapped round or reflected at the ends.
    Each bin sends its weighted count to its neighbours, 4 sigma each way; the sums meet by bin."""
    keys = keys or []
    n = bins if isinstance(bins, Column) else F.lit(bins)
    kernel = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in gaussian_weights(sigma)])
    b = hist.withColumn("_bins", n).select(*keys, F.col(bin_col).alias("_b"), F.col(n_col).alias("_n"), "_bins", F.explode(kernel).alias("_k"))
    to = F.col("_b") + F.col("_k.o")
    if wrap:
        out = b.withColumn("bin", F.pmod(to, F.col("_bins")))
    else:  # an image of the source lies beyond either end: -1 - b and 2 n - 1 - b
        images = F.array(to, F.lit(-1) - F.col("_b") + F.col("_k.o"), 2 * F.col("_bins") - 1 - F.col("_b") + F.col("_k.o"))
        out = b.withColumn("bin", F.explode(images)).filter((F.col("bin") >= 0) & (F.col("bin") < F.col("_bins")))
    return out.groupBy(*keys, "bin").agg(F.sum(F.col("_n") * F.col("_k.w")).alias("s"))


def manhattan_yaw(df: DataFrame, dx: str, dz: str, keys: list[str] | None = None, *, bins: int = 720, sigma: float = 3.0, reach: float = 0.15) -> DataFrame:
    """keys, yaw: the direction (modulo a quarter turn) of most of the given directions: the mode of four times their angle, smoothed
    round the circle, then the circular mean of what lies within ``reach`` (radians of the fourfold angle) of it."""
    keys = keys or []
    d = df.filter((F.col(dx) != 0) | (F.col(dz) != 0)).select(*keys, F.pmod(4 * F.atan2(F.col(dz), F.col(dx)), F.lit(2 * math.pi)).alias("_a"))
    s = smoothed(circular_bins(d, F.col("_a"), keys, bins), bins, sigma, keys, wrap=True)
    peak = s.groupBy(*keys).agg(F.max_by("bin", F.struct(F.round("s", 9), -F.col("bin"))).alias("_peak")).withColumn("_peak", (F.col("_peak") + 1) * (2 * math.pi / bins))
    d = _join(d, peak, keys)
    off = F.atan2(F.sin(F.col("_a") - F.col("_peak")), F.cos(F.col("_a") - F.col("_peak")))
    return d.filter(F.abs(off) < reach).groupBy(*keys).agg((F.atan2(F.avg(F.sin("_a")), F.avg(F.cos("_a"))) / 4).alias("yaw"))


def percentiles(df: DataFrame, value: str, shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """keys, p<share>: exact percentiles, linear between ranks, of groups of any size."""
    return selection.quantiles(df, value, shares, keys, [f"p{s * 100:g}".replace(".", "_") for s in shares])


def inlier_stats(df: DataFrame, value: str, reach: float, keys: list[str] | None = None) -> DataFrame:
    """keys, median, mean, std (population), n: of the values nearer than ``reach`` to the median."""
    keys = keys or []
    m = selection.quantiles(df, value, [0.5], keys, ["median"])
    d = _join(df.filter(F.col(value).isNotNull()), m, keys).filter(F.abs(F.col(value) - F.col("median")) < reach)
    x = F.col(value).cast("double")
    return d.groupBy(*keys).agg(F.first("median").alias("median"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count("*").alias("n"))


def robust_scale(df: DataFrame, ratio: str, view: str, keys: list[str] | None = None, least: int = 1) -> DataFrame:
    """keys, scale (median of the views' median ratios), p16, p84, spread (sqrt(p84 / p16) - 1), views (those with ``least`` ratios)."""
    keys = keys or []
    v = df.groupBy(*keys, view).agg(F.median(ratio).alias("_m"), F.count(ratio).alias("_n")).filter(F.col("_n") >= least)
    return v.groupBy(*keys).agg(F.median("_m").alias("scale"), F.percentile("_m", 0.16).alias("p16"), F.percentile("_m", 0.84).alias("p84"), (F.sqrt(F.try_divide(F.percentile("_m", 0.84), F.percentile("_m", 0.16))) - 1).alias("spread"), F.count("*").alias("views"))


def confidence_levels(df: DataFrame, conf: str, view: str, least: int = 100) -> DataFrame:
    """df with level 0, 1, 2: under the view's 15th percentile, under its 40th, above; 0 throughout a view of fewer than ``least`` rows."""
    q = df.groupBy(view).agg(F.percentile(conf, 0.15).alias("_p15"), F.percentile(conf, 0.40).alias("_p40"), F.count(conf).alias("_n"))
    d = df.join(q, view)
    return d.withColumn("level", F.when(F.col("_n") < least, 0).when(F.col(conf) < F.col("_p15"), 0).when(F.col(conf) < F.col("_p40"), 1).otherwise(2)).drop("_p15", "_p40", "_n")


def height_coverage(df: DataFrame, cell: list[str], h: Column, lo: float | Column, hi: float | Column, step: float) -> DataFrame:
    """cell, coverage: the share of the height bins in (lo, hi) that hold a point. Columns lo and hi are the same throughout a cell."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    bins = F.greatest(F.lit(1).cast("long"), F.ceil((hi - lo) / step - 1e-9))
    d = df.filter((h > lo) & (h < hi)).select(*cell, F.least(F.floor((h - lo) / step), bins - 1).alias("_b"), bins.alias("_bins"))
    return d.groupBy(*cell).agg((F.count_distinct("_b") / F.max("_bins")).alias("coverage"))


def voxel_nearest(df: DataFrame, xyz: list[str], size: float, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """The row of each voxel that comes first by ``order`` (give a total order: the nearest, then what tells rows apart)."""
    cells = [F.floor(F.col(c) / size).alias(f"_k{i}") for i, c in enumerate(xyz)]
    row = F.struct(*df.columns)
    return df.groupBy(*(keys or []), *cells).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def crispness(df: DataFrame, value: str, axis: str, keys: list[str] | None = None, *, width: float = 0.01, share: float = 0.99, reach: float = 0.1) -> DataFrame:
    """keys, crispness: median distance of values to the nearest peak bin (above the percentile ``share`` of all bins, empty ones too), mean of the axes."""
    keys = keys or []
    by = [*keys, axis]
    h = histogram(df, value, width, by)
    ends = h.groupBy(*by).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    last = F.greatest(F.ceil((F.col("hi") - F.col("lo")) / width), F.lit(1)) - 1
    dense = ends.select(*by, "lo", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("bin")).join(h.select(*by, "bin", "n"), [*by, "bin"], "left").fillna({"n": 0})
    top = dense.groupBy(*by).agg(F.percentile("n", share).alias("_p"))
    peaks = dense.join(top, by).filter(F.col("n") > F.col("_p")).select(*by, (F.col("lo") + (F.col("bin") + 0.5) * width).alias("_c"))
    peaks = peaks.groupBy(*by).agg(F.sort_array(F.collect_list("_c")).alias("_peaks"))  # at most one bin in a hundred
    # broadcast: a number for each hundredth bin of an axis at most. A join by axis would bring all values of one to a task
    d = df.join(F.broadcast(peaks), by).withColumn("_d", F.array_min(F.transform("_peaks", lambda c: F.abs(c - F.col(value)))))
    each = selection.quantiles(d.filter(F.col("_d") < reach), "_d", [0.5], by, ["_m"])
    return each.groupBy(*keys).agg(F.avg("_m").alias("crispness"))


def local_peaks(df: DataFrame, index: str, value: str, keys: list[str] | None = None, half: int = 4, least: float = 30.0) -> DataFrame:
    """Rows of a dense series that are the greatest within ``half`` places either way and exceed ``least``."""
    w = Window.partitionBy(*(keys or [])).orderBy(index).rangeBetween(-half, half)
    return df.withColumn("_top", F.max(value).over(w)).filter((F.col(value) > F.col("_top") - 1e-9) & (F.col(value) > least)).drop("_top")
