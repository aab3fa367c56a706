"""Exact order statistics of groups of any size, by histograms that are refined where the wanted ranks lie.

Spark's own percentile keeps every distinct value of a group in one buffer, and a group may be a whole capture. Here a pass counts each group and finds its
ends; then each round deals the values between a rank's bounds to ``BINS`` bins (a count, a least and a greatest value each, combined on the map side) and
keeps the bin that holds the rank. Bounds are values that occur, so every round parts them, and a dozen rounds are enough for any doubles; a round reads only what lies between the bounds of the one before.
A rank is done when its bounds are equal or when at most ``BINS`` values are left, which are then sorted. Groups that small from the start take Spark's
percentile. No buffer holds more than ``BINS`` values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import checkpoint_dir

BINS = 1024
#: Intervals (some 40 bytes each) that are broadcast; more are joined by key.
BROADCAST_ROWS = 200_000


def _joined(values: DataFrame, intervals: DataFrame, names: list[str]) -> DataFrame:
    """Values with those intervals of their group that hold them."""
    right = intervals.select(*[F.col(k).alias(f"{k}_") for k in names], "_lo", "_hi", "_base")
    right = F.broadcast(right) if intervals.count() <= BROADCAST_ROWS else right
    on = F.col("_x").between(F.col("_lo"), F.col("_hi"))
    for k in names:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return values.join(right, on).drop(*[f"{k}_" for k in names])


def _on(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & a[c].eqNullSafe(b[f"{c}_"])
    return out


def _aside(d: DataFrame, names: list[str]) -> DataFrame:
    return d.select(*[F.col(c).alias(f"{c}_") if c in names else F.col(c) for c in d.columns])


def _share(by_log: bool) -> Column:
    """Where _x lies between _lo (0) and _hi (1): never less for a greater value. Linear, or by the logarithm of the size on both sides of zero, so that
    neither values of many magnitudes nor values close together stay in one bin for long: two rounds narrow both by the number of bins."""
    x, lo, hi = (F.col(c) for c in ("_x", "_lo", "_hi"))
    linear = F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2)  # halves, so that no difference overflows
    if by_log:
        code = lambda v: F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log(F.abs(v)) + 745.5))  # the least double's logarithm is -744.4
        linear = F.coalesce(F.try_divide(code(x) - code(lo), code(hi) - code(lo)), linear)
    return F.coalesce(linear, F.when(x < hi, 0.0).otherwise(1.0))


def order_statistics(values: DataFrame, targets: DataFrame, names: list[str]) -> DataFrame:
    """names, _rank, _value: the values (column _x, not null) of each group at the ranks (from 0) of targets: names, _rank, _lo, _hi, _n (the group's ends and size)."""
    state = targets.select(*names, "_rank", "_lo", "_hi", F.lit(0).cast("long").alias("_base"), "_n").checkpoint()
    group = [*names, "_lo", "_hi", "_base"]
    out = state.filter("_lo = _hi").select(*names, "_rank", F.col("_lo").alias("_value"))
    by_log = False
    while True:
        few = state.filter(f"_lo < _hi AND _n <= {BINS}")
        lists = _joined(values, few.select(*group).distinct(), names).groupBy(*group).agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
        side = _aside(lists, group)
        out = out.unionByName(few.join(side, _on(few, side, group)).select(*[few[c] for c in names], "_rank", F.get("_xs", (F.col("_rank") - F.col("_base")).cast("int")).alias("_value")))
        many = state.filter(f"_lo < _hi AND _n > {BINS}")
        if many.isEmpty():
            return out.checkpoint()
        share = _share(by_log)
        by_log = not by_log
        bins = _joined(values, many.select(*group).distinct(), names).groupBy(*group, F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("_bin")).agg(F.count("*").alias("_m"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        before = F.coalesce(F.sum("_m").over(Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        side = _aside(bins.withColumn("_before", before), group)
        within = F.col("_rank") - F.col("_base") - F.col("_before")
        found = many.join(side, _on(many, side, group)).filter((within >= 0) & (within < F.col("_m")))
        state = found.select(*[many[c] for c in names], "_rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), (F.col("_base") + F.col("_before")).alias("_base"), F.col("_m").alias("_n")).checkpoint()
        out = out.unionByName(state.filter("_lo = _hi").select(*names, "_rank", F.col("_lo").alias("_value")))


def quantiles(df: DataFrame, value: str | Column, shares: list[float], keys: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """keys and a column for each share (q0, q1, ... or ``names``): exact percentiles, linear between ranks, as Spark's percentile gives them. Null and NaN
    values don't count; a group of none has no row. Runs passes over df at once, so let df be cheap to read."""
    keys, names = keys or [], names or [f"q{i}" for i in range(len(shares))]
    checkpoint_dir(df.sparkSession)
    ks = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    v = df.select(*([F.col(k).alias(a) for k, a in zip(keys, ks, strict=False)] or [F.lit(0).alias("_k0")]), x.alias("_x")).filter("_x IS NOT NULL AND NOT isnan(_x)")
    stats = v.groupBy(*ks).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).checkpoint()
    back = [F.col(a).alias(k) for k, a in zip(keys, ks, strict=False)]
    if stats.filter((F.col("_n") > BINS) & (F.col("_lo") < F.col("_hi"))).isEmpty():
        return v.groupBy(*ks).agg(*[F.percentile("_x", s).alias(n) for s, n in zip(shares, names, strict=True)]).select(*back, *names)
    places = [F.lit(float(s)) * (F.col("_n") - 1) for s in shares]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]))
    got = order_statistics(v, stats.withColumn("_rank", F.explode(ranks)), ks)
    by_rank = _aside(got.groupBy(*ks).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_values")), ks)
    d = stats.join(by_rank, _on(stats, by_rank, ks))

    def between(place: Column) -> Column:
        low, high = F.floor(place), F.ceil(place)
        a, b = (F.element_at("_values", r.cast("long")) for r in (low, high))
        return F.when(low == high, a).otherwise((high - place) * a + (place - low) * b)

    return d.select(*[stats[a].alias(k) for k, a in zip(keys, ks, strict=False)], *[between(p).alias(n) for p, n in zip(places, names, strict=True)])
