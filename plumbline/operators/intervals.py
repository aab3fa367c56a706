"""Intervals and runs: gaps and islands, merging, gaps, coverage, closing, bridging, ordered folds.

Running operators use one window by key; the key must part the data (capture, axis, line, ...), as it does in measurement data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(df: DataFrame, index: str, keys: list[str], max_step: int | float = 1) -> DataFrame:
    """keys, first, last, n: runs of indices whose neighbours differ by ``max_step`` at most."""
    w = Window.partitionBy(*keys).orderBy(index)
    step = F.col(index) - F.lag(index).over(w)
    d = df.withColumn("_new", F.when(step.isNull() | (step > max_step), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_run").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n")).drop("_run")


def closed_runs(df: DataFrame, index: str, keys: list[str], half: int, width: float, least: float, origin: Column | float = 0.0) -> DataFrame:
    """keys, a, b: intervals of occupied columns after closing gaps of up to 2 * half columns, of length ``least`` or more."""
    runs = islands(df.select(*keys, index).distinct(), index, keys, 2 * half + 1)
    o = origin if isinstance(origin, Column) else F.lit(origin)
    a, b = o + F.col("first") * width, o + (F.col("last") + 1) * width
    return runs.select(*keys, a.alias("a"), b.alias("b")).filter(F.col("b") - F.col("a") >= least - 1e-9)


def bridged(cells: DataFrame, along: str, line: list[str], gap: int) -> DataFrame:
    """Cells of each line with the gaps of fewer than ``gap`` cells between them filled."""
    w = Window.partitionBy(*line).orderBy(along)
    d = cells.select(*line, along).distinct().withColumn("_next", F.lead(along).over(w))
    to = F.when(F.col("_next") - F.col(along) <= gap, F.col("_next") - 1).otherwise(F.col(along))
    return d.select(*line, F.explode(F.sequence(F.col(along), to)).alias(along))


def merged(df: DataFrame, lo: str, hi: str, keys: list[str], gap: float = 0.02) -> DataFrame:
    """keys, a, b, n: unions of intervals that overlap or lie within ``gap`` of each other."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    d = df.withColumn("_reach", F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(lo) - F.col("_reach") > gap), 1).otherwise(0))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_run").agg(F.min(lo).alias("a"), F.max(hi).alias("b"), F.count("*").alias("n")).drop("_run")


def gaps(intervals: DataFrame, keys: list[str], lo: str = "a", hi: str = "b", least: float = 0.0, most: float | None = None) -> DataFrame:
    """keys, a, b: what lies between an interval and the next, of a length from ``least`` to ``most``."""
    w = Window.partitionBy(*keys).orderBy(lo)
    d = intervals.withColumn("_next", F.lead(lo).over(w)).select(*keys, F.col(hi).alias("a"), F.col("_next").alias("b")).filter(F.col("b").isNotNull())
    length = F.col("b") - F.col("a")
    return d.filter(length >= least) if most is None else d.filter((length >= least) & (length <= most))


def coverage(targets: DataFrame, parts: DataFrame, keys: list[str], target_id: list[str], width: float = 1.0) -> DataFrame:
    """targets with covered: the share of [a, b] that the keys' (disjoint) intervals cover; 0 without any. Both sides are cut at multiples of
    ``width`` and meet by bin, so that a long key isn't compared with itself."""
    cut = lambda d, lo, hi: d.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    p = cut(parts.select(*keys, F.col("a").alias("pa"), F.col("b").alias("pb")), "pa", "pb")
    by = list(dict.fromkeys([*keys, *target_id]))
    edge = F.col("_bin") * width
    over = F.greatest(F.lit(0.0), F.least("b", "pb", edge + width) - F.greatest("a", "pa", edge))
    got = cut(targets.select(*by, "a", "b"), "a", "b").join(p, [*keys, "_bin"]).groupBy(*by).agg(F.sum(over).alias("_s"))
    return targets.join(got, by, "left").withColumn("covered", F.coalesce(F.try_divide("_s", F.col("b") - F.col("a")), F.lit(0.0))).drop("_s")


def cut_lines(df: DataFrame, coord: str, weight: str, keys: list[str], merge: float = 0.035) -> DataFrame:
    """keys, coord, weight: positions, in order, join the line before while nearer than ``merge`` to its weighted mean so far. An ordered
    fold over a key's positions (walls of one capture)."""
    item = F.struct(F.col(coord).cast("double").alias("c"), F.col(weight).cast("double").alias("w"))
    start = F.expr("cast(array() as array<struct<c:double,w:double>>)")

    def step(lines: Column, x: Column) -> Column:
        last = F.element_at(lines, -1)
        near = (F.size(lines) > 0) & (x["c"] - F.try_element_at(lines, F.lit(-1))["c"] < merge)
        total = last["w"] + x["w"]
        joined = F.struct(((last["c"] * last["w"] + x["c"] * x["w"]) / total).alias("c"), total.alias("w"))
        return F.when(near, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(joined))).otherwise(F.concat(lines, F.array(F.struct(x["c"].alias("c"), x["w"].alias("w")))))

    folded = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_x")).withColumn("_l", F.aggregate("_x", start, step))
    return folded.select(*keys, F.posexplode("_l").alias("ord", "_c")).select(*keys, "ord", F.col("_c.c").alias("coord"), F.col("_c.w").alias("weight"))


def principal_line(df: DataFrame, coord: str, length: str, is_measured: str, keys: list[str], merge: float = 0.03) -> DataFrame:
    """keys, coord, measured: edges within ``merge`` of a line's first edge make a line; measured lines go before free-space ones, then
    the weight (length, measured edges in full, others at 0.3) decides, then the lower coordinate."""
    item = F.struct(F.col(coord).cast("double").alias("c"), F.col(length).cast("double").alias("l"), F.col(is_measured).alias("m"))
    start = F.expr("cast(array() as array<struct<c0:double,cl:double,l:double,w:double,m:boolean>>)")

    def step(lines: Column, x: Column) -> Column:
        w = x["l"] * F.when(x["m"], F.lit(1.0)).otherwise(F.lit(0.3))
        last = F.element_at(lines, -1)
        near = (F.size(lines) > 0) & (x["c"] - F.try_element_at(lines, F.lit(-1))["c0"] < merge)
        joined = F.struct(last["c0"].alias("c0"), (last["cl"] + x["c"] * x["l"]).alias("cl"), (last["l"] + x["l"]).alias("l"), (last["w"] + w).alias("w"), (last["m"] | x["m"]).alias("m"))
        own = F.struct(x["c"].alias("c0"), (x["c"] * x["l"]).alias("cl"), x["l"].alias("l"), w.alias("w"), x["m"].alias("m"))
        return F.when(near, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(joined))).otherwise(F.concat(lines, F.array(own)))

    folded = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_x")).withColumn("_l", F.aggregate("_x", start, step))
    line = folded.select(*keys, F.explode("_l").alias("_c")).select(*keys, (F.col("_c.cl") / F.col("_c.l")).alias("coord"), F.col("_c.m").alias("measured"), F.col("_c.w").alias("_w"))
    return line.groupBy(*keys).agg(F.max_by(F.struct("coord", "measured"), F.struct(F.col("measured").cast("int"), "_w", -F.col("coord"))).alias("_r")).select(*keys, "_r.*")


def opening_runs(edges: DataFrame, ord_col: str, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, a, b, n: consecutive edges (by ordinal) of one key, as one opening."""
    w = Window.partitionBy(*keys).orderBy(ord_col)
    d = edges.withColumn("_new", F.when(F.lag(ord_col).over(w) == F.col(ord_col) - 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_run").agg(F.min(a).alias("a"), F.max(b).alias("b"), F.count("*").alias("n")).drop("_run")


def tightened(spans: DataFrame, walls: DataFrame, keys: list[str], span_id: list[str]) -> DataFrame:
    """spans with a moved up to the last wall end at or before their middle, b down to the first wall start at or after it: two passes over
    each key in the order of the line, not pairs."""
    by = list(dict.fromkeys([*keys, *span_id]))
    own = [c for c in by if c not in keys]
    mids = spans.select(*keys, ((F.col("a") + F.col("b")) / 2).cast("double").alias("_x"), F.struct(*own, "a", "b").alias("_span"), F.lit(None).cast("double").alias("_end"), F.lit(None).cast("double").alias("_start"))
    no = F.lit(None).cast(mids.schema["_span"].dataType)
    wall = lambda c, end: walls.select(*keys, F.col(c).cast("double").alias("_x"), no.alias("_span"), (F.col(c) if end else F.lit(None)).cast("double").alias("_end"), (F.lit(None) if end else F.col(c)).cast("double").alias("_start"))
    rows = mids.unionByName(wall("b", True)).unionByName(wall("a", False))
    # at one place: wall ends, then middles, then wall starts
    turn = F.when(F.col("_end").isNotNull(), 0).when(F.col("_span").isNotNull(), 1).otherwise(2)
    w = Window.partitionBy(*keys).orderBy("_x", turn)
    lo = F.last("_end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.first("_start", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    got = rows.withColumns({"_lo": lo, "_hi": hi}).filter(F.col("_span").isNotNull())
    kinds = spans.schema
    return got.select(*[F.col(c) if c in keys else F.col(f"_span.{c}").alias(c) for c in by], F.greatest(F.col("_span.a"), F.col("_lo").cast(kinds["a"].dataType)).alias("a"), F.least(F.col("_span.b"), F.col("_hi").cast(kinds["b"].dataType)).alias("b"))


def last_wins(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The row of each key that comes last by ``order``."""
    row = F.struct(*df.columns)
    return df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])).alias("_r")).select("_r.*")
