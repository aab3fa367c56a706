"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Each source is a task whose weight is its share of the mix; its documents, in a fixed pseudo-random order, form blocks, and block i
(0, 1, ...) of a source with weight w is released at slot floor(i / w) and due by slot ceil((i + 1) / w). The earliest deadline among
the released blocks gets each slot, which keeps every source within one block of w times the slots passed.

Weights are whole numbers of slots in a frame, so that the schedule repeats: one frame is scheduled by a fold over its slots, and block i
takes the place of block i mod a in frame i div a. No step walks over the blocks. Given weights are taken as the exact decimal fractions
that they are written as, and hold exactly if their common frame has at most ``MAX_FRAME`` slots. Weights from counts, and given ones
beyond that, are rounded to a frame of ``frame`` slots, or of as many more (up to ``MAX_FRAME``) as give the least weight a slot of its
own; the rounded weights are the targets then, half a slot a frame from the unrounded ones at most, and one slot at least. A given weight
of zero, or none for a source, keeps the source out of the mix. A source that has run out leaves its slots empty, and the others go on in
their proportions.

Up to ``GROUP`` sources share one frame. More are dealt by hash into groups, which share the frame by their sums, and each group's slots
go to its sources in a frame of the group's own; every source then stays within two blocks.

schedule() has every row of the input once: repeated rows, null ids and the null source (a source like any other) too, with null slots
for sources out of the mix. An empty table gives an empty result. Text is not read.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction
from math import gcd, lcm

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, partitions, spare, stored

MAX_FRAME, GROUP, STEP = 1 << 16, 1000, 256


def whole_weights(weights: dict[str | None, float]) -> dict[str | None, int]:
    """The weights as whole numbers in the same proportions."""
    exact = {k: Fraction(Decimal(str(v))) for k, v in weights.items()}
    if any(v < 0 for v in exact.values()):
        raise ValueError("a weight is negative")
    scale = lcm(*(v.denominator for v in exact.values())) if exact else 1
    whole = {k: int(v * scale) for k, v in exact.items()}
    common = gcd(*whole.values()) or 1
    return {k: v // common for k, v in whole.items()}


def source_weights(docs: DataFrame, source_col: str = "source", *, weights: dict[str | None, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """source, w: the given weights as whole numbers, or the sources' document counts to the power ``temperature``; sources of weight zero aren't there."""
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        return counts.select("source", F.round(F.pow(F.col("n").cast("double"), F.lit(temperature)), 6).alias("w"))
    given = [F.struct(F.lit(k).cast("string").alias("k"), F.lit(float(v)).alias("w")) for k, v in whole_weights(weights).items() if v]
    if not given:
        return counts.select("source", F.lit(0.0).alias("w")).limit(0)
    table = docs.sparkSession.range(1).select(F.inline(F.array(*given)))
    return counts.join(F.broadcast(table), counts["source"].eqNullSafe(table["k"])).select("source", "w")


def frame_slots(weights: DataFrame, group: Column, *, frame: int = 1000, whole: bool = False) -> DataFrame:
    """group, source, a, size: slots of each source in its group's frame. Whole weights whose sum is at most MAX_FRAME are the slots themselves."""
    each = weights.withColumn("group", group)
    sums = each.groupBy("group").agg(F.sum("w").alias("total"), F.min("w").alias("least"))
    sums = sums.withColumn("frame", F.least(F.lit(MAX_FRAME), F.greatest(F.lit(frame), F.ceil(F.col("total") / F.col("least")))))
    rounded = F.greatest(F.lit(1).cast("long"), F.floor(F.col("w") * F.col("frame") / F.col("total") + 0.5))
    slots = F.when(F.col("total") <= MAX_FRAME, F.col("w").cast("long")).otherwise(rounded) if whole else rounded
    return each.join(sums, "group").select("group", "source", slots.alias("a"))


def frame_schedule(slots: DataFrame) -> DataFrame:
    """group, source, in_frame (block within the frame), slot_in_frame, a, size: one frame of each group by earliest deadline first."""
    lists = slots.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("source", "a"))).alias("of"), F.sum("a").alias("size"))
    lists = lists.withColumn("src", F.expr("transform(of, (x, i) -> named_struct('k', i, 'a', x.a))"))
    none = "cast(array() AS array<struct<k:int,i:bigint,t:bigint>>)"
    # a source with i blocks placed: released if floor(i * size / a) <= t; deadline ceil((i + 1) * size / a)
    choice = "array_min(transform(filter(src, x -> s.done[x.k] < x.a AND s.done[x.k] * size div x.a <= t), x -> named_struct('due', ((s.done[x.k] + 1L) * size + x.a - 1L) div x.a, 'k', x.k)))"
    one = f"transform(array({choice}), c -> named_struct('done', transform(s.done, (n, j) -> if(j = c.k, n + 1L, n)), 'out', concat(s.out, array(named_struct('k', c.k, 'i', s.done[c.k], 't', t)))))[0]"
    # STEP slots at a time, so that what is copied at each slot stays short
    some = f"aggregate(sequence(c * {STEP}L, least(size, c * {STEP}L + {STEP}L) - 1L), named_struct('done', f.done, 'out', {none}), (s, t) -> {one}, s -> named_struct('done', s.done, 'out', concat(f.out, s.out)))"
    whole = f"aggregate(sequence(0L, (size - 1L) div {STEP}L), named_struct('done', array_repeat(0L, size(src)), 'out', {none}), (f, c) -> {some}, f -> f.out)"
    plan = lists.select("group", "of", "size", F.expr(f"inline({whole})"))
    return plan.select("group", F.expr("of[k].source").alias("source"), F.col("i").alias("in_frame"), F.col("t").alias("slot_in_frame"), F.expr("of[k].a").alias("a"), "size")


def frames(docs: DataFrame, source_col: str = "source", *, weights: dict[str | None, float] | None = None, temperature: float = 0.5, frame: int = 1000) -> tuple[DataFrame, DataFrame | None]:
    """The sources' frame; with more than GROUP sources the frames inside their groups (source, group), and the groups' frame (group as source)."""
    w = source_weights(docs, source_col, weights=weights, temperature=temperature)
    many = w.count()
    if many <= GROUP:
        return frame_schedule(frame_slots(w, F.lit(0).cast("long"), frame=frame, whole=weights is not None)), None
    group = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(-(-many // GROUP)))
    inner = frame_schedule(frame_slots(w, group, frame=frame, whole=weights is not None))
    sums = w.groupBy(group.alias("g")).agg(F.sum("w").alias("w")).select(F.col("g").cast("string").alias("source"), "w")
    return inner, frame_schedule(frame_slots(sums, F.lit(0).cast("long"), frame=frame, whole=weights is not None))


def _placed(rows: DataFrame, source: str, order: list[str], names: list[str], docs: DataFrame, source_col: str, block: int, options: dict) -> DataFrame:
    """The rows with the columns named: block, position, release, deadline, slot. A source's rows come in ``order``, whose last column tells all
    rows apart, so that a common source, id or row spans range partitions; what is added up afterwards is a count for each of them."""
    key, m, part, shift, rank, share, own_a, own_size, plan_source, in_frame, in_slot, outer = spare(rows, "_key", "_m", "_part", "_shift", "_rank", "_share", "_a", "_size", "_plan", "_in", "_at", "_outer")
    b, position, release, deadline, slot = names
    keyed = rows.withColumn(key, F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")))
    ordered = keyed.repartitionByRange(partitions(rows.sparkSession), key, *order).sortWithinPartitions(key, *order).withColumn(m, F.monotonically_increasing_id())
    ordered = stored(ordered, "mix-order", per_core=4)
    each = ordered.groupBy(F.shiftright(m, 33).alias(part), key).agg(F.count("*").alias("n"), F.min(m).alias("least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = each.select(part, key, (before - F.col("least")).alias(shift))
    numbered = ordered.withColumn(part, F.shiftright(m, 33)).join(offsets, [part, key]).withColumn(rank, F.col(m) + F.col(shift))
    numbered = numbered.withColumns({b: F.expr(f"`{rank}` div {block}"), position: F.col(rank) % block})

    plan, groups = frames(docs, source_col, **options)
    plan = stored(plan, "mix-frame", per_core=1)  # at most MAX_FRAME + GROUP rows a group
    small = F.broadcast if groups is None else (lambda df: df)
    shares = plan.select(F.col("source").alias(share), F.col("a").alias(own_a), F.col("size").alias(own_size), F.col("group").alias(outer)).distinct()
    placed = numbered.join(small(shares), numbered[source].eqNullSafe(F.col(share)), "left")
    places = plan.select(F.col("source").alias(plan_source), F.col("in_frame").alias(in_frame), F.col("slot_in_frame").alias(in_slot))
    placed = placed.join(small(places), F.col(source).eqNullSafe(F.col(plan_source)) & (F.expr(f"`{b}` % `{own_a}`") == F.col(in_frame)), "left")
    placed = placed.withColumn(slot, F.expr(f"(`{b}` div `{own_a}`) * `{own_size}` + `{in_slot}`"))
    if groups is None:
        ahead, due = f"`{b}` * `{own_size}` div `{own_a}`", f"((`{b}` + 1) * `{own_size}` + `{own_a}` - 1) div `{own_a}`"
    else:  # the slot so far is the number of a block of the group
        top = stored(groups, "mix-groups", per_core=1).select(F.col("source").cast("long").alias("g"), F.col("in_frame").alias("gi"), F.col("slot_in_frame").alias("gt"), F.col("a").alias("ga"), F.col("size").alias("gs"))
        of = top.select(F.col("g").alias("g2"), "ga", "gs").distinct()
        placed = placed.join(F.broadcast(of), F.col(outer) == F.col("g2"), "left")
        placed = placed.join(F.broadcast(top.select("g", "gi", "gt")), (F.col(outer) == F.col("g")) & (F.expr(f"`{slot}` % ga") == F.col("gi")), "left")
        placed = placed.withColumn(slot, F.expr(f"(`{slot}` div ga) * gs + gt"))
        ahead, due = f"`{b}` * (`{own_size}` * gs) div (`{own_a}` * ga)", f"((`{b}` + 1) * (`{own_size}` * gs) + `{own_a}` * ga - 1) div (`{own_a}` * ga)"
    return placed.withColumns({release: F.expr(ahead), deadline: F.expr(due)}).select(*columns(rows), *names)


def _order_of(id_col: str) -> Column:
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def schedule(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", *, block: int = 16, **options) -> DataFrame:
    """_id, _order, source, block (within its source), position (within its block), release, deadline, slot: a row for each document.

    Slot order, then position, is the mix. A source's documents come in the order of the MD5 of their id (then id). Options: weights,
    temperature, frame.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), _order_of(id_col).alias("_order"), F.monotonically_increasing_id().alias("_tie"))
    names = ["block", "position", "release", "deadline", "slot"]
    return _placed(rows, "source", ["_order", "_id", "_tie"], names, docs, source_col, block, options).select("_id", "_order", "source", *names)


def filed(docs: DataFrame) -> DataFrame:
    """docs as a plain table of Parquet files, whose rows have places: itself, or a stored copy."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName() == "LogicalRelation":
        try:
            docs.select(docs.metadataColumn("_metadata")["row_index"]).schema  # noqa: B018
            return docs
        except AnalysisException:
            pass
    return stored(docs, "mix-input")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", *, block: int = 16, **options) -> DataFrame:
    """The rows and columns of docs in the order of the mix: files, and rows in them, follow the slots. Nothing is dropped or repeated, but for
    sources of weight zero. Rows that share an id come in the order of their places in the input's files, by which they get their slots."""
    docs = filed(docs)
    source, order, file, row, *names = spare(docs, "_source", "_order", "_file", "_row", "_block", "_position", "_release", "_deadline", "_slot")
    where = docs.metadataColumn("_metadata")
    place = {file: F.xxhash64(where["file_path"]), row: where["row_index"]}
    rows = docs.select(F.col(source_col).cast("string").alias(source), _order_of(id_col).alias(order), *[c.alias(n) for n, c in place.items()])
    placed = _placed(rows, source, [order, file, row], names, docs, source_col, block, options)
    at = [names[4], names[1]]
    slots = placed.filter(F.col(names[4]).isNotNull()).select(file, row, *at)
    whole = docs.select(*columns(docs), *[c.alias(n) for n, c in place.items()]).join(slots, [file, row])
    return whole.repartitionByRange(partitions(docs.sparkSession), *at).sortWithinPartitions(*at).select(*columns(docs))
