"""Streams whose rows come out of order: key frames folded in the order of event time, and frames between the poses around them.

Both wait for the watermark: a frame is folded once no earlier one can come, so the result is that of the whole table in order, whatever the order of arrival
within the allowed delay. What waits is bounded by the delay, and what a finished capture leaves is given up after ``expire``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State that processors with list state and timers need (RocksDB), for the streams that start inside; the setting is restored afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _packed(d: pd.DataFrame) -> bytes:
    t, sink = pa.Table.from_pandas(d, preserve_index=False).replace_schema_metadata(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpacked(blocks: list[bytes]) -> pd.DataFrame:
    return pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(bytes(b))).read_all() for b in blocks], promote_options="permissive").to_pandas()


class KeyFrames(StatefulProcessor):
    """Holds the frames of a group of captures until the watermark has passed them, folds each capture's in the order of their time, and forgets a capture
    after ``expire_ms``. A call to the state costs far more than a frame does, so the captures of a group share calls: their frames and their folds are held as
    whole Arrow tables, with one timer, for the first thing that falls due."""

    def __init__(self, key: str, least_shift: float, gap_s: float, recent: int, least_frames: int, expire_ms: int):
        self.key, self.rule, self.recent, self.least_frames, self.expire_ms = key, (least_shift, gap_s), recent, least_frames, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "frames binary")
        self.folds = handle.getValueState("folds", "captures binary")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for d in rows:
            self.pending.appendValue((_packed(d[[self.key, "frame_id", "us", "shift", "sharpness"]]),))
            ms = int(d["us"].min()) // 1000 + 1
            first = ms if first is None else min(first, ms)
        was = self.due.get()
        if first is not None and (was is None or first < was[0]):
            if was is not None:
                self.handle.deleteTimer(was[0])
            self.handle.registerTimer(first)
            self.due.update((first,))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        blocks, before = [r[0] for r in self.pending.get()], self.folds.get()
        folds = _unpacked([before[0]]) if before is not None else pd.DataFrame({self.key: [], "last_t": [], "moved": [], "since": [], "recent_q": [], "recent_f": [], "newest_ms": []})
        waiting = _unpacked(blocks) if blocks else pd.DataFrame({self.key: [], "us": []})
        ready, out = waiting["us"] < now * 1000, None
        rest = waiting[~ready]
        if ready.any():
            folds, out = self._folded(folds, waiting[ready])
            self.pending.put([(_packed(rest),)]) if len(rest) else self.pending.clear()
        waits, over = pd.Index(rest[self.key].unique()).get_indexer(folds[self.key]) >= 0, (folds["newest_ms"] + self.expire_ms).to_numpy()
        kept = waits | (over >= now)
        if ready.any() or not kept.all():
            self.folds.update((_packed(folds[kept]),)) if kept.any() else self.folds.clear()
        due = [int(x.min()) + 1 for x in (rest["us"] // 1000, over[kept & ~waits]) if len(x)]
        if due:
            self.handle.registerTimer(min(due))
            self.due.update((min(due),))
        else:
            self.due.clear()
        if out is not None and len(out):
            yield out

    def _folded(self, folds: pd.DataFrame, ready: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The folds after the ready frames, and the key frames among these."""
        code, who = pd.factorize(ready[self.key], use_na_sentinel=False)
        order = np.lexsort((*(ready[x].to_numpy() for x in ("sharpness", "shift", "frame_id", "us")), code))
        code = code[order]
        us, frames, shifts, sharps = (ready[x].to_numpy()[order].tolist() for x in ("us", "frame_id", "shift", "sharpness"))
        at = who.get_indexer(folds[self.key])
        begun = {c: row for c, row in zip(at.tolist(), folds[["last_t", "moved", "since", "recent_q", "recent_f", "newest_ms"]].itertuples(index=False), strict=True) if c >= 0}
        least_shift, gap_s = self.rule
        bounds = [*np.flatnonzero(np.diff(code, prepend=-1)).tolist(), len(code)]
        after, out_c, out_f = [], [], []
        for c, (a, b) in enumerate(pairwise(bounds)):
            last_t, moved, since, rq, rf, newest = begun.get(c, (None, 0.0, 0, [], [], 0))
            last = [(np.nan if q is None else float(q), int(f)) for q, f in zip(rq, rf, strict=True)]
            for i in range(a, b):
                last = [*last, (sharps[i], frames[i])][-self.recent :]
                moved, since = moved + shifts[i], since + 1
                if last_t is None or (since >= self.least_frames and (moved >= least_shift or us[i] / 1e6 - last_t >= gap_s)):
                    out_c.append(c)
                    out_f.append(max(last, key=lambda x: (x[0], -x[1]))[1])
                    last_t, moved, since, last = us[i] / 1e6, 0.0, 0, []
            after.append((last_t, moved, since, [q for q, _ in last], [f for _, f in last], max(newest, us[b - 1] // 1000)))
        new = pd.DataFrame(after, columns=["last_t", "moved", "since", "recent_q", "recent_f", "newest_ms"])
        new.insert(0, self.key, who)
        still = folds[at < 0]
        return pd.concat([still, new], ignore_index=True) if len(still) else new, pd.DataFrame({self.key: who.take(out_c), "frame_id": out_f})

    def close(self) -> None:
        pass


def keyframes(frames: DataFrame, key: str = "capture_id", ts: str = "ts", *, late: str = "10 minutes", expire_s: float = 3600.0, least_shift: float = 0.12, gap_s: float = 0.5, recent: int = 3, least_frames: int = 2, groups: int = 1024) -> DataFrame:
    """key, frame_id: as operators.windows.keyframes in the order of time. frames: a stream of key, frame_id, ts (timestamp), shift, sharpness; rows that come
    later than ``late`` are dropped, as are those without a time or frame_id, and frames wait as long. Start the stream inside keyed_state(). Captures share
    state in ``groups`` by their hash, a number that stays for as long as a checkpoint does."""
    d = frames.select(key, "frame_id", F.col(ts).cast("timestamp").alias(ts), F.col("shift").cast("double").alias("shift"), F.col("sharpness").cast("double").alias("sharpness"))
    d = d.filter(F.col(ts).isNotNull() & F.col("frame_id").isNotNull()).withWatermark(ts, late).withColumn("us", F.unix_micros(ts))
    # rows without a key apart: beside them pandas would hold whole numbers as doubles
    d = d.withColumn("_group", F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.hash(key), F.lit(groups))))
    kind = frames.schema[key].dataType.simpleString()
    return d.groupBy("_group").transformWithStateInPandas(KeyFrames(key, least_shift, gap_s, recent, least_frames, int(expire_s * 1000)), f"`{key}` {kind}, frame_id long", "Append", "EventTime")


def between_poses(frames: DataFrame, poses: DataFrame, key: str, frame: str, ts: str, values: list[str], *, reach: str, late: str) -> DataFrame:
    """key, frame, ts and the values interpolated between the poses before and after each frame, at most ``reach`` away; held where only one side has one.

    Two streams (frames: key, frame, ts; poses: key, ts, values) with a watermark each: an interval join, of which the last pose before and the first after
    each frame are kept until the watermark passes it. Frames without a pose in reach give no row.
    """
    f = frames.select(F.col(key).alias("_k"), frame, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, late)
    p = poses.select(F.col(key).alias("_pk"), F.col(ts).cast("timestamp").alias("_pt"), F.struct(*[F.col(v).cast("double").alias(v) for v in values]).alias("_v")).withWatermark("_pt", late)
    near = F.expr(f"_k = _pk AND _pt >= {ts} - INTERVAL {reach} AND _pt <= {ts} + INTERVAL {reach}")
    j = f.join(p, near)
    row = F.struct(F.unix_micros("_pt").alias("t"), F.col("_v").alias("v"))
    g = j.groupBy("_k", frame, ts).agg(F.max(F.when(F.col("_pt") <= F.col(ts), row)).alias("_a"), F.min(F.when(F.col("_pt") >= F.col(ts), row)).alias("_b"))
    share = F.coalesce(F.try_divide(F.unix_micros(ts) - F.col("_a.t"), F.col("_b.t") - F.col("_a.t")), F.lit(0.0))
    at = lambda v: F.coalesce(F.col(f"_a.v.{v}") + (F.col(f"_b.v.{v}") - F.col(f"_a.v.{v}")) * share, F.col(f"_a.v.{v}"), F.col(f"_b.v.{v}")).alias(v)
    return g.select(F.col("_k").alias(key), frame, ts, *[at(v) for v in values])
