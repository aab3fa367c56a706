"""Streams of frames and events: key frames with keyed state, tumbling, sliding and session windows, deduplication, pose lookup."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

KEYFRAME_STATE = "last_t double, moved double, since int, recent_q array<double>, recent_f array<long>"


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """The stream with event time (cast to timestamp) and a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], aggs: list) -> DataFrame:
    return df.groupBy(F.window(ts, size), *keys).agg(*aggs)


def sliding(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], aggs: list) -> DataFrame:
    return df.groupBy(F.window(ts, size, slide), *keys).agg(*aggs)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: list) -> DataFrame:
    return df.groupBy(F.session_window(ts, gap), *keys).agg(*aggs)


def first_seen(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys)


def with_poses(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """A stream of frames with a static table of poses, which is looked up anew with each batch."""
    return frames.join(poses, ["capture_id", "frame_id"])


def keyframes(frames: DataFrame, key: str = "capture_id", *, least_shift: float = 0.12, gap_s: float = 0.5, recent: int = 3, least_frames: int = 2) -> DataFrame:
    """key, frame_id: as operators.windows.keyframes, over a stream; the state of a capture is a few numbers. Frames of a batch are taken
    in order; frames of one capture must arrive in order of their batches. columns: key, frame_id, ts_s, shift, sharpness."""
    kind = frames.schema[key].dataType.simpleString()

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_t, moved, since, rq, rf = state.get if state.exists else (None, 0.0, 0, [], [])
        last = list(zip(rq, rf, strict=True))
        out = []
        rows = pd.concat(list(batches)).sort_values("frame_id")
        for f, t, s, q in rows[["frame_id", "ts_s", "shift", "sharpness"]].itertuples(index=False):
            last = [*last, (float(q), int(f))][-recent:]
            moved, since = moved + float(s), since + 1
            if last_t is None or (since >= least_frames and (moved >= least_shift or t - last_t >= gap_s)):
                out.append(max(last, key=lambda x: (x[0], -x[1]))[1])
                last_t, moved, since, last = float(t), 0.0, 0, []
        state.update((last_t, moved, since, [q for q, _ in last], [f for _, f in last]))
        yield pd.DataFrame({key: [k[0]] * len(out), "frame_id": pd.Series(out, dtype="int64")})

    return frames.groupBy(key).applyInPandasWithState(fold, f"`{key}` {kind}, frame_id long", KEYFRAME_STATE, "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns its rows from Parquet files in the shared folder: those of every batch, or of the last
    one in mode complete. A batch that runs twice overwrites its own files, so that it counts once."""
    from ..operators.graph import checkpoint_dir

    spark = stream.sparkSession
    checkpoint_dir(spark)
    where = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{name}-{uuid.uuid4().hex}"
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/{number}")
        done.append(number)

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{where}-progress").trigger(availableNow=True).start()
    q.awaitTermination()
    paths = [f"{where}/{n}" for n in sorted(set(done))]
    paths = paths[-1:] if mode == "complete" else paths
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)
