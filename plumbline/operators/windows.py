"""Ranking, naming, sampling and time windows over rows; each with an explicit total order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key; a limit by group, so that each partition sends k rows a key at most."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    return d.withColumnRenamed("_rank", rank) if rank else d.drop("_rank")


def top_by(df: DataFrame, keys: list[str], row: list[str], order: list[Column]) -> DataFrame:
    """keys and the columns ``row`` of the key's row that comes last by ``order``: an aggregate, without sorting the group."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*row), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])).alias("_r")).select(*keys, "_r.*")


def suffixed(df: DataFrame, kind: str, order: list[Column], keys: list[str], name: str = "name") -> DataFrame:
    """df with a name: the kind where it is the only one in its key, else kind and number."""
    w = Window.partitionBy(*keys, kind)
    n = F.row_number().over(w.orderBy(*order))
    return df.withColumn(name, F.when(F.count("*").over(w) == 1, F.col(kind)).otherwise(F.concat(F.col(kind), F.lit(" "), n.cast("string"))))


def numbered(df: DataFrame, order: list[Column], keys: list[str], prefix: str, name: str = "id") -> DataFrame:
    return df.withColumn(name, F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("string")))


def segment_of(frame: Column, size: int) -> Column:
    return F.floor(frame / size)


def sliding(index: Column, size: int, overlap: int) -> Column:
    """The array of windows (0, 1, ...) of ``size`` rows, each sharing ``overlap`` with the one before, that hold an index."""
    step = size - overlap
    return F.sequence(F.greatest(F.floor((index - size) / step) + 1, F.lit(0)), F.floor(index / step))


def sessions(df: DataFrame, keys: list[str], ts: str, gap_s: float) -> DataFrame:
    """df with session (from 1 on): a new one after a silence of ``gap_s`` seconds or more."""
    w = Window.partitionBy(*keys).orderBy(ts)
    quiet = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    return df.withColumn("_new", F.when(quiet.isNull() | (quiet >= gap_s * 1e6), 1).otherwise(0)).withColumn("session", F.sum("_new").over(w)).drop("_new")


def every(df: DataFrame, order: list[Column], keys: list[str], step: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).filter(F.col("_n") % step == 0).drop("_n")


def evenly(df: DataFrame, order: list[Column], keys: list[str], k: int) -> DataFrame:
    """k rows spread evenly over each key's order, first and last among them (all, if there are no more)."""
    w = Window.partitionBy(*keys)
    d = df.withColumns({"_n": F.row_number().over(w.orderBy(*order)) - 1, "_all": F.count("*").over(w)})
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_all") - 1) / max(1, k - 1)))
    return d.filter((F.col("_all") <= k) | F.array_contains(places, F.col("_n").cast("long"))).drop("_n", "_all")


def farthest_points(df: DataFrame, keys: list[str], features: list[str], order: list[str], k: int) -> DataFrame:
    """k rows of each key (a room's frames): the first by order, then always the one farthest from those taken. Sequential per key."""
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(order)
        x = pdf[features].to_numpy(float)
        taken = [0]
        d = ((x - x[0]) ** 2).sum(1)
        while len(taken) < min(k, len(x)):
            i = int(d.argmax())
            taken.append(i)
            d = np.minimum(d, ((x - x[i]) ** 2).sum(1))
        return pdf.iloc[taken]

    return df.groupBy(*keys).applyInPandas(pick, out)


def keyframes(df: DataFrame, keys: list[str], frame: str, ts: str, shift: str, sharpness: str, *, least_shift: float = 0.12, gap_s: float = 0.5, recent: int = 3, least_frames: int = 2) -> DataFrame:
    """keys, frame: a frame is due when the shifts since the last key frame add up to ``least_shift`` or ``gap_s`` passed, and
    ``least_frames`` frames did; the sharpest of the last few is taken. An ordered fold, per capture."""
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys, frame).schema.fields)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, last_t, moved, since, last = [], None, 0.0, 0, []
        for f, t, s, q in pdf.sort_values(frame)[[frame, ts, shift, sharpness]].itertuples(index=False):
            last = [*last, (q, -f, f)][-recent:]
            moved, since = moved + s, since + 1
            if last_t is None or (since >= least_frames and (moved >= least_shift or t - last_t >= gap_s)):
                out.append(max(last)[2])
                last_t, moved, since, last = t, 0.0, 0, []
        res = pd.DataFrame({frame: out})
        for k in reversed(keys):
            res.insert(0, k, pdf[k].iloc[0])
        return res

    return df.groupBy(*keys).applyInPandas(fold, head)
