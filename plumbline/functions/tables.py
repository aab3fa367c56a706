"""Table functions: ordered folds over a table argument, and the exact cells of a line.

    register(spark)
    SELECT * FROM key_frames(TABLE(frames) PARTITION BY capture_id ORDER BY (frame_id), 0.12, 0.5, 3, 2)
    SELECT * FROM merged_lines(TABLE(positions) PARTITION BY capture_id ORDER BY (c, w), 0.035)
    SELECT r.*, l.r, l.c FROM rays r, LATERAL line_cells(r.r0, r.c0, r.r1, r.c1, 0) l

The folds take a partition's rows one by one in the order asked for and hold a few numbers, where a grouped pandas function holds the whole group. The first
column of the table argument is the partition's key, as a string in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


class KeyFrames:
    """Table columns: key, frame, time in seconds, shift, sharpness. A frame is due when the shifts since the last key frame reach ``least_shift`` or ``gap_s``
    passed, and ``least_frames`` frames did; the sharpest of the last ``recent`` is taken, the earlier of equals."""

    def __init__(self) -> None:
        self.last_t: float | None = None
        self.moved, self.since, self.last = 0.0, 0, []

    def eval(self, row: Row, least_shift: float, gap_s: float, recent: int, least_frames: int) -> Iterator[tuple]:
        key, frame, t, shift, sharp = row
        self.last = [*self.last, (sharp, -frame)][-recent:]
        self.moved, self.since = self.moved + shift, self.since + 1
        if self.last_t is None or (self.since >= least_frames and (self.moved >= least_shift or t - self.last_t >= gap_s)):
            best = -max(self.last)[1]
            self.last_t, self.moved, self.since, self.last = t, 0.0, 0, []
            yield (None if key is None else str(key), best)


class MergedLines:
    """Table columns: key, position, weight, in order. A position joins the line before while nearer than ``merge`` to its weighted mean so far."""

    def __init__(self) -> None:
        self.key, self.line, self.ord = None, None, 0

    def eval(self, row: Row, merge: float) -> Iterator[tuple]:
        key, c, w = row
        self.key = None if key is None else str(key)
        if self.line is None:
            self.line = (c, w)
        elif c - self.line[0] < merge:
            total = self.line[1] + w
            self.line = ((self.line[0] * self.line[1] + c * w) / total, total)
        else:
            yield (self.key, self.ord, *self.line)
            self.ord, self.line = self.ord + 1, (c, w)

    def terminate(self) -> Iterator[tuple]:
        if self.line is not None:
            yield (self.key, self.ord, *self.line)


class LineCells:
    """The cells of the straight line from (r0, c0) to (r1, c1) by whole-number steps alone (no rounding of fractions), but for the last ``short``: along the
    longer side one cell a step, the other side follows when twice the error passes the step. Null ends give none."""

    def eval(self, r0: int, c0: int, r1: int, c1: int, short: int) -> Iterator[tuple]:
        if None in (r0, c0, r1, c1):
            return
        dr, dc = abs(r1 - r0), abs(c1 - c0)
        up, right = (1 if r1 > r0 else -1), (1 if c1 > c0 else -1)
        error, r, c = dc - dr, r0, c0
        for _ in range(max(dr, dc) + 1 - short):
            yield r, c
            twice = 2 * error
            if twice > -dr:
                error -= dr
                c += right
            if twice < dc:
                error += dc
                r += up


key_frames = udtf(KeyFrames, returnType="key string, frame_id long")
merged_lines = udtf(MergedLines, returnType="key string, ord int, coord double, weight double")
line_cells = udtf(LineCells, returnType="r long, c long")


def with_line_cells(lines: DataFrame, ends: tuple[str, str, str, str], *aggs: Column, short: int = 0) -> DataFrame:
    """lines with aggregates of their cells (r, c); ends: the names of r0, c0, r1, c1. Equal lines are drawn once. Lines without cells go."""
    one = lines.select(*[F.col(e).cast("long").alias(f"_e{i}") for i, e in enumerate(ends)]).distinct()
    cells = one.lateralJoin(line_cells(*[F.col(f"_e{i}").outer() for i in range(4)], F.lit(short)))
    drawn = cells.groupBy(*[f"_e{i}" for i in range(4)]).agg(*aggs)
    on = [F.col(e).cast("long") == F.col(f"_e{i}") for i, e in enumerate(ends)]
    return lines.join(drawn, on).drop(*[f"_e{i}" for i in range(4)])


def register(spark: SparkSession) -> None:
    for name, f in (("key_frames", key_frames), ("merged_lines", merged_lines), ("line_cells", line_cells)):
        spark.udtf.register(name, f)
