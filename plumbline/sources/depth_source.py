"""Depth captures as a Spark data source: folders with odometry.csv, depth/NNNNNN.png (16 bits, millimetres) and confidence/NNNNNN.png (0, 1, 2).

    register(spark)
    spark.read.format("depth_frames").load("captures/").filter("capture_id = 'flat' AND frame_id < 100")

A partition is a span of frames of one capture. Conditions on capture_id and frame_id are taken by the source: captures that they exclude aren't listed and
spans without a frame that they allow aren't planned. With ``.schema(...)`` only the named columns are read: without depth, conf, w or h no image is opened.
Frames are numbered in the order of their files, and a capture has as many as it has both depth files and odometry rows. Depth is in metres, 0 where
nothing was measured; a missing confidence image gives a null. With the options rgb_width and rgb_height intrinsics are brought from that size to the
depth image's. Files are read through Arrow's file systems, so paths may be remote; a capture's odometry is read with each of its spans, as a capture is
bounded. A folder without captures gives no rows; a broken image fails with its path.

``write_captures`` writes such folders, a task for each capture, and gives a manifest.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import png
from .captures import FRAMES

_IMAGES = {"depth", "conf", "w", "h"}
#: Frames of a partition, and of a batch of rows.
SPAN, BATCH = 256, 16


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") or not path.startswith("file:") else "file://" + path[5:])


def _names(files: arrow_fs.FileSystem, folder: str) -> list[str]:
    found = files.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == arrow_fs.FileType.File and f.base_name.lower().endswith(".png"))


def _read(files: arrow_fs.FileSystem, path: str) -> bytes:
    with files.open_input_stream(path) as f:
        return f.read()


@dataclass
class Span(InputPartition):
    capture_id: str
    folder: str
    start: int
    depth: list[str]
    conf: list[str | None]

    def __post_init__(self) -> None:
        super().__init__((self.capture_id, self.start))


class DepthReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.captures: set[str] | None = None
        self.least, self.most = 0, 2**62
        self.frames: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = ".".join(getattr(f, "attribute", ())).lower()
            if column == "capture_id" and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.captures = values if self.captures is None else self.captures & values
            elif column == "frame_id" and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.frames = values if self.frames is None else self.frames & values
            elif column == "frame_id" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            elif column == "frame_id" and isinstance(f, LessThan | LessThanOrEqual):
                self.most = min(self.most, f.value - isinstance(f, LessThan))
            else:
                yield f

    def _allowed(self, start: int, end: int) -> list[int]:
        """Frames of start to end (exclusive) that the conditions allow."""
        span = range(max(start, self.least), min(end, self.most + 1))
        return [i for i in span if self.frames is None or i in self.frames]

    def partitions(self) -> list[Span]:
        files, root = _open(self.options["path"])
        if files.get_file_info(f"{root}/odometry.csv").type == arrow_fs.FileType.File:
            folders = [root]
        else:
            folders = sorted(f.path for f in files.get_file_info(arrow_fs.FileSelector(root)) if f.type == arrow_fs.FileType.Directory)
        size, out = int(self.options.get("span", SPAN)), []
        for folder in folders:
            name = folder.rstrip("/").rsplit("/", 1)[-1]
            if self.captures is not None and name not in self.captures:
                continue
            if files.get_file_info(f"{folder}/odometry.csv").type != arrow_fs.FileType.File:
                continue
            depth, conf = _names(files, f"{folder}/depth"), set(_names(files, f"{folder}/confidence"))
            for a in range(0, len(depth), size):
                part = depth[a : a + size]
                if self._allowed(a, a + len(part)):
                    out.append(Span(name, folder, a, part, [c if c in conf else None for c in part]))
        return out or [Span("", "", 0, [], [])]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.depth:
            return
        files, _ = _open(self.options["path"])
        names = [f.name for f in self.schema.fields]
        arrow = to_arrow_schema(self.schema)
        rows = list(csv.DictReader(io.StringIO(_read(files, f"{partition.folder}/odometry.csv").decode()), skipinitialspace=True))
        wanted = self._allowed(partition.start, min(partition.start + len(partition.depth), len(rows)))
        for i in range(0, len(wanted), BATCH):
            made = [self._frame(files, partition, n, rows[n], names) for n in wanted[i : i + BATCH]]
            yield pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], f.type) for c, f in zip(names, arrow, strict=True)], schema=arrow)

    def _frame(self, files: arrow_fs.FileSystem, span: Span, n: int, row: dict[str, str], names: list[str]) -> dict:
        k = n - span.start
        out = {"capture_id": span.capture_id, "frame_id": n, "ts_s": float(row["timestamp"])}
        scale = (1.0, 1.0)
        rgb = self.options.get("rgb_width"), self.options.get("rgb_height")
        if _IMAGES & set(names) or all(rgb):
            path = f"{span.folder}/depth/{span.depth[k]}"
            data = _read(files, path)
            try:
                out["w"], out["h"] = png.size_of(data)
                if "depth" in names:
                    out["depth"] = png.decode(data).astype(np.float32).ravel() / np.float32(1000)
            except ValueError as e:
                raise ValueError(f"{path}: {e}") from e
            if all(rgb):
                scale = out["w"] / int(rgb[0]), out["h"] / int(rgb[1])
        if "conf" in names:
            conf = span.conf[k]
            out["conf"] = None if conf is None else png.decode(_read(files, f"{span.folder}/confidence/{conf}")).astype(np.int8).ravel()
        out |= {c: float(row[c]) * scale[c.endswith("y")] for c in ("fx", "fy", "cx", "cy")}
        if "t_wc" in names:
            x, y, z, w = (float(row[c]) for c in ("qx", "qy", "qz", "qw"))
            s = 2.0 / (x * x + y * y + z * z + w * w)
            turn = [[1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w)], [s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w)], [s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y)]]
            out["t_wc"] = [v for line, p in zip(turn, "xyz", strict=True) for v in (*line, float(row[p]))] + [0.0, 0.0, 0.0, 1.0]
        return out


class DepthFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "depth_frames"

    def schema(self) -> StructType:
        return FRAMES

    def reader(self, schema: StructType) -> DepthReader:
        unknown = {f.name for f in schema.fields} - {f.name for f in FRAMES.fields}
        if unknown:
            raise ValueError(f"depth captures have no columns {sorted(unknown)}")
        return DepthReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Python sources take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DepthFrames)


ODOMETRY_COLUMNS = ("timestamp", "frame", "x", "y", "z", "qx", "qy", "qz", "qw", "fx", "fy", "cx", "cy")


def write_captures(frames: DataFrame, path: str) -> DataFrame:
    """Writes each capture's folder and gives a manifest (capture_id, frames, bytes) that writes when it is run. frames: capture_id, frame_id, w,
    depth (metres), conf, and the odometry's timestamp, x to z, qx to qw, fx to cy. A task writes a capture's frames in their order, numbered from 0, one
    image at a time; a task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(path)
        now, lines, size = None, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            if now is not None:
                text = "\n".join([", ".join(ODOMETRY_COLUMNS), *lines, ""])
                with files.open_output_stream(f"{root}/{now}/odometry.csv") as f:
                    f.write(text.encode())
                yield pa.RecordBatch.from_pydict({"capture_id": [now], "frames": [len(lines)], "bytes": [size + len(text)]})

        for batch in batches:
            for row in batch.to_pylist():
                if row["capture_id"] != now:
                    yield from close()
                    now, lines, size = row["capture_id"], [], 0
                    for folder in ("depth", "confidence"):
                        files.create_dir(f"{root}/{now}/{folder}", recursive=True)
                for folder, values in (("depth", np.rint(np.array(row["depth"], np.float64) * 1000).astype(np.uint16)), ("confidence", None if row["conf"] is None else np.array(row["conf"], np.uint8))):
                    if values is not None:
                        image = png.encode(values.reshape(-1, row["w"]))
                        size += len(image)
                        with files.open_output_stream(f"{root}/{now}/{folder}/{len(lines):06d}.png") as f:
                            f.write(image)
                lines.append(", ".join(str(len(lines) if c == "frame" else row[c]) for c in ODOMETRY_COLUMNS))
        yield from close()

    d = frames.select(F.col("capture_id").cast("string").alias("capture_id"), "frame_id", "w", "depth", "conf", *[c for c in ODOMETRY_COLUMNS if c != "frame"])
    return d.repartition("capture_id").sortWithinPartitions("capture_id", "frame_id").mapInArrow(run, "capture_id string, frames long, bytes long")
