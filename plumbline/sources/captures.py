"""Capture sources: which tier a path is, its tables, and tables of what models computed (read, never computed here)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import quaternion_rotation, vec

_D = T.DoubleType()
ODOMETRY = T.StructType([T.StructField("timestamp", _D), T.StructField("frame", T.LongType()), *[T.StructField(c, _D) for c in ("x", "y", "z", "qx", "qy", "qz", "qw", "fx", "fy", "cx", "cy")]])
POINTS = T.StructType([T.StructField("capture_id", T.StringType()), T.StructField("frame_id", T.LongType()), *[T.StructField(c, _D) for c in ("x", "y", "z", "nx", "ny", "nz", "range")]])
DETECTIONS = T.StructType([T.StructField("frame", T.LongType()), T.StructField("class", T.StringType()), T.StructField("conf", _D), T.StructField("xyz", T.ArrayType(_D)), T.StructField("bbox_rot", T.ArrayType(_D)), T.StructField("depth_m", _D)])
CELL_PROBS = T.StructType([T.StructField("surface_id", T.LongType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("frame", T.LongType()), T.StructField("probs", T.ArrayType(_D)), T.StructField("surface_p", _D)])
FRAMES = T.StructType([T.StructField("capture_id", T.StringType()), T.StructField("frame_id", T.LongType()), T.StructField("ts_s", _D), T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType()), T.StructField("depth", T.ArrayType(T.FloatType())), T.StructField("conf", T.ArrayType(T.ByteType())), *[T.StructField(c, _D) for c in ("fx", "fy", "cx", "cy")], T.StructField("t_wc", T.ArrayType(_D))])


@dataclass
class Options:
    """What a run may be asked for."""

    tier: str | None = None
    step: int | None = None
    detect: bool = True
    damage: bool = True
    drift: str = "auto"
    live: bool = False
    rotate: int = 0
    out: str | None = None


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def detect_tier(spark: SparkSession, path: str) -> str:
    """video for a file, lidar for a folder with odometry.csv, photo for one with folders; through Hadoop's file systems."""
    fs, p = _fs(spark, path)
    if fs.getFileStatus(p).isFile():
        return "video"
    names = list(fs.listStatus(p))
    if any(s.getPath().getName() == "odometry.csv" for s in names):
        return "lidar"
    if any(s.isDirectory() for s in names):
        return "photo"
    raise ValueError(f"{path} is no capture: neither a file, nor odometry.csv, nor room folders in it")


def odometry(spark: SparkSession, path: str) -> DataFrame:
    """The odometry CSV with an explicit schema (a header, perhaps with spaces after commas)."""
    return spark.read.csv(f"{path}/odometry.csv", header=True, schema=ODOMETRY, ignoreLeadingWhiteSpace=True, enforceSchema=True)


def poses(odo: DataFrame) -> DataFrame:
    """frame, rotation r00..r22, position x, y, z and intrinsics."""
    return odo.select("timestamp", "frame", "x", "y", "z", *[c.alias(n) for n, c in quaternion_rotation(*vec("qx", "qy", "qz", "qw")).items()], "fx", "fy", "cx", "cy")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and the number in the name of files under a folder, from the listing alone (contents are read only if asked for)."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    number = F.expr(r"try_cast(regexp_extract(path, '([0-9]+)[.][^./]*$', 1) AS bigint)")
    return d.select("path", "length", "content", number.alias("frame"))


def capture_frames(odo: DataFrame, depth_files: DataFrame) -> DataFrame:
    """Frames that have both a pose and a depth file."""
    return poses(odo).join(depth_files.select("frame", F.col("path").alias("depth_path")), "frame")


def photo_folders(photos: DataFrame) -> DataFrame:
    """Photos with their room: the folder's name. Only image files count."""
    ok = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("jpg", "jpeg", "png", "heic")
    return photos.filter(ok).withColumn("room", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))


def pixels(frames: DataFrame, step: int = 1) -> DataFrame:
    """capture_id, frame_id, row, col, depth, conf of every ``step``-th frame's pixels."""
    f = frames.filter(F.col("frame_id") % step == 0)
    p = f.select("capture_id", "frame_id", "w", "fx", "fy", "cx", "cy", F.posexplode(F.arrays_zip("depth", "conf")).alias("_i", "_p"))
    return p.select("capture_id", "frame_id", F.floor(F.col("_i") / F.col("w")).cast("int").alias("row"), (F.col("_i") % F.col("w")).cast("int").alias("col"), F.col("_p.depth").cast("double").alias("depth"), F.col("_p.conf").alias("conf"), "fx", "fy", "cx", "cy")


def wanted_frames(frames: DataFrame, indices: DataFrame) -> DataFrame:
    """Frames whose number is in a list; duplicates in the list don't matter."""
    return frames.join(indices.select("frame_id").distinct(), "frame_id", "left_semi")


def frame_step(n: int, tier: str) -> int:
    return max(2, n // 1600) if tier == "lidar" else 1


def replayed(spark: SparkSession, path: str, params: dict, compute, schema: T.StructType | None = None, live: bool = False) -> DataFrame:
    """A computed table kept as Parquet under the hash of its parameters: read if there, else computed and written; ``live`` computes anew."""
    import hashlib
    import json

    where = f"{path}/{hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:16]}"
    fs, p = _fs(spark, f"{where}/_SUCCESS")
    if live or not fs.exists(p):
        compute().write.mode("overwrite").parquet(where)
    return spark.read.schema(schema).parquet(where) if schema is not None else spark.read.parquet(where)


def reconciled(meta: DataFrame, views: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of either table whose key is in the other."""
    return meta.join(views, keys, "left_semi"), views.join(meta, keys, "left_semi")


def json_documents(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Whole JSON documents (plans, ground truth), with the file's name."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema is not None else r).json(path).withColumn("file", F.col("_metadata.file_name"))


def labelled(spark: SparkSession, path: str, label: str, test_share: float = 0.2) -> DataFrame:
    """Parquet files with a split column: test by a hash of the row, so that any machine splits alike."""
    d = spark.read.parquet(path)
    return d.withColumn("split", F.when(F.pmod(F.xxhash64(*d.columns), F.lit(1000)) < int(test_share * 1000), "test").otherwise("train")).filter(F.col(label).isNotNull())
