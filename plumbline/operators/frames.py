"""From depth frames to a point cloud: back-projection, normals from neighbouring pixels, validity, world coordinates, voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import priors
from ..functions import geometry as G
from .robust import voxel_nearest

FRAME = ["capture_id", "frame_id"]


def camera_points(pixels: DataFrame, stride: int = 1) -> DataFrame:
    """pixels (row, col, depth, fx, fy, cx, cy) with px, py, pz in the camera."""
    p = pixels.filter((F.col("row") % stride == 0) & (F.col("col") % stride == 0)).withColumns({"row": (F.col("row") / stride).cast("int"), "col": (F.col("col") / stride).cast("int")})
    x, y, z = G.back_project(F.col("col"), F.col("row"), F.col("depth"), *[F.col(c) for c in ("fx", "fy", "cx", "cy")], stride)
    return p.withColumns({"px": x, "py": y, "pz": z})


def normals(points: DataFrame, stride: int = 1, *, least: float = 0.15, most: float = priors.MAX_DEPTH, conf: int = priors.MIN_CONFIDENCE, jump: float = 0.02) -> DataFrame:
    """Valid points with unit normals (cnx, cny, cnz) that face the camera: central differences along rows and columns; a point is valid
    if it is near and sure enough, inside the image, and depth changes by under 8 % and ``jump`` around it. Two windows, one frame's rows and columns."""
    across, down = Window.partitionBy(*FRAME, "row").orderBy("col"), Window.partitionBy(*FRAME, "col").orderBy("row")
    d = points
    for name, w in (("h", across), ("v", down)):
        for c in ("px", "py", "pz"):
            d = d.withColumn(f"_{name}{c}", F.lead(c).over(w) - F.lag(c).over(w))
    h, v = (tuple(F.col(f"_{n}{c}") for c in ("px", "py", "pz")) for n in ("h", "v"))
    n = G.cross(h, v)
    size = G.norm(n)
    p = tuple(F.col(c) for c in ("px", "py", "pz"))
    away = F.when(G.dot(n, p) > 0, -1.0).otherwise(1.0) / F.greatest(size, F.lit(1e-9))
    ok = (F.col("depth") > least) & (F.col("depth") < most) & (F.col("conf") >= conf) & (size > 0) & (F.greatest(F.abs(h[2]), F.abs(v[2])) < 0.08 * F.col("depth") * stride + jump)
    d = d.withColumns({f"cn{a}": c * away for a, c in zip("xyz", n, strict=True)}).filter(ok)  # on the border a difference is null
    return d.drop(*[f"_{a}{c}" for a in "hv" for c in ("px", "py", "pz")])


def cloud(valid: DataFrame, poses: DataFrame, voxel: float = 0.02) -> DataFrame:
    """capture_id, frame_id, x, y, z, nx, ny, nz, range: world points, the nearest to its camera of each voxel. poses: capture_id,
    frame_id, r00..r22, x, y, z of every frame: small beside the pixels."""
    q = poses.select(*FRAME, *[f"r{i}{j}" for i in range(3) for j in range(3)], F.col("x").alias("_tx"), F.col("y").alias("_ty"), F.col("z").alias("_tz"))
    j = valid.join(q, FRAME)
    r = {f"r{a}{b}": F.col(f"r{a}{b}") for a in range(3) for b in range(3)}
    p = tuple(F.col(c) for c in ("px", "py", "pz"))
    w = G.to_world(p, r, tuple(F.col(c) for c in ("_tx", "_ty", "_tz")))
    n = G.to_world(tuple(F.col(c) for c in ("cnx", "cny", "cnz")), r)
    out = j.select(*FRAME, "row", "col", *[c.alias(a) for a, c in zip("xyz", w, strict=True)], *[c.alias(f"n{a}") for a, c in zip("xyz", n, strict=True)], G.norm(p).alias("range"))
    return voxel_nearest(out, ["x", "y", "z"], voxel, ["range", "frame_id", "row", "col"], ["capture_id"]).drop("row", "col")


def build_cloud(pixels: DataFrame, poses: DataFrame, stride: int = 1, voxel: float = 0.02) -> DataFrame:
    return cloud(normals(camera_points(pixels, stride), stride), poses, voxel)


def half_resolution(pixels: DataFrame, level: str = "level") -> DataFrame:
    """Every other row and column of pixels with some confidence; intrinsics halved."""
    d = pixels.filter((F.col("row") % 2 == 0) & (F.col("col") % 2 == 0) & (F.col(level) > 0))
    return d.withColumns({"row": (F.col("row") / 2).cast("int"), "col": (F.col("col") / 2).cast("int"), **{c: F.col(c) / 2 for c in ("fx", "fy", "cx", "cy")}})


def level_frames(poses: DataFrame, low: float = -0.45, high: float = 0.25) -> DataFrame:
    """Frames whose camera (its axis is the rotation's third column) is about level."""
    return poses.filter(G.pitch(F.col("r02"), F.col("r12"), F.col("r22")).between(low, high))
