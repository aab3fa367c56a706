"""Row-wise geometry as column expressions: poses, projections, plan coordinates, grids, angles, vectors. All stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(*names: str) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: tuple[Column, ...]) -> Column:
    return F.sqrt(dot(a, a))


def quaternion_rotation(qx: Column, qy: Column, qz: Column, qw: Column) -> dict[str, Column]:
    """r00..r22 of a quaternion (x, y, z, w), which need not have unit length."""
    s = F.lit(2.0) / (qx * qx + qy * qy + qz * qz + qw * qw)
    return {
        "r00": 1 - s * (qy * qy + qz * qz), "r01": s * (qx * qy - qz * qw), "r02": s * (qx * qz + qy * qw),
        "r10": s * (qx * qy + qz * qw), "r11": 1 - s * (qx * qx + qz * qz), "r12": s * (qy * qz - qx * qw),
        "r20": s * (qx * qz - qy * qw), "r21": s * (qy * qz + qx * qw), "r22": 1 - s * (qx * qx + qy * qy),
    }


def rescaled_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, from_size: tuple[int, int], to_size: tuple[int, int]) -> tuple[Column, ...]:
    kx, ky = to_size[0] / from_size[0], to_size[1] / from_size[1]
    return fx * kx, fy * ky, cx * kx, cy * ky


def back_project(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column, stride: int = 1) -> Vec:
    """Camera coordinates of a pixel of an image sampled every ``stride`` pixels."""
    return ((u - cx / stride) * depth / (fx / stride), (v - cy / stride) * depth / (fy / stride), depth)


def to_world(p: Vec, rotation: dict[str, Column], t: Vec | None = None) -> Vec:
    """Rotates (and moves, if t is given) a point or a direction."""
    out = tuple(dot(p, tuple(rotation[f"r{i}{j}"] for j in range(3))) for i in range(3))
    return out if t is None else tuple(a + b for a, b in zip(out, t, strict=True))  # type: ignore[return-value]


def rotate_plan(x: Column, z: Column, yaw: Column) -> tuple[Column, Column]:
    """Wall-aligned plan coordinates (u, v) of world (x, z); directions rotate alike."""
    return F.cos(yaw) * x + F.sin(yaw) * z, F.cos(yaw) * z - F.sin(yaw) * x


def unrotate_plan(u: Column, v: Column, yaw: Column) -> tuple[Column, Column]:
    return F.cos(yaw) * u - F.sin(yaw) * v, F.sin(yaw) * u + F.cos(yaw) * v


def similarity(p: Vec, scale: Column, rotation: dict[str, Column], t: Vec) -> Vec:
    return tuple(scale * a + b for a, b in zip(to_world(p, rotation), t, strict=True))  # type: ignore[return-value]


def axis_rotation(up: Vec) -> dict[str, Column]:
    """The rotation that takes a unit vector to +y (Rodrigues); for -y a half turn about x."""
    x, y, z = up
    k = F.lit(1.0) / F.greatest(1 + y, F.lit(1e-12))
    flip = y < -1 + 1e-9
    # rows map to: (x', y', z') with y' along up
    r = {"r00": 1 - x * x * k, "r01": -x, "r02": -x * z * k, "r10": x, "r11": y, "r12": z, "r20": -x * z * k, "r21": -z, "r22": 1 - z * z * k}
    turned = {"r00": 1.0, "r11": -1.0, "r22": -1.0}
    return {n: F.when(flip, F.lit(turned.get(n, 0.0))).otherwise(c) for n, c in r.items()}


def grid_index(x: Column, origin: Column | float, res: float, n: Column | int | None = None) -> Column:
    i = F.floor((x - origin) / res)
    return i if n is None else F.least(F.greatest(i, F.lit(0)), (n if isinstance(n, Column) else F.lit(n)) - 1)


def grid_centre(i: Column, origin: Column | float, res: float) -> Column:
    return origin + (i + 0.5) * res


def height_bin(h: Column, lo: float, step: float, bins: int) -> Column:
    return F.least(F.greatest(F.floor((h - lo) / step), F.lit(0)), F.lit(bins - 1))


def focal_from_fov(width: Column, fov: Column) -> Column:
    return width / 2 / F.tan(fov / 2)


def fov_from_focal(width: Column, focal: Column) -> Column:
    return 2 * F.atan(width / 2 / focal)


def focal_from_f35(f35: Column, width: Column, height: Column) -> Column:
    """Pixels of a 35-mm-equivalent focal length; 43.2666 mm is the diagonal of the 35-mm frame."""
    return f35 / 43.2666 * F.hypot(width, height)


def model_size(width: Column, scale: Column, patch: int) -> Column:
    return (F.bround(width * scale / patch) * patch).cast("int")


def crop_to_aspect(width: Column, height: Column, aspect: float) -> tuple[Column, Column]:
    """Width and height of the largest centred crop with this aspect (width / height)."""
    wide = width > height * aspect
    return F.when(wide, F.bround(height * aspect)).otherwise(width).cast("int"), F.when(wide, height).otherwise(F.bround(width / aspect)).cast("int")


def calibrated_depth(d: Column, factor: float = 0.955) -> Column:
    """Depth by the calibration factor; what isn't finite is 0."""
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(0.0)).otherwise(d / factor)


def view_cosine(p: Vec, n: Vec) -> Column:
    return F.abs(dot(p, n)) / F.greatest(norm(p), F.lit(1e-9))


def view_score(cosine: Column, distance: Column) -> Column:
    return cosine / F.greatest(distance, F.lit(0.3))


def expected_pixels(tile: float, cosine: Column, distance: Column, fx: Column, fy: Column) -> Column:
    return F.lit(tile * tile) * cosine / (distance * distance / (fx * fy))


def heading(dx: Column, dz: Column) -> Column:
    return F.degrees(F.atan2(dx, dz))


def pitch(dx: Column, dy: Column, dz: Column) -> Column:
    return F.atan2(dy, F.hypot(dx, dz))


def snap_right_angle(delta: Column) -> Column:
    """Degrees to the nearest multiple of 90, in [-45, 45)."""
    return F.pmod(delta + 45, F.lit(90.0)) - 45


def quarter_turn(axis: Column, coord: Column, sign: Column, k: Column) -> tuple[Column, Column, Column]:
    """Axis, coordinate and sign of a plan face after k quarter turns: (u, v) -> (-v, u)."""
    k = F.pmod(k, F.lit(4))
    odd, u = k % 2 == 1, axis == "u"
    flips = F.when(k == 0, F.lit(1)).when(k == 1, F.when(u, F.lit(1)).otherwise(F.lit(-1))).when(k == 2, F.lit(-1)).otherwise(F.when(u, F.lit(-1)).otherwise(F.lit(1)))
    return F.when(odd, F.when(u, F.lit("v")).otherwise(F.lit("u"))).otherwise(axis), coord * flips, sign * flips


def sample_segment(lo: Column, hi: Column, step: float = 0.05) -> Column:
    """An array of places along [lo, hi], every step and the end's own fraction left out."""
    n = F.floor((hi - lo) / step + 1e-9).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: lo + i * step)


def image_tiles(width: Column, height: Column, scales: tuple[float, ...] = (1.0, 0.5, 0.25)) -> Column:
    """Array of square tiles (x, y, size) with half overlap at several scales of the shorter side."""
    side = F.least(width, height)

    def at(scale: float) -> Column:
        size = F.floor(side * scale).cast("int")
        step = F.greatest(F.floor(size / 2).cast("int"), F.lit(1))
        xs = F.sequence(F.lit(0), F.greatest(F.floor((width - size) / step), F.lit(0)).cast("int"))
        ys = F.sequence(F.lit(0), F.greatest(F.floor((height - size) / step), F.lit(0)).cast("int"))
        return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct((i * step).alias("x"), (j * step).alias("y"), size.alias("size")))))

    return F.concat(*[at(s) for s in scales])


# vectors held in arrays


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used: a lambda over an array of one."""
    return F.transform(F.array(value), use)[0]


def l2_normalised(a: Column) -> Column:
    return let(F.greatest(F.sqrt(array_dot(a, a)), F.lit(1e-12)), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def softmax(logits: Column) -> Column:
    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total))

    return let(logits, lambda z: let(F.array_max(z), lambda top: let(F.transform(z, lambda x: F.exp(x - top)), shares)))


def linear_probe(features: Column, weights: list[list[float]] | Column, bias: list[float] | Column) -> Column:
    """softmax(features · Wᵀ + b); W and b as literals or array columns."""
    w = weights if isinstance(weights, Column) else F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in weights])
    b = bias if isinstance(bias, Column) else F.array(*[F.lit(float(x)) for x in bias])
    return softmax(F.zip_with(w, b, lambda row, c: array_dot(features, row) + c))


def zero_shot_gate(features: Column, prompts: Column, chosen: int, temperature: float = 100.0) -> Column:
    """Probability mass of the first ``chosen`` prompts."""
    p = softmax(F.transform(prompts, lambda row: array_dot(features, row) * temperature))
    return let(p, lambda q: F.aggregate(F.slice(q, 1, chosen), F.lit(0.0), lambda s, x: s + x))


def argmax(a: Column) -> Column:
    """Zero-based place of the first greatest element."""
    return let(a, lambda x: F.array_position(x, F.array_max(x)).cast("int") - 1)
