"""Measurements with a 95 % interval: the error model of a tier, and how errors combine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


@dataclass(frozen=True)
class ErrorModel:
    """face: systematic error of a wall face (m); drift: error per metre; scale: relative scale error."""

    face: float
    drift: float
    scale: float


#: The error models of the capture tiers.
LIDAR, VIDEO, PHOTO = ErrorModel(0.006, 0.002, 0.0), ErrorModel(0.02, 0.01, 0.03), ErrorModel(0.03, 0.015, 0.12)
TIERS = {"lidar": LIDAR, "video": VIDEO, "photo": PHOTO}


def face_sigma(std: Column, n: Column, measured: Column | None = None, model: ErrorModel = LIDAR) -> Column:
    s = F.hypot(3 * std / F.sqrt(F.greatest(n, F.lit(1))), F.lit(model.face))
    return s if measured is None else F.when(measured, s).otherwise(F.lit(0.05 + model.face))


def floor_sigma(std: Column, n: Column) -> Column:
    return F.hypot(3 * std / F.sqrt(F.greatest(n, F.lit(1))), F.lit(0.004))


def length_ci(length: Column, sigma_lo: Column, sigma_hi: Column, model: ErrorModel = LIDAR) -> Column:
    grow = F.hypot(F.lit(model.drift) * length, F.lit(model.scale) * length)
    return Z * F.sqrt(sigma_lo * sigma_lo + sigma_hi * sigma_hi + grow * grow)


def area_ci(area: Column, length_u: Column, ci_u: Column, length_v: Column, ci_v: Column) -> Column:
    return area * F.hypot(ci_u / length_u, ci_v / length_v)


def opening_ci(kind: Column, width: Column | None = None, model: ErrorModel = LIDAR) -> Column:
    """Width of a door (two jambs of 8 mm), a window (20 mm), another opening (two edges of 30 mm); no edge is better known than the tier's
    faces, and the tier's scale error grows with the width."""
    edge = lambda s: F.lit(2**0.5 * max(s, model.face))
    base = F.when(kind == "door", edge(0.008)).when(kind == "window", F.lit(0.02)).otherwise(edge(0.03))
    return F.lit(Z) * (base if width is None else F.hypot(base, model.scale * width))


def ceiling_ci(value: Column, std: Column, n: Column, sigma_floor: Column, model: ErrorModel = LIDAR) -> Column:
    """Height of a ceiling: of its plane, of the floor, and of the tier's faces and scale."""
    plane = 3 * std / F.sqrt(F.greatest(n, F.lit(1)))
    return F.lit(Z) * F.sqrt(plane * plane + model.face**2 + sigma_floor * sigma_floor + (model.scale * value) * (model.scale * value))


def region_ci(area: Column, exposed_sides: Column, tile: float = 0.4) -> Column:
    return 0.5 * exposed_sides / 4 * tile * tile + 0.1 * area


def measured(value: Column, ci: Column, digits: int = 4) -> Column:
    """value and ci95, both rounded half to even."""
    return F.struct(F.bround(value, digits).alias("value"), F.bround(ci, digits).alias("ci95"))
