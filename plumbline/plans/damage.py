"""Damage of a capture: tile views are chosen by geometry alone, then the probabilities ingested for them are voted on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import priors
from ..operators import damage
from ..operators import windows as windows_of_rank

TILE_KEY = ["surface_id", "a", "b"]
#: Fixed value: the order of the classes in ingested probabilities.
CLASSES = ["algae", "major_crack", "minor_crack", "peeling", "plain", "spalling", "stain"]


@dataclass
class Damage:
    views: DataFrame
    regions: DataFrame
    inspected: DataFrame
    flags: DataFrame
    scope: DataFrame


def scan_damage(pixels: DataFrame, probs: DataFrame, surfaces: DataFrame, rooms: DataFrame, adjacent: DataFrame, windows: DataFrame, keys: list[str], classes: list[str] = CLASSES) -> Damage:
    """pixels: frame, surface_id, a, b, x, y, d, cos, fx, fy, width, height; probs: frame, surface_id, a, b, probs, surface_p (of the
    chosen views only: pixels are fetched late); surfaces: surface_id, kind, room, axis, coord."""
    best = damage.best_views(damage.tile_views(pixels, TILE_KEY, keys), TILE_KEY, keys)
    seen = probs.join(best.select(*keys, "frame", *TILE_KEY), [*keys, "frame", *TILE_KEY], "left_semi")
    tiles = damage.voted(seen, TILE_KEY, keys, classes, report=dict(priors.DAMAGE_CLASS))
    reg = damage.regions(tiles, keys).join(surfaces, [*keys, "surface_id"])
    reg = windows_of_rank.numbered(reg, [F.desc("area.value"), F.col("surface_id"), F.col("class"), F.col("component")], keys, "D", "damage_id")  # the largest is D1
    flat = reg.select(*keys, "damage_id", "class", "kind", "room", "axis", "coord", F.col("a0"), (F.col("a0") + F.col("extent_a")).alias("a1"), F.col("b0").alias("height"), F.greatest("extent_a", "extent_b").alias("extent"), F.col("area.value").alias("area"), "severity")
    flags = damage.concealed_flags(flat, rooms, adjacent, windows, keys)
    return Damage(best, reg, damage.inspected(best, TILE_KEY, keys), flags, damage.scope_items(flat, flags, keys))
