"""Fixed values of the domain: sizes of doors, rooms and tiles, thresholds, weights, rules. Lengths are metres, areas square metres."""

from __future__ import annotations

DOOR_MIN, DOOR_MAX, WINDOW_MAX = 0.55, 1.30, 3.0
CORRIDOR_MAX_WIDTH, CORRIDOR_MIN_ELONGATION = 1.6, 2.0
NECK_MAX, NECK_MIN_AREA = 2.0, 3.0
SPACE_MIN_AREA, SPACE_MIN_WIDTH, CLOSET_MAX_AREA = 1.0, 0.7, 2.8
WALL_COVERAGE, WALL_SOLID = 0.55, 0.4
MAX_DEPTH, MIN_CONFIDENCE, CEILING_COVERAGE = 4.0, 2, 0.5
TILE, MIN_VIEWS, MIN_TILE_PIXELS, MAX_VIEW_DISTANCE, MIN_AGREEING, MIN_DEFECT, MIN_SURFACE = 0.4, 3, 64, 3.0, 2, 0.6, 0.5
DRIFT_SEGMENT, REVISIT_S, SIGMA_ODOMETRY, SIGMA_ICP = 60, 20.0, 0.01, 0.03
KEYFRAME_SHIFT, KEYFRAME_GAP_S, LINK_RESIDUAL = 0.12, 0.5, 0.25

#: Fixture class, space type, weight of one instance (three count at most).
FIXTURE_WEIGHTS = [
    ("toilet", "Bathroom", 3.0), ("shower", "Bathroom", 3.0), ("bathtub", "Bathroom", 2.0), ("sink", "Bathroom", 1.0), ("sink", "Kitchen", 1.0),
    ("stove", "Kitchen", 3.0), ("refrigerator", "Kitchen", 2.0), ("kitchen cabinet", "Kitchen", 2.0), ("microwave", "Kitchen", 1.0),
    ("sofa", "Living", 3.0), ("television", "Living", 1.5), ("television", "Bedroom", 0.5), ("bed", "Bedroom", 3.0), ("wardrobe", "Bedroom", 1.0),
    ("dining table", "Dining", 2.0), ("desk", "Study", 2.0), ("office chair", "Study", 1.0), ("staircase", "Stairs", 3.0),
    ("stair railing", "Stairs", 2.0), ("washing machine", "Utility", 3.0),
]
#: Space type, least and greatest plausible area.
PLAUSIBLE_AREA = [("Bathroom", 1.5, 8.0), ("Kitchen", 3.0, 25.0), ("Living", 7.0, 60.0), ("Bedroom", 6.0, 30.0), ("Dining", 5.0, 40.0), ("Study", 4.0, 20.0), ("Stairs", 2.0, 30.0), ("Utility", 1.5, 8.0)]
#: Fixture class that alone names a space type.
DECISIVE = [
    ("toilet", "Bathroom"), ("shower", "Bathroom"), ("bathtub", "Bathroom"), ("stove", "Kitchen"), ("kitchen cabinet", "Kitchen"),
    ("refrigerator", "Kitchen"), ("bed", "Bedroom"), ("sofa", "Living"), ("staircase", "Stairs"), ("stair railing", "Stairs"), ("washing machine", "Utility"),
]
#: Class that the probe tells apart, damage class of the report.
DAMAGE_CLASS = [("algae", "mould"), ("stain", "water_stain"), ("peeling", "peeling_paint"), ("spalling", "spalling"), ("minor_crack", "crack"), ("major_crack", "crack")]
MIN_TYPE_SCORE, MIN_TYPE_MARGIN, IMPLAUSIBLE, STAIR_POINTS = 3.0, 1.5, 0.3, 400
WET_TYPES = ["Bathroom", "WC", "Kitchen", "Utility", "Living / Kitchen"]
MOIST_CLASSES = ["water_stain", "mould"]
#: Damage class, repair, quantity per square metre (or per metre of extent), least quantity, unit.
REPAIRS = [
    ("water_stain", "Stain-block primer and repaint", 1.5, 1.0, "m2"), ("mould", "Fungicidal wash, stain-block, anti-mould paint", 2.0, 1.0, "m2"),
    ("peeling_paint", "Scrape, fill, prime and repaint", 1.3, 0.5, "m2"), ("spalling", "Break out loose render, patch repair and repaint", 1.3, 0.5, "m2"),
    ("crack", "Rake out and fill crack, repaint surface", 1.0, 0.0, "m"),
]
