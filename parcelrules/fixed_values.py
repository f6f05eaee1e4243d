"""Names, lists, patterns and thresholds that results depend on.

Everything in this module is a given of the data model (field names, payload
aliases, footnote patterns, bands, limits). No logic lives here.
"""

from __future__ import annotations

# --- Rule fields of a requirements row, in table order (all DOUBLE but one) ---
RULE_FIELDS = [
    "interior_min_lot_area_sqft",
    "interior_min_lot_frontage_ft",
    "interior_min_lot_width_ft",
    "interior_min_lot_depth_ft",
    "corner_min_lot_area_sqft",
    "corner_min_lot_frontage_ft",
    "corner_min_lot_width_ft",
    "corner_min_lot_depth_ft",
    "min_circle_diameter_ft",
    "buildable_lot_area_sqft",
    "principal_front_yard_ft",
    "principal_side_yard_ft",
    "principal_street_side_yard_ft",
    "principal_rear_yard_ft",
    "principal_street_rear_yard_ft",
    "accessory_front_yard_ft",
    "accessory_side_yard_ft",
    "accessory_street_side_yard_ft",
    "accessory_rear_yard_ft",
    "accessory_street_rear_yard_ft",
    "max_building_coverage_percent",
    "max_lot_coverage_percent",
    "max_height_stories",
    "max_height_feet_total",
    "min_gross_floor_area_first_floor_sqft",
    "min_gross_floor_area_multistory_sqft",
    "max_gross_floor_area_all_structures_sqft",
    "maximum_far",
    "maximum_density_units_per_acre",
]
INTEGER_FIELDS = ["max_height_stories"]

# --- Optional nested groups of a zone object: group -> accepted key names ---
GROUP_KEYS = {
    "interior": ["interior_lots", "interior", "interior_lot"],
    "corner": ["corner_lots", "corner", "corner_lot"],
    "lot": ["lot_requirements", "additional_lot_requirements", "lot_req"],
    "principal": ["principal_building_yards", "principal_yards", "main_building_yards"],
    "accessory": ["accessory_building_yards", "accessory_yards", "accessory"],
    "coverage": ["coverage_and_height", "coverage", "building_requirements"],
    "floor": ["floor_area", "floor_requirements", "area_requirements"],
    "intensity": ["development_intensity", "intensity", "density"],
}

# --- Field -> (group, also searched in the flat zone object?, key aliases in order) ---
FIELD_ALIASES = {
    "interior_min_lot_area_sqft": ("interior", True, [
        "min_lot_area_sqft", "interior_min_lot_area_sqft", "lot_area", "area_sqft", "minimum_area_sqft"]),
    "interior_min_lot_frontage_ft": ("interior", True, [
        "min_lot_frontage_ft", "interior_min_lot_frontage_ft", "frontage", "frontage_ft", "street_frontage"]),
    "interior_min_lot_width_ft": ("interior", True, [
        "min_lot_width_ft", "interior_min_lot_width_ft", "width", "width_ft", "lot_width"]),
    "interior_min_lot_depth_ft": ("interior", True, [
        "min_lot_depth_ft", "interior_min_lot_depth_ft", "depth", "depth_ft", "lot_depth"]),
    "corner_min_lot_area_sqft": ("corner", False, ["min_lot_area_sqft"]),
    "corner_min_lot_frontage_ft": ("corner", False, ["min_lot_frontage_ft"]),
    "corner_min_lot_width_ft": ("corner", False, ["min_lot_width_ft"]),
    "corner_min_lot_depth_ft": ("corner", False, ["min_lot_depth_ft"]),
    "min_circle_diameter_ft": ("lot", False, ["min_circle_diameter_ft"]),
    "buildable_lot_area_sqft": ("lot", False, ["buildable_lot_area_sqft"]),
    "principal_front_yard_ft": ("principal", True, [
        "principal_min_front_yard_ft", "front_yard_ft", "front_setback", "principal_front_yard_ft"]),
    "principal_side_yard_ft": ("principal", True, [
        "principal_min_side_yard_ft", "side_yard_ft", "side_setback", "principal_side_yard_ft"]),
    "principal_street_side_yard_ft": ("principal", True, [
        "principal_min_street_side_yard_ft", "street_side_yard_ft", "street_side_setback"]),
    "principal_rear_yard_ft": ("principal", True, [
        "principal_min_rear_yard_ft", "rear_yard_ft", "rear_setback", "principal_rear_yard_ft"]),
    "principal_street_rear_yard_ft": ("principal", True, [
        "principal_min_street_rear_yard_ft", "street_rear_yard_ft", "street_rear_setback"]),
    "accessory_front_yard_ft": ("accessory", True, [
        "accessory_min_front_yard_ft", "accessory_front_yard_ft", "garage_front_setback", "outbuilding_front"]),
    "accessory_side_yard_ft": ("accessory", True, [
        "accessory_min_side_yard_ft", "accessory_side_yard_ft", "garage_side_setback", "outbuilding_side"]),
    "accessory_street_side_yard_ft": ("accessory", True, [
        "accessory_min_street_side_yard_ft", "accessory_street_side_yard_ft"]),
    "accessory_rear_yard_ft": ("accessory", True, [
        "accessory_min_rear_yard_ft", "accessory_rear_yard_ft", "garage_rear_setback", "outbuilding_rear"]),
    "accessory_street_rear_yard_ft": ("accessory", True, [
        "accessory_min_street_rear_yard_ft", "accessory_street_rear_yard_ft"]),
    "max_building_coverage_percent": ("coverage", True, [
        "max_building_coverage_percent", "building_coverage", "coverage_percent", "max_coverage"]),
    "max_lot_coverage_percent": ("coverage", True, [
        "max_lot_coverage_percent", "lot_coverage", "max_lot_coverage", "coverage"]),
    "max_height_stories": ("coverage", True, [
        "principal_max_height_stories", "max_height_stories", "height_stories", "max_stories"]),
    "max_height_feet_total": ("coverage", True, [
        "principal_max_height_feet", "max_height_feet_total", "max_height_feet", "height_ft"]),
    "min_gross_floor_area_first_floor_sqft": ("floor", False, ["min_gross_floor_area_first_floor_sqft"]),
    "min_gross_floor_area_multistory_sqft": ("floor", False, ["min_gross_floor_area_multistory_sqft"]),
    "max_gross_floor_area_all_structures_sqft": ("floor", False, ["max_gross_floor_area_all_structures_sqft"]),
    "maximum_far": ("intensity", True, [
        "maximum_far", "max_far", "far", "floor_area_ratio", "maximum_floor_area_ratio"]),
    "maximum_density_units_per_acre": ("intensity", True, [
        "maximum_density_units_per_acre", "max_density", "density", "units_per_acre"]),
}

# --- Accessory yards fall back on these flat keys of the principal building ---
ACCESSORY_FALLBACK_KEYS = {
    "accessory_front_yard_ft": ["principal_min_front_yard_ft", "front_yard_ft", "front_setback"],
    "accessory_side_yard_ft": ["principal_min_side_yard_ft", "side_yard_ft", "side_setback"],
    "accessory_rear_yard_ft": ["principal_min_rear_yard_ft", "rear_yard_ft", "rear_setback"],
}

# --- Keys of a response ---
ZONE_ARRAY_KEYS = ["zones", "zoning_requirements", "requirements", "extracted_zones", "districts"]
SCORER_ZONE_ARRAY_KEYS = ["zones", "zoning_requirements", "requirements", "extracted_zones"]
ZONE_MARKER_KEYS = ["zone", "district", "zoning", "Zone"]
ZONE_NAME_KEYS = ["zone_name", "zone", "district", "zoning_district", "name"]

# --- Defaults and placeholders ---
DEFAULT_STATE = "NJ"
DEFAULT_CONFIDENCE = 0.7
ENVELOPE_CONFIDENCE = 0.5
REGEX_CONFIDENCE = 0.3
UNKNOWN_COUNTY = "Unknown County"
PENDING_TOWN = "PENDING_EXTRACTION"
UNKNOWN_ZONE = "Unknown_Zone"
DATA_SOURCE = "AI_Extracted"

# --- Text patterns ---
SUPERSCRIPTS = "¹²³⁴⁵⁶⁷⁸⁹⁰"
SUPERSCRIPT_RUN = "[¹²³⁴⁵⁶⁷⁸⁹⁰]+"
CARET_NOTE = r"\^[0-9]+"
BRACKET_NOTE = r"\([0-9]+\)"
TRAILING_COMMA = r",(\s*[}\]])"
CONTROL_CHARS = r"[\x00-\x1F\x7F-\x9F]"
ZONE_MENTION_PATTERNS = [
    r"(?iU)(?:zone|district)[:\s]*([A-Z0-9\-]+)",
    r"(?iU)([A-Z]{1,2}-\d+)",
    r"(?iU)([RC]-\d+)",
]
MAX_ZONE_MENTION_LENGTH = 50

# --- Number repair: values and ranges ---
PLAUSIBLE_LOT_AREA = (1000, 50000)
TWO_DIGIT_PREFIXES = ["10", "11", "12", "20", "21", "22", "30", "31", "32"]
KNOWN_LOT_AREAS = {
    15000: 5000,
    28000: 8000,
    312000: 12000,
    110000: 10000,
    115000: 15000,
    27500: 7500,
    36000: 6000,
}
SMALL_LOT_AREA = (3000, 20000)
LARGE_LOT_ABOVE = 100000

# --- Scoring: key of an extracted zone -> field of the verified zone ---
SCORED_KEYS = {
    "interior_min_lot_area_sqft": "interior_min_lot_area_sqft",
    "interior_min_lot_frontage_ft": "interior_min_lot_frontage_ft",
    "interior_min_lot_width_ft": "interior_min_lot_width_ft",
    "interior_min_lot_depth_ft": "interior_min_lot_depth_ft",
    "principal_min_front_yard_ft": "principal_front_yard_ft",
    "principal_front_yard_ft": "principal_front_yard_ft",
    "principal_min_side_yard_ft": "principal_side_yard_ft",
    "principal_side_yard_ft": "principal_side_yard_ft",
    "principal_min_rear_yard_ft": "principal_rear_yard_ft",
    "principal_rear_yard_ft": "principal_rear_yard_ft",
    "max_building_coverage_percent": "max_building_coverage_percent",
    "max_lot_coverage_percent": "max_lot_coverage_percent",
    "principal_max_height_stories": "max_height_stories",
    "max_height_stories": "max_height_stories",
    "principal_max_height_feet": "max_height_feet_total",
    "max_height_feet_total": "max_height_feet_total",
    "maximum_far": "maximum_far",
    "max_far": "maximum_far",
    "maximum_density_units_per_acre": "maximum_density_units_per_acre",
}
FIELD_TOLERANCE_PERCENT = 5.0
STRICT_TOLERANCE = 0.05
ZONE_WEIGHT = 0.4
FIELD_WEIGHT = 0.6
COMPLETENESS_KEYS = [
    "zone_name", "interior_min_lot_area_sqft", "interior_min_lot_frontage_ft",
    "principal_min_front_yard_ft", "principal_min_side_yard_ft", "principal_min_rear_yard_ft",
    "principal_max_height_feet", "max_lot_coverage_percent", "maximum_far",
]
COMPLETENESS_FIELDS_PER_ZONE = 10

# --- Bands, best first: (lower bound, label) and the label below all bounds ---
ACCURACY_BANDS = ([(0.9, "Excellent"), (0.7, "Good")], "Needs Improvement")
ZONE_BANDS = ([(0.95, "Perfect"), (0.8, "Good")], "Poor")
DIFFICULTY_BANDS = ([(0.9, "Easy"), (0.7, "Medium")], "Hard")
DASHBOARD_BANDS = ([(0.9, "success"), (0.7, "warning")], "error")
RATING_BANDS = ([(0.95, 5), (0.85, 4), (0.75, 3), (0.6, 2)], 1)
TREND_STEP = 0.01

# --- Files ---
ALLOWED_SUFFIXES = ["pdf", "doc", "docx", "txt", "jpg", "jpeg", "png", "tiff"]
PARSER_SUFFIXES = ["pdf", "doc", "docx"]
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_ATTEMPTS = 3

# --- Status values ---
FINAL_STATUSES = ["completed", "failed"]
COMPLEXITIES = ["simple", "medium", "complex"]

# --- Columns of the bulk call: cast to integer, cast to a number ---
BULK_INTEGER_FIELDS = [
    "interior_min_lot_area_sqft", "interior_min_lot_frontage_ft",
    "interior_min_lot_width_ft", "interior_min_lot_depth_ft",
    "corner_min_lot_area_sqft", "corner_min_lot_frontage_ft",
    "corner_min_lot_width_ft", "corner_min_lot_depth_ft",
    "buildable_lot_area_sqft", "min_gross_floor_area_first_floor_sqft",
    "min_gross_floor_area_multistory_sqft", "max_gross_floor_area_all_sqft",
]
BULK_NUMERIC_FIELDS = [
    "min_circle_diameter_ft", "principal_front_yard_ft", "principal_side_yard_ft",
    "principal_street_side_yard_ft", "principal_rear_yard_ft", "principal_street_rear_yard_ft",
    "accessory_front_yard_ft", "accessory_side_yard_ft", "accessory_street_side_yard_ft",
    "accessory_rear_yard_ft", "accessory_street_rear_yard_ft", "max_building_coverage_pct",
    "max_lot_coverage_pct", "principal_height_stories", "principal_height_ft",
    "max_far", "max_density_units_per_acre",
]

# --- Phrases an ordinance uses for a rule, per extracted key ---
PHRASES = {
    "interior_min_lot_area_sqft": ["lot area", "lot size", "minimum area", "required area", "minimum lot(?! [a-z])"],
    "interior_min_lot_frontage_ft": ["frontage"],
    "interior_min_lot_width_ft": ["lot width", "width"],
    "interior_min_lot_depth_ft": ["lot depth", "depth"],
    "principal_min_front_yard_ft": ["front yard", "front setback", "front building line"],
    "principal_min_side_yard_ft": ["side yard", "side setback"],
    "principal_min_rear_yard_ft": ["rear yard", "rear setback", "back yard"],
    "principal_max_height_feet": ["building height", "maximum height", "max height", "height limit", "height", "H ?(?==)"],
    "max_building_coverage_percent": ["building coverage", "structure coverage", "footprint coverage"],
    "max_lot_coverage_percent": ["lot coverage", "impervious coverage", "total coverage", "site coverage"],
    "maximum_far": ["FAR", "floor area ratio"],
    "maximum_density_units_per_acre": ["density"],
}

SQFT_IN_ACRE = 43560.0
