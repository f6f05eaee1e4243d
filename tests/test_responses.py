"""Normalising hand-made responses, one oddity each."""

import json
from datetime import datetime

import pytest

from parcelrules import schemas
from parcelrules.operators import ordinance, responses

AT = datetime(2024, 1, 1)


def run(spark, said, municipality=None, county=None, filename="plan.pdf"):
    df = spark.createDataFrame([(1, "job-12345678", municipality, county, None, filename, AT, said)],
                               schemas.RESPONSES)
    return responses.normalize(df).orderBy("position").collect()


def names(rows):
    return [r.zone for r in rows]


ZONE_LISTS = [
    ('{"zones": [{"zone": "A"}, {"district": "B"}, {"name": "a"}, {}]}', ["A", "B", "Unknown_Zone"]),
    ('{"zones": null}', []),
    ('{"zones": "abc", "list": [{"zone": "Z"}]}', []),
    ('{"zones": {}, "list": [{"zone": "Z"}]}', ["Z"]),
    ('{"zones": "", "list": [{"zone": "Z"}]}', ["Z"]),
    ('{"zones": {"zone": "A"}}', []),
    ('{"zones": [], "requirements": [{"zone": "A"}]}', ["A"]),
    ('{"zoning_requirements": [{"zone": "B"}], "zones": []}', ["B"]),
    ('{"zeta": [{"zone": "first"}], "alpha": [{"zone": "second"}]}', ["first"]),
    ('{"x": [{"other": 1}], "y": [5], "w": [{"Zone": 1, "name": "N"}]}', ["N"]),
    ('{"zones": [{"zone": "A"}, "text", {"zone": "B"}]}', ["A"]),
    ('{"zones": ["text", {"zone": "B"}]}', []),
    ('[{"zone": "A"}]', []),
    ('5', []),
    ('{"zones": [{"zone": "A"}]} trailing }', ["s"]),
    ('prose {"zones": [{"zone": "A"},],\n} prose', ["A"]),
    ('{"raw_response": "{\\"zones\\": [{\\"zone\\": \\"In\\"}]}"}', ["In"]),
    ('{"raw_response": 5, "zones": [{"zone": "A"}]}', ["A"]),
    ('{"zones": [{"zone_name": "", "zone": null, "district": 0, "name": 7}]}', ["7"]),
    ('zone R-1, zone r-1, zone R-1', ["R-1", "r-1"]),
    ('{"a": 1, "a": 2, "zones": [{"zone": "X", "zone": "Y"}]}', ["Y"]),
]


def test_zone_lists(spark):
    rows = [(i, f"job-{i}", None, None, None, "plan.pdf", AT, said) for i, (said, _) in enumerate(ZONE_LISTS)]
    got = {i: [] for i in range(len(rows))}
    for r in responses.normalize(spark.createDataFrame(rows, schemas.RESPONSES)).orderBy("position").collect():
        got[r.response_id].append(r.zone)
    assert [(said, got[i]) for i, (said, _) in enumerate(ZONE_LISTS)] == ZONE_LISTS


def test_wrapped_text_is_searched_for_zones(spark):
    rows = run(spark, json.dumps({"raw_response": "See zone R-5.", "zones": [], "extraction_confidence": 0.5}))
    assert set(names(rows)) == {"R-5", "s"}
    assert {(r.town, r.county, r.extraction_confidence) for r in rows} == {("PENDING_EXTRACTION", "Unknown County", 0.3)}


def test_a_present_null_stops_the_search(spark):
    zone = {"zone": "A", "interior": {"min_lot_area_sqft": None}, "lot_area": 9000, "front_yard_ft": None,
            "front_setback": 30, "frontage": "80 ft", "width": "n/a", "depth": 90, "accessory_front_yard_ft": "x"}
    (row,) = run(spark, json.dumps({"zones": [zone]}))
    assert row.interior_min_lot_area_sqft is None and row.principal_front_yard_ft is None
    assert row.interior_min_lot_frontage_ft is None and row.interior_min_lot_width_ft is None
    assert row.interior_min_lot_depth_ft == 90 and row.accessory_front_yard_ft is None


def test_groups_and_types(spark):
    zone = {"zone_name": "R-2²", "interior_lots": {"lot_area": "28000"}, "coverage": 40, "coverage_and_height": "none",
            "building_requirements": {"max_stories": 2.9, "height_ft": "35¹"}, "density": {"far": ".5"},
            "accessory": {"garage_side_setback": 3}, "rear_setback": 12, "corner": {"min_lot_depth_ft": "100"}}
    (row,) = run(spark, json.dumps({"districts": [zone], "extraction_confidence": None}))
    assert (row.zone, row.interior_min_lot_area_sqft, row.max_lot_coverage_percent) == ("R-2", 8000, 40)
    assert (row.max_height_stories, row.max_height_stories_exact, row.max_height_feet_total) == (2, 2.9, 35)
    assert (row.maximum_far, row.accessory_side_yard_ft, row.accessory_rear_yard_ft) == (0.5, 3, 12)
    assert (row.corner_min_lot_depth_ft, row.extraction_confidence, row.state) == (100, None, "NJ")


def test_area_repair_without_a_text_name(spark):
    zones = [{"zone": "a", "lot_area": 125000}, {"zone": "b", "zone_name": None, "lot_area": 125000}]
    assert [r.interior_min_lot_area_sqft for r in run(spark, json.dumps({"zones": zones}))] == [25000, 125000]


@pytest.mark.parametrize("municipality, county, said, place", [
    (" Springfield ", "Union", {"extracted_town": "X"}, ("Springfield", "Union")),
    ("Unknown", "", {"extracted_town": " X ", "extracted_county": "C"}, ("X", "C")),
    (None, "Unknown County", {"extracted_county": " "}, ("Doc_my_plan", "Unknown County")),
])
def test_places(spark, municipality, county, said, place):
    (row,) = run(spark, json.dumps({**said, "zones": [{"zone": "A"}]}), municipality, county, "my plan.pdf")
    assert (row.town, row.county) == place


def test_envelope(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "plain")], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(responses.envelope(F.col("s"))).collect()]
    assert got[0] == '{"a": 1}'
    assert json.loads(got[1]) == {"raw_response": "plain", "zones": [], "extraction_confidence": 0.5}


ORDINANCE = """
Land use code of the Borough of Harrow Mills
County: Larch County

District AG-40¹ (farming)
lot size no less than 40,000 sq ft, width 150
front building line 60 ft; back yard of 2 1/2 feet
H=45
Sheds: side 6 feet; outbuilding rear line 9 ft
Zone TC
The height permitted in the district for any principal structure is two and one-half stories or 36 feet
structure coverage 55 %, total coverage of 80%
side setback: N/A, depth 90
24 dwelling units per acre. FAR = .75
Zone R-1-A²: 7,500 sf, 4-story buildings; zone boundaries follow the map
"""


def test_ordinance_in_other_words(spark):
    rows = ordinance.rule_extract(spark.createDataFrame([(1, ORDINANCE)], "doc_id int, text string")).orderBy("position").collect()
    assert [(r.extracted_town, r.extracted_county, r.zone_name) for r in rows] == [
        ("Harrow Mills", "Larch County", z) for z in ("AG-40", "TC", "R-1-A")]
    farm, center, homes = [{k: x for k, x in r.asDict().items() if isinstance(x, float)} for r in rows]
    assert farm == {"interior_min_lot_area_sqft": 40000, "interior_min_lot_width_ft": 150, "interior_min_lot_depth_ft": 150, "principal_min_front_yard_ft": 60,
                    "principal_min_rear_yard_ft": 2.5, "principal_max_height_feet": 45, "accessory_min_side_yard_ft": 6,
                    "accessory_min_rear_yard_ft": 9}
    assert center == {"principal_max_height_feet": 36, "principal_max_height_stories": 2.5, "max_building_coverage_percent": 55,
                      "max_lot_coverage_percent": 80, "interior_min_lot_depth_ft": 90, "maximum_density_units_per_acre": 24,
                      "maximum_far": 0.75}
    assert homes == {"interior_min_lot_area_sqft": 7500, "principal_max_height_stories": 4}


SECTIONS = {
    "minimum rear yard, for corner lots, 30 feet": {"principal_min_rear_yard_ft": 30},
    "Front yard, 25 feet; side yards (both), 12 feet": {"principal_min_front_yard_ft": 25, "principal_min_side_yard_ft": 12},
    "setbacks: front 25 feet, side 10 feet, rear 30 feet": {
        "principal_min_front_yard_ft": 25, "principal_min_side_yard_ft": 10, "principal_min_rear_yard_ft": 30},
    "Yards:\n- front 25 ft\n- rear 30'\n": {"principal_min_front_yard_ft": 25, "principal_min_rear_yard_ft": 30},
    "garage setback 8 feet": {"accessory_min_front_yard_ft": 8},
    "Accessory buildings, rear 5 feet and side 3 feet, height 15 feet\nheight 35 feet": {
        "accessory_min_rear_yard_ft": 5, "accessory_min_side_yard_ft": 3, "principal_max_height_feet": 35},
    "frontage 80 feet": {"interior_min_lot_frontage_ft": 80, "interior_min_lot_width_ft": 80, "interior_min_lot_depth_ft": 80},
    "lot area, as stated in section 12.4, 2 acres": {"interior_min_lot_area_sqft": 87120},
    "lot area within 30 days of notice, 4 lots": {},
    "side setback: N/A, 40 feet from the front": {},
    "Height three and one-half stories, 42 feet. 20 feet wide": {"principal_max_height_stories": 3.5, "principal_max_height_feet": 42},
    "coverage shall not exceed 30%": {}, "impervious coverage 45 percent, building coverage: 30%": {
        "max_lot_coverage_percent": 45, "max_building_coverage_percent": 30},
    "as far as 3 miles": {}, "FAR=.5; density: 4.25": {"maximum_far": 0.5, "maximum_density_units_per_acre": 4.25},
    "front yard 25 feet, 30 feet on corners": {"principal_min_front_yard_ft": 25}, "": {},
}


@pytest.mark.parametrize("section", SECTIONS)
def test_clauses(section):
    found = ordinance.with_fallbacks(ordinance.found_in(section))
    assert {n: found[t] for t, n in zip(ordinance.TARGETS, ordinance.VALUES) if t in found} == SECTIONS[section]


def test_headings_and_tables(spark):
    text = """Zone PLANNED requirements: frontage 50 ft
Zone Highway Commercial: FAR 2
in zone r-2 the lot size is 9,000
Zone Regulations apply; each zone has rules. District Highway Commercial shall have FAR 3
| Zone | Lot Size | Front | Garage side | Max height | Stories | Coverage |
|---|---|---|---|---|---|---|
| R-9² | 8,500 sf | 20 ft | 4 | - | 2½ | 30% |
| too | few |
| Old Mill | 1,000 | N/A | x | 28 | 2 | 25 |
after the table FAR 4
zones\tarea\tdepth
A\t5,000\t90
"""
    df = spark.createDataFrame([("x", text, 1), ("y", None, 2), ("z", "", 3), (None, "Zone B: FAR 1", 4)], "doc_id string, text string, extra int")
    rows = sorted(ordinance.rule_extract(df).collect(), key=lambda r: (r.doc_id is None, r.position))
    assert [(r.doc_id, r.position, r.zone_name) for r in rows] == [
        ("x", 1, "PLANNED"), ("x", 2, "Highway Commercial"), ("x", 3, "r-2"), ("x", 4, "Highway Commercial"),
        ("x", 6, "R-9"), ("x", 8, "Old Mill"), ("x", 9, "A"), (None, 1, "B")]
    assert [r.maximum_far for r in rows] == [None, 2, None, 3, None, None, None, 1] and rows[2].interior_min_lot_area_sqft == 9000
    assert {k: v for k, v in rows[4].asDict().items() if isinstance(v, float)} == {
        "interior_min_lot_area_sqft": 8500, "principal_min_front_yard_ft": 20, "accessory_min_side_yard_ft": 4, "principal_max_height_stories": 2.5,
        "max_lot_coverage_percent": 30}
    assert (rows[6].interior_min_lot_area_sqft, rows[6].interior_min_lot_depth_ft) == (5000, 90)
    assert ordinance.rule_extract(df.where("false")).count() == 0


def test_odd_bulk_calls(spark):
    good = {"zone_name": "A", "max_far": "1.5"}
    calls = [json.dumps({"extracted_town": "T", "zoning_requirements": [good, "x", None, [good], {"zone_name": "B", "max_far": {}}, {"zone_name": "C"}]}),
             json.dumps({"extracted_town": "T", "zoning_requirements": good}), json.dumps({"extracted_town": "T"}), "{broken", None, "[1]",
             json.dumps({"extracted_town": None, "zoning_requirements": [good]})]
    df = spark.createDataFrame([(i, x, 10 + i) for i, x in enumerate(calls)], "response_id int, response_text string, document_id int")
    got = {r.response_id: (r.success, r.inserted_count, r.error_count) for r in responses.bulk_report(df).collect()}
    assert got == {0: (True, 2, 4), 1: (False, 0, 0), 2: (True, 0, 0), 3: (False, 0, 0), 4: (False, 0, 0), 5: (False, 0, 0), 6: (False, 0, 0)}
    said = {r.document_id: r.processing_status for r in responses.bulk_document_status(df).collect()}
    assert said == {10: "completed", 11: "failed", 12: "completed", 13: "failed", 14: "failed"}
