"""Scalar rules: value tables."""

import pytest
from pyspark.sql import functions as F

from parcelrules.functions import numeric, scores, text, variants
from parcelrules.operators import prompts, responses


def evaluate(spark, rows, schema, **columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [tuple(r)[1:] for r in df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()]


NUMBERS = {"8,000": None, "312000": 2000, "115000": 5000, "110000": 110000, "65000": 5000, "50000": 50000,
           "60500": 60500, "5000(1)": 5000, "5000¹": 5000, " 25 ": 25, "25 ft": None, "1.5": 1.5, "null": None,
           "100000": 100000, "123456": 3456, "99999": 9999, "65,000": 5000, "65 000": 5000, "25f": None, "25d": None,
           "": None, "-3": -3, "1e3": 1000, ".5": 0.5, "5.": 5, "inf": None, "NaN": None, "(1¹)": None, " 7 ": 7}


def test_number_from_text(spark):
    got = evaluate(spark, [(k,) for k in NUMBERS], "s string", v=numeric.number_from_text(F.col("s")))
    assert dict(zip(NUMBERS, [g[0] for g in got])) == NUMBERS


AREAS = [(15000.0, "R-1¹", 5000), (28000.0, "R-2²", 8000), (312000.0, "R-3³", 12000), (2000.0, "R-3", 2000),
         (115000.0, "R-1", 15000), (10000.0, "R-1", 10000), (12000.0, "R-1", 2000), (12000.0, "C-1", 12000),
         (22000.0, "R-2", 2000), (13500.0, "C-2", 3500), (20000.0, "R-20", 20000), (125000.0, "", 25000),
         (250000.0, "I-1", 50000), (145000.0, "C-1", 45000), (1200000.0, "", 1200000), (15000.7, "C-1", 5000),
         (43560.0, "R-4⁴", 3560), (None, "R-1", None), (125000.0, None, 125000), (13500.0, None, 3500)]


def test_lot_areas(spark):
    got = evaluate(spark, [(a, z) for a, z, _ in AREAS], "a double, z string",
                   v=numeric.fix_lot_area(F.col("a"), F.col("z")))
    assert [g[0] for g in got] == [w for _, _, w in AREAS]


def test_strict_mode_needs_proof(spark):
    cases = [(12000.0, "R-1", 12000), (15000.0, "C-1", 5000), (13500.0, "C-2", 13500), (12000.0, "R-1¹", 2000)]
    got = evaluate(spark, [(a, z) for a, z, _ in cases], "a double, z string",
                   v=numeric.fix_lot_area(F.col("a"), F.col("z"), "strict"))
    assert [g[0] for g in got] == [w for _, _, w in cases]


def test_zone_names(spark):
    cases = {"R-1¹": "R-1", "R-2(2)": "R-2", "C-1^3": "C-1", " R-3³ ": "R-3", "(1)": ""}
    got = evaluate(spark, [(k,) for k in cases], "s string", v=text.clean_zone_name(F.col("s")))
    assert [g[0] for g in got] == list(cases.values())


def test_json_numbers(spark):
    cases = [("2.5", 2.5, 2), ('"2.5"', 2.5, None), ('"2"', 2, 2), ("null", None, None), ("true", 1, 1),
             ('"312000"', 2000, 312000), ("312000", 312000, 312000), ("{}", None, None), ('"null"', None, None)]
    value = F.parse_json("j")
    got = evaluate(spark, [(j,) for j, _, _ in cases], "j string", n=variants.number(value),
                   w=variants.whole_number(value))
    assert got == [(n, w) for _, n, w in cases]


def test_field_accuracy(spark):
    cases = [(104.0, 100.0, 1.0), (150.0, 100.0, 0.5), (None, None, 1.0), (None, 1.0, 0.0), (1.0, None, 0.0),
             (0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (500.0, 100.0, 0.0)]
    got = evaluate(spark, [(p, a) for p, a, _ in cases], "p double, a double",
                   v=scores.field_accuracy(F.col("p"), F.col("a")))
    assert [g[0] for g in got] == [w for _, _, w in cases]


@pytest.mark.parametrize("said, zones", [
    ("Zone R-1: Minimum lot area 10,000 sqft. Zone C-2: max FAR 2.0.", {"R-1", "C-2"}),
    ("ZONE R-1 SINGLE FAMILY; zoning district c-2; The zones are Zoned R1. word-4 AB-12",
     {"R-1", "c-2", "s", "d", "rd-4", "AB-12"}),
    ("district\u00a0B-7", {"B-7"}),
])
def test_zone_mentions(spark, said, zones):
    (row,) = evaluate(spark, [(said,)], "s string", v=responses.zone_mentions(F.col("s")))
    assert set(row[0]) == zones and len(row[0]) == len(zones)


def test_names_from_files(spark):
    got = evaluate(spark, [("My plan (1).v2.pdf",), ("a" * 40 + ".pdf",), ("",)], "s string",
                   d=text.town_from_filename(F.col("s")), j=text.job_town_from_filename(F.col("s")))
    assert got == [("Doc_My_plan__1_", "Unknown_My plan (1)_v2_pdf"), ("Doc_" + "a" * 20, "Unknown_" + "a" * 30),
                   (None, None)]


def test_human_size(spark):
    got = evaluate(spark, [(512.0,), (1048576.0,), (5 * 1048576.0,)], "n double", v=text.human_size(F.col("n")))
    assert [g[0] for g in got] == ["0.5 KB", "1024.0 KB", "5.0 MB"]


def test_template_values_are_not_filled_again(spark):
    (row,) = evaluate(spark, [("{a}-{{b}}-{b}", "{b}", "x\x01y")], "t string, a string, b string",
                      v=prompts.fill_template(F.col("t"), {"a": F.col("a"), "b": F.col("b")}))
    assert row[0] == "{b}-{b}-x\x01y"


def test_missing_results_are_untested_and_new(spark):
    (row,) = evaluate(spark, [(None,)], "x double", d=scores.difficulty(F.col("x")),
                      t=scores.trend_direction(F.col("x")))
    assert row == ("Untested", "New")
