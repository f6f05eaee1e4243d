"""Response normalisation, scoring, bulk calls and prompts as named queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from parcelrules import fixed_values as fv
from parcelrules.functions import numeric, scores, text, variants as v
from parcelrules.operators import maintenance, ordinance, prompts, responses as r, scoring
from parcelrules.plans.registry import query, rounded
from parcelrules.plans.suite_reports import sql_percent
from parcelrules.sources import responses as src


def _ansi(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


# --- the scalar rules, as the checks state them ------------------------------------

def sql_notes(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(trim({x}), '[¹²³⁴⁵⁶⁷⁸⁹⁰]+', '', 'g'), "
            rf"'\^[0-9]+', '', 'g'), '\([0-9]+\)', '', 'g'))")


def sql_number(x: str) -> str:
    """Text to a number: notes off, glued footnote digits off, plain notation only."""
    c = sql_notes(x)
    d = f"replace(replace({c}, ',', ''), ' ', '')"
    n = f"try_cast({d} AS BIGINT)"
    one, two = f"try_cast(substr({d}, 2) AS BIGINT)", f"try_cast(substr({d}, 3) AS BIGINT)"
    plain = rf"CASE WHEN regexp_full_match({c}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)') THEN try_cast({c} AS DOUBLE) END"
    return (f"CASE WHEN regexp_full_match({d}, '[0-9]+') AND {n} > 50000 AND length({d}) = 5 "
            f"AND {one} BETWEEN 1000 AND 50000 THEN CAST({one} AS DOUBLE) "
            f"WHEN regexp_full_match({d}, '[0-9]+') AND {n} > 50000 AND length({d}) = 6 AND substr({d}, 1, 2) IN "
            f"('10','11','12','20','21','22','30','31','32') AND {two} BETWEEN 1000 AND 50000 "
            f"THEN CAST({two} AS DOUBLE) ELSE {plain} END")


def sql_lot_area(a: str, z: str) -> str:
    """A repaired number and a raw zone name to a lot area."""
    shown = f"CAST(CAST(trunc({a}) AS BIGINT) AS VARCHAR)"
    rest = f"try_cast(substr({shown}, 2) AS BIGINT)"
    digit = (f"CASE WHEN regexp_matches({z}, '[¹²³⁴⁵⁶⁷⁸⁹]') "
             f"THEN translate(regexp_extract({z}, '[¹²³⁴⁵⁶⁷⁸⁹]'), '¹²³⁴⁵⁶⁷⁸⁹', '123456789') "
             f"WHEN contains({z}, 'R-1') OR contains({z}, 'R1') THEN '1' "
             f"WHEN contains({z}, 'R-2') OR contains({z}, 'R2') THEN '2' "
             f"WHEN contains({z}, 'R-3') OR contains({z}, 'R3') THEN '3' END")
    known = " ".join(f"WHEN {k} THEN {val}" for k, val in (
        (15000, 5000), (28000, 8000), (312000, 12000), (110000, 10000), (115000, 15000), (27500, 7500), (36000, 6000)))
    return (f"CAST(CASE WHEN {a} IS NULL THEN NULL WHEN {a} IN (15000,28000,312000,110000,115000,27500,36000) "
            f"THEN CASE {a} {known} END "
            f"WHEN length({shown}) = 5 AND substr({shown}, 1, 1) IN ('1','2','3') AND {rest} BETWEEN 3000 AND 20000 "
            f"THEN {rest} WHEN starts_with({shown}, {digit}) AND {rest} BETWEEN 1000 AND 50000 THEN {rest} "
            f"WHEN {a} > 100000 AND length({shown}) > 4 AND {rest} BETWEEN 1000 AND 50000 THEN {rest} "
            f"ELSE {a} END AS DOUBLE)")


RAW = "raw_zone_values"


@query("clean_zone_names", f"SELECT id, {sql_notes('zone_name')} AS zone FROM raw_zone_values", (RAW,))
def clean_zone_names(t):
    return t.raw_zone_values.select("id", text.clean_zone_name(F.col("zone_name")).alias("zone"))


@query("clean_numeric", f"SELECT id, {sql_number('lot_area_text')} AS number FROM raw_zone_values", (RAW,))
def clean_numeric(t):
    return t.raw_zone_values.select("id", numeric.number_from_text(F.col("lot_area_text")).alias("number"))


@query("fix_lot_area", f"""
    WITH n AS (SELECT id, zone_name, {sql_number('lot_area_text')} AS a FROM raw_zone_values)
    SELECT id, a AS number, {sql_lot_area('a', 'zone_name')} AS lot_area FROM n""", (RAW,))
def fix_lot_area(t):
    rows = t.raw_zone_values.select("id", "zone_name", numeric.number_from_text(F.col("lot_area_text")).alias("number"))
    return rows.select("id", "number", numeric.fix_lot_area(F.col("number"), F.col("zone_name")).alias("lot_area"))


# --- the normaliser -----------------------------------------------------------------

# Field values of every zone, straight from the relational form.
ZONES_CHECK = f"""
    zv AS ({_ansi(src.ZONE_VALUES)}),
    f AS (SELECT response_id AS r, pos, k, s, {sql_notes('zone_text')} AS zone,
        CASE WHEN k % 5 <> 4 THEN zone_text ELSE '' END AS area_name,
        CASE WHEN k % 6 = 4 THEN CAST(price10 AS DOUBLE)
             WHEN k % 2 = 1 THEN {sql_number("coalesce(area_text, CAST(price10 AS VARCHAR))")}
             ELSE {sql_number('area_text')} END AS area,
        CASE WHEN s % 3 = 0 THEN CAST(s AS DOUBLE) END AS frontage FROM zv),
    w AS (SELECT *, {sql_lot_area('area', 'area_name')} AS interior_min_lot_area_sqft,
        coalesce(CASE WHEN k % 4 = 0 THEN CAST(s + 10 AS DOUBLE) END, frontage) AS width,
        CASE WHEN k % 7 = 0 THEN CAST(s * 2 AS DOUBLE) END AS corner_min_lot_width_ft,
        CAST(CASE WHEN k % 3 = 1 THEN s + 1 ELSE s END AS DOUBLE) AS principal_front_yard_ft,
        CASE WHEN k % 3 = 1 THEN CAST(s AS DOUBLE) END AS principal_side_yard_ft,
        CASE WHEN k % 2 = 0 THEN s + 0.5 END AS principal_rear_yard_ft,
        CASE WHEN k % 3 <> 1 THEN CAST(s AS DOUBLE) END AS accessory_front_yard_ft,
        CASE WHEN k % 10 = 3 THEN 5.5 WHEN k % 2 = 0 THEN s + 0.5 END AS accessory_rear_yard_ft,
        CASE WHEN k % 4 <> 3 THEN CAST(s AS DOUBLE) END AS max_lot_coverage_percent,
        CASE WHEN k % 2 = 0 THEN CAST(floor(s / 10.0) AS INT) END AS max_height_stories,
        s / 10.0 AS max_height_stories_exact, CAST(25 + s % 4 * 5 AS DOUBLE) AS max_height_feet_total,
        CASE WHEN s % 3 = 0 THEN 1.5 END AS maximum_far,
        CASE WHEN s % 3 = 1 THEN s / 4.0 END AS maximum_density_units_per_acre FROM f),
    x AS (SELECT r, CASE WHEN r % 10 = 7 THEN pos + 1 ELSE pos END AS position, * EXCLUDE (r, pos) FROM w
          WHERE r % 12 <> 5 AND (r % 10 IN (3, 4) OR r % 14 <> 6)
          UNION ALL BY NAME
          SELECT DISTINCT r, 0 AS position, 'Z-9' AS zone, 2.0 AS maximum_far FROM w
          WHERE r % 12 <> 5 AND r % 14 <> 6 AND r % 10 = 7
          UNION ALL BY NAME
          SELECT DISTINCT r, 0 AS position, 'R-' || CAST(r % 9 AS VARCHAR) AS zone FROM w WHERE r % 12 = 5
          UNION ALL BY NAME
          SELECT DISTINCT r, 1 AS position, 'C-' || CAST(r % 4 AS VARCHAR) AS zone FROM w WHERE r % 12 = 5),
    y AS (SELECT *, row_number() OVER (PARTITION BY r, lower(zone) ORDER BY position) AS rn FROM x),
    n AS (SELECT r AS response_id, position, 'job' || lpad(CAST(r AS VARCHAR), 9, '0') AS job_id,
        CASE WHEN r % 12 = 5 THEN 'PENDING_EXTRACTION' WHEN r % 8 = 0 THEN 'Mytown'
             WHEN r % 10 = 8 AND r % 10 NOT IN (3, 4, 7) AND r % 14 <> 6 THEN 'Doc_file_' || CAST(r AS VARCHAR)
             ELSE 'Town_' || CAST(r % 40 AS VARCHAR) END AS town,
        CASE WHEN r % 16 = 0 THEN 'Mycounty' WHEN r % 12 = 5 OR r % 10 = 8 OR r % 6 = 0 THEN 'Unknown County'
             ELSE 'County_' || CAST(r % 5 AS VARCHAR) END AS county, 'NJ' AS state, zone,
        interior_min_lot_area_sqft, frontage AS interior_min_lot_frontage_ft, width AS interior_min_lot_width_ft,
        width AS interior_min_lot_depth_ft, NULL AS corner_min_lot_area_sqft, NULL AS corner_min_lot_frontage_ft,
        corner_min_lot_width_ft, NULL AS corner_min_lot_depth_ft, NULL AS min_circle_diameter_ft,
        NULL AS buildable_lot_area_sqft, principal_front_yard_ft, principal_side_yard_ft,
        NULL AS principal_street_side_yard_ft, principal_rear_yard_ft, NULL AS principal_street_rear_yard_ft,
        accessory_front_yard_ft, NULL AS accessory_side_yard_ft, NULL AS accessory_street_side_yard_ft,
        accessory_rear_yard_ft, NULL AS accessory_street_rear_yard_ft, NULL AS max_building_coverage_percent,
        max_lot_coverage_percent, max_height_stories, max_height_feet_total,
        NULL AS min_gross_floor_area_first_floor_sqft, NULL AS min_gross_floor_area_multistory_sqft,
        NULL AS max_gross_floor_area_all_structures_sqft, maximum_far, maximum_density_units_per_acre,
        round(max_height_stories_exact, 9) AS max_height_stories_exact, 'AI_Extracted' AS data_source,
        CASE WHEN r % 12 = 5 THEN 0.3 WHEN r % 10 = 8 THEN 0.25
             WHEN r % 4 = 0 THEN 0.9 ELSE 0.7 END AS extraction_confidence,
        TIMESTAMP '2024-01-01 00:00:00' + (r % 700) * INTERVAL '1' MINUTE AS extracted_at FROM y WHERE rn = 1)"""


FIELD_TYPES = {f: "INTEGER" if f in fv.INTEGER_FIELDS else "DOUBLE" for f in fv.RULE_FIELDS}
NORMAL_TYPES = {**FIELD_TYPES, "extraction_confidence": "DOUBLE"}
BULK_TYPES = {"county": "VARCHAR", **{f: "INTEGER" for f in fv.BULK_INTEGER_FIELDS},
              **{f: "DOUBLE" for f in fv.BULK_NUMERIC_FIELDS}}


def _responses(t):
    return src.extraction_responses(t.spark, t.folder)


@query("normalize_requirements", f"WITH {ZONES_CHECK} SELECT * FROM n", types=NORMAL_TYPES)
def normalize_requirements(t):
    return rounded(r.normalize(_responses(t)))


@query("normalize_upsert", f"""WITH {ZONES_CHECK},
    u AS (SELECT *, row_number() OVER (PARTITION BY town, county, state, zone
                    ORDER BY extracted_at DESC, response_id DESC, position DESC) AS rn FROM n)
    SELECT * EXCLUDE (rn) FROM u WHERE rn = 1""", types=NORMAL_TYPES)
def normalize_upsert(t):
    rows = r.normalize(_responses(t))
    return rounded(maintenance.latest_per_key(rows, maintenance.UPSERT_KEY,
                                              ["extracted_at", "response_id", "position"]))


@query("parse_responses", f"""WITH {ZONES_CHECK}, a AS (SELECT DISTINCT r FROM f)
    SELECT r AS response_id, CASE WHEN r % 12 = 5 THEN 'text' ELSE 'json' END AS outcome,
           CASE WHEN r % 12 = 5 OR (r % 10 NOT IN (3, 4) AND r % 14 = 6) THEN 0
                ELSE (SELECT count(*) FROM f WHERE f.r = a.r)
                     + CASE WHEN r % 10 = 7 THEN 1 ELSE 0 END END AS zones
    FROM a""", types={"zones": "INTEGER"})
def parse_responses(t):
    return r.parse_responses(_responses(t)).select(
        "response_id", "outcome", F.coalesce(F.size("zones"), F.lit(0)).alias("zones"))


@query("resolve_location", f"""WITH {ZONES_CHECK}, a AS (SELECT DISTINCT r FROM f)
    SELECT r AS response_id,
        CASE WHEN r % 8 = 0 THEN 'Mytown' WHEN r % 12 = 5 THEN 'PENDING_EXTRACTION'
             WHEN r % 10 = 8 OR (r % 14 = 6 AND r % 10 NOT IN (3, 4)) THEN 'Doc_file_' || CAST(r AS VARCHAR)
             ELSE 'Town_' || CAST(r % 40 AS VARCHAR) END AS town,
        CASE WHEN r % 16 = 0 THEN 'Mycounty' WHEN r % 12 = 5 OR r % 10 = 8 OR r % 6 = 0
                  OR (r % 14 = 6 AND r % 10 NOT IN (3, 4)) THEN 'Unknown County'
             ELSE 'County_' || CAST(r % 5 AS VARCHAR) END AS county, 'NJ' AS state FROM a""")
def resolve_location(t):
    return r.with_place(r.parse_responses(_responses(t))).select("response_id", "town", "county", "state")


@query("extract_fields", f"""WITH {ZONES_CHECK}
    SELECT response_id, position, zone, interior_min_lot_area_sqft, principal_front_yard_ft, principal_side_yard_ft,
           principal_rear_yard_ft, max_lot_coverage_percent, max_height_stories, max_height_feet_total, maximum_far,
           maximum_density_units_per_acre FROM n""",
       types={"principal_rear_yard_ft": "DOUBLE", "maximum_far": "DOUBLE"})
def extract_fields(t):
    return rounded(r.normalize(_responses(t)).select(
        "response_id", "position", "zone", "interior_min_lot_area_sqft", "principal_front_yard_ft",
        "principal_side_yard_ft", "principal_rear_yard_ft", "max_lot_coverage_percent", "max_height_stories",
        "max_height_feet_total", "maximum_far", "maximum_density_units_per_acre"))


@query("field_fallbacks", f"""WITH {ZONES_CHECK}
    SELECT response_id, position, zone, interior_min_lot_frontage_ft, interior_min_lot_width_ft,
           interior_min_lot_depth_ft, accessory_front_yard_ft, accessory_rear_yard_ft FROM n""",
       types={"accessory_rear_yard_ft": "DOUBLE"})
def field_fallbacks(t):
    return rounded(r.normalize(_responses(t)).select(
        "response_id", "position", "zone", "interior_min_lot_frontage_ft", "interior_min_lot_width_ft",
        "interior_min_lot_depth_ft", "accessory_front_yard_ft", "accessory_rear_yard_ft"))


@query("regex_zone_fallback", """
    WITH p AS (SELECT p_partkey AS id, 'The zones near ZONE R-' || CAST(p_size AS VARCHAR) || '; zoning district: c-'
                      || CAST(p_size % 7 AS VARCHAR) || ' and lot AB-' || CAST(p_partkey % 90 AS VARCHAR) AS txt FROM part),
    m AS (SELECT id, unnest(regexp_extract_all(txt, '(?i)(?:zone|district)[:\\s]*([A-Z0-9\\-]+)', 1)) AS zone FROM p
          UNION SELECT id, unnest(regexp_extract_all(txt, '(?i)([A-Z]{1,2}-\\d+)', 1)) FROM p
          UNION SELECT id, unnest(regexp_extract_all(txt, '(?i)([RC]-\\d+)', 1)) FROM p)
    SELECT id, zone FROM m WHERE zone <> '' AND length(zone) < 50""")
def regex_zone_fallback(t):
    spoken = t.part.select(F.col("p_partkey").alias("id"), F.concat(
        F.lit("The zones near ZONE R-"), F.col("p_size"), F.lit("; zoning district: c-"), F.col("p_size") % 7,
        F.lit(" and lot AB-"), F.col("p_partkey") % 90).alias("txt"))
    return spoken.select("id", F.explode(r.zone_mentions(F.col("txt"))).alias("zone"))


@query("repair_json", """
    SELECT p_partkey AS id, '{"name": "' || p_name || '","sizes": [' || CAST(p_size AS VARCHAR) || '],"brand": "'
           || p_brand || '"}' AS repaired FROM part""")
def repair_json(t):
    broken = F.concat(F.lit('Result: {"name": "'), F.col("p_name"), F.lit('",\n"sizes": ['), F.col("p_size"),
                      F.lit(',\t],\x07"brand": "'), F.col("p_brand"), F.lit('",\n} end'))
    return t.part.select(F.col("p_partkey").alias("id"), r.repair_json(broken).alias("repaired"))


# --- the bulk call --------------------------------------------------------------------

_BULK_CASTS = ", ".join(
    f"{expr} AS {f}" for f, expr in
    [(f, {"interior_min_lot_area_sqft": "CASE WHEN k % 5 = 3 THEN s * 100 END",
          "corner_min_lot_area_sqft": "CASE WHEN k % 5 = 0 THEN s * 1000 END"}.get(f, "NULL"))
     for f in fv.BULK_INTEGER_FIELDS] +
    [(f, {"principal_front_yard_ft": "s / 2.0", "max_far": "CASE WHEN k % 17 <> 0 AND k % 2 = 0 THEN 1.25 END"}
      .get(f, "NULL")) for f in fv.BULK_NUMERIC_FIELDS])
BULK_CHECK = f"""
    bv AS ({_ansi(src.BULK_VALUES)}),
    taken AS (SELECT *, count(*) OVER (PARTITION BY response_id) AS zones FROM bv
              WHERE response_id % 11 <> 0 AND response_id % 13 <> 5 AND response_id % 17 <> 6),
    b AS (SELECT response_id, pos AS position, 'Town_' || CAST(response_id % 50 AS VARCHAR) AS town, NULL AS county,
                 CASE WHEN k % 19 <> 0 THEN zone_name END AS zone_name, {_BULK_CASTS},
                 k % 5 IN (1, 2) OR k % 17 = 0 OR k % 19 = 0 AS is_error FROM taken
          UNION ALL BY NAME
          SELECT DISTINCT response_id, zones + odd AS position, 'Town_' || CAST(response_id % 50 AS VARCHAR) AS town,
                 TRUE AS is_error FROM taken, (VALUES (0), (1), (2)) o(odd) WHERE response_id % 7 = 2)"""


@query("bulk_parse", f"WITH {BULK_CHECK} SELECT * FROM b", types=BULK_TYPES)
def bulk_parse(t):
    return r.bulk_rows(src.bulk_calls(t.spark, t.folder))


@query("bulk_upsert", f"""WITH {BULK_CHECK}, q AS (SELECT *, row_number() OVER (PARTITION BY town, zone_name
    ORDER BY response_id DESC, position DESC) AS rn FROM b WHERE NOT is_error) SELECT * EXCLUDE (rn) FROM q WHERE rn = 1""", types=BULK_TYPES)
def bulk_upsert(t):
    good = r.bulk_rows(src.bulk_calls(t.spark, t.folder)).where(~F.col("is_error"))
    return maintenance.latest_per_key(good, ["town", "zone_name"], ["response_id", "position"])


OUTCOME = """CASE WHEN response_id % 17 = 6 THEN 'not a JSON value' WHEN response_id % 11 = 0 THEN 'no town'
                   WHEN response_id % 13 = 5 THEN 'zoning_requirements is no list' END"""


@query("upsert_report", f"""WITH {BULK_CHECK},
    c AS (SELECT response_id, count(*) FILTER (WHERE NOT is_error) AS good, count(*) FILTER (WHERE is_error) AS bad
          FROM b GROUP BY 1),
    a AS (SELECT DISTINCT response_id, {OUTCOME} AS failure FROM bv)
    SELECT a.response_id, failure IS NULL AS success,
           CASE WHEN failure = 'no town' THEN 'Missing required field: extracted_town'
                WHEN failure IS NOT NULL THEN 'Error processing JSON: ' || failure
                ELSE 'Successfully processed ' || good || ' zones, ' || bad || ' errors' END AS message,
           coalesce(good, 0) AS inserted_count, coalesce(bad, 0) AS error_count,
           CASE WHEN failure IS NULL THEN 'Town_' || CAST(a.response_id % 50 AS VARCHAR) END AS town, NULL AS county
    FROM a LEFT JOIN c ON a.response_id = c.response_id""",
       types={"county": "VARCHAR"})
def upsert_report(t):
    return r.bulk_report(src.bulk_calls(t.spark, t.folder))


@query("bulk_documents", f"""WITH {BULK_CHECK}, a AS (SELECT DISTINCT response_id, {OUTCOME} AS failure FROM bv)
    SELECT response_id + 1000 AS document_id, CASE WHEN failure IS NULL THEN 'completed' ELSE 'failed' END AS processing_status,
           failure AS error_message FROM a WHERE coalesce(failure, '') <> 'no town' AND response_id % 3 <> 0""")
def bulk_documents(t):
    calls = src.bulk_calls(t.spark, t.folder)
    return r.bulk_document_status(calls.withColumn("document_id", F.when(
        F.col("response_id") % 3 != 0, F.col("response_id") + 1000)))


# --- scoring ---------------------------------------------------------------------------

def sql_score(p: str, a: str) -> str:
    return (f"CASE WHEN {p} IS NULL AND {a} IS NULL THEN 1.0 WHEN {p} IS NULL OR {a} IS NULL THEN 0.0 "
            f"WHEN {a} = 0 THEN CASE WHEN {p} = 0 THEN 1.0 ELSE 0.0 END "
            f"WHEN abs(({p} - {a}) / {a}) * 100 <= 5 THEN 1.0 ELSE greatest(0.0, 1 - abs(({p} - {a}) / {a})) END")


SCORE_CHECK = f"""
    truth AS ({_ansi(src.TRUTH_SQL)}),
    pred AS ({_ansi(src.PREDICTED_SQL)}),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY test_id, upper(zone) ORDER BY k) AS rn FROM pred
               WHERE test_id % 9 <> 4),
    m AS (SELECT p.test_id, p.ground_truth_doc_id, p.k, p.s, p.zone AS predicted_zone, p.lot, p.front, t.*
              EXCLUDE (ground_truth_doc_id)
          FROM firsts p JOIN truth t ON p.ground_truth_doc_id = t.ground_truth_doc_id AND upper(p.zone) = upper(t.zone)
          WHERE rn = 1),
    cells AS (
      SELECT test_id, zone, {sql_score('CAST(lot AS DOUBLE)', 'interior_min_lot_area_sqft')} AS score FROM m WHERE k % 4 <> 1
      UNION ALL SELECT test_id, zone, {sql_score('CAST(front AS DOUBLE)', 'principal_front_yard_ft')} FROM m WHERE k % 2 = 0
      UNION ALL SELECT test_id, zone, {sql_score('CAST(s + 2 AS DOUBLE)', 'principal_front_yard_ft')} FROM m WHERE k % 3 = 0
      UNION ALL SELECT test_id, zone, {sql_score('CASE WHEN k % 5 <> 0 THEN s / 2.0 END', 'principal_side_yard_ft')} FROM m
      UNION ALL SELECT test_id, zone, {sql_score('30.0', 'max_height_feet_total')} FROM m WHERE k % 7 <> 0
      UNION ALL SELECT test_id, zone, 0.0 FROM m WHERE k % 4 = 2
      UNION ALL SELECT test_id, zone, {sql_score('1.5', 'maximum_far')} FROM m WHERE k % 4 = 0),
    per_test AS (SELECT test_id, avg(score) AS f FROM cells GROUP BY 1),
    found AS (SELECT test_id, count(DISTINCT upper(zone)) AS z FROM m GROUP BY 1),
    expected AS (SELECT ground_truth_doc_id, count(DISTINCT upper(zone)) AS e FROM truth GROUP BY 1),
    all_tests AS (SELECT DISTINCT test_id, ground_truth_doc_id FROM pred),
    scored AS (SELECT a.test_id, a.ground_truth_doc_id, coalesce(z / e, 0.0) AS zone_accuracy,
                      coalesce(f, 0.0) AS field_accuracy, CASE WHEN e IS NULL THEN 0.0 ELSE 1.0 END AS location_accuracy
               FROM all_tests a LEFT JOIN expected USING (ground_truth_doc_id) LEFT JOIN found USING (test_id)
                    LEFT JOIN per_test USING (test_id))"""


def _tests_and_truth(t):
    return src.scored_responses(t.spark, t.folder), src.verified_zones(t.spark, t.folder)


@query("score_extractions", f"""WITH {SCORE_CHECK}
    SELECT test_id, ground_truth_doc_id, round(zone_accuracy, 9) AS zone_accuracy,
           round(field_accuracy, 9) AS field_accuracy, location_accuracy,
           round(0.4 * zone_accuracy + 0.6 * field_accuracy, 9) AS overall_accuracy FROM scored""",
       types={"location_accuracy": "DOUBLE"})
def score_extractions(t):
    return rounded(scoring.score_extractions(*_tests_and_truth(t)))


@query("score_zone_results", f"""WITH {SCORE_CHECK},
    wanted AS (SELECT a.test_id, t.id, t.zone AS actual_zone, upper(t.zone) AS zk,
                      t.* EXCLUDE (id, zone, ground_truth_doc_id)
               FROM all_tests a JOIN truth t USING (ground_truth_doc_id)),
    p AS (SELECT test_id, upper(zone) AS zk, zone AS predicted_zone,
             CASE WHEN k % 4 <> 1 THEN CAST(lot AS DOUBLE) END AS lot,
             CASE WHEN k % 2 = 0 THEN CAST(front AS DOUBLE) WHEN k % 3 = 0 THEN CAST(s + 2 AS DOUBLE) END AS front,
             CASE WHEN k % 5 <> 0 THEN s / 2.0 END AS side, CASE WHEN k % 7 <> 0 THEN 30.0 END AS height,
             CASE WHEN k % 4 = 0 THEN 1.5 END AS far FROM firsts WHERE rn = 1)
    SELECT w.test_id, w.id AS ground_truth_req_id, actual_zone, predicted_zone,
           predicted_zone IS NULL AS is_missed,
           lot AS predicted_interior_min_lot_area_sqft, front AS predicted_principal_front_yard_ft,
           side AS predicted_principal_side_yard_ft, height AS predicted_max_height_feet_total,
           far AS predicted_maximum_far,
           round(CASE WHEN predicted_zone IS NULL THEN 0.0 ELSE
             ({sql_score('lot', 'interior_min_lot_area_sqft')} + {sql_score('front', 'principal_front_yard_ft')}
              + {sql_score('side', 'principal_side_yard_ft')} + {sql_score('height', 'max_height_feet_total')}
              + {sql_score('far', 'maximum_far')}) / 5 END, 9) AS zone_accuracy_score
    FROM wanted w LEFT JOIN p ON w.test_id = p.test_id AND w.zk = p.zk""",
       types={"predicted_max_height_feet_total": "DOUBLE", "predicted_maximum_far": "DOUBLE"})
def score_zone_results(t):
    rows = scoring.zone_results(*_tests_and_truth(t))
    return rounded(rows.withColumn("is_missed", F.col("predicted_zone").isNull()))


STRICT_FIELDS = {"interior_min_lot_area_sqft": "interior_min_lot_area_sqft",
                 "principal_min_front_yard_ft": "principal_front_yard_ft",
                 "principal_min_side_yard_ft": "principal_side_yard_ft",
                 "principal_max_height_feet": "max_height_feet_total", "maximum_far": "maximum_far"}


def sql_hit(p: str, a: str) -> str:
    return (f"CASE WHEN {p} IS NULL AND {a} IS NULL THEN 1 WHEN {p} IS NULL OR {a} IS NULL THEN 0 "
            f"WHEN abs({p} - {a}) / {a} <= 0.05 THEN 1 ELSE 0 END")


@query("strict_accuracy", f"""WITH {SCORE_CHECK},
    h AS (SELECT test_id, {sql_hit('CASE WHEN k % 4 <> 1 THEN lot END', 'interior_min_lot_area_sqft')}
             + {sql_hit('CASE WHEN k % 2 = 0 THEN front END', 'principal_front_yard_ft')}
             + {sql_hit('CASE WHEN k % 5 <> 0 THEN s / 2.0 END', 'principal_side_yard_ft')}
             + {sql_hit('CASE WHEN k % 7 <> 0 THEN 30.0 END', 'max_height_feet_total')}
             + {sql_hit('CASE WHEN k % 4 = 0 THEN 1.5 END', 'maximum_far')} AS hits
          FROM m WHERE predicted_zone = zone),
    g AS (SELECT test_id, sum(hits) / (count(*) * 5) AS a FROM h GROUP BY 1)
    SELECT test_id, ground_truth_doc_id, round(coalesce(a, 0), 9) AS accuracy
    FROM all_tests LEFT JOIN g USING (test_id)""")
def strict_accuracy(t):
    tests, truth = _tests_and_truth(t)
    return rounded(scoring.strict_accuracy(tests, truth, STRICT_FIELDS))


@query("completeness", f"""WITH {SCORE_CHECK}
    SELECT test_id, round(coalesce(sum(CASE WHEN test_id % 9 <> 4 THEN 1 + (k % 4 <> 1)::INT + (k % 2 = 0)::INT
        + (k % 5 <> 0)::INT + (k % 7 <> 0)::INT + (k % 4 = 0)::INT END) / (10.0 * count(*)), 0), 9) AS completeness
    FROM pred GROUP BY 1""")
def completeness(t):
    return rounded(scoring.completeness(_tests_and_truth(t)[0]))


@query("response_profile", f"""WITH {SCORE_CHECK},
    z AS (SELECT test_id, row_number() OVER (PARTITION BY test_id ORDER BY k) - 1 AS position,
             count(*) OVER (PARTITION BY test_id) AS zone_count, zone AS zone_name,
             1 + (k % 4 <> 1)::INT + (k % 2 = 0)::INT + (k % 3 = 0)::INT + (k % 5 <> 0)::INT + (k % 7 <> 0)::INT
             + (k % 4 IN (0, 2))::INT AS given_fields FROM pred WHERE test_id % 9 <> 4)
    SELECT test_id, TRUE AS has_town, test_id % 3 <> 0 AS has_county, zone_count, position, zone_name, given_fields FROM z
    UNION ALL SELECT DISTINCT test_id, FALSE, FALSE, 0, NULL, NULL, NULL FROM pred WHERE test_id % 9 = 4""",
       types={"zone_count": "INTEGER", "position": "INTEGER", "given_fields": "INTEGER"})
def response_profile(t):
    return scoring.response_profile(_tests_and_truth(t)[0])


@query("field_accuracy", f"""
    SELECT z.prompt_experiment_id, z.ground_truth_req_id, z.test_date,
        round({sql_score('predicted_interior_min_lot_area_sqft', 'interior_min_lot_area_sqft')}, 9) AS lot_area_score,
        round({sql_score('predicted_principal_front_yard_ft', 'principal_front_yard_ft')}, 9) AS front_yard_score,
        round({sql_score('predicted_principal_side_yard_ft', 'principal_side_yard_ft')}, 9) AS side_yard_score,
        round({sql_score('predicted_maximum_far', 'maximum_far')}, 9) AS far_score
    FROM zone_results z JOIN gt_requirements g ON z.ground_truth_req_id = g.id""", ("zone_results", "gt_requirements"))
def field_accuracy(t):
    truth = t.gt_requirements.withColumnRenamed("id", "ground_truth_req_id")
    rows = t.zone_results.join(truth, "ground_truth_req_id")
    scored = {"lot_area_score": "interior_min_lot_area_sqft", "front_yard_score": "principal_front_yard_ft",
              "side_yard_score": "principal_side_yard_ft", "far_score": "maximum_far"}
    return rounded(rows.select("prompt_experiment_id", "ground_truth_req_id", "test_date", *[
        scores.field_accuracy(F.col(f"predicted_{f}"), F.col(f)).alias(n) for n, f in scored.items()]))


@query("prompt_ranking", f"""
    WITH a AS (SELECT prompt_experiment_id AS id, round(avg(overall_accuracy_score)
                      FILTER (WHERE extraction_success), 9) AS accuracy, sum(llm_tokens_used) AS tokens,
                      sum(parsed_zones_count) AS zones_found FROM tests GROUP BY 1)
    SELECT rank() OVER (ORDER BY accuracy DESC) AS rank, prompt_name, prompt_version, round(accuracy, 9) AS accuracy,
           {sql_percent('accuracy')} AS accuracy_text, CAST(tokens AS BIGINT) AS tokens,
           CAST(zones_found AS BIGINT) AS zones_found
    FROM a JOIN experiments e ON a.id = e.id WHERE accuracy IS NOT NULL""", ("tests", "experiments"))
def prompt_ranking(t):
    return rounded(scoring.prompt_ranking(t.tests, t.experiments))


# --- prompts and rules ---------------------------------------------------------------------

@query("build_prompts", """
    WITH p AS (SELECT DISTINCT prompt_experiment_id, ground_truth_doc_id FROM tests),
    q AS (SELECT prompt_experiment_id, ground_truth_doc_id, CASE WHEN g.id IS NULL THEN 'no place' WHEN text IS NULL THEN 'no text'
            ELSE 'ready' END AS status,
            'Experiment ' || CAST(prompt_experiment_id AS VARCHAR) || ': answer {"zones": []} for ' || town || ', '
            || county || ', ' || state || '.' || chr(10) || text || chr(10) || 'End of ' || town AS prompt
          FROM p LEFT JOIN gt_documents g ON p.ground_truth_doc_id = g.id
               LEFT JOIN documents d ON p.ground_truth_doc_id = d.doc_id)
    SELECT prompt_experiment_id, ground_truth_doc_id, status, length(prompt) AS prompt_chars, md5(prompt) AS prompt_md5
    FROM q""", ("tests", "gt_documents"), {"prompt_chars": "INTEGER"})
def build_prompts(t):
    template = F.concat(F.lit("Experiment "), F.col("id"), F.lit(
        ': answer {{"zones": []}} for {municipality}, {county}, {state}.\n{text_content}\nEnd of {municipality}'))
    rows = prompts.build_prompts(t.tests, t.experiments.withColumn("prompt_text", template), t.documents,
                                 t.gt_documents)
    return rows.select("prompt_experiment_id", "ground_truth_doc_id", "status", F.length("prompt").alias("prompt_chars"),
                       F.md5("prompt").alias("prompt_md5"))


ACCESSORY = ["accessory_min_front_yard_ft", "accessory_min_side_yard_ft", "accessory_min_rear_yard_ft"]


FRONTAGE = "CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END"
WIDTH = f"coalesce(CASE WHEN p_size % 5 = 1 THEN p_size + 5.0 END, {FRONTAGE})"
IN_DOC = "CAST(FLOOR(p_partkey / 8) AS BIGINT)"


@query("rule_extract", f"""
    WITH s AS (
    SELECT {IN_DOC} AS doc_id, p_partkey % 8 + 1 AS position, {src.ZONE_NAMES} AS zone_name,
           p_size * 1000.0 AS interior_min_lot_area_sqft, {FRONTAGE} AS interior_min_lot_frontage_ft,
           {WIDTH} AS interior_min_lot_width_ft, coalesce(CASE WHEN p_size % 5 = 2 THEN p_size + 7.0 END, {WIDTH}) AS interior_min_lot_depth_ft,
           p_size + 5.0 AS principal_min_front_yard_ft,
           CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS principal_min_side_yard_ft,
           CASE WHEN p_partkey % 6 IN (0, 1, 2, 4) THEN p_size + 7.0 END AS principal_min_rear_yard_ft, 30.0 AS principal_max_height_feet,
           CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size AS DOUBLE) END AS max_building_coverage_percent,
           CAST(p_size AS DOUBLE) AS max_lot_coverage_percent, 1.5 AS maximum_far,
           CASE WHEN p_partkey % 6 IN (1, 2) THEN CAST(p_size AS DOUBLE) END AS maximum_density_units_per_acre,
           2.5 AS principal_max_height_stories, CASE WHEN p_partkey % 6 = 0 THEN p_size + 5.0 END AS accessory_min_front_yard_ft,
           CASE WHEN p_partkey % 6 = 0 THEN 4.0 END AS accessory_min_side_yard_ft,
           CASE WHEN p_partkey % 2 = 1 THEN CAST(p_size AS DOUBLE) END AS accessory_min_rear_yard_ft FROM part
    UNION ALL BY NAME
    SELECT doc_id, n + 2 AS position, 'T-1' AS zone_name, 9100.0 + doc_id % 21 AS interior_min_lot_area_sqft, 80.0 AS interior_min_lot_width_ft,
           80.0 AS interior_min_lot_depth_ft, 25.0 AS principal_min_front_yard_ft, 3.0 AS accessory_min_rear_yard_ft, 35.0 AS principal_max_height_feet,
           2.5 AS principal_max_height_stories, 40.0 AS max_lot_coverage_percent, 0.5 AS maximum_far
    FROM (SELECT {IN_DOC} AS doc_id, count(*) AS n FROM part GROUP BY 1) WHERE doc_id % 5 = 0
    UNION ALL BY NAME
    SELECT doc_id, n + 3 AS position, 'Mill Village' AS zone_name, 12000.0 AS interior_min_lot_area_sqft, doc_id % 9 AS principal_min_front_yard_ft, 12.0 AS principal_min_side_yard_ft,
           38.0 AS principal_max_height_feet, 3.0 AS principal_max_height_stories, 35.0 AS max_lot_coverage_percent, 0.75 AS maximum_far
    FROM (SELECT {IN_DOC} AS doc_id, count(*) AS n FROM part GROUP BY 1) WHERE doc_id % 5 = 0)
    SELECT *, 'Springfield_' || CAST(doc_id AS VARCHAR) AS extracted_town, 'Union_' || CAST(doc_id % 21 AS VARCHAR) || ' County' AS extracted_county FROM s""",
       types={"position": "INTEGER", "principal_max_height_stories": "DOUBLE", **{k: "DOUBLE" for k in [*fv.PHRASES, *ACCESSORY]}})
def rule_extract(t):
    return ordinance.rule_extract(src.ordinance_texts(t.spark, t.folder))
