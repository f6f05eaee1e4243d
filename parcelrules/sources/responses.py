"""Extraction responses made by Spark from the ``part`` table.

Each response describes eight parts. The shapes vary by response: plain JSON
under different keys, JSON inside prose, broken JSON, wrapped JSON, a list at
the top and plain text; zones differ in keys, nesting and value types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelrules.sources.bindings import bind_sql

ZONES_PER_RESPONSE = 8

# The zone values in relational form; a check can derive rows from these.
ZONE_VALUES = """
    SELECT CAST(FLOOR(p_partkey / 8) AS BIGINT) AS response_id, CAST(p_partkey % 8 AS INT) AS pos,
           p_partkey AS k, p_size AS s, CAST(p_retailprice * 10 AS BIGINT) AS price10,
           CASE p_size % 5 WHEN 0 THEN 'R-' || CAST(p_size % 7 AS VARCHAR(10)) || '¹'
                WHEN 1 THEN 'r-' || CAST(p_size % 7 AS VARCHAR(10)) || '(2)'
                WHEN 2 THEN 'C-' || CAST(p_size % 7 AS VARCHAR(10)) || '^3'
                WHEN 3 THEN ' R-' || CAST(p_size % 7 AS VARCHAR(10)) || '³ '
                ELSE 'I-' || CAST(p_size % 7 AS VARCHAR(10)) END AS zone_text,
           CASE p_partkey % 6 WHEN 0 THEN CAST(p_size * 1000 AS VARCHAR(20))
                WHEN 1 THEN CAST(p_size % 3 + 1 AS VARCHAR(10)) || CAST(p_size * 500 AS VARCHAR(20))
                WHEN 2 THEN '5,000' WHEN 3 THEN CAST(p_size AS VARCHAR(10)) || '00¹'
                ELSE NULL END AS area_text
    FROM {part}"""

_ZONE_JSON = """
    to_json(named_struct(
      'zone_name', CASE WHEN k % 5 <> 4 THEN zone_text END,
      'district', CASE WHEN k % 5 = 4 THEN zone_text END,
      'lot_area', CASE WHEN k % 2 = 0 THEN area_text END,
      'min_lot_area_sqft', CASE WHEN k % 2 = 1 THEN coalesce(area_text, CAST(price10 AS STRING)) END,
      'interior_lots', CASE WHEN k % 6 = 4 THEN named_struct('area_sqft', price10) END,
      'frontage', CASE WHEN s % 3 = 0 THEN CAST(s AS STRING) || ' ' WHEN s % 3 = 1 THEN CAST(s AS STRING) || ' ft' END,
      'lot_width', CASE WHEN k % 4 = 0 THEN s + 10 END,
      'corner', CASE WHEN k % 7 = 0 THEN named_struct('min_lot_width_ft', s * 2) END,
      'principal_min_front_yard_ft', CASE WHEN k % 3 = 0 THEN s END,
      'principal_yards', CASE WHEN k % 3 = 1 THEN named_struct('front_yard_ft', s + 1, 'side_setback', CAST(s AS STRING)) END,
      'front_setback', CASE WHEN k % 3 = 2 THEN CAST(s AS STRING) || '²' END,
      'garage_rear_setback', CASE WHEN k % 10 = 3 THEN 5.5 END,
      'rear_setback', CASE WHEN k % 2 = 0 THEN CAST(s AS STRING) || '.5' END,
      'height_stories', CASE WHEN k % 2 = 0 THEN s / 10.0D END,
      'max_stories', CASE WHEN k % 2 = 1 THEN CAST(s / 10.0D AS STRING) END,
      'max_height_feet', 25 + s % 4 * 5,
      'lot_coverage', CASE WHEN k % 4 <> 3 THEN CAST(s AS STRING) || '(1)' END,
      'intensity', CASE WHEN s % 3 = 0 THEN named_struct('far', 1.5D) END,
      'density', CASE WHEN s % 3 = 1 THEN s / 4.0D END))"""

# The tables of one response: the zones joined to text in order (at most eight),
# then wrapped according to the response's number.
RESPONSES_SQL = f"""
    WITH z AS (SELECT response_id, pos, {_ZONE_JSON} AS zone_json FROM ({ZONE_VALUES})),
    g AS (SELECT response_id, array_join(transform(sort_array(collect_list(struct(pos, zone_json))),
                 x -> x.zone_json), ',') AS zones FROM z GROUP BY response_id),
    h AS (SELECT response_id AS r, zones,
                 '"extracted_town":"Town_' || CAST(response_id % 40 AS STRING) || '","extracted_county":'
                 || CASE WHEN response_id % 6 = 0 THEN 'null' ELSE '"County_' || CAST(response_id % 5 AS STRING) || '"' END
                 || CASE WHEN response_id % 4 = 0 THEN ',"extraction_confidence":0.9' ELSE '' END AS head
          FROM g)
    SELECT r AS response_id, 'job' || lpad(CAST(r AS STRING), 9, '0') AS job_id,
           CASE WHEN r % 8 = 0 THEN ' Mytown ' WHEN r % 8 = 1 THEN 'unknown' END AS municipality,
           CASE WHEN r % 16 = 0 THEN 'Mycounty' END AS county, CAST(NULL AS STRING) AS state,
           'file ' || CAST(r AS STRING) || '.v1.pdf' AS filename,
           timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(r % 700 AS INT)) AS processed_at,
           CASE WHEN r % 12 = 5 THEN 'Zoning: zone R-' || CAST(r % 9 AS STRING) || ' and district C-' || CAST(r % 4 AS STRING) || '.'
                WHEN r % 10 = 3 THEN 'Here you are: {{{{' || head || ',"zoning_requirements":[' || zones || ',],}}}} Done.'
                WHEN r % 10 = 4 THEN to_json(named_struct('raw_response', '{{{{' || head || ',"zones":[' || zones || ']}}}}'))
                WHEN r % 14 = 6 THEN '[' || zones || ']'
                WHEN r % 10 = 7 THEN '{{{{' || head || ',"zones":[],"notes":["x"],"found":[{{{{"zone":"Z-9","far":2}}}},' || zones || ']}}}}'
                WHEN r % 10 = 8 THEN '{{{{"extraction_confidence":"0.25","districts":[' || zones || ']}}}}'
                ELSE '{{{{' || head || ',"zoning_requirements":[' || zones || ']}}}}' END AS response_text
    FROM h"""


# Uploaded documents with what the service said: some have no text, for some it failed.
UPLOADS_SQL = f"""
    SELECT response_id AS id, filename AS original_filename, municipality, county, state,
           CASE WHEN response_id % 9 <> 2 THEN 'Ordinance ' || CAST(response_id AS STRING) END AS text, response_text,
           CASE WHEN response_id % 9 = 5 THEN 'Request timed out' END AS error,
           processed_at - make_dt_interval(0, 0, 1) AS created_at, processed_at FROM ({RESPONSES_SQL})"""


def uploaded_documents(spark: SparkSession, folder: str) -> DataFrame:
    return bind_sql(spark, folder, UPLOADS_SQL)


def zone_values(spark: SparkSession, folder: str) -> DataFrame:
    return bind_sql(spark, folder, ZONE_VALUES)


def extraction_responses(spark: SparkSession, folder: str) -> DataFrame:
    return bind_sql(spark, folder, RESPONSES_SQL)


# Verified zones: up to eight per document, one per name; some have names that no run finds.
TRUTH_SQL = """
    SELECT min(p_partkey) AS id, CAST(FLOOR(p_partkey / 8) AS BIGINT) AS ground_truth_doc_id,
           CASE WHEN p_size % 10 = 9 THEN 'Y-' ELSE 'Z-' END || CAST(p_size % 10 AS VARCHAR(10)) AS zone,
           max(CAST(p_retailprice * 10 AS DOUBLE)) AS interior_min_lot_area_sqft,
           max(CAST(p_size AS DOUBLE)) AS principal_front_yard_ft,
           max(CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 2 END) AS principal_side_yard_ft,
           max(CAST(25 + p_size % 4 * 5 AS DOUBLE)) AS max_height_feet_total,
           max(CASE WHEN p_size % 3 = 0 THEN CAST(1.5 AS DOUBLE) ELSE NULL END) AS maximum_far
    FROM {part} GROUP BY 2, 3"""

# What two runs of an extractor said about the same documents; a zone in eight under a wrong name.
PREDICTED_SQL = """
    SELECT CAST(FLOOR(p_partkey / 8) AS BIGINT) * 2 + v AS test_id,
           CAST(FLOOR(p_partkey / 8) AS BIGINT) AS ground_truth_doc_id, p_partkey AS k, p_size AS s, v,
           CASE WHEN p_partkey % 8 = 7 THEN 'M-' WHEN v = 0 THEN 'Z-' ELSE 'z-' END || CAST(p_size % 10 AS VARCHAR(10)) AS zone,
           CAST(FLOOR(p_retailprice * 10 * (100 + p_partkey % 5 * 3 * (1 + v)) / 100) AS BIGINT) AS lot,
           CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE p_size + p_partkey % 3 END AS front
    FROM (SELECT *, 0 AS v FROM {part} UNION ALL SELECT *, 1 AS v FROM {part}) runs"""

SCORED_SQL = f"""
    WITH z AS (SELECT test_id, ground_truth_doc_id, k, '{{{{"zone_name":"' || zone || '"'
                || CASE WHEN k % 4 <> 1 THEN ',"interior_min_lot_area_sqft":' || CAST(lot AS STRING) ELSE '' END
                || CASE WHEN k % 2 = 0 THEN ',"principal_min_front_yard_ft":"' || CAST(front AS STRING) || '"' ELSE '' END
                || CASE WHEN k % 3 = 0 THEN ',"principal_front_yard_ft":' || CAST(s + 2 AS STRING) ELSE '' END
                || ',"principal_min_side_yard_ft":' || CASE WHEN k % 5 = 0 THEN 'null' ELSE CAST(s / 2.0D AS STRING) END
                || CASE WHEN k % 7 <> 0 THEN ',"principal_max_height_feet":30' ELSE '' END
                || CASE WHEN k % 4 = 2 THEN ',"max_far":"N/A"' WHEN k % 4 = 0 THEN ',"maximum_far":1.5' ELSE '' END
                || '}}}}' AS zone_json FROM ({PREDICTED_SQL})),
    g AS (SELECT test_id, ground_truth_doc_id, array_join(transform(sort_array(collect_list(struct(k, zone_json))),
                 x -> x.zone_json), ',') AS zones FROM z GROUP BY test_id, ground_truth_doc_id)
    SELECT test_id, ground_truth_doc_id,
           CASE WHEN test_id % 9 = 4 THEN 'no zones here'
                ELSE '{{{{"extracted_town":"T' || CAST(ground_truth_doc_id AS STRING) || '","extracted_county":'
                     || CASE WHEN test_id % 3 = 0 THEN 'null' ELSE '"C"' END || ',"zoning_requirements":[' || zones
                     || ']}}}}' END AS response_text FROM g"""

# Zones of the bulk call in relational form.
BULK_VALUES = """
    SELECT CAST(FLOOR(p_partkey / 8) AS BIGINT) AS response_id, CAST(p_partkey % 8 AS INT) AS pos, p_partkey AS k,
           p_size AS s, 'R-' || CAST(p_size % 6 AS VARCHAR(10)) AS zone_name,
           CASE p_partkey % 5 WHEN 0 THEN CAST(p_size * 1000 AS VARCHAR(20)) WHEN 1 THEN '8,000'
                WHEN 2 THEN CAST(p_size AS VARCHAR(20)) || '.5' WHEN 3 THEN ' ' || CAST(p_size * 100 AS VARCHAR(20)) || ' '
                ELSE NULL END AS lot
    FROM {part}"""

BULK_SQL = f"""
    WITH z AS (SELECT response_id, pos, to_json(named_struct(
                 'zone_name', CASE WHEN k % 19 <> 0 THEN zone_name END,
                 'interior_min_lot_area_sqft', CASE WHEN k % 5 IN (1, 3) THEN lot END,
                 'corner_min_lot_area_sqft', CASE WHEN k % 5 = 0 THEN s * 1000 END,
                 'buildable_lot_area_sqft', CASE WHEN k % 5 = 2 THEN s + 0.5D END,
                 'principal_front_yard_ft', s / 2.0D,
                 'max_far', CASE WHEN k % 17 = 0 THEN 'n/a' WHEN k % 2 = 0 THEN '1.25' END)) AS zone_json
               FROM ({BULK_VALUES})),
    g AS (SELECT response_id, array_join(transform(sort_array(collect_list(struct(pos, zone_json))),
                 x -> x.zone_json), ',') AS zones FROM z GROUP BY response_id)
    SELECT response_id, CASE WHEN response_id % 11 = 0 THEN '{{{{' ELSE '{{{{"extracted_town":"Town_'
           || CAST(response_id % 50 AS STRING) || '",' END || '"extracted_county":null,"zoning_requirements":'
           || CASE WHEN response_id % 13 = 5 THEN '{{{{"zone_name":"R-1"}}}}'
                   WHEN response_id % 7 = 2 THEN '[' || zones || ',"x",null,[1]]' ELSE '[' || zones || ']' END
           || CASE WHEN response_id % 17 = 6 THEN '' ELSE '}}}}' END AS response_text FROM g"""

# Ordinance texts: a heading per zone, then its rules in one of six wordings; every fifth text ends with a table.
ZONE_NAMES = """CASE p_partkey % 6 WHEN 1 THEN 'C-' WHEN 2 THEN 'r-' WHEN 3 THEN 'PLANNED' WHEN 4 THEN 'Highway Commercial' WHEN 5 THEN 'M-' ELSE 'R-' END
    || CASE WHEN p_partkey % 6 IN (3, 4) THEN '' ELSE CAST(p_size AS VARCHAR(10)) END || CASE WHEN p_partkey % 6 = 5 THEN '-A' ELSE '' END"""

ORDINANCE_SQL = f"""
    WITH v AS (SELECT CAST(FLOOR(p_partkey / 8) AS BIGINT) AS doc_id, p_partkey AS k, p_partkey % 6 AS w, p_size AS n,
                 CAST(p_size AS STRING) AS s, format_number(p_size * 1000, 0) AS area, CAST(p_size + 5 AS STRING) AS front,
                 CAST(p_size + 7 AS STRING) AS rear, {ZONE_NAMES} AS zone
               FROM {{part}}),
    z AS (SELECT doc_id, k, CASE WHEN w % 2 = 0 THEN 'Zone ' ELSE 'DISTRICT ' END || zone
                 || CASE w WHEN 2 THEN '¹: ' WHEN 3 THEN '^2: ' WHEN 4 THEN ': ' ELSE ' requirements:' || chr(10) END
                 || CASE w WHEN 0 THEN '- Minimum lot area: ' || area || ' square feet' WHEN 1 THEN 'Required area ' || CAST(n * 1000 AS STRING) || ' sq ft'
                           WHEN 2 THEN area || ' sq ft, and no less' WHEN 3 THEN 'minimum area, as in section 12, ' || area || ' sf'
                           WHEN 4 THEN 'lot size ' || area ELSE area || ' sf minimum lot' END || chr(10)
                 || CASE WHEN n % 2 = 0 THEN '- Minimum lot frontage: ' || s || ' feet' || chr(10) ELSE '' END
                 || CASE WHEN n % 5 = 1 THEN 'Lot width, at the building line, ' || front || ' ft' || chr(10) ELSE '' END
                 || CASE WHEN n % 5 = 2 THEN 'lot depth ' || rear || ' feet' || chr(10) ELSE '' END
                 || CASE w WHEN 3 THEN 'Front yard, ' || front || ' feet; side yards (both), ' || CASE WHEN n % 3 = 0 THEN 'none' ELSE s || ' feet' END
                           WHEN 4 THEN 'setbacks: front ' || front || ' feet, side ' || CASE WHEN n % 3 = 0 THEN 'N/A' ELSE s || ' feet' END || ', rear ' || rear || ' feet'
                           WHEN 5 THEN 'The front setback required of every principal structure in the district shall be ' || front || ' ft; side setback '
                                || CASE WHEN n % 3 = 0 THEN 'N/A' ELSE s || ' ft' END
                           ELSE '- Front yard setback: ' || front || ' feet, side yard ' || CASE WHEN n % 3 = 0 THEN 'N/A' ELSE s || ' ft' END END || chr(10)
                 || CASE WHEN w < 3 THEN 'minimum rear yard, for corner lots, ' || rear || ' feet' || chr(10) ELSE '' END
                 || CASE w WHEN 1 THEN 'Maximum height 2 1/2 stories or 30 feet' WHEN 3 THEN 'Height limit two and one-half stories, height 30 ft'
                           WHEN 5 THEN 'H=30; 2.5 stories' ELSE '- Maximum height: 30 feet (2½ stories)' END || chr(10)
                 || CASE WHEN w % 2 = 1 THEN 'Accessory buildings: rear setback ' || s || ' feet, height 15 feet.' || chr(10)
                         WHEN w = 0 THEN 'Garage setback ' || front || ' feet, side 4 feet; ' ELSE '' END
                 || CASE WHEN w < 3 THEN '- Maximum lot coverage: ' || s || '%; FAR shall not exceed 1.5'
                         ELSE 'site coverage of no more than ' || s || '%, FAR=1.5' END || chr(10)
                 || CASE w WHEN 0 THEN 'Building coverage: ' || s || ' percent' WHEN 1 THEN s || ' dwelling units per acre' WHEN 2 THEN 'density ' || s ELSE '' END || chr(10)
                 AS body FROM v),
    g AS (SELECT doc_id, array_join(transform(sort_array(collect_list(struct(k, body))), x -> x.body), '') AS bodies
          FROM z GROUP BY doc_id)
    SELECT doc_id, 'Town of Springfield_' || CAST(doc_id AS STRING) || ' Zoning Ordinance' || chr(10)
           || 'County: Union_' || CAST(doc_id % 21 AS STRING) || ' County' || chr(10) || bodies
           || CASE WHEN doc_id % 5 <> 0 THEN '' ELSE 'Schedule of dimensions' || chr(10)
                   || 'District | Minimum lot area (sq ft) | Width | Front | Side yard | Garage rear | Height (ft) | Stories | Lot coverage | FAR' || chr(10)
                   || '---|---|---|---|---|---|---|---|---|---' || chr(10)
                   || 'T-1¹ | 9,' || CAST(doc_id % 21 + 100 AS STRING) || ' | 80 | 25 | - | 3 | 35 | 2½ | 40% | 0.5' || chr(10)
                   || 'Mill Village | 12,000 sf | N/A | ' || CAST(doc_id % 9 AS STRING) || ' | 12 | none | 38 | 3 | 35 | .75' || chr(10) END AS text FROM g"""


def verified_zones(spark: SparkSession, folder: str) -> DataFrame:
    return bind_sql(spark, folder, TRUTH_SQL)


def scored_responses(spark: SparkSession, folder: str) -> DataFrame:
    return bind_sql(spark, folder, SCORED_SQL)


def bulk_calls(spark: SparkSession, folder: str) -> DataFrame:
    return bind_sql(spark, folder, BULK_SQL)


def ordinance_texts(spark: SparkSession, folder: str) -> DataFrame:
    return bind_sql(spark, folder, ORDINANCE_SQL)
