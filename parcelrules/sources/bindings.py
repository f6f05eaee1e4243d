"""The domain tables, derived from the tables at hand.

Each binding is one SELECT that Spark and any ANSI engine read alike, so a check
can derive the same rows on its own. ``bind`` returns a lazy DataFrame: nothing
is collected, and column pruning and filters still reach the Parquet scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BINDINGS = {
    "experiments": """
        SELECT s_suppkey AS id, 'prompt_' || CAST(s_suppkey % 20 AS VARCHAR(10)) AS prompt_name,
               CAST(CAST(FLOOR(s_suppkey / 20.0) AS BIGINT) AS VARCHAR(10)) AS prompt_version,
               'model_' || CAST(s_nationkey % 3 AS VARCHAR(10)) AS llm_model,
               s_suppkey % 20 = 0 AS is_baseline, s_acctbal >= 0 AS is_active,
               TIMESTAMP '2000-01-01 00:00:00' + s_suppkey * INTERVAL '1' HOUR AS created_at
        FROM {supplier}""",
    "gt_documents": """
        SELECT o_orderkey AS id, 'doc_' || CAST(o_orderkey AS VARCHAR(20)) AS document_name,
               'Town_' || CAST(o_custkey % 50 AS VARCHAR(10)) AS town,
               'County_' || CAST(o_custkey % 7 AS VARCHAR(10)) AS county, 'NJ' AS state,
               CASE o_orderstatus WHEN 'F' THEN 'simple' WHEN 'O' THEN 'medium' ELSE 'complex' END
                   AS document_complexity,
               o_orderdate AS verification_date
        FROM {orders}""",
    "tests": """
        SELECT l_suppkey AS prompt_experiment_id, l_orderkey AS ground_truth_doc_id, l_partkey AS part_id,
               l_linenumber AS test_epoch, l_shipdate AS test_date,
               CAST(1 - 5 * l_discount AS DOUBLE) AS overall_accuracy_score,
               CAST(1 - 10 * l_tax AS DOUBLE) AS zone_identification_accuracy,
               CAST(l_quantity / 50 AS DOUBLE) AS field_extraction_accuracy,
               CAST(1 AS DOUBLE) AS location_extraction_accuracy, l_linenumber AS parsed_zones_count,
               l_returnflag <> 'R' AS extraction_success,
               CAST(l_extendedprice / 1000 AS DOUBLE) AS processing_time_seconds,
               CAST(l_quantity AS INT) * 100 AS llm_tokens_used
        FROM {lineitem}""",
    "gt_requirements": """
        SELECT p_partkey AS id, p_partkey AS ground_truth_doc_id, p_brand AS zone,
               CAST(p_retailprice * 10 AS DOUBLE) AS interior_min_lot_area_sqft,
               CAST(p_size AS DOUBLE) AS principal_front_yard_ft,
               CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 2 END AS principal_side_yard_ft,
               CAST(25 + p_size % 4 * 5 AS DOUBLE) AS max_height_feet_total,
               CASE WHEN p_size % 3 = 0 THEN CAST(1.5 AS DOUBLE) ELSE NULL END AS maximum_far
        FROM {part}""",
    "zone_results": """
        SELECT l_suppkey AS prompt_experiment_id, l_partkey AS ground_truth_req_id, l_shipdate AS test_date,
               CASE WHEN l_linenumber % 4 = 0 THEN 'Brand#1' ELSE p_brand END AS predicted_zone,
               p_brand AS actual_zone,
               CAST(p_retailprice * 10 * (1 + l_discount) AS DOUBLE) AS predicted_interior_min_lot_area_sqft,
               CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END
                   AS predicted_principal_front_yard_ft,
               CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 3 END
                   AS predicted_principal_side_yard_ft,
               CAST(25 + p_size % 3 * 5 AS DOUBLE) AS predicted_max_height_feet_total,
               CASE WHEN p_size % 2 = 0 THEN CAST(1.25 AS DOUBLE) ELSE NULL END AS predicted_maximum_far,
               CAST(1 - 10 * l_tax AS DOUBLE) AS zone_accuracy_score
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "zdocuments": """
        SELECT doc_id AS id,
               source || '_' || CAST(n_chars % 40 AS VARCHAR(10))
                   || CASE WHEN doc_id % 11 = 0 THEN '.exe' ELSE '.txt' END AS original_filename,
               n_chars * CASE WHEN doc_id % 13 = 0 THEN 10000 ELSE 1 END AS file_size,
               CASE WHEN doc_id % 9 = 0 THEN NULL ELSE source END AS municipality, upper(lang) AS state,
               CASE doc_id % 4 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed'
                    ELSE 'failed' END AS processing_status,
               TIMESTAMP '2024-01-01 00:00:00' + (doc_id * 37 % 500) * INTERVAL '1' MINUTE AS created_at
        FROM {documents}""",
    "jobs": """
        SELECT o_orderkey AS id, 'Town_' || CAST(o_custkey % 50 AS VARCHAR(10)) AS town,
               'County_' || CAST(o_custkey % 7 AS VARCHAR(10)) AS county, 'NJ' AS state,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'failed'
                    WHEN o_orderstatus = 'O' THEN 'completed' ELSE 'processing' END AS processing_status,
               o_orderdate AS created_at
        FROM {orders}""",
    "requirements": """
        SELECT p_partkey AS id,
               CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN p_partkey + 100000000
                    ELSE p_partkey END AS job_id,
               'Town_' || CAST(p_partkey % 50 AS VARCHAR(10)) AS town,
               'County_' || CAST(p_partkey % 7 AS VARCHAR(10)) AS county, 'NJ' AS state, p_brand AS zone,
               CAST(p_retailprice * 10 AS DOUBLE) AS interior_min_lot_area_sqft,
               CAST(p_size AS DOUBLE) AS principal_front_yard_ft,
               CAST(p_size AS DOUBLE) * 2.5 AS max_lot_coverage_percent,
               CAST(p_size AS DOUBLE) / 50 AS extraction_confidence,
               TIMESTAMP '2024-01-01 00:00:00' + (p_partkey * 17 % 300) * INTERVAL '1' MINUTE AS created_at
        FROM {part}""",
    "requirement_changes": """
        SELECT p_partkey + 1000000 AS id, p_partkey AS job_id,
               'Town_' || CAST(p_partkey * 3 % 50 AS VARCHAR(10)) AS town,
               CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 'County_' || CAST(p_partkey % 7 AS VARCHAR(10)) END
                   AS county,
               'NJ' AS state, p_brand AS zone, CAST(p_retailprice * 20 AS DOUBLE) AS interior_min_lot_area_sqft,
               CAST(p_size AS DOUBLE) / 2 AS principal_front_yard_ft,
               CAST(p_size AS DOUBLE) AS max_lot_coverage_percent,
               CAST(p_size AS DOUBLE) / 60 AS extraction_confidence,
               TIMESTAMP '2024-02-01 00:00:00' + (p_partkey * 11 % 300) * INTERVAL '1' MINUTE AS created_at
        FROM {part}""",
    "seed_experiments": """
        SELECT c_custkey + 1000000 AS id, 'prompt_' || CAST(c_custkey % 30 AS VARCHAR(10)) AS prompt_name,
               CAST(c_nationkey AS VARCHAR(10)) AS prompt_version, 'model_s' AS llm_model, FALSE AS is_baseline,
               TRUE AS is_active, TIMESTAMP '2024-01-01 00:00:00' AS created_at
        FROM {customer}""",
    "raw_zone_values": """
        SELECT p_partkey AS id,
               CASE p_size % 7 WHEN 0 THEN 'R-1¹' WHEN 1 THEN 'R-2(2)' WHEN 2 THEN 'C-1^3' WHEN 3 THEN ' R-3³ '
                    WHEN 4 THEN 'I-2' WHEN 5 THEN 'R2' ELSE '(1)' END AS zone_name,
               CASE p_partkey % 6 WHEN 0 THEN CAST(p_size * 1000 AS VARCHAR(20))
                    WHEN 1 THEN CAST(p_size % 3 + 1 AS VARCHAR(10)) || CAST(p_size * 500 AS VARCHAR(20))
                    WHEN 2 THEN '5,000' WHEN 3 THEN CAST(p_size AS VARCHAR(10)) || '00¹'
                    WHEN 4 THEN CAST(p_size * 12345 AS VARCHAR(20)) || ' '
                    ELSE CAST(p_size AS VARCHAR(10)) || ',500(2)' END AS lot_area_text
        FROM {part}""",
    "status_events": """
        SELECT event_id, user_id AS document_id, ts AS event_at,
               CASE event_type WHEN 'view' THEN 'start' WHEN 'signup' THEN 'start' ELSE 'update' END AS action,
               CASE event_type WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed'
                    WHEN 'error' THEN 'failed' ELSE NULL END AS status,
               CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'r' || CAST(event_id AS VARCHAR(20))
                    ELSE NULL END AS response_text,
               CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'e' || CAST(event_id AS VARCHAR(20))
                    ELSE NULL END AS error_message
        FROM {events}""",
    "job_events": """
        SELECT event_id, user_id AS job_id, ts AS event_at,
               CASE event_type WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'processing' WHEN 'click' THEN 'processing'
                    WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
               CASE WHEN event_id % 4 = 0 THEN 'model_' || CAST(event_id % 9 AS VARCHAR(10)) ELSE NULL END
                   AS ai_model_used
        FROM {events}""",
    "attempts": """
        SELECT 'file_' || CAST(l_orderkey AS VARCHAR(20)) AS path, l_linenumber AS attempt_no,
               l_returnflag = 'A' AND l_linenumber % 2 = 0 AS ok
        FROM {lineitem}""",
}

# Declared, so that opening a table starts no job to look into its files.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}

_TABLE = re.compile(r"\{(\w+)\}")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    reader = spark.read.schema(TABLE_SCHEMAS[table]) if table in TABLE_SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def bind_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {name: load(spark, sf_dir, name) for name in sorted(set(_TABLE.findall(sql)))}
    return spark.sql(sql, **tables)


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The domain table ``name`` over the Parquet tables in ``sf_dir``."""
    return bind_sql(spark, sf_dir, BINDINGS[name])


def ansi(name: str) -> str:
    """The binding with plain table names."""
    return _TABLE.sub(lambda m: m.group(1), BINDINGS[name])
