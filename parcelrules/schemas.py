"""Table schemas, declared so that no reader has to infer them. The columns are given ones."""

from __future__ import annotations

from pyspark.sql import types as T

from parcelrules import fixed_values as fv

STRING, LONG, INT, DOUBLE, TIME = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()


def table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


RULES = {f: INT if f in fv.INTEGER_FIELDS else DOUBLE for f in fv.RULE_FIELDS}

JOBS = table(
    id=STRING, town=STRING, county=STRING, state=STRING,
    pdf_filename=STRING, original_pdf_filename=STRING, pdf_file_path=STRING, pdf_file_size=LONG,
    processing_status=STRING, processing_started_at=TIME, processing_completed_at=TIME, ai_model_used=STRING,
    created_at=TIME, updated_at=TIME)

REQUIREMENTS = table(
    id=STRING, job_id=STRING, town=STRING, county=STRING, state=STRING, zone=STRING, **RULES, data_source=STRING,
    extraction_confidence=DOUBLE, extracted_at=TIME, created_at=TIME, updated_at=TIME)

# One extraction response per row, as the normaliser takes it.
RESPONSES = table(
    response_id=LONG, job_id=STRING, municipality=STRING, county=STRING,
    state=STRING, filename=STRING, processed_at=TIME, response_text=STRING)
