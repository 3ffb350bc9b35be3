"""DDL of the tables; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

REGION = "struct<kind:string,x0:double,y0:double,x1:double,y1:double,text:string,confidence:double,reading_order:int>"
PAGES_LOG = (
    "book_id string, page int, seq bigint, run_id string, text string, confidence double, tier string, status string, engine_used string, processing_pass int, page_width int, page_height int, "
    f"regions array<{REGION}>, warnings array<string>, engine_versions map<string,string>, processed_at timestamp, duration_s double"
)
CANDIDATES = (
    "book_id string, page int, processing_pass int, engine_name string, engine_version string, model_revision string, output_format string, native_confidence double, runtime_s double, text string, "
    f"regions array<{REGION}>, score double, tier string, signals map<string,double>, warnings array<string>, evidence map<string,double>, raw string"
)
BLOCK = "struct<kind:string,x0:double,y0:double,x1:double,y1:double,reading_order:int>"
LAYOUTS = f"book_id string, page int, provider string, warnings array<string>, regions array<{REGION}>"
DECISIONS = "book_id string, page int, action string, status string, selected_engine string, processing_pass int, reasons array<string>, candidates array<string>"
ATTEMPTS = "attempt_id bigint, book_id string, page int, processing_pass int, engine_used string, status string, started_at timestamp, completed_at timestamp, error string, artifact string"
BOOKS = "book_id string, seq bigint, source_path string, page_count int, source_fingerprint string, source_sha256 string, pipeline_version string, config_hash string, status string, completed_at timestamp"
EVENTS = "book_id string, ts timestamp, event string, page int, payload string"
PROFILES = "book_id string, page int, source_sha256 string, original_path string, processed_path string, width int, height int, dpi int, preprocessing_applied boolean, analysis string"
MANIFESTS = "schema_version int, book_id string, title string, source_path string, source_sha256 string, page_count int, pipeline_version string, config_hash string, engine_versions map<string,string>, finalized_at timestamp"
TABLES = {"pages_log": PAGES_LOG, "candidates": CANDIDATES, "layouts": LAYOUTS, "decisions": DECISIONS, "attempts": ATTEMPTS, "books": BOOKS, "events": EVENTS, "profiles": PROFILES, "manifests": MANIFESTS}


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table, cast, in its order; null where df lacks one."""
    have = set(df.columns)
    fields = _parse_datatype_string(TABLES[table]).fields  # type: ignore[attr-defined]
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))


def create_tables(spark: SparkSession, database: str) -> list[str]:
    """Creates what is missing of the database and its tables; gives their names."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, ddl in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet")
    return sorted(TABLES)


# The states of a page and of routing.
PAGE_STATUS = ("PENDING", "PROCESSING", "COMPLETED", "LOW_CONFIDENCE", "REPROCESSING", "FAILED", "REVIEW_REQUIRED", "BLANK")
FINAL_STATUS = ("COMPLETED", "BLANK", "REVIEW_REQUIRED")
ACTIONS = ("accept", "reprocess_local", "escalate_external", "flag_for_review")
TIERS = ("HIGH", "MEDIUM", "LOW", "CRITICAL")
#: Which status may follow which; a page's first is PENDING or PROCESSING.
TRANSITIONS = {
    "PENDING": ("PROCESSING",),
    "PROCESSING": ("COMPLETED", "LOW_CONFIDENCE", "FAILED", "REVIEW_REQUIRED", "BLANK", "PROCESSING"),
    "LOW_CONFIDENCE": ("REPROCESSING",),
    "REPROCESSING": ("COMPLETED", "REVIEW_REQUIRED"),
    "FAILED": ("PROCESSING",),
    "COMPLETED": ("PROCESSING",),
    "REVIEW_REQUIRED": ("PROCESSING",),
    "BLANK": ("PROCESSING",),
}


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
