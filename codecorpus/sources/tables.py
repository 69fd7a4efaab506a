"""Reading stored tables, commit logs and exported logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(),
}


def _schema(text: str) -> T.StructType:
    """Schema from ``name type`` pairs; unlike the DDL parser it needs no session at import time."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (part.split() for part in text.split(","))])


SESSION_SCHEMA = _schema(
    "session_id string, original_filename string, created_at timestamp, status string, processing_mode string, refactor_type string, "
    "preserve_comments boolean, add_documentation boolean, follow_conventions boolean, total_files int, processed_files int, error_message string"
)
FILE_SCHEMA = _schema(
    "file_id bigint, session_id string, original_path string, language string, original_content string, refactored_content string, "
    "status string, error_message string, created_at timestamp, complexity_score int, readability_score int, maintainability_score int, "
    "overall_quality_score int"
)
# --- fixed values: column defaults of later schema versions --------------------------------------------------------
SESSION_DEFAULTS = {
    "status": "processing", "processing_mode": "local", "refactor_type": "comprehensive", "preserve_comments": True,
    "add_documentation": True, "follow_conventions": False, "total_files": 0, "processed_files": 0, "error_message": "",
}
FILE_DEFAULTS = {
    "refactored_content": "", "status": "pending", "error_message": "", "complexity_score": 0, "readability_score": 0,
    "maintainability_score": 0, "overall_quality_score": 0,
}


def _with_defaults(df: DataFrame, schema: T.StructType, defaults: dict) -> DataFrame:
    """Fill columns that an older writer did not have and NULLs with the schema defaults; casts to the declared types.

    Each column is ``coalesce(column, default)``, so the scan still prunes columns it is not asked for.
    """
    have = set(df.columns)
    out = []
    for field in schema:
        col = F.col(field.name) if field.name in have else F.lit(None)
        col = col.cast(field.dataType)
        default = defaults.get(field.name)
        out.append((F.coalesce(col, F.lit(default).cast(field.dataType)) if default is not None else col).alias(field.name))
    return df.select(*out)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return _with_defaults(spark.read.option("mergeSchema", "true").parquet(path), SESSION_SCHEMA, SESSION_DEFAULTS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return _with_defaults(spark.read.option("mergeSchema", "true").parquet(path), FILE_SCHEMA, FILE_DEFAULTS)


def parse_commits(lines: DataFrame, value: str = "value") -> DataFrame:
    """``hash|author|date|subject`` lines; further bars belong to the subject, lines with fewer fields are dropped."""
    parts = F.split(F.col(value), r"\|", 4)
    stamp = F.regexp_replace(F.get(parts, F.lit(2)), r"^(\S+) (\S+) ([+-]\d{2})(\d{2})$", "$1 $2$3:$4")
    return lines.filter(F.size(parts) == 4).select(
        F.get(parts, F.lit(0)).alias("hash"), F.get(parts, F.lit(1)).alias("author"), F.try_to_timestamp(stamp).alias("committed_at"),
        F.get(parts, F.lit(3)).alias("message"),
    )


LOG_EXPORT = (
    "session_summary struct<session_id:string,session_duration:double,total_log_entries:bigint,total_operations:bigint>, "
    "log_entries array<struct<timestamp:double,datetime:string,level:string,operation_type:string,message:string,file_path:string,"
    "line_number:int,function_name:string,metadata:map<string,string>>>"
)
DIFF_EXPORT = (
    "session_id string, diffs array<struct<file_path:string,original_code:string,refactored_code:string,language:string,timestamp:double,"
    "operation_id:string>>"
)
METRIC_EXPORT = (
    "session_id string, metrics array<struct<operation_id:string,operation_type:string,start_time:double,end_time:double,duration:double,"
    "file_path:string,file_size:bigint,line_count:int>>"
)


def read_log_exports(spark: SparkSession, path: str, kind: str = "logs", multi_line: bool = False) -> DataFrame:
    """Exploded entries of exported JSON documents; ``kind``: logs, diffs or metrics. The schema is given, not inferred.

    One document per line, so that files are split between tasks; ``multi_line`` is for pretty-printed single documents."""
    schema = {"logs": LOG_EXPORT, "diffs": DIFF_EXPORT, "metrics": METRIC_EXPORT}[kind]
    docs = spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(path)
    if kind == "logs":
        return docs.select(F.col("session_summary.session_id").alias("session_id"), F.inline("log_entries"))
    return docs.select("session_id", F.inline("diffs" if kind == "diffs" else "metrics"))
