"""Column layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("raw", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("ts_offset", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("extras", T.MapType(T.StringType(), T.StringType())),
        T.StructField("cluster_id", T.LongType()),
        T.StructField("template", T.StringType()),
    ]
)

RECORD_COLUMNS = RECORD.fieldNames()
PARSED_COLUMNS = [c for c in RECORD_COLUMNS if c != "raw"]
OUTPUT_COLUMNS = ["ts", "level", "msg", "file", "lineno"]

FORMATS = ("json", "logfmt", "plaintext")

# Severity order of the summary report, most severe first.
SEVERITY_ORDER = ["FATAL", "CRITICAL", "ERROR", "WARN", "WARNING", "INFO", "DEBUG", "TRACE"]
