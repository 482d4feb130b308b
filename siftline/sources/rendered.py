"""Log lines rendered from the given tables, for queries, tests and benchmarks.

Every event becomes one line, in one of three formats. Spellings of keys and
timestamps rotate over the events, some lines are damaged, so that all parsing
rules are met. Long texts (documents, pages, conversations) are cut into lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.numbering import number_rows
from siftline.session import prepare
from siftline.sources.tables import lines_from_table

_MESSAGE = """CASE event_type WHEN 'click' THEN 'button clicked' WHEN 'error' THEN 'request failed'
    WHEN 'purchase' THEN 'order placed' WHEN 'signup' THEN 'account created' ELSE 'page viewed' END
  || ' user=' || user_id || ' value ' || CAST(value AS DECIMAL(12,2))"""

_LEVEL = """CASE event_type WHEN 'click' THEN 'debug' WHEN 'error' THEN 'error'
    WHEN 'purchase' THEN 'info' WHEN 'signup' THEN 'warning' END"""

# Plain text: six timestamp shapes (the last one is not accepted), four level spellings and none.
_PLAIN = f"""
  CASE event_id % 6
    WHEN 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS ')
    WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS ')
    WHEN 2 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z '")
    WHEN 3 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00 '")
    WHEN 4 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss ')
    ELSE date_format(ts, "yyyy-MM-dd HH:mm:ss'Z '") END
  || CASE event_type WHEN 'click' THEN 'DEBUG  ' WHEN 'error' THEN 'ERROR - '
    WHEN 'purchase' THEN 'INFO  ' WHEN 'signup' THEN 'Warning: ' ELSE '' END
  || {_MESSAGE}"""

# JSON: four key spellings, four time values (one is an epoch number), some damaged lines.
_JSON = f"""
  '{{"' || CASE event_id % 4 WHEN 0 THEN 'time' WHEN 1 THEN 'timestamp' WHEN 2 THEN 'ts' ELSE '@timestamp' END
  || '":' || CASE event_id % 4
    WHEN 0 THEN date_format(ts, "'\\"'yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z\\"'")
    WHEN 1 THEN date_format(ts, "'\\"'yyyy-MM-dd'T'HH:mm:ss'+02:00\\"'")
    WHEN 2 THEN CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS STRING)
    ELSE date_format(ts, "'\\"'dd/MMM/yyyy:HH:mm:ss '-0130\\"'") END
  || ',"' || CASE event_id % 4 WHEN 0 THEN 'level' WHEN 1 THEN 'severity' WHEN 2 THEN 'lvl' ELSE 'LEVEL' END
  || '":' || coalesce('"' || {_LEVEL} || '"', '0')
  || ',"' || CASE event_id % 3 WHEN 0 THEN 'msg' WHEN 1 THEN 'message' ELSE 'MESSAGE' END
  || '":"' || {_MESSAGE} || '","user":' || user_id || ',"value":' || value || ', "props":' || props || ',"ok":true'
  || CASE WHEN event_id % 11 = 5 THEN '' WHEN event_id % 13 = 7 THEN '}} trailing' ELSE '}}' END"""

# logfmt: three key spellings, bare and quoted values, repeated and glued keys.
_LOGFMT = f"""
  CASE WHEN event_id % 9 = 4 THEN 'stray ' ELSE '' END
  || CASE event_id % 3
    WHEN 0 THEN date_format(ts, "'time='yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    WHEN 1 THEN date_format(ts, "'ts=\\"'yyyy-MM-dd HH:mm:ss.SSSSSS'\\"'")
    ELSE date_format(ts, "'timestamp='yyyy-MM-dd'T'HH:mm:ss,SSS") END
  || coalesce(CASE event_id % 3 WHEN 0 THEN ' level=' WHEN 1 THEN ' lvl=' ELSE ' severity=' END || {_LEVEL}, '')
  || CASE event_id % 2 WHEN 0 THEN ' msg="' ELSE ' message="' END || {_MESSAGE}
  || '" user=' || user_id || ' value="' || CAST(value AS DECIMAL(12,2)) || '" note='
  || CASE WHEN event_id % 7 = 3 THEN ' user=again' ELSE '' END"""

LAYOUTS = {
    "plaintext": _PLAIN,
    "json": _JSON,
    "logfmt": _LOGFMT,
    # one format per log file
    "mixed": f"CASE user_id % 4 WHEN 0 THEN {_JSON} WHEN 1 THEN {_LOGFMT} ELSE {_PLAIN} END",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def event_lines(spark: SparkSession, folder: str, fmt: str = "plaintext") -> DataFrame:
    """``event_id, file, raw``: events as lines of four log files. ``mixed`` gives the files different formats."""
    return table(spark, folder, "events").selectExpr(
        "event_id", "'app-' || (user_id % 4) || '.log' AS file", f"{LAYOUTS[fmt]} AS raw"
    )


def numbered_event_lines(spark: SparkSession, folder: str, fmt: str = "plaintext") -> DataFrame:
    """Event lines with ``lineno`` per file and ``seq`` over all files."""
    return number_rows(event_lines(spark, folder, fmt), "event_id", ["file"])


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, lineno, raw``."""
    return lines_from_table(table(spark, folder, "documents"), "text", ["doc_id"])


def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, lineno, raw``."""
    return lines_from_table(table(spark, folder, "pages"), "html", ["page_id"])


def conversation_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``conv_id, turn, lineno, raw``: lines of each turn."""
    return lines_from_table(table(spark, folder, "conversations"), "text", ["conv_id", "turn"])


def write_event_files(
    spark: SparkSession, folder: str, target: str, fmt: str = "plaintext", compression: str | None = None
) -> list[str]:
    """Write event lines as text files, one folder per log; returns a glob per log, in order.

    Sorted by range, so the part files of a log follow each other in line order.
    """
    lines = event_lines(spark, folder, fmt).orderBy("file", "event_id").select("file", F.col("raw").alias("value"))
    writer = lines.write.partitionBy("file")
    if compression:
        writer = writer.option("compression", compression)
    writer.text(target)
    return [f"{target}/file=app-{i}.log/part-*" for i in range(4)]


def part_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``p_partkey, raw``: a line of four to nine words for each part, with few different words at each place."""
    place = F.element_at(
        F.array(
            F.lit("in stock"),
            F.concat(F.lit("in size "), F.col("p_size").cast("string")),
            F.lit("on order since monday by mail"),
            F.concat(F.lit("moved to "), F.col("p_brand")),
            F.concat(F.lit("on order since friday by "), F.split("p_name", " ")[0]),
        ),
        (F.col("p_size") % 5 + 1).cast("int"),
    )
    parts = spark.read.parquet(f"{folder}/part.parquet")
    return parts.select("p_partkey", F.concat_ws(" ", "p_type", "p_name", place).alias("raw"))
