"""Output: prefixes, tags, highlighting, output records and the three sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.patterns import alternation
from siftline.functions.timestamps import timestamp_text
from siftline.operators.templates import template_text
from siftline.schema import OUTPUT_COLUMNS, SEVERITY_ORDER

SEPARATOR = "--"
FORMATS = ("text", "json", "csv")

# Doubled quotes, bare empty cells, blanks kept.
CSV_OPTIONS = {
    "header": True,
    "emptyValue": "",
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def prefix(file: Column | None = None, lineno: Column | None = None) -> Column:
    """``file:lineno:`` from the parts given; '' when there is none."""
    parts = []
    if file is not None:
        parts.append(F.when(file != "-", file))
    if lineno is not None:
        parts.append(lineno.cast("string"))
    if not parts:
        return F.lit("")
    joined = F.concat_ws(":", *parts)
    return F.when(joined == "", joined).otherwise(F.concat(joined, F.lit(":")))


def level_tag(level: Column) -> Column:
    """``[LEVEL] `` for the known levels, else ''."""
    return F.when(level.isin(SEVERITY_ORDER), F.concat(F.lit("["), level, F.lit("] "))).otherwise(F.lit(""))


def highlight(raw: Column, patterns: Sequence[str], before: str = "<<", after: str = ">>") -> Column:
    """Wrap every match of any pattern; an invalid pattern switches highlighting off."""
    expression = alternation(patterns) if patterns else None
    if expression is None:
        return raw

    def plain(mark: str) -> str:
        return mark.replace("\\", "\\\\").replace("$", "\\$")

    return F.regexp_replace(raw, expression, f"{plain(before)}$0{plain(after)}")


def text_lines(
    parsed: DataFrame,
    show_file: bool = False,
    show_lineno: bool = False,
    tag: bool = False,
    patterns: Sequence[str] = (),
    separator: bool = False,
) -> Column:
    """The text form of a row. With ``separator`` a ``--`` line precedes the first row of a group."""
    line = F.concat(
        prefix(F.col("file") if show_file else None, F.col("lineno") if show_lineno else None),
        level_tag(F.col("level")) if tag else F.lit(""),
        highlight(F.col("raw"), patterns),
    )
    if separator and "new_group" in parsed.columns:
        line = F.concat(F.when(F.col("new_group"), F.lit(SEPARATOR + "\n")).otherwise(F.lit("")), line)
    return line


def output_record(parsed: DataFrame, show_file: bool = False, show_lineno: bool = False) -> DataFrame:
    """``ts, level, msg, file, lineno``; file and line number only when asked for."""
    file = F.when(F.col("file") != "-", F.col("file")) if show_file else F.lit(None).cast("string")
    lineno = F.col("lineno") if show_lineno else F.lit(None)
    extra = [c for c in ("group_id",) if c in parsed.columns]
    return parsed.select(
        timestamp_text(F.col("ts"), F.col("ts_offset")).alias("ts"),
        F.col("level"),
        template_text(F.col("message"), F.col("raw")).alias("msg"),
        file.alias("file"),
        lineno.cast("bigint").alias("lineno"),
        *extra,
    )


def json_line(columns: Sequence[str] = tuple(OUTPUT_COLUMNS)) -> Column:
    """One JSON object per output record; absent values are written as null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_matches(
    parsed: DataFrame,
    path: str,
    fmt: str = "text",
    show_file: bool = False,
    show_lineno: bool = False,
    order: str | None = None,
    mode: str = "errorifexists",
    **text_options,
) -> None:
    """Write rows as text, NDJSON or CSV files.

    ``order`` names the position column to sort by: part files then follow each
    other in input order (one range shuffle). Without it rows are written where
    they are.
    """
    kind = fmt.lower()
    if kind not in FORMATS:
        raise ValueError(f"unknown output format {fmt!r}; one of {', '.join(FORMATS)}")
    rows = parsed.orderBy(order) if order else parsed
    if kind == "text":
        separator = "new_group" in rows.columns
        value = text_lines(rows, show_file, show_lineno, separator=separator, **text_options)
        rows.select(value.alias("value")).write.mode(mode).text(path)
        return
    record = output_record(rows, show_file, show_lineno)
    if kind == "json":
        record.write.mode(mode).option("ignoreNullFields", "false").json(path)
        return
    record.write.mode(mode).options(**CSV_OPTIONS).csv(path)
