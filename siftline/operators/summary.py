"""Volumes by level, time span and most frequent texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftline.functions.timestamps import instant
from siftline.schema import SEVERITY_ORDER

TOP_ROWS = 10
NO_LEVEL = "(no level)"

# Label length of the report and the mark of a shortened label.
LABEL_LENGTH = 53
ELLIPSIS = "…"


def _has_level(column: str = "level") -> Column:
    return F.coalesce(F.col(column) != "", F.lit(False))


def _by_offset(table: DataFrame, *keys: str) -> DataFrame:
    """Rows, first and last wall clock per key and UTC offset.

    Clocks with the same offset compare directly, so the pass over the data
    keeps fixed-width minima and maxima (a hash aggregate combined before the
    shuffle); instants are compared on its few result rows.
    """
    return table.groupBy(*keys, "ts_offset").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("_min"), F.max("ts").alias("_max")
    )


def _merged() -> list[Column]:
    """Aggregates that merge rows of ``_by_offset``: rows, first and last clock by instant."""

    def point(c: str) -> Column:
        moment = instant(F.col(c), F.col("ts_offset"))
        return F.when(F.col(c).isNotNull(), F.struct(moment.alias("m"), F.col(c).alias("t")))

    return [
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.min(point("_min")).getField("t").alias("first_ts"),
        F.max(point("_max")).getField("t").alias("last_ts"),
        F.min(point("_min")).getField("m").alias("_first_ts"),  # as instants
        F.max(point("_max")).getField("m").alias("_last_ts"),
    ]


def _level_parts(parsed: DataFrame) -> DataFrame:
    """The only pass over the data: rows and clocks per level (NULL for none) and offset."""
    level = F.when(_has_level(), F.col("level"))
    return _by_offset(parsed.select(level.alias("level"), "ts", "ts_offset"), "level")


def summary(parsed: DataFrame) -> DataFrame:
    """One row: ``total, unparsed, n_levels, by_level, first_ts, last_ts``, from one pass over the data.

    ``by_level`` is a map of the rows of each level, in order of severity, then of name.
    """
    none = F.col("level").isNull()
    parts = _level_parts(parsed)
    # the offsets of a level are merged first; then its few rows
    levels = parts.groupBy("level").agg(*_merged()).withColumn("_rank", severity_rank(F.col("level")))
    counted = F.when(~none, F.struct("_rank", "level", "n"))
    sorted_ = F.array_sort(F.collect_list(counted))

    def point(c: str) -> Column:
        return F.struct(f"_{c}", c)

    return levels.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(none, F.col("n"))), F.lit(0)).alias("unparsed"),
        F.count("level").alias("n_levels"),
        F.map_from_entries(F.transform(sorted_, lambda x: F.struct(x["level"], x["n"]))).alias("by_level"),
        F.min(F.when(F.col("first_ts").isNotNull(), point("first_ts"))).getField("first_ts").alias("first_ts"),
        F.max(F.when(F.col("last_ts").isNotNull(), point("last_ts"))).getField("last_ts").alias("last_ts"),
    )


def total_rows(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count(F.lit(1)).alias("total"))


def count_by_level(parsed: DataFrame) -> DataFrame:
    """``level, n`` of rows that have a level."""
    return parsed.where(_has_level()).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def unparsed_rows(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if(~_has_level()).alias("unparsed"))


def time_span(parsed: DataFrame) -> DataFrame:
    """``first_ts, last_ts``: wall clocks of the earliest and latest instant."""
    return _by_offset(parsed.select("ts", "ts_offset")).agg(*_merged()[1:3])


def severity_rollup(parsed: DataFrame) -> DataFrame:
    """One row: ``errors`` (ERROR, FATAL, CRITICAL) and ``warnings`` (WARN, WARNING)."""
    return parsed.agg(
        F.count_if(F.col("level").isin("ERROR", "FATAL", "CRITICAL")).alias("errors"),
        F.count_if(F.col("level").isin("WARN", "WARNING")).alias("warnings"),
    )


def severity_rank(level: Column) -> Column:
    """Position in the severity order; levels outside it come after all of it."""
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), level)
    return F.when(place > 0, place).otherwise(len(SEVERITY_ORDER) + 1)


def summary_report(parsed: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """The report as rows ``section, label, value``, in report order.

    With ``templates`` (``template, n, first_seq``) the most frequent ones follow.

    Total, known levels by severity, other levels by name, rows without level,
    then first and last time. One pass over the data: the grand total is rolled
    up from the counts per level.
    """
    parts = _level_parts(parsed)
    # One row of zero lines, so that empty input still reports its total.
    nothing = parsed.sparkSession.range(0, 1, 1, 1).select(
        *[F.lit(0 if f.name == "n" else None).cast(f.dataType).alias(f.name) for f in parts.schema.fields]
    )
    rolled = (
        parts.unionByName(nothing)
        .rollup("level")
        .agg(*_merged(), F.grouping_id().alias("_all"))
        .where((F.col("_all") == 1) | (F.col("n") > 0))
    )

    def line(section: str, rank: Column, label: Column, value: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), rank.cast("int").alias("rank"), label.alias("label"), value.alias("value")
        )

    def clock(column: str) -> Column:
        return F.date_format(F.col(column), "yyyy-MM-dd HH:mm:ss")

    count = F.format_number("n", 0)
    level = F.col("level")
    whole = F.array(
        line("total", F.lit(0), F.lit("Total lines"), count),
        line("span", F.lit(1), F.lit("From"), clock("first_ts")),
        line("span", F.lit(2), F.lit("To"), clock("last_ts")),
    )
    single = F.array(
        line(
            "level",
            F.when(level.isNull(), 99).otherwise(severity_rank(level)),
            F.coalesce(level, F.lit(NO_LEVEL)),
            count,
        )
    )
    order = F.array(*map(F.lit, ("total", "level", "span", "template")))
    section_order = F.array_position(order, F.col("section"))
    lines = rolled.select(F.explode(F.when(F.col("_all") == 1, whole).otherwise(single)).alias("line")).select("line.*")
    if templates is not None:
        best = top(templates)
        place = F.row_number().over(W.orderBy(F.desc("n"), "first_seq"))  # of the ten kept rows
        named = label(F.col("template"))
        lines = lines.unionByName(best.select(line("template", place, named, count).alias("line")).select("line.*"))
    return (
        lines.where(F.col("value").isNotNull())
        .orderBy(section_order, "rank", "label")
        .select("section", "label", "value")
    )


def label(text: Column) -> Column:
    """A text as shown in the report: longer than 53 characters keeps 52 and an ellipsis."""
    short = F.concat(F.substring(text, 1, LABEL_LENGTH - 1), F.lit(ELLIPSIS))
    return F.when(F.char_length(text) > LABEL_LENGTH, short).otherwise(text)


def count_texts(rows: DataFrame, text: str, order: str = "seq") -> DataFrame:
    """``text, n, first_seq``: rows per text and where it was first seen."""
    return rows.groupBy(text).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seq"))


def top(counts: DataFrame, rows: int = TOP_ROWS) -> DataFrame:
    """The most frequent entries; equal counts keep the order of first appearance."""
    return counts.orderBy(F.desc("n"), "first_seq").limit(rows)
