"""Search: parse lines, keep the ones a filter matches."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siftline.operators import predicates
from siftline.operators.parse import detect_format, detect_per_key, format_shares, parse
from siftline.sources.files import head, heads, read_lines


def search(
    lines: DataFrame,
    levels: Sequence[str] = (),
    patterns: str | Sequence[str] | None = (),
    from_: str | datetime | None = None,
    to: str | datetime | None = None,
    invert: bool = False,
    fmt: str | Column | None = None,
    regex_mode: bool = False,
    extra: Sequence[Column] = (),
    per_file: bool = False,
) -> DataFrame:
    """Parsed lines that match every given filter (or, inverted, that do not).

    The format is detected from the first lines by ``seq`` (any lines where there is no position), with ``per_file`` for each
    file from its first lines by ``lineno``, unless ``fmt`` gives it. The filter
    and the parsing are plain expressions over ``raw``; a search by pattern only
    never parses the lines it drops.
    """
    columns = lines.columns
    if fmt is None and per_file:
        lines, fmt = _with_formats(lines, detect_per_key(lines, ["file"]))
    elif fmt is None:
        fmt = detect_format(lines)
    plain = isinstance(fmt, str) and fmt not in ("json", "logfmt")
    test = predicates.build(levels, patterns, from_, to, regex_mode, extra, plain, lazy=True)
    found = parse(lines, fmt).where(predicates.inverted(test) if invert else test)
    return found.drop("_format") if "_format" not in columns else found


def _with_formats(lines: DataFrame, formats: DataFrame) -> tuple[DataFrame, Column]:
    """The lines with the format of their file, and the column that holds it."""
    formats = formats.select(F.col("file").alias("_of"), F.col("fmt").alias("_format"))
    return lines.join(formats, lines["file"].eqNullSafe(formats["_of"])).drop("_of"), F.col("_format")


def search_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    numbered: bool = True,
    per_file: bool = False,
    **filters,
) -> DataFrame:
    """``search`` over text files, with their format detected from the beginnings of the files.

    Detection reads the first lines of the whole input (of as many files as that takes) or, with ``per_file``, of every file; the
    lines themselves are neither numbered nor sorted for it, and it does not depend on how they are partitioned.
    ``filters`` are those of ``search``.
    """
    paths = paths if isinstance(paths, str) else list(paths)
    lines = read_lines(spark, paths, numbered)
    if filters.get("fmt") is not None:
        return search(lines, **filters)
    if not per_file:
        return search(lines, **{**filters, "fmt": format_shares(head(spark, paths)).first().fmt})
    formats = format_shares(heads(spark, paths, numbered=numbered), ["file"])
    lines, fmt = _with_formats(lines, formats)
    return search(lines, **{**filters, "fmt": fmt}).drop("_format")


def counted(parsed: DataFrame, test: Column, name: str = "scan") -> tuple[DataFrame, Observation]:
    """The matching rows, and an observation of rows scanned and matched.

    The counters fill while the result is written; no extra pass is needed.
    """
    seen = Observation(name)
    watched = parsed.withColumn("_match", predicates.definite(test)).observe(
        seen,
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(F.col("_match")).alias("matched"),
    )
    return watched.where("_match").drop("_match"), seen


def scan_rate(scanned: int, seconds: float) -> int:
    """Rows per second, 0 for an unmeasurably short run."""
    return int(scanned / seconds) if seconds > 0 else 0
