"""Any table with a text column as positioned lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.staging import once


def _parts(text: str) -> Column:
    """Text cut at line feeds, carriage returns and pairs of both, as in text files."""
    return F.expr(f"split(replace(replace({text}, '\\r\\n', '\\n'), '\\r', '\\n'), '\\n', -1)")


def _lines(parts: str) -> Column:
    """Without the part after a last terminator; empty text has no line."""
    return F.expr(f"CASE WHEN element_at({parts}, -1) = '' THEN slice({parts}, 1, size({parts}) - 1) ELSE {parts} END")


def lines_from_table(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys, lineno, raw``: one row per line of ``text``, numbered from 1 in each row. No shuffle."""
    cut = once(df.select(*keys, F.col(text).alias("_text")), "_parts", _parts("_text"))
    cut = once(cut.select(*keys, "_parts"), "_lines", _lines("_parts"))
    return cut.select(*keys, F.posexplode("_lines").alias("_pos", "raw")).select(
        *keys, (F.col("_pos") + 1).cast("bigint").alias("lineno"), "raw"
    )
