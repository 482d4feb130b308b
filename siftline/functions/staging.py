"""Columns that must be computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    A later filter on a plain column would be pushed below it, with the
    expression copied to every place the filter mentions it. A filter passes the
    one-element explode only when it uses other columns.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
