"""Row numbers over tables, and running totals, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftline.session import stage

# Rows per chunk. One chunk is what one window group sees at most.
CHUNK_ROWS = 1 << 18


def chunk_of(position: Column, chunk_rows: int) -> Column:
    return F.call_function("div", position, F.lit(chunk_rows))


def offsets(counts: DataFrame, keys: Sequence[str], chunk: str, value: str, into: str) -> DataFrame:
    """Add the total of ``value`` over earlier chunks of the same key (one row per key and chunk)."""
    earlier = W.partitionBy(*keys).orderBy(chunk)
    return counts.withColumn(into, F.sum(value).over(earlier) - F.col(value))


def running_total(df: DataFrame, order: Sequence[str], value: str, into: str) -> DataFrame:
    """Add the total of ``value`` over all earlier rows in the order of ``order``.

    Rows are range-partitioned once; totals run within a partition, and over one row for each partition.
    """
    placed = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = F.sum(value).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    parts = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    parts = parts.select("_part", (F.sum("_sum").over(W.orderBy("_part")) - F.col("_sum")).alias("_ahead"))
    total = F.col("_ahead") + F.col("_inside") - F.col(value)
    return placed.withColumn("_inside", inside).join(parts, "_part").withColumn(into, total).drop("_part", "_inside", "_ahead")


def number_by_rank(df: DataFrame, order: str, into: str) -> DataFrame:
    """Number rows from 1 by the column ``order`` (unique), however far apart its values lie."""
    counted = running_total(df.withColumn("_one", F.lit(1).cast("bigint")), [order], "_one", into)
    return counted.withColumn(into, F.col(into) + 1).drop("_one")


def number_rows(
    df: DataFrame,
    order: str,
    keys: Sequence[str] = (),
    lineno: str = "lineno",
    seq: str | None = "seq",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Number rows by the integer column ``order``, unique within ``keys``.

    ``lineno`` counts from 1 per key; ``seq`` counts over all keys in key order.
    Rows are cut into chunks of ``chunk_rows`` consecutive values of ``order``,
    so a key holding most of the table still spreads over many tasks: count rows
    per chunk (combined before the shuffle), add up the counts of earlier
    chunks, then number within each chunk.
    """
    keys = list(keys)
    own = df.withColumn("_chunk", chunk_of(F.col(order), chunk_rows))
    places = own.groupBy(*keys, "_chunk").agg(F.count("*").alias("_rows"))
    places = offsets(places, keys, "_chunk", "_rows", "_before")
    if keys:
        totals = places.groupBy(*keys).agg(F.sum("_rows").alias("_total"))
        places = places.join(running_total(totals, keys, "_total", "_key_before").drop("_total"), keys)
    else:
        places = places.withColumn("_key_before", F.lit(0).cast("bigint"))
    ranked = own.withColumn("_rank", F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(order)))
    number = F.col("_before") + F.col("_rank")
    result = ranked.join(places.drop("_rows"), [*keys, "_chunk"]).withColumn(lineno, number)
    if seq:
        result = result.withColumn(seq, F.col("_key_before") + F.col(lineno))
    return result.drop("_chunk", "_rank", "_before", "_key_before")
