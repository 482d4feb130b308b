"""Rows around matches: every row within N rows of a hit, in groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftline.operators.numbering import CHUNK_ROWS, chunk_of, offsets
from siftline.operators.predicates import definite, inverted
from siftline.session import stage

# Hit neighbourhoods up to this many bytes are broadcast.
MAX_BROADCAST_BYTES = 64 << 20


def _bytes_of(positions: DataFrame, keys: Sequence[str], per_hit: int) -> int:
    """Size of the neighbourhood table that ``positions`` would give, from an actual count."""
    width = F.lit(48)
    for key in keys:
        width = width + F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0))
    total = positions.agg(F.sum(width.cast("bigint")).alias("b")).first().b
    return (total or 0) * per_hit


def _near(hits: DataFrame, n: int, order: str, keys: list[str]) -> DataFrame:
    """Positions within ``n`` of a hit with their group. Only used below the broadcast bound.

    Each hit gives the positions its predecessor did not reach, so no position
    comes twice.
    """
    line = W.partitionBy(*keys).orderBy(order)
    before = F.lag(order).over(line)
    apart = F.coalesce(F.col(order) - before > 2 * n + 1, F.lit(False))
    first = F.greatest(F.col(order) - n, before + n + 1)
    spans = hits.select(*keys, order, apart.alias("_apart"), first.alias("_from"))
    spans = spans.withColumn("group_id", F.sum(F.col("_apart").cast("bigint")).over(line))
    near = spans.withColumn("_at", F.explode(F.sequence("_from", F.col(order) + n)))
    return near.select(*keys, F.col("_at").alias(order), "group_id")


def _groups_before(hits: DataFrame, n: int, order: str, keys: list[str], size: int) -> DataFrame:
    """Per chunk near a hit: how many groups have their first hit in earlier chunks of the key.

    Works on the positions of the hits alone. A group starts at a hit more
    than ``2 n + 1`` after the hit before it, which may lie in an earlier
    chunk: its position comes from the last hit of each chunk.
    """
    own = hits.withColumn("_own", chunk_of(F.col(order), size))
    earlier = W.partitionBy(*keys).orderBy("_own").rowsBetween(W.unboundedPreceding, -1)
    last = own.groupBy(*keys, "_own").agg(F.max(order).alias("_last"))
    last = last.withColumn("_carried", F.max("_last").over(earlier)).drop("_last")
    line = W.partitionBy(*keys, "_own").orderBy(order)
    linked = own.withColumn("_lag", F.lag(order).over(line)).join(last, [*keys, "_own"])
    gap = F.col(order) - F.coalesce("_lag", "_carried")
    starts = F.when(F.coalesce(gap > 2 * n + 1, F.lit(True)), 1).otherwise(0)
    touched = F.array(
        F.struct(F.col("_own").alias("_chunk"), starts.alias("_starts")),
        F.struct(chunk_of(F.col(order) - n, size).alias("_chunk"), F.lit(0).alias("_starts")),
        F.struct(chunk_of(F.col(order) + n, size).alias("_chunk"), F.lit(0).alias("_starts")),
    )
    counts = linked.select(*keys, F.inline(touched)).groupBy(*keys, "_chunk").agg(F.sum("_starts").alias("_starts"))
    return offsets(counts, keys, "_chunk", "_starts", "_before").drop("_starts")


def _sparse(df: DataFrame, hits: DataFrame, n: int, order: str, keys: list[str]) -> DataFrame:
    """Few hits: broadcast their neighbourhood, only its lines move."""
    kept = df.join(F.broadcast(_near(hits, n, order, keys)), [*keys, order])
    first = F.min(order).over(W.partitionBy(*keys, "group_id"))
    return kept.withColumn("new_group", (F.col("group_id") > 0) & (F.col(order) == first))


def _dense(df: DataFrame, hits: DataFrame, n: int, order: str, keys: list[str], chunk_rows: int) -> DataFrame:
    """Many hits: one shuffle by chunk of consecutive positions, of the lines in chunks near a hit.

    Rows close to a chunk border are copied to the neighbouring chunk, so each
    chunk decides about its own rows alone and no key is ever in one task. All distances are
    between positions, so gaps mean the same as in the other plan.
    """
    reach = 2 * n + 1
    size = max(chunk_rows, reach)
    place = F.col(order)
    before = _groups_before(hits, n, order, keys, size)
    spread = F.array_distinct(
        F.array(chunk_of(place - reach, size), chunk_of(place, size), chunk_of(place + reach, size))
    )
    rows = df.withColumn("_own", chunk_of(place, size)).withColumn("_chunk", F.explode(spread))
    rows = rows.join(before, [*keys, "_chunk"])
    line = W.partitionBy(*keys, "_chunk").orderBy(order)
    hit = F.when(F.col("hit"), F.col(order))
    rows = rows.withColumn("_starts", F.col("hit") & F.max(hit).over(line.rangeBetween(-reach, -1)).isNull())
    start = F.when(F.col("_starts"), F.col(order))
    # starts of this chunk and later ones up to the reach of the row, after those of earlier chunks
    counted = F.when(F.col("_starts") & (F.col("_own") >= F.col("_chunk")), 1).otherwise(0)
    upto = F.sum(counted).over(line.rangeBetween(W.unboundedPreceding, n))
    rows = rows.withColumns(
        {
            "_kept": F.max("hit").over(line.rangeBetween(-n, n)),
            "group_id": (F.col("_before") + upto - 1).cast("bigint"),
            "_opens": F.max(start).over(line.rangeBetween(0, n)),
            "_previous": F.lag(order).over(line),
        }
    ).where(F.col("_kept") & (F.col("_own") == F.col("_chunk")))
    first = F.col("_opens").isNotNull() & F.coalesce(F.col("_previous") < F.col("_opens") - n, F.lit(True))
    return rows.withColumn("new_group", first & (F.col("group_id") > 0)).drop(
        "_own", "_chunk", "_kept", "_starts", "_opens", "_previous", "_before"
    )


def context(
    df: DataFrame,
    test: Column,
    n: int,
    order: str = "seq",
    keys: Sequence[str] = (),
    invert: bool = False,
    chunk_rows: int = CHUNK_ROWS,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Rows within ``n`` positions of a hit, each once, with ``hit``, ``group_id`` and ``new_group``.

    ``order`` numbers the rows, over the whole table or within ``keys``; a row counts as near by its position, also where
    positions are missing. Hits up to ``2 n + 1`` apart are one group. ``new_group`` marks the first row after a gap (where a separator
    goes), ``group_id`` numbers the groups from 0. ``n <= 0`` is a plain filter.

    The positions of the hits are written to the shared folder first. Their
    exact number decides the plan: a broadcast of the neighbourhoods below
    ``max_broadcast_bytes``, a chunked window above it.
    """
    keys = list(keys)
    hit = inverted(test) if invert else definite(test)
    if n <= 0:
        return (
            df.where(hit)
            .withColumn("hit", F.lit(True))
            .withColumn("group_id", F.lit(0).cast("bigint"))
            .withColumn("new_group", F.lit(False))
        )
    hits = stage(df.where(hit).select(*keys, F.col(order).cast("bigint").alias(order)), "hits")
    marked = df.withColumn("hit", hit)
    if _bytes_of(hits, keys, 2 * n + 1) <= max_broadcast_bytes:
        return _sparse(marked, hits, n, order, keys)
    return _dense(marked, hits, n, order, keys, chunk_rows)
