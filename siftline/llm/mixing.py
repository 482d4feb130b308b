"""Mixing sources to target weights, with whole copies of documents, by pivotal dependent rounding.

A source's target divided by its size is the number of copies that each of its documents should have: a whole part that all get,
and a fraction. Fractions are rounded in pairs: words move at random between two documents until the fraction of one is 0 or 1, so
each document keeps its expectation and the source keeps its words. What is left of a group is one fraction, and
the fractions of all groups are rounded together in the next level of a tree, until one of each source is left; its own draw is all
that a source can miss its target by.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.numbering import chunk_of, running_total
from siftline.session import prepare, stage

#: Rows of a group at the leaves of the tree, and residuals of a group above.
GROUP_ROWS, FAN_IN = 1024, 64
#: The table of sources is broadcast up to so many bytes (measured), joined by shuffle beyond.
BROADCAST_BYTES = 8 << 20
RESULT = ("source", "size", "source_size", "target", "copies", "taken")


def targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), ceiling: int = 3) -> DataFrame:
    """``sources(source, size)``, one row each, with ``target double``: words that the mix should take.

    Sources in order of code points, null last, weigh ``weights`` in turn and share all words. A target stops at ``ceiling``
    times the source's size and the excess is shared by the others' weights, again until none is above.
    """
    order = sources.select("source", "size", F.col("source").isNull().alias("_null"), F.lit(1).cast("long").alias("_one"))
    ranked = running_total(order, ["_null", "source"], "_one", "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = stage(
        ranked.select("source", "size", weight.cast("long").alias("_weight"), (F.col("size") * ceiling).alias("_most")), "sources"
    )
    total = ranked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # each round shares by one scalar: words left for each unit of weight, of the sources below their ceiling
    left, among, capped, share = total, None, -1, None
    while True:
        above = F.lit(False) if share is None else share >= F.col("_most")
        found = ranked.agg(
            F.coalesce(F.sum(F.when(above, F.col("_most"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0)),
            F.count(F.when(above, 1)),
        ).first()
        left, among = total - found[0], found[1]
        if found[2] == capped or not among:
            break
        capped = found[2]
        share = F.lit(float(left)) * F.col("_weight") / F.lit(float(among))
    most = F.col("_most").cast("double")
    target = most if share is None or not among else F.when(share >= most, most).otherwise(share)
    return ranked.select("source", "size", target.alias("target"))


def pivot(sizes: np.ndarray, chances: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round ``chances`` (above 0, below 1) to 0 or 1 but for at most one; its place, or -1.

    ``sum(sizes * chances)`` stays, and so does each chance in expectation. Large documents go first, so that a
    small one tends to be left.
    """
    size, p = sizes.astype(float).tolist(), chances.astype(float).tolist()
    order = np.argsort(-sizes, kind="stable").tolist()
    coins = draw.random(len(order)).tolist()
    open_ = -1
    for k, j in enumerate(order):
        if not 0.0 < p[j] < 1.0:
            continue
        if open_ < 0:
            open_ = j
            continue
        i = open_
        up = min((1.0 - p[i]) * size[i], p[j] * size[j])  # words that i can take from j
        down = min(p[i] * size[i], (1.0 - p[j]) * size[j])
        if coins[k] * (up + down) < down:  # fair: the expected move is nothing
            full, empty, moved = i, j, up
        else:
            full, empty, moved = j, i, down
        fills = (1.0 - p[full]) * size[full] <= moved
        empties = p[empty] * size[empty] <= moved
        p[full] = 1.0 if fills else p[full] + moved / size[full]
        p[empty] = 0.0 if empties else p[empty] - moved / size[empty]
        rest = [x for x in (i, j) if 0.0 < p[x] < 1.0]
        open_ = rest[0] if rest else -1
    return np.array(p), open_


def _round(seed: int, level: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_tie", "ascending"), ("size", "ascending"), ("_chance", "ascending")])
        group, source = table.column("_group")[0].as_py(), table.column("source")[0].as_py()
        name = zlib.crc32((source or "").encode()) + (source is None)
        draw = np.random.default_rng([seed, level, group, name])
        chance, open_ = pivot(table.column("size").to_numpy(), table.column("_chance").to_numpy(), draw)
        if last and open_ >= 0:
            chance[open_], open_ = float(draw.random() < chance[open_]), -1
        waiting = np.arange(len(chance)) == open_
        return table.set_column(table.schema.get_field_index("_chance"), "_chance", pa.array(chance)).set_column(
            table.schema.get_field_index("_open"), "_open", pa.array(waiting)
        )

    return run


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    ceiling: int = 3,
    seed: int = 1,
    keep: Sequence[str] = ("doc_id",),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The columns ``keep`` of ``docs(doc_id, source, text)``, and ``source, size, source_size, target, copies, taken``.

    ``size`` is the text's number of words between white space, ``copies`` (0 to ``ceiling``) how often the mix has the
    document, ``taken`` both multiplied. Null texts have no words and no copies; null is a source of its own, after all others.

    Documents are put in an order of hashes (of doc_id, source, text and ``keep``) and cut into groups of ``group_rows``, whatever their
    source or partition, so no source is one task and reruns agree on any cluster. Rows that are equal take consecutive places
    in any order, which gives the same rows. The tree above has one row of each group. A column of ``keep`` named like
    a result column is left out; other columns may have any name. ``keep`` travels through three shuffles, so
    it should be narrow; ``expand`` writes the copies out.
    """
    spark = prepare(docs.sparkSession)
    keep = [c for c in keep if c not in RESULT]
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    hashed = [F.col(f.name) for f in docs.schema if f.name in keep and "map<" not in f.dataType.simpleString()]
    rows = docs.select(
        *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)),
        source.alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), source, text, *hashed).alias("_tie"),
        # parts a run of equal rows into several ranges; written out, so that a lost task can't draw anew
        F.xxhash64(F.monotonically_increasing_id()).alias("_salt"),
    )
    rows = stage(rows, "sizes")
    sums = stage(rows.groupBy("source").agg(F.sum("size").alias("size")), "source_sizes")
    aims = targets(sums, weights, ceiling).select(
        F.coalesce("source", F.lit("")).alias("_name"),
        F.col("source").isNull().alias("_none"),
        F.col("size").alias("source_size"),
        "target",
    )
    aims = stage(aims, "targets")
    measured = aims.agg(F.coalesce(F.sum(F.octet_length("_name") + 64), F.lit(0))).first()[0]
    ratio = F.least(F.try_divide("target", "source_size"), F.lit(float(ceiling)))
    aimed = rows.join(
        F.broadcast(aims) if measured <= BROADCAST_BYTES else aims,
        (F.coalesce("source", F.lit("")) == F.col("_name")) & (F.col("source").isNull() == F.col("_none")),
    ).drop("_name", "_none")
    aimed = aimed.withColumn("_ratio", F.when(F.col("size") > 0, ratio).otherwise(0.0))
    aimed = aimed.withColumn("_whole", F.floor("_ratio").cast("long"))
    aimed = aimed.withColumn("_chance", F.col("_ratio") - F.col("_whole")).drop("_ratio")
    settled = aimed.where("_chance <= 0").withColumn("copies", F.col("_whole"))
    waiting = aimed.where("_chance > 0").withColumn("_one", F.lit(1).cast("long"))
    level, highest = 0, (waiting.count() - 1) // group_rows  # the highest group of the level
    waiting = running_total(waiting, ["source", "_tie", "_salt"], "_one", "_place").drop("_one", "_salt")
    waiting = waiting.withColumn("_group", chunk_of(F.col("_place"), group_rows)).drop("_place")
    waiting = waiting.withColumn("_open", F.lit(True))

    shown = [*(f"c{i}" for i in range(len(keep))), "source", "size", "source_size", "target"]
    done = [settled.select(*shown, "copies")]
    while highest >= 0:
        rounded = waiting.groupBy("source", "_group").applyInArrow(_round(seed, level, highest == 0), waiting.schema)
        rounded = stage(rounded, "rounded")
        done.append(rounded.where("not _open").select(*shown, (F.col("_whole") + F.col("_chance").cast("long")).alias("copies")))
        if highest == 0:
            break
        waiting = rounded.where("_open").withColumn("_group", chunk_of(F.col("_group"), FAN_IN))
        highest, level = highest // FAN_IN, level + 1
    result = done[0]
    for part in done[1:]:
        result = result.union(part)
    return result.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)),
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def expand(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row of ``mixed`` as often as its ``copies`` say, with ``copy`` from 0."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
