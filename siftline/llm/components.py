"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import stage


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Each round moves every node to the neighbour of smallest hash and replaces the
    edges by those between the new places, until none is left. The order of the
    hashes changes in every round, so long chains shrink by a constant factor as well.
    Edges with a null end and loops are ignored. Each round's tables are written to the shared
    folder; nothing but row counts reaches the driver.
    """
    u, v = F.col(left), F.col(right)
    edges = stage(
        edges.where((u != v) & u.isNotNull() & v.isNotNull())
        .select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
        .distinct(),
        "edges",
    )
    places = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    places = places.select("node", F.col("node").alias("place"))
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        seed = F.lit(turn)
        order = lambda c: F.struct(F.xxhash64(F.col(c), seed).alias("h"), F.col(c).alias("n"))
        moves = stage(
            both.groupBy("u")
            .agg(F.min(order("v")).alias("m"))
            .select(F.col("u").alias("old"), F.least(order("u"), F.col("m"))["n"].alias("new")),
            "moves",
        )
        places = stage(
            places.join(moves, places.place == moves.old, "left").select(
                "node", F.coalesce("new", "place").alias("place")
            ),
            "places",
        )
        to_u = moves.select(F.col("old").alias("u"), F.col("new").alias("x"))
        to_v = moves.select(F.col("old").alias("v"), F.col("new").alias("y"))
        edges = stage(
            edges.join(to_u, "u")
            .join(to_v, "v")
            .where("x != y")
            .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
            .distinct(),
            "edges",
        )
        turn += 1
    smallest = places.groupBy("place").agg(F.min("node").alias("component"))
    return places.join(smallest, "place").select("node", "component")
