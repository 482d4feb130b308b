"""Exact top-k search by selection on distributed histograms.

Every pass scores all vectors against a block of queries and counts the scores of each query in equal bins
of the range that still holds its k-th best score. The bin with that score becomes the next range, until it is a single
value. The ids of the vectors tied at that value are narrowed down in the same way. A last pass returns
exactly the rows above the two thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.session import stage

#: Scores held at once in a task.
_SCORES = 1 << 22
_MOST = 1 << 62


@dataclass(frozen=True)
class TopK:
    """``k`` best of every query; queries go to the executors in blocks of at most ``block`` vectors.

    ``bins`` is the number of histogram bins of a query and pass.
    """

    k: int = 10
    block: int = 4096
    bins: int = 1024


def quantized(vectors: DataFrame, scale: int = 1024, vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, vector``: components as ``floor(scale * x)`` in whole numbers.

    Left out are null vectors, vectors without components, and vectors with a null or non-finite component (or one
    beyond 2^62 when scaled); so are rows without id. Columns other than the two named are ignored, whatever their names.
    """
    x = F.transform(F.col(vector), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    usable = F.forall(
        F.col(vector),
        lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(F.lit(float(scale)) * v.cast("double")) < 2.0**62),
    )
    rows = vectors.where(F.col(vector_id).isNotNull() & (F.size(vector) > 0) & F.coalesce(usable, F.lit(False)))
    return rows.select(F.col(vector_id).cast("long").alias("id"), x.alias("vector"))


def _matrices(batch: pa.RecordBatch):
    """Ids and a matrix for each vector length in a batch."""
    lists = batch.column("vector")
    sizes = np.diff(lists.offsets.to_numpy())
    ids = batch.column("id").to_numpy()
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        flat = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False)
        yield ids[own], flat.reshape(len(own), size)


def _products(queries: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Exact inner products, queries by rows; one of 2^62 or more of different ids raises ``OverflowError``.

    Whole numbers below 2^53 are exact as doubles. Rows that may reach 2^62 with some query are computed in
    numbers of any size.
    """
    most = float(np.abs(queries).max()) * np.abs(rows).max(axis=1).astype(np.float64) * rows.shape[1]
    if most.max() < 2**53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    scores = queries @ rows.T
    for at in np.flatnonzero(most >= 2**61).tolist():  # a factor 2 above the rounding of ``most``
        exact = queries.astype(object) @ rows[at].astype(object)
        for i, value in enumerate(exact):
            if abs(value) < _MOST:
                scores[i, at] = value
            elif query_ids[i] != ids[at]:
                raise OverflowError(f"inner product of vectors {query_ids[i]} and {ids[at]} does not fit: {value}")
            else:
                scores[i, at] = 0  # a query is no candidate of its own
    return scores


def _scored(batches, queries):
    """Query places, candidate ids and scores of each query group, in pieces; the query itself scores nothing."""
    for batch in batches:
        if not batch.num_rows:
            continue
        for ids, matrix in _matrices(batch):
            if matrix.shape[1] not in queries:
                continue
            places, query_ids, others = queries[matrix.shape[1]]
            step = max(1, _SCORES // len(places))
            for at in range(0, len(ids), step):
                part = matrix[at : at + step]
                own = ids[at : at + step]
                scores = _products(others, part, query_ids, own)
                yield places, own, scores, query_ids[:, None] != own[None, :]


@dataclass
class _State:
    """Per query: the closed range that holds the threshold, and how many of the best in it are wanted."""

    low: np.ndarray
    high: np.ndarray
    want: np.ndarray

    def width(self, bins: int) -> np.ndarray:
        return np.maximum(1, -((self.low - self.high - 1) // bins))


def _histogram(shared, bins: int):
    """Counts by query and bin of what lies in the range; bins are numbered from the best one.

    A batch's bins below its own k-th best can't hold the global one, and are left out.
    """

    def run(batches):
        queries, state, ties = shared.value
        width = state.width(bins)
        for places, ids, scores, valid in _scored(batches, queries):
            low, high = state.low[places][:, None], state.high[places][:, None]
            if ties is None:
                value, distance = scores, high - scores
            else:
                value = np.broadcast_to(ids[None, :], scores.shape)
                valid = valid & (scores == ties[places][:, None])
                distance = value - low
            inside = valid & (value >= low) & (value <= high)
            row, column = np.nonzero(inside)
            if not len(row):
                continue
            bin_ = distance[row, column] // width[places][row]
            key, n = np.unique(row * np.int64(bins) + bin_, return_counts=True)
            row, bin_ = key // bins, key % bins
            before = np.cumsum(n) - n
            starts = np.searchsorted(row, np.arange(len(places)))
            before -= before[np.minimum(starts, len(before) - 1)][row]
            keep = before < state.want[places][row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(places[row[keep]]), pa.array(bin_[keep]), pa.array(n[keep])], ["place", "bin", "n"]
            )

    return run


def _narrowed(rows: DataFrame, queries, state: _State, ties, params: TopK) -> None:
    """Shrink every range to the single value at which the wanted count is reached."""
    spark = rows.sparkSession
    while (open_ := state.low < state.high).any():
        live = _only(queries, open_)
        shared = spark.sparkContext.broadcast((live, state, ties))
        counts = rows.mapInArrow(_histogram(shared, params.bins), "place long, bin long, n long")
        # the first bin whose running count reaches what is wanted; at most ``bins`` rows of each query
        counts = counts.groupBy("place", "bin").agg(F.sum("n").alias("n"))
        want = pa.table({"place": np.flatnonzero(open_), "want": state.want[open_]})
        counts = counts.join(F.broadcast(spark.createDataFrame(want)), "place")
        running = W.partitionBy("place").orderBy("bin")
        counts = counts.withColumn("reached", F.sum("n").over(running))
        found = counts.where("reached >= want").groupBy("place")
        found = found.agg(F.min("bin").alias("bin"), F.min_by(F.col("reached") - F.col("n"), "bin").alias("before")).toArrow()
        place, bin_, before = (found[c].to_numpy() for c in ("place", "bin", "before"))
        width = state.width(params.bins)[place]
        if ties is None:
            high = state.high[place] - bin_ * width
            low = np.maximum(state.low[place], high - width + 1)
        else:
            low = state.low[place] + bin_ * width
            high = np.minimum(state.high[place], low + width - 1)
        state.low[place], state.high[place] = low, high
        state.want[place] -= before
        shared.unpersist()


def _only(queries, chosen: np.ndarray):
    """The queries whose place is chosen."""
    out = {}
    for size, (places, ids, matrix) in queries.items():
        own = chosen[places]
        if own.any():
            out[size] = (places[own], ids[own], matrix[own])
    return out


def _extent(shared):
    """For each query: its number of candidates, the range of their scores and that of the ids."""

    def run(batches):
        for places, ids, scores, valid in _scored(batches, shared.value):
            n = valid.sum(axis=1)
            low = np.where(valid, scores, _MOST).min(axis=1)
            high = np.where(valid, scores, -_MOST).max(axis=1)
            columns = [places, n, low, high, np.full(len(places), ids.min()), np.full(len(places), ids.max())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(c, np.int64)[n > 0]) for c in columns], ["place", "n", "low", "high", "first", "last"]
            )

    return run


def _selected(shared):
    """The rows better than a query's threshold, and those at it up to the last wanted id."""

    def run(batches):
        queries, query_ids, score, last = shared.value
        for places, ids, scores, valid in _scored(batches, queries):
            at = score[places][:, None]
            chosen = valid & ((scores > at) | (scores == at) & (ids[None, :] <= last[places][:, None]))
            row, column = np.nonzero(chosen)
            place = places[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(place), pa.array(query_ids[place]), pa.array(ids[column]), pa.array(scores[row, column])],
                ["place", "query_id", "vec_id", "score"],
            )

    return run


def _search_block(rows: DataFrame, block: pa.Table, params: TopK) -> DataFrame:
    spark = rows.sparkSession
    query_ids = block["id"].to_numpy()
    lists = block["vector"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    queries = {}
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        flat = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False)
        queries[size] = (own, query_ids[own], flat.reshape(len(own), size))
    shared = spark.sparkContext.broadcast(queries)
    extent = rows.mapInArrow(_extent(shared), "place long, n long, low long, high long, first long, last long")
    extent = extent.groupBy("place").agg(
        F.sum("n").alias("n"),
        *(F.min(c).alias(c) for c in ("low", "first")),
        *(F.max(c).alias(c) for c in ("high", "last")),
    ).toArrow()
    found = np.zeros(len(query_ids), bool)
    n, low, high, first, last = (np.zeros(len(query_ids), np.int64) for _ in range(5))
    place = extent["place"].to_numpy()
    found[place] = True
    for values, name in ((n, "n"), (low, "low"), (high, "high"), (first, "first"), (last, "last")):
        values[place] = extent[name].to_numpy()
    few = n <= params.k  # all candidates are wanted
    scores = _State(low.copy(), np.where(few, low, high), np.full(len(n), params.k))
    _narrowed(rows, queries, scores, None, params)
    ids = _State(np.where(few, last, first), last, scores.want)
    _narrowed(rows, queries, ids, scores.low, params)
    shared = spark.sparkContext.broadcast((_only(queries, found), query_ids, scores.low, ids.low))
    return rows.mapInArrow(_selected(shared), "place long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, params: TopK = TopK()) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` largest integer inner products.

    Both frames are of the form of ``quantized``. A query meets all vectors of its length except those with its own id;
    with fewer than ``k`` of them all are returned. Ties go to the smaller id; rows that
    repeat an id count separately as candidates. Equal query rows are one query. Empty frames give no rows.
    Scores are exact below 2^62; a query and a vector with a larger inner product, either sign, stop the search with an
    ``OverflowError`` that names them, so no score ever wraps.

    What reaches the driver is bounded by the block: the queries, and per pass one bin for each. Executors send
    at most ``k`` bins of a query and batch. Queries beyond a block start a new round of passes.
    """
    rows = stage(vectors.select("id", "vector"), "vectors")
    queries = stage(queries.select("id", "vector").distinct(), "query-vectors")
    blocks = -(-queries.count() // params.block)
    results = []
    for number in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow()
        if own.num_rows:
            results.append(_search_block(rows, own, params).withColumn("block", F.lit(number)))
    if not results:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = results[0]
    for more in results[1:]:
        every = every.union(more)
    best = W.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    return (
        every.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= params.k)
        .select("query_id", "rank", "vec_id", "score")
    )
