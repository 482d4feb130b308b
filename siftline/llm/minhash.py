"""Near-duplicate documents by b-bit MinHash.

One pass computes the minima of every distinct shingle set. Bands of minima give
candidates; of each minimum only the lowest ``b`` bits are kept, packed into 64-bit
words (one word list per bit), and the similarity of a candidate pair is estimated from
bit counts and corrected for chance agreement of the kept bits. Pairs that
may reach the threshold are confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.components import connected_components
from siftline.llm.tokens import BLANK, mix, place, renamed, restored, slices, text_bytes, unique_per_text, windows, words
from siftline.session import stage


@dataclass(frozen=True)
class MinHash:
    """``bands`` bands of ``rows`` minima; ``bits`` bits of ``kept`` minima are kept for estimates.

    A pair at exactly ``percent`` = 80 shares no band with probability
    (1 - 0.8^6)^40 = 5e-6. ``sigmas`` is the distance, in standard errors of the
    estimate, below the threshold up to which candidates are still confirmed: with five, a pair at the threshold
    is overlooked with probability 3e-7.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    bits: int = 4
    kept: int = 480
    sigmas: float = 5.0

    def __post_init__(self):
        if self.kept < self.bands * self.rows:
            raise ValueError("kept minima must cover the bands")

    @property
    def longs(self) -> int:
        return -(-self.kept // 64)

    def most_mismatches(self) -> int:
        """Unequal kept values up to which a pair may still reach the threshold."""
        chance = 2.0**-self.bits
        j = self.percent / 100
        agree = chance + (1 - chance) * j
        error = math.sqrt(agree * (1 - agree) / self.kept)
        return math.floor((1 - agree + self.sigmas * error) * self.kept)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, with offsets."""
    buffer, offsets = text_bytes(column)
    _, _, hashes, first = words(buffer, offsets, BLANK)
    return unique_per_text(*windows(hashes, first, size))


def set_keys(sets: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set: equal sets have equal keys."""
    keys = []
    for salt in (0x1234567, 0x7654321):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets ^ np.uint64(salt)), dtype=np.uint64)])
        keys.append((total[begin[1:]] - total[begin[:-1]]).view(np.int64))
    return keys[0], keys[1]


def _multipliers(n: int) -> np.ndarray:
    return (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minima(sets: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` minima of each set (rows); an empty set has the largest value everywhere."""
    out = np.full((len(begin) - 1, n), 0xFFFFFFFF, np.uint32)
    short = (sets >> np.uint64(32)).astype(np.uint32)
    factors = _multipliers(n)[:, None]
    for i, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
        for at in range(a, b, 2048):
            values = factors * short[None, at : min(at + 2048, b)]
            np.minimum(out[i], values.min(axis=1), out=out[i])
    return out


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(found), bands)).copy()
    for k in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + found[:, k : bands * rows : rows].astype(np.uint64))
    return keys.view(np.int64)


def packed(found: np.ndarray, bits: int, longs: int) -> np.ndarray:
    """Bit planes of the minima: ``longs`` words for the lowest bit, then for the next one."""
    planes = []
    for bit in range(bits):
        plane = np.zeros((len(found), longs * 64), np.uint8)
        plane[:, : found.shape[1]] = (found >> np.uint32(bit)) & np.uint32(1)
        planes.append(np.packbits(plane, axis=1, bitorder="little").view("<i8"))
    return np.concatenate(planes, axis=1) if planes else np.zeros((len(found), 0), np.int64)


def _lists(matrix: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(matrix).reshape(-1), pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), flat)


def _signatures(params: MinHash):
    def run(batches):
        for batch in slices(batches, "text"):
            sets, begin = shingle_sets(batch.column("text"), params.shingle)
            one, two = set_keys(sets, begin)
            found = minima(sets, begin, params.kept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(begin), pa.int64()),
                    pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()),
                    _lists(packed(found, params.bits, params.longs)),
                    _lists(band_keys(found, params.bands, params.rows)),
                    _lists(bitmaps(sets, begin)),
                ],
                ["doc_id", "n_shingles", "key1", "key2", "planes", "band_keys", "bitmap"],
            )

    return run


def _keys_only(size: int):
    def run(batches):
        for batch in slices(batches, "text"):
            sets, begin = shingle_sets(batch.column("text"), size)
            one, two = set_keys(sets, begin)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(begin), pa.int64()),
                    pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()),
                ],
                ["doc_id", "n_shingles", "key1", "key2"],
            )

    return run


def _confirmed(size: int, percent: int):
    def run(batches):
        for batch in slices(batches, "text_a", "text_b"):
            left, at = shingle_sets(batch.column("text_a"), size)
            right, bt = shingle_sets(batch.column("text_b"), size)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = left[at[i] : at[i + 1]], right[bt[i] : bt[i + 1]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


#: Words of the bitmap of a set.
BITMAP_LONGS = 16


def bitmaps(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One bit of each set's bitmap per shingle."""
    out = np.zeros((len(begin) - 1, BITMAP_LONGS * 64), np.uint8)
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    out[owner, (sets >> np.uint64(20)).astype(np.int64) % (BITMAP_LONGS * 64)] = 1
    return np.packbits(out, axis=1, bitorder="little").view("<i8")


def mismatches(left: Column, right: Column, params: MinHash) -> Column:
    """Number of kept values in which two packed signatures differ."""
    n = params.longs
    parts = [
        F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), [left[k * n + i].bitwiseXOR(right[k * n + i]) for k in range(params.bits)]))
        for i in range(n)
    ]
    return reduce(lambda x, y: x + y, parts)


def estimate(unequal: Column, params: MinHash) -> Column:
    """Similarity from the number of unequal kept values, corrected for chance agreement."""
    chance = 2.0**-params.bits
    return F.greatest(F.lit(0.0), ((1 - unequal / params.kept) - chance) / (1 - chance))


#: Column of ``_numbered``: the id of a row, one of its own for a row without doc_id.
_ROW = "__row_id"


def _numbered(docs: DataFrame, doc_id: str) -> tuple[DataFrame, int, int] | None:
    """``docs`` with ``_ROW``, and the first and last id given here; none if every row has a doc_id.

    The ids given lie above all others, so that a row with an id is kept rather than one without. Only rows without id
    are staged: their numbers have to stay.
    """
    own = docs.withColumn(_ROW, F.col(doc_id).cast("long"))
    without = own.where(F.col(_ROW).isNull())
    if without.isEmpty():
        return None
    without = stage(without.withColumn(_ROW, F.monotonically_increasing_id()), "rows-without-id")
    span = without.agg(F.max(_ROW)).first()[0] + 1
    low, high = own.agg(F.min(_ROW), F.max(_ROW)).first()
    base = 0 if high is None else high + 1
    if base + span > (1 << 63) - 1:
        base = low - span  # no room above: below all others
        if base < -(1 << 63):
            raise ValueError("doc_ids leave no room for numbers of rows without id")
    without = without.withColumn(_ROW, F.col(_ROW) + F.lit(base))
    return own.where(F.col(_ROW).isNotNull()).union(without), base, base + span - 1


def near_duplicates(docs: DataFrame, params: MinHash = MinHash()) -> DataFrame:
    """``_near_duplicates`` for tables with rows without doc_id as well: each of them is a document of its own.

    Such a row takes the component of its set, which is null if no row with an id is in it; of a component of such rows one
    is kept.
    """
    docs = docs.select("doc_id", "text")
    numbered = _numbered(docs, "doc_id")
    if numbered is None:
        return _near_duplicates(docs, params)
    rows, first, last = numbered
    found = _near_duplicates(rows.select(F.col(_ROW).alias("doc_id"), "text"), params)
    named = lambda c: F.when(~F.col(c).between(first, last), F.col(c))
    return found.select(named("doc_id").alias("doc_id"), "n_shingles", named("component_id").alias("component_id"), "kept")


def _near_duplicates(docs: DataFrame, params: MinHash) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    A document's set holds its distinct runs of ``shingle`` words (ASCII white space
    separates words, A-Z lower-cased); a shorter text is one run. Documents are linked
    when their sets overlap by ``percent`` or more; ``component_id`` is the smallest
    doc_id reachable over links.

    Null and empty texts have no set: they are linked with nothing and kept. Rows with
    the same doc_id are one document with the links of all its rows, and share its
    decision; no doc_id is null. Other columns are ignored.

    Equal sets become one class before anything is compared, so groups of copies
    cost one member. Bands give each class as partner the member of its bucket that meets most
    others in all buckets; a chain of three steps (most central partner, all such partners,
    all other members of a bucket) confirms only pairs that earlier steps left in
    different components. The last step compares in the join condition and returns a pair once, only if
    its estimate is near the threshold and bitmaps of the sets do not rule it out; no bucket is collected or cut.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = docs.mapInArrow(
        _signatures(params),
        "doc_id long, n_shingles long, key1 long, key2 long, planes array<long>, band_keys array<long>, bitmap array<long>",
    )
    classes = stage(
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("key1", "key2")
        .agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n_shingles", "planes", "band_keys", "bitmap"))),
        "classes",
    )
    # documents of several sets: rows with the same doc_id and different texts
    keyed = docs.mapInArrow(_keys_only(params.shingle), "doc_id long, n_shingles long, key1 long, key2 long")
    several = keyed.groupBy("doc_id").agg(F.min(F.struct("key1", "key2")).alias("x"), F.max(F.struct("key1", "key2")).alias("y"))
    several = stage(several.where("x != y").select("doc_id"), "several")
    same = None
    if not several.isEmpty():
        owned = keyed.where("n_shingles > 0").join(several, "doc_id", "left_semi").join(classes, ["key1", "key2"])
        owned = owned.groupBy("doc_id", "id").agg(F.count("*"))
        least = owned.groupBy("doc_id").agg(F.min("id").alias("a"))
        same = stage(owned.join(least, "doc_id").where("a != id").select("a", F.col("id").alias("b")).distinct(), "same-document")
    by_band = classes.select("id", F.explode("band_keys").alias("band_key"))
    shared = by_band.groupBy("band_key").agg(F.count("*").alias("n")).where("n > 1")
    members = stage(by_band.join(shared, "band_key"), "members")
    # the member that meets most others is likely the text that they were made from
    central = members.groupBy("id").agg(F.sum("n").alias("weight"))
    weighed = members.join(central, "id").select("band_key", "id", F.struct(-F.col("weight"), "id").alias("rank"))
    hubs = weighed.groupBy("band_key").agg(F.min("rank").alias("hub"))
    involved = members.select("id").distinct()
    texts = stage(docs.join(involved, docs.doc_id == involved.id, "left_semi"), "texts")
    sketches = ["n_shingles", "planes", "band_keys", "bitmap"]
    planes = stage(classes.join(involved, "id", "left_semi").select("id", *sketches), "planes")
    of = lambda s: planes.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in sketches[:2]))
    planes_a, planes_b = of("a"), of("b")
    likely = mismatches(F.col("planes_a"), F.col("planes_b"), params) <= params.most_mismatches()
    partners = stage(
        members.join(hubs, "band_key")
        .select(F.col("hub.id").alias("a"), F.col("id").alias("b"), "hub")
        .where("a != b")
        .distinct()
        .join(planes_a, "a")
        .join(planes_b, "b")
        .where(likely)
        .select("a", "b", "hub"),
        "partners",
    )
    labels = None  # class id -> component, for classes in a link

    def settle(pairs: DataFrame) -> None:
        nonlocal labels
        text_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        text_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        joined = pairs.join(text_a, "a").join(text_b, "b").select("a", "b", "text_a", "text_b")
        links = joined.mapInArrow(_confirmed(params.shingle, params.percent), "a long, b long").distinct()
        if labels is None:
            links = links if same is None else links.union(same)
            labels = stage(connected_components(links), "labels")
            return
        links = stage(links, "links")
        if links.isEmpty():
            return
        a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        merged = links.join(a, "a", "left").join(b, "b", "left")
        merged = merged.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        moved = stage(connected_components(merged), "moved")
        old = labels.union(
            moved.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
        )
        to = moved.select(F.col("node").alias("component"), F.col("component").alias("target"))
        labels = stage(
            old.join(to, "component", "left").select("node", F.coalesce("target", "component").alias("component")),
            "labels",
        )

    def apart(pairs: DataFrame) -> DataFrame:
        a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        joined = pairs.join(a, "a", "left").join(b, "b", "left")
        return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    nearest = partners.groupBy("b").agg(F.min("hub").alias("hub")).select(F.col("hub.id").alias("a"), "b")
    settle(nearest.select("a", "b"))
    settle(apart(partners.join(nearest, ["a", "b"], "left_anti")))
    named = labels.select(F.col("node").alias("id"), "component")
    placed = members.select("band_key", "id").join(named, "id", "left")
    placed = placed.select("band_key", "id", F.coalesce("component", "id").alias("component"))
    split = placed.groupBy("band_key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    placed = placed.join(split.where("x != y").select("band_key"), "band_key", "left_semi").join(planes, "id")
    placed = stage(placed, "placed")
    side = lambda s: placed.select(
        "band_key", *(F.col(c).alias(f"{c}_{s}") for c in ("component", *sketches)), F.col("id").alias(s)
    )
    # sets whose bitmaps differ in more bits than the sets may differ in shingles are no link
    apart_bits = reduce(
        lambda x, y: x + y, [F.bit_count(F.col("bitmap_a")[i].bitwiseXOR(F.col("bitmap_b")[i])) for i in range(BITMAP_LONGS)]
    )
    p = params.percent
    within = (100 + p) * apart_bits <= (100 - p) * (F.col("n_shingles_a") + F.col("n_shingles_b"))
    # a pair is reported by the first band that it shares
    equal = F.zip_with("band_keys_a", "band_keys_b", lambda x, y: x == y)
    once = F.array_position(equal, True) == F.array_position("band_keys_a", F.col("band_key"))
    others = side("a").join(side("b"), "band_key")
    others = others.where((F.col("component_a") < F.col("component_b")) & likely & within & once)
    others = others.select("a", "b").join(partners, ["a", "b"], "left_anti")
    others = others.join(partners.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    settle(others)

    named = labels.select(F.col("node").alias("id"), "component")
    owners = classes.select("key1", "key2", "id").join(named, "id", "left")
    owners = owners.select("key1", "key2", F.coalesce("component", "id").alias("component_id"))
    found = docs.mapInArrow(_keys_only(params.shingle), "doc_id long, n_shingles long, key1 long, key2 long")
    found = found.join(owners, ["key1", "key2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    found = found.select("doc_id", "n_shingles", component.alias("component_id"))
    if same is not None:  # a row without a set goes with the other rows of its document
        decided = found.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        found = found.join(decided, "doc_id", "left")
        found = found.select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, params: MinHash = MinHash()) -> DataFrame:
    """The rows of ``docs`` (all columns) that are kept; each row without doc_id is a document of its own."""
    rows, row, text = renamed(docs), place(docs, "doc_id"), place(docs, "text")
    numbered = _numbered(rows, row)
    if numbered is not None:
        rows, row = numbered[0], _ROW
    kept = _near_duplicates(rows.select(F.col(row).alias("doc_id"), F.col(text).alias("text")), params)
    gone = kept.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return restored(rows.join(gone, rows[row] == gone["__gone"], "left_anti"), docs)
