"""Target-distribution importance resampling over hashed n-grams.

Every document's runs of one to three words fall into buckets by hash. A bucket's gain is the logarithm of how much more often it
occurs in the target than in the documents; a document's weight is the sum of its gains, and Gumbel noise on the weights turns the
highest scores into a sample without replacement.

Tasks intern the n-grams of a slice of texts in an open-addressed table: xxhash64 keys, verified byte by byte, with a bucket and a
count in each slot. A bucket is computed once for each distinct n-gram; counts go by slot, and gains are gathered by the slots of
the occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.tokens import ALNUM, slices, text_bytes
from siftline.operators.numbering import running_total
from siftline.session import prepare, stage

U64 = np.uint64
RESULT = ("n_words", "n_features", "weight", "score", "rank")

#: Text bytes interned at once; a longer text is a slice of its own.
TABLE_BYTES = 1 << 18

# The constants of xxHash64 (fixed values).
_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
P1, P2, P3, P4, P5 = map(U64, _PRIMES)
_STATE = [U64(x % 2**64) for x in (_PRIMES[0] + _PRIMES[1], _PRIMES[1], 0, -_PRIMES[0])]


def _crc_tables() -> np.ndarray:
    """Row k: what crc32 becomes of a byte that k zero bytes follow."""
    tables = np.zeros((8, 256), np.uint32)
    tables[0] = np.arange(256)
    for _ in range(8):
        odd = (tables[0] & 1).astype(bool)
        tables[0] = np.where(odd, (tables[0] >> 1) ^ np.uint32(0xEDB88320), tables[0] >> 1)
    for k in range(1, 8):
        tables[k] = (tables[k - 1] >> 8) ^ tables[0][tables[k - 1] & 255]
    return tables


_CRC = _crc_tables()


@dataclass(frozen=True)
class Resampling:
    """Documents of ``least_words`` words at least take part; ``percent`` of them are drawn."""

    buckets: int = 10_000
    longest: int = 3
    percent: int = 5
    least_words: int = 20
    seed: str = "42"


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _lane(x: np.ndarray) -> np.ndarray:
    return _rotated(x * P2, 31) * P1


class Bytes:
    """A buffer that can be read as little-endian integers at any place; eight zero bytes follow its end."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        n = len(data)
        self.eight = np.ndarray((n + 1,), "<u8", self.data, strides=(1,))
        self.four = np.ndarray((n + 1,), "<u4", self.data, strides=(1,))

    def xxhash64(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """xxHash64 (seed 0) of the strings that begin at ``at``."""
        h = np.full(len(at), P5, U64)
        at, left = at.copy(), size.copy()
        long = np.flatnonzero(size >= 32)
        if len(long):
            place, stripes = at[long], size[long] // 32
            state = [np.full(len(long), x, U64) for x in _STATE]
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                for i in range(4):
                    state[i][on] = _rotated(state[i][on] + self.eight[place[on] + 32 * k + 8 * i] * P2, 31) * P1
            total = _rotated(state[0], 1) + _rotated(state[1], 7) + _rotated(state[2], 12) + _rotated(state[3], 18)
            for v in state:
                total = (total ^ _lane(v)) * P1 + P4
            h[long] = total
            at[long] += 32 * stripes
            left[long] -= 32 * stripes
        h += size.astype(U64)
        for _ in range(3):
            on = np.flatnonzero(left >= 8)
            if not len(on):
                break
            h[on] = _rotated(h[on] ^ _lane(self.eight[at[on]]), 27) * P1 + P4
            at[on] += 8
            left[on] -= 8
        on = np.flatnonzero(left >= 4)
        if len(on):
            h[on] = _rotated(h[on] ^ (self.four[at[on]].astype(U64) * P1), 23) * P2 + P3
            at[on] += 4
            left[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(left > 0)
            if not len(on):
                break
            h[on] = _rotated(h[on] ^ (self.data[at[on]].astype(U64) * P5), 11) * P1
            at[on] += 1
            left[on] -= 1
        h = (h ^ (h >> U64(33))) * P2
        h = (h ^ (h >> U64(29))) * P3
        return h ^ (h >> U64(32))

    def crc32(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """crc32 of the strings that begin at ``at``."""
        crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
        at, left = at.copy(), size.copy()
        for step, read in ((8, self.eight), (4, self.four), (1, self.data)):
            on = np.flatnonzero(left >= step)
            while len(on):
                x = read[at[on]] ^ crc[on]
                now = _CRC[step - 1][x & read.dtype.type(255)]
                for k in range(1, step):
                    now ^= _CRC[step - 1 - k][(x >> read.dtype.type(8 * k)) & read.dtype.type(255)]
                crc[on] = now if step > 1 else _CRC[0][x & 255] ^ (crc[on] >> 8)
                at[on] += step
                left[on] -= step
                on = on[left[on] >= step]
        return ~crc

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the strings of the same size at ``a`` and ``b`` agree in every byte."""
        out, rest = np.ones(len(a), bool), np.arange(len(a))
        for k in range(0, int(size.max()) if len(size) else 0, 8):
            differ = self.eight[a[rest] + k] ^ self.eight[b[rest] + k]
            spare = np.maximum(k + 8 - size[rest], 0).astype(U64)  # bytes of the last eight beyond the string
            same = (differ << (spare * U64(8))) == 0
            out[rest[~same]] = False
            rest = rest[same & (size[rest] > k + 8)]
            if not len(rest):
                break
        return out


class Table:
    """Distinct strings of a buffer, by open addressing with linear probing; at most half of the slots are taken."""

    def __init__(self, text: Bytes, at: np.ndarray, size: np.ndarray, keys: np.ndarray, buckets: int):
        slots = 1 << max(4, int(2 * len(at)).bit_length())
        held = np.full(slots, -1, np.int64)  # the occurrence that a slot holds
        self.slot = (keys & U64(slots - 1)).astype(np.int64)  # of each occurrence
        waiting = np.arange(len(at))
        while len(waiting):
            here = self.slot[waiting]
            owner = held[here]
            free = np.flatnonzero(owner < 0)
            held[here[free]] = waiting[free]
            owner = held[here]
            found = owner == waiting
            alike = np.flatnonzero(~found & (keys[owner] == keys[waiting]) & (size[owner] == size[waiting]))
            a, b = owner[alike], waiting[alike]
            found[alike] = text.equal(at[a], at[b], size[b])
            waiting = waiting[~found]
            self.slot[waiting] = (self.slot[waiting] + 1) & (slots - 1)
        taken = np.flatnonzero(held >= 0)
        self.count = np.bincount(self.slot, minlength=slots)
        self.bucket = np.zeros(slots, np.int64)
        own = held[taken]
        self.bucket[taken] = text.crc32(at[own], size[own]) % np.uint32(buckets)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def joined_words(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-case words with single spaces between, their starts and ends there, and where each text's words begin."""
    inside = ALNUM[buffer] != 0
    before = np.zeros(len(buffer), bool)
    before[1:] = inside[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    before[begins] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(buffer), bool)
    after[:-1] = inside[1:]
    after[begins[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after)
    kept = inside | before  # a word and the byte behind it
    place = np.cumsum(kept) - 1
    text = np.where(inside, _LOWER[buffer], np.uint8(0x20))[kept]
    return text, place[starts], place[ends] + 1, np.searchsorted(starts, offsets)


def interned(column: pa.Array, params: Resampling):
    """The texts' numbers of words, and for each length of run its table and where each text's occurrences begin.

    The tables are made one at a time, when they are asked for, so that only one is held.
    """
    data, starts, ends, first = joined_words(*text_bytes(column))
    words, text = np.diff(first), Bytes(data)

    def tables():
        for length in range(1, params.longest + 1):
            runs = np.maximum(words - (length - 1), 0)
            begin = np.concatenate([[0], np.cumsum(runs)])
            at = np.repeat(first[:-1] - begin[:-1], runs) + np.arange(begin[-1])
            place = starts[at]
            size = ends[at + length - 1] - place
            yield Table(text, place, size, text.xxhash64(place, size), params.buckets), begin

    return words, tables()


def _count(params: Resampling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(params.buckets, np.int64)
        for batch in slices(batches, "text", size=TABLE_BYTES):
            for table, _ in interned(batch.column("text"), params)[1]:
                counts += np.bincount(table.bucket, table.count, params.buckets).astype(np.int64)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, params: Resampling = Resampling()) -> np.ndarray:
    """How many n-grams of all ``texts(text)`` fall into each bucket. A task sends one row for each bucket."""
    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_count(params), "bucket int, n long")
    counts = np.zeros(params.buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # as many rows as buckets
        counts[row.bucket] = row.n
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm by which each bucket is likelier in ``target`` than in ``raw``, rounded down."""
    n = len(raw)
    above = (target + 1).astype(float) * float(raw.sum() + n)
    below = (raw + 1).astype(float) * float(target.sum() + n)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def _weigh(params: Resampling, gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", size=TABLE_BYTES):
            words, tables = interned(batch.column("text"), params)
            weight, features = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for table, begin in tables:
                total = np.concatenate([[0], np.cumsum(gain[table.bucket][table.slot])])
                weight += total[begin[1:]] - total[begin[:-1]]
                features += np.diff(begin)
            kept = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(words), pa.array(features), pa.array(weight)],
                [*kept, "n_words", "n_features", "weight"],
            )

    return run


def weigh(docs: DataFrame, gain: np.ndarray, params: Resampling = Resampling(), keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs(doc_id, text)``, and ``n_words, n_features, weight, score``.

    ``score`` is the weight plus noise that depends on the seed and doc_id alone. A null doc_id counts as empty text there, a null text
    has no words. A column of ``keep`` named like a result column is left out; other columns may have any name.
    """
    keep = [c for c in keep if c not in RESULT]
    digest = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashed = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((hashed + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    rows = docs.select(
        *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), noise.alias("noise"), F.col("text").cast("string").alias("text")
    )
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    found = rows.mapInArrow(_weigh(params, gain), kept + ", n_words long, n_features long, weight long")
    return found.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)),
        "n_words",
        "n_features",
        "weight",
        (F.col("weight") + F.col("noise")).alias("score"),
    )


def draw(weighed: DataFrame, params: Resampling = Resampling(), ties: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``weighed`` with ``rank``: 1, 2, 3 and so on for the highest scores among rows of enough words, null for the rest.

    Equal scores go in order of ``ties`` (null last), then of features and weight; rows equal in all of them are
    ranked in any order. Rows are placed by range and counted by partition; neither a task nor the driver sees all.
    """
    weighed = stage(weighed, "weighed")
    takes_part = F.col("n_words") >= params.least_words
    drawn = weighed.where(takes_part).count() * params.percent // 100
    order = ["_low", *(x for i in range(len(ties)) for x in (f"_none{i}", f"_tie{i}")), "n_features", "weight"]
    placed = weighed.where(takes_part).withColumns(
        {"_low": -F.col("score"), "_one": F.lit(1).cast("long")}
        | {f"_none{i}": F.col(c).isNull() for i, c in enumerate(ties)}
        | {f"_tie{i}": F.col(c) for i, c in enumerate(ties)}
    )
    placed = running_total(placed, order, "_one", "_before").withColumn("rank", F.col("_before") + 1)
    placed = placed.select(*weighed.columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    rest = weighed.where(~F.coalesce(takes_part, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return placed.union(rest)


def resample(
    docs: DataFrame, target: DataFrame, params: Resampling = Resampling(), keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with the columns ``keep``, and ``n_words, n_features, weight, score, rank``.

    Those with a rank are the sample that looks like ``target(text)``. Counts are taken over all rows of both tables. ``keep``
    must hold ``doc_id``; empty tables give no rows, an empty target gives every bucket the same count there.
    """
    prepare(docs.sparkSession)
    gain = gains(bucket_counts(docs, params), bucket_counts(target, params))
    return draw(weigh(docs, gain, params, keep), params)
