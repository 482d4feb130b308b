"""Bytes, words and shingles of Arrow text columns, as flat numpy arrays.

Texts stay UTF-8 bytes: every word boundary used here is an ASCII byte, so byte and
character words agree. Words become 64-bit hashes; all arrays cover a slice of a
batch, with offsets that say where each text begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes handled at once in a task; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20

U64 = np.uint64


def crc_remainder(id_column: str, divisor: int) -> Column:
    """``crc32`` of an id as text, modulo ``divisor``; a null id counts as empty text."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(F.encode(text, "utf-8")), F.lit(divisor))


def renamed(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named ``c0``, ``c1`` and so on, so that no column clashes with one that is added."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their names, from rows that came out of ``renamed``."""
    return rows.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)))


def place(docs: DataFrame, name: str) -> str:
    """The name of a column in ``renamed``."""
    return f"c{docs.columns.index(name)}"


def slices(
    batches: Iterator[pa.RecordBatch], *text_columns: str, size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of a slice stay below ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.zeros(batch.num_rows, np.int64)
        for name in text_columns:
            length = pc.fill_null(pc.binary_length(batch.column(name)), 0)
            sizes += length.to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, 0
        for i, here in enumerate(sizes.tolist()):
            if total + here > size and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += here
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_table(separators: Iterator[int], lower: bool = True) -> np.ndarray:
    """A 64-bit value per byte: 0 for separators, equal for A-Z and a-z if ``lower``."""
    table = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    if lower:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    table[list(separators)] = 0
    return table


#: Words between ASCII white space.
BLANK = byte_table([0x20, *range(0x09, 0x0E)])
#: Words of ASCII letters, digits and all characters beyond ASCII.
ALNUM = byte_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, SLICE_BYTES // 4), base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def words(buffer: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Start, end and hash of every word, and for each text where its words begin (with one end entry)."""
    values = table[buffer]
    inside = values != 0
    before = np.zeros(len(buffer) + 1, bool)
    before[1:] = inside
    cuts = offsets[:-1][np.diff(offsets) > 0]
    before[cuts] = False  # a text begins
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(buffer) + 1, bool)
    after[:-1] = inside
    after[cuts] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    if len(starts):
        power, inverse = _power_tables(len(buffer) + 1)
        hashes = mix(np.add.reduceat(values * power[: len(buffer)], starts) * inverse[starts])
    else:
        hashes = np.zeros(0, U64)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, first: np.ndarray, size: int):
    """Hashes of runs of ``size`` words of one text, and where each text's runs begin.

    A text with fewer words, but not none, gives its whole sequence as one run.
    """
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(runs)])
    at = np.repeat(first[:-1] - begin[:-1], runs) + np.arange(begin[-1])
    last = np.repeat(first[1:], runs)
    out = np.zeros(begin[-1], U64)
    for k in range(size):
        here = at + k
        there = here < last
        step = np.where(there, hashes[np.minimum(here, max(len(hashes) - 1, 0))], U64(0)) if len(hashes) else out
        out = mix(out * U64(0x9E3779B97F4A7C15) + step + U64(k + 1))
    return out, begin


def unique_per_text(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and where each text's values begin."""
    parts = [np.unique(values[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)])
