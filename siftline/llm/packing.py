"""Packing of documents into training sequences by vector best fit.

A sequence has a capacity for tokens, for pieces and for attention cost (the sum of the squared
piece lengths). Pieces are placed longest first; a piece goes to the open sequence that fits
under every constraint and has the best score: the largest weighted dot product of demand and residual,
or the smallest weighted norm of what would remain.

Pieces are dealt by hash into groups of a fixed expected size, each packed by one task.
"""

from __future__ import annotations

import functools
import json
import math
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.tokens import slices

#: The public pre-tokenisation pattern of the byte-level vocabulary (fixed value), with possessive repeats.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@dataclass(frozen=True)
class Packing:
    """Capacities of a sequence and how sequences are chosen.

    ``rule`` is ``"norm"`` or ``"dot"``; ``weights`` weigh tokens, pieces and attention cost, each as a share of its
    capacity. ``group_pieces`` is the number of pieces that one task packs together; every group may leave
    one sequence partly empty, 1 in some 30,000.
    """

    tokens: int = 1024
    pieces: int = 1024
    attention: int = 1024 * 1024
    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)
    end: int = 2
    group_pieces: int = 32_768

    def __post_init__(self):
        if self.rule not in ("norm", "dot"):
            raise ValueError("rule must be 'norm' or 'dot'")
        if self.tokens < 1 or self.pieces < 1 or self.attention < 1 or min(self.weights) < 0:
            raise ValueError("capacities must be positive and weights not negative")

    @property
    def longest(self) -> int:
        """The most tokens of a piece: it must fit an empty sequence."""
        return min(self.tokens, math.isqrt(self.attention))


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary: itself, or the next free code from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def encoder(content: str):
    """A function from text to the ids of a byte-level BPE vocabulary in the ``tokenizers`` file format.

    The same ids as ``Tokenizer.encode(text, add_special_tokens=False).ids``, by a faster library; the strings
    of special tokens in a text become these tokens, as they do there.
    """
    import tiktoken

    data = json.loads(content)
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in word): i for word, i in data["model"]["vocab"].items() if word not in special}
    own = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return own.encode(text, allowed_special="all")
        return own.encode_ordinary(text)

    return encode


def _cut(shared, params: Packing, with_ids: bool):
    def run(batches):
        encode = encoder(shared.value)
        for batch in slices(batches, "text"):
            columns = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32", "ids")}
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), params.end], "<u4")
                count = -(-len(ids) // params.longest)
                first = len(ids) - (count - 1) * params.longest
                for piece in range(count):
                    start = first + (piece - 1) * params.longest if piece else 0
                    part = ids[start : first + piece * params.longest]
                    content = part.tobytes()
                    values = (row, piece, start, len(part), zlib.crc32(content), content if with_ids else None)
                    for name, value in zip(columns, values):
                        columns[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(columns["row"], pa.int64())),
                    pa.array(columns["piece"], pa.int32()),
                    pa.array(columns["start"], pa.int64()),
                    pa.array(columns["length"], pa.int64()),
                    pa.array(columns["ids_crc32"], pa.int64()),
                    pa.array(columns["ids"], pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
            )

    return run


def pieces(docs: DataFrame, vocabulary: str, params: Packing = Packing(), with_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids`` of ``docs(doc_id, text)``.

    ``vocabulary`` is the path of a ``tokenizers`` file on the driver; its content (a few MB) is broadcast. A
    document is its ids and the end id; a null text is empty. Only documents longer than a sequence are cut, into
    full pieces; the first piece may be shorter. ``ids`` holds unsigned little-endian 32-bit ids, null unless
    ``with_ids``.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        _cut(shared, params, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    )


def best_fit(lengths: np.ndarray, params: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in the given order.

    Open sequences of equal residuals are one kind, so a placement compares kinds, and with tokens as the only
    binding capacity it is one search among the residual token counts.
    """
    full = (params.tokens, params.pieces, params.attention)
    w = [weight / cap**2 for weight, cap in zip(params.weights, full)]
    # one piece takes one token at least, and l tokens cost at most l * longest: then tokens bind first
    scalar = params.pieces >= params.tokens and params.attention >= params.tokens * params.longest
    scalar = scalar and params.rule == "norm" and params.weights[1:] == (0.0, 0.0)
    kinds: dict[tuple[int, int, int], list[int]] = {}
    residuals: list[int] = []  # distinct residual token counts, sorted (scalar case)
    place = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    opened = 0
    for i, length in enumerate(lengths.tolist()):
        need = (length, 1, length * length)
        best = None
        if scalar:
            at = bisect_left(residuals, length)
            best = (residuals[at], 0, 0) if at < len(residuals) else None
        else:
            score = None
            for kind in kinds:
                if all(n <= r for n, r in zip(need, kind)):
                    if params.rule == "dot":
                        value = -sum(f * n * r for f, n, r in zip(w, need, kind))
                    else:
                        value = sum(f * (r - n) ** 2 for f, n, r in zip(w, need, kind))
                    if score is None or (value, kind) < score:
                        score, best = (value, kind), kind
        if best is None:
            number, best = opened, full
            opened += 1
        else:
            number = kinds[best].pop()
            if not kinds[best]:
                del kinds[best]
                if scalar:
                    residuals.pop(at)
        place[i], offset[i] = number, params.tokens - best[0]
        left = (best[0] - length, 0, 0) if scalar else tuple(r - n for r, n in zip(best, need))
        if left[0] > 0 and (scalar or left[1] > 0 and left[2] > 0):
            if scalar and left not in kinds:
                insort(residuals, left[0])
            kinds.setdefault(left, []).append(number)
    return place, offset


def _pack(params: Packing):
    def run(key, group):
        group = group.sort_by([("length", "descending"), *((k, "ascending") for k in ("doc_id", "piece", "ids_crc32"))])
        number, offset = best_fit(group["length"].to_numpy(), params)
        group = group.append_column("sequence_id", pa.array((key[0].as_py() << 32) + number, pa.int64()))
        return group.append_column("offset", pa.array(offset, pa.int64())).drop_columns("pack_group")

    return run


def expected_pieces(docs: DataFrame, params: Packing = Packing()) -> int:
    """About how many pieces ``docs(text)`` is cut into, from the lengths of the texts: a token has four bytes or so."""
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0))
    cuts = F.sum(F.lit(1) + F.floor(size / (4 * params.tokens)))
    return docs.agg(F.coalesce(cuts, F.lit(0)).cast("long")).first()[0]


def pack(cut: DataFrame, params: Packing = Packing(), n_pieces: int | None = None) -> DataFrame:
    """``sequence_id`` and ``offset`` for every piece, by groups of pieces dealt out by hash.

    ``n_pieces`` is the number of pieces, or about (counted if not given); it sets the number of groups, to some
    ``group_pieces`` each, however few documents they are of. Equal rows are placed separately. Lengths must be between
    1 and ``params.longest``.
    """
    if n_pieces is None:
        n_pieces = cut.count()
    groups = max(1, math.ceil(n_pieces / params.group_pieces))
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    schema = cut.schema.add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy("pack_group").applyInArrow(_pack(params), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, lengths`` of each sequence: its ids in order, and the lengths of its pieces.

    A sequence holds at most ``Packing.tokens`` ids, so each group is small.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"])).alias("ids"),
        F.transform("parts", lambda part: part["length"]).alias("lengths"),
    )

