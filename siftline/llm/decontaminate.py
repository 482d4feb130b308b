"""Benchmark decontamination by an FM-index per shard of training text.

The words of the benchmark are numbered; in the training text all other words become separators,
and runs shorter than the shortest window are left out, since no window can lie there. Each shard
of what remains gets an FM-index. All benchmark windows are searched backward in it at once,
their occurrences are located and merged into spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.fm_index import FmIndex
from siftline.llm.tokens import ALNUM, place, renamed, restored, slices, text_bytes, words
from siftline.session import stage

#: Occurrences located at once.
_BLOCK = 1 << 18


@dataclass(frozen=True)
class Decontamination:
    """Windows of ``window`` words; they are broadcast in blocks of about ``block`` windows (counted with one for each
    item that has it). A window of ten words takes some 100 bytes."""

    window: int = 10
    block: int = 1 << 19
    sample: int = 8


@dataclass(frozen=True)
class Windows:
    """Distinct windows: word numbers (right-aligned), lengths, and the items of window ``i``:
    ``items[bounds[i] : bounds[i + 1]]``, as places in ``names``."""

    vocabulary: np.ndarray
    phrases: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray
    items: np.ndarray
    names: pa.Array

    def named(self, windows: np.ndarray) -> set[str]:
        """The items of some windows."""
        if not len(windows):
            return set()
        own = np.concatenate([self.items[self.bounds[w] : self.bounds[w + 1]] for w in windows.tolist()])
        return set(self.names.take(pa.array(np.unique(own))).to_pylist())


def _item_windows(size: int):
    """The windows of each batch of items, each once for an item, as the hashes of their words."""

    def run(batches):
        for batch in slices(batches, "text", size=1 << 20):
            _, _, hashes, first = words(*text_bytes(batch.column("text")), ALNUM)
            counts = np.diff(first)
            n = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
            item = np.repeat(np.arange(batch.num_rows), n)
            begin = first[:-1][item] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            lengths = np.minimum(counts[item], size)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            at = np.repeat(begin - offsets[:-1], lengths) + np.arange(offsets[-1])
            windows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(item)), windows], ["item_id", "window"])

    return run


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """``window, items``: the distinct windows of ``items(item_id, text)`` with their items in order.

    Made in tasks; items without id, text or words have none.
    """
    usable = items.where("item_id is not null and text is not null")
    found = usable.mapInArrow(_item_windows(size), "item_id string, window array<long>")
    return found.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def windows_of(block: pa.Table, size: int) -> Windows:
    """One block of ``item_windows``, on the driver, without an object for each window."""
    window, items = block["window"].combine_chunks(), block["items"].combine_chunks()
    lengths = np.diff(window.offsets.to_numpy()).astype(np.int64)
    vocabulary, number = np.unique(window.flatten().to_numpy().view(np.uint64), return_inverse=True)
    row = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    phrases = np.zeros((len(lengths), size), np.int64)
    phrases[row, size - (ends[row] - np.arange(len(row)))] = number + 1
    bounds = np.concatenate([[0], np.cumsum(np.diff(items.offsets.to_numpy()))])
    coded = items.flatten().dictionary_encode()
    return Windows(vocabulary, phrases, lengths, bounds, coded.indices.to_numpy(), coded.dictionary)


def _numbered(hashes: np.ndarray, first: np.ndarray, bench: Windows) -> tuple[np.ndarray, np.ndarray]:
    """The text to index and the word that each of its places stands for."""
    at = np.minimum(np.searchsorted(bench.vocabulary, hashes), len(bench.vocabulary) - 1)
    number = np.where(bench.vocabulary[at] == hashes, at + 1, 0)
    # a gap before the first word of each text, and one after the last
    at = np.arange(len(number)) + np.repeat(np.arange(len(first) - 1), np.diff(first)) + 1
    spread = np.zeros(len(number) + len(first), np.int64)
    spread[at] = number
    word = np.full(len(spread), -1, np.int64)
    word[at] = np.arange(len(number))
    gaps = np.flatnonzero(spread == 0)
    sizes = np.diff(np.concatenate([gaps, [len(spread)]])) - 1  # words after each gap
    long = sizes >= bench.lengths.min()
    keep = np.repeat(long, sizes + 1)
    return np.append(spread[keep], 0), np.append(word[keep], -1)


def occurrences(hashes: np.ndarray, first: np.ndarray, bench: Windows, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Window numbers and first words of all occurrences."""
    none = np.zeros(0, np.int64)
    if not len(bench.lengths) or not len(hashes):
        return none, none
    text, word = _numbered(hashes, first, bench)
    present = np.zeros(len(bench.vocabulary) + 1, bool)
    present[text] = True
    wanted = np.flatnonzero((present[bench.phrases] | (bench.phrases == 0)).all(axis=1))
    if not len(wanted):
        return none, none
    index = FmIndex(text, len(bench.vocabulary) + 1, sample)
    low, high = index.search(bench.phrases[wanted], bench.lengths[wanted])
    counts = np.maximum(high - low, 0)
    ends = np.cumsum(counts)
    window, start = [], []
    for block in range(0, int(ends[-1]), _BLOCK):
        row = np.arange(block, min(block + _BLOCK, int(ends[-1])))
        which = np.searchsorted(ends, row, side="right")
        window.append(wanted[which])
        start.append(word[index.locate(low[which] + row - (ends - counts)[which])])
    return (np.concatenate(window), np.concatenate(start)) if window else (none, none)


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans that cover the same words, in order; touching spans become one."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.concatenate([[True], begin[1:] > reach[:-1]])[: len(begin)]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(begin)) - 1 if len(heads) else heads
    return begin[heads], reach[tails]


def _search(shared, sample: int, last: bool, cut: str | None):
    def run(batches):
        bench = shared.value
        for batch in slices(batches, "__text"):
            buffer, offsets = text_bytes(batch.column("__text"))
            starts, ends, hashes, first = words(buffer, offsets, ALNUM)
            window, begin = occurrences(hashes, first, bench, sample)
            doc = np.searchsorted(first, begin, side="right") - 1
            order = np.argsort(doc, kind="stable")
            window, begin, doc = window[order], begin[order], doc[order]
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            finish = begin + bench.lengths[window]
            earlier = batch.column("__spans").to_pylist(), batch.column("__items").to_pylist()
            spans, items, hits, texts = [], [], [], []
            for i in range(batch.num_rows):
                a, b = bounds[i], bounds[i + 1]
                old = np.array([(x["first"], x["end"]) for x in earlier[0][i]], np.int64).reshape(-1, 2)
                if a == b and not len(old):
                    merged = (begin[:0], begin[:0])
                else:
                    merged = _merged(
                        np.concatenate([begin[a:b] - first[i], old[:, 0]]),
                        np.concatenate([finish[a:b] - first[i], old[:, 1]]),
                    )
                spans.append([{"first": x, "end": y} for x, y in zip(merged[0].tolist(), merged[1].tolist())])
                named = bench.named(np.unique(window[a:b]))
                items.append(sorted(named | set(earlier[1][i])))
                hits.append(int((merged[1] - merged[0]).sum()))
                if cut:
                    at, parts = offsets[i], []
                    for x, y in zip((merged[0] + first[i]).tolist(), (merged[1] + first[i]).tolist()):
                        parts.append(buffer[at : starts[x]])
                        at = ends[y - 1]
                    parts.append(buffer[at : offsets[i + 1]])
                    texts.append(b"".join(p.tobytes() for p in parts) if len(spans[-1]) else None)
            found = {
                "__spans": pa.array(spans, pa.list_(pa.struct({"first": pa.int64(), "end": pa.int64()}))),
                "__items": pa.array(items, pa.list_(pa.string())),
            }
            if last:
                found["__n_words"] = pa.array(np.diff(first), pa.int64())
                found["__n_hit"] = pa.array(hits, pa.int64())
                if cut:
                    found["__clean"] = pa.array(texts, pa.binary()).cast(pa.string())
            keep = [f for f in batch.schema.names if f not in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(f)) for f in keep), *found.values()], [*keep, *found]
            )

    return run


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    params: Decontamination = Decontamination(),
    cut: bool = False,
    text: str = "text",
) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, with ``__n_words``, ``__n_hit``, ``__spans`` and ``__items``.

    ``__spans`` are the merged runs of hit words (``first``, ``end`` exclusive), ``__items`` the ids (as text, in
    order) of the items with an occurring window. With ``cut``, ``__clean`` is the text without its hit
    words (from the first to the last byte of each span), null where nothing was hit.

    A-Z count as a-z; words are runs of ASCII letters, digits and characters beyond ASCII. An item shorter than a
    window is one window. Null and empty texts have no words. Items without id or words take no part; rows
    with the same id are one item. Repeated rows of ``docs`` are judged separately.

    The windows are made in tasks and go to the executors in blocks of bounded size, one search pass after the other in
    the same stage; there is one block unless they exceed ``block``. A block is all that the driver holds.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = stage(item_windows(items, params.window), "benchmark-windows")
    total = windows.agg(F.sum(F.size("items") + 1)).first()[0] or 0
    blocks = max(1, math.ceil(total / params.block))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    spans = T.ArrayType(T.StructType().add("first", "long").add("end", "long"))
    rows = docs.select(
        *keep,
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"),
        F.array().cast(spans).alias("__spans"),
        F.array().cast("array<string>").alias("__items"),
    )
    for block in range(blocks):
        last = block == blocks - 1
        own = windows.where(F.col("block") == block).select("window", "items").toArrow()
        shared = spark.sparkContext.broadcast(windows_of(own, params.window))
        fields = [f for f in rows.schema.fields if f.name not in ("__spans", "__items")]
        schema = T.StructType(fields).add("__spans", spans).add("__items", T.ArrayType(T.StringType()))
        if last:
            schema = schema.add("__n_words", "long").add("__n_hit", "long")
            if cut:
                schema = schema.add("__clean", "string")
        rows = rows.mapInArrow(_search(shared, params.sample, last, cut and last), schema)
    return rows.drop("__text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: Decontamination = Decontamination()) -> DataFrame:
    """``docs`` with the benchmark's passages cut out of ``text``; other columns and rows stay as they are."""
    rows, text = renamed(docs), place(docs, "text")
    found = find(rows, benchmark, rows.columns, params, cut=True, text=text)
    return restored(found.withColumn(text, F.coalesce("__clean", text)), docs)
