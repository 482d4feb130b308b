"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes. The counts of all training texts
are taken in Spark and frozen; the code length of a text in a language is then exact:
a byte seen in its longest known context costs ``-log2(count / (total + distinct))`` there,
a byte not seen pays the escape ``-log2(distinct / (total + distinct))`` and is coded in the next
shorter context, down to a uniform choice among all bytes. The language with the shortest code wins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.tokens import slices, text_bytes

UNDETERMINED = "und"
#: Text bytes scored at once; a longer text is a slice of its own.
SLICE = 1 << 19
#: Languages whose costs are tables of all nodes at the same time, and entries (bytes times languages) scored at once.
_TABLED = 64
_ENTRIES = 1 << 23


@dataclass(frozen=True)
class Ppm:
    """Contexts of up to ``order`` bytes.

    All counted strings are nodes of the tree. ``max_nodes``, if given, keeps only those with the highest
    counts of all languages together (a string's prefixes and suffixes count at least as often). The first ``dense``
    contexts have a table of 256 followers, which takes 1024 bytes each; followers of others are looked up in a sorted
    array. The broadcast costs take 12 bytes for each string of a language and each of its contexts, however many
    languages there are.
    """

    order: int = 3
    max_nodes: int | None = None
    dense: int = 65_536


def _grams(buffer: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` bytes that end at each byte, as one integer, and how many of them lie in the text."""
    place = np.arange(len(buffer)) - np.repeat(offsets[:-1], np.diff(offsets))
    value = np.zeros(len(buffer), np.int64)
    for back in range(size - 1, -1, -1):
        value <<= 8
        value[back:] |= buffer[: len(buffer) - back]
    length = np.minimum(place + 1, size)
    return value & ((np.int64(1) << (8 * length)) - 1), length


def _counts(order: int):
    """Counts of the byte strings of each batch of one language: only the longest string at each byte."""

    def run(batches):
        for batch in slices(batches, "text", size=2 * SLICE):
            buffer, offsets = text_bytes(batch.column("text"))
            languages = batch.column("lang").dictionary_encode()
            codes = np.repeat(languages.indices.to_numpy(zero_copy_only=False), np.diff(offsets))
            value, length = _grams(buffer, offsets, order + 1)
            key = value | (length.astype(np.int64) << (8 * (order + 1)))
            for code, name in enumerate(languages.dictionary.to_pylist()):
                found, n = np.unique(key[codes == code], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(n, pa.int64())],
                    ["lang", "key", "n"],
                )

    return run


def context_counts(docs: DataFrame, params: Ppm = Ppm()) -> DataFrame:
    """``lang, length, value, n``: occurrences of every byte string of up to ``order + 1`` bytes.

    A string is counted once for each byte it ends at; shorter strings are suffixes of the longest one.
    """
    if not 1 <= params.order <= 6:
        raise ValueError("order must be between 1 and 6")
    width = 8 * (params.order + 1)
    longest = (
        docs.where("lang is not null and text is not null")
        .select("lang", "text")
        .mapInArrow(_counts(params.order), "lang string, key long, n long")
        .groupBy("lang", "key")
        .agg(F.sum("n").alias("n"))
    )
    length = F.shiftright("key", width)
    each = longest.select("lang", "key", "n", F.explode(F.sequence(F.lit(1), length.cast("int"))).alias("length"))
    value = F.expr("key & (shiftleft(1L, length * 8) - 1L)")
    return each.groupBy("lang", "length", value.alias("value")).agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Tree:
    """Nodes are byte strings; ``child[node, byte]`` is the string with that byte added at its end (or -1). Contexts
    beyond that table have their followers in ``deep``: node ``first_deep + i`` is that with ``deep[i]`` = 256 * node + byte.

    Costs are kept by ``(node, language)`` for what a language has seen: ``seen`` is the code length of the string's last
    byte after the rest, ``left`` the cost of leaving the string as a context. Node 0 is the empty string.
    """

    languages: list[str]
    order: int
    child: np.ndarray
    nodes: int
    seen: tuple[np.ndarray, np.ndarray, np.ndarray]
    left: tuple[np.ndarray, np.ndarray, np.ndarray]
    deep: np.ndarray
    first_deep: int

    def tables(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Both costs by node and language of the range: NaN where nothing was seen, 0 to leave what is no context."""
        out = []
        for (node, lang, cost), empty in ((self.seen, np.nan), (self.left, 0)):
            own = (lang >= first) & (lang < last)
            out.append(np.full((self.nodes, last - first), empty, np.float32))
            out[-1][node[own], lang[own] - first] = cost[own]
        return out[0], out[1]

    @cached_property
    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        return self.tables(0, len(self.languages))

    @property
    def known(self) -> np.ndarray:
        return self.whole[0]

    def follow(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node of each string with a byte added, -1 if there is none; -1 stays."""
        table = len(self.child)
        if not len(self.deep):
            known = (node >= 0) & (node < table)
            return np.where(known, self.child[np.where(known, node, 0), byte], -1)
        out = np.full(len(node), -1, np.int32)
        near = np.flatnonzero((node >= 0) & (node < table))
        out[near] = self.child[node[near], byte[near]]
        far = np.flatnonzero(node >= table)
        key = (node[far].astype(np.int64) << 8) | byte[far]
        at = np.minimum(np.searchsorted(self.deep, key), len(self.deep) - 1)
        out[far] = np.where(self.deep[at] == key, self.first_deep + at, -1)
        return out


def fit(docs: DataFrame, params: Ppm = Ppm()) -> Tree:
    """The frozen tree of ``docs(text, lang)``; rows without text or language teach nothing.

    Any number of languages; memory grows with the strings that each of them has. Without training rows the tree has no
    language.
    """
    counts = context_counts(docs, params)
    nodes = counts.groupBy("length", "value").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by_lang")
    )
    if params.max_nodes is not None:
        nodes = nodes.orderBy(F.desc("total"), "length", "value").limit(params.max_nodes)
    nodes = (
        nodes.select(F.col("length").cast("long").alias("length"), "value", "by_lang")
        .toArrow()
        .sort_by([("length", "ascending"), ("value", "ascending")])
        .combine_chunks()
    )
    length, value = nodes["length"].to_numpy(), nodes["value"].to_numpy()
    by_lang = nodes["by_lang"].combine_chunks()
    names, n = by_lang.flatten().flatten()
    coded = names.dictionary_encode()
    spelt = coded.dictionary.to_pylist()
    languages = sorted(spelt)
    place = {name: i for i, name in enumerate(languages)}
    lang = np.array([place[name] for name in spelt], np.int64)[coded.indices.to_numpy()]
    owner = np.repeat(np.arange(1, len(nodes) + 1), np.diff(by_lang.offsets.to_numpy()))
    contexts = 1 + int((length <= params.order).sum())  # longest strings are no contexts
    table = max(1, min(contexts, params.dense))
    child = np.full((table, 256), -1, np.int32)
    parent = np.zeros(len(nodes) + 1, np.int64)
    for size in range(1, params.order + 2):
        own = np.flatnonzero(length == size)
        above = np.flatnonzero(length == size - 1)
        if size > 1 and len(own):
            parent[own + 1] = above[np.searchsorted(value[above], value[own] >> 8)] + 1
    near = np.flatnonzero(parent[1:] < table)
    child[parent[near + 1], value[near] & 255] = near + 1
    # nodes are in order of their parents
    first_deep = len(near) + 1
    deep = (parent[first_deep:] << 8) | (value[first_deep - 1 :] & 255)
    count = n.to_numpy().astype(np.float64)
    context, own = np.unique(parent[owner] * max(1, len(languages)) + lang, return_inverse=True)
    distinct = np.bincount(own, minlength=len(context)).astype(np.float64)
    all_ = np.bincount(own, count, len(context)) + distinct
    seen = _costs(owner, lang, np.log2(all_[own] / count))
    left = _costs(context // max(1, len(languages)), context % max(1, len(languages)), np.log2(all_ / distinct))
    return Tree(languages, params.order, child, len(nodes) + 1, seen, left, deep, first_deep)


def _costs(node: np.ndarray, lang: np.ndarray, cost: np.ndarray):
    return node.astype(np.int32), lang.astype(np.int32), cost.astype(np.float32)


def code_lengths(buffer: np.ndarray, offsets: np.ndarray, tree: Tree) -> np.ndarray:
    """Bits of each text (rows) in each language, every byte in its longest known context.

    Languages are scored in blocks, so that the arrays stay bounded by the slice, not by the number of languages.
    """
    n, width = len(buffer), len(tree.languages)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    node = np.zeros(n, np.int32)  # the string of the order's length before each byte
    path = []  # for each order: is there a context, which one, and the string with the byte added
    for order in range(tree.order + 1):
        fits = place >= order
        at = tree.follow(np.where(fits, node, -1), buffer)
        path.append((fits & (node >= 0), np.where(fits & (node >= 0), node, 0), at))
        node = np.full(n, -1, np.int32)  # before the next byte: this string, one byte longer
        node[1:] = at[:-1]
    out = np.zeros((len(offsets) - 1, width))
    step = max(1, min(_TABLED, _ENTRIES // max(1, n)))
    for tabled in range(0, width, _TABLED):
        upper = min(tabled + _TABLED, width)
        known, escape = tree.whole if width <= _TABLED else tree.tables(tabled, upper)
        for first in range(0, upper - tabled, step):
            last = min(first + step, upper - tabled)
            bits = _bits(path, known[:, first:last], escape[:, first:last])
            sums = np.concatenate([np.zeros((1, last - first)), np.cumsum(bits, axis=0, dtype=np.float64)])
            out[:, tabled + first : tabled + last] = sums[offsets[1:]] - sums[offsets[:-1]]
    return out


def _bits(path, known: np.ndarray, escape: np.ndarray) -> np.ndarray:
    """Bits of each byte in each language of the tables."""
    bits = np.full((len(path[0][0]), known.shape[1]), 8.0, np.float32)  # no context left: all bytes are alike
    for fits, context, at in path:
        cost = known[at]
        escaped = bits + escape[context] * fits[:, None]
        bits = np.where((at >= 0)[:, None] & ~np.isnan(cost), cost, escaped)
    return bits


def _predict(shared, outputs):
    def run(batches):
        tree = shared.value
        for batch in slices(batches, "__text", size=SLICE):
            buffer, offsets = text_bytes(batch.column("__text"))
            choice = np.full(batch.num_rows, -1)
            score = np.zeros(batch.num_rows)
            if tree.languages:
                bits = code_lengths(buffer, offsets, tree)
                choice = bits.argmin(axis=1)
                score = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
            letters = batch.column("__letters").to_numpy(zero_copy_only=False).astype(bool)
            names = [tree.languages[c] if ok and c >= 0 else UNDETERMINED for c, ok in zip(choice.tolist(), letters)]
            found = {
                "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(np.where(letters & (choice >= 0), score, 0.0)),
            }
            keep = [f for f in batch.schema.names if not f.startswith("__")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(f)) for f in keep), *(found[f] for f in outputs)],
                [*keep, *outputs],
            )

    return run


def identify(docs: DataFrame, tree: Tree, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, ``lang_pred`` and ``score`` (posterior of the choice with equal priors).

    A null text, one without any letter, or a tree without languages gives ``und`` and 0. Equal code lengths go
    to the language first in order. Only ``keep`` columns are carried, so other columns may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    rows = docs.select(
        *keep,
        F.coalesce(F.col(text), F.lit("")).alias("__text"),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letters"),
    )
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(_predict(shared, ["lang_pred", "score"]), schema)
