"""Repeated passages with edits: seeds of equal words, extended over edits and verified.

Of every ``window`` adjacent runs of ``seed`` words the one with the smallest hash is a seed, so two texts that have
``seed + window - 1`` words in a row in common share one. A seed points to its first occurrence; from there both texts are
compared word by word in both directions, also across edits, and what is joined over edits must overlap by ``percent``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.tokens import BLANK, slices, text_bytes, windows, words
from siftline.session import release, stage, staged_so_far

U64 = np.uint64


@dataclass(frozen=True)
class Passages:
    """Passages that overlap by 80 percent of their five-word shingles and hold an edit have 41 shingles or more, and a run
    of 23 equal words (each edit costs four shingles at least): with 12 and 12 they always share a seed.

    An edit replaces at most ``gap`` words by at most ``gap`` others; ``resume`` equal words end it. Longer insertions are
    text of their own and part two passages. ``margin`` words of the first occurrence are compared beyond the last seed.
    """

    seed: int = 12
    window: int = 12
    shingle: int = 5
    percent: int = 80
    gap: int = 10
    resume: int = 4
    margin: int = 48


def winnowed(runs: np.ndarray, begin: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest of every ``window`` adjacent values of a text (of all, if it has fewer)."""
    counts = np.diff(begin)
    owner = np.repeat(np.arange(len(counts)), counts)
    spot = np.arange(len(runs)) + owner * (window - 1)
    value = np.full(len(runs) + len(counts) * (window - 1), ~U64(0))
    value[spot] = runs
    at = spot[np.arange(len(runs)) - begin[:-1][owner] < np.maximum(counts - window + 1, 1)[owner]]
    starts = max(len(value) - window + 1, 0)
    best, offset = value[:starts].copy(), np.zeros(starts, np.int16)
    for k in range(1, window):
        here = value[k : k + starts]
        better = here < best
        np.copyto(best, here, where=better)
        np.copyto(offset, k, where=better)
    chosen = at + offset[at]
    mark = np.zeros(len(value), bool)
    mark[chosen] = True
    return np.flatnonzero(mark[spot])


def _seeds(params: Passages):
    def run(batches):
        for batch in slices(batches, "text"):
            buffer, offsets = text_bytes(batch.column("text"))
            _, _, hashes, first = words(buffer, offsets, BLANK)
            runs, begin = windows(hashes, first, params.seed)
            at = winnowed(runs, begin, params.window)
            owner = np.searchsorted(begin, at, side="right") - 1
            long = np.diff(first)[owner] >= params.seed
            at, owner = at[long], owner[long]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(runs[at].view(np.int64)),
                    batch.column("doc_id").take(pa.array(owner)),
                    pa.array(at - begin[owner], pa.int32()),
                ],
                ["hash", "doc", "word"],
            )

    return run


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(32)).astype(np.uint32)


def _lists(begin: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), values)


def _bounds(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins in ``flatten()``, with one end entry."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of every range, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _references(params: Passages):
    """The words of the first occurrence around the seeds of each pair of documents, as extents."""

    def run(batches):
        for batch in slices(batches, "text"):
            buffer, offsets = text_bytes(batch.column("text"))
            _, _, hashes, first = words(buffer, offsets, BLANK)
            own = _short(hashes).view(np.int32)
            seeds = batch.column("seeds")
            row = np.repeat(np.arange(batch.num_rows), np.diff(_bounds(seeds)))
            word, kept = (x.to_numpy() for x in seeds.flatten().flatten())
            size = np.diff(first)
            order = np.lexsort((kept, row))
            order = order[kept[order] + params.seed <= size[row[order]]]  # the others: another row of the same doc_id
            row, word, kept = row[order], word[order], kept[order]
            low = np.maximum(kept.astype(np.int64) - params.margin, 0)
            high = np.minimum(kept.astype(np.int64) + params.seed + params.margin, size[row])
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (low[1:] > high[:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(row))
            low, length = low[at], high[last - 1] - low[at]
            extents = pa.StructArray.from_arrays(
                [
                    pa.array(low, pa.int32()),
                    _lists(np.append(at, len(row)), pa.StructArray.from_arrays([pa.array(word), pa.array(kept)], ["word", "kept_word"])),
                    _lists(np.append(0, np.cumsum(length)), pa.array(own[_ranges(first[row[at]] + low, length)])),
                ],
                ["at", "seeds", "words"],
            )
            begin = np.searchsorted(row[at], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("kept_doc"), _lists(begin, extents)], ["doc", "kept_doc", "extents"]
            )

    return run


_EXTENTS_SPARK = "array<struct<at int, seeds array<struct<word int, kept_word int>>, words array<int>>>"


class _Pairs:
    """The words of all texts of a slice and of all extents they are compared with, each as one array.

    Points are places ``(i, j)`` in these arrays and the number ``e`` of their extent; ``low`` and ``high`` are the bounds of
    the extent and of its text.
    """

    def __init__(self, own: np.ndarray, other: np.ndarray, low: tuple, high: tuple, params: Passages):
        self.own, self.other, self.low, self.high, self.params = own, other, low, high, params
        self.own_twos, self.other_twos = _twos(own), _twos(other)

    def equal(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many words, ``most`` at most, are equal from each point on: forwards, or with ``step`` -1 backwards."""
        count = np.zeros(len(i), np.int64)
        active, width = np.flatnonzero(most > 0), 8
        while len(active):
            going = []
            for k in range(0, len(active), _POINTS * 8 // width):
                here = active[k : k + _POINTS * 8 // width]
                done, reach = count[here], np.arange(width)
                inside = done[:, None] + reach < most[here, None]
                x = (i[here] + step * done)[:, None] + step * reach
                y = (j[here] + step * done)[:, None] + step * reach
                same = inside & (self.own[np.where(inside, x, 0)] == self.other[np.where(inside, y, 0)])
                run = np.where(same.all(axis=1), width, same.argmin(axis=1))
                count[here] += run
                going.append(here[run == width])
            active, width = np.concatenate(going), min(4 * width, _POINTS * 8)
        return count

    def stretches(self, e: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The maximal equal stretch around each point: its first words and length."""
        back = self.equal(i - 1, j - 1, np.minimum(i - self.low[0][e], j - self.low[1][e]), -1)
        ahead = self.equal(i, j, np.minimum(self.high[0][e] - i, self.high[1][e] - j), 1)
        return i - back, j - back, back + ahead

    def resumed(self, e: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest edit from each point on after which both go on with equal words: whether there is one, and its sizes."""
        gap, last = self.params.gap, self.params.resume - 2
        twos_of = sorted({*range(0, last, 2), last})  # two words at a time: pair r are the words r and r + 1 from the point on
        edits = [(x, t - x) for t in range(1, 2 * gap + 1) for x in range(max(0, t - gap), min(t, gap) + 1)]
        reach = np.arange(gap + self.params.resume - 1)[:, None]
        best = np.full(len(i), -1, np.int16)
        for k in range(0, len(i), _POINTS):
            part = slice(k, k + _POINTS)
            sides = []
            for side, (place, twos) in enumerate(((i[part], self.own_twos), (j[part], self.other_twos))):
                left = self.high[side][e[part]] - place if step > 0 else place - self.low[side][e[part]]
                there = reach + 2 <= left
                at = place + reach if step > 0 else place - 2 - reach
                sides.append((twos[np.where(there, at, 0)], there))
            (a, in_a), (b, in_b) = sides
            found = best[part]
            for n in range(len(edits) - 1, -1, -1):  # the smallest is written last
                x, y = edits[n]
                hit = in_a[x + last] & in_b[y + last]
                for r in twos_of:
                    hit &= a[x + r] == b[y + r]
                np.copyto(found, n, where=hit)
        there = best >= 0
        x, y = np.array(edits).T[:, best]
        return there, x, y


#: Points handled at once.
_POINTS = 4096


def _twos(words: np.ndarray) -> np.ndarray:
    """Every two adjacent words as one number."""
    out = words.astype(U64)
    out[:-1] |= words[1:].astype(U64) << U64(32)
    return out if len(out) else np.zeros(1, U64)


def _seeded(pairs: _Pairs, e: np.ndarray, i: np.ndarray, j: np.ndarray):
    """``e, i, j, n``: the maximal equal stretches that seeds lie in, in the order of their first seeds."""
    seed = pairs.params.seed
    inside = (i >= pairs.low[0][e]) & (j >= pairs.low[1][e]) & (i + seed <= pairs.high[0][e]) & (j + seed <= pairs.high[1][e])
    e, i, j = e[inside], i[inside], j[inside]
    holds = pairs.equal(i, j, np.full(len(i), seed), 1) == seed  # the others: another row of the same doc_id
    e, i, j = e[holds], i[holds], j[holds]
    order = np.lexsort((i, j - i, e))
    e, i, j = e[order], i[order], j[order]
    # only up to the next seed on the same diagonal, so that no word is compared for every seed
    next_ = np.full(len(e), np.iinfo(np.int64).max)
    follows = (e[1:] == e[:-1]) & (j[1:] - i[1:] == j[:-1] - i[:-1])
    next_[:-1][follows] = (i[1:] - i[:-1])[follows]
    most = np.minimum(np.minimum(pairs.high[0][e] - i, pairs.high[1][e] - j), np.maximum(next_, seed))
    run = pairs.equal(i, j, most, 1)
    starts = np.ones(len(e), bool)
    starts[1:] = run[:-1] < next_[:-1]
    head = np.flatnonzero(starts)
    last = np.append(head[1:], len(e)) - 1
    order = np.lexsort((j[head], i[head], e[head])) if len(head) else head
    head, last = head[order], last[order]
    e, i, j, n = e[head], i[head], j[head], i[last] + run[last] - i[head]
    back = pairs.equal(i - 1, j - 1, np.minimum(i - pairs.low[0][e], j - pairs.low[1][e]), -1)
    return e, i - back, j - back, n + back


def _segments(pairs: _Pairs, e: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
    """``e, i, j, n``: maximal equal stretches that seeds and what follows edits lie in, by extent and place.

    From each stretch that seeds are in, in their order, edits are followed in both directions up to a stretch that is known.
    """
    e, i, j, n = _seeded(pairs, e, i, j)
    count = len(e)
    number = {key: k for k, key in enumerate(zip(e.tolist(), (j - i).tolist(), i.tolist()))}
    size, rows = count, [(e, i, j, n)]
    onward: list[dict[int, int]] = [{}, {}]
    for way, step in enumerate((1, -1)):
        ids, at, done = np.arange(count), (e, i, j, n), set(range(count))
        while len(ids):
            e1, i1, j1, n1 = at
            ends = (i1 + n1, j1 + n1) if step > 0 else (i1, j1)
            there, x, y = pairs.resumed(e1, *ends, step)
            less = 0 if step > 0 else 1
            e1, i1, j1 = e1[there], (ends[0] + step * x - less)[there], (ends[1] + step * y - less)[there]
            i1, j1, n1 = pairs.stretches(e1, i1, j1)
            fresh, further = [], []
            for k, (source, key) in enumerate(zip(ids[there].tolist(), zip(e1.tolist(), (j1 - i1).tolist(), i1.tolist()))):
                target = number.setdefault(key, len(number))
                if target == size:
                    fresh.append(k)
                    size += 1
                onward[way][source] = target
                if target not in done:
                    done.add(target)
                    further.append((k, target))
            rows.append((e1[fresh], i1[fresh], j1[fresh], n1[fresh]))
            ids, chosen = np.array([t for _, t in further], np.int64), [k for k, _ in further]
            at = (e1[chosen], i1[chosen], j1[chosen], n1[chosen])
    e, i, j, n = (np.concatenate(x) for x in zip(*rows))
    known = np.zeros(len(e), bool)
    known[:count] = True
    seen: set[int] = set()
    for start in sorted(onward[0].keys() | onward[1].keys()):
        if start >= count:
            break
        if start in seen:
            continue
        seen.add(start)
        for ahead in onward:
            k = ahead.get(start)
            while k is not None and k not in seen:
                seen.add(k)
                k = ahead.get(k)
    known[list(seen)] = True
    at = np.flatnonzero(known)
    at = at[np.lexsort((n[at], j[at], i[at], e[at]))]
    return e[at], i[at], j[at], n[at]


def _jaccard_holds(a: np.ndarray, b: np.ndarray, params: Passages) -> bool:
    x, y, size = a.tobytes(), b.tobytes(), 4 * params.shingle
    left = {x[i : i + size] for i in range(0, max(len(x) - size, 0) + 1, 4)}
    right = {y[i : i + size] for i in range(0, max(len(y) - size, 0) + 1, 4)}
    common = len(left & right)
    return 100 * common >= params.percent * (len(left) + len(right) - common)


def _chains(segments, params: Passages):
    """Segments that follow each other in both texts with at most ``gap`` words between them.

    They come by place. A segment goes on the oldest chain that it can; such a chain ends on a diagonal within ``gap``.
    """
    gap = params.gap
    chains: list[list[tuple[int, int, int]]] = []
    ending: dict[int, list[tuple[int, int, int, int]]] = {}  # by diagonal: chain, last segment's places, its end
    for i, j, n in segments:
        best, d, past = None, j - i, False
        for there in range(d - gap, d + gap + 1):
            for last in ending.get(there, ()):
                k, pi, pj, end = last
                if end + gap < i:
                    past = True
                elif pj < j and pi < i and (best is None or k < best[0]):
                    over = max(0, end - i, end + there - j)
                    if over < n and i + over - end <= gap and j + over - end - there <= gap:
                        best = k, over, there, last
            if past:
                ending[there] = [x for x in ending[there] if x[3] + gap >= i]
                past = False
        if best:
            k, over, there, last = best
            chains[k].append((i + over, j + over, n - over))
            ending[there].remove(last)
        else:
            k, over = len(chains), 0
            chains.append([(i, j, n)])
        ending.setdefault(d, []).append((k, i + over, j + over, i + n))
    return chains


def _chained(pairs: _Pairs, chain: list[tuple[int, int, int]]):
    """``(place, words, place of the other, edits)`` of the passages of a chain."""
    params = pairs.params
    p, less = params.percent, params.shingle - 1
    common = [0]
    for _, _, n in chain:
        common.append(common[-1] + max(0, n - less))
    upto = [(100 + p) * c - p * (i + j + 2 * n - 2 * less) for c, (i, j, n) in zip(common[1:], chain)]
    ahead = np.maximum.accumulate(np.array(upto)[::-1])  # largest of the last 1, 2, ... values
    k = 0
    while k < len(chain):
        i, j, n = chain[k]
        least = (100 + p) * common[k] - p * (i + j)
        last = len(chain) - 1 - int(np.searchsorted(ahead, least, side="left"))
        end, other = (chain[last][0] + chain[last][2], chain[last][1] + chain[last][2]) if last > k else (i + n, j + n)
        if last <= k or not _jaccard_holds(pairs.own[i:end], pairs.other[j:other], params):
            last, end = k, i + n
        if end - i >= params.seed:
            yield i, end - i, j, last - k
        k = last + 1


def repeats(pairs: _Pairs, e: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """``e, i, n, j, edits`` of the passages that texts have in common with the extents their seeds ``e, i, j`` point to."""
    params = pairs.params
    e, i, j, n = _segments(pairs, e, i, j)
    # a chain goes on within the gap, in its place and its diagonal: most segments are alone
    order = np.lexsort((j - i, e))
    first = np.ones(len(e), bool)
    first[1:] = (np.diff(e[order]) > 0) | (np.diff((j - i)[order]) > params.gap)
    near = np.zeros(len(e), np.int64)
    near[order] = np.cumsum(first)
    order = np.lexsort((n, j, i, near))
    e, i, j, n, near = e[order], i[order], j[order], n[order], near[order]
    at = near * (len(pairs.own) + params.gap + 1) + i
    first[1:] = at[1:] > np.maximum.accumulate(at + n)[:-1] + params.gap
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(e)))
    alone = begin[size == 1]
    alone = alone[n[alone] >= params.seed]
    found = []
    for b, count in zip(begin[size > 1].tolist(), size[size > 1].tolist()):
        part = slice(b, b + count)
        for chain in _chains(zip(i[part].tolist(), j[part].tolist(), n[part].tolist()), params):
            if len(chain) > 1:
                found += [(e[b], *x) for x in _chained(pairs, chain)]
            elif chain[0][2] >= params.seed:
                found.append((e[b], chain[0][0], chain[0][2], chain[0][1], 0))
    more = np.array(found, np.int64).reshape(-1, 5).T
    own = (e[alone], i[alone], n[alone], j[alone], np.zeros(len(alone), np.int64))
    return [np.concatenate(x) for x in zip(own, more)]


def _found(params: Passages):
    names = ["doc_id", "first_word", "n_words", "kept_doc_id", "kept_word", "edits"]

    def run(batches):
        for batch in slices(batches, "text"):
            buffer, offsets = text_bytes(batch.column("text"))
            _, _, hashes, first = words(buffer, offsets, BLANK)
            by_doc = batch.column("pairs")
            kept_doc, by_pair = by_doc.flatten().flatten()
            at, by_extent, other = by_pair.flatten().flatten()
            pair = np.repeat(np.arange(len(kept_doc)), np.diff(_bounds(by_pair)))
            row = np.repeat(np.arange(batch.num_rows), np.diff(_bounds(by_doc)))[pair]
            extent = np.repeat(np.arange(len(pair)), np.diff(_bounds(by_extent)))
            word, kept_word = (x.to_numpy().astype(np.int64) for x in by_extent.flatten().flatten())
            at, bounds = at.to_numpy().astype(np.int64), _bounds(other)
            pairs = _Pairs(_short(hashes), other.flatten().to_numpy().view(np.uint32), (first[row], bounds[:-1]), (first[row + 1], bounds[1:]), params)
            e, i, n, j, edits = repeats(pairs, extent, word + first[row[extent]], kept_word - at[extent] + bounds[extent])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row[e])),
                    pa.array(i - first[row[e]], pa.int32()),
                    pa.array(n, pa.int32()),
                    kept_doc.take(pa.array(pair[e])),
                    pa.array(j - bounds[e] + at[e], pa.int32()),
                    pa.array(edits, pa.int32()),
                ],
                names,
            )

    return run


def edited_passages(docs: DataFrame, params: Passages = Passages()) -> DataFrame:
    """``doc_id, first_word, n_words, kept_doc_id, kept_word, edits`` of passages of ``docs(doc_id, text)`` that occur before.

    ``docs`` has neither null ids nor null texts. Passages may overlap; each is given with the first occurrence of a
    seed in it. ``edits`` counts the places where the occurrences differ. Rows with the same doc_id may give a passage twice.
    """
    spark = docs.sparkSession
    mark = staged_so_far(spark)
    # a few bytes each; one sort brings the occurrences of a seed together, the first one in front
    seeds = docs.mapInArrow(_seeds(params), "hash long, doc long, word int")
    order = W.partitionBy("hash").orderBy("doc", "word").rowsBetween(W.unboundedPreceding, W.currentRow)
    heads = [F.first(name).over(order).alias(f"kept_{name}") for name in ("doc", "word")]
    pairs = (
        seeds.select("doc", "word", *heads)
        .where("doc != kept_doc or word != kept_word")
        .groupBy("doc", "kept_doc")
        .agg(F.collect_set(F.struct("word", "kept_word")).alias("seeds"))
    )
    pairs = stage(pairs, "seed-pairs")
    release(spark, mark, pairs)
    # both joins take the texts by doc_id, from one shuffle
    extents = pairs.join(docs, pairs.kept_doc == docs.doc_id).select("doc", "kept_doc", "text", "seeds")
    extents = extents.mapInArrow(_references(params), f"doc long, kept_doc long, extents {_EXTENTS_SPARK}")
    by_doc = extents.groupBy("doc").agg(F.collect_list(F.struct("kept_doc", "extents")).alias("pairs"))
    rows = docs.join(by_doc, docs.doc_id == by_doc.doc).select("doc_id", "text", "pairs")
    return rows.mapInArrow(
        _found(params), "doc_id long, first_word int, n_words int, kept_doc_id long, kept_word int, edits int"
    )


def joined(passages: DataFrame) -> DataFrame:
    """Overlapping and adjacent passages of a document as one; the first one tells where it is kept."""
    order = W.partitionBy("doc_id").orderBy("first_word", F.desc("n_words"), "kept_doc_id", "kept_word")
    before = F.max(F.col("first_word") + F.col("n_words")).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = passages.withColumn("fresh", F.coalesce(F.col("first_word") > before, F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("fresh").over(order))
    first = F.min(F.struct("first_word", -F.col("n_words"), "kept_doc_id", "kept_word")).alias("first")
    end = F.max(F.col("first_word") + F.col("n_words")).alias("end")
    rows = rows.groupBy("doc_id", "run").agg(first, end, F.array_sort(F.array_distinct(F.flatten(F.collect_list("kept_doc_ids")))).alias("kept_doc_ids"))
    return rows.select(
        "doc_id",
        "first.first_word",
        (F.col("end") - F.col("first.first_word")).cast("int").alias("n_words"),
        "first.kept_doc_id",
        "first.kept_word",
        "kept_doc_ids",
    )
