"""Removal of repeated passages by MinHash banding of paragraphs.

A paragraph is a run of words between content-defined cuts: a cut lies where the hash of two
adjacent words is smallest within ``radius`` words on either side. Cuts depend on nearby words only, so a passage
copied into the middle of another line has the same paragraphs there, except at its two ends. Paragraphs that share a
band of minima are joined; exact Jaccard similarity of the shingle sets is verified, and
components of linked paragraphs keep one occurrence. Adjacent removed paragraphs form one passage.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.components import connected_components
from siftline.llm.passages import edited_passages, joined
from siftline.llm.tokens import (
    BLANK,
    mix,
    place,
    renamed,
    restored,
    slices,
    text_bytes,
    unique_per_text,
    windows,
    words,
)
from siftline.session import release, stage, staged_so_far

U64 = np.uint64


@dataclass(frozen=True)
class Paragraphs:
    """``bands`` bands (15 at most) of one minimum each over ``shingle``-word shingles; links need ``percent`` overlap.

    A pair at exactly 80 percent shares no band with probability 0.2^3 = 0.8 %; equal paragraphs always meet.
    With a radius of 5 words paragraphs have 11 words on average; of passages of 51 random words 98 % contain
    ``passage_words`` words of complete paragraphs, of 60 words 99.8 %. Shorter repeats are left alone.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 3
    radius: int = 5
    passage_words: int = 12


def cuts(hashes: np.ndarray, first: np.ndarray, radius: int) -> np.ndarray:
    """First words of all paragraphs, in order; every text with words starts one."""
    texts = len(first) - 1
    spot = np.arange(len(hashes)) + np.repeat(np.arange(1, texts + 1), np.diff(first)) * radius
    pair = np.full(len(hashes) + (texts + 1) * radius, ~U64(0))
    if len(hashes) > 1:
        pair[spot[:-1]] = mix(hashes[:-1] * U64(0x9E3779B97F4A7C15) + hashes[1:])
        last = first[1:][np.diff(first) > 0] - 1
        pair[spot[last]] = ~U64(0)  # the last word of a text has no next one
    smaller = np.ones(len(pair), bool)
    for k in range(1, radius + 1):
        smaller[k:] &= pair[k:] < pair[:-k]
        smaller[:-k] &= pair[:-k] <= pair[k:]
    begins = smaller[spot] & (pair[spot] != ~U64(0)) if len(hashes) else np.zeros(0, bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    return np.flatnonzero(begins)


def _paragraphs(params: Paragraphs):
    def run(batches):
        for batch in slices(batches, "text"):
            buffer, offsets = text_bytes(batch.column("text"))
            _, _, hashes, first = words(buffer, offsets, BLANK)
            begin = np.append(cuts(hashes, first, params.radius), len(hashes))
            doc = np.searchsorted(first, begin[:-1], side="right") - 1
            length = np.diff(begin)
            keep = length >= params.shingle
            runs, at = windows(hashes, begin, params.shingle)
            if not keep.any():
                continue
            # equal shingles of a paragraph count once, so equal sets are one class
            own = np.repeat(np.arange(len(length)), np.diff(at)).astype(U64)
            once = np.zeros(len(runs), U64)
            once[np.unique(mix(runs + own * U64(0x9E3779B97F4A7C15)), return_index=True)[1]] = U64(1)
            sets = np.add.reduceat(mix(runs) * once, at[:-1])
            keep = np.flatnonzero(keep)
            sets, doc, word, length = sets[keep], doc[keep], (begin[:-1] - first[doc])[keep], length[keep]
            # of equal paragraphs of a slice only the first one meets others: a frequent one is a row for each slice there
            head, back, count = np.unique(sets, return_index=True, return_inverse=True, return_counts=True)[1:]
            head = np.sort(head)
            several = np.flatnonzero(count[back] > 1)
            bands = [
                (np.minimum.reduceat(mix(runs ^ U64(0x51ED27 * (k + 1))), at[:-1])[keep[head]] << U64(4)) | U64(k)
                for k in range(params.bands)
            ]
            rows = np.concatenate([*[head] * params.bands, several])
            spread = mix(sets[several] + several.astype(U64)) | U64(_SEVERAL)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([*bands, spread]).view(np.int64)),
                    pa.array(sets[rows].view(np.int64)),
                    batch.column("doc_id").take(pa.array(doc[rows])),
                    pa.array(word[rows], pa.int32()),
                    pa.array(length[rows], pa.int32()),
                ],
                _MET.names,
            )

    return run


_OCCURRENCE = ["doc", "word", "size"]
#: In the last four bits of a key, in place of the band: an occurrence of a class that is known to have several.
_SEVERAL = 15
_MET = T.StructType().add("key", "long").add("class", "long").add("doc", "long").add("word", "integer").add("size", "integer")


def _meet(batches):
    """Rows come sorted by bucket, class, document and word, with all rows of a bucket in one partition.

    Reported without key: all occurrences of a class that has several (band 0, and those known before). With key: the first
    occurrence of each class of a bucket that has several classes, once. Only the first rows of the bucket and of the class are
    carried along.
    """
    names = ["class", *_OCCURRENCE]
    carried: list[np.ndarray] = []
    told = False  # whether the carried bucket's first row has been reported

    def report(rows, chosen, key=None):
        bucket = pa.nulls(len(chosen), pa.int64()) if key is None else pa.array(key[chosen])
        return pa.RecordBatch.from_arrays([bucket, *(pa.array(r[chosen]) for r in rows)], _MET.names)

    for batch in batches:
        key = batch.column("key").to_numpy()
        rows = [batch.column(n).to_numpy() for n in names]
        several = key & 15 == _SEVERAL
        yield report(rows, np.flatnonzero(several))
        key, rows = key[~several], [r[~several] for r in rows]
        if not len(key):
            continue
        skip = len(carried[0]) if carried else 0
        if carried:
            key = np.concatenate([carried[0], key])
            rows = [np.concatenate([c, r]) for c, r in zip(carried[1:], rows)]
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new_class = new_key | np.concatenate([[True], rows[0][1:] != rows[0][:-1]])
        at = np.arange(len(key))
        hub = np.maximum.accumulate(np.where(new_key, at, 0))
        head = np.maximum.accumulate(np.where(new_class, at, 0))
        fresh = at >= skip
        again = ~new_class & (key & 15 == 0) & fresh
        second = again & (at - head == 1)
        other = new_class & ~new_key & fresh
        hubs = np.unique(hub[other])
        yield report(rows, np.concatenate([np.flatnonzero(again), head[second]]))
        yield report(rows, np.concatenate([np.flatnonzero(other), hubs[1:] if told and len(hubs) and not hubs[0] else hubs]), key)
        told = hub[-1] in hubs or told and not hub[-1]
        last = [hub[-1], head[-1]] if hub[-1] != head[-1] else [hub[-1]]
        carried = [key[last], *(r[last] for r in rows)]


def _shingles(size: int):
    def run(batches):
        for batch in slices(batches, "text"):
            buffer, offsets = text_bytes(batch.column("text"))
            _, _, hashes, first = words(buffer, offsets, BLANK)
            wanted = batch.column("wanted")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            word, length = (x.to_numpy().astype(np.int64) for x in wanted.flatten().flatten())
            start = first[owner] + word
            fits = start + length <= first[owner + 1]  # rows that share a doc_id may differ
            for i in range(0, len(owner), 4096):
                part = np.flatnonzero(fits[i : i + 4096]) + i
                own = [hashes[a:b] for a, b in zip(start[part].tolist(), (start + length)[part].tolist())]
                flat = np.concatenate(own) if own else hashes[:0]
                bounds = np.concatenate([[0], np.cumsum(length[part])]).astype(np.int64)
                sets, begin = unique_per_text(*windows(flat, bounds, size))
                each = U64(1) << (sets & U64(63))
                bits = np.bitwise_or.reduceat(each, begin[:-1]) if len(each) else each
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(owner[part])),
                        pa.array(word[part], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(sets.view(np.int64))),
                        pa.array(bits.view(np.int64)),
                    ],
                    ["doc", "word", "shingles", "bits"],
                )

    return run


def _documents(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )


def _links(met: DataFrame, docs: DataFrame, params: Paragraphs) -> DataFrame:
    """Pairs ``class_a, class_b`` of classes that connect all classes with enough shingles in common in a bucket.

    First the class of a bucket that meets most others is compared with the rest; then the classes still in different
    components are compared inside the join condition, which returns links only. ``bits`` has one bit set
    for each shingle: sets whose bits differ in more places than their shingles may differ can't be linked, which
    settles nearly all comparisons without loss.
    """
    everywhere = W.partitionBy("key")
    members = met.where("key is not null").withColumn("n", F.count(F.lit(1)).over(everywhere))
    members = stage(members, "bucket-members")
    first = F.min(F.struct(*_OCCURRENCE)).alias("first")
    classes = stage(members.groupBy("class").agg(first, F.sum("n").alias("weight")).select("class", "first.*", "weight"), "bucket-classes")
    wanted = classes.groupBy("doc").agg(F.collect_set(F.struct("word", "size")).alias("wanted"))
    sets = docs.join(wanted, docs.doc_id == wanted.doc).select("doc_id", "text", "wanted")
    sets = sets.mapInArrow(_shingles(params.shingle), "doc long, word int, shingles array<long>, bits long")
    classes = classes.join(sets, ["doc", "word"]).select("class", "weight", "shingles", "bits")
    members = stage(members.select("key", "class").join(classes, "class").select("key", *classes.columns), "paragraph-sets")
    p = params.percent
    sizes = F.size("shingles_a") + F.size("shingles_b")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    # overlap of p percent: the sets differ in (100 - p) / (100 + p) of their summed sizes at most
    may = (100 + p) * F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= (100 - p) * sizes
    linked = may & (100 * common >= p * (sizes - common))
    named = lambda rows, s: rows.select("key", *(F.col(n).alias(f"{n}_{s}") for n in rows.columns if n != "key"))
    order = everywhere.orderBy(F.desc("weight"), "class").rowsBetween(W.unboundedPreceding, W.currentRow)
    hub = [F.first(name).over(order).alias(f"{name}_b") for name in ("class", "shingles", "bits")]
    stars = members.select(*(F.col(n).alias(f"{n}_a") for n in ("class", "shingles", "bits")), *hub)
    stars = stars.where((F.col("class_a") != F.col("class_b")) & linked)
    stars = stage(stars.select("class_a", "class_b").distinct(), "paragraph-stars")
    labels = connected_components(stars, "class_a", "class_b").select(F.col("node").alias("class"), "component")
    placed = members.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    apart = F.min("component").over(everywhere) != F.max("component").over(everywhere)
    placed = stage(placed.withColumn("apart", apart).where("apart").drop("apart"), "paragraph-apart")
    apart = named(placed, "a").join(named(placed, "b"), "key").where((F.col("component_a") < F.col("component_b")) & linked)
    return stars.union(apart.select("class_a", "class_b")).distinct()


def repeated_passages(docs: DataFrame, params: Paragraphs = Paragraphs()) -> DataFrame:
    """``doc_id, first_word, n_words, kept_doc_id, kept_word, kept_doc_ids`` of every passage to remove from ``docs(doc_id, text)``.

    Words are separated by ASCII white space, A-Z count as a-z, and are numbered from 0 in each text. Of every
    component of linked paragraphs the occurrence with the smallest doc_id and word stays; all others go,
    also within one document. Runs of adjacent removed paragraphs with fewer than
    ``passage_words`` words together stay. ``kept_doc_id`` and ``kept_word`` tell where the first paragraph of the passage
    is kept, ``kept_doc_ids`` where any of its paragraphs is.

    Null ids, null and empty texts and texts with fewer words than a shingle have no passages. Rows with
    the same doc_id are taken as one document: a paragraph at the same words of both is one occurrence.
    Other columns are ignored.

    One shuffle sorts the paragraphs by bucket, class and place. Of equal paragraphs of a slice of texts one takes part, the
    others go past the buckets, so a frequent paragraph is spread over many tasks. Rows stream through a task, which keeps two at a time. A repeat costs one row; only
    different paragraphs of a bucket are compared with each other.
    """
    docs = _documents(docs)
    buckets = docs.mapInArrow(_paragraphs(params), _MET).repartition("key").sortWithinPartitions("key", "class", "doc", "word")
    met = stage(buckets.mapInArrow(_meet, _MET), "paragraphs")
    links = stage(_links(met, docs, params), "paragraph-links")
    labels = connected_components(links, "class_a", "class_b").select(F.col("node").alias("class"), "component")
    # a class that links leave alone is a group of its own
    rows = met.join(labels, "class", "left").where("key is null or component is not null")
    rows = stage(rows.select(F.coalesce("component", "class").alias("group"), *_OCCURRENCE), "paragraph-occurrences")
    heads = rows.groupBy("group").agg(F.min(F.struct("doc", "word")).alias("kept"))
    removed = rows.join(heads, "group").where((F.col("doc") != F.col("kept.doc")) | (F.col("word") != F.col("kept.word")))
    removed = removed.groupBy("doc", "word", "size").agg(F.min("kept").alias("kept"))
    order = W.partitionBy("doc").orderBy("word")
    gap = F.col("word") != F.lag(F.col("word") + F.col("size")).over(order)
    removed = removed.withColumn("run", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(order))
    return (
        removed.groupBy("doc", "run")
        .agg(
            F.min("word").alias("first_word"),
            F.sum("size").cast("int").alias("n_words"),
            F.min_by("kept", "word").alias("kept"),
            F.array_sort(F.collect_set("kept.doc")).alias("kept_doc_ids"),
        )
        .where(F.col("n_words") >= params.passage_words)
        .select(
            F.col("doc").alias("doc_id"),
            "first_word",
            "n_words",
            F.col("kept.doc").alias("kept_doc_id"),
            F.col("kept.word").alias("kept_word"),
            "kept_doc_ids",
        )
    )


def all_passages(docs: DataFrame, params: Paragraphs = Paragraphs(), only_edited: bool = False) -> DataFrame:
    """``repeated_passages`` and the passages that seeds find, as one table with the columns of the former.

    Paragraphs end at their cuts and tell nothing of an edited passage when few of them are equal; passages from seeds reach
    over edits and to their true ends. ``only_edited`` adds those with an edit alone.
    """
    spark = docs.sparkSession
    mark = staged_so_far(spark)
    own = stage(repeated_passages(docs, params), "passages")
    release(spark, mark, own)
    more = edited_passages(_documents(docs)).where("n_words >= %d" % params.passage_words)
    if only_edited:
        more = more.where("edits > 0")
    more = more.withColumn("kept_doc_ids", F.array("kept_doc_id")).select(*own.columns)
    return joined(own.union(more))


def _without(text: str):
    def run(batches):
        for batch in slices(batches, text):
            buffer, offsets = text_bytes(batch.column(text))
            starts, ends, _, first = words(buffer, offsets, BLANK)
            texts = batch.column(text).to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if not spans or texts[i] is None:
                    continue
                at, parts = offsets[i], []
                for span in sorted(spans, key=lambda s: s["first_word"]):
                    x, y = first[i] + span["first_word"], first[i] + span["first_word"] + span["n_words"]
                    if y > first[i + 1]:
                        continue  # another row of the same doc_id has these words
                    parts.append(buffer[at : starts[x]])
                    at = ends[y - 1]
                parts.append(buffer[at : offsets[i + 1]])
                texts[i] = b"".join(p.tobytes() for p in parts).decode()
            keep = [name for name in batch.schema.names if name != "spans"]
            columns = [pa.array(texts, pa.string()) if name == text else batch.column(name) for name in keep]
            yield pa.RecordBatch.from_arrays(columns, keep)

    return run


def remove_repeats(docs: DataFrame, params: Paragraphs = Paragraphs()) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; all rows and other columns stay.

    Equal passages are cut at their paragraphs, edited ones at their true ends.
    """
    rows, text = renamed(docs), place(docs, "text")
    spans = all_passages(docs, params, only_edited=True).groupBy(F.col("doc_id").alias("doc"))
    spans = spans.agg(F.collect_list(F.struct("first_word", "n_words")).alias("spans"))
    joined = rows.join(spans, rows[place(docs, "doc_id")] == spans["doc"], "left").drop("doc")
    return restored(joined.mapInArrow(_without(text), rows.schema), docs)
