"""Bigram language model with interpolated modified Kneser-Ney smoothing.

Words and bigrams are counted in Spark and stored in the shared folder as sorted arrays: the vocabulary by
word hash, which also numbers the words, and the bigrams by word numbers. Workers memory-map the arrays and look up
each batch's distinct words and bigrams in order. Where the shared folder isn't mounted, they read the arrays they need.

Files are written by tasks under random names and count only if listed by a task that succeeded.
"""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.tokens import BLANK, mix, slices, text_bytes, words
from siftline.session import stage, work_folder

U64 = np.uint64
#: Stand-ins of a text's begin and end, beside the hashes of words.
BEGIN, END = mix(np.array([0xBE61, 0xE4D], U64))
#: Distinct counts that a task gathers before it hands them on.
_GATHERED = 1 << 21
_LARGE = 255


# -- arrays in files ---------------------------------------------------------------------------


def _save(folder: str, arrays: list[np.ndarray]) -> str:
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    path = f"{root}/{uuid.uuid4().hex}"
    with store.open_output_stream(path, compression=None) as out:
        for x in arrays:
            out.write(np.ascontiguousarray(x).tobytes())
    return path


@functools.lru_cache(maxsize=4096)
def _load(folder: str, path: str, kinds: tuple[tuple[str, int], ...]) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped if it lies in a mounted folder; an empty array has no bytes."""
    store, _ = pafs.FileSystem.from_uri(folder)
    local = isinstance(store, pafs.LocalFileSystem)
    data = None
    if not local:
        with store.open_input_stream(path, compression=None) as file:
            data = file.read()
    out, at = [], 0
    for kind, n in kinds:
        kind = np.dtype(kind)
        if not n:
            out.append(np.zeros(0, kind))
        elif local:
            out.append(np.memmap(path, kind, "r", at, (n,)))
        else:
            out.append(np.frombuffer(data, kind, n, at))
        at += kind.itemsize * n
    return out


# -- counting ------------------------------------------------------------------------------------


def _tokens(batch: pa.RecordBatch):
    """Token hashes of the texts of a slice, each text between BEGIN and END, and where each text starts."""
    _, _, hashes, first = words(*text_bytes(batch.column("text")), BLANK)
    sizes = np.diff(first) + 2
    start = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(start[-1], U64)
    out[start[:-1]] = BEGIN
    out[start[1:] - 1] = END
    out[np.arange(len(hashes)) + 2 * np.repeat(np.arange(len(sizes)), sizes - 2) + 1] = hashes
    return out, start


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
    return key[heads], (np.add.reduceat(n, heads) if len(key) else n)


def _handed_on(found, shard_of):
    """Batches of ``shard, key, n`` of the counts in ``found``, added up as far as memory allows."""
    keys, counts, size = [], [], 0

    def batch():
        key, n = _summed(keys, counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(shard_of(key).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(n)], ["shard", "key", "n"]
        )

    for key, n in found:
        keys.append(key)
        counts.append(n)
        size += len(key)
        if size >= _GATHERED:
            yield batch()
            keys, counts, size = [], [], 0
    if keys:
        yield batch()


_COUNTED = "shard int, key long, n long"


def _word_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _word_counts(shards: int):
    def run(batches):
        def found():
            for batch in slices(batches, "text"):
                yield np.unique(_tokens(batch)[0], return_counts=True)

        yield from _handed_on(found(), lambda key: _word_shard(key, shards))

    return run


def _by_shard(batches):
    """Shard, keys and counts of everything in a partition, equal keys added up."""
    parts: dict[int, tuple[list, list]] = {}
    for batch in batches:
        shard, key, n = (batch.column(c).to_numpy() for c in ("shard", "key", "n"))
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, cut) if len(order) else []:
            keys, counts = parts.setdefault(int(shard[part[0]]), ([], []))
            keys.append(key[part].view(U64))
            counts.append(n[part])
    for shard in sorted(parts):
        yield shard, *_summed(*parts.pop(shard))


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    """Files: their shard, path, number of entries, and up to six sums."""
    columns = list(zip(*rows)) if rows else [()] * 9
    kinds = [pa.int32(), pa.string(), *[pa.int64()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _FILES.names)


_FILES = pa.schema([(n, pa.int64()) for n in ("shard", "path", "size", "x1", "x2", "x3", "x4", "x5", "x6")])
_FILES_SPARK = "shard int, path string, size long, x1 long, x2 long, x3 long, x4 long, x5 long, x6 long"


def _save_words(folder: str):
    def run(batches):
        rows = []
        for shard, key, n in _by_shard(batches):
            path = _save(folder, [key, n.astype(U64), (np.cumsum(n) - n).astype(U64)])
            rows.append((shard, path, len(key), int(n.sum()), 0, 0, 0, 0, 0))
        yield _listed(rows)

    return run


@dataclass(frozen=True)
class Vocabulary:
    """Files of the vocabulary in order of hash; words are numbered through."""

    folder: str
    shards: int
    files: tuple[tuple[int, str, int], ...]  # shard, path, words
    before: np.ndarray  # words before each shard, one end entry
    tokens: np.ndarray  # tokens before each shard, one end entry

    def arrays(self, shard: int) -> list[np.ndarray]:
        """Hashes of the words, their counts, and the tokens of the words before each."""
        path, size = self.paths[shard]
        return _load(self.folder, path, (("u8", size),) * 3)

    @functools.cached_property
    def paths(self) -> dict[int, tuple[str, int]]:
        return {shard: (path, size) for shard, path, size in self.files}

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number (-1 if unknown), count and preceding tokens of sorted word hashes."""
        number = np.full(len(hashes), -1, np.int64)
        count = np.zeros(len(hashes), np.int64)
        ahead = np.zeros(len(hashes), np.int64)
        shard = _word_shard(hashes, self.shards)
        for s in np.unique(shard).tolist():
            if s not in self.paths:
                continue
            own = np.flatnonzero(shard == s)
            key, n, running = self.arrays(s)
            at = np.minimum(np.searchsorted(key, hashes[own]), len(key) - 1)
            known = key[at] == hashes[own]
            own, at = own[known], at[known]
            number[own] = self.before[s] + at
            count[own] = n[at]
            ahead[own] = self.tokens[s] + running[at].astype(np.int64)
        return number, count, ahead


def _vocabulary(docs: DataFrame, folder: str, shards: int) -> Vocabulary:
    counted = docs.mapInArrow(_word_counts(shards), _COUNTED).repartition(shards, "shard")
    files = stage(counted.mapInArrow(_save_words(folder), _FILES_SPARK), "words").orderBy("shard").toArrow().to_pylist()
    before, tokens = np.zeros(shards + 1, np.int64), np.zeros(shards + 1, np.int64)
    for f in files:
        before[f["shard"] + 1], tokens[f["shard"] + 1] = f["size"], f["x1"]
    names = tuple((f["shard"], f["path"], f["size"]) for f in files)
    return Vocabulary(folder, shards, names, np.cumsum(before), np.cumsum(tokens))


def _pairs(batch: pa.RecordBatch, vocabulary: Vocabulary):
    """For each token after BEGIN: numbers, counts and preceding tokens of it and of its context."""
    tokens, start = _tokens(batch)
    unique, place = np.unique(tokens, return_inverse=True)
    number, count, ahead = vocabulary.find(unique)
    keep = np.ones(len(tokens), bool)
    keep[start[:-1]] = False
    at = np.flatnonzero(keep)
    word, context = place[at], place[at - 1]
    return number[word], count[word], number[context], count[context], ahead[context], start


def _bigram_shard(context_count, context_ahead, word, capacity: int) -> np.ndarray:
    """Contexts lie in order of their numbers, each as wide as it is frequent; a frequent one spans several shards."""
    share = (mix(word.astype(U64)) >> U64(11)).astype(np.float64) / 2.0**53
    return (context_ahead + np.floor(share * context_count).astype(np.int64)) // capacity


def _bigram_counts(shared, capacity: int):
    def run(batches):
        vocabulary = shared.value
        keys, shards, counts, size = [], [], [], 0

        def batch():
            key, shard, n = np.concatenate(keys), np.concatenate(shards), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            key, shard, n = key[order], shard[order], n[order]
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            columns = [shard[heads].astype(np.int32), key[heads].view(np.int64), np.add.reduceat(n, heads)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "key", "n"])

        for part in slices(batches, "text"):
            word, _, context, context_count, ahead, _ = _pairs(part, vocabulary)
            key, first, n = np.unique((context.astype(U64) << U64(32)) | word.astype(U64), return_index=True, return_counts=True)
            keys.append(key)
            shards.append(_bigram_shard(context_count[first], ahead[first], word[first], capacity))
            counts.append(n)
            size += len(key)
            if size >= _GATHERED:
                yield batch()
                keys, shards, counts, size = [], [], [], 0
        if keys:
            yield batch()

    return run


def _save_bigrams(folder: str):
    """Counts below 255 take a byte; places and values of larger ones follow."""

    def run(batches):
        rows = []
        for shard, key, n in _by_shard(batches):
            large = np.flatnonzero(n >= _LARGE)
            path = _save(folder, [key, large.astype(U64), n[large].astype(U64), np.minimum(n, _LARGE).astype(np.uint8)])
            frequent = [int((n == k).sum()) for k in (1, 2, 3, 4)]
            rows.append((shard, path, len(key), len(large), *frequent, 0))
        yield _listed(rows)

    return run


def _bigram_arrays(folder: str, path: str, size: int, large: int) -> list[np.ndarray]:
    return _load(folder, path, (("u8", size), ("u8", large), ("u8", large), ("u1", size)))


def _counts_at(arrays: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    _, large, value, small = arrays
    n = small[at].astype(np.int64)
    full = n == _LARGE
    if full.any():
        n[full] = value[np.searchsorted(large, at[full].astype(U64))]
    return n


def _word_statistics(folder: str, before: np.ndarray):
    """From each bigram file: followers of each context seen once, twice and more often; contexts before each word."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                arrays = _bigram_arrays(folder, row["path"], row["size"], row["x1"])
                key = np.asarray(arrays[0])
                small = np.asarray(arrays[3])
                for numbers, weights in (
                    ((key >> U64(32)).astype(np.int64), [small == 1, small == 2, small > 2, None]),
                    ((key & U64(0xFFFFFFFF)).astype(np.int64), [None, None, None, small > 0]),
                ):
                    number, place = np.unique(numbers, return_inverse=True)
                    sums = [np.zeros(len(number), np.int64) if w is None else np.bincount(place, w, len(number)).astype(np.int64) for w in weights]
                    shard = np.searchsorted(before, number, side="right") - 1
                    columns = [pa.array(shard, pa.int32()), pa.array(number), *map(pa.array, sums)]
                    for at in range(0, len(number), 1 << 17):
                        yield pa.RecordBatch.from_arrays([c.slice(at, 1 << 17) for c in columns], _STATISTICS.names)

    return run


_STATISTICS = pa.schema([(n, pa.int64()) for n in ("shard", "key", "n1", "n2", "n3", "before")])


def _save_statistics(folder: str, vocabulary_before: np.ndarray):
    def run(batches):
        parts: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            for s in np.unique(shard).tolist():
                parts.setdefault(s, []).append(batch.filter(pa.array(shard == s)))
        rows = []
        for shard, own in sorted(parts.items()):
            table = pa.Table.from_batches(own)
            size = int(vocabulary_before[shard + 1] - vocabulary_before[shard])
            at = table["key"].to_numpy() - vocabulary_before[shard]
            arrays = [np.zeros(size, np.uint64) for _ in range(4)]
            for x, name in zip(arrays, ("n1", "n2", "n3", "before")):
                np.add.at(x, at, table[name].to_numpy().astype(U64))
            preceding = arrays[3]
            frequent = [int((preceding == k).sum()) for k in (1, 2, 3, 4)]
            rows.append((shard, _save(folder, arrays), size, int(preceding.sum()), *frequent, int((preceding > 0).sum())))
        yield _listed(rows)

    return run


# -- the model ---------------------------------------------------------------------------------


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; fixed ones where counts of counts are missing.

    A discount of 0 or less would leave nothing for words that were not seen after a context, and one of a whole count
    nothing for those that were: where the formula gives either, the fixed one stands in.
    """
    fixed = [0.5, 1.0, 1.5]
    if min(n1, n2, n3, n4) == 0:
        return np.array([0.0, *fixed])
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(d if 0 < d < k else fixed[k - 1] for k, d in enumerate(found, 1))])


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that hold for the whole model."""

    folder: str
    vocabulary: Vocabulary
    capacity: int
    bigrams: dict[int, tuple[str, int, int]]  # shard: path, bigrams, large counts
    statistics: dict[int, tuple[str, int]]  # vocabulary shard: path, words
    discount: np.ndarray  # of bigram counts
    lower: np.ndarray  # discounts of the numbers of preceding contexts
    n_bigrams: int
    rest: float  # probability that the lower order leaves to the uniform choice
    n_words: int  # V
    n_tokens: int  # N

    def lower_order(self, before: np.ndarray) -> np.ndarray:
        own = np.maximum(before - self.lower[np.minimum(before, 3)], 0) / max(self.n_bigrams, 1)
        return own + self.rest / (self.n_words + 1)

    def of_words(self, number: np.ndarray) -> list[np.ndarray]:
        """Followers seen once, twice and more often, and preceding contexts, of words by number (0 if unknown)."""
        out = [np.zeros(len(number), np.int64) for _ in range(4)]
        shard = np.where(number < 0, -1, np.searchsorted(self.vocabulary.before, number, side="right") - 1)
        for s in np.unique(shard[shard >= 0]).tolist():
            if s in self.statistics:
                path, size = self.statistics[s]
                own = np.flatnonzero(shard == s)
                for x, stored in zip(out, _load(self.folder, path, (("u8", size),) * 4)):
                    x[own] = stored[number[own] - self.vocabulary.before[s]]
        return out

    def bigram_counts(self, key: np.ndarray, shard: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.int64)
        for s in np.unique(shard).tolist():
            if s in self.bigrams:
                arrays = _bigram_arrays(self.folder, *self.bigrams[s])
                own = np.flatnonzero(shard == s)
                at = np.minimum(np.searchsorted(arrays[0], key[own]), len(arrays[0]) - 1)
                known = arrays[0][at] == key[own]
                out[own[known]] = _counts_at(arrays, at[known])
        return out


def train(docs: DataFrame) -> Model:
    """The model of ``docs(text)``; null texts are empty, and an empty text is an end alone.

    There are as many shards as the session has shuffle partitions, and tasks hold one shard's distinct words or bigrams.
    A frequent context is spread over shards, and equal counts are added up before they are shuffled.
    """
    spark = docs.sparkSession
    docs = docs.select("text")
    folder = work_folder(spark, "kneser-ney")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vocabulary = _vocabulary(docs, folder, shards)
    total = int(vocabulary.tokens[-1])
    if vocabulary.before[-1] >= 1 << 32:
        raise ValueError("more than 2^32 different words")
    capacity = max(1, -(-total // shards))
    shared = spark.sparkContext.broadcast(vocabulary)
    counted = docs.mapInArrow(_bigram_counts(shared, capacity), _COUNTED).repartition(shards, "shard")
    files = stage(counted.mapInArrow(_save_bigrams(folder), _FILES_SPARK), "bigrams")
    bigrams = files.toArrow().to_pylist()
    sums = (
        files.repartition(shards, "path")
        .mapInArrow(_word_statistics(folder, vocabulary.before), "shard int, key long, n1 long, n2 long, n3 long, before long")
        .repartition(shards, "shard")
        .mapInArrow(_save_statistics(folder, vocabulary.before), _FILES_SPARK)
    )
    statistics = stage(sums, "statistics").toArrow().to_pylist()
    upper = discounts(*(sum(f[x] for f in bigrams) for x in ("x2", "x3", "x4", "x5")))
    m1, m2, m3, m4 = (sum(f[x] for f in statistics) for x in ("x2", "x3", "x4", "x5"))
    lower = discounts(m1, m2, m3, m4)
    n_bigrams, n_words = sum(f["x1"] for f in statistics), sum(f["x6"] for f in statistics)
    left = lower[1] * m1 + lower[2] * m2 + lower[3] * (n_words - m1 - m2)
    begins = int(vocabulary.find(np.array([BEGIN]))[1][0])
    return Model(
        folder,
        vocabulary,
        capacity,
        {f["shard"]: (f["path"], f["size"], f["x1"]) for f in bigrams},
        {f["shard"]: (f["path"], f["size"]) for f in statistics},
        upper,
        lower,
        n_bigrams,
        left / n_bigrams if n_bigrams else 1.0,
        n_words,
        total - begins,
    )


def log_probabilities(batch: pa.RecordBatch, model: Model):
    """For each token of a slice: log10 probability, training count; and where each text's tokens start."""
    word, count, context, context_count, ahead, start = _pairs(batch, model.vocabulary)
    unique, place = np.unique(word, return_inverse=True)
    lower = model.lower_order(model.of_words(unique)[3])[place]
    unique, place = np.unique(context, return_inverse=True)
    n1, n2, n3, _ = model.of_words(unique)
    left = (model.discount[1] * n1 + model.discount[2] * n2 + model.discount[3] * n3)[place]
    known = context >= 0
    both = np.flatnonzero(known & (word >= 0))
    key = (context[both].astype(U64) << U64(32)) | word[both].astype(U64)
    key, first, place = np.unique(key, return_index=True, return_inverse=True)
    first = both[first]
    shard = _bigram_shard(context_count[first], ahead[first], word[first], model.capacity)
    seen = np.zeros(len(word), np.int64)
    seen[both] = model.bigram_counts(key, shard)[place]
    own = seen - model.discount[np.minimum(seen, 3)]
    chance = np.where(known, (own + left * lower) / np.maximum(context_count, 1), lower)
    return np.log10(chance), count, start - np.arange(len(start))


def _score(shared):
    def run(batches):
        model = shared.value
        denominator = np.log10(model.n_tokens + 0.1 * (model.n_words + 1))
        for batch in slices(batches, "text"):
            logs, count, start = log_probabilities(batch, model)
            add = lambda x: np.add.reduceat(x, start[:-1])  # noqa: E731  # every text has an end
            keep = [f for f in batch.schema.names if f != "text"]
            columns = {
                "n_tokens": pa.array(np.diff(start), pa.int64()),
                "n_known": pa.array(add((count > 0).astype(np.int64))),
                "base_score": pa.array(add(np.log10(count + 0.1) - denominator)),
                "score": pa.array(add(logs)),
            }
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(f)) for f in keep), *columns.values()], [*keep, *columns]
            )

    return run


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every row of ``docs``.

    Tokens are the words (A-Z as a-z, separated by ASCII white space) and an end; null texts are empty. ``n_known``
    counts tokens that occur in training, ``score`` is the log10 probability of all tokens, ``base_score`` that of a
    unigram model with 0.1 added to each count. A model without training text gives every token probability 1.
    ``keep`` may not contain ``text``; other columns may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")
    return rows.mapInArrow(_score(shared), schema)
