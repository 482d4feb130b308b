import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from siftline.llm import importance
from siftline.llm.importance import Bytes, Resampling, Table

SCHEMA = "doc_id long, text string"
ODD = [None, "", "..!", "One", "ONE two", "a-b c", "é É naïve ÀB", "x" * 100 + " " + "y" * 40 + " tail", "\x00a\x7fb", "日本 語 text"]


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(feature, n=10_000):
    return zlib.crc32(feature.encode()) % n


def brute(rows, target, percent=5, least=20):
    s = Counter(bucket(f) for _, text in rows for f in features(text))
    t = Counter(bucket(f) for text in target for f in features(text))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for doc, text in rows:
        own = features(text)
        weight = 0
        for f in own:
            b = bucket(f)
            weight += math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(own), weight, weight + noise, None, len(words(text)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


def found(spark, rows, target, **how):
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA + ", score string, rank int").repartition(3)
    texts = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, texts, Resampling(**how), keep=("doc_id", "score"))
    return [(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()]


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "d", "über", "Zeta9", "w" * 37, "m,n", "3"]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 90))) for _ in range(n)]
    return list(enumerate(texts)) + [(n + i, t) for i, t in enumerate(ODD)]


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed, 150)
    rows += [(3, rows[3][1]), (3, "other " * 30), (None, rows[5][1]), (None, None)]
    target = ["alpha beta gamma", None, "", "Zeta9 zeta9 über alles", rows[7][1]]
    assert order(found(spark, rows, target, percent=40)) == order(brute(rows, target, percent=40))


def test_ties_go_to_smaller_ids(spark):
    rows = [(None, "a " * 30)] * 6
    got = found(spark, rows, ["b"], percent=50)
    assert order(got) == order(brute(rows, ["b"], percent=50)) and sum(r[4] is not None for r in got) == 3


def test_very_long_text_and_partitions(spark):
    rows = [(1, "long story " * 200_000), *((i, f"short story number {i} " * 8) for i in range(2, 40))]
    assert order(found(spark, rows, ["long story"], percent=10)) == order(brute(rows, ["long story"], percent=10))


def test_empty_tables(spark):
    assert found(spark, [], ["a b"]) == []
    rows = [(1, "one two three " * 10)]
    assert order(found(spark, rows, [], percent=100)) == order(brute(rows, [], percent=100))


def strings(seed):
    rnd = random.Random(seed)
    return [bytes(rnd.choices(range(256), k=rnd.choice([0, 1, 3, 4, 7, 8, 9, 12, 31, 32, 33, 40, 63, 64, 65, 200]))) for _ in range(300)]


def test_hashes_agree_with_the_libraries():
    parts = strings(1)
    text = Bytes(np.frombuffer(b"".join(parts), np.uint8))
    size = np.array(list(map(len, parts)))
    at = np.cumsum(size) - size
    assert text.xxhash64(at, size).tolist() == [xxhash.xxh64_intdigest(p) for p in parts]
    assert text.crc32(at, size).tolist() == [zlib.crc32(p) for p in parts]


def test_equal_keys_of_different_strings_take_different_slots():
    parts = [b"left", b"best", b"left", b"lefty", b"12345678a", b"12345678b", b"12345678a", b""] * 3
    text = Bytes(np.frombuffer(b"".join(parts), np.uint8))
    size = np.array(list(map(len, parts)))
    at = np.cumsum(size) - size
    for keys in (np.zeros(len(parts), np.uint64), np.full(len(parts), 2**64 - 1, np.uint64), text.xxhash64(at, size)):
        table = Table(text, at, size, keys, 1000)
        by_slot = {}
        for part, slot in zip(parts, table.slot.tolist()):
            assert by_slot.setdefault(slot, part) == part
        assert len(by_slot) == len(set(parts))
        assert [table.count[s] for s in table.slot] == [parts.count(p) for p in parts]
        assert [table.bucket[s] for s in table.slot] == [zlib.crc32(p) % 1000 for p in parts]


def test_joined_words():
    texts = ["A  b", None, "", "c", "--", "d-E--F "]
    column = pa.array(texts, pa.string())
    data, starts, ends, first = importance.joined_words(*importance.text_bytes(column))
    got = [[bytes(data[a:b]).decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(first[:-1], first[1:])]
    assert got == [words(t) for t in texts]
    assert b"d e f" in bytes(data)


def test_memory_of_a_task_is_bounded():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 3000)) for _ in range(150)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array(texts)], ["doc_id", "text"])
    for run in (importance._count(importance.Resampling()), importance._weigh(importance.Resampling(), np.zeros(10_000, np.int64))):
        tracemalloc.start()
        assert sum(b.num_rows for b in run(iter([batch]))) > 0
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20 << 20, peak
