import random
import re

import pytest
from pyspark.sql import functions as F

from siftline.llm.components import connected_components
from siftline.llm.minhash import MinHash, drop_near_duplicates, estimate, mismatches, near_duplicates

SCHEMA = "doc_id long, text string"


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def brute(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        sets[i] = shingles(t, size)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


def corpus(seed, groups=8, copies=12):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 12))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append(" ".join(words))
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("size", [2, 5])
def test_same_components_as_all_pairs(spark, size):
    rows = corpus(size)
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), MinHash(shingle=size))
    assert result(found) == brute(rows, size)


def test_edge_cases(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (7, "One"), (2, "one"), (4, "ONE two"), (8, "É a"), (6, "é a"), (1, "x " * 30000)]
    frame = spark.createDataFrame([(i, t, "x", True) for i, t in rows], SCHEMA + ", component_id string, kept boolean")
    assert result(near_duplicates(frame, MinHash(shingle=2))) == brute(rows, 2)


def test_repeated_rows_and_null_ids(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "e f"), (1, "a b c d"), (2, None)]
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA), MinHash(shingle=2))
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in found.collect())
    assert got == [("1", "1", True), ("2", "2", True), ("3", "1", False), ("3", "1", False), ("None", "1", False), ("None", "None", True)]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_group_of_copies_keeps_one(spark):
    rows = [(i, "the same text again and again") for i in range(500)] + [(1000, "quite another text here")]
    frame = spark.createDataFrame([(i, t, "z") for i, t in rows], SCHEMA + ", key1 string")
    kept = drop_near_duplicates(frame)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1000]
    assert kept.columns == frame.columns


def test_estimate_is_corrected_for_chance(spark):
    params = MinHash(bands=16, rows=4, bits=2, kept=64)
    row = spark.range(1).select(
        F.array(F.lit(0), F.lit(0)).alias("x"), F.array(F.lit(0b1100), F.lit(0b0110)).alias("y")
    )
    unequal = row.select(mismatches(F.col("x"), F.col("y"), params).alias("n")).first().n
    assert unequal == 3
    got = row.select(estimate(F.lit(unequal), params).alias("e")).first().e
    assert got == pytest.approx((1 - 3 / 64 - 0.25) / 0.75)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (None, 3)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)}


def test_different_texts_of_one_document_link_their_groups(spark):
    one, two = "a b c d e f g", "p q r s t u v"
    frame = spark.createDataFrame([(1, one), (2, one), (2, two), (3, two), (4, one), (4, None), (5, "x y z")], SCHEMA)
    got = {tuple(r) for r in near_duplicates(frame).select("doc_id", "component_id", "kept").collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 5, True)}


def test_copies_among_rows_without_id_go(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (None, text + " x"), (None, "other words"), (None, None), (7, "own text"), (None, "own text")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    left = [tuple(r) for r in drop_near_duplicates(frame).collect()]
    assert len(left) == 4 and {(7, "own text"), (None, "other words"), (None, None)} < set(left)
    found = near_duplicates(frame).collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) == 4
    assert {r.component_id for r in found if r.doc_id is None} == {None, 7}
