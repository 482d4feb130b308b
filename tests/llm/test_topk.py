import math
import random

import pytest
from pyspark.sql import functions as F

from siftline.llm.topk import TopK, quantized, top_k

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, chosen):
    usable = {}
    out = []
    kept = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(1024 * x) for x in v]))
    for q, a in {(q, tuple(a)) for q, a in kept if chosen(q)}:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q and len(a) == len(b))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def search(frame, params):
    rows = quantized(frame)
    return sorted(tuple(r) for r in top_k(rows, rows.where(F.col("id") % 10 == 0), params).collect())


def exact(x):
    return math.floor(x * 256) / 256  # also exact as a float


@pytest.mark.parametrize("params", [TopK(), TopK(k=3, block=4, bins=4), TopK(k=200, bins=16)])
def test_same_as_brute_force_with_ties(spark, params):
    rnd = random.Random(params.k)
    base = [[exact(rnd.uniform(-1, 1)) for _ in range(6)] for _ in range(12)]
    rows = [(i, rnd.choice(base)) for i in range(120)]  # many equal vectors
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert search(frame, params) == brute(rows, params.k, lambda q: q % 10 == 0)


def test_edge_cases(spark):
    rows = [
        (0, [1.0, 2.0]), (10, None), (20, []), (30, [float("nan"), 1.0]), (40, [float("inf"), 1.0]), (50, [None, 1.0]),
        (60, [1.0]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (2, [0.5, -0.25]), (None, [1.0, 1.0]), (3, [-0.0001, 0.0]), (70, [1.0, 2.0, 3.0]),
    ]
    frame = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", score int")
    assert search(frame, TopK(k=2)) == brute(rows, 2, lambda q: q % 10 == 0)
    assert search(frame, TopK(k=3)) == brute(rows, 3, lambda q: q % 10 == 0)


def test_one_hot_vector(spark):
    rows = [(i, [0.5, 0.5]) for i in range(3000)] + [(5001, [0.75, 0.5])]
    frame = spark.createDataFrame(rows, SCHEMA).where("vec_id % 10 != 0 or vec_id < 30").repartition(4)
    kept = [r for r in rows if r[0] % 10 or r[0] < 30]
    assert search(frame, TopK(bins=8)) == brute(kept, 10, lambda q: q % 10 == 0)


def test_large_components(spark):
    rows = [(i, [1000.0 * i, -1500.0, 30000.0]) for i in range(25)]
    assert search(spark.createDataFrame(rows, SCHEMA), TopK()) == brute(rows, 10, lambda q: q % 10 == 0)


def whole(frame_rows):
    return [(i, [float(x) / 1024 for x in v]) for i, v in frame_rows]


def test_products_near_the_bound_are_exact(spark):
    # sums pass 64 bits on the way, the results do not
    big = 1 << 40
    rows = whole([(0, [big, big, 3]), (1, [big, -big, 7]), (2, [-big, big, 5]), (3, [1 << 20, 0, 1]), (4, [2, 0, 0]), (10, [1, 1, 1])])
    schema = "vec_id long, embedding array<double>"
    assert search(spark.createDataFrame(rows, schema), TopK()) == brute(rows, 10, lambda q: q % 10 == 0)


def test_products_that_do_not_fit_are_refused(spark):
    rows = whole([(0, [4e9, 4e9]), (1, [4e9, 4e9]), (2, [1.0, 2.0])])
    with pytest.raises(Exception, match="inner product of vectors 0 and 1 does not fit"):
        search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), TopK())


def test_clashing_extra_columns(spark):
    rows = [(i, [0.5 * i, 1.0]) for i in range(12)]
    frame = spark.createDataFrame([(*r, 5, "a", 1, 2) for r in rows], SCHEMA + ", id int, vector string, place int, n int")
    assert search(frame, TopK(k=3)) == brute(rows, 3, lambda q: q % 10 == 0)


def test_empty(spark):
    assert search(spark.createDataFrame([], SCHEMA), TopK()) == []
    assert search(spark.createDataFrame([(1, [1.0])], SCHEMA), TopK()) == []
    assert search(spark.createDataFrame([(10, [1.0])], SCHEMA), TopK()) == []
