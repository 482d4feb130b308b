import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftline.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1), ceiling=3):
    """Share, cap, reshare the excess among those below, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, fixed, left = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        above = {s for s in free if share[s] >= ceiling * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = float(ceiling * sizes[s])
            left -= ceiling * sizes[s]
        fixed |= above
        if len(fixed) == len(names):
            return target


def corpus(seed, n, sources=("b", "a", None, "é", "Z", "", "🙂", "aa")):
    rnd = random.Random(seed)
    shares = [1 / (i + 1) ** 2 for i in range(len(sources))]
    out = []
    for i in range(n):
        text = rnd.choice([None, "", " \t\n"]) if i % 17 == 0 else "w " * int(rnd.paretovariate(1.1) * 5 % 3000)
        out.append((i, rnd.choices(sources, shares)[0], text))
    return out


def check(spark, rows, **how):
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((d, s, size(t)) for d, s, t in rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for d, s, t in rows:
        sizes[s] += size(t)
        largest[s] = max(largest[s], size(t))
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        exact = r.target / r.source_size if r["size"] else 0
        assert r.copies in (int(exact), int(exact) + (exact > int(exact))) and r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) < largest[s] + 1e-6
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    check(spark, corpus(seed, 1500), group_rows=50)


def test_reruns_agree_whatever_the_partitions(spark):
    rows = corpus(4, 800) + [(None, "a", "same words here")] * 40
    docs = spark.createDataFrame(rows, SCHEMA)
    runs = [
        sorted(map(repr, mixing.mix(docs.repartition(n), keep=("doc_id", "text"), group_rows=64).collect())) for n in (1, 7)
    ]
    assert runs[0] == runs[1]
    other = sorted(map(repr, mixing.mix(docs, keep=("doc_id", "text"), group_rows=64, seed=2).collect()))
    assert other != runs[0]


def test_one_source_repeated_rows_and_zero_sizes(spark):
    check(spark, [(1, "only", "one two")] * 500, group_rows=20)
    check(spark, [(i, None, None) for i in range(5)])
    check(spark, [(1, "big", "w " * 100_000), (2, "small", "w"), (3, "none", "")])
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_sources(spark):
    rows = [(i, f"s{i % 700}", "w " * (i % 50 + (5000 if i % 700 == 3 else 0))) for i in range(3000)]
    check(spark, rows, group_rows=100)


def test_expand_and_names(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * (9 if i % 2 else 40), i, i) for i in range(60)], SCHEMA + ", target long, c0 long")
    mixed = mixing.mix(docs, keep=("doc_id", "target", "c0"))
    assert mixed.columns == ["doc_id", "c0", *mixing.RESULT]
    copies = Counter(r.doc_id for r in mixing.expand(mixed).collect())
    assert copies == Counter({r.doc_id: r.copies for r in mixed.collect() if r.copies})


def test_pivots_keep_words_and_chances():
    rnd = np.random.default_rng(5)
    sizes = rnd.integers(1, 400, 60)
    chances = rnd.random(60) * 0.98 + 0.01
    mean = np.zeros(60)
    for k in range(3000):
        rounded, left = mixing.pivot(sizes, chances, np.random.default_rng(k))
        open_ = [i for i, p in enumerate(rounded) if 0 < p < 1]
        assert open_ == ([] if left < 0 else [left])
        assert (rounded * sizes).sum() == pytest.approx((chances * sizes).sum())
        mean += rounded
    assert np.abs(mean / 3000 - chances).max() < 0.05


def test_groups_are_bounded_and_each_level_has_one_residual_of_a_group(spark, monkeypatch):
    seen = defaultdict(list)
    real = mixing.stage

    def noted(df, name):
        out = real(df, name)
        if name == "rounded":
            per = out.groupBy("source", "_group").agg({"*": "count"}).collect()
            seen["rows"].append(max(r[2] for r in per))
            seen["open"].append(max(r[2] for r in out.where("_open").groupBy("source", "_group").agg({"*": "count"}).collect() or [(0, 0, 0)]))
        return out

    monkeypatch.setattr(mixing, "stage", noted)
    check(spark, corpus(6, 3000), group_rows=10)
    assert len(seen["rows"]) == 3 and seen["rows"][0] <= 10 and max(seen["rows"]) <= mixing.FAN_IN
    assert seen["open"][:2] == [1, 1] and seen["open"][2] == 0
