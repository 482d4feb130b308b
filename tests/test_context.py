import random

import pytest
from pyspark.sql import functions as F

from siftline.operators.context import context
from siftline.operators.predicates import level_in, matches
from siftline.operators.parse import parse


def brute(hits, n):
    """Kept positions with their group, by walking over the rows."""
    kept = [i for i in range(len(hits)) if any(hits[max(0, i - n) : i + n + 1])]
    out, group = [], 0
    for j, i in enumerate(kept):
        new = j > 0 and i - kept[j - 1] > 1
        group += new
        out.append((i + 1, hits[i], group, new))
    return out


def rows(df, order="seq", key=()):
    return [tuple(r) for r in df.orderBy(*key, order).select(*key, order, "hit", "group_id", "new_group").collect()]


PLANS = {"broadcast": {}, "chunks": dict(max_broadcast_bytes=0), "tiny chunks": dict(max_broadcast_bytes=0, chunk_rows=3)}


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("share, n", [(0.02, 1), (0.02, 5), (0.3, 1), (0.3, 2), (0.0, 2), (1.0, 3)])
def test_against_brute_force(spark, plan, share, n):
    rng = random.Random(f"{share}{n}")
    hits = [rng.random() < share for _ in range(300)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hits, 1)], "seq BIGINT, h BOOLEAN")
    assert rows(context(df, F.col("h"), n, **PLANS[plan])) == brute(hits, n)


@pytest.mark.parametrize("plan", PLANS)
def test_per_key_with_one_key_holding_most_rows(spark, plan):
    rng = random.Random(5)
    files = {"a": 3, "hot": 400, "z": 20}
    hits = {f: [rng.random() < 0.1 for _ in range(size)] for f, size in files.items()}
    df = spark.createDataFrame([(f, i, h) for f in hits for i, h in enumerate(hits[f], 1)], "f STRING, no BIGINT, h BOOLEAN")
    want = [(f, *row) for f in sorted(hits) for row in brute(hits[f], 2)]
    assert rows(context(df, F.col("h"), 2, "no", ["f"], **PLANS[plan]), "no", ["f"]) == want


def level_lines(lines, levels):
    return parse(lines([f"2024-01-15 14:00:0{i % 10} {lv} text" for i, lv in enumerate(levels)]))


@pytest.mark.parametrize("plan", PLANS)
def test_groups_and_separators(lines, plan):
    two = level_lines(lines, ["INFO", "ERROR", "INFO", "INFO", "INFO", "ERROR", "INFO"])
    got = rows(context(two, level_in(["ERROR"]), 1, **PLANS[plan]))
    assert [(r[0], r[3]) for r in got] == [(1, False), (2, False), (3, False), (5, True), (6, False), (7, False)]
    near = level_lines(lines, ["ERROR", "INFO", "ERROR"])
    assert not any(r[3] for r in rows(context(near, level_in(["ERROR"]), 2, **PLANS[plan])))
    far = level_lines(lines, ["ERROR", "INFO", "INFO", "INFO", "INFO", "ERROR"])
    assert sum(r[3] for r in rows(context(far, level_in(["ERROR"]), 1, **PLANS[plan]))) == 1


def test_inverted_context_counts_rows_without_level_as_hits(lines):
    df = parse(lines(["INFO a", "ERROR x", "INFO b", "nothing", "ERROR y", "ERROR z", "ERROR w"]))
    got = rows(context(df, level_in(["ERROR"]), 1, invert=True))
    assert [(r[0], r[1]) for r in got] == [(1, True), (2, False), (3, True), (4, True), (5, False)]


@pytest.mark.parametrize("n", [0, -2])
def test_no_context_is_a_filter(lines, n):
    df = parse(lines(["ERROR a", "INFO b", "ERROR c"]))
    assert rows(context(df, matches("error"), n)) == [(1, True, 0, False), (3, True, 0, False)]


def brute_positions(rows, n):
    """Kept positions with their group, from positions alone."""
    hits = [p for p, h in rows if h]
    out, group, last = [], -1, None
    for p, h in rows:
        near = [q for q in hits if abs(q - p) <= n]
        if not near:
            continue
        starts = [q for i, q in enumerate(hits) if i == 0 or q - hits[i - 1] > 2 * n + 1]
        own = sum(q <= p + n for q in starts) - 1
        out.append((p, h, own, own > 0 and own != group))
        group = own
    return out


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("step, n", [(4, 2), (2, 3), (3, 1), (5, 8), (1, 2)])
def test_gaps_between_positions(spark, plan, step, n):
    rng = random.Random(step)
    at, data = 1, []
    for _ in range(200):
        data.append((at, rng.random() < 0.2))
        at += rng.randint(1, step) if step != 4 else 4
    df = spark.createDataFrame(data, "seq BIGINT, h BOOLEAN").repartition(3)
    assert rows(context(df, F.col("h"), n, **PLANS[plan])) == brute_positions(data, n)
