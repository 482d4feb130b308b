import os
import random

import pandas as pd
import pyarrow as pa
import pytest

from siftline.operators import templates as T
from siftline.operators.parse import parse
from siftline.session import discard, stage
from pyspark.sql import functions as F


def check_invariants(rows):
    """Every member has its template's tokens, wildcards aside."""
    for r in rows:
        tokens, template = r.shape.split(" "), r.template.split(" ")
        assert len(tokens) == len(template)
        assert all(b == T.WILDCARD or a == b for a, b in zip(tokens, template)), r


def mined(df, **options):
    return T.mine(df, "raw", **options)


def as_set(df):
    return {tuple(r) for r in df.collect()}


MESSAGES = [
    "Job nightly finished after 30s", "Job hourly aborted by 10.0.0.1", "Job nightly finished after 45s",
    "Shelf anna was restocked", "Shelf bert was restocked", "Shelf carl was emptied", "Tape full", "Tape full", "", "   ", None,
]


def test_small_example(lines):
    counts = {r.template: (r.n, r.first_seq) for r in T.template_counts(mined(lines(MESSAGES))).collect()}
    assert counts == {
        "Job nightly finished after <*>": (2, 1), "Job hourly aborted by <*>": (1, 2), "Shelf <*> was <*>": (3, 4),
        "Tape full": (2, 7), "": (3, 9),
    }
    assigned = T.assign(lines(MESSAGES), "raw").collect()
    assert len(assigned) == len(MESSAGES)
    assert {r.template for r in assigned if not (r.raw or "").strip()} == {""}


def words(rng, n):
    return [rng.choice(["get", "put", "user", "disk", "node", "up", "down", "7", "a1", "x"]) for _ in range(n)]


@pytest.mark.parametrize("size", [60, 600])
def test_invariants_and_independence_of_partitioning(spark, size):
    rng = random.Random(size)
    texts = [" ".join(["start", *words(rng, rng.randint(2, 6))]) for _ in range(size)]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "seq BIGINT, raw STRING")
    rows = mined(df).collect()
    check_invariants(rows)
    assert sum(r.n for r in rows) == len(texts)
    assert len({r.shape for r in rows}) == len(rows)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        # all leaves by joins, all in tasks of their own, and both: the rounds are the same
        for partitions, batch, leaf_tokens in ((1, 50, 0 if size < 100 else 900), (4, 300, 1 << 20), (16, 10, 300)):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            assert as_set(mined(df.repartition(partitions, F.rand(3)), leaf_tokens=leaf_tokens)) == {tuple(r) for r in rows}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_large_leaf_finds_the_common_template(spark):
    texts = [f"user {''.join(random.Random(i).choices('abcdefgh', k=6))} logged in" for i in range(500)]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "seq BIGINT, raw STRING")
    counts = T.template_counts(mined(df)).collect()
    assert [(r.template, r.n, r.first_seq) for r in counts] == [("user <*> logged in", 500, 1)]


def test_clusters_are_numbered_by_rank_over_sparse_positions(spark):
    rows = [(f"t{i}", 1, (i * 7919 % 500) << 40) for i in range(500)]
    df = spark.createDataFrame(rows, "template STRING, n BIGINT, first_seq BIGINT").repartition(5)
    got = [r.template for r in T.number_templates(df).orderBy("cluster_id").collect()]
    assert got == [t for t, _, _ in sorted(rows, key=lambda r: r[2])]
    assert [r.cluster_id for r in T.number_templates(df).orderBy("cluster_id").collect()] == list(range(1, 501))


def test_child_limit_routes_late_first_tokens_together(lines):
    texts = [f"{c} common words here" for c in "abcdef"]
    few = {r.template for r in mined(lines(texts), max_children=4).collect()}
    assert few == {"a common words here", "b common words here", "c common words here", "<*> common words here"}


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_assignment_numbers_clusters_by_first_appearance(lines, max_bytes):
    texts = ["b 1", "a x", "b 2", "c c c", "a y"]
    got = T.assign(lines(texts), "raw", max_broadcast_bytes=max_bytes).orderBy("seq").collect()
    assert [(r.raw, r.cluster_id, r.template) for r in got] == [
        ("b 1", 1, "b <*>"), ("a x", 2, "a <*>"), ("b 2", 1, "b <*>"), ("c c c", 3, "c c c"), ("a y", 2, "a <*>"),
    ]


def test_masking(spark):
    df = spark.createDataFrame([("  a\t b1 c  d ",), ("1",), ("x=1,y",), ("",), ("no digits",)], "t STRING")
    got = [r[0] for r in df.select(T.masked(F.col("t"))).collect()]
    assert got == ["a <*> c d", "<*>", "<*>", "", "no digits"]


def test_text_choice_and_passthrough(lines):
    df = T.passthrough(parse(lines(['{"msg":"m"}', '{"msg":""}', "broken"]), "json")).orderBy("seq")
    assert [(r.cluster_id, r.template) for r in df.collect()] == [(-1, "m"), (-1, '{"msg":""}'), (-1, "broken")]


def test_many_leaves_cross_batch_borders(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        texts = [f"{k} item {'xyz'[i % 3]}" for k in ("alpha", "beta", "gamma", "delta") for i in range(30)]
        texts += [f"w{chr(97 + i)} once upon" for i in range(26)]
        df = spark.createDataFrame(list(enumerate(texts, 1)), "seq BIGINT, raw STRING")
        rows = mined(df).collect()
        check_invariants(rows)
        counts = {}
        for r in rows:
            counts[r.template] = counts.get(r.template, 0) + r.n
        assert counts["alpha item <*>"] == 30 and counts["delta item <*>"] == 30
        assert sum(counts.values()) == len(texts)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_a_leaf_of_half_a_million_tokens_needs_no_join_rounds(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(["Once", *rng.choices(["upon", "a", "time", "there", "was", "one"], k=2), *(f"w{chr(97 + i % 26)}{chr(97 + j)}" for j in rng.choices(range(26), k=60))]) for i in range(9000)]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "seq BIGINT, raw STRING")
    assert 9000 * 63 > 1 << 19  # more than fitted in a task before
    monkeypatch.setattr(T, "_partners", lambda *a: pytest.fail("a round by joins"))
    check_invariants(T.mine(df, "raw").collect())


def test_tokens_are_numbered_by_leaf():
    rows, words = T._numbered(pd.Series(["a <*> b", "b a <*>", " a é"]))
    assert [[words[t] for t in r] for r in rows] == [["a", "<*>", "b"], ["b", "a", "<*>"], ["", "a", "é"]]
    assert (rows == 0).tolist() == [[False, True, False], [False, False, True], [False, False, False]]
    rows, words = T._numbered(pd.Series(["", "x"]))
    assert [[words[t] for t in r] for r in rows] == [[""], ["x"]]


def rounds_by_hand(rows, branch):
    """What each template of a leaf joined, and the templates made; rows of (id, tokens) by id."""
    width = len(rows[0][1])
    given = 0 if branch == T.WILDCARD or width <= 2 else 1
    live, able, joined, led = {i: list(t) for i, t in rows}, {i for i, _ in rows}, {}, {}
    equal = lambda a, b: "".join("01"[x == y and x != T.WILDCARD] for x, y in zip(a, b))
    while True:
        first, near = {}, {}
        for i, tokens in live.items():
            for key in enumerate(tokens):
                first.setdefault(key, i)
        for i in [i for i in live if i in able]:
            names = [first[p, t] for p, t in enumerate(live[i]) if p >= given and t != T.WILDCARD and first[p, t] != i]
            if not names or (len(names) + given) / width < T.SIMILARITY:
                able.discard(i)
                continue
            best = sorted(set(names), key=lambda c: (-names.count(c), c))[: T.COMPARED]
            masks = [(c, equal(live[i], live[c])) for c in best]
            near[i] = [(c, m) for c, m in masks if m.count("1") / width >= T.SIMILARITY]
        near = {i: found for i, found in near.items() if found}
        if not near:
            return joined, {i: t for i, t in led.items() if i not in joined}
        groups = {}
        for i, found in near.items():
            found = [x for x in found if x[0] not in near]
            if found:
                c, mask = min(found, key=lambda x: (-x[1].count("1"), x[0]))
                groups.setdefault(c, []).append((i, mask))
        for c, members in groups.items():
            masks, chosen = [m for _, m in members], "1" * width
            for mask in sorted(set(masks), key=lambda m: (masks.count(m), m.count("1"), m), reverse=True):
                narrower = "".join(min(x) for x in zip(chosen, mask))
                if narrower.count("1") / width < T.SIMILARITY:
                    break
                chosen = narrower
            joined |= {i: c for i, m in members if all(b == "1" for a, b in zip(chosen, m) if a == "1")}
            live[c] = [t if b == "1" else T.WILDCARD for t, b in zip(live[c], chosen)]
            led[c] = " ".join(live[c])
        live = {i: t for i, t in live.items() if i not in joined and (i in able or i in groups)}


@pytest.mark.parametrize("many", [1, 1 << 30])
def test_leaves_of_a_group_do_their_rounds_by_themselves(monkeypatch, many):
    monkeypatch.setattr(T, "MANY_TEMPLATES", many)
    monkeypatch.setattr(T, "CELLS", 40)
    rng, merged = random.Random(4), 0
    for width, n, branches in ((1, 9, 1), (2, 30, 2), (3, 60, 3), (5, 150, 1), (5, 150, 3), (9, 120, 2)):
        ids, leaves = iter(rng.sample(range(1 << 40), n)), {}
        for text in {" ".join(rng.choice(["a", "b", "c", "d", T.WILDCARD, f"x{rng.randrange(40)}"]) for _ in range(width)) for _ in range(n)}:
            leaves.setdefault([T.WILDCARD, "A", "B"][rng.randrange(branches)], []).append((next(ids), text.split(" ")))
        rows, expected = [], set()
        for branch, leaf in leaves.items():
            leaf = sorted((i, t if branch == T.WILDCARD else [branch, *t[1:]]) for i, t in leaf)
            leaf = [x for k, x in enumerate(leaf) if x[1] not in [t for _, t in leaf[:k]]]
            rows += [{"id": i, "n_tokens": width, "branch": branch, "template": " ".join(t), "able": True} for i, t in leaf]
            joined, made = rounds_by_hand(leaf, branch)
            expected |= {(i, c, None) for i, c in joined.items()} | {(i, None, t) for i, t in made.items()}
        rng.shuffle(rows)
        got = T._leaf_rounds(pa.Table.from_pylist(rows))
        assert {(r["id"], r["rep"], r["template"]) for r in got.to_pylist()} == expected
        merged += len(expected)
    assert merged > 100


def test_templates_without_an_id_say_nothing():
    texts = {7: "a b c", 9: "a b d", None: "a b e"}
    rows = [{"id": i, "n_tokens": 3, "branch": "a", "template": t, "able": True} for i, t in texts.items()]
    assert T._leaf_rounds(pa.Table.from_pylist(rows)).to_pylist() == [
        {"id": 9, "rep": 7, "template": None}, {"id": 7, "rep": None, "template": "a b <*>"},
    ]


def test_only_merged_templates_are_carried_to_the_lines(lines, monkeypatch):
    staged = {}
    monkeypatch.setattr(T, "stage", lambda df, name: staged.setdefault(name, []).append(out := stage(df, name)) or out)
    monkeypatch.setattr(T, "discard", lambda *tables: None)
    texts = ["a long line of its own", "user ann went home", " user  bob went\thome ", "code 7", "code 8", "", None]
    got = T.assign(lines(texts), "raw", max_broadcast_bytes=0).orderBy("seq").collect()
    assert [(r.raw, r.template, r.cluster_id) for r in got] == [
        (texts[0], texts[0], 1), (texts[1], "user <*> went home", 2), (texts[2], "user <*> went home", 2),
        (texts[3], "code <*>", 3), (texts[4], "code <*>", 3), ("", "", 4), (None, "", 4),
    ]
    mined = staged["mined"][0].collect()
    assert sorted((r.n, r.template or "") for r in mined) == [(1, ""), (1, "user <*> went home"), (1, "user <*> went home"), (2, ""), (2, "")]


def test_masking_of_white_space_and_digits_beyond_ascii(spark):
    marks = [chr(i) for i in (9, 10, 13, 28, 31, 32, 48, 0x7F, 0x85, 0xA0, 0xA1, 0x167F, 0x1680, 0x2003, 0x2029, 0x3000, 0x661)]
    df = spark.createDataFrame([(f"{a}x{m}{a}1é{m}y{b}",) for m in marks for a in ("", " ") for b in ("", " ")], "t STRING")
    whole = F.regexp_replace(F.trim(F.regexp_replace("t", r"(?U)\s+", " ")), r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", T.WILDCARD)
    assert df.where(~T.masked(F.col("t")).eqNullSafe(whole)).collect() == []


def test_discarded_tables_leave_others(spark):
    one, two = stage(spark.range(3).toDF("id"), "one"), stage(spark.range(4).toDF("id"), "two")
    path = one.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    discard(one)
    assert not os.path.exists(path) and two.count() == 4
