import random

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm.paragraphs import Paragraphs, _paragraphs, cuts, remove_repeats, repeated_passages
from siftline.llm.tokens import BLANK, mix, text_bytes, words

SCHEMA = "doc_id long, text string"


def sets_of(text, params):
    """Paragraphs of a text, cut by the stated rule on the same word hashes: (first word, words, shingle set)."""
    own = text.split()
    _, _, h, _ = words(*text_bytes(pa.array([text])), BLANK)
    n = len(own)
    pair = [int(mix(h[i : i + 1] * np.uint64(0x9E3779B97F4A7C15) + h[i + 1 : i + 2])[0]) for i in range(n - 1)]
    begins = [0] if n else []
    for i in range(1, n - 1):
        left, right = pair[max(0, i - params.radius) : i], pair[i + 1 : i + 1 + params.radius]
        if all(pair[i] < x for x in left) and all(pair[i] <= x for x in right):
            begins.append(i)
    out = []
    for a, b in zip(begins, [*begins[1:], n]):
        if b - a >= params.shingle:
            part = [w.lower() for w in own[a:b]]
            out.append((a, b - a, frozenset(tuple(part[i : i + params.shingle]) for i in range(len(part) - params.shingle + 1)), tuple(part)))
    return out


def brute(rows, params):
    found = sorted(((doc, a, n, s, w) for doc, text in rows for a, n, s, w in sets_of(text or "", params)), key=lambda x: x[:2])
    parent = list(range(len(found)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(found)):
        for j in range(i + 1, len(found)):
            same = found[i][4] == found[j][4]
            common = len(found[i][3] & found[j][3])
            if same or common and 100 * common >= params.percent * len(found[i][3] | found[j][3]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    out, run = [], None
    for i, (doc, a, n, _, _) in enumerate(found):
        if root(i) == i:
            run = None
            continue
        kept = found[root(i)][:2]
        if run and run[0] == doc and run[1] + run[2] == a:
            run[2] += n
            run[5].add(kept[0])
        else:
            run = [doc, a, n, *kept, {kept[0]}]
            out.append(run)
    return sorted((*r[:5], sorted(r[5])) for r in out if r[2] >= params.passage_words)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    some = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passages = [some(rnd.randint(51, 90)) for _ in range(6)]
    rows, planted = [], []
    for doc in range(60):
        text = some(rnd.randint(0, 150))
        if doc % 3 == 0:
            passage = list(rnd.choice(passages))
            at = rnd.randint(0, len(text))
            text[at:at] = passage
            planted.append(doc)
        rows.append((doc, "".join(w + rnd.choice([" ", " ", "\n"]) for w in text)))
    return rows, planted


def found(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_same_passages_as_all_pairs(spark, seed):
    rows, planted = corpus(seed)
    params = Paragraphs(bands=7)
    got = found(repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(4), params))
    assert got == brute(rows, params)
    named = {r[0] for r in got} | {d for r in got for d in r[5]}
    assert named <= set(planted) and len(named) >= 0.9 * len(planted)


def test_near_paragraphs_are_verified_by_jaccard(spark):
    rnd = random.Random(5)
    base = [f"v{rnd.randrange(10**6)}" for _ in range(400)]
    rows = [(0, " ".join(base))]
    for doc in range(1, 25):
        own = list(base)
        for _ in range(12):
            own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
        rows.append((doc, " ".join(own)))
    params = Paragraphs(bands=7, radius=12)  # longer paragraphs, so that one changed word may leave 80 percent
    got = found(repeated_passages(spark.createDataFrame(rows, SCHEMA), params))
    want = brute(rows, params)
    assert got == want


def test_edge_cases(spark):
    rnd = random.Random(8)
    long = " ".join(f"u{rnd.randrange(10**6)}" for _ in range(60))
    rows = [(1, None), (2, ""), (3, "a b"), (None, long), (4, long), (4, long), (6, "the " * 20_000), (5, long + " tail")]
    got = found(repeated_passages(spark.createDataFrame(rows, SCHEMA)))
    assert {(r[0], r[3]) for r in got} <= {(5, 4), (6, 6)} and (5, 4) in {(r[0], r[3]) for r in got}
    assert found(repeated_passages(spark.createDataFrame([], SCHEMA))) == []


def test_removal_keeps_rows_and_columns(spark):
    rnd = random.Random(9)
    passage = " ".join(f"p{rnd.randrange(10**6)}" for _ in range(80))
    rows = [(1, f"one {passage} two", "k"), (2, f"three\n{passage}\nfour ä", "k"), (3, None, None), (4, "clean text", "k"), (None, "x", "k")]
    frame = spark.createDataFrame(rows, SCHEMA + ", kept string")
    out = remove_repeats(frame)
    assert out.columns == frame.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == rows[0][1] and got[3] is None and got[4] == "clean text" and got[None] == "x"
    assert got[2].startswith("three\n") and got[2].endswith("four ä") and len(got[2].split()) < 40


def test_large_group_of_copies(spark):
    rnd = random.Random(10)
    passage = " ".join(f"q{rnd.randrange(10**6)}" for _ in range(60))
    rows = [(i, passage) for i in range(2000)]
    got = found(repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(6)))
    assert {r[0] for r in got} == set(range(1, 2000)) and {r[3] for r in got} == {0}


def test_cuts_depend_on_nearby_words_only():
    a = [f"w{i}" for i in range(100)]
    _, _, h1, f1 = words(*text_bytes(pa.array(["x y z " + " ".join(a)])), BLANK)
    _, _, h2, f2 = words(*text_bytes(pa.array(["u", " ".join(a) + " t"])), BLANK)
    one = {c - 3 for c in cuts(h1, f1, 5).tolist()}
    two = {c - 1 for c in cuts(h2, f2, 5).tolist()}
    inside = set(range(6, 90))
    assert one & inside == two & inside and len(one & inside) > 3


def test_copies_meet_others_once_for_each_slice():
    rnd = random.Random(11)
    text = " ".join(f"q{rnd.randrange(10**6)}" for _ in range(60))
    batch = pa.record_batch({"doc_id": pa.array(range(500)), "text": pa.array([text] * 500)})
    rows = pa.Table.from_batches(_paragraphs(Paragraphs())(iter([batch])))
    key, kind = rows["key"].to_numpy(), rows["class"].to_numpy()
    bands = key & 15 != 15
    assert bands.sum() == Paragraphs().bands * len(set(kind.tolist())) and (~bands).sum() == 500 * len(set(kind.tolist()))
    assert len(set(key[~bands].tolist())) > 400
