import random

import numpy as np
import pytest

from siftline.llm.paragraphs import all_passages, remove_repeats
from siftline.llm.passages import Passages, _chains, winnowed

SCHEMA = "doc_id long, text string"


def planted(size, n=60):
    """Pairs of documents with a passage of their own; one word in the middle of the second one's differs."""
    rnd = random.Random(size)
    some = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    rows, at = [], {}
    for pair in range(n):
        passage = some(size)
        edited = [*passage]
        edited[size // 2] = "edit"
        for doc, own in ((2 * pair, passage), (2 * pair + 1, edited)):
            before = some(rnd.randint(0, 80))
            rows.append((doc, " ".join([*before, *own, *some(rnd.randint(0, 80))])))
            at[doc] = len(before)
    return rows, at


@pytest.mark.parametrize("size", [51, 55, 60])
def test_edited_passages_are_found_whole(spark, size):
    rows, at = planted(size)
    got = sorted(tuple(r) for r in all_passages(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())
    assert [(r[0], r[3], r[5]) for r in got] == [(d, d - 1, [d - 1]) for d in range(1, len(rows), 2)]
    # a linked paragraph at the end may hold a few words of what follows
    assert all(at[r[0]] - 3 <= r[1] <= at[r[0]] and at[r[0]] + size <= r[1] + r[2] <= at[r[0]] + size + 3 for r in got)


def test_edited_passages_are_cut_out(spark):
    rows, at = planted(51)
    left = {r.doc_id: r.text for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    for doc, text in rows:
        own = text.split()
        want = own[: at[doc]] + own[at[doc] + 51 :] if doc % 2 else own
        assert set(left[doc].split()) <= set(want) and len(want) - 6 <= len(left[doc].split())


def test_equal_passages_insertions_and_new_text(spark):
    rnd = random.Random(1)
    some = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    base, new = some(120), some(30)
    rows = [(0, base), (1, [*some(9), *base[:55], "x", "y", *base[55:], *some(7)]), (2, [*base[:60], *new, *base[60:]]), (3, some(40) + base[:51]), (4, some(90))]
    got = all_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], SCHEMA)).collect()
    assert sorted(tuple(r[:3]) for r in got) == [(1, 9, 122), (2, 0, 60), (2, 90, 60), (3, 40, 51)]


def test_every_window_has_a_seed():
    rnd = np.random.default_rng(2)
    begin = np.array([0, 5, 5, 400])
    runs = rnd.integers(0, 1 << 60, 400).astype(np.uint64)
    at = winnowed(runs, begin, Passages().window).tolist()
    assert at[0] == int(np.argmin(runs[:5])) and at[1] >= 5
    assert all(5 + k + int(np.argmin(runs[5 + k : 17 + k])) in at for k in range(395 - 11))


def plain_chains(segments, gap):
    """The rule in words: the oldest chain that a segment goes on."""
    chains = []
    for i, j, n in segments:
        for chain in chains:
            pi, pj, pn = chain[-1]
            over = max(0, pi + pn - i, pj + pn - j)
            if pi < i and pj < j and over < n and i + over - pi - pn <= gap and j + over - pj - pn <= gap:
                chain.append((i + over, j + over, n - over))
                break
        else:
            chains.append([(i, j, n)])
    return chains


def test_chains_are_those_of_the_plain_rule():
    rnd = random.Random(4)
    for _ in range(200):
        segments = sorted({(rnd.randrange(150), rnd.randrange(60), rnd.randint(1, 30)) for _ in range(rnd.randint(0, 60))})
        assert sorted(_chains(segments, Passages())) == sorted(plain_chains(segments, Passages().gap))


def test_chains_look_at_near_diagonals_only():
    class Counted(int):
        compared = 0

        def __add__(self, other):
            Counted.compared += 1
            return int(self) + int(other)

        __radd__ = __add__

    # a word said again and again: every place goes with the same place of the other text
    segments = [(i, 5000 - 40 * i, Counted(60)) for i in range(120)]
    assert len(_chains(segments, Passages())) == 120
    assert Counted.compared < 20 * 120
