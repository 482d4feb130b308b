import hashlib
import random
import re

import numpy as np
import pytest

from siftline.llm.decontaminate import Decontamination, decontaminate, find
from siftline.llm.fm_index import FmIndex, Wavelet, suffix_array

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        own = split(text)
        if item is None or not own:
            continue
        for i in range(max(1, len(own) - size + 1)):
            windows.setdefault(tuple(own[i : i + size]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        own = split(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(own) - n + 1):
                if (w := tuple(own[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        out.append((doc, len(own), len(hit), sorted(found)))
    return sorted(out, key=repr)


def rows(frame):
    return sorted(((r["doc_id"], r["__n_words"], r["__n_hit"], list(r["__items"])) for r in frame.collect()), key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "and", "a", "in", "ça", "x1", *(f"w{i}" for i in range(60))])
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items = [(i, t) if len(t.split()) > 1 else (i, f"unique{i}") for i, t in items]
    docs = []
    for i in range(60):
        own = [word() for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 3)):
            passage = rnd.choice(items)[1].split()
            a = rnd.randint(0, len(passage))
            at = rnd.randint(0, len(own))
            own[at:at] = passage[a:] if rnd.random() < 0.5 else passage
        docs.append((i, rnd.choice([" ", "-- ", "\n"]).join(w.title() if rnd.random() < 0.2 else w for w in own)))
    return docs, items


@pytest.mark.parametrize("seed,block", [(1, 1 << 19), (2, 40), (3, 1 << 19)])
def test_same_hits_as_brute_force(spark, seed, block):
    docs, items = corpus(seed)
    found = find(
        spark.createDataFrame(docs, DOCS).repartition(3),
        spark.createDataFrame(items, ITEMS),
        ["doc_id"],
        Decontamination(block=block),
    )
    assert rows(found) == brute(docs, items)


def test_edge_cases(spark):
    items = [(1, None), (2, ""), (3, "..."), (4, "one two"), (4, "three four"), (None, "alone here"), (5, "One  TWO")]
    docs = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "x one, two!"), (7, "alone here"), (8, "one " * 50_000), (9, "four three four")]
    found = find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), ["doc_id"])
    assert rows(found) == brute(docs, items)


def test_windows_of_many_items_in_blocks(spark):
    # one window that all items share, each item with windows of its own, and an item id on several rows
    shared = " ".join(f"s{i}" for i in range(10))
    items = [(i % 150, f"{shared} own{i} own{i + 1}") for i in range(200)]
    docs = [(1, shared), (2, f"x {shared} own7 own8 y"), (3, " ".join(f"s{i}" for i in range(9))), (4, f"own1 {items[-1][1]}")]
    for block in (25, 1 << 19):
        found = find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), ["doc_id"], Decontamination(block=block))
        assert rows(found) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert find(docs, items, ["doc_id"]).collect() == []
    some = spark.createDataFrame([(1, "a b")], DOCS)
    assert rows(find(some, items, ["doc_id"])) == [(1, 2, 0, [])]


def test_cut_texts(spark):
    items = spark.createDataFrame([(1, "secret answer is forty two")], ITEMS)
    docs = [(1, "Hello! (Secret answer is forty-two), bye. Ä", "k"), (2, "clean", "k"), (3, None, "k")]
    frame = spark.createDataFrame(docs, DOCS + ", n_words string")
    got = decontaminate(frame, items)
    assert got.columns == frame.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, "Hello! (), bye. Ä", "k"), (2, "clean", "k"), (3, None, "k")]


def test_query_digest(spark, tmp_path):
    from siftline.llm.queries import op9_decontamination

    docs, items = corpus(5)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {d: (n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for d, n, h, x in brute(docs, items)}
    got = {r[0]: tuple(r[1:]) for r in op9_decontamination(spark, str(tmp_path)).collect()}
    assert got == want


def test_index_parts():
    rnd = np.random.default_rng(0)
    text = rnd.integers(0, 5, 300)
    text[-1] = 0
    order = suffix_array(text)
    gaps = text == 0
    named = np.where(gaps, np.cumsum(gaps) - 1000, text).tolist()
    assert order.tolist() == sorted(range(300), key=lambda i: named[i:])
    wavelet = Wavelet(text, 5)
    places = np.arange(300)
    assert (wavelet.access(places) == text).all()
    assert all(wavelet.rank(np.full(300, c), places).tolist() == [int((text[:i] == c).sum()) for i in places] for c in range(5))
    index = FmIndex(text, 5, sample=3)
    phrases = np.array([[0, 1, 2], [3, 4, 4], [0, 0, 1]])
    lengths = np.array([2, 3, 1])
    low, high = index.search(phrases, lengths)
    for k in range(3):
        phrase = phrases[k, 3 - lengths[k] :]
        want = [i for i in range(300) if text[i : i + len(phrase)].tolist() == phrase.tolist()]
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want
