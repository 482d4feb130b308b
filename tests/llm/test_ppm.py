import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm.ppm import Ppm, code_lengths, context_counts, fit, identify
from siftline.llm.tokens import text_bytes

TRAIN = [
    ("the cat sat on the mat and the dog ate", "en"),
    ("that is the other thing", "en"),
    ("der hund und die katze über den weg", "de"),
    ("", "de"),
    (None, "en"),
    ("no language here", None),
]


def counts_of(rows, order):
    seen = defaultdict(int)
    for text, lang in rows:
        if text is None or lang is None:
            continue
        data = text.encode()
        for i in range(len(data)):
            for n in range(1, order + 2):
                if i - n + 1 >= 0:
                    seen[lang, data[i - n + 1 : i + 1]] += 1
    return seen


def brute(text, lang, seen, order):
    children = defaultdict(dict)
    for (name, gram), n in seen.items():
        if name == lang:
            children[gram[:-1]][gram[-1]] = n
    data, bits = text.encode(), 0.0
    for i, byte in enumerate(data):
        for n in range(min(order, i), -1, -1):
            known = children.get(data[i - n : i])
            if not known:
                continue
            total, distinct = sum(known.values()), len(known)
            if byte in known:
                bits += math.log2((total + distinct) / known[byte])
                break
            bits += math.log2((total + distinct) / distinct)
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order", [1, 3])
def test_exact_code_lengths(spark, order):
    frame = spark.createDataFrame(TRAIN, "text string, lang string")
    tree = fit(frame, Ppm(order=order))
    assert tree.languages == ["de", "en"]
    texts = ["the hund", "", "über", "xyz 123", None, "t", "a und the"]
    bits = code_lengths(*text_bytes(pa.array(texts)), tree)
    seen = counts_of(TRAIN, order)
    want = [[brute(t or "", lang, seen, order) for lang in tree.languages] for t in texts]
    assert np.allclose(bits, want, rtol=1e-5)


def test_counts(spark):
    frame = spark.createDataFrame(TRAIN, "text string, lang string").repartition(3)
    got = {
        (r.lang, r.value.to_bytes(r.length, "big")): r.n for r in context_counts(frame, Ppm(order=2)).collect()
    }
    assert got == counts_of(TRAIN, 2)


def test_cut_tree_keeps_prefixes(spark):
    tree = fit(spark.createDataFrame(TRAIN, "text string, lang string"), Ppm(max_nodes=20))
    assert len(tree.known) == 21
    assert sorted(tree.child[tree.child >= 0]) == list(range(1, 21))
    assert np.isfinite(code_lengths(*text_bytes(pa.array(["the über katze"])), tree)).all()


def test_held_out_accuracy_and_rows_without_letters(spark):
    rnd = random.Random(3)
    parts = {"aa": ["ban", "tor", "mil", "su"], "bb": ["kel", "öst", "rif", "ga"]}
    make = lambda lang: " ".join(rnd.choice(parts[lang]) + rnd.choice(parts[lang]) for _ in range(12))
    train = [(make(lang), lang) for lang in parts for _ in range(40)]
    tree = fit(spark.createDataFrame(train, "text string, lang string"))
    rows = [(i, make(lang), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    rows += [(100, None, "aa"), (101, "", "aa"), (102, "12 34 !!", None), (103, "x" * 300_000, None), (103, "é", None)]
    frame = spark.createDataFrame([r + ("z",) for r in rows], "doc_id long, text string, lang string, score string")
    got = identify(frame, tree, ["doc_id"]).collect()
    assert len(got) == len(rows)
    want = {i: lang for i, _, lang in rows[:40]}
    assert all(r.lang_pred == want[r.doc_id] for r in got if r.doc_id < 40)
    assert [(r.lang_pred, r.score) for r in got if 100 <= r.doc_id <= 102] == [("und", 0.0)] * 3
    assert all(0 < r.score <= 1 for r in got if r.doc_id < 100 or r.doc_id == 103)


def test_hundreds_of_languages(spark):
    rnd = random.Random(8)
    words = {f"l{i:03}": ["".join(rnd.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(6)] for i in range(300)}
    train = [(" ".join(own), lang) for lang, own in words.items()]
    tree = fit(spark.createDataFrame(train, "text string, lang string").repartition(4))
    assert tree.languages == sorted(words) and "whole" not in vars(tree)
    texts = [" ".join(rnd.choices(own, k=4)) for own in words.values()] + ["", "zzz é"]
    bits = code_lengths(*text_bytes(pa.array(texts)), tree)
    seen = counts_of(train, 3)
    chosen = [0, 63, 64, 150, 299, 300, 301]
    want = [[brute(texts[t], lang, seen, 3) for lang in tree.languages] for t in chosen]
    assert np.allclose(bits[chosen], want, rtol=1e-5)
    assert "whole" not in vars(tree)  # no table of all languages
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in identify(rows, tree, ["doc_id"]).collect()}
    assert [got[i] for i in range(300)] == list(words) and got[300] == "und"


def test_nothing_to_learn_from(spark):
    tree = fit(spark.createDataFrame([("a", None)], "text string, lang string"))
    assert tree.languages == []
    frame = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [tuple(r) for r in identify(frame, tree, ["doc_id"]).collect()] == [(1, "und", 0.0)]
    assert identify(frame.limit(0), tree, ["doc_id"]).collect() == []


def test_a_rare_language_beside_many_strings_keeps_all_its_contexts(spark):
    rnd = random.Random(4)
    junk = [("".join(chr(rnd.randrange(33, 1500)) for _ in range(40_000)), "zz") for _ in range(4)] * 3
    rare = [("qu'est-ce que c'est", "fr"), ("der hund und die katze", "de")]
    train = junk + rare
    frame = spark.createDataFrame(train, "text string, lang string")
    tree = fit(frame)
    seen = counts_of(train, 3)
    assert len(tree.known) == len({gram for _, gram in seen}) + 1 > 100_001
    texts = ["que c'est la katze", "hund und"]
    bits = code_lengths(*text_bytes(pa.array(texts)), tree)
    want = [[brute(t, lang, seen, 3) for lang in tree.languages] for t in texts]
    assert np.allclose(bits, want, rtol=1e-5)
    small = fit(spark.createDataFrame(rare, "text string, lang string"), Ppm(dense=3))
    whole = fit(spark.createDataFrame(rare, "text string, lang string"))
    assert len(small.deep) and not len(whole.deep)
    assert np.array_equal(code_lengths(*text_bytes(pa.array(texts)), small), code_lengths(*text_bytes(pa.array(texts)), whole))
