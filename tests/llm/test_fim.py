import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.llm import fim
from siftline.llm.tokens import text_bytes

SCHEMA = "doc_id long, text string"
ODD = [None, "", "a", " ", "é", "🙂🙂", "abc", "has <P> mark", "<S>", "x<M>", "ends <", "ends <P", ">", "S>M>P>", "<<<", "\x00\n\r", "日本 text"]


def cut(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "", re.DOTALL)


def brute(doc, text, rate=90, spm_rate=20):
    parts, text = cut(text), text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(parts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(p) for p in (parts[:a], parts[a:b], parts[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc, n, "plain", None, None, text
    if h4 % 100 < spm_rate:
        return doc, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def corpus(seed, n):
    rnd = random.Random(seed)
    alphabet = ["word", "A", " ", "\n", "<", ">", "<P", "S>", "é", "🙂", "1", "'"]
    return [(i, rnd.choice(ODD) if i % 9 == 0 else "".join(rnd.choices(alphabet, k=rnd.randint(0, 200)))) for i in range(n)]


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_and_back(spark, seed):
    rows = corpus(seed, 400) + [(None, "no id at all"), (None, None), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", form string").repartition(5)
    made = fim.transform(docs, keep=("doc_id", "form"))
    assert made.columns == ["doc_id", *fim.RESULT]
    got = made.select("*", fim.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert order(tuple(r)[:6] for r in got) == order(brute(*r) for r in rows)
    assert order((r.doc_id, r.back) for r in got) == order((d, t or "") for d, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rates(spark):
    rows = corpus(3, 60)
    docs = spark.createDataFrame(rows, SCHEMA)
    for rate, spm in ((0, 20), (100, 0), (100, 100)):
        got = fim.transform(docs, fim.Fim(rate=rate, spm_rate=spm)).collect()
        assert order(map(tuple, got)) == order(brute(*r, rate, spm) for r in rows)


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "one two three", "k", 5)], SCHEMA + ", text2 string, c0 int")
    row = fim.transform(docs, keep=("c0", "text", "doc_id")).first()
    assert (row.c0, row.text, row.doc_id) == (5, "one two three", 1)


def test_every_rank_is_reached_exactly():
    texts = ["", "ab cd", "é🙂x", None, "a" * 50, "x y " * 3000, "7"]
    points, first = fim.units(*text_bytes(pa.array(texts, pa.string())))
    lanes = fim.SkipList(points, first)
    assert len(lanes.lanes) > 3
    for i, text in enumerate(texts):
        parts = cut(text)
        assert lanes.n[i] == len(parts)
        ranks = np.arange(len(parts) + 1)
        want = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        assert lanes.points_before(np.full(len(ranks), i), ranks).tolist() == want.tolist()
    for lane, above in zip(lanes.lanes, lanes.lanes[1:]):
        assert len(above.units) <= len(lane.units) and above.units.sum() == lane.units.sum()


def test_long_text_bad_bytes_and_empty_table(spark):
    long = "word 1 é " * 300_000
    made = fim.transform(spark.createDataFrame([(5, long)], SCHEMA)).first()
    assert tuple(made) == brute(5, long)
    raw = spark.createDataFrame([(1, bytearray(b"ok \xff\xfe end"))], "doc_id long, text binary")
    made = fim.transform(raw.withColumn("text", F.expr("cast(text as string)"))).first()
    assert tuple(made) == brute(1, "ok �� end")
    assert fim.transform(spark.createDataFrame([], SCHEMA)).collect() == []
