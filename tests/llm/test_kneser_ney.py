import math
import random
import re
from collections import Counter

import pytest

from siftline.llm.kneser_ney import discounts, score, train

SCHEMA = "doc_id long, text string"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), "</s>"]


def fixed(n):
    return discounts(*(n.get(k, 0) for k in (1, 2, 3, 4))).tolist()


class Brute:
    def __init__(self, texts):
        own = [tokens(t) for t in texts]
        self.words = Counter(w for t in own for w in t)
        self.pairs = Counter(p for t in own for p in zip(["<s>", *t], t))
        self.context = Counter()
        for (u, _), n in self.pairs.items():
            self.context[u] += n
        self.before = Counter(w for _, w in self.pairs)
        self.upper = fixed(Counter(self.pairs.values()))
        self.lower = fixed(Counter(self.before.values()))
        self.v, self.n = len(self.words), sum(self.words.values())

    def chance(self, w, u):
        if not self.pairs:
            return 1.0
        rest = sum(self.lower[min(n, 3)] for n in self.before.values()) / len(self.pairs)
        p = rest / (self.v + 1)
        if w in self.before:
            p += (self.before[w] - self.lower[min(self.before[w], 3)]) / len(self.pairs)
        if u not in self.context:
            return p
        followers = [n for (x, _), n in self.pairs.items() if x == u]
        left = sum(self.upper[min(n, 3)] for n in followers)
        seen = self.pairs.get((u, w), 0)
        return (seen - self.upper[min(seen, 3)] + left * p) / self.context[u]

    def row(self, text):
        own = tokens(text)
        base = sum(math.log10((self.words.get(w, 0) + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in own)
        total = sum(math.log10(self.chance(w, u)) for u, w in zip(["<s>", *own], own))
        return len(own), sum(w in self.words for w in own), base, total


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    return [" ".join(vocabulary[int(60 * rnd.random() ** 2)] for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_scores_as_brute_force(spark, seed):
    texts = corpus(seed, 120) + ["The THE the", "the " * 400, None, "", " \n"]
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], SCHEMA + ", score double").repartition(6)
    brute = Brute(texts)
    model = train(frame)
    assert (model.n_tokens, model.n_words) == (brute.n, brute.v)
    assert model.discount.tolist() == pytest.approx(brute.upper) and model.lower.tolist() == pytest.approx(brute.lower)
    other = [*corpus(seed + 10, 20), "unknown words here w1", None, "", "w1", "É w2\tw3", "x " * 100_000]
    rows = spark.createDataFrame([(i, t, "z") for i, t in enumerate(other)] + [(0, other[0], "z")], SCHEMA + ", n_tokens string")
    got = score(rows, model, ["doc_id"]).collect()
    assert len(got) == len(other) + 1
    for r in got:
        n, known, base, total = brute.row(other[r.doc_id]) if len(other[r.doc_id] or "") < 9999 else (100_001, 1, None, None)
        assert (r["n_tokens"], r["n_known"]) == (n, known)
        if base is not None:
            assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(total)


def test_probabilities_add_up_to_one():
    brute = Brute(corpus(4, 50))
    for u in ["<s>", "w1", "w59", "never"]:
        assert sum(brute.chance(w, u) for w in [*brute.words, "unknown"]) == pytest.approx(1)


def test_better_than_unigrams_on_held_out_text(spark):
    rnd = random.Random(6)
    follows = {i: [rnd.randrange(50) for _ in range(3)] for i in range(50)}

    def text():
        at, out = rnd.randrange(50), []
        for _ in range(80):
            at = rnd.choice(follows[at])
            out.append(f"w{at}")
        return " ".join(out)

    model = train(spark.createDataFrame([(i, text()) for i in range(150)], SCHEMA))
    rows = score(spark.createDataFrame([(i, text()) for i in range(20)], SCHEMA), model, ["doc_id"]).collect()
    assert all(r.score > r.base_score for r in rows)


def test_nothing_to_learn_from(spark):
    model = train(spark.createDataFrame([], SCHEMA))
    rows = score(spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA), model, ["doc_id"]).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    assert score(spark.createDataFrame([], SCHEMA), model, ["doc_id"]).collect() == []


def test_query_tells_the_training_tokens(spark, tmp_path):
    from siftline.llm.queries import op4_kneser_ney
    from siftline.llm.tokens import crc_remainder

    rows = [*enumerate(corpus(7, 40)), (40, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    train_rows = docs.where(crc_remainder("doc_id", 10) != 0).collect()
    found = op4_kneser_ney(spark, str(tmp_path))
    assert dict(found.dtypes)["train_tokens"] == "bigint"
    got = found.collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {sum(len(tokens(r.text)) for r in train_rows)}


def test_no_discount_takes_all_or_nothing():
    for counts in ((100, 10, 10, 50), (5, 100, 1, 1), (1, 1, 1, 1), (0, 1, 2, 3), (10, 1, 40, 1), (1000, 100, 20, 400)):
        d = discounts(*counts)
        assert d[0] == 0 and all(0 < d[k] < k for k in (1, 2, 3))


def test_scores_are_finite_where_counts_of_counts_are_odd(spark):
    # many more bigrams that occur four times than three times: the formula gives D3 below 0
    texts = [f"p{i} u{i}" for i in range(100)] + [f"q{i} v{i}" for i in range(10)] * 2 + [f"r{i} w{i}" for i in range(3)] * 3
    texts += [f"s{i} z{i}" for i in range(50)] * 4
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "p1 u3", "s1 unseen", "never met"])], "doc_id long, text string")
    model = train(docs.where(f"doc_id < {len(texts)}").select("text"))
    got = score(docs, model, ["doc_id"]).collect()
    assert len(got) == len(texts) + 3 and all(-100 < r.score < 0 for r in got)
