import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftline.llm.rules import STATISTICS, Condition, RuleEnsemble, RuleParams, fit, statistics

FOLDER = "/root/testdata/sf0.01"


def brute(text):
    data = (text or "").encode()
    own = [w for w in re.split(rb"[\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in data)) if w]
    raw = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    if not data:
        return dict.fromkeys(STATISTICS, 0.0)
    n, size = max(len(own), 1), len(data)
    pairs = [tuple(own[i : i + 2]) for i in range(max(len(own) - 1, min(len(own), 1)))]
    share = lambda test: sum(map(test, data)) / size
    symbol = lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:!?"
    return {
        "log_words": math.log1p(len(own)),
        "word_bytes": sum(map(len, own)) / n,
        "distinct_words": len(set(own)) / n,
        "distinct_pairs": len(set(pairs)) / max(len(pairs), 1),
        "most_frequent": max(Counter(own).values(), default=0) / n,
        "repeats_previous": sum(a == b for a, b in zip(own, own[1:])) / n,
        "letters": share(lambda b: b >= 128 or chr(b).isalpha()),
        "upper": share(lambda b: 65 <= b <= 90),
        "digits": share(lambda b: 48 <= b <= 57),
        "stops": share(lambda b: b < 128 and chr(b) in ".,;:"),
        "shouts": share(lambda b: b < 128 and chr(b) in "!?"),
        "symbols": share(symbol),
        "line_ends": share(lambda b: b == 10),
        "symbol_ends": sum(symbol(w[-1]) for w in raw) / n,
    }


def test_statistics(spark):
    rnd = random.Random(1)
    texts = [None, "", "   \n", "One one ONE two!", "ä é ß\n%%% &&&", "x" * 50_000, "1 2 3. a;b?"]
    texts += ["".join(rnd.choice("abAB 12.,!%é\n\t") for _ in range(rnd.randint(0, 200))) for _ in range(60)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, upper int").repartition(3)
    got = {r.doc_id: r for r in statistics(frame, ["doc_id"]).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        for name, value in brute(text).items():
            assert got[i][name] == pytest.approx(value), (name, text)


def labelled(spark, seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        good = rnd.random() < 0.7
        own = [rnd.choice(["lorem", "ipsum", "Dolor,", "sit", "amet."]) + str(rnd.randrange(500)) * (not good) for _ in range(rnd.randint(5, 60))]
        if not good and i % 2:
            own = [rnd.choice(own)] * len(own)
        rows.append((i, " ".join(own), int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_held_out_accuracy_and_compiled_expression(spark):
    ensemble = fit(statistics(labelled(spark, 1, 400), ["label"]))
    assert ensemble.rules and ensemble.describe()
    seen = statistics(labelled(spark, 2, 300), ["label"]).select("*", ensemble.score().alias("score")).collect()
    assert sum((r.score >= 0.5) == (r.label == 1) for r in seen) >= 290
    for r in seen[:40]:
        total = ensemble.intercept
        for rule, weight in ensemble.rules:
            total += weight * all((r[STATISTICS[c.feature]] > c.threshold) == c.above for c in rule)
        for f, weight, low, high in ensemble.linear:
            total += weight * min(max(r[STATISTICS[f]], low), high)
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))


def test_sample_is_bounded(spark):
    frame = statistics(labelled(spark, 3, 600), ["label"])
    ensemble = fit(frame, RuleParams(sample=200, trees=3))
    right = frame.where((ensemble.score() >= 0.5) == (F.col("label") == 1)).count()
    assert right >= 560


def test_little_to_learn_from(spark):
    frame = statistics(labelled(spark, 4, 30), ["label"])
    score = lambda ensemble: {round(r[0], 6) for r in frame.select(ensemble.score()).collect()}
    assert score(fit(frame.limit(0))) == {0.5}
    assert score(fit(frame.withColumn("label", F.lit(None).cast("int")))) == {0.5}
    assert score(fit(frame.withColumn("label", F.lit(1)))) == {round(30.5 / 31, 6)}
    one = RuleEnsemble(0.0, [((Condition(0, True, 1e9),), 5.0)], [])
    assert score(one) == {0.5}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_on_held_out_documents(spark):
    from siftline.llm.queries import op6_quality_rules

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = op6_quality_rules(spark, FOLDER)
    assert rows.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    held = rows.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held) > 0
