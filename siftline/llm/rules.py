"""Text quality by a sparse ensemble of rules.

Statistics of every text are computed in one pass. A random forest over labelled texts gives candidate rules: each path from
a root to an inner node or leaf is a conjunction of comparisons. A logistic regression with an L1 penalty over the rules and the
statistics keeps few of them. The kept rules and weights are compiled into one Spark column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.tokens import BLANK, slices, text_bytes, unique_per_text, windows, words

#: Statistics of a text, in the order of the columns. Shares are of bytes unless said otherwise.
STATISTICS = [
    "log_words",  # natural logarithm of 1 + words
    "word_bytes",  # bytes per word
    "distinct_words",  # share of words that are different
    "distinct_pairs",  # share of word pairs that are different
    "most_frequent",  # share of words that are the most frequent one
    "repeats_previous",  # share of words equal to the word before
    "letters",  # ASCII letters and bytes beyond ASCII
    "upper",  # A-Z
    "digits",
    "stops",  # . , ; :
    "shouts",  # ! ?
    "symbols",  # other printable ASCII
    "line_ends",
    "symbol_ends",  # share of words whose last byte is another printable ASCII character
]


def _classes() -> np.ndarray:
    table = np.full(256, 6, np.uint8)  # controls and blanks
    table[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[[*map(ord, ".,;:")]] = 3
    table[[*map(ord, "!?")]] = 4
    rest = [b for b in range(33, 127) if table[b] == 6]
    table[rest] = 5
    table[ord("\n")] = 7
    return table


_CLASS = _classes()


def _statistics(batches):
    for batch in slices(batches, "__text"):
        buffer, offsets = text_bytes(batch.column("__text"))
        starts, ends, hashes, first = words(buffer, offsets, BLANK)
        n, sizes = np.diff(first), np.diff(offsets)
        texts = batch.num_rows
        kind = _CLASS[buffer]
        owner = np.repeat(np.arange(texts), sizes)
        share = np.bincount(owner * 8 + kind, minlength=texts * 8).reshape(texts, 8) / np.maximum(sizes, 1)[:, None]
        word_owner = np.repeat(np.arange(texts), n)
        distinct = np.diff(unique_per_text(hashes, first)[1])
        pairs, at = windows(hashes, first, 2)
        order = np.lexsort((hashes, word_owner))
        run = np.flatnonzero(np.concatenate([[True], (np.diff(word_owner[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])])[: len(order)])
        most = np.zeros(texts, np.int64)
        np.maximum.at(most, word_owner[order][run], np.diff(np.append(run, len(order))))
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1])
        some, some_pairs = np.maximum(n, 1), np.maximum(np.diff(at), 1)
        columns = [
            np.log1p(n),
            np.bincount(word_owner, ends - starts, texts) / some,
            distinct / some,
            np.diff(unique_per_text(pairs, at)[1]) / some_pairs,
            most / some,
            np.bincount(word_owner, again, texts) / some,
            share[:, 0] + share[:, 1],
            share[:, 1],
            share[:, 2],
            share[:, 3],
            share[:, 4],
            share[:, 5],
            share[:, 7],
            np.bincount(word_owner, kind[ends - 1] == 5, texts) / some,
        ]
        keep = [f for f in batch.schema.names if f != "__text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(f)) for f in keep), *(pa.array(c.astype(float)) for c in columns)],
            [*keep, *STATISTICS],
        )


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``STATISTICS`` of every row of ``docs``; all 0 for null and empty texts.

    ``keep`` may not contain a statistic's name; other columns may have any name.
    """
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    schema = docs.select(*keep).schema
    for name in STATISTICS:
        schema = schema.add(name, "double")
    return rows.mapInArrow(_statistics, schema)


@dataclass(frozen=True)
class RuleParams:
    """The forest that proposes rules, and the fit that chooses among them.

    The fit uses a documented bound: at most about ``sample`` labelled rows, chosen by a hash of their statistics.
    """

    trees: int = 12
    depth: int = 3
    penalty: float = 0.002
    iterations: int = 60
    sample: int = 20_000
    seed: int = 7


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool  # else at most
    threshold: float

    def column(self) -> Column:
        value = F.col(STATISTICS[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{STATISTICS[self.feature]} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def tree_rules(model) -> list[Rule]:
    """Every path of a forest's trees as a conjunction; of comparisons on one side of a statistic only the tightest stays."""
    found: dict[Rule, None] = {}

    def descend(node, path):
        if path:
            tight: dict[tuple[int, bool], float] = {}
            for c in path:
                old = tight.get((c.feature, c.above))
                best = max if c.above else min
                tight[c.feature, c.above] = c.threshold if old is None else best(old, c.threshold)
            found.setdefault(tuple(Condition(f, a, t) for (f, a), t in sorted(tight.items())))
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        for child, above in ((node.leftChild(), False), (node.rightChild(), True)):
            descend(child, [*path, Condition(split.featureIndex(), above, split.threshold())])

    for tree in model.trees:
        descend(tree._call_java("rootNode"), [])
    # the two sides of a split say the same: keep one
    kept: list[Rule] = []
    for rule in found:
        if len(rule) == 1 and rule[0].above and (Condition(rule[0].feature, False, rule[0].threshold),) in found:
            continue
        kept.append(rule)
    return kept


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules and statistics. A statistic counts up to the bounds it had in training."""

    intercept: float
    rules: list[tuple[Rule, float]]
    linear: list[tuple[int, float, float, float]]  # statistic, weight, lower and upper bound

    def score(self) -> Column:
        """Probability of label 1 as an expression over the columns of ``statistics``."""
        terms = [F.lit(self.intercept)]
        for rule, weight in self.rules:
            terms.append(F.when(reduce(lambda x, y: x & y, (c.column() for c in rule)), F.lit(weight)).otherwise(F.lit(0.0)))
        for feature, weight, low, high in self.linear:
            terms.append(F.lit(weight) * F.least(F.greatest(F.col(STATISTICS[feature]), F.lit(low)), F.lit(high)))
        return 1 / (1 + F.exp(-reduce(lambda x, y: x + y, terms)))

    def describe(self) -> list[str]:
        """The rules by weight, in words."""
        named = [(w, " and ".join(map(str, rule))) for rule, w in self.rules]
        named += [(w, STATISTICS[f]) for f, w, _, _ in self.linear]
        return [f"{w:+.4f}  {text}" for w, text in sorted(named, key=lambda x: -abs(x[0]))]


def fit(labelled: DataFrame, params: RuleParams = RuleParams()) -> RuleEnsemble:
    """The ensemble of ``labelled(label, *STATISTICS)``, label 0 or 1; rows with another or no label are left out.

    Without rows the score is 0.5 everywhere; with one label only it is that label's smoothed share.
    """
    rows = labelled.where("label in (0, 1)").select(F.col("label").cast("double").alias("label"), *STATISTICS)
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")).first()
    n, ones = totals["n"], totals["ones"]
    if ones in (0, n):
        share = (ones + 0.5) / (n + 1)
        return RuleEnsemble(math.log(share / (1 - share)), [], [])
    if n > params.sample:
        place = F.pmod(F.xxhash64(*STATISTICS), F.lit(1 << 30))
        rows = rows.where(place < int(params.sample / n * (1 << 30)))
    rows = rows.repartition(4).cache()
    try:
        bounds = rows.agg(*(F.percentile_approx(c, [0.025, 0.975], 1000).alias(c) for c in STATISTICS)).first()
        if bounds[0] is None or rows.select("label").distinct().count() < 2:
            share = (ones + 0.5) / (n + 1)
            return RuleEnsemble(math.log(share / (1 - share)), [], [])
        forest = RandomForestClassifier(
            labelCol="label", featuresCol="features", numTrees=params.trees, maxDepth=params.depth, seed=params.seed, subsamplingRate=0.5
        )
        assembled = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows)
        rules = tree_rules(forest.fit(assembled.select("label", "features")))
        names = [f"r{i}" for i in range(len(rules))]
        clipped = [F.least(F.greatest(F.col(c), F.lit(bounds[c][0])), F.lit(bounds[c][1])).alias(f"x{i}") for i, c in enumerate(STATISTICS)]
        held = [reduce(lambda x, y: x & y, (c.column() for c in rule)).cast("double").alias(name) for name, rule in zip(names, rules)]
        inputs = rows.select("label", *held, *clipped)
        inputs = VectorAssembler(inputCols=[*names, *(f"x{i}" for i in range(len(STATISTICS)))], outputCol="features").transform(inputs)
        lasso = LogisticRegression(
            labelCol="label", featuresCol="features", regParam=params.penalty, elasticNetParam=1.0, maxIter=params.iterations
        )
        fitted = lasso.fit(inputs.select("label", "features"))
    finally:
        rows.unpersist()
    weights = fitted.coefficients.toArray()
    linear = [
        (i, float(w), float(bounds[c][0]), float(bounds[c][1]))
        for i, (c, w) in enumerate(zip(STATISTICS, weights[len(rules) :]))
        if w
    ]
    return RuleEnsemble(float(fitted.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w], linear)
