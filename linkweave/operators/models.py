"""Scoring models, calibration and blending.

The deterministic matcher's formula and the substitutes for boosted trees and the ranker are this
library's own: the weights are public configuration, the formula around them is not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DeterministicMatcher:
    """Weighted name and address agreement with bonuses, within [0, 1]."""

    name: float = 0.50
    address: float = 0.30
    exact: float = 0.15
    support: float = 0.05

    def score(self) -> Column:
        s = self.name * F.col("name_token_jaccard") + self.address * F.col("addr_token_jaccard") + self.exact * F.col("name_exact_clean")
        s = s + self.support * F.least(F.col("retrieval_support_count"), F.lit(3.0)) / 3.0
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 6)

    def transform(self, features: DataFrame) -> DataFrame:
        return features.withColumn("score", self.score())


def assemble(features: DataFrame, names: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error").transform(features)


def grouped(training: DataFrame, names: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """by, label, names, n: rows equal in these once, with their number. Losses are sums over rows, so a
    fit weighted by n is the fit on all rows; what is kept and cached grows with the distinct rows."""
    n = F.sum("n") if "n" in training.columns else F.count("*")
    return training.groupBy(*by, "label", *names).agg(n.alias("n"))


def _balanced(training: DataFrame) -> tuple[DataFrame, int]:
    """training (label, n) with weight, by which labels count alike; the number of rows it stands for."""
    n = {r.label: r.n for r in training.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # two rows
    total = sum(n.values())
    weight = F.lit(1.0)
    for y, k in n.items():
        weight = F.when(F.col("label") == y, total / (len(n) * k)).otherwise(weight)
    return training.withColumn("weight", weight * F.col("n")), total


def _positive(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return df.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _linear(weights, names: list[str]) -> Column:
    return sum((F.lit(w) * F.col(n) for w, n in zip(weights.toArray().tolist(), names)), F.lit(0.0))


@dataclass(frozen=True)
class LogisticMatcher:
    c: float = 1.0
    rounds: int = 100

    def fit(self, training: DataFrame, names: list[str]):
        from pyspark.ml.classification import LogisticRegression

        rows, total = _balanced(assemble(grouped(training, names), names))
        reg = 1.0 / (self.c * max(total, 1))
        model = LogisticRegression(regParam=reg, standardization=False, weightCol="weight", maxIter=self.rounds).fit(rows)
        margin = _linear(model.coefficients, names) + float(model.intercept)
        return lambda features: features.withColumn("score", 1.0 / (1.0 + F.exp(-margin)))  # no vectors of pairs


@dataclass(frozen=True)
class BoostedMatcher:
    depth: int = 6
    trees: int = 100
    step: float = 0.08

    def fit(self, training: DataFrame, names: list[str]):
        from pyspark.ml.classification import GBTClassifier

        model = GBTClassifier(maxDepth=min(self.depth, 30), maxIter=self.trees, stepSize=self.step, seed=42, weightCol="n").fit(assemble(grouped(training, names), names))
        return lambda features: _positive(model.transform(assemble(features, names)))


@dataclass(frozen=True)
class PairwiseRanker:
    """Logistic regression on differences of a query's positives and negatives; the score is the
    linear form, so it ranks. Differences go from each candidate to its query's mean of the other
    class: as many rows as candidates that differ, never all pairs."""

    c: float = 1.0

    def fit(self, training: DataFrame, names: list[str]):
        from pyspark.ml.classification import LogisticRegression

        training = grouped(training, names, ("s1_id",))
        of = lambda c, y: F.sum(F.when(F.col("label") == y, c))
        means = training.groupBy("s1_id").agg(*[(of(F.col(n) * F.col("n"), y) / of(F.col("n"), y)).alias(f"m{y}_{n}") for y in (0, 1) for n in names])
        rows = training.join(means, "s1_id")
        other = lambda n: F.when(F.col("label") == 1, F.col(f"m0_{n}")).otherwise(F.col(f"m1_{n}"))
        rows = rows.where(other(names[0]).isNotNull()).select("label", *[(F.col(n) - other(n)).alias(n) for n in names], "n")
        rows = grouped(rows, names)
        reg = 1.0 / (self.c * max(rows.agg(F.sum("n")).first()[0] or 0, 1))
        model = LogisticRegression(regParam=reg, standardization=False, fitIntercept=False, weightCol="n").fit(assemble(rows, names))
        return lambda features: features.withColumn("score", _linear(model.coefficients, names))


def clipped(score: Column) -> Column:
    s = F.when(F.isnan(score) | score.isNull(), 0.0).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def calibrate(training: DataFrame, method: str = "platt"):
    """training: score, label, and n where a row stands for many; gives a function on DataFrames with a score."""
    clean = training.select(clipped(F.col("score")).alias("score"), F.col("label").cast("double").alias("label"), *[c for c in ("n",) if c in training.columns])
    clean = grouped(clean, ["score"])
    if method == "none":
        return lambda df: df.withColumn("score", clipped(F.col("score")))
    if method == "platt":
        from pyspark.ml.classification import LogisticRegression

        model = LogisticRegression(regParam=1e-6, standardization=False, weightCol="n").fit(assemble(clean, ["score"]))
        a, b = float(model.coefficients[0]), float(model.intercept)
        return lambda df: df.withColumn("score", 1.0 / (1.0 + F.exp(-(clipped(F.col("score")) * a + b))))
    if method == "isotonic":
        from pyspark.ml.regression import IsotonicRegression

        model = IsotonicRegression(weightCol="n").fit(assemble(clean, ["score"]))
        return lambda df: model.transform(assemble(df.withColumn("score", clipped(F.col("score"))), ["score"])).drop("score", "features").withColumnRenamed("prediction", "score")
    raise ValueError(f"no calibration {method}")


def sigmoid(score: Column) -> Column:
    """Ranker scores in (0, 1); infinities count as 10 and -10."""
    s = F.when(F.isnan(score) | score.isNull(), 0.0).when(score == float("inf"), 10.0).when(score == float("-inf"), -10.0).otherwise(score)
    return 1.0 / (1.0 + F.exp(-s))


def blend(a: Column, b: Column, weight: float = 0.5) -> Column:
    return weight * a + (1.0 - weight) * b


def ablation(training: DataFrame, test: DataFrame, groups: dict[str, list[str]], model, measure) -> dict[str, object]:
    """measure of a model refitted on growing groups of features."""
    out, names = {}, []
    for group, more in groups.items():
        names = [*names, *more]
        out[group] = measure(model.fit(training, names)(test))
    return out
