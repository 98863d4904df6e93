"""The logistic matcher's scores are Spark's own probabilities, worked out without a vector a pair."""

from __future__ import annotations

from linkweave.operators import models


def test_scores_are_the_models_probabilities(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    rows = spark.createDataFrame([(float(k % 3 == 0), (k * 7 % 5) / 5, (k * 3 % 4) / 4 + (k % 3 == 0) / 3) for k in range(40)], "label double, a double, b double")
    got = models.LogisticMatcher(rounds=20).fit(rows, ["a", "b"])(rows)
    assert "UDF" not in got._jdf.queryExecution().optimizedPlan().toString()
    few, total = models._balanced(models.assemble(models.grouped(rows, ["a", "b"]), ["a", "b"]))
    model = LogisticRegression(regParam=1.0 / total, standardization=False, weightCol="weight", maxIter=20).fit(few)
    want = model.transform(models.assemble(rows, ["a", "b"])).select("a", "b", vector_to_array("probability")[1].alias("score"))
    pairs = [sorted(d.select("a", "b", "score").collect()) for d in (got, want)]
    assert len(pairs[0]) == 40 and all(abs(x.score - y.score) < 1e-9 for x, y in zip(*pairs))
