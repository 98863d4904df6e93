"""Fits on grouped rows: equal rows count as often as they occur, and pairs needn't be kept."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linkweave.operators import metrics, models
from linkweave.plans.queries import Linkage


@pytest.fixture(scope="module")
def rows(spark):
    made = [(f"S1-{k % 4}", float(y), (k * 7 % 5) / 5 + y * 0.2, (k * 3 % 4) / 4) for k in range(40) for y in [int(k % 3 == 0)] for _ in range(1 + k % 6)]
    return spark.createDataFrame(made, "s1_id string, label double, a double, b double").cache()


def close(a, b):
    key = ["a", "b"] if "a" in a.columns else ["raw"]
    x, y = (sorted(tuple(r[c] for c in (*key, "score")) for r in d.select(*key, "score").distinct().collect()) for d in (a, b))
    return len(x) == len(y) > 2 and all(abs(u - v) < 1e-6 for p, q in zip(x, y) for u, v in zip(p, q))


@pytest.mark.parametrize("model", [models.LogisticMatcher(rounds=20), models.BoostedMatcher(depth=3, trees=3), models.PairwiseRanker()])
def test_fit_on_grouped_rows(rows, model):
    few = models.grouped(rows, ["a", "b"], ("s1_id",))
    assert few.count() < rows.count() == few.agg(F.sum("n")).first()[0]
    assert close(model.fit(rows, ["a", "b"])(rows), model.fit(few, ["a", "b"])(rows))


@pytest.mark.parametrize("method", ["platt", "isotonic"])
def test_calibration_on_grouped_rows(rows, method):
    raw = rows.select(F.col("a").alias("score"), F.col("a").alias("raw"), "label")
    few = models.grouped(raw, ["score"])
    assert few.count() < raw.count() and close(models.calibrate(raw, method)(raw), models.calibrate(few, method)(raw))


def test_quality_of_grouped_rows(rows):
    scored = rows.select(F.col("a").alias("score"), F.col("label").cast("int").alias("label"))
    assert metrics.pair_quality(models.grouped(scored, ["score"])).collect() == metrics.pair_quality(scored).collect()


def test_training_stands_for_all_pairs(spark, tmp_path):
    texts = ["one two three four five six", "one two three four five seven", None, "a b"]
    docs = spark.createDataFrame([(k, texts[k % 4] if k % 5 else f"own {k}", "en", "s", 10) for k in range(36)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    x = Linkage(spark, str(tmp_path))
    pairs, linked = x.arm_b.count(), x.arm_b.join(x.links, ["s1_id", "target_id"], "left_semi").count()
    got = x.training.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("label"))).first()
    assert got[0] < got[1] == pairs and got[2] == linked > 0
    ids = x.links.select("s1_id").distinct()
    assert x.query_training.agg(F.sum("n")).first()[0] == x.arm_b.join(ids, "s1_id", "left_semi").count()
