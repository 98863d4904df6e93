"""Two feature tables compared by query: as by joining all pairs, without shuffling equal ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave.operators import features


def test_difference_by_query(spark):
    rows = [(f"S1-{k // 6}", f"S2-{k}", k / 7, float(k % 3)) for k in range(30)]
    a = spark.createDataFrame(rows, "s1_id string, target_id string, x double, y double")
    moved = a.withColumn("x", F.col("x") + F.when(F.col("target_id") == "S2-8", 0.25).otherwise(0.0))
    for b, diff in ((a.repartition(3), 0.0), (moved, 0.25), (a.where("target_id <> 'S2-8'"), 0.0), (a.where("s1_id <> 'S1-1'"), 0.0), (a.limit(0), 0.0)):
        got, want = (f(a, b, ["x", "y"]) for f in (features.max_difference_by_query, features.max_difference))
        assert got.dtypes == want.dtypes
        g, w = got.first(), want.first()
        assert g.pairs == w.pairs == b.count() and abs(g.max_abs_diff - w.max_abs_diff) < 1e-12 and abs(g.max_abs_diff - diff) < 1e-12
