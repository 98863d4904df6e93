"""Causes of errors told within the pair join: the same counts as by joins of pairs and links with records."""

from __future__ import annotations

import re

import pytest

from linkweave.operators import metrics, policy
from linkweave.plans.queries import Linkage


@pytest.mark.parametrize("least", [0.5, 0.99])
def test_causes_without_a_shuffle_of_pairs(spark, tmp_path, least):
    texts = ["one two three four five six", "one two three four five six", "one two three four five seven", "the and.com co", "the and.com co", "अल one two", None, ""]
    rows = [(k, texts[k % 8], "en", ["s", None, "web 12"][k % 5 % 3], 10 if k % 4 else None) for k in range(48)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    x, p = Linkage(spark, str(tmp_path)), policy.GlobalThreshold(least)
    got, want = x.causes(p), metrics.error_causes(x.links, x.preds(p), x.records)
    assert got.schema.names == want.schema.names and got.dtypes == want.dtypes
    rows = sorted(want.collect())
    assert sorted(got.collect()) == rows and ("FN" if least > 0.9 else "FP") in {r.kind for r in rows}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((s1_id|target_id)#\d+, (s1_id|target_id)#", plan)
    twice = Linkage(spark, str(tmp_path))
    twice.records = twice.records.union(twice.records)
    assert twice.causes(p).collect()
