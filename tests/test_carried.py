"""Pairs that bring their records along: the same features, policies and measures without shuffles of pairs."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from linkweave.operators import blocking, features, metrics, policy, tfidf
from linkweave.operators.records import enrich, queries_of, targets_of
from linkweave.plans.queries import Linkage

NAMES = ["alpha beta", "alpha beta", "beta alpha", "alpha gamma 12", "alpha gamma", "", "अल्फा बीटा", "alpha-beta ltd"]


@pytest.fixture
def rec(spark):
    rows = [(f"S{1 + k % 3}-{k}", NAMES[k % len(NAMES)], f"{k % 4} road 1234{k % 2}", "US") for k in range(48)]
    return enrich(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"))


def test_carried_features_equal_joined_ones(rec):
    q, t, blocks = queries_of(rec), targets_of(rec), blocking.arm_b_blocks()
    joined = features.pair_features(blocking.provenance(q, t, blocks), rec)
    carried = features.carried_features(blocking.provenance(q, t, blocks, carry=features.carried(rec)))
    assert carried.columns == joined.columns and carried.count() > 100
    assert carried.exceptAll(joined).isEmpty() and joined.exceptAll(carried).isEmpty()


@pytest.mark.parametrize("p", [policy.GlobalThreshold(0.5), policy.TopKThreshold(0.5, 2), policy.RelativeMargin(0.6, 0.5, 0.2, 3), policy.AdaptiveRatio(0.6, 0.8, 3)])
def test_bounds_of_policies_change_nothing(spark, p):
    rows = [(f"S1-{a}", f"S{2 + b % 2}-{b}", [0.1, 0.5, 0.55, 0.6, 0.9, float("nan"), float("inf"), None][(a * b + a) % 8]) for a in range(12) for b in range(9)]
    df = spark.createDataFrame(rows, "s1_id string, target_id string, score double")
    want = policy.ranked(df).where(p.accepted()).select("s1_id", "target_id", "score", "rank").collect()
    for got in (policy.decide(df, p), policy.decide(df, p, unique=True), policy.decide(df.union(df), p)):
        assert sorted(got.collect()) == sorted(want) and want


def test_measures_by_hits_and_no_shuffle_of_all_pairs(spark, tmp_path):
    texts = ["one two three four five six", "one two three four five six", "one two three four five seven", None, None]
    docs = spark.createDataFrame([(k, texts[k % 5], "en", "s", 10) for k in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    x = Linkage(spark, str(tmp_path))
    for p in (policy.GlobalThreshold(0.5), policy.RelativeMargin(0.6, 0.65, 0.10, 5)):
        preds = x.hit_preds(p)
        assert "hit" in preds.columns
        a, b = metrics.entity_scores(x.spine, x.links, preds), metrics.entity_scores(x.spine, x.links, preds.drop("hit"))
        assert sorted(a.select(sorted(a.columns)).collect()) == sorted(b.select(sorted(a.columns)).collect())
    assert x.hit_scored.where("hit").count() == x.hit_scored.join(x.links, ["s1_id", "target_id"], "left_semi").count() > 0
    for rows in (x.scored, x.feats):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\((s1_id|target_id)#\d+, (s1_id|target_id)#", plan)
        last = [line for line in plan.split("\n") if "Join" in line][0]
        assert "block#" in last and "key#" in last  # nothing is joined after the pair join
    twice = Linkage(spark, str(tmp_path))
    twice.records = twice.records.union(twice.records)
    assert not twice.unique and "hit" not in twice.hit_preds(policy.GlobalThreshold(0.5)).columns


def test_blocks_are_read_not_shuffled(spark, rec):
    """Cells get numbers alone: no block goes through an exchange, however many cells it belongs to."""
    got = tfidf.top_k(queries_of(rec), targets_of(rec), tfidf.CHAR_PARAMS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "numbers" not in plan and "hashpartitioning(qb" not in plan and got.count() > 0
