"""Records of a name meet as one: features of names once for all of them, the same as pair by pair."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linkweave.operators import blocking, features
from linkweave.operators.records import enrich, queries_of, targets_of

NAMES = ["alpha beta", "alpha beta", "Alpha beta", "beta alpha", "alpha gamma 12", "", "अल्फा बीटा", "alpha-beta ltd", None]
PLACES = ["1111 1111 lane", "web 11111", "9", "", None, "12345 road 12345", "aaaa aaaa 7", "ü€𝄞 ü€𝄞"]


@pytest.fixture(scope="module")
def rec(spark):
    rows = [(f"S{1 + k % 3}-{k}", NAMES[k % 9], PLACES[k // 2 % 8], ["US", "us", ""][k % 5 % 3]) for k in range(90)]
    return enrich(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")).cache()


def by_name(rec, **final):
    carry, early = features.by_name(rec)
    return features.class_features(blocking.provenance(queries_of(rec), targets_of(rec), blocking.arm_b_blocks(), carry=carry, early=early), **final)


def test_features_equal_joined_ones(rec):
    want = features.pair_features(blocking.provenance(queries_of(rec), targets_of(rec), blocking.arm_b_blocks()), rec).cache()
    for records in (rec, features.with_grams(rec), rec.union(rec.where("entity_id = 'S1-0'"))):
        got = by_name(records)
        if records.count() > rec.count():  # a repeated id's pairs come as often as its record
            assert got.count() == want.count() + want.where("s1_id = 'S1-0'").count()
            continue
        assert got.columns == want.columns and want.count() > 300
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_names_are_compared_before_their_records_meet(rec):
    plan = by_name(rec)._jdf.queryExecution().optimizedPlan().toString().split("Union")[-1]
    assert "levenshtein" in plan and plan.index("explode(q_members") < plan.index("levenshtein(")  # printed from the top


def test_rounded(spark):
    values = [0.0, 1.0, -1.0, 0.5, 1 / 3, 2 / 3, 0.1234565, 0.0000005, 2.5e-7, -0.1234565, -1e-9, 1e15 + 0.3, 1e300, float("nan"), float("inf"), float("-inf"), None]
    values += [k / 64 + 5e-7 for k in range(200)] + [k / 997 for k in range(997)] + [k / 2e6 for k in range(999)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 6).alias("a"), features.rounded(F.col("x"), 6).alias("b"), F.round("x", 4).alias("c"), features.rounded(F.col("x"), 4).alias("d"))
    assert rows.where("NOT (a <=> b AND c <=> d)").isEmpty() and rows.count() > 2000
    for n, c in ((n, F.col(n)) for n in features.WHOLE):
        assert n in features.FEATURES and c is not None


def test_whole_features_need_no_rounding(rec):
    assert by_name(rec).where(" OR ".join(f"{n} <> floor({n})" for n in features.WHOLE)).isEmpty()


def test_clean_within_the_projection(rec):
    got, want = by_name(rec, final=lambda n, c: features.clean(c)), features.sanitized(by_name(rec))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.columns == want.columns
