"""Records of equal keys meet as one; what comes out is what every record alone gives."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkweave.operators import blocking
from linkweave.operators.records import enrich, queries_of, targets_of


def _records(spark):
    rows = [(f"S{1 + k % 3}-{k:04d}", ["red fox den", "fox den red", "blue owl nest 77", "red fox dane"][k // 3 % 4], f"{k % 5} mill street", "US") for k in range(240)]
    rows += [("S1-9000", "", "3 mill street", "US"), ("S2-9001", "red", None, "US")]
    return enrich(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"))


def test_equal_records_meet_as_one(spark):
    per = spark.range(1000).selectExpr("concat('S1-', id) s1_id", "array(cast(id < 900 as string)) k")
    got = [len(r.members) for r in blocking._classes(per, "s1_id", ["k"], F.col("s1_id")).collect()]
    assert sum(got) == 1000 and len(got) <= 6 and max(got) <= 2 * blocking.CLASS


def test_pairs_and_flags_as_from_hits(spark):
    rows = _records(spark)
    q, t = queries_of(rows), targets_of(rows)
    near = spark.createDataFrame([("S1-0000", "S2-0001", 0.5, 1), ("S1-9000", "S2-9001", 0.4, 1)], "s1_id string, target_id string, score double, rank int")
    as_set = lambda d: sorted(map(str, d.select(sorted(d.columns)).collect()))
    for k in (None, near):
        blocks = blocking.arm_b_blocks()
        assert any(b.own for b in blocks)
        assert as_set(blocking.provenance(q, t, blocks, k)) == as_set(blocking.with_provenance(blocking.hits(q, t, blocks), k))


def test_first_targets_of_a_query(spark):
    rows = _records(spark)
    q, t = queries_of(rows), targets_of(rows)
    near = spark.createDataFrame([("S1-0000", "S2-0001", 0.5, 1), ("S1-9000", "S2-9001", 0.4, 1)], "s1_id string, target_id string, score double, rank int")
    blocks = [replace(b, cap=None) for b in blocking.ensemble_blocks()]
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy("target_id"))
    want = {tuple(r) for r in blocking.hits(q, t, blocks).select("s1_id", "target_id").distinct().withColumn("r", rank).where("r <= 7").drop("r").collect()}
    got = [tuple(r) for r in blocking.candidates(q, t, blocks, 7, near).collect()]
    assert len(got) == len(set(got)) and set(got) == want | {("S1-0000", "S2-0001"), ("S1-9000", "S2-9001")}
