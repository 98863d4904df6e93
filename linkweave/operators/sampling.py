"""Splits, cohorts and training pairs, all by hash order: the same rows at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut_off


def _order(*cols: Column | str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", *cols, F.lit(str(seed))))


def entity_split(ids: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """entity_id, part: round(n * share) ids go to validation, first by hash."""
    one = ids.select("entity_id").distinct().withColumn("h", _order("entity_id", seed=seed))
    want = round(one.count() * share)
    # the cut-off is one order statistic: no ranking of all ids in one task
    last = cut_off(one.withColumn("h", F.concat_ws("|", "h", "entity_id")), "h", want) if want else None
    inside = F.concat_ws("|", "h", "entity_id") <= F.lit(last) if last is not None else F.lit(False)
    return one.select("entity_id", F.when(inside, "validation").otherwise("train").alias("part"))


def partition_truth(truth: DataFrame, split: DataFrame) -> DataFrame:
    """truth (s1_id first) with its part; an action fails on an id the split lacks."""
    rows = truth.join(split.select(F.col("entity_id").alias("s1_id"), "part"), "s1_id", "left")
    return rows.withColumn("part", F.when(F.col("part").isNull(), F.raise_error(F.concat(F.lit("not in the split: "), "s1_id"))).otherwise(F.col("part")))


def cohort(ids: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """The first size ids in hash order; smaller cohorts are prefixes of larger ones."""
    return ids.select("entity_id").distinct().orderBy(_order("entity_id", seed=seed), "entity_id").limit(size)


STRATA = (0.30, 0.30, 0.20, 0.10)


def sample_negatives(pairs: DataFrame, ratio: int = 6, seed: int = 42) -> DataFrame:
    """pairs (s1_id, target_id, label, tfidf_rank, tfidf_score, support_count, flags): positives and
    ratio negatives a positive (ratio where there is none), by quotas of strata, then from the rest."""
    w = Window.partitionBy("s1_id")
    rows = pairs.withColumn("want", F.greatest(F.sum("label").over(w), F.lit(1)) * ratio)
    stratum = (
        F.when((F.col("tfidf_rank") <= 5) | (F.col("tfidf_score") >= 0.40), 0)
        .when(F.col("support_count") >= 2, 1)
        .when(F.col("exact_name") | F.col("sorted_name"), 2)
        .when(F.col("name_numeric"), 3)
        .otherwise(4)
    )
    neg = rows.where("label = 0").withColumn("stratum", stratum).withColumn("h", _order("s1_id", "target_id", seed=seed))
    quotas = [F.greatest(F.lit(1), F.floor(F.col("want") * s).cast("int")) for s in STRATA]
    rest = F.greatest(F.lit(1), F.col("want") - (quotas[0] + quotas[1] + quotas[2] + quotas[3]))
    quota = F.when(F.col("stratum") == 4, rest)
    for k, q in enumerate(quotas):
        quota = quota.when(F.col("stratum") == k, q)
    neg = neg.withColumn("r", F.row_number().over(Window.partitionBy("s1_id", "stratum").orderBy("h")))
    neg = neg.withColumn("late", (F.col("r") > quota).cast("int"))
    neg = neg.withColumn("o", F.row_number().over(w.orderBy("late", F.when(F.col("late") == 0, F.col("stratum")), "h"))).where("o <= want")
    return rows.where("label = 1").select(*pairs.columns).unionByName(neg.select(*pairs.columns))


def query_groups(training: DataFrame) -> DataFrame:
    return training.groupBy("s1_id").agg(F.count("*").alias("group_size"), F.sum("label").alias("positives"))


def label(pairs: DataFrame, links: DataFrame) -> DataFrame:
    return pairs.join(links.select("s1_id", "target_id", F.lit(1).alias("label")), ["s1_id", "target_id"], "left").na.fill(0, ["label"])


def id_digest(ids: DataFrame) -> DataFrame:
    """n and a SHA-256 of a set of ids that no order changes, without gathering them: the sum of the
    ids' own hashes in 16 parts of 16 bits, hashed again."""
    h = F.sha2("entity_id", 256)
    parts = [F.sum(F.conv(F.substring(h, 4 * k + 1, 4), 16, 10).cast("long")) for k in range(16)]
    return ids.select("entity_id").distinct().agg(F.count("*").alias("n"), F.sha2(F.concat_ws("-", *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]), 256).alias("digest"))
