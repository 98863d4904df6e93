"""Decision policies: which candidates of a query count as matches.

Scores come in sanitised and ranked; every policy is then a filter on score, rank and the top score,
so a policy adds no shuffle to the ranking's one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(scored: DataFrame, least: float | None = None, unique: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """s1_id, target_id, score, rank, top: targets of S2 and S3 once each with the best score; bad scores are 0.

    least: scores under it are left out, which changes no other's rank; unique: scored has no pair twice,
    and then columns of keep stay.
    """
    score = F.col("score").cast("double")
    good = F.when(F.isnan(score) | score.isNull() | (F.abs(score) == float("inf")), 0.0).otherwise(score)
    rows = scored.where(F.col("target_id").startswith("S2-") | F.col("target_id").startswith("S3-"))
    rows = rows.select("s1_id", "target_id", *keep, good.alias("score"))
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    if not unique:
        rows = rows.groupBy("s1_id", "target_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("s1_id").orderBy(F.desc("score"), "target_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("s1_id", "target_id", *keep, "score", F.row_number().over(w).alias("rank"), F.first("score").over(w).alias("top"))


@dataclass(frozen=True)
class GlobalThreshold:
    threshold: float = 0.70

    def bounds(self):
        """The least score and the last rank that can be accepted, None for no bound."""
        return self.threshold, None

    def accepted(self):
        return F.col("score") >= self.threshold


@dataclass(frozen=True)
class TopKThreshold:
    threshold: float = 0.70
    k: int = 3

    def bounds(self):
        return self.threshold, max(1, self.k)

    def accepted(self):
        return (F.col("score") >= self.threshold) & (F.col("rank") <= max(1, self.k))


@dataclass(frozen=True)
class RelativeMargin:
    floor: float = 0.70
    multi: float = 0.75
    margin: float = 0.10
    k: int = 5

    def bounds(self):
        return min(self.floor, self.multi), max(1, self.k)

    def accepted(self):
        more = (F.col("score") >= self.multi) & (F.col("top") - F.col("score") <= self.margin) & (F.col("rank") <= self.k)
        return (F.col("top") >= self.floor) & ((F.col("rank") == 1) | more)


@dataclass(frozen=True)
class AdaptiveRatio:
    floor: float = 0.70
    ratio: float = 0.90
    k: int = 5

    def bounds(self):
        return self.floor, max(1, self.k)

    def accepted(self):
        more = (F.col("top") > 0) & (F.col("score") >= self.floor) & (F.col("score") / F.col("top") >= self.ratio) & (F.col("rank") <= self.k)
        return (F.col("top") >= self.floor) & ((F.col("rank") == 1) | more)


def decide(scored: DataFrame, policy, unique: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """s1_id, target_id, score, rank of the accepted candidates; unique: scored has no pair twice.

    What no policy of these bounds accepts goes before the shuffle: low scores, and with unique each map
    task's candidates past the last rank (Spark's WindowGroupLimit)."""
    least, last = policy.bounds()
    rows = ranked(scored, least, unique, keep)
    if last is not None:
        rows = rows.where(F.col("rank") <= last)
    return rows.where(policy.accepted()).select("s1_id", "target_id", *keep, "score", "rank")


def match_lists(spine: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row an S1 entity with its matches in order, empty ones too."""
    lists = accepted.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("rank", "target_id"))).alias("m"))
    rows = spine.select("s1_id").join(lists, "s1_id", "left")
    return rows.select("s1_id", F.coalesce(F.transform("m", lambda x: x["target_id"]), F.array().cast("array<string>")).alias("matches"))


@dataclass(frozen=True)
class RescueTrigger:
    threshold: float = 0.70
    margin: float = 0.05
    sure: float = 0.85

    def uncertain(self, spine: DataFrame, scored: DataFrame) -> DataFrame:
        """s1_id of queries without candidates, without a good one, or with two near ones."""
        best = ranked(scored).groupBy("s1_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
        rows = spine.select("s1_id").join(best, "s1_id", "left")
        near = (F.col("a") < self.sure) & (F.col("a") - F.col("b") <= self.margin)
        return rows.where(F.col("a").isNull() | (F.col("a") < self.threshold) | F.coalesce(near, F.lit(False))).select("s1_id")


def merge_rescue(first: DataFrame, rescue: DataFrame) -> DataFrame:
    """Union of two scored sets; a pair keeps its best score and where it came from first."""
    rows = first.select("s1_id", "target_id", "score", F.lit(0).alias("o")).unionByName(rescue.select("s1_id", "target_id", "score", F.lit(1).alias("o")))
    return rows.groupBy("s1_id", "target_id").agg(F.max("score").alias("score"), F.when(F.min("o") == 0, "primary").otherwise("rescue").alias("origin"))


def cascade(spine: DataFrame, first: DataFrame, second: DataFrame, trigger: RescueTrigger, policy) -> DataFrame:
    """Primary scores, rescue scores for uncertain queries, then the policy."""
    wanted = trigger.uncertain(spine, first)
    return decide(merge_rescue(first, second.join(wanted, "s1_id", "left_semi")), policy)
