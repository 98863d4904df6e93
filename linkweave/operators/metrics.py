"""Quality measures. All start from the spine of S1 ids, so queries without links or candidates count."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .tables import running_down


def _share(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(empty)


def captured(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """links with hit: whether pairs has them."""
    found = pairs.select("s1_id", "target_id").distinct().withColumn("hit", F.lit(True))
    return links.join(found, ["s1_id", "target_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def blocking_recall(links: DataFrame, pairs: DataFrame) -> DataFrame:
    rows = captured(links, pairs)
    s2, s3 = F.col("target_id").startswith("S2-"), F.col("target_id").startswith("S3-")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return rows.agg(
        F.count("*").alias("true_links"),
        n(F.col("hit")).alias("captured"),
        F.round(_share(n(F.col("hit")), F.count("*")), 6).alias("recall"),
        F.round(_share(n(F.col("hit") & s2), n(s2)), 6).alias("recall_s2"),
        F.round(_share(n(F.col("hit") & s3), n(s3)), 6).alias("recall_s3"),
    )


def volumes(spine: DataFrame, pairs: DataFrame) -> DataFrame:
    """s1_id, n: distinct candidates of every query."""
    counts = pairs.select("s1_id", "target_id").distinct().groupBy("s1_id").agg(F.count("*").alias("n"))
    return spine.select("s1_id").join(counts, "s1_id", "left").select("s1_id", F.coalesce("n", F.lit(0)).alias("n"))


def blocking_volume(spine: DataFrame, pairs: DataFrame, n_targets: int) -> DataFrame:
    p = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95), F.lit(0.99)))
    rows = volumes(spine, pairs).agg(
        F.count("*").alias("queries"),
        F.sum("n").alias("total"),
        F.round(F.avg("n"), 6).alias("mean"),
        p.alias("p"),
        F.max("n").alias("most"),
        F.sum((F.col("n") == 0).cast("long")).alias("without"),
    )
    space = F.greatest(F.col("queries") * F.lit(n_targets), F.lit(1))
    quantiles = [F.round(F.col("p")[k], 6).alias(name) for k, name in enumerate(("median", "p90", "p95", "p99"))]
    return rows.select("queries", "total", "mean", *quantiles, "most", "without", F.round(1 - F.col("total") / space, 6).alias("reduction"))


def entity_scores(spine: DataFrame, links: DataFrame, preds: DataFrame, beta2: float = 0.25) -> DataFrame:
    """s1_id, n_true, n_pred, tp, precision, recall, f05 of every entity. preds with hit (whether a pair is
    one of links) must be free of repeats, links too: they are then counted by entity, without a shuffle of pairs."""
    if "hit" in preds.columns:
        l = links.groupBy("s1_id").agg(F.count("*").alias("n_true"))  # noqa: E741
        p = preds.groupBy("s1_id").agg(F.count("*").alias("n_pred"), F.sum(F.col("hit").cast("long")).alias("tp"))
        counts = l.join(p, "s1_id", "full_outer").select("s1_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_true", "n_pred", "tp")])
        return _entity_measures(spine, counts, beta2)
    l = links.select("s1_id", "target_id", F.lit(1).alias("a"), F.lit(0).alias("b"))  # noqa: E741
    p = preds.select("s1_id", "target_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    both = l.unionByName(p).groupBy("s1_id", "target_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    counts = both.groupBy("s1_id").agg(F.sum("a").alias("n_true"), F.sum("b").alias("n_pred"), F.sum(F.col("a") * F.col("b")).alias("tp"))
    return _entity_measures(spine, counts, beta2)


def _entity_measures(spine: DataFrame, counts: DataFrame, beta2: float) -> DataFrame:
    rows = spine.select("s1_id").join(counts, "s1_id", "left").na.fill(0, ["n_true", "n_pred", "tp"])
    none = (F.col("n_true") == 0) & (F.col("n_pred") == 0)
    rows = rows.withColumns({"precision": F.when(none, 1.0).otherwise(_share(F.col("tp"), F.col("n_pred"))), "recall": F.when(none, 1.0).otherwise(_share(F.col("tp"), F.col("n_true")))})
    pr = F.col("precision"), F.col("recall")
    return rows.withColumn("f05", F.when(pr[0] + pr[1] > 0, (1 + beta2) * pr[0] * pr[1] / (beta2 * pr[0] + pr[1])).otherwise(0.0))


def require_unique(preds: DataFrame) -> DataFrame:
    """preds; an action fails where an entity names a target twice."""
    n = F.count("*").over(Window.partitionBy("s1_id", "target_id"))
    wrong = F.raise_error(F.concat(F.lit("duplicate prediction of "), "s1_id")).cast("boolean")
    return preds.withColumn("n", n).where(F.when(F.col("n") > 1, wrong).otherwise(True)).drop("n")


def macro(scores: DataFrame) -> DataFrame:
    """The macro measures and their diagnostics as one row."""
    n = lambda c: F.sum(c.cast("long"))
    single, none = F.col("n_true") == 0, F.col("n_pred") == 0
    return scores.agg(
        F.round(F.avg("f05"), 6).alias("macro_f05"),
        F.round(F.avg("precision"), 6).alias("mean_precision"),
        F.round(F.avg("recall"), 6).alias("mean_recall"),
        F.count("*").alias("entities"),
        n(single).alias("true_singletons"),
        n(single & none).alias("correct_singletons"),
        n(single & ~none).alias("false_merges"),
        n(~single & none).alias("missed_entities"),
        F.sum("n_true").alias("true_links"),
        F.sum("n_pred").alias("predicted_links"),
        F.sum("tp").alias("correct_links"),
        n(F.col("f05") == 1.0).alias("perfect_entities"),
    )


def policy_report(scores: DataFrame) -> DataFrame:
    """Macro F0.5 by number of true links, link recall, shares of predicted counts."""
    at = lambda c: F.avg(F.when(c, F.col("f05")))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return scores.agg(
        F.round(F.avg("f05"), 6).alias("macro_f05"),
        F.round(_share(F.sum("tp"), F.sum("n_true")), 6).alias("link_recall"),
        F.round(F.coalesce(at(F.col("n_true") == 0), F.lit(1.0)), 6).alias("singleton_f05"),
        F.round(F.coalesce(at(F.col("n_true") == 1), F.lit(0.0)), 6).alias("one_match_f05"),
        F.round(F.coalesce(at(F.col("n_true") >= 2), F.lit(0.0)), 6).alias("multi_match_f05"),
        share(F.col("n_pred") == 0).alias("share_0"),
        share(F.col("n_pred") == 1).alias("share_1"),
        share(F.col("n_pred") == 2).alias("share_2"),
        share(F.col("n_pred") >= 3).alias("share_3plus"),
    )


def pair_quality(labelled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision and recall at a threshold, average precision by steps, ROC area; label, score in, and n
    where a row stands for many.

    Scores are grouped first, so the running sums go over distinct scores, range by range.
    """
    rows = F.col("n") if "n" in labelled.columns else F.lit(1)
    groups = labelled.groupBy("score").agg(F.sum(F.col("label") * rows).alias("p"), F.sum((1 - F.col("label")) * rows).alias("n"))
    g = running_down(groups, "score", ["p", "n"]).withColumnsRenamed({"run_p": "tp", "run_n": "fp"})
    hit = F.col("score") >= threshold
    tp, pred = F.sum(F.when(hit, F.col("p")).otherwise(0)), F.sum(F.when(hit, F.col("p") + F.col("n")).otherwise(0))
    step = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    above = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0))  # positives over a negative, ties half
    all_p, all_n = F.max("all_p"), F.max("all_n")
    return g.agg(
        F.round(F.coalesce(_share(tp, pred), F.lit(0.0)), 6).alias("pair_precision"),
        F.round(F.coalesce(_share(tp, all_p), F.lit(0.0)), 6).alias("pair_recall"),
        F.round(F.coalesce(_share(step, all_p), F.lit(0.0)), 6).alias("average_precision"),
        F.round(F.coalesce(F.when((all_p > 0) & (all_n > 0), above / (all_p * all_n)), F.lit(0.5)), 6).alias("roc_auc"),
    )


def ranking_quality(links: DataFrame, scored: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """k, recall and precision among the k best, over entities with links."""
    true = links.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "target_id"))
    rows = scored.select("s1_id", "target_id", "score").withColumn("rank", rank).where(F.col("rank") <= max(ks))
    rows = rows.join(links.select("s1_id", "target_id", F.lit(1).alias("y")), ["s1_id", "target_id"], "left").withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")
    counts = rows.groupBy("s1_id", "k").agg(F.count("*").alias("shown"), F.coalesce(F.sum("y"), F.lit(0)).alias("hits"))
    grid = true.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).join(counts, ["s1_id", "k"], "left")
    return grid.groupBy("k").agg(F.round(F.avg(F.coalesce(F.col("hits") / F.col("n_true"), F.lit(0.0))), 6).alias("recall"), F.round(F.avg(F.coalesce(F.col("hits") / F.col("shown"), F.lit(0.0))), 6).alias("precision"))


def threshold_sweep(spine: DataFrame, links: DataFrame, scored: DataFrame, thresholds: tuple[float, ...] = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    """Macro F0.5 and link recall at every threshold, from one join of scores and links."""
    true = links.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    rows = scored.join(links.withColumn("y", F.lit(1)), ["s1_id", "target_id"], "left")
    per = []
    for k, th in enumerate(thresholds):
        hit = F.col("score") >= th
        per += [F.sum(hit.cast("long")).alias(f"p{k}"), F.sum(F.when(hit, F.coalesce("y", F.lit(0))).otherwise(0)).alias(f"t{k}")]
    counts = spine.select("s1_id").join(rows.groupBy("s1_id").agg(*per), "s1_id", "left").join(true, "s1_id", "left").na.fill(0)
    at = F.explode(F.array(*[F.struct(F.lit(th).alias("threshold"), F.col(f"p{k}").alias("n_pred"), F.col(f"t{k}").alias("tp")) for k, th in enumerate(thresholds)])).alias("x")
    c = counts.select("n_true", at).select("n_true", "x.*")
    none = (F.col("n_true") == 0) & (F.col("n_pred") == 0)
    c = c.withColumns({"p": F.when(none, 1.0).otherwise(_share(F.col("tp"), F.col("n_pred"))), "r": F.when(none, 1.0).otherwise(_share(F.col("tp"), F.col("n_true")))})
    c = c.withColumn("f", F.when(F.col("p") + F.col("r") > 0, 1.25 * F.col("p") * F.col("r") / (0.25 * F.col("p") + F.col("r"))).otherwise(0.0))
    return c.groupBy("threshold").agg(F.round(F.avg("f"), 6).alias("macro_f05"), F.round(_share(F.sum("tp"), F.sum("n_true")), 6).alias("link_recall"), F.sum("n_pred").alias("predicted_links"))


def rank_margin(scored: DataFrame) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "target_id"))
    best = scored.withColumn("r", order).where("r <= 2").groupBy("s1_id").agg(F.max(F.when(F.col("r") == 1, F.col("score"))).alias("a"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0)).alias("b"))
    return best.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n) for c, n in ((F.col("a"), "mean_top_score"), (F.col("b"), "mean_second_score"), (F.col("a") - F.col("b"), "mean_score_margin"))])


def paired_bootstrap(a: DataFrame, b: DataFrame, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Mean difference of two policies' entity scores with a percentile interval.

    Every entity draws its Poisson weights for all rounds from hashes, so a round is a weighted mean.
    Each task adds its entities' weights up and gives one row a round.
    """
    d = a.select("s1_id", F.col("f05").alias("x")).join(b.select("s1_id", F.col("f05").alias("y")), "s1_id").select("s1_id", (F.col("y") - F.col("x")).alias("d"))

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        # Poisson distribution function at rate one
        steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
        weighted, weights, n = np.zeros(rounds), np.zeros(rounds), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                h = part.column(0).to_numpy().view(np.uint64)[:, None] + np.arange(1, rounds + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # mixing constants of SplitMix64
                    h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
                u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
                w = np.searchsorted(steps, u, "left").astype(float)
                weighted += part.column(1).to_numpy() @ w
                weights += w.sum(axis=0)
                n += part.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, rounds + 1)), pa.array(weighted), pa.array(weights)], ["round", "dw", "w"])

    drawn = d.select(F.xxhash64("s1_id", F.lit(seed)).alias("h"), "d").mapInArrow(draw, "round long, dw double, w double")
    means = drawn.groupBy("round").agg((F.sum("dw") / F.greatest(F.sum("w"), F.lit(1.0))).alias("m"))
    spread = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg((F.col("m") <= 0).cast("double")).alias("below"), F.avg((F.col("m") >= 0).cast("double")).alias("above"))
    whole = d.agg(F.avg("d").alias("mean_delta"), F.sum((F.col("d") > 1e-6).cast("long")).alias("improved"), F.sum((F.col("d") < -1e-6).cast("long")).alias("worsened"), F.sum((F.abs("d") <= 1e-6).cast("long")).alias("tied"))
    both = whole.withColumn("one", F.lit(1)).join(spread.withColumn("one", F.lit(1)), "one")
    return both.select("mean_delta", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "improved", "worsened", "tied", F.least(F.lit(1.0), 2 * F.least("below", "above")).alias("p_value"))


def error_decomposition(links: DataFrame, scored: DataFrame, preds: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Missed links by where they were lost: blocking, matcher or policy."""
    best = scored.groupBy("s1_id", "target_id").agg(F.max("score").alias("score"))
    rows = links.join(best, ["s1_id", "target_id"], "left").join(preds.select("s1_id", "target_id").distinct().withColumn("y", F.lit(True)), ["s1_id", "target_id"], "left")
    kind = F.when(F.col("y"), "captured").when(F.col("score").isNull(), "blocking").when(F.col("score") < threshold, "matcher").otherwise("policy")
    n = lambda k: F.coalesce(F.sum((F.col("kind") == k).cast("long")), F.lit(0))
    return rows.withColumn("kind", kind).agg(F.count("*").alias("true_links"), *[n(k).alias(k) for k in ("captured", "blocking", "matcher", "policy")])


def slice_recall(links: DataFrame, pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Link recall in 14 slices of entities and links."""
    s2, s3 = F.col("target_id").startswith("S2-"), F.col("target_id").startswith("S3-")
    per = links.groupBy("s1_id").agg(F.count("*").alias("n"), F.sum(s2.cast("int")).alias("a"), F.sum(s3.cast("int")).alias("b"))
    rows = captured(links, pairs).join(per, "s1_id").join(records.select(F.col("entity_id").alias("s1_id"), "business_name", "business_address", "country"), "s1_id")
    country = F.upper(F.coalesce("country", F.lit("")))
    missing = F.trim(F.coalesce("business_address", F.lit(""))) == ""
    short = F.length(F.coalesce("business_name", F.lit(""))) <= 15
    slices = {
        "overall": F.lit(True), "one_match": F.col("n") == 1, "multi_match": F.col("n") > 1, "us": country == "US", "india": country == "INDIA",
        "s2_links": s2, "s3_links": s3, "s2_only_entity": (F.col("a") > 0) & (F.col("b") == 0), "s3_only_entity": (F.col("b") > 0) & (F.col("a") == 0),
        "both_sources_entity": (F.col("a") > 0) & (F.col("b") > 0), "address_present": ~missing, "address_missing": missing, "name_short": short, "name_long": ~short,
    }
    names = F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in slices.items()]), lambda x: x.isNotNull())).alias("slice_name")
    return rows.select("hit", names).groupBy("slice_name").agg(F.count("*").alias("true_links"), F.sum(F.col("hit").cast("long")).alias("captured"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("recall"))


def explosions(spine: DataFrame, pairs: DataFrame, n: int = 25) -> DataFrame:
    """The queries with most candidates: a report of n rows."""
    return volumes(spine, pairs).orderBy(F.desc("n"), "s1_id").limit(n)


def failures(links: DataFrame, pairs: DataFrame, n: int = 50) -> DataFrame:
    """Links that blocking missed: a report of n rows at most."""
    return missed(links, pairs).orderBy("s1_id", "target_id").limit(n)


def missed(links: DataFrame, pairs: DataFrame) -> DataFrame:
    return links.select("s1_id", "target_id").join(pairs, ["s1_id", "target_id"], "left_anti")


def fold_stability(values: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, population deviation, extremes and variation of a measure over folds."""
    return values.groupBy(by).agg(F.count("*").alias("folds"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"), F.round(F.min(value), 6).alias("least"), F.round(F.max(value), 6).alias("most"), F.round(_share(F.stddev_pop(value), F.avg(value)), 6).alias("cv"))


def submission_profile(spine: DataFrame, preds: DataFrame) -> DataFrame:
    """Distribution of predicted counts and a verdict on it."""
    per = preds.groupBy("s1_id").agg(F.count("*").alias("n"), F.sum(F.col("target_id").startswith("S2-").cast("long")).alias("s2"), F.sum(F.col("target_id").startswith("S3-").cast("long")).alias("s3"))
    rows = spine.select("s1_id").join(per, "s1_id", "left").na.fill(0)
    n = lambda c: F.sum(c.cast("long"))
    got = rows.agg(F.count("*").alias("entities"), *[n(F.col("n") == k).alias(f"n_{k}") for k in range(4)], n(F.col("n") > 3).alias("n_more"), F.sum("n").alias("matches"), F.sum("s2").alias("s2_targets"), F.sum("s3").alias("s3_targets"), F.sum(F.col("n") - F.col("s2") - F.col("s3")).alias("bad_prefix"))
    empty, mean = F.col("n_0") / F.col("entities"), F.col("matches") / F.col("entities")
    return got.select("*", F.round(mean, 6).alias("mean_matches"), F.when((empty > 0.40) | (empty < 0.01) | (mean > 4.5) | (mean < 0.5), "WARNING").otherwise("NORMAL").alias("verdict"))


#: Words whose agreement says little.
WEAK_WORDS = "solutions enterprises services industries holdings group".split()


def _cause_fields(records: DataFrame) -> DataFrame:
    """What the causes need of a record, every record once."""
    plain = records.select("entity_id", F.coalesce("business_name", F.lit("")).alias("name"), F.coalesce("business_address", F.lit("")).alias("address"))
    plain = plain.select("*", t.has_indic("name").alias("indic"), t.tokens(t.standard_clean("name")).alias("words"), F.get(t.numeric_tokens("address"), 0).alias("number"))
    few = F.size(F.filter(F.split(t.collapse("address"), " "), lambda w: w != "")) < 3
    return plain.select("*", (F.col("address") == "").alias("bare"), few.alias("few"), F.col("name").contains(".").alias("dotted")).drop("address")


def _false_positive(q, s) -> Column:
    """The likely cause; q, s: column of a query's and a target's field."""
    head = lambda c: F.lower(F.substring_index(c, ".", 1))
    weak = F.size(F.array_except(F.array_intersect(q("words"), s("words")), F.array(*map(F.lit, WEAK_WORDS)))) == 0
    return (
        F.when(q("indic") != s("indic"), "cross_script")
        .when((q("dotted") | s("dotted")) & (head(q("name")) == head(s("name"))), "domain_collision")
        .when((q("number") == s("number")) & (F.lower(q("name")) != F.lower(s("name"))), "commercial_cluster")
        .when(weak, "generic_tokens")
        .otherwise("high_lexical_similarity")
    )


_PLAIN = ("indic", "bare", "few", "dotted")  # what a false negative's cause is told from


def _false_negative(q, s) -> Column:
    return (
        F.when(q("indic") | s("indic"), "cross_script_target")
        .when(q("bare") | s("bare"), "address_missing")
        .when(q("few") | s("few"), "address_truncated")
        .when(q("dotted") | s("dotted"), "domain_alias")
        .otherwise("name_transformation")
    )


def _of_side(p: str):
    return lambda c: F.col(f"{p}_{c}")


def _shares(counts: DataFrame) -> DataFrame:
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 6))


def error_causes(links: DataFrame, preds: DataFrame, records: DataFrame) -> DataFrame:
    """False positives and negatives by their likely cause, with each cause's share of its kind."""
    true, said = links.select("s1_id", "target_id", F.lit(True).alias("y")), preds.select("s1_id", "target_id", F.lit(True).alias("p"))
    rows = true.join(said, ["s1_id", "target_id"], "full_outer").where("y IS NULL OR p IS NULL").withColumn("kind", F.when(F.col("y").isNull(), "FP").otherwise("FN"))
    plain = _cause_fields(records)
    side = lambda p, key: plain.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in plain.columns[1:]])
    rows = rows.join(side("q", "s1_id"), "s1_id").join(side("t", "target_id"), "target_id")
    q, s = _of_side("q"), _of_side("t")
    cause = F.when(F.col("kind") == "FP", _false_positive(q, s)).otherwise(_false_negative(q, s))
    return _shares(rows.withColumn("cause", cause).groupBy("kind", "cause").agg(F.count("*").alias("n")))


def carried_causes(records: DataFrame, hashes: DataFrame) -> DataFrame:
    """entity_id, h (equal in a true link's records, hashes has it) and what the causes need, for
    blocking.provenance to carry; their names start with c_, so none is a feature's field."""
    plain = _cause_fields(records)
    return plain.select("entity_id", *[F.col(c).alias(f"c_{c}") for c in plain.columns[1:]]).join(hashes, "entity_id")


def carried_cause() -> Column:
    """Of a pair with hit and both records' carried_causes: its cause as a false positive, or the one it
    would have as a false negative if it is a true link."""
    q, s = _of_side("q_c"), _of_side("t_c")
    return F.when(F.col("hit"), _false_negative(q, s)).otherwise(_false_positive(q, s))


def error_causes_of_hits(accepted: DataFrame, fields: DataFrame) -> DataFrame:
    """error_causes of accepted pairs (hit, cause; no pair twice), fields being all records' carried_causes.
    Neither pairs nor links are joined or shuffled: links of a cause are counted by products of record
    counts of equal h, and less the accepted ones they are those missed."""
    kind, one = F.when(F.col("hit"), "FN").otherwise("FP"), F.when(F.col("hit"), -1).otherwise(1)
    said = accepted.groupBy(kind.alias("kind"), "cause").agg(F.sum(one).alias("n"))
    per = lambda rows, p: rows.groupBy("h", *[F.col(f"c_{c}").alias(f"{p}_{c}") for c in _PLAIN]).agg(F.count("*").alias(f"{p}_n"))
    first, known = F.col("entity_id").startswith("S1-"), fields.where("h IS NOT NULL")
    links = per(known.where(first), "q").join(per(known.where(~first), "t"), "h")
    links = links.groupBy(_false_negative(_of_side("q"), _of_side("t")).alias("cause")).agg(F.sum(F.col("q_n") * F.col("t_n")).alias("n"))
    links = links.select(F.lit("FN").alias("kind"), "cause", "n")
    return _shares(said.unionByName(links).groupBy("kind", "cause").agg(F.sum("n").alias("n")).where("n > 0"))


def arm_report(spine: DataFrame, links: DataFrame, scored: DataFrame, preds: DataFrame) -> DataFrame:
    """One row: the macro measures of preds, pair quality, recall among the k best, margins, and the
    threshold with the best macro F0.5 (the least of equal ones)."""
    label = scored.join(links.select("s1_id", "target_id", F.lit(1).alias("label")), ["s1_id", "target_id"], "left").na.fill(0, ["label"])
    ranks = ranking_quality(links, scored)
    at = ranks.agg(*[F.max(F.when(F.col("k") == k, F.col("recall"))).alias(f"recall_at_{k}") for k in (1, 3, 5, 10)])
    sweep = threshold_sweep(spine, links, scored).agg(F.max(F.struct("macro_f05", (-F.col("threshold")).alias("t"))).alias("b"))
    best = sweep.select((-F.col("b.t")).alias("best_threshold"), F.col("b.macro_f05").alias("best_macro_f05"))
    parts = [macro(entity_scores(spine, links, preds)), pair_quality(label), at, rank_margin(scored), best]
    rows = parts[0].withColumn("one", F.lit(1))
    for part in parts[1:]:
        rows = rows.join(part.withColumn("one", F.lit(1)), "one")
    return rows.drop("one")
