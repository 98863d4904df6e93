"""Data audits, constraint checks and verifications, each as one table of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_profile(records: DataFrame) -> DataFrame:
    """A row a source, and one ("all") for the whole: rows, blanks, repeated ids, countries."""
    blank = lambda c: F.sum((F.trim(F.coalesce(c, F.lit(""))) == "").cast("long"))
    rows = records.withColumn("source", F.substring_index("entity_id", "-", 1))
    got = rows.rollup("source").agg(
        F.grouping("source").alias("g"),
        F.count("*").alias("n_rows"),
        blank("business_name").alias("blank_names"),
        blank("business_address").alias("blank_addresses"),
        blank("country").alias("blank_countries"),
        F.countDistinct("entity_id").alias("ids"),
        F.countDistinct("country").alias("countries"),
    )
    return got.select(F.when(F.col("g") == 1, "all").otherwise(F.col("source")).alias("source"), "n_rows", "blank_names", "blank_addresses", "blank_countries", (F.col("n_rows") - F.col("ids")).alias("repeated_ids"), "countries")


def country_histogram(records: DataFrame) -> DataFrame:
    return records.groupBy(F.substring_index("entity_id", "-", 1).alias("source"), "country").agg(F.count("*").alias("n"))


def repeated_names(records: DataFrame) -> DataFrame:
    """Per source: names that occur more than once, and the rows they take."""
    per = records.groupBy(F.substring_index("entity_id", "-", 1).alias("source"), "business_name").agg(F.count("*").alias("n")).where("n > 1")
    return per.groupBy("source").agg(F.count("*").alias("names"), F.sum("n").alias("n_rows"))


def truth_profile(spine: DataFrame, links: DataFrame) -> DataFrame:
    s2, s3 = F.col("target_id").startswith("S2-"), F.col("target_id").startswith("S3-")
    per = links.groupBy("s1_id").agg(F.count("*").alias("n"), F.sum(s2.cast("long")).alias("a"), F.sum(s3.cast("long")).alias("b"))
    rows = spine.select("s1_id").join(per, "s1_id", "left").na.fill(0)
    n = lambda c: F.sum(c.cast("long"))
    a, b = F.col("a") > 0, F.col("b") > 0
    return rows.agg(F.count("*").alias("entities"), n(F.col("n") == 0).alias("singletons"), n(F.col("n") == 1).alias("one_match"), n(F.col("n") > 1).alias("multi_match"), n(a & ~b).alias("s2_only"), n(b & ~a).alias("s3_only"), n(a & b).alias("both_sources"), F.sum("n").alias("links"), F.round(F.avg("n"), 6).alias("mean_links"))


def cardinalities(spine: DataFrame, links: DataFrame, n: int = 10) -> DataFrame:
    """The n commonest numbers of links: a report."""
    per = links.groupBy("s1_id").agg(F.count("*").alias("n_links"))
    rows = spine.select("s1_id").join(per, "s1_id", "left").na.fill(0)
    return rows.groupBy("n_links").agg(F.count("*").alias("entities")).orderBy(F.desc("entities"), "n_links").limit(n)


def constraint_violations(records: DataFrame, prefix: str | None = None) -> DataFrame:
    """rule, entity_id, n of every broken record rule: blank ids, repeated ids, wrong prefixes."""
    ids = F.coalesce("entity_id", F.lit(""))
    blank = records.where(F.trim(ids) == "").groupBy().agg(F.count("*").alias("n")).where("n > 0").select(F.lit("blank_id").alias("rule"), F.lit("").alias("entity_id"), "n")
    again = records.groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("rule"), "entity_id", "n")
    found = [blank, again]
    if prefix:
        found.append(records.where((F.trim(ids) != "") & ~ids.startswith(prefix)).groupBy("entity_id").agg(F.count("*").alias("n")).select(F.lit("wrong_prefix").alias("rule"), "entity_id", "n"))
    return reduce(DataFrame.unionByName, found)


def submission_violations(rows: DataFrame, expected: DataFrame, samples: int = 5) -> DataFrame:
    """rule, n and up to samples examples of every broken rule; rows: s1_id, matches (a comma list)."""
    ids = F.trim(F.coalesce("s1_id", F.lit("")))
    each = rows.select(ids.alias("s1_id"), F.posexplode(F.filter(F.split(F.coalesce("matches", F.lit("")), ","), lambda x: F.trim(x) != "")).alias("pos", "m")).withColumn("m", F.trim("m"))
    rules = {
        "blank_id": rows.where(ids == "").select(F.lit("").alias("x")),
        "duplicate_row": rows.where(ids != "").groupBy("s1_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("s1_id").alias("x")),
        "duplicate_match": each.groupBy("s1_id", "m").agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws(":", "s1_id", "m").alias("x")),
        "self_match": each.where("m LIKE 'S1-%'").select(F.concat_ws(":", "s1_id", "m").alias("x")),
        "wrong_prefix": each.where("m NOT LIKE 'S1-%' AND m NOT LIKE 'S2-%' AND m NOT LIKE 'S3-%'").select(F.concat_ws(":", "s1_id", "m").alias("x")),
        "missing_entity": expected.select("s1_id").join(rows, "s1_id", "left_anti").select(F.col("s1_id").alias("x")),
        "unknown_entity": rows.where(ids != "").join(expected.select("s1_id"), "s1_id", "left_anti").select(F.col("s1_id").alias("x")),
    }
    found = reduce(DataFrame.unionByName, [d.withColumn("rule", F.lit(r)) for r, d in rules.items()])
    from pyspark.sql import Window

    # examples by rank within map tasks first: no rule's findings gather in one place
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("rule").orderBy("x"))).where(F.col("r") <= samples)
    shown = top.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("examples"))
    return found.groupBy("rule").agg(F.count("*").alias("n")).join(shown, "rule").select("rule", "n", "examples")


def verify_output(spine: DataFrame, preds: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts, cardinalities and PASS or FAIL of a written prediction: every target must exist (all are
    looked up, not a sample), every S1 be known, no target be named twice."""
    unknown = preds.join(targets.select(F.col("entity_id").alias("target_id")), "target_id", "left_anti").agg(F.count("*").alias("unknown_targets"))
    foreign = preds.join(spine.select("s1_id"), "s1_id", "left_anti").agg(F.count("*").alias("unknown_entities"))
    again = preds.groupBy("s1_id", "target_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("repeated"))
    s2, s3 = F.col("target_id").startswith("S2-"), F.col("target_id").startswith("S3-")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    base = preds.agg(F.count("*").alias("predictions"), F.countDistinct("s1_id").alias("matched_entities"), n(s2).alias("s2_links"), n(s3).alias("s3_links"), n(~s2 & ~s3).alias("wrong_prefix"))
    per = spine.select("s1_id").join(preds.groupBy("s1_id").agg(F.count("*").alias("k")), "s1_id", "left").na.fill(0)
    sizes = per.agg(F.count("*").alias("entities"), *[n(F.col("k") == k).alias(f"cardinality_{k}") for k in range(4)], n(F.col("k") > 3).alias("cardinality_more"))
    one = [d.withColumn("one", F.lit(1)) for d in (base, unknown, foreign, again, sizes)]
    rows = reduce(lambda a, b: a.join(b, "one"), one).drop("one")
    bad = F.col("unknown_targets") + F.col("unknown_entities") + F.col("repeated") + F.col("wrong_prefix")
    return rows.withColumn("verdict", F.when(bad == 0, "PASS").otherwise("FAIL"))


def id_round_trip(spine: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """Target ids through the prediction file's form and back: how many there are, how many come back
    changed or not at all, and how many have a wrong prefix."""
    from ..sources.sinks import prediction_rows
    from ..sources.tsv import TRUTH_COLUMNS, parsed_matches

    rows = prediction_rows(spine, links.select("s1_id", "target_id", F.lit(1.0).alias("score"), F.lit(1).alias("rank")))
    back = rows.select(F.col(TRUTH_COLUMNS[0]).alias("s1_id"), F.explode(parsed_matches(F.col(TRUTH_COLUMNS[1]))).alias("target_id"))
    lost = links.select("s1_id", "target_id").exceptAll(back).agg(F.count("*").alias("lost"))
    new = back.exceptAll(links.select("s1_id", "target_id")).agg(F.count("*").alias("changed"))
    prefix = targets.select("entity_id").agg(F.count("*").alias("targets"), F.coalesce(F.sum((~F.col("entity_id").rlike("^S[23]-")).cast("long")), F.lit(0)).alias("wrong_prefix"))
    one = [d.withColumn("one", F.lit(1)) for d in (back.agg(F.count("*").alias("ids")), lost, new, prefix)]
    rows = reduce(lambda a, b: a.join(b, "one"), one).drop("one")
    return rows.withColumn("verdict", F.when(F.col("lost") + F.col("changed") + F.col("wrong_prefix") == 0, "PASS").otherwise("FAIL"))


def leakage(train: DataFrame, validation: DataFrame, truth: DataFrame) -> DataFrame:
    """Ids in both parts, and ids the parts lack or add against the whole."""
    both = train.select("entity_id").intersect(validation.select("entity_id"))
    parts = train.select("entity_id").union(validation.select("entity_id"))
    n = lambda d, name: d.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
    lost, added = truth.select("entity_id").subtract(parts), parts.subtract(truth.select("entity_id"))
    rows = reduce(lambda a, b: a.join(b, "one"), [n(both, "overlap"), n(lost, "lost"), n(added, "added"), n(train.distinct(), "train"), n(validation.distinct(), "validation")]).drop("one")
    return rows.withColumn("clean", (F.col("overlap") == 0) & (F.col("lost") == 0) & (F.col("added") == 0))


def link_agreement(links: DataFrame, records: DataFrame) -> DataFrame:
    """Over all links: how often names, addresses and countries agree exactly."""
    side = lambda p, key: records.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{p}{k}") for k, c in enumerate(("business_name", "business_address", "country"))])
    rows = links.join(side("q", "s1_id"), "s1_id").join(side("t", "target_id"), "target_id")
    same = lambda k: F.coalesce(F.sum((F.lower(F.trim(f"q{k}")) == F.lower(F.trim(f"t{k}"))).cast("long")), F.lit(0))
    return rows.agg(F.count("*").alias("links"), same(0).alias("same_name"), same(1).alias("same_address"), same(2).alias("same_country"))


def output_by_country(preds: DataFrame, records: DataFrame) -> DataFrame:
    """Matches by the entity's country and the target's source, with subtotals of both."""
    country = records.select(F.col("entity_id").alias("s1_id"), "country")
    rows = preds.join(country, "s1_id").withColumn("target_source", F.substring_index("target_id", "-", 1))
    got = rows.cube("country", "target_source").agg(F.count("*").alias("n"), F.countDistinct("s1_id").alias("entities"))
    return got.select(F.coalesce("country", F.lit("all")).alias("country"), F.coalesce("target_source", F.lit("all")).alias("target_source"), "n", "entities")


def unseen_countries(train: DataFrame, test: DataFrame, n: int = 10) -> DataFrame:
    """Countries of test that train lacks, with examples: a report of n rows."""
    return test.join(train.select("country").distinct(), "country", "left_anti").groupBy("country").agg(F.count("*").alias("n"), F.min("entity_id").alias("example")).orderBy(F.desc("n"), "country").limit(n)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two runs has, counting repeats: zero and zero for equal runs."""
    n = lambda d, name: d.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
    return n(a.exceptAll(b), "only_first").join(n(b.exceptAll(a), "only_second"), "one").drop("one")
