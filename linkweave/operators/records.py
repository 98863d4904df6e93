"""Records enriched once with every derived field that keys, features and retrieval need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .tables import cut_off

BASE = ("entity_id", "business_name", "business_address", "country")


def with_source(df: DataFrame, id_col: str = "entity_id") -> DataFrame:
    return df.withColumn("source", F.substring_index(id_col, "-", 1))


def enrich(records: DataFrame) -> DataFrame:
    """Adds clean_name, name (without legal forms), address, tokens and signatures."""
    base = records.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in BASE])
    base = base.select(
        *BASE,
        t.standard_clean("business_name").alias("clean_name"),
        t.standard_clean("business_address").alias("address"),
        t.domain_signature("business_name", 4).alias("domain"),
        t.leetspeak_signature("business_name", 4).alias("leet"),
        t.romanised("business_name").alias("latin_name"),
        t.indic_signature("business_name", 4).alias("indic"),
        t.has_indic("business_name").alias("is_indic"),
    )
    base = base.withColumn("name", t.strip_legal(F.col("clean_name")))
    return base.select(
        "*",
        t.tokens(F.col("name")).alias("name_tokens"),
        t.sorted_tokens(F.col("name")).alias("sorted_name"),
        F.replace("name", F.lit(" "), F.lit("")).alias("compact"),
        t.tokens(F.col("address")).alias("address_tokens"),
        t.postal_codes(F.col("business_address")).alias("postals"),
        t.numeric_tokens(F.col("business_address")).alias("numbers"),
        t.numeric_compounds(F.col("business_address")).alias("plots"),
        t.informative_tokens(t.tokens(F.col("name"))).alias("informative"),
        t.strip_accents(F.col("name")).alias("bare_name"),
    )


def queries_of(records: DataFrame) -> DataFrame:
    return records.where(F.col("entity_id").startswith("S1-"))


def targets_of(records: DataFrame) -> DataFrame:
    return records.where(F.col("entity_id").startswith("S2-") | F.col("entity_id").startswith("S3-"))


def load_with_distractors(records: DataFrame, s1_ids: DataFrame, target_ids: DataFrame, per_source: int = 250_000) -> DataFrame:
    """The wanted queries and targets, and the first per_source other targets of each source."""
    wanted = records.join(s1_ids.select(F.col("s1_id").alias("entity_id")).union(target_ids.select("target_id")).distinct(), "entity_id", "left_semi")
    others = targets_of(records).join(target_ids.select(F.col("target_id").alias("entity_id")).distinct(), "entity_id", "left_anti")
    for source in ("S2-", "S3-"):
        part = others.where(F.col("entity_id").startswith(source))
        last = cut_off(part, "entity_id", per_source)  # null: the source has no more than these
        wanted = wanted.unionByName(part if last is None else part.where(F.col("entity_id") <= last))
    return wanted
