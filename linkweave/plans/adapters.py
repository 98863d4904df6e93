"""Linkage views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_records(docs: DataFrame, name: Column | None = None) -> DataFrame:
    """Three sources by id, name or the first six words of the first line as name, source and length as
    address: pairs are of records with short names, as the operators expect."""
    first = F.split(F.substring_index("text", "\n", 1), " ")
    return docs.select(
        F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        (F.array_join(F.slice(first, 1, 6), " ") if name is None else name).alias("business_name"),
        F.concat_ws(" ", "source", F.col("n_chars").cast("string")).alias("business_address"),
        F.col("lang").alias("country"),
    )


def text_hashes(docs: DataFrame) -> DataFrame:
    """entity_id, h: pairs of equal h are document_links'; a null text's h is null."""
    return docs.select(F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), F.md5("text").alias("h"))


def document_links(docs: DataFrame) -> DataFrame:
    """True links: first-source records and others with equal texts."""
    rows = text_hashes(docs)
    a = rows.where("entity_id LIKE 'S1-%'").select(F.col("entity_id").alias("s1_id"), "h")
    b = rows.where("entity_id NOT LIKE 'S1-%'").select(F.col("entity_id").alias("target_id"), "h")
    return a.join(b, "h").select("s1_id", "target_id")


def parts_as_records(part: DataFrame) -> DataFrame:
    """Few names in many records: heavy buckets."""
    return part.select(
        F.concat(F.lit("S"), (1 + F.col("p_partkey") % 3).cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("entity_id"),
        F.col("p_name").alias("business_name"),
        F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_brand", "p_type").alias("business_address"),
        F.lit("US").alias("country"),
    )


def customers_as_records(customer: DataFrame, nation: DataFrame) -> DataFrame:
    rows = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    return rows.select(
        F.concat(F.lit("S"), (1 + F.col("c_custkey") % 3).cast("string"), F.lit("-"), F.col("c_custkey").cast("string")).alias("entity_id"),
        F.col("c_name").alias("business_name"),
        F.col("c_mktsegment").alias("business_address"),
        F.col("n_name").alias("country"),
    )
