"""Sinks: prediction files, ranked lists, resumable chunks, reports and registries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tsv import TRUTH_COLUMNS


def prediction_rows(spine: DataFrame, accepted: DataFrame, order: str | None = None) -> DataFrame:
    """source1_entity_id, matched_entity_ids: a row an entity, empty lists too; order: a spine column."""
    from ..operators.policy import match_lists

    rows = match_lists(spine, accepted)
    if order:
        rows = rows.join(spine.select("s1_id", order), "s1_id").orderBy(order)
    return rows.select(F.col("s1_id").alias(TRUTH_COLUMNS[0]), F.array_join("matches", ",").alias(TRUTH_COLUMNS[1]))


def write_predictions(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Range-ordered part files keep the rows' order across them; files=1 for one file at the edge."""
    out = rows if files is None else rows.coalesce(files)
    out.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def ranked_rows(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("s1_id").orderBy(F.desc("score"), "target_id")
    return scored.select("s1_id", "target_id", "score", F.row_number().over(order).alias("rank"))


def write_chunks(rows: DataFrame, path: str, chunk: str = "chunk") -> None:
    """Writes each chunk's folder anew; a chunk written twice replaces itself."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(chunk).parquet(path)


def pending(queries: DataFrame, path: str, chunk: str = "chunk") -> DataFrame:
    """The queries whose chunk isn't written yet."""
    spark = queries.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return queries
    return queries.join(spark.read.parquet(path).select(chunk).distinct(), chunk, "left_anti")


def with_chunk(queries: DataFrame, chunks: int, id_col: str = "s1_id") -> DataFrame:
    return queries.withColumn("chunk", F.pmod(F.xxhash64(id_col), F.lit(chunks)).cast("int"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both; where both have a key, the new one's."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new")))).where("_r = 1").drop("_r", "_new")


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result as one CSV, JSON or Markdown file."""
    out = df.coalesce(1)
    if kind == "json":
        out.write.mode("overwrite").json(path)
    elif kind == "md":
        line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")
        head = df.sparkSession.range(1).select(line([F.lit(c) for c in df.columns])).union(df.sparkSession.range(1).select(line([F.lit("-") for _ in df.columns])))
        head.union(out.select(line([F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]))).coalesce(1).write.mode("overwrite").text(path)
    else:
        out.write.mode("overwrite").csv(path, header=True)


def register(spark: SparkSession, path: str, name: str, params: dict, metrics: dict) -> None:
    """Appends a run to a registry table; the latest row of a name counts."""
    row = [(name, json.dumps(params, sort_keys=True), json.dumps(metrics, sort_keys=True))]
    df = spark.createDataFrame(row, "name string, params string, metrics string").withColumn("at", F.current_timestamp())
    df.write.mode("append").parquet(path)


def registered(spark: SparkSession, path: str) -> DataFrame:
    latest = Window.partitionBy("name").orderBy(F.desc("at"))
    return spark.read.parquet(path).withColumn("r", F.row_number().over(latest)).where("r = 1").drop("r")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of files, read whole by the executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def leaderboard(runs: DataFrame, metric: str) -> DataFrame:
    return runs.select("name", F.get_json_object("metrics", f"$.{metric}").cast("double").alias(metric)).orderBy(F.desc(metric), "name")


def leaderboard_matrix(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """A row a run: its metrics, and its rank by each of them (equal values share one)."""
    rows = runs.select("name", *[F.get_json_object("metrics", f"$.{m}").cast("double").alias(m) for m in metrics])
    # one row a registered run: a small table
    return rows.select("*", *[F.rank().over(Window.orderBy(F.desc_nulls_last(m))).alias(f"rank_{m}") for m in metrics])


def hypothesise(spark: SparkSession, path: str, name: str, hypothesis: str, status: str = "open") -> None:
    """Appends what a run is to show, or how that came out; the latest row of a name counts."""
    df = spark.createDataFrame([(name, hypothesis, status)], "name string, hypothesis string, status string").withColumn("at", F.current_timestamp())
    df.write.mode("append").parquet(path)
