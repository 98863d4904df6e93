"""Retrieval over a stream of targets: query keys stay, targets pass by once.

Each micro-batch joins its targets' keys with the static query keys and appends the pairs. A running
top-k merges each batch with the last table into a table of its own number, so a batch that runs again
writes the same table again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking, tfidf
from ..operators.records import enrich


def stream_pairs(queries: DataFrame, targets: DataFrame, blocks: list[blocking.Block]) -> DataFrame:
    """block, s1_id, target_id of a streaming targets DataFrame; caps don't apply to streams."""
    q = blocking.keys(enrich(queries), blocks, "query").withColumnRenamed("entity_id", "s1_id")
    t = blocking.keys(enrich(targets), blocks, "target").withColumnRenamed("entity_id", "target_id")
    return t.join(q, ["block", "key"]).select("block", "s1_id", "target_id")


def run_once(pairs: DataFrame, path: str, checkpoint: str) -> None:
    """Takes what is there into a Parquet sink, exactly once."""
    pairs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _versions(spark: SparkSession, path: str) -> list[int]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(p):
        return []
    done = lambda s: files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    return sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(p) if s.getPath().getName().startswith("version=") and done(s))


def best_so_far(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """s1_id, target_id, score, rank after the last batch (or the last one before a number)."""
    known = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/version={known[-1]}") if known else None


def running_top_k(scored: DataFrame, path: str, checkpoint: str, k: int) -> None:
    """Takes what is there of a stream of s1_id, target_id, score into the k best targets of each query."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select("s1_id", "target_id", "score")
        old = best_so_far(batch.sparkSession, path, number)
        if old is not None:
            rows = rows.unionByName(old.select("s1_id", "target_id", "score"))
        best = rows.groupBy("s1_id", "target_id").agg(F.max("score").alias("score"))
        tfidf.ranked(best, k).write.mode("overwrite").parquet(f"{path}/version={number}")

    scored.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
