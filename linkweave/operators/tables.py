"""Intermediate tables in the folder all executors share, and sums and cut-offs without one big task."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
RANGES = 256
FEW = 10_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the session names one. Where it doesn't, one machine (tests, bench)
    gets a temporary folder; a cluster gets an error."""
    found = spark.conf.get(_SETTING, None) or getattr(spark, "_linkweave_tables", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        found = spark._linkweave_tables = "file://" + tempfile.mkdtemp(prefix="linkweave-")
        atexit.register(_drop, spark, found)
    return found.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder's owner cleans it
        pass


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table, worked out once however often it is read; removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parted(df: DataFrame, label: str, by: str) -> str:
    """df as Parquet files under <folder>/<by>=<value>/ for rows_of; the folder. by: a column of numbers."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_drop, df.sparkSession, path)
    df.write.partitionBy(by).parquet(path)
    return path


def rows_of(folder: str, by: str, value: int):
    """Within a task: the rows of one part of a parted table, one at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    if folder.startswith("file:"):
        files, path = fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    elif "://" in folder:
        files, path = fs.FileSystem.from_uri(folder)
    else:
        files, path = fs.LocalFileSystem(), folder
    found = files.get_file_info(fs.FileSelector(f"{path}/{by}={value}", allow_not_found=True))
    for name in sorted(f.path for f in found if f.path.endswith(".parquet")):
        with files.open_input_file(name) as file:
            for batch in pq.ParquetFile(file).iter_batches(1):
                yield from batch.to_pylist()


def ranges(df: DataFrame, value: str) -> Column:
    """The number of the range a row's value falls into: RANGES at most, equal values together, about
    as many rows each. Its cut-offs alone come to the driver."""
    cuts = df.agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 10_000)).first()[0] or []
    return F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: c < F.col(value)))


def running_down(df: DataFrame, value: str, sums: list[str]) -> DataFrame:
    """df (one row a value) with, of each column of sums, its total over rows of this value or more as
    run_<column> and over all rows as all_<column>. Sums go range by range, so no task sorts all rows."""
    rows = df.withColumn("range_", ranges(df, value))
    per = rows.groupBy("range_").agg(*[F.sum(c).alias(f"per_{c}") for c in sums])
    above = Window.orderBy(F.desc("range_")).rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    per = per.select("range_", *[F.coalesce(F.sum(f"per_{c}").over(above), F.lit(0)).alias(f"up_{c}") for c in sums], *[F.sum(f"per_{c}").over(Window.partitionBy()).alias(f"all_{c}") for c in sums])
    down = Window.partitionBy("range_").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(per, "range_").select(*df.columns, "range_", *[f"up_{c}" for c in sums], *[f"all_{c}" for c in sums])
    return rows.select(*df.columns, *[(F.col(f"up_{c}") + F.sum(c).over(down)).alias(f"run_{c}") for c in sums], *[f"all_{c}" for c in sums])


def cut_off(df: DataFrame, key: str, n: int) -> str | None:
    """The n-th smallest value of a string column, null where there are fewer. Counts by the next two
    characters narrow a prefix until few rows are left under it, so no task orders a large part."""
    prefix, left = "", n
    while True:
        rows = df.where(F.col(key).startswith(prefix)) if prefix else df
        step = F.substring(key, len(prefix) + 1, 2)
        counts = sorted((r.c, r.n) for r in rows.groupBy(step.alias("c")).agg(F.count("*").alias("n")).collect())
        for c, k in counts:
            if k >= left:
                break
            left -= k
        else:
            return None
        if k <= FEW or len(c) < 2:
            tail = rows.where(step == c).select(key).orderBy(key).limit(left)
            return tail.agg(F.max(key)).first()[0]
        prefix += c
