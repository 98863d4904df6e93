"""Shared helpers: table access, the shared work folder, files that executors write."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the session names one. Where it
    doesn't, one machine (tests) gets a temporary folder; a cluster gets an error."""
    found = spark.conf.get(_SETTING, None) or getattr(spark, "_linkweave_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        found = spark._linkweave_dir = "file://" + tempfile.mkdtemp(prefix="linkweave-")
        atexit.register(_drop, spark, found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables written within are dropped at the end, but for those written with keep."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _drop(spark, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder's owner cleans it
        pass


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors. keep: it
    outlives the scratch scope around it, to the next one out or the driver's end."""
    path = new_folder(df.sparkSession, label)
    scopes = _SCOPES[:-1] if keep else _SCOPES
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of df's size, from its files' sizes; 0 where it knows none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def text_of(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI in the shared folder."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, write) -> None:
    """write(stream) to a private name, then rename: attempts that die leave nothing under uri,
    and a second attempt replaces the first one's file by equal bytes."""
    files, path = filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        write(out)
    files.move(part, path)


def numbered(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns called c0, c1, ..., and what the named ones are called there: within an
    operator no column of the input can then clash with its own. toDF(*docs.columns) undoes it."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]), [f"c{docs.columns.index(n)}" for n in names]


def free_name(columns: list[str], name: str) -> str:
    """name, or name with underscores where columns has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
