"""Tab-separated sources under a strict schema: fields are never quoted, empty means missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
TRUTH_COLUMNS = ["source1_entity_id", "matched_entity_ids"]


class SourceError(ValueError):
    """A source breaks its contract."""


def _first_line(spark: SparkSession, path: str) -> str | None:
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(hadoop).exists(p):
        raise SourceError(f"missing file: {path}")
    head = spark.read.text(path).limit(1).collect()
    return head[0][0] if head else None


def check_header(spark: SparkSession, path: str, columns: list[str] = SOURCE_COLUMNS) -> None:
    """Raises where the first line isn't exactly the columns, tab-separated, in order."""
    line = _first_line(spark, path)
    if line is None or not line.strip():
        raise SourceError(f"empty file: {path}")
    if "\t" not in line:
        raise SourceError(f"{'comma-separated' if ',' in line else 'single-column'} header: {path}")
    if line.rstrip("\r\n").split("\t") != columns:
        raise SourceError(f"header mismatch: {path} has {line!r}")


def _scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.csv(path, schema=schema, sep="\t", header=True, quote="", escape="")
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def read_source(spark: SparkSession, path: str, prefix: str | None = None, n_rows: int | None = None, unique: bool = True) -> DataFrame:
    """The records of a source; raises on blank ids, repeated ids (unless not unique) and wrong prefixes."""
    check_header(spark, path)
    rows = _scan(spark, path, SOURCE_COLUMNS)
    if n_rows is not None:
        rows = rows.limit(n_rows)
    _refuse(rows, "entity_id", prefix, unique)
    return rows


def _refuse(rows: DataFrame, id_col: str, prefix: str | None, unique: bool) -> None:
    found = rows.agg(F.sum((F.trim(id_col) == "").cast("long")).alias("blank"), *([F.sum((~F.col(id_col).startswith(prefix)).cast("long")).alias("prefix")] if prefix else [])).first()
    if found["blank"]:
        raise SourceError(f"{found['blank']} blank ids")
    if prefix and found["prefix"]:
        raise SourceError(f"{found['prefix']} ids without prefix {prefix}")
    if unique:
        n = rows.groupBy(id_col).count().where("count > 1").agg(F.sum("count")).first()[0]
        if n:
            raise SourceError(f"{n} rows share a duplicate id")


def stream_source(spark: SparkSession, folder: str, files_at_once: int = 1, prefix: str | None = None) -> DataFrame:
    """The records of all files of a folder as a stream, some files a chunk. A blank id, or one without
    the prefix, fails its chunk; uniqueness is no matter of one chunk and isn't checked."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in SOURCE_COLUMNS])
    rows = spark.readStream.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("maxFilesPerTrigger", files_at_once).csv(folder)
    rows = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in SOURCE_COLUMNS])
    found = F.trim(F.col(SOURCE_COLUMNS[0]))
    bad = F.when(found == "", "blank id").when(~found.startswith(prefix) if prefix else F.lit(False), F.concat(F.lit("id without its prefix: "), found))
    return rows.where(F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(True))


def parsed_matches(matches: Column, strict: bool = True) -> Column:
    """A comma list as an array; strict: fails on empty, foreign and repeated entries."""
    text = F.trim(F.coalesce(matches, F.lit("")))
    items = F.transform(F.split(text, ","), lambda x: F.trim(x))
    if strict:
        bad = (
            F.when(F.exists(items, lambda x: x == ""), "empty entry")
            .when(F.exists(items, lambda x: x.startswith("S1-")), "entry of the first source")
            .when(F.exists(items, lambda x: ~(x.startswith("S2-") | x.startswith("S3-"))), "entry of an unknown source")
            .when(F.size(F.array_distinct(items)) < F.size(items), "repeated entry")
        )
        items = F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.lit(" in "), text)).cast("array<string>")).otherwise(items)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(items)


def read_truth(spark: SparkSession, path: str, strict: bool = True, max_rows: int | None = None) -> DataFrame:
    """s1_id, matches (array). strict=False takes rows as they are, with missing or extra fields."""
    if strict:
        check_header(spark, path, TRUTH_COLUMNS)
    rows = _scan(spark, path, TRUTH_COLUMNS)
    if max_rows is not None:
        rows = rows.limit(max_rows)
    if strict:
        _refuse(rows, "source1_entity_id", "S1-", True)
    return rows.select(F.col("source1_entity_id").alias("s1_id"), parsed_matches(F.col("matched_entity_ids"), strict).alias("matches"))


def links_of(truth: DataFrame) -> DataFrame:
    return truth.select("s1_id", F.explode("matches").alias("target_id"))


def spine_of(truth: DataFrame) -> DataFrame:
    return truth.select("s1_id").distinct()


def resolve_folder(candidates: list[str], override: str | None = None, spark: SparkSession | None = None) -> str:
    """The override, or the first folder that exists."""
    import os

    for path in [override] if override else candidates:
        if spark is not None:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        else:
            found = os.path.isdir(path)
        if found:
            return path
    raise SourceError(f"none of these folders exists: {override or candidates}")
