"""Op 1: content-defined line chunks, repeated ones removed. DataFrame functions only.

A rolling hash over the hashes of WINDOW lines ends a chunk after about every DIVISOR-th line, so
boundaries follow content and survive shifts. Chunks of two non-blank lines or more take part. Their
texts are grouped by value (equal bytes) under their MD5; a hash that stands for one text only, found
more than once, names a repeat. The first occurrence by (document id, text hash, chunk number) stays,
every other is cut out with its line feeds. Only hashes and places are joined, never texts.

Nulls: a null text stays null and has no chunks; a null id sorts before all others. Rows with equal
id and text are one document and all keep or lose the same chunks. Other columns pass through
`deduplicated` unchanged. Empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

WINDOW = 2
FACTOR, MODULUS, DIVISOR = 65599, 4294967291, 3
NO_ID = -(1 << 63)


def _chunks(rows: DataFrame, t: str, keep: list[str]) -> DataFrame:
    """rows with an array of chunks: c (number), text, lines, ok (takes part)."""
    lines, marks, ends = "lw_lines", "lw_marks", "lw_ends"
    rows = rows.select(*keep, F.split(F.coalesce(F.col(t), F.lit("")), "\n", -1).alias(lines))
    rows = rows.select(*keep, lines, F.expr(f"transform({lines}, l -> cast(conv(substr(md5(l), 1, 8), 16, 10) AS BIGINT))").alias(marks))
    rolling = " + ".join(f"coalesce(get({marks}, j - {k}), 0L) * {FACTOR ** k}L" for k in range(WINDOW))
    cut = f"j = size({marks}) - 1 OR pmod({rolling}, {MODULUS}L) % {DIVISOR} = 0"
    rows = rows.select(*keep, lines, F.expr(f"filter(sequence(0, size({marks}) - 1), j -> {cut})").alias(ends))
    start = f"coalesce(get({ends}, k - 1) + 1, 0)"
    part = f"slice({lines}, {start} + 1, e - {start} + 1)"
    chunk = f"""transform({ends}, (e, k) -> named_struct('c', k, 'lines', e - {start} + 1, 'text', array_join({part}, '\\n'),
        'ok', size(filter({part}, l -> l RLIKE '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]')) >= 2))"""
    return rows.select(*keep, F.expr(chunk).alias("lw_chunks"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("i"), F.xxhash64(text).alias("h"), text.alias("t"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """i, h, cut: the chunk numbers to cut out of each document that loses some."""
    chunks = _chunks(_keyed(docs, id_col, text_col), "t", ["i", "h"])
    ours = F.expr("filter(lw_chunks, x -> x.ok)")
    # equal bytes: grouped by the text itself
    texts = chunks.select(F.explode(F.transform(ours, lambda x: x["text"])).alias("text"))
    texts = texts.groupBy(F.md5("text").alias("k"), "text").agg(F.count("*").alias("n"))
    named = texts.groupBy("k").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).where("texts = 1 AND n > 1").select("k")
    places = chunks.select("i", "h", F.explode(F.transform(ours, lambda x: F.struct(x["c"].alias("c"), F.md5(x["text"]).alias("k")))).alias("x")).select("i", "h", "x.c", "x.k")
    named = written(named, "repeats")
    found = written(places.join(named, "k", "left_semi"), "places")  # places of repeated chunks only
    first = written(found.groupBy("k").agg(F.min(F.struct("i", "h", "c")).alias("first")), "first")
    again = found.join(first, "k").where(F.struct("i", "h", "c") != F.col("first"))
    return again.groupBy("i", "h").agg(F.collect_set("c").alias("cut"))


def _applied(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs with the chunk numbers to cut, null where nothing is; that column's name."""
    i, h, cut = "lw_i", "lw_h", "lw_cut"
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({i: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), h: F.xxhash64(text)})
    lost = repeats(docs, id_col, text_col).toDF(i, h, cut)
    return rows.join(lost, [i, h], "left"), cut


def _kept_text(chunks: str, cut: str) -> str:
    left = f"array_except(sequence(0, size({chunks}) - 1), {cut})"
    return f"array_join(transform({left}, c -> {chunks}[c].text), '\\n')"


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated chunks cut out of the texts; columns as they were."""
    plain, (i, t) = numbered(docs, id_col, text_col)
    rows, cut = _applied(plain, i, t)
    rows = _chunks(rows, t, [*plain.columns, cut])
    text = F.when(F.col(cut).isNull(), F.col(t)).otherwise(F.expr(_kept_text("lw_chunks", cut)))
    return rows.select(*[text.alias(c) if c == t else F.col(c) for c in plain.columns]).toDF(*docs.columns)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (deduplicated), n_chunks, n_cut_chunks, n_cut_lines of every row."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, cut = _applied(plain, "doc_id", "text")
    rows = _chunks(rows, "text", ["doc_id", "text", cut])
    lines = F.expr(f"aggregate({cut}, 0L, (a, c) -> a + lw_chunks[c].lines)")
    return rows.select(
        "doc_id",
        F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.expr(_kept_text("lw_chunks", cut))).alias("text"),
        F.size("lw_chunks").cast("long").alias("n_chunks"),
        F.when(F.col(cut).isNull(), F.lit(0)).otherwise(F.size(cut)).cast("long").alias("n_cut_chunks"),
        F.coalesce(lines, F.lit(0)).cast("long").alias("n_cut_lines"),
    )
