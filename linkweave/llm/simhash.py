"""Op 9: SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit where over half of its word shingles' XXH64 values have it. Distinct
fingerprints are dealt into tiles by the population counts of their four 16-bit quarters, or of their
eight bytes where there are over MANY of them (17^4 or 9^8 cells at most), large cells into several
tiles. Two fingerprints at d differing bits have counts that differ by d at most in sum, so only tile
pairs within the radius are compared, all against all, with numpy exclusive-or and bit counts. Parts
decide how many tile pairs are skipped, not what is found. A tile pair reports a spanning forest of
its links, never all pairs of a group, which keeps the components. Components come from min-label
rounds with pointer jumping over tables in the shared folder; nothing of the corpus comes to the driver.

`deduplicated` with a similarity asks for more than a radius can tell: see near_copies.

Nulls: a null text has no words, so fingerprint zero, linked like any other. A null id is no
component's name unless all its members' ids are null. Repeated rows are members each. Empty input gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, scratch, text_of, written

SEED = 42
RADIUS = 3
SHINGLE = 3
TILE = 2048
MANY = 8_000_000  # eight counts cost a few hundred keys a tile, four leave 5 % of all pairs


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    whole = b" ".join(words)
    if n <= 1:
        return xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    hashes = np.fromiter((xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """i, h (the text's hash), fp (as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["i", "h", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text_of(text_col)).alias("h"), text_of(text_col).alias("t"))
    return rows.mapInArrow(run, "i long, h long, fp long")


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """Links between a's and b's fingerprints: as they are if few, else every node's link to the
    smallest node of its component within the tile pair."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    if same:
        near &= np.tri(len(a), k=-1, dtype=bool).T
    left, right = np.nonzero(near)
    if len(left) <= len(a) + len(b):
        return list(zip(a[left].tolist(), b[right].tolist()))
    nodes = a if same else np.concatenate([a, b])
    right = right if same else right + len(a)
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return list(zip(nodes[label[out]].tolist(), nodes[out].tolist()))


def _steps(parts: int, radius: int):
    """Differences of counts that sum to the radius at most; of each and its opposite one."""

    def below(k: int, left: int):
        if not k:
            yield ()
            return
        for x in range(-left, left + 1):
            for rest in below(k - 1, left - abs(x)):
                yield (x, *rest)

    return (s for s in below(parts, radius) if s >= (0,) * parts)


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """u, v: links that connect every group of distinct fingerprints within the radius."""
    parts = parts or (4 if fps.count() <= MANY else 8)
    bits = 64 // parts
    counts = [F.lpad(F.bit_count(F.shiftrightunsigned("fp", bits * q).bitwiseAND(F.lit((1 << bits) - 1))), 2, "0") for q in range(parts)]
    cells = fps.select("fp", F.concat_ws("-", *counts).alias("cell"))
    sizes = written(cells.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("subs")), "cells")
    dealt = cells.join(sizes, "cell").withColumn("sub", F.pmod(F.xxhash64("fp"), "subs").cast("int"))
    tiles = written(dealt.groupBy("cell", "sub").agg(F.sort_array(F.collect_list("fp")).alias("fps")), "tiles")
    # names of the tile pairs first: arrays travel only to pairs that are there
    steps = list(_steps(parts, radius))
    at = F.transform(F.split("cell", "-"), lambda x: x.cast("int"))
    near = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in steps]))
    moved = sizes.select(F.col("cell").alias("c0"), F.col("subs").alias("subs0"), at.alias("c"), near.alias("step"))
    other = F.array_join(F.transform(F.zip_with("c", "step", lambda x, y: x + y), lambda x: F.lpad(x.cast("string"), 2, "0")), "-")
    cell_pairs = moved.select("c0", "subs0", other.alias("cell")).join(sizes, "cell")
    named = cell_pairs.select("c0", "cell", F.explode(F.sequence(F.lit(0), F.col("subs0") - 1)).alias("s0"), "subs")
    named = named.select("c0", "cell", "s0", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    named = named.where((F.col("c0") != F.col("cell")) | (F.col("s0") <= F.col("sub")))
    left = tiles.select(F.col("cell").alias("c0"), F.col("sub").alias("s0"), F.col("fps").alias("a"))
    right = tiles.select("cell", "sub", F.col("fps").alias("b"))
    pairs = named.join(left, ["c0", "s0"]).join(right, ["cell", "sub"])
    pairs = pairs.select("a", "b", ((F.col("c0") == F.col("cell")) & (F.col("s0") == F.col("sub"))).alias("same"))

    def compare(batches):
        for batch in batches:
            out = []
            a_col, b_col, same = batch.column(0), batch.column(1), batch.column(2)
            for k in range(batch.num_rows):
                a, b = (c[k].values.to_numpy() for c in (a_col, b_col))
                out += _forest(a, b, same[k].as_py(), radius)
            if out:
                u, v = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return pairs.mapInArrow(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: every linked node with the smallest node it reaches."""
    both = written(edges.union(edges.select("v", "u")).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), "labels")
    while True:
        reached = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        hooked = written(labels.join(reached, labels.node == reached.u).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), "labels")
        jump = hooked.select(F.col("node").alias("n"), F.col("label").alias("next"))
        new = written(hooked.join(jump, hooked.label == jump.n).select("node", F.least("label", "next").alias("label"), "old"), "labels")
        if new.where("label != old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Tables of the members (i, h, fp) and of the classes (fp, label, component_id)."""
    with scratch(docs.sparkSession):
        members = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints", keep=True)
        distinct = written(members.groupBy("fp").agg(F.min("i").alias("first")), "distinct")
        found = components(links(distinct.select("fp"), radius))
        named = distinct.join(found, distinct.fp == found.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
        smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
        return members, written(named.join(smallest, "label").select("fp", "label", "component_id"), "classes", keep=True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the component's smallest id) of every row."""
    members, known = classes(docs, id_col, text_col, shingle, radius)
    return members.join(known, "fp").select(F.col("i").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
                 similarity: tuple[int, int] | None = None) -> DataFrame:
    """docs with one row of each component: the one with the smallest id, then text hash. Columns as they were.

    similarity, as a fraction: groups are of texts whose shingle sets have that Jaccard similarity or more.
    """
    if similarity is not None:
        from .near_copies import survivors

        return only(docs, survivors(docs, id_col, text_col, shingle, similarity), id_col, text_col)
    members, known = classes(docs, id_col, text_col, shingle, radius)
    order = F.struct(F.col("i").isNull().alias("n"), F.coalesce("i", F.lit(0)).alias("j"), "h")
    stays = members.join(known, "fp").groupBy("label").agg(F.min(order).alias("s")).select("s.n", "s.j", "s.h")
    return only(docs, written(stays, "stays"), id_col, text_col)


def only(docs: DataFrame, stays: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs at the places stays (null id or not, id, text hash), one for each. Columns as they were."""
    n, j, h, r = (f"lw_{x}" for x in "njhr")
    plain, (i, t) = numbered(docs, id_col, text_col)
    keyed = plain.withColumns({n: F.col(i).isNull(), j: F.coalesce(F.col(i).cast("long"), F.lit(0)), h: F.xxhash64(text_of(t))})
    kept = keyed.join(stays.toDF(n, j, h), [n, j, h], "left_semi")
    # rows that repeat id and text: one of them
    return kept.withColumn(r, F.row_number().over(Window.partitionBy(n, j, h).orderBy(n))).where(F.col(r) == 1).select(*plain.columns).toDF(*docs.columns)
