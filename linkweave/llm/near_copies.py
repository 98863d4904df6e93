"""Op 9 at a given similarity: of texts whose shingle sets are alike one stays.

A radius that catches Jaccard similarities of 0.8 is some 20 bits of 64, where population counts skip
nothing and every tile would meet every other. So the texts that can meet come from MinHash bands, and
tiles are made of these: a text is the set of its shingles' XXH64 values, equal sets are one class, and
different sets share a bucket if all ROWS minima of one of BANDS bands agree. A pair at 0.8 shares none
with a probability of (1 - 0.8^6)^40, about 5 in a million.

First the sets that share a bucket go through op 9 itself: tiles by population counts, exclusive-or and bit
counts link SimHash fingerprints within its radius, links whose similarity is too low are dropped, and
linked sets leave but for the first of their component. Then every set of a bucket is tested against the
bucket's first one (by document id); rounds go on, over buckets whose first set left, until none is
linked. What is left and shares buckets is dealt into tiles of TILE sets by population counts, and tile pairs
within RADIUS are compared all against all: numpy exclusive-or and bit counts of SimHash fingerprints leave
pairs within RADIUS bits, whose similarity is then counted exactly. A tile pair reports a spanning forest.
So no two texts remain that share a band and are alike, and nothing makes all pairs of a group as rows.

Nulls: a null text has no words; all texts without words are one class. Repeated rows are one class.
A null id comes after all others. Empty input gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, text_of, written
from .encoding import forget
from .simhash import SEED, components
from .simhash import links as simhash_links

BANDS, ROWS = 40, 6
TILE, RADIUS = 256, 24
COLUMNS = 8192  # shingles compared at once
_FACTORS = np.random.RandomState(SEED).randint(0, 1 << 31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: str, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; shorter texts are one shingle."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = len(words) - shingle + 1
    whole = b" ".join(words)
    if n <= 1:
        return np.array([xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    return np.unique(np.fromiter((xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band; none for the empty set."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return np.zeros(0, np.int64)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), 1024):
        np.minimum(least, (_FACTORS[:, None] * high[None, at : at + 1024]).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.fromiter((xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)), np.uint64, BANDS).view(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text_of(text_col)).alias("h"), text_of(text_col).alias("t"))


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """i, h (the text's hash), s (the set's name), n (its size), keys (its bands) of every row."""
    from xxhash import xxh64_intdigest

    def run(batches):
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t.as_py(), shingle) for t in part.column(2)]
                names = np.array([xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                keys = pa.array([bands(x) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names), pa.array([len(x) for x in sets], pa.int32()), keys], ["i", "h", "s", "n", "keys"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "i long, h long, s long, n int, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """s, fp, x (the set's values) of the texts at wanted's places: sets are made again, so only texts move."""
    at = wanted.select("s", F.col("first.n").alias("n"), F.col("first.j").alias("j"), F.col("first.h").alias("h"))
    rows = _texts(docs, id_col, text_col).select(F.col("i").isNull().alias("n"), F.coalesce("i", F.lit(0)).alias("j"), "h", "t")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t.as_py(), shingle) for t in part.column(1)]
                fps = np.array([fingerprint(x) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["s", "fp", "x"])

    # rows that repeat id and text: one of them
    return rows.join(at, ["n", "j", "h"]).groupBy("s").agg(F.first("t").alias("t")).mapInArrow(run, "s long, fp long, x array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, over: int, under: int) -> DataFrame:
    """Those of pairs (u, v) whose sets' similarity is at the limit or over."""
    a = sets.select(F.col("s").alias("u"), F.col("x").alias("a"))
    b = sets.select(F.col("s").alias("v"), F.col("x").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").where(under * both >= over * (F.size("a") + F.size("b") - both)).select("u", "v")


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of a shares with each of b."""
    sets = [*a, *b]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    row, column = row[keep], np.cumsum(count > 1)[column[keep]] - 1
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        there = np.zeros((len(sets), COLUMNS), np.float32)
        there[row[lo:hi], column[lo:hi] - at] = 1
        out += there[: len(a)] @ there[len(a) :].T
    return out


def _tile(sets: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Names, fingerprints and values of a tile's sets."""
    rows = sets.values
    x = rows.field("x")
    ends = x.offsets.to_numpy()
    values = x.values.to_numpy()
    return rows.field("s").to_numpy(), rows.field("fp").to_numpy().view(np.uint64), [values[i:j] for i, j in zip(ends, ends[1:])]


def _tile_links(a: tuple, b: tuple, same: bool, over: int, under: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles' sets."""
    near = np.bitwise_count(a[1][:, None] ^ b[1][None, :]) <= RADIUS
    sizes = [np.array([len(x) for x in side[2]]) for side in (a, b)]
    near &= under * np.minimum(sizes[0][:, None], sizes[1][None, :]) >= over * np.maximum(sizes[0][:, None], sizes[1][None, :])
    if same:
        near &= np.tri(len(a[0]), k=-1, dtype=bool).T
    left, right = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(left):
        return []
    both = _shared([a[2][k] for k in left], [b[2][k] for k in right])
    total = sizes[0][left][:, None] + sizes[1][right][None, :]
    at = np.argwhere((under * both >= over * (total - both)) & near[np.ix_(left, right)])
    out, parent = [], {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in at.tolist():
        u, v = int(a[0][left[i]]), int(b[0][right[j]])
        if root(u) != root(v):
            parent[root(u)] = root(v)
            out.append((u, v))
    return out


def _tiled(keyed: DataFrame, sets: DataFrame, over: int, under: int) -> DataFrame:
    """u, v: links among all sets that buckets connect."""
    first = keyed.groupBy("key").agg(F.min("s").alias("v"))
    edges = keyed.join(first, "key").where("s != v").select(F.col("s").alias("u"), "v").distinct()
    groups = components(edges)
    sizes = groups.groupBy("label").agg(F.count("*").alias("n"))
    counted = groups.withColumnRenamed("node", "s").join(sizes, "label").join(sets.select("s", F.bit_count("fp").cast("int").alias("ones")), "s")
    # a component of one tile needs no cells
    cells = counted.select("s", "label", F.when(F.col("n") > TILE, F.col("ones")).otherwise(-1).alias("ones"))
    subs = written(cells.groupBy("label", "ones").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("subs")), "cells")
    dealt = cells.join(subs, ["label", "ones"]).select("s", "label", "ones", F.pmod(F.xxhash64("s"), "subs").cast("int").alias("sub"))
    tiles = dealt.join(sets, "s").groupBy("label", "ones", "sub").agg(F.collect_list(F.struct("s", "fp", "x")).alias("a"))  # about TILE sets
    tiles = written(tiles, "tiles")
    # names of the tile pairs first: sets travel only to pairs that are there
    names = subs.select("label", "ones", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    pairs = names.join(names.toDF("label", "ones2", "sub2"), "label").where(f"ones2 - ones <= {RADIUS} AND (ones < ones2 OR ones = ones2 AND sub <= sub2)")
    pairs = pairs.join(tiles, ["label", "ones", "sub"]).join(tiles.toDF("label", "ones2", "sub2", "b"), ["label", "ones2", "sub2"])
    pairs = pairs.select(((F.col("ones") == F.col("ones2")) & (F.col("sub") == F.col("sub2"))).alias("same"), "a", "b")

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                found = _tile_links(_tile(batch.column(1)[k]), _tile(batch.column(2)[k]), batch.column(0)[k].as_py(), over, under)
                if found:
                    u, v = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return pairs.mapInArrow(compare, "u long, v long")


def _near(sets: DataFrame) -> DataFrame:
    """u, v: sets that op 9 links. Of sets with equal fingerprints the first one stands for the others."""
    firsts = written(sets.groupBy("fp").agg(F.min("s").alias("first")), "distinct")
    name = lambda c: firsts.select(F.col("fp").alias(f"{c}_"), F.col("first").alias(c))
    found = simhash_links(firsts.select("fp"))
    found = found.toDF("u_", "v_").join(name("u"), "u_").join(name("v"), "v_").select("u", "v")
    equal = sets.join(firsts, "fp").where("s != first").select(F.col("s").alias("u"), F.col("first").alias("v"))
    return found.union(equal)


def survivors(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """n, j, h: the place of the one row that stays of every class."""
    over, under = similarity
    with scratch(docs.sparkSession):
        members = written(signatures(docs, id_col, text_col, shingle), "signatures")
        place = F.struct(F.col("i").isNull().alias("n"), F.coalesce("i", F.lit(0)).alias("j"), F.col("h"))
        firsts = written(members.groupBy("s").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys")), "firsts")
        keyed = firsts.select("s", "n", "first", F.explode("keys").alias("key"))
        shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
        keyed = written(keyed.join(shared, "key", "left_semi"), "bands")
        sets = written(_sets(docs, firsts.join(keyed.select("s").distinct(), "s", "left_semi"), id_col, text_col, shingle), "sets")
        gone = None

        def lost_of(linked: DataFrame) -> DataFrame:
            named = components(linked).join(firsts.select(F.col("s").alias("node"), "first"), "node")
            stay = named.groupBy("label").agg(F.min_by("node", "first").alias("stay"))
            return written(named.join(stay, "label").where("node != stay").select(F.col("node").alias("s")), "lost")

        linked = written(_alike(_near(sets), sets, over, under), "alike")
        if not linked.isEmpty():
            gone = lost_of(linked)
            keyed = written(keyed.join(gone, "s", "left_anti"), "bands")
        active = keyed
        while True:
            least = active.groupBy("key").agg(F.min(F.struct("first", "s", "n")).alias("v")).select("key", F.col("v.s").alias("v"), F.col("v.n").alias("m"))
            least = written(least, "least")
            pairs = active.withColumnRenamed("s", "u").join(least, "key").where("u != v")
            pairs = pairs.where(under * F.least("n", "m") >= over * F.greatest("n", "m")).select("u", "v").distinct()
            linked = written(_alike(pairs, sets, over, under), "alike")
            if linked.isEmpty():
                break
            lost = lost_of(linked)
            gone = lost if gone is None else gone.union(lost)
            # only buckets whose first set left have new pairs to test
            again = least.join(lost.withColumnRenamed("s", "v"), "v", "left_semi").select("key")
            active = written(active.join(again, "key", "left_semi").join(lost, "s", "left_anti"), "bands")
        left = keyed if gone is None else written(keyed.join(gone, "s", "left_anti"), "bands")
        linked = written(_tiled(left, sets, over, under), "alike")
        if not linked.isEmpty():
            lost = lost_of(linked)
            gone = lost if gone is None else gone.union(lost)
        kept = firsts.select("s", "first")
        if gone is not None:
            kept = kept.join(gone, "s", "left_anti")
        return written(kept.select("first.n", "first.j", "first.h"), "stays", keep=True)
