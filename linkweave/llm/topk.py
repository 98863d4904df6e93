"""Op 10: exact top-k inner products by distributed histogram selection.

Rows are packed into blocks where they lie, queries into blocks of QUERY_BLOCK. Row blocks are dealt
into stripes of about STRIPE blocks; each (query block, stripe) is a cell of a grid and a task's work,
so tasks grow with rows and with queries, and either side travels once a cell. Each pass scores every
cell and counts scores into BINS bins of each query's current range; summed over all cells the counts
show the bin with the k-th score, which is the next range, until bins are one wide. A last pass keeps
scores over the k-th value and, of those equal to it, the smallest ids, k a query and task at most. A
task reports bins from the top only until they hold as many rows as are still sought.

Components are floor(64 * x), kept in the smallest integer type a block needs; products are computed
in the narrowest floating type that is exact for the blocks' norms. Rows whose id or vector is null, or
whose vector holds a null or non-finite component, take no part; shorter vectors count as padded with
zeros; rows with the query's own id are left out; equal rows each count. Empty tables give no rows.
Scores must fit 2^62.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BINS = 256
ROW_BLOCK = 4096
QUERY_BLOCK = 1024
STRIPE = 4
STRIP = 512  # rows scored at once
MOST_CELLS = 20_000  # partitions; more cells share them
HELD = 200_000  # found pairs a task holds before it drops what can't be among the best
_LOW = -(1 << 62)


def quantized(df: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """i, v: ids and integer vectors of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v")).where("i IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(math.inf)))
    return rows.where(finite).select("i", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def blocks(rows: DataFrame, size: int, dim: int, label: str) -> DataFrame:
    """Blocks of size rows at most, as the rows lie: part, ids (ascending), the matrix, its type and largest norm."""

    def pack(batches):
        from pyspark import TaskContext

        def block(ids, matrix):
            order = np.argsort(ids, kind="stable")
            ids, matrix = ids[order], matrix[order]
            top = float(np.sqrt((matrix.astype(float) ** 2).sum(axis=1)).max())
            low, high = int(matrix.min(initial=0)), int(matrix.max(initial=0))
            kind = next(k for k in ("i1", "i2", "i4", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
            return pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "matrix": pa.array([matrix.astype(kind).tobytes()], pa.binary()), "kind": [kind], "norm": [top]})

        held, n = [], 0
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(column.offsets.to_numpy())
            full = np.zeros((batch.num_rows, dim), np.int64)
            full[np.arange(dim)[None, :] < sizes[:, None]] = flat
            held.append((batch.column(0).to_numpy(), full))
            n += batch.num_rows
            if n >= size:
                ids, matrix = (np.concatenate(x) for x in zip(*held))
                for at in range(0, n - size + 1, size):
                    yield block(ids[at : at + size], matrix[at : at + size])
                held, n = [(ids[n - n % size :], matrix[n - n % size :])], n % size
        if n:
            yield block(*(np.concatenate(x) for x in zip(*held)))

    return written(rows.mapInArrow(pack, "part int, ids binary, matrix binary, kind string, norm double"), label)


def _scores(row: dict, dim: int):
    """(query ids, row ids, score matrix) in strips of rows; a query's own id gets _LOW."""
    q_ids, r_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    reach = row["q_norm"] * row["norm"]  # no partial sum is larger
    kind = np.float32 if reach < 2.0**23 else np.float64 if reach < 2.0**52 else np.int64
    q = np.frombuffer(row["q_matrix"], row["q_kind"]).reshape(-1, dim).astype(kind)
    r = np.frombuffer(row["matrix"], row["kind"]).reshape(-1, dim).astype(kind)
    for at in range(0, len(r_ids), STRIP):
        ids = r_ids[at : at + STRIP]
        s = (q @ r[at : at + STRIP].T).astype(np.int64)
        first, last = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
        for k in np.flatnonzero(last > first).tolist():
            s[k, first[k] : last[k]] = _LOW
        yield q_ids, ids, s


def _rows(batches):
    for batch in batches:
        yield from (dict(zip(batch.schema.names, (c[k].as_py() for c in batch.columns))) for k in range(batch.num_rows))


def _seen(counts: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The lowest bin of each query that can still hold one of the rows it needs; 0 where too few are known."""
    upto = counts[:, ::-1].cumsum(axis=1)
    enough = upto >= need[:, None]
    return np.where(enough.any(axis=1), counts.shape[1] - 1 - enough.argmax(axis=1), 0)


def _best(found: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query number, row id, score) the k best of each query."""
    qi, ids, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, -score, qi))
    qi, ids, score = qi[order], ids[order], score[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi, "left")
    return qi[rank < k], ids[rank < k], score[rank < k]


def top_k(df: DataFrame, k: int = 20, query_filter=lambda i: i % 20 == 0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    rows = quantized(df, id_col, vec_col)
    schema = "query_id long, rank int, vec_id long, score long"
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return df.sparkSession.createDataFrame([], schema)
    data = blocks(rows, ROW_BLOCK, dim, "rows")
    asked = rows.where(query_filter(F.col("i")))
    n_queries = max(1, -(-asked.count() // QUERY_BLOCK))
    queries = blocks(asked.repartition(n_queries), 1 << 30, dim, "queries")  # one block a partition
    queries = queries.select(F.col("part").alias("qb"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("kind").alias("q_kind"), F.col("norm").alias("q_norm"))
    n_blocks, top = data.agg(F.count("*"), F.max("norm")).first()
    reach = math.ceil((top or 0.0) * (queries.agg(F.max("q_norm")).first()[0] or 0.0)) + 1
    if reach >= 1 << 62:
        raise OverflowError("scores exceed 2^62")
    width = 1
    while width * BINS < 2 * reach + 1:
        width *= 2
    stripes = max(1, -(-n_blocks // STRIPE))
    cells = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n_queries * stripes, MOST_CELLS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = data.drop("part").withColumn("stripe", F.pmod(F.xxhash64("ids"), F.lit(stripes)).cast("int")).withColumn("qb", each(n_queries)).repartition(cells, "qb", "stripe")

    def with_state(state):
        """queries with lo (start of the current range) and above (rows over it) of each."""
        if state is None:
            return queries.withColumn("lo", F.lit(None).cast("binary")).withColumn("above", F.lit(None).cast("binary"))
        return queries.join(state, "qb")

    def scored(state, what, kind):
        side = with_state(state).withColumn("stripe", each(stripes)).repartition(cells, "qb", "stripe")
        return grid.join(side, ["qb", "stripe"]).mapInArrow(what, kind)

    def state_of(row):
        n = len(row["q_ids"]) // 8
        if row["lo"] is None:
            return np.full(n, -reach, np.int64), np.zeros(n, np.int64)
        return np.frombuffer(row["lo"], np.int64), np.frombuffer(row["above"], np.int64)

    def refine(state, span, width):
        """The next range of each query: width wide, within the current one, span wide."""
        shift = width.bit_length() - 1

        def count(batches):
            sums, need, low, strips = {}, {}, {}, {}
            for row in _rows(batches):
                lo, above = state_of(row)
                n, qb = len(lo), row["qb"]
                need[qb] = k - above
                held = sums.setdefault(qb, np.zeros((n, BINS), np.int64))
                least = low.setdefault(qb, np.zeros(n, np.int64))
                for _, _, s in _scores(row, dim):
                    # bins under least can't be reported any more
                    qi, ri = np.nonzero((s >= (lo + least * width)[:, None]) & (s < (lo + span)[:, None]))
                    bins = (s[qi, ri] - lo[qi]) >> shift
                    held += np.bincount(qi * BINS + bins, minlength=n * BINS).reshape(n, BINS)
                    strips[qb] = strips.get(qb, 0) + 1
                    if strips[qb] & (strips[qb] - 1) == 0:
                        least[:] = _seen(held, need[qb])
            for qb, held in sums.items():
                over = held[:, ::-1].cumsum(axis=1)[:, ::-1] - held  # in higher bins, here alone
                qi, bins = np.nonzero((held > 0) & (over < need[qb][:, None]))
                for at in range(0, len(qi), 65536):
                    a, b = qi[at : at + 65536], bins[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), qb), pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(held[a, b], pa.int64())], ["qb", "qi", "bin", "n"])

        def choose(key, found, side):
            if not side.num_rows:
                return pa.Table.from_pydict({"qb": [], "lo": [], "above": []}, schema=chosen)
            row = {c: side[c][0].as_py() for c in side.column_names}
            lo, above = (x.copy() for x in state_of(row))
            counts = np.zeros((len(lo), BINS), np.int64)
            counts[found["qi"].to_numpy(), found["bin"].to_numpy()] = found["n"].to_numpy()
            over = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
            hit = (counts > 0) & (over < (k - above)[:, None])
            at = np.where(hit.any(axis=1), hit.argmax(axis=1), 0)  # the lowest bin still sought
            above += np.take_along_axis(over, at[:, None], 1)[:, 0]
            lo += at * width
            return pa.Table.from_pydict({"qb": [row["b"]], "lo": [lo.tobytes()], "above": [above.tobytes()]}, schema=chosen)

        chosen = pa.schema([("qb", pa.int32()), ("lo", pa.binary()), ("above", pa.binary())])
        found = scored(state, count, "qb int, qi int, bin int, n long").groupBy("qb", "qi", "bin").agg(F.sum("n").alias("n"))
        side = with_state(state).select(F.col("qb").alias("b"), "q_ids", "lo", "above")
        return written(found.groupBy("qb").cogroup(side.groupBy("b")).applyInArrow(choose, "qb int, lo binary, above binary"), "kth")

    state, span = None, width * BINS
    while span > 1:
        state, span = refine(state, span, width), width
        width = max(1, width // BINS)

    def keep(batches):
        held, sizes = {}, {}
        for row in _rows(batches):
            lo, _ = state_of(row)
            qb = row["qb"]
            for q_ids, ids, s in _scores(row, dim):
                qi, ri = np.nonzero(s >= lo[:, None])
                if len(qi):
                    held.setdefault(qb, [q_ids, []])[1].append((qi, ids[ri], s[qi, ri]))
                    sizes[qb] = sizes.get(qb, 0) + len(qi)
                    if sizes[qb] > HELD:
                        held[qb][1] = [_best(held[qb][1], k)]
                        sizes[qb] = len(held[qb][1][0][0]) // 2  # makes room before the next time
        for qb, (q_ids, found) in held.items():
            qi, ids, score = _best(found, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(qi), qb), pa.int32()), pa.array(qi, pa.int32()), pa.array(q_ids[qi]), pa.array(ids), pa.array(score)], ["qb", "qi", "query_id", "vec_id", "score"])

    kept = scored(state, keep, "qb int, qi int, query_id long, vec_id long, score long")
    order = Window.partitionBy("qb", "qi").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
