"""Op 6: mixture-controlled packing by deficit round-robin over source queues.

Documents are encoded once into a table in the shared folder. A source's queue is its documents in the
table's order; sums over the tasks that wrote the table give every document's place in it. Blocks of
about BLOCK_TOKENS ids take from each queue exactly the target share, so a document may be cut at a
block's edge, and fill their windows by themselves: each window visits the sources in turn, adds a
quantum of target share x window to the source's deficit and takes that many ids from its queue; what
a visit can't use is carried on. A block starts with the rounding deficit that all blocks before it
leave behind, known from the shares alone. Pieces under MIN_PIECE wait for a later window.

Without given proportions the target is the corpus's own mixture, which lasts to the end. With them,
mixed blocks go on until the first queue runs dry; what other queues still hold, and sources without a
share, follow in rest blocks (their numbers come after the mixed ones) in the mixture of what is left.

All ids are placed: what is left of a block under one window becomes sequences of powers of two,
without padding. Nulls: a null text is empty (its end id remains), a null source is a source of its
own, a null id stays null. Repeated rows are packed each. Empty input gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written
from .encoding import byte_encoder, with_ends

WINDOW = 2048
MIN_PIECE = 128
BURST = 2.0
BLOCK_TOKENS = 4_000_000
UNIT = 1 << 16  # ids a block are kept as so many parts of one
MOST_PARTITIONS = 50_000  # a task packs its blocks one after another
PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
            source_col: str = "source") -> DataFrame:
    """i, s, n, ids of every document, part (the task that encoded it) and before (ids of the source
    before it in that task); ids in 2 bytes each where the vocabulary allows, else 4."""

    def encode(batches):
        from pyspark import TaskContext

        encoder = byte_encoder(vocabulary)
        kind = "<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids, ends = with_ends(*encoder.batch(part.column(2)), end_id, kind)
                n, before = np.diff(ends, prepend=0).tolist(), []
                for s, k in zip(part.column(1).to_pylist(), n):
                    before.append(seen.get(s, 0))
                    seen[s] = before[-1] + k
                places = pa.array(np.concatenate([[0], ends]) * ids.itemsize, pa.int32())
                flat = pa.Array.from_buffers(pa.binary(), len(n), [None, places.buffers()[1], pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array([task] * len(n), pa.int32()), pa.array(before, pa.int64()), flat, pa.array([ids.itemsize] * len(n), pa.int32())], ["i", "s", "n", "part", "before", "ids", "width"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(source_col).cast("string").alias("s"), text_of(text_col).alias("t"))
    return rows.mapInArrow(encode, "i long, s string, n long, part int, before long, ids binary, width int")


def tail_sizes(left: int) -> list[int]:
    """A rest under one window as powers of two, largest first."""
    return [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def drr(queues: dict, share: dict, deficit: dict, window: int = WINDOW, min_piece: int = MIN_PIECE):
    """Yields (sequence, offset, source, take): how many ids each visit takes from a source's queue.

    queues: source -> ids in its queue; share: source -> target share; deficit: what it starts with.
    """
    left = dict(queues)
    ring = [s for s in sorted(left, key=lambda s: (s is None, s)) if left[s]]
    owed, total, sequence, turn = dict(deficit), sum(left.values()), 0, 0
    sizes = []
    while total:
        if total >= window:
            size = window
        else:
            sizes = sizes or tail_sizes(total)
            size = sizes.pop(0)
        at, turn = 0, turn % len(ring)
        for s in ring[turn:] + ring[:turn]:
            quantum = share[s] * size
            owed[s] += quantum
            take = min(int(owed[s]), int(BURST * quantum) + min_piece, left[s], size - at)
            if take <= 0 or take < min_piece and take < min(left[s], size - at):
                continue
            yield sequence, at, s, take
            owed[s] -= take
            left[s] -= take
            at += take
        while at < size:
            s = max((x for x in ring if left[x]), key=lambda x: owed[x])
            take = min(left[s], size - at)
            yield sequence, at, s, take
            owed[s] -= take
            left[s] -= take
            at += take
        total -= size
        ring = [s for s in ring if left[s]]
        sequence, turn = sequence + 1, turn + 1


def _pack(key, docs):
    block = key[0].as_py()
    docs = docs.sort_by([("s", "ascending"), ("at", "ascending")])
    ids_of, n_of, i_of = docs["ids"].combine_chunks(), docs["m"].to_pylist(), docs["i"].to_pylist()
    from_of, whole_of = docs["cut"].to_pylist(), docs["n"].to_pylist()
    width = docs["width"][0].as_py()
    queue: dict = {}
    for row, s in enumerate(docs["s"].to_pylist()):
        queue.setdefault(s, []).append(row)
    share = {s: docs["share"][rows[0]].as_py() for s, rows in queue.items()}
    owed = {s: docs["owed"][rows[0]].as_py() for s, rows in queue.items()}
    place = {s: [0, 0] for s in queue}  # row in the queue, ids of it taken
    out: list[list] = [[] for _ in range(8)]
    for sequence, at, s, take in drr({s: sum(n_of[r] for r in rows) for s, rows in queue.items()}, share, owed):
        here, rows = place[s], queue[s]
        while take:
            row = rows[here[0]]
            piece = min(take, n_of[row] - here[1])
            raw = np.frombuffer(ids_of[row].as_buffer(), f"<u{width}")[here[1] : here[1] + piece].astype("<u4").tobytes()
            for column, value in zip(out, (i_of[row], s, from_of[row] + here[1], piece, zlib.crc32(raw), whole_of[row], (block << 32) + sequence, at)):
                column.append(value)
            at, take, here[1] = at + piece, take - piece, here[1] + piece
            if here[1] == n_of[row]:
                here[0], here[1] = here[0] + 1, 0
    kinds = [pa.int64(), pa.string()] + [pa.int64()] * 6
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def queues(ids: DataFrame, proportions: dict[str, float] | None, block_tokens: int) -> tuple[DataFrame, int]:
    """A row for each source in each task: where its ids start in the source's queue, and the source's
    share, ids in mixed blocks and ids a block (in 1 / UNIT) of mixed and of rest blocks; and the
    number of all blocks. Sources and tasks bound its size; totals alone come to the driver."""
    parts = ids.groupBy("s", "part").agg(F.sum("n").alias("k"))
    order = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("s", "part", F.coalesce(F.sum("k").over(order), F.lit(0)).alias("base"), "k")
    sources = parts.groupBy("s").agg(F.sum("k").alias("all"))
    if proportions is None:
        want = F.col("all").cast("double")
    else:
        named = [F.lit(x) for k, v in proportions.items() for x in (k, float(v))]
        want = F.coalesce(F.create_map(*named)[F.coalesce("s", F.lit(""))], F.lit(0.0))
    sources = written(sources.select("s", "all", want.alias("want")), "sources")
    total, whole, mixed = sources.agg(F.sum("all"), F.sum("want"), F.min(F.when(F.col("want") > 0, F.col("all") / F.col("want")))).first()
    mixed = int((mixed or 0.0) * (whole or 0.0)) if proportions else total or 0  # ids until a queue is dry
    blocks, share = max(1, round(mixed / block_tokens)), F.col("want") / F.lit(whole or 1.0)
    in_mix = F.col("all") if proportions is None else F.least(F.col("all"), F.floor(share * mixed))
    sources = sources.select("s", "all", share.alias("share"), in_mix.cast("long").alias("mixed"))
    left = (total or 0) - (sources.agg(F.sum("mixed")).first()[0] or 0)
    rest = max(1, round(left / block_tokens)) if left else 0
    a_block = lambda n, k: F.greatest(F.lit(1), F.floor(F.col(n) * F.lit(float(UNIT)) / F.lit(k))).cast("long")
    sources = sources.withColumns({"rest_share": (F.col("all") - F.col("mixed")) / F.lit(float(max(left, 1))), "a_mixed": a_block("mixed", blocks), "rest": F.col("all") - F.col("mixed")})
    sources = sources.withColumn("a_rest", a_block("rest", max(rest, 1))).drop("all", "rest")
    sources = sources.withColumnRenamed("s", "q")
    known = parts.drop("k").join(sources, F.col("s").eqNullSafe(F.col("q"))).drop("q")
    return written(known.withColumns({"blocks": F.lit(blocks), "rests": F.lit(max(rest, 1))}), "queues"), blocks + rest


def dealt(ids: DataFrame, known: DataFrame) -> DataFrame:
    """The parts of documents that fall into each block: block, at (place in the queue), cut (ids of the
    document before the part), m (its ids), share, owed."""
    known = known.withColumnsRenamed({"s": "q", "part": "p"})
    rows = ids.join(known, F.col("s").eqNullSafe(F.col("q")) & (F.col("part") == F.col("p"))).withColumn("at", F.expr("base + before"))
    # a document's ids in mixed blocks, and those in rest blocks, each counted from their own start
    spans = """filter(array(
      named_struct('lo', at, 'hi', least(at + n, mixed), 'from', 0L, 'unit', a_mixed, 'blocks', blocks, 'first', 0L, 'share', share),
      named_struct('lo', greatest(at, mixed) - mixed, 'hi', at + n - mixed, 'from', mixed, 'unit', a_rest, 'blocks', rests, 'first', cast(blocks AS BIGINT), 'share', rest_share)),
      x -> x.hi > x.lo)"""
    rows = rows.select("i", "s", "n", "ids", "width", "at", F.explode(F.expr(spans)).alias("x"))
    block = lambda place: f"least((({place} + 1) * {UNIT}L - 1) div x.unit, x.blocks - 1L)"
    rows = rows.select("*", F.explode(F.expr(f"sequence({block('x.lo')}, {block('x.hi - 1')})")).alias("b"))
    edge = lambda b: f"(({b}) * x.unit) div {UNIT}L"
    rows = rows.withColumns({"lo": F.expr(f"greatest(x.lo, {edge('b')})"), "hi": F.expr(f"CASE WHEN b = x.blocks - 1 THEN x.hi ELSE least(x.hi, {edge('b + 1')}) END")})
    rows = rows.withColumns({"cut": F.expr("lo + x.from - at"), "m": F.expr("hi - lo")})
    slice_ = F.expr("substring(ids, cast(cut * width + 1 AS INT), cast(m * width AS INT))")
    return rows.select((F.col("x.first") + F.col("b")).alias("block"), F.expr("lo + x.from").alias("at"), "i", "s", "n", "cut", "m", slice_.alias("ids"), "width", "x.share", F.expr(f"b * x.unit / {float(UNIT)}D - {edge('b')}").alias("owed"))


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, proportions: dict[str, float] | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a piece. proportions: target share of each source; without it, the corpus's own.

    Shuffles the ids once. Sequence ids are block x 2^32 + place in the block.
    """
    ids = written(encoded(docs, vocabulary, end_id), "packing")
    known, blocks = queues(ids, proportions, block_tokens)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks, MOST_PARTITIONS))
    return dealt(ids, known).repartition(parts, "block").groupBy("block").applyInArrow(_pack, PIECES)
