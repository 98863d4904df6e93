"""Sparse TF-IDF retrieval by blocks.

Terms are words of two characters or more and their bigrams, or character n-grams; a term's weight is
(1 + ln tf) * idf, idf = ln((1 + N) / (1 + df)) + 1, vectors have length one. Vectors are packed into
blocks of queries and blocks of targets; a grid of (query block, stripe of target blocks) is the tasks'
work. A cell is named by its numbers and its task reads the blocks from the shared folder one by one, so
blocks aren't copied into a shuffle for every cell. Within a cell a query's scores are sums over its terms'
postings in the block, and only its k best targets leave the cell: neither shared terms nor pair sums ever
cross the network.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import parted, rows_of, stored


@dataclass(frozen=True)
class TfidfParams:
    analyzer: str = "word"  # or "char": n-grams of characters, blanks included
    ngrams: tuple[int, int] = (1, 2)
    min_df: int = 3
    max_df: float = 0.2
    max_features: int = 20_000
    k: int = 25
    floor: float = 0.0
    small: int = 50  # under so many documents no term is dropped by frequency: part of the definition


TARGET_BLOCK, QUERY_BLOCK, STRIPE = 4096, 1024, 2
MOST_CELLS = 20_000
#: Characters 3 to 4 at a time, as a second retrieval.
CHAR_PARAMS = TfidfParams(analyzer="char", ngrams=(3, 4), min_df=2, max_df=0.5, max_features=50_000)


def retrieval_text() -> Column:
    return F.concat_ws(" ", "name", "address")


def _run_of(n: int):
    return lambda i: F.array_join(F.slice("w", i, n), " ")


def document_terms(docs: DataFrame, text: Column, ngrams: tuple[int, int] = (1, 2), id_col: str = "entity_id", analyzer: str = "word") -> DataFrame:
    """id, term, tf."""
    if analyzer == "char":
        s = F.regexp_replace(F.lower(text), r"\s\s+", " ")
        grams_of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))
        pieces = [F.when(F.length(s) >= n, grams_of(n)).otherwise(F.array().cast("array<string>")) for n in range(ngrams[0], ngrams[1] + 1)]
        return docs.select(F.col(id_col).alias("id"), F.explode(F.concat(*pieces)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    words = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)).alias("w"))
    grams = []
    for n in range(ngrams[0], ngrams[1] + 1):
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
        grams.append(F.when(F.size("w") >= n, F.transform(starts, _run_of(n))).otherwise(F.array().cast("array<string>")))
    return words.select("id", F.explode(F.concat(*grams)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def vocabulary(terms: DataFrame, n_docs: int, p: TfidfParams) -> DataFrame:
    """term, df, idf: at most max_features rows."""
    low, high = (1, n_docs) if n_docs < p.small else (p.min_df, p.max_df * n_docs)
    df = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    kept = df.where((F.col("df") >= low) & (F.col("df") <= high)).orderBy(F.desc("total"), "term").limit(p.max_features)
    return kept.select("term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def vectors(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """id, term, w of unit length."""
    raw = terms.join(F.broadcast(vocab.select("term", "idf")), "term").select("id", "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    # vocab has max_features rows at most, a parameter: its size is bounded
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def similarities(q: DataFrame, t: DataFrame) -> DataFrame:
    """s1_id, target_id, score of all pairs that share a term: for small sides and checks."""
    a = q.select(F.col("id").alias("s1_id"), "term", F.col("w").alias("a"))
    b = t.select(F.col("id").alias("target_id"), "term", F.col("w").alias("b"))
    return a.join(b, "term").groupBy("s1_id", "target_id").agg(F.round(F.sum(F.col("a") * F.col("b")), 6).alias("score"))


def _blocks(vectors: DataFrame, terms: DataFrame, size: int) -> DataFrame:
    """Blocks of size records at most: part, ids (ascending), each record's end, terms' numbers and weights.
    terms: term, number."""
    # terms has max_features rows at most, a parameter: its size is bounded
    rows = vectors.join(F.broadcast(terms), "term").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("number", "w"))).alias("v"))

    def pack(batches):
        from pyspark import TaskContext

        def block(held):
            held.sort(key=lambda r: r[0])
            ids, numbers, weights = zip(*held)
            ends = np.cumsum([len(x) for x in numbers])
            return pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "ids": pa.array([list(ids)], pa.list_(pa.string())), "ends": pa.array([ends.tobytes()], pa.binary()),
                                               "numbers": pa.array([np.concatenate(numbers).astype(np.int32).tobytes()], pa.binary()), "weights": pa.array([np.concatenate(weights).tobytes()], pa.binary())})

        held = []
        for batch in batches:
            lists = batch.column(1)
            each, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            numbers, weights = each.field("number").to_numpy(), each.field("w").to_numpy()
            for k, i in enumerate(batch.column(0).to_pylist()):
                held.append((i, numbers[ends[k] : ends[k + 1]], weights[ends[k] : ends[k + 1]]))
                if len(held) == size:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    return rows.mapInArrow(pack, "part int, ids array<string>, ends binary, numbers binary, weights binary")


def _cells(queries: str, targets: str, stripes: int, k: int, floor: float):
    """The k best targets of each query in each cell: (query block) x stripes + (stripe)."""

    def pairs(cell: int):
        for q in rows_of(queries, "qb", cell // stripes):
            named = {f"q_{name}": value for name, value in q.items()}
            for t in rows_of(targets, "stripe", cell % stripes):
                yield t | named

    def run(batches):
        best: dict[str, list] = {}
        for batch in batches:
            for row in (row for cell in batch.column(0).to_pylist() for row in pairs(cell)):
                ends = np.frombuffer(row["ends"], np.int64)
                numbers, weights = np.frombuffer(row["numbers"], np.int32), np.frombuffer(row["weights"], np.float64)
                order = np.argsort(numbers, kind="stable")
                target = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[order]
                numbers, weights = numbers[order], weights[order]
                q_ends, q_numbers, q_weights = np.frombuffer(row["q_ends"], np.int64), np.frombuffer(row["q_numbers"], np.int32), np.frombuffer(row["q_weights"], np.float64)
                lo, hi = np.searchsorted(numbers, q_numbers, "left"), np.searchsorted(numbers, q_numbers, "right")
                for j, (a, b) in enumerate(zip(np.concatenate([[0], q_ends]).tolist(), q_ends.tolist())):
                    size = hi[a:b] - lo[a:b]
                    total = int(size.sum())
                    if not total:
                        continue
                    at = np.arange(total) + np.repeat(lo[a:b] - size.cumsum() + size, size)
                    score = np.round(np.bincount(target[at], weights[at] * np.repeat(q_weights[a:b], size), len(ends)), 6)
                    there = np.flatnonzero(score > 0 if floor == 0 else score >= floor)
                    if len(there) > k:  # ties at the k-th stay for the order by id
                        there = there[score[there] >= np.partition(score[there], -k)[-k]]
                    there = there[np.lexsort((there, -score[there]))][:k]  # a block's ids ascend
                    if len(there):
                        best.setdefault(row["q_ids"][j], []).extend((row["ids"][x], s) for x, s in zip(there.tolist(), score[there].tolist()))
                if len(best) > 8 * QUERY_BLOCK:
                    yield _found(best, k)
                    best = {}
        if best:
            yield _found(best, k)

    return run


def _found(best: dict[str, list], k: int) -> pa.RecordBatch:
    rows = [(q, t, s) for q, found in best.items() for t, s in sorted(found, key=lambda x: (-x[1], x[0]))[:k]]
    q, t, s = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(q, pa.string()), pa.array(t, pa.string()), pa.array(s, pa.float64())], ["s1_id", "target_id", "score"])


def best_pairs(q: DataFrame, t: DataFrame, vocab: DataFrame, k: int, floor: float = 0.0) -> DataFrame:
    """s1_id, target_id, score, rank of the k best targets of each query; q, t: id, term, w."""
    spark = q.sparkSession
    numbered = stored(vocab.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("number")), "terms")  # max_features rows at most
    count = lambda v: v.select("id").distinct().count()
    n, stripes = max(1, -(-count(q) // QUERY_BLOCK)), max(1, -(-count(t) // (STRIPE * TARGET_BLOCK)))
    dealt = F.pmod(F.xxhash64("numbers", "weights"), F.lit(stripes)).cast("int").alias("stripe")
    targets = parted(_blocks(t, numbered, TARGET_BLOCK).select("ids", "ends", "numbers", "weights", dealt), "target-blocks", "stripe")
    queries = _blocks(q.repartition(n, "id"), numbered, 4 * QUERY_BLOCK)
    queries = parted(queries.select("ids", "ends", "numbers", "weights", F.pmod("part", F.lit(n)).alias("qb")), "query-blocks", "qb")
    cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n * stripes, MOST_CELLS))
    found = spark.range(0, n * stripes, 1, min(cells, n * stripes)).mapInArrow(_cells(queries, targets, stripes, k, floor), "s1_id string, target_id string, score double")
    return ranked(found, k, floor)


def ranked(scored: DataFrame, k: int, floor: float = 0.0) -> DataFrame:
    """The k best targets of each query with their rank; ties by id."""
    order = Window.partitionBy("s1_id").orderBy(F.desc("score"), "target_id")
    return scored.where(F.col("score") > floor if floor == 0 else F.col("score") >= floor).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fit(targets: DataFrame, p: TfidfParams, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, target vectors); sample: fit the vocabulary on the first records by id."""
    terms = document_terms(targets, retrieval_text(), p.ngrams, analyzer=p.analyzer)
    base, n = terms, None
    if sample is not None:
        first = targets.select(F.col("entity_id").alias("id")).orderBy("id").limit(sample)
        base, n = terms.join(first, "id", "left_semi"), first.count()
    vocab = stored(vocabulary(base, n if n is not None else targets.count(), p), "vocabulary")
    return vocab, vectors(terms, vocab)


def top_k(queries: DataFrame, targets: DataFrame, p: TfidfParams = TfidfParams()) -> DataFrame:
    """s1_id, target_id, score, rank."""
    vocab, tv = fit(targets, p)
    qv = vectors(document_terms(queries, retrieval_text(), p.ngrams, analyzer=p.analyzer), vocab)
    return best_pairs(qv, tv, vocab, p.k, p.floor)


def pair_scores(pairs: DataFrame, queries: DataFrame, targets: DataFrame, p: TfidfParams = TfidfParams()) -> DataFrame:
    """Scores of given pairs only: terms meet through the pair table, not each other."""
    vocab, tv = fit(targets, p)
    qv = vectors(document_terms(queries, retrieval_text(), p.ngrams), vocab)
    a = pairs.join(qv.select(F.col("id").alias("s1_id"), "term", F.col("w").alias("a")), "s1_id")
    b = tv.select(F.col("id").alias("target_id"), "term", F.col("w").alias("b"))
    dot = a.join(b, ["target_id", "term"]).groupBy("s1_id", "target_id").agg(F.round(F.sum(F.col("a") * F.col("b")), 6).alias("score"))
    return pairs.join(dot, ["s1_id", "target_id"], "left").select("s1_id", "target_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def merge_top_k(parts: list[DataFrame], k: int) -> DataFrame:
    """One ranking of several chunks' results; a pair counts once, with its best score."""
    rows = parts[0].select("s1_id", "target_id", "score")
    for part in parts[1:]:
        rows = rows.unionByName(part.select("s1_id", "target_id", "score"))
    return ranked(rows.groupBy("s1_id", "target_id").agg(F.max("score").alias("score")), k)
