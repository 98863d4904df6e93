"""Candidate generation: equi-joins on derived keys.

A Block names the keys a query record and a target record get. All blocks of a run are one key table
(block, key, entity_id) a side and one join, so adding a block adds rows, not shuffles. Caps keep the
first targets of a key by entity_id; Spark ranks within map tasks before it shuffles, so a hot key
never gathers in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored


@dataclass(frozen=True)
class Block:
    """query, target: SQL of an array of keys over an enriched record; cap: targets a key, None for all.

    skip_over: keys that more queries than this share are skipped whole. own: keys hold numbers, so nearly
    every record has others; this tells how pairs are worked out, not which.
    """

    name: str
    query: str
    target: str | None = None
    cap: int | None = None
    skip_over: int | None = None
    own: bool = False

    @property
    def target_keys(self) -> str:
        return self.target or self.query


def _one(expression: str) -> str:
    return f"CASE WHEN {expression} <> '' THEN array({expression}) ELSE array() END"


_BOUNDARY = "CASE WHEN length(compact) < {n} THEN compact ELSE concat(left(compact, {n}), '::', right(compact, {n})) END"
_FIRST_LONG = "get(filter(name_tokens, x -> length(x) >= 3), 0)"


def exact_name(cap: int | None = 1000, strip_legal: bool = True, with_country: bool = False) -> Block:
    field = "name" if strip_legal else "clean_name"
    key = f"concat(country, '::', {field})" if with_country else field
    return Block("exact_name", f"CASE WHEN {field} <> '' THEN array({key}) ELSE array() END", cap=cap)


def sorted_name(cap: int | None = 1000) -> Block:
    return Block("sorted_name", _one("sorted_name"), cap=cap)


def char_boundary(n: int = 4, cap: int | None = 1000) -> Block:
    return Block("char_ngram", _one("(" + _BOUNDARY.format(n=n) + ")"), cap=cap)


def exact_address(cap: int | None = 1000) -> Block:
    return Block("address", "CASE WHEN address <> '' THEN array(concat(upper(country), '::', address)) ELSE array() END", cap=cap)


def postal_code(cap: int | None = 2000) -> Block:
    return Block("postal", "array_distinct(postals)", cap=cap)


def name_postal(cap: int | None = 500) -> Block:
    return Block("name_postal", f"CASE WHEN {_FIRST_LONG} IS NOT NULL THEN transform(array_distinct(postals), p -> concat(upper(country), '::', {_FIRST_LONG}, '::', p)) ELSE array() END", cap=cap)


def name_number(cap: int | None = 500) -> Block:
    return Block("name_numeric", f"CASE WHEN {_FIRST_LONG} IS NOT NULL AND size(numbers) > 0 THEN array(concat(upper(country), '::', {_FIRST_LONG}, '::', numbers[0])) ELSE array() END", cap=cap, own=True)


def first_token_with(field: str, name: str, cap: int | None = 500) -> Block:
    """First token, if long enough, with every value of an array field; no country."""
    return Block(name, f"CASE WHEN length(get(name_tokens, 0)) >= 3 THEN transform(array_distinct({field}), p -> concat(name_tokens[0], '::', p)) ELSE array() END", cap=cap, own=True)


def ensemble_blocks(cap: int | None = 500) -> list[Block]:
    """The deterministic part of the six-way ensemble: exact and sorted uncapped."""
    return [exact_name(None), sorted_name(None), first_token_with("postals", "name_postal", cap), first_token_with("numbers", "name_numeric", cap), char_boundary(4, cap)]


def informative_number(cap: int | None = 250) -> Block:
    """Informative token x plot number: queries give their first token with all numbers and all tokens
    with their first number, targets their first two tokens with all numbers."""
    query = """array_distinct(concat(
      CASE WHEN size(informative) > 0 THEN transform(plots, p -> concat(informative[0], '::', p)) ELSE array() END,
      CASE WHEN size(plots) > 0 THEN transform(informative, x -> concat(x, '::', plots[0])) ELSE array() END))"""
    target = "array_distinct(flatten(transform(slice(informative, 1, 2), x -> transform(plots, p -> concat(x, '::', p)))))"
    return Block("informative_number", query, target, cap)


def cross_script() -> list[Block]:
    """Indic addresses, and romanised name prefixes against Latin signatures."""
    place = "coalesce(get(postals, 0), try_element_at(address_tokens, -1), 'addr')"
    address = f"transform(array_distinct(plots), p -> concat('IN::', {place}, '::', p))"
    return [
        Block("indic_address", f"CASE WHEN upper(country) IN ('IN', 'INDIA') THEN {address} ELSE array() END", f"CASE WHEN is_indic THEN {address} ELSE array() END"),
        Block("transliteration", "CASE WHEN length(domain) >= 5 THEN array(left(domain, 5)) ELSE array() END", "CASE WHEN length(indic) >= 5 THEN array(left(indic, 5)) ELSE array() END"),
    ]


def domain_block(least: int = 5) -> Block:
    return Block("domain", f"CASE WHEN length(domain) >= {least} THEN array(domain) ELSE array() END")


def leetspeak_block() -> Block:
    return Block("leetspeak", "CASE WHEN leet <> '' AND leet <> domain THEN array(leet) ELSE array() END", _one("leet"))


def alias_block() -> Block:
    place = "coalesce(get(postals, 0), try_element_at(address_tokens, -1))"
    return Block("alias", f"CASE WHEN {place} IS NOT NULL THEN transform(array_distinct(filter(plots, p -> length(p) >= 2)), p -> concat(upper(country), '::', {place}, '::', p)) ELSE array() END")


def arm_b_blocks(cap: int | None = None) -> list[Block]:
    """The first arm; by definition every pair of a key. cap bounds targets a key: metrics.missed with
    the capped pairs gives the links that costs."""
    number = "CASE WHEN size(informative) > 0 THEN transform(array_distinct(plots), p -> concat(informative[0], '::', p)) ELSE array() END"
    return [exact_name(cap), sorted_name(cap), Block("name_numeric", number, cap=cap, own=True), char_boundary(4, cap), replace(domain_block(4), cap=cap)]


def arm_c_blocks(cap: int | None = None) -> list[Block]:
    return [*arm_b_blocks(cap), *(replace(b, cap=cap) for b in (*cross_script(), leetspeak_block()))]


def engine_blocks() -> list[Block]:
    """Production retrieval: Arm B without the character block."""
    return [b for b in arm_b_blocks() if b.name != "char_ngram"]


def capped_blocks(skip_over: int = 30) -> list[Block]:
    """Final-script retrieval: keys that too many queries share are skipped."""
    return [Block(b.name, b.query, b.target, None, skip_over, b.own) for b in engine_blocks()]


def keys(records: DataFrame, blocks: list[Block], side: str) -> DataFrame:
    """block, key, entity_id; empty keys never appear."""
    parts = [f"transform(cast({b.query if side == 'query' else b.target_keys} AS array<string>), k -> named_struct('block', '{b.name}', 'key', k))" for b in blocks]
    return records.select("entity_id", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("x")).select("x.block", "x.key", "entity_id").where("key <> ''")


def _limit(blocks: list[Block], field: str) -> Column | None:
    bounded = {b.name: getattr(b, field) for b in blocks if getattr(b, field) is not None}
    if not bounded:
        return None
    return F.create_map(*[F.lit(x) for kv in bounded.items() for x in kv])[F.col("block")]


def capped(target_keys: DataFrame, blocks: list[Block]) -> DataFrame:
    """The first targets of each key by entity_id, per the blocks' caps."""
    out, by_cap = None, {}
    for b in blocks:
        by_cap.setdefault(b.cap, []).append(b.name)
    rank = F.dense_rank().over(Window.partitionBy("block", "key").orderBy("entity_id"))  # repeated rows count once
    for cap, names in by_cap.items():
        part = target_keys.where(F.col("block").isin(names))
        if cap is not None:
            part = part.withColumn("r", rank).where(F.col("r") <= cap).drop("r")
        out = part if out is None else out.unionByName(part)
    return out


def _met_keys(queries: DataFrame, targets: DataFrame, blocks: list[Block]) -> tuple[DataFrame, DataFrame]:
    """block, key, s1_id and block, key, target_id with caps and skipped keys applied."""
    q = keys(queries, blocks, "query").withColumnRenamed("entity_id", "s1_id")
    skip = _limit(blocks, "skip_over")
    if skip is not None:
        hot = q.groupBy("block", "key").agg(F.countDistinct("s1_id").alias("n")).where(F.col("n") > F.coalesce(skip, F.lit(1 << 60)))
        q = q.join(hot, ["block", "key"], "left_anti")
    return q, capped(keys(targets, blocks, "target"), blocks).withColumnRenamed("entity_id", "target_id")


def hits(queries: DataFrame, targets: DataFrame, blocks: list[Block]) -> DataFrame:
    """block, s1_id, target_id of every key match."""
    q, t = _met_keys(queries, targets, blocks)
    return q.join(t, ["block", "key"]).select("block", "s1_id", "target_id")


SIDE = 2048  # queries and targets of a key that meet in one cell
CLASS = 256  # records of equal keys that meet others as one
EARLY_SIDE, EARLY_CLASS, EARLY_PARTS = 512, 64, 24  # the same where pairs are worked on as they come out; tasks a core


@dataclass(frozen=True)
class Early:
    """What is told of a pair's classes, once for all their members. fields: carried columns that the first
    of them decides; columns: gives columns (by name) over q_ and t_ of these fields, before fields go. of_class
    and of_member give more fields (by name, over a prefix), made of classes' and of members' columns only where
    they meet others."""

    fields: tuple[str, ...]
    columns: Callable[[], dict[str, Column]]
    of_class: Callable[[str], dict[str, Column]]
    of_member: Callable[[str], dict[str, Column]]


def _classes(per: DataFrame, name: str, by: list[str], member: Column, size: int = CLASS, decided: tuple[str, ...] = ()) -> DataFrame:
    """by, members: records (name) with equal by as one row, in parts of some size each, so none is large.
    decided: columns that by decides."""
    n = per.groupBy(*by).agg(F.count("*").alias("n_"))
    rows = per.join(n, by).withColumn("part_", F.pmod(F.xxhash64(name), F.ceil(F.col("n_") / size)))
    return rows.groupBy(*by, "part_").agg(F.collect_list(member).alias("members"), *[F.first(c).alias(c) for c in decided]).drop("part_")


def _near(per: DataFrame, tfidf: DataFrame | None) -> DataFrame:
    """per with each query's targets by TF-IDF, null where it has none."""
    if tfidf is None:
        return per.withColumn("near", F.lit(None).cast("array<string>"))
    return per.join(tfidf.groupBy("s1_id").agg(F.collect_set("target_id").alias("near")), "s1_id", "left")


def met(queries: DataFrame, targets: DataFrame, blocks: list[Block], tfidf: DataFrame | None = None, carry: DataFrame | None = None, early: Early | None = None) -> DataFrame:
    """s1_id, target_id of every pair once, a flag a block (by name), and of tfidf (s1_id, target_id, score,
    rank) score and rank, else null; with carry (entity_id and more) both records' columns as q_ and t_.

    Records carry all their keys into the join on (block, key), so a pair is told there from its other
    blocks' hits: it comes from the first block and key that has it, and what comes out needs no shuffle.
    A key's queries and targets are dealt into cells of SIDE each, so no hot key stays in one task. Pairs
    by TF-IDF are left out there, by their query's list, and added with their flags. Without carry, records
    of equal keys meet as one: what holds of a pair is told once for all of them. Blocks whose keys are a
    record's own are left out of that: their flags are told pair by pair, and they add the pairs that no
    other block has. With early (no tfidf then) records of equal keys and fields meet as one too, and its columns
    come in the place of the fields'.
    """
    one_by_one = carry is not None and early is None
    apart = set() if one_by_one else {b.name for b in blocks if b.own}
    names = sorted(dict.fromkeys(b.name for b in blocks), key=lambda b: b in apart)  # those of records last
    fields = [] if early is None else list(early.fields)
    members = [c for c in (carry.columns if carry is not None else []) if c not in ("entity_id", *fields)]
    members += [] if early is None else [c[2:] for c in early.of_member("q_")]
    made = [] if early is None else [c[2:] for c in early.of_class("q_")]
    most = SIDE if early is None else EARLY_SIDE
    q, t = _met_keys(queries, targets, blocks)

    def side(rows: DataFrame, name: str, p: str) -> DataFrame:
        """name, p_k0.. (its keys in each block) and what it carries: one row a record that has a key."""
        per = rows.groupBy(name).agg(*[F.array_sort(F.collect_set(F.when(F.col("block") == b, F.col("key")))).alias(f"{p}_k{i}") for i, b in enumerate(names)])
        if carry is None:
            return per
        rows = per.join(carry.select(F.col("entity_id").alias(name), *[F.col(c).alias(f"{p}_{c}") for c in carry.columns if c != "entity_id"]), name)
        return rows if early is None else rows.withColumns(early.of_member(f"{p}_"))

    count = lambda rows, n: rows.groupBy("block", "key").agg(F.count("*").alias(n))
    cells = count(q, "nq").join(count(t, "nt"), ["block", "key"])
    if early is not None:  # records that meet none needn't bring anything along
        cells = stored(cells, "cells")
        q, t = (rows.join(cells.select("block", "key"), ["block", "key"], "left_semi") for rows in (q, t))
    qs, ts = side(q, "s1_id", "q"), side(t, "target_id", "t")
    parts = lambda n: F.ceil(F.col(n) / most).cast("int")
    cells = cells.select("block", "key", parts("nq").alias("nq"), parts("nt").alias("nt"))  # keys of one side alone are gone

    def dealt(per: DataFrame, name: str | Column, p: str, which: list[int]) -> DataFrame:
        """per by its keys in these blocks and the cells it meets others in."""
        of = lambda b: lambda k: F.struct(F.lit(b).alias("block"), k.alias("key"))
        each = F.explode(F.concat(*[F.transform(f"{p}_k{i}", of(names[i])) for i in which]))
        own, other, mine, others = ("nq", "nt", "cq", "ct") if p == "q" else ("nt", "nq", "ct", "cq")
        rows = per.select("*", each.alias("x")).select("*", "x.block", "x.key").drop("x").join(cells, ["block", "key"])
        rows = rows.withColumn(mine, F.pmod(F.xxhash64(name), F.col(own)).cast("int")).withColumn(others, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return rows.drop("nq", "nt")

    shared = lambda i: F.arrays_overlap(f"q_k{i}", f"t_k{i}")

    def joined(qd: DataFrame, td: DataFrame, which: list[int], spread: bool = False) -> DataFrame:
        """What meets in a cell, where none of these blocks has it before."""
        first = F.lit(True)
        for i in reversed(which):
            least = (F.size(f"q_k{i}") == 1) | (F.size(f"t_k{i}") == 1) | (F.array_min(F.array_intersect(f"q_k{i}", f"t_k{i}")) == F.col("key"))
            first = F.when(F.col("block") == names[i], least).otherwise(~shared(i) & first)
        by = ["block", "key", "cq", "ct"]
        if spread:  # few bytes give many pairs: by bytes, Spark would take few tasks
            n = EARLY_PARTS * queries.sparkSession.sparkContext.defaultParallelism
            qd, td = qd.repartition(n, *by), td.repartition(n, *by)
        return qd.join(td, by).where(first)

    everything = list(range(len(names)))
    flags = [shared(i).alias(b) for i, b in enumerate(names)]
    near = _near(qs, tfidf)
    unlisted = lambda rows, near: rows if tfidf is None else rows.where(F.col(near).isNull() | ~F.array_contains(near, F.col("target_id")))
    whole = [i for i, b in enumerate(names) if b not in apart]
    told_early = lambda rows: rows if early is None else rows.select(*[c for c in rows.columns if c[2:] not in (*fields, *made)], *[c.alias(n) for n, c in early.columns().items()])
    brought = [] if early is None else list(early.columns())
    prepared = lambda rows, p: rows if early is None else rows.withColumns(early.of_class(p))
    if one_by_one or not whole:
        rows = told_early(unlisted(joined(prepared(dealt(near, "s1_id", "q", everything), "q_"), prepared(dealt(ts, "target_id", "t", everything), "t_"), everything, early is not None), "near"))
    else:
        own = everything[len(whole) :]
        told = lambda p: [F.col(f"{p}_k{i}").alias(f"k{i}") for i in own] + [F.col(f"{p}_{c}").alias(c) for c in members]
        size = CLASS if early is None else EARLY_CLASS

        def classes(per: DataFrame, name: str, p: str, *more: str) -> DataFrame:
            by, decided = [f"{p}_k{i}" for i in whole] + [f"{p}_{c}" for c in fields[:1]], tuple(f"{p}_{c}" for c in fields[1:])
            return prepared(_classes(per, name, by, F.struct(name, *more, *told(p)), size, decided).withColumnRenamed("members", f"{p}_members"), f"{p}_")

        qc, tc = classes(near, "s1_id", "q", "near"), classes(ts, "target_id", "t")
        rows = joined(dealt(qc, F.col("q_members")[0]["s1_id"], "q", whole), dealt(tc, F.col("t_members")[0]["target_id"], "t", whole), whole, early is not None)
        rows = told_early(rows).select(*flags[: len(whole)], *brought, F.explode("q_members").alias("q"), "t_members")
        of = lambda p: [*[F.col(f"{p}.k{i}").alias(f"{p}_k{i}") for i in own], *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for c in members]]
        rows = rows.select(*names[: len(whole)], *brought, "q.s1_id", "q.near", *of("q"), "t_members")  # of q before t: Spark loses fields of q otherwise
        rows = rows.withColumn("t", F.explode("t_members")).drop("t_members").select("*", "t.target_id", *of("t"))
        also = [*brought, *[f"{p}_{c}" for p in "qt" for c in members]]
        rows = rows.select("s1_id", "target_id", "near", *names[: len(whole)], *[shared(i).alias(names[i]) for i in own], *also)
        rows = unlisted(rows, "near").select("s1_id", "target_id", *names, *also)
        if own:  # pairs of no other block
            more = joined(prepared(dealt(near, "s1_id", "q", own), "q_"), prepared(dealt(ts, "target_id", "t", own), "t_"), own)
            for i in whole:
                more = more.where(~shared(i))
            rows = rows.unionByName(told_early(unlisted(more, "near")).select("s1_id", "target_id", *flags, *also))
        flags = names
    carried = [*brought, *[f"{p}_{c}" for p in "qt" for c in members]]
    out = rows.select("s1_id", "target_id", *flags, F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank"), *carried)
    if tfidf is not None:
        ranked = tfidf.select("s1_id", "target_id", "score", F.col("rank").cast("int").alias("rank"))
        if carry is None:
            more = ranked.join(qs, "s1_id", "left").join(ts, "target_id", "left")
        else:
            by = lambda name, p: carry.select(F.col("entity_id").alias(name), *[F.col(c).alias(f"{p}_{c}") for c in carry.columns if c != "entity_id"])
            bare = lambda per, p: per.drop(*[f"{p}_{c}" for c in carry.columns])
            more = ranked.join(bare(qs, "q"), "s1_id", "left").join(bare(ts, "t"), "target_id", "left").join(by("s1_id", "q"), "s1_id").join(by("target_id", "t"), "target_id")
        out = out.unionByName(more.select("s1_id", "target_id", *[F.coalesce(shared(i), F.lit(False)).alias(b) for i, b in enumerate(names)], "score", "rank", *carried))
    return out


def candidates(queries: DataFrame, targets: DataFrame, blocks: list[Block], per_query: int | None = None, tfidf: DataFrame | None = None) -> DataFrame:
    """Distinct s1_id, target_id; per_query keeps a query's first targets by id. These are among the first
    per_query of each of its keys, so no key has to give more: a key's are a list, and queries of equal keys
    merge theirs once and add those of their own keys. Pairs of tfidf come besides."""
    if per_query is None:
        return met(queries, targets, blocks, tfidf).select("s1_id", "target_id")
    blocks = [replace(b, cap=per_query if b.cap is None else min(b.cap, per_query)) for b in blocks]
    q, t = _met_keys(queries, targets, blocks)
    lists = t.groupBy("block", "key").agg(F.collect_set("target_id").alias("ids"))  # per_query at most
    q = q.join(lists.select("block", "key"), ["block", "key"], "left_semi")  # keys that no target has tell nothing
    firsts = lambda ids: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(ids)))), 1, per_query)
    own = [b.name for b in blocks if b.own]
    mine = q.where(F.col("block").isin(own)).join(lists, ["block", "key"]).groupBy("s1_id").agg(firsts("ids").alias("mine"))
    keyed = q.where(~F.col("block").isin(own)).groupBy("s1_id").agg(F.array_sort(F.collect_set(F.struct("block", "key"))).alias("keys"))
    per = _near(keyed.join(mine, "s1_id", "full").withColumn("keys", F.coalesce("keys", F.array().cast("array<struct<block:string,key:string>>"))), tfidf)
    classes = stored(_classes(per, "s1_id", ["keys"], F.struct("s1_id", "near", "mine")).withColumn("class", F.col("members")[0]["s1_id"]), "classes")
    met_lists = classes.select("class", F.explode("keys").alias("x")).select("class", "x.block", "x.key").join(lists, ["block", "key"])
    rows = classes.select("class", "members").join(met_lists.groupBy("class").agg(firsts("ids").alias("ids")), "class", "left")
    rows = rows.select(F.explode("members").alias("q"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    ids = F.when(F.col("q.mine").isNull(), F.col("ids")).otherwise(F.slice(F.array_sort(F.array_union("ids", "q.mine")), 1, per_query))
    rows = rows.select("q.s1_id", "q.near", ids.alias("ids"))
    pairs = rows.select("s1_id", F.explode(F.when(F.col("near").isNull(), F.col("ids")).otherwise(F.array_except("ids", "near"))).alias("target_id"))
    return pairs if tfidf is None else pairs.unionByName(tfidf.select("s1_id", "target_id"))


FLAGS = ("exact_name", "sorted_name", "name_numeric", "char_ngram", "domain", "transliteration", "leetspeak")


def with_provenance(found: DataFrame, tfidf: DataFrame | None = None) -> DataFrame:
    """One row a pair: a flag a block, tfidf score and rank, and how many blocks found it.

    found: block, s1_id, target_id; tfidf: s1_id, target_id, score, rank.
    """
    rows = found.select("s1_id", "target_id", "block", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank"))
    if tfidf is not None:
        rows = rows.unionByName(tfidf.select("s1_id", "target_id", F.lit("tfidf").alias("block"), "score", F.col("rank").cast("int").alias("rank")))
    flags = [F.max(F.col("block") == b).alias(b) for b in (*FLAGS, "tfidf")]
    return rows.groupBy("s1_id", "target_id").agg(
        *flags,
        F.coalesce(F.max("score"), F.lit(0.0)).alias("tfidf_score"),
        F.coalesce(F.min("rank"), F.lit(1000)).alias("tfidf_rank"),
        F.size(F.collect_set("block")).alias("support_count"),  # a dozen names at most
    )


def provenance(queries: DataFrame, targets: DataFrame, blocks: list[Block], tfidf: DataFrame | None = None, carry: DataFrame | None = None, early: Early | None = None) -> DataFrame:
    """with_provenance of the blocks' hits and tfidf, without a shuffle of pairs; carry and early as for met."""
    rows = met(queries, targets, blocks, tfidf, carry, early)
    names = list(dict.fromkeys(b.name for b in blocks))
    count = sum((F.col(b).cast("int") for b in names), F.col("rank").isNotNull().cast("int"))
    return rows.select(
        "s1_id", "target_id",
        *[F.col(b) if b in names else F.lit(False).alias(b) for b in FLAGS],
        F.col("rank").isNotNull().alias("tfidf"),
        F.coalesce("score", F.lit(0.0)).alias("tfidf_score"),
        F.coalesce("rank", F.lit(1000)).alias("tfidf_rank"),
        count.alias("support_count"),
        *[c for c in rows.columns if c not in ("s1_id", "target_id", "score", "rank", *names)],
    )


def rare_token_pairs(queries: DataFrame, targets: DataFrame, least: int = 3, max_df: int = 1000, cap: int = 500) -> DataFrame:
    """Pairs that share their rarest name token; frequencies are the targets'."""

    def words(records: DataFrame, name: str) -> DataFrame:
        rows = records.select(F.col("entity_id").alias(name), F.posexplode("name_tokens").alias("pos", "token"))
        return rows.where(F.length("token") >= least)

    t, q = words(targets, "target_id"), words(queries, "s1_id")
    df = t.groupBy("token").agg(F.countDistinct("target_id").alias("df"))

    def rarest(rows: DataFrame, name: str) -> DataFrame:
        best = rows.join(df, "token").groupBy(name).agg(F.min(F.struct("df", "pos", "token")).alias("b"))
        return best.select(name, F.col("b.token").alias("token"), F.col("b.df").alias("df"))

    rank = F.row_number().over(Window.partitionBy("token").orderBy("target_id"))
    index = rarest(t, "target_id").where(F.col("df") <= max_df).withColumn("r", rank).where(F.col("r") <= cap)
    return rarest(q, "s1_id").select("s1_id", "token").join(index.select("token", "target_id"), "token").select("s1_id", "target_id").distinct()
