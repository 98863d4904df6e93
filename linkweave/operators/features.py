"""The 43 pair features, over records enriched once before the pair join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .blocking import Early
from .tables import stored

GROUPS = {
    "name": "name_exact_clean name_compact_exact name_token_jaccard name_token_overlap_coeff name_char_ngram_cosine name_edit_similarity name_prefix_match_len name_length_ratio name_first_token_match name_sorted_token_jaccard",
    "address": "addr_exact_clean addr_token_jaccard addr_token_overlap_coeff addr_char_ngram_cosine addr_numeric_exact_match addr_numeric_jaccard addr_postal_match addr_is_missing_either",
    "country": "country_exact_match source_is_s2 source_is_s3",
    "script": "is_cross_script_pair translit_name_token_jaccard translit_name_char_ngram_cosine",
    "domain": "is_domain_name_pair domain_compact_match",
    "spelling": "leetspeak_exact_match accent_stripped_match",
    "rarity": "shared_rare_token_count min_shared_token_idf",
    "provenance": "retrieval_support_count retrieved_by_exact_name retrieved_by_sorted_name retrieved_by_name_numeric retrieved_by_char_ngram retrieved_by_domain retrieved_by_tfidf tfidf_similarity_score tfidf_rank",
    "interaction": "inter_name_x_addr_jaccard inter_name_exact_x_addr_jaccard inter_name_jaccard_x_country inter_support_x_name_jaccard",
}
FEATURES = [name for group in GROUPS.values() for name in group.split()]
UNSEEN_IDF, RARE_IDF = 5.0, 4.0
_FIELDS = ["business_name", "business_address", "country", "name", "compact", "name_tokens", "sorted_name", "address", "address_tokens", "numbers", "postals", "is_indic", "latin_name", "domain", "leet", "bare_name"]


def inventory() -> list[tuple[int, str, str]]:
    """Number, name and group of every feature."""
    return [(k + 1, name, next(g for g, names in GROUPS.items() if name in names.split())) for k, name in enumerate(FEATURES)]


def with_grams(enriched: DataFrame) -> DataFrame:
    """What the n-gram cosines need, once a record."""
    if "latin_grams" in enriched.columns:
        return enriched
    return enriched.withColumns({"name_grams": t.gram_counts(F.col("name")), "address_grams": t.gram_counts(F.col("address")), "latin_grams": t.gram_counts(F.when(F.col("is_indic"), F.col("latin_name")).otherwise(F.col("name")))})


def carried(enriched: DataFrame) -> DataFrame:
    """What features need of a record, for blocking.provenance to carry: no join of pairs with records then."""
    return with_grams(enriched).select("entity_id", *_FIELDS, "name_grams", "address_grams", F.when(F.col("is_indic"), F.col("latin_grams")).alias("latin_grams"))


_OF_NAME = ["business_name", "name", "compact", "name_tokens", "sorted_name", "is_indic", "latin_name", "domain", "leet", "bare_name"]  # the first decides the others


def _gram_codes(p: str) -> dict[str, Column]:
    """address_codes: the distinct 3-grams, each as a number of three code points; address_counts: their
    counts, null where all are 1; address_square: the sum of the squares."""
    counts = t.gram_counts(F.col(f"{p}address"))
    code = lambda g: sum((F.ascii(F.substring(g, i, 1)).cast("long") * (1 << 21 * (3 - i)) for i in (1, 2, 3)), F.lit(0).cast("long"))
    once = F.forall(F.map_values(counts), lambda n: n == 1.0)
    square = F.aggregate(F.map_values(counts), F.lit(0.0), lambda a, n: a + n * n)
    return {f"{p}address_codes": F.transform(F.map_keys(counts), code), f"{p}address_counts": F.when(~once, F.map_values(counts)), f"{p}address_square": square}


def by_name(enriched: DataFrame) -> tuple[DataFrame, Early]:
    """What class_features needs of a record, for blocking.provenance to carry, and the features that names
    alone decide, told once for all records of two names. Grams are taken as they are, or made."""
    given = [g for g in ("name_grams", "latin_grams") if g in enriched.columns]
    carry = enriched.select(
        "entity_id", *_OF_NAME, *given, "country", "address", F.array_distinct("address_tokens").alias("address_set"),
        F.array_sort(F.array_distinct("numbers")).alias("number_set"), F.get("postals", F.lit(0)).alias("postal"),
    )
    none = F.lit(None).cast("map<string,double>")
    field = lambda p: lambda f: none if f == "token_idf" else F.col(f"{p}_{f}")
    grams = lambda p: {} if given else {f"{p}name_grams": t.gram_counts(F.col(f"{p}name")), f"{p}latin_grams": t.gram_counts(F.when(F.col(f"{p}is_indic"), F.col(f"{p}latin_name")).otherwise(F.col(f"{p}name")))}
    return carry, Early((*_OF_NAME, *given), lambda: _of_names(field("q"), field("t")), grams, _gram_codes)


def class_features(pairs: DataFrame, keep: tuple[str, ...] = ("label", "hit"), final=lambda name, c: c) -> DataFrame:
    """carried_features of pairs with by_name's columns: what is left to tell is of addresses and blocks.
    final: what is made of each feature. All comes in one projection: with the cosine in it Spark leaves it out
    of whole-stage code, whose methods would be too long to be compiled."""
    q, s = (lambda f: F.col(f"q_{f}")), (lambda f: F.col(f"t_{f}"))
    one = lambda c: c.cast("double")
    rows = pairs.withColumns({n: F.size(F.array_intersect(q(f), s(f))) for n, f in (("words_", "address_set"), ("numbers_", "number_set"), ("grams_", "address_codes"))})
    least = F.least(F.size(q("address_set")), F.size(s("address_set")))
    of = lambda n, f: F.when(F.size(q(f)) + F.size(s(f)) > 0, F.col(n) / (F.size(q(f)) + F.size(s(f)) - F.col(n))).otherwise(0.0)
    counted = lambda p: F.map_from_arrays(p("address_codes"), F.coalesce(p("address_counts"), F.array_repeat(F.lit(1.0), F.size(p("address_codes")))))
    product = F.aggregate(F.map_keys(counted(q)), F.lit(0.0), lambda a, k: a + F.try_element_at(counted(q), k) * F.coalesce(F.try_element_at(counted(s), k), F.lit(0.0)))
    dot = F.when(F.col("grams_") == 0, 0.0).when(q("address_counts").isNull() & s("address_counts").isNull(), one(F.col("grams_"))).otherwise(product)
    bare = lambda p: F.replace(p("address"), F.lit(" "), F.lit(""))
    short = (F.length(bare(q)) < 3) | (F.length(bare(s)) < 3)
    cosine = F.when((q("address") == "") | (s("address") == ""), 0.0).when(q("address") == s("address"), 1.0).when(short, one(bare(q) == bare(s))).otherwise(dot / F.sqrt(q("address_square") * s("address_square")))
    told = {n: F.col(n) for n in FEATURES if n in pairs.columns and n != "tfidf_rank"} | {
        "addr_exact_clean": one((q("address") != "") & (q("address") == s("address"))),
        "addr_token_jaccard": of("words_", "address_set"),
        "addr_token_overlap_coeff": F.when(least > 0, F.col("words_") / least).otherwise(0.0),
        "addr_char_ngram_cosine": F.least(F.lit(1.0), cosine),
        "addr_numeric_exact_match": one((F.size(q("number_set")) > 0) & (q("number_set") == s("number_set"))),
        "addr_numeric_jaccard": of("numbers_", "number_set"),
        "addr_postal_match": F.when(q("postal").isNotNull() & s("postal").isNotNull(), one(q("postal") == s("postal"))).when(q("postal").isNull() & s("postal").isNull(), 0.0).otherwise(-1.0),
        "addr_is_missing_either": one((q("address") == "") | (s("address") == "")),
        "country_exact_match": one((q("country") != "") & (F.upper(q("country")) == F.upper(s("country")))),
    }
    told |= _of_blocks(set(pairs.columns))
    told |= _interactions(told)
    return rows.select("s1_id", "target_id", *[c for c in pairs.columns if c in keep], *[final(n, told[n]).alias(n) for n in FEATURES])


WHOLE = [n for n in FEATURES if n.endswith(("_exact", "_clean", "_match", "_rank", "_count", "_either")) or n.startswith(("is_", "source_", "retriev"))]  # of whole numbers


def rounded(c: Column, digits: int) -> Column:
    """F.round of a double; off ties, where it can't matter, without the decimals that F.round goes through."""
    x = c * 10.0**digits
    off = F.abs(x - F.floor(x) - 0.5) > 1e-3
    return F.when(off & (F.abs(x) < 1e10), F.floor(x + 0.5) / 10.0**digits).otherwise(F.round(c, digits))


def token_idf(records: DataFrame, n: int) -> DataFrame:
    """token, idf of name tokens over a corpus of n records."""
    words = records.select("entity_id", F.explode(F.array_distinct("name_tokens")).alias("token"))
    return words.groupBy("token").agg((F.log((1.0 + n) / (1.0 + F.count("*"))) + 1.0).alias("idf"))


def pair_features(pairs: DataFrame, enriched: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """pairs (s1_id, target_id, provenance columns where known) with the 43 features.

    idf: token, idf; tokens it lacks count as rare. Tokens meet it before the pair join, once a record.
    """
    records = with_grams(enriched)
    if idf is not None:
        words = records.select("entity_id", F.explode(F.array_distinct("name_tokens")).alias("token")).join(idf, "token")
        per = words.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("token_idf"))
        records = records.join(per, "entity_id", "left")
    else:
        records = records.withColumn("token_idf", F.lit(None).cast("map<string,double>"))
    fields = [*_FIELDS, "name_grams", "address_grams", "latin_grams", "token_idf"]
    side = lambda p, key: records.select(F.col("entity_id").alias(key), *[F.col(f).alias(f"{p}_{f}") for f in fields])
    return _features(pairs.join(side("q", "s1_id"), "s1_id").join(side("t", "target_id"), "target_id"), pairs.columns)


def carried_features(pairs: DataFrame, keep: tuple[str, ...] = ("label", "hit")) -> DataFrame:
    """The 43 features of pairs that bring both records' columns along (carried); no token has a known idf.
    Columns of keep stay where pairs have them."""
    known = [c for c in pairs.columns if c[:2] not in ("q_", "t_")]
    none = F.lit(None).cast("map<string,double>")
    latin = {f"{p}_latin_grams": F.when(F.col(f"{p}_is_indic"), F.col(f"{p}_latin_grams")).otherwise(F.col(f"{p}_name_grams")) for p in "qt"}
    return _features(pairs.withColumns(latin | {"q_token_idf": none, "t_token_idf": none}), known, keep)


def _features(rows: DataFrame, given_columns: list[str], keep: tuple[str, ...] = ("label", "hit")) -> DataFrame:
    q, s = (lambda f: F.col(f"q_{f}")), (lambda f: F.col(f"t_{f}"))
    one = lambda c: c.cast("double")
    same = lambda f: one((q(f) != "") & (q(f) == s(f)))
    postals = F.when((F.size(q("postals")) > 0) & (F.size(s("postals")) > 0), one(q("postals")[0] == s("postals")[0])).when((F.size(q("postals")) == 0) & (F.size(s("postals")) == 0), 0.0).otherwise(-1.0)
    numbers = F.array_sort(F.array_distinct(q("numbers"))) == F.array_sort(F.array_distinct(s("numbers")))
    rows = rows.withColumns(_of_names(q, s) | {
        "addr_exact_clean": same("address"),
        "addr_token_jaccard": t.jaccard(q("address_tokens"), s("address_tokens")),
        "addr_token_overlap_coeff": t.overlap(q("address_tokens"), s("address_tokens")),
        "addr_char_ngram_cosine": F.least(F.lit(1.0), t.gram_cosine(q("address"), s("address"), q("address_grams"), s("address_grams"))),
        "addr_numeric_exact_match": one((F.size(q("numbers")) > 0) & numbers),
        "addr_numeric_jaccard": t.jaccard(q("numbers"), s("numbers")),
        "addr_postal_match": postals,
        "addr_is_missing_either": one((q("address") == "") | (s("address") == "")),
        "country_exact_match": one((q("country") != "") & (F.upper(q("country")) == F.upper(s("country")))),
    })
    told = _of_blocks(set(given_columns))
    rows = rows.withColumns({f"{n}_" if n == "tfidf_rank" else n: c for n, c in told.items()})
    rows = rows.drop("tfidf_rank").withColumnRenamed("tfidf_rank_", "tfidf_rank")
    rows = rows.withColumns(_interactions({n: F.col(n) for n in FEATURES}))
    return rows.select("s1_id", "target_id", *[c for c in given_columns if c in keep], *FEATURES)


def _of_names(q, s) -> dict[str, Column]:
    """The features that names alone decide; q and s give either record's field."""
    one = lambda c: c.cast("double")
    same = lambda f: one((q(f) != "") & (q(f) == s(f)))
    shorter, longer = F.least(F.length(q("name")), F.length(s("name"))), F.greatest(F.length(q("name")), F.length(s("name")))
    differ = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: (F.substring(q("name"), i, F.lit(1)) == F.substring(s("name"), i, F.lit(1)))), False)
    prefix = F.when(differ == 0, shorter).otherwise(differ - 1)
    latin = lambda p: F.when(p("is_indic"), p("latin_name")).otherwise(p("name"))
    cross = q("is_indic") != s("is_indic")
    words = lambda c: t.tokens(c)
    shared = F.array_intersect(q("name_tokens"), s("name_tokens"))
    idfs = F.transform(shared, lambda w: F.coalesce(F.try_element_at(s("token_idf"), w), F.try_element_at(q("token_idf"), w), F.lit(UNSEEN_IDF)))
    return {
        "name_exact_clean": same("name"),
        "name_compact_exact": same("compact"),
        "name_token_jaccard": t.jaccard(q("name_tokens"), s("name_tokens")),
        "name_token_overlap_coeff": t.overlap(q("name_tokens"), s("name_tokens")),
        "name_char_ngram_cosine": F.least(F.lit(1.0), t.gram_cosine(q("name"), s("name"), q("name_grams"), s("name_grams"))),
        "name_edit_similarity": t.levenshtein_ratio(q("name"), s("name")),
        "name_prefix_match_len": F.when(shorter > 0, prefix / shorter).otherwise(0.0),
        "name_length_ratio": F.when(longer > 0, shorter / longer).otherwise(0.0),
        "name_first_token_match": one(F.coalesce(F.get(q("name_tokens"), 0) == F.get(s("name_tokens"), 0), F.lit(False))),
        "name_sorted_token_jaccard": t.jaccard(words(q("sorted_name")), words(s("sorted_name"))),
        "is_cross_script_pair": one(cross),
        "translit_name_token_jaccard": F.when(cross, t.jaccard(words(latin(q)), words(latin(s)))).otherwise(0.0),
        "translit_name_char_ngram_cosine": F.when(cross, F.least(F.lit(1.0), t.gram_cosine(latin(q), latin(s), q("latin_grams"), s("latin_grams")))).otherwise(0.0),
        "is_domain_name_pair": one(F.lower(F.concat_ws(" ", q("business_name"), s("business_name"))).rlike(r"\.|com")),
        "domain_compact_match": same("domain"),
        "leetspeak_exact_match": same("leet"),
        "accent_stripped_match": same("bare_name"),
        "shared_rare_token_count": F.size(F.filter(idfs, lambda x: x >= RARE_IDF)).cast("double"),
        "min_shared_token_idf": F.coalesce(F.array_min(idfs), F.lit(0.0)),
    }


def _of_blocks(known: set[str]) -> dict[str, Column]:
    """The features of ids and of what found a pair; known: the columns there are."""
    given = lambda c, default: F.coalesce(F.col(c).cast("double"), F.lit(default)) if c in known else F.lit(default)
    return {
        "source_is_s2": F.col("target_id").startswith("S2-").cast("double"),
        "source_is_s3": F.col("target_id").startswith("S3-").cast("double"),
        "retrieval_support_count": given("support_count", 1.0),
        **{f"retrieved_by_{b}": given(b, 0.0) for b in ("exact_name", "sorted_name", "name_numeric", "char_ngram", "domain", "tfidf")},
        "tfidf_similarity_score": given("tfidf_score", 0.0),
        "tfidf_rank": given("tfidf_rank", 1000.0),
    }


def _interactions(f: dict[str, Column]) -> dict[str, Column]:
    return {
        "inter_name_x_addr_jaccard": f["name_token_jaccard"] * f["addr_token_jaccard"],
        "inter_name_exact_x_addr_jaccard": f["name_exact_clean"] * f["addr_token_jaccard"],
        "inter_name_jaccard_x_country": f["name_token_jaccard"] * f["country_exact_match"],
        "inter_support_x_name_jaccard": F.log1p(f["retrieval_support_count"]) * f["name_token_jaccard"],
    }


def clean(c: Column) -> Column:
    """NaN and null become 0, infinities 1 and -1."""
    return F.when(F.isnan(c) | c.isNull(), 0.0).when(c == float("inf"), 1.0).when(c == float("-inf"), -1.0).otherwise(c)


def sanitized(features: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """names, clean."""
    return features.withColumns({c: clean(F.col(c)) for c in names})


def max_difference(a: DataFrame, b: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """pairs compared and the largest absolute difference of two feature tables."""
    rows = a.alias("a").join(b.alias("b"), ["s1_id", "target_id"])
    return rows.agg(F.count("*").alias("pairs"), F.coalesce(F.max(F.greatest(*[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in names])), F.lit(0.0)).alias("max_abs_diff"))


def max_difference_by_query(a: DataFrame, b: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """max_difference of tables without repeated pairs. Queries are compared by count and 128 bits of their
    rows' hashes; only those that differ have their pairs joined, so equal tables shuffle no pair."""

    def digests(rows: DataFrame, p: str) -> DataFrame:
        h = [F.bit_xor(F.xxhash64(F.lit(k), "target_id", *names)) for k in range(2)]
        return rows.groupBy("s1_id").agg(F.count("*").alias("n"), F.struct(F.count("*"), *h).alias(p))

    both = stored(digests(a, "a").join(digests(b, "b").drop("n"), "s1_id"), "digests")
    odd = both.where("a <> b").select("s1_id")
    same = both.where("a = b").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.lit(0.0).alias("max_abs_diff"))
    if not odd.isEmpty():
        same = same.unionByName(max_difference(a.join(odd, "s1_id", "left_semi"), b.join(odd, "s1_id", "left_semi"), names))
    return same.agg(F.sum("pairs").alias("pairs"), F.max("max_abs_diff").alias("max_abs_diff"))
