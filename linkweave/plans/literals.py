"""Queries over literal rows, for scripts and spellings that the driver's tables lack.

Each case states its input and the value the definition gives; the SQL is the table of the latter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import blocking, features, metrics
from ..operators.records import enrich, queries_of, targets_of

_CASES = {
    "t1_has_indic_literals": (lambda: t.has_indic("s").cast("string"), [("नॉर्थ", "true"), ("தமிழ்", "true"), ("ಕನ್ನಡ", "true"), ("বাংলা", "true"), ("ਪੰਜਾਬ", "true"), ("മലയാളം", "true"), ("Latin", "false"), ("", "false")]),
    "t2_transliterate_literals": (lambda: t.romanised("s"), [("कमल", "kamala"), ("राम", "rama"), ("हिन्दी", "hindee"), ("Acme, Ltd.", "acme ltd"), ("", "")]),
    "t3_indic_signature_literals": (lambda: t.indic_signature("s"), [("कमल राम", "kamalarama"), ("कम", "kama"), ("क", ""), ("Acme", "")]),
    "l2_leetspeak_literals": (lambda: t.leetspeak_text("s"), [("2-P0int", "2 point"), ("Fa5t Solutions", "fast solutions"), ("R0", "ro"), ("0ak Tree", "oak tree"), ("1005", "1005"), ("Café 5tar", "cafe star")]),
    "l3_leetspeak_signature_literals": (lambda: t.leetspeak_signature("s"), [("2-Point", "2point"), ("2-P0int", "2point"), ("2-Póint", "2point"), ("ab", "")]),
    "d1_domain_literals": (lambda: t.domain_words("s"), [("foo-bar.com", "foo bar"), ("https://www.pacificalliance.com", "pacificalliance"), ("solancemicroelectronicscom", "solancemicroelectronics"), ("telcom", "telcom"), ("shop.co.in", "shop")]),
    "d2_signature_literals": (lambda: t.domain_signature("s", 5), [("Pacific Alliance PC", "pacificalliance"), ("Indutrust.Com", "indutrust"), ("Indu Trust", "indutrust"), ("abc", "")]),
    "n6_standard_clean_literals": (lambda: t.standard_clean("s"), [("  Acme,   Inc. & Sons (Trading) \t", "acme inc sons trading"), ("Orelee's Barbershop", "orelee barbershop"), ("ＡＢＣ", "abc"), ("", "")]),
    "a3_postal_literals": (lambda: F.array_join(t.postal_codes("s"), ","), [("KH NO. -570/13, NEW DELHI 110059", "110059"), ("a1234567 12345x 54321", "54321"), ("", "")]),
    "a6_compound_literals": (lambda: F.array_join(t.numeric_compounds("s"), ","), [("Plot No 70C/4G, Ward 1", "70c/4g"), ("Flat 1", "1"), ("P-88 A7", "88,a7")]),
}


def _literal(make, cases):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(cases)], "k int, s string")
        return rows.select("k", make().alias("value"))

    return run


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _table(columns: str, rows: list[tuple]) -> str:
    values = ", ".join("(" + ", ".join(_sql_text(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {values}) AS x({columns})"


QUERIES = {n: _literal(make, cases) for n, (make, cases) in _CASES.items()}
ORACLES = {n: _table("k, value", [(k, v) for k, (_, v) in enumerate(cases)]) for n, (_, cases) in _CASES.items()}

_RECORDS = [
    ("S1-1", "Kamal Rama", "12 x 110059", "India"), ("S2-1", "कमल राम", "12 x 110059", "India"), ("S2-2", "कमल राम", "99 y", "India"),
    ("S1-2", "Fa5t P0int", "", "US"), ("S3-2", "Fast Point", "", "US"), ("S3-3", "Other Name", "12 x 110059", "US"),
]


def _blocked(*blocks):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = enrich(spark.createDataFrame(_RECORDS, "entity_id string, business_name string, business_address string, country string"))
        return blocking.hits(queries_of(rows), targets_of(rows), list(blocks)).distinct()

    return run


QUERIES["b13_cross_script_literals"] = _blocked(*blocking.cross_script())
ORACLES["b13_cross_script_literals"] = _table("block, s1_id, target_id", [("indic_address", "S1-1", "S2-1"), ("transliteration", "S1-1", "S2-1"), ("transliteration", "S1-1", "S2-2")])
QUERIES["b15_leetspeak_literals"] = _blocked(blocking.leetspeak_block())
ORACLES["b15_leetspeak_literals"] = _table("block, s1_id, target_id", [("leetspeak", "S1-2", "S3-2")])

_PLACES = [
    ("S1-1", "Acme Tools Ltd", "Plot 7, Delhi 110059", "India"), ("S2-1", "Acme Works", "Delhi 110059", "India"), ("S3-1", "Other Works", "12 Main 110059", "India"),
    ("S1-2", "Beta", "Paris 75001", "France"), ("S2-2", "Beta SARL", "75001 Paris", "France"), ("S3-2", "Beta", "Paris 7500", "France"), ("S3-3", "Beta", "75001", "US"),
]
_PLACE_LINKS = [("S1-1", "S2-1"), ("S1-2", "S3-2"), ("S1-2", "S2-2")]


def _placed(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = enrich(spark.createDataFrame(_PLACES, "entity_id string, business_name string, business_address string, country string"))
        return make(spark, queries_of(rows), targets_of(rows))

    return run


QUERIES["b6_postal_literals"] = _placed(lambda spark, q, t: blocking.candidates(q, t, [blocking.postal_code()]))
ORACLES["b6_postal_literals"] = _table("s1_id, target_id", [("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-2"), ("S1-2", "S3-3")])
QUERIES["b7_name_postal_literals"] = _placed(lambda spark, q, t: blocking.candidates(q, t, [blocking.name_postal()]))
ORACLES["b7_name_postal_literals"] = _table("s1_id, target_id", [("S1-1", "S2-1"), ("S1-2", "S2-2")])
QUERIES["j3_misses_literals"] = _placed(lambda spark, q, t: metrics.missed(spark.createDataFrame(_PLACE_LINKS, "s1_id string, target_id string"), blocking.candidates(q, t, [blocking.postal_code()])))
ORACLES["j3_misses_literals"] = _table("s1_id, target_id", [("S1-2", "S3-2")])

_ISOLATED = [
    ("S1-1", "Acme Widgets Global LLC", "100 Innovation Way", "US"), ("S1-2", "Bharat Bio Solutions Ltd", "45 Gandhi Road", "IN"), ("S1-3", "Cyberdyne Systems France SAS", "12 Rue de Paris", "FR"),
    ("S2-1", "Acme Widgets Global", "100 Innovation Way", "US"), ("S3-2", "Bharat Bio Solutions", "45 Gandhi Road", "IN"), ("S2-3", "Cyberdyne Systems France", "12 Rue de Paris", "FR"), ("S3-9", "Totally Unrelated Bakery", "99 Market Street", "US"),
]


def _isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query finds its own target and no other's, in a run with the others as alone."""
    rows = enrich(spark.createDataFrame(_ISOLATED, "entity_id string, business_name string, business_address string, country string"))
    return blocking.candidates(queries_of(rows), targets_of(rows), [blocking.exact_name(), blocking.sorted_name()])


QUERIES["v5_query_isolation"] = _isolation
ORACLES["v5_query_isolation"] = _table("s1_id, target_id", [("S1-1", "S2-1"), ("S1-2", "S3-2"), ("S1-3", "S2-3")])

# one pair with known values of all 43 features
_GOLDEN = [("S1-A", "Acme Widgets Global", "123 Main St", "US"), ("S2-B", "Acme Widgets Global", "123 Main Street", "US")]
_GOLDEN_VALUES = [1.0] * 10 + [0.0, 0.5, 0.666667, 0.797724, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 3.0, 5.0, 3.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.88, 1.0, 0.5, 0.5, 1.0, 1.386294]


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich(spark.createDataFrame(_GOLDEN, "entity_id string, business_name string, business_address string, country string"))
    pair = spark.sql("""SELECT 'S1-A' AS s1_id, 'S2-B' AS target_id, true AS exact_name, true AS sorted_name, false AS name_numeric, false AS char_ngram, true AS domain,
      true AS tfidf, 0.88D AS tfidf_score, 1 AS tfidf_rank, 3 AS support_count""")
    got = features.pair_features(pair, rows)
    return got.select(F.posexplode(F.array(*[F.round(F.col(n).cast("double"), 6) for n in features.FEATURES])).alias("k", "value"))


QUERIES["g24_golden_features"] = _golden
ORACLES["g24_golden_features"] = "SELECT k, CAST(value AS DOUBLE) AS value FROM (" + _table("k, value", list(enumerate(_GOLDEN_VALUES))) + ")"
