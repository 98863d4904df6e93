"""Scalar functions on literal cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave.functions import text as t


def values(spark, make, *inputs):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, s string")
    out = [r.v for r in df.select("k", make(F.col("s")).alias("v")).orderBy("k").collect()]
    return out[0] if len(out) == 1 else out


def test_cleaning(spark):
    assert values(spark, t.standard_clean, "  Acme,   Inc. & Sons (Trading) \t", "Orelee's Barbershop", "ＡＢＣ_x", None) == ["acme inc sons trading", "orelee barbershop", "abc_x", ""]
    clean = spark.createDataFrame([("reliance industries private limited",), ("national state bank of india",)], "s string")
    assert [r[0] for r in clean.select(t.strip_legal(F.col("s"))).collect()] == ["reliance", "national state bank of india"]
    assert [r[0] for r in clean.select(t.sorted_tokens(F.col("s"))).collect()][1] == "bank india national of state"


def test_grams_and_tokens(spark):
    assert values(spark, lambda s: t.char_ngrams(s, 3), "acme", "ab", "") == [["acm", "cme"], ["ab"], []]
    df = spark.createDataFrame([("a b c",), ("a",), ("",)], "s string")
    assert [r[0] for r in df.select(t.token_ngrams(t.tokens(F.col("s")), 2)).collect()] == [["a b", "b c"], ["a"], []]
    df = spark.createDataFrame([("tata global motors",), ("global services",)], "s string")
    assert [r[0] for r in df.select(t.informative_tokens(t.tokens(F.col("s")))).collect()] == [["tata", "motors"], ["global", "services"]]


def test_addresses(spark):
    a = "KH NO. -570/13, NEW DELHI 110059, Plot 42"
    assert values(spark, t.postal_codes, a) == ["110059"]
    assert values(spark, t.numeric_tokens, a) == ["570", "13", "110059", "42"]
    assert "70c/4g" in values(spark, t.numeric_compounds, "Plot No 70C/4G, Chhota Baghara")
    assert values(spark, t.numeric_compounds, "Flat 1", "P-88 A7") == [["1"], ["88", "a7"]]
    assert values(spark, t.is_missing, " ", "x", None) == [True, False, True]


def test_domains(spark):
    assert values(spark, t.domain_words, "foo-bar.com", "https://www.pacificalliance.com", "solancemicroelectronicscom", "shop.co.in", "telcom") == ["foo bar", "pacificalliance", "solancemicroelectronics", "shop", "telcom"]
    assert values(spark, lambda s: t.domain_signature(s, 5), "Pacific Alliance PC", "Indutrust.Com", "abc") == ["pacificalliance", "indutrust", ""]


def test_spelling(spark):
    assert values(spark, t.leetspeak_text, "2-P0int", "Fa5t Solutions", "R0") == ["2 point", "fast solutions", "ro"]
    assert values(spark, t.leetspeak_signature, "2-Point", "2-P0int", "2-Póint", "ab") == ["2point", "2point", "2point", ""]
    assert values(spark, t.strip_accents, "Société Générale", "plain") == ["Societe Generale", "plain"]


def test_scripts(spark):
    assert values(spark, t.has_indic, "नॉर्थ", "தமிழ்", "ಕನ್ನಡ", "Latin") == [True, True, True, False]
    assert values(spark, t.romanised, "राम", "कमल", "Acme, Ltd") == ["rama", "kamala", "acme ltd"]
    assert values(spark, t.indic_signature, "कमल राम", "Acme") == ["kamalarama", ""]


def test_similarities(spark):
    df = spark.createDataFrame([("Apex", "Ape"), ("Apex", "Zyzz"), ("", ""), ("a", "")], "a string, b string")
    lev = [r[0] for r in df.select(t.levenshtein_ratio(F.col("a"), F.col("b"))).collect()]
    assert lev[0] > 0.70 and lev[1] < 0.30 and lev[2:] == [1.0, 0.0]
    df = spark.createDataFrame([("abcd", "abce"), ("ab", "ab "), ("", "x"), ("abab abab", "ababa")], "a string, b string")
    cos = [r[0] for r in df.select(t.gram_cosine(F.col("a"), F.col("b"), t.gram_counts(F.col("a")), t.gram_counts(F.col("b")))).collect()]
    assert abs(cos[0] - 0.5) < 1e-9 and cos[1:3] == [1.0, 0.0] and 0.9 < cos[3] < 1
