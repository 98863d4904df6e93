"""Column functions on names and addresses: normalisation, tokens, signatures, similarities.

Everything is built from Spark SQL functions but for two Unicode operations Spark lacks (NFKC, and
NFKD without marks), which are Arrow-batched pandas UDFs with an ASCII shortcut.
Enrich records once (see operators.records), not pairs.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .brahmic import latin

# Legal forms dropped from names.
LEGAL_FORMS = (
    "inc incorporated corp corporation co company llc llp ltd limited lp plc enterprises holdings "
    "group services solutions international intl industries pvt private proprietorship partnership "
    "sarl sas sasu sa eurl snc scop ste societe gie"
).split()
# Forms dropped from compact signatures besides.
EXTENDED_LEGAL_FORMS = LEGAL_FORMS + "pc esq esquire dr md phd pllc".split()
# Words too common in business names to block on.
GENERIC_WORDS = (
    "enterprises enterprise solutions solution services service industries industry holdings holding group groups "
    "international intl global national standard general products product trading commercial technologies technology "
    "consulting consultancy management logistics associates associate india indian corporation corp company co limited ltd "
    "private pvt inc llc llp center centre ventures systems system traders agency agencies impex"
).split()
# Domain endings, in order of trial.
DOMAIN_ENDINGS = ".co.in .com.au .co.uk .com .org .net .in .io .co .biz .info .us .tv .cc .fr .de .eu .online .tech .store .site .group .global .cloud".split()
# Romanised corporate words.
ROMANISED_FORMS = "praaivet praivet limitted limited intrpraaijhis enterprises kampanee company".split()
#: Word boundaries as Python sees them: letters, digits and underscore of any script.
_NOT_AFTER, _NOT_BEFORE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """NFKD without combining marks."""
    bare = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    return s.map(lambda x: x if x is None or x.isascii() else bare(x))


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(_text(c), r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def lower(c: Column) -> Column:
    return F.lower(_text(c))


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(_text(c), r"[^\p{L}\p{N}_\s]", " ")


def alphanumeric(c: Column) -> Column:
    return collapse(remove_punctuation(c))


def standard_clean(c: Column | str) -> Column:
    possessive = F.regexp_replace(F.lower(nfkc(_text(c))), "['’]s" + _NOT_BEFORE, "")
    return alphanumeric(possessive)


def tokens(clean: Column) -> Column:
    return F.filter(F.split(_text(clean), " "), lambda x: x != "")


def sorted_tokens(clean: Column) -> Column:
    return F.array_join(F.array_sort(tokens(clean)), " ")


def strip_legal(clean: Column) -> Column:
    """Drops legal forms anywhere in a cleaned name."""
    forms = F.array(*map(F.lit, LEGAL_FORMS))
    return F.array_join(F.filter(tokens(clean), lambda x: ~F.array_contains(forms, x)), " ")


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Every run of n characters, in time that grows with the text: one pattern looks ahead from each place."""
    s = F.replace(_text(c), F.lit(" "), F.lit(""))
    grams = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.when(s == "", F.array().cast("array<string>")).when(F.length(s) < n, F.array(s)).otherwise(grams)


def token_ngrams(words: Column, n: int = 2) -> Column:
    # the words as a variable: worked out once, not at every place
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.transform(F.array(words), lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(grams(w)))[0]


def informative_tokens(words: Column) -> Column:
    """Tokens of three letters or more that aren't generic; all of them if none is left."""
    generic = F.array(*map(F.lit, GENERIC_WORDS))
    kept = F.filter(words, lambda x: ~F.array_contains(generic, x) & (F.length(x) >= 3))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def is_missing(c: Column | str) -> Column:
    return F.trim(_text(c)) == ""


def postal_codes(raw: Column) -> Column:
    return F.regexp_extract_all(_text(raw), F.lit(_NOT_AFTER + r"\p{Nd}{5,6}" + _NOT_BEFORE), F.lit(0))


def numeric_tokens(raw: Column) -> Column:
    return F.regexp_extract_all(_text(raw), F.lit(_NOT_AFTER + r"\p{Nd}+" + _NOT_BEFORE), F.lit(0))


def numeric_compounds(raw: Column) -> Column:
    """House and plot numbers such as 70c/4g; single digits only where nothing else is there."""
    first = F.regexp_extract_all(_text(raw), F.lit(_NOT_AFTER + r"\p{Nd}+[a-zA-Z]?(?:[/-]\p{Nd}+[a-zA-Z]?)*" + _NOT_BEFORE), F.lit(0))
    then = F.regexp_extract_all(_text(raw), F.lit(_NOT_AFTER + r"[A-Za-z]\p{Nd}+" + _NOT_BEFORE), F.lit(0))
    found = F.transform(F.concat(first, then), F.lower)
    long = F.filter(found, lambda x: (F.length(x) >= 2) | x.contains("/") | x.contains("-"))
    return F.when(F.size(long) > 0, long).otherwise(found)


def domain_words(raw: Column | str) -> Column:
    """A web name as words: scheme, www., one ending and a glued com go."""
    s = F.regexp_replace(F.regexp_replace(F.trim(F.lower(_text(raw))), "^https?://", ""), r"^www\.", "")
    s = F.regexp_replace(s, "(?:" + "|".join(e.replace(".", r"\.") for e in DOMAIN_ENDINGS) + r")\z", "")
    s = F.when(s.endswith("com") & (F.length(s) > 7), F.substring(s, F.lit(1), F.length(s) - 3)).otherwise(s)
    return collapse(F.regexp_replace(s, r"[-_./]+", " "))


def _compact(bare: Column, drop: list[str], least: int) -> Column:
    words = F.regexp_extract_all(bare, F.lit("[a-z0-9]+"), F.lit(0))
    if drop:
        forms = F.array(*map(F.lit, drop))
        words = F.filter(words, lambda x: ~F.array_contains(forms, x))
    joined = F.array_join(words, "")
    return F.when(F.length(joined) >= least, joined).otherwise("")


def domain_signature(raw: Column | str, least: int = 5) -> Column:
    return _compact(F.lower(strip_accents(domain_words(raw))), EXTENDED_LEGAL_FORMS, least)


def leetspeak_text(raw: Column | str) -> Column:
    """Digits 0 and 5 within or at the edge of words read as o and s."""
    s = strip_accents(F.lower(_text(raw)))
    for digit, letter in (("0", "o"), ("5", "s")):
        s = F.regexp_replace(s, f"(?<=[a-z]){digit}(?=[a-z])", letter)
        s = F.regexp_replace(s, f"(?<=[a-z]){digit}" + _NOT_BEFORE, letter)
        s = F.regexp_replace(s, _NOT_AFTER + digit + "(?=[a-z]{2,})", letter)
    return collapse(F.regexp_replace(s, r"[-_.]+", " "))


def leetspeak_signature(raw: Column | str, least: int = 4) -> Column:
    return _compact(leetspeak_text(raw), [], least)


def has_indic(raw: Column | str) -> Column:
    return _text(raw).rlike(r"[\x{0900}-\x{0D7F}]")


def romanised(raw: Column | str) -> Column:
    """Brahmic scripts in Latin letters; other characters stay, punctuation goes."""
    s = _text(raw)
    return alphanumeric(F.lower(F.when(has_indic(s), latin(s)).otherwise(s)))


def indic_signature(raw: Column | str, least: int = 4) -> Column:
    """Compact romanised name without corporate words; empty for names in other scripts."""
    plain = F.regexp_replace(romanised(_text(raw)), _NOT_AFTER + "(?:" + "|".join(ROMANISED_FORMS) + ")" + _NOT_BEFORE, "")
    return F.when(has_indic(raw), _compact(plain, [], least)).otherwise("")


def levenshtein_ratio(a: Column, b: Column, most: int = 50) -> Column:
    """1 - distance / longer length, on prefixes of most characters."""
    x, y = F.substring(a, 1, most), F.substring(b, 1, most)
    ratio = 1.0 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(ratio)


def gram_counts(c: Column, n: int = 3) -> Column:
    """Counts of a text's n-grams as a map; compute once a record."""
    grams = char_ngrams(c, n)
    distinct = F.array_distinct(grams)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda g: F.size(F.filter(grams, lambda x: x == g)).cast("double")))


def gram_cosine(a: Column, b: Column, counts_a: Column, counts_b: Column, n: int = 3) -> Column:
    """Cosine of two texts' n-gram counts; texts shorter than n are equal or not."""
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda t, x: t + x * x)
    dot = F.aggregate(F.map_keys(counts_a), F.lit(0.0), lambda t, k: t + F.try_element_at(counts_a, k) * F.coalesce(F.try_element_at(counts_b, k), F.lit(0.0)))
    bare_a, bare_b = (F.replace(x, F.lit(" "), F.lit("")) for x in (a, b))
    short = (F.length(bare_a) < n) | (F.length(bare_b) < n)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(short, (bare_a == bare_b).cast("double")).otherwise(dot / F.sqrt(square(counts_a) * square(counts_b)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)
