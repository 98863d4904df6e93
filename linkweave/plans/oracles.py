"""The linkage queries in plain SQL, written from the definitions for another engine to check."""

from __future__ import annotations

from ..functions.text import DOMAIN_ENDINGS, EXTENDED_LEGAL_FORMS, GENERIC_WORDS, LEGAL_FORMS


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _clean(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(nfc_normalize({c})), '[''’]s\b', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


def _domain(c: str) -> str:
    bare = rf"regexp_replace(regexp_replace(regexp_replace(trim(lower({c})), '^https?://', ''), '^www\.', ''), '({'|'.join(e.replace('.', chr(92) + '.') for e in DOMAIN_ENDINGS)})$', '')"
    com = f"CASE WHEN ({bare}) LIKE '%com' AND length({bare}) > 7 THEN left({bare}, length({bare}) - 3) ELSE {bare} END"
    return rf"trim(regexp_replace(regexp_replace({com}, '[-_./]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _signature(c: str, least: int) -> str:
    joined = f"array_to_string(list_filter(regexp_extract_all(lower(strip_accents({_domain(c)})), '[a-z0-9]+'), lambda w: NOT list_contains({_list(EXTENDED_LEGAL_FORMS)}, w)), '')"
    return f"CASE WHEN length({joined}) >= {least} THEN {joined} ELSE '' END"


_ID = "'S' || CAST(1 + doc_id % 3 AS VARCHAR) || '-' || CAST(doc_id AS VARCHAR)"
_NUMBERS = r"\b\d+\b"
_PLOTS = r"\b\d+[a-zA-Z]?(?:[/-]\d+[a-zA-Z]?)*\b"

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def _cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql, needs)


_cte("rec", f"""SELECT {_ID} AS entity_id, array_to_string(list_slice(string_split(split_part(text, chr(10), 1), ' '), 1, 6), ' ') AS business_name,
  source || ' ' || CAST(n_chars AS VARCHAR) AS business_address, lang AS country, md5(text) AS h FROM documents""")
# whole texts as names
_cte("txt", f"SELECT {_ID} AS entity_id, text AS business_name, source || ' ' || CAST(n_chars AS VARCHAR) AS business_address FROM documents")
_cte("txt_clean", f"SELECT *, {_clean('business_name')} AS clean_name, {_clean('business_address')} AS address FROM txt", "txt")
_cte("txt_name", f"SELECT *, list_filter({_words('clean_name')}, lambda w: NOT list_contains({_list(LEGAL_FORMS)}, w)) AS name_tokens FROM txt_clean", "txt_clean")
_cte("te", f"""SELECT *, array_to_string(name_tokens, ' ') AS name, array_to_string(name_tokens, '') AS compact, array_to_string(list_sort(name_tokens), ' ') AS sorted_name,
  CASE WHEN len(list_filter(name_tokens, lambda w: length(w) >= 3 AND NOT list_contains({_list(GENERIC_WORDS)}, w))) > 0
    THEN list_filter(name_tokens, lambda w: length(w) >= 3 AND NOT list_contains({_list(GENERIC_WORDS)}, w)) ELSE name_tokens END AS informative FROM txt_name""", "txt_name")
_cte("cleaned", f"SELECT *, {_clean('business_name')} AS clean_name, {_clean('business_address')} AS address FROM rec", "rec")
_cte("named", f"SELECT *, array_to_string(list_filter({_words('clean_name')}, lambda w: NOT list_contains({_list(LEGAL_FORMS)}, w)), ' ') AS name FROM cleaned", "cleaned")
_cte("full_rec", rf"""SELECT *, {_words('name')} AS name_tokens, array_to_string(list_sort({_words('name')}), ' ') AS sorted_name, replace(name, ' ', '') AS compact,
  {_words('address')} AS address_tokens, regexp_extract_all(business_address, '\b\d{{5,6}}\b') AS postals, regexp_extract_all(business_address, '{_NUMBERS}') AS numbers,
  {_signature('business_name', 4)} AS domain,
  list_transform(list_concat(regexp_extract_all(business_address, '{_PLOTS}'), regexp_extract_all(business_address, '\b[A-Za-z]\d+\b')), lambda p: lower(p)) AS plots0 FROM named""", "named")
_cte("e", f"""SELECT *, CASE WHEN len(list_filter(plots0, lambda p: length(p) >= 2 OR p LIKE '%/%' OR p LIKE '%-%')) > 0
    THEN list_filter(plots0, lambda p: length(p) >= 2 OR p LIKE '%/%' OR p LIKE '%-%') ELSE plots0 END AS plots,
  CASE WHEN len(list_filter(name_tokens, lambda w: length(w) >= 3 AND NOT list_contains({_list(GENERIC_WORDS)}, w))) > 0
    THEN list_filter(name_tokens, lambda w: length(w) >= 3 AND NOT list_contains({_list(GENERIC_WORDS)}, w)) ELSE name_tokens END AS informative FROM full_rec""", "full_rec")
_cte("q", "SELECT * FROM e WHERE entity_id LIKE 'S1-%'", "e")
_cte("t", "SELECT * FROM e WHERE entity_id NOT LIKE 'S1-%'", "e")
_cte("spine", "SELECT entity_id AS s1_id FROM rec WHERE entity_id LIKE 'S1-%'", "rec")
_cte("links", "SELECT a.entity_id AS s1_id, b.entity_id AS target_id FROM rec a JOIN rec b ON a.h = b.h AND a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%'", "rec")


def _capped(target: str, cap: int | None) -> str:
    if cap is None:
        return target
    # a target is within the cap if fewer than cap targets of its key come before it
    return f"SELECT key, entity_id FROM ({target}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY entity_id) <= {cap}"


def _block(query: str, target: str | None = None, cap: int | None = None) -> str:
    """Pairs of one block; query, target: SQL of a list of keys."""
    k = lambda side, keys: f"SELECT DISTINCT key, entity_id FROM (SELECT entity_id, unnest({keys}) AS key FROM {side}) WHERE key <> ''"
    return f"SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS target_id FROM ({k('q', query)}) a JOIN ({_capped(k('t', target or query), cap)}) b ON a.key = b.key"


_BOUNDARY = "[CASE WHEN length(compact) < 4 THEN compact ELSE left(compact, 4) || '::' || right(compact, 4) END]"
_FIRST_LONG = "list_filter(name_tokens, lambda w: length(w) >= 3)[1]"
_EACH = "list_transform(list_distinct({field}), lambda p: {first} || '::' || p)"
_DOMAIN = "[CASE WHEN length(domain) >= {n} THEN domain ELSE '' END]"
_PLACE = "coalesce(postals[1], address_tokens[-1])"

_cte("b1", _block("[name]", cap=1000), "q", "t")
_cte("b2", _block("[sorted_name]", cap=1000), "q", "t")
_cte("b4", _block(_BOUNDARY, cap=1000), "q", "t")
_cte("b4_all", _block(_BOUNDARY), "q", "t")
_cte("b5", _block("[CASE WHEN address <> '' THEN upper(country) || '::' || address ELSE '' END]", cap=1000), "q", "t")
_cte("b6", _block("postals", cap=2000), "q", "t")
_cte("b7", _block(_EACH.format(field="postals", first=f"upper(country) || '::' || {_FIRST_LONG}"), cap=500), "q", "t")
_cte("b8", _block(f"[CASE WHEN {_FIRST_LONG} IS NOT NULL AND len(numbers) > 0 THEN upper(country) || '::' || {_FIRST_LONG} || '::' || numbers[1] ELSE '' END]", cap=500), "q", "t")
_cte("b12", _block(
    "list_concat(CASE WHEN len(informative) > 0 THEN list_transform(plots, lambda p: informative[1] || '::' || p) ELSE [] END, CASE WHEN len(plots) > 0 THEN list_transform(informative, lambda w: w || '::' || plots[1]) ELSE [] END)",
    "flatten(list_transform(list_slice(informative, 1, 2), lambda w: list_transform(plots, lambda p: w || '::' || p)))", 250), "q", "t")
_cte("b14", _block(_DOMAIN.format(n=5)), "q", "t")
_cte("b16", _block(f"CASE WHEN {_PLACE} IS NOT NULL THEN list_transform(list_filter(plots, lambda p: length(p) >= 2), lambda p: upper(country) || '::' || {_PLACE} || '::' || p) ELSE [] END"), "q", "t")
_cte("n_inf", _block("CASE WHEN len(informative) > 0 THEN list_transform(list_distinct(plots), lambda p: informative[1] || '::' || p) ELSE [] END"), "q", "t")
_cte("x_all", _block("[name]"), "q", "t")
_cte("s_all", _block("[sorted_name]"), "q", "t")
_cte("d_all", _block(_DOMAIN.format(n=4)), "q", "t")
_ens = lambda f: _block(f"CASE WHEN length(name_tokens[1]) >= 3 THEN {_EACH.format(field=f, first='name_tokens[1]')} ELSE [] END", cap=500)
_cte("np_ens", _ens("postals"), "q", "t")
_cte("nn_ens", _ens("numbers"), "q", "t")
_cte("b4_500", _block(_BOUNDARY, cap=500), "q", "t")
_cte("ens", "SELECT * FROM x_all UNION SELECT * FROM s_all UNION SELECT * FROM np_ens UNION SELECT * FROM nn_ens UNION SELECT * FROM b4_500", "x_all", "s_all", "np_ens", "nn_ens", "b4_500")
_cte("prov", """SELECT s1_id, target_id, bool_or(b = 'exact_name') AS exact_name, bool_or(b = 'sorted_name') AS sorted_name, bool_or(b = 'name_numeric') AS name_numeric,
  bool_or(b = 'char_ngram') AS char_ngram, bool_or(b = 'domain') AS domain, false AS transliteration, false AS leetspeak, false AS tfidf,
  CAST(0 AS DOUBLE) AS tfidf_score, CAST(1000 AS INTEGER) AS tfidf_rank, CAST(count(DISTINCT b) AS INTEGER) AS support_count
  FROM (SELECT *, 'exact_name' AS b FROM x_all UNION ALL SELECT *, 'sorted_name' FROM s_all UNION ALL SELECT *, 'name_numeric' FROM n_inf
        UNION ALL SELECT *, 'char_ngram' FROM b4_all UNION ALL SELECT *, 'domain' FROM d_all) GROUP BY ALL""", "x_all", "s_all", "n_inf", "b4_all", "d_all")


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


_cte("sides", """SELECT p.*, a.name AS qn, b.name AS tn, a.name_tokens AS qt, b.name_tokens AS tt, a.address_tokens AS qa, b.address_tokens AS ta, a.address AS qd, b.address AS td,
  a.country AS qc, b.country AS tc, a.numbers AS qx, b.numbers AS tx FROM prov p JOIN q a ON p.s1_id = a.entity_id JOIN t b ON p.target_id = b.entity_id""", "prov", "q", "t")
_cte("scored", f"""SELECT s1_id, target_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE * ({_jaccard('qt', 'tt')}) + 0.3::DOUBLE * ({_jaccard('qa', 'ta')})
  + 0.15::DOUBLE * (CASE WHEN qn <> '' AND qn = tn THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + 0.05::DOUBLE * least(support_count::DOUBLE, 3.0::DOUBLE) / 3.0::DOUBLE)), 6) AS score FROM sides""", "sides")
_cte("best", "SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) AS rank, max(score) OVER (PARTITION BY s1_id) AS top FROM scored", "scored")
_cte("margin", "SELECT s1_id, target_id, score, rank FROM best WHERE top >= 0.6::DOUBLE AND (rank = 1 OR (score >= 0.65::DOUBLE AND top - score <= 0.1::DOUBLE AND rank <= 5))", "best")
_cte("per", """SELECT s.s1_id, coalesce(l.n, 0) AS n_true, coalesce(p.n, 0) AS n_pred, coalesce(h.n, 0) AS tp FROM spine s
  LEFT JOIN (SELECT s1_id, count(*) AS n FROM links GROUP BY 1) l ON s.s1_id = l.s1_id LEFT JOIN (SELECT s1_id, count(*) AS n FROM margin GROUP BY 1) p ON s.s1_id = p.s1_id
  LEFT JOIN (SELECT m.s1_id, count(*) AS n FROM margin m JOIN links k ON m.s1_id = k.s1_id AND m.target_id = k.target_id GROUP BY 1) h ON s.s1_id = h.s1_id""", "spine", "links", "margin")
_P = "CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE WHEN n_pred = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / n_pred END"
_R = "CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE WHEN n_true = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / n_true END"
_cte("f05", f"SELECT *, CASE WHEN p + r > 0 THEN 1.25::DOUBLE * p * r / (0.25::DOUBLE * p + r) ELSE 0.0::DOUBLE END AS f FROM (SELECT *, {_P} AS p, {_R} AS r FROM per)", "per")

# TF-IDF
_cte("tok", r"SELECT entity_id AS id, regexp_extract_all(lower(concat_ws(' ', name, address)), '[\p{L}\p{N}_]{2,}') AS w FROM e", "e")
_cte("grams", """SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM tok
  UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tok) GROUP BY ALL""", "tok")
_cte("n_t", "SELECT count(*) AS n FROM t", "t")
_cte("vocab_all", """SELECT term, count(*) AS df, sum(tf) AS total FROM grams WHERE id NOT LIKE 'S1-%' GROUP BY term
  HAVING count(*) >= CASE WHEN (SELECT n FROM n_t) < 50 THEN 1 ELSE 3 END AND count(*) <= CASE WHEN (SELECT n FROM n_t) < 50 THEN 1 ELSE 0.2::DOUBLE END * (SELECT n FROM n_t)""", "grams", "n_t")


def _tfidf(features: int, suffix: str) -> None:
    _cte(f"vocab{suffix}", f"SELECT term, ln((1.0::DOUBLE + (SELECT n FROM n_t)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf FROM vocab_all ORDER BY total DESC, term LIMIT {features}", "vocab_all", "n_t")
    _cte(f"raw{suffix}", f"SELECT id, g.term, (1.0::DOUBLE + ln(tf)) * idf AS w FROM grams g JOIN vocab{suffix} v ON g.term = v.term", "grams", f"vocab{suffix}")
    _cte(f"vec{suffix}", f"SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw{suffix}", f"raw{suffix}")
    _cte(f"sim{suffix}", f"SELECT a.id AS s1_id, b.id AS target_id, round(sum(a.w * b.w), 6) AS score FROM vec{suffix} a JOIN vec{suffix} b ON a.term = b.term AND a.id LIKE 'S1-%' AND b.id NOT LIKE 'S1-%' GROUP BY ALL", f"vec{suffix}")
    _cte(f"top{suffix}", f"SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) AS INTEGER) AS rank FROM sim{suffix} WHERE score > 0", f"sim{suffix}")


_tfidf(20_000, "")
_tfidf(15_000, "15")


_cte("char_text", r"SELECT entity_id AS id, regexp_replace(lower(concat_ws(' ', name, address)), '\s\s+', ' ', 'g') AS s FROM e", "e")
_cte("char_grams", "SELECT id, term, count(*) AS tf FROM (" + " UNION ALL ".join(f"SELECT id, unnest(list_transform(range(1, greatest(length(s) - {n - 2}, 1)), lambda i: substr(s, i, {n}))) AS term FROM char_text" for n in (3, 4)) + ") GROUP BY ALL", "char_text")
_cte("char_vocab", """SELECT term, ln((1.0::DOUBLE + (SELECT n FROM n_t)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM char_grams WHERE id NOT LIKE 'S1-%' GROUP BY term
  HAVING count(*) >= CASE WHEN (SELECT n FROM n_t) < 50 THEN 1 ELSE 2 END AND count(*) <= CASE WHEN (SELECT n FROM n_t) < 50 THEN 1 ELSE 0.5::DOUBLE END * (SELECT n FROM n_t) ORDER BY sum(tf) DESC, term LIMIT 50000""", "char_grams", "n_t")
_cte("char_raw", "SELECT id, g.term, (1.0::DOUBLE + ln(tf)) * idf AS w FROM char_grams g JOIN char_vocab v ON g.term = v.term", "char_grams", "char_vocab")
_cte("char_vec", "SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM char_raw", "char_raw")
_cte("char_top", """SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) AS INTEGER) AS rank FROM (
  SELECT a.id AS s1_id, b.id AS target_id, round(sum(a.w * b.w), 6) AS score FROM char_vec a JOIN char_vec b ON a.term = b.term AND a.id LIKE 'S1-%' AND b.id NOT LIKE 'S1-%' GROUP BY ALL) WHERE score > 0""", "char_vec")


def sql(body: str, *needs: str) -> str:
    """body with the tables it needs in front, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in CTES[name][1]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][0]})" for n in order) + "\n" + body if order else body


ORACLES: dict[str, str] = {}


def _oracle(name: str, body: str, *needs: str) -> None:
    ORACLES[name] = sql(body, *needs)


def _value(name: str, expression: str, source: str = "te") -> None:
    _oracle(name, f"SELECT entity_id, {expression} AS value FROM {source}", source)


def _joined(name: str, expression: str, source: str = "te") -> None:
    _value(name, f"coalesce(array_to_string({expression}, ','), '')", source)


_value("n1_normalize_unicode", "nfc_normalize(business_name)", "txt")
_value("n2_normalize_whitespace", r"trim(regexp_replace(business_name, '\s+', ' ', 'g'))", "txt")
_value("n3_normalize_case", "lower(business_name)", "txt")
_value("n4_remove_punctuation", r"regexp_replace(business_name, '[^\p{L}\p{N}_\s]', ' ', 'g')", "txt")
_value("n5_normalize_alphanumeric", r"trim(regexp_replace(regexp_replace(business_name, '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))", "txt")
_value("n6_standard_clean", "clean_name")
_value("a1_is_address_missing", "trim(business_address) = ''", "txt")
_joined("a2_address_tokens", "address_tokens", "e")
_joined("a3_postal_codes", "postals", "e")
_joined("a4_numeric_tokens", "numbers", "e")
_value("a5_sorted_address", "array_to_string(list_sort(address_tokens), ' ')", "e")
_joined("a6_numeric_compounds", "plots", "e")
_joined("m1_name_tokens", _words("clean_name"))
_value("m2_strip_legal", "name")
_value("m3_sorted_name", "sorted_name")
_joined("m4_char_ngrams", "CASE WHEN compact = '' THEN [] WHEN length(compact) < 3 THEN [compact] ELSE list_transform(range(1, length(compact) - 1), lambda i: substr(compact, i, 3)) END")
_joined("m5_token_ngrams", "CASE WHEN len(name_tokens) = 0 THEN [] WHEN len(name_tokens) = 1 THEN name_tokens ELSE list_transform(range(1, len(name_tokens)), lambda i: name_tokens[i] || ' ' || name_tokens[i + 1]) END")
_joined("m6_informative_tokens", "informative")
ORACLES["d1_domain_words"] = f"SELECT page_id, {_domain('url')} AS value FROM pages"
_value("d2_domain_signature", _signature("business_name", 5), "txt")
_value("l1_strip_accents", "strip_accents(business_name)", "txt")
_value("t1_has_indic", r"regexp_matches(business_name, '[\x{0900}-\x{0D7F}]')", "txt")
_value("t3_indic_signature", "''", "txt")



def _leet(c: str) -> str:
    """Zeros and fives within or at the edge of words as letters; neighbours are matched and put back, twice for those shared."""
    out = f"strip_accents(lower({c}))"
    for digit, letter in (("0", "o"), ("5", "s")):
        for find, put in ((f"([a-z]){digit}([a-z])", rf"\1{letter}\2"), (rf"([a-z]){digit}([^\p{{L}}\p{{N}}_]|$)", rf"\1{letter}\2"), (rf"(^|[^\p{{L}}\p{{N}}_]){digit}([a-z]{{2}})", rf"\1{letter}\2")):
            for _ in range(2):
                out = f"regexp_replace({out}, '{find}', '{put}', 'g')"
    return rf"trim(regexp_replace(regexp_replace({out}, '[-_.]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _leet_signature(c: str, least: int) -> str:
    joined = f"array_to_string(regexp_extract_all({_leet(c)}, '[a-z0-9]+'), '')"
    return f"CASE WHEN length({joined}) >= {least} THEN {joined} ELSE '' END"


_value("l2_leetspeak_text", _leet("business_name"), "txt")
_value("l3_leetspeak_signature", _leet_signature("business_name", 4), "txt")
# no text has Brahmic letters: t1 shows it, so the rest of the definition is left
_value("t2_transliterate", r"trim(regexp_replace(regexp_replace(lower(business_name), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))", "txt")

_NAMES = "FROM b4_all p JOIN q a ON p.s1_id = a.entity_id JOIN t b ON p.target_id = b.entity_id"
_ascii = lambda c: f"regexp_replace(strip_accents({c}), '[^ -~]', '?', 'g')"
_LEV = "1.0::DOUBLE - levenshtein(left({a}, 50), left({b}, 50))::DOUBLE / greatest(length(left({a}, 50)), length(left({b}, 50)))"
_LEVENSHTEIN = "CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE " + _LEV + " END"
_oracle("sim1_levenshtein_ratio", f"SELECT s1_id, target_id, round({_LEVENSHTEIN.format(a=_ascii('a.name'), b=_ascii('b.name'))}, 6) AS value {_NAMES}", "b4_all", "q", "t")
_cte("tri", "SELECT entity_id, g, count(*)::DOUBLE AS n FROM (SELECT entity_id, unnest(list_transform(range(1, greatest(length(compact) - 1, 1)), lambda i: substr(compact, i, 3))) AS g FROM e) GROUP BY ALL", "e")
_cte("norms", "SELECT entity_id, sum(n * n) AS n2 FROM tri GROUP BY 1", "tri")
_cte("dots", "SELECT p.s1_id AS qi, p.target_id AS ti, sum(a.n * b.n) AS dot FROM b4_all p JOIN tri a ON a.entity_id = p.s1_id JOIN tri b ON b.entity_id = p.target_id AND a.g = b.g GROUP BY ALL", "tri", "b4_all")
_oracle("sim2_ngram_cosine", f"""SELECT s1_id, target_id, round(CASE WHEN a.name = '' OR b.name = '' THEN 0.0::DOUBLE WHEN a.name = b.name THEN 1.0::DOUBLE
  WHEN length(a.compact) < 3 OR length(b.compact) < 3 THEN CAST(a.compact = b.compact AS INTEGER)::DOUBLE ELSE coalesce(d.dot, 0.0::DOUBLE) / sqrt(x.n2 * y.n2) END, 6) AS value
  {_NAMES} LEFT JOIN norms x ON x.entity_id = p.s1_id LEFT JOIN norms y ON y.entity_id = p.target_id LEFT JOIN dots d ON d.qi = p.s1_id AND d.ti = p.target_id""", "b4_all", "q", "t", "norms", "dots")

for _name, _table in {"b1_exact_name": "b1", "b2_sorted_token": "b2", "b4_char_boundary": "b4", "b5_exact_address": "b5", "b6_postal_code": "b6", "b7_name_postal": "b7", "b8_name_number": "b8", "b12_informative_number": "b12", "b14_domain": "b14", "b16_alias": "b16"}.items():
    _oracle(_name, f"SELECT s1_id, target_id FROM {_table}", _table)
_INDIC = r"regexp_matches({c}, '[\x{{0900}}-\x{{0D7F}}]')"
_PLACE_OR = "coalesce(postals[1], address_tokens[-1], 'addr')"
_IN = f"list_transform(list_distinct(plots), lambda p: 'IN::' || {_PLACE_OR} || '::' || p)"
_cte("b13_address", _block(f"CASE WHEN upper(country) IN ('IN', 'INDIA') THEN {_IN} ELSE [] END", f"CASE WHEN {_INDIC.format(c='business_name')} THEN {_IN} ELSE [] END"), "q", "t")
# a target without Brahmic letters has no romanised prefix
_cte("b13_prefix", _block("[CASE WHEN length(domain) >= 5 THEN left(domain, 5) ELSE '' END]", f"[CASE WHEN {_INDIC.format(c='business_name')} THEN left(domain, 5) ELSE '' END]"), "q", "t")
_oracle("b13_cross_script", "SELECT * FROM b13_address UNION SELECT * FROM b13_prefix", "b13_address", "b13_prefix")
_cte("leet_keys", f"SELECT entity_id, {_leet_signature('business_name', 4)} AS leet, domain FROM e", "e")
_cte("b15", "SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS target_id FROM leet_keys a JOIN leet_keys b ON a.leet = b.leet AND a.leet <> '' AND a.leet <> a.domain AND a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%'", "leet_keys")
_oracle("b15_leetspeak", "SELECT s1_id, target_id FROM b15", "b15")
_cte("rare_words", "SELECT entity_id, token, pos FROM (SELECT entity_id, unnest(name_tokens) AS token, generate_subscripts(name_tokens, 1) AS pos FROM e) WHERE length(token) >= 3", "e")
_cte("rare_df", "SELECT token, count(DISTINCT entity_id) AS df FROM rare_words WHERE entity_id NOT LIKE 'S1-%' GROUP BY 1", "rare_words")
_cte("rarest", "SELECT w.entity_id, w.token, d.df FROM rare_words w JOIN rare_df d ON w.token = d.token QUALIFY row_number() OVER (PARTITION BY w.entity_id ORDER BY d.df, w.pos) = 1", "rare_words", "rare_df")
_oracle("b3_rare_token", """SELECT a.entity_id AS s1_id, b.entity_id AS target_id FROM rarest a JOIN (SELECT * FROM rarest WHERE entity_id NOT LIKE 'S1-%' AND df <= 1000
  QUALIFY row_number() OVER (PARTITION BY token ORDER BY entity_id) <= 500) b ON a.token = b.token WHERE a.entity_id LIKE 'S1-%'""", "rarest")
_oracle("b9_sparse_tfidf", "SELECT s1_id, target_id, score, rank FROM top WHERE rank <= 25", "top")
_oracle("b9_char_tfidf", "SELECT s1_id, target_id, score, rank FROM char_top WHERE rank <= 25", "char_top")
_oracle("b10_ensemble", "SELECT s1_id, target_id FROM ens UNION SELECT s1_id, target_id FROM top15 WHERE rank <= 25", "ens", "top15")
_oracle("b11_full_corpus", "SELECT s1_id, target_id FROM (SELECT * FROM ens QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY target_id) <= 500) UNION SELECT s1_id, target_id FROM top WHERE rank <= 25", "ens", "top")
_oracle("b17_blocks_only", "SELECT * FROM prov", "prov")


def _arm(name: str, k: int, more: dict[str, str]) -> None:
    """Provenance of the first arm's blocks, of more blocks, and of the k best by TF-IDF."""
    blocks = {"exact_name": "x_all", "sorted_name": "s_all", "name_numeric": "n_inf", "char_ngram": "b4_all", "domain": "d_all", **more}
    rows = " UNION ALL ".join(f"SELECT s1_id, target_id, '{b}' AS b, NULL::DOUBLE AS score, NULL::INTEGER AS rank FROM {c}" for b, c in blocks.items())
    flags = ", ".join(f"bool_or(b = '{b}') AS {b}" for b in ("exact_name", "sorted_name", "name_numeric", "char_ngram", "domain", "transliteration", "leetspeak", "tfidf"))
    _cte(name, f"""SELECT s1_id, target_id, {flags}, coalesce(max(score), 0.0::DOUBLE) AS tfidf_score, coalesce(min(rank), 1000) AS tfidf_rank, CAST(count(DISTINCT b) AS INTEGER) AS support_count
      FROM ({rows} UNION ALL SELECT s1_id, target_id, 'tfidf', score, rank FROM top WHERE rank <= {k}) GROUP BY s1_id, target_id""", "top", *blocks.values())


_arm("prov40", 40, {})
_arm("prov_c", 50, {"indic_address": "b13_address", "transliteration": "b13_prefix", "leetspeak": "b15"})
_oracle("b17_provenance", "SELECT * FROM prov40", "prov40")
_oracle("b17_arm_c", "SELECT * FROM prov_c", "prov_c")
_FIRST = "SELECT s1_id, target_id FROM ({u}) QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY target_id) <= {n}"
_oracle("b18_engine_retrieval", _FIRST.format(u="SELECT * FROM x_all UNION SELECT * FROM s_all UNION SELECT * FROM n_inf UNION SELECT * FROM d_all", n=50), "x_all", "s_all", "n_inf", "d_all")
_oracle("b20_generator_retrieval", _FIRST.format(u="SELECT * FROM x_all UNION SELECT * FROM s_all UNION SELECT * FROM n_inf UNION SELECT * FROM b4_all", n=40), "x_all", "s_all", "n_inf", "b4_all")
_cte("keys19", """SELECT DISTINCT b, key, entity_id FROM (SELECT 'x' AS b, name AS key, entity_id FROM e UNION ALL SELECT 's', sorted_name, entity_id FROM e
  UNION ALL SELECT 'd', CASE WHEN length(domain) >= 4 THEN domain ELSE '' END, entity_id FROM e
  UNION ALL SELECT 'n', unnest(CASE WHEN len(informative) > 0 THEN list_transform(plots, lambda p: informative[1] || '::' || p) ELSE [] END), entity_id FROM e) WHERE key <> ''""", "e")
_oracle("b19_bucket_skip", _FIRST.format(u="""SELECT DISTINCT a.entity_id AS s1_id, c.entity_id AS target_id FROM keys19 a JOIN keys19 c ON a.b = c.b AND a.key = c.key AND a.entity_id LIKE 'S1-%' AND c.entity_id NOT LIKE 'S1-%'
  WHERE (SELECT count(*) FROM keys19 k WHERE k.b = a.b AND k.key = a.key AND k.entity_id LIKE 'S1-%') <= 30""", n=40), "keys19")
ORACLES["b2_parts_heavy_buckets"] = f"""WITH r AS (SELECT 'S' || CAST(1 + p_partkey % 3 AS VARCHAR) || '-' || CAST(p_partkey AS VARCHAR) AS entity_id,
  array_to_string(list_sort(list_filter({_words(_clean('p_name'))}, lambda w: NOT list_contains({_list(LEGAL_FORMS)}, w))), ' ') AS key FROM part),
t AS (SELECT * FROM r WHERE entity_id NOT LIKE 'S1-%' AND key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY entity_id) <= 1000)
SELECT a.entity_id AS s1_id, t.entity_id AS target_id FROM r a JOIN t ON a.key = t.key WHERE a.entity_id LIKE 'S1-%'"""
_oracle("j1_semi_join", "SELECT entity_id, business_name, business_address, country FROM rec WHERE entity_id IN (SELECT target_id FROM links)", "rec", "links")
_oracle("j2_label_pairs", "SELECT s1_id, target_id, CAST(EXISTS (SELECT 1 FROM links l WHERE l.s1_id = b2.s1_id AND l.target_id = b2.target_id) AS INTEGER) AS label FROM b2", "b2", "links")
_oracle("j3_blocking_misses", "SELECT s1_id, target_id FROM links EXCEPT SELECT s1_id, target_id FROM b2", "links", "b2")
_AG = "CAST(count(*) FILTER (WHERE lower(trim(a.{c})) = lower(trim(b.{c}))) AS BIGINT)"
_oracle("j4_link_agreement", f"SELECT count(*) AS links, {_AG.format(c='business_name')} AS same_name, {_AG.format(c='business_address')} AS same_address, {_AG.format(c='country')} AS same_country FROM links l JOIN rec a ON l.s1_id = a.entity_id JOIN rec b ON l.target_id = b.entity_id", "links", "rec")

_oracle("k1_vocabulary", "SELECT term, df, round(ln((1.0::DOUBLE + (SELECT n FROM n_t)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE, 6) AS idf FROM vocab_all", "vocab_all", "n_t")
_cte("first500", "SELECT entity_id FROM t ORDER BY entity_id LIMIT 500", "t")
_oracle("k2_vocabulary_sample", """SELECT term, count(*) AS df, round(ln((1.0::DOUBLE + n) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE, 6) AS idf FROM grams, (SELECT count(*) AS n FROM first500)
  WHERE id IN (SELECT entity_id FROM first500) GROUP BY term, n HAVING count(*) >= CASE WHEN n < 50 THEN 1 ELSE 3 END AND count(*) <= CASE WHEN n < 50 THEN 1 ELSE 0.2::DOUBLE END * n""", "grams", "first500")
_oracle("k4_merged_top_k", "SELECT s1_id, target_id, score, rank FROM top WHERE rank <= 10", "top")
_oracle("k5_score_floor", "SELECT s1_id, target_id, score FROM (SELECT * FROM top WHERE score >= 0.1::DOUBLE) WHERE rank <= 40", "top")
_oracle("k6_rank_defaults", "SELECT p.s1_id, p.target_id, coalesce(k.score, 0.0::DOUBLE) AS score, coalesce(k.rank, 1000) AS rank FROM b2 p LEFT JOIN (SELECT * FROM top WHERE rank <= 5) k ON p.s1_id = k.s1_id AND p.target_id = k.target_id", "b2", "top")
_oracle("k7_pair_tfidf", "SELECT p.s1_id, p.target_id, coalesce(k.score, 0.0::DOUBLE) AS score FROM b2 p LEFT JOIN sim k ON p.s1_id = k.s1_id AND p.target_id = k.target_id", "b2", "sim")
_oracle("k8_top_k_sweep", "SELECT k, count(*) AS pairs, count(l.s1_id) AS captured FROM (SELECT unnest([25, 40, 50, 75, 100]) AS k) JOIN top ON rank <= k LEFT JOIN links l ON top.s1_id = l.s1_id AND top.target_id = l.target_id GROUP BY k", "top", "links")

_oracle("so1_union", "SELECT * FROM b2 UNION SELECT * FROM b4", "b2", "b4")
_HAS = "EXISTS (SELECT 1 FROM {p} p WHERE p.s1_id = l.s1_id AND p.target_id = l.target_id)"
_oracle("so2_complementarity", f"""SELECT count(*) AS links, count(*) FILTER (WHERE a AND NOT b) AS a_only, count(*) FILTER (WHERE b AND NOT a) AS b_only, count(*) FILTER (WHERE a AND b) AS both_sets,
  count(*) FILTER (WHERE NOT a AND NOT b) AS missed, coalesce(round(100.0::DOUBLE * count(*) FILTER (WHERE a AND b) / nullif(count(*) FILTER (WHERE a OR b), 0), 6), 0.0::DOUBLE) AS overlap_pct
  FROM (SELECT {_HAS.format(p='b2')} AS a, {_HAS.format(p='b5')} AS b FROM links l)""", "links", "b2", "b5")


def _recall(pairs: str) -> str:
    s = lambda n, c: f"coalesce(round(count(*) FILTER (WHERE hit{c})::DOUBLE / nullif(count(*) FILTER (WHERE true{c}), 0), 6), 0.0::DOUBLE) AS {n}"
    parts = [s("recall", ""), s("recall_s2", " AND target_id LIKE 'S2-%'"), s("recall_s3", " AND target_id LIKE 'S3-%'")]
    return f"SELECT count(*) AS true_links, count(*) FILTER (WHERE hit) AS captured, {', '.join(parts)} FROM (SELECT target_id, {_HAS.format(p=pairs)} AS hit FROM links l)"


def _volume(pairs: str) -> str:
    quantiles = ", ".join(f"round(quantile_cont(n, {p}), 6) AS {name}" for name, p in (("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))
    return f"""SELECT count(*) AS queries, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, {quantiles}, max(n) AS most, count(*) FILTER (WHERE n = 0) AS without,
      round(1.0::DOUBLE - sum(n)::DOUBLE / greatest(count(*) * (SELECT n FROM n_t), 1), 6) AS reduction FROM (SELECT s.s1_id, count(p.target_id) AS n FROM spine s LEFT JOIN {pairs} p ON s.s1_id = p.s1_id GROUP BY 1)"""


_cte("u25", "SELECT * FROM b2 UNION SELECT * FROM b5", "b2", "b5")
_oracle("so3_union_quality", f"SELECT * FROM ({_recall('u25')}), ({_volume('u25')})", "u25", "links", "spine", "n_t")
FLAGSHIP = sql(f"SELECT * FROM ({_recall('b2')}), ({_volume('b2')})", "b2", "links", "spine", "n_t")
_cte("staged", "SELECT s1_id, target_id, min(k) AS k FROM (SELECT *, 0 AS k FROM b1 UNION ALL SELECT *, 1 FROM b2 UNION ALL SELECT *, 2 FROM b5 UNION ALL SELECT *, 3 FROM b4) GROUP BY ALL", "b1", "b2", "b5", "b4")
_oracle("so4_progressive_union", """SELECT ['exact', 'sorted', 'address', 'boundary'][k + 1] AS stage_name, count(*) FILTER (WHERE s.k = g.k) AS new_pairs, count(l.s1_id) FILTER (WHERE s.k = g.k) AS new_links,
  round(count(l.s1_id)::DOUBLE / greatest((SELECT count(*) FROM links), 1), 6) AS recall, round(count(s.s1_id)::DOUBLE / (SELECT count(*) FROM spine), 6) AS mean_candidates
  FROM (SELECT unnest([0, 1, 2, 3]) AS k) g LEFT JOIN staged s ON s.k <= g.k LEFT JOIN links l ON s.s1_id = l.s1_id AND s.target_id = l.target_id GROUP BY g.k""".replace("[k + 1]", "[g.k + 1]"), "staged", "links", "spine")
_oracle("so5_configurations", """SELECT c AS config, round(count(l.s1_id)::DOUBLE / greatest((SELECT count(*) FROM links), 1), 6) AS recall, round(count(*)::DOUBLE / (SELECT count(*) FROM spine), 6) AS mean_candidates
  FROM (SELECT 'A' AS c, * FROM b1 UNION SELECT 'B', * FROM b1 UNION SELECT 'B', * FROM b5 UNION SELECT 'C', * FROM b1 UNION SELECT 'C', * FROM b5 UNION SELECT 'C', * FROM b4) p
  LEFT JOIN links l ON p.s1_id = l.s1_id AND p.target_id = l.target_id GROUP BY c""", "b1", "b5", "b4", "links", "spine")
_oracle("so6_rescue_merge", "SELECT s1_id, target_id, CASE WHEN score >= 0.6::DOUBLE THEN greatest(score, round(score * 0.9::DOUBLE + 0.05::DOUBLE, 6)) ELSE round(score * 0.9::DOUBLE + 0.05::DOUBLE, 6) END AS score, CASE WHEN score >= 0.6::DOUBLE THEN 'primary' ELSE 'rescue' END AS origin FROM scored", "scored")
_oracle("so7_intersect_except", "SELECT s1_id AS entity_id, CASE WHEN country = 'en' THEN 'both' ELSE 'second_only' END AS kind FROM spine JOIN rec ON s1_id = entity_id", "spine", "rec")

_oracle("x1_deterministic_matcher", "SELECT * FROM scored", "scored")
_SIG = "1.0::DOUBLE / (1.0::DOUBLE + exp(-({x})))"
_oracle("x6_sigmoid", f"SELECT s1_id, target_id, round({_SIG.format(x='score * 4.0::DOUBLE - 2.0::DOUBLE')}, 6) AS score FROM scored", "scored")
_oracle("x7_blend", f"SELECT s1_id, target_id, round(0.7::DOUBLE * score + 0.3::DOUBLE * {_SIG.format(x='score')}, 6) AS score FROM scored", "scored")
_cte("split", "SELECT s1_id AS entity_id, CASE WHEN row_number() OVER (ORDER BY md5(s1_id || '|42'), s1_id) <= round((SELECT count(*) FROM spine) * 0.2::DOUBLE) THEN 'validation' ELSE 'train' END AS part FROM spine", "spine")
_oracle("h1_entity_split", "SELECT * FROM split", "split")
_oracle("h2_partition_truth", "SELECT part, count(*) AS links FROM links JOIN split ON s1_id = entity_id GROUP BY 1", "links", "split")
_oracle("h3_nested_cohorts", "SELECT s1_id AS entity_id, size FROM (SELECT s1_id, row_number() OVER (ORDER BY md5(s1_id || '|42'), s1_id) AS r FROM spine), (SELECT unnest([50, 100]) AS size) WHERE r <= size", "spine")
_cte("negs", """SELECT p.*, CASE WHEN l.s1_id IS NULL THEN 0 ELSE 1 END AS label, greatest(count(l.s1_id) OVER (PARTITION BY p.s1_id), 1) * 6 AS want, md5(p.s1_id || '|' || p.target_id || '|42') AS h,
  CASE WHEN tfidf_rank <= 5 OR tfidf_score >= 0.4::DOUBLE THEN 0 WHEN support_count >= 2 THEN 1 WHEN exact_name OR sorted_name THEN 2 WHEN name_numeric THEN 3 ELSE 4 END AS stratum
  FROM prov p LEFT JOIN links l ON p.s1_id = l.s1_id AND p.target_id = l.target_id""", "prov", "links")
_cte("quota", """SELECT *, row_number() OVER (PARTITION BY s1_id, stratum ORDER BY h) > CASE stratum WHEN 0 THEN greatest(1, CAST(floor(want * 0.3::DOUBLE) AS BIGINT)) WHEN 1 THEN greatest(1, CAST(floor(want * 0.3::DOUBLE) AS BIGINT))
  WHEN 2 THEN greatest(1, CAST(floor(want * 0.2::DOUBLE) AS BIGINT)) WHEN 3 THEN greatest(1, CAST(floor(want * 0.1::DOUBLE) AS BIGINT))
  ELSE greatest(1, want - 2 * greatest(1, CAST(floor(want * 0.3::DOUBLE) AS BIGINT)) - greatest(1, CAST(floor(want * 0.2::DOUBLE) AS BIGINT)) - greatest(1, CAST(floor(want * 0.1::DOUBLE) AS BIGINT))) END AS late FROM negs WHERE label = 0""", "negs")
_cte("trained", """SELECT s1_id, target_id, 0 AS label FROM quota QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY late, CASE WHEN NOT late THEN stratum ELSE -1 END, h) <= want
  UNION ALL SELECT s1_id, target_id, 1 FROM negs WHERE label = 1""", "quota", "negs")
_oracle("h4_negative_sample", "SELECT s1_id, target_id, CAST(label AS INTEGER) AS label FROM trained", "trained")
_oracle("h5_query_groups", "SELECT s1_id, count(*) AS group_size, CAST(sum(label) AS BIGINT) AS positives FROM trained GROUP BY 1", "trained")
_oracle("src8_distractors", """SELECT entity_id FROM rec WHERE entity_id LIKE 'S1-%' OR entity_id IN (SELECT target_id FROM links)
  UNION SELECT entity_id FROM (SELECT entity_id FROM rec WHERE entity_id NOT LIKE 'S1-%' AND entity_id NOT IN (SELECT target_id FROM links) QUALIFY row_number() OVER (PARTITION BY left(entity_id, 2) ORDER BY entity_id) <= 100)""", "rec", "links")
_oracle("src5_parse_truth", "SELECT s.s1_id, coalesce(string_agg(l.target_id, '|' ORDER BY l.target_id), '') AS matches FROM spine s LEFT JOIN links l ON s.s1_id = l.s1_id GROUP BY 1", "spine", "links")
_oracle("src2_constraint_violations", """SELECT 'duplicate_id' AS rule, count(*) AS ids, CAST(2 * count(*) AS BIGINT) AS n FROM rec WHERE country = 'de' HAVING count(*) > 0
  UNION ALL SELECT 'wrong_prefix', count(*), CAST(sum(CASE WHEN country = 'de' THEN 2 ELSE 1 END) AS BIGINT) FROM rec WHERE entity_id NOT LIKE 'S1-%'""", "rec")
_oracle("snk1_prediction_rows", "SELECT s.s1_id AS source1_entity_id, coalesce(string_agg(b.target_id, ',' ORDER BY b.rank), '') AS matched_entity_ids FROM spine s LEFT JOIN (SELECT * FROM best WHERE score >= 0.5::DOUBLE AND rank <= 3) b ON s.s1_id = b.s1_id GROUP BY 1", "spine", "best")
_RANKED = "SELECT s1_id, target_id, score, CAST(rank AS INTEGER) AS rank FROM best"
_oracle("snk2_ranked_rows", _RANKED, "best")
_oracle("snk5_upsert", "SELECT entity_id, country, CASE WHEN country = 'fr' THEN 2 ELSE 1 END AS v FROM rec", "rec")
_oracle("p1_global_threshold", f"{_RANKED} WHERE score >= 0.6::DOUBLE", "best")
_oracle("p2_top_k_threshold", f"{_RANKED} WHERE score >= 0.5::DOUBLE AND rank <= 3", "best")
_oracle("p3_relative_margin", "SELECT s1_id, target_id, score, CAST(rank AS INTEGER) AS rank FROM margin", "margin")
_oracle("p4_adaptive_ratio", f"{_RANKED} WHERE top >= 0.6::DOUBLE AND (rank = 1 OR (top > 0 AND score >= 0.6::DOUBLE AND score / top >= 0.9::DOUBLE AND rank <= 5))", "best")
_cte("two", "SELECT s.s1_id, max(b.score) FILTER (WHERE rank = 1) AS a, max(b.score) FILTER (WHERE rank = 2) AS b FROM spine s LEFT JOIN best b ON s.s1_id = b.s1_id GROUP BY 1", "spine", "best")
_oracle("p5_rescue_trigger", "SELECT s1_id FROM two WHERE a IS NULL OR a < 0.7::DOUBLE OR (a < 0.85::DOUBLE AND a - b <= 0.05::DOUBLE)", "two")
_cte("strong", "SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) AS rank FROM scored WHERE score >= 0.7::DOUBLE", "scored")
_cte("unsure", """SELECT s1_id FROM (SELECT s.s1_id, max(b.score) FILTER (WHERE rank = 1) AS a, max(b.score) FILTER (WHERE rank = 2) AS b FROM spine s LEFT JOIN strong b ON s.s1_id = b.s1_id GROUP BY 1)
  WHERE a IS NULL OR a < 0.7::DOUBLE OR (a < 0.85::DOUBLE AND a - b <= 0.05::DOUBLE)""", "spine", "strong")
_cte("merged", "SELECT s1_id, target_id, score FROM scored WHERE score >= 0.7::DOUBLE OR s1_id IN (SELECT s1_id FROM unsure)", "scored", "unsure")
_oracle("p6_rescue_cascade", """SELECT s1_id, target_id, score FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) AS rank, max(score) OVER (PARTITION BY s1_id) AS top FROM merged)
  WHERE top >= 0.6::DOUBLE AND (rank = 1 OR (score >= 0.65::DOUBLE AND top - score <= 0.1::DOUBLE AND rank <= 5))""", "merged")

_oracle("g1_blocking_recall", _recall("b2"), "b2", "links")
_oracle("g2_blocking_volume", _volume("b2"), "b2", "spine", "n_t")
_oracle("g3_entity_f05", 'SELECT s1_id, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f05 FROM f05', "f05")
_MACRO = """SELECT round(avg(f), 6) AS macro_f05, round(avg(p), 6) AS mean_precision, round(avg(r), 6) AS mean_recall, count(*) AS entities, count(*) FILTER (WHERE n_true = 0) AS true_singletons,
  count(*) FILTER (WHERE n_true = 0 AND n_pred = 0) AS correct_singletons, count(*) FILTER (WHERE n_true = 0 AND n_pred > 0) AS false_merges, count(*) FILTER (WHERE n_true > 0 AND n_pred = 0) AS missed_entities,
  CAST(sum(n_true) AS BIGINT) AS true_links, CAST(sum(n_pred) AS BIGINT) AS predicted_links, CAST(sum(tp) AS BIGINT) AS correct_links, count(*) FILTER (WHERE f = 1) AS perfect_entities FROM f05"""
_oracle("g4_macro_f05", _MACRO, "f05")
_cte("lab", "SELECT s.*, CASE WHEN l.s1_id IS NULL THEN 0 ELSE 1 END AS y FROM scored s LEFT JOIN links l ON s.s1_id = l.s1_id AND s.target_id = l.target_id", "scored", "links")
_G5 = """SELECT
    coalesce(round((SELECT sum(y)::DOUBLE / count(*) FROM lab WHERE score >= 0.5::DOUBLE), 6), 0.0::DOUBLE) AS pair_precision,
    coalesce(round((SELECT sum(y)::DOUBLE FROM lab WHERE score >= 0.5::DOUBLE) / nullif((SELECT sum(y) FROM lab), 0), 6), 0.0::DOUBLE) AS pair_recall,
    coalesce(round((SELECT sum(dp * tp / k) FROM steps) / nullif((SELECT sum(y) FROM lab), 0), 6), 0.0::DOUBLE) AS average_precision,
    coalesce(round(((SELECT sum(r) FROM ranks WHERE y = 1) - (SELECT sum(y) * (sum(y) + 1) / 2.0::DOUBLE FROM lab)) / nullif((SELECT sum(y) * sum(1 - y) FROM lab), 0), 6), 0.5::DOUBLE) AS roc_auc"""
_cte("by_score", "SELECT score, sum(y)::DOUBLE AS dp, count(*)::DOUBLE AS c FROM lab GROUP BY 1", "lab")
_cte("steps", "SELECT a.score, a.dp, sum(b.dp) AS tp, sum(b.c) AS k FROM by_score a JOIN by_score b ON b.score >= a.score GROUP BY ALL", "by_score")
_cte("ranks", "SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM lab", "lab")
_oracle("g5_pair_quality", _G5, "lab", "steps", "ranks")
_oracle("g6_ranking_quality", """SELECT k, round(avg(coalesce(h::DOUBLE / n, 0.0::DOUBLE)), 6) AS recall, round(avg(coalesce(h::DOUBLE / nullif(c, 0), 0.0::DOUBLE)), 6) AS "precision" FROM (
  SELECT g.k, u.s1_id, u.n, count(b.target_id) AS c, count(l.s1_id) AS h FROM (SELECT s1_id, count(*) AS n FROM links GROUP BY 1) u JOIN (SELECT unnest([1, 3, 5, 10]) AS k) g ON true
  LEFT JOIN best b ON b.s1_id = u.s1_id AND b.rank <= g.k LEFT JOIN links l ON l.s1_id = b.s1_id AND l.target_id = b.target_id GROUP BY ALL) GROUP BY k""", "links", "best")
_oracle("g7_threshold_sweep", f"""SELECT threshold, round(avg(CASE WHEN p + r > 0 THEN 1.25::DOUBLE * p * r / (0.25::DOUBLE * p + r) ELSE 0.0::DOUBLE END), 6) AS macro_f05,
  coalesce(round(sum(tp)::DOUBLE / nullif(sum(n_true), 0), 6), 0.0::DOUBLE) AS link_recall, CAST(sum(n_pred) AS BIGINT) AS predicted_links FROM (SELECT *, {_P} AS p, {_R} AS r FROM (
  SELECT g.threshold, s.s1_id, (SELECT count(*) FROM links l WHERE l.s1_id = s.s1_id) AS n_true, count(b.target_id) AS n_pred, coalesce(sum(b.y), 0) AS tp FROM spine s
  JOIN (SELECT unnest([0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE]) AS threshold) g ON true LEFT JOIN lab b ON b.s1_id = s.s1_id AND b.score >= g.threshold GROUP BY g.threshold, s.s1_id)) GROUP BY threshold""", "lab", "spine", "links")
_oracle("g8_rank_margin", "SELECT round(avg(a), 6) AS mean_top_score, round(avg(coalesce(b, 0.0::DOUBLE)), 6) AS mean_second_score, round(avg(a - coalesce(b, 0.0::DOUBLE)), 6) AS mean_score_margin FROM two WHERE a IS NOT NULL", "two")
_oracle("g9_policy_report", """SELECT round(avg(f), 6) AS macro_f05, coalesce(round(sum(tp)::DOUBLE / nullif(sum(n_true), 0), 6), 0.0::DOUBLE) AS link_recall, coalesce(round(avg(f) FILTER (WHERE n_true = 0), 6), 1.0::DOUBLE) AS singleton_f05,
  coalesce(round(avg(f) FILTER (WHERE n_true = 1), 6), 0.0::DOUBLE) AS one_match_f05, coalesce(round(avg(f) FILTER (WHERE n_true >= 2), 6), 0.0::DOUBLE) AS multi_match_f05, round(avg(CAST(n_pred = 0 AS INTEGER)), 6) AS share_0,
  round(avg(CAST(n_pred = 1 AS INTEGER)), 6) AS share_1, round(avg(CAST(n_pred = 2 AS INTEGER)), 6) AS share_2, round(avg(CAST(n_pred >= 3 AS INTEGER)), 6) AS share_3plus FROM f05""", "f05")
_oracle("g11_error_decomposition", f"""SELECT count(*) AS true_links, count(*) FILTER (WHERE said) AS captured, count(*) FILTER (WHERE NOT said AND score IS NULL) AS blocking, count(*) FILTER (WHERE NOT said AND score < 0.6::DOUBLE) AS matcher,
  count(*) FILTER (WHERE NOT said AND score >= 0.6::DOUBLE) AS policy FROM (SELECT {_HAS.format(p='margin')} AS said, s.score FROM links l LEFT JOIN scored s ON s.s1_id = l.s1_id AND s.target_id = l.target_id)""", "links", "margin", "scored")
_cte("slice_rows", f"""SELECT *, count(*) OVER (PARTITION BY s1_id) AS n, sum(CAST(target_id LIKE 'S2-%' AS INTEGER)) OVER (PARTITION BY s1_id) AS n2, sum(CAST(target_id LIKE 'S3-%' AS INTEGER)) OVER (PARTITION BY s1_id) AS n3
  FROM (SELECT l.*, {_HAS.format(p='b2')} AS hit FROM links l) JOIN rec ON s1_id = entity_id""", "links", "b2", "rec")
_SLICES = {"overall": "true", "one_match": "n = 1", "multi_match": "n > 1", "us": "upper(country) = 'US'", "india": "upper(country) = 'INDIA'", "s2_links": "target_id LIKE 'S2-%'", "s3_links": "target_id LIKE 'S3-%'", "s2_only_entity": "n3 = 0", "s3_only_entity": "n2 = 0", "both_sources_entity": "n2 > 0 AND n3 > 0", "address_present": "trim(business_address) <> ''", "address_missing": "trim(business_address) = ''", "name_short": "length(business_name) <= 15", "name_long": "length(business_name) > 15"}
_oracle("g12_slice_recall", " UNION ALL ".join(f"SELECT '{n}' AS slice_name, count(*) AS true_links, count(*) FILTER (WHERE hit) AS captured, round(avg(CAST(hit AS INTEGER)), 4) AS recall FROM slice_rows WHERE {c} HAVING count(*) > 0" for n, c in _SLICES.items()), "slice_rows")
_oracle("g13_explosions", "SELECT s.s1_id, count(p.target_id) AS n FROM spine s LEFT JOIN b2 p ON s.s1_id = p.s1_id GROUP BY 1 ORDER BY n DESC, 1 LIMIT 25", "spine", "b2")
_oracle("g13_failures", "SELECT * FROM (SELECT s1_id, target_id FROM links EXCEPT SELECT s1_id, target_id FROM b5) ORDER BY 1, 2 LIMIT 50", "links", "b5")
_PROFILE = """count(*) AS n_rows, count(*) FILTER (WHERE trim(business_name) = '') AS blank_names, count(*) FILTER (WHERE trim(business_address) = '') AS blank_addresses, count(*) FILTER (WHERE trim(country) = '') AS blank_countries,
  count(*) - count(DISTINCT entity_id) AS repeated_ids, count(DISTINCT country) AS countries"""
_profile = lambda t: f"SELECT left(entity_id, 2) AS source, {_PROFILE} FROM {t} GROUP BY 1 UNION ALL SELECT 'all', {_PROFILE} FROM {t}"
_oracle("g14_source_profile", _profile("rec"), "rec")
_cte("parts", "SELECT 'S' || CAST(1 + p_partkey % 3 AS VARCHAR) || '-' || CAST(p_partkey AS VARCHAR) AS entity_id, p_name AS business_name, CAST(p_partkey AS VARCHAR) || ' ' || p_brand || ' ' || p_type AS business_address, 'US' AS country FROM part")
_oracle("g16_audit_rollup", f"SELECT *, 'documents' AS dataset FROM ({_profile('rec')}) UNION ALL SELECT *, 'parts' FROM ({_profile('parts')})", "rec", "parts")
_oracle("g14_repeated_names", "SELECT source, count(*) AS names, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT left(entity_id, 2) AS source, business_name, count(*) AS n FROM rec GROUP BY ALL HAVING count(*) > 1) GROUP BY 1", "rec")
ORACLES["g14_country_histogram"] = "SELECT 'S' || CAST(1 + c_custkey % 3 AS VARCHAR) AS source, n_name AS country, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"
_cte("counts", "SELECT s.s1_id, count(l.target_id) AS n, count(*) FILTER (WHERE target_id LIKE 'S2-%') AS a, count(*) FILTER (WHERE target_id LIKE 'S3-%') AS b FROM spine s LEFT JOIN links l ON s.s1_id = l.s1_id GROUP BY 1", "spine", "links")
_oracle("g15_truth_profile", """SELECT count(*) AS entities, count(*) FILTER (WHERE n = 0) AS singletons, count(*) FILTER (WHERE n = 1) AS one_match, count(*) FILTER (WHERE n > 1) AS multi_match, count(*) FILTER (WHERE a > 0 AND b = 0) AS s2_only,
  count(*) FILTER (WHERE b > 0 AND a = 0) AS s3_only, count(*) FILTER (WHERE a > 0 AND b > 0) AS both_sources, CAST(sum(n) AS BIGINT) AS links, round(avg(n), 6) AS mean_links FROM counts""", "counts")
_oracle("g15_cardinalities", "SELECT n AS n_links, count(*) AS entities FROM counts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "counts")
_SUMS = " || '-' || ".join(f"CAST(sum(CAST('0x' || substr(sha256(s1_id), {4 * k + 1}, 4) AS BIGINT)) AS VARCHAR)" for k in range(16))
_oracle("g17_id_digest", f"SELECT count(*) AS n, sha256({_SUMS}) AS digest FROM spine", "spine")
_cte("folds", "SELECT CAST('0x' || left(md5(s1_id), 2) AS INTEGER) % 5 AS fold, avg(f) AS f FROM f05 GROUP BY 1", "f05")
_oracle("g18_fold_stability", "SELECT 'macro_f05' AS measure, count(*) AS folds, round(avg(f), 6) AS mean, round(stddev_pop(f), 6) AS std, round(min(f), 6) AS least, round(max(f), 6) AS most, round(stddev_pop(f) / avg(f), 6) AS cv FROM folds", "folds")
ORACLES["g19_determinism"] = "SELECT CAST(0 AS BIGINT) AS only_first, CAST(0 AS BIGINT) AS only_second"
_oracle("g19_scaling_curve", "SELECT count(p.target_id) AS pairs, size FROM (SELECT unnest([50, 100, 200]) AS size) JOIN (SELECT s1_id, row_number() OVER (ORDER BY md5(s1_id || '|42'), s1_id) AS r FROM spine) s ON r <= size LEFT JOIN b2 p ON p.s1_id = s.s1_id GROUP BY size", "spine", "b2")
_cte("other_t", "SELECT entity_id, row_number() OVER (PARTITION BY left(entity_id, 2) ORDER BY entity_id) AS r FROM t WHERE entity_id NOT IN (SELECT target_id FROM links)", "t", "links")
_cte("universe", "SELECT n, entity_id FROM (SELECT unnest([10, 100, 1000]) AS n) JOIN (SELECT entity_id, r FROM other_t UNION ALL SELECT DISTINCT target_id, 0 FROM links) ON r <= n", "other_t", "links")
_oracle("g20_universes", """SELECT count(*) AS pairs, CAST(n AS INTEGER) AS per_source FROM (SELECT u.n, t.sorted_name AS key, t.entity_id FROM universe u JOIN t ON t.entity_id = u.entity_id WHERE t.sorted_name <> ''
  QUALIFY row_number() OVER (PARTITION BY u.n, t.sorted_name ORDER BY t.entity_id) <= 1000) x JOIN q ON q.sorted_name = x.key GROUP BY n""", "universe", "t", "q")
_cte("said", "SELECT s.s1_id, count(m.target_id) AS n, count(*) FILTER (WHERE target_id LIKE 'S2-%') AS s2, count(*) FILTER (WHERE target_id LIKE 'S3-%') AS s3 FROM spine s LEFT JOIN margin m ON s.s1_id = m.s1_id GROUP BY 1", "spine", "margin")
_oracle("g21_submission_profile", """SELECT *, round(matches::DOUBLE / entities, 6) AS mean_matches, CASE WHEN n_0::DOUBLE / entities > 0.4::DOUBLE OR n_0::DOUBLE / entities < 0.01::DOUBLE OR matches::DOUBLE / entities > 4.5::DOUBLE OR matches::DOUBLE / entities < 0.5::DOUBLE THEN 'WARNING' ELSE 'NORMAL' END AS verdict
  FROM (SELECT count(*) AS entities, count(*) FILTER (WHERE n = 0) AS n_0, count(*) FILTER (WHERE n = 1) AS n_1, count(*) FILTER (WHERE n = 2) AS n_2, count(*) FILTER (WHERE n = 3) AS n_3, count(*) FILTER (WHERE n > 3) AS n_more,
  CAST(sum(n) AS BIGINT) AS matches, CAST(sum(s2) AS BIGINT) AS s2_targets, CAST(sum(s3) AS BIGINT) AS s3_targets, CAST(sum(n - s2 - s3) AS BIGINT) AS bad_prefix FROM said)""", "said")
_oracle("g22_output_by_country", "SELECT coalesce(country, 'all') AS country, coalesce(ts, 'all') AS target_source, count(*) AS n, count(DISTINCT s1_id) AS entities FROM (SELECT m.s1_id, r.country, left(m.target_id, 2) AS ts FROM margin m JOIN rec r ON m.s1_id = r.entity_id) GROUP BY CUBE (country, ts)", "margin", "rec")
_cte("wrong", """SELECT coalesce(l.s1_id, p.s1_id) AS s1_id, coalesce(l.target_id, p.target_id) AS target_id, CASE WHEN l.s1_id IS NULL THEN 'FP' ELSE 'FN' END AS kind
  FROM links l FULL JOIN (SELECT * FROM scored WHERE score >= 0.5::DOUBLE) p ON l.s1_id = p.s1_id AND l.target_id = p.target_id WHERE l.s1_id IS NULL OR p.s1_id IS NULL""", "links", "scored")
_WEAK = _list("solutions enterprises services industries holdings group".split())
_HEAD = "lower(split_part({c}, '.', 1))"
_cte("causes", f"""SELECT kind, CASE WHEN kind = 'FP' THEN CASE WHEN {_INDIC.format(c='a.business_name')} <> {_INDIC.format(c='b.business_name')} THEN 'cross_script'
    WHEN (contains(a.business_name, '.') OR contains(b.business_name, '.')) AND {_HEAD.format(c='a.business_name')} = {_HEAD.format(c='b.business_name')} THEN 'domain_collision'
    WHEN a.numbers[1] = b.numbers[1] AND lower(a.business_name) <> lower(b.business_name) THEN 'commercial_cluster'
    WHEN len(list_filter({_words('a.clean_name')}, lambda w: list_contains({_words('b.clean_name')}, w) AND NOT list_contains({_WEAK}, w))) = 0 THEN 'generic_tokens' ELSE 'high_lexical_similarity' END
  ELSE CASE WHEN {_INDIC.format(c='a.business_name')} OR {_INDIC.format(c='b.business_name')} THEN 'cross_script_target' WHEN a.business_address = '' OR b.business_address = '' THEN 'address_missing'
    WHEN len({_words('a.business_address')}) < 3 OR len({_words('b.business_address')}) < 3 THEN 'address_truncated' WHEN contains(a.business_name, '.') OR contains(b.business_name, '.') THEN 'domain_alias' ELSE 'name_transformation' END END AS cause
  FROM wrong w JOIN e a ON a.entity_id = w.s1_id JOIN e b ON b.entity_id = w.target_id""", "wrong", "e")
_oracle("g23_error_causes", "SELECT kind, cause, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY kind), 6) AS share FROM causes GROUP BY kind, cause", "causes")
_oracle("g25_unseen_countries", "SELECT country, count(*) AS n, min(entity_id) AS example FROM rec WHERE country = 'de' GROUP BY 1", "rec")
_oracle("v1_target_prefix", "SELECT s1_id, target_id FROM links", "links")
_CARD = ", ".join(f"count(*) FILTER (WHERE n = {k}) AS cardinality_{k}" for k in range(4))
_cte("said_n", "SELECT s.s1_id, count(m.target_id) AS n FROM spine s LEFT JOIN margin m ON s.s1_id = m.s1_id GROUP BY 1", "spine", "margin")
_oracle("v3_verify_output", f"""SELECT * FROM (SELECT count(*) AS predictions, count(DISTINCT s1_id) AS matched_entities, count(*) FILTER (WHERE target_id LIKE 'S2-%') AS s2_links, count(*) FILTER (WHERE target_id LIKE 'S3-%') AS s3_links,
  count(*) FILTER (WHERE target_id NOT LIKE 'S2-%' AND target_id NOT LIKE 'S3-%') AS wrong_prefix, count(*) FILTER (WHERE target_id NOT IN (SELECT entity_id FROM t)) AS unknown_targets,
  count(*) FILTER (WHERE s1_id NOT IN (SELECT s1_id FROM spine)) AS unknown_entities, count(*) - count(DISTINCT s1_id || '|' || target_id) AS repeated, 'PASS' AS verdict FROM margin),
  (SELECT count(*) AS entities, {_CARD}, count(*) FILTER (WHERE n > 3) AS cardinality_more FROM said_n)""", "margin", "said_n", "t", "spine")
_oracle("v5_id_round_trip", "SELECT (SELECT count(*) FROM links) AS ids, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS changed, count(*) AS targets, count(*) FILTER (WHERE NOT regexp_matches(entity_id, '^S[23]-')) AS wrong_prefix, 'PASS' AS verdict FROM t", "links", "t")
_cte("sent", """SELECT s1_id, string_agg(target_id, ',' ORDER BY target_id) AS matches FROM links WHERE s1_id <> 'S1-0' GROUP BY 1 UNION ALL SELECT s1_id, '' FROM spine WHERE s1_id <> 'S1-0' AND s1_id NOT IN (SELECT s1_id FROM links)
  UNION ALL SELECT entity_id, entity_id || ',X9-1,S2-1,S2-1' FROM rec WHERE country = 'de' AND entity_id LIKE 'S1-%'""", "links", "spine", "rec")
_cte("sent_each", "SELECT s1_id, trim(unnest(string_split(matches, ','))) AS m FROM sent", "sent")
_cte("broken", """SELECT 'duplicate_row' AS rule, s1_id AS x FROM sent GROUP BY s1_id HAVING count(*) > 1
  UNION ALL SELECT 'duplicate_match', s1_id || ':' || m FROM sent_each WHERE m <> '' GROUP BY s1_id, m HAVING count(*) > 1
  UNION ALL SELECT 'self_match', s1_id || ':' || m FROM sent_each WHERE m LIKE 'S1-%'
  UNION ALL SELECT 'wrong_prefix', s1_id || ':' || m FROM sent_each WHERE m <> '' AND NOT regexp_matches(m, '^S[123]-')
  UNION ALL SELECT 'missing_entity', s1_id FROM spine WHERE s1_id NOT IN (SELECT s1_id FROM sent)
  UNION ALL SELECT 'unknown_entity', s1_id FROM sent WHERE s1_id NOT IN (SELECT s1_id FROM spine)""", "sent", "sent_each", "spine")
_oracle("v2_submission_validator", """SELECT rule, count(*) AS n, string_agg(x, ',' ORDER BY x) FILTER (WHERE r <= 5) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY x) AS r FROM broken) GROUP BY rule""", "broken")
_oracle("v4_leakage", "SELECT CAST(0 AS BIGINT) AS overlap, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS added, count(*) FILTER (WHERE part = 'train') AS train, count(*) FILTER (WHERE part = 'validation') AS validation, true AS clean FROM split", "split")
ORACLES["v6_feature_parity"] = sql("SELECT count(*) AS pairs, CAST(0 AS DOUBLE) AS max_abs_diff FROM prov", "prov")


# The 43 features. No Indic names and no digits within words occur in the documents, so romanised and
# leetspeak columns follow from the plain ones.
_cte("addr_tri", "SELECT entity_id, g, count(*)::DOUBLE AS n FROM (SELECT entity_id, unnest(list_transform(range(1, greatest(length(replace(address, ' ', '')) - 1, 1)), lambda i: substr(replace(address, ' ', ''), i, 3))) AS g FROM e) GROUP BY ALL", "e")


def _dots(name: str, tri: str) -> None:
    _cte(f"{name}_n", f"SELECT entity_id, sum(n * n) AS n2 FROM {tri} GROUP BY 1", tri)
    _cte(f"{name}_d", f"SELECT p.s1_id AS qi, p.target_id AS ti, sum(a.n * b.n) AS dot FROM prov p JOIN {tri} a ON a.entity_id = p.s1_id JOIN {tri} b ON b.entity_id = p.target_id AND a.g = b.g GROUP BY ALL", tri, "prov")


_dots("nm", "tri")
_dots("ad", "addr_tri")


def _cosine(name: str, a: str, b: str) -> str:
    x, y = f"replace({a}, ' ', '')", f"replace({b}, ' ', '')"
    return f"""CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN length({x}) < 3 OR length({y}) < 3 THEN CAST({x} = {y} AS INTEGER)::DOUBLE
      ELSE least(1.0::DOUBLE, coalesce((SELECT dot FROM {name}_d WHERE qi = s1_id AND ti = target_id), 0.0::DOUBLE) / sqrt((SELECT n2 FROM {name}_n WHERE entity_id = s1_id) * (SELECT n2 FROM {name}_n WHERE entity_id = target_id))) END"""


def _overlap(a: str, b: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / least(len(list_distinct({a})), len(list_distinct({b}))) END"


_B = "CAST({c} AS INTEGER)::DOUBLE"
_PREFIX = "len(list_filter(range(1, least(length(qn), length(tn)) + 1), lambda i: left(qn, CAST(i AS INTEGER)) = left(tn, CAST(i AS INTEGER))))"
_cte("fsides", """SELECT p.*, a.name AS qn, b.name AS tn, a.business_name AS qr, b.business_name AS tr, a.name_tokens AS qt, b.name_tokens AS tt, a.address_tokens AS qa, b.address_tokens AS ta, a.address AS qd, b.address AS td,
  a.country AS qc, b.country AS tc, a.numbers AS qx, b.numbers AS tx, a.postals AS qp, b.postals AS tp, a.domain AS qg, b.domain AS tg FROM prov p JOIN q a ON p.s1_id = a.entity_id JOIN t b ON p.target_id = b.entity_id""", "prov", "q", "t")
_LEET = "array_to_string(regexp_extract_all(strip_accents(lower({c})), '[a-z0-9]+'), '')"
_F = {
    "name_exact_clean": _B.format(c="(qn <> '' AND qn = tn)"),
    "name_compact_exact": _B.format(c="(qn <> '' AND replace(qn, ' ', '') = replace(tn, ' ', ''))"),
    "name_token_jaccard": _jaccard("qt", "tt"),
    "name_token_overlap_coeff": _overlap("qt", "tt"),
    "name_char_ngram_cosine": _cosine("nm", "qn", "tn"),
    "name_prefix_match_len": f"CASE WHEN least(length(qn), length(tn)) = 0 THEN 0.0::DOUBLE ELSE {_PREFIX}::DOUBLE / least(length(qn), length(tn)) END",
    "name_length_ratio": "CASE WHEN greatest(length(qn), length(tn)) = 0 THEN 0.0::DOUBLE ELSE least(length(qn), length(tn))::DOUBLE / greatest(length(qn), length(tn)) END",
    "name_first_token_match": _B.format(c="coalesce(qt[1] = tt[1], false)"),
    "name_sorted_token_jaccard": _jaccard("qt", "tt"),
    "addr_exact_clean": _B.format(c="(qd <> '' AND qd = td)"),
    "addr_token_jaccard": _jaccard("qa", "ta"),
    "addr_token_overlap_coeff": _overlap("qa", "ta"),
    "addr_char_ngram_cosine": _cosine("ad", "qd", "td"),
    "addr_numeric_exact_match": _B.format(c="(len(qx) > 0 AND list_sort(list_distinct(qx)) = list_sort(list_distinct(tx)))"),
    "addr_numeric_jaccard": _jaccard("qx", "tx"),
    "addr_postal_match": "CASE WHEN len(qp) > 0 AND len(tp) > 0 THEN CAST(qp[1] = tp[1] AS INTEGER)::DOUBLE WHEN len(qp) = 0 AND len(tp) = 0 THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END",
    "addr_is_missing_either": _B.format(c="(qd = '' OR td = '')"),
    "country_exact_match": _B.format(c="(qc <> '' AND upper(qc) = upper(tc))"),
    "source_is_s2": _B.format(c="(target_id LIKE 'S2-%')"),
    "source_is_s3": _B.format(c="(target_id LIKE 'S3-%')"),
    "is_cross_script_pair": "0.0::DOUBLE",
    "translit_name_token_jaccard": "0.0::DOUBLE",
    "translit_name_char_ngram_cosine": "0.0::DOUBLE",
    "is_domain_name_pair": _B.format(c="(qr || ' ' || tr LIKE '%.%' OR lower(qr) LIKE '%com%' OR lower(tr) LIKE '%com%')"),
    "domain_compact_match": _B.format(c="(qg <> '' AND qg = tg)"),
    "leetspeak_exact_match": _B.format(c=f"(length({_LEET.format(c='qr')}) >= 4 AND {_LEET.format(c='qr')} = {_LEET.format(c='tr')})"),
    "accent_stripped_match": _B.format(c="(qn <> '' AND strip_accents(qn) = strip_accents(tn))"),
    "shared_rare_token_count": "len(list_intersect(qt, tt))::DOUBLE",
    "min_shared_token_idf": "CASE WHEN len(list_intersect(qt, tt)) > 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END",
    "retrieval_support_count": "support_count::DOUBLE",
    **{f"retrieved_by_{b}": _B.format(c=b) for b in ("exact_name", "sorted_name", "name_numeric", "char_ngram", "domain", "tfidf")},
    "tfidf_similarity_score": "0.0::DOUBLE",
    "tfidf_rank": "1000.0::DOUBLE",
    "inter_name_x_addr_jaccard": f"({_jaccard('qt', 'tt')}) * ({_jaccard('qa', 'ta')})",
    "inter_name_exact_x_addr_jaccard": f"CAST((qn <> '' AND qn = tn) AS INTEGER)::DOUBLE * ({_jaccard('qa', 'ta')})",
    "inter_name_jaccard_x_country": f"({_jaccard('qt', 'tt')}) * CAST((qc <> '' AND upper(qc) = upper(tc)) AS INTEGER)::DOUBLE",
    "inter_support_x_name_jaccard": f"ln(1.0::DOUBLE + support_count) * ({_jaccard('qt', 'tt')})",
}
# the checking engine's edit distance counts bytes: every other letter of names becomes one that cleaned
# names lack
_WIDE = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7) + "œ"
_NARROW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "!#$%&()"
_narrow = lambda c: f"translate(left({c}, 50), '{_WIDE}', '{_NARROW}')"
_EDIT = f"""CASE WHEN qn = tn THEN 1.0::DOUBLE WHEN qn = '' OR tn = '' THEN 0.0::DOUBLE
  ELSE 1.0::DOUBLE - levenshtein({_narrow('qn')}, {_narrow('tn')})::DOUBLE / greatest(length(left(qn, 50)), length(left(tn, 50))) END"""
_oracle("f1_pair_features", "SELECT s1_id, target_id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _F.items()) + " FROM fsides", "fsides", "nm_n", "nm_d", "ad_n", "ad_d")
_ALL = {**dict(list(_F.items())[:5]), "name_edit_similarity": _EDIT, **dict(list(_F.items())[5:])}
_oracle("f1_43_pair_features", "SELECT s1_id, target_id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _ALL.items()) + " FROM fsides", "fsides", "nm_n", "nm_d", "ad_n", "ad_d")
_cte("f_all", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _ALL.items()) + " FROM fsides", "fsides", "nm_n", "nm_d", "ad_n", "ad_d")
_oracle("f_matrix_sanitized", "SELECT " + ", ".join(f"round(sum({n}), 3) AS {n}" for n in _ALL) + " FROM f_all", "f_all")

# the whole first arm: the same chain from pairs to measures over its own provenance
_SIDES = CTES["sides"][0].replace("FROM prov p", "FROM prov40 p")
_cte("sides40", _SIDES, "prov40", "q", "t")
for _name, _from in {"scored": "sides", "best": "scored", "margin": "best", "per": "margin", "f05": "per", "lab": "scored", "by_score": "lab", "steps": "by_score", "ranks": "lab"}.items():
    _body, _needs = CTES[_name]
    _body = _body.replace(f"FROM {_from}", f"FROM {_from}40").replace("FROM margin GROUP", "FROM margin40 GROUP").replace("FROM margin m", "FROM margin40 m").replace("JOIN by_score b", "JOIN by_score40 b")
    _cte(f"{_name}40", _body, *[f"{n}40" if n == _from else n for n in _needs])
_on40 = lambda body: body.replace("FROM f05", "FROM f0540").replace("FROM lab", "FROM lab40").replace("FROM steps", "FROM steps40").replace("FROM ranks", "FROM ranks40")
_RANKS40 = """SELECT k, round(avg(coalesce(h::DOUBLE / n, 0.0::DOUBLE)), 6) AS recall FROM (SELECT g.k, u.s1_id, u.n, count(l.s1_id) AS h FROM (SELECT s1_id, count(*) AS n FROM links GROUP BY 1) u JOIN (SELECT unnest([1, 3, 5, 10]) AS k) g ON true
  LEFT JOIN best40 b ON b.s1_id = u.s1_id AND b.rank <= g.k LEFT JOIN links l ON l.s1_id = b.s1_id AND l.target_id = b.target_id GROUP BY ALL) GROUP BY k"""
_cte("at_k40", _RANKS40, "links", "best40")
_cte("sweep40", f"""SELECT threshold, round(avg(CASE WHEN p + r > 0 THEN 1.25::DOUBLE * p * r / (0.25::DOUBLE * p + r) ELSE 0.0::DOUBLE END), 6) AS f FROM (SELECT *, {_P} AS p, {_R} AS r FROM (
  SELECT g.threshold, s.s1_id, (SELECT count(*) FROM links l WHERE l.s1_id = s.s1_id) AS n_true, count(b.target_id) AS n_pred, coalesce(sum(b.y), 0) AS tp FROM spine s
  JOIN (SELECT unnest([0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE]) AS threshold) g ON true LEFT JOIN lab40 b ON b.s1_id = s.s1_id AND b.score >= g.threshold GROUP BY g.threshold, s.s1_id)) GROUP BY threshold""", "lab40", "spine", "links")
_cte("two40", "SELECT s1_id, max(score) FILTER (WHERE rank = 1) AS a, max(score) FILTER (WHERE rank = 2) AS b FROM best40 GROUP BY 1", "best40")
_oracle("g26_arm_evaluation", f"""SELECT * FROM ({_on40(_MACRO)}), ({_on40(_G5)}),
  (SELECT {', '.join(f"max(recall) FILTER (WHERE k = {k}) AS recall_at_{k}" for k in (1, 3, 5, 10))} FROM at_k40),
  (SELECT round(avg(a), 6) AS mean_top_score, round(avg(coalesce(b, 0.0::DOUBLE)), 6) AS mean_second_score, round(avg(a - coalesce(b, 0.0::DOUBLE)), 6) AS mean_score_margin FROM two40),
  (SELECT threshold AS best_threshold, f AS best_macro_f05 FROM sweep40 ORDER BY f DESC, threshold LIMIT 1)""", "f0540", "lab40", "steps40", "ranks40", "at_k40", "two40", "sweep40")
