"""Op 2: secrets in texts: three fixed patterns and a battery of randomness tests. DataFrame functions only.

Base spans come from the patterns. Candidates of the battery are all maximal runs of base64 and
URL-safe characters of MIN_RUN or more, with "=" as padding only, so NAME=value is two. The encoding is
inferred from the characters used. Per token, three equivalence tests ask whether it is closer to
uniformly random symbols than structured text could be: chi-squared over the encoding's alphabet
(structure: letters as unequal as in words, COINCIDENCE, see DELTA), runs above and below the middle of
the alphabet (structure: off by RUNS_OFF of the expected number) and serial correlation (structure:
SERIAL_OFF). Each gives a normal deviate, negative if random; Stouffer's sum of the three gives one
p-value a token. Short tokens can't reach small ones: that, and not a floor, decides about them, but
for MIN_RUN, a parameter under which not one of 2,000 random tokens was ever flagged.
Benjamini-Hochberg at level FDR runs within each encoding and length class (power of two), over a
histogram of the corpus's p-values; a class has one threshold, all classes are a few hundred at most.

Offsets are in code points, ends exclusive; a span covers the whole match. Nulls: a null text is
empty; ids may be null; repeated rows each get a row. Empty input gives no rows.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

#: Fixed patterns. ASSIGN matches first and is then kept or dropped by the length of its group 2;
#: the other two have their least lengths in the pattern, which finds the same spans.
KEY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = KEY + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_VALUE = 12
KINDS = ("assign", "access", "hex", "random")

RUN = r"A-Za-z0-9+/_\-"
MIN_RUN = 16
TOKEN = rf"(?<![{RUN}])[{RUN}]{{{MIN_RUN},}}={{0,2}}"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: name, what the token must match, alphabet; the first that fits counts
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("lower", "^[a-z]+$", LOWER),
    ("upper", "^[A-Z]+$", UPPER),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("lower36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("upper36", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[0-9A-Za-z_\-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", r"^[0-9A-Za-z+/_\-]+$", UPPER + LOWER + DIGITS + "+/-_"),
)
#: How often two letters of a word are the same, and the least non-centrality a symbol that counts as structure.
COINCIDENCE, LEAST_DELTA = 0.066, 0.6
RUNS_OFF, SERIAL_OFF = 0.35, 0.4
FDR = 0.01
PER_E, EDGES = 4, 120  # p-value bins: e^(-bin / PER_E)
BLOCK = 64


def _quoted(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def _starts(gaps: str, sizes: str) -> str:
    """Start of every match, from the gaps before the matches and the matches' sizes: sums of whole
    blocks first, then within the block, so long lists cost little more than their length."""
    step = f"zip_with(slice({gaps}, 1, size({sizes})), {sizes}, (g, m) -> g + m)"
    return f"""transform(array({step}), s -> transform(array(
        aggregate(sequence(0, greatest(0, cast((size(s) - 1) div {BLOCK} as int))), array(0), (acc, b) ->
          concat(acc, array(element_at(acc, -1) + aggregate(slice(s, b * {BLOCK} + 1, {BLOCK}), 0, (x, y) -> x + y))))),
        pre -> transform(s, (x, k) -> pre[cast(k div {BLOCK} as int)]
          + aggregate(slice(s, cast(k div {BLOCK} as int) * {BLOCK} + 1, cast(k % {BLOCK} as int)), 0, (p, q) -> p + q) + {gaps}[k])))[0][0]"""


def _matches(rows: DataFrame, text: str, pattern: str, out: str, keep: list[str]) -> DataFrame:
    """rows with an array out of (s, e, m): places and texts of all matches of pattern."""
    hit = F.col(text).rlike(pattern)
    empty = F.array().cast("array<string>")
    rows = rows.select(*keep, F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty).alias("sm_m"), F.when(hit, F.transform(F.split(text, pattern, -1), F.length)).otherwise(F.array().cast("array<int>")).alias("sm_g"))
    rows = rows.select(*keep, "sm_m", F.when(F.size("sm_m") > 0, F.expr(_starts("sm_g", "transform(sm_m, x -> length(x))"))).otherwise(F.array().cast("array<int>")).alias("sm_s"))
    return rows.select(*keep, F.expr("zip_with(sm_s, sm_m, (s, m) -> named_struct('s', s, 'e', s + length(m), 'm', m))").alias(out))


def _p_value(token: str) -> str:
    """SQL of a struct (enc, n, p) of a token; null if no encoding fits."""
    enc = "CASE " + " ".join(f"WHEN v RLIKE '{_quoted(pattern)}' THEN {k}" for k, (_, pattern, _) in enumerate(ENCODINGS)) + " END"
    alphabets = "array(" + ", ".join(f"'{a}'" for _, _, a in ENCODINGS) + ")"
    # v: the token without padding; a: its alphabet; x: its symbols' numbers
    counts = "aggregate(sequence(1, length(a)), 0.0D, (t, k) -> t + pow(length(v) - length(replace(v, substr(a, k, 1), '')), 2))"
    high = "translate(v, a, concat(repeat('0', cast(length(a) div 2 as int)), repeat('1', cast(length(a) - length(a) div 2 as int))))"
    products = "aggregate(zip_with(slice(x, 1, size(x) - 1), slice(x, 2, size(x) - 1), (p, q) -> p * q), 0.0D, (t, y) -> t + y)"
    z_chi = "(chi - (df + n * delta)) / sqrt(2 * (df + 2 * n * delta))"
    z_runs = f"(abs(runs - (2 * n1 * n0 / n + 1)) - {RUNS_OFF} * n / 2) / (sqrt(n) / 2)"
    z_serial = f"(abs((n * products - sums * sums) / greatest(n * squares - sums * sums, 1.0D)) - {SERIAL_OFF}) * sqrt(n)"

    def let(name: str, value: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    z = f"(({z_chi}) + ({z_runs}) + ({z_serial})) / sqrt(3.0D)"
    # Fixed approximation of the normal distribution function (Page 1977)
    p = "1 / (1 + exp(-(1.5976D * z + 0.070565992D * z * z * z)))"
    body = let("z", z, f"named_struct('enc', enc, 'n', cast(n as int), 'p', {p})")
    body = let("products", products, body)
    body = let("squares", "aggregate(x, 0.0D, (t, y) -> t + y * y)", body)
    body = let("sums", "aggregate(x, 0.0D, (t, y) -> t + y)", body)
    body = let("n0", "n - n1", body)
    body = let("n1", "cast(length(replace(bits, '0', '')) as double)", body)
    body = let("runs", "cast(length(regexp_replace(bits, '0+|1+', 'r')) as double)", body)
    body = let("bits", high, body)
    body = let("chi", f"length(a) * {counts} / n - n", body)
    body = let("delta", f"greatest({LEAST_DELTA}D, {COINCIDENCE}D * length(a) - 1)", body)
    body = let("df", "length(a) - 1", body)
    body = let("n", "cast(length(v) as double)", body)
    body = let("x", "transform(split(v, ''), ch -> cast(instr(a, ch) - 1 as double))", body)
    body = let("a", f"{alphabets}[enc]", body)
    body = f"CASE WHEN enc IS NOT NULL AND length(v) >= {MIN_RUN} THEN {body} END"
    return let("v", f"rtrim('=', {token})", let("enc", enc, body))


def scanned(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """rows[keep] with base spans (array of s, kind, e) and tokens (array of s, e, enc, n, p)."""
    names = [f"lw_found{k}" for k in range(4)]
    rows = rows.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("lw_t"))
    for k, pattern in enumerate((ASSIGN, ACCESS, HEX, TOKEN)):
        rows = _matches(rows, "lw_t", pattern, names[k], [*keep, "lw_t", *names[:k]])
    # a match ends with its value: longer than the key part by the value's length
    key = _quoted("^" + KEY)
    base = [f"transform(filter({names[0]}, x -> length(regexp_replace(x.m, '{key}', '')) >= {MIN_VALUE}), x -> named_struct('s', x.s, 'k', 0, 'e', x.e))"]
    base += [f"transform({names[k]}, x -> named_struct('s', x.s, 'k', {k}, 'e', x.e))" for k in (1, 2)]
    tokens = f"filter(transform({names[3]}, y -> transform(array({_p_value('y.m')}), r -> named_struct('s', y.s, 'e', y.e, 'enc', r.enc, 'n', r.n, 'p', r.p))[0]), y -> y.p IS NOT NULL)"
    return rows.select(*keep, F.expr(f"array_sort(concat({', '.join(base)}))").alias("lw_base"), F.expr(tokens).alias("lw_tokens"))


def _class(enc: Column, n: Column) -> Column:
    return enc * 64 + F.floor(F.log2(n)).cast("int")


def thresholds(found: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """For each encoding and length class with any: the smallest bin of p-values that counts as
    random. At most 11 encodings x 31 lengths come to the driver."""
    token = found.select(F.explode("lw_tokens").alias("y")).select(_class(F.col("y.enc"), F.col("y.n")).alias("c"), _bin(F.col("y.p")).alias("b"))
    counts = token.groupBy("c", "b").agg(F.count("*").alias("n"))
    by_class = counts.groupBy("c").agg(F.sum("n").alias("m"), F.collect_list(F.struct("b", "n")).alias("bins"))  # EDGES bins at most
    passed = F.expr(f"filter(transform(bins, x -> named_struct('b', x.b, 'n', aggregate(filter(bins, y -> y.b >= x.b), 0L, (t, y) -> t + y.n))), x -> exp(-x.b / {PER_E}D) <= {fdr}D * x.n / m)")
    chosen = by_class.select("c", F.array_min(F.transform(passed, lambda x: x["b"])).alias("b")).where("b IS NOT NULL")
    return {r.c: r.b for r in chosen.collect()}


def _bin(p: Column) -> Column:
    """The bin whose upper edge e^(-bin / PER_E) is the next over p."""
    return F.least(F.lit(EDGES), F.floor(-F.log(F.greatest(p, F.lit(1e-300))) * PER_E)).cast("int")


def _spans(limits: dict[int, int]) -> Column:
    """All spans, base and flagged tokens, sorted by start and kind."""
    if not limits:
        return F.col("lw_base")
    limit = F.create_map(*[F.lit(x) for c, b in sorted(limits.items()) for x in (c, b)])
    flagged = F.filter("lw_tokens", lambda y: _bin(y["p"]) >= F.coalesce(F.try_element_at(limit, _class(y["enc"], y["n"])), F.lit(EDGES + 1)))
    added = F.transform(flagged, lambda y: F.struct(y["s"].alias("s"), F.lit(KINDS.index("random")).alias("k"), y["e"].alias("e")))
    return F.array_sort(F.concat("lw_base", added))


def _shown(spans: str) -> Column:
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({kinds}[x.k], ':', x.s, ':', x.e)), ',')")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every row."""
    found = written(scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")), "t", ["doc_id"]), "secrets")
    rows = found.select("doc_id", "lw_base", _spans(thresholds(found, fdr)).alias("lw_all"))
    count = lambda k: F.size(F.filter("lw_all", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_shown("lw_base"), 256).alias("base_sha256"), _shown("lw_all").alias("spans"), count("random"))


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", fdr: float = FDR) -> DataFrame:
    """docs with every span (overlapping ones as one) replaced by mark; columns as they were."""
    plain, (t,) = numbered(docs, text_col)
    found = written(scanned(plain, t, plain.columns), "secrets")
    rows = found.select(*plain.columns, _spans(thresholds(found, fdr)).alias("lw_all"))
    # ends of what is covered so far, then the gaps between
    merged = """aggregate(lw_all, array(named_struct('s', 0, 'e', 0)), (acc, x) ->
      CASE WHEN x.s < element_at(acc, -1).e
           THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', greatest(x.e, element_at(acc, -1).e))))
           ELSE concat(acc, array(named_struct('s', x.s, 'e', x.e))) END)"""
    rows = rows.select(*plain.columns, F.when(F.size("lw_all") > 0, F.expr(merged)).alias("lw_merged"))
    kept = F.expr(f"array_join(transform(lw_merged, (x, k) -> substring({t}, x.e + 1, coalesce(get(lw_merged, k + 1).s, length({t})) - x.e)), '{_quoted(mark)}')")
    text = F.when(F.col("lw_merged").isNull(), F.col(t)).otherwise(kept)
    return rows.select(*[text.alias(c) if c == t else F.col(c) for c in plain.columns]).toDF(*docs.columns)
