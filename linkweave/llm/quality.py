"""Op 3: quality rules and robust multivariate outliers.

Every text gives counts and a vector of transformed statistics. For each language and source the
minimum-covariance-determinant estimate of these vectors is sought from three deterministic starts
(median with quartile spreads; the same with the correlation of spatial signs; with that of squashed
values). A concentration step counts distances from the current centre into a fine histogram and takes
the COVERAGE nearest rows, the last bin by the share of it that is missing, as the next subset; steps
go on until the subset is stable or the determinant falls no more, MAX_STEPS at most. Of the starts
the smallest determinant wins, and a last step re-weights. A step is one aggregation of integer moments
(vectors are fixed-point, so sums are exact in any order), at most BINS rows a group and start.

Groups are nested: all texts, a language, a language and source. A group's own estimate weighs its
rows against PRIOR_ROWS rows of the estimate around it, centre and covariance alike, within every
step, so the determinant is that of the regularised covariance, groups of any size have an estimate
and every text is judged. Variances have a floor besides, so that a statistic most texts share doesn't
turn small differences into outliers; short texts' ratios are drawn to common values by PRIOR words. A
text is kept if no base rule fails and its Mahalanobis distance is within LIMIT.

Nulls: a null text has no words (so fails); null language or source is a group of its own. Repeated
rows each count and get equal verdicts. Empty input gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name as _free
from .common import numbered, scratch, written
from .encoding import forget

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of words
RUN = 8
#: Words added to ratios, and what they are taken to hold.
PRIOR = 50.0
PRIOR_WORD_CHARS, PRIOR_UPPER = 5.0, 0.02
UNIT = 256  # fixed-point steps of a statistic
DIMS = 6
#: Smallest standard deviation of each statistic.
FLOORS = (0.25, 0.15, 0.06, 0.08, 0.12, 0.12)
COVERAGE = 0.75
MAX_STEPS = 30
PRIOR_ROWS = 25
STABLE = 1e-3  # a determinant's logarithm that falls by no more has a stable subset
REWEIGHT = 0.975
TAIL = 5e-4
PER_OCTAVE, BINS = 16, 320
STARTS = 3
BLOCK_ROWS, HELD_ROWS, HELD_SUMS = 4096, 200_000, 400
FINE = 1 << 20  # fixed-point steps of signs and squashed values
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
SUMS = 1 + DIMS + len(PAIRS)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words inside runs of RUN words that occur twice or more."""
    n = len(words) - RUN + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    mixed = ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(RUN):
        h = h * np.uint64(0x100000001B3) + mixed[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    near = np.zeros(n, bool)
    near[order[1:][same]] = True
    near[order[:-1][same]] = True
    seen: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(near).tolist():  # equal hashes only: compare the runs themselves
        seen.setdefault(ids[i : i + RUN].tobytes(), []).append(i)
    hit = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                hit[i] += 1
                hit[i + RUN] -= 1
    return int((hit.cumsum() > 0).sum())


def statistics(text: str) -> tuple[list[int], list[int]]:
    """The counts and the fixed-point vector of a text."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    dup = len(lines) - len(set(lines))
    upper = len(text) - sum(map(len, _not_upper(text)))
    vector = (
        math.log1p(n),
        (chars + PRIOR * PRIOR_WORD_CHARS) / (n + PRIOR),
        math.sqrt(symbols / (chars + PRIOR * PRIOR_WORD_CHARS)),
        math.sqrt((upper + PRIOR * PRIOR_WORD_CHARS * PRIOR_UPPER) / (chars + PRIOR * PRIOR_WORD_CHARS)),
        dup / (len(lines) + 4),
        math.log1p(len(set(words))),
    )
    return [n, chars, symbols, dup, repeat_words(words)], [round(UNIT * x) for x in vector]


def _not_upper(text: str):
    import re

    global _UPPER
    if _UPPER is None:
        _UPPER = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x250) if chr(c).isupper()) + "]+")
    return _UPPER.split(text)


_UPPER = None


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


@functools.cache
def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(df / 2, mid / 2) < p else (low, mid)
    return high


@functools.cache
def consistency(p: float, df: int) -> float:
    """What the covariance of the nearest share p of normal rows is multiplied by."""
    return p / _gamma_p(df / 2 + 1, chi2_quantile(p, df) / 2)


LIMIT = chi2_quantile(1 - TAIL, DIMS)


def with_statistics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column: a struct of the counts and the vector; and its name."""
    name = _free(docs.columns, "quality_stats")
    at = docs.columns.index(text_col)
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("x", T.ArrayType(T.LongType()))])

    def run(batches):
        forget()
        for batch in batches:
            got = [statistics(t.as_py() or "") for t in batch.column(at)]
            arrays = [pa.array([c[k] for c, _ in got], pa.int64()) for k in range(len(COUNTS))]
            arrays.append(pa.array([x for _, x in got], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(arrays, [*COUNTS, "x"])], [*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    return docs.mapInArrow(run, schema), name


def distance(x: Column, centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance; inverse: the upper triangle by rows."""
    off = [(x[i].cast("double") - centre[i]) for i in range(DIMS)]
    terms = [off[i] * off[j] * inverse[k] * F.lit(1.0 if i == j else 2.0) for k, (i, j) in enumerate(PAIRS)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


_KEYS = ["level", "lang", "source"]
_KEY_FIELDS = [pa.field("level", pa.int32()), pa.field("lang", pa.string()), pa.field("source", pa.string())]
_SUM_COLUMNS = [f"m{k}" for k in range(SUMS)]
_SUMMED = "level int, lang string, source string, start int, bin int, " + ", ".join(f"{c} long" for c in _SUM_COLUMNS)
_LISTS = "array<array<double>>"
#: A list of STARTS each: cov without floors, logdet with them, done if the start is stable. fixed: made
#: under the last estimate of the group around; best: the start of the smallest determinant.
_PARAMS = f"level int, lang string, source string, centre {_LISTS}, cov {_LISTS}, inverse {_LISTS}, logdet array<double>, done array<boolean>, fixed boolean, best int"
_VECTORS = pa.list_(pa.list_(pa.float64()))
_PARAM_SCHEMA = pa.schema([*_KEY_FIELDS, *[(n, _VECTORS) for n in ("centre", "cov", "inverse")], ("logdet", pa.list_(pa.float64())), ("done", pa.list_(pa.bool_())), ("fixed", pa.bool_()), ("best", pa.int32())])
_OWN_SCHEMA = pa.schema([*_KEY_FIELDS, ("n", pa.float64()), ("mean", pa.list_(pa.float64())), ("cov", pa.list_(pa.float64()))])
_OWN = "level int, lang string, source string, n double, mean array<double>, cov array<double>"
_FLOOR = np.diag((np.array(FLOORS) * UNIT) ** 2)


def _square(upper) -> np.ndarray:
    out = np.zeros((DIMS, DIMS))
    for v, (i, j) in zip(upper, PAIRS):
        out[i, j] = out[j, i] = v
    return out


def _upper(square: np.ndarray) -> list[float]:
    return [float(square[i, j]) for i, j in PAIRS]


def _params(key: dict, found: list[tuple], done: list[bool], fixed: bool) -> dict:
    """found: centre and covariance of every start."""
    wholes = [cov + _FLOOR for _, cov in found]
    logdet = [float(np.linalg.slogdet(w)[1]) for w in wholes]
    return key | {
        "centre": [[float(c) for c in centre] for centre, _ in found], "cov": [_upper(cov) for _, cov in found], "inverse": [_upper(np.linalg.inv(w)) for w in wholes],
        "logdet": logdet, "done": done, "fixed": fixed, "best": int(np.argmin(logdet)),
    }


def _bins(d2: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(PER_OCTAVE * np.log2(d2 + 2.0**-4) + 4 * PER_OCTAVE), 0, BINS - 1).astype(np.int64)


def _distances(x: np.ndarray, centre, inverse) -> np.ndarray:
    """Term by term, so a row's distance doesn't depend on the rows around it."""
    off = [x[:, i] - centre[i] for i in range(DIMS)]
    total = np.zeros(len(x))
    for v, (i, j) in zip(inverse, PAIRS):
        total += off[i] * off[j] * (v if i == j else 2 * v)
    return np.maximum(total, 0.0)


def _same(a: DataFrame, b: DataFrame, keys=_KEYS, how: str = "inner") -> DataFrame:
    """a joined to b where keys are equal or both null; b's keys go."""
    b = b.withColumnsRenamed({k: f"p_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in keys]
    joined = a.join(b, on, how)
    return joined if how == "left_semi" else joined.drop(*[f"p_{k}" for k in keys])


def _level(k: int) -> list[Column]:
    """The key of a row's group at level k: 0 language and source, 1 language, 2 all."""
    none = F.lit(None).cast("string")
    return [F.lit(k).alias("level"), (F.col("lang") if k < 2 else none).alias("lang"), (F.col("source") if k < 1 else none).alias("source")]


def _blocks(fit: DataFrame) -> DataFrame:
    """lang, source, x: up to BLOCK_ROWS vectors of a group in a row, as they lie in the partitions."""

    def pack(batches):
        held: dict[tuple, list] = {}
        rows = 0

        def flush(keys):
            for lang, source in keys:
                x = np.array(held.pop((lang, source)), np.int32)
                for at in range(0, len(x), BLOCK_ROWS):
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang], pa.string()), "source": pa.array([source], pa.string()), "x": pa.array([x[at : at + BLOCK_ROWS].tobytes()], pa.binary())})

        for batch in batches:
            for lang, source, x in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault((lang, source), []).append(x)
            rows += batch.num_rows
            full = list(held) if rows > HELD_ROWS else [k for k, v in held.items() if len(v) >= BLOCK_ROWS]
            rows -= sum(len(held[k]) for k in full)
            yield from flush(full)
        yield from flush(list(held))

    return fit.mapInArrow(pack, "lang string, source string, x binary")


def _keyed(batches):
    """(key, vectors, the rest of the row) of every row of blocks joined to parameters."""
    for batch in batches:
        for row in batch.to_pylist():
            x = np.frombuffer(row.pop("x"), np.int32).reshape(-1, DIMS).astype(np.int64)
            yield {k: row.pop(k) for k in _KEYS}, x, row


def _sums(batches, each):
    """Sums of integer columns by key, start and bin; each(x, row) yields (start, bins, columns)."""
    held: dict[tuple, np.ndarray] = {}

    def flush():
        there = [np.flatnonzero(total[:, 0]) for total in held.values()]
        names = [[name] * len(at) for name, at in zip(held, there)]
        level, lang, source, start = zip(*(n for part in names for n in part))
        sums = np.concatenate([total[at] for total, at in zip(held.values(), there)])
        keys = [pa.array(level, pa.int32()), pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(start, pa.int32()), pa.array(np.concatenate(there), pa.int32())]
        held.clear()
        yield pa.RecordBatch.from_arrays([*keys, *[pa.array(np.ascontiguousarray(sums[:, k])) for k in range(SUMS)]], [*_KEYS, "start", "bin", *_SUM_COLUMNS])

    for key, x, row in _keyed(batches):
        for start, bins, columns in each(x, row):
            total = held.setdefault((*key.values(), start), np.zeros((BINS, SUMS), np.int64))
            order = np.argsort(bins, kind="stable")
            there, first = np.unique(bins[order], return_index=True)
            total[there, 0] += np.diff(np.append(first, len(order)))
            total[there, 1:] += np.add.reduceat(columns[order], first, axis=0)
            if len(held) > HELD_SUMS:
                yield from flush()
    if held:
        yield from flush()


def _products(v: np.ndarray) -> np.ndarray:
    return np.column_stack([v, *[v[:, i] * v[:, j] for i, j in PAIRS]])


def _added(found: DataFrame) -> DataFrame:
    return found.groupBy(*_KEYS, "start", "bin").agg(*[F.sum(c).alias(c) for c in _SUM_COLUMNS])


def _moments(sums: np.ndarray, weights: list[tuple[int, float]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Weight, mean and covariance of the rows in the first bins, the last of them in part."""
    total = [0.0] * SUMS
    exact = [0] * SUMS
    for k, w in weights:  # whole bins as integers, so no sum loses anything
        for c in range(SUMS):
            if w == 1.0:
                exact[c] += int(sums[k, c])
            else:
                total[c] += w * float(sums[k, c])
    n = exact[0] + total[0]
    mean = np.array([(exact[1 + i] + total[1 + i]) / n for i in range(DIMS)])
    cov = np.zeros((DIMS, DIMS))
    for k, (i, j) in enumerate(PAIRS):
        second = exact[1 + DIMS + k]
        if any(total):
            value = (second + total[1 + DIMS + k]) / n - mean[i] * mean[j]
        else:
            value = (second * exact[0] - exact[1 + i] * exact[1 + j]) / exact[0] ** 2
        cov[i, j] = cov[j, i] = value
    return n, mean, cov


def _estimate(sums: np.ndarray, bins: np.ndarray, reweighted: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, centre and covariance of a group's subset."""
    counts = sums[:, 0]
    if reweighted:  # every row within the distance
        last = int(np.searchsorted(bins, _bins(np.array([chi2_quantile(REWEIGHT, DIMS)]))[0], "right"))
        weights = [(k, 1.0) for k in range(max(1, last))]
    else:
        want, weights = math.ceil(COVERAGE * int(counts.sum())), []
        for k, n in enumerate(counts.tolist()):
            weights.append((k, 1.0 if n <= want else want / n))
            want -= min(n, want)
            if not want:
                break
    n, mean, cov = _moments(sums, weights)
    return n, mean, cov * consistency(REWEIGHT if reweighted else COVERAGE, DIMS)


def _drawn(n: float, mean: np.ndarray, cov: np.ndarray, around: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance, n rows' worth of them, with PRIOR_ROWS rows' worth of those around."""
    if around is None:
        return mean, cov
    own = n / (n + PRIOR_ROWS)
    return own * mean + (1 - own) * around[0], own * cov + (1 - own) * around[1]


def _by_group(batches):
    """(row, start -> (sums by bin, bins) in the bins' order) of every group."""
    for batch in batches:
        rows = batch.drop_columns(["f"]).to_pylist()
        lists = batch["f"]
        each = lists.values if lists.offset == 0 else lists.flatten()
        ends = np.concatenate([[0], np.cumsum([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()])])
        starts, bins = each.field("start").to_numpy(), each.field("bin").to_numpy()
        sums = np.column_stack([each.field(c).to_numpy() for c in _SUM_COLUMNS])
        for row, a, b in zip(rows, ends, ends[1:]):
            out = {}
            for s in np.unique(starts[a:b]).tolist():
                at = a + np.flatnonzero(starts[a:b] == s)
                at = at[np.argsort(bins[at])]
                out[s] = sums[at], bins[at]
            yield row, out


def _key_of(row: dict) -> dict:
    return {k: row[k] for k in _KEYS}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _started(batches):
    """The starts of every group, from its medians and spreads and the sums of signs and squashed values."""
    out = []
    for row, found in _by_group(batches):
        centre, spread = np.array(row["centre"]), np.sqrt(np.array(row["spread"]))
        covs = [np.diag(spread**2)]
        for start in range(1, STARTS):
            n, mean, cov = _moments(found[start][0], [(k, 1.0) for k in range(len(found[start][0]))])
            cov = cov / FINE**2
            if start == 1:  # signs are about zero: their second moment
                cov = cov + np.outer(mean, mean) / FINE**2
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            covs.append(cov / np.outer(scale, scale) * np.outer(spread, spread))
        out.append(_params(_key_of(row), [(centre, c) for c in covs], [False] * STARTS, False))
    yield _batch(out, _PARAM_SCHEMA)


def _concentrated(step: int):
    """The next estimates of every group's starts that aren't stable yet."""

    def run(batches):
        out = []
        for row, found in _by_group(batches):
            top = row["level"] == 2
            around = None if top else (np.array(row["p_centre"]), _square(row["p_cov"]))
            news, done = [], list(row["done"])
            for s in range(STARTS):
                old = np.array(row["centre"][s]), _square(row["cov"][s])
                if done[s] or s not in found:
                    news.append(old)
                    continue
                new = _drawn(*_estimate(*found[s], False), around)
                if step and (top or row["fixed"]):  # both determinants are under one estimate around
                    fell = row["logdet"][s] - float(np.linalg.slogdet(new[1] + _FLOOR)[1])
                    done[s] = fell <= STABLE or step == MAX_STEPS - 1
                    new = new if fell > 0 else old
                news.append(new)
            out.append(_params(_key_of(row), news, done, top or row["p_done"]))
        yield _batch(out, _PARAM_SCHEMA)

    return run


def _reweighted(batches):
    out = []
    for row, found in _by_group(batches):
        n, mean, cov = _estimate(*found[row["best"]], True)
        out.append(_key_of(row) | {"n": n, "mean": mean.tolist(), "cov": _upper(cov)})
    yield _batch(out, _OWN_SCHEMA)


def _nested(batches):
    """Centre and inverse of every language and source, drawn to those around, level by level."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("centre", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64()))])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            around = None
            for k in (2, 1, 0):
                around = _drawn(row[f"n{k}"], np.array(row[f"mean{k}"]), _square(row[f"cov{k}"]), around)
            out.append({"lang": row["lang"], "source": row["source"], "centre": around[0].tolist(), "inverse": _upper(np.linalg.inv(around[1] + _FLOOR))})
        yield _batch(out, schema)


def _robust(fit: DataFrame) -> DataFrame:
    """Medians and quartile spreads of every group at every level."""
    q = [F.percentile(F.col("x")[k], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{k}") for k in range(DIMS)]
    # fixed-point values: the percentiles hold one count for each distinct value
    got = fit.select("x", F.explode(F.array(*[F.struct(*_level(k)) for k in range(3)])).alias("key")).groupBy("key").agg(*q)
    spread = [F.pow((F.col(f"q{k}")[2] - F.col(f"q{k}")[0]) / 1.349, 2) + (FLOORS[k] * UNIT) ** 2 for k in range(DIMS)]
    return got.select("key.*", F.array(*[F.col(f"q{k}")[1].cast("double") for k in range(DIMS)]).alias("centre"), F.array(*spread).alias("spread"))


def _signs(batches):
    def each(x, row):
        z = (x - np.array(row["centre"])) / np.sqrt(np.array(row["spread"]))
        size = np.maximum(np.sqrt((z * z).sum(axis=1)), 1e-12)
        none = np.zeros(len(x), np.int64)
        yield 1, none, _products(np.rint(z / size[:, None] * FINE).astype(np.int64))
        yield 2, none, _products(np.rint(np.tanh(z) * FINE).astype(np.int64))

    return _sums(batches, each)


def _counted(last: bool):
    def each(x, row):
        columns = _products(x)
        for start in range(STARTS):
            if start == row["best"] if last else not row["done"][start]:
                yield start, _bins(_distances(x, row["centre"][start], row["inverse"][start])), columns

    return lambda batches: _sums(batches, each)


def estimates(fit: DataFrame) -> DataFrame:
    """lang, source, centre, inverse of every group; fit: lang, source, x. All levels take their steps
    together, each under the best estimate so far of the group around. Groups travel as tables: the
    joins' own size checks decide whether they are broadcast. Of each step one bit comes to the driver."""
    with scratch(fit.sparkSession):
        blocks = written(_blocks(fit.select("lang", "source", "x")), "vectors")
        rows = blocks.select("x", F.explode(F.array(*[F.struct(*_level(k)) for k in range(3)])).alias("key")).select("key.*", "x")

        def summed(side: DataFrame, params: DataFrame, what) -> DataFrame:
            """side with f: the sums of its groups' rows, by start and bin."""
            found = _added(_same(rows, params).mapInArrow(what, _SUMMED))
            found = found.groupBy(*_KEYS).agg(F.collect_list(F.struct("start", "bin", *_SUM_COLUMNS)).alias("f"))  # STARTS x BINS at most
            return _same(side, found, how="left")

        robust = written(_robust(fit), "robust")
        params = written(summed(robust, robust, _signs).mapInArrow(_started, _PARAMS), "starts")
        every = lambda c: F.forall(c, lambda d: d)
        for step in range(MAX_STEPS):
            best = lambda c: F.col(c)[F.col("best")].alias(f"p_{c}")
            around = params.where("level > 0").select(F.col("level").alias("p_level"), F.col("lang").alias("p_lang"), best("centre"), best("cov"), every("done").alias("p_done"))
            wanted = (F.col("p_level") == F.col("level") + 1) & F.col("p_lang").eqNullSafe(F.when(F.col("level") == 0, F.col("lang")))
            side = params.join(around, wanted, "left").drop("p_level", "p_lang")
            moving = params.where(~every("done")).select(*_KEYS, "centre", "inverse", "done")
            params = written(summed(side, moving, _counted(False)).mapInArrow(_concentrated(step), _PARAMS), "mcd")
            if step > 2 and params.where(~every("done")).isEmpty():
                break
        chosen = params.select(*_KEYS, "centre", "inverse", "best")
        own = written(summed(chosen.select(*_KEYS, "best"), chosen, _counted(True)).mapInArrow(_reweighted, _OWN), "own")
        at = lambda k: own.where(F.col("level") == k).select("lang", "source", *[F.col(c).alias(f"{c}{k}") for c in ("n", "mean", "cov")])
        whole = at(2).drop("lang", "source").withColumn("level", F.lit(2))
        nested = _same(at(0), at(1).drop("source"), ["lang"]).withColumn("level", F.lit(2)).join(whole, "level")
        return written(nested.mapInArrow(_nested, "lang string, source string, centre array<double>, inverse array<double>"), "estimates", keep=True)


def base_failed(c) -> Column:
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEATED * c("n_words"))


def _judge(rows: DataFrame, stats: str, lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, str]:
    """rows (with lang, source and the statistics' struct) with a verdict: base_failed, distance, kept."""
    rows = written(rows, "quality", keep=True)
    c = lambda n: F.col(stats)[n]
    lang, source = F.col(lang_col).cast("string"), F.col(source_col).cast("string")
    params = estimates(rows.where(~base_failed(c)).select(lang.alias("lang"), source.alias("source"), c("x").alias("x")))
    one, verdict = _free(rows.columns, "quality_group"), _free(rows.columns, "quality_verdict")
    p = params.select(F.struct("lang", "source", "centre", "inverse").alias(one))
    found = rows.join(p, lang.eqNullSafe(F.col(one)["lang"]) & source.eqNullSafe(F.col(one)["source"]), "left")
    d = distance(c("x"), F.col(one)["centre"], F.col(one)["inverse"])
    kept = ~base_failed(c) & (F.coalesce(d, F.lit(0.0)) <= LIMIT)
    return found.withColumn(verdict, F.struct(base_failed(c).alias("base_failed"), d.alias("distance"), kept.alias("kept"))).drop(one), verdict


def quality(docs: DataFrame, id_col: str = "doc_id", **cols) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the distance of every row."""
    names = [id_col, cols.get("text_col", "text"), cols.get("lang_col", "lang"), cols.get("source_col", "source")]
    plain = docs.select(*[F.col(n).alias(m) for n, m in zip(names, ("doc_id", "text", "lang", "source"))])
    rows, stats = with_statistics(plain)
    rows = rows.drop("text")
    found, verdict = _judge(rows, stats)
    return found.select("doc_id", *[F.col(stats)[n].alias(n) for n in COUNTS], F.col(verdict)["base_failed"].alias("base_failed"), F.col(verdict)["kept"].alias("kept"), F.round(F.col(verdict)["distance"], 6).alias("distance"))


def filtered(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that are kept, with docs' columns."""
    plain, (t, lang, source) = numbered(docs, text_col, lang_col, source_col)
    rows, stats = with_statistics(plain, t)
    found, verdict = _judge(rows, stats, lang, source)
    return found.where(F.col(verdict)["kept"]).select(*plain.columns).toDF(*docs.columns)
