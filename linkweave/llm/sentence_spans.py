"""Op 4: repeated runs of sentences, removed wherever they are not the first.

Texts are cut into sentences (terminator and white space, or line feeds) and these further before the
word with the least hash of any WINDOW words in a row, so a cut depends on the words next to it only
and no piece is over WINDOW words. From every piece starts a run of at least RUN pieces
that goes on until it has MIN_WORDS words, and one such run leads up to every sentence's end; the run's hash (128 bits of its words, white space aside)
is counted over the corpus. A passage that repeats holds a cut in its first WINDOW words, and cuts are
the same wherever WINDOW words of it are to either side: one of MIN_WORDS + 3 * WINDOW - 2 = 50 words
or more, however it lies in sentences, holds a whole run. Of each repeated run the first by (document id, text hash, place) stays; sentences
under any other occurrence are removed. Only hashes and places are shuffled for this; texts move once,
to meet what is to be removed.

Nulls: a null text has no sentences and stays null; a null id sorts first. Rows with equal id and text
are one document and share their fate. Runs within one document count too. Empty input gives no rows.
"""

from __future__ import annotations

import re
import struct
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, text_of, written

RUN = 2
MIN_WORDS = 16
WINDOW = 12
NO_ID = -(1 << 63)
_ENDS = re.compile(r"[.!?。！？]+[\"'”’)\]]*\s+|[。！？]+|\n\s*")
_WORD = re.compile(r"\S+")


def sentences(text: str) -> list[str]:
    """Pieces that join to the text again."""
    return _cut(text)[0]


def _cut(text: str) -> tuple[list[str], list[list[str]], list[bool]]:
    """Pieces, their words and whether a sentence ends with them."""
    pieces, words, ends = [], [], []
    for piece, end in _split(text):
        w = piece.split()
        if len(w) > WINDOW:
            cuts = _cuts(w)
            starts = _starts(piece, w, cuts)
            pieces += map(piece.__getitem__, map(slice, [0, *starts], [*starts, len(piece)]))
            words += map(w.__getitem__, map(slice, [0, *cuts], [*cuts, len(w)]))
            ends += [False] * len(cuts)
        else:
            pieces.append(piece)
            words.append(w)
        ends.append(end)
    return pieces, words, ends


def _cuts(words: list[str]) -> list[int]:
    """The words that have the least hash of some WINDOW words (the last of equal ones), but the first."""
    hashes = list(map(crc32, map(str.encode, words)))
    out, best, least = [], -1, 0
    for at, h in enumerate(hashes[WINDOW - 1 :], WINDOW - 1):
        if best <= at - WINDOW:
            least = min(hashes[at - WINDOW + 1 : at + 1])
            best = at
            while hashes[best] != least:
                best -= 1
        elif h <= least:
            best, least = at, h
        else:
            continue
        if best:
            out.append(best)
    return out


def _starts(piece: str, words: list[str], cuts: list[int]) -> list[int]:
    """Where these words start."""
    lead = piece.index(words[0])
    ends = list(accumulate(map(len, words)))
    if lead + ends[-1] + len(words) - 1 == len(piece.rstrip()):  # one white space between any two
        return [lead + ends[k - 1] + k for k in cuts]
    starts = [m.start() for m in _WORD.finditer(piece)]
    return [starts[k] for k in cuts]


def _split(text: str) -> list[tuple[str, bool]]:
    out, at = [], 0
    for m in _ENDS.finditer(text):
        out.append((text[at : m.end()], True))
        at = m.end()
    if at < len(text):
        out.append((text[at:], False))
    return out


def runs(pieces: list[str]) -> list[tuple[int, int, int, int]]:
    """(first, count, hash, hash) of every run."""
    first, count, digests = _runs([p.split() for p in pieces], [bool(_ENDS.search(p)) for p in pieces])
    return [(a, n, *struct.unpack(">QQ", d)) for a, n, d in zip(first, count, digests)]


def _runs(words: list[list[str]], ends: list[bool]) -> tuple[list[int], list[int], list[bytes]]:
    """First, count and hash of every run of pieces with these words."""
    from xxhash import xxh3_128_digest

    real = [k for k, w in enumerate(words) if w]  # blank pieces belong to what is before them
    joined = [" ".join(words[k]).encode() for k in real]
    upto = [0, *accumulate(len(words[k]) for k in real)]
    spans, last, n = [], 0, len(real)
    for a in range(n):
        enough, least = upto[a] + MIN_WORDS, a + RUN
        while last < n and (upto[last] < enough or last < least):
            last += 1
        if upto[last] < enough or last < least:
            break
        spans.append((a, last))
    known, a = set(spans), 0
    for last in range(1, n + 1):  # the shortest run up to the end of a sentence
        if last == n or ends[real[last - 1]]:
            enough = upto[last] - MIN_WORDS
            while a + 1 < last and upto[a + 1] <= enough and last - a - 1 >= RUN:
                a += 1
            if upto[a] <= enough and last - a >= RUN and (a, last) not in known:
                spans.append((a, last))
    whole, at = b" ".join(joined), [0, *accumulate(len(j) + 1 for j in joined)]
    digests = [xxh3_128_digest(whole[at[a] : at[last] - 1]) for a, last in spans]
    return [real[a] for a, _ in spans], [real[last - 1] - real[a] + 1 for a, last in spans], digests


def _places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """i, h, a (first piece), n (pieces), k1, k2 of every run; a = -1: n counts the pieces of a whole text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, first, count, keys = [], [], [], []
                for t in part.column(2):
                    pieces, words, ends = _cut(t.as_py())
                    a, n, k = _runs(words, ends)
                    rows.append(len(a) + 1)
                    first += [-1, *a]
                    count += [len(pieces), *n]
                    keys += [bytes(16), *k]
                of = np.repeat(np.arange(len(rows)), rows)
                k = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)), pa.array(first, pa.int32()), pa.array(count, pa.int32()), pa.array(k[:, 0]), pa.array(k[:, 1])], ["i", "h", "a", "n", "k1", "k2"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("i"), F.xxhash64(text_of(text_col)).alias("h"), text_of(text_col).alias("t"))
    return rows.mapInArrow(run, "i long, h long, a int, n int, k1 long, k2 long")


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """i, h, pieces (how many), gone (sorted (first, count) runs of pieces to remove, null where none) of each document."""
    with scratch(docs.sparkSession):
        cut = written(_places(docs, id_col, text_col), "runs")
        places = cut.where("a >= 0")
        again = written(places.groupBy("k1", "k2").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "repeated")
        found = written(places.join(again, ["k1", "k2"], "left_semi"), "found")
        first = written(found.groupBy("k1", "k2").agg(F.min(F.struct("i", "h", "a")).alias("first")), "first")
        other = found.join(first, ["k1", "k2"]).where(F.struct("i", "h", "a") != F.col("first"))
        gone = other.groupBy("i", "h").agg(F.array_sort(F.collect_set(F.struct("a", "n"))).alias("gone"))
        pieces = cut.where("a < 0").groupBy("i", "h").agg(F.max("n").cast("long").alias("pieces"))
        return written(pieces.join(gone, ["i", "h"], "left"), "gone", keep=True)


def _without(pieces: list[str], gone) -> tuple[str, int]:
    keep, n = bytearray(b"\x01") * len(pieces), 0
    for r in gone:
        for k in range(r["a"], r["a"] + r["n"]):
            n += keep[k]
            keep[k] = 0
    return "".join(p for p, k in zip(pieces, keep) if k), n


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (what is left), n_sentences, n_removed of every row."""
    gone = covered(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("i"), F.xxhash64(text_of(text_col)).alias("h"))
    rows = rows.join(gone, ["i", "h"], "left").select("doc_id", "t", "pieces", "gone")

    def apply(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, lost = part.column(1).to_pylist(), [0] * part.num_rows
                for k, g in enumerate(part.column(3).to_pylist()):
                    if g:  # other texts stay whole and need no cutting
                        texts[k], lost[k] = _without(sentences(texts[k] or ""), g)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), part.column(2), pa.array(lost, pa.int64())], ["doc_id", "text", "n_sentences", "n_removed"])

    return rows.mapInArrow(apply, "doc_id long, text string, n_sentences long, n_removed long")
