"""Byte-level BPE of whole texts through the tokenizers library, with a bounded cache of pieces.

Where spaces and line feeds stand alone between other characters, the vocabulary's splitting rule
keeps a space with what is behind it, makes a line feed a piece of its own and joins nothing across
either; a full stop or comma between a letter and either of them is a piece too. So Arrow cuts a batch
of plain texts there by literal replacement, and its dictionary encoding leaves each distinct unit of
the batch once; a unit seen before comes from the cache, others go to the library's model piece by
piece. Other texts go through the rule or the library one by one: those with a special token's string,
other white space, or characters whose class could differ between regular-expression engines.
"""

from __future__ import annotations

import re
from array import array
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_UNITS = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = "\n\t\r\x20-\x7e\xa1-\u024f"
_SAFE = re.compile(f"[{_LETTERS}]*\\Z")
#: White space that doesn't stand alone between two other characters, stops behind other signs, and
#: characters not known as safe.
_ODD = rf"^[ \n]|[ \n][ \n]|[ \n]\z|[\t\r]|(?:^|[^\p{{L}}\p{{N}}])[.,][ \n]|[^{_LETTERS}]"
CACHE_UNITS = 500_000  # in two halves: the older one goes when the younger is full
_MARK = "\x00"
BATCH_BYTES = 6 << 20


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteEncoder:
    """ids(text) as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from public_tokenizers import PATTERN

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = regex.compile(PATTERN).findall
        self.letters = _byte_letters()
        self.space = self.letters[0x20]
        self.odd = _ODD + "".join("|" + re.sub(r"(\W)", r"\\\1", x) for x in self.special)
        self.cache_units, self.known, self.older = cache_units, {}, {}

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        return ids if ids is not None else self._new(piece, True)

    def _new(self, unit: str, one: bool) -> bytes:
        """ids of a unit that isn't in the cache's younger half; one: whether it is a single piece."""
        ids = self.older.get(unit)
        return self._keep(unit, self._made(unit, one) if ids is None else ids)

    def _made(self, unit: str, one: bool) -> bytes:
        if one:
            return self._model(unit.encode().decode("latin-1").translate(self.letters))
        if not _SAFE.match(unit):
            return self.library(unit)
        return b"".join(map(self._piece, self.pieces(unit)))

    def _model(self, mapped: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(mapped)]).tobytes()

    def _keep(self, unit: str, ids: bytes) -> bytes:
        if len(unit) <= 64:
            if 2 * len(self.known) >= self.cache_units:
                self.known, self.older = {}, self.known
            self.known[unit] = ids
        return ids

    def _units(self, units: list[str]) -> list[bytes]:
        """ids of every unit; one of letters only, but for a space before them, is one piece."""
        out = list(map(self.known.get, units))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            unit = units[k]
            ids = self.older.get(unit)
            if ids is None:
                spaced = unit[:1] == " "
                body = unit[1:] if spaced else unit
                if not body.isalpha():
                    ids = self._made(unit, False) if unit else b""
                elif body.isascii():  # letters that stand for themselves
                    ids = self._model(self.space + body if spaced else body)
                else:
                    ids = self._made(unit, bool(_SAFE.match(unit)))
            out[k] = self._keep(unit, ids)
        return out

    def _unit(self, unit: str) -> bytes:
        return self._units([unit])[0]

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.library(text)
        first, *rest = _UNITS.split(text)
        return self._unit(first) + b"".join(self._unit(" " + x) for x in rest)

    def batch(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """The ids of all texts one after another, little-endian unsigned 32-bit integers, and how many
        each text has. Texts must not be null."""
        raw, n, at = [], [], 0
        while at < len(texts):  # long texts in smaller batches
            size = min(4096, len(texts) - at)
            while size > 1 and pc.sum(pc.binary_length(texts.slice(at, size))).as_py() > BATCH_BYTES:
                size //= 2
            part = texts.slice(at, size)
            odd = pc.match_substring_regex(part, self.odd).to_numpy(zero_copy_only=False)
            if odd.any():
                alone = [self.ids(t) for t in part.filter(pa.array(odd)).to_pylist()]
                plain, sizes = self._plain(part.filter(pa.array(~odd)))
                ends, here = iter(sizes.cumsum().tolist()), 0
                alone, counts = iter(alone), []
                for o in odd.tolist():
                    if o:
                        raw.append(next(alone))
                        counts.append(len(raw[-1]) // 4)
                    else:
                        end = next(ends)
                        raw.append(plain[4 * here : 4 * end])
                        counts.append(end - here)
                        here = end
                n.append(np.array(counts, np.int64))
            else:
                ids, sizes = self._plain(part)
                raw.append(ids)
                n.append(sizes)
            at += size
        return b"".join(raw), np.concatenate(n) if n else np.zeros(0, np.int64)

    def _plain(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """Texts without anything odd."""
        if not len(texts):
            return b"", np.zeros(0, np.int64)
        for sign, cut in ((" ", "| "), ("\n", "|\n|"), (".|", "|.|"), (",|", "|,|")):
            texts = pc.replace_substring(texts, sign.replace("|", _MARK), cut.replace("|", _MARK))
        units = pc.split_pattern(texts, _MARK)
        coded, sizes = units.flatten().dictionary_encode(), np.diff(units.offsets.to_numpy())
        ids = self._units(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        known = coded.indices.to_numpy()
        upto = np.fromiter(map(len, ids), np.int64, len(ids))[known].cumsum() // 4
        found = itemgetter(*known.tolist())(ids) if len(known) > 1 else [ids[k] for k in known]
        return b"".join(found), np.diff(upto[sizes.cumsum() - 1], prepend=0)


def with_ends(raw: bytes, sizes: np.ndarray, end_id: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A batch's ids in the given type with end_id behind each text, and where texts end."""
    ends = (sizes + 1).cumsum()
    ids = np.full(int(ends[-1]) if len(ends) else 0, end_id, kind)
    inside = np.ones(len(ids), bool)
    inside[ends - 1] = False
    ids[inside] = np.frombuffer(raw, "<u4")
    return ids, ends


_ENCODERS: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """One encoder a worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Frees this process's encoders: Spark gives a worker other work next, and a full cache takes some 120 MB."""
    if _ENCODERS:
        import gc

        _ENCODERS.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
