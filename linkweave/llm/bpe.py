"""Op 7: exact BPE by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives every token that starts at each place of a word.
The longest token goes first; it stands if it and the token before it are a compatible pair, that is,
if merging the two tokens' characters by the merge list gives just these two. A prefix has one exact
encoding, so a place from which no token fits is dead for good, the encoder steps back over it once,
and the work is linear in the word. The pair table fills as pairs are met and is bounded.

Texts are normalised and cut into words as the tokenizer file says: texts of common characters by
lower-casing and a pattern, others by the library's own normaliser and splitter. Words are encoded
here and kept in a bounded cache. Nulls: a null text is empty and gives no ids; repeated rows give a
row each; other columns are ignored; a word of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .encoding import _byte_letters

END = "</w>"
_SAFE = re.compile(r"[\n\t\r\x20-\x7e\xa1-ɏ]*\Z")
CACHE_WORDS = 600_000
CACHE_PAIRS = 2_000_000
_LAST = 0x10000  # a word's last character is shifted so: it carries the end mark


class BacktrackingBPE:
    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.vocab: dict[str, int] = config["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in config["model"]["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in reversed(list(enumerate(merges)))}
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(split).findall
        library = Tokenizer.from_file(path)
        self.normalize, self.presplit = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.letters = _byte_letters()
        self.automaton = ahocorasick.Automaton()
        self.symbols: dict[int, str] = {}
        for token, i in self.vocab.items():
            s = self._marked(token[: -len(END)]) if token.endswith(END) and token != END else token
            self.symbols[i] = s
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.single = {s: i for i, s in self.symbols.items() if len(s) == 1}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reachable: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        top = max([*self.vocab.values(), *self.special.values()]) + 1
        names = [b""] * top
        for token, i in [*self.vocab.items(), *self.special.items()]:
            names[i] = token.encode() + b" "
        self.blob = np.frombuffer(b"".join(names), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(n) for n in names])])

    @staticmethod
    def _marked(word: str) -> str:
        return word[:-1] + chr(ord(word[-1]) + _LAST)

    def merged(self, symbols: str) -> list[int]:
        """Plain merging, lowest rank first, leftmost of equals; for pairs of tokens only."""
        ids = [self.single[c] for c in symbols]
        while len(ids) > 1:
            rank, at = min((self.rank.get((a, b), (1 << 60, 0))[0], k) for k, (a, b) in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 60:
                break
            ids[at : at + 2] = [self.rank[ids[at], ids[at + 1]][1]]
        return ids

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(self.symbols[a] + self.symbols[b]) == [a, b]
        return found

    def _whole(self, i: int) -> bool:
        found = self.reachable.get(i)
        if found is None:
            found = self.reachable[i] = self.merged(self.symbols[i]) == [i]
        return found

    def word(self, mapped: str) -> list[int]:
        """ids of one word, given in the byte-level alphabet."""
        w = self._marked(mapped)
        n = len(w)
        starts: list[list] = [[] for _ in range(n + 1)]
        for end, token in self.automaton.iter(w):
            if self._whole(token[0]):
                starts[end - token[1] + 1].append(token)  # longer ones later
        ids, stack, dead, at = [], [], bytearray(n + 1), 0
        k = len(starts[0]) - 1
        while at < n:
            here = starts[at]
            while k >= 0 and (dead[at + here[k][1]] or ids and not self.compatible(ids[-1], here[k][0])):
                k -= 1
            if k >= 0:
                stack.append((at, k))
                ids.append(here[k][0])
                at += here[k][1]
                k = len(starts[at]) - 1
            else:
                dead[at] = 1
                at, k = stack.pop()
                ids.pop()
                k -= 1
        return ids

    def _unit(self, unit: str) -> bytes:
        """Common characters without white space, in lower case."""
        ids = array("I")
        for piece in self.find(unit):
            ids.extend(self.word(piece.encode().decode("latin-1").translate(self.letters)))
        out = ids.tobytes()
        if len(unit) <= 64:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            self.words[unit] = out
        return out

    def _segment(self, text: str) -> bytes:
        if _SAFE.match(text):
            get, make = self.words.get, self._unit
            return b"".join([get(u) or make(u) for u in text.lower().split()])
        ids = array("I")
        for piece, _ in self.presplit(self.normalize(text)):
            ids.extend(self.word(piece))
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        if "<|" not in text or not self._specials:
            return self._segment(text)
        parts = self._specials.split(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if k % 2 else self._segment(p) for k, p in enumerate(parts))

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings in UTF-8 with a space between: the file names no decoder."""
        out = []
        for at in range(0, len(ids), 1 << 16):
            part = ids[at : at + (1 << 16)]
            start, end = self.offsets[part], self.offsets[part + 1]
            size = end - start
            shift = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            out.append(self.blob[shift + np.arange(len(shift))].tobytes())
        return b"".join(out)[:-1]


_MADE: dict[str, BacktrackingBPE] = {}


def bpe(path: str) -> BacktrackingBPE:
    if path not in _MADE:
        _MADE[path] = BacktrackingBPE(path)
    return _MADE[path]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with keep also ids (array<int>) and decoded."""

    def run(batches):
        model = bpe(vocabulary)
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for t in batch.column(1):
                raw = model.encode(t.as_py())
                ids = np.frombuffer(raw, "<u4").astype(np.int64)
                text = model.decode(ids)
                cols[0].append(len(ids))
                cols[1].append(hashlib.sha256(raw).hexdigest())
                cols[2].append(hashlib.sha256(text).hexdigest())
                if keep:
                    cols[3].append(ids)
                    cols[4].append(text.decode())
            arrays = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            if keep:
                arrays += [pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return docs.select(F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t")).mapInArrow(run, schema)
