"""Brahmic scripts in Latin letters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin sounds by offset in a Brahmic block.
BRAHMIC = {
    0x02: "n", 0x03: "h",
    0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ee", 0x09: "u", 0x0A: "oo", 0x0B: "ri", 0x0E: "e", 0x0F: "ai", 0x10: "ai", 0x12: "o", 0x13: "au", 0x14: "au",
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "ng", 0x1A: "c", 0x1B: "ch", 0x1C: "j", 0x1D: "jh", 0x1E: "ny",
    0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x29: "nn",
    0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "rr", 0x32: "l", 0x33: "l", 0x34: "ll", 0x35: "v",
    0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h",
    0x3E: "a", 0x3F: "i", 0x40: "ee", 0x41: "u", 0x42: "oo", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x4D: "",
}
#: First code points of the blocks, which lay out their letters alike.
BLOCKS = range(0x0900, 0x0D80, 0x80)


def _every(first: int, last: int) -> str:
    """A character class's ranges of the offsets first to last in every block."""
    return "".join(f"{chr(b + first)}-{chr(b + last)}" for b in BLOCKS)


#: A consonant that no vowel sign, virama, nasal sign or breath follows has the inherent vowel.
_BARE = f"([{_every(0x15, 0x39)}])(?![{_every(0x02, 0x03)}{_every(0x3E, 0x4D)}])"


def latin(c: Column) -> Column:
    """All blocks' letters brought to the first block, then each replaced by its sound."""
    offsets = [o for o in BRAHMIC for _ in BLOCKS]
    s = F.translate(F.regexp_replace(c, _BARE, "$1a"), "".join(chr(b + o) for o in BRAHMIC for b in BLOCKS), "".join(chr(BLOCKS[0] + o) for o in offsets))
    for offset, sound in BRAHMIC.items():
        s = F.replace(s, F.lit(chr(BLOCKS[0] + offset)), F.lit(sound))
    return s
