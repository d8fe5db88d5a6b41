"""Where a page may be cut: before openers, between words, at the raw place of a normalised one.

Cuts are expressions over a text and a place in it: what stands before the place and after it is read
off by regular expressions inside code generation. Give them the neighbourhood of a cut, not a whole book.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Opening brackets and quotes a cut moves in front of.
OPENERS = "([{«“‘\"'﴾﴿"

_OPEN = "[" + "".join("\\" + c if c in "([{" else c for c in OPENERS) + "]"
#: Openers up to the cut, each with at most one space after it.
_OPENERS_BEFORE = rf"(?U)((?:{_OPEN}\s?)+)\z"
_IN_WORD = r"(?U)[\p{L}\p{N}]"
#: Words a search for the nearest start passes at most so many characters of.
RADIUS = 14


def _halves(text: Column, at: Column) -> tuple[Column, Column]:
    return F.substring(text, F.lit(1), at), F.substring(text, at + 1, F.length(text))


def before_openers(text: Column, at: Column) -> Column:
    """Move a cut left over openers, and over single spaces that follow one."""
    before, _ = _halves(text, at)
    return at - F.length(F.regexp_extract(before, _OPENERS_BEFORE, 1))


def word_start(text: Column, at: Column, radius: int = RADIUS) -> Column:
    """Move a cut inside a word to the nearest start of a word within ``radius``, to the left on ties."""
    before, after = _halves(text, at)
    inside = before.rlike(_IN_WORD + r"\z") & after.rlike(r"\A" + _IN_WORD)
    back = F.length(F.regexp_extract(before, r"(?U)\s(\S+)\z", 1))
    ahead = F.length(F.regexp_extract(after, r"(?U)\A(\S*\s+)\S", 1))
    near = lambda n: F.when(n.between(1, radius), n).otherwise(radius + 1)
    left, right = near(back), near(ahead)
    move = F.when(F.least(left, right) > radius, 0).when(left <= right, -left).otherwise(right)
    return at + F.when(inside, move).otherwise(0)


def snap(text: Column, at: Column) -> Column:
    """A cut in raw text, moved before openers and out of words; null stays null."""
    return word_start(text, before_openers(text, at))


def to_raw(norm_map: Column, place: Column, raw_length: Column) -> Column:
    """Raw place of a normalised one; places past the end are the end of the text."""
    return F.when(place >= F.size(norm_map), raw_length).otherwise(F.get(norm_map, place))


def slice_text(text: Column, start: Column, lo: Column, hi: Column) -> Column:
    """The part of ``text`` (which begins at ``start``) inside ``[lo, hi)``; empty if they do not meet."""
    a = F.greatest(lo - start, F.lit(0))
    n = F.least(hi - start, F.length(text)) - a
    return F.when(n > 0, F.substring(text, a + 1, n)).otherwise("")
