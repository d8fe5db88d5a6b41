"""Runs of Arabic digits and the order of text on a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARABIC_DIGITS = "".join(chr(b + i) for b in (0x0660, 0x06F0) for i in range(10))
ASCII_DIGITS = "0123456789" * 2
_RUN = f"[{ARABIC_DIGITS}]"
#: An article split from the ligature of the name of God in extracted text.
_SPLIT_NAME = "[\u0627\ufe8d\ufe8e]\ufdf2"


def digit_runs(text: Column) -> Column:
    """Each run of two or more digits: ``struct(as_is, reversed)`` as decimals."""
    value = lambda x: F.translate(x, ARABIC_DIGITS, ASCII_DIGITS).cast("decimal(38,0)")
    runs = F.regexp_extract_all(text, F.lit(f"({_RUN}{{2,}})"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(value(r).alias("as_is"), value(F.reverse(r)).alias("reversed")))


def reverse_digit_runs(text: Column) -> Column:
    """Text with each run of digits turned round."""
    parts = F.regexp_extract_all(text, F.lit(f"({_RUN}+|[^{ARABIC_DIGITS}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^{_RUN}"), F.reverse(p)).otherwise(p)), "")


def ordered_lines(lines: Column, mode: str, reverse_digits: bool = False) -> Column:
    """Lines joined in the order ``logical``, ``reverse_chars`` or ``reverse_words``."""
    if mode == "reverse_chars":
        lines = F.transform(lines, F.reverse)
    elif mode == "reverse_words":
        lines = F.transform(lines, lambda x: F.array_join(F.reverse(F.split(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), " ")), " "))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, _SPLIT_NAME, "\ufdf2"))
    if reverse_digits:
        lines = F.transform(lines, reverse_digit_runs)
    return F.array_join(lines, "\n")
