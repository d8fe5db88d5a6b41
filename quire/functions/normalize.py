"""Matching normalisation of text, as Python kernels, pandas UDFs and native expressions.

One character at a time: compatibility composition (NFKC), then tatweel, marks and format
characters are dropped, decimal digits become ASCII, letter variants are folded, and of the rest
only letters and numbers stay, in lower case. Normalised text serves comparison only.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that count as one in matching (target: its variants).
LETTER_FOLD = {
    "ي": "ىیېۍێےئؠ",
    "ك": "کڪګگ",
    "ه": "ةہھەۀۂۃ",
    "ا": "أإآٱٲٳ",
    "و": "ؤۋۆۇۈ",
    "ب": "پ",
    "ج": "چ",
    "ز": "ژ",
    "ف": "ڤ",
    "ق": "ڨ",
}
_TO = {v: k for k, vs in LETTER_FOLD.items() for v in vs}
TATWEEL = "ـ"


def fold_char(ch: str) -> str:
    """What one source character contributes to the normalised text (maybe nothing, maybe several)."""
    kept = []
    for c in unicodedata.normalize("NFKC", ch):
        kind = unicodedata.category(c)
        if kind == "Nd":
            kept.append(str(unicodedata.digit(c)))
        elif kind[0] in "LN" and c != TATWEEL:
            kept.append(_TO.get(c, c).lower())
    return "".join(kept)


class _Table(dict):
    """A translation table that learns each code point when it is first met."""

    def __missing__(self, code: int) -> str:
        self[code] = out = fold_char(chr(code))
        return out


TABLE = _Table()


def normalize_text(text: str) -> str:
    return text.translate(TABLE)


def normalize_with_map(text: str) -> tuple[str, list[int]]:
    """The normalised text and, for each of its characters, the place it came from in ``text``."""
    out, places = [], []
    for i, ch in enumerate(text):
        if rep := TABLE[ord(ch)]:
            out.append(rep)
            places.extend([i] * len(rep))
    return "".join(out), places


@F.pandas_udf(T.StringType())
def normalize_udf(s: pd.Series) -> pd.Series:
    """Full normalisation; null stays null, text without letters or digits becomes empty."""
    return s.map(lambda x: x.translate(TABLE), na_action="ignore")


_MAPPED = T.StructType([T.StructField("norm", T.StringType()), T.StructField("norm_map", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_MAPPED)
def normalize_map_udf(s: pd.Series) -> pd.DataFrame:
    """Normalised text with the map to source positions; null gives nulls."""
    rows = [(None, None) if x is None else normalize_with_map(x) for x in s]
    return pd.DataFrame(rows, columns=["norm", "norm_map"])


def normalize_native(col: Column) -> Column:
    """The same without Python, for text free of compatibility characters (presentation forms,
    full-width forms, superscripts): translate and regular expressions inside code generation."""
    src = "".join(_TO)
    dst = "".join(_TO.values())
    digits = "".join(chr(b + i) for b in (0x0660, 0x06F0) for i in range(10))
    return F.lower(
        F.regexp_replace(F.translate(col, src + digits, dst + "0123456789" * 2), r"[^\p{L}\p{N}]|ـ", "")
    )


def has_compatibility_chars(col: Column) -> Column:
    """Whether text needs the full kernel: a character whose NFKC form differs may be in it."""
    return col.rlike(r"[^\x00-\x7F\x{00C0}-\x{024F}\x{0400}-\x{0529}\x{0600}-\x{0674}\x{0679}-\x{06FF}\x{2010}\x{2013}-\x{2015}\x{2018}-\x{201F}«»]")
