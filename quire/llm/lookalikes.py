"""One consistent form for texts that look the same.

Composed compatibility forms, mapped white space and removal of default-ignorable characters, once
per distinct value of a batch. Only differences that do not show are levelled: of the compatibility mappings
those the character data tag as width, presentation form or no-break, and the block of ligatures; not
superscripts, fractions or circled signs. Case shows and stays, unless ``fold_case`` asks for full case
folding. Letters of another alphabet become the letter whose shape they have in that place of the word; for
Arabic that depends on joining. Characters are taken apart before letters are mapped and composed after,
so composed and decomposed spellings have one form whatever alphabet their letters are from.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import checkpoint

# Letters with the shape of a Latin letter (shape: letters of other alphabets).
SAME_SHAPE = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СᏟϹ", "E": "ЕΕᎬ", "F": "Ϝ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫ", "K": "КΚᏦ",
    "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ",
    "Y": "ҮΥ", "Z": "ΖᏃ", "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ",
    "n": "ո", "o": "оοօ", "p": "р", "q": "ԛզ", "s": "ѕ", "u": "ս", "v": "ѵν", "w": "ԝ", "x": "х", "y": "у",
}
# Digits of the two Arabic sets that have one shape, and letters of one shape anywhere.
SAME_DIGITS = ("۰۱۲۳۷۸۹", "٠١٢٣٧٨٩")
# Letters equal only where they join the next letter: (variants, shape there).
JOINED_SHAPE = {"ي": "ی", "ې": "ې", "ك": "ک", "ہ": "ه", "ھ": "ھ"}
# Letters equal only where they do not join the next letter.
END_SHAPE = {"ى": "ی", "ە": "ه", "ہ": "ه"}
# Arabic letters that join the letter before them only (also hamza, which joins none).
_RIGHT = set("اآأإٱٲٳٵدذڈډڊڋڌڍڎڏڐرزژڑڒړڔڕږڗڙوؤۄۅۆۇۈۉۊۋۏةۃۀەىۍےۓ") - set("ى")
_NONE = set("ءٴ")
ZWNJ = "\u200c"

_TAGS = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>"}
_LIGATURES = range(0xFB00, 0xFB50)


def _ignorable(code: int) -> bool:
    """Default-ignorable code points (by rule: format characters and the blocks set aside)."""
    return (
        code in (0x00AD, 0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0xFEFF)
        or 0x180B <= code <= 0x180F
        or 0x200B <= code <= 0x200F
        or 0x202A <= code <= 0x202E
        or 0x2060 <= code <= 0x206F
        or 0xFE00 <= code <= 0xFE0F
        or code == 0x061C
        or 0x1BCA0 <= code <= 0x1BCA3
        or 0xE0000 <= code <= 0xE0FFF
    )


_LATIN = {ord(v): k for k, vs in SAME_SHAPE.items() for v in vs} | {
    ord(a): b for a, b in zip(*SAME_DIGITS)
}


def _base(code: int) -> str:
    """What a character contributes before joining is looked at."""
    ch = chr(code)
    if ch == ZWNJ:  # it keeps letters apart: whether it shows depends on its neighbours
        return ch
    if _ignorable(code):
        return ""
    if ch == "\n":
        return ch
    kind = unicodedata.category(ch)
    if kind == "Zs" or ch == "\t":
        return " "
    if kind in ("Zl", "Zp") or ch in "\r\x0b\x0c\x85":
        return "\n"
    apart = unicodedata.normalize("NFD", ch)
    if apart != ch:  # composed again at the end
        return "".join(_base(ord(c)) for c in apart)
    parts = unicodedata.decomposition(ch).split()
    if parts and (parts[0] in _TAGS or (parts[0] == "<compat>" and code in _LIGATURES)):
        return "".join(_base(int(p, 16)) for p in parts[1:])
    return _LATIN.get(code, ch)


class _Table(dict):
    def __missing__(self, code: int) -> str:
        self[code] = out = _base(code)
        return out


_TABLE = _Table()
_MARK = r"[ً-ٰٟۖ-ۜ۟-۪ۤۧۨ-ۭ̀-ͯ]*"
_DUAL = "[" + "".join(
    c for c in map(chr, range(0x0620, 0x06D4))
    if unicodedata.category(c) == "Lo" and c not in _RIGHT and c not in _NONE
) + "ـ]"
_JOINS = "[" + "".join(
    c for c in map(chr, range(0x0620, 0x06D6)) if unicodedata.category(c) == "Lo" and c not in _NONE
) + "ـ]"
_ZWNJ = re.compile(rf"({_DUAL}{_MARK})\u200c+(?={_MARK}{_JOINS})|\u200c+")
_NEXT = rf"(?={_MARK}{_JOINS})"
_TO_JOINED = re.compile(rf"([{''.join(JOINED_SHAPE)}]){_NEXT}")
_TO_END = re.compile(rf"([{''.join(END_SHAPE)}])(?!{_MARK}{_JOINS})")
_HAS_ARABIC = re.compile(r"[؀-ۿ]")


def canonical(text: str, fold_case: bool = False) -> str:
    """The consistent form of ``text``."""
    if text.isascii():
        out = text
        if "\r" in out or "\t" in out:
            out = out.translate(_TABLE)
    else:
        out = text.replace("\r\n", "\n").translate(_TABLE)
        out = unicodedata.normalize("NFC", out)
        if ZWNJ in out:
            out = _ZWNJ.sub(lambda m: m.group(1) + ZWNJ if m.group(1) else "", out)
        if _HAS_ARABIC.search(out):
            out = _TO_JOINED.sub(lambda m: JOINED_SHAPE[m.group(1)], out)
            out = _TO_END.sub(lambda m: END_SHAPE[m.group(1)], out)
    return unicodedata.normalize("NFC", out.casefold()) if fold_case else out


def canonical_udf(fold_case: bool = False):
    """Vectorised ``canonical``: each distinct value of a batch once; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}
        return pd.Series(
            [None if x is None else seen[x] if x in seen else seen.setdefault(x, canonical(x, fold_case)) for x in s],
            dtype=object,
        )

    return run


_DIGESTS = T.StructType([T.StructField("canon", T.BinaryType()), T.StructField("stored", T.BinaryType())])


@F.pandas_udf(_DIGESTS)
def _digests(s: pd.Series) -> pd.DataFrame:
    seen: dict[str, tuple[bytes, bytes] | tuple[None, None]] = {}
    out = []
    for x in s:
        if x is None:
            out.append((None, None))
            continue
        if x not in seen:
            raw, c = x.encode("utf-8", "surrogatepass"), canonical(x).encode("utf-8", "surrogatepass")
            seen[x] = (xxhash.xxh3_128_digest(c) if c.strip() else None, xxhash.xxh3_128_digest(raw))
        out.append(seen[x])
    return pd.DataFrame(out, columns=["canon", "stored"])


def with_digests(rows: DataFrame) -> DataFrame:
    """``field, id, canon, stored`` of rows ``field, id, text``: digests of both forms. Null texts and
    texts without a visible character are left out."""
    return rows.where("text IS NOT NULL AND id IS NOT NULL").select("field", "id", _digests("text").alias("_d")).select(
        "field", "id", "_d.canon", "_d.stored"
    ).where("canon IS NOT NULL")


def _members(rows: DataFrame) -> DataFrame:
    """Rows with the digests of forms that have two stored texts or more. The text kernel runs once: digests, not
    texts, are kept. Whether a form has two is told by the least and the greatest digest, which combine on the map side.
    """
    d = checkpoint(with_digests(rows))
    mixed = (
        d.groupBy("field", "canon")
        .agg(F.min("stored").alias("lo"), F.max("stored").alias("hi"))
        .where("lo <> hi")
        .select("field", "canon")
    )
    return checkpoint(d.join(mixed, ["field", "canon"], "left_semi").distinct())


def lookalike_classes(rows: DataFrame) -> DataFrame:
    """``field, id, class_id, links`` of rows ``field, id, text`` that have a look-alike: the least id of the records
    with their consistent form, and how many of those are stored differently. A record with two such texts has
    a row for each. Counts are added per stored text first: a running head on every page is one row there."""
    m = _members(rows)
    stored = m.groupBy("field", "canon", "stored").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    whole = stored.groupBy("field", "canon").agg(F.sum("n").alias("all"), F.min("low").alias("class_id"))
    links = stored.join(whole, ["field", "canon"]).select("field", "canon", "stored", "class_id", (F.col("all") - F.col("n")).alias("links"))
    return m.join(links, ["field", "canon", "stored"]).select("field", "id", "class_id", "links")


def lookalike_pairs(rows: DataFrame) -> DataFrame:
    """``field, a_id, b_id`` (``a_id < b_id``) of rows ``field, id, text``: different records whose
    texts have one consistent form and are stored differently. Identical texts are no pair.

    The classes of ``lookalike_classes`` written out: stored texts of a class are paired first, each with
    each, and their records after that, so no row is made that is no pair.
    """
    m = _members(rows)
    stored = m.select("field", "canon", "stored").distinct()
    key = ["field", "canon"]
    forms = (
        stored.withColumnRenamed("stored", "a").join(stored.withColumnRenamed("stored", "b"), key).where("a < b")
        .join(m.select(*key, F.col("stored").alias("a"), F.col("id").alias("i")), [*key, "a"])
        .join(m.select(*key, F.col("stored").alias("b"), F.col("id").alias("j")), [*key, "b"])
    )
    return forms.where("i <> j").select("field", F.least("i", "j").alias("a_id"), F.greatest("i", "j").alias("b_id")).distinct()


def text_fields(blocks: DataFrame, streams: DataFrame) -> DataFrame:
    """``field, id, text`` of the three text fields: blocks of any kind, raw and normalised streams."""
    s = streams.select(
        F.col("stream_id").alias("id"),
        F.explode(
            F.array(
                F.struct(F.lit("raw_text").alias("field"), F.col("raw_text").alias("text")),
                F.struct(F.lit("norm_text").alias("field"), F.col("norm_text").alias("text")),
            )
        ).alias("_t"),
    ).select("_t.field", "id", "_t.text")
    b = blocks.select(F.lit("text").alias("field"), F.col("block_id").alias("id"), "text")
    return b.unionByName(s)
