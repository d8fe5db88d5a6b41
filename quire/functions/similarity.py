"""Dice similarity of texts on character trigrams, counted with multiplicity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Four bytes a character: any piece of a text is then a slice of bytes, found without reading from the start.
FIXED = "UTF-32"


def pieces(text: Column, places: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """``places`` gets a function from start and length (characters, from 0) to the bytes of that piece of
    ``text``. The text is encoded once a row: as an element of an array it is bound before pieces are cut."""
    cut = lambda b: lambda start, n: F.substring(b, start * 4 + 1, n * 4)
    return F.get(F.transform(F.array(F.encode(text, FIXED)), lambda b: places(cut(b))), F.lit(0))


def as_text(piece: Column) -> Column:
    # decoding drops one byte order mark: the one put in front, not the text's own
    return F.decode(F.concat(F.unhex(F.lit("0000FEFF")), piece), FIXED)


def grams(text: Column, k: int) -> Column:
    """The k-grams of a text in order, as bytes (see ``as_text``); none if it is shorter or null."""
    at = F.sequence(F.lit(0), F.length(text) - k)
    return F.when(F.length(text) >= k, pieces(text, lambda cut: F.transform(at, lambda i: cut(i, F.lit(k))))).otherwise(
        F.expr("cast(array() as array<binary>)")
    )


def dice(pairs: DataFrame, keys: list[str], a: str, b: str, k: int = 3) -> DataFrame:
    """``*keys, dice`` of each row: 0 if a text is empty or null; texts shorter than ``k`` are alike only if equal.

    Trigrams are counted per row in one pass, without a join: the side is a sign in the sum.
    """
    rows = pairs.select(*keys, F.coalesce(a, F.lit("")).alias("_a"), F.coalesce(b, F.lit("")).alias("_b"))
    sides = F.concat(
        F.transform(grams(F.col("_a"), k), lambda g: F.struct(g.alias("g"), F.lit(1).alias("x"), F.lit(0).alias("y"))),
        F.transform(grams(F.col("_b"), k), lambda g: F.struct(g.alias("g"), F.lit(0).alias("x"), F.lit(1).alias("y"))),
    )
    common = (
        rows.where((F.length("_a") >= k) & (F.length("_b") >= k))
        .select(*keys, F.explode(sides).alias("_s"))
        .groupBy(*keys, "_s.g")
        .agg(F.least(F.sum("_s.x"), F.sum("_s.y")).alias("_n"))
        .groupBy(*keys)
        .agg(F.sum("_n").alias("_n"))
    )
    short = (F.length("_a") < k) | (F.length("_b") < k)
    value = (
        F.when((F.col("_a") == "") | (F.col("_b") == ""), 0.0)
        .when(short, F.when(F.col("_a") == F.col("_b"), 1.0).otherwise(0.0))
        .otherwise(2.0 * F.coalesce("_n", F.lit(0)) / (F.length("_a") + F.length("_b") - 2 * (k - 1)))
    )
    return rows.join(common, keys, "left").select(*keys, value.alias("dice"))
