"""Joins on order: latest before, nearest with a tolerance, intervals that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stacked(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, take: list[str]):
    a = left.select(*by, F.col(on).alias("_at"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("_r"))
    b = right.select(*by, F.col(right_on).alias("_at"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*take).alias("_r"))
    return a.unionByName(b)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, take: list[str]) -> DataFrame:
    """Each left row with ``take`` of the last right row of its group at or before it; nulls if there is none.

    One shuffle and sort by group and place, no pairs. Rows with a null place have no partner. Of right
    rows at one place any may be taken: make their places distinct first.
    """
    rows = _stacked(left, right, by, on, right_on, take)
    w = Window.partitionBy(*by).orderBy("_at", F.col("_l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_found", F.last("_r", ignorenulls=True).over(w)).where("_l IS NOT NULL")
    found = lambda c: F.when(F.col("_at").isNotNull(), F.col(f"_found.{c}")).alias(c)
    return out.select("_l.*", *(found(c) for c in take))


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, within: int, ties: str = "before") -> DataFrame:
    """Each left row with ``nearest``: the closest right place not farther than ``within``, else null."""
    rows = _stacked(left, right, by, on, right_on, [right_on])
    w = Window.partitionBy(*by).orderBy("_at", F.col("_l").isNotNull())
    back = F.last(f"_r.{right_on}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    w2 = Window.partitionBy(*by).orderBy(F.desc("_at"), F.col("_l").isNotNull())
    ahead = F.last(f"_r.{right_on}", ignorenulls=True).over(w2.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.select("_l", "_at", back.alias("_b"), ahead.alias("_a")).where("_l IS NOT NULL")
    db, da = F.col("_at") - F.col("_b"), F.col("_a") - F.col("_at")
    first_b = (db <= da) if ties == "before" else (db < da)
    pick = F.when(F.col("_a").isNull() | first_b, F.col("_b")).otherwise(F.col("_a"))
    return out.select("_l.*", F.when(F.abs(pick - F.col("_at")) <= within, pick).alias("nearest"))


def overlap_join(spans: DataFrame, ranges: DataFrame, by: list[str], s: tuple[str, str], r: tuple[str, str], width: int = 2000) -> DataFrame:
    """Pairs of spans and ranges of one group that overlap; ends are exclusive, a span without length meets the range it stands in.

    Both sides are dealt into cells of ``width``; a pair is taken in the cell where its overlap begins,
    so a long group is many join keys.
    """
    cell = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.greatest(F.col(hi) - 1, F.col(lo)) / width)))
    a = spans.where(F.col(s[0]).isNotNull() & (F.col(s[1]) >= F.col(s[0]))).withColumn("_cell", cell(*s))
    b = ranges.where(F.col(r[0]).isNotNull() & (F.col(r[1]) > F.col(r[0]))).withColumn("_cell", cell(*r))
    meets = F.when(F.col(s[1]) > F.col(s[0]), (F.col(s[0]) < F.col(r[1])) & (F.col(s[1]) > F.col(r[0]))).otherwise(
        (F.col(s[0]) >= F.col(r[0])) & (F.col(s[0]) < F.col(r[1]))
    )
    begin = F.floor(F.greatest(F.col(s[0]), F.col(r[0])) / width)
    return a.join(b, [*by, "_cell"]).where(meets & (F.col("_cell") == begin)).drop("_cell")


def as_int(c: Column | str) -> Column:
    return F.col(c).cast("int") if isinstance(c, str) else c.cast("int")
