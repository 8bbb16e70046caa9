"""Exact ranks, medians and row numbers without one task for all rows of a key.

Rows are dealt out to ranges of their order, whose borders Spark samples from the rows themselves, so ranges are of about
one size however values are spread. They are written with their range's number. The rows of each range, added up over
the ranges before it, say how many come before a range; inside a range rows are put in order. A median is looked for in
the one or two ranges that hold the middle ranks; the others are not read in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import written

_RANGE = "_range"


def _ranged(df: DataFrame, order: list[str], parts: int | None) -> DataFrame:
    """A written table with each row's range. Without ``parts`` there are as many as the session shuffles to, and Spark
    joins small neighbours."""
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return written(dealt.withColumn(_RANGE, F.spark_partition_id()), "ranges")


def _offsets(ranged: DataFrame, keys: list[str], size: str) -> DataFrame:
    """(keys, range, own, before, all): how many rows a key has in a range, before it, and in all. A row per key and range."""
    per = ranged.groupBy(*keys, _RANGE).agg(F.expr(size).alias("_own"))
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.sum("_own").over(by.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_own")
    return per.select(*keys, _RANGE, "_own", before.alias("_before"), F.sum("_own").over(by).alias("_all"))


def _counted(df: DataFrame, keys: list[str], value: str, parts: int | None) -> tuple[DataFrame, DataFrame]:
    """Different values with their counts, in ranges, and the ranges' offsets."""
    values = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    ranged = _ranged(values, [*keys, value], parts)
    return ranged, _offsets(ranged, keys, "sum(_k)")


def _upto(keys: list[str], value: str):
    """Rows of the key up to a value, from its range's offset."""
    inside = Window.partitionBy(*keys, _RANGE).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return F.col("_before") + F.sum("_k").over(inside)


def share_at_or_below(df: DataFrame, keys: list[str], value: str, parts: int | None = None) -> DataFrame:
    """(keys, value, share): of each different value, which share of its key's values is at or below it."""
    values, offsets = _counted(df, keys, value, parts)
    return values.join(offsets, [*keys, _RANGE]).select(*keys, value, (_upto(keys, value) / F.col("_all")).alias("share"))


def medians(df: DataFrame, keys: list[str], value: str, parts: int | None = None) -> DataFrame:
    """(keys, median): the middle value, or the mean of the two in the middle."""
    values, offsets = _counted(df, keys, value, parts)
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = offsets.where((F.col("_before") <= high) & (F.col("_before") + F.col("_own") > low))
    ranked = values.join(middle, [*keys, _RANGE]).select(*keys, value, "_all", _upto(keys, value).alias("_upto"))
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(value)))
    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "i", parts: int | None = None) -> DataFrame:
    """``df`` with each row's place in its key from 0, which no window over a whole key counts. ``order`` must be total."""
    ranged = _ranged(df, [*keys, *order], parts)
    inside = F.row_number().over(Window.partitionBy(*keys, _RANGE).orderBy(*order))
    met = ranged.join(_offsets(ranged, keys, "count(1)"), [*keys, _RANGE])
    return met.withColumn(name, F.col("_before") + inside - 1).select(*df.columns, name)
