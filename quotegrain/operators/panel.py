"""Cleaning, indexing and length-gating of daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

MIN_BARS = 260


def clean(bars: DataFrame) -> DataFrame:
    """Bars with a close; open, high, low and adjusted close fall back to it, volume to 0."""
    kept = bars.where("close is not null")
    fill = {c: F.coalesce(c, "close") for c in ("open", "high", "low", "adj_close")}
    return kept.withColumns({**fill, "volume": F.coalesce("volume", F.lit(0).cast("bigint"))})


def indexed(bars: DataFrame) -> DataFrame:
    """With i, the bar's place from 0, and n, the ticker's bars. One exchange by ticker serves all that follows."""
    by = Window.partitionBy("ticker")
    return bars.withColumns({"i": F.row_number().over(by.orderBy("date")) - 1, "n": F.count("*").over(by)})


def eligible(panel: DataFrame, least: int = MIN_BARS) -> DataFrame:
    return panel.where(F.col("n") >= least)


def skipped(bars: DataFrame, least: int = MIN_BARS) -> DataFrame:
    counts = clean(bars).groupBy("ticker").agg(F.count("*").alias("bars"))
    return counts.where(F.col("bars") < least).select("ticker", "bars", F.lit(f"fewer than {least} bars").alias("reason"))


def latest(panel: DataFrame) -> DataFrame:
    """The newest row of each ticker."""
    return panel.where(F.col("i") == F.col("n") - 1)
