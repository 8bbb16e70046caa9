"""Lookup queries over bars and quotes; each is one plan for all tickers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import change, change_pct, symbol
from ..scratch import written
from ..sources.ingest import NAMED, run_summary
from ..sources.versioned import VersionedTable

MOST_ROWS = 1000
DMA = 200


def coverage(bars: DataFrame) -> DataFrame:
    """Rows (with or without a close) and dates per ticker."""
    return bars.groupBy("ticker").agg(F.count("*").alias("bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def history(bars: DataFrame, ticker: str | Column, start: str | None = None, end: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first; ``ticker`` may be a scalar subquery."""
    rows = bars.where(F.col("ticker") == (ticker.strip().upper() if isinstance(ticker, str) else ticker))
    rows = rows.where(F.col("date") >= F.lit(start).cast("date")) if start else rows
    rows = rows.where(F.col("date") <= F.lit(end).cast("date")) if end else rows
    return rows.orderBy(F.desc("date")).limit(min(max(int(limit), 1), MOST_ROWS))


def newest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key, by one aggregate."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(key, "r.*")


def latest_quotes(bars: DataFrame, spot: DataFrame) -> DataFrame:
    """Newest bar and newest quote of each ticker; either may be missing."""
    b = newest(bars.select("ticker", "date", "close", "volume"), "ticker", "date")
    s = newest(spot.select("ticker", "captured_at", "price", "previous_close"), "ticker", "captured_at")
    return b.join(s, "ticker", "full_outer")


def performance(bars: DataFrame, tickers: list[str] | DataFrame, start: Column, end: Column) -> DataFrame:
    """First and last close in a span and the change in percent, best first, unknown last. ``tickers``: a list, or a
    table with that column."""
    rows = bars.where(F.col("close").isNotNull() & F.col("date").between(start, end))
    if isinstance(tickers, DataFrame):
        rows = rows.join(tickers.select(symbol(F.col("ticker")).alias("ticker")), "ticker", "left_semi")
    else:
        rows = rows.where(F.col("ticker").isin([t.strip().upper() for t in tickers]))
    per = rows.groupBy("ticker").agg(F.min_by("close", "date").alias("first_close"), F.max_by("close", "date").alias("last_close"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    pct = F.round(F.try_divide(F.col("last_close") - F.col("first_close"), F.col("first_close")) * 100, 2)
    return per.withColumn("pct_change", pct).orderBy(F.desc_nulls_last("pct_change"), "ticker")


def run_select(spark: SparkSession, views: dict[str, DataFrame], query: str) -> DataFrame:
    """One SELECT or WITH statement over the given views, at most 1000 rows."""
    text = query.strip().rstrip(";")
    words = set(re.findall(r"[a-z_]+", text.lower()))
    banned = {"insert", "update", "delete", "drop", "alter", "create", "attach", "detach", "pragma", "replace", "vacuum", "reindex", "analyze"}  # fixed values
    if ";" in text or not re.match(r"(?i)(select|with)\b", text) or words & banned:
        raise ValueError("only one SELECT or WITH statement is allowed")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(text).limit(MOST_ROWS)  # names are resolved here
    finally:
        for name in views:
            spark.catalog.dropTempView(name)


#: Months that hold 200 closes of a ticker that trades on most days.
RECENT_MONTHS = 14


def recent_bars(table: VersionedTable, universe: DataFrame, months: int = RECENT_MONTHS) -> DataFrame:
    """The bars of a table in parts by month that a snapshot of these tickers needs: of the newest months, and of older ones
    only for tickers that have fewer than 200 closes there. If there are none, older months are not read at all."""
    version = table.manifest()
    parts = sorted(version.parts, reverse=True)
    recent = table.read(version.version, parts[:months]).join(universe.select("ticker").distinct(), "ticker", "left_semi")
    if not parts[months:]:
        return recent
    full = recent.groupBy("ticker").agg(F.count("close").alias("k")).where(F.col("k") >= DMA)
    short = written(universe.select("ticker").distinct().join(full, "ticker", "left_anti"), "short")
    if not short.head(1):
        return recent
    return recent.unionByName(table.read(version.version, parts[months:]).join(short, "ticker", "left_semi"))


def snapshot(bars: DataFrame, spot: DataFrame) -> DataFrame:
    """Newest bar, newest quote and the 200-bar mean, which needs 200 closes; one row per known ticker."""
    # bars are read once: the newest and the mean come from one aggregate
    w = Window.partitionBy("ticker").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    counted = bars.select("ticker", "date", "close", "volume").withColumn("k", F.count("close").over(w))
    near = F.col("close").isNotNull() & (F.col("k") <= DMA)
    b = counted.groupBy("ticker").agg(
        F.max_by(F.struct("date", "close", "volume"), "date").alias("r"), F.avg(F.when(near, F.col("close"))).alias("mean"), F.count_if(near).alias("dma_bars")
    ).select("ticker", "r.*", "mean", "dma_bars")
    s = newest(spot.select("ticker", "captured_at", "price", "previous_close"), "ticker", "captured_at")
    out = b.join(s, "ticker", "full_outer")
    price = F.coalesce("price", "close")
    dma200 = F.when(F.col("dma_bars") >= DMA, F.col("mean"))
    return out.select(
        "ticker", "date", F.round("close", 4).alias("close"), "volume", "captured_at", F.round("price", 4).alias("price"), F.round(dma200, 4).alias("dma200"),
        F.round(F.try_divide(price - dma200, dma200) * 100, 2).alias("vs_dma200_pct"), F.coalesce("dma_bars", F.lit(0).cast("bigint")).alias("dma_bars"),
    )


def quote_changes(spot: DataFrame) -> DataFrame:
    last, prev = F.col("price"), F.col("previous_close")
    return newest(spot.select("ticker", "captured_at", "price", "previous_close"), "ticker", "captured_at").select("ticker", "price", "previous_close", change(last, prev).alias("change"), change_pct(last, prev).alias("change_pct"))


def answered(requested: DataFrame, quotes: DataFrame) -> DataFrame:
    """requested (pos, ticker), each with its quote or an error text."""
    return requested.join(quotes, "ticker", "left").withColumn("error", F.when(F.col("price").isNull(), F.lit("no quote")))


def envelope(requested: DataFrame, quotes: DataFrame, named: int = NAMED) -> DataFrame:
    """(requested, ok, failed) of requested (pos, ticker): counts, and the first failures in the order of requests."""
    out = run_summary(answered(requested, quotes), "pos", named)
    return out.select((F.col("ok") + F.col("failed")).alias("requested"), "ok", F.col("failed_tickers").alias("failed"))
