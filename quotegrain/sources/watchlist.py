"""Watchlist text to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import symbol

MOST = 120
# Fixed value: the form of a group's header line.
HEADER = r"^#\s*-{2,}\s*(.+?)\s*-{2,}\s*$"
# Patterns of group names, in order, and the proxy of each.
GROUP_PROXY = [
    (r"semiconduct|memory|storage|optic|network", "SMH"),
    (r"ai compute|datacenter", "SMH"),
    (r"power|energy", "SPY"),
    (r"miner|royalty|metals", "GDX"),
    (r"software", "IGV"),
    (r"macro|benchmark", None),
    (r"broad|thematic|crypto", "SPY"),
]


def proxy_of(group: Column) -> Column:
    out = F
    for pattern, proxy in GROUP_PROXY:
        out = out.when(group.rlike(f"(?i){pattern}"), F.lit(proxy))
    return out.otherwise("SPY")


def _lines(text: DataFrame) -> DataFrame:
    """``text``: whole files in a column value."""
    return text.select(F.posexplode(F.split("value", "\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", "\r", "")))


def symbols(text: DataFrame) -> DataFrame:
    """(pos, symbol): comments cut, upper case, the first of repeats."""
    rows = _lines(text).withColumn("symbol", symbol(F.substring_index("line", "#", 1))).where("symbol <> ''")
    return rows.groupBy("symbol").agg(F.min("pos").alias("pos"))


def groups(text: DataFrame) -> DataFrame:
    """(ticker, group, proxy): the header above a symbol names its group; the last of repeats counts. A watchlist is one
    ordered file, so its lines stay together."""
    rows = _lines(text).withColumn("header", F.nullif(F.regexp_extract("line", HEADER, 1), F.lit("")))
    w = Window.partitionBy(F.lit(0)).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("group", F.coalesce(F.last("header", ignorenulls=True).over(w), F.lit("Ungrouped"))).where("header is null")
    rows = rows.withColumn("ticker", symbol(F.substring_index("line", "#", 1))).where("ticker <> ''")
    return rows.groupBy("ticker").agg(F.max_by("group", "pos").alias("group")).withColumn("proxy", proxy_of(F.col("group")))


def quotable(rows: DataFrame, c: str = "symbol") -> DataFrame:
    return rows.where(~F.col(c).rlike(r"[\^=.]") & ~F.col(c).endswith("-USD"))


def from_text(df: DataFrame, c: str) -> DataFrame:
    """Symbols of free text, parted by commas or white space, in order, without repeats."""
    rows = df.select(F.posexplode(F.split(c, r"[,\s]+")).alias("pos", "s")).withColumn("symbol", symbol(F.col("s"))).where("symbol <> ''")
    return rows.groupBy("symbol").agg(F.min("pos").alias("pos"))


def request(rows: DataFrame, most: int = MOST) -> DataFrame:
    """The first ``most`` different symbols of (symbol, pos), by their first place."""
    once = rows.withColumn("symbol", symbol(F.col("symbol"))).where("symbol <> ''").groupBy("symbol").agg(F.min("pos").alias("pos"))
    return once.orderBy("pos", "symbol").limit(most)
