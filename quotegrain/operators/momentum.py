"""Momentum of adjusted closes, ranks across tickers, strength against a proxy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.order import share_at_or_below
from ..functions.scalars import ratio
from ..scratch import written
from .indicators import lag, trailing
from .panel import latest

RETURNS = {"mom_12_1": (252, 21), "mom_6_1": (126, 21), "ret_12m": (252, 0), "ret_3m": (63, 0), "ret_1m": (21, 0)}
STRENGTH = 126


def momentum(panel: DataFrame) -> DataFrame:
    """One row per ticker of a panel with sma50 and sma200; six decimals."""
    df = panel.withColumns({k: ratio(lag("adj_close", b) if b else F.col("adj_close"), lag("adj_close", a)) - 1 for k, (a, b) in RETURNS.items()})
    df = df.withColumns({
        "hi": F.when(F.col("i") >= 251, F.max("close").over(trailing(252))), "lo": F.when(F.col("i") >= 251, F.min("close").over(trailing(252))),
        "strength_base": lag("close", STRENGTH),
    })
    c = F.col("close")
    own = {"dist_52w_high": ratio(c, F.col("hi")) - 1, "dist_52w_low": ratio(c, F.col("lo")) - 1, "vs_200dma": ratio(c, F.col("sma200")) - 1, "vs_50dma": ratio(c, F.col("sma50")) - 1}
    row = latest(df).withColumns(own)
    tsmom = F.when(F.col("ret_12m") > 0, 1).when(F.col("ret_12m").isNotNull(), -1)
    return row.select("ticker", *(F.round(k, 6).alias(k) for k in [*RETURNS, *own]), tsmom.alias("tsmom_12m"), ratio(c, F.col("strength_base")).alias("growth"))


def ranks(rows: DataFrame, groups: DataFrame, value: str = "mom_12_1") -> DataFrame:
    """Share of the universe, and of the group, at or below; three decimals. ``groups``: ticker, group."""
    joined = rows.select("ticker", value).join(groups.select("ticker", "group"), "ticker", "left").withColumn("group", F.coalesce("group", F.lit("Ungrouped")))
    joined = written(joined, "ranked")  # a row for each ticker; both ranks and the result read it
    known = joined.where(F.col(value).isNotNull())

    def share(by: list[str], name: str):
        return share_at_or_below(known, by, value).withColumn(name, F.round("share", 3)).drop("share")

    universe, group = share([], "rank_universe"), share(["group"], "rank_group")
    return joined.join(universe, value, "left").join(group, ["group", value], "left").select("ticker", "group", value, "rank_universe", "rank_group")


def relative_strength(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Growth over 126 bars against the proxy's; null without a proxy or enough bars of both. Bars align by count."""
    own = rows.select("ticker", "growth").join(groups.select("ticker", "proxy", F.lit(True).alias("known")), "ticker", "left")
    own = own.withColumn("proxy", F.when(F.col("known"), F.col("proxy")).otherwise("SPY"))
    other = rows.select(F.col("ticker").alias("proxy"), F.col("growth").alias("proxy_growth"))
    return own.join(other, "proxy", "left").select("ticker", "proxy", F.round(ratio(F.col("growth"), F.col("proxy_growth")) - 1, 6).alias("rs_126d"))
