"""Trend structure, volatility state and participation: what a setup is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import ratio
from .indicators import lag, sma, trailing
from .panel import latest

RANK_WINDOW = 252
CONTRACTED, EXPANDED, BUYERS = 0.20, 0.80, 1.2
PIVOT = 5


def newest_rank(panel: DataFrame, c: str, name: str, k: int = RANK_WINDOW) -> DataFrame:
    """``panel`` with ``name``: at a ticker's newest row the share of its last k rows whose value is at or below that row's;
    null unless all k have one, and at other rows."""
    whole = Window.partitionBy("ticker").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last, own = F.col("i") > F.col("n") - 1 - k, F.col(f"_newest_{c}")
    below = F.count_if(last & (F.col(c) <= own)).over(whole) / F.lit(float(k))
    full = F.count(F.when(last, F.col(c))).over(whole) == k
    return panel.withColumn(f"_newest_{c}", F.last(c).over(whole)).withColumn(name, F.when((F.col("i") == F.col("n") - 1) & full, below)).drop(f"_newest_{c}")


def stack_state(c: str = "close") -> Column:
    x, a, b, d = (F.col(n) for n in (c, "e20", "e50", "e200"))
    return F.when((x > a) & (a > b) & (b > d), "aligned_up").when((x < a) & (a < b) & (b < d), "aligned_down").when(a.isNotNull() & b.isNotNull() & d.isNotNull(), "mixed")


def up_down(k: int) -> tuple[Column, Column]:
    """Volume of rising and of falling closes over the last k rows."""
    v, move = F.col("volume").cast("double"), F.col("close") - F.col("pc")
    return tuple(F.sum(F.when(cond, v).otherwise(0.0)).over(trailing(k)) for cond in (move > 0, move < 0))


def swings(panel: DataFrame) -> DataFrame:
    """(ticker, swing): the last two confirmed pivot highs and lows. A pivot is the only extreme of 5 rows to each side."""
    around = Window.partitionBy("ticker").orderBy("i").rowsBetween(-PIVOT, PIVOT)
    inside = (F.col("i") >= PIVOT) & (F.col("i") < F.col("n") - PIVOT)

    def alone(c, best):
        return inside & (F.col(c) == best(c).over(around)) & (F.size(F.filter(F.collect_list(c).over(around), lambda x: x == F.col(c))) == 1)

    marked = panel.select("ticker", "i", "high", "low", alone("high", F.max).alias("top"), alone("low", F.min).alias("bottom")).where("top or bottom")
    order = Window.partitionBy("ticker", "side").orderBy(F.desc("i"))
    sides = marked.select("ticker", "i", F.explode(F.array(
        F.struct(F.lit("top").alias("side"), F.when(F.col("top"), F.col("high")).alias("value")), F.struct(F.lit("bottom").alias("side"), F.when(F.col("bottom"), F.col("low")).alias("value")),
    )).alias("p")).select("ticker", "i", "p.*").where("value is not null")
    last = sides.withColumn("k", F.row_number().over(order)).where("k <= 2")
    at = lambda side, k: F.max(F.when((F.col("side") == side) & (F.col("k") == k), F.col("value")))
    both = last.groupBy("ticker").agg((at("top", 1) > at("top", 2)).alias("hh"), (at("bottom", 1) > at("bottom", 2)).alias("hl"))
    label = F.when(F.col("hh") & F.col("hl"), "HH/HL").when(~F.col("hh") & ~F.col("hl"), "LH/LL").when(F.col("hh").isNotNull() & F.col("hl").isNotNull(), "mixed")
    return both.select("ticker", label.alias("swing"))


def setup(panel: DataFrame) -> DataFrame:
    """One row per ticker from an indicator panel: the setup record, rounded."""
    v = F.col("volume").cast("double")
    # no window below reaches further back from the newest row
    df = panel.where(F.col("i") >= F.col("n") - RANK_WINDOW - 1).withColumn("pc", lag("close"))
    up, down = up_down(50)
    signed = F.signum(F.col("close") - F.col("pc")) * v
    has_range = F.col("high") > F.col("low")
    df = df.withColumns({
        "stack": stack_state(), "slope": F.when(F.col("i") >= 63, ratio(F.col("e200"), lag("e200", 63)) - 1), 
        "pos20": F.avg(F.when(has_range, F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")))).over(trailing(20)),
        "up": up, "down": down, "vol50": F.sum(v).over(trailing(50)), "s10": sma(v, 10), "s50": sma(v, 50),
        "d_obv": F.sum(signed).over(trailing(63)), "d_px": F.col("close") - lag("close", 63), "vol63": F.sum(v).over(trailing(63)),
    })
    row = latest(newest_rank(df, "atr_pct", "rank"))
    state = F.when(F.col("rank") <= CONTRACTED, "contracted").when(F.col("rank") >= EXPANDED, "expanded").when(F.col("rank").isNotNull(), "normal")
    ud = F.when((F.col("vol50") != 0) & (F.col("up") + F.col("down") != 0), F.when(F.col("down") == 0, 9.99).otherwise(F.least(F.try_divide(F.col("up"), F.col("down")), F.lit(9.99))))
    row = row.withColumns({"vol_state": state, "ud": ud})
    obv = F.when((F.col("i") < 63) | (F.col("vol63") == 0), None).when((F.col("d_px") > 0) & (F.col("d_obv") < 0), "bearish_divergence").when((F.col("d_px") < 0) & (F.col("d_obv") > 0), "bullish_divergence").otherwise("confirms")
    out = row.select(
        "ticker", "stack", F.round("slope", 4).alias("ema200_slope_63d"), F.round("pos20", 3).alias("close_pos_20"), F.round("atr_pct", 2).alias("atr_pct"),
        F.round("rank", 3).alias("atr_pct_rank_1y"), "vol_state", F.round("ud", 2).alias("ud_vol_50d"),
        F.when(F.col("s10") != 0, F.round(ratio(F.col("s10"), F.col("s50")), 2)).alias("vol_10v50"), F.round(ratio(v, F.col("s50")), 2).alias("rvol"), obv.alias("obv_63d"),
        F.coalesce((F.col("stack") == "aligned_up") & (F.col("vol_state") == "contracted") & (F.col("ud") >= BUYERS), F.lit(False)).alias("in_setup"),
    )
    return out.join(swings(panel), "ticker", "left")
