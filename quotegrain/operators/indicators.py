"""Moving averages, oscillators and ranges per ticker, as columns of an indexed panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.recurrence import ema, linear_recurrence, wilder
from ..functions.scalars import ratio

def by_bar():
    return Window.partitionBy("ticker").orderBy("i")


def trailing(k: int):
    return by_bar().rowsBetween(1 - k, 0)


def lag(c: str | Column, k: int = 1) -> Column:
    return F.lag(c, k).over(by_bar())


def sma(c: str | Column, k: int, start: int = 0) -> Column:
    """Mean of k values, null until there are so many."""
    return F.when(F.col("i") >= start + k - 1, F.avg(c).over(trailing(k)))


def oscillator(up: Column, down: Column) -> Column:
    """100 - 100 / (1 + up / down); 100 where down is 0."""
    return F.when(down == 0, 100.0).otherwise(100.0 - 100.0 / (1 + F.try_divide(up, down)))


def with_indicators(panel: DataFrame) -> DataFrame:
    """Adds sma20, sma50, sma200, macd (line, signal, hist), rsi, mfi, vpvma (line, signal), atr_pct, e20, e50, e200."""
    c, v = F.col("close"), F.col("volume").cast("double")
    tp = (F.col("high") + F.col("low") + c) / 3.0
    mean4 = (F.col("high") + F.col("low") + c + F.col("open")) / 4.0
    spread = sum(((x - mean4) * (x - mean4) for x in (F.col("high"), F.col("low"), c, F.col("open"))), F.lit(0.0))
    df = panel.withColumns({"tp": tp, "dv": F.sqrt(spread / 3.0), "pc": lag("close")})
    move = c - F.col("pc")
    df = df.withColumns({
        "gain": F.greatest(move, F.lit(0.0)), "loss": F.greatest(-move, F.lit(0.0)),
        "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("pc")), F.abs(F.col("low") - F.col("pc"))),
        "ptp": lag("tp"),
        **{f"vw{k}": F.coalesce(ratio(F.sum(F.col("tp") * v).over(trailing(k)), F.sum(v).over(trailing(k))), F.col("tp")) * F.col("dv") for k in (12, 26)},
        "sma20": sma("close", 20), "sma50": sma("close", 50), "sma200": sma("close", 200),
    })
    df = df.withColumns({
        "inflow": F.when(F.col("tp") > F.col("ptp"), F.col("tp") * v).otherwise(0.0), "outflow": F.when(F.col("tp") < F.col("ptp"), F.col("tp") * v).otherwise(0.0),
    })
    df = linear_recurrence(df, [
        ema("e12", "close", 12), ema("e26", "close", 26), ema("e20", "close", 20), ema("e50", "close", 50), ema("e200", "close", 200),
        wilder("avg_gain", "gain", 14, 1), wilder("avg_loss", "loss", 14, 1), wilder("atr", "tr", 14, 1),
        ema("v12", "vw12", 12, 25), ema("v26", "vw26", 26, 25),
    ])
    df = df.withColumns({"macd": F.col("e12") - F.col("e26"), "vpvma": F.col("v12") - F.col("v26")})
    df = linear_recurrence(df, [ema("macd_signal", "macd", 9, 25)])
    return df.withColumns({
        "macd_hist": F.col("macd") - F.col("macd_signal"),
        "rsi": F.when(F.col("i") >= 14, oscillator(F.col("avg_gain"), F.col("avg_loss"))),
        "mfi": F.when(F.col("i") >= 14, oscillator(F.sum("inflow").over(trailing(14)), F.sum("outflow").over(trailing(14)))),
        "vpvma_signal": sma("vpvma", 9, 50),
        "atr_pct": F.try_divide(F.col("atr"), c) * 100,
    }).drop("tp", "dv", "pc", "gain", "loss", "tr", "ptp", "vw12", "vw26", "inflow", "outflow", "e12", "e26", "avg_gain", "avg_loss", "atr", "v12", "v26")
