"""Rule-based signals and their backtest, as tables: no loop over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import ratio
from ..scratch import written
from .indicators import by_bar, lag, trailing

RULES = ["macd_crossover_sig", "macd_sig_above_zero", "macd_rsi", "macd_mfi", "vpvma"]
BAND = 0.10
#: Bars of a block of the backtest.
BLOCK = 4096


def signals(panel: DataFrame) -> DataFrame:
    """(ticker, i, n, date, close, next_close, strategy, buy, sell) of an indicator panel; a flag is false where a value it needs is null."""
    line, sig, v, vs = (F.col(c) for c in ("macd", "macd_signal", "vpvma", "vpvma_signal"))
    df = panel.withColumns({"next_close": F.lead("close").over(by_bar()), "l1": lag("macd"), "s1": lag("macd_signal"), "v1": lag("vpvma"), "vs1": lag("vpvma_signal"), **{
        f"{f.__name__}_{c}": F.when((F.count(c).over(trailing(6)) == 6) & (F.col("i") >= 6), f(c).over(trailing(6))) for c in ("rsi", "mfi") for f in (F.max, F.min)
    }})
    up, down = (F.col("l1") < F.col("s1")) & (line > sig), (F.col("l1") > F.col("s1")) & (line < sig)
    rules = {
        "macd_crossover_sig": (up, down),
        "macd_sig_above_zero": (up & (line > 0), down & (line < 0)),
        "macd_rsi": ((line > sig) & (F.col("max_rsi") <= 35), (line < sig) & (F.col("min_rsi") >= 70)),
        "macd_mfi": ((line > sig) & (F.col("max_mfi") <= 25), (line < sig) & (F.col("min_mfi") >= 70)),
        "vpvma": ((v > (1 + BAND) * vs) & (F.col("v1") <= F.col("vs1")), (v < (1 - 2 * BAND) * vs) & (F.col("v1") >= F.col("vs1"))),
    }
    false = F.lit(False)
    each = F.array(*(F.struct(F.lit(k).alias("strategy"), F.coalesce(b, false).alias("buy"), F.coalesce(s, false).alias("sell")) for k, (b, s) in rules.items()))
    bar = ["ticker", "i", "n", "date", "close", "next_close"]
    return df.select(*bar, F.explode(each).alias("r")).select(*bar, "r.*")


_PAIR = ["ticker", "strategy"]


def _in_blocks(signals_: DataFrame, block: int) -> DataFrame:
    """Bars with a flag, of (ticker, strategy, block), with px: the next bar's close. Blocks are of so many bars."""
    return signals_.where("(buy or sell) and i < n - 1").withColumn("block", F.floor(F.col("i") / block))


def _states(flagged: DataFrame) -> DataFrame:
    """What each block does to a position: it is ``set`` (1 long, 0 flat) by the last bar with one flag only, if there is
    one, and turned by each bar with both flags after that; before: the position that the block takes over."""
    one = F.when(F.col("buy") != F.col("sell"), F.struct("i", F.col("buy").cast("int").alias("s")))
    per = flagged.withColumn("pure", one).groupBy(*_PAIR, "block").agg(
        F.max("pure").alias("pure"), F.sort_array(F.collect_list(F.when(F.col("buy") & F.col("sell"), F.col("i")))).alias("both")
    )
    after = F.size(F.filter("both", lambda i: F.col("pure").isNull() | (i > F.col("pure.i"))))
    maps = per.select(*_PAIR, "block", F.col("pure.s").alias("set"), (after % 2).alias("turns"))
    earlier = Window.partitionBy(*_PAIR).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*_PAIR).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    maps = maps.withColumn("all", F.sum("turns").over(so_far))
    # the last block that sets it, turned by what that block and later ones turn
    last = F.last(F.when(F.col("set").isNotNull(), F.struct("set", (F.col("all") - F.col("turns")).alias("t"))), ignorenulls=True).over(earlier)
    all_before = F.coalesce(F.sum("turns").over(earlier), F.lit(0))
    return maps.select(*_PAIR, "block", last.alias("last"), all_before.alias("turned")).select(
        *_PAIR, "block", ((F.coalesce("last.set", F.lit(0)) + F.col("turned") - F.coalesce("last.t", F.lit(0))) % 2).alias("before")
    )


def _moves(flagged: DataFrame) -> DataFrame:
    """Bars that change the position: with long, 1 after buying and 0 after selling."""
    in_block = Window.partitionBy(*_PAIR, "block").orderBy("i")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, 0)
    df = flagged.join(_states(flagged), [*_PAIR, "block"])
    df = df.withColumn("toggles", F.sum((F.col("buy") & F.col("sell")).cast("int")).over(so_far))
    df = df.withColumn("base", F.last(F.when(F.col("buy") != F.col("sell"), F.struct(F.col("buy").cast("int").alias("s"), F.col("toggles").alias("t"))), ignorenulls=True).over(so_far))
    df = df.withColumn("long", (F.coalesce("base.s", "before") + F.col("toggles") - F.coalesce("base.t", F.lit(0))) % 2)
    return df.withColumn("was", F.coalesce(F.lag("long").over(in_block), "before")).where("long <> was").drop("base", "was", "toggles", "before")


def trades(signals_: DataFrame, block: int = BLOCK) -> DataFrame:
    """(ticker, strategy, entry_i, entry, exit, ret): long only, filled at the next close, the last bar's signal unread.

    A ticker's bars are cut in blocks that go to any task; between blocks pass the position and the price of the next
    move, by windows over one row a block. An open position ends at the last close.
    """
    if "next_close" not in signals_.columns:
        signals_ = signals_.withColumn("next_close", F.lead("close").over(Window.partitionBy(*_PAIR).orderBy("i")))
    moves = written(_moves(_in_blocks(signals_, block)).select(*_PAIR, "block", "i", F.col("next_close").alias("px"), "long"), "moves")
    # the first move of each block, and of blocks after it: what a block's last move meets
    firsts = moves.groupBy(*_PAIR, "block").agg(F.min_by("px", "i").alias("px"))
    firsts = firsts.select(*_PAIR, "block", F.lead("px").over(Window.partitionBy(*_PAIR).orderBy("block")).alias("later"))
    last = signals_.where("i = n - 1").select(*_PAIR, F.col("close").alias("last_close"))
    met = moves.join(firsts, [*_PAIR, "block"])
    exit_ = F.coalesce(F.lead("px").over(Window.partitionBy(*_PAIR, "block").orderBy("i")), "later")
    bought = met.withColumn("exit", exit_).where("long = 1").join(last, _PAIR)
    bought = bought.withColumn("exit", F.coalesce("exit", "last_close"))
    return bought.select(*_PAIR, F.col("i").alias("entry_i"), F.col("px").alias("entry"), "exit", (ratio(F.col("exit"), F.col("px")) - 1).alias("ret"))


def backtest(signals_: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per ticker and strategy, against buying and holding; pairs without a trade stay."""
    if "next_close" not in signals_.columns:
        signals_ = signals_.withColumn("next_close", F.lead("close").over(Window.partitionBy(*_PAIR).orderBy("i")))
    # few bars have a flag: they and the ends of each series are all that is read below
    few = written(signals_.where("buy or sell or i = 0 or i = n - 1").select(*_PAIR, "i", "n", "close", "next_close", "buy", "sell"), "flags")
    pairs = few.groupBy(*_PAIR).agg((ratio(F.max_by("close", "i"), F.min_by("close", "i")) - 1).alias("hold"))
    done = trades(few, block).groupBy(*_PAIR).agg(F.product(1 + F.col("ret")).alias("eq"), F.count("*").alias("k"), F.avg((F.col("ret") > 0).cast("double")).alias("wins"))
    eq = F.coalesce("eq", F.lit(1.0)) - 1
    return pairs.join(done, _PAIR, "left").select(
        *_PAIR, F.round(eq, 4).alias("strategy_return"), F.round("hold", 4).alias("buy_hold_return"), F.round(eq - F.col("hold"), 4).alias("excess_vs_hold"),
        (eq > F.col("hold")).alias("beat_hold"), F.coalesce("k", F.lit(0)).cast("bigint").alias("n_trades"), F.round("wins", 3).alias("win_rate"),
    )
