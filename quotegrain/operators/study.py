"""Event study: forward returns after setup conditions, pooled over tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.order import medians
from ..functions.scalars import ratio
from ..functions.sweep import with_trailing_share
from ..scratch import written
from .indicators import by_bar, lag
from .structure import BUYERS, CONTRACTED, RANK_WINDOW, stack_state, up_down

HORIZONS = (21, 63)


CONDITIONS = ["full_setup", "stacked_only", "coiled_only", "buyers_only", "baseline"]


def flags(panel: DataFrame) -> DataFrame:
    """(ticker, date, i, stacked, coiled, buyers: null where not computable; the same of the bar before, as stacked_before
    and so on; fwd21, fwd63: forward returns of adjusted closes). One exchange by ticker."""
    df = panel.withColumn("pc", lag("close"))
    up, down = up_down(50)
    stacked = F.when(F.col("e200").isNotNull(), F.coalesce(stack_state() == "aligned_up", F.lit(False)))
    df = df.withColumns({"up": up, "down": down, "stacked": stacked})
    buyers = F.when((F.col("i") >= 50) & (F.col("up") + F.col("down") > 0), F.when(F.col("down") > 0, F.col("up") >= BUYERS * F.col("down")).otherwise(True))
    ahead = lambda k: F.lead("adj_close", k).over(by_bar())
    forward = {f"fwd{k}": F.when(F.col("adj_close") != 0, ratio(F.when(ahead(k) != 0, ahead(k)), F.col("adj_close")) - 1) for k in HORIZONS}
    df = df.withColumns({"buyers": buyers, **forward})
    df = df.withColumns({"stacked_before": lag("stacked"), "buyers_before": lag("buyers")})
    kept = ["ticker", "date", "i", "stacked", "buyers", "stacked_before", "buyers_before", *forward]
    # ranked among the last 252 bars that have a value
    ranked = with_trailing_share(df.select(*kept, "atr_pct"), "atr_pct", RANK_WINDOW, "rank")
    return ranked.withColumns({"coiled": F.col("rank") <= CONTRACTED, "coiled_before": F.col("rank_before") <= CONTRACTED}).select(*kept, "coiled", "coiled_before")


def _on(suffix: str = "") -> dict[str, Column]:
    """Which conditions hold on a bar; none does where a flag is not computable."""
    stacked, coiled, buyers = (F.col(f"{c}{suffix}") for c in ("stacked", "coiled", "buyers"))
    known = stacked.isNotNull() & coiled.isNotNull() & buyers.isNotNull()
    held = dict(zip(CONDITIONS, (stacked & coiled & buyers, stacked, coiled, buyers, F.lit(True)), strict=True))
    return {k: F.coalesce(known & c, F.lit(False)) for k, c in held.items()}


def events(flagged: DataFrame) -> DataFrame:
    """(ticker, date, condition, start, took, fwd21, fwd63) of bars on which a condition holds; start: an episode opens."""
    on, before = _on(), _on("_before")
    each = F.array(*(F.when(on[k], F.struct(F.lit(k).alias("condition"), before[k].alias("before"))) for k in CONDITIONS))
    rows = flagged.select("ticker", "date", "fwd21", "fwd63", F.explode(F.array_compact(each)).alias("c"))
    took = F.col("fwd21").isNotNull() | F.col("fwd63").isNotNull()
    return rows.select("ticker", "date", "c.condition", (took & ~F.col("c.before")).alias("start"), took.alias("took"), "fwd21", "fwd63")


def with_evidence(setups: DataFrame, base_rates: DataFrame) -> DataFrame:
    """(ticker, condition, and the base rates of that condition for each horizon); nulls where there are none."""
    state = setups.select("ticker", F.when(F.col("in_setup"), "full_setup").otherwise("baseline").alias("condition"))
    return state.join(base_rates, "condition", "left").select("ticker", *base_rates.columns)


def summary(events_: DataFrame) -> DataFrame:
    """(condition, horizon, n, median, mean, hit_rate, n_names, n_episodes). Events are computed once, and written."""
    rows = written(events_.select("ticker", "condition", "start", "took", "fwd21", "fwd63"), "events")
    per = rows.groupBy("condition", "ticker").agg(F.max("took").alias("took"), F.count_if("start").alias("starts"))
    per = per.groupBy("condition").agg(F.count_if("took").alias("n_names"), F.sum("starts").alias("n_episodes"))
    horizons = F.explode(F.array(*(F.struct(F.lit(k).alias("horizon"), F.col(f"fwd{k}").alias("r")) for k in HORIZONS)))
    pools = rows.select("condition", horizons.alias("p")).select("condition", "p.*").where("r is not null")
    stats = pools.groupBy("condition", "horizon").agg(
        F.count("*").alias("n"), F.round(F.avg("r"), 4).alias("mean"), F.round(F.avg((F.col("r") > 0).cast("double")), 3).alias("hit_rate")
    )
    middle = medians(pools, ["condition", "horizon"], "r").withColumn("median", F.round("median", 4))
    return stats.join(middle, ["condition", "horizon"]).join(per, "condition").select("condition", "horizon", "n", "median", "mean", "hit_rate", "n_names", "n_episodes")


def documents(summary_: DataFrame) -> DataFrame:
    """(condition, n_names, n_episodes, horizons): a document for each condition, its horizons in order."""
    pool = F.struct(F.col("horizon").cast("int").alias("horizon"), "n", "median", "mean", "hit_rate")
    return summary_.groupBy("condition", "n_names", "n_episodes").agg(F.sort_array(F.collect_list(pool)).alias("horizons"))
