"""The regime gate over a ticker's last 90 closes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WINDOW, LEAST, CROSS = 90, 40, 20
TREND_R2, REVERT_R2, REVERT_CROSS = 0.85, 0.35, 7.0
# Error rates of the gate on random walks, and R2 quantiles of random walks in steps of 5 %.
FALSE_TREND, FALSE_REVERT = 0.10, 0.08
R2_NULL = [0.0, 0.0068, 0.0263, 0.0575, 0.0995, 0.1508, 0.2053, 0.2626, 0.3202, 0.3806, 0.4387, 0.4962, 0.5506, 0.6046, 0.6552, 0.7040, 0.7493, 0.7954, 0.8401, 0.8877]


def null_percentile(r2: Column) -> Column:
    k = F.size(F.filter(F.array(*map(F.lit, R2_NULL)), lambda q: q <= r2))
    return F.when(r2.isNotNull(), F.when(k == len(R2_NULL), 100).otherwise(F.greatest(k - 1, F.lit(0)) * 5))


def regime(panel: DataFrame) -> DataFrame:
    """One row per ticker: label, fit, variance ratio, crossing rate, gates."""
    seg = panel.where(F.col("i") >= F.col("n") - WINDOW).select("ticker", "close", "n", (F.col("i") - F.greatest(F.col("n") - WINDOW, F.lit(0))).alias("j"))
    order = Window.partitionBy("ticker").orderBy("j")
    positive = F.when(F.col("close") > 0, F.col("close"))
    seg = seg.withColumns({
        "y": F.ln(positive), "sma": F.when(F.col("j") >= CROSS - 1, F.avg("close").over(order.rowsBetween(1 - CROSS, 0))),
    })
    # positive closes are numbered on their own, and returns are between neighbours among them
    pos = F.when(F.col("y").isNotNull(), F.count("y").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("double")
    seg = seg.withColumns({"p": pos, "above": F.when(F.col("sma").isNotNull(), F.col("close") - F.col("sma") > 0)})
    known = Window.partitionBy("ticker", F.col("y").isNotNull()).orderBy("j")
    seg = seg.withColumns({
        "r1": F.col("y") - F.lag("y", 1).over(known), "r5": F.col("y") - F.lag("y", 5).over(known), "crossed": (F.col("above") != F.lag("above").over(order)).cast("int"),
    })
    agg = seg.groupBy("ticker").agg(
        F.count("*").alias("window"), F.count("y").alias("ny"), F.count("sma").alias("nd"), F.sum("crossed").alias("crosses"),
        F.covar_pop("p", "y").alias("cov"), F.var_pop(F.when(F.col("y").isNotNull(), F.col("p"))).alias("vp"), F.var_pop("y").alias("vy"),
        F.var_samp("r1").alias("v1"), F.var_samp("r5").alias("v5"), F.min_by("close", "j").alias("first"), F.max_by("close", "j").alias("last"),
    )
    agg = agg.withColumns({
        "r2": F.when((F.col("window") >= LEAST) & (F.col("ny") >= 10) & (F.col("vy") > 0), F.try_divide(F.col("cov") * F.col("cov"), F.col("vp") * F.col("vy"))),
        "vr": F.when((F.col("window") >= LEAST) & (F.col("ny") >= 20) & (F.col("v1") > 1e-12), F.try_divide(F.col("v5"), F.col("v1") * 5)),
        "cross": F.when((F.col("window") >= LEAST) & (F.col("nd") >= 3), F.try_divide(F.lit(100.0) * F.coalesce("crosses", F.lit(0)), F.col("nd"))),
    })
    label = (
        F.when(F.col("window") < LEAST, "insufficient_history").when(F.col("r2").isNull() | F.col("cross").isNull(), "undetermined")
        .when(F.col("r2") >= TREND_R2, "trending").when((F.col("r2") < REVERT_R2) & (F.col("cross") <= REVERT_CROSS), "mean_reverting").otherwise("neither")
    )
    known = F.col("r2").isNotNull() & F.col("cross").isNotNull()
    # not in the select below: a lambda there takes r2 for the rounded column of that name
    agg = agg.withColumns({"regime": label, "pct": F.when(known, null_percentile(F.col("r2")))})
    return agg.select(
        "ticker", "regime", F.round("r2", 4).alias("r2"), F.col("pct").alias("r2_vs_null_pct"), F.round("vr", 4).alias("vr"),
        F.round("cross", 2).alias("cross_rate"), F.when(known, F.when(F.col("last") >= F.col("first"), "up").otherwise("down")).alias("slope"),
        (F.col("regime") == "trending").alias("trend_ok"), (F.col("regime") == "mean_reverting").alias("oscillator_ok"),
        F.when(F.col("regime") == "trending", FALSE_TREND).when(F.col("regime") == "mean_reverting", FALSE_REVERT).alias("false_positive_rate"), "window",
    )
