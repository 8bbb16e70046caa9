"""Insider transactions: retention, deduplication, choice of source, monthly buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RETAIN, MONTHS = 15, 12
BUY, NOTICE = "P", "S144"


def month(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def months(tickers: DataFrame, as_of: Column, k: int = MONTHS) -> DataFrame:
    """tickers x the k months up to and with that of ``as_of``."""
    end = F.trunc(as_of, "month")
    return tickers.select("ticker", F.explode(F.sequence(first_month(as_of, k), end, F.expr("interval 1 month"))).alias("m")).select("ticker", month("m").alias("month"))


def retained(txns: DataFrame, as_of: Column, k: int = RETAIN) -> DataFrame:
    return txns.where(F.col("date") >= F.add_months(F.trunc(as_of, "month"), -k))


def dedupe(txns: DataFrame) -> DataFrame:
    """Trades repeat by owner, date, code, shares and price; notices by owner, date, shares and value. The first by
    date and accession stays, of rows of one accession that of the least value, unplanned first."""
    key = F.when(F.col("code") == NOTICE, F.struct(F.lit(None).cast("double").alias("p"), F.col("value").alias("v"))).otherwise(F.struct(F.col("price").alias("p"), F.lit(None).cast("bigint").alias("v")))
    w = Window.partitionBy("ticker", "owner", "date", "code", "shares", key).orderBy("date", "accession", "value", "plan", "price")
    return txns.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def first_month(as_of: Column, k: int = MONTHS) -> Column:
    return F.add_months(F.trunc(as_of, "month"), 1 - k)


def mode(txns: DataFrame, tickers: DataFrame, filings: DataFrame, as_of: Column) -> DataFrame:
    """(ticker, status). The skip class of ``tickers`` (ticker, cik, skip) comes first, then no-cik; ok where there are
    trades; 144 where there are none but notices in the window; ok, and quiet, where ``filings`` (ticker) of the trade
    form exist; else no-section16."""
    per = txns.groupBy("ticker").agg(F.count_if(F.col("code") != NOTICE).alias("trades"), F.count_if((F.col("code") == NOTICE) & (F.col("date") >= first_month(as_of))).alias("notices"))
    filed = filings.select("ticker", F.lit(True).alias("filed")).distinct()
    status = (
        F.when(F.col("skip").isNotNull(), F.col("skip")).when(F.col("cik").isNull(), "no-cik").when(F.col("trades") > 0, "ok")
        .when(F.col("notices") > 0, "144").when(F.col("filed"), "ok").otherwise("no-section16")
    )
    return tickers.join(per, "ticker", "left").join(filed, "ticker", "left").select("ticker", status.alias("status"))


def chosen(txns: DataFrame, modes: DataFrame) -> DataFrame:
    """The rows that count: notices of tickers with status 144, trades of those with status ok. A notice comes before
    the trade it announces, so one ticker's notices and trades are never added up."""
    rows = txns.join(modes, "ticker")
    return rows.where(((F.col("status") == "144") & (F.col("code") == NOTICE)) | ((F.col("status") == "ok") & (F.col("code") != NOTICE))).drop("status")


def buckets(txns: DataFrame, tickers: DataFrame, as_of: Column, k: int = MONTHS) -> DataFrame:
    """(ticker, month, buy_value, sell_value, buys, sells, plan_value), dense in months; what is no P is a sell."""
    buy = F.col("code") == BUY
    value = F.coalesce("value", F.lit(0).cast("bigint"))
    per = txns.groupBy("ticker", month("date").alias("month")).agg(
        F.sum(F.when(buy, value).otherwise(0)).alias("buy_value"), F.sum(F.when(~buy, value).otherwise(0)).alias("sell_value"), F.count_if(buy).alias("buys"),
        F.count_if(~buy).alias("sells"), F.sum(F.when(~buy & F.col("plan"), value).otherwise(0)).alias("plan_value"),
    )
    zero = F.lit(0).cast("bigint")
    columns = ["buy_value", "sell_value", "buys", "sells", "plan_value"]
    return months(tickers, as_of, k).join(per, ["ticker", "month"], "left").select("ticker", "month", *(F.coalesce(c, zero).alias(c) for c in columns))


def totals(txns: DataFrame, as_of: Column) -> DataFrame:
    """(ticker, tot_b, tot_s) of chosen rows from the first month on, also of days after ``as_of``."""
    value, buy = F.coalesce("value", F.lit(0).cast("bigint")), F.col("code") == BUY
    return txns.where(F.col("date") >= first_month(as_of)).groupBy("ticker").agg(F.sum(F.when(buy, value).otherwise(0)).alias("tot_b"), F.sum(F.when(~buy, value).otherwise(0)).alias("tot_s"))


def compact(bucketed: DataFrame, modes: DataFrame, sums: DataFrame) -> DataFrame:
    """(ticker, status, tot_b, tot_s, months): one array per month, in order; only the status where it is no source."""
    cells = F.struct("month", F.array("buy_value", "sell_value", "buys", "sells", "plan_value").alias("v"))
    months_ = bucketed.groupBy("ticker").agg(F.transform(F.sort_array(F.collect_list(cells)), lambda x: x["v"]).alias("months"))
    used, zero = F.col("status").isin("ok", "144"), F.lit(0).cast("bigint")
    rows = modes.join(months_, "ticker", "left").join(sums, "ticker", "left")
    return rows.select("ticker", "status", *(F.when(used, F.coalesce(c, zero)).alias(c) for c in ("tot_b", "tot_s")), F.when(used, F.col("months")).alias("months"))
