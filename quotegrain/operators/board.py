"""A market board: groups of members in a fixed order, with quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import direction


def repaired(quotes: DataFrame, closes: DataFrame) -> DataFrame:
    """A missing last or previous price is the newest, or next to newest, non-zero close (ticker, date, close)."""
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    near = closes.where("close is not null and close <> 0").withColumn("k", F.row_number().over(w)).where("k <= 2")
    two = near.groupBy("ticker").agg(F.max(F.when(F.col("k") == 1, F.col("close"))).alias("c1"), F.max(F.when(F.col("k") == 2, F.col("close"))).alias("c2"))
    return quotes.join(two, "ticker", "left").select("ticker", F.coalesce("last", "c1").alias("last"), F.coalesce("prev_close", "c2").alias("prev_close"))


def board(members: DataFrame, quotes: DataFrame) -> DataFrame:
    """Members (group_pos, group, item_pos, ticker, name) in order; one without a quote stays, with nulls."""
    pct = F.round((F.try_divide(F.col("last"), F.col("prev_close")) - 1) * 100, 3)
    return members.join(quotes, "ticker", "left").select("group_pos", "group", "item_pos", "ticker", "name", "last", "prev_close", pct.alias("pct"), direction(pct).alias("direction"))


def documents(rows: DataFrame) -> DataFrame:
    """(group_pos, group, ok, total, items): a document for each group, its items in order of their places."""
    items = F.struct("item_pos", "ticker", "name", "last", "prev_close", "pct", "direction")
    per = rows.groupBy("group_pos", "group").agg(F.count_if(F.col("pct").isNotNull()).alias("ok"), F.count("*").alias("total"), F.sort_array(F.collect_list(items)).alias("items"))
    return per.select("group_pos", "group", "ok", "total", "items").orderBy("group_pos")


def movers(rows: DataFrame, k: int = 3) -> DataFrame:
    """The k best and the k worst by pct, board order on ties."""
    known = rows.where("pct is not null")
    up = known.orderBy(F.desc("pct"), "group_pos", "item_pos").limit(k).withColumn("side", F.lit("up"))
    down = known.orderBy("pct", "group_pos", "item_pos").limit(k).withColumn("side", F.lit("down"))
    return up.unionByName(down).select("side", "ticker", "pct")
