"""Upserts, exports, and snapshots of quotes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import schemas
from .versioned import Manifest, VersionedTable


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BARS).parquet(path).where("close is not null")


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], at: str = "updated_at", seq: str | None = None) -> DataFrame:
    """Rows of both; the last write of a key wins, a batch's over an existing one of the same time."""
    order = [F.desc(at), F.desc("_new"), *([F.desc(seq)] if seq else [])]
    both = existing.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("_new", "_k")]
    return both.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, F.desc(F.struct(*rest))))).where("_k = 1").drop("_k", "_new")


def upsert_bars(existing: DataFrame, batch: DataFrame) -> DataFrame:
    return upsert(existing, batch, ["ticker", "date"])


def upsert_months(table: VersionedTable, batch: DataFrame) -> Manifest:
    """Upserts bars into a table in parts by month: only months that the batch has are read and written. Readers see all
    of it or nothing, also where it fails between months."""
    fresh = batch.withColumn("month", F.date_format("date", "yyyy-MM"))
    base = table.manifest()
    if not base.version:
        return table.replace(upsert(fresh.limit(0), fresh, ["ticker", "date"]), "month", base)
    months = [r.month for r in fresh.select("month").distinct().collect()]  # as many as a table has months
    return table.replace(upsert(table.read(base.version, months), fresh, ["ticker", "date"]), "month", base)


def upsert_spot(existing: DataFrame, batch: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Quotes by ticker and time; ``also``: columns that tell quotes of one ticker and time apart, where a source has them."""
    return upsert(existing, batch, ["ticker", "captured_at", *also], at="captured_at")


def export_csv(df: DataFrame, path: str, prices: list[str], files: int | None = None) -> None:
    """Gzip CSV, ordered by the first two columns within and across files; prices to four places."""
    first, second = df.columns[:2]
    out = df.select(*(F.round(c, 4).alias(c) if c in prices else c for c in df.columns))
    out = out.repartitionByRange(files, first, second) if files else out.repartitionByRange(first, second)
    out.sortWithinPartitions(first, second).write.csv(path, header=True, compression="gzip")


def ticker_documents(sections: dict[str, DataFrame]) -> DataFrame:
    """One row per ticker of any section, with a struct of each section's columns; null where it has none. Sections, of one
    row per ticker each, are laid end to end and grouped once, however many they are."""
    parts = [df.select("ticker", F.struct(*(c for c in df.columns if c != "ticker")).alias(name)) for name, df in sections.items()]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.groupBy("ticker").agg(*(F.first(name, ignorenulls=True).alias(name) for name in sections))


def export_json(df: DataFrame, path: str) -> None:
    """A nested document per row and line; fields that are null are left out."""
    df.write.json(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SNAPSHOT).option("multiLine", True).json(path)


def snapshot_quotes(snapshots: DataFrame) -> DataFrame:
    """One row per usable quote; those without a price or time are errors. Of tables and of streams."""
    return snapshots.select("as_of", F.explode("quotes").alias("q")).select("as_of", "q.*").where("price is not null and quote_time is not null")


def snapshot_errors(snapshots: DataFrame) -> DataFrame:
    """(as_of, ticker) listed as errors, and those of quotes without a price or time. Of tables and of streams."""
    unusable = F.transform(F.filter("quotes", lambda q: q["price"].isNull() | q["quote_time"].isNull()), lambda q: q["ticker"])
    none = F.array().cast("array<string>")
    return snapshots.select("as_of", F.explode(F.concat(F.coalesce("errors", none), F.coalesce(unusable, none))).alias("ticker"))


def provider_quotes(raw: DataFrame, *keep: str) -> DataFrame:
    """Fields c, d, dp, o, h, l, pc, t under their names, with the columns to keep; a time of 0 is none."""
    names = {"c": "price", "d": "change", "dp": "change_pct", "o": "open", "h": "high", "l": "low", "pc": "prev_close"}
    return raw.select(*keep, "ticker", *(F.col(k).cast("double").alias(v) for k, v in names.items()), F.when(F.col("t") != 0, F.timestamp_seconds("t")).alias("quote_time"))


def newest_snapshots(snapshots: DataFrame, keep: int = 20) -> DataFrame:
    times = snapshots.select("as_of").distinct().orderBy(F.desc("as_of")).limit(keep)
    return snapshots.join(times, "as_of", "left_semi")


#: Failures that a summary names.
NAMED = 1000


def failures(status: DataFrame, order: str = "ticker") -> DataFrame:
    """The failed rows of a batch's status (ticker, error), in order: a table, for as many as there are."""
    return status.where(F.col("error").isNotNull()).select(order, *(c for c in ("ticker", "error") if c != order)).orderBy(order)


def run_summary(status: DataFrame, order: str = "ticker", named: int = NAMED) -> DataFrame:
    """(ok, failed, failed_tickers) of a batch's (ticker, error): counts of all, and the first ``named`` failures in order."""
    bad = F.col("error").isNotNull()
    first = failures(status, order).limit(named).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("ticker").alias("t")))).alias("f")).select(F.col("f.t"))
    return status.agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed")).withColumn("failed_tickers", first.scalar())
