"""The quote feed: a directory of snapshots as a stream."""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from .. import schemas
from ..sources.ingest import snapshot_errors, snapshot_quotes
from ..sources.versioned import VersionedTable


def snapshot_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None, multi_line: bool = True) -> DataFrame:
    """Of files of one snapshot each, or of one on each line."""
    reader = spark.readStream.schema(schemas.SNAPSHOT).option("multiLine", multi_line)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


quote_rows, error_rows = snapshot_quotes, snapshot_errors


def without_repeats(quotes: DataFrame, delay: str = "4 days") -> DataFrame:
    """One row per (ticker, quote_time); which copy stays is not defined. The delay spans a weekend."""
    return quotes.withWatermark("quote_time", delay).dropDuplicatesWithinWatermark(["ticker", "quote_time"])


def latest_per_ticker(quotes: DataFrame, at: str = "quote_time") -> DataFrame:
    rest = [c for c in quotes.columns if c != "ticker"]
    return quotes.groupBy("ticker").agg(F.max_by(F.struct(*rest), at).alias("r")).select("ticker", "r.*")


def upserting(table: VersionedTable, keys: list[str], buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A sink for ``run_available``: each batch is added to the table as files of its own rows. A batch that is repeated
    after a failure is taken in once."""

    def sink(batch: DataFrame, number: int) -> None:
        table.upsert(batch, keys, number, buckets)
        table.expire()

    return sink


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what has landed, batch by batch, and ends."""
    query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class _Last(StatefulProcessor):
    """A ticker's last quote. Each row comes out as ``quote`` if it is the newest so far, else as ``late``; a ticker that
    is not quoted for ``expire_ms`` of event time comes out once as ``expired``, with its last quote, and is forgotten."""

    def __init__(self, expire_ms: int):
        self.expire_ms = expire_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, price double")

    def handleInputRows(self, key, rows, timerValues):
        held = self.last.get() if self.last.exists() else None
        at, price, out = (*held, []) if held else (None, None, [])
        # of rows that arrive together, earlier ones come first
        for frame in rows:
            for t, p in sorted(zip((frame["quote_time"].astype("int64") // 1000).tolist(), frame["price"].tolist())):
                newest = at is None or t > at
                out.append((key[0], "quote" if newest else "late", t, p))
                at, price = (t, p) if newest else (at, price)
        if held is None or at != held[0]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at // 1000 + self.expire_ms)
            self.last.update((at, price))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists():
            at, price = self.last.get()
            self.last.clear()
            yield self._frame([(key[0], "expired", at, price)])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["ticker", "kind", "quote_time", "price"])
        return out.assign(quote_time=out["quote_time"].astype("datetime64[us]"))

    def close(self) -> None:
        pass


def tracked(quotes: DataFrame, expire: str = "7 days", delay: str = "4 days") -> DataFrame:
    """(ticker, kind, quote_time, price) of a stream of quotes: ``quote`` for each that is newer than all before it of its
    ticker, ``late`` for others, ``expired`` for a ticker's last one when the watermark, which trails by ``delay``, has
    passed it by ``expire``. Rows before the watermark are dropped by Spark. State is a time and a price for each ticker
    that is quoted; it needs the RocksDB state store."""
    span = int(pd.Timedelta(expire).total_seconds() * 1000)
    rows = quotes.where("ticker is not null and quote_time is not null").select("ticker", "quote_time", "price").withWatermark("quote_time", delay)
    return rows.groupBy("ticker").transformWithStateInPandas(_Last(span), "ticker string, kind string, quote_time timestamp, price double", "append", "eventTime")
