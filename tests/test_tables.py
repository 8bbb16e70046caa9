"""Versioned tables: atomic replacement of parts, upserts in levels, clean-up; streams into them."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quotegrain import schemas
from quotegrain.sources import ingest
from quotegrain.sources.versioned import VersionedTable, newest_rows
from quotegrain.streaming import quotes as feed

SPOT = "ticker string, price double"


def bar(day, close, at=1, ticker="A"):
    return (ticker, day, close, close, close, close, close, 1, "x", dt.datetime(2024, 1, at))


def rows_of(df):
    return sorted((r.ticker, str(r.date), r.close) for r in df.collect())


def files(tmp_path):
    return {str(p.relative_to(tmp_path)): p.stat().st_size for p in tmp_path.rglob("*.parquet")}


def test_months_are_swapped_as_a_whole(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path))
    first = [bar(dt.date(2024, 1, 5), 1.0), bar(dt.date(2024, 2, 5), 2.0), bar(dt.date(2024, 3, 5), 4.0)]
    ingest.upsert_months(table, spark.createDataFrame(first, schemas.BARS))
    before, old = files(tmp_path), rows_of(table.read())
    assert [r[2] for r in old] == [1.0, 2.0, 4.0]

    late = spark.createDataFrame([bar(dt.date(2024, 2, 5), 9.0, 2), bar(dt.date(2024, 3, 6), 3.0, 2)], schemas.BARS)
    # fails in one month's rows, when the other month may be written already
    broken = late.withColumn("close", F.when(F.month("date") == 3, F.raise_error(F.lit("no such month")).cast("double")).otherwise(F.col("close")))
    with pytest.raises(Exception, match="no such month"):
        ingest.upsert_months(table, broken)
    assert rows_of(table.read()) == old and table.versions() == [1]

    pinned = table.read(1)
    ingest.upsert_months(table, late)
    assert rows_of(table.read()) == [("A", "2024-01-05", 1.0), ("A", "2024-02-05", 9.0), ("A", "2024-03-05", 4.0), ("A", "2024-03-06", 3.0)]
    assert rows_of(pinned) == old  # a reader stays with its version
    added = {k: v for k, v in files(tmp_path).items() if k not in before}
    assert {k.split("/")[2] for k in added} == {"_part=2024-02", "_part=2024-03"} and before.items() <= files(tmp_path).items()
    assert rows_of(table.read(parts=["2024-01", "1999-01"])) == [("A", "2024-01-05", 1.0)]

    gone = table.expire(1)
    assert any("_part=2024-02" in g for g in gone) and rows_of(table.read())[1] == ("A", "2024-02-05", 9.0)
    assert table.versions() == [2] and not table.expire(1)


def test_second_writer_of_a_version_fails(spark, tmp_path):
    one = VersionedTable(spark, str(tmp_path))
    rows = spark.createDataFrame([("m", "A", 1.0)], "part string, ticker string, price double")
    base = one.manifest()
    one.replace(rows, "part", base)
    with pytest.raises(Exception, match="(?i)exist"):
        VersionedTable(spark, str(tmp_path)).replace(rows, "part", base)
    assert one.versions() == [1] and one.read().count() == 1
    with pytest.raises(FileNotFoundError):
        VersionedTable(spark, str(tmp_path / "none")).read()


@pytest.mark.parametrize("fan", [2, 3, 100])
def test_upserts_equal_a_dict(spark, tmp_path, fan):
    r, table, want = random.Random(fan), VersionedTable(spark, str(tmp_path), fan=fan), {}
    for number in range(9):
        batch = {f"T{r.randrange(12)}": r.random() for _ in range(5)}
        want |= batch
        table.upsert(spark.createDataFrame(list(batch.items()), SPOT), ["ticker"], number, 4)
        again = spark.createDataFrame([("T0", -1.0)], SPOT)
        assert table.upsert(again, ["ticker"], number, 4).version == number + 1  # a repeated batch is none
    assert {x.ticker: x.price for x in table.current(["ticker"]).collect()} == want
    assert table.current(["ticker"]).columns == ["ticker", "price"]
    held = table.manifest().parts
    for folders in held.values():
        for level in range(9):
            assert sum(x[1] == level for x in folders) < fan
    table.expire(1)
    assert {x.ticker: x.price for x in table.current(["ticker"]).collect()} == want
    live = {f for folders in held.values() for f, _ in folders}
    assert {str(p.relative_to(tmp_path / "data").parent) for p in (tmp_path / "data").rglob("*.parquet")} == live


def test_bytes_written_follow_the_batch(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path))
    table.upsert(spark.range(200_000).select(F.col("id").cast("string").alias("ticker"), F.rand(1).alias("price")), ["ticker"], 0)
    before = files(tmp_path)
    table.upsert(spark.createDataFrame([("7", 1.0), ("8", 2.0)], SPOT), ["ticker"], 1)
    added = {k: v for k, v in files(tmp_path).items() if k not in before}
    assert 1 <= len(added) <= 2 and sum(added.values()) * 100 < sum(before.values())
    assert table.current(["ticker"]).count() == 200_000 and table.current(["ticker"]).where("ticker = '7'").first().price == 1.0


def test_empty_batches_and_nulls(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path))
    table.upsert(spark.createDataFrame([], SPOT), ["ticker"], 0)
    assert table.current(["ticker"]).count() == 0
    table.upsert(spark.createDataFrame([(None, 1.0), ("A", None)], SPOT), ["ticker"], 1)
    table.upsert(spark.createDataFrame([(None, 2.0)], SPOT), ["ticker"], 2)
    assert sorted(table.current(["ticker"]).collect(), key=str) == [("A", None), (None, 2.0)]
    only = newest_rows(spark.createDataFrame([("A", 1.0, 1), ("A", 2.0, 2)], SPOT + ", _version long"), ["ticker"])
    assert [x.price for x in only.collect()] == [2.0]


def test_stream_into_a_table(spark, tmp_path):
    """A restarted stream, and one whose last batch is repeated, give the rows of one run."""
    landed, table = tmp_path / "in", VersionedTable(spark, str(tmp_path / "table"), fan=2)
    landed.mkdir()

    def run():
        quotes = spark.readStream.schema("ticker string, price double, captured_at timestamp").option("maxFilesPerTrigger", 1).json(str(landed))
        feed.run_available(feed.latest_per_ticker(quotes, "captured_at"), feed.upserting(table, ["ticker"], 2), str(tmp_path / "state"), "update")

    def land(k, *quotes):
        (landed / f"{k}.json").write_text("\n".join(json.dumps({"ticker": t, "price": p, "captured_at": f"2024-01-{d:02d}T00:00:00"}) for t, p, d in quotes))

    land(0, ("A", 1.0, 1), ("B", 5.0, 9))
    land(1, ("A", 2.0, 2))
    run()
    got = lambda: sorted((x.ticker, x.price) for x in table.current(["ticker"]).collect())
    assert got() == [("A", 2.0), ("B", 5.0)]
    land(2, ("B", 4.0, 3), ("C", 7.0, 1))  # B's quote is older than the one at hand
    run()
    assert got() == [("A", 2.0), ("B", 5.0), ("C", 7.0)]
    last = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    last.unlink()  # the batch was taken in, its commit was lost: it is sent again
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    versions = table.versions()
    run()
    assert got() == [("A", 2.0), ("B", 5.0), ("C", 7.0)] and table.versions() == versions


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_tracked_quotes(spark, tmp_path):
    """Newest, late and expired quotes, over a restart."""
    landed = tmp_path / "in"
    landed.mkdir()
    land = lambda k, *quotes: (landed / f"{k}.json").write_text("\n".join(json.dumps({"ticker": t, "price": p, "quote_time": f"2024-01-{d:02d}T00:00:00"}) for t, p, d in quotes))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def run():
        quotes = spark.readStream.schema("ticker string, price double, quote_time timestamp").option("maxFilesPerTrigger", 1).json(str(landed))
        feed.run_available(feed.tracked(quotes, "3 days", "1 days"), lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}")), str(tmp_path / "state"))

    try:
        land(0, ("A", 1.0, 1), ("B", 5.0, 2), ("A", 1.5, 2))
        run()
        land(1, ("A", 2.0, 3), ("B", 4.0, 2), ("B", 3.0, 1))  # the last is before the watermark
        run()
        land(2, ("A", 3.0, 3), ("A", 3.5, 9), (None, 1.0, 9))
        run()
        land(3, ("A", 4.0, 10))
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [(r.ticker, r.kind, r.quote_time.day, r.price) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = [("A", "quote", 1, 1.0), ("A", "quote", 2, 1.5), ("A", "quote", 3, 2.0), ("A", "quote", 9, 3.5), ("A", "quote", 10, 4.0)]
    assert sorted(got) == sorted([*want, ("B", "quote", 2, 5.0), ("B", "late", 2, 4.0), ("A", "late", 3, 3.0), ("B", "expired", 2, 5.0)])


def test_seen_accessions(spark, tmp_path):
    """Batches read only the buckets that they hit; what gave nothing is remembered, and may give something later."""
    from quotegrain.sources.filings import SeenAccessions

    of = lambda *names: spark.createDataFrame([(n,) for n in names], "accession string")
    index = SeenAccessions(spark, str(tmp_path), 8)
    assert index.unseen(of("a", "b")).count() == 2
    index.record(of("a", "b", "c", "c"), of("a"), 0)
    assert sorted(r.accession for r in index.emptied().collect()) == ["b", "c"]
    assert [r.accession for r in index.unseen(of("a", "d")).collect()] == ["d"]
    before = files(tmp_path)
    index.record(of("c", "d"), of("c", "d"), 1)
    index.record(of("z"), of("z"), 1)  # taken in already
    assert len(set(files(tmp_path)) - set(before)) <= 2 and [r.accession for r in index.emptied().collect()] == ["b"]
    assert {r.accession for r in index.unseen(of("a", "b", "c", "d", "z")).collect()} == {"z"}
    # a batch of one accession reads one bucket's files
    read = {"/".join(f.split("/")[-2:-1]) for f in index.among(of("b")).inputFiles()}
    assert read == {"_part=" + index.hit(of("b"))[0]}
    assert SeenAccessions(spark, str(tmp_path), 8).unseen(of("a")).count() == 0


def test_failures_are_counted_and_named_in_order(spark):
    status = spark.createDataFrame([("D", 1, None), ("C", 2, "x"), ("A", 3, "y"), ("B", 4, "z")], "ticker string, pos int, error string")
    one = ingest.run_summary(status).first()
    assert (one.ok, one.failed, one.failed_tickers) == (1, 3, ["A", "B", "C"])
    assert ingest.run_summary(status, "pos", 2).first().failed_tickers == ["C", "A"]
    assert [(r.pos, r.ticker, r.error) for r in ingest.failures(status, "pos").collect()] == [(2, "C", "x"), (3, "A", "y"), (4, "B", "z")]
    assert ingest.run_summary(status.limit(0)).first().asDict() == {"ok": 0, "failed": 0, "failed_tickers": []}


def test_documents(spark):
    from quotegrain.operators import board

    members = spark.createDataFrame([(2, "g2", 1, "C", "c"), (1, "g1", 2, "B", "b"), (1, "g1", 1, "A", "a")], 'group_pos int, `group` string, item_pos int, ticker string, name string')
    quotes = spark.createDataFrame([("A", 11.0, 10.0), ("C", 1.0, None)], "ticker string, last double, prev_close double")
    out = board.documents(board.board(members, quotes)).collect()
    assert [(r.group, r.ok, r.total, [i.ticker for i in r["items"]]) for r in out] == [("g1", 1, 2, ["A", "B"]), ("g2", 0, 1, ["C"])]
    sections = {"x": spark.createDataFrame([("A", 1)], "ticker string, v int"), "y": spark.createDataFrame([("A", 2), ("B", 3)], "ticker string, v int"), "z": spark.createDataFrame([], "ticker string, w string")}
    one = ingest.ticker_documents(sections)
    assert sorted((r.ticker, r.x and r.x.v, r.y.v, r.z) for r in one.collect()) == [("A", 1, 2, None), ("B", None, 3, None)]
    assert ingest.ticker_documents(sections)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_snapshot_reads_recent_months(spark, tmp_path):
    from quotegrain.operators import lookup

    day = lambda k: dt.date(2022, 1, 1) + dt.timedelta(days=k)
    rows = [bar(day(k), float(k), 1, "DAILY") for k in range(730)] + [bar(day(k), float(k), 1, "WEEKLY") for k in range(0, 730, 3)] + [bar(day(5), 1.0, 1, "OLD")]
    every = spark.createDataFrame(rows, schemas.BARS)
    table = VersionedTable(spark, str(tmp_path))
    ingest.upsert_months(table, every)
    spot = spark.createDataFrame([], "ticker string, captured_at timestamp, price double, previous_close double")
    names = lambda *t: spark.createDataFrame([(x,) for x in t], "ticker string")
    months = lambda df: {f.split("_part=")[1][:7] for f in df.inputFiles() if "_part=" in f}
    daily = lookup.recent_bars(table, names("DAILY"))
    assert len(months(daily)) == lookup.RECENT_MONTHS and min(months(daily)) == "2022-11"
    for asked in (("DAILY",), ("DAILY", "WEEKLY", "OLD")):
        part = lookup.recent_bars(table, names(*asked))
        want = lookup.snapshot(every.where(F.col("ticker").isin(*asked)), spot).orderBy("ticker").collect()
        assert lookup.snapshot(part, spot).orderBy("ticker").collect() == want and len(want) == len(asked)
    assert len(months(lookup.recent_bars(table, names("OLD")))) == 24
