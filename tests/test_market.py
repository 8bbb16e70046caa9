"""Market operators against plain loops written from the formulas, and edge cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotegrain import schemas
from quotegrain.functions import scalars
from quotegrain.functions.order import medians, share_at_or_below
from quotegrain.functions.recurrence import ema, linear_recurrence
from quotegrain.operators import insiders, lookup, signals as rules
from quotegrain.operators.indicators import with_indicators
from quotegrain.operators.panel import clean, indexed, skipped
from quotegrain.operators.regime import null_percentile, regime
from quotegrain.operators.structure import setup, swings
from quotegrain.plans import driver_tables, queries as plans
from quotegrain.sources import filings, ingest, watchlist
from quotegrain.streaming import quotes as feed

DAY = dt.date(2020, 1, 1)
BARS = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume bigint"


def bars(spark, **series):
    rows = []
    for ticker, closes in series.items():
        for k, bar in enumerate(closes):
            o, h, l, c, v = bar if isinstance(bar, tuple) else (bar, bar + 1, bar - 1, bar, 1000)
            rows.append((ticker, DAY + dt.timedelta(days=k), o, h, l, c, c, v))
    return spark.createDataFrame(rows, BARS)


def walk(n, seed):
    r = random.Random(seed)
    x, out = 100.0, []
    for _ in range(n):
        x *= 1 + r.gauss(0, 0.015)
        out.append(x)
    return out


def test_recurrence_equals_the_loop(spark):
    xs = walk(900, 1)
    df = indexed(bars(spark, A=xs)).select("ticker", "i", "close")
    got = [r.e for r in linear_recurrence(df, [ema("e", "close", 9), ema("f", "close", 200)]).orderBy("i").collect()]
    want, e = [None] * 8, sum(xs[:9]) / 9
    want.append(e)
    for x in xs[9:]:
        e = x * 0.2 + e * 0.8
        want.append(e)
    assert got[:8] == want[:8]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got[8:], want[8:]))


def test_exact_oscillators(spark):
    panel = indexed(bars(spark, UP=[float(x) for x in range(1, 60)], DOWN=[float(x) for x in range(60, 1, -1)]))
    rows = with_indicators(panel).where("i = n - 1").collect()
    rsi = {r.ticker: r.rsi for r in rows}
    assert rsi["UP"] == 100 and abs(rsi["DOWN"]) < 1e-9
    first = with_indicators(panel).where("macd is not null").agg(F.min("i")).first()[0]
    assert first == 25


def test_constant_range_has_two_percent(spark):
    row = setup(with_indicators(indexed(bars(spark, A=[(100.0, 101.0, 99.0, 100.0, 0)] * 300)))).first()
    assert row.atr_pct == 2.0 and row.ud_vol_50d is None and row.in_setup is False and row.obv_63d is None


def test_zigzag_swings(spark):
    up, base = [], 100.0
    for wave in range(8):
        for k in range(14):
            up.append(base + wave * 4 + (k if k < 7 else 14 - k) * 1.5)
    got = {r.ticker: r.swing for r in swings(indexed(bars(spark, UP=up, DOWN=up[::-1]))).collect()}
    assert got == {"UP": "HH/HL", "DOWN": "LH/LL"}


def test_regime_labels(spark):
    trend = [100 * 1.01**k for k in range(120)]
    rows = {r.ticker: r for r in regime(indexed(bars(spark, T=trend, S=[1.0] * 30, FLAT=[5.0] * 120))).collect()}
    assert rows["T"].regime == "trending" and rows["T"].trend_ok and rows["T"].r2_vs_null_pct == 100
    assert rows["S"].regime == "insufficient_history" and rows["S"].slope is None
    assert rows["FLAT"].regime == "undetermined"
    one = spark.range(1).select(null_percentile(F.lit(0.86)).alias("a"), null_percentile(F.lit(0.8877)).alias("b")).first()
    assert (one.a, one.b) == (90, 100)


def test_regime_percentile_is_of_the_unrounded_fit(spark):
    x = np.arange(120) - 74.5  # of the last 90 bars the mean is 0
    noise = np.random.default_rng(1).normal(size=120)
    last = slice(30, None)
    noise -= noise[last].mean()
    noise -= x * (noise[last] @ x[last]) / (x[last] @ x[last])
    closes = lambda r2: np.exp(x * np.sqrt(r2 / (x[last] @ x[last])) + noise * np.sqrt((1 - r2) / (noise[last] @ noise[last]))).tolist()
    rows = {r.ticker: r for r in regime(indexed(bars(spark, BELOW=closes(0.70397), ABOVE=closes(0.70403)))).collect()}
    assert (rows["BELOW"].r2, rows["BELOW"].r2_vs_null_pct) == (0.704, 70)
    assert (rows["ABOVE"].r2, rows["ABOVE"].r2_vs_null_pct) == (0.704, 75)


@pytest.mark.parametrize("seed", range(3))
def test_backtest_equals_the_loop(spark, seed):
    r = random.Random(seed)
    rows, want = [], {}
    for k in range(8):
        n = r.choice([2, 3, 50, 200])
        closes = walk(n, seed * 100 + k)
        buys, sells = [r.random() < 0.2 for _ in range(n)], [r.random() < 0.2 for _ in range(n)]
        held, entry, eq, count = False, 0.0, 1.0, 0
        for i in range(n - 1):
            if not held and buys[i]:
                held, entry = True, closes[i + 1]
            elif held and sells[i]:
                held, eq, count = False, eq * closes[i + 1] / entry, count + 1
        if held:
            eq, count = eq * closes[-1] / entry, count + 1
        want[f"T{k}"] = (round(eq - 1, 3), count)
        rows += [(f"T{k}", i, n, "s", closes[i], buys[i], sells[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "ticker string, i int, n int, strategy string, close double, buy boolean, sell boolean")
    for block in (4096, 50, 1):  # also with a ticker's bars in many blocks
        got = {x.ticker: (round(x.strategy_return, 3), x.n_trades) for x in rules.backtest(df, block).collect()}
        assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
        assert all(abs(got[k][0] - want[k][0]) < 2e-3 for k in want)


def test_partitions_do_not_matter(spark):
    df = bars(spark, A=walk(300, 5), B=walk(280, 6))
    results = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append([tuple(r) for r in setup(with_indicators(indexed(df.repartition(n)))).orderBy("ticker").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert results[0] == results[1]


def test_cleaning_and_skipping(spark):
    df = spark.createDataFrame([("A", DAY, None, None, None, 5.0, None, None), ("A", DAY + dt.timedelta(1), 1.0, 2.0, 1.0, None, None, 3)], BARS)
    row = clean(df).collect()
    assert len(row) == 1 and row[0].open == 5.0 and row[0].volume == 0 and row[0].adj_close == 5.0
    assert skipped(df).first().bars == 1
    assert lookup.coverage(df).first().bars == 2


def test_upsert_is_idempotent(spark):
    cols = "ticker string, date date, close double, updated_at timestamp"
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("A", DAY, 1.0, t), ("B", DAY, 2.0, t)], cols)
    new = spark.createDataFrame([("A", DAY, 9.0, t + dt.timedelta(1))], cols)
    once = ingest.upsert_bars(old, new)
    assert sorted(once.collect()) == sorted(ingest.upsert_bars(once, new).collect())
    assert {r.ticker: r.close for r in once.collect()} == {"A": 9.0, "B": 2.0}


def test_quotes_of_one_time_are_kept(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    events = [(0, at, 1, "view", 1.0, None), (1, at, 2, "view", 2.0, None), (2, at, 2, "view", 2.0, None), (3, at, 3, "click", None, None)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    rows = plans.upsert_spot(spark, str(tmp_path)).collect()
    assert sorted((r.ticker, r.price or 0.0, r.previous_close) for r in rows) == [("click", 0.0, 3.0), ("view", 1.0, 1.0), ("view", 2.0, 2.0), ("view", 2.0, 2.0)]
    # by ticker and time alone the last write wins
    quote = lambda p: spark.createDataFrame([("A", at, p)], "ticker string, captured_at timestamp, price double")
    assert [r.price for r in ingest.upsert_spot(quote(1.0), quote(2.0)).collect()] == [2.0]


def test_watchlist(spark):
    text = "# ==== banner\nspy  # comment\n# --- Semiconductors ---\nNVDA\n\n# --- Gold miners ---\nnem\nBTC-USD\nNVDA\n# --- Macro ---\n^VIX\n"
    df = spark.createDataFrame([(text,)], "value string")
    got = {r.ticker: (r.group, r.proxy) for r in watchlist.groups(df).collect()}
    assert got["NVDA"] == ("Gold miners", "GDX") and got["SPY"] == ("Ungrouped", "SPY") and got["^VIX"] == ("Macro", None)
    names = watchlist.symbols(df)
    assert [r.symbol for r in names.orderBy("pos").collect()] == ["SPY", "NVDA", "NEM", "BTC-USD", "^VIX"]
    assert {r.symbol for r in watchlist.quotable(names).collect()} == {"SPY", "NVDA", "NEM"}


def test_select_guard(spark):
    df = spark.createDataFrame([("A", 1)], "ticker string, x int")
    assert lookup.run_select(spark, {"t": df}, "select * from t;").count() == 1
    assert not [x for x in spark.catalog.listTables() if x.name == "t"]
    for bad in ("drop table t", "select 1; select 2", "with x as (select 1) analyze table t", "select replace(ticker, 'A', 'B') from t"):
        with pytest.raises(ValueError):
            lookup.run_select(spark, {"t": df}, bad)


def test_insiders(spark):
    rows = [
        ("A", dt.date(2024, 5, 3), "o", "r", "P", 10, 2.0, 20, False, "1"), ("A", dt.date(2024, 5, 3), "o", "r", "P", 10, 2.0, 20, False, "2"),
        ("A", dt.date(2024, 4, 3), "o", "r", "S", 5, 3.0, 15, True, "3"), ("B", dt.date(2024, 5, 9), "o", "r", "S144", 5, 3.0, 15, False, "4"),
    ]
    txns = insiders.dedupe(spark.createDataFrame(rows, schemas.INSIDER))
    assert {r.accession for r in txns.collect()} == {"1", "3", "4"}
    names = spark.createDataFrame([("A", "1", None), ("B", "2", None), ("C", None, None), ("D", "4", "etf"), ("E", "5", None), ("F", "6", None), ("G", "7", None)], "ticker string, cik string, skip string")
    filed = spark.createDataFrame([("A",), ("F",), ("F",), ("G",)], "ticker string")
    as_of = F.lit("2024-05-20").cast("date")
    old = spark.createDataFrame([("F", dt.date(2023, 4, 9), "o", "r", "S144", 5, 3.0, 15, False, "5"), ("A", dt.date(2024, 5, 1), "o", "r", "S144", 7, 3.0, 21, False, "6")], schemas.INSIDER)
    txns = txns.unionByName(old)
    modes = insiders.mode(txns, names, filed, as_of)
    # old notices only, or none: quiet where there are filings
    assert {r.ticker: r.status for r in modes.collect()} == {"A": "ok", "B": "144", "C": "no-cik", "D": "etf", "E": "no-section16", "F": "ok", "G": "ok"}
    used = insiders.chosen(txns, modes)
    assert {r.accession for r in used.collect()} == {"1", "3", "4"}
    compact = {r.ticker: r for r in insiders.compact(insiders.buckets(used, modes, as_of), modes, insiders.totals(used, as_of)).collect()}
    a = compact["A"]
    assert (a.tot_b, a.tot_s) == (20, 15) and len(a.months) == 12 and a.months[-1] == [20, 0, 1, 0, 0] and a.months[-2] == [0, 15, 0, 1, 15]
    assert compact["B"].tot_s == 15 and compact["G"].tot_b == 0 and compact["E"].months is None and compact["E"].tot_b is None


def test_dedupe_keeps_one_row_in_every_order(spark):
    base = ("A", dt.date(2024, 5, 3), "o", "r")
    rows = [(*base, "P", 10, 2.0, v, p, "1") for v in (30, 20) for p in (True, False)] + [(*base, "S144", 5, x, 15, False, acc) for x, acc in ((3.0, "9"), (4.0, "8"))]
    for order in (rows, rows[::-1]):
        got = insiders.dedupe(spark.createDataFrame(order, schemas.INSIDER)).collect()
        assert sorted((r.code, r.value, r.plan, r.accession) for r in got) == [("P", 20, False, "1"), ("S144", 15, False, "8")]


def test_display(spark):
    ages = [(None, ""), (0.4, "0m ago"), (59.4, "59m ago"), (60.0, "1h ago"), (119.0, "1h ago"), (1439.0, "23h ago"), (2160.0, "1d ago"), (2880.0, "2d ago")]
    prices = [(None, "\u2014"), (1234.5, "1,235"), (1000.0, "1,000"), (12.5, "12.5"), (12.0, "12"), (3.14159, "3.14"), (0.12345, "0.1235"), (0.5, "0.5")]
    df = spark.createDataFrame([(i, a, p) for i, ((a, _), (p, _)) in enumerate(zip(ages, prices))], "i int, a double, p double")
    got = df.select("i", scalars.age_text(F.col("a")).alias("a"), scalars.price_text(F.col("p")).alias("p")).orderBy("i").collect()
    assert [r.a for r in got] == [t for _, t in ages] and [r.p for r in got] == [t for _, t in prices]
    pct = spark.createDataFrame([(1.234,), (-0.5,), (0.0,)], "x double").select(scalars.pct_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in pct] == ["+1.23%", "-0.50%", "0.00%"]
    one = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, x double").groupBy("k").agg(scalars.sample_stdev("x").alias("s")).orderBy("k").collect()
    assert one[0].s == 0 and abs(one[1].s - 2**0.5) < 1e-12


def test_exact_ranks_and_medians(spark):
    import statistics

    r = random.Random(9)
    rows = [(k, r.choice([r.gauss(0, 0.3), 0.25, -7e9, 4e5])) for k in ("a", "b") for _ in range(301 if k == "a" else 400)] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    want = {k: statistics.median(x for j, x in rows if j == k and x is not None) for k in ("a", "b")}
    every = [x for _, x in rows if x is not None]
    shares = {x: sum(y <= x for y in every) / len(every) for x in every}
    for parts in (None, 1, 7):
        assert {r.k: r.median for r in medians(df, ["k"], "x", parts).collect()} == want
        assert {r.x: r.share for r in share_at_or_below(df, [], "x", parts).collect()} == shares
    assert medians(df.limit(0), ["k"], "x").count() == share_at_or_below(df.limit(0), [], "x").count() == 0


@pytest.mark.parametrize("spread", ["id * 0.0009 / 200000", "1000 + id * 0.5", "exp(id * 0.001 % 300)", "if(id % 2 = 0, id * 4.5e-9, 1e6 + id)"])
def test_ranges_are_even_however_values_lie(spark, spread):
    from quotegrain.functions import order

    df = spark.range(200_000, numPartitions=8).selectExpr(f"{spread} AS x")
    ranged, _ = order._counted(df, [], "x", 16)
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16
    xs = sorted(r.x for r in df.collect())
    assert medians(df, [], "x", 16).first().median == (xs[99_999] + xs[100_000]) / 2


def test_numbered_rows(spark):
    from quotegrain.functions.order import numbered

    r = random.Random(3)
    rows = [(r.choice("aab"), r.random(), k) for k in range(500)]
    for parts in (None, 1, 9):
        out = numbered(spark.createDataFrame(rows, "k string, x double, id long"), ["k"], ["x", "id"], "place", parts).collect()
        by = {k: sorted((x, i) for j, x, i in rows if j == k) for k in "ab"}
        assert len(out) == 500 and all(by[q.k][q.place] == (q.x, q.id) for q in out)


def loop_of(spec, xs):
    out = [None] * len(xs)
    if len(xs) > spec.seed:
        y = out[spec.seed] = sum(xs[spec.start : spec.seed + 1]) / spec.n
        for i in range(spec.seed + 1, len(xs)):
            y = out[i] = spec.b * y + spec.a * xs[i]
    return out


def test_long_recurrences_equal_the_loop(spark):
    """Short and long memories over several blocks, with a block as long as fast ones allow."""
    from quotegrain.functions.recurrence import spread_recurrence, wilder

    r = random.Random(3)
    series = {"long": [r.gauss(0, 1) + (50 if k % 3 else -50) for k in range(3000)], "short": [r.random() for _ in range(230)], "one": [1.0]}
    specs = [ema("a", "x", 9), ema("b", "x", 200), wilder("c", "x", 14, 1), ema("d", "x", 2000), ema("e", "x", 2, 25)]
    df = spark.createDataFrame([(k, i, x) for k, xs in series.items() for i, x in enumerate(xs)], "ticker string, i long, x double")
    for scan in (linear_recurrence, spread_recurrence):
        got = {(q.ticker, q.i): q for q in scan(df, specs).collect()}
        assert len(got) == sum(map(len, series.values()))
        for key, xs in series.items():
            for spec in specs:
                for i, want in enumerate(loop_of(spec, xs)):
                    value = got[key, i][spec.name]
                    assert (value is None) == (want is None) and (want is None or abs(value - want) <= 1e-12 * max(1, abs(want))), (scan, key, spec, i)


def test_spread_recurrence_plan(spark):
    """Rows are dealt by key and block, never by key alone."""
    from quotegrain.functions.recurrence import spread_recurrence

    df = spark.range(1000).selectExpr("cast(id div 900 AS string) AS ticker", "id % 900 AS i", "rand(1) AS x")
    plan = spread_recurrence(df, [ema("a", "x", 9)])._jdf.queryExecution().executedPlan().toString()
    rows = [x for x in plan.split("\n") if "Exchange hashpartitioning(ticker" in x]
    assert rows and sum("_block" not in x for x in rows) == 1  # ends of blocks, one row each


def test_trailing_shares_equal_the_loop(spark):
    from quotegrain.functions.sweep import shares, with_trailing_share

    r = random.Random(2)
    series = {k: [r.choice([None, r.random(), 0.5]) for _ in range(n)] for k, n in (("a", 700), ("b", 3), ("c", 90), ("d", 0))}
    df = spark.createDataFrame([(k, i, x, "kept") for k, xs in series.items() for i, x in enumerate(xs)], "ticker string, i long, x double, note string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = with_trailing_share(df.repartition(5), "x", 20, "rank")
        got = {(q.ticker, q.i): q for q in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out.columns == ["ticker", "i", "x", "note", "rank", "rank_before"] and len(got) == 793
    for k, xs in series.items():
        before, known = None, []
        for i, x in enumerate(xs):
            known += [] if x is None else [x]
            want = None if x is None or len(known) < 20 else sum(y <= x for y in known[-20:]) / 20
            assert (got[k, i]["rank"], got[k, i].rank_before) == (want, before)
            before = want
    assert len(shares(np.zeros(5), 6)) == 0 and shares(np.arange(3.0), 1).tolist() == [1, 1, 1]


def test_study_plan(spark):
    """One exchange by ticker, no arrays of windows."""
    from quotegrain.operators import study

    panel = with_indicators(indexed(clean(bars(spark, A=[1.0, 2.0]))))
    plan = study.events(study.flags(panel))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan and "Join" not in plan


def test_recurrence_plan(spark):
    """One exchange by ticker, one read, no join."""
    plan = with_indicators(indexed(clean(bars(spark, A=[1.0, 2.0]))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and plan.count("Scan") == 1


def test_filings(spark, tmp_path):
    (tmp_path / "0001-24-000001.xml").write_text(
        "<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>Doe</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector>"
        "</reportingOwnerRelationship></reportingOwner><footnotes><footnote>under a 10b5-1 plan</footnote></footnotes><nonDerivativeTable><nonDerivativeTransaction>"
        "<transactionDate><value>2024-05-03</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding><transactionAmounts>"
        "<transactionShares><value>10.5</value></transactionShares><transactionPricePerShare><value>2</value></transactionPricePerShare></transactionAmounts>"
        "</nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
    )
    row = filings.form4(spark, str(tmp_path)).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.owner, r.role, r.code, r.shares, r.value, r.plan, r.accession) == ("Doe", "Director", "S", 10, 21, True, "0001-24-000001")


def test_documents_of_many_lines_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    at = dt.datetime(2024, 1, 1)
    orders = [(k, k, "F", 1.0, at) for k in range(400)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, n, 2.0, 3.0 + n, "ARN"[n % 3], at) for k in range(400) for n in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(driver_tables, "LINES", 20, raising=False)
    docs = driver_tables.ownership_documents(spark, str(tmp_path))
    held = [r["count"] for r in docs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 400 and max(held) <= 40  # of four shuffle partitions the largest would hold 100 or more
    assert docs.where("accession = '6'").first().xml.count("<nonDerivativeTransaction>") == 3
    assert plans.form4_trades(spark, str(tmp_path)).count() == 800


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    quote = '{"ticker": "%s", "price": %s, "quote_time": "%s"}'
    for k in range(3):
        body = ", ".join([quote % ("A", 12 + k, f"2024-01-0{k + 1}T10:00:00"), quote % ("B", 25.5, "2024-01-01T09:00:00")])
        (src / f"{k}.json").write_text(f'{{"as_of": "2024-01-0{k + 1}T12:00:00", "errors": ["X"], "quotes": [{body}]}}')
    rows = feed.without_repeats(feed.quote_rows(feed.snapshot_stream(spark, str(src))))
    feed.run_available(rows, lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "state"))
    got = sorted((r.ticker, r.price) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("A", 12.0), ("A", 13.0), ("A", 14.0), ("B", 25.5)]
    landed = ingest.read_snapshots(spark, str(src))
    assert ingest.snapshot_quotes(landed).count() == 6
    errors = feed.error_rows(feed.snapshot_stream(spark, str(src)))
    feed.run_available(errors, lambda df, n: df.write.mode("append").parquet(str(tmp_path / "err")), str(tmp_path / "state2"))
    assert spark.read.parquet(str(tmp_path / "err")).count() == ingest.snapshot_errors(landed).count() == 3


def test_entry_without_the_corpus_operators(spark):
    import __spark_entry__ as e

    assert {"indicators", "backtest", "event_study"} <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
