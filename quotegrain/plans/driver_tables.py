"""Bars, quotes and insider trades derived from the order and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.indicators import with_indicators
from ..operators.panel import clean, eligible, indexed
from ..sources.ingest import provider_quotes


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region, supplier = (read(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("n_name").alias("ticker"), F.col("r_name").alias("group"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per nation of suppliers, from the trades of its order lines in a total order."""
    line = read(spark, sf_dir, "lineitem").join(_supply(spark, sf_dir).select("s_suppkey", "ticker"), F.col("l_suppkey") == F.col("s_suppkey"))
    px, date = F.col("l_extendedprice") / F.col("l_quantity"), F.to_date("l_shipdate")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    day = line.groupBy("ticker", date.alias("date")).agg(
        F.min_by(px, order).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, order).alias("close"), F.sum("l_quantity").cast("bigint").alias("volume")
    )
    return day.select("ticker", "date", "open", "high", "low", "close", (F.col("close") * (1 + F.dayofyear("date") / 10000)).alias("adj_close"), "volume")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, group, proxy: the first nation of the region; the first region has none."""
    rows = _supply(spark, sf_dir).select("ticker", "group").distinct()
    first = rows.groupBy("group").agg(F.min("ticker").alias("proxy"))
    lone = first.agg(F.min("group").alias("lone"))
    return rows.join(first, "group").join(lone, F.col("group") == F.col("lone"), "left").select("ticker", "group", F.when(F.col("lone").isNull(), F.col("proxy")).alias("proxy"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, numbered bars of eligible tickers."""
    return eligible(indexed(clean(bars(spark, sf_dir))))


def indicator_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_indicators(panel(spark, sf_dir))


def spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from events: the type is the ticker, the value the price, and the user's number the previous close."""
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.col("ts").alias("captured_at"), F.col("value").alias("price"), (F.col("user_id") % 100).cast("double").alias("previous_close"), "event_id")


#: Regions of tickers whose insiders only give notices; that have filings without trades; that have no filings.
NOTICES_ONLY, QUIET, NO_FILINGS = "ASIA", "AFRICA", "EUROPE"


def issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, cik, skip: one ticker has no id, one is skipped as a fund."""
    name = F.col("n_name")
    return read(spark, sf_dir, "nation").select(name.alias("ticker"), F.when(name != "NATION_4", F.lpad(F.col("n_nationkey").cast("string"), 10, "0")).alias("cik"), F.when(name == "NATION_1", "etf").alias("skip"))


def _traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    supply = _supply(spark, sf_dir).where(~F.col("group").isin(NO_FILINGS))
    return line.join(supply, F.col("l_suppkey") == F.col("s_suppkey"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, accession, date) of filings of the trade form: orders."""
    rows = _traded(spark, sf_dir).where(F.col("group") != NOTICES_ONLY)
    return rows.select("ticker", F.col("l_orderkey").cast("string").alias("accession"), F.to_date("l_shipdate").alias("date"))


def insider_txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the flag A are purchases, R sales, N notices."""
    orders, flag = read(spark, sf_dir, "orders"), F.col("l_returnflag")
    rows = _traded(spark, sf_dir).where((F.col("group") != QUIET) & ((F.col("group") != NOTICES_ONLY) | (flag == "N")))
    rows = rows.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return rows.select(
        "ticker", F.to_date("l_shipdate").alias("date"), F.col("o_custkey").cast("string").alias("owner"), F.lit("Director").alias("role"),
        F.when(flag == "A", "P").when(flag == "R", "S").otherwise("S144").alias("code"), F.col("l_quantity").cast("bigint").alias("shares"), price.alias("price"),
        F.round("l_extendedprice").cast("bigint").alias("value"), (F.col("l_linestatus") == "F").alias("plan"), F.col("l_orderkey").cast("string").alias("accession"),
    )


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watchlist's text: a header for each region, then its nations, with comments, blanks and repeats."""
    supply = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.lit("  "), F.lower("n_name"), F.when(F.col("n_nationkey") % 3 == 0, " # a note").otherwise(""))
    per = supply.groupBy("r_regionkey").agg(F.max("r_name").alias("r"), F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    part = F.concat(F.lit("# --- "), F.col("r"), F.when(F.col("r") == "ASIA", " miners").when(F.col("r") == "EUROPE", " macro").otherwise(""), F.lit(" ---\n\n"), F.col("lines"))
    text = per.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey", part.alias("t")))), lambda x: x["t"]), "\n").alias("value"))
    return text.select(F.concat(F.lit("\nfirst^1\nbtc-usd\n"), F.col("value"), F.lit("\n\nCHINA\nx.to")).alias("value"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote snapshots as a provider's fields: one for each hour of events, errors for those of the type ``error`` or of
    users divisible by 7, whose quotes have no time."""
    e = read(spark, sf_dir, "events").where("ts is not null").withColumn("as_of", F.date_trunc("hour", "ts"))
    raw = e.select(
        "as_of", F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")).alias("ticker"), F.col("value").alias("c"), (F.col("value") - F.col("user_id") % 10).alias("d"), F.lit(None).cast("double").alias("dp"),
        F.col("value").alias("o"), F.col("value").alias("h"), F.col("value").alias("l"), (F.col("user_id") % 10).cast("double").alias("pc"), F.when(F.col("user_id") % 7 == 0, 0).otherwise(F.unix_timestamp("ts")).alias("t"),
    )
    quotes = provider_quotes(raw, "as_of")
    q = F.struct(*(c for c in quotes.columns if c != "as_of"))
    kept = F.when(F.col("quote_time").isNotNull() | (F.col("price") > 50), q)
    failed = F.when(F.col("quote_time").isNull() & ~F.coalesce(F.col("price") > 50, F.lit(False)), F.col("ticker"))
    per = quotes.groupBy("as_of").agg(F.collect_list("ticker").alias("requested"), F.collect_list(failed).alias("errors"), F.collect_list(kept).alias("quotes"))
    return per.select("as_of", F.lit("events").alias("source"), F.size("quotes").alias("count"), "requested", "errors", "quotes")


def filing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing indexes: one for each customer, of their orders as filings, and one older page."""
    o = read(spark, sf_dir, "orders")
    form = F.element_at(F.array(*(F.lit(x) for x in ("4", "144", "4/A", "8-K", "144/A"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    f = F.struct(F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").cast("string").alias("a"), form.alias("f"))
    per = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(f), asc=False).alias("r"), F.min(F.to_date("o_orderdate")).alias("first"))
    recent = F.struct(F.col("r.f").alias("form"), F.col("r.d").alias("filingDate"), F.col("r.a").alias("accessionNumber"), F.transform("r", lambda x: F.concat(x["a"], F.lit(".xml"))).alias("primaryDocument"))
    pages = F.array(F.struct(F.concat(F.lit("page-"), F.col("o_custkey").cast("string")).alias("name"), F.date_sub("first", 1).alias("filingTo")))
    return per.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"), F.col("o_custkey").cast("string").alias("cik"), F.struct(recent.alias("recent"), pages.alias("files")).alias("filings"))


def _element(name: str, *parts) -> Column:
    return F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))


#: Order lines of a task that gathers them, at most and at least about.
LINES, FEW_LINES = 250_000, 20_000


def by_order(lines: DataFrame) -> DataFrame:
    """Lines dealt by order, before anything is made of them: into the session's shuffle partitions if these are enough,
    else into as many as keep a task's share at ``LINES``, however many lines there are."""
    count, own = lines.count(), int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(max(-(-count // LINES), min(own, count // FEW_LINES + 1)), "l_orderkey")


def ownership_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(accession, xml): an ownership document for each order, of its lines as transactions."""
    o, text = read(spark, sf_dir, "orders"), lambda c: F.col(c).cast("string")
    value = lambda name, c: _element(name, F.lit("<value>"), c, F.lit("</value>"))
    amounts = _element("transactionAmounts", value("transactionShares", text("l_quantity")), F.when(F.col("l_linenumber") % 5 == 0, "").otherwise(value("transactionPricePerShare", text("l_extendedprice"))))
    code = _element("transactionCoding", _element("transactionCode", F.element_at(F.create_map(*(F.lit(x) for x in ("A", "P", "R", "S", "N", "M"))), F.col("l_returnflag"))))
    one = _element("nonDerivativeTransaction", value("transactionDate", F.date_format("l_shipdate", "yyyy-MM-dd")), code, amounts)
    per = by_order(read(spark, sf_dir, "lineitem")).groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(one)), "").alias("rows"))
    met = o.join(per, F.col("o_orderkey") == F.col("l_orderkey"))
    rel = _element("reportingOwnerRelationship", _element("isDirector", F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise("0")), _element("isTenPercentOwner", F.lit("1")), _element("officerTitle", F.when(F.col("o_orderkey") % 3 == 0, " Chief ").otherwise("")))
    owner = _element("reportingOwner", _element("reportingOwnerId", _element("rptOwnerName", text("o_orderstatus"))), rel)
    notes = F.when(F.col("o_orderkey") % 4 == 0, "<footnotes><footnote>under a 10b5-1 plan</footnote></footnotes>").otherwise("")
    return met.select(text("o_orderkey").alias("accession"), _element("ownershipDocument", owner, F.lit("<aff10b5One>0</aff10b5One>"), notes, _element("nonDerivativeTable", F.col("rows"))).alias("xml"))


def sale_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(accession, cik, xml): a notice for each order, listed for its customer, now and then of another issuer's shares."""
    text = lambda c: F.col(c).cast("string")
    o = read(spark, sf_dir, "orders")
    issuer = (F.col("o_custkey") + F.when(F.col("o_orderkey") % 6 == 0, 1).otherwise(0)).cast("string")
    info = _element("issuerInfo", _element("issuerCik", F.lpad(issuer, 10, "0")), _element("nameOfPersonForWhoseAccountTheSecuritiesAreToBeSold", text("o_orderstatus")), F.lit("<relationshipsToIssuer><relationshipToIssuer>Officer</relationshipToIssuer></relationshipsToIssuer>"))
    units = F.when(F.col("o_orderkey") % 9 == 0, "0").otherwise((F.col("o_orderkey") % 50 * 7 / 4).cast("string"))
    sold = _element("securitiesInformation", _element("noOfUnitsSold", units), _element("aggregateMarketValue", text("o_totalprice")), _element("approxSaleDate", F.date_format("o_orderdate", "MM/dd/yyyy")))
    xml = _element("edgarSubmission", _element("formData", info, sold))
    return o.select(text("o_orderkey").alias("accession"), text("o_custkey").alias("cik"), xml.alias("xml"))
