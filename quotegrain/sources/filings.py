"""Landed insider filings: issuer ids, filing indexes, ownership documents and sale notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.scalars import to_double, us_date
from .versioned import VersionedTable, bucket_of, newest_rows

TRADE_FORMS, NOTICE_FORMS = ["4", "4/A"], ["144", "144/A"]


def issuer_ids(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, cik): ten digits."""
    return issuer_ids_of(spark.read.text(path, wholetext=True))


def issuer_ids_of(texts: DataFrame) -> DataFrame:
    """The same of documents' texts in a column value."""
    raw = texts.select(F.from_json("value", schemas.ISSUER_IDS).alias("m"))
    return raw.select(F.explode(F.map_values("m")).alias("r")).select(F.upper("r.ticker").alias("ticker"), F.lpad(F.col("r.cik_str").cast("string"), 10, "0").alias("cik"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FILING_INDEX).option("multiLine", True).json(path)


def forms(index: DataFrame, since: Column) -> DataFrame:
    """(ticker, cik, form, date, accession, document, kind) of the recent blocks, on or after ``since``."""
    r = "filings.recent"
    rows = index.select("ticker", "cik", F.explode(F.arrays_zip(*(F.col(f"{r}.{c}").alias(c) for c in ("form", "filingDate", "accessionNumber", "primaryDocument")))).alias("f"))
    kind = F.when(F.col("f.form").isin(TRADE_FORMS), "form4").when(F.col("f.form").isin(NOTICE_FORMS), "form144")
    return rows.select("ticker", "cik", "f.form", F.col("f.filingDate").alias("date"), F.col("f.accessionNumber").alias("accession"), F.col("f.primaryDocument").alias("document"), kind.alias("kind")).where(F.col("kind").isNotNull() & (F.col("date") >= since))


def older_pages(index: DataFrame, since: Column) -> DataFrame:
    """(cik, name): pages that may reach back to ``since``, of issuers whose recent block does not."""
    short = F.coalesce(F.array_min("filings.recent.filingDate") > since, F.lit(False))
    return index.where(short).select("cik", F.explode("filings.files").alias("p")).where(F.col("p.filingTo") >= since).select("cik", "p.name")


def _accession() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.xml$", 1)


def form4(spark: SparkSession, path: str) -> DataFrame:
    """Trades of ownership documents in files; the accession is the file's name."""
    docs = spark.read.format("xml").option("rowTag", "ownershipDocument").schema(schemas.FORM4).load(path)
    return form4_rows(docs.withColumn("accession", _accession()))


def form4_text(docs: DataFrame) -> DataFrame:
    """The same of (accession, xml), a document's text per row."""
    return form4_rows(docs.select("accession", F.from_xml("xml", schemas.FORM4).alias("d")).select("accession", "d.*"))


def form4_rows(docs: DataFrame) -> DataFrame:
    """Purchases and sales of parsed documents. The first owner counts; missing shares or prices are 0, a missing owner is
    a question mark. Prices have two places, shares and values none."""
    owner = F.get("reportingOwner", F.lit(0))
    rel = owner["reportingOwnerRelationship"]
    yes = lambda c: F.coalesce(c, F.lit("")).isin("1", "true")
    role = F.coalesce(F.nullif(F.trim(rel["officerTitle"]), F.lit("")), F.when(yes(rel["isDirector"]), "Director").when(yes(rel["isTenPercentOwner"]), "10% owner"), F.lit(""))
    plan = yes(F.col("aff10b5One")) | F.coalesce(F.exists("footnotes.footnote", lambda x: x.contains("10b5-1")), F.lit(False))
    name = F.coalesce(F.nullif(owner["reportingOwnerId"]["rptOwnerName"], F.lit("")), F.lit("?"))
    rows = docs.select("accession", name.alias("owner"), role.alias("role"), plan.alias("plan"), F.explode("nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    number = lambda c: F.coalesce(to_double(c), F.lit(0.0))
    shares, price = number(F.col("t.transactionAmounts.transactionShares.value")), number(F.col("t.transactionAmounts.transactionPricePerShare.value"))
    return rows.select(
        F.to_date(F.substring("t.transactionDate.value", 1, 10)).alias("date"), "owner", "role", F.col("t.transactionCoding.transactionCode").alias("code"),
        F.bround(shares, 0).cast("bigint").alias("shares"), F.bround(price, 2).alias("price"), F.bround(shares * price, 0).cast("bigint").alias("value"), "plan", "accession",
    ).where(F.col("code").isin("P", "S"))


def form144(spark: SparkSession, path: str, listed: DataFrame) -> DataFrame:
    """Sale notices of documents in files. ``listed`` (accession, cik): for which issuer each was listed."""
    docs = spark.read.format("xml").option("rowTag", "edgarSubmission").option("ignoreNamespace", True).schema(schemas.FORM144).load(path)
    return form144_rows(docs.withColumn("accession", _accession()), listed)


def form144_text(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """The same of (accession, xml), a document's text per row."""
    parsed = F.from_xml("xml", schemas.FORM144, {"ignoreNamespace": "true"})
    return form144_rows(docs.select("accession", parsed.alias("d")).select("accession", "d.*"), listed)


def form144_rows(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """Notices whose issuer is the one they were listed for: an issuer also files notices of other issuers' shares. Units
    and a date are needed; the price is value over units, with two places. The first security sold counts."""
    info = F.col("formData.issuerInfo")
    ours = docs.join(listed.select("accession", "cik").distinct(), "accession").where(info["issuerCik"].try_cast("bigint") == F.col("cik").try_cast("bigint"))
    name = F.coalesce(info["nameOfPersonForWhoseAccountTheSecuritiesAreToBeSold"], F.lit("?"))
    role = F.coalesce(F.get(info["relationshipsToIssuer"]["relationshipToIssuer"], F.lit(0)), F.lit(""))
    rows = ours.select("accession", name.alias("owner"), role.alias("role"), F.get("formData.securitiesInformation", F.lit(0)).alias("s"))
    units, value = (F.coalesce(to_double(F.col(c)), F.lit(0.0)) for c in ("s.noOfUnitsSold", "s.aggregateMarketValue"))
    return rows.where(units != 0).select(
        us_date(F.trim("s.approxSaleDate")).alias("date"), "owner", "role", F.lit("S144").alias("code"), F.bround(units, 0).cast("bigint").alias("shares"),
        F.bround(value / units, 2).alias("price"), F.bround(value, 0).cast("bigint").alias("value"), F.lit(False).alias("plan"), "accession",
    ).where("date is not null")


def unseen(listed: DataFrame, txns: DataFrame, empty: DataFrame) -> DataFrame:
    """Listed filings whose accession is neither in the transactions nor known to give none."""
    return listed.join(txns.select("accession").union(empty.select("accession")).distinct(), "accession", "left_anti")


def emptied(seen: DataFrame, surviving: DataFrame, empty: DataFrame) -> DataFrame:
    """Accessions known to give nothing: those so far, and seen ones of which no row is left."""
    gone = seen.select("accession").join(surviving.select("accession"), "accession", "left_anti")
    return empty.select("accession").union(gone).distinct()


class SeenAccessions:
    """All accessions that were looked into, in a table that only grows: (accession, empty: it gave no row that is kept).

    Accessions lie in buckets; a batch reads the buckets that it has accessions in, and adds rows of its own."""

    KEYS = ["accession"]

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.table, self.buckets = VersionedTable(spark, path), buckets

    def hit(self, listed: DataFrame) -> list[str]:
        """The buckets of these accessions: at most ``buckets`` names."""
        return [r.part for r in listed.select(bucket_of(self.KEYS, self.buckets).alias("part")).distinct().collect()]

    def among(self, listed: DataFrame) -> DataFrame | None:
        """What is known of the buckets of these accessions; None before the first batch."""
        version = self.table.manifest().version
        return newest_rows(self.table.read(version, self.hit(listed)), self.KEYS) if version else None

    def unseen(self, listed: DataFrame) -> DataFrame:
        """Rows of ``listed`` whose accession is not known."""
        known = self.among(listed)
        return listed if known is None else listed.join(known.select("accession"), "accession", "left_anti")

    def record(self, looked_into: DataFrame, surviving: DataFrame, number: int) -> None:
        """Takes in a numbered batch: the accessions that were looked into, and rows of which some are kept."""
        kept = surviving.select("accession", F.lit(False).alias("empty")).distinct()
        rows = looked_into.select("accession").distinct().join(kept, "accession", "left").na.fill({"empty": True})
        self.table.upsert(rows, self.KEYS, number, self.buckets)

    def emptied(self) -> DataFrame:
        """Accessions that gave nothing."""
        return self.table.current(self.KEYS).where("empty").select("accession")
