"""File readers with explicit schemas: master data, quotes, weekly prices, statements, FX, reports, bundles.

All readers are permissive; a row that does not fit lands in ``_corrupt_record`` for the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashlens.functions.market import freshness, fx_to_base
from cashlens.functions.numeric import finite_double

c = F.col

MASTER = "issuerId string, securityId string, quoteCode string, name string, ticker string, market string, currency string, sector string, industry string"
SECURITY = """id string, issuerId string, quoteCode string, name string, ticker string, market string, currency string,
 sector string, industry string,
 quote struct<currentPrice:double,dailyChangePct:double,marketState:string,lastUpdatedAt:string,status:string>,
 targetPrices struct<watch:double,preferred:double,deep:double>,
 yieldBasis struct<annualAveragePerShareCny:double,windowYears:int,startYear:int,endYear:int,method:string>,
 metrics map<string,double>, valuationStatus string,
 technicalIndicators struct<rsi14:double,drawdown60dPct:double,relativeSector5dPct:double,historyTradingDays:int,asOf:string>,
 history array<struct<label:string,timestamp:string,price:double>>,
 targetRevisionHistory array<struct<label:string,preferredPrice:double,watchPrice:double,deepPrice:double,reason:string,changedAt:string>>,
 recommendationPaused boolean"""
SIGNAL = """return1dPct double, return5dPct double, return20dPct double, advancers5dPct double, aboveMa20Pct double,
 issuerCount int, coveredIssuerCount int, coveragePct double, asOf string"""
WATCHLIST = f"""mode string, isDemo boolean, snapshotGeneratedAt string,
 marketData struct<provider:string,realtime:boolean,collectedAt:string,fxRates:struct<HKD_CNY:struct<rate:double,asOf:string,fetchedAt:string,source:string,status:string>>>,
 sectorSignals map<string,struct<{SIGNAL.replace(' double', ':double').replace(' int', ':int').replace(' string', ':string')}>>,
 securities array<struct<_placeholder:string>>, _corrupt_record string"""
STATEMENTS = """schema_version string, fetched_at string, sha256 string,
 company struct<issuer_id:string,security_id:string,share_class:string>,
 statements map<string,struct<report_list:array<struct<date_time_str:string,fiscal_year:int,financial_type:int,period_text:string,currency_code:string,item_list:array<struct<field_id:bigint,display_name:string,data:string>>>>>>,
 _corrupt_record string"""
WEEKLY = "provider string, generatedAt string, securities map<string,struct<quoteCode:string,currency:string,frequency:string,adjustment:string,points:array<struct<timestamp:string,price:double>>>>, _corrupt_record string"


def _json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def companies(spark: SparkSession, path: str) -> DataFrame:
    """Company master: one document with ``companies[]``."""
    doc = _json(spark, path, f"companies array<struct<{_struct(MASTER)}>>, _corrupt_record string")
    return doc.select(F.explode("companies").alias("x")).select("x.*")


def _struct(ddl: str) -> str:
    """Column DDL to struct-field DDL."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(ddl).fields
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields)


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Watch-list document with its securities, market data and sector signals still nested."""
    ddl = WATCHLIST.replace("_placeholder:string", _struct(SECURITY))
    return _json(spark, path, ddl)


def watchlist_securities(document: DataFrame) -> DataFrame:
    """One row per security with the document's collection time, provider and FX rate beside it."""
    return document.select(
        F.coalesce("marketData.collectedAt", "snapshotGeneratedAt").alias("snapshot_collected_at"),
        F.coalesce("marketData.provider", F.lit("vendor")).alias("provider"),
        c("marketData.fxRates.HKD_CNY.rate").alias("hkd_cny"),
        F.explode("securities").alias("s"),
    ).select("snapshot_collected_at", "provider", "hkd_cny", "s.*")


def quote_observations(document: DataFrame, now) -> DataFrame:
    """Quote rows of a snapshot: the price counts only when available, FX follows the currency."""
    s = watchlist_securities(document)
    price = F.when(c("quote.status") == "available", finite_double(c("quote.currentPrice"), positive=True))
    m = lambda k: finite_double(c("metrics")[k])
    staged = s.select(
        F.trim("issuerId").alias("company_id"),
        F.trim("id").alias("security_id"),
        "market",
        "currency",
        price.alias("price"),
        F.when(price.isNotNull(), c("quote.lastUpdatedAt").try_cast("timestamp")).alias("quote_timestamp"),
        F.coalesce("quote.marketState", F.lit("unknown")).alias("market_state"),
        F.when(m("totalMarketValue") > 0, m("totalMarketValue")).alias("total_market_value"),
        m("pe").alias("pe"),
        m("peTtm").alias("pe_ttm"),
        m("pb").alias("pb"),
        m("dividendYieldTtmPct").alias("dividend_yield_ttm_pct"),
        m("earningsPerShare").alias("earnings_per_share"),
        m("bookValuePerShare").alias("book_value_per_share"),
        fx_to_base(c("currency"), c("hkd_cny")).alias("fx_to_base"),
        "provider",
        c("snapshot_collected_at").try_cast("timestamp").alias("snapshot_collected_at"),
    )
    return staged.withColumn(
        "freshness", freshness(c("quote_timestamp"), c("snapshot_collected_at"), c("market_state"), c("market"), now)
    )


def weekly_prices(spark: SparkSession, path: str, adjustment: str = "qfq") -> DataFrame:
    """Weekly adjusted closes: only series with the expected adjustment and frequency."""
    doc = _json(spark, path, WEEKLY)
    series = doc.select("provider", "generatedAt", F.explode("securities").alias("security_id", "s"))
    kept = series.where((c("s.adjustment") == adjustment) & (c("s.frequency") == "weekly"))
    points = kept.select("security_id", c("s.quoteCode").alias("quote_code"), c("s.currency").alias("currency"), F.explode("s.points").alias("p"))
    return points.select(
        "security_id",
        "quote_code",
        "currency",
        F.try_to_date(F.substring("p.timestamp", 1, 10), "yyyy-MM-dd").alias("week"),
        finite_double(c("p.price"), positive=True).alias("close"),
    ).where(c("week").isNotNull())


def statement_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Vendor statement documents, one file per company (see ``ledger.flatten_statements``)."""
    return _json(spark, path, STATEMENTS)


def staging(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Directory of one JSON file per company; rows whose file stem is not their company_id are marked."""
    df = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).json(path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return df.withColumn("file_matches", F.coalesce(stem == c("company_id"), F.lit(False)))


def annual_cash_csv(spark: SparkSession, path: str) -> DataFrame:
    """Per-share yearly cash returns from CSV (header; a byte-order mark is tolerated)."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    named = raw.toDF(*[x.lstrip("﻿").strip() for x in raw.columns])
    return named.select(
        "security_id",
        c("year").try_cast("int").alias("year"),
        (
            c("cash_dividend_per_share_cny").try_cast("decimal(28,12)")
            + c("net_cancelled_buyback_per_share_cny").try_cast("decimal(28,12)")
        ).alias("per_share"),
    )


def fx_rates_xml(spark: SparkSession, path: str) -> DataFrame:
    """Daily reference rates: (as_of, currency, rate) from the nested Cube elements."""
    schema = "Cube array<struct<_time:string,Cube:array<struct<_currency:string,_rate:double,_VALUE:string>>>>"
    outer = spark.read.format("xml").option("rowTag", "Cube").schema(schema).load(path)
    days = outer.select(F.explode("Cube").alias("d")).select(c("d._time").alias("as_of"), F.explode("d.Cube").alias("x"))
    return days.select("as_of", c("x._currency").alias("currency"), c("x._rate").alias("rate"))


def report_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole report texts with their file name as document id."""
    return spark.read.option("wholetext", True).text(path).select(
        F.regexp_replace(c("_metadata.file_name"), r"\.txt$", "").alias("doc_id"), c("value").alias("text")
    )


def bundle_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a bundle with length and SHA-256, for ``quality.bundle_issues``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/")
    return files.select(
        F.regexp_replace("path", "^.*?" + root.replace(".", r"\."), "").alias("path"), "length", F.sha2("content", 256).alias("sha256")
    )


def candidate_inventory(document: DataFrame) -> DataFrame:
    """companies -> reports -> candidates in one table, parent keys copied down."""
    r = document.select(F.explode("companies").alias("k")).select(c("k.company_id").alias("company_id"), F.explode("k.reports").alias("r"))
    return r.select("company_id", c("r.fiscal_year").alias("report_fiscal_year"), c("r.sha256").alias("report_sha256"), F.explode("r.candidates").alias("x")).select(
        "company_id", "report_fiscal_year", "report_sha256", "x.*"
    )


def event_store(spark: SparkSession, path: str, issuer_id: str | None = None, event_type: str | None = None) -> DataFrame:
    """Stored events, optionally of one issuer and type (both filters reach the parquet scan)."""
    df = spark.read.parquet(path)
    if issuer_id is not None:
        df = df.where(c("issuer_id") == issuer_id)
    if event_type is not None:
        df = df.where(c("event_type") == event_type)
    return df
