"""Projections of the generic star-schema tables onto the screening domain.

Each function reads only the columns it needs and reduces them with map-side aggregation to the
natural grain of its domain table (security x week, company x fiscal year, company x release
hour).  Those grains are bounded by the calendar, so later windows per company or security stay
small whatever the skew of the raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cashlens.functions.numeric import MONEY, WIDE, half_up, ratio

AS_OF = "2001-11-04"

# The trading venue and currency that stand for each region.
MARKET_OF_REGION = {
    "AFRICA": ("CN", "CNY"),
    "AMERICA": ("CN", "CNY"),
    "ASIA": ("HK", "HKD"),
    "EUROPE": ("HK", "HKD"),
    "MIDDLE EAST": ("US", "USD"),
}
HKD_CNY = 0.92


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """lineitem with only the named columns."""
    return table(spark, sf_dir, "lineitem").select(*columns)


def money(c: str) -> Column:
    return F.col(c).cast(MONEY)


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """security_id, name, issuer_id, sector, market, currency, acctbal."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    market, currency = F.lit("UNKNOWN"), F.lit("")
    for region, (m, c) in MARKET_OF_REGION.items():
        market = F.when(F.col("r_name") == region, m).otherwise(market)
        currency = F.when(F.col("r_name") == region, c).otherwise(currency)
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("s_suppkey").alias("security_id"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("issuer_id"),
            F.col("r_name").alias("sector"),
            market.alias("market"),
            currency.alias("currency"),
            F.col("s_acctbal").alias("acctbal"),
        )
    )


def trading_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """security_id, week, fiscal_year with traded amount, quantity and cash return.

    The one aggregate from which weekly prices and yearly cash returns both derive.
    """
    li = lines(spark, sf_dir, "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
    return li.groupBy(
        F.col("l_suppkey").alias("security_id"),
        F.trunc(F.col("l_shipdate").cast("date"), "week").alias("week"),
        F.year("l_shipdate").alias("fiscal_year"),
    ).agg(
        F.sum(money("l_extendedprice")).alias("amount"),
        F.sum(money("l_quantity")).alias("quantity"),
        F.sum(money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")).alias("cash"),
    )


def day(text: str) -> Column:
    """A day as a timestamp literal of the stored type, so comparisons reach the parquet scan."""
    return F.lit(text).cast("timestamp_ntz")


def weekly_prices(
    spark: SparkSession, sf_dir: str, weeks: DataFrame | None = None, since: str | None = None, before: str | None = None
) -> DataFrame:
    """security_id, week, close: volume-weighted price of the week.

    ``since`` and ``before`` cut the raw rows by ship date before anything is aggregated; give bounds
    that leave every wanted week whole.
    """
    if weeks is None:
        raw = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
        if since is not None:
            raw = raw.where(F.col("l_shipdate") >= day(since))
        if before is not None:
            raw = raw.where(F.col("l_shipdate") < day(before))
        li = raw
        grouped = li.groupBy(
            F.col("l_suppkey").alias("security_id"),
            F.trunc(F.col("l_shipdate").cast("date"), "week").alias("week"),
        ).agg(F.sum(money("l_extendedprice")).alias("amount"), F.sum(money("l_quantity")).alias("quantity"))
    else:
        grouped = weeks.groupBy("security_id", "week").agg(
            F.sum("amount").alias("amount"), F.sum("quantity").alias("quantity")
        )
    return grouped.select(
        "security_id",
        "week",
        F.round(ratio(F.col("amount"), F.col("quantity")).cast(WIDE), 4).cast("decimal(18,4)").alias("close"),
    )


def price_features(spark: SparkSession, sf_dir: str, weeks: DataFrame | None = None) -> DataFrame:
    """One row per security: last and previous close, returns, RSI, drawdown, weeks of history."""
    newest = Window.partitionBy("security_id").orderBy(F.desc("week"))
    ranked = weekly_prices(spark, sf_dir, weeks).select(
        "security_id",
        "close",
        F.row_number().over(newest).alias("rn"),
        F.lead("close").over(newest).alias("older"),
    )
    at = lambda k: F.max(F.when(F.col("rn") == k, F.col("close")))
    move = F.col("close") - F.col("older")
    g = ranked.groupBy("security_id").agg(
        at(1).alias("last"),
        at(2).alias("prev"),
        at(6).alias("p5"),
        at(21).alias("p20"),
        F.sum(F.when(F.col("rn") <= 20, F.col("close"))).alias("sum20"),
        F.count(F.when(F.col("rn") <= 20, 1)).alias("n20"),
        F.max(F.when(F.col("rn") <= 60, F.col("close"))).alias("max60"),
        F.sum(F.when((F.col("rn") <= 14) & (move > 0), move).otherwise(0)).alias("gain"),
        F.sum(F.when((F.col("rn") <= 14) & (move < 0), -move).otherwise(0)).alias("loss"),
        F.count(F.lit(1)).alias("history_weeks"),
    )
    pct = lambda a, b: half_up((ratio(F.col(a), F.col(b)) - 1) * 100, 4)
    return g.select(
        "security_id",
        F.col("last").cast("double").alias("last"),
        F.col("prev").cast("double").alias("prev"),
        pct("last", "prev").alias("return1d_pct"),
        pct("last", "p5").alias("return5d_pct"),
        pct("last", "p20").alias("return20d_pct"),
        (F.col("last").cast("double") > ratio(F.col("sum20"), F.col("n20"))).alias("above_ma20"),
        pct("last", "max60").alias("drawdown60d_pct"),
        half_up(ratio(F.col("gain"), F.col("gain") + F.col("loss")) * 100, 4).alias("rsi14"),
        "history_weeks",
    )


def yield_basis(spark: SparkSession, sf_dir: str, weeks: DataFrame | None = None) -> DataFrame:
    """security_id, basis: mean yearly cash return per share with the years it covers."""
    if weeks is None:
        li = lines(spark, sf_dir, "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
        grouped = li.groupBy(F.col("l_suppkey").alias("security_id"), F.year("l_shipdate").alias("fiscal_year")).agg(
            F.sum(money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")).alias("cash"),
            F.sum(money("l_quantity")).alias("quantity"),
        )
    else:
        grouped = weeks.groupBy("security_id", "fiscal_year").agg(
            F.sum("cash").alias("cash"), F.sum("quantity").alias("quantity")
        )
    yearly = grouped.select(
        "security_id",
        "fiscal_year",
        F.round(ratio(F.col("cash"), F.col("quantity")).cast(WIDE), 6).alias("per_share"),
    )
    return yearly.groupBy("security_id").agg(
        half_up(ratio(F.sum("per_share"), F.count("per_share")), 6).alias("basis"),
        F.count(F.lit(1)).alias("window_years"),
        F.min("fiscal_year").alias("start_year"),
        F.max("fiscal_year").alias("end_year"),
    )


def order_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem reduced to one row per order before it meets orders (same key, one shuffle)."""
    li = lines(spark, sf_dir, "l_orderkey", "l_returnflag", "l_extendedprice", "l_quantity")
    flag = lambda f, c: F.sum(F.when(F.col("l_returnflag") == f, c))
    price, qty = money("l_extendedprice"), money("l_quantity")
    return li.groupBy("l_orderkey").agg(
        flag("N", price).alias("n_amount"),
        flag("R", price).alias("r_amount"),
        flag("A", price).alias("a_amount"),
        flag("R", qty).alias("r_quantity"),
        flag("A", qty).alias("a_quantity"),
    )


def company_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly facts per company from orders and their lines.

    A missing class of orders or lines leaves the fact null, never zero.
    """
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("company_id"),
        F.year("o_orderdate").alias("fiscal_year"),
        "o_orderstatus",
        "o_orderpriority",
        money("o_totalprice").alias("amount"),
    )
    joined = o.join(order_flows(spark, sf_dir), o.o_orderkey == F.col("l_orderkey"), "left")
    status = lambda *s: F.sum(F.when(F.col("o_orderstatus").isin(*s), F.col("amount")))
    priority = lambda p: F.sum(F.when(F.col("o_orderpriority") == p, F.col("amount")))
    grouped = joined.groupBy("company_id", "fiscal_year").agg(
        status("F", "P").alias("ordinary_dividend"),
        F.when(F.max(F.col("o_orderstatus") == "F"), "PAID")
        .when(F.max(F.col("o_orderstatus") == "P"), "SHAREHOLDER_APPROVED")
        .otherwise("PROPOSED")
        .alias("ordinary_dividend_status"),
        priority("1-URGENT").alias("special_dividend"),
        priority("2-HIGH").alias("asset_sale_distribution"),
        priority("5-LOW").alias("one_off_buyback"),
        F.sum("r_amount").alias("gross_cancelled_buyback"),
        F.sum("r_quantity").alias("cancelled_shares"),
        (F.sum("r_quantity") - F.sum("a_quantity")).alias("diluted_net_share_reduction"),
        F.sum("n_amount").alias("operating_cash_flow"),
        F.sum("r_amount").alias("capital_expenditure"),
        F.sum("a_amount").alias("lease_principal_repayment"),
        (F.sum("n_amount") - F.sum("a_amount")).alias("net_profit"),
        status("F").alias("cash"),
        status("O").alias("interest_bearing_debt"),
        status("P").alias("total_equity"),
        F.sum("amount").alias("total_assets"),
        status("O", "F").alias("total_liabilities"),
    )
    return grouped.withColumns(
        {
            "period_type": F.lit("FULL_YEAR"),
            "fiscal_year_end_date": F.make_date("fiscal_year", F.lit(12), F.lit(31)),
            "net_debt": F.col("interest_bearing_debt") - F.col("cash"),
        }
    )


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company_id, name, industry."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry")
    )


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed event payloads with a stable key and content hash."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256).alias("event_key"),
        F.col("user_id").alias("issuer_id"),
        "event_type",
        F.sha2("props", 256).alias("payload_hash"),
        F.col("props").alias("payload"),
        F.col("ts").alias("observed_at"),
        F.col("event_id").alias("batch_seq"),
        F.col("value"),
    )


def company_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per company and release hour, aggregated from the raw event values."""
    e = table(spark, sf_dir, "events")
    v = F.col("value").cast(MONEY)
    g = e.groupBy(F.col("user_id").alias("company_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("run_at")).agg(
        F.sum(v).alias("s"),
        F.count("value").alias("n"),
        F.max(v).alias("hi"),
        F.min(v).alias("lo"),
        F.array_sort(F.collect_set("event_type")).alias("kinds"),
    )
    mean = ratio(F.col("s"), F.col("n"))
    return g.select(
        "company_id",
        "run_at",
        F.col("run_at").cast("date").alias("trade_date"),
        half_up(mean / 1250, 6).alias("ssy"),
        half_up(F.col("hi").cast("double") / 1250, 6).alias("raw_yield"),
        F.col("s").cast("double").alias("h"),
        F.col("lo").cast("double").alias("eri"),
        half_up(mean / 50, 6).alias("coverage"),
        "kinds",
    )


FIELD_OF_PRIORITY = {
    "1-URGENT": "net_profit",
    "2-HIGH": "operating_cash_flow",
    "3-MEDIUM": "capital_expenditure",
    "4-NOT SPECIFIED": "total_equity",
    "5-LOW": "cash",
}
POINT_FIELDS = tuple(FIELD_OF_PRIORITY.values())
CONFLICT_ABOVE = 400_000


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance points: one per order; the status decides source and data status."""
    return points_of(table(spark, sf_dir, "orders"))


def points_of(o: DataFrame) -> DataFrame:
    """Points of order rows, of a table or a stream."""
    status, amount = F.col("o_orderstatus"), money("o_totalprice")
    field = F.lit(None).cast("string")
    for priority, name in FIELD_OF_PRIORITY.items():
        field = F.when(F.col("o_orderpriority") == priority, name).otherwise(field)
    data_status = F.when(status != "P", "VALID").when(amount > CONFLICT_ABOVE, "CONFLICT").otherwise("MISSING")
    source = F.when(status == "F", "Official annual report").when(status == "O", "Provider feed").otherwise("Exchange filing")
    year = F.year("o_orderdate")
    return o.select(
        F.col("o_custkey").alias("company_id"),
        year.alias("fiscal_year"),
        field.alias("field"),
        F.concat(F.lit("FY"), year.cast("string"), F.lit("."), field).alias("field_id"),
        F.lit(None).cast("string").alias("security_id"),
        F.concat(F.lit("FY"), year.cast("string")).alias("fiscal_period"),
        source.alias("source_name"),
        F.lower(F.regexp_replace(source, " ", "-")).alias("source_document"),
        F.lit("/archive").alias("source_url_or_local_path"),
        F.when(status == "F", "OFFICIAL_FILING").otherwise("PROVIDER").alias("source_level"),
        F.col("o_orderdate").alias("source_fetch_time"),
        F.when(amount > 300_000, F.lit(None)).otherwise("CNY").alias("currency"),
        F.lit("currency").alias("unit"),
        F.when(data_status == "VALID", amount).alias("value"),
        data_status.alias("data_status"),
        F.lit("ORIGINAL").alias("restatement_status"),
        F.col("o_orderkey").alias("ingest_seq"),
        F.col("o_orderkey").alias("seq"),
    )


def provider_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider statement facts per company, year and field (unpivoted yearly sums)."""
    years = company_years(spark, sf_dir).select("company_id", "fiscal_year", *[F.col(f).cast("decimal(38,2)").alias(f) for f in POINT_FIELDS])
    return years.unpivot(["company_id", "fiscal_year"], list(POINT_FIELDS), "field", "value")


def report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report fields per company and year: current value, comparative column, vendor value.

    The comparative column repeats the previous year without its urgent orders, the vendor value
    leaves out the low-priority ones, so both agree with the report only where there are none.
    """
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company_id"),
        F.year("o_orderdate").alias("fiscal_year"),
        F.col("o_orderstatus").alias("field"),
        "o_orderpriority",
        money("o_totalprice").alias("amount"),
    )
    p = F.col("o_orderpriority")
    g = o.groupBy("company_id", "field", "fiscal_year").agg(
        F.sum("amount").alias("current_value"),
        F.sum(F.when(p != "1-URGENT", F.col("amount"))).alias("next_comparative"),
        F.sum(F.when(p != "5-LOW", F.col("amount"))).alias("vendor_value"),
    )
    w = Window.partitionBy("company_id", "field").orderBy("fiscal_year")
    known = F.col("vendor_value").isNotNull()
    return g.select(
        "company_id",
        "field",
        "fiscal_year",
        "current_value",
        F.lag("next_comparative").over(w).alias("comparative_value"),
        F.lit("CNY").alias("currency"),
        F.lit("currency").alias("unit"),
        "vendor_value",
        F.when(known, "CNY").alias("vendor_currency"),
        F.when(known, "VALID").otherwise("MISSING").alias("vendor_status"),
        F.lit("REVIEW").alias("extraction_status"),
        (F.col("current_value") > 600_000).alias("accepted_before"),
    )


def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short annual report per order, worded from the order's own values.

    Three pages: a cash-flow statement in the unit of the priority, a dividend sentence whose
    wording follows the status, and a share-change table.
    """
    narrow = ("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice")
    # a file may be one unsplittable block: the narrow rows are dealt out before they become texts
    o = table(spark, sf_dir, "orders").select(*narrow).repartition("o_orderkey")
    year = F.year("o_orderdate")
    amount = F.format_number(money("o_totalprice"), 2)
    other = F.format_number((F.col("o_orderkey") + 1).cast(MONEY), 2)
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    unit = (
        F.when(priority == "1-URGENT", "单位：人民币百万元")
        .when(priority == "5-LOW", "人民币元 美元万元")
        .when(priority == "4-NOT SPECIFIED", "单位：元")
        .otherwise("单位：人民币元")
    )
    shown = F.when(status == "P", F.concat(F.lit("("), amount, F.lit(")"))).otherwise(amount)
    row = F.concat_ws(" ", F.lit("经营活动产生的现金流量净额"), shown, other)
    flow = F.concat_ws(
        "\n",
        F.lit("合并现金流量表"),
        unit,
        row,
        F.when(status == "O", row),
        F.lit("购建固定资产、无形资产和其他长期资产支付的现金"),
        F.concat_ws(" ", F.lit(" "), shown, other),
        F.lit("母公司现金流量表"),
        F.lit("经营活动产生的现金流量净额 1.00 2.00"),
    )
    y = year.cast("string")
    dividend = (
        F.when(status == "F", F.concat(y, F.lit("年度已派发现金股息总额人民币"), amount, F.lit("元")))
        .when(
            status == "P",
            F.concat(
                F.lit("股东大会审议通过"),
                y,
                F.lit("年度末期股息，每10股派发现金红利人民币"),
                F.format_number((money("o_totalprice") / 100000).cast("decimal(18,2)"), 2),
                F.lit("元"),
            ),
        )
        .otherwise(F.concat(F.lit("建议派发"), y, F.lit("年度特别股息合计港币"), amount, F.lit("元")))
    )
    first = F.format_number(F.col("o_orderkey") + 1_000_000, 0)
    last = F.format_number(F.col("o_orderkey") + 1_000_000 - F.col("o_custkey"), 0)
    shares = F.concat_ws(
        "\n", F.lit("股份变动情况 本次变动前 本次变动后 单位：股"), F.concat_ws(" ", F.lit("一、股份总数"), first, F.lit("100.00%"), last, F.lit("100.00"))
    )
    return o.select(
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_custkey").alias("company_id"),
        year.alias("fiscal_year"),
        F.lit("CN").alias("market"),
        F.lit("CNY").alias("currency"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"),
        F.concat_ws("\f", flow, dividend, shares).alias("text"),
    )


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report documents with titles in five forms, one per order."""
    narrow = ("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    o = table(spark, sf_dir, "orders").select(*narrow).repartition("o_orderkey")
    year = F.year("o_orderdate") + 5
    y, p = year.cast("string"), F.col("o_orderpriority")
    cjk = F.translate(y, "0123456789", "〇一二三四五六七八九")
    title = (
        F.when(p == "1-URGENT", F.concat(y, F.lit("年年度报告")))
        .when(p == "2-HIGH", F.concat(F.lit("Annual Report "), y))
        .when(p == "3-MEDIUM", F.concat(cjk, F.lit("年年报（修订版）")))
        .when(p == "4-NOT SPECIFIED", F.concat((year - 1).cast("string"), F.lit("/"), F.substring(y, 3, 2), F.lit(" 年報")))
        .otherwise(F.concat(y, F.lit("年半年度报告摘要")))
    )
    return o.select(
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_custkey").alias("company_id"),
        title.alias("source_document"),
        F.col("o_orderdate").cast("date").alias("publish_date"),
        F.col("o_orderkey").alias("source_announcement_id"),
        F.floor("o_totalprice").cast("int").alias("source_size_hint_kb"),
    )


def share_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Hong Kong share-capital note per order, with the balances of the order's own keys."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition("o_orderkey")
    y = F.year("o_orderdate").cast("string")
    first, cut = F.col("o_orderkey") + 1_000_000, F.col("o_custkey") + 1
    text = F.concat_ws(
        "\n",
        F.lit("16. 股本"),
        F.lit("股份數目 千股"),
        F.lit("法定股本"),
        F.lit("於年初 9,999,999"),
        F.lit("已發行及繳足"),
        F.concat(F.lit("於"), y, F.lit("年1月1日 "), F.format_number(first, 0)),
        F.concat(F.lit("購回及註銷股份 ("), F.format_number(cut, 0), F.lit(")")),
        F.concat(F.lit("於"), y, F.lit("年12月31日 "), F.format_number(first - cut, 0)),
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("fiscal_year"), text.alias("text"))
