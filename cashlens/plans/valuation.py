"""Queries over market value, coverage, returns, confidence and freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashlens.functions import market as M
from cashlens.functions.numeric import half_up, linear_score, ratio
from cashlens.functions import policy as P
from cashlens.operators import history as H
from cashlens.operators import valuation as V
from cashlens.operators.ledger import balance_sheet_kind
from cashlens.plans import history as PH
from cashlens.plans.registry import query
from cashlens.plans.sqlparts import clip, d, knots, m, part, rnd, with_parts
from cashlens.sources import domain as D

c = F.col
NOW = "2001-11-05 10:00:00"

# A share class per line status: FX by class, shares from quantities, one class per (company, flag).
part(
    "share_class",
    f"""SELECT o_custkey AS company_id, l_returnflag AS share_class, {d(f"sum({m('l_extendedprice')})")} / {d(f"sum({m('l_quantity')})")} AS price, {d(f"sum({m('l_quantity')})")} AS issued_shares,
  CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'N' THEN 0.92::DOUBLE ELSE 0.5::DOUBLE END AS fx, CASE l_returnflag WHEN 'R' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS factor, max(l_shipdate) AS ts
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""",
)


def share_classes(spark, sf):
    """One row per company and return flag; lines are reduced per order and flag before the join."""
    li = D.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(
        F.sum(D.money("l_extendedprice")).alias("amount"), F.sum(D.money("l_quantity")).alias("quantity"), F.max("l_shipdate").alias("ts")
    )
    o = D.table(spark, sf, "orders").select("o_orderkey", c("o_custkey").alias("company_id"))
    g = li.join(o, c("l_orderkey") == c("o_orderkey")).groupBy("company_id", c("l_returnflag").alias("share_class")).agg(
        F.sum("amount").alias("amount"), F.sum("quantity").alias("quantity"), F.max("ts").alias("price_timestamp")
    )
    return g.select(
        "company_id",
        c("share_class").alias("security_id"),
        "share_class",
        ratio(c("amount"), c("quantity")).alias("price"),
        c("quantity").cast("double").alias("issued_shares"),
        F.when(c("share_class") == "A", 1.0).when(c("share_class") == "N", 0.92).otherwise(0.5).alias("fx_to_base"),
        F.when(c("share_class") == "R", 2.0).otherwise(1.0).alias("economic_rights_factor"),
        F.lit(True).alias("rights_verified"),
        F.lit(True).alias("material"),
        F.lit("VALID").alias("quote_status"),
        "price_timestamp",
    )


HOURS = 24 * 400
part(
    "market_cap",
    f"""SELECT c_custkey AS company_id, CASE WHEN present IS DISTINCT FROM ['A','N','R'] THEN 'SHARE_CLASSES_INCOMPLETE' WHEN bad THEN 'CLASS_INPUT_INVALID' END AS blocker, n AS material_classes, total
FROM customer LEFT JOIN (SELECT company_id, list_sort(list(share_class)) AS present, count(*) AS n, bool_or(TIMESTAMP '{NOW}' - ts > to_hours({HOURS}) OR ts > TIMESTAMP '{NOW}') AS bad, sum(price * issued_shares * fx) AS total FROM share_class GROUP BY 1) ON company_id = c_custkey""",
    "share_class",
)


@query(
    "market_cap_ah",
    with_parts("market_cap", f"SELECT company_id, blocker, material_classes, {rnd('CASE WHEN blocker IS NULL THEN total END', 2)} AS market_cap FROM market_cap"),
)
def market_cap_ah(spark, sf):
    return market_caps(spark, sf).withColumn("market_cap", half_up(c("market_cap"), 2))


def market_caps(spark, sf):
    expected = D.table(spark, sf, "customer").select(
        c("c_custkey").alias("company_id"), F.array(*[F.lit(x) for x in ("A", "N", "R")]).alias("expected_classes")
    )
    now = F.lit(NOW).cast("timestamp_ntz")
    return V.company_market_cap(share_classes(spark, sf), expected, now, HOURS)


@query(
    "prices_at_four_percent",
    with_parts(
        ["share_class", "credited_h", "fcf_company"],
        f"""SELECT s.company_id, s.share_class, {rnd(f"({PH.SUSTAIN_SQL}) / 0.04::DOUBLE / eq * factor / fx", 6)} AS price_at_4pct
FROM (SELECT *, sum(issued_shares * factor) OVER (PARTITION BY company_id) AS eq FROM share_class) s LEFT JOIN credited_h h USING (company_id) LEFT JOIN fcf_company USING (company_id)""",
    ),
)
def prices_at_four_percent(spark, sf):
    sustainable = PH.slow(spark, sf).select("company_id", "sustainable")
    return V.prices_at_four_percent(share_classes(spark, sf), sustainable).select(
        "company_id", "share_class", half_up(c("price_at_4pct"), 6).alias("price_at_4pct")
    )


@query(
    "vendor_value_check",
    f"""SELECT company_id, blocker, {rnd('value', 2)} AS market_value, CASE WHEN blocker IS NULL THEN CASE WHEN vendor THEN 'VENDOR_AUTHORIZED' ELSE 'DERIVED' END ELSE 'UNAVAILABLE' END AS market_value_basis, deviation AS deviation_warning
FROM (SELECT *, CASE WHEN blocker IS NULL THEN CASE WHEN vendor THEN tmv * 0.92::DOUBLE ELSE price * official * 0.92::DOUBLE END END AS value, blocker IS NULL AND vendor AND rel > 0.02 AS deviation
FROM (SELECT *, CASE WHEN l_orderkey IS NULL THEN 'MARKET_OBSERVATION_MISSING' WHEN price IS NULL THEN 'PRICE_OR_FX_MISSING' WHEN vendor AND rel > 0.05 THEN 'VENDOR_EQUIVALENT_SHARES_DEVIATION_GT_5PCT' WHEN NOT vendor AND NOT direct THEN 'SEEV_NOT_AUTHORIZED' END AS blocker
FROM (SELECT o_orderkey AS company_id, l_orderkey, o_orderpriority IN ('1-URGENT','2-HIGH') AS vendor, o_orderstatus <> 'O' AS direct, q AS official, tmv, amt / nullif(q, 0) AS price, abs(tmv / (amt / q) - q) / q AS rel
FROM (SELECT o_orderkey, o_orderpriority, o_orderstatus, l_orderkey, {d('q')} AS q, {d('amt')} AS amt, {d('amt')} * (1 + {d('disc')}) AS tmv
  FROM orders LEFT JOIN (SELECT l_orderkey, sum({m('l_quantity')}) AS q, sum({m('l_extendedprice')}) AS amt, min({m('l_discount')}) AS disc FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey))))""",
)
def vendor_value_check(spark, sf):
    li = D.table(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("company_id")).agg(
        F.sum(D.money("l_quantity")).cast("double").alias("q"),
        F.sum(D.money("l_extendedprice")).cast("double").alias("amt"),
        F.min(D.money("l_discount")).cast("double").alias("disc"),
    )
    obs = li.select(
        "company_id",
        c("company_id").alias("security_id"),
        ratio(c("amt"), c("q")).alias("price"),
        F.lit(0.92).alias("fx_to_base"),
        (c("amt") * (1 + c("disc"))).alias("total_market_value"),
        c("q").alias("official_equivalent_shares"),
        F.lit("CURRENT").alias("freshness"),
    )
    auth = D.table(spark, sf, "orders").select(
        c("o_orderkey").alias("company_id"),
        c("o_orderkey").alias("selected_security_id"),
        c("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("vendor_value_authorized"),
        (c("o_orderstatus") != "O").alias("direct_equivalent_shares_authorized"),
    )
    v = V.vendor_value(auth.join(obs, "company_id", "left"))
    return v.select(
        "company_id",
        "blocker",
        half_up(c("market_value"), 2).alias("market_value"),
        "market_value_basis",
        F.array_contains("market_warnings", "VENDOR_EQUIVALENT_SHARES_DEVIATION_2_TO_5PCT").alias("deviation_warning"),
    )


def industry_inputs(spark, sf):
    """Bank and insurance inputs from the newest year's figures, fcf median for the rest."""
    slow = PH.slow(spark, sf).select("company_id", "h", c("capacity").alias("fcf_median"), c("simplified_fcf").alias("lease_incomplete"))
    cust = D.table(spark, sf, "customer").select(
        c("c_custkey").alias("company_id"), "c_mktsegment", D.money("c_acctbal").cast("double").alias("bal")
    )
    kind = (
        F.when(c("c_mktsegment") == "BUILDING", "BANK")
        .when(c("c_mktsegment") == "HOUSEHOLD", "INSURANCE")
        .when(c("c_mktsegment") == "FURNITURE", "SECURITIES")
        .otherwise("NON_FINANCIAL")
    )
    bal = c("bal")
    j = cust.withColumn("industry_kind", kind).join(slow, "company_id", "left")
    bank = {
        "adjusted_net_income": c("h"),
        "capital_generation_capacity": c("fcf_median"),
        "cet1_ratio": bal / 100_000 + 0.08,
        "cet1_regulatory_minimum": F.lit(0.08),
        "risk_weighted_asset_growth": F.lit(0.05),
        "nonperforming_loan_ratio": F.lit(0.01),
        "provision_coverage_ratio": F.lit(2.0),
        "credit_cost": F.lit(0.01),
        "net_interest_margin": F.when(bal > -500, F.lit(0.02)),
    }
    insurance = {
        "free_surplus_generation": c("h"),
        "distributable_surplus_capacity": c("h") * 0.8,
        "comprehensive_solvency_ratio": bal / 10_000 + 1.0,
        "comprehensive_solvency_minimum": F.lit(1.0),
        "core_solvency_ratio": bal / 20_000 + 0.5,
        "core_solvency_minimum": F.lit(0.5),
        "investment_asset_quality_score": F.lit(60.0),
        "interest_rate_sensitivity_score": F.lit(50.0),
        "new_business_value": F.lit(1.0),
    }
    return j.withColumns(bank | insurance)


@query(
    "coverage_by_industry",
    with_parts(
        ["credited_h", "fcf_company"],
        f"""SELECT company_id, industry_kind, {rnd('capacity', 4)} AS capacity, {rnd('CASE WHEN h IS NOT NULL AND capacity IS NOT NULL THEN greatest(0.0::DOUBLE, least(h, cut * greatest(capacity, 0.0::DOUBLE))) END', 6)} AS sustainable,
  CASE WHEN h IS NULL OR capacity IS NULL THEN 'INSUFFICIENT_DATA' WHEN industry_kind = 'NON_FINANCIAL' AND simplified_fcf THEN 'PARTIAL' ELSE 'VALID' END AS coverage_status, near_minimum
FROM (SELECT *, CASE industry_kind WHEN 'NON_FINANCIAL' THEN 0.90::DOUBLE ELSE 1.0::DOUBLE END AS cut, CASE industry_kind WHEN 'NON_FINANCIAL' THEN med
    WHEN 'BANK' THEN CASE WHEN h IS NULL OR med IS NULL OR bal <= -500 THEN NULL WHEN (bal / 100000 + 0.08) - 0.08 <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(h, med) * 0.90::DOUBLE * least(1.0::DOUBLE, ((bal / 100000 + 0.08::DOUBLE) - 0.08::DOUBLE) / 0.01::DOUBLE)) END
    WHEN 'INSURANCE' THEN CASE WHEN h IS NOT NULL THEN greatest(0.0::DOUBLE, least(h, h * 0.8::DOUBLE) * 0.90::DOUBLE * CASE WHEN buf <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, buf / 0.20::DOUBLE) END) END END AS capacity,
    CASE industry_kind WHEN 'BANK' THEN (bal / 100000 + 0.08::DOUBLE) - 0.08::DOUBLE <= 0.01 WHEN 'INSURANCE' THEN buf <= 0.20 END AS near_minimum
  FROM (SELECT c_custkey AS company_id, h, capacity AS med, simplified_fcf, {d(m('c_acctbal'))} AS bal, least(({d(m('c_acctbal'))} / 10000 + 1.0::DOUBLE) - 1.0::DOUBLE, ({d(m('c_acctbal'))} / 20000 + 0.5::DOUBLE) - 0.5::DOUBLE) AS buf,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'BANK' WHEN 'HOUSEHOLD' THEN 'INSURANCE' WHEN 'FURNITURE' THEN 'SECURITIES' ELSE 'NON_FINANCIAL' END AS industry_kind
    FROM customer LEFT JOIN credited_h ON company_id = c_custkey LEFT JOIN fcf_company USING (company_id)))""",
    ),
)
def coverage_by_industry(spark, sf):
    rows = V.coverage_by_industry(industry_inputs(spark, sf))
    return rows.select(
        "company_id",
        "industry_kind",
        half_up(c("capacity"), 4).alias("capacity"),
        half_up(c("sustainable"), 6).alias("sustainable"),
        "coverage_status",
        V.capital_buffer_near_minimum().alias("near_minimum"),
    )


part(
    "fast",
    f"""SELECT *, CASE WHEN idx IS NULL THEN NULL ELSE least(least(idx, 60.0::DOUBLE), CASE WHEN n_years <= 2 THEN 50.0::DOUBLE WHEN n_years <= 4 THEN 65.0::DOUBLE WHEN n_years <= 7 THEN 80.0::DOUBLE ELSE 100.0::DOUBLE END) END AS ri
FROM (SELECT *, {clip(f"((rs * 0.45::DOUBLE + {clip('payout')} * 0.30::DOUBLE) / (0.45::DOUBLE + 0.30::DOUBLE))")} AS idx
FROM (SELECT *, {clip("(50.0::DOUBLE + 25.0::DOUBLE * ((cr10 - 0.04::DOUBLE) / 0.01::DOUBLE))")} AS rs
FROM (SELECT *, ssy + growth + drag AS cr10
FROM (SELECT s.company_id, s.n_years, CASE WHEN cap > 0 AND r2 >= 0 THEN r2 / cap END AS raw_yield, CASE WHEN cap > 0 AND sustainable >= 0 THEN sustainable / cap END AS ssy,
    coalesce(CASE WHEN og IS NULL THEN NULL WHEN og <= 0 THEN og WHEN len(g) >= 5 THEN least(0.03, og) WHEN len(g) >= 3 THEN least(0.02, og) ELSE least(0.0, og) END, 0) AS growth,
    CASE WHEN cov IS NULL OR tr IS NULL OR st IS NULL OR bs IS NULL THEN NULL ELSE payout_raw END AS payout,
    CASE WHEN m5 > 0 AND latest > 0 THEN least(0.0::DOUBLE, pow(m5 / latest, 0.1::DOUBLE) - 1) END AS drag
  FROM slow s LEFT JOIN (SELECT company_id, CASE WHEN blocker IS NULL THEN total END AS cap FROM market_cap) USING (company_id)))))""",
    "slow",
    "market_cap",
)


@query(
    "fast_variables",
    with_parts(
        "fast",
        f"""SELECT company_id, {rnd('raw_yield', 8)} AS raw_yield, {rnd('ssy', 8)} AS ssy, {rnd('drag', 8)} AS drag, {rnd('cr10', 8)} AS cr10, {rnd('rs', 4)} AS return_score, {rnd('ri', 4)} AS recommendation_index,
  CASE WHEN ssy IS NOT NULL AND cr10 IS NOT NULL THEN CASE WHEN ssy >= 0.04 THEN 'CASH_ANCHORED' WHEN cr10 >= 0.04 THEN 'GROWTH_SUPPLEMENTED' ELSE 'BELOW_THRESHOLD' END END AS return_type FROM fast""",
    ),
)
def fast_variables(spark, sf):
    slow = PH.slow(spark, sf).withColumns(
        {"business_durability": F.lit(None).cast("double"), "governance": F.lit(None).cast("double")}
    )
    # The valuation history of a company stands in for P/FCF: its median payout against the latest one.
    val = slow.select("company_id", V.valuation_drag(c("m5"), c("latest")).alias("drag"))
    fast = V.fast_variables(slow, market_caps(spark, sf), val)
    return fast.select(
        "company_id",
        *[half_up(c(x), 8).alias(x) for x in ("raw_yield", "ssy", "drag", "cr10")],
        half_up(c("return_score"), 4).alias("return_score"),
        half_up(c("recommendation_index"), 4).alias("recommendation_index"),
        "return_type",
    )


part(
    "plan",
    """SELECT k.company_id, k.industry, coalesce(e.dy, []) AS dy, coalesce(v.cy, []) AS cy, coalesce(v.lease_ok, false) AS lease_ok, b.balance_kind, k.bal
FROM (SELECT c_custkey AS company_id, c_mktsegment AS industry, c_acctbal AS bal FROM customer) k
LEFT JOIN (SELECT company_id, list(fiscal_year ORDER BY rn) AS dy FROM eligible_year GROUP BY 1) e USING (company_id)
LEFT JOIN (SELECT company_id, list(fiscal_year ORDER BY rn) AS cy, bool_and(lease_principal_repayment IS NOT NULL) AS lease_ok FROM coverage_year GROUP BY 1) v USING (company_id)
LEFT JOIN balance b USING (company_id)""",
    "eligible_year",
    "coverage_year",
    "balance",
)


@query(
    "assessment_tier",
    with_parts(
        "plan",
        """, base AS (SELECT *, 2000 - list_aggregate(dy, 'max') AS dlag, 2000 - list_aggregate(cy, 'max') AS clag, CASE WHEN balance_kind IN ('NET_CASH','NET_DEBT_TO_EQUITY') THEN 'DIRECT' WHEN balance_kind = 'DEBT_TO_ASSETS_PROXY' THEN 'PROXY' ELSE 'UNAVAILABLE' END AS bb,
  len(cy) > 0 AND NOT lease_ok AS simple, bal > 0 AS has_val FROM plan),
dom AS (SELECT *, 12 AS d1, CASE WHEN dlag = 1 THEN greatest((CASE WHEN len(dy) >= 5 THEN 25 WHEN len(dy) >= 3 THEN 20 WHEN len(dy) >= 2 THEN 15 ELSE 0 END) - 3, 0) ELSE (CASE WHEN len(dy) >= 5 THEN 25 WHEN len(dy) >= 3 THEN 20 WHEN len(dy) >= 2 THEN 15 ELSE 0 END) END AS d2,
  CASE WHEN simple THEN greatest(c3 - 2, 0) ELSE c3 END AS d3, CASE WHEN has_val THEN 14 ELSE 10 END AS d4, CASE WHEN len(cy) >= 5 THEN 5 WHEN len(cy) >= 3 THEN 4 WHEN len(cy) = 2 THEN 2 ELSE 0 END AS d5, CASE WHEN bal > 5000 THEN 4 ELSE 0 END AS d6
  FROM (SELECT *, (CASE WHEN len(cy) >= 4 THEN 18 WHEN len(cy) = 3 THEN 15 WHEN len(cy) >= 2 THEN 12 ELSE 0 END) + (CASE bb WHEN 'DIRECT' THEN 7 WHEN 'PROXY' THEN 4 ELSE 0 END) AS c3 FROM base))
SELECT company_id, CAST(d1 + d2 + d3 + d4 + d5 + d6 AS INTEGER) AS confidence, CASE WHEN blocked THEN 'BLOCKED' WHEN d1 + d2 + d3 + d4 + d5 + d6 < 60 OR simple OR bb = 'PROXY' OR len(cy) < 2 OR d6 = 0 THEN 'ESTIMATED' ELSE 'CALCULABLE' END AS data_tier, blockers
FROM (SELECT *, len(blockers) > 0 AS blocked FROM (SELECT *, concat_ws(',', CASE WHEN industry IN ('BUILDING','HOUSEHOLD') THEN 'INDUSTRY_COVERAGE_ADAPTER_NOT_READY' END, CASE WHEN len(dy) < 2 THEN 'DIVIDEND_HISTORY_LT_2Y' END,
  CASE WHEN dlag IS NULL OR dlag > 1 THEN 'DIVIDEND_HISTORY_NOT_RECENT' END, CASE WHEN len(cy) < 2 THEN 'COVERAGE_HISTORY_LT_2Y' END, CASE WHEN clag IS NULL OR clag > 1 THEN 'COVERAGE_HISTORY_NOT_RECENT' END,
  CASE WHEN NOT has_val THEN 'CURRENT_VALUATION_MISSING' END, CASE WHEN bb = 'UNAVAILABLE' THEN 'BALANCE_SHEET_MINIMUM_MISSING' END, CASE WHEN d1 + d2 + d3 + d4 + d5 + d6 < 35 THEN 'DATA_CONFIDENCE_LT_35' END) AS blockers FROM dom))""",
    ).replace("\n, base AS", ",\nbase AS"),
)
def assessment_tier(spark, sf):
    years = balance_sheet_kind(D.company_years(spark, sf))
    as_of = PH.as_of()
    # Distribution and coverage years of a company from one pass over the yearly table.
    from pyspark.sql import Window

    newest = H.newest_first().rowsBetween(Window.unboundedPreceding, 0)
    ended = c("fiscal_year_end_date") <= as_of
    pays = F.coalesce(ended & c("ordinary_dividend_status").isin(*H.ELIGIBLE_DIVIDEND_STATUSES) & (c("ordinary_dividend") >= 0), F.lit(False))
    covers = F.coalesce(ended & c("operating_cash_flow").isNotNull() & (c("capital_expenditure") >= 0), F.lit(False))
    ranked = years.withColumns({"pays": pays, "covers": covers}).withColumns(
        {
            "rd": F.sum(c("pays").cast("int")).over(newest),
            "rc": F.sum(c("covers").cast("int")).over(newest),
            "rn": F.row_number().over(H.newest_first()),
        }
    )
    in_d, in_c = c("pays") & (c("rd") <= 10), c("covers") & (c("rc") <= 5)
    g = ranked.groupBy("company_id").agg(
        F.reverse(F.array_sort(F.collect_list(F.when(in_d, c("fiscal_year"))))).alias("distribution_years"),
        F.reverse(F.array_sort(F.collect_list(F.when(in_c, c("fiscal_year"))))).alias("coverage_years"),
        F.min(F.when(in_c, c("lease_principal_repayment").isNotNull())).alias("lease_complete"),
        F.max(F.when(c("rn") == 1, c("balance_basis"))).alias("balance_basis"),
    )
    cust = D.table(spark, sf, "customer").select(c("c_custkey").alias("company_id"), "c_mktsegment", "c_acctbal")
    empty = F.array().cast("array<int>")
    none = F.array().cast("array<string>")
    rows = cust.join(g, "company_id", "left").withColumns(
        {
            "distribution_years": F.coalesce("distribution_years", empty),
            "coverage_years": F.coalesce("coverage_years", empty),
            "balance_basis": F.coalesce("balance_basis", F.lit("UNAVAILABLE")),
            "security_id": c("company_id"),
            "pe_ttm": F.when(c("c_acctbal") > 0, c("c_acctbal")),
            "pe": F.lit(None).cast("double"),
            "pb": F.lit(None).cast("double"),
            "market_warnings": none,
            "balance_warnings": none,
            "has_source": F.lit(True),
            "has_official_source": F.lit(False),
            "market_value_basis": F.lit("VENDOR_AUTHORIZED"),
            "business": F.lit(False),
            "governance_known": F.lit(False),
            "structural": F.lit(False),
            "policy_known": F.lit(False),
            "veto_known": c("c_acctbal") > 5000,
            "industry_kind": F.when(c("c_mktsegment").isin("BUILDING", "HOUSEHOLD"), "BANK").otherwise("NON_FINANCIAL"),
            "price": F.lit(1.0),
            "fx_to_base": F.lit(1.0),
            "source_conflict": F.lit(False),
            "source_missing": F.lit(False),
            "source_invalid": F.lit(False),
            "blocker": F.lit(None).cast("string"),
            "relative_difference": F.lit(0.01),
            "freshness": F.lit("CURRENT"),
        }
    )
    assessed = V.assess(V.data_confidence(V.input_plan(rows), F.lit(2001)))
    return assessed.select("company_id", "confidence", "data_tier", F.array_join("blockers", ",").alias("blockers"))


@query(
    "freshness",
    """SELECT event_id, CASE WHEN ts > now_ THEN 'STALE_LAST_GOOD' WHEN trading AND age <= 600 THEN 'CURRENT' WHEN trading THEN 'STALE_LAST_GOOD' WHEN age <= 345600 AND wd <= 1 THEN 'MARKET_CLOSED_CURRENT' ELSE 'STALE_LAST_GOOD' END AS freshness, CAST(wd AS INTEGER) AS weekdays
FROM (SELECT *, epoch_us(now_ - ts) / 1000000.0 AS age, event_type = 'click' OR (isodow(now_) <= 5 AND ((market = 'HK' AND (s BETWEEN 5400 AND 14400 OR s BETWEEN 18000 AND 28800)) OR (market = 'CN' AND (s BETWEEN 5400 AND 12600 OR s BETWEEN 18000 AND 25200)))) AS trading,
   len(list_filter(range(1, greatest(date_diff('day', CAST(ts AS DATE), CAST(now_ AS DATE)), 0) + 1), lambda k: isodow(CAST(ts AS DATE) + CAST(k AS INTEGER)) <= 5)) AS wd
  FROM (SELECT event_id, ts, event_type, CASE event_type WHEN 'view' THEN 'CN' WHEN 'signup' THEN 'US' ELSE 'HK' END AS market, date_trunc('minute', ts) + to_minutes(CAST(floor(value) AS BIGINT) * 60) AS now_,
     hour(date_trunc('minute', ts) + to_minutes(CAST(floor(value) AS BIGINT) * 60)) * 3600 + minute(date_trunc('minute', ts) + to_minutes(CAST(floor(value) AS BIGINT) * 60)) * 60 + second(date_trunc('minute', ts) + to_minutes(CAST(floor(value) AS BIGINT) * 60)) AS s FROM events))""",
)
def freshness(spark, sf):
    e = D.table(spark, sf, "events").select("event_id", c("ts").cast("timestamp").alias("ts"), "event_type", "value")
    market = F.when(c("event_type") == "view", "CN").when(c("event_type") == "signup", "US").otherwise("HK")
    now = F.timestamp_seconds(
        F.floor(F.unix_micros("ts") / 60_000_000) * 60 + F.floor("value") * 3600
    )
    rows = e.withColumns({"now": now, "market": market, "state": F.when(c("event_type") == "click", "Trading ").otherwise("closed")})
    return rows.select(
        "event_id",
        M.freshness(c("ts"), c("ts"), c("state"), c("market"), c("now")).alias("freshness"),
        M.weekdays_between(c("ts").cast("date"), c("now").cast("date")).alias("weekdays"),
    )


@query(
    "daily_change",
    """SELECT o_orderkey AS id, round_even(x * 10000, 0) / 10000 AS change_pct FROM (SELECT o_orderkey, (o_totalprice - p) / p * 100 AS x
FROM (SELECT o_orderkey, o_totalprice, min(l_extendedprice) AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2))""",
)
def daily_change(spark, sf):
    li = D.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("p"))
    o = D.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    j = o.join(li, c("o_orderkey") == c("l_orderkey"))
    return j.select(
        c("o_orderkey").alias("id"), M.daily_change(F.lit(None).cast("double"), c("o_totalprice"), c("p")).alias("change_pct")
    )


@query(
    "snapshot_metrics",
    """SELECT p_partkey AS id, CASE WHEN p_retailprice > 0 THEN p_retailprice END AS pe, CASE WHEN p_size - 10 >= 0 THEN CAST(p_size - 10 AS DOUBLE) END AS dividend_yield, CAST(p_size - 25 AS DOUBLE) AS eps FROM part""",
)
def snapshot_metrics(spark, sf):
    raw = D.table(spark, sf, "part").select(
        c("p_partkey").alias("id"),
        c("p_retailprice").alias("peRatio"),
        (c("p_size") - 10).alias("dividend_ratio_ttm"),
        (c("p_size") - 25).alias("earning_per_share"),
    )
    out = M.snapshot_metrics(raw)
    return out.select("id", "pe", c("dividendYieldTtmPct").alias("dividend_yield"), c("earningsPerShare").alias("eps"))


@query(
    "listing_codes",
    """SELECT p_partkey AS id, CASE WHEN p_size < 26 THEN (CASE WHEN lpad(CAST(p_partkey AS VARCHAR), 6, '0')[1] IN ('0','3') THEN 'SZ' ELSE 'SH' END) || lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE 'HK' || lpad(CAST(p_partkey AS VARCHAR), greatest(4, length(CAST(p_partkey AS VARCHAR)))::INTEGER, '0') END AS security_id,
  CASE WHEN p_size < 26 THEN 'CNY' ELSE 'HKD' END AS currency FROM part""",
)
def listing_codes(spark, sf):
    p = D.table(spark, sf, "part").select(c("p_partkey").alias("id"), "p_size", c("p_partkey").cast("string").alias("code"))
    a, h = M.a_share_fields(c("code")), M.h_share_fields(c("code"))
    mainland = c("p_size") < 26
    return p.select(
        "id",
        F.when(mainland, a["security_id"]).otherwise(h["security_id"]).alias("security_id"),
        F.when(mainland, a["currency"]).otherwise(h["currency"]).alias("currency"),
    )
