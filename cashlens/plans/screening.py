"""Queries of the current screening line: price opportunity, resilience, triggers, snapshot."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from cashlens.functions import policy as P
from cashlens.functions.numeric import half_up, ratio
from cashlens.operators import screening as S
from cashlens.plans.registry import query
from cashlens.plans.sqlparts import at_most, clip, d, knots, m, part, rnd, trend, with_parts
from cashlens.sources import domain as D

c = F.col
DATA_KEYWORDS = ("BUILDING", "HOUSEHOLD")
AS_OF_SQL = f"DATE '{D.AS_OF}'"


def priced_weeks(spark, sf):
    """Weekly closes of the last five years with the newest close as current price on every row.

    One shuffle: the window runs on the table already reduced to one row per security and week.
    """
    end = date.fromisoformat(D.AS_OF)
    start = end.replace(year=end.year - P.OPPORTUNITY["history_years"])
    # Raw bounds that keep every week of the window whole; they are pushed into the scan.
    prices = D.weekly_prices(spark, sf, since=start.isoformat(), before=(end + timedelta(days=7)).isoformat())
    return S.recent_weeks(prices, F.lit(D.AS_OF).cast("date"), P.OPPORTUNITY["history_years"])


def positions(spark, sf):
    """Price position by one window per security over at most five years of weeks."""
    w = Window.partitionBy("security_id")
    current = F.max_by("close", "week").over(w)
    weekly = priced_weeks(spark, sf).where(c("close") > 0).withColumn("current_price", current)
    counted = weekly.groupBy("security_id").agg(
        F.max("current_price").alias("current_price"),
        F.count(F.lit(1)).alias("points"),
        F.count(F.when(c("close") <= c("current_price"), 1)).alias("at_or_below"),
    )
    enough = c("points") >= P.OPPORTUNITY["minimum_weekly_points"]
    rank = c("at_or_below") / c("points")
    return counted.select(
        "security_id",
        "current_price",
        "points",
        F.when(enough, half_up(rank, 4)).alias("percentile_rank"),
        F.when(enough, S.score2(100.0 * (1 - rank))).alias("price_position_score"),
    )


part(
    "recent_week",
    f"SELECT * FROM weekly_price WHERE week >= {AS_OF_SQL} - INTERVAL 5 YEAR AND week <= {AS_OF_SQL} AND \"close\" > 0",
    "weekly_price",
)
part(
    "position",
    f"""SELECT security_id, max(cur) AS current_price, count(*) AS points,
  CASE WHEN count(*) >= 52 THEN {rnd('count(*) FILTER (WHERE "close" <= cur)::DOUBLE / count(*)', 4)} END AS percentile_rank,
  CASE WHEN count(*) >= 52 THEN {rnd('100.0::DOUBLE * (1 - count(*) FILTER (WHERE "close" <= cur)::DOUBLE / count(*))', 2)} END AS price_position_score
FROM (SELECT *, first_value("close") OVER (PARTITION BY security_id ORDER BY week DESC) AS cur FROM recent_week) GROUP BY 1""",
    "recent_week",
)
part(
    "fundamental",
    f"""SELECT l_suppkey AS security_id,
  {rnd(f"{d(f'''sum({m('l_extendedprice')} * {m('l_discount')})''')} / {d(f'''sum({m('l_extendedprice')})''')} * 100", 4)} AS dividend_yield_pct,
  {rnd(f"{d(f'''sum({m('l_extendedprice')})''')} / nullif({d(f'''sum({m('l_extendedprice')} * {m('l_tax')})''')}, 0) / 3", 4)} AS pe_ttm
FROM lineitem WHERE CAST(l_shipdate AS DATE) > {AS_OF_SQL} - INTERVAL 1 YEAR GROUP BY 1""",
)
part(
    "fundamentals",
    f"""SELECT s.security_id, s.sector, s.issuer_id, s.name, s.market, s.currency, f.dividend_yield_pct, f.pe_ttm,
  CASE WHEN s.acctbal > 0 THEN {rnd('s.acctbal / 2000', 4)} END AS pb,
  CASE WHEN s.sector = 'EUROPE' THEN 'FINANCIAL' ELSE 'NON_FINANCIAL' END AS profile
FROM security s LEFT JOIN fundamental f ON s.security_id = f.security_id""",
    "security",
    "fundamental",
)


def fundamentals(spark, sf):
    """Trailing yield, earnings multiple and book multiple per security."""
    end = date.fromisoformat(D.AS_OF)
    first = end.replace(year=end.year - 1) + timedelta(days=1)
    li = D.table(spark, sf, "lineitem").where(c("l_shipdate") >= D.day(first.isoformat()))
    price = D.money("l_extendedprice")
    g = li.groupBy(c("l_suppkey").alias("security_id")).agg(
        F.sum(price).alias("amount"),
        F.sum(price * D.money("l_discount")).alias("cash"),
        F.sum(price * D.money("l_tax")).alias("tax"),
    )
    per = g.select(
        "security_id",
        half_up(ratio(c("cash"), c("amount")) * 100, 4).alias("dividend_yield_pct"),
        half_up(ratio(c("amount"), c("tax")) / 3, 4).alias("pe_ttm"),
    )
    sec = D.securities(spark, sf)
    return sec.join(per, "security_id", "left").select(
        "security_id",
        "sector",
        "issuer_id",
        "name",
        "market",
        "currency",
        "dividend_yield_pct",
        "pe_ttm",
        F.when(c("acctbal") > 0, half_up(c("acctbal") / 2000, 4)).alias("pb"),
        S.profile_of(c("security_id"), c("sector"), c("issuer_id"), c("name"), keywords=("EUROPE",)).alias("profile"),
    )


VALUATION_SQL = f"""CASE WHEN profile = 'FINANCIAL' THEN {knots('pb', P.OPPORTUNITY['pb_financial'])}
  WHEN pe_ttm > 0 THEN {knots('(100.0::DOUBLE / pe_ttm)', P.OPPORTUNITY['earnings_yield_pct'])}
  ELSE {knots('pb', P.OPPORTUNITY['pb_fallback'])} END"""


def shrunk_sql(parts: dict[str, tuple[str, str]]) -> dict[str, str]:
    """value, coverage, status of (component, effective weight) pairs."""
    w = " + ".join(f"CASE WHEN {x} IS NULL THEN 0.0::DOUBLE ELSE {k} END" for x, k in parts.values())
    acc = " + ".join(f"CASE WHEN {x} IS NULL THEN 0.0::DOUBLE ELSE {x} * ({k}) END" for x, k in parts.values())
    wr = rnd(f"({w})", 10)
    raw = f"(CASE WHEN {wr} > 0 THEN ({acc}) / ({w}) END)"
    return {
        "value": rnd(clip(f"(50.0::DOUBLE + ({w}) * ({raw} - 50.0::DOUBLE))"), 2),
        "coverage": rnd(f"least(1.0::DOUBLE, {wr})", 4),
        "status": f"CASE WHEN {wr} <= 0 THEN 'UNAVAILABLE' WHEN {wr} >= 1 THEN 'READY' ELSE 'DATA_LIMITED' END",
        "raw_score": rnd(clip(raw), 2),
    }


OPP = shrunk_sql(
    {
        "y": ("dividend_yield_score", "0.40::DOUBLE"),
        "v": ("valuation_score", "0.35::DOUBLE"),
        "p": ("price_position_score", "0.25::DOUBLE"),
    }
)
part(
    "opportunity",
    f"""SELECT *, {OPP['value']} AS opportunity_value, {OPP['coverage']} AS opportunity_coverage, {OPP['status']} AS opportunity_status
FROM (SELECT f.*, p.current_price, p.points, p.percentile_rank, p.price_position_score,
        CASE WHEN dividend_yield_pct >= 0 THEN {knots('dividend_yield_pct', P.OPPORTUNITY['dividend_yield_pct'])} END AS dividend_yield_score,
        {VALUATION_SQL} AS valuation_score,
        CASE WHEN profile = 'FINANCIAL' THEN CASE WHEN pb > 0 THEN 'PB' END WHEN pe_ttm > 0 THEN 'EARNINGS_YIELD_FROM_PE_TTM' WHEN pb > 0 THEN 'PB' END AS valuation_metric
      FROM fundamentals f LEFT JOIN position p USING (security_id))""",
    "fundamentals",
    "position",
)


def opportunities(spark, sf):
    joined = fundamentals(spark, sf).join(positions(spark, sf), "security_id", "left")
    staged = joined.withColumns(
        {"pe": F.lit(None).cast("double"), "dividend_yield_score": S.dividend_yield_score(c("dividend_yield_pct"))}
    )
    return S.opportunity_score(S.valuation_score(staged))


@query(
    "price_position_score",
    with_parts(
        ["security", "position"],
        f"""SELECT security_id, name, sector, points, percentile_rank, price_position_score,
  {rnd('CASE WHEN price_position_score IS NULL THEN NULL ELSE 50.0::DOUBLE + 0.25::DOUBLE * (price_position_score - 50.0::DOUBLE) END', 2)} AS shrunk_score
FROM security JOIN position USING (security_id)""",
    ),
)
def price_position_score(spark, sf):
    pos = positions(spark, sf).join(D.securities(spark, sf).select("security_id", "name", "sector"), "security_id")
    shrunk = S.coverage_shrunk(pos, "shrunk", {"price_position_score": F.lit(0.25)})
    return shrunk.select(
        "security_id", "name", "sector", "points", "percentile_rank", "price_position_score", c("shrunk_value").alias("shrunk_score")
    ).orderBy(F.desc_nulls_last("shrunk_score"), "security_id")


@query(
    "weekly_series_quality",
    with_parts(
        "weekly_price",
        """SELECT security_id, count(*) AS points, count(*) FILTER (WHERE week <= before) AS not_increasing,
  count(*) FILTER (WHERE date_diff('day', before, week) > 7) AS gaps, CAST(max("close") AS DOUBLE) AS highest
FROM (SELECT *, lag(week) OVER (PARTITION BY security_id ORDER BY week) AS before FROM weekly_price) GROUP BY 1""",
    ),
)
def weekly_series_quality(spark, sf):
    before = F.lag("week").over(Window.partitionBy("security_id").orderBy("week"))
    return (
        D.weekly_prices(spark, sf)
        .withColumn("before", before)
        .groupBy("security_id")
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.count(F.when(c("week") <= c("before"), 1)).alias("not_increasing"),
            F.count(F.when(F.datediff("week", "before") > 7, 1)).alias("gaps"),
            F.max("close").cast("double").alias("highest"),
        )
    )


@query(
    "opportunity_score",
    with_parts(
        "opportunity",
        "SELECT security_id, dividend_yield_score, valuation_metric, valuation_score, price_position_score, opportunity_value, opportunity_coverage, opportunity_status FROM opportunity",
    ),
)
def opportunity_score(spark, sf):
    return opportunities(spark, sf).select(
        "security_id",
        "dividend_yield_score",
        "valuation_metric",
        "valuation_score",
        "price_position_score",
        "opportunity_value",
        "opportunity_coverage",
        "opportunity_status",
    )


def quality_sql(v: str) -> str:
    pos = f"(len(list_filter({v}, lambda x: x > 0))::DOUBLE / len({v}))"
    return (
        f"CASE WHEN len({v}) > 0 THEN "
        + rnd(clip(f"(0.70::DOUBLE * {pos} * 100.0::DOUBLE + 0.30::DOUBLE * {knots(trend(v), P.RESILIENCE['trend'])})"), 2)
        + " END"
    )


def factor_sql(n: str) -> str:
    return f"least(1.0::DOUBLE, ({n})::DOUBLE / 3.0::DOUBLE)"


def filled(x: str) -> str:
    return f"list({d(x)} ORDER BY fiscal_year) FILTER (WHERE {x} IS NOT NULL)"


part(
    "run_lists",
    f"""SELECT company_id, count(*) AS n_years, coalesce({filled('net_profit')}, []) AS np, coalesce({filled('operating_cash_flow')}, []) AS ocf,
  coalesce({filled('operating_cash_flow - capital_expenditure')}, []) AS fcf,
  coalesce(list({d('net_profit')} / (({d('total_equity')} + {d('prior_equity')}) / 2) * 100 ORDER BY fiscal_year)
    FILTER (WHERE net_profit IS NOT NULL AND total_equity > 0 AND prior_equity > 0), []) AS roe,
  coalesce(list({d('total_equity')} ORDER BY fiscal_year) FILTER (WHERE total_equity > 0), []) AS eq,
  max(cash) FILTER (WHERE rn = 1) AS cash, max(interest_bearing_debt) FILTER (WHERE rn = 1) AS debt,
  max(total_equity) FILTER (WHERE rn = 1) AS equity, max(total_liabilities) FILTER (WHERE rn = 1) AS liab, max(total_assets) FILTER (WHERE rn = 1) AS assets
FROM (SELECT *, lag(total_equity) OVER (PARTITION BY company_id ORDER BY fiscal_year) AS prior_equity FROM run_year) GROUP BY 1""",
    "run_year",
)
part(
    "resilience_parts",
    f"""SELECT company_id, n_years, CASE WHEN industry IN ('BUILDING','HOUSEHOLD') THEN 'FINANCIAL' ELSE 'NON_FINANCIAL' END AS profile,
  {quality_sql('np')} AS net_profit_quality, {factor_sql('len(np)')} AS npf,
  {quality_sql('ocf')} AS operating_cash_flow_quality, {factor_sql('len(ocf)')} AS ocff,
  {quality_sql('fcf')} AS simplified_fcf_quality, {factor_sql('len(fcf)')} AS fcff,
  CASE WHEN cash IS NOT NULL AND debt IS NOT NULL AND equity > 0 THEN
      CASE WHEN debt - cash <= 0 THEN 100.0 ELSE {at_most(f"({d('debt - cash')} / {d('equity')})", P.RESILIENCE['net_debt_to_equity'], 20)} END
    WHEN liab IS NOT NULL AND assets > 0 THEN {at_most(f"({d('liab')} / {d('assets')})", P.RESILIENCE['liabilities_to_assets'], 20)} END AS balance_sheet_resilience,
  CASE WHEN len(roe) > 0 THEN {rnd(f"(0.70::DOUBLE * {knots('roe[len(roe)]', P.RESILIENCE['roe_level_pct'])} + 0.30::DOUBLE * {knots(trend('roe'), P.RESILIENCE['trend'])})", 2)} END AS roe_quality,
  {factor_sql('len(roe)')} AS roef,
  CASE WHEN len(eq) >= 2 THEN {knots(trend('eq'), P.RESILIENCE['equity_growth'])} END AS equity_growth, {factor_sql('greatest(len(eq) - 1, 0)')} AS eqf
FROM run_lists LEFT JOIN industry USING (company_id)""",
    "run_lists",
    "industry",
)
NONFIN = shrunk_sql(
    {
        "a": ("net_profit_quality", "0.25::DOUBLE * npf"),
        "b": ("operating_cash_flow_quality", "0.25::DOUBLE * ocff"),
        "c": ("simplified_fcf_quality", "0.25::DOUBLE * fcff"),
        "d": ("balance_sheet_resilience", "0.25::DOUBLE"),
    }
)
FIN = shrunk_sql(
    {
        "a": ("net_profit_quality", "0.30::DOUBLE * npf"),
        "b": ("roe_quality", "0.30::DOUBLE * roef"),
        "c": ("equity_growth", "0.25::DOUBLE * eqf"),
    }
)
part(
    "resilience",
    "SELECT *, "
    + ", ".join(
        f"CASE WHEN profile = 'FINANCIAL' THEN {FIN[k]} ELSE {NONFIN[k]} END AS resilience_{k}"
        for k in ("value", "coverage", "status")
    )
    + " FROM resilience_parts",
    "resilience_parts",
)


def resilience(spark, sf):
    profiles = D.industries(spark, sf).select(
        "company_id",
        S.profile_of(c("company_id"), c("industry"), c("name"), keywords=DATA_KEYWORDS).alias("profile"),
    )
    return S.resilience_score(D.company_years(spark, sf), profiles)


@query(
    "resilience_score",
    with_parts(
        "resilience",
        """SELECT company_id, profile, CAST(n_years AS INTEGER) AS n_years, net_profit_quality, operating_cash_flow_quality, simplified_fcf_quality,
  balance_sheet_resilience, roe_quality, equity_growth, resilience_value, resilience_coverage, resilience_status FROM resilience""",
    ),
)
def resilience_score(spark, sf):
    return resilience(spark, sf).select(
        "company_id",
        "profile",
        "n_years",
        "net_profit_quality",
        "operating_cash_flow_quality",
        "simplified_fcf_quality",
        "balance_sheet_resilience",
        "roe_quality",
        "equity_growth",
        "resilience_value",
        "resilience_coverage",
        "resilience_status",
    )


# A security is matched with the company of the same number; its events are the error and signup types.
part(
    "event_codes",
    """SELECT user_id AS company_id, list_sort(list_distinct(list(CASE event_type WHEN 'error' THEN 'PROFIT_WARNING' WHEN 'signup' THEN 'ASSET_SALE' ELSE 'ROUTINE_NEWS' END))) AS events,
  max(ts) AS last_event FROM events GROUP BY 1""",
)
part(
    "screen_base",
    """SELECT o.*, r.resilience_value, r.resilience_status, coalesce(e.events, []) AS events, o.points >= 200 AS price_fresh
FROM opportunity o LEFT JOIN resilience r ON r.company_id = o.security_id LEFT JOIN event_codes e ON e.company_id = o.security_id""",
    "opportunity",
    "resilience",
    "event_codes",
)
part(
    "screen",
    """SELECT *, CASE WHEN len(codes) > 0 THEN codes[1] WHEN y THEN 'DIVIDEND_YIELD_TTM' WHEN high THEN 'OPPORTUNITY_SCORE_HIGH' WHEN comb THEN 'COMBINED_SCREEN' END AS trigger_type
FROM (SELECT *, list_sort(list_filter(events, lambda x: x IN ('PROFIT_WARNING','ASSET_SALE'))) AS codes,
        coalesce(dividend_yield_pct >= 4, false) AS y, coalesce(opportunity_value >= 75, false) AS high,
        coalesce(opportunity_value < 75 AND opportunity_value >= 65 AND resilience_value >= 60, false) AS comb FROM screen_base)""",
    "screen_base",
)


def event_codes(spark, sf):
    """Distinct event codes per company; the set of codes is fixed, so the set per company stays tiny."""
    e = D.table(spark, sf, "events")
    code = (
        F.when(c("event_type") == "error", "PROFIT_WARNING")
        .when(c("event_type") == "signup", "ASSET_SALE")
        .otherwise("ROUTINE_NEWS")
    )
    return e.groupBy(c("user_id").alias("company_id")).agg(F.array_sort(F.collect_set(code)).alias("events"))


def screened(spark, sf):
    opp = opportunities(spark, sf)
    res = resilience(spark, sf).select("company_id", "resilience_value", "resilience_status")
    joined = (
        opp.join(res, opp.security_id == res.company_id, "left")
        .drop("company_id")
        .join(event_codes(spark, sf).withColumnRenamed("company_id", "event_company"), c("security_id") == c("event_company"), "left")
        .withColumns(
            {
                "events": F.coalesce("events", F.array().cast("array<string>")),
                "price_fresh": c("points") >= 200,
                "identity_valid": c("issuer_id").isNotNull(),
                "price": c("current_price"),
            }
        )
    )
    return S.screening_status(S.research_trigger(joined))


@query(
    "research_trigger",
    with_parts(
        "screen",
        """SELECT security_id, trigger_type, trigger_type IS NOT NULL AS in_observation_zone, array_to_string(codes, ',') AS event_codes,
  concat_ws(',', CASE WHEN len(codes) > 0 THEN 'MATERIAL_EVENT' END, CASE WHEN y THEN 'DIVIDEND_YIELD_TTM' END,
    CASE WHEN high THEN 'OPPORTUNITY_SCORE_HIGH' END, CASE WHEN comb THEN 'COMBINED_SCREEN' END) AS reasons
FROM screen""",
    ),
)
def research_trigger(spark, sf):
    return screened(spark, sf).select(
        "security_id",
        "trigger_type",
        "in_observation_zone",
        F.array_join("event_codes", ",").alias("event_codes"),
        F.array_join("trigger_reasons", ",").alias("reasons"),
    )


@query(
    "screening_snapshot",
    with_parts(
        "screen",
        """SELECT security_id, status, opportunity_value, resilience_value,
  CASE WHEN status = 'STALE' THEN len(codes) > 0 ELSE trigger_type IS NOT NULL AND (price_fresh OR len(codes) > 0) END AS trigger_eligible, warnings
FROM (SELECT *, CASE WHEN current_price IS NULL OR current_price <= 0 THEN 'UNAVAILABLE' WHEN NOT coalesce(price_fresh, false) THEN 'STALE'
    WHEN opportunity_status = 'READY' AND resilience_status = 'READY' THEN 'READY' ELSE 'DATA_LIMITED' END AS status,
  concat_ws(',', CASE WHEN dividend_yield_score IS NULL THEN 'DIVIDEND_YIELD_TTM_MISSING' END,
    CASE WHEN profile <> 'FINANCIAL' AND valuation_metric = 'PB' THEN 'PB_FALLBACK' END,
    CASE WHEN price_position_score IS NULL THEN 'PRICE_HISTORY_INSUFFICIENT' END,
    CASE WHEN valuation_score IS NULL THEN 'VALUATION_ANCHOR_MISSING' END) AS warnings FROM screen)""",
    ),
)
def screening_snapshot(spark, sf):
    return screened(spark, sf).select(
        "security_id",
        "status",
        "opportunity_value",
        "resilience_value",
        "trigger_eligible",
        F.array_join(S.opportunity_warnings(), ",").alias("warnings"),
    )


@query(
    "screening_counts",
    with_parts(
        "screen",
        """SELECT coalesce(trigger_type, 'NONE') AS trigger_type, opportunity_status, count(*) AS n, {avg} AS mean_opportunity FROM screen GROUP BY 1, 2""".replace(
            "{avg}", rnd("CAST(sum(CAST(opportunity_value AS DECIMAL(18,2))) AS DOUBLE) / count(opportunity_value)", 4)
        ),
    ),
)
def screening_counts(spark, sf):
    total = F.sum(c("opportunity_value").cast("decimal(18,2)"))
    return (
        screened(spark, sf)
        .groupBy(F.coalesce("trigger_type", F.lit("NONE")).alias("trigger_type"), "opportunity_status")
        .agg(F.count(F.lit(1)).alias("n"), half_up(ratio(total, F.count("opportunity_value")), 4).alias("mean_opportunity"))
    )
