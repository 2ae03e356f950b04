"""Queries over the yearly distribution and cash-flow history."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashlens.functions import policy as P
from cashlens.functions import series as S
from cashlens.functions.numeric import half_up, linear_score, lit_null
from cashlens.operators import history as H
from cashlens.plans.registry import query
from cashlens.plans.sqlparts import (
    at_least,
    at_most,
    changes,
    clip,
    d,
    growth,
    knots,
    median,
    part,
    rnd,
    trend,
    with_parts,
)
from cashlens.sources import domain as D

c = F.col


def as_of():
    return F.lit(D.AS_OF).cast("date")


def distributions(spark, sf):
    return H.eligible_distributions(D.company_years(spark, sf), as_of())


def coverage(spark, sf):
    return H.eligible_coverage(D.company_years(spark, sf), as_of())


@query(
    "newest_distributions",
    with_parts(
        "eligible_year",
        f"SELECT company_id, fiscal_year, ordinary_dividend_status, {d('ordinary_dividend')} AS ordinary_dividend, rn FROM eligible_year",
    ),
)
def newest_distributions(spark, sf):
    return distributions(spark, sf).select(
        "company_id",
        "fiscal_year",
        "ordinary_dividend_status",
        c("ordinary_dividend").cast("double").alias("ordinary_dividend"),
        "rn",
    )


@query(
    "coverage_rows",
    with_parts(
        "coverage_year",
        f"""SELECT company_id, fiscal_year, {d('operating_cash_flow')} AS operating_cash_flow,
        {d('operating_cash_flow - capital_expenditure')} AS simplified_fcf FROM coverage_year""",
    ),
)
def coverage_rows(spark, sf):
    return coverage(spark, sf).select(
        "company_id",
        "fiscal_year",
        c("operating_cash_flow").cast("double").alias("operating_cash_flow"),
        (c("operating_cash_flow") - c("capital_expenditure")).cast("double").alias("simplified_fcf"),
    )


part(
    "dist_list",
    f"""SELECT company_id, list({d('ordinary_dividend')} ORDER BY rn) AS v FROM eligible_year GROUP BY 1""",
    "eligible_year",
)


def profile_sql(source: str) -> str:
    """r2, m5, t10 from a list v, newest first."""
    return f"""
SELECT company_id, v, len(v) AS n_years, v[1] AS latest, v[2] AS previous,
       CASE WHEN len(v) >= 2 THEN 0.65::DOUBLE * v[1] + 0.35::DOUBLE * v[2] END AS r2,
       {median('v[1:5]')} AS m5,
       CASE WHEN len(v) >= 8 THEN (list_sum(list_sort(v)) - list_sort(v)[1] + list_sort(v)[2] - list_sort(v)[len(v)] + list_sort(v)[len(v) - 1]) / len(v)
            ELSE list_sum(list_sort(v)) / len(v) END AS t10
FROM {source}"""


def h_sql(source: str) -> str:
    return f"""
SELECT *, CASE WHEN n_years < 2 THEN NULL
  WHEN n_years >= 8 THEN least(0.65::DOUBLE * r2 + 0.25::DOUBLE * m5 + 0.10::DOUBLE * t10, 1.10::DOUBLE * m5, 1.20::DOUBLE * t10)
  WHEN n_years >= 5 THEN least(0.70::DOUBLE * r2 + 0.30::DOUBLE * m5, 1.10::DOUBLE * m5)
  WHEN n_years >= 3 THEN least(r2, m5) ELSE least(latest, r2) END AS h
FROM {source}"""


part("dist_profile", profile_sql("dist_list"), "dist_list")
part("dist_h", h_sql("dist_profile"), "dist_profile")


@query(
    "history_h",
    with_parts(
        "dist_h",
        f"SELECT company_id, CAST(n_years AS INTEGER) AS n_years, {rnd('r2', 6)} AS r2, {rnd('m5', 6)} AS m5, {rnd('t10', 6)} AS t10, {rnd('h', 6)} AS h FROM dist_h",
    ),
)
def history_h(spark, sf):
    profile = H.history_profile(H.newest_values(distributions(spark, sf), "ordinary_dividend"))
    return profile.select("company_id", "n_years", *[half_up(c(x), 6).alias(x) for x in ("r2", "m5", "t10", "h")])


@query(
    "contiguous_years",
    with_parts(
        "run_year",
        "SELECT company_id, count(*) AS run_years, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year FROM run_year GROUP BY 1",
    ),
)
def contiguous_years(spark, sf):
    return (
        H.latest_run(D.company_years(spark, sf).select("company_id", "fiscal_year"), 5)
        .groupBy("company_id")
        .agg(
            F.count(F.lit(1)).alias("run_years"),
            F.min("fiscal_year").alias("first_year"),
            F.max("fiscal_year").alias("last_year"),
        )
    )


part(
    "profit_list",
    f"SELECT company_id, list({d('net_profit')} ORDER BY fiscal_year) FILTER (WHERE net_profit IS NOT NULL) AS v FROM run_year GROUP BY 1",
    "run_year",
)


@query(
    "growth_trend",
    with_parts(
        "profit_list",
        f"""SELECT company_id, CAST(len(v) AS INTEGER) AS n_values, {rnd(trend('v'), 6)} AS trend, {rnd('g', 6)} AS organic_growth,
  {rnd('CASE WHEN g IS NULL THEN NULL ELSE least(0.03::DOUBLE, 0.5::DOUBLE * greatest(g, 0.0)) + least(g, 0.0) END', 6)} AS contribution,
  {rnd('CASE WHEN g IS NULL THEN NULL WHEN g <= 0 THEN g WHEN len(v) >= 5 THEN least(0.03, g) WHEN len(v) >= 3 THEN least(0.02, g) ELSE least(0.0, g) END', 6)} AS contribution_by_years
FROM (SELECT company_id, v, {growth('v')} AS g FROM (SELECT company_id, coalesce(v, []) AS v FROM profit_list))""",
    ),
)
def growth_trend(spark, sf):
    run = H.latest_run(D.company_years(spark, sf).select("company_id", "fiscal_year", "net_profit"), 5)
    packed = run.groupBy("company_id").agg(
        F.array_sort(
            F.collect_list(
                F.when(c("net_profit").isNotNull(), F.struct("fiscal_year", c("net_profit").cast("double").alias("x")))
            )
        ).alias("p")
    )
    v = packed.select("company_id", F.transform("p", lambda s: s["x"]).alias("v"))
    g = v.withColumn("g", S.organic_growth(c("v"), -0.08, 0.06))
    return g.select(
        "company_id",
        F.size("v").alias("n_values"),
        half_up(S.trend(c("v")), 6).alias("trend"),
        half_up(c("g"), 6).alias("organic_growth"),
        half_up(H.growth_contribution(c("g")), 6).alias("contribution"),
        half_up(H.growth_contribution_by_years(c("g"), F.size("v")), 6).alias("contribution_by_years"),
    )


TREND_SQL = """CASE WHEN latest = 0 THEN 0.0 WHEN r2 IS NULL OR m5 IS NULL OR m5 <= 0 THEN NULL
  WHEN coalesce(previous > 0 AND latest / previous < 0.70, false) AND r2 / m5 >= 0.95 THEN 60.0
  WHEN r2 / m5 >= 1.10 THEN 100.0 WHEN r2 / m5 >= 0.95 THEN 85.0 WHEN r2 / m5 >= 0.80 THEN 60.0
  WHEN r2 / m5 >= 0.50 THEN 25.0 ELSE 0.0 END"""
CV_SQL = """CASE WHEN list_aggregate(v[1:5], 'max') = 0 AND list_aggregate(v[1:5], 'min') = 0 THEN 0.0
  ELSE list_aggregate(v[1:5], 'stddev_pop') / abs(list_aggregate(v[1:5], 'avg')) END"""
STABILITY_SQL = f"""CASE WHEN v[1] = 0 THEN 0.0
  WHEN len(list_filter(v[1:5], lambda x: x = 0)) = 0 AND ({CV_SQL}) <= 0.15 THEN 100.0
  WHEN len(list_filter(v[1:5], lambda x: x = 0)) = 0 AND ({CV_SQL}) <= 0.30 THEN 80.0
  WHEN len(list_filter(v[1:5], lambda x: x = 0)) <= 1 OR ({CV_SQL}) <= 0.50 THEN 55.0 ELSE 20.0 END"""


@query(
    "stability_and_trend",
    with_parts(
        "dist_h",
        f"""SELECT company_id, {rnd(CV_SQL, 6)} AS cv, {d(STABILITY_SQL)} AS stability, {d(TREND_SQL)} AS recent_trend,
  {at_most('n_years', [(2, 50), (4, 65), (7, 80), (100, 100)], 100)} AS history_cap
FROM dist_h""",
    ),
)
def stability_and_trend(spark, sf):
    p = H.history_profile(H.newest_values(distributions(spark, sf), "ordinary_dividend"))
    return p.select(
        "company_id",
        half_up(S.variation(F.slice("v", 1, 5)), 6).alias("cv"),
        H.stability_score(c("v")).alias("stability"),
        H.trend_score(c("r2"), c("m5"), c("latest"), c("previous")).alias("recent_trend"),
        H.history_cap(c("n_years")).alias("history_cap"),
    )


BUYBACK_SQL = f"""CASE WHEN gross_cancelled_buyback IS NULL OR cancelled_shares IS NULL OR diluted_net_share_reduction IS NULL THEN NULL
  WHEN gross_cancelled_buyback < 0 OR cancelled_shares < 0 THEN NULL WHEN cancelled_shares = 0 THEN 0.0
  ELSE {d('gross_cancelled_buyback')} * least(1.0::DOUBLE, greatest(0.0::DOUBLE, {d('diluted_net_share_reduction')}) / {d('cancelled_shares')}) END"""
part(
    "credited_year",
    f"SELECT *, {BUYBACK_SQL} AS buyback, {d('ordinary_dividend')} + coalesce({BUYBACK_SQL}, 0) AS effective FROM eligible_year",
    "eligible_year",
)
part(
    "persistence",
    f"""SELECT company_id, CASE WHEN count(*) FILTER (WHERE diluted_net_share_reduction IS NULL) > 0 THEN NULL
  ELSE {at_least('count(*) FILTER (WHERE diluted_net_share_reduction > 0)', P.BUYBACK_PERSISTENCE, 0.0)} END AS factor
FROM eligible_year WHERE rn <= 5 GROUP BY 1""",
    "eligible_year",
)


@query(
    "buyback_credit",
    with_parts(
        ["credited_year", "persistence"],
        f"""SELECT company_id, fiscal_year, {rnd('buyback', 6)} AS eligible_buyback, {rnd('effective', 6)} AS effective_verified,
  factor AS persistence_factor, {rnd(f"{d('ordinary_dividend')} + factor * buyback", 6)} AS effective_weighted
FROM credited_year JOIN persistence USING (company_id)""",
    ),
)
def buyback_credit(spark, sf):
    from pyspark.sql import Window

    rows = distributions(spark, sf).withColumn(
        "buyback",
        H.eligible_buyback(c("gross_cancelled_buyback"), c("cancelled_shares"), c("diluted_net_share_reduction")),
    )
    # Ten rows per company at most; the window shares the partitioning of the newest-years rank.
    nets = F.transform(
        F.array_sort(
            F.collect_list(F.struct("rn", c("diluted_net_share_reduction").alias("x"))).over(
                Window.partitionBy("company_id")
            )
        ),
        lambda s: s["x"],
    )
    staged = rows.withColumn("nets", nets).withColumn("factor", H.persistence_factor(c("nets")))
    return staged.select(
        "company_id",
        "fiscal_year",
        half_up(c("buyback"), 6).alias("eligible_buyback"),
        half_up(H.effective_distribution_verified(c("ordinary_dividend"), c("buyback")), 6).alias("effective_verified"),
        c("factor").alias("persistence_factor"),
        half_up(H.effective_distribution(c("ordinary_dividend"), c("factor"), c("buyback")), 6).alias(
            "effective_weighted"
        ),
    )


part("credited_list", "SELECT company_id, list(effective ORDER BY rn) AS v FROM credited_year GROUP BY 1", "credited_year")
part("credited_profile", profile_sql("credited_list"), "credited_list")
part("credited_h", h_sql("credited_profile"), "credited_profile")
part(
    "fcf_year",
    f"""SELECT company_id, fiscal_year, rn, simplified,
  {d('CASE WHEN simplified THEN operating_cash_flow - capital_expenditure ELSE operating_cash_flow - capital_expenditure - lease_principal_repayment END')} AS fcf
FROM (SELECT *, bool_or(lease_principal_repayment IS NULL) OVER (PARTITION BY company_id) AS simplified FROM coverage_year)""",
    "coverage_year",
)
part(
    "fcf_company",
    f"""SELECT company_id, bool_or(simplified) AS simplified_fcf, count(*) AS coverage_years,
  CASE WHEN count(*) >= 2 THEN median(fcf) END AS capacity,
  list(fcf ORDER BY fiscal_year) FILTER (WHERE fiscal_year = newest - rn + 1) AS g
FROM (SELECT *, max(fiscal_year) OVER (PARTITION BY company_id) AS newest FROM fcf_year) GROUP BY 1""",
    "fcf_year",
)
SUSTAIN_SQL = """CASE WHEN h >= 0 AND capacity IS NOT NULL THEN greatest(0.0::DOUBLE, least(h,
  (CASE WHEN simplified_fcf THEN 0.85::DOUBLE ELSE 0.90::DOUBLE END) * greatest(capacity, 0.0))) END"""


@query(
    "sustainable_distribution",
    with_parts(
        ["credited_h", "fcf_company"],
        f"""SELECT company_id, {rnd('h', 6)} AS h, {rnd('capacity', 6)} AS capacity, {rnd(SUSTAIN_SQL, 6)} AS sustainable,
  {rnd('CASE WHEN h > 0 THEN capacity / h END', 6)} AS coverage_ratio
FROM credited_h LEFT JOIN fcf_company USING (company_id)""",
    ),
)
def sustainable_distribution(spark, sf):
    return slow(spark, sf).select(
        "company_id",
        half_up(c("h"), 6).alias("h"),
        half_up(c("capacity"), 6).alias("capacity"),
        half_up(c("sustainable"), 6).alias("sustainable"),
        half_up(c("coverage_ratio"), 6).alias("coverage_ratio"),
    )


def latest_balance(spark, sf):
    """Balance-sheet kind and value of the newest year."""
    from cashlens.operators.ledger import balance_sheet_kind
    from cashlens.operators.scale import latest_by

    cols = ["company_id", "fiscal_year", "cash", "interest_bearing_debt", "total_equity", "total_assets", "total_liabilities"]
    newest = latest_by(D.company_years(spark, sf).select(*cols), ["company_id"], [c("fiscal_year")])
    return balance_sheet_kind(newest)


def slow(spark, sf):
    from cashlens.operators.ledger import balance_sheet_kind

    return H.slow_variables(balance_sheet_kind(D.company_years(spark, sf)), as_of())


part(
    "balance",
    f"""SELECT company_id, CASE WHEN direct AND net_debt < 0 THEN 'NET_CASH' WHEN direct THEN 'NET_DEBT_TO_EQUITY'
    WHEN proxy THEN 'DEBT_TO_ASSETS_PROXY' ELSE 'UNAVAILABLE' END AS balance_kind,
  CASE WHEN direct AND net_debt < 0 THEN {d('-net_debt')} WHEN direct THEN {d('net_debt')} / {d('nullif(total_equity, 0)')}
    WHEN proxy THEN {d('total_liabilities')} / {d('nullif(total_assets, 0)')} END AS balance_value
FROM (SELECT *, interest_bearing_debt - cash AS net_debt,
        coalesce(interest_bearing_debt - cash IS NOT NULL AND total_equity > 0, false) AS direct,
        coalesce(total_assets > 0 AND total_liabilities IS NOT NULL, false) AS proxy
      FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC) AS k FROM company_year) WHERE k = 1)""",
    "company_year",
)
BALANCE_SCORE_SQL = f"""CASE WHEN balance_value IS NULL THEN NULL WHEN balance_kind = 'NET_CASH' THEN 100.0
  WHEN balance_kind = 'NET_DEBT_TO_EQUITY' THEN {at_most('balance_value', [(0.30, 85), (0.60, 70), (1.00, 50)], 20)}
  WHEN balance_kind = 'DEBT_TO_ASSETS_PROXY' THEN {at_most('balance_value', [(0.40, 80), (0.60, 60), (0.75, 40)], 20)} END"""


@query(
    "balance_sheet_kind",
    with_parts(
        "balance",
        f"SELECT company_id, balance_kind, {rnd('balance_value', 6)} AS balance_value, {d(BALANCE_SCORE_SQL)} AS balance_score FROM balance",
    ),
)
def balance_sheet_kind_query(spark, sf):
    return latest_balance(spark, sf).select(
        "company_id",
        "balance_kind",
        half_up(c("balance_value"), 6).alias("balance_value"),
        H.balance_score(c("balance_kind"), c("balance_value")).alias("balance_score"),
    )


part(
    "slow",
    f"""SELECT *, least(100.0, greatest(0.0, (cov * 0.40::DOUBLE + tr * 0.25::DOUBLE + st * 0.20::DOUBLE + bs * 0.15::DOUBLE))) AS payout_raw
FROM (SELECT *, {knots('coverage_ratio', P.COVERAGE_KNOTS, None)} AS cov, {d(TREND_SQL)} AS tr,
        CASE WHEN n_years >= 2 THEN {d(STABILITY_SQL)} END AS st, {d(BALANCE_SCORE_SQL)} AS bs, {growth("coalesce(g, [])")} AS og
      FROM (SELECT *, CASE WHEN h > 0 THEN capacity / h END AS coverage_ratio, {SUSTAIN_SQL} AS sustainable
            FROM credited_h LEFT JOIN fcf_company USING (company_id) LEFT JOIN balance USING (company_id)))""",
    "credited_h",
    "fcf_company",
    "balance",
)


@query(
    "slow_variables",
    with_parts(
        "slow",
        f"""SELECT company_id, {rnd('h', 6)} AS h, {rnd('sustainable', 6)} AS sustainable, {rnd('cov', 6)} AS coverage_component,
  tr AS trend_component, st AS stability_component, bs AS balance_component,
  {rnd('CASE WHEN cov IS NULL OR tr IS NULL OR st IS NULL OR bs IS NULL THEN NULL ELSE payout_raw END', 6)} AS payout_quality,
  {rnd('coalesce(CASE WHEN og IS NULL THEN NULL WHEN og <= 0 THEN og WHEN len(g) >= 5 THEN least(0.03, og) WHEN len(g) >= 3 THEN least(0.02, og) ELSE least(0.0, og) END, 0)', 6)} AS conservative_growth
FROM slow""",
    ),
)
def slow_variables(spark, sf):
    return slow(spark, sf).select(
        "company_id",
        half_up(c("h"), 6).alias("h"),
        half_up(c("sustainable"), 6).alias("sustainable"),
        half_up(c("coverage_component"), 6).alias("coverage_component"),
        "trend_component",
        "stability_component",
        "balance_component",
        half_up(c("payout_quality"), 6).alias("payout_quality"),
        half_up(c("conservative_growth"), 6).alias("conservative_growth"),
    )


@query(
    "veto_flags",
    with_parts(
        "eligible_year",
        """
SELECT company_id, coalesce(d1 = 0 OR (d2 > 0 AND (CAST(d2 - d1 AS DOUBLE)) / CAST(d2 AS DOUBLE) > 0.30), false) AS dividend_cut,
  coalesce(o1 AND o2 AND debt1 > debt2, false) AS over_fcf_and_debt,
  coalesce(b1 > 0 AND net1 <= 0, false) AS buyback_without_reduction,
  coalesce(t1 > 0 AND CAST(one1 AS DOUBLE) / CAST(nullif(t1, 0) AS DOUBLE) > 0.30, false) AS one_off_over_30pct
FROM (SELECT company_id,
    max(ordinary_dividend) FILTER (WHERE rn = 1) AS d1, max(ordinary_dividend) FILTER (WHERE rn = 2) AS d2,
    max(gross_cancelled_buyback) FILTER (WHERE rn = 1) AS b1, max(diluted_net_share_reduction) FILTER (WHERE rn = 1) AS net1,
    max(total) FILTER (WHERE rn = 1) AS t1, max(one_off) FILTER (WHERE rn = 1) AS one1,
    bool_or(CAST(total AS DOUBLE) > 1.25 * CAST(fcf AS DOUBLE)) FILTER (WHERE rn = 1) AS o1,
    bool_or(CAST(total AS DOUBLE) > 1.25 * CAST(fcf AS DOUBLE)) FILTER (WHERE rn = 2) AS o2,
    max(interest_bearing_debt - cash) FILTER (WHERE rn = 1) AS debt1, max(interest_bearing_debt - cash) FILTER (WHERE rn = 2) AS debt2
  FROM (SELECT *, ordinary_dividend + special_dividend + gross_cancelled_buyback + asset_sale_distribution AS total,
               special_dividend + asset_sale_distribution + one_off_buyback AS one_off,
               operating_cash_flow - capital_expenditure - lease_principal_repayment AS fcf FROM eligible_year)
  GROUP BY company_id)""",
    ),
)
def veto_flags(spark, sf):
    flagged = H.veto_flags(H.veto_inputs(distributions(spark, sf)))
    has = lambda code: F.array_contains("veto_codes", code)
    return flagged.select(
        "company_id",
        has("ORDINARY_DIVIDEND_DROPPED_OR_SUSPENDED").alias("dividend_cut"),
        has("DISTRIBUTION_OVER_FCF_AND_DEBT_RISING").alias("over_fcf_and_debt"),
        has("BUYBACK_WITHOUT_DILUTED_REDUCTION").alias("buyback_without_reduction"),
        has("ONE_OFF_DISTRIBUTION_OVER_30PCT").alias("one_off_over_30pct"),
    )
