"""Screening line: price position, shrinkage, resilience, triggers, watch list rules."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cashlens.operators import screening as S
from cashlens.operators import watchlist as W


def weeks(spark, n, sid=1):
    start = dt.date(2020, 1, 6)
    return spark.createDataFrame([(sid, start + dt.timedelta(weeks=i), float(i + 1)) for i in range(n)], "security_id int, week date, close double")


def test_price_position(spark):
    prices = weeks(spark, 100).unionByName(weeks(spark, 51, 2))
    current = spark.createDataFrame([(1, 25.0), (2, 25.0)], "security_id int, current_price double")
    got = {r.security_id: r for r in S.price_position(prices, current).collect()}
    assert (got[1].percentile_rank, got[1].price_position_score) == (0.25, 75.0)
    assert got[2].price_position_score is None and got[2].points == 51


def test_recent_weeks_is_inclusive_and_handles_leap_days(spark):
    df = spark.createDataFrame([(1, dt.date(2019, 2, 28)), (1, dt.date(2019, 2, 27)), (1, dt.date(2024, 2, 29))], "security_id int, week date")
    kept = S.recent_weeks(df, F.lit("2024-02-29").cast("date"), 5).collect()
    assert sorted(r.week.isoformat() for r in kept) == ["2019-02-28", "2024-02-29"]


def test_shrinkage(spark):
    df = spark.createDataFrame([(100.0, None, None), (None, None, None), (60.0, 70.0, 80.0)], "a double, b double, c double")
    out = S.coverage_shrunk(df, "x", {"a": F.lit(0.40), "b": F.lit(0.35), "c": F.lit(0.25)}).collect()
    assert (out[0].x_coverage, out[0].x_value, out[0].x_status) == (0.4, 70.0, "DATA_LIMITED")
    assert (out[1].x_coverage, out[1].x_value, out[1].x_status) == (0.0, None, "UNAVAILABLE")
    assert (out[2].x_value, out[2].x_status) == (68.5, "READY")


def test_valuation_rules(spark):
    df = spark.createDataFrame(
        [(10.0, 5.0, 1.0, "NON_FINANCIAL"), (None, 25.0, 1.0, "NON_FINANCIAL"), (None, None, 1.0, "NON_FINANCIAL"), (10.0, None, 1.0, "FINANCIAL"), (10.0, None, None, "FINANCIAL"), (-4.0, None, -1.0, "NON_FINANCIAL")],
        "pe_ttm double, pe double, pb double, profile string",
    )
    got = [(r.valuation_metric, r.valuation_score) for r in S.valuation_score(df).collect()]
    assert got == [("EARNINGS_YIELD_FROM_PE_TTM", 100.0), ("EARNINGS_YIELD_FROM_PE", 50.0), ("PB", 80.0), ("PB", 70.0), (None, None), (None, None)]


def test_resilience_needs_contiguous_years(spark):
    rows = [(1, y, 10.0, 20.0, 5.0, 50.0, 10.0, 100.0, 200.0, 100.0) for y in (2024, 2023, 2021)]
    df = spark.createDataFrame(rows, "company_id int, fiscal_year int, net_profit double, operating_cash_flow double, capital_expenditure double, cash double, interest_bearing_debt double, total_equity double, total_assets double, total_liabilities double")
    prof = spark.createDataFrame([(1, "NON_FINANCIAL")], "company_id int, profile string")
    r = S.resilience_score(df, prof).first()
    assert r.n_years == 2 and r.balance_sheet_resilience == 100.0
    assert r.net_profit_quality == 85.0
    assert r.resilience_coverage == pytest.approx(0.75) and r.resilience_status == "DATA_LIMITED"


def trigger(spark, opp, res, dy, fresh, events):
    df = spark.createDataFrame([(opp, res, dy, fresh, events)], "opportunity_value double, resilience_value double, dividend_yield_pct double, price_fresh boolean, events array<string>")
    r = S.research_trigger(df).first()
    return r.trigger_type, r.trigger_eligible, list(r.trigger_reasons)


def test_trigger_ladder(spark):
    assert trigger(spark, 80.0, 70.0, 1.0, True, [])[:2] == ("OPPORTUNITY_SCORE_HIGH", True)
    assert trigger(spark, 70.0, 60.0, 1.0, True, [])[:2] == ("COMBINED_SCREEN", True)
    assert trigger(spark, 80.0, 70.0, 4.0, True, []) == ("DIVIDEND_YIELD_TTM", True, ["DIVIDEND_YIELD_TTM", "OPPORTUNITY_SCORE_HIGH"])
    assert trigger(spark, 80.0, 70.0, 1.0, False, [])[1] is False
    assert trigger(spark, 10.0, 10.0, 0.0, False, ["PROFIT_WARNING", "ASSET_SALE", "x"])[:2] == ("ASSET_SALE", True)
    assert trigger(spark, None, None, None, True, [])[0] is None


def test_average_rank_percentile(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 3.0)], "s string, v double").withColumn("p", F.lit(1))
    got = {r.s: r.y for r in df.withColumn("y", S.average_rank_percentile("v", "p")).collect()}
    assert got == {"a": 0.0, "b": 50.0, "c": 50.0, "d": 100.0}


def test_target_state_and_yield(spark):
    df = spark.createDataFrame(
        [(1, 4.0, "CNY", 100.0), (2, 4.0, "CNY", 110.0), (3, 4.0, "USD", 90.0), (4, None, "CNY", 90.0), (5, 4.0, "HKD", 100.0)],
        "security_id int, basis double, currency string, current_price double",
    ).withColumn("hkd_cny", F.lit(0.8))
    got = {r.security_id: r for r in W.target_state(W.yield_model(df)).collect()}
    assert (got[1].target_status, got[1].alert_status, got[1].shareholder_yield_pct) == ("reached", "buy_zone", 4.0)
    assert (got[2].target_status, got[2].target_attractiveness) == ("within_10", 50.0)
    assert got[3].target_status == "unconfigured" and got[3].target_preferred_cny == 100.0
    assert got[4].target_status == "unconfigured" and got[4].valuation_status == "unconfigured"
    assert got[5].target_preferred == 125.0 and got[5].shareholder_yield_pct == 5.0


def test_technical_needs_sixty_days(spark):
    df = spark.createDataFrame([(30.0, -25.0, -10.0, 60), (30.0, -25.0, -10.0, 59)], "rsi14 double, drawdown60d_pct double, relative_sector5d_pct double, history_days int")
    got = W.technical_score(df).collect()
    assert (got[0].technical, got[0].technical_oversold) == (100.0, True)
    assert (got[1].technical, got[1].technical_oversold) == (None, None)


def test_sector_needs_three_issuers_and_coverage(spark):
    sec = spark.createDataFrame(
        [("s", f"i{k}", float(k)) for k in range(3)] + [("s", "i0", 4.0)] + [("t", "j", 1.0)], "sector string, issuer_id string, daily_change_pct double"
    )
    sig = spark.createDataFrame([("s", 1.0, 1.0, 1.0, 50.0, 50.0, 3, 3, None), ("t", 1.0, 1.0, 1.0, 50.0, 50.0, 1, 1, None)], "sector string, return1dPct double, return5dPct double, return20dPct double, advancers5dPct double, aboveMa20Pct double, issuerCount int, coveredIssuerCount int, coveragePct double")
    got = {r.sector: r for r in W.sector_heat(W.sector_base(sec, sig)).collect()}
    assert got["s"].heat_status == "computed" and got["s"].heat_score == 50.0 and got["s"].rank == 1
    assert got["s"].average_daily_change_pct == round((2.0 + 1.0 + 2.0) / 3, 2)
    assert got["t"].heat_status == "insufficient_issuers" and got["t"].rank is None


def test_list_sort_keeps_missing_last(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", None), ("c", 1.0)], "name string, v double")
    assert [r.name for r in W.sort_list(df, "v").collect()] == ["b", "c", "a"]
    assert [r.name for r in W.sort_list(df, "v", True).collect()] == ["b", "c", "a"]


def test_select_one_counts_hits(spark):
    df = spark.createDataFrame([("x", "1"), ("y", "x"), ("z", "2")], "a string, b string")
    r = W.select_one(df, "x", ("a", "b")).first()
    assert (r.hits, r.match) == (2, None)
    assert W.select_one(df, "2", ("a", "b")).first().match.a == "z"


def test_normalize_securities_and_points(spark):
    from cashlens.sources.readers import SECURITY

    row = [(" s1 ", None, " ", None, None, " cn", None, None, None, (-5.0, 1.0, "OPEN", None, "Available"), None, None, None, None, (30.0, -5.0, None, 70, None), [("", None, 3.0), ("x", None, -1.0), (None, "t", 4.0)], None, None)]
    df = spark.createDataFrame(row, SECURITY.replace("\n", " "))
    r = W.normalize_securities(df).first()
    assert (r.id, r.issuer_id, r.name, r.market, r.sector, r.current_price, r.market_state) == ("s1", "s1", "s1", "CN", "未分类", None, "open")
    assert r.technical is None
    points = df.select(W.normalize_history(F.col("history")).alias("h")).first().h
    assert [(p.label, p.price) for p in points] == [("T-2", 3.0), ("T-0", 4.0)]


def test_yield_basis_takes_best_source(spark):
    df = spark.createDataFrame([(1, 2, 2020, 9.0), (1, 1, 2020, 1.0), (1, 1, 2021, 2.0), (2, 3, 2019, 5.0)], "security_id int, source_priority int, year int, per_share double")
    got = {r.security_id: (r.basis, r.window_years, r.start_year) for r in W.yield_basis(df).collect()}
    assert got == {1: (1.5, 2, 2020), 2: (5.0, 1, 2019)}
