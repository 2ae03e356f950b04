"""Price-opportunity and financial-resilience scores, research triggers and the screening snapshot."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashlens.functions import policy as P
from cashlens.functions import series as S
from cashlens.functions.numeric import half_up, linear_score, lit_null, ratio, score2, step_at_most
from cashlens.operators.history import latest_run


def coverage_shrunk(df: DataFrame, prefix: str, effective: Mapping[str, Column]) -> DataFrame:
    """Weighted mean over the present components, pulled to 50 by the weight that is missing.

    ``effective`` maps each component column to its weight after evidence factors.  Adds
    ``<prefix>_value``, ``_coverage``, ``_status`` and ``_raw_score``.  The steps are separate
    projections so that no expression is repeated inside another.
    """
    weight = sum((F.when(F.col(k).isNotNull(), w).otherwise(F.lit(0.0)) for k, w in effective.items()), F.lit(0.0))
    acc = sum(
        (F.when(F.col(k).isNotNull(), F.col(k) * w).otherwise(F.lit(0.0)) for k, w in effective.items()), F.lit(0.0)
    )
    w10, raw, pulled = F.col("_w10"), F.col("_raw"), F.col("_pulled")
    return (
        df.withColumns({"_weight": weight, "_acc": acc})
        .withColumn("_w10", half_up(F.col("_weight"), 10))
        .withColumn("_raw", F.when(w10 > 0, F.col("_acc") / F.col("_weight")))
        .withColumn("_pulled", F.lit(50.0) + F.col("_weight") * (raw - 50.0))
        .withColumns(
            {
                f"{prefix}_value": score2(pulled),
                f"{prefix}_coverage": half_up(F.least(F.lit(1.0), w10), 4),
                f"{prefix}_status": F.when(w10 <= 0, "UNAVAILABLE").when(w10 >= 1, "READY").otherwise("DATA_LIMITED"),
                f"{prefix}_raw_score": score2(raw),
            }
        )
        .drop("_weight", "_acc", "_w10", "_raw", "_pulled")
    )


def recent_weeks(prices: DataFrame, as_of: Column, years: int) -> DataFrame:
    """Weekly points inside the last ``years`` years, both ends included."""
    return prices.where((F.col("week") >= F.add_months(as_of, -12 * years)) & (F.col("week") <= as_of))


def price_position(prices: DataFrame, current: DataFrame) -> DataFrame:
    """Share of weekly closes at or below the current price, turned into a score.

    ``prices`` (security_id, week, close) is already windowed; ``current`` has one price per
    security.  The comparison is a conditional count, so no price list is gathered.
    """
    valid = prices.where(F.col("close") > 0).join(current, "security_id")
    counted = valid.groupBy("security_id").agg(
        F.first("current_price").alias("current_price"),
        F.count(F.lit(1)).alias("points"),
        F.count(F.when(F.col("close") <= F.col("current_price"), 1)).alias("at_or_below"),
    )
    enough = (F.col("points") >= P.OPPORTUNITY["minimum_weekly_points"]) & (F.col("current_price") > 0)
    rank = F.col("at_or_below") / F.col("points")
    return counted.select(
        "security_id",
        "points",
        F.when(enough, half_up(rank, 4)).alias("percentile_rank"),
        F.when(enough, score2(100.0 * (1 - rank))).alias("price_position_score"),
    )


def dividend_yield_score(pct: Column) -> Column:
    return F.when(pct >= 0, linear_score(pct, P.OPPORTUNITY["dividend_yield_pct"]))


def valuation_score(df: DataFrame) -> DataFrame:
    """Adds valuation_metric and valuation_score: PB for financials, else earnings yield, else PB as fallback.

    Expects pe_ttm, pe, pb and profile.
    """
    pos = lambda x: F.when(F.col(x) > 0, F.col(x).cast("double"))
    t, p, b = F.col("_pe_ttm"), F.col("_pe"), F.col("_pb")
    financial = F.col("profile") == "FINANCIAL"
    metric = (
        F.when(financial & b.isNotNull(), "PB")
        .when(~financial & t.isNotNull(), "EARNINGS_YIELD_FROM_PE_TTM")
        .when(~financial & p.isNotNull(), "EARNINGS_YIELD_FROM_PE")
        .when(~financial & b.isNotNull(), "PB")
    )
    score = F.when(financial, linear_score("_pb", P.OPPORTUNITY["pb_financial"])).otherwise(
        F.coalesce(
            linear_score("_ey", P.OPPORTUNITY["earnings_yield_pct"]),
            linear_score("_pb", P.OPPORTUNITY["pb_fallback"]),
        )
    )
    return (
        df.withColumns({"_pe_ttm": pos("pe_ttm"), "_pe": pos("pe"), "_pb": pos("pb")})
        .withColumn("_ey", 100.0 / F.coalesce(t, p))
        .withColumns({"valuation_metric": metric, "valuation_score": score})
        .drop("_pe_ttm", "_pe", "_pb", "_ey")
    )


def opportunity_score(df: DataFrame) -> DataFrame:
    """Adds the opportunity score from dividend_yield_score, valuation_score and price_position_score."""
    w = P.OPPORTUNITY["weights"]
    return coverage_shrunk(
        df,
        "opportunity",
        {
            "dividend_yield_score": F.lit(w["dividend_yield"]),
            "valuation_score": F.lit(w["valuation"]),
            "price_position_score": F.lit(w["five_year_price_position"]),
        },
    )


def opportunity_warnings() -> Column:
    """Sorted distinct component warnings of an opportunity row."""
    raw = F.array(
        F.when(F.col("dividend_yield_score").isNull(), F.lit("DIVIDEND_YIELD_TTM_MISSING")),
        F.when(F.col("valuation_score").isNull(), F.lit("VALUATION_ANCHOR_MISSING")),
        F.when((F.col("profile") != "FINANCIAL") & (F.col("valuation_metric") == "PB"), F.lit("PB_FALLBACK")),
        F.when(F.col("price_position_score").isNull(), F.lit("PRICE_HISTORY_INSUFFICIENT")),
    )
    return F.array_sort(F.array_distinct(F.array_compact(raw)))


def profile_of(company_id: Column, *texts: Column, ids: tuple[str, ...] = (), keywords=P.FINANCIAL_KEYWORDS) -> Column:
    """FINANCIAL when the id is listed or a keyword occurs in the joined texts."""
    joined = F.concat_ws(" ", *texts)
    hit = company_id.cast("string").isin(*ids) if ids else F.lit(False)
    for k in keywords:
        hit = hit | joined.contains(k)
    return F.when(hit, "FINANCIAL").otherwise("NON_FINANCIAL")


def series_quality(df: DataFrame, series: Mapping[str, str]) -> DataFrame:
    """Score and evidence factor of yearly series (arrays, oldest first, without nulls).

    ``series`` maps an array column to the name of its score; the factor is ``<score>_factor``.
    """
    r = P.RESILIENCE
    full = float(r["full_evidence_years"])
    trends = with_trends(df, list(series))
    scores = {out: F.when(F.size(a) > 0, linear_score(f"{a}_trend", r["trend"])) for a, out in series.items()}
    staged = trends.withColumns({f"{a}_trend_score": scores[out] for a, out in series.items()}).withColumns(
        {f"{a}_positive": S.positive_ratio(F.col(a)) for a in series}
    )
    mixed = staged.withColumns(
        {f"{a}_mix": 0.70 * F.col(f"{a}_positive") * 100.0 + 0.30 * F.col(f"{a}_trend_score") for a in series}
    )
    return mixed.withColumns({out: score2(F.col(f"{a}_mix")) for a, out in series.items()}).withColumns(
        {f"{out}_factor": F.least(F.lit(1.0), F.size(a) / full) for a, out in series.items()}
    )


def with_trends(df: DataFrame, arrays: list[str]) -> DataFrame:
    """Adds ``<array>_trend`` for each array, in projections that do not repeat one another."""
    staged = df.withColumns({f"{a}_changes": F.array_sort(S.relative_changes(F.col(a))) for a in arrays})
    raw = staged.withColumns({f"{a}_trend_raw": S.trend_raw(F.col(a), F.col(f"{a}_changes")) for a in arrays})
    return raw.withColumns({f"{a}_trend": S.trend_clip(F.col(f"{a}_trend_raw")) for a in arrays})


def balance_sheet_resilience(cash: Column, debt: Column, equity: Column, liabilities: Column, assets: Column) -> tuple[Column, Column]:
    """(score, basis) of the newest year."""
    r = P.RESILIENCE
    net = (debt - cash).cast("double")
    direct = cash.isNotNull() & debt.isNotNull() & (equity > 0)
    proxy = liabilities.isNotNull() & (assets > 0)
    score = (
        F.when(direct & (net <= 0), F.lit(100.0))
        .when(direct, step_at_most(ratio(net, equity), r["net_debt_to_equity"], r["net_debt_above"]))
        .when(proxy, step_at_most(ratio(liabilities, assets), r["liabilities_to_assets"], r["liabilities_above"]))
    )
    basis = (
        F.when(direct & (net <= 0), "NET_CASH")
        .when(direct, "NET_DEBT_TO_EQUITY")
        .when(proxy, "LIABILITIES_TO_ASSETS_PROXY")
        .otherwise("UNAVAILABLE")
    )
    return score, basis


FINANCIAL_FIELDS = (
    "net_profit",
    "operating_cash_flow",
    "capital_expenditure",
    "cash",
    "interest_bearing_debt",
    "total_equity",
    "total_assets",
    "total_liabilities",
    "capital_quality_score",
)


def resilience_score(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Financial resilience per company from the latest unbroken run of at most five years.

    ``rows`` holds one row per company and fiscal year; ``profiles`` has company_id and profile.
    The years of a company travel as one short array, so the whole score needs a single shuffle
    of the yearly table.
    """
    r = P.RESILIENCE
    c = F.col
    run = latest_run(rows, r["maximum_fiscal_years"])
    have = [f for f in FINANCIAL_FIELDS if f in rows.columns]
    row = F.struct("fiscal_year", *[c(f).cast("double").alias(f) for f in have])
    packed = run.groupBy("company_id").agg(F.array_sort(F.collect_list(row)).alias("y"))
    packed = packed.join(profiles.select("company_id", "profile"), "company_id", "left").withColumn(
        "profile", F.coalesce("profile", F.lit("NON_FINANCIAL"))
    )

    def column(name: str) -> Column:
        if name not in have:
            return F.array().cast("array<double>")
        return F.filter(F.transform(c("y"), lambda s: s[name]), lambda x: x.isNotNull())

    fcf = F.filter(
        F.transform(c("y"), lambda s: s["operating_cash_flow"] - s["capital_expenditure"]), lambda x: x.isNotNull()
    )
    n = F.size("y")
    before, after = F.slice(c("y"), F.lit(1), n - 1), F.slice(c("y"), F.lit(2), n - 1)
    roe = F.filter(
        F.zip_with(
            before,
            after,
            lambda a, b: F.when(
                (a["total_equity"] > 0) & (b["total_equity"] > 0),
                b["net_profit"] / ((a["total_equity"] + b["total_equity"]) / 2) * 100,
            ),
        ),
        lambda x: x.isNotNull(),
    )
    staged = packed.select(
        "company_id",
        "profile",
        n.alias("n_years"),
        F.get(c("y"), F.lit(0))["fiscal_year"].alias("first_year"),
        F.get(c("y"), n - 1).alias("newest"),
        column("net_profit").alias("np"),
        column("operating_cash_flow").alias("ocf"),
        fcf.alias("fcf"),
        roe.alias("roe"),
        F.filter(column("total_equity"), lambda x: x > 0).alias("eq"),
        column("capital_quality_score").alias("cq"),
    )
    full = float(r["full_evidence_years"])
    quality = series_quality(
        staged,
        {"np": "net_profit_quality", "ocf": "operating_cash_flow_quality", "fcf": "simplified_fcf_quality"},
    )
    bal_score, bal_basis = balance_sheet_resilience(
        *[c(f"newest.{f}") for f in ("cash", "interest_bearing_debt", "total_equity", "total_liabilities", "total_assets")]
    )
    factor = lambda k: F.least(F.lit(1.0), k / full)
    trends = with_trends(quality, ["roe", "eq"]).withColumns(
        {
            "balance_sheet_resilience": bal_score,
            "balance_basis": bal_basis,
            "newest_roe": F.get(c("roe"), F.size("roe") - 1),
            "newest_cq": F.get(c("cq"), F.size("cq") - 1),
        }
    )
    levels = trends.withColumns(
        {
            "roe_level": linear_score("newest_roe", r["roe_level_pct"]),
            "roe_trend_score": F.when(F.size("roe") > 0, linear_score("roe_trend", r["trend"])),
            "equity_growth": F.when(F.size("eq") >= 2, linear_score("eq_trend", r["equity_growth"])),
            "capital_or_asset_quality": score2(c("newest_cq")),
            "roe_quality_factor": factor(F.size("roe")),
            "equity_growth_factor": factor(F.greatest(F.size("eq") - 1, F.lit(0))),
        }
    ).withColumn("roe_mix", 0.70 * c("roe_level") + 0.30 * c("roe_trend_score"))
    scored = levels.withColumn("roe_quality", score2(c("roe_mix")))
    financial = c("profile") == "FINANCIAL"
    weights = r["weights"]
    effective = {}
    for name in sorted({k for w in weights.values() for k in w}):
        share = F.when(financial, F.lit(weights["FINANCIAL"].get(name, 0.0))).otherwise(
            F.lit(weights["NON_FINANCIAL"].get(name, 0.0))
        )
        effective[name] = share * c(f"{name}_factor") if f"{name}_factor" in scored.columns else share
    return coverage_shrunk(scored, "resilience", effective)


def research_trigger(df: DataFrame, events: str = "events") -> DataFrame:
    """Deterministic research trigger: material event, yield, high opportunity, else the combined rule.

    Expects opportunity_value, resilience_value, dividend_yield_pct, price_fresh and an array column
    of event codes.
    """
    t = P.TRIGGERS
    c = F.col
    urgent = F.array_sort(F.array_intersect(c(events), F.array(*[F.lit(x) for x in P.MATERIAL_EVENT_CODES])))
    base = df.withColumn("event_codes", F.coalesce(urgent, F.array().cast("array<string>")))
    yes = lambda e: F.coalesce(e, F.lit(False))
    has_event = F.size("event_codes") > 0
    by_yield = yes(c("dividend_yield_pct") >= t["dividend_yield_pct_min"])
    high = yes(c("opportunity_value") >= t["opportunity_high_min"])
    combined = ~high & yes(
        (c("opportunity_value") >= t["opportunity_combined_min"]) & (c("resilience_value") >= t["resilience_combined_min"])
    )
    kind = (
        F.when(has_event, F.get(c("event_codes"), F.lit(0)))
        .when(by_yield, "DIVIDEND_YIELD_TTM")
        .when(high, "OPPORTUNITY_SCORE_HIGH")
        .when(combined, "COMBINED_SCREEN")
    )
    reasons = F.array_compact(
        F.array(
            F.when(has_event, F.lit("MATERIAL_EVENT")),
            F.when(by_yield, F.lit("DIVIDEND_YIELD_TTM")),
            F.when(high, F.lit("OPPORTUNITY_SCORE_HIGH")),
            F.when(combined, F.lit("COMBINED_SCREEN")),
        )
    )
    return base.withColumns(
        {
            "trigger_type": kind,
            "trigger_reasons": reasons,
            "in_observation_zone": kind.isNotNull(),
            "trigger_eligible": kind.isNotNull() & (yes(c("price_fresh")) | has_event),
        }
    )


def screening_status(df: DataFrame) -> DataFrame:
    """Status of a screening snapshot and its fatal errors."""
    c = F.col
    fatal = F.array_compact(
        F.array(
            F.when(~F.coalesce(c("identity_valid"), F.lit(False)), F.lit("COMPANY_OR_SECURITY_IDENTITY_CONFLICT")),
            F.when(c("price").isNull() | (c("price") <= 0), F.lit("LEGAL_PRICE_MISSING")),
        )
    )
    fresh = F.coalesce(c("price_fresh"), F.lit(False))
    status = (
        F.when(F.size("fatal_errors") > 0, "UNAVAILABLE")
        .when(~fresh, "STALE")
        .when((c("opportunity_status") == "READY") & (c("resilience_status") == "READY"), "READY")
        .otherwise("DATA_LIMITED")
    )
    out = df.withColumn("fatal_errors", fatal).withColumn("status", status)
    if "trigger_eligible" in df.columns:
        # A stale price leaves only event-driven triggers eligible.
        out = out.withColumn(
            "trigger_eligible",
            F.when(c("status") == "STALE", F.size("event_codes") > 0).otherwise(c("trigger_eligible")),
        )
    return out


def average_rank_percentile(column: str, *partition: str) -> Column:
    """0..100 percentile by average rank; ties share it, a single row gets 50.

    Meant for small dimension tables (sectors): the window spans the whole partition.
    """
    part = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    order = part.orderBy(F.col(column))
    ties = Window.partitionBy(*partition, column) if partition else Window.partitionBy(column)
    position = F.rank().over(order) - 1 + (F.count(F.lit(1)).over(ties) - 1) / 2
    total = F.count(F.lit(1)).over(part)
    return F.when(F.col(column).isNull(), lit_null()).when(total == 1, F.lit(50.0)).otherwise(position / (total - 1) * 100)
