"""Yearly distribution history: eligibility, conservative history value, growth, stability, buyback credit.

Inputs hold one row per company and fiscal year (checked by ``quality.duplicate_report``), so a
window per company never exceeds the number of fiscal years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashlens.functions import policy as P
from cashlens.functions import series as S
from cashlens.functions.numeric import (
    clip,
    half_up,
    linear_score,
    lit_null,
    ratio,
    step_at_least,
    step_at_most,
    weighted_score,
)

# Fixed values.
ELIGIBLE_DIVIDEND_STATUSES = ("PAID", "SHAREHOLDER_APPROVED", "LEGAL_COMMITMENT", "NO_DISTRIBUTION")


def newest_first() -> Window:
    return Window.partitionBy("company_id").orderBy(F.desc("fiscal_year"))


def newest_years(df: DataFrame, limit: int) -> DataFrame:
    """Newest ``limit`` fiscal years per company with their position ``rn`` (1 = newest)."""
    return df.withColumn("rn", F.row_number().over(newest_first())).where(F.col("rn") <= limit)


def eligible_distributions(df: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """Full-year rows that ended by ``as_of`` with a settled status and an amount of zero or more.

    ``NO_DISTRIBUTION`` without an amount counts as zero.
    """
    amount = F.when(
        F.col("ordinary_dividend").isNull() & (F.col("ordinary_dividend_status") == "NO_DISTRIBUTION"), F.lit(0)
    ).otherwise(F.col("ordinary_dividend"))
    kept = df.withColumn("ordinary_dividend", amount).where(
        (F.col("period_type") == "FULL_YEAR")
        & (F.col("fiscal_year_end_date") <= as_of)
        & F.col("ordinary_dividend_status").isin(*ELIGIBLE_DIVIDEND_STATUSES)
        & (F.col("ordinary_dividend") >= 0)
    )
    return newest_years(kept, limit)


def eligible_coverage(df: DataFrame, as_of: Column, limit: int = 5) -> DataFrame:
    """Rows with both cash-flow members, capex of zero or more and a fiscal end not after ``as_of``."""
    kept = df.where(
        (F.col("fiscal_year_end_date").isNull() | (F.col("fiscal_year_end_date") <= as_of))
        & F.col("operating_cash_flow").isNotNull()
        & (F.col("capital_expenditure") >= 0)
    )
    return newest_years(kept, limit)


def latest_run(df: DataFrame, maximum: int) -> DataFrame:
    """The unbroken run of fiscal years that ends at the newest year, at most ``maximum`` long."""
    ranked = df.withColumn("rn", F.row_number().over(newest_first())).withColumn(
        "newest", F.max("fiscal_year").over(Window.partitionBy("company_id"))
    )
    return ranked.where(
        (F.col("rn") <= maximum) & (F.col("fiscal_year") == F.col("newest") - F.col("rn") + 1)
    ).drop("newest")


def eligible_buyback(gross: Column, cancelled: Column, net_reduction: Column) -> Column:
    """Cash credited for cancelled shares, scaled by the net reduction really achieved."""
    g, c, n = gross.cast("double"), cancelled.cast("double"), net_reduction.cast("double")
    factor = F.least(F.lit(1.0), F.greatest(F.lit(0.0), n) / F.when(c != 0, c))
    return (
        F.when(g.isNull() | c.isNull() | n.isNull() | (g < 0) | (c < 0), lit_null())
        .when(c == 0, F.lit(0.0))
        .otherwise(g * factor)
    )


def effective_distribution(dividend: Column, persistence: Column, buyback: Column) -> Column:
    """Dividend plus persistence-weighted buyback; null if any part is missing."""
    return F.when(dividend >= 0, dividend.cast("double") + persistence * buyback)


def effective_distribution_verified(dividend: Column, buyback: Column) -> Column:
    """Dividend plus verified buyback; an unverified buyback adds nothing and stays null itself."""
    return F.when(dividend >= 0, dividend.cast("double") + F.coalesce(buyback, F.lit(0.0)))


def newest_values(df: DataFrame, column: str, out: str = "v") -> DataFrame:
    """One row per company with its non-null values newest first (bounded by the kept years)."""
    picked = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("rn", F.col(column).cast("double").alias("x")))))
    return df.groupBy("company_id").agg(F.transform(picked, lambda s: s["x"]).alias(out))


def history_columns(v: Column) -> dict[str, Column]:
    """R2, M5, T10 and the conservative history value H from values newest first."""
    n = F.size(v)
    at = lambda k: F.get(v, F.lit(k - 1))
    w2 = P.FORMULA["recent_two_year_weights"]
    r2 = F.when(n >= 2, w2[0] * at(1) + w2[1] * at(2))
    m5 = S.median(F.slice(v, 1, 5))
    ten = F.array_sort(F.slice(v, 1, 10))
    k = F.size(ten)
    pulled = S.total(ten) - F.get(ten, F.lit(0)) + F.get(ten, F.lit(1)) - F.get(ten, k - 1) + F.get(ten, k - 2)
    t10 = F.when(k >= P.FORMULA["winsorize_minimum_years"], pulled / k).otherwise(S.mean(ten))
    return {"r2": r2, "m5": m5, "t10": t10}


def conservative_history(n: Column, latest: Column, r2: Column, m5: Column, t10: Column) -> Column:
    """H: the branch follows the number of years on record."""
    f = P.FORMULA
    a, b, c = f["history_8_plus_weights"]
    d, e = f["history_5_7_weights"]
    long_run = F.least(
        a * r2 + b * m5 + c * t10, f["history_8_plus_median_cap"] * m5, f["history_8_plus_ten_year_cap"] * t10
    )
    return (
        F.when(n < 2, lit_null())
        .when(n >= f["winsorize_minimum_years"], long_run)
        .when(n >= 5, F.least(d * r2 + e * m5, f["history_5_7_median_cap"] * m5))
        .when(n >= 3, F.least(r2, m5))
        .otherwise(F.least(latest, r2))
    )


def history_profile(values: DataFrame) -> DataFrame:
    """Adds n_years, latest, previous, r2, m5, t10 and h to a frame with ``v`` newest first."""
    v = F.col("v")
    base = values.withColumns({"n_years": F.size(v), "latest": F.get(v, F.lit(0)), "previous": F.get(v, F.lit(1))})
    base = base.withColumns(history_columns(v))
    return base.withColumn(
        "h", conservative_history(F.col("n_years"), F.col("latest"), F.col("r2"), F.col("m5"), F.col("t10"))
    )


def persistence_factor(net_newest_first: Column) -> Column:
    """Buyback persistence from the net reductions of the newest five years; any null gives null."""
    five = F.slice(net_newest_first, 1, 5)
    years = F.size(F.filter(five, lambda x: x > 0))
    known = (F.size(five) > 0) & F.forall(five, lambda x: x.isNotNull())
    return F.when(known, step_at_least(years, P.BUYBACK_PERSISTENCE))


def trend_score(r2: Column, m5: Column, latest: Column, previous: Column) -> Column:
    """Recent trend from R2 over M5, held back after an obvious decline of the latest year."""
    r = ratio(r2, m5)
    decline = F.coalesce((previous > 0) & (latest / previous < P.RECENT_TREND_DECLINE_RATIO), F.lit(False))
    out = F.when(latest == 0, F.lit(0.0)).when(r2.isNull() | (m5 <= 0) | m5.isNull(), lit_null())
    out = out.when(decline & (r >= 0.95), F.lit(P.RECENT_TREND_DECLINE_SCORE))
    for minimum, score, only_steady in P.RECENT_TREND:
        hit = r >= minimum
        out = out.when(hit & ~decline if only_steady else hit, F.lit(score))
    return out.otherwise(F.lit(0.0))


def stability_score(newest_first_values: Column) -> Column:
    """History stability of the newest five years from interruptions and variation."""
    five = F.slice(newest_first_values, 1, 5)
    gaps = F.size(F.filter(five, lambda x: x == 0))
    cv = S.variation(five)
    s, lim = P.STABILITY_SCORES, P.STABILITY_LIMITS
    return (
        F.when(F.size(five) == 0, lit_null())
        .when(F.get(five, F.lit(0)) == 0, F.lit(0.0))
        .when((gaps == 0) & (cv <= lim["excellent_cv"]), F.lit(s["excellent"]))
        .when((gaps == 0) & (cv <= lim["good_cv"]), F.lit(s["good"]))
        .when((gaps <= lim["acceptable_interruptions"]) | (cv <= lim["acceptable_cv"]), F.lit(s["acceptable"]))
        .otherwise(F.lit(s["otherwise"]))
    )


def buyback_quality(factor: Column, has_buyback: Column, dilution: Column, net: Column) -> Column:
    out = F.when(dilution | (has_buyback & (net <= 0)), F.lit(0.0))
    out = out.when(~has_buyback, F.lit(P.BUYBACK_QUALITY_NONE))
    for f, score in P.BUYBACK_QUALITY.items():
        out = out.when(factor == f, F.lit(score))
    return out.otherwise(F.lit(P.BUYBACK_QUALITY_FAILED))


def history_cap(years: Column) -> Column:
    """Upper limit on a score by the number of years on record."""
    return step_at_most(years, [(hi, cap) for _, hi, cap, _ in P.HISTORY_CAPS], P.HISTORY_CAPS[-1][2])


def growth_contribution(growth: Column) -> Column:
    """Half of positive growth up to a cap; negative growth in full."""
    f = P.FORMULA
    up = F.least(F.lit(f["positive_growth_contribution_cap"]), f["positive_growth_confirmation"] * F.greatest(growth, F.lit(0.0)))
    return F.when(growth.isNotNull(), up + F.least(growth, F.lit(0.0)))


def growth_contribution_by_years(growth: Column, years: Column) -> Column:
    """Positive growth capped by the length of the evidence; negative growth in full."""
    f = P.FORMULA
    cap = (
        F.when(years >= 5, F.lit(f["growth_positive_cap_5y"]))
        .when(years >= 3, F.lit(f["growth_positive_cap_3_4y"]))
        .otherwise(F.lit(f["growth_positive_cap_2y"]))
    )
    return F.when(growth <= 0, growth).when(growth.isNotNull(), F.least(cap, growth))


def sustainable_distribution(h: Column, capacity: Column, simplified: Column) -> Column:
    """min(H, haircut x median capacity), never below zero."""
    f = P.FORMULA
    cut = F.when(simplified, F.lit(f["simplified_fcf_capacity_haircut"])).otherwise(F.lit(f["fcf_capacity_haircut"]))
    value = F.greatest(F.lit(0.0), F.least(h, cut * F.greatest(capacity, F.lit(0.0))))
    return F.when((h >= 0) & capacity.isNotNull(), value)


def free_cash_flow(rows: DataFrame) -> DataFrame:
    """fcf per kept year; one missing lease figure makes the whole company window a simplified FCF."""
    whole = Window.partitionBy("company_id")
    simple = F.max(F.col("lease_principal_repayment").isNull()).over(whole)
    base = F.col("operating_cash_flow") - F.col("capital_expenditure")
    return rows.withColumn("simplified_fcf", simple).withColumn(
        "fcf", F.when(F.col("simplified_fcf"), base).otherwise(base - F.col("lease_principal_repayment"))
    )


def veto_flags(df: DataFrame) -> DataFrame:
    """Eleven veto flags as an array of triggered codes; a missing input never triggers.

    Expects one row per company with the input columns named below; absent evidence is null.
    """
    t = P.THRESHOLDS
    c = F.col
    drop = (c("ordinary_dividend_previous") > 0) & (
        ratio(c("ordinary_dividend_previous") - c("ordinary_dividend_latest"), c("ordinary_dividend_previous"))
        > t["ordinary_dividend_decline_veto"]
    )
    rules = {
        "ORDINARY_DIVIDEND_DROPPED_OR_SUSPENDED": drop | (c("ordinary_dividend_latest") == 0),
        "DISTRIBUTION_OVER_FCF_AND_DEBT_RISING": c("two_year_distribution_over_fcf") & c("net_debt_increased"),
        "BUYBACK_WITHOUT_DILUTED_REDUCTION": (c("claimed_buyback") > 0) & (c("diluted_net_share_reduction") <= 0),
        "ONE_OFF_DISTRIBUTION_OVER_30PCT": (c("surface_distribution") > 0)
        & (ratio(c("one_off_distribution"), c("surface_distribution")) > t["one_off_distribution_share_veto"]),
        "CORE_ASSET_EXPIRES_WITHIN_10Y": c("core_asset_expires_within_10y"),
        "MAJOR_COMMITTED_CAPEX_OR_MA": c("major_committed_capex_or_ma"),
        "AUDIT_GOVERNANCE_ALERT": c("qualified_audit_opinion")
        | c("material_internal_control_weakness")
        | c("controlling_shareholder_fund_occupation")
        | c("major_related_party_alert"),
        "MAJOR_REGULATORY_PENALTY": c("major_regulatory_penalty"),
        "FINANCIAL_CAPITAL_BUFFER_NEAR_MINIMUM": c("financial_capital_buffer_near_minimum"),
        "KEY_SOURCE_VALIDATION_FAILED": c("key_source_validation_failed"),
        "INCOMPLETE_AH_MARKET_CAP": c("incomplete_ah_market_cap"),
    }
    have = set(df.columns)
    needed = {
        "ordinary_dividend_previous", "ordinary_dividend_latest", "claimed_buyback", "diluted_net_share_reduction",
        "surface_distribution", "one_off_distribution",
    }
    flags = {
        "two_year_distribution_over_fcf", "net_debt_increased", "core_asset_expires_within_10y",
        "major_committed_capex_or_ma", "qualified_audit_opinion", "material_internal_control_weakness",
        "controlling_shareholder_fund_occupation", "major_related_party_alert", "major_regulatory_penalty",
        "financial_capital_buffer_near_minimum", "key_source_validation_failed", "incomplete_ah_market_cap",
    }
    filled = df.withColumns(
        {n: lit_null() for n in needed - have} | {n: lit_null("boolean") for n in flags - have}
    ) if (needed | flags) - have else df
    codes = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()])
    return filled.withColumn("veto_codes", F.array_compact(codes))


def veto_inputs(years: DataFrame) -> DataFrame:
    """Derive the threshold inputs of ``veto_flags`` from the two newest eligible years per company.

    ``years`` carries rn plus distribution, cash-flow and net_debt columns.  Totals are null as soon
    as one component is null.
    """
    c = F.col
    total = c("ordinary_dividend") + c("special_dividend") + c("gross_cancelled_buyback") + c("asset_sale_distribution")
    fcf = c("operating_cash_flow") - c("capital_expenditure") - c("lease_principal_repayment")
    over = total.cast("double") > P.THRESHOLDS["fcf_overdistribution_ratio"] * fcf.cast("double")
    one_off = c("special_dividend") + c("asset_sale_distribution") + c("one_off_buyback")
    at = lambda k, e: F.max(F.when(c("rn") == k, e))
    g = years.groupBy("company_id").agg(
        at(1, c("ordinary_dividend")).alias("ordinary_dividend_latest"),
        at(2, c("ordinary_dividend")).alias("ordinary_dividend_previous"),
        at(1, c("gross_cancelled_buyback")).alias("claimed_buyback"),
        at(1, c("diluted_net_share_reduction")).alias("diluted_net_share_reduction"),
        at(1, total).alias("total_latest"),
        at(1, one_off).alias("one_off_latest"),
        at(1, over).alias("over1"),
        at(2, over).alias("over2"),
        at(1, c("net_debt")).alias("debt1"),
        at(2, c("net_debt")).alias("debt2"),
    )
    both = c("total_latest").isNotNull() & c("one_off_latest").isNotNull()
    return g.select(
        "company_id",
        "ordinary_dividend_latest",
        "ordinary_dividend_previous",
        "claimed_buyback",
        "diluted_net_share_reduction",
        F.when(both, c("total_latest")).alias("surface_distribution"),
        F.when(both, c("one_off_latest")).alias("one_off_distribution"),
        F.when(c("over1").isNotNull() & c("over2").isNotNull(), c("over1") & c("over2")).alias(
            "two_year_distribution_over_fcf"
        ),
        (c("debt1") > c("debt2")).alias("net_debt_increased"),
    )


def slow_variables(years: DataFrame, as_of: Column, overlays: DataFrame | None = None) -> DataFrame:
    """History-only surface of a company: H, S, coverage, growth, payout quality.

    ``years`` is the yearly fact table.  Eligible distribution years, eligible coverage years and the
    newest balance sheet are all picked in one pass: one window and one aggregate over the same
    company partitioning, so the yearly table is shuffled once.
    """
    c = F.col
    ended = c("fiscal_year_end_date") <= as_of
    pays = F.coalesce(
        (c("period_type") == "FULL_YEAR")
        & ended
        & c("ordinary_dividend_status").isin(*ELIGIBLE_DIVIDEND_STATUSES)
        & (c("paid") >= 0),
        F.lit(False),
    )
    covers = F.coalesce(
        (c("fiscal_year_end_date").isNull() | ended)
        & c("operating_cash_flow").isNotNull()
        & (c("capital_expenditure") >= 0),
        F.lit(False),
    )
    so_far = newest_first().rowsBetween(Window.unboundedPreceding, 0)
    paid = F.when(
        c("ordinary_dividend").isNull() & (c("ordinary_dividend_status") == "NO_DISTRIBUTION"), F.lit(0)
    ).otherwise(c("ordinary_dividend"))
    flagged = (
        years.withColumn("paid", paid)
        .withColumns({"pays": pays, "covers": covers})
        .withColumns(
            {
                "rn": F.row_number().over(newest_first()),
                "rd": F.sum(c("pays").cast("int")).over(so_far),
                "rc": F.sum(c("covers").cast("int")).over(so_far),
                "buyback": eligible_buyback(
                    c("gross_cancelled_buyback"), c("cancelled_shares"), c("diluted_net_share_reduction")
                ),
            }
        )
        .withColumn("effective", effective_distribution_verified(c("paid"), c("buyback")))
    )
    in_d = c("pays") & (c("rd") <= 10) & c("effective").isNotNull()
    in_c = c("covers") & (c("rc") <= 5)
    plain = (c("operating_cash_flow") - c("capital_expenditure")).cast("double")
    packed = flagged.groupBy("company_id").agg(
        F.array_sort(F.collect_list(F.when(in_d, F.struct("rd", c("effective").alias("x"))))).alias("d"),
        F.array_sort(
            F.collect_list(
                F.when(
                    in_c,
                    F.struct(
                        "rc",
                        c("fiscal_year").alias("y"),
                        plain.alias("x"),
                        c("lease_principal_repayment").cast("double").alias("l"),
                    ),
                )
            )
        ).alias("f"),
        F.max(F.when(c("rn") == 1, F.struct("balance_kind", "balance_value"))).alias("b"),
    )
    simple = F.exists("f", lambda s: s["l"].isNull())
    staged = (
        packed.where(F.size("d") > 0)
        .withColumns({"v": F.transform("d", lambda s: s["x"]), "simplified_fcf": F.when(F.size("f") > 0, simple)})
        .withColumns(
            {
                "fcf": F.transform(
                    "f",
                    lambda s: F.struct(
                        s["y"].alias("y"),
                        F.when(c("simplified_fcf"), s["x"]).otherwise(s["x"] - s["l"]).alias("x"),
                    ),
                ),
                "balance_kind": c("b.balance_kind"),
                "balance_value": c("b.balance_value"),
            }
        )
        .withColumn("newest_fcf_year", F.get(c("fcf"), F.lit(0))["y"])
        .withColumns(
            {
                "coverage_years": F.size("fcf"),
                "fcf_sorted": F.array_sort(F.transform("fcf", lambda s: s["x"])),
                # The unbroken run from the newest year, oldest first.
                "growth_series": F.reverse(
                    F.transform(F.filter("fcf", lambda s, i: s["y"] == c("newest_fcf_year") - i), lambda s: s["x"])
                ),
            }
        )
    )
    hist = history_profile(staged).withColumns(
        {
            "capacity": F.when(c("coverage_years") >= 2, S.middle(c("fcf_sorted"))),
            "organic_growth": S.organic_growth(
                c("growth_series"), P.FORMULA["organic_growth_floor"], P.FORMULA["organic_growth_ceiling"]
            ),
        }
    )
    if overlays is not None:
        hist = hist.join(overlays, "company_id", "left")
    out = hist.withColumns(
        {
            "sustainable": sustainable_distribution(c("h"), c("capacity"), c("simplified_fcf")),
            "coverage_ratio": F.when(c("h") > 0, c("capacity") / c("h")),
            "conservative_growth": F.coalesce(
                growth_contribution_by_years(c("organic_growth"), F.size("growth_series")), F.lit(0.0)
            ),
            "trend_component": trend_score(c("r2"), c("m5"), c("latest"), c("previous")),
            "stability_component": F.when(c("n_years") >= 2, stability_score(c("v"))),
            "balance_component": balance_score(c("balance_kind"), c("balance_value")),
        }
    ).withColumn("coverage_component", linear_score(c("coverage_ratio"), P.COVERAGE_KNOTS, rounded=False))
    return out.withColumn(
        "payout_quality",
        weighted_score(
            {
                "coverage": c("coverage_component"),
                "recent_trend": c("trend_component"),
                "history_stability": c("stability_component"),
                "balance_sheet": c("balance_component"),
            },
            P.WEIGHTS["payout_quality"],
        ),
    )


def balance_score(kind: Column, value: Column) -> Column:
    """Score of the balance-sheet kinds produced by ``ledger.balance_sheet_kind``."""
    r = P.RESILIENCE
    return (
        F.when(value.isNull(), lit_null())
        .when(kind == "NET_CASH", F.lit(100.0))
        .when(kind == "NET_DEBT_TO_EQUITY", step_at_most(value, r["net_debt_to_equity"], r["net_debt_above"]))
        .when(kind == "DEBT_TO_ASSETS_PROXY", step_at_most(value, r["liabilities_to_assets"], r["liabilities_above"]))
    )


def entry_risk(df: DataFrame) -> DataFrame:
    """Entry-risk index of the verified line: unknown qualitative inputs take the default risk.

    Expects trend_component, coverage_component, balance_component, structural_cycle,
    policy_asset_life, valuation_trap, governance, veto_config_incomplete, warning_flags.
    """
    c = F.col
    u = P.RISK_UPLIFTS
    unknown = F.lit(u["unknown_qualitative_default"])
    inverse = lambda x: F.coalesce(100.0 - c(x), unknown)
    base = weighted_score(
        {
            "distribution_deterioration": inverse("trend_component"),
            "coverage": inverse("coverage_component"),
            "balance_sheet": inverse("balance_component"),
            "structural_cycle": F.coalesce(c("structural_cycle"), unknown),
            "policy_asset_life": F.coalesce(c("policy_asset_life"), unknown),
            "valuation": F.coalesce(c("valuation_trap"), F.lit(u["current_only_valuation_default"])),
            "governance": inverse("governance"),
        },
        P.WEIGHTS["entry_risk"],
    )
    lift = F.when(c("veto_config_incomplete"), F.lit(u["unknown_veto"])).otherwise(F.lit(0.0)) + F.least(
        F.lit(u["triggered_warning_cap"]), u["triggered_warning_each"] * F.coalesce(c("warning_flags"), F.lit(0))
    )
    return df.withColumn("entry_risk_index", half_up(clip(base + lift), 4))
