"""Market value, coverage by industry, returns, recommendation, confidence and assessment tiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashlens.functions import policy as P
from cashlens.functions.numeric import clip, lit_null, linear_score, ratio, weighted_score
from cashlens.operators.history import history_cap

c = F.col


def class_issues(now: Column, stale_hours: int = 24) -> Column:
    """Why a share class cannot be valued (empty when it can)."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(c("price_timestamp").cast("timestamp"))
    limit = stale_hours * 3600 * 1_000_000
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(c("quote_status").isin("VALID", "KNOWN_ZERO"), F.lit(False)), F.lit("QUOTE_NOT_VALID")),
            F.when(
                c("price").isNull() | c("issued_shares").isNull() | c("fx_to_base").isNull() | c("price_timestamp").isNull(),
                F.lit("INPUT_MISSING"),
            ),
            F.when((age < 0) | (age > limit), F.lit("QUOTE_STALE")),
            F.when((c("price") <= 0) | (c("issued_shares") <= 0) | (c("fx_to_base") <= 0), F.lit("NOT_POSITIVE")),
        )
    )


def company_market_cap(classes: DataFrame, expected: DataFrame, now: Column, stale_hours: int = 24) -> DataFrame:
    """Sum of price x shares x FX over the material classes; all or nothing.

    ``expected``: company_id, expected_classes (array).  The material classes present must be the
    expected ones, compared as sorted sets of class codes (a handful per company).
    """
    material = classes.where(c("material")).withColumn("_bad", F.size(class_issues(now, stale_hours)) > 0)
    value = c("price").cast("double") * c("issued_shares").cast("double") * c("fx_to_base").cast("double")
    g = material.groupBy("company_id").agg(
        F.sum(value).alias("_sum"),
        F.max("_bad").alias("_any_bad"),
        F.array_sort(F.collect_set("share_class")).alias("_present"),
        F.count(F.lit(1)).alias("material_classes"),
    )
    j = expected.join(g, "company_id", "left")
    complete = (F.size("expected_classes") > 0) & F.array_sort(F.array_distinct("expected_classes")).eqNullSafe(c("_present"))
    blocker = F.when(~F.coalesce(complete, F.lit(False)), "SHARE_CLASSES_INCOMPLETE").when(c("_any_bad"), "CLASS_INPUT_INVALID")
    return j.withColumn("blocker", blocker).select(
        "company_id", F.when(c("blocker").isNull(), c("_sum")).alias("market_cap"), "blocker", "material_classes"
    )


def prices_at_four_percent(classes: DataFrame, sustainable: DataFrame) -> DataFrame:
    """Price per class at a 4 % yield, weighted by economic rights.

    Equivalent shares come from an aggregate joined back, and any unverified class blocks the company.
    """
    material = classes.where(c("material"))
    ok = c("rights_verified") & (c("economic_rights_factor") > 0) & c("issued_shares").isNotNull() & (c("fx_to_base") > 0)
    weight = c("issued_shares").cast("double") * c("economic_rights_factor").cast("double")
    g = material.groupBy("company_id").agg(
        F.sum(weight).alias("equivalent_shares"), F.min(F.coalesce(ok, F.lit(False))).alias("_ok")
    )
    j = material.join(g, "company_id").join(sustainable, "company_id", "left")
    usable = c("_ok") & (c("equivalent_shares") > 0) & (c("sustainable") >= 0)
    price = c("sustainable") / 0.04 / c("equivalent_shares") * c("economic_rights_factor").cast("double") / c("fx_to_base").cast("double")
    return j.select("company_id", "security_id", "share_class", "equivalent_shares", F.when(usable, price).alias("price_at_4pct"))


def vendor_value(df: DataFrame) -> DataFrame:
    """Company value from the vendor figure after a share-count check, else price x official shares.

    Expects authorization and observation columns joined on company_id: selected_security_id,
    vendor_value_authorized, direct_equivalent_shares_authorized, official_equivalent_shares,
    security_id, price, fx_to_base, total_market_value, freshness.
    """
    official = c("official_equivalent_shares").cast("double")
    staged = df.withColumn("implied_shares", ratio(c("total_market_value"), c("price"))).withColumn(
        "relative_difference", F.when(official > 0, F.abs(c("implied_shares") - official) / official)
    )
    has_quote = c("security_id").isNotNull()
    vendor = F.coalesce(c("vendor_value_authorized"), F.lit(False)) & c("total_market_value").isNotNull()
    direct = F.coalesce(c("direct_equivalent_shares_authorized"), F.lit(False)) & (official > 0)
    blocker = (
        F.when(~has_quote, "MARKET_OBSERVATION_MISSING")
        .when(c("security_id") != c("selected_security_id"), "SELECTED_SECURITY_IDENTITY_CONFLICT")
        .when(c("price").isNull() | c("fx_to_base").isNull(), "PRICE_OR_FX_MISSING")
        .when((c("price") <= 0) | (c("fx_to_base") <= 0), "PRICE_OR_FX_INVALID")
        .when(vendor & (official.isNull() | (official <= 0)), "OFFICIAL_EQUIVALENT_SHARES_MISSING")
        .when(vendor & (c("relative_difference") > 0.05), "VENDOR_EQUIVALENT_SHARES_DEVIATION_GT_5PCT")
        .when(~vendor & ~F.coalesce(direct, F.lit(False)), "SEEV_NOT_AUTHORIZED")
    )
    staged = staged.withColumn("blocker", blocker)
    open_ = c("blocker").isNull()
    value = F.when(open_ & vendor, c("total_market_value").cast("double") * c("fx_to_base").cast("double")).when(
        open_, c("price").cast("double") * official * c("fx_to_base").cast("double")
    )
    quoted = has_quote & ~F.coalesce(c("blocker"), F.lit("")).isin(
        "SELECTED_SECURITY_IDENTITY_CONFLICT", "PRICE_OR_FX_MISSING", "PRICE_OR_FX_INVALID", "OFFICIAL_EQUIVALENT_SHARES_MISSING"
    )
    warnings = F.array_compact(
        F.array(
            F.when(quoted & (c("freshness") == "STALE_LAST_GOOD"), F.lit("STALE_LAST_GOOD")),
            F.when(open_ & vendor & (c("relative_difference") > 0.02), F.lit("VENDOR_EQUIVALENT_SHARES_DEVIATION_2_TO_5PCT")),
        )
    )
    basis = F.when(open_ & vendor, "VENDOR_AUTHORIZED").when(open_, "DERIVED").otherwise("UNAVAILABLE")
    return staged.withColumns(
        {
            "market_value": value,
            "market_value_basis": basis,
            "market_warnings": warnings,
            "relative_difference": F.when(vendor, c("relative_difference")),
        }
    )


# ---- coverage by industry ----


def missing_fields(names: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*[F.when(c(n).isNull(), F.lit(n)) for n in names]))


def bank_capacity() -> Column:
    buffer = c("cet1_ratio") - c("cet1_regulatory_minimum")
    factor = F.least(F.lit(1.0), buffer / P.BANK_MINIMUM_BUFFER)
    earned = F.least(c("adjusted_net_income"), c("capital_generation_capacity")) * P.FORMULA["fcf_capacity_haircut"] * factor
    return F.when(buffer <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), earned))


def insurance_capacity() -> Column:
    buffer = F.least(
        c("comprehensive_solvency_ratio") - c("comprehensive_solvency_minimum"),
        c("core_solvency_ratio") - c("core_solvency_minimum"),
    )
    factor = F.when(buffer <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), buffer / P.INSURANCE_MINIMUM_BUFFER))
    earned = F.least(c("free_surplus_generation"), c("distributable_surplus_capacity")) * P.FORMULA["fcf_capacity_haircut"] * factor
    return F.greatest(F.lit(0.0), earned)


def fcf_capacity() -> Column:
    return c("fcf_median")


# One builder per industry: (required columns, capacity column, haircut on S).
COVERAGE_BUILDERS: dict[str, tuple[tuple[str, ...], Callable[[], Column], float]] = {
    "NON_FINANCIAL": (("fcf_median",), fcf_capacity, P.FORMULA["fcf_capacity_haircut"]),
    "BANK": (
        (
            "adjusted_net_income", "capital_generation_capacity", "cet1_ratio", "cet1_regulatory_minimum",
            "risk_weighted_asset_growth", "nonperforming_loan_ratio", "provision_coverage_ratio", "credit_cost",
            "net_interest_margin",
        ),
        bank_capacity,
        1.0,
    ),
    "INSURANCE": (
        (
            "free_surplus_generation", "distributable_surplus_capacity", "comprehensive_solvency_ratio",
            "comprehensive_solvency_minimum", "core_solvency_ratio", "core_solvency_minimum",
            "investment_asset_quality_score", "interest_rate_sensitivity_score", "new_business_value",
        ),
        insurance_capacity,
        1.0,
    ),
}


def coverage_by_industry(df: DataFrame) -> DataFrame:
    """Capacity, S and coverage ratio by the builder of each industry; a missing input blocks, never falls back.

    Expects company_id, industry_kind, h and the inputs of the industries present (absent ones are null).
    ``fcf_median`` and ``lease_incomplete`` describe the non-financial window.
    """
    needed = {x for names, _, _ in COVERAGE_BUILDERS.values() for x in names} - set(df.columns)
    full = df.withColumns({n: lit_null() for n in needed}) if needed else df
    if "lease_incomplete" not in full.columns:
        full = full.withColumn("lease_incomplete", F.lit(False))
    capacity, missing, haircut = lit_null(), F.array(F.lit("industry_specific_coverage_adapter")), F.lit(1.0)
    for kind, (names, build, cut) in COVERAGE_BUILDERS.items():
        mine = c("industry_kind") == kind
        lacking = missing_fields(names)
        capacity = F.when(mine, F.when(F.size(lacking) == 0, build())).otherwise(capacity)
        missing = F.when(mine, lacking).otherwise(missing)
        haircut = F.when(mine, F.lit(cut)).otherwise(haircut)
    staged = full.withColumns({"capacity": capacity, "missing_fields": missing, "_cut": haircut})
    known = c("h").isNotNull() & c("capacity").isNotNull()
    return staged.withColumns(
        {
            "sustainable": F.when(
                known, F.greatest(F.lit(0.0), F.least(c("h"), c("_cut") * F.greatest(c("capacity"), F.lit(0.0))))
            ),
            "coverage_ratio": F.when(known & (c("h") > 0), c("capacity") / c("h")),
            "coverage_status": F.when(~known, "INSUFFICIENT_DATA")
            .when((c("industry_kind") == "NON_FINANCIAL") & c("lease_incomplete"), "PARTIAL")
            .otherwise("VALID"),
        }
    ).drop("_cut")


def capital_buffer_near_minimum() -> Column:
    """Bank or insurance buffer at or below the policy minimum; null when it cannot be told."""
    bank = c("cet1_ratio") - c("cet1_regulatory_minimum") <= P.BANK_MINIMUM_BUFFER
    solvency = F.when(
        c("comprehensive_solvency_ratio").isNotNull() & c("core_solvency_ratio").isNotNull(),
        F.least(
            c("comprehensive_solvency_ratio") - c("comprehensive_solvency_minimum"),
            c("core_solvency_ratio") - c("core_solvency_minimum"),
        ),
    )
    return F.when(c("industry_kind") == "BANK", bank).when(c("industry_kind") == "INSURANCE", solvency <= P.INSURANCE_MINIMUM_BUFFER)


# ---- growth, valuation, returns ----

GROWTH_METRIC = {
    "NON_FINANCIAL": "normalized_fcf",
    "BANK": "adjusted_net_income_or_capital_generation",
    "INSURANCE": "free_surplus_generation",
}
VALUATION_METRICS = {"NON_FINANCIAL": ("P_FCF", "EV_EBIT"), "BANK": ("P_B_WITH_ROE",), "INSURANCE": ("P_EV", "P_B_WITH_ROE")}


def growth_inputs(series: DataFrame, companies: DataFrame, as_of: Column) -> DataFrame:
    """Newest five growth values, oldest first, only when the metric fits the industry and the years are unbroken."""
    w = Window.partitionBy("company_id").orderBy(F.desc("fiscal_year"))
    bad = (
        ~F.coalesce(c("period_type") == "FULL_YEAR", F.lit(False))
        | c("fiscal_year_end_date").isNull()
        | (c("fiscal_year_end_date") > as_of)
        | c("value").isNull()
    )
    ranked = series.withColumns({"_k": F.row_number().over(w), "_bad": bad})
    g = ranked.groupBy("company_id").agg(
        F.max("_bad").alias("_any_bad"),
        F.array_sort(F.collect_list(F.when(c("_k") <= 5, F.struct("fiscal_year", c("value").cast("double").alias("x"))))).alias("p"),
    )
    j = companies.select("company_id", "industry_kind", "organic_growth_metric").join(g, "company_id", "left")
    fits = F.lit(False)
    for kind, metric in GROWTH_METRIC.items():
        fits = fits | ((c("industry_kind") == kind) & (c("organic_growth_metric") == metric))
    n = F.size("p")
    unbroken = (n >= 2) & (F.get(c("p"), n - 1)["fiscal_year"] - F.get(c("p"), F.lit(0))["fiscal_year"] == n - 1)
    distinct = F.size(F.array_distinct(F.transform("p", lambda s: s["fiscal_year"]))) == n
    issue = (
        F.when(~F.coalesce(fits, F.lit(False)), "GROWTH_METRIC_MISSING")
        .when(c("p").isNull(), "GROWTH_SERIES_MISSING")
        .when(c("_any_bad"), "GROWTH_PERIOD_INCOMPLETE")
        .when(~distinct | ~unbroken, "GROWTH_YEARS_NOT_CONTINUOUS")
    )
    return j.withColumn("growth_issue", issue).select(
        "company_id", "growth_issue", F.when(c("growth_issue").isNull(), F.transform("p", lambda s: s["x"])).alias("growth_series")
    )


def valuation_inputs(df: DataFrame) -> DataFrame:
    """Comparable current and median valuation, only with a metric allowed for the industry."""
    allowed = F.lit(False)
    for kind, names in VALUATION_METRICS.items():
        allowed = allowed | ((c("industry_kind") == kind) & c("valuation_metric").isin(*names))
    ok = allowed & F.coalesce(c("basis_consistent"), F.lit(False))
    roe = (c("valuation_metric") != "P_B_WITH_ROE") | (c("current_roe").isNotNull() & c("historical_median_roe").isNotNull())
    usable = F.coalesce(ok & roe, F.lit(False))
    return df.withColumns(
        {
            "valuation_usable": usable,
            "drag": valuation_drag(F.when(usable, c("historical_median")), F.when(usable, c("current_valuation"))),
        }
    )


def valuation_drag(historical: Column, current: Column) -> Column:
    """Yearly effect of returning to the median valuation within ten years; never positive."""
    years = P.FORMULA["valuation_compression_years"]
    back = F.pow(historical.cast("double") / current.cast("double"), F.lit(1.0 / years)) - 1
    return F.when((historical > 0) & (current > 0), F.least(F.lit(0.0), back))


def return_score_legacy(cr10: Column) -> Column:
    f = P.FORMULA
    return clip(f["return_score_center"] + f["return_score_points_per_1pct"] * ((cr10 - f["return_score_cr10_center"]) / 0.01))


def return_score(cr10: Column) -> Column:
    return linear_score(cr10, P.RETURN_KNOTS, rounded=False)


def recommendation(df: DataFrame, legacy: bool = False) -> DataFrame:
    """Recommendation index from return_score, payout_quality, business_durability, governance, history_years.

    The verified line replaces missing qualitative scores by a default; the legacy line leaves them out
    of the weights and caps the result.
    """
    w = P.WEIGHTS["recommendation"]
    complete = c("business_durability").isNotNull() & c("governance").isNotNull()
    if not legacy:
        d = P.RECOMMENDATION_DEFAULTS
        index = weighted_score(
            {
                "return_score": c("return_score"),
                "payout_quality": c("payout_quality"),
                "business_durability": F.coalesce(c("business_durability"), F.lit(d["missing_business_durability"])),
                "governance_capital_allocation": F.coalesce(
                    c("governance"), F.lit(d["missing_governance_capital_allocation"])
                ),
            },
            w,
        )
        return df.withColumns({"recommendation_index": index, "recommendation_complete": complete})
    parts = {
        "return_score": w["return_score"],
        "payout_quality": w["payout_quality"],
        "business_durability": w["business_durability"],
        "governance": w["governance_capital_allocation"],
    }
    optional = ("business_durability", "governance")
    weight = sum((F.when(c(k).isNotNull(), F.lit(v)).otherwise(0.0) if k in optional else F.lit(v) for k, v in parts.items()), F.lit(0.0))
    acc = sum(
        (F.coalesce(clip(c(k)) * v, F.lit(0.0)) if k in optional else clip(c(k)) * v for k, v in parts.items()), F.lit(0.0)
    )
    staged = df.withColumns({"_i": clip(acc / weight), "recommendation_complete": complete})
    capped = F.when(complete, c("_i")).otherwise(F.least(c("_i"), F.lit(P.FORMULA["incomplete_recommendation_cap"])))
    return staged.withColumn(
        "recommendation_index", F.when(c("_i").isNotNull(), F.least(capped, history_cap(c("history_years"))))
    ).drop("_i")


def recommendation_class(ri: Column, eri: Column, unresolved_veto: Column, major_veto: Column, complete: Column) -> Column:
    a, b, d = P.CLASS_BANDS["A"], P.CLASS_BANDS["B"], P.CLASS_BANDS["D"]
    return (
        F.when(major_veto, "D")
        .when(ri.isNull() | eri.isNull(), "C")
        .when((ri < d[0]) | (eri > d[1]), "D")
        .when(~complete, "C")
        .when((ri >= a[0]) & (eri <= a[1]) & ~unresolved_veto, "A")
        .when((ri >= b[0]) & (eri <= b[1]), "B")
        .otherwise("C")
    )


def return_type(ssy: Column, cr10: Column) -> Column:
    anchor = P.THRESHOLDS["cash_anchor_yield"]
    return F.when(ssy.isNotNull() & cr10.isNotNull(), F.when(ssy >= anchor, "CASH_ANCHORED").when(cr10 >= anchor, "GROWTH_SUPPLEMENTED").otherwise("BELOW_THRESHOLD"))


def fast_variables(slow: DataFrame, market: DataFrame, valuation: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """Price-dependent surface: yields, 4 % value, drag, ten-year return, index, class, return type.

    ``slow``: company_id, r2, sustainable, conservative_growth, payout_quality, business_durability,
    governance, n_years.  ``market``: company_id, market_cap.  ``valuation``: company_id, drag.
    ``risk``: company_id, entry_risk_index, major_veto.
    """
    j = slow.join(market.select("company_id", "market_cap"), "company_id", "left").join(
        valuation.select("company_id", "drag"), "company_id", "left"
    )
    if risk is not None:
        j = j.join(risk.select("company_id", "entry_risk_index", "major_veto"), "company_id", "left")
    else:
        j = j.withColumns({"entry_risk_index": lit_null(), "major_veto": F.lit(False)})
    positive = c("market_cap") > 0
    out = j.withColumns(
        {
            "raw_yield": F.when(positive & (c("r2") >= 0), c("r2") / c("market_cap")),
            "ssy": F.when(positive & (c("sustainable") >= 0), c("sustainable") / c("market_cap")),
            "four_pct_value": c("sustainable") / 0.04,
            "history_years": c("n_years"),
        }
    ).withColumn("cr10", c("ssy") + c("conservative_growth") + c("drag"))
    out = out.withColumn("return_score", return_score_legacy(c("cr10")))
    out = recommendation(out, legacy=True)
    done = c("recommendation_index").isNotNull() & c("entry_risk_index").isNotNull() & c("recommendation_complete")
    veto = F.coalesce(c("major_veto"), F.lit(False))
    return out.withColumns(
        {
            "data_complete": F.coalesce(done, F.lit(False)),
            "return_type": return_type(c("ssy"), c("cr10")),
        }
    ).withColumn("recommendation_class", recommendation_class(c("recommendation_index"), c("entry_risk_index"), veto, veto, c("data_complete")))


# ---- input plan, confidence, assessment ----


def input_plan(df: DataFrame) -> DataFrame:
    """Chosen years and bases, required source ids and warnings of a company.

    Expects distribution_years and coverage_years (arrays newest first), lease_complete, security_id,
    pe_ttm, pe, pb, market_warnings, balance_basis, balance_warnings.
    """
    valuation = F.when(c("pe_ttm") > 0, "PE_TTM").when(c("pe") > 0, "PE").when(c("pb") > 0, "PB")
    simplified = (F.size("coverage_years") > 0) & ~F.coalesce(c("lease_complete"), F.lit(False))
    fy = lambda y, f: F.concat(F.lit("FY"), y.cast("string"), F.lit(f".{f}"))
    sources = F.concat(
        F.transform("distribution_years", lambda y: fy(y, "ordinary_dividend")),
        F.flatten(F.transform("coverage_years", lambda y: F.array(fy(y, "operating_cash_flow"), fy(y, "capital_expenditure")))),
        F.array_compact(
            F.array(
                F.when(
                    valuation.isNotNull(), F.concat_ws(".", F.lit("MARKET"), c("security_id").cast("string"), F.lower(valuation))
                )
            )
        ),
    )
    n_growth = F.size("coverage_years")
    warnings = F.concat(
        F.array_compact(
            F.array(
                F.when(simplified, F.lit("SIMPLIFIED_FCF")),
                F.when(valuation.isNotNull(), F.lit("CURRENT_VALUATION_WITHOUT_COMPARABLE_HISTORY")),
                F.when(n_growth < 2, F.lit("GROWTH_DEFAULT_ZERO")),
            )
        ),
        F.coalesce("market_warnings", F.array().cast("array<string>")),
        F.coalesce("balance_warnings", F.array().cast("array<string>")),
    )
    return df.withColumns(
        {
            "distribution_basis": F.when(F.size("distribution_years") > 0, "DIRECT").otherwise("UNAVAILABLE"),
            "coverage_basis": F.when(simplified, "PROXY").when(F.size("coverage_years") > 0, "DIRECT").otherwise("UNAVAILABLE"),
            "valuation_metric": valuation,
            "valuation_basis": F.when(valuation.isNotNull(), "VENDOR_AUTHORIZED").otherwise("UNAVAILABLE"),
            "growth_basis": F.when(n_growth >= 2, "DERIVED").otherwise("CONSERVATIVE_DEFAULT"),
            "required_source_ids": F.array_distinct(sources),
            "plan_warnings": F.array_distinct(warnings),
        }
    )


def data_confidence(df: DataFrame, on_year: Column) -> DataFrame:
    """Six additive domains of evidence.

    Expects the columns of ``input_plan`` plus has_source, has_official_source, market_value_basis,
    and the booleans business, governance_known, structural, policy_known, veto_known.
    """
    lag = on_year - 1 - F.array_max("distribution_years")
    nd, nc = F.size("distribution_years"), F.size("coverage_years")
    flag = lambda x: F.coalesce(c(x), F.lit(False)).cast("int")
    history = F.when(nd >= 5, 25).when(nd >= 3, 20).when(nd >= 2, 15).otherwise(0)
    history = F.when(lag == 1, F.greatest(history - 3, F.lit(0))).otherwise(history)
    cover = F.when(nc >= 4, 18).when(nc == 3, 15).when(nc >= 2, 12).otherwise(0) + F.when(c("balance_basis") == "DIRECT", 7).when(
        c("balance_basis") == "PROXY", 4
    ).otherwise(0)
    cover = F.when(c("coverage_basis") == "PROXY", F.greatest(cover - 2, F.lit(0))).otherwise(cover)
    market = F.when(c("market_value_basis") == "DERIVED", 12).when(c("market_value_basis") == "VENDOR_AUTHORIZED", 10).otherwise(0)
    domains = {
        "identity_and_provenance": F.when(c("has_official_source"), 15).when(c("has_source"), 12).otherwise(0),
        "distribution_history": history,
        "coverage_and_balance_sheet": cover,
        "market_and_valuation": market + F.when(c("valuation_basis") == "VENDOR_AUTHORIZED", 4).otherwise(0),
        "growth_evidence": F.when(nc >= 5, 5).when(nc >= 3, 4).when(nc == 2, 2).otherwise(0),
        "qualitative_and_veto_coverage": 2 * flag("business")
        + 2 * flag("governance_known")
        + 2 * flag("structural") * flag("policy_known")
        + 4 * flag("veto_known"),
    }
    staged = df.withColumns({k: v.cast("int") for k, v in domains.items()} | {"dividend_lag": lag, "coverage_lag": on_year - 1 - F.array_max("coverage_years")})
    caveats = F.array_compact(
        F.array(
            F.when(c("dividend_lag") == 1, F.lit("LATEST_DIVIDEND_YEAR_LAGS_ONE_YEAR")),
            F.when(c("coverage_basis") == "PROXY", F.lit("SIMPLIFIED_FCF")),
            F.when(c("qualitative_and_veto_coverage") == 0, F.lit("QUALITATIVE_AND_VETO_COVERAGE_MISSING")),
        )
    )
    return staged.withColumns({"confidence": sum((c(k) for k in domains), F.lit(0)), "confidence_caveats": caveats})


def assess(df: DataFrame) -> DataFrame:
    """Blockers, warnings and tier BLOCKED / ESTIMATED / CALCULABLE / VERIFIED from plan and confidence columns."""
    no = lambda x: ~F.coalesce(c(x), F.lit(False))
    late = lambda x: c(x).isNull() | (c(x) > 1)
    rules = [
        ("INDUSTRY_COVERAGE_ADAPTER_NOT_READY", c("industry_kind") != "NON_FINANCIAL"),
        ("DIVIDEND_HISTORY_LT_2Y", F.size("distribution_years") < 2),
        ("DIVIDEND_HISTORY_NOT_RECENT", late("dividend_lag")),
        ("COVERAGE_HISTORY_LT_2Y", F.size("coverage_years") < 2),
        ("COVERAGE_HISTORY_NOT_RECENT", late("coverage_lag")),
        ("CURRENT_PRICE_OR_FX_MISSING", c("price").isNull() | c("fx_to_base").isNull()),
        ("CURRENT_VALUATION_MISSING", c("valuation_basis") == "UNAVAILABLE"),
        ("BALANCE_SHEET_MINIMUM_MISSING", c("balance_basis") == "UNAVAILABLE"),
        ("CORE_SOURCE_CONFLICT", ~no("source_conflict")),
        ("SELECTED_INPUT_SOURCE_MISSING", ~no("source_missing")),
        ("SELECTED_INPUT_SOURCE_INVALID", ~no("source_invalid")),
        ("DATA_CONFIDENCE_LT_35", c("confidence") < 35),
    ]
    blockers = F.array_distinct(
        F.array_compact(F.concat(F.array(c("blocker")), F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(code)) for code, cond in rules])))
    )
    estimated = F.array_contains(F.coalesce("market_warnings", F.array().cast("array<string>")), "VENDOR_EQUIVALENT_SHARES_DEVIATION_2_TO_5PCT")
    proxy = (
        (c("coverage_basis") == "PROXY")
        | (c("balance_basis") == "PROXY")
        | (c("growth_basis") == "CONSERVATIVE_DEFAULT")
        | estimated
        | (c("qualitative_and_veto_coverage") == 0)
    )
    verified = (
        (c("confidence") >= 85)
        & (F.size("distribution_years") >= 5)
        & (c("dividend_lag") == 0)
        & (F.size("coverage_years") >= 4)
        & (c("coverage_lag") == 0)
        & (c("relative_difference") <= 0.02)
        & (c("balance_basis") == "DIRECT")
        & (c("valuation_basis") != "VENDOR_AUTHORIZED")
        & (c("qualitative_and_veto_coverage") == 10)
    )
    staged = df.withColumn("blockers", blockers)
    tier = (
        F.when(F.size("blockers") > 0, "BLOCKED")
        .when(F.coalesce(verified, F.lit(False)), "VERIFIED")
        .when((c("confidence") < 60) | F.coalesce(proxy, F.lit(False)), "ESTIMATED")
        .otherwise("CALCULABLE")
    )
    warnings = F.array_distinct(
        F.concat(
            c("plan_warnings"),
            c("confidence_caveats"),
            F.array_compact(F.array(F.when(c("freshness") == "STALE_LAST_GOOD", F.lit("STALE_LAST_GOOD")))),
        )
    )
    return staged.withColumns({"data_tier": tier, "assessment_warnings": warnings})


# ---- registry seeds ----


def staging_seed(companies: DataFrame, watch: DataFrame) -> DataFrame:
    """Empty staging rows from two masters; rows without a partner are flagged, not dropped."""
    w = watch.select("issuer_id", "security_id", "market", c("name").alias("_w"))
    j = companies.join(w, companies.company_id == w.issuer_id, "full_outer")
    return j.select(
        F.coalesce("company_id", "issuer_id").alias("company_id"),
        "security_id",
        F.when(c("market") == "CN", "A").when(c("market") == "HK", "H").otherwise("ORDINARY").alias("share_class"),
        F.lit("UNSUPPORTED").alias("industry_kind"),
        F.when(c("company_id").isNull(), "MASTER_MISSING").when(c("security_id").isNull(), "WATCH_LIST_MISSING").alias("seed_issue"),
    )


def registry_seed(watch: DataFrame, structures: DataFrame, evidence: DataFrame) -> DataFrame:
    """Capital-structure rows: default by market, configured structure, then share evidence with its authorisation.

    ``structures``: company_id, structure_kind, classes, rights_equal; ``evidence``: company_id, shares,
    implied, difference, rights_unresolved, as_of_date.
    """
    s = structures.select("company_id", c("structure_kind").alias("_k"), c("classes").alias("_cl"), c("rights_equal").alias("_r"))
    j = watch.join(s, "company_id", "left").join(evidence, "company_id", "left")
    ready = c("difference").isNotNull() & ~F.coalesce(c("rights_unresolved"), F.lit(False))
    vendor = F.coalesce(ready & (c("difference") <= 0.02), F.lit(False))
    return j.select(
        "company_id",
        c("security_id").alias("selected_security_id"),
        F.coalesce("_k", F.lit("SINGLE_CLASS")).alias("structure_kind"),
        F.coalesce("_cl", F.when(c("market") == "CN", F.array(F.lit("A"))).otherwise(F.array(F.lit("H")))).alias("material_share_classes"),
        F.when(c("_k").isNull(), F.lit(True)).otherwise(c("_r")).alias("distribution_rights_equal"),
        F.lit(1.0).alias("selected_security_rights_factor"),
        F.when(vendor & (c("_k") == "A_H"), "VENDOR_SELECTED_SECURITY_EQUIVALENT_VALUE")
        .when(vendor, "VENDOR_COMPANY_MARKET_VALUE")
        .otherwise("UNRESOLVED")
        .alias("vendor_semantics"),
        vendor.alias("vendor_value_authorized"),
        F.coalesce(ready, F.lit(False)).alias("direct_equivalent_shares_authorized"),
        c("shares").alias("official_equivalent_shares"),
        c("difference").alias("observed_relative_difference"),
        "as_of_date",
        F.when(
            c("difference") > 0.05, "VENDOR_SHARES_DIFFER_MORE_THAN_5PCT"
        ).when(c("rights_unresolved"), "RIGHTS_EQUIVALENCE_UNRESOLVED").alias("note"),
    )
