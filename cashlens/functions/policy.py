"""Versioned screening policy: the numbers every score and trigger is built from.

Fixed values: they must equal the published policy for results to match.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

POLICY_VERSION = "screen-policy-2.2"

THRESHOLDS = {
    "cash_anchor_yield": 0.04,
    "observation_exit_yield": 0.035,
    "observation_exit_trading_days": 5,
    "price_trigger_cooldown_days": 7,
    "company_analysis_cooldown_days": 30,
    "periodic_refresh_days": 90,
    "high_risk_refresh_days": 30,
    "material_ssy_absolute": 0.005,
    "material_ssy_relative": 0.15,
    "material_h_relative": 0.15,
    "material_s_relative": 0.15,
    "material_cr10_absolute": 0.0075,
    "material_score_absolute": 10.0,
    "material_coverage_absolute": 0.25,
    "material_net_debt_ebitda": 0.5,
    "ordinary_dividend_decline_veto": 0.30,
    "one_off_distribution_share_veto": 0.30,
    "fcf_overdistribution_ratio": 1.25,
}

# (minimum years, maximum years, score cap, may be recommended)
HISTORY_CAPS = [(0, 2, 50.0, False), (3, 4, 65.0, True), (5, 7, 80.0, True), (8, 100, 100.0, True)]

WEIGHTS = {
    "payout_quality": {"coverage": 0.40, "recent_trend": 0.25, "history_stability": 0.20, "balance_sheet": 0.15},
    "payout_quality_legacy": {
        "coverage": 0.30,
        "recent_trend": 0.20,
        "history_stability": 0.15,
        "balance_sheet": 0.15,
        "buyback_quality": 0.10,
        "data_completeness": 0.10,
    },
    "recommendation": {
        "return_score": 0.45,
        "payout_quality": 0.30,
        "business_durability": 0.15,
        "governance_capital_allocation": 0.10,
    },
    "entry_risk": {
        "distribution_deterioration": 0.20,
        "coverage": 0.20,
        "balance_sheet": 0.15,
        "structural_cycle": 0.15,
        "policy_asset_life": 0.10,
        "valuation": 0.10,
        "governance": 0.10,
    },
    "entry_risk_legacy": {
        "distribution_deterioration": 0.20,
        "coverage": 0.20,
        "balance_sheet": 0.15,
        "structural_cycle": 0.15,
        "policy_asset_life": 0.10,
        "valuation_trap": 0.10,
        "governance": 0.05,
        "data_quality": 0.05,
    },
}

COVERAGE_KNOTS = [(0, 0), (0.50, 20), (0.80, 45), (1.00, 70), (1.20, 85), (1.50, 100)]
RETURN_KNOTS = [(0, 0), (0.01, 20), (0.02, 40), (0.03, 60), (0.04, 75), (0.05, 88), (0.06, 100)]

FORMULA = {
    "recent_two_year_weights": (0.65, 0.35),
    "history_8_plus_weights": (0.65, 0.25, 0.10),
    "history_8_plus_median_cap": 1.10,
    "history_8_plus_ten_year_cap": 1.20,
    "history_5_7_weights": (0.70, 0.30),
    "history_5_7_median_cap": 1.10,
    "winsorize_minimum_years": 8,
    "fcf_capacity_haircut": 0.90,
    "simplified_fcf_capacity_haircut": 0.85,
    "growth_positive_cap_5y": 0.03,
    "growth_positive_cap_3_4y": 0.02,
    "growth_positive_cap_2y": 0.0,
    "organic_growth_floor": -0.08,
    "organic_growth_ceiling": 0.06,
    "positive_growth_confirmation": 0.50,
    "positive_growth_contribution_cap": 0.03,
    "valuation_compression_years": 10,
    "return_score_center": 50.0,
    "return_score_cr10_center": 0.04,
    "return_score_points_per_1pct": 25.0,
    "incomplete_recommendation_cap": 60.0,
}

RISK_UPLIFTS = {
    "unknown_veto": 5.0,
    "triggered_warning_each": 2.0,
    "triggered_warning_cap": 10.0,
    "unknown_qualitative_default": 60.0,
    "current_only_valuation_default": 60.0,
}
RECOMMENDATION_DEFAULTS = {"missing_business_durability": 50.0, "missing_governance_capital_allocation": 50.0}

# (minimum reduction years, factor)
BUYBACK_PERSISTENCE = [(4, 1.0), (2, 0.7), (1, 0.4), (0, 0.0)]
BUYBACK_QUALITY = {1.0: 100.0, 0.7: 80.0, 0.4: 60.0}
BUYBACK_QUALITY_NONE = 70.0
BUYBACK_QUALITY_FAILED = 0.0

# (minimum ratio, score, only without an obvious decline)
RECENT_TREND = [(1.10, 100.0, True), (0.95, 85.0, False), (0.80, 60.0, False), (0.50, 25.0, False), (0.0, 0.0, False)]
RECENT_TREND_DECLINE_RATIO = 0.70
RECENT_TREND_DECLINE_SCORE = 60.0

STABILITY_SCORES = {"excellent": 100.0, "good": 80.0, "acceptable": 55.0, "otherwise": 20.0}
STABILITY_LIMITS = {"excellent_cv": 0.15, "good_cv": 0.30, "acceptable_cv": 0.50, "acceptable_interruptions": 1}

BANK_MINIMUM_BUFFER = 0.01
INSURANCE_MINIMUM_BUFFER = 0.20

CLASS_BANDS = {"A": (80.0, 30.0), "B": (65.0, 45.0), "D": (50.0, 60.0)}

TOLERANCES = {"relative": 0.02, "absolute": 1.0, "share_count_relative": 0.005, "stale_quote_hours": 24}

OPPORTUNITY = {
    "weights": {"dividend_yield": 0.40, "valuation": 0.35, "five_year_price_position": 0.25},
    "dividend_yield_pct": [(0, 0), (1, 20), (2, 40), (3, 60), (4, 80), (5, 100)],
    "earnings_yield_pct": [(0, 0), (2, 20), (4, 50), (6, 75), (8, 100)],
    "pb_fallback": [(0.5, 100), (1, 80), (1.5, 60), (2, 40), (3, 20), (5, 0)],
    "pb_financial": [(0.5, 100), (0.8, 85), (1, 70), (1.5, 40), (2, 20), (3, 0)],
    "history_years": 5,
    "minimum_weekly_points": 52,
}

RESILIENCE = {
    "maximum_fiscal_years": 5,
    "full_evidence_years": 3,
    "weights": {
        "NON_FINANCIAL": {
            "net_profit_quality": 0.25,
            "operating_cash_flow_quality": 0.25,
            "simplified_fcf_quality": 0.25,
            "balance_sheet_resilience": 0.25,
        },
        "FINANCIAL": {
            "net_profit_quality": 0.30,
            "roe_quality": 0.30,
            "equity_growth": 0.25,
            "capital_or_asset_quality": 0.15,
        },
    },
    "trend": [(-0.20, 0), (-0.10, 25), (0, 50), (0.10, 75), (0.20, 100)],
    "net_debt_to_equity": [(0.30, 85), (0.60, 70), (1.00, 50)],
    "net_debt_above": 20.0,
    "liabilities_to_assets": [(0.40, 80), (0.60, 60), (0.75, 40)],
    "liabilities_above": 20.0,
    "roe_level_pct": [(0, 0), (5, 30), (8, 55), (12, 80), (15, 100)],
    "equity_growth": [(-0.05, 0), (0, 50), (0.05, 75), (0.10, 100)],
}

FINANCIAL_KEYWORDS = ("银行", "保险", "证券", "多元金融")

TRIGGERS = {
    "opportunity_high_min": 75.0,
    "opportunity_combined_min": 65.0,
    "resilience_combined_min": 60.0,
    "dividend_yield_pct_min": 4.0,
}
MATERIAL_EVENT_CODES = (
    "DIVIDEND_CANCELLED_OR_CUT",
    "PROFIT_WARNING",
    "AUDIT_OR_INTERNAL_CONTROL_ALERT",
    "MAJOR_BUYBACK_OR_CAPITAL_CHANGE",
    "MAJOR_MA",
    "MAJOR_CAPEX",
    "ASSET_SALE",
    "MAJOR_REGULATORY_PENALTY",
    "INDUSTRY_POLICY_CHANGE",
    "SOURCE_CONFLICT",
)

REVIEW_RUBRIC = {
    "business_durability": {
        "dimensions": (
            "demand_resilience",
            "competitive_position",
            "substitution_and_asset_life",
            "capital_intensity_and_cash_conversion",
        ),
        "red_flag_cap": 49,
        "red_flags": (
            "STRUCTURAL_DEMAND_DECLINE",
            "CORE_ASSET_EXPIRY_WITHIN_10Y",
            "TECHNOLOGY_SUBSTITUTION_UNMITIGATED",
        ),
    },
    "governance_capital_allocation": {
        "dimensions": (
            "shareholder_alignment",
            "capital_allocation_discipline",
            "disclosure_and_internal_controls",
            "related_party_and_minority_protection",
        ),
        "red_flag_cap": 39,
        "red_flags": (
            "AUDIT_OR_INTERNAL_CONTROL_MAJOR_DEFECT",
            "CONTROLLING_SHAREHOLDER_MISAPPROPRIATION",
            "MATERIAL_RELATED_PARTY_CONFLICT",
            "REPEATED_VALUE_DESTRUCTIVE_ALLOCATION",
        ),
    },
}
REVIEW_MAX_VALIDITY_DAYS = 365

# v1 watch list
SECTOR_HEAT_WEIGHTS = {
    "return1dPct": 0.20,
    "return5dPct": 0.30,
    "return20dPct": 0.30,
    "advancers5dPct": 0.10,
    "aboveMa20Pct": 0.10,
}
VALUATION_LABEL_SCORES = {
    "deeply_attractive": 10.0,
    "deeply-undervalued": 10.0,
    "深度低估": 10.0,
    "attractive": 8.0,
    "undervalued": 8.0,
    "低估": 8.0,
    "fair": 5.0,
    "合理": 5.0,
    "expensive": 1.0,
    "overvalued": 1.0,
    "高估": 1.0,
}
HEAT_LABELS = [(80, "偏热"), (60, "升温"), (40, "中性"), (20, "降温")]
HEAT_LABEL_LOWEST = "偏冷"
SNAPSHOT_METRICS = (
    "pe",
    "peTtm",
    "pb",
    "dividendYieldTtmPct",
    "totalMarketValue",
    "earningsPerShare",
    "bookValuePerShare",
)
TARGETS = (("watch", "关注价", 0.03), ("preferred", "理想价", 0.04), ("deep", "深度价值价", 0.05))


REQUIRED_SECTIONS = {
    "policy_version": str,
    "thresholds": Mapping,
    "opportunity": Mapping,
    "resilience": Mapping,
    "triggers": Mapping,
}


def current_policy() -> dict[str, Any]:
    """The policy as one document, for storage next to a release."""
    return {
        "policy_version": POLICY_VERSION,
        "thresholds": dict(THRESHOLDS),
        "opportunity": dict(OPPORTUNITY),
        "resilience": dict(RESILIENCE),
        "triggers": dict(TRIGGERS) | {"material_event_codes": list(MATERIAL_EVENT_CODES)},
    }


def check_policy(document: Mapping[str, Any], expected_version: str = POLICY_VERSION) -> dict[str, Any]:
    """Accept a policy document only with the expected version and exactly the known sections."""
    unknown = sorted(set(document) - set(REQUIRED_SECTIONS))
    missing = sorted(set(REQUIRED_SECTIONS) - set(document))
    if unknown or missing:
        raise ValueError(f"policy sections unknown={unknown} missing={missing}")
    for key, kind in REQUIRED_SECTIONS.items():
        if not isinstance(document[key], kind):
            raise ValueError(f"policy section {key} has the wrong type")
    if document["policy_version"] != expected_version:
        raise ValueError(f"policy version {document['policy_version']} is not {expected_version}")
    return dict(document)
