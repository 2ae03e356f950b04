"""Queries over the composed trigger decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashlens.operators import legacy_triggers as L
from cashlens.operators import triggers as T
from cashlens.plans import events  # noqa: F401 - its SQL parts
from cashlens.plans.registry import query
from cashlens.plans.sqlparts import part, with_parts
from cashlens.sources import domain as D

c = F.col
START = "2024-01-01 00:00:00"
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def stretched(at):
    """The events cover 30 days; twelve times as slow, the 30 and 90 day rules come into play."""
    start = F.unix_micros(F.lit(START).cast("timestamp"))
    return F.timestamp_micros(start + (F.unix_micros(at) - start) * 12)


def legacy_runs(spark, sf):
    """Company runs with everything the legacy decision looks at, and the newest success before each."""
    has = lambda kind: F.array_contains("kinds", kind)
    one = lambda cond, code: F.when(cond, F.lit(code))
    version = lambda at: F.when(at < F.lit("2024-06-01").cast("timestamp"), "risk-review-v1.0.0").otherwise("risk-review-v2.0.0")
    tier = F.when(c("eri") < 1, "BLOCKED").when(has("view"), "VERIFIED").when(has("click"), "ESTIMATED")
    status = F.when(has("view"), "FULLY_VALID").otherwise("CORE_VALID_QUALITATIVE_OVERLAY_PENDING")
    missing = F.when(has("purchase"), F.array(F.lit("business_durability"))).otherwise(F.array(F.lit("balance_sheet")))
    at = stretched(c("run_at"))
    runs = D.company_runs(spark, sf).select(
        "company_id",
        at.alias("run_at"),
        at.cast("date").alias("trade_date"),
        L.legacy_eligible(tier, F.when(has("purchase"), "PARTIAL").otherwise("VALID"), c("raw_yield") >= 0.002, status, missing).alias("eligible"),
        *["ssy", "raw_yield", "h", "eri", "coverage"],
        (c("raw_yield") * 100).alias("s"),
        (c("ssy") / 4).alias("cr10"),
        (c("coverage") * 10).alias("ri"),
        (c("raw_yield") * 4).alias("net_debt_ebitda"),
        F.array_compact(F.array(one(has("error") & (c("raw_yield") >= 0.06), "AUDIT_GOVERNANCE_ALERT"), one(has("signup"), "MINOR_NOTE"))).alias("veto_codes"),
        F.array_compact(F.array(one(c("raw_yield") >= 0.2, "PROFIT_WARNING"), one(has("signup") & (c("raw_yield") >= 0.25), "MAJOR_REGULATORY_PENALTY"))).alias("event_codes"),
        version(at).alias("current_prompt_version"),
        (F.size("kinds") >= 3).alias("prompt_major_upgrade"),
        (c("eri") > 150).alias("prior_baseline_invalid"),
    )
    done = D.table(spark, sf, "events").where((c("event_type") == "purchase") & (c("value") > 100))
    done = done.select(c("user_id").alias("company_id"), stretched(c("ts").cast("timestamp")).alias("at"))
    return L.with_success(runs, done.withColumn("version", version(c("at"))))


def successes(spark, sf):
    done = D.table(spark, sf, "events").where((c("event_type") == "purchase") & (c("value") > 100))
    return done.select(c("user_id").alias("company_id"), stretched(c("ts").cast("timestamp")).alias("at"), F.lit("1").alias("version"))


def late(x: str) -> str:
    return f"TIMESTAMP '{START}' + 12 * ({x} - TIMESTAMP '{START}')"


def sql_version(t_at: str) -> str:
    return f"CASE WHEN {t_at} < TIMESTAMP '2024-06-01' THEN 1 ELSE 2 END"


URGENT = "['" + "', '".join(L.URGENT_CODES) + "']"
MATERIAL = "['" + "', '".join(L.MATERIAL_EVENT_TYPES) + "']"

part("legacy_success", f"SELECT user_id AS company_id, {late('ts')} AS t_at FROM events WHERE event_type = 'purchase' AND value > 100")
part(
    "legacy_run",
    f"""
SELECT *, CAST(t_at AS DATE) AS trade_date, (SELECT max(s.t_at) FROM legacy_success s WHERE s.company_id = r.company_id AND s.t_at <= r.t_at) AS success,
  {sql_version('t_at')} AS prompt, lag(ssy) OVER w AS p_ssy, lag(h) OVER w AS p_h, lag(s) OVER w AS p_s, lag(cr10) OVER w AS p_cr10,
  lag(coverage) OVER w AS p_coverage, lag(ri) OVER w AS p_ri, lag(eri) OVER w AS p_eri, lag(nd) OVER w AS p_nd, lag(veto) OVER w AS p_veto,
  row_number() OVER w AS rn
FROM (SELECT company_id, {late('run_at')} AS t_at, CAST(ssy AS DECIMAL(24,8)) AS ssy, CAST(raw_yield AS DECIMAL(24,8)) AS raw, CAST(h AS DECIMAL(24,8)) AS h,
    CAST(eri AS DECIMAL(24,8)) AS eri, CAST(coverage AS DECIMAL(24,8)) AS coverage, CAST(raw_yield * 100 AS DECIMAL(24,8)) AS s,
    CAST(ssy / 4 AS DECIMAL(24,8)) AS cr10, CAST(coverage * 10 AS DECIMAL(24,8)) AS ri, CAST(raw_yield * 4 AS DECIMAL(24,8)) AS nd,
    CASE WHEN eri < 1 THEN false WHEN list_contains(kinds, 'view') OR list_contains(kinds, 'click') THEN raw_yield >= 0.002
      WHEN list_contains(kinds, 'purchase') THEN raw_yield >= 0.002 ELSE true END AS eligible,
    list_filter([CASE WHEN list_contains(kinds, 'error') AND raw_yield >= 0.06 THEN 'AUDIT_GOVERNANCE_ALERT' END, CASE WHEN list_contains(kinds, 'signup') THEN 'MINOR_NOTE' END], lambda x: x IS NOT NULL) AS veto,
    list_filter([CASE WHEN raw_yield >= 0.2 THEN 'PROFIT_WARNING' END, CASE WHEN list_contains(kinds, 'signup') AND raw_yield >= 0.25 THEN 'MAJOR_REGULATORY_PENALTY' END], lambda x: x IS NOT NULL) AS codes,
    len(kinds) >= 3 AS upgrade, eri > 150 AS invalid FROM run) r
WINDOW w AS (PARTITION BY company_id ORDER BY t_at)""",
    "run",
    "legacy_success",
)
part(
    "legacy_fact",
    f"""
SELECT *, coalesce(t_at < success + INTERVAL 30 DAY, false) AS cooling,
  list_aggregate(list_filter(list_concat(list_filter(veto, lambda x: success IS NULL OR NOT list_contains(coalesce(p_veto, []), x)), codes), lambda x: list_contains({URGENT}, x)), 'min') AS urgent,
  list_aggregate(list_filter(codes, lambda x: list_contains({MATERIAL}, x)), 'min') AS event,
  list_filter([CASE WHEN abs(ssy - p_ssy) >= 0.005 THEN 'SSY_ABSOLUTE' END, CASE WHEN p_ssy <> 0 AND abs(ssy - p_ssy) >= 0.15 * abs(p_ssy) THEN 'SSY_RELATIVE' END,
    CASE WHEN abs(cr10 - p_cr10) >= 0.0075 THEN 'CR10_ABSOLUTE' END, CASE WHEN abs(ri - p_ri) >= 10 THEN 'RI_POINTS' END], lambda x: x IS NOT NULL) AS price_reasons,
  list_filter([CASE WHEN p_h <> 0 AND abs(h - p_h) >= 0.15 * abs(p_h) THEN 'H_RELATIVE' END, CASE WHEN p_s <> 0 AND abs(s - p_s) >= 0.15 * abs(p_s) THEN 'S_RELATIVE' END,
    CASE WHEN abs(eri - p_eri) >= 10 THEN 'ERI_POINTS' END, CASE WHEN (coverage >= 1 AND p_coverage < 1) OR (p_coverage >= 1 AND coverage < 1) THEN 'COVERAGE_CROSSED_ONE' END,
    CASE WHEN abs(coverage - p_coverage) >= 0.25 THEN 'COVERAGE_ABSOLUTE' END, CASE WHEN nd - p_nd >= 0.5 THEN 'NET_DEBT_EBITDA' END], lambda x: x IS NOT NULL) AS other_reasons,
  coalesce(t_at >= success + INTERVAL 1 DAY * (CASE WHEN eri > 45 OR len(veto) > 0 THEN 30 ELSE 90 END), false) AS due
FROM legacy_run""",
    "legacy_run",
)

STEP = f"""
SELECT company_id, rn, zone, n, low_day, CASE WHEN sets THEN t_at ELSE price END AS price, t_at, mode,
  CASE mode WHEN 'URGENT_VETO_REVIEW' THEN urgent WHEN 'MATERIAL_CHANGE_REVIEW' THEN coalesce(event, 'MATERIAL_METRIC_CHANGE') ELSE mode END AS kind,
  CASE mode WHEN 'URGENT_VETO_REVIEW' THEN urgent WHEN 'FULL_ENTRY_REVIEW' THEN reason WHEN 'MATERIAL_CHANGE_REVIEW' THEN array_to_string(list_concat(changes, CASE WHEN event IS NULL THEN [] ELSE [event] END), ',') ELSE '' END AS reasons,
  CASE WHEN mode IS NOT NULL THEN NULL WHEN NOT eligible THEN 'NOT_ELIGIBLE' WHEN cooling THEN 'COMPANY_COOLDOWN' WHEN zone AND len(changes) > 0 THEN 'PRICE_COOLDOWN' ELSE 'NOTHING_NEW' END AS held
FROM (SELECT *, CASE WHEN NOT eligible THEN NULL WHEN urgent IS NOT NULL THEN 'URGENT_VETO_REVIEW' WHEN goes THEN 'FULL_ENTRY_REVIEW'
    WHEN moves THEN 'MATERIAL_CHANGE_REVIEW' WHEN zone AND due AND NOT cooling THEN 'PERIODIC_REFRESH' END AS mode,
    eligible AND urgent IS NULL AND (goes OR (moves AND only_price)) AS sets
  FROM (SELECT *, reason IS NOT NULL AND NOT cooling AND (clock_open OR upgrade OR invalid) AS goes,
      zone AND (len(changes) > 0 OR event IS NOT NULL) AND NOT cooling AND (clock_open OR NOT only_price) AS moves
    FROM (SELECT f.* EXCLUDE (price_reasons, other_reasons), z.zone, z.n, z.low_day, w.price, list_concat(price_reasons, other_reasons) AS changes, len(other_reasons) = 0 AND event IS NULL AS only_price,
        w.price IS NULL OR f.t_at >= w.price + INTERVAL 7 DAY AS clock_open,
        CASE WHEN ssy >= 0.04 AND (p_ssy IS NULL OR p_ssy < 0.04) THEN 'ENTERED_ZONE' WHEN raw >= 0.04 AND ssy < 0.04 THEN 'YIELD_TRAP' WHEN z.zone AND success IS NULL THEN 'NO_LEGAL_REPORT'
          WHEN upgrade OR prompt <> {sql_version('success')} AND success IS NOT NULL THEN 'PROMPT_MAJOR_UPGRADE' WHEN invalid THEN 'BASELINE_INVALID' END AS reason
      FROM walk w JOIN legacy_fact f ON f.company_id = w.company_id AND f.rn = w.rn + 1,
      LATERAL (SELECT CASE WHEN NOT f.eligible THEN 0 WHEN ssy >= 0.04 OR raw >= 0.04 THEN 1 WHEN w.zone AND ssy < 0.035 AND raw < 0.035 THEN 2 ELSE 0 END AS act) a,
      LATERAL (SELECT CASE WHEN act = 2 AND w.low_day IS DISTINCT FROM f.trade_date THEN w.n + 1 ELSE w.n END AS m) b,
      LATERAL (SELECT CASE act WHEN 1 THEN true WHEN 2 THEN m < 5 ELSE w.zone END AS zone, CASE act WHEN 1 THEN 0 WHEN 2 THEN CASE WHEN m < 5 THEN m ELSE 0 END ELSE w.n END AS n,
        CASE act WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN m < 5 THEN f.trade_date END ELSE w.low_day END AS low_day) z)))"""

LEGACY_SQL = (
    "WITH RECURSIVE "
    + with_parts("legacy_fact", "")[len("WITH ") :].rstrip()
    + f""",
walk AS (
SELECT DISTINCT company_id, CAST(0 AS BIGINT) AS rn, false AS zone, 0 AS n, CAST(NULL AS DATE) AS low_day, CAST(NULL AS TIMESTAMP) AS price, CAST(NULL AS TIMESTAMP) AS t_at,
  CAST(NULL AS VARCHAR) AS mode, CAST(NULL AS VARCHAR) AS kind, '' AS reasons, CAST(NULL AS VARCHAR) AS held FROM legacy_run
UNION ALL {STEP})
SELECT company_id, strftime(t_at, '%Y-%m-%d %H:%M:%S.%f') AS run_at, mode IS NOT NULL AS fires, mode, kind AS trigger_type, reasons, held AS held_by, zone AS in_zone,
  strftime(price, '%Y-%m-%d %H:%M:%S.%f') AS last_price_trigger_at FROM walk WHERE rn > 0"""
)


@query("legacy_trigger_decisions", LEGACY_SQL)
def legacy_trigger_decisions(spark, sf):
    rows = L.legacy_decisions(legacy_runs(spark, sf))
    return rows.withColumns(
        {
            "run_at": F.date_format("run_at", STAMP),
            "last_price_trigger_at": F.date_format("last_price_trigger_at", STAMP),
            "reasons": F.array_join("reasons", ","),
        }
    )


# ---------------------------------------------------------------- screening decisions

SCREEN_STEP = f"""
SELECT company_id, rn, at_, CASE WHEN urgent THEN true WHEN eligible THEN eligible ELSE zone END AS zone, CASE WHEN goes THEN at_ ELSE price END AS price, done OR (goes AND first) AS done,
  urgent OR goes AS fires, CASE WHEN urgent THEN 'URGENT_RISK_REVIEW' WHEN goes THEN 'PRICE_RISK_ANALYSIS' END AS mode, CASE WHEN urgent THEN 'PROFIT_WARNING' WHEN goes AND first THEN 'INITIAL_TRIGGER_BACKLOG' WHEN goes THEN kind END AS trigger_type
FROM (SELECT *, NOT urgent AND eligible AND CASE WHEN first OR kind IN ('DIVIDEND_YIELD_TTM', 'COMBINED_SCREEN') THEN price IS NULL OR at_ >= price + INTERVAL 7 DAY ELSE coalesce(at_ >= success + INTERVAL 30 DAY, true) END AS goes
  FROM (SELECT s.*, w.zone, w.price, w.done, s.success IS NULL AND NOT w.done AS first FROM walk w JOIN screen_run s ON s.company_id = w.company_id AND s.rn = w.rn + 1))"""

part(
    "screen_run",
    f"""
SELECT *, (SELECT max(s.t_at) FROM legacy_success s WHERE s.company_id = r.company_id AND s.t_at <= r.at_) AS success, row_number() OVER (PARTITION BY company_id ORDER BY at_) AS rn
FROM (SELECT company_id, {late('run_at')} AS at_, eri > 200 AS urgent, raw_yield >= 0.04 AS eligible,
  CASE WHEN list_contains(kinds, 'signup') THEN 'FUNDAMENTAL_CHANGE' WHEN ssy >= 0.04 THEN 'DIVIDEND_YIELD_TTM' ELSE 'COMBINED_SCREEN' END AS kind FROM run) r""",
    "run",
    "legacy_success",
)
SCREEN_SQL = (
    "WITH RECURSIVE "
    + with_parts("screen_run", "")[len("WITH ") :].rstrip()
    + f""",
walk AS (
SELECT DISTINCT company_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS TIMESTAMP) AS at_, false AS zone, CAST(NULL AS TIMESTAMP) AS price, false AS done, false AS fires, CAST(NULL AS VARCHAR) AS mode, CAST(NULL AS VARCHAR) AS trigger_type FROM screen_run
UNION ALL {SCREEN_STEP})
SELECT company_id, strftime(at_, '%Y-%m-%d %H:%M:%S.%f') AS run_at, fires, mode, trigger_type, zone AS in_zone FROM walk WHERE rn > 0"""
)


@query("trigger_decisions", SCREEN_SQL)
def trigger_decisions(spark, sf):
    runs = D.company_runs(spark, sf).select(
        "company_id",
        stretched(c("run_at")).alias("run_at"),
        F.when(c("eri") > 200, F.array(F.lit("PROFIT_WARNING"))).otherwise(F.array().cast("array<string>")).alias("event_codes"),
        (c("raw_yield") >= 0.04).alias("eligible"),
        (c("raw_yield") >= 0.04).alias("in_observation_zone"),
        F.when(F.array_contains("kinds", "signup"), "FUNDAMENTAL_CHANGE").when(c("ssy") >= 0.04, "DIVIDEND_YIELD_TTM").otherwise("COMBINED_SCREEN").alias("trigger_type"),
    )
    rows = T.screening_decisions(L.with_success(runs, successes(spark, sf)))
    return rows.withColumn("run_at", F.date_format("run_at", STAMP))
