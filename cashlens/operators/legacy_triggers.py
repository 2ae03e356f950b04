"""Legacy trigger decisions: one decision per run from the zone, the price clock, cooldowns, changes and refresh.

The reference form is a state machine that walks the runs of a company. Here its two states are composed maps, so that no
company is a single fold:

* the zone with its count of low days is a map per trading day (did a run enter, was a run low behind the last entry).
  Maps of the days before a day compose by running sums over days, which the calendar bounds; inside a day a run only
  asks whether the first entry or the first low run came before it.
* the price clock is a map from a firing to the next one: the first run that asks at least seven days later, unless a run
  that fires whatever the clock says comes between. Those maps compose with themselves by doubling: after k rounds of
  joins on (company, time) all firings among the first 2**k of a chain are known.

Runs of a company at one time are one run: the one with the largest columns, in their order. Rows without a company or a
time make no decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashlens.functions import policy as P
from cashlens.operators.clock import clock_firings
from cashlens.operators.scale import lag_in_buckets, running_in_buckets
from cashlens.operators.triggers import MATERIAL_EVENT_TYPES, URGENT_CODES
from cashlens.session import cut_lineage

c = F.col
T = P.THRESHOLDS
KEY = ["company_id"]

# Fixed values.
ELIGIBLE_STATUS = ("FULLY_VALID", "CORE_VALID_QUALITATIVE_OVERLAY_PENDING")
PUBLISHED_TIERS = ("ESTIMATED", "CALCULABLE", "VERIFIED")
OVERLAY_SCORES = ("business_durability", "governance_capital_allocation")
PROMPT_VERSION = r"^risk-review-v(\d+)\.\d+\.\d+$"

METRICS = ("ssy", "raw_yield", "h", "s", "cr10", "coverage", "ri", "eri", "net_debt_ebitda")
DEFAULTS = {
    **{x: "decimal(24,8)" for x in METRICS},
    "eligible": "boolean",
    "has_report": "boolean",
    "last_success_at": "timestamp",
    "last_prompt_version": "string",
    "current_prompt_version": "string",
    "prompt_major_upgrade": "boolean",
    "prior_baseline_invalid": "boolean",
    "veto_codes": "array<string>",
    "event_codes": "array<string>",
}


def yes(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def days(name: str) -> Column:
    return F.make_dt_interval(F.lit(T[name]))


def legacy_eligible(tier: Column, data_status: Column, eligible: Column, status: Column, missing: Column) -> Column:
    """Only a published numeric core is judged; a blocked one never, a partial one with nothing but overlay scores missing."""
    overlay = yes(eligible) & yes(status == ELIGIBLE_STATUS[1]) & yes(F.size(missing) > 0)
    overlay &= yes(F.size(F.array_except(missing, F.array(*[F.lit(x) for x in OVERLAY_SCORES]))) == 0)
    published = yes(eligible) & yes(status.isin(*ELIGIBLE_STATUS))
    return (
        F.when(yes(tier == "BLOCKED"), False)
        .when(yes(tier.isin(*PUBLISHED_TIERS)), published)
        .when(yes(data_status == "VALID"), True)
        .otherwise(yes(data_status == "PARTIAL") & overlay)
    )


def major_prompt_change(previous: Column, current: Column) -> Column:
    """Both are versions of the review prompt, with different major numbers."""
    old, new = (F.regexp_extract(F.coalesce(x, F.lit("")), PROMPT_VERSION, 1) for x in (previous, current))
    return (old != "") & (new != "") & (old != new)


def with_success(runs: DataFrame, successes: DataFrame, bucket: str = "hour") -> DataFrame:
    """Adds has_report, last_success_at and last_prompt_version: the newest success (company_id, at, version) up to each run."""
    rest = [x for x in runs.columns if x not in ("company_id", "run_at")]
    left = runs.select("company_id", c("run_at").alias("_at"), F.lit(1).alias("_kind"), F.struct(*rest).alias("_row"), F.lit(None).cast("string").alias("version"))
    right = successes.select("company_id", c("at").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), c("version").cast("string"))
    newest = F.when(c("_kind") == 0, F.struct(c("_at").alias("at"), "version"))
    # a success at the time of a run counts for it
    both = running_in_buckets(left.unionByName(right), KEY, ["_at", "_kind"], F.date_trunc(bucket, "_at"), {"_newest": ("max", newest)})
    return both.where("_kind = 1").select(
        "company_id",
        c("_at").alias("run_at"),
        "_row.*",
        c("_newest").isNotNull().alias("has_report"),
        c("_newest.at").alias("last_success_at"),
        c("_newest.version").alias("last_prompt_version"),
    )


# ---------------------------------------------------------------- what a run says by itself


def prepared(runs: DataFrame) -> DataFrame:
    """The known columns in their types, missing ones null, one row per company and time."""
    named = runs.select(
        "company_id",
        c("run_at").cast("timestamp").alias("run_at"),
        (F.coalesce("trade_date", c("run_at").cast("date")) if "trade_date" in runs.columns else c("run_at").cast("date")).alias("trade_date"),
        *[(c(x).cast(t) if x in runs.columns else F.lit(None).cast(t)).alias(x) for x, t in DEFAULTS.items()],
    )
    rest = [x for x in named.columns if x not in ("company_id", "run_at")]
    named = named.where("company_id is not null and run_at is not null")
    return named.groupBy("company_id", "run_at").agg(F.max(F.struct(*rest)).alias("_row")).select("company_id", "run_at", "_row.*")


def with_previous(runs: DataFrame, bucket: str) -> DataFrame:
    """``p``: metrics and veto codes of the run before, null for the first."""
    staged = runs.withColumn("_snap", F.struct(*METRICS, "veto_codes"))
    return lag_in_buckets(staged, KEY, ["run_at"], F.date_trunc(bucket, "run_at"), "_snap", "p").drop("_snap")


def material_reasons() -> tuple[Column, Column]:
    """The codes of all material changes against ``p`` and the events, and whether one of them is not about the price."""
    now, then = (lambda x: c(x)), (lambda x: c(f"p.{x}"))
    moved = lambda x: F.abs(now(x) - then(x))
    share = lambda x, limit: (then(x) != 0) & (moved(x) >= F.lit(str(T[limit])).cast("decimal(10,6)") * F.abs(then(x)))
    least = lambda x, limit: moved(x) >= F.lit(str(T[limit])).cast("decimal(10,6)")
    crossed = ((now("coverage") >= 1) & (then("coverage") < 1)) | ((then("coverage") >= 1) & (now("coverage") < 1))
    price = [
        ("SSY_ABSOLUTE", least("ssy", "material_ssy_absolute")),
        ("SSY_RELATIVE", share("ssy", "material_ssy_relative")),
        ("CR10_ABSOLUTE", least("cr10", "material_cr10_absolute")),
        ("RI_POINTS", least("ri", "material_score_absolute")),
    ]
    other = [
        ("H_RELATIVE", share("h", "material_h_relative")),
        ("S_RELATIVE", share("s", "material_s_relative")),
        ("ERI_POINTS", least("eri", "material_score_absolute")),
        ("COVERAGE_CROSSED_ONE", crossed),
        ("COVERAGE_ABSOLUTE", least("coverage", "material_coverage_absolute")),
        ("NET_DEBT_EBITDA", now("net_debt_ebitda") - then("net_debt_ebitda") >= F.lit(str(T["material_net_debt_ebitda"])).cast("decimal(10,6)")),
    ]
    events = F.array_sort(F.array_intersect("_events", F.array(*[F.lit(x) for x in MATERIAL_EVENT_TYPES])))
    codes = F.array_compact(F.array(*[F.when(yes(rule), F.lit(code)) for code, rule in price + other]))
    beyond_price = F.size(events) > 0
    for _, rule in other:
        beyond_price |= yes(rule)
    return F.concat(codes, events), beyond_price


def facts(runs: DataFrame) -> DataFrame:
    """Per run, from its own row, the run before and its zone: the urgent code, reasons, cooldown and refresh."""
    none = F.array().cast("array<string>")
    urgent_codes = F.array(*[F.lit(x) for x in URGENT_CODES])
    staged = runs.withColumns({"_events": F.coalesce("event_codes", none), "_veto": F.coalesce("veto_codes", none), "_report": yes(c("has_report"))})
    fresh = F.when(c("_report"), F.array_except("_veto", F.coalesce("p.veto_codes", none))).otherwise(c("_veto"))
    reasons, beyond_price = material_reasons()
    anchor = F.lit(str(T["cash_anchor_yield"])).cast("decimal(10,6)")
    upgrade = yes(c("prompt_major_upgrade"))
    full = (
        F.when(yes((c("ssy") >= anchor) & (c("p.ssy").isNull() | (c("p.ssy") < anchor))), "ENTERED_ZONE")
        .when(yes((c("raw_yield") >= anchor) & (c("ssy") < anchor)), "YIELD_TRAP")
        .when(c("in_zone") & ~c("_report"), "NO_LEGAL_REPORT")
        .when(upgrade | major_prompt_change(c("last_prompt_version"), c("current_prompt_version")), "PROMPT_MAJOR_UPGRADE")
        .when(yes(c("prior_baseline_invalid")), "BASELINE_INVALID")
    )
    waited = lambda column: c("run_at") >= c("last_success_at") + column
    risky = yes(c("eri") > 45) | (F.size("_veto") > 0)
    due = yes(F.when(risky, waited(days("high_risk_refresh_days"))).otherwise(waited(days("periodic_refresh_days"))))
    return staged.select(
        "company_id",
        "run_at",
        yes(c("eligible")).alias("eligible"),
        "in_zone",
        F.array_min(F.array_intersect(F.array_union(fresh, "_events"), urgent_codes)).alias("urgent"),
        full.alias("full_reason"),
        (upgrade | yes(c("prior_baseline_invalid"))).alias("override"),
        reasons.alias("reasons"),
        beyond_price.alias("beyond_price"),
        F.array_min(F.array_intersect("_events", F.array(*[F.lit(x) for x in MATERIAL_EVENT_TYPES]))).alias("event"),
        yes(~waited(days("company_analysis_cooldown_days"))).alias("cooling"),
        (c("in_zone") & due).alias("refresh"),
    )


# ---------------------------------------------------------------- the zone, a map per day


def with_zone(runs: DataFrame) -> DataFrame:
    """``in_zone`` behind each run; runs that are not eligible leave the zone as it is."""
    anchor, exit_ = (F.lit(str(T[x])).cast("decimal(10,6)") for x in ("cash_anchor_yield", "observation_exit_yield"))
    enters = yes(c("eligible")) & (yes(c("ssy") >= anchor) | yes(c("raw_yield") >= anchor))
    low = yes(c("eligible")) & yes((c("ssy") < exit_) & (c("raw_yield") < exit_))
    entered, lowered = F.when(enters, c("run_at")), F.when(low, c("run_at"))
    maps = runs.groupBy("company_id", "trade_date").agg(
        F.min(entered).alias("_entry"), F.max(entered).alias("_last_entry"), F.min(lowered).alias("_low"), F.max(lowered).alias("_last_low")
    )
    # the low days that a day adds: to the count before it, or from zero behind its last entry
    adds = F.when(c("_entry").isNull(), c("_low").isNotNull()).otherwise(yes(c("_last_low") > c("_last_entry"))).cast("int")
    before = Window.partitionBy("company_id").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    counted = maps.withColumn("_count", F.coalesce(F.sum(adds).over(before), F.lit(0)))
    base = F.last(F.when(c("_entry").isNotNull(), c("_count")), ignorenulls=True).over(before)
    starts = counted.withColumn("_days", c("_count") - base).select("company_id", "trade_date", "_entry", "_low", "_days")
    joined = runs.join(starts, ["company_id", "trade_date"])
    low_days = c("_days") + yes(c("run_at") >= c("_low")).cast("int")
    inside = yes(c("run_at") >= c("_entry")) | yes(low_days < T["observation_exit_trading_days"])
    return joined.withColumn("in_zone", inside).drop("_entry", "_low", "_days")


# ---------------------------------------------------------------- the decision


def legacy_decisions(runs: DataFrame, bucket: str = "hour") -> DataFrame:
    """company_id, run_at, fires, mode, trigger_type, reasons, held_by, in_zone and last_price_trigger_at of every run.

    ``runs`` has company_id, run_at and any of ``DEFAULTS`` and trade_date, which must not go back as run_at goes on.
    ``bucket`` is the time in which the runs of one company may be sorted together.
    """
    known = cut_lineage(facts(with_zone(with_previous(prepared(runs), bucket))))
    plain = c("eligible") & c("urgent").isNull() & ~c("cooling")
    full = plain & c("full_reason").isNotNull()
    material = plain & c("in_zone") & (F.size("reasons") > 0)
    always = full & c("override")
    asks = (full & ~c("override")) | (material & ~c("beyond_price") & ~always)
    marks = cut_lineage(known.where(always | asks).select("company_id", "run_at", always.alias("always")))
    fired = clock_firings(marks, T["price_trigger_cooldown_days"], bucket).withColumn("_open", F.lit(True))
    joined = known.join(fired, ["company_id", "run_at"], "left").withColumn("_open", yes(c("_open")))
    mode = (
        F.when(c("eligible") & c("urgent").isNotNull(), "URGENT_VETO_REVIEW")
        .when(always | (full & c("_open")), "FULL_ENTRY_REVIEW")
        .when(material & (c("beyond_price") | c("_open")), "MATERIAL_CHANGE_REVIEW")
        .when(c("eligible") & ~c("cooling") & c("refresh"), "PERIODIC_REFRESH")
    )
    decided = joined.withColumn("mode", mode)
    kind = F.when(c("mode") == "URGENT_VETO_REVIEW", c("urgent")).when(
        c("mode") == "MATERIAL_CHANGE_REVIEW", F.coalesce("event", F.lit("MATERIAL_METRIC_CHANGE"))
    )
    reasons = (
        F.when(c("mode") == "URGENT_VETO_REVIEW", F.array("urgent"))
        .when(c("mode") == "FULL_ENTRY_REVIEW", F.array("full_reason"))
        .when(c("mode") == "MATERIAL_CHANGE_REVIEW", c("reasons"))
        .otherwise(F.array().cast("array<string>"))
    )
    held = (
        F.when(c("mode").isNotNull(), None)
        .when(~c("eligible"), "NOT_ELIGIBLE")
        .when(c("cooling"), "COMPANY_COOLDOWN")
        .when(material, "PRICE_COOLDOWN")
        .otherwise("NOTHING_NEW")
    )
    sets = F.when(always | c("_open"), c("run_at"))
    out = decided.select(
        "company_id", "run_at", c("mode").isNotNull().alias("fires"), "mode", F.coalesce(kind, "mode").alias("trigger_type"), reasons.alias("reasons"), held.alias("held_by"), "in_zone", sets.alias("_set")
    )
    clocked = running_in_buckets(out, KEY, ["run_at"], F.date_trunc(bucket, "run_at"), {"last_price_trigger_at": ("max", c("_set"))})
    return clocked.drop("_set")
