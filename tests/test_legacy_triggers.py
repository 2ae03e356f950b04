"""Composed trigger decisions against a walk over the runs, and the rules one by one."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cashlens.operators import legacy_triggers as L

D = Decimal
START = datetime(2024, 1, 1, 9)
SCHEMA = """company_id bigint, run_at timestamp, trade_date date, eligible boolean, ssy double, raw_yield double, h double, eri double, coverage double,
 has_report boolean, last_success_at timestamp, last_prompt_version string, current_prompt_version string, prompt_major_upgrade boolean,
 prior_baseline_invalid boolean, veto_codes array<string>, event_codes array<string>"""
NAMES = [x.split()[0] for x in SCHEMA.replace("\n", " ").split(",")]


def run(company, hours, **values):
    at = START + timedelta(hours=hours)
    base = dict.fromkeys(NAMES) | {"eligible": True, "has_report": True, "veto_codes": [], "event_codes": []}
    return base | {"company_id": company, "run_at": at, "trade_date": at.date()} | values


def decide(spark, rows, **settings):
    df = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], SCHEMA)
    got = L.legacy_decisions(df, **settings).collect()
    assert len(got) == len({(r["company_id"], r["run_at"]) for r in rows})
    return {(r["company_id"], r["run_at"]): r for r in got}


def walk(rows):
    """The same rules as one step per run."""
    out = {}
    state: dict = {}
    for r in sorted(rows, key=lambda r: (r["company_id"], r["run_at"])):
        zone, low_days, low_day, price, before = state.get(r["company_id"], (False, 0, None, None, None))
        num = lambda x, row=r: None if row is None or row[x] is None else D(str(row[x]))
        old = lambda x, row=before: None if row is None or row[x] is None else D(str(row[x]))
        mode, reasons = None, []
        if r["eligible"]:
            ssy, raw = num("ssy"), num("raw_yield")
            if (ssy is not None and ssy >= D("0.04")) or (raw is not None and raw >= D("0.04")):
                zone, low_days, low_day = True, 0, None
            elif zone and ssy is not None and raw is not None and ssy < D("0.035") and raw < D("0.035"):
                if low_day != r["trade_date"]:
                    low_days, low_day = low_days + 1, r["trade_date"]
                if low_days >= 5:
                    zone, low_days, low_day = False, 0, None
            fresh = set(r["veto_codes"]) - (set(before["veto_codes"]) if before else set()) if r["has_report"] else set(r["veto_codes"])
            urgent = sorted((fresh | set(r["event_codes"])) & set(L.URGENT_CODES))
            success, at = r["last_success_at"], r["run_at"]
            cooling = success is not None and at - success < timedelta(days=30)
            free = price is None or at - price >= timedelta(days=7)
            override = bool(r["prompt_major_upgrade"] or r["prior_baseline_invalid"])
            full = None
            if ssy is not None and ssy >= D("0.04") and (old("ssy") is None or old("ssy") < D("0.04")):
                full = "ENTERED_ZONE"
            elif raw is not None and raw >= D("0.04") and ssy is not None and ssy < D("0.04"):
                full = "YIELD_TRAP"
            elif zone and not r["has_report"]:
                full = "NO_LEGAL_REPORT"
            elif r["prompt_major_upgrade"]:
                full = "PROMPT_MAJOR_UPGRADE"
            elif r["prior_baseline_invalid"]:
                full = "BASELINE_INVALID"
            changes, beyond = [], False
            if None not in (ssy, old("ssy")):
                if abs(ssy - old("ssy")) >= D("0.005"):
                    changes.append("SSY_ABSOLUTE")
                if old("ssy") and abs(ssy - old("ssy")) / abs(old("ssy")) >= D("0.15"):
                    changes.append("SSY_RELATIVE")
            if None not in (num("h"), old("h")) and old("h") and abs(num("h") - old("h")) / abs(old("h")) >= D("0.15"):
                changes.append("H_RELATIVE")
                beyond = True
            if None not in (num("eri"), old("eri")) and abs(num("eri") - old("eri")) >= 10:
                changes.append("ERI_POINTS")
                beyond = True
            events = sorted(set(r["event_codes"]) & set(L.MATERIAL_EVENT_TYPES))
            changes, beyond = changes + events, beyond or bool(events)
            high = (num("eri") is not None and num("eri") > 45) or r["veto_codes"]
            if urgent:
                mode, reasons = "URGENT_VETO_REVIEW", [urgent[0]]
            elif full and not cooling and (free or override):
                mode, reasons, price = "FULL_ENTRY_REVIEW", [full], at
            elif zone and changes and not cooling and (beyond or free):
                mode, reasons = "MATERIAL_CHANGE_REVIEW", changes
                price = price if beyond else at
            elif zone and success is not None and not cooling and at - success >= timedelta(days=30 if high else 90):
                mode = "PERIODIC_REFRESH"
        out[r["company_id"], r["run_at"]] = (mode, reasons, zone, price)
        state[r["company_id"]] = (zone, low_days, low_day, price, r)
    return out


def same(got, want):
    assert {k: (r["mode"], r["reasons"], r["in_zone"], r["last_price_trigger_at"]) for k, r in got.items()} == want


def random_runs(rng, company, n, step):
    rows, hours, success = [], 0, None
    for _ in range(n):
        hours += rng.choice(step)
        if rng.random() < 0.04:
            success = START + timedelta(hours=hours)
        level = rng.choice([0.03, 0.034, 0.036, 0.0399, 0.04, 0.05])
        rows.append(
            run(
                company,
                hours,
                eligible=rng.random() < 0.93,
                ssy=rng.choice([level, None, 0.031]),
                raw_yield=rng.choice([level, 0.02, 0.045, None]),
                h=rng.choice([100.0, 101.0, 120.0, None]),
                eri=rng.choice([20.0, 25.0, 50.0, None]),
                has_report=success is not None and rng.random() < 0.95,
                last_success_at=success,
                prompt_major_upgrade=rng.random() < 0.02,
                prior_baseline_invalid=rng.choice([None, False, False, rng.random() < 0.05]),
                veto_codes=rng.choice([[], [], [], ["AUDIT_GOVERNANCE_ALERT"], ["OTHER"]]),
                event_codes=rng.choice([[], [], [], [], ["ANNUAL_REPORT"], ["MAJOR_REGULATORY_PENALTY", "ASSET_SALE"]]) if rng.random() < 0.3 else [],
            )
        )
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_runs(spark, seed):
    rng = random.Random(seed)
    rows = [r for k in range(12) for r in random_runs(rng, k, 70, [1, 3, 24, 24, 100])]
    rows += random_runs(rng, 99, 600, [1, 2, 5])  # one company with a third of the rows, many asks in each cooldown
    rng.shuffle(rows)
    same(decide(spark, rows), walk(rows))
    same(decide(spark, rows, bucket="month"), walk(rows))


def test_entry_then_cooldown(spark):
    rows = [run(1, 24 * k, ssy=s, raw_yield=s) for k, s in enumerate([0.03, 0.04, 0.041, 0.03, 0.041, 0.0410, 0.03, 0.03, 0.04])]
    got = decide(spark, rows)
    same(got, walk(rows))
    by_day = [got[1, START + timedelta(days=k)] for k in range(9)]
    assert [r["mode"] for r in by_day] == [None, "FULL_ENTRY_REVIEW", None, None, None, None, None, None, "FULL_ENTRY_REVIEW"]
    assert by_day[3]["held_by"] == "PRICE_COOLDOWN" and by_day[2]["held_by"] == "NOTHING_NEW"


def test_trap_material_refresh_and_first_report(spark):
    success = START - timedelta(days=31)
    rows = [
        run(1, 0, ssy=0.03, raw_yield=0.05),  # trap
        run(2, 0, ssy=0.05, raw_yield=0.05, last_success_at=START - timedelta(days=2)),  # company cooldown
        run(3, 0, ssy=0.05, raw_yield=0.05), run(3, 200, ssy=0.045, raw_yield=0.05),  # price change, clock open
        run(4, 0, ssy=0.05, raw_yield=0.05, h=100.0), run(4, 24, ssy=0.05, raw_yield=0.05, h=115.0),  # no price change: no clock
        run(5, 0, ssy=0.05, raw_yield=0.05, eri=50.0, last_success_at=success), run(5, 24, ssy=0.05, raw_yield=0.05, eri=50.0, last_success_at=success),
        run(6, 0, ssy=0.036, raw_yield=0.036, has_report=False, veto_codes=["AUDIT_GOVERNANCE_ALERT"]),
        run(6, 1, ssy=0.036, raw_yield=0.036, has_report=False, veto_codes=["AUDIT_GOVERNANCE_ALERT"]),  # without a report all flags count
        run(7, 0, ssy=0.05, raw_yield=0.05, prompt_major_upgrade=True), run(7, 24, ssy=0.05, raw_yield=0.05, prior_baseline_invalid=True),
        run(8, 0, eligible=False, ssy=0.05, raw_yield=0.05, veto_codes=["AUDIT_GOVERNANCE_ALERT"]),
        run(9, 0, ssy=0.05, raw_yield=0.05), run(9, 200, ssy=0.05, raw_yield=0.05, last_prompt_version="risk-review-v1.2.0", current_prompt_version="risk-review-v2.0.0"),
        run(9, 400, ssy=0.05, raw_yield=0.05, last_prompt_version="risk-review-v2.2.0", current_prompt_version="risk-review-v2.0.0"),
    ]
    got = decide(spark, rows)
    at = lambda company, hours: got[company, START + timedelta(hours=hours)]
    assert (at(1, 0)["mode"], at(1, 0)["reasons"]) == ("FULL_ENTRY_REVIEW", ["YIELD_TRAP"])
    assert (at(2, 0)["fires"], at(2, 0)["held_by"], at(2, 0)["in_zone"]) == (False, "COMPANY_COOLDOWN", True)
    assert at(3, 200)["trigger_type"] == "MATERIAL_METRIC_CHANGE" and at(3, 200)["last_price_trigger_at"] == START + timedelta(hours=200)
    assert at(4, 24)["reasons"] == ["H_RELATIVE"] and at(4, 24)["last_price_trigger_at"] == START
    assert at(5, 24)["mode"] == "PERIODIC_REFRESH"
    assert [at(6, h)["mode"] for h in (0, 1)] == ["URGENT_VETO_REVIEW"] * 2
    assert [at(7, h)["mode"] for h in (0, 24)] == ["FULL_ENTRY_REVIEW"] * 2
    assert (at(8, 0)["fires"], at(8, 0)["held_by"]) == (False, "NOT_ELIGIBLE")
    assert (at(9, 200)["reasons"], at(9, 400)["mode"]) == (["PROMPT_MAJOR_UPGRADE"], None)


def test_equal_times_and_edges(spark):
    rows = [run(1, 0, ssy=0.05, raw_yield=0.05), run(1, 0, ssy=0.01, raw_yield=0.01), run(None, 0, ssy=0.05), run(2, 0) | {"run_at": None}]
    df = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], SCHEMA)
    (one,) = L.legacy_decisions(df).collect()
    assert one["fires"] and one["company_id"] == 1
    assert L.legacy_decisions(df.limit(0)).collect() == []
    few = df.select("company_id", "run_at", "ssy", "eligible")
    assert [r["mode"] for r in L.legacy_decisions(few).collect()] == ["FULL_ENTRY_REVIEW"]


def test_eligibility(spark):
    rows = [
        ("BLOCKED", "VALID", True, "FULLY_VALID", []), ("VERIFIED", None, True, "FULLY_VALID", None), ("VERIFIED", "VALID", False, "FULLY_VALID", None),
        ("ESTIMATED", None, True, "OTHER", None), (None, "VALID", None, None, None), (None, "STALE", True, "FULLY_VALID", None),
        (None, "PARTIAL", True, "CORE_VALID_QUALITATIVE_OVERLAY_PENDING", ["business_durability"]), (None, "PARTIAL", True, "CORE_VALID_QUALITATIVE_OVERLAY_PENDING", []),
        (None, "PARTIAL", True, "CORE_VALID_QUALITATIVE_OVERLAY_PENDING", ["price"]), (None, "PARTIAL", True, "FULLY_VALID", ["business_durability"]),
    ]
    df = spark.createDataFrame(rows, "t string, d string, e boolean, s string, m array<string>")
    got = [r[0] for r in df.select(L.legacy_eligible(F.col("t"), F.col("d"), F.col("e"), F.col("s"), F.col("m"))).collect()]
    assert got == [False, True, False, False, True, False, True, False, False, False]


def test_success_up_to_each_run(spark):
    runs = spark.createDataFrame([(1, START + timedelta(hours=h), h) for h in (0, 1, 2, 30)] + [(2, START, 0)], "company_id bigint, run_at timestamp, x int")
    done = spark.createDataFrame([(1, START + timedelta(hours=1), "a"), (1, START + timedelta(hours=5), "b")], "company_id bigint, at timestamp, version string")
    got = {(r.company_id, r.x): (r.has_report, r.last_prompt_version) for r in L.with_success(runs, done).collect()}
    assert got == {(1, 0): (False, None), (1, 1): (True, "a"), (1, 2): (True, "a"), (1, 30): (True, "b"), (2, 0): (False, None)}
