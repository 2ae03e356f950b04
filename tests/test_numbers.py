"""Golden values of rounding, bands and yearly-history formulas."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cashlens.functions import policy as P
from cashlens.functions import series as S
from cashlens.functions.numeric import (
    clip,
    exact_equal,
    finite_decimal,
    float_round,
    half_up,
    linear_score,
    metric,
    reconciles,
    relative_difference,
    weighted_score,
)
from cashlens.operators import history as H
from cashlens.operators import valuation as V


def one(spark, expr, value, kind="double"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first().y


def test_dividend_yield_knots(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2.5, 4, 5, 8)], "x double")
    got = [r.y for r in df.select(linear_score(F.col("x"), P.OPPORTUNITY["dividend_yield_pct"]).alias("y")).collect()]
    assert got == [0, 20, 50, 80, 100, 100]


def test_knots_must_increase():
    with pytest.raises(ValueError):
        linear_score(F.lit(1), [(1, 0), (1, 5)])


def test_float_round_is_binary_exact(spark):
    rng = random.Random(3)
    xs = [2.675, 0.125, 99.85, 99.95, -2.675, 1e15 + 0.5, 0.0] + [rng.uniform(-1e4, 1e4) for _ in range(500)]
    xs += [i / 100 + 0.005 for i in range(-200, 200)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", float_round(F.col("x"), 2).alias("a"), float_round(F.col("x"), 1).alias("b")).collect():
        assert (r.a, r.b) == (round(r.x, 2), round(r.x, 1))


def test_half_up_keeps_decimal_ties(spark):
    assert one(spark, half_up(F.col("x"), 2), 2.675) == 2.68
    assert one(spark, half_up(F.col("x"), 2), -2.675) == -2.68
    assert one(spark, half_up(F.col("x"), 2), None) is None


def test_clip_keeps_null(spark):
    assert one(spark, clip(F.col("x")), None) is None
    assert one(spark, clip(F.col("x")), 120.0) == 100.0


@pytest.mark.parametrize("text,want", [("1.50", 1.5), ("NaN", None), ("abc", None), ("", None), ("-3", -3.0)])
def test_finite_decimal(spark, text, want):
    got = one(spark, finite_decimal(F.col("x")), text, "string")
    assert got is None if want is None else float(got) == want


def test_tolerances(spark):
    df = spark.createDataFrame([(100.0, 101.0), (1000.0, 1015.0), (1000.0, 1030.0), (None, 1.0)], "a double, b double")
    got = [r.y for r in df.select(reconciles(F.col("a"), F.col("b")).alias("y")).collect()]
    assert got == [True, True, False, None]
    assert df.select(relative_difference(F.col("a"), F.col("b")).alias("y")).first().y == pytest.approx(1 / 101)


def test_exact_equal(spark):
    assert spark.range(1).select(exact_equal(F.lit("1.500"), F.lit("1.5")).alias("y")).first().y is True


def test_metric_struct(spark):
    df = spark.createDataFrame([(0.0,), (None,), (2.5,)], "x double")
    got = [r.m.status for r in df.select(metric(F.col("x"), "missing", "CNY", "DIRECT").alias("m")).collect()]
    assert got == ["KNOWN_ZERO", "INSUFFICIENT_DATA", "VALID"]


def test_weighted_score_needs_equal_names(spark):
    with pytest.raises(ValueError):
        weighted_score({"a": F.lit(1)}, {"b": 1.0})
    assert spark.range(1).select(weighted_score({"a": F.lit(120.0), "b": F.lit(0.0)}, {"a": 3.0, "b": 1.0}).alias("y")).first().y == 75.0


def profile(spark, values):
    df = spark.createDataFrame([(1, [float(v) for v in values])], "company_id int, v array<double>")
    return H.history_profile(df).first()


@pytest.mark.parametrize(
    "values,h",
    [
        ([100] * 10, 100.0),
        ([0] + [100] * 9, 57.75),
        ([300] + [100] * 9, 110.0),
        ([100], None),
        ([80, 120], 80.0),
        ([100, 80, 60], 80.0),
    ],
)
def test_conservative_history(spark, values, h):
    assert profile(spark, values).h == (pytest.approx(h) if h is not None else None)


def test_winsorised_mean(spark):
    assert profile(spark, [1000, 10, 10, 10, 10, 10, 10, 0]).t10 == pytest.approx(10.0)
    assert profile(spark, [30, 10, 20]).t10 == pytest.approx(20.0)


def test_stability(spark):
    def score(v):
        df = spark.createDataFrame([([float(x) for x in v],)], "v array<double>")
        return df.select(H.stability_score(F.col("v")).alias("y")).first().y

    assert score([100, 100, 100]) == 100.0
    assert score([0, 100, 100]) == 0.0
    assert score([100, 70, 130, 80, 120]) == 80.0
    assert score([100, 0, 100, 100, 100]) == 55.0
    assert score([100, 0, 0, 500, 1]) == 20.0


def test_trend_rules(spark):
    def both(v):
        df = spark.createDataFrame([([float(x) for x in v],)], "v array<double>")
        r = df.select(S.trend(F.col("v")).alias("t"), S.organic_growth(F.col("v"), -0.08, 0.06).alias("g")).first()
        return r.t, r.g

    t, g = both([100, -50, 121])
    assert t == pytest.approx(0.1) and g == pytest.approx(0.06)
    t, g = both([100, 110])
    assert t == pytest.approx(0.1) and g == 0.06
    assert both([100]) == (0.0, None)
    assert both([0, 0]) == (0.0, None)


def test_buyback(spark):
    df = spark.createDataFrame(
        [(100.0, 10.0, 4.0), (100.0, 10.0, -4.0), (100.0, 0.0, 4.0), (None, 1.0, 1.0), (-1.0, 1.0, 1.0), (100.0, 10.0, 40.0)],
        "g double, k double, n double",
    )
    got = [r.y for r in df.select(H.eligible_buyback(F.col("g"), F.col("k"), F.col("n")).alias("y")).collect()]
    assert got == [40.0, 0.0, 0.0, None, None, 100.0]


def test_persistence(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0, 1.0, -1.0],), ([1.0, 1.0, -1.0],), ([-1.0],), ([1.0, None],)], "v array<double>")
    assert [r.y for r in df.select(H.persistence_factor(F.col("v")).alias("y")).collect()] == [1.0, 0.7, 0.0, None]


def test_trend_score_after_decline(spark):
    def score(r2, m5, latest, previous):
        return spark.range(1).select(H.trend_score(*[F.lit(float(x)) for x in (r2, m5, latest, previous)]).alias("y")).first().y

    assert score(110, 100, 110, 100) == 100.0
    assert score(110, 100, 60, 100) == 60.0
    assert score(80, 100, 60, 100) == 60.0
    assert score(80, 100, 0, 100) == 0.0


def test_growth_contribution(spark):
    df = spark.createDataFrame([(0.08,), (-0.05,), (0.02,)], "g double")
    assert [r.y for r in df.select(H.growth_contribution(F.col("g")).alias("y")).collect()] == [0.03, -0.05, 0.01]
    by = [r.y for r in df.select(H.growth_contribution_by_years(F.col("g"), F.lit(3)).alias("y")).collect()]
    assert by == [0.02, -0.05, 0.02]


def test_valuation_drag_never_positive(spark):
    df = spark.createDataFrame([(10.0, 20.0), (20.0, 10.0), (0.0, 1.0)], "h double, k double")
    got = [r.y for r in df.select(V.valuation_drag(F.col("h"), F.col("k")).alias("y")).collect()]
    assert got[0] == pytest.approx(0.5**0.1 - 1) and got[1] == 0.0 and got[2] is None


@pytest.mark.parametrize(
    "ri,eri,veto,done,want",
    [(85.0, 20.0, False, True, "A"), (70.0, 40.0, False, True, "B"), (85.0, 20.0, True, True, "B"), (40.0, 20.0, False, True, "D"), (85.0, 20.0, False, False, "C"), (None, 1.0, False, True, "C")],
)
def test_recommendation_class(spark, ri, eri, veto, done, want):
    lit = lambda x: F.lit(x).cast("double")
    got = spark.range(1).select(V.recommendation_class(lit(ri), lit(eri), F.lit(veto), F.lit(False), F.lit(done)).alias("y")).first().y
    assert got == want


def test_policy_contract():
    doc = P.current_policy()
    assert P.check_policy(doc)["policy_version"] == P.POLICY_VERSION
    with pytest.raises(ValueError):
        P.check_policy(doc | {"extra": 1})
    with pytest.raises(ValueError):
        P.check_policy(doc | {"policy_version": "0"})


def test_quote_times_do_not_follow_the_session_zone(spark):
    from cashlens.functions.market import expected_open, quote_timestamp

    df = spark.createDataFrame([("2026-08-03 10:00:00", "HK.00700"), ("2026-07-01 09:30:00", "US.A"), ("2026-08-03T02:00:00Z", "HK.1"), ("--", "HK.1")], "raw string, code string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            at = quote_timestamp(F.col("raw"), F.col("code"))
            got = [r.s for r in df.select(F.unix_seconds(at).alias("s")).collect()]
            assert got == [1785722400, 1782912600, 1785722400, None]
            open_ = df.limit(1).select(expected_open(F.timestamp_seconds(F.lit(1785722400)), F.lit("HK")).alias("x")).first().x
            assert open_ is not None and open_ == (open_ if zone == "UTC" else first)
            first = open_
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_public_summary_rules(spark):
    from cashlens.functions.hashing import public_summary

    m = {"Z": "see /home/u/a", "my_Private_Key": "x", "stderr": "x", "a": "~/b", "jsonl_path": "x", "note": "n" * 5000, "password": "kept"}
    df = spark.range(1).select(F.create_map(*[F.lit(x) for pair in m.items() for x in pair]).alias("m"))
    got = df.select(public_summary(F.col("m")).alias("y")).first().y
    assert got == {"Z": "[local path]", "a": "[local path]", "note": "n" * 5000, "password": "kept"}
    cut = df.select(public_summary(F.col("m"), max_items=1, max_text=3).alias("y")).first().y
    assert list(cut) == list(m)[:1]
