"""Change capture, triggers, streams, readers, sinks and releases."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cashlens.operators import events as E
from cashlens.operators import triggers as T
from cashlens.sources import readers, sinks
from cashlens.streaming.change_capture import gated_replace, revision_stream, run_available, windowed_counts
from cashlens.streaming.trigger_stream import trigger_stream

DAY = dt.datetime(2024, 1, 1)


def observations(spark):
    seq = [("a", "h1"), ("a", "h2"), ("b", "h1"), ("a", "h1"), ("a", "h1"), ("a", "h3")]
    rows = [(k, "t", h, DAY + dt.timedelta(days=i), i) for i, (k, h) in enumerate(seq)]
    return spark.createDataFrame(rows, "event_key string, event_type string, payload_hash string, observed_at timestamp, batch_seq int")


def test_change_log_and_revisions(spark):
    obs = observations(spark)
    log = [r.change_kind for r in E.change_log(obs).orderBy("batch_seq").collect()]
    assert log == ["new", "changed", "new", "changed", "unchanged", "changed"]
    rev = {(r.event_key, r.payload_hash): r.change_kind for r in E.revisions(obs).collect()}
    assert rev == {("a", "h1"): "new", ("a", "h2"): "changed", ("a", "h3"): "changed", ("b", "h1"): "new"}
    cur = {r.event_key: (r.payload_hash, r.observations) for r in E.current_state(obs).collect()}
    assert cur == {"a": ("h3", 5), "b": ("h1", 1)}
    acks = spark.createDataFrame([(0,), (2,)], "revision_id int")
    assert {r.revision_id for r in E.unsynced(E.revisions(obs), acks).collect()} == {1, 5}


def test_identity_ignores_view_count(spark):
    ddl = "issuer_id string, quote_code string, event_type string, payload map<string,string>, observed_at timestamp, batch_seq int"
    rows = [
        ("i", "q", "news", {"url": "u", "title": "t", "view_count": "1"}, DAY, 1),
        ("i", "q", "news", {"url": "u", "title": "t", "view_count": "2"}, DAY, 2),
        ("i", "q", "news", {"url": "u", "title": "other"}, DAY, 3),
        ("i", "q", "dividend", {"pub_date": "2024-01-01", "statement": "s"}, DAY, 4),
        ("i", "q", "buyback", {"record_market": "HK", "end_date_str": "2024-02-01", "buy_back_sum": "5"}, DAY, 5),
    ]
    n = E.normalize(spark.createDataFrame(rows, ddl)).orderBy("batch_seq").collect()
    assert n[0].event_key == n[1].event_key == n[2].event_key
    assert n[0].payload_hash == n[1].payload_hash != n[2].payload_hash
    assert n[3].event_date == "2024-01-01" and n[4].event_date == "2024-02-01"
    last = E.last_in_batch(E.normalize(spark.createDataFrame(rows[:3], ddl))).collect()
    assert len(last) == 1 and last[0].batch_seq == 3


def test_buyback_totals_round_each_row(spark):
    df = spark.createDataFrame([("i", "2024-01-01", "1.005", 3, "x"), ("i", "2024-05-01", "1.005", None, "y"), ("i", None, None, 1, None)], "issuer_id string, event_date string, buy_back_money string, buy_back_sum long, process string")
    got = {r.year: (float(r.money), r.shares, r.processes) for r in E.buyback_totals(df).collect()}
    assert got == {"2024": (2.02, 3, "x；y"), "日期不明": (0.0, 1, "")}


def test_confirmation(spark):
    state = spark.createDataFrame([("k", "i", "t", "h", {"a": "1"})], "event_key string, issuer_id string, event_type string, payload_hash string, payload map<string,string>")
    exp = spark.createDataFrame([("k", "i", "t", "h", {"a": "1"}), ("k", "j", "t", "h", {"a": "2"}), ("z", "i", "t", "h", {})], "event_key string, issuer_id string, event_type string, payload_hash string, expected_values map<string,string>")
    got = [list(r.issues) for r in E.confirm(exp, state).orderBy("event_key", "issuer_id").collect()]
    assert got == [[], ["ISSUER_MISMATCH", "VALUE_MISMATCH"], ["EVENT_NOT_FOUND"]]


def test_upsert_and_supersede_and_reuse(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "id int, name string")
    got = {r.id: (r.name, r.merge_action) for r in E.upsert_master(old, new, "id").collect()}
    assert got == {1: ("a", "unchanged"), 2: ("x", "updated"), 3: ("c", "unexpected"), 4: ("d", "inserted")}
    sel = spark.createDataFrame([(1, 2024, "d1", 1), (1, 2024, "d2", 2)], "company_id int, fiscal_year int, document_id string, selected_at int")
    assert {r.document_id: (r.selection_status, r.superseded_by) for r in E.supersede(sel).collect()} == {"d1": ("SUPERSEDED", "d2"), "d2": ("CURRENT", None)}
    inputs = spark.createDataFrame([(1, "h"), (2, "n")], "company_id int, input_hash string")
    cached = spark.createDataFrame([(1, "h", 5.0), (2, "o", 6.0)], "company_id int, input_hash string, v double")
    todo = E.rows_to_recompute(inputs, cached)
    assert [r.company_id for r in todo.collect()] == [2]
    merged = E.reuse_cached(inputs, cached, todo.withColumn("v", F.lit(7.0)))
    assert {r.company_id: r.v for r in merged.collect()} == {1: 5.0, 2: 7.0}


def zone_rows(spark, ssys):
    rows = [(1, DAY + dt.timedelta(hours=h), (DAY + dt.timedelta(hours=h)).date(), s, s) for h, s in ssys]
    return spark.createDataFrame(rows, "company_id int, run_at timestamp, trade_date date, ssy double, raw_yield double")


def test_zone_leaves_after_five_distinct_low_days(spark):
    path = [(0, 0.05), (24, 0.03), (26, 0.03), (48, 0.036), (72, 0.03), (96, 0.03), (120, 0.03), (121, 0.037), (144, 0.03), (168, 0.037), (192, 0.041), (216, 0.03)]
    got = [(r.in_zone, r.below_exit_days) for r in T.observation_zone(zone_rows(spark, path)).orderBy("run_at").collect()]
    assert got == [(True, 0), (True, 1), (True, 1), (True, 1), (True, 2), (True, 3), (True, 4), (True, 4), (False, 0), (False, 0), (True, 0), (True, 1)]


def test_cooldown_is_greedy(spark):
    rows = [(1, DAY + dt.timedelta(days=d)) for d in (0, 3, 6, 7, 13, 14, 30)]
    got = sorted(r.fired_at for r in T.cooldown_fires(spark.createDataFrame(rows, "company_id int, run_at timestamp"), 7).collect())
    assert [(t - DAY).days for t in got] == [0, 7, 14, 30]


RUNS = "company_id bigint, run_at timestamp, event_codes array<string>, eligible boolean, in_observation_zone boolean, trigger_type string, has_report boolean, last_success_at timestamp"


def run_rows():
    out = []
    for k in (1, 2):
        for d in range(0, 40, 2):
            codes = ["PROFIT_WARNING"] if d == 10 and k == 1 else []
            out.append((k, DAY + dt.timedelta(days=d), codes, d % 4 == 0, True, "COMBINED_SCREEN", k == 2, DAY - dt.timedelta(days=1)))
    return out


def test_urgent_bypasses_cooldown_and_backlog_runs_once(spark):
    got = T.screening_decisions(spark.createDataFrame(run_rows(), RUNS)).where("company_id = 1 AND fires").orderBy("run_at").collect()
    kinds = [((r.run_at - DAY).days, r.trigger_type) for r in got]
    assert kinds[:3] == [(0, "INITIAL_TRIGGER_BACKLOG"), (8, "COMBINED_SCREEN"), (10, "PROFIT_WARNING")]
    assert kinds[3] == (16, "COMBINED_SCREEN")


def test_trigger_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(run_rows(), RUNS)
    for part, lo, hi in (("p1", 0, 20), ("p2", 20, 99)):
        day = F.datediff("run_at", F.lit("2024-01-01"))
        df.where((day >= lo) & (day < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / part))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_available(trigger_stream(stream), str(tmp_path / "out"))
    order = ["company_id", "run_at"]
    got = spark.read.parquet(str(tmp_path / "out" / "data")).orderBy(*order).collect()
    want = T.screening_decisions(df).orderBy(*order).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_revision_stream_equals_batch(spark, tmp_path):
    obs = observations(spark)
    obs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_available(revision_stream(stream), str(tmp_path / "out"))
    got = {(r.event_key, r.payload_hash) for r in spark.read.parquet(str(tmp_path / "out" / "data")).collect()}
    assert got == {(r.event_key, r.payload_hash) for r in E.revisions(obs).collect()}


def test_windowed_counts_stream(spark, tmp_path):
    obs = observations(spark)
    obs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "2 days", "1 day").writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) s from wc").first().s == 6


def test_gated_replace_keeps_last_good(spark, tmp_path):
    write = gated_replace(lambda b: b.where("v < 0"), str(tmp_path))
    write(spark.createDataFrame([(1,)], "v int"), 0)
    write(spark.createDataFrame([(-1,)], "v int"), 1)
    assert [p.name for p in tmp_path.iterdir()] == ["version=0"]


def records(spark, bad=False):
    rows = [(1, "one", "READY", 80.0, 1.0, 70.0, 1.0, []), (2, "two", "WRONG" if bad else "STALE", None, 0.0, 50.0, 0.5, [])]
    return spark.createDataFrame(rows, "company_id int, company_name string, status string, opportunity_value double, opportunity_coverage double, resilience_value double, resilience_coverage double, fatal_errors array<string>")


def test_release_is_content_addressed_and_gated(spark, tmp_path):
    root = str(tmp_path)
    good = sinks.write_release(records(spark), root, expected=2)
    assert good and good == sinks.write_release(records(spark).orderBy(F.desc("company_id")), root, expected=2)
    assert sinks.write_release(records(spark, bad=True), root) is None
    assert sinks.write_release(records(spark), root, expected=3) is None
    assert sinks.current_release(spark, root).count() == 2
    pointers = spark.createDataFrame([(f"r{i}", DAY + dt.timedelta(days=i)) for i in range(8)], "release_id string, activated_at timestamp")
    assert {r.release_id for r in sinks.retained_releases(pointers).collect()} == {f"r{i}" for i in range(3, 8)}


def test_append_changed(spark, tmp_path):
    hist, latest = str(tmp_path / "h"), str(tmp_path / "l")
    ddl = "event_key string, payload_hash string, observed_at timestamp"
    for day, h in enumerate(["x", "x", "y"]):
        sinks.append_changed(spark.createDataFrame([("k", h, DAY + dt.timedelta(days=day))], ddl), hist, latest)
    assert spark.read.parquet(hist).count() == 2 and spark.read.parquet(latest).first().payload_hash == "y"


def test_analysis_status_tables(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "j1", "SUCCESS", 1), (1, "j2", "FAILED", 2), (2, "j3", "SUCCESS", 1)], "company_id int, job_id string, status string, created_at int")
    reports = spark.createDataFrame([(1, "j1"), (2, "old"), (3, "j9")], "company_id int, job_id string")
    got = {r.company_id: (r.public_status, r.success_job_id) for r in sinks.analysis_statuses(jobs, reports).collect()}
    assert got == {1: ("FAILED", "j1"), 2: ("REPORT_PENDING", "j3"), 3: ("REPORT_WITHOUT_JOB", None)}
    sinks.write_analysis_release(reports.withColumn("reviewed_overlay_candidates", F.lit("x")), sinks.analysis_statuses(jobs, reports).drop("report_job_id"), str(tmp_path))
    assert "reviewed_overlay_candidates" not in spark.read.parquet(str(tmp_path / "analyses")).columns


def test_history_tables(spark):
    rows = [("i", "financial", f"k{n}", f"2024-01-{n:02d}", {"period_text": str(n)}) for n in range(1, 20)]
    rows += [("i", "buyback", "b", "2024-02-01", {"buy_back_money": "5", "buy_back_sum": "2", "share_type": "H"}), ("i", "dividend", "d", "2024-03-01", {"statement": "s"})]
    t = sinks.history_tables(spark.createDataFrame(rows, "issuer_id string, event_type string, event_key string, event_date string, payload map<string,string>"))
    assert t["statements"].count() == 12 and t["dividends"].count() == 1
    assert float(t["buyback_totals"].first().money) == 5.0


def test_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"companies": [{"issuerId": "i1", "securityId": "s1", "quoteCode": "SH.1"}]}))
    assert readers.companies(spark, str(tmp_path / "c.json")).first().issuerId == "i1"
    sec = {"id": "s1", "issuerId": "i1", "market": "HK", "currency": "HKD", "quote": {"currentPrice": 5.0, "status": "available", "marketState": "closed", "lastUpdatedAt": "2024-01-05T08:00:00Z"}, "metrics": {"pe": 4.0}}
    doc = {"mode": "live", "isDemo": False, "marketData": {"collectedAt": "2024-01-05T08:00:10Z", "fxRates": {"HKD_CNY": {"rate": 0.9}}}, "securities": [sec, sec | {"id": "s2", "issuerId": "i2", "quote": {"currentPrice": 5.0, "status": "stale"}}]}
    (tmp_path / "w.json").write_text(json.dumps(doc))
    obs = {r.security_id: r for r in readers.quote_observations(readers.watchlist(spark, str(tmp_path / "w.json")), F.lit("2024-01-06 10:00:00").cast("timestamp")).collect()}
    assert (obs["s1"].price, obs["s1"].fx_to_base, obs["s1"].freshness, obs["s1"].pe) == (5.0, 0.9, "MARKET_CLOSED_CURRENT", 4.0)
    assert (obs["s2"].price, obs["s2"].freshness) == (None, "STALE_LAST_GOOD")
    weekly = {"provider": "p", "securities": {"s1": {"adjustment": "qfq", "frequency": "weekly", "points": [{"timestamp": "2024-01-05", "price": 5.0}, {"timestamp": "bad", "price": 1.0}]}, "s2": {"adjustment": "none", "frequency": "weekly", "points": [{"timestamp": "2024-01-05", "price": 5.0}]}}}
    (tmp_path / "p.json").write_text(json.dumps(weekly))
    assert [(r.security_id, str(r.week), r.close) for r in readers.weekly_prices(spark, str(tmp_path / "p.json")).collect()] == [("s1", "2024-01-05", 5.0)]
    stage = tmp_path / "stage"
    stage.mkdir()
    (stage / "c1.json").write_text(json.dumps({"company_id": "c1"}))
    (stage / "c2.json").write_text(json.dumps({"company_id": "zz"}))
    assert {r.company_id: r.file_matches for r in readers.staging(spark, str(stage), "company_id string").collect()} == {"c1": True, "zz": False}
    (tmp_path / "y.csv").write_bytes("﻿security_id,year,cash_dividend_per_share_cny,net_cancelled_buyback_per_share_cny\ns,2024,1.5,0.5\n".encode())
    assert float(readers.annual_cash_csv(spark, str(tmp_path / "y.csv")).first().per_share) == 2.0
    (tmp_path / "fx.xml").write_text('<Envelope><Cube><Cube time="2024-01-02"><Cube currency="CNY" rate="7.8"/><Cube currency="HKD" rate="8.5"/></Cube></Cube></Envelope>')
    rates = {r.currency: r.rate for r in readers.fx_rates_xml(spark, str(tmp_path / "fx.xml")).collect()}
    assert rates == {"CNY": 7.8, "HKD": 8.5}


def test_bundle_reader(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc")
    r = readers.bundle_files(spark, str(tmp_path)).first()
    assert (r.path, r.length, r.sha256[:8]) == ("/a.txt", 3, "ba7816bf")
    assert readers.report_text(spark, str(tmp_path / "a.txt")).first().text == "abc"
