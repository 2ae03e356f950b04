"""Payload rules one by one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cashlens.operators import quality as Q

IDENTITY = {x: "v" for x in Q.IDENTITY_FIELDS} | {"analysis_mode": "FULL_ENTRY_REVIEW", "analysis_id": "1", "company_id": "c"}
GOOD = IDENTITY | {
    "trigger_type": "t", "company_name": "n", "ticker": "k", "market": "m", "as_of_date": "d", "report_markdown": "text",
    "source_urls": ["https://a.org"], "verdict": "HOLD", "data_issue_detected": False, "data_issue_notes": [],
}
SCHEMA = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in GOOD.items())


def found(spark, payload, job=None, snapshot=None):
    df = spark.createDataFrame([tuple(payload.values())], SCHEMA)
    queued = IDENTITY | {"trigger_type": "t"} | (job or {})
    jobs = spark.createDataFrame([tuple(queued.values())], ", ".join(f"{k} string" for k in queued))
    shown = None
    if snapshot is not None:
        row = {"company_id": "c"} | dict.fromkeys(Q.SNAPSHOT_FIELDS) | snapshot
        shown = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    (out,) = Q.analysis_output_issues(df, jobs, shown).collect()
    assert set(out.asDict()) == {*GOOD, "issues"}
    return out["issues"]


@pytest.mark.parametrize("field", [x for x in Q.IDENTITY_FIELDS if x != "analysis_id"])
def test_identity(spark, field):
    assert found(spark, GOOD) == []
    assert found(spark, GOOD | {field: None}, {field: "other"}) == [f"IDENTITY:{field}"]


def test_job_trigger_snapshot(spark):
    assert found(spark, GOOD | {"analysis_id": "9"}) == ["JOB_UNKNOWN"]
    assert found(spark, GOOD | {"analysis_id": None}) == ["JOB_UNKNOWN"]
    assert found(spark, GOOD, {"trigger_type": "u"}) == ["TRIGGER_MISMATCH"]
    assert found(spark, GOOD, snapshot={"company_name": "n", "market": "x"}) == ["SNAPSHOT:market"]
    assert found(spark, GOOD, snapshot={}) == []


@pytest.mark.parametrize(
    ("change", "issue"),
    [
        ({"report_markdown": "a < b"}, "RAW_HTML"),
        ({"report_markdown": "<b>"}, "RAW_HTML"),
        ({"analysis_mode": "URGENT_RISK_REVIEW", "verdict": "SCALE_IN"}, "URGENT_SCALE_IN"),
        ({"analysis_mode": "URGENT_VETO_REVIEW", "verdict": "SCALE_IN"}, "URGENT_SCALE_IN"),
        ({"data_issue_detected": True}, "DATA_ISSUE_DISAGREES"),
        ({"data_issue_notes": ["x"]}, "DATA_ISSUE_DISAGREES"),
    ],
)
def test_rules(spark, change, issue):
    assert found(spark, GOOD | change, {k: v for k, v in change.items() if k == "analysis_mode"}) == [issue]


def test_urls(spark):
    cases = {
        "https://a.org/x": None, "http://a.org": None, "HTTP://A.org:8080?q=1": None, "https://u:p@a.org#f": None, "https://[::1]/x": None,
        "ftp://a.org": "SOURCE_SCHEME", "a.org": "SOURCE_SCHEME", "https://": "SOURCE_SCHEME", "": "SOURCE_SCHEME", None: "SOURCE_SCHEME",
        "https://localhost": "SOURCE_NOT_PUBLIC", "http://LOCALHOST:80/": "SOURCE_NOT_PUBLIC", "https://example.com/": "SOURCE_NOT_PUBLIC",
        "https://www.example.com?x": "SOURCE_NOT_PUBLIC", "https://x@db.local/": "SOURCE_NOT_PUBLIC", "https://a.invalid": "SOURCE_NOT_PUBLIC",
        "https://my-example.com": None, "https://local.org": None, "https://127.0.0.1/": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", Q.source_url_issue(F.col("u")).alias("i"))
    assert {r["u"]: r["i"] for r in df.collect()} == cases
