"""Ledger, reconciliation and quality rules on small fixtures."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cashlens.operators import ledger as L
from cashlens.operators import quality as Q
from cashlens.operators import valuation as V

POINT = "company_id int, field_id string, value double, data_status string, source_name string, source_level string, seq int"


def upsert(spark, rows):
    good, bad = L.upsert_facts(spark.createDataFrame([(1, "FY2024.x", *r) for r in rows], POINT))
    return good.collect(), bad.collect()


@pytest.mark.parametrize(
    "rows,want",
    [
        ([(5.0, "VALID", "p", "PROVIDER", 1), (None, "MISSING", "p", "PROVIDER", 2)], ("VALID", 1)),
        ([(5.0, "VALID", "p", "PROVIDER", 1), (5.0, "VALID", "o", "OFFICIAL_FILING", 2)], ("VALID", 2)),
        ([(5.0, "VALID", "o", "OFFICIAL_FILING", 1), (5.0, "VALID", "p", "PROVIDER", 2)], ("VALID", 1)),
        ([(None, "CONFLICT", "p", "PROVIDER", 1), (None, "MISSING", "p", "PROVIDER", 2)], ("CONFLICT", 1)),
        ([(None, "MISSING", "p", "PROVIDER", 1), (None, "STALE", "p", "PROVIDER", 2)], ("STALE", 2)),
        ([(None, "CONFLICT", "p", "PROVIDER", 1), (3.0, "VALID", "p", "PROVIDER", 2)], ("VALID", 2)),
    ],
)
def test_fact_upsert_order(spark, rows, want):
    good, bad = upsert(spark, rows)
    assert not bad and (good[0].data_status, good[0].seq) == want


def test_disagreeing_numbers_are_quarantined(spark):
    good, bad = upsert(spark, [(5.0, "VALID", "p", "PROVIDER", 1), (6.0, "VALID", "o", "OFFICIAL_FILING", 2)])
    assert not good and (bad[0].lowest, bad[0].highest) == (5.0, 6.0)


def test_restatement_tie_keeps_first(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "f", "s", "FY", "d", t, 1, 10.0), (1, "f", "s", "FY", "d", t, 2, 20.0)], "company_id int, field_id string, security_id string, fiscal_period string, source_document string, source_fetch_time timestamp, ingest_seq int, value double")
    assert L.latest_restatements(df).first().value == 10.0


REPORT = "company_id int, field string, fiscal_year int, current_value double, comparative_value double, currency string, unit string, vendor_value double, vendor_currency string, vendor_status string, extraction_status string, accepted_before boolean"


def reports(spark, rows):
    return spark.createDataFrame([(1, "ocf", *r) for r in rows], REPORT)


def test_adjacent_and_decisions(spark):
    df = reports(
        spark,
        [
            (2020, 10.0, None, "CNY", "currency", None, None, "MISSING", "REVIEW", False),
            (2021, 11.0, 10.0, "CNY", "currency", 11.0, "CNY", "VALID", "REVIEW", False),
            (2023, 12.0, 11.0, "CNY", "currency", 12.0, "CNY", "VALID", "REVIEW", False),
            (2024, 13.0, 99.0, "CNY", "currency", 13.0, "HKD", "VALID", "REVIEW", True),
        ],
    )
    adj = L.adjacent(df)
    got = {r.fiscal_year: r for r in L.field_decision(adj).collect()}
    assert [got[y].prior_report for y in (2020, 2021, 2023, 2024)] == ["NO_PRIOR_REPORT", "MATCH", "YEAR_GAP", "AMOUNT_MISMATCH"]
    assert [got[y].status for y in (2020, 2021, 2023, 2024)] == ["REVIEW", "VALID", "REVIEW", "CONFLICT"]
    dec = {r.fiscal_year: r.decision for r in L.coverage_decision(adj).collect()}
    assert dec == {2020: "ACCEPT_OFFICIAL_ADJACENT", 2021: "ACCEPT_OFFICIAL_ADJACENT", 2023: "CONFLICT", 2024: "CONFLICT"}


def test_coverage_decision_without_official_value(spark):
    df = reports(
        spark,
        [
            (2020, None, None, None, None, 5.0, "CNY", "VALID", "REVIEW", False),
            (2022, None, None, None, None, None, None, "MISSING", "REVIEW", False),
            (2024, 5.0, None, "CNY", None, None, None, "MISSING", "REVIEW", False),
            (2026, 5.0, None, "CNY", "currency", 5.0, "CNY", "VALID", "REVIEW", False),
            (2028, 5.0, None, "CNY", "currency", 5.0, "CNY", "VALID", "REVIEW", True),
        ],
    )
    got = [r.decision for r in L.coverage_decision(L.adjacent(df)).orderBy("fiscal_year").collect()]
    assert got == ["PROVIDER_ONLY", "INSUFFICIENT_DATA", "REVIEW", "ACCEPT_OFFICIAL_PLUS_PROVIDER", "ACCEPT_V1"]


def test_official_conflict_voids_only_its_field(spark):
    off = spark.createDataFrame([(1, 2024, "a", 1.0, "VALID", "Exchange", 1), (1, 2024, "b", 2.0, "CONFLICT", "Exchange", 2), (1, 2024, "c", 3.0, "VALID", "provider x", 3)], "company_id int, fiscal_year int, field string, value double, data_status string, source_name string, seq int")
    prov = spark.createDataFrame([(1, 2024, f, 9.0) for f in "abcd"] + [(1, y, "a", 0.0) for y in range(2015, 2020)], "company_id int, fiscal_year int, field string, value double")
    got = {(r.fiscal_year, r.field): (r.value, r.basis) for r in L.official_over_provider(off, prov).collect()}
    assert got[(2024, "a")] == (1.0, "OFFICIAL_STRUCTURED") and got[(2024, "b")] == (None, "SOURCE_CONFLICT")
    assert got[(2024, "c")] == (9.0, "PROVIDER") and (2016, "a") in got and (2015, "a") not in got


def test_share_chain_and_bridge(spark):
    rows = [(1, 2020, 100, 90, False, "REVIEW"), (1, 2021, 90, 80, False, "REVIEW"), (1, 2022, 70, 60, False, "REVIEW"), (1, 2023, 60, 50, True, "REVIEW")]
    df = spark.createDataFrame(rows, "company_id int, fiscal_year int, opening_issued_shares long, closing_issued_shares long, has_marker boolean, extraction_status string")
    got = [(r.opening_reconciliation, r.status) for r in L.share_chain(df).orderBy("fiscal_year").collect()]
    assert got == [(None, "VALID"), ("MATCH", "CONFLICT"), ("MISMATCH", "CONFLICT"), ("MATCH_REVIEW_SPLIT", "REVIEW")]
    b = spark.createDataFrame([(100, [5, 5], 10, 100, 101, "ACCEPT")], "opening_issued_shares long, issued_additions array<long>, verified_cancelled_shares long, configured_closing long, reported_closing long, bridge_status string")
    r = L.share_bridge(b).first()
    assert int(r.derived_closing) == 100 and r.issues == ["REPORTED_MISMATCH"]


EVIDENCE = "company struct<issuer_id:string,security_id:string>, fetched_at string, statements map<string,struct<report_list:array<struct<date_time_str:string,fiscal_year:int,financial_type:int,period_text:string,currency_code:string,item_list:array<struct<field_id:bigint,display_name:string,data:string>>>>>>"


def evidence(spark):
    items = [(1, "经营活动产生的现金流量净额", "10"), (2, "货币资金", "3"), (3, "短期借款", "1.5"), (4, "应付债券", "2"), (5, "现金及现金等价物", "99"), (6, "净利润", None)]
    doc = (("c1", "s1"), "2024-01-01", {"cash_flow": ([("2023-12-31", 2023, 7, "2023/FY", "CNY", items), ("2023-06-30", 2023, 1, "2023/H1", "CNY", items)],)})
    return spark.createDataFrame([doc], EVIDENCE)


def test_statement_items(spark):
    items = L.full_year(L.flatten_statements(evidence(spark)))
    keys = ["company_id", "fiscal_year"]
    got = {r.field: float(r.value) for r in L.first_by_alias(items, keys, L.FIELD_ALIASES).collect()}
    assert got == {"operating_cash_flow": 10.0, "cash": 3.0}
    assert float(L.interest_bearing_debt(items, keys).first().interest_bearing_debt) == 3.5
    one = L.exact_extract(items, keys, ("货币资金", "现金及现金等价物"), "cash").first()
    assert (one.cash, one.cash_status) == (None, "CONFLICT")
    assert L.exact_extract(items, keys, ("nothing",), "x").first().x_status == "MISSING"
    capex = L.capex_from_items(items, keys, ("购建",), (("短期借款", "应付债券"),)).first()
    assert (float(capex.capital_expenditure), capex.capex_status) == (3.5, "VALID")


def test_yearly_ledger_currency_clash(spark):
    cols = "company_id string, fiscal_year int, period_text string, period_end string, currency string"
    cf = spark.createDataFrame([("c", 2023, "2023/FY", "e", "CNY", 1.0, "VALID", 2.0, "VALID")], cols + ", operating_cash_flow double, operating_cash_flow_status string, capital_expenditure double, capital_expenditure_status string")
    bs = spark.createDataFrame([("c", 2023, "2023/FY", "e", "HKD", 3.0, "VALID"), ("c", 2022, "2022/FY", "e", "CNY", 4.0, "VALID")], cols + ", share_capital double, share_capital_status string")
    got = {r.fiscal_year: r for r in L.yearly_ledger(cf, bs).collect()}
    assert got[2023].operating_cash_flow is None and got[2023].share_capital_status == "CONFLICT"
    assert got[2022].share_capital == 4.0 and got[2022].operating_cash_flow_status == "MISSING"


def test_balance_sheet_kinds(spark):
    df = spark.createDataFrame([(5.0, 9.0, 10.0, 1.0, 2.0), (9.0, 9.0, 10.0, 1.0, 2.0), (None, 9.0, 10.0, 1.0, 2.0), (None, None, None, None, None)], "interest_bearing_debt double, cash double, total_equity double, total_liabilities double, total_assets double")
    got = [(r.balance_kind, r.balance_value) for r in L.balance_sheet_kind(df).collect()]
    assert got == [("NET_CASH", 4.0), ("NET_DEBT_TO_EQUITY", 0.0), ("DEBT_TO_ASSETS_PROXY", 0.5), ("UNAVAILABLE", None)]


def test_market_overlay(spark):
    pts = spark.createDataFrame([(1, "FY2020.x", 1.0, "VALID"), (1, "MARKET.9.price", 5.0, "VALID"), (2, "MARKET.8.price", 6.0, "VALID")], "company_id int, field_id string, value double, data_status string")
    cur = L.market_points(spark.createDataFrame([(1, 9, 7.0, 0.0)], "company_id int, security_id int, price double, pe double"))
    got = {(r.company_id, r.field_id): (r.value, r.data_status) for r in L.replace_market_points(pts, cur).collect()}
    assert got == {(1, "FY2020.x"): (1.0, "VALID"), (2, "MARKET.8.price"): (6.0, "VALID"), (1, "MARKET.9.price"): (7.0, "VALID"), (1, "MARKET.9.pe"): (0.0, "KNOWN_ZERO")}
    comp = spark.createDataFrame([(1, [("a", 1.0, 1.0, "MISSING"), ("b", 2.0, 1.0, "VALID")], "a", 9.0, 0.9)], "company_id int, share_classes array<struct<security_id:string,price:double,fx_to_base:double,quote_status:string>>, observed_security_id string, observed_price double, observed_fx double")
    s = L.overlay_share_classes(comp).first().share_classes
    assert (s[0].price, s[0].quote_status, s[1].price) == (9.0, "VALID", 2.0)


def test_absences_and_reviews(spark):
    years = spark.createDataFrame([(1, 2024)], "company_id int, fiscal_year int")
    pts = spark.createDataFrame([(1, "FY2024.a")], "company_id int, field_id string")
    assert [r.field_id for r in L.explicit_absences(years, pts, ("a", "b")).collect()] == ["FY2024.b"]
    rev = spark.createDataFrame(
        [(1, 2024, "x", "ACCEPT", 5.0, 5.0, 5.0, {"a": True}, ["CNY", "CNY"], [None]), (1, 2023, "x", "ACCEPT", 5.0, 6.0, 5.0, {"a": False}, ["CNY", "HKD"], [1.0])],
        "company_id int, fiscal_year int, field string, decision string, value double, official_value double, candidate_value double, checks map<string,boolean>, currencies array<string>, forbidden_values array<double>",
    )
    good, bad = L.convert_reviewed(rev)
    assert good.first().field_id == "FY2024.x"
    assert bad.first().reasons == ["CHECK_FAILED", "VALUES_DIFFER", "CURRENCY_NOT_UNIQUE", "FORBIDDEN_NUMERIC_PRESENT"]


def test_current_scores_prefer_manual(spark):
    who = spark.createDataFrame([(1,), (2,), (3,)], "company_id int")
    ddl = "company_id int, score_id string, value double, source string, reason string, as_of_date date, expires_at date"
    d = dt.date
    manual = spark.createDataFrame([(1, "q", 70.0, "s", "r", d(2024, 1, 1), d(2024, 12, 31)), (2, "q", 70.0, "s", "r", d(2020, 1, 1), d(2020, 12, 31))], ddl)
    rev = spark.createDataFrame([(1, "q", 50.0, "s", "r", d(2024, 1, 1), d(2024, 12, 31)), (2, "q", 40.0, "s", "r", d(2024, 1, 1), d(2024, 6, 1)), (3, "q", 40.0, " ", "r", d(2024, 1, 1), d(2024, 6, 1))], ddl)
    got = {r.company_id: r.q for r in L.current_scores(who, manual, rev, "q", F.lit("2024-06-01").cast("date")).collect()}
    assert got == {1: 70.0, 2: 40.0, 3: None}


def test_provenance_contract(spark):
    ok = ("c", "f", "s", "d", "p", "FY", "currency", "O", "CNY")
    rows = [(*ok, 1.0, "VALID"), (*ok, None, "VALID"), (*ok, 0.0, "VALID"), (*ok, 1.0, "MISSING"), (" ", *ok[1:8], None, 5.0, "VALID")]
    df = spark.createDataFrame(rows, "company_id string, field_id string, source_name string, source_document string, source_url_or_local_path string, fiscal_period string, unit string, restatement_status string, currency string, value double, data_status string")
    got = [list(r.issues) for r in Q.provenance_issues(df).collect()]
    assert got == [[], ["VALUE_REQUIRED"], ["ZERO_NOT_MARKED"], ["VALUE_FORBIDDEN"], ["BLANK_PROVENANCE_TEXT", "CURRENCY_REQUIRED"]]


def test_bundle_and_self_hash(spark):
    m = spark.createDataFrame([("/a", 1, "h"), ("/b", 2, "h"), ("/c", 3, "h")], "path string, size long, sha256 string")
    p = spark.createDataFrame([("/a", 1, "h"), ("/b", 9, "x"), ("/d", 1, "h")], "path string, length long, sha256 string")
    got = {r.path: list(r.issues) for r in Q.bundle_issues(m, p).collect()}
    assert got == {"/a": [], "/b": ["SIZE_MISMATCH", "HASH_MISMATCH"], "/c": ["FILE_MISSING"], "/d": ["FILE_NOT_LISTED"]}
    good = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    h = spark.createDataFrame([("abc", good), ("abd", good), ("abc", "zz")], "content string, declared_sha256 string")
    assert [list(r.issues) for r in Q.self_hash_issues(h).collect()] == [[], ["HASH_MISMATCH"], ["HASH_FORMAT", "HASH_MISMATCH"]]


def test_fragments_on_page(spark):
    pages = spark.createDataFrame([("d", 1, "股份 总数 100")], "document_id string, page int, text string")
    checks = spark.createDataFrame([("a", "d", 1, ["股份总数"]), ("b", "d", 1, ["缺失"]), ("c", "d", 9, ["x"])], "check_id string, document_id string, page int, fragments array<string>")
    got = {r.check_id: list(r.issues) for r in Q.fragment_issues(checks, pages).collect()}
    assert got == {"a": [], "b": ["FRAGMENT_MISSING"], "c": ["PAGE_OUT_OF_RANGE"]}


def test_reviewed_score_audit(spark):
    dims = {"demand_resilience": 80, "competitive_position": 60, "substitution_and_asset_life": 60, "capital_intensity_and_cash_conversion": 61}
    d = dt.date
    rows = [
        ("business_durability", 65, dims, [], d(2024, 1, 1), d(2024, 12, 30), "u"),
        ("business_durability", 65, dims, ["STRUCTURAL_DEMAND_DECLINE"], d(2024, 1, 1), d(2025, 12, 30), ""),
        ("other", 1, {"x": 1}, [], d(2024, 1, 1), d(2023, 1, 1), "u"),
    ]
    df = spark.createDataFrame(rows, "score_id string, value int, dimensions map<string,int>, red_flags array<string>, as_of_date date, expires_at date, source string")
    got = [list(r.issues) for r in Q.reviewed_score_issues(df).collect()]
    assert got[0] == []
    assert got[1] == ["RED_FLAG_CAP:business_durability", "VALIDITY_TOO_LONG", "SOURCE_MISSING"]
    assert got[2] == ["SCORE_ID_UNKNOWN", "VALIDITY_ORDER"]


def test_last_valid(spark):
    cand = spark.createDataFrame([(1, "VALID", None, 5.0, 9), (2, "STALE", None, 5.0, 9), (3, "INVALID", "", 5.0, 9), (4, "INVALID", None, 5.0, 9), (5, "VALID", "BLOCKED", 5.0, 9)], "company_id int, data_status string, data_tier string, score double, run_at int")
    old = spark.createDataFrame([(2, 1.0, 1), (3, 1.0, 1)], "company_id int, score double, run_at int")
    got = {r.company_id: (r.score, r.data_status, r.update_status) for r in Q.last_valid(cand, old).collect()}
    assert got == {1: (5.0, "VALID", "CURRENT"), 2: (1.0, "STALE", "BLOCKED_USING_LAST_VALID"), 3: (1.0, "INVALID", "BLOCKED_USING_LAST_VALID"), 4: (5.0, "INVALID", "BLOCKED_NO_VALID_BASELINE"), 5: (None, "VALID", "BLOCKED")}


def test_capital_structure_and_vendor_value(spark):
    ddl = "company_id string, selected_security_id string, structure_kind string, material_share_classes array<string>, distribution_rights_equal boolean, selected_security_rights_factor double, vendor_semantics string, vendor_value_authorized boolean, direct_equivalent_shares_authorized boolean, official_equivalent_shares double, observed_relative_difference double, authorization_source_ids array<string>, as_of_date string, ads_ordinary_shares_per_security double"
    ok = ("c", "s", "SINGLE_CLASS", ["A"], True, 1.0, "VENDOR_COMPANY_MARKET_VALUE", True, True, 10.0, 0.01, ["x"], "2024-01-01", None)
    bad = ("c", "s", "A_H", ["A", "A"], None, 0.0, "UNRESOLVED", True, False, None, 0.2, [], None, None)
    got = [list(r.issues) for r in Q.capital_structure_issues(spark.createDataFrame([ok, bad], ddl)).collect()]
    assert got[0] == []
    assert got[1] == ["SHARE_CLASSES_INVALID", "RIGHTS_FACTOR_INVALID", "VENDOR_WITHOUT_EVIDENCE", "AUTHORIZED_WITHOUT_SHARES", "VENDOR_DIFFERENCE_ABOVE_LIMIT", "RIGHTS_NOT_EQUAL"]
    q = "selected_security_id string, vendor_value_authorized boolean, direct_equivalent_shares_authorized boolean, official_equivalent_shares double, security_id string, price double, fx_to_base double, total_market_value double, freshness string"
    rows = [("s", True, True, 100.0, "s", 2.0, 0.5, 200.0, "CURRENT"), ("s", True, True, 100.0, "s", 2.0, 1.0, 206.0, "STALE_LAST_GOOD"), ("s", True, True, 100.0, "s", 2.0, 1.0, 300.0, "CURRENT"), ("s", False, True, 100.0, "s", 2.0, 1.0, None, "CURRENT"), ("s", False, False, 100.0, "s", 2.0, 1.0, None, "CURRENT"), ("s", True, True, 1.0, "t", 2.0, 1.0, 1.0, "CURRENT"), ("s", True, True, 1.0, None, None, None, None, None)]
    v = V.vendor_value(spark.createDataFrame(rows, q)).collect()
    assert [(r.market_value, r.blocker) for r in v] == [
        (100.0, None), (206.0, None), (None, "VENDOR_EQUIVALENT_SHARES_DEVIATION_GT_5PCT"), (200.0, None), (None, "SEEV_NOT_AUTHORIZED"), (None, "SELECTED_SECURITY_IDENTITY_CONFLICT"), (None, "MARKET_OBSERVATION_MISSING"),
    ]
    assert list(v[1].market_warnings) == ["STALE_LAST_GOOD", "VENDOR_EQUIVALENT_SHARES_DEVIATION_2_TO_5PCT"]


def test_market_cap_is_all_or_nothing(spark):
    t = dt.datetime(2024, 1, 1, 10)
    ddl = "company_id int, security_id string, share_class string, price double, issued_shares double, fx_to_base double, price_timestamp timestamp, quote_status string, material boolean, rights_verified boolean, economic_rights_factor double"
    rows = [(1, "a", "A", 2.0, 10.0, 1.0, t, "VALID", True, True, 1.0), (1, "h", "H", 4.0, 5.0, 0.5, t, "VALID", True, True, 2.0), (2, "a", "A", 2.0, 10.0, 1.0, t, "VALID", True, True, 1.0), (3, "a", "A", None, 10.0, 1.0, t, "VALID", True, False, 1.0)]
    classes = spark.createDataFrame(rows, ddl)
    expected = spark.createDataFrame([(1, ["H", "A"]), (2, ["A", "H"]), (3, ["A"])], "company_id int, expected_classes array<string>")
    got = {r.company_id: (r.market_cap, r.blocker) for r in V.company_market_cap(classes, expected, F.lit("2024-01-01 12:00:00").cast("timestamp")).collect()}
    assert got == {1: (30.0, None), 2: (None, "SHARE_CLASSES_INCOMPLETE"), 3: (None, "CLASS_INPUT_INVALID")}
    s = spark.createDataFrame([(1, 0.8), (3, 0.8)], "company_id int, sustainable double")
    px = {(r.company_id, r.share_class): r.price_at_4pct for r in V.prices_at_four_percent(classes, s).collect()}
    assert px[(1, "A")] == pytest.approx(1.0) and px[(1, "H")] == pytest.approx(4.0) and px[(3, "A")] is None


def test_bank_never_falls_back(spark):
    names = V.COVERAGE_BUILDERS["BANK"][0]
    base = {n: 1.0 for n in names} | {"cet1_ratio": 0.10, "cet1_regulatory_minimum": 0.095, "adjusted_net_income": 100.0, "capital_generation_capacity": 80.0}
    rows = [("BANK", 90.0, 1000.0, *[base[n] for n in names]), ("BANK", 90.0, 1000.0, *[None if n == "credit_cost" else base[n] for n in names]), ("NON_FINANCIAL", 90.0, 50.0, *[None] * len(names)), ("SECURITIES", 90.0, 50.0, *[None] * len(names))]
    df = spark.createDataFrame(rows, "industry_kind string, h double, fcf_median double, " + ", ".join(f"{n} double" for n in names))
    got = V.coverage_by_industry(df).collect()
    assert got[0].capacity == pytest.approx(80 * 0.9 * 0.5) and got[0].sustainable == pytest.approx(36.0)
    assert (got[1].coverage_status, list(got[1].missing_fields)) == ("INSUFFICIENT_DATA", ["credit_cost"])
    assert got[2].sustainable == pytest.approx(45.0)
    assert list(got[3].missing_fields) == ["industry_specific_coverage_adapter"]


def test_text_candidates_against_the_prior_report(spark):
    from cashlens.operators.quality import text_candidate_check

    kind = "f string, value decimal(20,4), comparative_value decimal(20,4), match_count int, currency string, unit string, status string"
    from decimal import Decimal as N

    rows = [
        ("a", N(5), N(10000), 1, "CNY", "yuan", None),
        ("b", N(0), N(10001), 1, "CNY", "yuan", None),
        ("c", N(5), N(10002), 1, "CNY", "yuan", None),
        ("d", N(5), N(10000), 2, "CNY", "yuan", None),
        ("e", N(5), N(10000), 1, "HKD", "yuan", None),
        ("f", None, N(10000), 1, "CNY", "yuan", None),
        ("g", N(5), N(10000), 1, "CNY", "yuan", "CONFLICT"),
        (None, N(5), N(10000), 1, "CNY", "yuan", None),
        ("none", N(5), N(10000), 1, "CNY", "yuan", None),
    ]
    prior = [(k, N(10000), "CNY", "yuan") for k in ("a", "b", "c", "d", "e", "f", "g", None)]
    got = text_candidate_check(
        spark.createDataFrame(rows, kind), spark.createDataFrame(prior, "f string, value decimal(20,4), currency string, unit string"), ["f"]
    )
    want = {"a": "VALID", "b": "KNOWN_ZERO", "c": "CONFLICT", "d": "CONFLICT", "e": "REVIEW_REQUIRED", "f": "REVIEW_REQUIRED", "g": "CONFLICT", None: "VALID", "none": "REVIEW_REQUIRED"}
    assert {r.f: r.status for r in got.collect()} == want


def test_required_fields_of_doubled_and_empty_keys(spark):
    """Repeated years, classes and companies and empty keys; the ids are distinct and no aggregate holds them."""
    from cashlens.operators import quality as Q

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    years = frame([(1, 2020), (1, 2020), (1, None), (2, 2021), (None, 2020)], "company_id bigint, fiscal_year int")
    classes = frame([(1, 7, True), (1, 7, None), (1, None, True), (2, 8, False)], "company_id bigint, security_id bigint, material boolean")
    kinds = [(1, "NON_FINANCIAL"), (1, "BANK"), (2, "INSURANCE"), (3, None)]
    need = Q.required_field_ids(years, classes, years, frame(kinds, "company_id bigint, industry_kind string"), years.limit(1))
    want = {(k, None if y is None else f"FY{y}.{f}") for k, y in {(1, 2020), (1, None), (2, 2021), (None, 2020)} for f in Q.ANNUAL_FIELDS}
    want |= {(1, f"FY2020.{f}") for f in (*Q.CASH_FLOW_FIELDS, "net_debt")}
    want |= {(1, f) for f in ("MARKET.7.price", "MARKET.7.fx_to_base", "SECURITY.7.issued_shares", "SECURITY.7.economic_rights_factor")}
    want |= {(1, f"CURRENT.{f}") for f in Q.BANK_FIELDS} | {(2, f"CURRENT.{f}") for f in Q.INSURANCE_FIELDS}
    fixed = ["VALUATION.current", "VALUATION.historical_median", *[f"RECONCILIATION.{f}" for f in Q.RECONCILIATION_FIELDS]]
    want |= {(k, f) for k in (1, 2, 3) for f in fixed}
    got = [tuple(r) for r in need.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = need._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "field_id" in line]
