"""Report text on planted pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cashlens.functions import market as M
from cashlens.functions import text as X
from cashlens.functions.hashing import has_non_finite, public_summary
from cashlens.operators import documents as DOC


def ev(spark, fn, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r.y for r in df.select(fn(F.col("x")).alias("y")).collect()]


def test_amount_tokens(spark):
    got = ev(spark, lambda c: F.transform(X.amount_tokens(c), X.amount), "净额 1,234.50 （2,000） -3 v1.2.3 (4)")[0]
    assert [float(v) for v in got] == [1234.5, -2000.0, -3.0, -4.0]


def test_share_tokens(spark):
    assert ev(spark, X.integral_share_tokens, "股份总数 1,000 100.00% -5 1.5 2,000.00 100", "a 5 100") == [[1000, 2000], [5, 100]]


@pytest.mark.parametrize(
    "title,year",
    [("2024年年度报告", 2024), ("年報 2023", 2023), ("二〇二二年年报", 2022), ("Annual Report 2021", 2021), ("2020 Annual Report", 2020), ("2019/20 年報", 2020), ("2099/2101 年報", None), ("2024", 2024), ("notice", None)],
)
def test_fiscal_year(spark, title, year):
    assert ev(spark, X.fiscal_year, title) == [year]


def test_titles(spark):
    assert ev(spark, X.is_full_report_title, "2024年年度报告", "2024年年度报告摘要", "环境报告") == [True, False, False]
    assert ev(spark, lambda c: X.title_anomalies(c, F.lit(10)), "通函") == [["TITLE_IS_NOT_ANNUAL_REPORT", "TITLE_IS_CORRECTION_SUMMARY_OR_CIRCULAR", "DOCUMENT_TOO_SHORT_FOR_FULL_ANNUAL_REPORT"]]
    assert ev(spark, X.date_from_url, "https://x/2024-03-01/a.pdf", "https://x/a.pdf") == ["2024-03-01", None]


@pytest.mark.parametrize(
    "text,want",
    [
        ("2024年度股息已派付", "PAID"),
        ("已宣派股息，另有股息已支付", "AMBIGUOUS"),
        ("已宣派及派付股息，股息已支付", "PAID"),
        ("已宣派及派付股息", "DECLARED"),
        ("股东大会审议通过利润分配", "APPROVED"),
        ("尚需股东大会审议通过的利润分配方案", "PROPOSED"),
        ("利润分配预案经股东大会审议通过后实施", "PROPOSED"),
        ("2024年5月1日经股东大会审议通过，该预案经股东大会审议通过后实施", "APPROVED"),
        ("董事会建议末期股息", "PROPOSED"),
        ("宣派中期股息", "DECLARED"),
        ("股息", "UNKNOWN"),
    ],
)
def test_lifecycle(spark, text, want):
    assert ev(spark, lambda c: X.dividend_lifecycle(X.compact(c), F.lit("")), text) == [want]


def test_lifecycle_from_page(spark):
    assert ev(spark, lambda c: X.dividend_lifecycle(c, F.lit("本报告期利润分配预案")), "股息") == ["PROPOSED"]


def test_relevance(spark):
    got = ev(spark, lambda c: X.relevant_dividend_text(X.compact(c)), "派发股息 5 元", "每股收益与派发股息", "应付股息", "应付股息 已支付", "批准会议")
    assert got == [True, False, False, True, False]


def test_units(spark):
    got = ev(spark, lambda c: X.unit_context(c, F.lit("CNY"), F.lit("CN")), "单位：人民币百万元 RMB million", "单位：千元", "人民币元 千港元", "nothing")
    assert [(g.currency, g.multiplier, g.status) for g in got] == [("CNY", 1e6, "VALID"), ("CNY", 1e3, "VALID"), (None, None, "CONFLICT"), (None, None, "REVIEW")]
    assert ev(spark, X.share_multiplier, "股份數目\n千股", "股份數目 百萬股", "x") == [1000, 1000000, 1]


def test_years_and_identity(spark):
    got = ev(spark, lambda c: X.associated_year(X.compact(c), F.lit(2024)), "2023年度股息（2022年度）", "2023年及2022年", "二〇二一年股息", "本年度股息", "股息")
    assert [(g.year, g.basis) for g in got] == [(2023, "EXPLICIT"), (None, "AMBIGUOUS_MULTIPLE_YEARS"), (2021, "EXPLICIT"), (2024, "REPORT_CONTEXT"), (None, "MISSING")]
    assert ev(spark, lambda c: X.issuer_name_present(c, F.lit("测试能源股份有限公司")), "关于测试 能源 的报告", "别的公司") == [True, False]
    assert ev(spark, lambda c: X.ticker_present(c, F.lit("000651")), "股票代码：000651", "金额 651") == [True, False]
    assert ev(spark, lambda c: X.year_present(c, F.lit(2024)), "二零二四年", "2024", "2023") == [True, True, False]


def docs(spark, text, **extra):
    row = {"doc_id": 1, "company_id": 1, "fiscal_year": 2024, "market": "CN", "currency": "CNY", "sha256": "h", "text": text} | extra
    return spark.createDataFrame([tuple(row.values())], "doc_id int, company_id int, fiscal_year int, market string, currency string, sha256 string, text string")


FLOW = "目录\n合并现金流量表……12\n\f合并现金流量表\n单位：元\n一、经营活动产生的现金流量净额\n 1,000.00 900.00\n母公司现金流量表\n经营活动产生的现金流量净额 1 2\n"


def test_cash_flow_section(spark):
    r = DOC.unique_row(DOC.statement_rows(docs(spark, FLOW), X.CFO_LABELS)).first()
    assert (r.match_count, r.status, r.current_value, r.comparative_value, r.row_currency) == (1, "REVIEW", 1000.0, 900.0, "CNY")
    row = DOC.statement_rows(docs(spark, FLOW), X.CFO_LABELS).first().rows[0]
    assert (row.page, row.page_line, row.text_line) == (2, 3, 6)


def test_section_survives_page_break_but_not_equity_statement(spark):
    text = "合併現金流量表\n千港元\n\f經營活動產生的現金流量淨額 (5) 4\n權益變動表\n經營活動產生的現金流量淨額 7 8"
    rows = DOC.statement_rows(docs(spark, text), X.CFO_LABELS).first().rows
    assert [(r.current_value, r.comparative_value, r.currency) for r in rows] == [(-5000.0, 4000.0, "HKD")]


def test_several_rows_conflict(spark):
    text = "合并现金流量表\n人民币元\n经营活动现金流量净额 1 2\n经营活动现金流量净额 3 4"
    assert DOC.unique_row(DOC.statement_rows(docs(spark, text), X.CFO_LABELS)).first().status == "CONFLICT"


def test_wrapped_label(spark):
    text = "合并现金流量表\n人民币元\n购建固定资产、无形资产和其他\n长期资产支付的现金 -10.00\n20.00"
    rows = DOC.statement_rows(docs(spark, text), X.CAPEX_LABELS, absolute=True, wrapped=True).first().rows
    assert [(r.current_value, r.comparative_value) for r in rows] == [(10.0, 20.0)]


def test_dividend_evidence(spark):
    text = "建议2024年度每10股派发现金红利人民币3.50元(含税)\n\f2024年度已派发现金股息合计人民币1,200万元\n特别股息合计港币5百万元已支付"
    got = {(r.amount_kind, r.dividend_kind): r for r in DOC.dividend_evidence(docs(spark, text)).collect()}
    per = got[("PER_SHARE", "ORDINARY")]
    assert (float(per.value), per.unit, per.currency, per.lifecycle_status, per.associated_fiscal_year) == (3.5, "currency_per_10_shares", "CNY", "PROPOSED", 2024)
    special = [r for r in DOC.dividend_evidence(docs(spark, text)).collect() if r.currency == "HKD"]
    assert special and special[0].unit == "million_currency"


def test_per_share_amount_is_no_total(spark):
    text = "每股派发现金股息人民币0.50元，2024年度利润分配"
    kinds = {r.amount_kind for r in DOC.dividend_evidence(docs(spark, text)).collect()}
    assert "TOTAL" not in kinds


def test_slots(spark):
    ddl = "company_id int, fiscal_year int, dividend_kind string, lifecycle_status string, amount_kind string, associated_fiscal_year int, value double, currency string, unit string, share_basis int, component string"
    base = (1, 2024, "ORDINARY", "PAID", "TOTAL", 2024)
    rows = [(*base, 1.0, "CNY", "currency", None, "FINAL"), (*base, 2.0, "CNY", "currency", None, "FINAL"), (1, 2024, "ORDINARY", "PROPOSED", "TOTAL", 2024, 1.0, "CNY", "currency", None, "FINAL"), (1, 2024, "ORDINARY", "PROPOSED", "TOTAL", 2024, 2.0, "CNY", "currency", None, "INTERIM"), (1, 2024, "SPECIAL", "PAID", "TOTAL", 2024, 3.0, "CNY", "currency", None, "SPECIAL"), (1, 2024, "SPECIAL", "APPROVED", "TOTAL", 2024, 3.0, "CNY", "currency", None, "SPECIAL")]
    ev_ = spark.createDataFrame(rows, ddl)
    keys = ["company_id", "fiscal_year"]
    ledger = DOC.slot_ledger(ev_, DOC.resolve_slots(ev_, keys), keys).collect()
    got = {(r.dividend_kind, r.lifecycle_group, r.amount_kind): (r.slot_status, r.match_count, r.value) for r in ledger}
    assert len(got) == 12
    assert got[("ORDINARY", "PAID_OR_APPROVED", "TOTAL")] == ("CONFLICT", 2, None)
    assert got[("ORDINARY", "PROPOSED", "TOTAL")] == ("REVIEW", 2, None)
    assert got[("SPECIAL", "PAID_OR_APPROVED", "TOTAL")] == ("REVIEW", 2, 3.0)
    assert got[("SPECIAL", "DECLARED", "PER_SHARE")] == ("MISSING", 0, None)


def test_share_totals(spark):
    page = "股份变动情况 本次变动前 本次变动后 单位：股\n三、股份总数 1,000 100.00% 900 100.00\n"
    r = DOC.share_total_rows(docs(spark, page)).first()
    assert (r.opening_issued_shares, r.closing_issued_shares, r.status, list(r.markers)) == (1000, 900, "REVIEW", [])
    r = DOC.share_total_rows(docs(spark, page + "报告期内实施股份拆细\n股份总数 1 2")).first()
    assert (r.row_count, r.status, list(r.markers)) == (2, "CONFLICT", ["STOCK_SPLIT"])
    assert DOC.share_total_rows(docs(spark, "股份总数 5 6")).first().row_count == 0


def test_issued_heading(spark):
    df = spark.createDataFrame([(["法定股本", "1", "已發行及繳足", "2", "3"],)], "l array<string>")
    assert df.select(DOC.issued_lines(F.col("l")).alias("y")).first().y == [False, False, True, True, True]
    assert df.select(DOC.issued_lines(F.col("l"), 2).alias("y")).first().y == [False, False, True, True, False]


NOTE = "3. 發行股本\n股份數目\n法定股本\n於年初 9,000,000\n已發行及繳足\n於二〇二四年一月一日 1,500,000 15\n回購及註銷股份 (500,000)\n於二〇二四年十二月三十一日 1,000,000 10\n於二〇二三年十二月三十一日 7,000,000"


def test_share_note(spark):
    r = DOC.share_balance_rows(docs(spark, NOTE, market="HK")).first()
    assert (r.opening_issued_shares, r.closing_issued_shares, r.status) == (1500000, 1000000, "REVIEW")
    assert (r.cancelled_shares_candidate, r.cancel_status) == (500000, "VALID")
    assert DOC.share_balance_rows(docs(spark, "nothing")).first().cancel_status == "MISSING"


def test_share_note_lines_are_parsed_once(spark):
    """Only lines with a term are parsed, each rule's input once; a line without a term, another page and no year change nothing."""
    other = "附註\n已發行及繳足\n於二〇二四年一月一日 9,500,000"
    text = NOTE.replace("\n回購", "\n其他 2,000,000\n回購") + "\f" + other
    noted = docs(spark, text, market="HK")
    found = DOC.share_balance_rows(noted)
    r = found.first()
    assert (r.opening_issued_shares, r.closing_issued_shares, r.cancelled_shares_candidate) == (1500000, 1000000, 500000)
    twice = DOC.share_balance_rows(docs(spark, NOTE + "\f" + NOTE, market="HK")).first()
    assert (twice.opening_issued_shares, twice.status, twice.cancel_status) == (None, "CONFLICT", "CONFLICT")
    unknown = DOC.share_balance_rows(noted.withColumn("fiscal_year", F.lit(None).cast("int"))).first()
    assert (unknown.opening_issued_shares, unknown.closing_issued_shares, unknown.cancel_status) == (None, None, "MISSING")
    # the years of a line and of the lines before it
    assert found._jdf.queryExecution().optimizedPlan().toString().count("二〇零一三四五六七八九]{4}") == 2


def test_line_numbers(spark):
    rows = DOC.lines_of(docs(spark, "a\nb\n\fc").select("doc_id", "text")).orderBy("text_line").collect()
    assert [(r.page, r.page_line, r.text_line, r.line) for r in rows] == [(1, 1, 1, "a"), (1, 2, 2, "b"), (2, 1, 4, "c")]


def test_announcement_page(spark):
    html = '<table><tr><td>01/04/2024</td><td><a href="/x/abc.pdf">2023 年度報告</a></td></tr><tr><td>no</td></tr></table>'
    r = DOC.announcement_rows(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert [(x.title, str(x.publish_date), x.document_id, x.fiscal_year) for x in r] == [("2023 年度報告", "2024-04-01", "abc", 2023)]


def test_document_checks(spark):
    from cashlens.operators.quality import document_checks

    df = docs(spark, "测试公司 2024 年度报告 审计报告 合并现金流量表").withColumns(
        {k: F.lit(v) for k, v in {"selection_status": "SELECTED_CURRENT", "data_status": "VERIFIED", "source_level": "OFFICIAL_EXCHANGE", "source_url": "https://host.example/a.pdf", "source_document": "2024年年度报告", "actual_sha256": "h", "declared_sha256": "h", "company_name": "测试公司", "ticker": "1"}.items()}
        | {k: F.lit(v) for k, v in {"actual_pages": 60, "declared_pages": 60, "actual_size": 5, "declared_size": 6}.items()}
    )
    cols = DOC.document_check_columns(df, ["host.example"])
    names = [x for x in cols.columns if x not in df.columns]
    r = document_checks(cols, names).first()
    assert len(names) == 15 and list(r.failed_checks) == ["manifest_file_size_exact"] and not r.all_checks_hold


def test_market_words(spark):
    assert ev(spark, M.market_state, "MarketState.MORNING", " closed ", "??") == ["open", "closed", "unknown"]
    df = spark.createDataFrame([("2024-01-02 09:30:00", "US.X"), ("2024-01-02 09:30:00", "HK.1"), ("2024-01-02T09:30:00Z", "HK.1"), ("N/A", "HK.1")], "t string, k string")
    got = [r.y for r in df.select(F.date_format(M.quote_timestamp(F.col("t"), F.col("k")), "HH:mm").alias("y")).collect()]
    assert got == ["14:30", "01:30", "09:30", None]


def test_weekdays(spark):
    import datetime as dt

    days = [(dt.date(2024, 1, 1) + dt.timedelta(days=a), dt.date(2024, 1, 1) + dt.timedelta(days=b)) for a in range(7) for b in range(-2, 25)]
    df = spark.createDataFrame(days, "a date, b date")
    for r in df.select("a", "b", M.weekdays_between(F.col("a"), F.col("b")).alias("n")).collect():
        want = sum((r.a + dt.timedelta(days=k)).weekday() < 5 for k in range(1, (r.b - r.a).days + 1))
        assert r.n == want


def test_listing_codes(spark):
    df = spark.createDataFrame([("651",), ("600519",), ("abc",)], "x string")
    a = [(r.i, r.q) for r in df.select(M.a_share_fields(F.col("x"))["security_id"].alias("i"), M.a_share_fields(F.col("x"))["quote_code"].alias("q")).collect()]
    assert a == [("SZ000651", "SZ.000651"), ("SH600519", "SH.600519"), (None, None)]
    h = [r.i for r in df.select(M.h_share_fields(F.col("x"))["security_id"].alias("i")).collect()]
    assert h == ["HK0651", None, None]


def test_fx(spark):
    df = spark.createDataFrame([("2024-01-01", "CNY", 7.8), ("2024-01-01", "HKD", 8.5), ("2024-01-02", "CNY", 7.8)], "as_of string, currency string, rate double")
    assert [(r.as_of, r.rate) for r in M.cross_rate(df).collect()] == [("2024-01-01", round(7.8 / 8.5, 8))]


def test_non_finite_and_redaction(spark):
    df = spark.createDataFrame([(1.0, ["x"], {"a": (1.0,)}), (float("nan"), ["x"], None), (1.0, ["-Infinity"], None), (1.0, None, {"a": (float("inf"),)})], "v double, t array<string>, m map<string,struct<d:double>>")
    assert [r.y for r in df.select(has_non_finite(df).alias("y")).collect()] == [False, True, True, True]
    m = spark.createDataFrame([({"API_Token": "k", "path": "/root/x", "note": "ok"},)], "m map<string,string>")
    assert m.select(public_summary(F.col("m")).alias("y")).first().y == {"path": "[local path]", "note": "ok"}
