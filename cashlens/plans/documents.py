"""Queries over report text, titles and listing pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashlens.functions import text as X
from cashlens.operators import documents as DOC
from cashlens.plans.registry import query
from cashlens.plans.sqlparts import d, m, part, rnd, with_parts
from cashlens.sources import domain as D

c = F.col

UNIT_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 1000000 WHEN '5-LOW' THEN NULL ELSE 1 END"


@query(
    "report_cash_flow",
    f"""SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS match_count, CASE WHEN o_orderstatus = 'O' THEN 'CONFLICT' ELSE 'REVIEW' END AS status,
  CASE WHEN o_orderstatus <> 'O' THEN {d(m('o_totalprice'))} * CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 1 END * {UNIT_SQL} END AS current_value,
  CASE WHEN o_orderstatus <> 'O' THEN (o_orderkey + 1)::DOUBLE * {UNIT_SQL} END AS comparative_value,
  CASE WHEN o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW' THEN 'CNY' END AS row_currency FROM orders""",
)
def report_cash_flow(spark, sf):
    rows = DOC.statement_rows(D.report_texts(spark, sf), X.CFO_LABELS)
    return DOC.unique_row(rows).select("doc_id", "match_count", "status", "current_value", "comparative_value", "row_currency")


@query(
    "report_capex_wrapped",
    f"""SELECT o_orderkey AS doc_id, 1 AS match_count, CASE WHEN o_orderpriority <> '5-LOW' THEN {d(m('o_totalprice'))} * {UNIT_SQL} END AS current_value,
  CASE WHEN o_orderpriority <> '5-LOW' THEN (o_orderkey + 1)::DOUBLE * {UNIT_SQL} END AS comparative_value FROM orders""",
)
def report_capex_wrapped(spark, sf):
    rows = DOC.statement_rows(D.report_texts(spark, sf), X.CAPEX_LABELS, absolute=True, wrapped=True)
    return DOC.unique_row(rows).select("doc_id", "match_count", "current_value", "comparative_value")


part(
    "dividend",
    f"""SELECT o_orderkey AS doc_id, o_custkey AS company_id, year(o_orderdate) AS fiscal_year, CASE WHEN o_orderstatus = 'P' THEN 'PER_SHARE' ELSE 'TOTAL' END AS amount_kind,
  CASE WHEN o_orderstatus = 'P' THEN CAST(round({m('o_totalprice')} / CAST(100000 AS DECIMAL(18,0)), 2) AS DOUBLE) ELSE {d(m('o_totalprice'))} END AS value,
  CASE WHEN o_orderstatus = 'O' THEN 'HKD' ELSE 'CNY' END AS currency, CASE WHEN o_orderstatus = 'P' THEN 'currency_per_10_shares' ELSE 'currency' END AS unit,
  CASE WHEN o_orderstatus = 'O' THEN 'SPECIAL' ELSE 'ORDINARY' END AS dividend_kind, CASE o_orderstatus WHEN 'O' THEN 'SPECIAL' WHEN 'P' THEN 'FINAL' ELSE 'ANNUAL_TOTAL' END AS component,
  CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'P' THEN 'APPROVED' ELSE 'PROPOSED' END AS lifecycle_status, CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate) END AS associated_fiscal_year FROM orders""",
)


@query(
    "report_dividends",
    with_parts(
        "dividend",
        "SELECT doc_id, amount_kind, value, currency, unit, dividend_kind, component, lifecycle_status, associated_fiscal_year FROM dividend",
    ),
)
def report_dividends(spark, sf):
    return DOC.dividend_evidence(D.report_texts(spark, sf)).select(
        "doc_id",
        "amount_kind",
        c("value").cast("double").alias("value"),
        "currency",
        "unit",
        "dividend_kind",
        "component",
        "lifecycle_status",
        "associated_fiscal_year",
    )


@query(
    "slot_resolution",
    with_parts(
        "dividend",
        """SELECT company_id, fiscal_year, dividend_kind, CASE lifecycle_status WHEN 'PROPOSED' THEN 'PROPOSED' ELSE 'PAID_OR_APPROVED' END AS lifecycle_group, amount_kind, count(*) AS match_count,
  CASE WHEN min(value) = max(value) THEN 'REVIEW' ELSE 'CONFLICT' END AS slot_status, CASE WHEN min(value) = max(value) THEN min(value) END AS value
FROM dividend WHERE associated_fiscal_year = fiscal_year GROUP BY 1, 2, 3, 4, 5""",
    ),
)
def slot_resolution(spark, sf):
    ev = DOC.dividend_evidence(D.report_texts(spark, sf))
    return DOC.resolve_slots(ev, ["company_id", "fiscal_year"]).select(
        "company_id", "fiscal_year", "dividend_kind", "lifecycle_group", "amount_kind", "match_count", "slot_status", c("value").cast("double").alias("value")
    )


@query(
    "slot_ledger",
    with_parts(
        "dividend",
        """, used AS (SELECT DISTINCT company_id, fiscal_year, dividend_kind, CASE lifecycle_status WHEN 'PROPOSED' THEN 'PROPOSED' ELSE 'PAID_OR_APPROVED' END AS g, amount_kind FROM dividend WHERE associated_fiscal_year = fiscal_year)
SELECT k.fiscal_year, (SELECT count(*) FROM used u WHERE u.fiscal_year = k.fiscal_year) AS filled, k.n * 12 - (SELECT count(*) FROM used u WHERE u.fiscal_year = k.fiscal_year) AS missing
FROM (SELECT fiscal_year, count(DISTINCT company_id) AS n FROM dividend GROUP BY 1) k""",
    ).replace("\n, used AS", ",\nused AS"),
)
def slot_ledger(spark, sf):
    keys = ["company_id", "fiscal_year"]
    texts = D.report_texts(spark, sf)
    ledger = DOC.slot_ledger(texts, DOC.resolve_slots(DOC.dividend_evidence(texts), keys), keys)
    return ledger.groupBy("fiscal_year").agg(
        F.count(F.when(c("slot_status") != "MISSING", 1)).alias("filled"), F.count(F.when(c("slot_status") == "MISSING", 1)).alias("missing")
    )


@query(
    "report_share_totals",
    "SELECT o_orderkey AS doc_id, 1 AS row_count, o_orderkey + 1000000 AS opening_issued_shares, o_orderkey + 1000000 - o_custkey AS closing_issued_shares, 'REVIEW' AS status FROM orders",
)
def report_share_totals(spark, sf):
    return DOC.share_total_rows(D.report_texts(spark, sf)).select(
        "doc_id", "row_count", "opening_issued_shares", "closing_issued_shares", "status"
    )


@query(
    "share_note_balances",
    """SELECT o_orderkey AS doc_id, (o_orderkey + 1000000) * 1000 AS opening_issued_shares, (o_orderkey + 1000000 - o_custkey - 1) * 1000 AS closing_issued_shares,
  (o_custkey + 1) * 1000 AS cancelled_shares_candidate, 'REVIEW' AS status, 'VALID' AS cancel_status FROM orders""",
)
def share_note_balances(spark, sf):
    return DOC.share_balance_rows(D.share_notes(spark, sf)).select(
        "doc_id", "opening_issued_shares", "closing_issued_shares", "cancelled_shares_candidate", "status", "cancel_status"
    )


part(
    "text_line",
    "SELECT doc_id, lang, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line FROM documents WHERE length(text) > 0",
)


@query(
    "text_lines",
    with_parts(
        "text_line",
        "SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE trim(line) = '') AS blank_lines, max(length(line)) AS longest FROM text_line GROUP BY 1",
    ),
)
def text_lines(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    # Counted inside the row: no line leaves its document.
    lines = docs.select("doc_id", F.flatten(F.transform(F.split("text", "\f"), DOC.page_lines)).alias("l")).where(F.size("l") > 0)
    return lines.select(
        "doc_id",
        F.size("l").cast("bigint").alias("lines"),
        F.size(F.filter("l", lambda x: F.trim(x) == "")).cast("bigint").alias("blank_lines"),
        F.array_max(F.transform("l", F.length)).cast("bigint").alias("longest"),
    )


# The token rule without look-around (the SQL engine has none): mark every maximal run of digits, commas
# and dots, with an optional sign or bracket, then keep the runs that are one well-formed number.
@query(
    "text_amounts",
    """WITH run AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9.][0-9.,]*')) AS r FROM documents),
num AS (SELECT doc_id, regexp_extract(r, '^[0-9][0-9,]*(?:\\.[0-9]+)?', 0) AS v, r FROM run WHERE regexp_matches(r, '^[0-9][0-9,]*(\\.[0-9]+)?,*$'))
SELECT doc_id, count(*) AS tokens FROM num GROUP BY 1""",
)
def text_amounts(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "text").select("doc_id", X.amount_tokens(c("text")).alias("t"))
    return docs.where(F.size("t") > 0).select("doc_id", F.size("t").cast("bigint").alias("tokens"))


@query(
    "fiscal_year_titles",
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderpriority <> '5-LOW' AND NOT (o_orderpriority = '4-NOT SPECIFIED' AND year(o_orderdate) = 1995) THEN CAST(year(o_orderdate) + 5 AS INTEGER) END AS fiscal_year, o_orderpriority <> '5-LOW' AS full_report FROM orders""",
)
def fiscal_year_titles(spark, sf):
    docs = D.report_documents(spark, sf)
    return docs.select(
        "doc_id", X.fiscal_year(c("source_document")).alias("fiscal_year"), X.is_full_report_title(c("source_document")).alias("full_report")
    )


@query(
    "best_document_per_year",
    """WITH doc AS (SELECT o_custkey AS company_id, year(o_orderdate) + 5 AS fiscal_year, o_orderkey AS doc_id, CASE WHEN o_orderpriority IN ('1-URGENT') THEN 2 ELSE 1 END AS exact,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END AS restated, CAST(floor(o_totalprice) AS BIGINT) AS size, CAST(o_orderdate AS DATE) AS published FROM orders WHERE o_orderpriority <> '5-LOW' AND NOT (o_orderpriority = '4-NOT SPECIFIED' AND year(o_orderdate) = 1995))
SELECT company_id, CAST(fiscal_year AS INTEGER) AS fiscal_year, doc_id, CASE WHEN restated = 1 THEN 'RESTATED' ELSE 'ORIGINAL' END AS restatement_status, n AS candidate_count
FROM (SELECT *, count(*) OVER (PARTITION BY company_id, fiscal_year) AS n, row_number() OVER (PARTITION BY company_id, fiscal_year ORDER BY exact DESC, restated DESC, size DESC, published DESC, CAST(doc_id AS VARCHAR) DESC) AS k FROM doc)
WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC) <= 10""",
)
def best_document_per_year(spark, sf):
    docs = D.report_documents(spark, sf)
    dated = (
        docs.where(X.is_full_report_title(c("source_document")))
        .withColumn("fiscal_year", X.fiscal_year(c("source_document")))
        .withColumn("fiscal_year_end_date", F.make_date("fiscal_year", F.lit(12), F.lit(31)))
    )
    best = DOC.best_documents(dated, F.lit("2010-12-31").cast("date"))
    return best.select("company_id", "fiscal_year", "doc_id", "restatement_status", "candidate_count")


@query(
    "listing_rows",
    """WITH x AS (SELECT page_id, regexp_extract_all(html, '<li>\\s*<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>\\s*</li>', 1) AS h, regexp_extract_all(html, '<li>\\s*<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>\\s*</li>', 2) AS t FROM pages)
SELECT page_id, CAST(unnest(range(0, len(h))) AS INTEGER) AS position, unnest(h) AS href, trim(regexp_replace(unnest(t), '\\s+', ' ', 'g')) AS title FROM x""",
)
def listing_rows(spark, sf):
    return DOC.listing_rows(D.table(spark, sf, "pages")).select("page_id", "position", "href", "title")


@query(
    "news_titles",
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_matches(regexp_extract(html, '<title>([^<]*)</title>', 1), '(?i)dividend|buyback|repurchase|annual report|interim report') AS keyword_hit,
  nullif(regexp_extract(url, '^https?://([^/?#:]+)', 1), '') AS host FROM pages""",
)
def news_titles(spark, sf):
    p = D.table(spark, sf, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return p.select(
        "page_id", title.alias("title"), title.rlike(X.NEWS_PATTERN).alias("keyword_hit"), F.try_parse_url("url", F.lit("HOST")).alias("host")
    )
