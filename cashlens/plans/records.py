"""Queries that put records together and check them: joins, statuses, statement extracts, payload and review rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashlens.functions import policy as P
from cashlens.functions.numeric import half_up
from cashlens.operators import assembly as A
from cashlens.operators import events as E
from cashlens.operators import history as H
from cashlens.operators import ledger as L
from cashlens.operators import quality as Q
from cashlens.operators import valuation as V
from cashlens.plans import events as PE
from cashlens.plans import history as PH
from cashlens.plans import valuation as PV
from cashlens.plans.registry import query
from cashlens.plans.sqlparts import d, m, rnd, with_parts
from cashlens.sources import domain as D
from cashlens.sources import sinks

c = F.col


def joined(name: str):
    return F.array_join(c(name), ",").alias(name)


# ---------------------------------------------------------------- statement extracts and the yearly ledger

LABELS = {"1-URGENT": "短期借款", "2-HIGH": "长期借款", "3-MEDIUM": "经营活动产生的现金流量净额", "4-NOT SPECIFIED": "股本", "5-LOW": "其他"}
SQL_LABEL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END"


def statement_items(spark, sf):
    """Orders as statement lines: the priority is the label, some labels have blanks, large amounts are no number."""
    label = F.lit(None).cast("string")
    for k, v in LABELS.items():
        label = F.when(c("o_orderpriority") == k, v).otherwise(label)
    spaced = F.when((c("o_orderstatus") == "P") & (c("o_orderpriority") == "3-MEDIUM"), "经营活动 产生的现金流量净额").otherwise(label)
    amount = D.money("o_totalprice")
    return D.table(spark, sf, "orders").select(
        c("o_custkey").alias("company_id"),
        F.year("o_orderdate").alias("fiscal_year"),
        spaced.alias("label"),
        F.when(amount > 450_000, "--").otherwise(amount.cast("string")).alias("data"),
        c("o_orderkey").alias("item_id"),
    )


@query(
    "statement_extracts",
    f"""
WITH i AS (SELECT o_custkey AS company_id, year(o_orderdate) AS fiscal_year, {SQL_LABEL} AS label, CASE WHEN {m('o_totalprice')} > 450000 THEN NULL ELSE {m('o_totalprice')} END AS v, o_orderkey FROM orders),
e AS (SELECT company_id, fiscal_year, v FROM i WHERE label IN ('股本', '其他') AND v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_id, fiscal_year ORDER BY label = '其他', v) = 1)
SELECT company_id, fiscal_year, {d("sum(i.v) FILTER (WHERE label IN ('短期借款', '长期借款'))")} AS debt,
  {d("CASE WHEN count(*) FILTER (WHERE label = '经营活动产生的现金流量净额') = 1 THEN max(i.v) FILTER (WHERE label = '经营活动产生的现金流量净额') END")} AS cfo,
  CASE count(*) FILTER (WHERE label = '经营活动产生的现金流量净额') WHEN 0 THEN 'MISSING' WHEN 1 THEN CASE WHEN max(i.v) FILTER (WHERE label = '经营活动产生的现金流量净额') IS NULL THEN 'MISSING' ELSE 'VALID' END ELSE 'CONFLICT' END AS cfo_status,
  {d('any_value(e.v)')} AS equity
FROM i LEFT JOIN e USING (company_id, fiscal_year) GROUP BY 1, 2""",
)
def statement_extracts(spark, sf):
    keys = ["company_id", "fiscal_year"]
    items = statement_items(spark, sf)
    # one line per label and year, so that the best alias is one line
    least = items.groupBy(*keys, "label").agg(F.min(c("data").try_cast("decimal(18,2)")).cast("string").alias("data"))
    equity = L.first_by_alias(least, keys, {"equity": ("股本", "其他")}).select(*keys, c("value").alias("equity"))
    debt = L.interest_bearing_debt(items, keys)
    cfo = L.exact_extract(items, keys, ("经营活动产生的现金流量净额",), "cfo")
    rows = debt.join(cfo, keys).join(equity, keys, "left")
    return rows.select(*keys, c("interest_bearing_debt").cast("double").alias("debt"), c("cfo").cast("double").alias("cfo"), "cfo_status", c("equity").cast("double").alias("equity"))


@query(
    "yearly_source_ledger",
    f"""
WITH r AS (SELECT o_custkey AS company_id, year(o_orderdate) AS fiscal_year, o_orderstatus AS side, CASE WHEN o_orderpriority = '5-LOW' THEN 'USD' ELSE 'CNY' END AS currency, {d(m('o_totalprice'))} AS v
  FROM orders WHERE o_orderstatus IN ('F', 'O') QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), o_orderstatus ORDER BY o_orderkey DESC) = 1),
j AS (SELECT coalesce(a.company_id, b.company_id) AS company_id, coalesce(a.fiscal_year, b.fiscal_year) AS fiscal_year, coalesce(a.currency, b.currency) AS currency,
    coalesce(a.currency <> b.currency, false) AS bad, a.v AS cfo, b.v AS capital, a.company_id IS NOT NULL AS has_a, b.company_id IS NOT NULL AS has_b
  FROM (SELECT * FROM r WHERE side = 'F') a FULL JOIN (SELECT * FROM r WHERE side = 'O') b ON a.company_id = b.company_id AND a.fiscal_year = b.fiscal_year)
SELECT company_id, fiscal_year, currency, CASE WHEN NOT bad THEN cfo END AS operating_cash_flow, CASE WHEN NOT bad THEN capital END AS share_capital,
  CASE WHEN bad THEN 'CONFLICT' WHEN has_a THEN 'VALID' ELSE 'MISSING' END AS operating_cash_flow_status, CASE WHEN bad THEN 'CONFLICT' WHEN has_b THEN 'VALID' ELSE 'MISSING' END AS share_capital_status
FROM j QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC) <= 4""",
)
def yearly_source_ledger(spark, sf):
    o = D.table(spark, sf, "orders").where(c("o_orderstatus").isin("F", "O"))
    row = F.struct(
        F.when(c("o_orderpriority") == "5-LOW", "USD").otherwise("CNY").alias("currency"), D.money("o_totalprice").cast("double").alias("v")
    )
    newest = o.groupBy(c("o_custkey").alias("company_id"), F.year("o_orderdate").alias("fiscal_year"), "o_orderstatus").agg(F.max_by(row, "o_orderkey").alias("r"))
    period = [F.concat(F.lit("FY"), c("fiscal_year").cast("string")).alias("period_text"), F.make_date("fiscal_year", F.lit(12), F.lit(31)).alias("period_end")]
    side = lambda status, name: newest.where(c("o_orderstatus") == status).select(
        "company_id", "fiscal_year", *period, c("r.currency").alias("currency"), c("r.v").alias(name), F.lit("VALID").alias(f"{name}_status")
    )
    flow = side("F", "operating_cash_flow").withColumns({"capital_expenditure": F.lit(None).cast("double"), "capital_expenditure_status": F.lit(None).cast("string")})
    years = L.yearly_ledger(flow, side("O", "share_capital"), maximum=4)
    return years.select("company_id", "fiscal_year", "currency", "operating_cash_flow", "share_capital", "operating_cash_flow_status", "share_capital_status")


# ---------------------------------------------------------------- calendars and evidence joins


@query(
    "fiscal_calendars",
    """
SELECT c_custkey AS company_id, strftime(make_date(1999, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 12 + 1 AS INTEGER) ELSE n_regionkey * 2 + 3 END, CASE WHEN c_custkey % 5 = 0 THEN 28 ELSE 30 END), '%Y-%m-%d') AS fiscal_year_end
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def fiscal_calendars(spark, sf):
    companies = D.table(spark, sf, "customer").select(c("c_custkey").alias("company_id"), c("c_nationkey").alias("market"))
    overrides = companies.where(c("company_id") % 5 == 0).select("company_id", (c("company_id") % 12 + 1).cast("int").alias("month"), F.lit(28).alias("day"))
    defaults = D.table(spark, sf, "nation").select(c("n_nationkey").alias("market"), (c("n_regionkey") * 2 + 3).cast("int").alias("month"), F.lit(30).alias("day"))
    dated = L.default_calendar(companies, overrides, defaults, F.lit(1999))
    return dated.select("company_id", c("fiscal_year_end_date").cast("string").alias("fiscal_year_end"))


def yearly_documents(spark, sf, order):
    """One document per company and year: the order with the largest ``order``."""
    o = D.table(spark, sf, "orders")
    row = F.struct("o_orderkey", "o_orderstatus", "o_orderpriority", D.money("o_totalprice").alias("value"))
    best = o.groupBy(c("o_custkey").alias("company_id"), F.year("o_orderdate").alias("fiscal_year")).agg(F.max_by(row, F.struct(*order)).alias("r"))
    sha = F.sha2(c("r.o_orderkey").cast("string"), 256)
    return best.select("company_id", "fiscal_year", c("r.o_orderstatus").alias("scope"), c("r.value").alias("value"), sha.alias("sha256"), c("r.o_orderpriority").alias("source_document"), F.concat(F.lit("https://x/"), c("r.o_orderkey").cast("string")).alias("source_url"))


def sql_documents(order: str) -> str:
    return f"""SELECT o_custkey AS company_id, year(o_orderdate) AS fiscal_year, o_orderstatus AS scope, {m('o_totalprice')} AS value, sha256(CAST(o_orderkey AS VARCHAR)) AS sha, o_orderpriority AS document, o_orderkey
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY {order}) = 1"""


DOCUMENTS = f"WITH a AS ({sql_documents('o_orderkey DESC')}), b AS ({sql_documents('o_orderdate DESC, o_orderkey DESC')})"


@query(
    "candidate_review_issues",
    f"""{DOCUMENTS}, k AS (SELECT * FROM a WHERE scope <> 'P'), r AS (SELECT * FROM b WHERE document <> '5-LOW')
SELECT coalesce(k.company_id, r.company_id) AS company_id, coalesce(k.fiscal_year, r.fiscal_year) AS fiscal_year, CASE WHEN r.company_id IS NOT NULL THEN CASE WHEN r.scope = 'F' THEN 'ACCEPT' ELSE 'REJECT' END END AS decision,
  concat_ws(',', CASE WHEN r.company_id IS NULL THEN 'REVIEW_MISSING' END, CASE WHEN k.company_id IS NULL THEN 'CANDIDATE_MISSING' END, CASE WHEN k.scope <> r.scope THEN 'SCOPE_MISMATCH' END,
  CASE WHEN k.value <> r.value THEN 'VALUE_MISMATCH' END, CASE WHEN k.sha <> r.sha THEN 'SOURCE_HASH_MISMATCH' END) AS issues
FROM k FULL JOIN r ON k.company_id = r.company_id AND k.fiscal_year = r.fiscal_year""",
)
def candidate_review_issues(spark, sf):
    candidates = yearly_documents(spark, sf, ["o_orderkey"]).where(c("scope") != "P")
    reviews = yearly_documents(spark, sf, ["o_orderdate", "o_orderkey"]).where(c("source_document") != "5-LOW")
    reviews = reviews.withColumn("decision", F.when(c("scope") == "F", "ACCEPT").otherwise("REJECT"))
    return A.candidate_reviews(candidates, reviews).select("company_id", "fiscal_year", "decision", joined("issues"))


@query(
    "manifest_issues",
    f"""{DOCUMENTS}
SELECT company_id, fiscal_year, CASE WHEN b.scope = 'P' THEN 'DOCUMENT_NOT_SELECTED' ELSE concat_ws(',', CASE WHEN a.o_orderkey <> b.o_orderkey THEN 'SOURCE_URL_MISMATCH' END,
  CASE WHEN a.sha <> b.sha THEN 'SHA256_MISMATCH' END, CASE WHEN a.document <> b.document THEN 'SOURCE_DOCUMENT_MISMATCH' END) END AS issues
FROM a JOIN b USING (company_id, fiscal_year)""",
)
def manifest_issues(spark, sf):
    candidates = yearly_documents(spark, sf, ["o_orderkey"])
    manifest = yearly_documents(spark, sf, ["o_orderdate", "o_orderkey"])
    manifest = manifest.withColumn("selection_status", F.when(c("scope") == "P", "SUPERSEDED").otherwise("SELECTED_CURRENT"))
    return A.manifest_mismatches(candidates, manifest).select("company_id", "fiscal_year", joined("issues"))


@query(
    "cancellation_bridge",
    f"""{DOCUMENTS}
SELECT company_id, fiscal_year, CASE WHEN b.scope = 'F' THEN b.o_orderkey % 1000 END AS cancelled_shares, CASE WHEN b.scope <> 'F' OR b.scope IS NULL THEN 'NOT_DISCLOSED' WHEN b.document = '1-URGENT' THEN 'REVIEW' ELSE 'ACCEPT' END AS bridge_status
FROM a LEFT JOIN b USING (company_id, fiscal_year)""",
)
def cancellation_bridge(spark, sf):
    targets = yearly_documents(spark, sf, ["o_orderkey"]).select("company_id", "fiscal_year")
    found = yearly_documents(spark, sf, ["o_orderdate", "o_orderkey"]).where(c("scope") == "F")
    key = F.substring("source_url", 11, 30).cast("bigint")
    cancelled = found.select(
        "company_id", "fiscal_year", (key % 1000).alias("cancelled_shares"), F.when(c("source_document") == "1-URGENT", "REJECT").otherwise("ACCEPT").alias("decision")
    )
    return A.action_bridge(targets, cancelled)


# ---------------------------------------------------------------- jobs, queues, inputs beside each other

JOBS = """WITH j AS (SELECT user_id AS company_id, event_id AS job_id, ts, CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END AS status FROM events),
l AS (SELECT company_id, arg_max(status, row(ts, job_id)) AS latest_status, arg_max(job_id, row(ts, job_id)) AS latest_job_id, arg_max(job_id, row(ts, job_id)) FILTER (WHERE status = 'SUCCESS') AS success_job_id FROM j GROUP BY 1)"""


def jobs(spark, sf):
    status = F.when(c("event_type") == "purchase", "SUCCESS").when(c("event_type") == "error", "FAILED").otherwise("RUNNING")
    return D.table(spark, sf, "events").select(c("user_id").alias("company_id"), c("event_id").alias("job_id"), c("ts").alias("created_at"), status.alias("status"))


@query(
    "analysis_job_status",
    f"""{JOBS}, r AS (SELECT company_id, CASE WHEN company_id % 3 = 0 THEN arg_min(job_id, row(ts, job_id)) ELSE arg_max(job_id, row(ts, job_id)) END AS report FROM j WHERE status = 'SUCCESS' OR company_id % 4 = 0 GROUP BY 1
  UNION ALL SELECT -c_custkey - 1, c_custkey FROM customer WHERE c_custkey % 50 = 0)
SELECT coalesce(l.company_id, r.company_id) AS company_id, latest_job_id, success_job_id, CASE WHEN l.company_id IS NULL THEN 'REPORT_WITHOUT_JOB' WHEN latest_status = 'SUCCESS' AND report IS DISTINCT FROM latest_job_id THEN 'REPORT_PENDING' ELSE latest_status END AS public_status
FROM l FULL JOIN r ON l.company_id = r.company_id""",
)
def analysis_job_status(spark, sf):
    all_ = jobs(spark, sf)
    order = F.struct("created_at", "job_id")
    known = all_.where((c("status") == "SUCCESS") | (c("company_id") % 4 == 0)).groupBy("company_id").agg(F.min_by("job_id", order).alias("a"), F.max_by("job_id", order).alias("b"))
    reports = known.select("company_id", F.when(c("company_id") % 3 == 0, c("a")).otherwise(c("b")).alias("job_id"))
    lone = D.table(spark, sf, "customer").where(c("c_custkey") % 50 == 0).select((-c("c_custkey") - 1).alias("company_id"), c("c_custkey").alias("job_id"))
    return sinks.analysis_statuses(all_, reports.unionByName(lone)).select("company_id", "latest_job_id", "success_job_id", "public_status")


@query(
    "queue_status",
    f"""{JOBS}, s AS (SELECT company_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS latest_success_at FROM j WHERE status = 'SUCCESS' GROUP BY 1)
SELECT c_custkey AS company_id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN latest_status END, CASE WHEN c_acctbal > 5000 THEN 'INDEXED' END, 'NOT_REQUESTED') AS status, latest_success_at
FROM customer LEFT JOIN l ON l.company_id = c_custkey LEFT JOIN s ON s.company_id = c_custkey""",
)
def queue_status(spark, sf):
    order = F.struct("created_at", "job_id")
    all_ = jobs(spark, sf)
    queue = all_.where(c("company_id") % 2 == 0).groupBy("company_id").agg(F.max_by("status", order).alias("status"))
    success = all_.where(c("status") == "SUCCESS").groupBy("company_id").agg(F.max("created_at").alias("latest_success_at"))
    index = D.table(spark, sf, "customer").select(c("c_custkey").alias("company_id"), F.when(c("c_acctbal") > 5000, "INDEXED").alias("status"))
    rows = sinks.combined_status(queue, index, success)
    return rows.withColumn("latest_success_at", F.date_format("latest_success_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "prepared_inputs",
    f"""
WITH b AS (SELECT DISTINCT o_custkey AS company_id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)
SELECT c_custkey AS company_id, s_acctbal AS price, concat_ws(',', CASE WHEN c_acctbal <= 0 THEN 'AUTHORIZATION_MISSING' END, CASE WHEN s_suppkey IS NULL THEN 'MARKET_OBSERVATION_MISSING' END,
  CASE WHEN b.company_id IS NULL THEN 'BALANCE_SHEET_MISSING' END) AS input_issues FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN b ON b.company_id = c_custkey""",
)
def prepared_inputs(spark, sf):
    customers = D.table(spark, sf, "customer")
    staging = customers.select(c("c_custkey").alias("company_id"), "c_name")
    quotes = D.table(spark, sf, "supplier").select(c("s_suppkey").alias("company_id"), c("s_acctbal").alias("price"))
    registry = customers.where(c("c_acctbal") > 0).select(c("c_custkey").alias("company_id"), c("c_acctbal").alias("shares"))
    big = D.table(spark, sf, "orders").where((c("o_orderstatus") == "F") & (c("o_totalprice") > 300_000))
    balance = big.groupBy(c("o_custkey").alias("company_id")).agg(F.max("o_totalprice").alias("assets"))
    return A.prepare_inputs(staging, quotes, registry, balance).select("company_id", c("observation.price").alias("price"), joined("input_issues"))


@query(
    "watchlist_status",
    f"""{JOBS} SELECT s_suppkey AS issuer_id, c_acctbal AS balance, coalesce(latest_status, 'NOT_REQUESTED') AS analysis_status
FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey AND c_acctbal > 0 LEFT JOIN l ON l.company_id = s_suppkey""",
)
def watchlist_status(spark, sf):
    watch = D.table(spark, sf, "supplier").select(c("s_suppkey").alias("issuer_id"), "s_name")
    index = D.table(spark, sf, "customer").where(c("c_acctbal") > 0).select(c("c_custkey").alias("company_id"), c("c_acctbal").alias("balance"))
    analysis = jobs(spark, sf).groupBy("company_id").agg(F.max_by("status", F.struct("created_at", "job_id")).alias("status"))
    return A.enrich_watchlist(watch, index, analysis).select("issuer_id", c("screening.balance").alias("balance"), "analysis_status")


# ---------------------------------------------------------------- normalised events and their confirmation

NEWS = """n AS (SELECT event_id, user_id AS issuer_id, ts, '{"title":"' || event_type || '","url":"u' || event_id % 40 || '"}' AS payload, event_type AS title,
  'news:' || substr(sha256('["' || user_id || '","[\\"u' || event_id % 40 || '\\"]"]'), 1, 24) AS event_key FROM events)"""


def news(spark, sf):
    """Events as raw news of issuers: 40 urls, the event type as title, and a view count that keeps changing."""
    payload = F.create_map(
        F.lit("url"), F.concat(F.lit("u"), (c("event_id") % 40).cast("string")), F.lit("title"), c("event_type"), F.lit("view_count"), c("value").cast("string")
    )
    return D.table(spark, sf, "events").select(
        c("user_id").alias("issuer_id"), c("user_id").cast("string").alias("quote_code"), F.lit("news").alias("event_type"), payload.alias("payload"), c("ts").alias("observed_at"), c("event_id").alias("batch_seq")
    )


@query("normalized_news", f"WITH {NEWS} SELECT event_id AS batch_seq, event_key, sha256(payload) AS payload_hash FROM n")
def normalized_news(spark, sf):
    return E.normalize(news(spark, sf)).select("batch_seq", "event_key", "payload_hash")


@query(
    "confirmed_news",
    f"""WITH {NEWS}, s AS (SELECT event_key, arg_max(payload, row(ts, event_id)) AS payload, arg_max(title, row(ts, event_id)) AS title FROM n WHERE event_id % 5 <> 0 GROUP BY 1),
x AS (SELECT event_key, any_value(issuer_id) AS issuer_id, arg_min(payload, row(ts, event_id)) AS payload, arg_min(title, row(ts, event_id)) AS title FROM n GROUP BY 1)
SELECT event_key, concat_ws(',', CASE WHEN s.event_key IS NULL THEN 'EVENT_NOT_FOUND' END, CASE WHEN s.event_key IS NOT NULL AND issuer_id % 10 = 0 THEN 'ISSUER_MISMATCH' END,
  CASE WHEN s.payload <> x.payload THEN 'PAYLOAD_HASH_MISMATCH' END, CASE WHEN s.title <> x.title THEN 'VALUE_MISMATCH' END) AS issues FROM x LEFT JOIN s USING (event_key)""",
)
def confirmed_news(spark, sf):
    rows = E.normalize(news(spark, sf))
    order = F.struct("observed_at", "batch_seq")
    content = F.struct("issuer_id", "event_type", "payload_hash", "payload")
    state = rows.where(c("batch_seq") % 5 != 0).groupBy("event_key").agg(F.max_by(content, order).alias("s")).select("event_key", "s.*")
    first = rows.groupBy("event_key").agg(F.min_by(content, order).alias("s")).select("event_key", "s.*")
    other = F.when(c("issuer_id") % 10 == 0, c("issuer_id") + 1).otherwise(c("issuer_id"))
    wanted = F.map_filter("payload", lambda k, _: k == "title")
    expected = first.select("event_key", other.alias("issuer_id"), "event_type", "payload_hash", wanted.alias("expected_values"))
    return E.confirm(expected, state).select("event_key", joined("issues"))


# ---------------------------------------------------------------- payloads, reviews, evidence

PAYLOAD = ("schema_version", "prompt_version", "model", "reasoning_effort", "analysis_mode", "company_id", "input_snapshot_hash", "calculation_version")


@query(
    "analysis_payload_issues",
    """
WITH p AS (SELECT event_id AS id, user_id AS company, event_type AS kind, value AS v, props,
    CASE event_id % 9 WHEN 0 THEN ['https://a.org/x', 'http://B.cn:80/y'] WHEN 1 THEN ['ftp://a.org'] WHEN 2 THEN ['https://localhost/x'] WHEN 3 THEN ['HTTPS://WWW.Example.com?q'] WHEN 4 THEN ['https://u:p@db.local/']
      WHEN 5 THEN ['https://x.invalid#f', 'https://'] WHEN 6 THEN ['https://notexample.com'] WHEN 7 THEN [] ELSE [NULL] END AS urls FROM events)
SELECT id AS event_id, concat_ws(',', CASE WHEN id % 50 = 7 THEN 'JOB_UNKNOWN' END, CASE WHEN id % 50 <> 7 AND id % 11 = 0 THEN 'IDENTITY:prompt_version' END, CASE WHEN id % 50 <> 7 AND id % 13 = 0 THEN 'IDENTITY:input_snapshot_hash' END,
  CASE WHEN id % 50 <> 7 AND kind = 'view' THEN 'TRIGGER_MISMATCH' END, CASE WHEN company % 6 = 1 THEN 'SNAPSHOT:market' END, CASE WHEN v > 150 THEN 'RAW_HTML' END, CASE WHEN id % 9 IN (1, 5, 8) THEN 'SOURCE_SCHEME' END,
  CASE WHEN id % 9 IN (2, 3, 4, 5) THEN 'SOURCE_NOT_PUBLIC' END, CASE WHEN kind = 'error' AND id % 3 = 0 THEN 'URGENT_SCALE_IN' END, CASE WHEN (v < 5) <> (v < 10) THEN 'DATA_ISSUE_DISAGREES' END) AS issues
FROM p WHERE company IN (SELECT c_custkey FROM customer)""",
)
def analysis_payload_issues(spark, sf):
    """Events as analysis payloads: their jobs and company snapshots say what they should be."""
    i, v = c("event_id"), c("value")
    choices = [
        ["https://a.org/x", "http://B.cn:80/y"], ["ftp://a.org"], ["https://localhost/x"], ["HTTPS://WWW.Example.com?q"], ["https://u:p@db.local/"],
        ["https://x.invalid#f", "https://"], ["https://notexample.com"], [], [None],
    ]
    text = lambda x: F.array(*[F.lit(u).cast("string") for u in x]).cast("array<string>")
    urls = text(choices[8])
    for k, x in enumerate(choices[:8]):
        urls = F.when(i % 9 == k, text(x)).otherwise(urls)
    e = D.table(spark, sf, "events").join(D.table(spark, sf, "customer").select(c("c_custkey").alias("user_id"), "c_name", "c_mktsegment"), "user_id")
    base = {
        "schema_version": F.lit("2"),
        "prompt_version": F.lit("p1"),
        "model": F.lit("m"),
        "reasoning_effort": F.lit("high"),
        "analysis_mode": F.when(c("event_type") == "error", "URGENT_RISK_REVIEW").otherwise("FULL_ENTRY_REVIEW"),
        "company_id": c("user_id"),
        "input_snapshot_hash": F.sha2("props", 256),
        "calculation_version": F.lit("v2.1"),
    }
    payloads = e.select(
        i.alias("event_id"),
        i.alias("analysis_id"),
        *[x.alias(k) for k, x in base.items()],
        c("event_type").alias("trigger_type"),
        c("c_name").alias("company_name"),
        F.lit("T").alias("ticker"),
        c("c_mktsegment").alias("market"),
        F.lit("2024-01-31").alias("as_of_date"),
        F.when(v > 150, "a <b>").otherwise("plain").alias("report_markdown"),
        urls.alias("source_urls"),
        F.when(i % 3 == 0, "SCALE_IN").otherwise("HOLD").alias("verdict"),
        (v < 5).alias("data_issue_detected"),
        F.when(v < 10, F.array(F.lit("note"))).otherwise(F.array().cast("array<string>")).alias("data_issue_notes"),
    )
    expected = dict(base) | {
        "prompt_version": F.when(i % 11 == 0, "p2").otherwise("p1"),
        "input_snapshot_hash": F.when(i % 13 == 0, F.lit(None).cast("string")).otherwise(F.sha2("props", 256)),
    }
    queued = e.where(i % 50 != 7).select(i.alias("analysis_id"), *[x.alias(k) for k, x in expected.items()], F.when(c("event_type") == "view", "other").otherwise(c("event_type")).alias("trigger_type"))
    snapshots = D.table(spark, sf, "customer").select(
        c("c_custkey").alias("company_id"),
        c("c_name").alias("company_name"),
        F.lit(None).cast("string").alias("ticker"),
        F.when(c("c_custkey") % 6 == 1, "?").otherwise(c("c_mktsegment")).alias("market"),
        F.lit("2024-01-31").alias("as_of_date"),
    )
    return Q.analysis_output_issues(payloads, queued, snapshots).select("event_id", joined("issues"))


RUBRIC = P.REVIEW_RUBRIC["business_durability"]


@query(
    "reviewed_score_audit",
    f"""
WITH p AS (SELECT p_partkey AS k, p_partkey % 101 AS a, p_size AS b, p_partkey * 7 % 110 AS x, p_partkey % 4 AS f FROM part),
s AS (SELECT *, floor((a + b + x + 50) / 4.0 + 0.5) AS mean FROM p), v AS (SELECT *, mean + CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS value FROM s)
SELECT k AS p_partkey, concat_ws(',', CASE WHEN k % 8 = 0 THEN 'DIMENSIONS_MISMATCH:business_durability' END, CASE WHEN f = 1 THEN 'UNKNOWN_RED_FLAG:business_durability' END,
  CASE WHEN f IN (1, 2) AND value > {RUBRIC['red_flag_cap']} THEN 'RED_FLAG_CAP:business_durability' END, CASE WHEN k % 30 = 3 THEN 'SCORE_ID_UNKNOWN' END, CASE WHEN x > 100 THEN 'DIMENSION_OUT_OF_RANGE' END,
  CASE WHEN k % 9 = 0 THEN 'MEAN_MISMATCH' END, CASE WHEN b * 10 > 365 THEN 'VALIDITY_TOO_LONG' END, CASE WHEN b = 1 THEN 'VALIDITY_ORDER' END, CASE WHEN k % 25 = 0 THEN 'SOURCE_MISSING' END) AS issues FROM v
""".replace("CASE WHEN k % 8 = 0 THEN", "CASE WHEN k % 30 <> 3 AND k % 8 = 0 THEN").replace("CASE WHEN f = 1 THEN", "CASE WHEN k % 30 <> 3 AND f = 1 THEN").replace("CASE WHEN f IN (1, 2) AND", "CASE WHEN k % 30 <> 3 AND f IN (1, 2) AND"),
)
def reviewed_score_audit(spark, sf):
    k, size = c("p_partkey"), c("p_size")
    names = [F.lit(x) for x in RUBRIC["dimensions"]]
    values = [(k % 101).cast("int"), size, (k * 7 % 110).cast("int"), F.lit(50)]
    last = F.when(k % 8 == 0, "other").otherwise(names[3])
    dims = F.map_from_arrays(F.array(*names[:3], last), F.array(*values))
    mean = F.floor((values[0] + values[1] + values[2] + values[3]) / 4.0 + 0.5)
    flags = F.when(k % 4 == 1, F.array(F.lit("NO_SUCH_FLAG"))).when(k % 4 == 2, F.array(F.lit(RUBRIC["red_flags"][0]))).otherwise(F.array().cast("array<string>"))
    start = F.lit("2024-01-01").cast("date")
    rows = D.table(spark, sf, "part").select(
        k,
        F.when(k % 30 == 3, "luck").otherwise("business_durability").alias("score_id"),
        (mean + F.when(k % 9 == 0, 1).otherwise(0)).alias("value"),
        dims.alias("dimensions"),
        flags.alias("red_flags"),
        start.alias("as_of_date"),
        F.when(size == 1, F.date_add(start, -1)).otherwise(F.date_add(start, size * 10)).alias("expires_at"),
        F.when(k % 25 == 0, " ").otherwise("review").alias("source"),
    )
    return Q.reviewed_score_issues(rows).select("p_partkey", joined("issues"))


@query(
    "publishable_snapshots",
    f"""
WITH k AS (SELECT c_custkey AS company_id, {d(m('c_acctbal'))} AS score, CASE c_custkey % 4 WHEN 0 THEN 'BLOCKED' WHEN 1 THEN 'VERIFIED' END AS tier, CASE c_custkey % 5 WHEN 0 THEN 'VALID' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'STALE' ELSE 'INVALID' END AS status FROM customer),
j AS (SELECT k.*, s_suppkey IS NOT NULL AS has, {d(m('s_acctbal'))} AS old, tier IS NOT NULL OR status IN ('VALID', 'PARTIAL') AS cur FROM k LEFT JOIN supplier ON s_suppkey = company_id)
SELECT company_id, CASE WHEN tier = 'BLOCKED' THEN NULL WHEN NOT cur AND has THEN old ELSE score END AS score, CASE WHEN NOT cur AND has THEN CASE WHEN status = 'STALE' THEN 'STALE' ELSE 'INVALID' END ELSE status END AS data_status,
  CASE WHEN tier = 'BLOCKED' THEN 'BLOCKED' WHEN NOT cur AND has THEN 'BLOCKED_USING_LAST_VALID' WHEN NOT cur THEN 'BLOCKED_NO_VALID_BASELINE' ELSE 'CURRENT' END AS update_status FROM j""",
)
def publishable_snapshots(spark, sf):
    k = c("c_custkey")
    candidate = D.table(spark, sf, "customer").select(
        k.alias("company_id"),
        D.money("c_acctbal").cast("double").alias("score"),
        F.lit("2024-02-01").cast("date").alias("run_at"),
        F.when(k % 4 == 0, "BLOCKED").when(k % 4 == 1, "VERIFIED").alias("data_tier"),
        F.when(k % 5 == 0, "VALID").when(k % 5 == 1, "PARTIAL").when(k % 5 == 2, "STALE").otherwise("INVALID").alias("data_status"),
    )
    stored = D.table(spark, sf, "supplier").select(c("s_suppkey").alias("company_id"), D.money("s_acctbal").cast("double").alias("score"), F.lit("2024-01-01").cast("date").alias("run_at"))
    return Q.last_valid(candidate, stored).select("company_id", "score", "data_status", "update_status")


@query(
    "page_evidence",
    r"""
WITH p AS (SELECT page_id, regexp_replace(html, '[\t\n\x0B\f\r ]+', '', 'g') AS t FROM pages WHERE page_id % 10 <> 3),
k AS (SELECT page_id, list_transform([split_part(url, '/', 3), '</ body >', 'no such words', 'h 1'], lambda x: x) AS f FROM pages)
SELECT page_id, CASE WHEN t IS NULL THEN array_to_string(f, '|') ELSE array_to_string(list_filter(f, lambda x: NOT contains(t, regexp_replace(x, '\s+', '', 'g'))), '|') END AS missing,
  CASE WHEN t IS NULL THEN 'PAGE_OUT_OF_RANGE' WHEN len(list_filter(f, lambda x: NOT contains(t, regexp_replace(x, '\s+', '', 'g')))) > 0 THEN 'FRAGMENT_MISSING' ELSE '' END AS issues FROM k LEFT JOIN p USING (page_id)""",
)
def page_evidence(spark, sf):
    pages = D.table(spark, sf, "pages")
    fragments = F.array(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("</ body >"), F.lit("no such words"), F.lit("h 1"))
    checks = pages.select(c("page_id").alias("check_id"), c("page_id").alias("document_id"), F.lit(1).alias("page"), fragments.alias("fragments"))
    texts = pages.where(c("page_id") % 10 != 3).select(c("page_id").alias("document_id"), F.lit(1).alias("page"), c("html").alias("text"))
    found = Q.fragment_issues(checks, texts)
    return found.select(c("check_id").alias("page_id"), F.array_join("missing_fragments", "|").alias("missing"), joined("issues"))


@query(
    "analysis_gate",
    with_parts(
        "run",
        f"""SELECT company_id, {PE.sql_stamp('run_at')} AS run_at, CASE WHEN company_id % 2 = 0 THEN eri >= 1 AND (raw_yield >= 0.05 OR list_contains(kinds, 'error'))
  WHEN eri < 5 THEN false WHEN list_contains(kinds, 'view') THEN ssy >= 0.02 AND NOT list_contains(kinds, 'signup')
  ELSE list_contains(kinds, 'click') OR (list_contains(kinds, 'error') AND ssy >= 0.02 AND list_contains(kinds, 'signup')) END AS analysis_eligible FROM run""",
    ),
)
def analysis_gate(spark, sf):
    has = lambda x: F.array_contains("kinds", x)
    runs = D.company_runs(spark, sf).withColumns(
        {
            "schema_version": F.when(c("company_id") % 2 == 0, A.PUBLIC_SCHEMA),
            "status": F.when(c("eri") < 1, "UNAVAILABLE").otherwise("READY"),
            "company_name": F.lit("n"),
            "has_sources": F.lit(True),
            "trigger_eligible": c("raw_yield") >= 0.05,
            "event_codes": F.filter("kinds", lambda k: k == "error"),
            "data_tier": F.when(c("eri") < 5, "BLOCKED").when(has("view"), "VERIFIED"),
            "eligible": c("ssy") >= 0.02,
            "eligibility_status": F.when(has("signup") & has("view"), "OTHER").otherwise("CORE_VALID_QUALITATIVE_OVERLAY_PENDING"),
            "data_status": F.when(has("click"), "VALID").when(has("error"), "PARTIAL").otherwise("STALE"),
            "missing_scores": F.when(has("signup"), F.array(F.lit("business_durability"))).otherwise(F.array().cast("array<string>")),
        }
    ).withColumn("company_id", c("company_id").cast("string"))
    return A.analysis_eligible(runs).select(c("company_id").cast("bigint").alias("company_id"), PE.stamp(c("run_at")).alias("run_at"), "analysis_eligible")


# ---------------------------------------------------------------- entry risk, index and class of the verified line


def snapshot_sql() -> str:
    u, w = P.RISK_UPLIFTS, P.WEIGHTS["entry_risk"]
    bound = lambda x: f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, {x}))"
    unknown = f"{u['unknown_qualitative_default']}::DOUBLE"
    parts = {
        "distribution_deterioration": f"coalesce(100.0 - tr, {unknown})",
        "coverage": f"coalesce(100.0 - cov, {unknown})",
        "balance_sheet": f"coalesce(100.0 - bs, {unknown})",
        "structural_cycle": f"coalesce(cycle, {unknown})",
        "policy_asset_life": unknown,
        "valuation": f"{u['current_only_valuation_default']}::DOUBLE",
        "governance": f"coalesce(100.0 - gov, {unknown})",
    }
    risk = " + ".join(f"{bound(x)} * {w[k]}::DOUBLE" for k, x in parts.items())
    lift = f"CASE WHEN n_years < 3 THEN {u['unknown_veto']}::DOUBLE ELSE 0.0::DOUBLE END + least({u['triggered_warning_cap']}::DOUBLE, {u['triggered_warning_each']}::DOUBLE * warnings)"
    rw, rd = P.WEIGHTS["recommendation"], P.RECOMMENDATION_DEFAULTS
    index = (
        f"{bound('rs')} * {rw['return_score']}::DOUBLE + {bound('payout')} * {rw['payout_quality']}::DOUBLE + "
        f"coalesce(bus, {rd['missing_business_durability']}::DOUBLE) * {rw['business_durability']}::DOUBLE + coalesce(gov, {rd['missing_governance_capital_allocation']}::DOUBLE) * {rw['governance_capital_allocation']}::DOUBLE"
    )
    a, b, dd = (P.CLASS_BANDS[x] for x in "ABD")
    return with_parts(
        "fast",
        f"""SELECT company_id, {rnd('ssy', 8)} AS ssy, {rnd('cr10', 8)} AS cr10, {rnd('eri', 4)} AS entry_risk_index, {rnd('ri', 4)} AS recommendation_index,
  CASE WHEN warnings >= 4 THEN 'D' WHEN ri IS NULL OR eri IS NULL THEN 'C' WHEN ri < {dd[0]} OR eri > {dd[1]} THEN 'D' WHEN NOT complete THEN 'C' WHEN ri >= {a[0]} AND eri <= {a[1]} AND warnings = 0 THEN 'A' WHEN ri >= {b[0]} AND eri <= {b[1]} THEN 'B' ELSE 'C' END AS recommendation_class,
  CASE WHEN ssy IS NOT NULL AND cr10 IS NOT NULL THEN CASE WHEN ssy >= 0.04 THEN 'CASH_ANCHORED' WHEN cr10 >= 0.04 THEN 'GROWTH_SUPPLEMENTED' ELSE 'BELOW_THRESHOLD' END END AS return_type
FROM (SELECT *, {rnd(bound(f'({risk}) + {lift}'), 4)} AS eri, CASE WHEN rs IS NULL OR payout IS NULL THEN NULL ELSE {bound(f'({index})')} END AS ri, bus IS NOT NULL AND gov IS NOT NULL AS complete
  FROM (SELECT f.company_id, f.ssy, f.cr10, f.rs, f.payout, f.n_years, s.cov, s.tr, s.bs, CASE WHEN f.company_id % 3 <> 0 THEN 90.0::DOUBLE - f.company_id % 40 END AS bus, CASE WHEN f.company_id % 4 <> 0 THEN 95.0::DOUBLE - f.company_id % 30 END AS gov,
      CASE WHEN f.company_id % 5 <> 0 THEN CAST(f.company_id % 50 AS DOUBLE) END AS cycle, f.company_id % 5 AS warnings FROM fast f JOIN slow s USING (company_id)))""",
    )


@query("company_snapshot", snapshot_sql())
def company_snapshot(spark, sf):
    """One row per company: yields, ten-year return, entry risk and recommendation of the verified line, class and type."""
    k = c("company_id")
    scores = {
        "business_durability": F.when(k % 3 != 0, 90.0 - k % 40),
        "governance": F.when(k % 4 != 0, 95.0 - k % 30),
        "structural_cycle": F.when(k % 5 != 0, (k % 50).cast("double")),
        "policy_asset_life": F.lit(None).cast("double"),
        "valuation_trap": F.lit(None).cast("double"),
        "warning_flags": (k % 5).cast("int"),
    }
    slow = PH.slow(spark, sf).withColumns(scores)
    drag = slow.select("company_id", V.valuation_drag(c("m5"), c("latest")).alias("drag"))
    fast = V.fast_variables(slow, PV.market_caps(spark, sf), drag)
    risk = H.entry_risk(fast.withColumn("veto_config_incomplete", c("n_years") < 3).drop("entry_risk_index"))
    done = V.recommendation(risk.drop("recommendation_index", "recommendation_complete"))
    flags = c("warning_flags")
    cls = V.recommendation_class(c("recommendation_index"), c("entry_risk_index"), flags > 0, flags >= 4, c("recommendation_complete"))
    return done.select(
        "company_id",
        half_up(c("ssy"), 8).alias("ssy"),
        half_up(c("cr10"), 8).alias("cr10"),
        half_up(c("entry_risk_index"), 4).alias("entry_risk_index"),
        half_up(c("recommendation_index"), 4).alias("recommendation_index"),
        cls.alias("recommendation_class"),
        "return_type",
    )
