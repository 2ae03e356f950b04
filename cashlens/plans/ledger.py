"""Queries over provenance points, report reconciliation and quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashlens.functions.numeric import half_up
from cashlens.operators import ledger as L
from cashlens.operators import quality as Q
from cashlens.plans import screening as SC
from cashlens.plans.registry import query
from cashlens.plans.sqlparts import d, m, part, rnd, with_parts
from cashlens.sources import domain as D

c = F.col
AMT = m("o_totalprice")

part(
    "point",
    f"""SELECT *, 'FY' || fiscal_year || '.' || field AS field_id, lower(replace(source_name, ' ', '-')) AS source_document, CASE WHEN data_status = 'VALID' THEN amount END AS value
FROM (SELECT o_custkey AS company_id, year(o_orderdate) AS fiscal_year, o_orderkey AS seq, o_orderdate AS source_fetch_time, {AMT} AS amount, o_orderstatus,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'net_profit' WHEN '2-HIGH' THEN 'operating_cash_flow' WHEN '3-MEDIUM' THEN 'capital_expenditure' WHEN '4-NOT SPECIFIED' THEN 'total_equity' WHEN '5-LOW' THEN 'cash' END AS field,
  CASE WHEN o_orderstatus <> 'P' THEN 'VALID' WHEN {AMT} > 400000 THEN 'CONFLICT' ELSE 'MISSING' END AS data_status,
  CASE o_orderstatus WHEN 'F' THEN 'Official annual report' WHEN 'O' THEN 'Provider feed' ELSE 'Exchange filing' END AS source_name FROM orders)""",
)
part(
    "provider_fact",
    """SELECT company_id, fiscal_year, field, value FROM (SELECT company_id, fiscal_year, unnest(['net_profit','operating_cash_flow','capital_expenditure','total_equity','cash']) AS field,
  unnest([net_profit, operating_cash_flow, capital_expenditure, total_equity, cash]) AS value FROM company_year)""",
    "company_year",
)


@query(
    "latest_restatement",
    with_parts(
        "point",
        f"""SELECT company_id, field_id, source_document, seq, {d('value')} AS value FROM point
QUALIFY row_number() OVER (PARTITION BY company_id, field_id, source_document ORDER BY source_fetch_time DESC, seq) = 1""",
    ),
)
def latest_restatement(spark, sf):
    cols = ["company_id", "field_id", "security_id", "fiscal_period", "source_document", "source_fetch_time", "ingest_seq", "seq", "value"]
    return L.latest_restatements(D.raw_points(spark, sf).select(*cols)).select(
        "company_id", "field_id", "source_document", "seq", c("value").cast("double").alias("value")
    )


UPSERT = """SELECT company_id, field_id, count(*) AS candidates, min(CASE WHEN num THEN value END) AS lo, max(CASE WHEN num THEN value END) AS hi,
  coalesce(arg_max(seq, seq) FILTER (WHERE num AND o_orderstatus = 'F'), min(seq) FILTER (WHERE num), min(seq) FILTER (WHERE data_status = 'CONFLICT'), max(seq)) AS seq
FROM (SELECT *, data_status IN ('VALID','KNOWN_ZERO') AS num FROM point) GROUP BY 1, 2"""


@query(
    "fact_upsert",
    with_parts(
        "point",
        f"""SELECT u.company_id, u.field_id, p.data_status, {d('p.value')} AS value, u.seq, u.candidates FROM ({UPSERT}) u JOIN point p ON p.seq = u.seq WHERE lo IS NULL OR lo = hi""",
    ),
)
def fact_upsert(spark, sf):
    accepted, _ = L.upsert_facts(D.raw_points(spark, sf))
    return accepted.select(
        "company_id", "field_id", "data_status", c("value").cast("double").alias("value"), "seq", "candidates"
    )


@query(
    "fact_quarantine",
    with_parts(
        "point",
        f"SELECT company_id, field_id, {d('lo')} AS lowest, {d('hi')} AS highest, candidates FROM ({UPSERT}) WHERE lo <> hi",
    ),
)
def fact_quarantine(spark, sf):
    _, bad = L.upsert_facts(D.raw_points(spark, sf))
    return bad.withColumns({x: c(x).cast("double") for x in ("lowest", "highest")})


part(
    "resolved",
    """SELECT company_id, fiscal_year, field, CASE WHEN conflict THEN NULL WHEN has_official THEN official_value ELSE provider_value END AS value,
  CASE WHEN conflict THEN 'SOURCE_CONFLICT' WHEN has_official THEN 'OFFICIAL_STRUCTURED' WHEN provider_value IS NOT NULL THEN 'PROVIDER' ELSE 'MISSING' END AS basis
FROM (SELECT coalesce(o.company_id, p.company_id) AS company_id, coalesce(o.fiscal_year, p.fiscal_year) AS fiscal_year, coalesce(o.field, p.field) AS field,
    coalesce(conflict, false) AS conflict, coalesce(has_official, false) AS has_official, official_value, p.value AS provider_value
  FROM (SELECT company_id, fiscal_year, field, bool_or(data_status = 'CONFLICT') AS conflict, bool_or(o_orderstatus <> 'O' AND data_status = 'VALID') AS has_official,
      arg_max(value, seq) FILTER (WHERE o_orderstatus <> 'O' AND data_status = 'VALID') AS official_value FROM point GROUP BY 1, 2, 3) o
  FULL JOIN provider_fact p ON o.company_id = p.company_id AND o.fiscal_year = p.fiscal_year AND o.field = p.field)
QUALIFY dense_rank() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC) <= 5""",
    "point",
    "provider_fact",
)


def resolved(spark, sf):
    official = D.raw_points(spark, sf).select(
        "company_id", "fiscal_year", "field", c("value").cast("decimal(38,2)").alias("value"), "data_status", "source_name", "seq"
    )
    return L.official_over_provider(official, D.provider_facts(spark, sf))


@query(
    "official_over_provider",
    with_parts("resolved", f"SELECT company_id, fiscal_year, field, {d('value')} AS value, basis FROM resolved"),
)
def official_over_provider(spark, sf):
    return resolved(spark, sf).withColumn("value", c("value").cast("double"))


@query(
    "financial_rows",
    with_parts(
        "resolved",
        f"""SELECT company_id, fiscal_year, {', '.join(f"{d(f'''max(value) FILTER (WHERE field = '{f}')''')} AS {f}" for f in D.POINT_FIELDS)},
  count(*) FILTER (WHERE basis = 'SOURCE_CONFLICT') AS conflicts, CASE WHEN bool_or(basis = 'OFFICIAL_STRUCTURED') THEN 'OFFICIAL_STRUCTURED_AND_PROVIDER' ELSE 'PROVIDER' END AS source
FROM resolved GROUP BY 1, 2""",
    ),
)
def financial_rows(spark, sf):
    rows = L.financial_rows(resolved(spark, sf), list(D.POINT_FIELDS))
    return rows.withColumns({f: c(f).cast("double") for f in D.POINT_FIELDS})


part(
    "report_field",
    f"""SELECT *, lag(next_comparative) OVER (PARTITION BY company_id, field ORDER BY fiscal_year) AS comparative_value
FROM (SELECT o_custkey AS company_id, o_orderstatus AS field, year(o_orderdate) AS fiscal_year, sum({AMT}) AS current_value,
  sum({AMT}) FILTER (WHERE o_orderpriority <> '1-URGENT') AS next_comparative, sum({AMT}) FILTER (WHERE o_orderpriority <> '5-LOW') AS vendor_value FROM orders GROUP BY 1, 2, 3)""",
)
part(
    "adjacent",
    """SELECT *, CASE WHEN py = fiscal_year - 1 AND comparative_value IS NOT NULL AND pv IS NOT NULL THEN CASE WHEN comparative_value = pv THEN 'MATCH' ELSE 'MISMATCH' END ELSE 'UNAVAILABLE' END AS backward,
  CASE WHEN ny = fiscal_year + 1 AND nv IS NOT NULL THEN CASE WHEN current_value = nv THEN 'MATCH' ELSE 'MISMATCH' END ELSE 'UNAVAILABLE' END AS forward,
  CASE WHEN py IS NULL THEN 'NO_PRIOR_REPORT' WHEN py <> fiscal_year - 1 THEN 'YEAR_GAP' WHEN comparative_value IS NULL THEN 'VALUE_UNAVAILABLE' WHEN comparative_value = pv THEN 'MATCH' ELSE 'AMOUNT_MISMATCH' END AS prior_report
FROM (SELECT *, lag(fiscal_year) OVER w AS py, lag(current_value) OVER w AS pv, lead(fiscal_year) OVER w AS ny, lead(comparative_value) OVER w AS nv FROM report_field
  WINDOW w AS (PARTITION BY company_id, field ORDER BY fiscal_year))""",
    "report_field",
)


@query(
    "adjacent_reconcile",
    with_parts(
        "adjacent",
        f"""SELECT company_id, field, fiscal_year, backward, forward, prior_report, CASE WHEN vendor_value IS NULL THEN 'VENDOR_MISSING' WHEN current_value = vendor_value THEN 'MATCH' ELSE 'AMOUNT_MISMATCH' END AS vendor_relation,
  CASE WHEN coalesce(current_value <> vendor_value, false) OR prior_report = 'AMOUNT_MISMATCH' THEN 'CONFLICT' WHEN current_value = vendor_value AND prior_report = 'MATCH' THEN 'VALID' ELSE 'REVIEW' END AS status FROM adjacent""",
    ),
)
def adjacent_reconcile(spark, sf):
    return L.field_decision(L.adjacent(D.report_fields(spark, sf))).select(
        "company_id", "field", "fiscal_year", "backward", "forward", "prior_report", "vendor_relation", "status"
    )


@query(
    "report_status",
    with_parts(
        "adjacent",
        """SELECT company_id, fiscal_year, CASE WHEN bool_or(s = 'CONFLICT') THEN 'CONFLICT' WHEN bool_and(s = 'VALID') THEN 'VALID' ELSE 'REVIEW' END AS report_status
FROM (SELECT *, CASE WHEN coalesce(current_value <> vendor_value, false) OR prior_report = 'AMOUNT_MISMATCH' THEN 'CONFLICT' WHEN current_value = vendor_value AND prior_report = 'MATCH' THEN 'VALID' ELSE 'REVIEW' END AS s FROM adjacent) GROUP BY 1, 2""",
    ),
)
def report_status(spark, sf):
    return L.report_status(L.field_decision(L.adjacent(D.report_fields(spark, sf))))


@query(
    "coverage_decision",
    with_parts(
        "adjacent",
        f"""SELECT company_id, field, fiscal_year, decision, CASE WHEN decision LIKE 'ACCEPT%' THEN {d('current_value')} END AS accepted_value
FROM (SELECT *, CASE WHEN coalesce(current_value <> vendor_value, false) OR backward = 'MISMATCH' OR forward = 'MISMATCH' THEN 'CONFLICT'
  WHEN current_value > 600000 THEN CASE WHEN coalesce(current_value = vendor_value, false) THEN 'ACCEPT_V1' ELSE 'CONFLICT' END
  WHEN backward = 'MATCH' OR forward = 'MATCH' THEN 'ACCEPT_OFFICIAL_ADJACENT' WHEN current_value = vendor_value THEN 'ACCEPT_OFFICIAL_PLUS_PROVIDER' ELSE 'REVIEW' END AS decision FROM adjacent)""",
    ),
)
def coverage_decision(spark, sf):
    return L.coverage_decision(L.adjacent(D.report_fields(spark, sf))).select(
        "company_id", "field", "fiscal_year", "decision", c("accepted_value").cast("double").alias("accepted_value")
    )


part(
    "share_year",
    """SELECT company_id, fiscal_year, CAST(cancelled_shares AS DECIMAL(18,0)) AS closing, one_off_buyback IS NOT NULL AS marker, special_dividend IS NULL AS plain,
  CASE WHEN diluted_net_share_reduction > 0 THEN CAST(diluted_net_share_reduction AS DECIMAL(18,0)) ELSE 0 END AS addition, ordinary_dividend_status AS st FROM company_year""",
    "company_year",
)
part(
    "share_row",
    """SELECT *, CASE WHEN coalesce(lag(plain) OVER w, true) THEN lag(closing) OVER w ELSE lag(closing) OVER w + 1 END AS opening, lag(fiscal_year) OVER w AS py, lag(closing) OVER w AS pc, lag(marker) OVER w AS pm FROM share_year
WINDOW w AS (PARTITION BY company_id ORDER BY fiscal_year)""",
    "share_year",
)


def share_rows(spark, sf):
    """Issued-share balances: the opening repeats the previous closing unless a special payout came between."""
    from pyspark.sql import Window

    y = D.company_years(spark, sf).select(
        "company_id",
        "fiscal_year",
        c("cancelled_shares").cast("decimal(18,0)").alias("closing_issued_shares"),
        c("one_off_buyback").isNotNull().alias("has_marker"),
        c("special_dividend").isNull().alias("plain"),
        F.greatest(F.coalesce(c("diluted_net_share_reduction"), F.lit(0)), F.lit(0)).cast("decimal(18,0)").alias("addition"),
    )
    w = Window.partitionBy("company_id").orderBy("fiscal_year")
    before = F.lag("closing_issued_shares").over(w)
    return y.withColumn(
        "opening_issued_shares", F.when(F.coalesce(F.lag("plain").over(w), F.lit(True)), before).otherwise(before + 1)
    ).withColumn("extraction_status", F.lit("REVIEW"))


@query(
    "share_chain",
    with_parts(
        "share_row",
        """SELECT company_id, fiscal_year, opening_reconciliation, closing_reconciliation,
  CASE WHEN coalesce(opening_reconciliation = 'MISMATCH', false) OR coalesce(closing_reconciliation = 'MISMATCH', false) THEN 'CONFLICT' WHEN marker THEN 'REVIEW'
    WHEN coalesce(opening_reconciliation = 'MATCH', false) OR coalesce(closing_reconciliation = 'MATCH', false) THEN 'VALID' ELSE 'REVIEW' END AS status
FROM (SELECT *, lead(opening_reconciliation) OVER (PARTITION BY company_id ORDER BY fiscal_year) AS closing_reconciliation
  FROM (SELECT *, CASE WHEN py IS NULL THEN NULL WHEN py <> fiscal_year - 1 THEN 'YEAR_GAP' WHEN pc IS NULL OR opening IS NULL THEN NULL
      WHEN pc = opening THEN CASE WHEN pm OR marker THEN 'MATCH_REVIEW_SPLIT' ELSE 'MATCH' END ELSE CASE WHEN pm OR marker THEN 'MISMATCH_REVIEW_SPLIT' ELSE 'MISMATCH' END END AS opening_reconciliation FROM share_row))""",
    ),
)
def share_chain(spark, sf):
    return L.share_chain(share_rows(spark, sf)).select(
        "company_id", "fiscal_year", "opening_reconciliation", "closing_reconciliation", "status"
    )


@query(
    "share_bridge",
    with_parts(
        "share_row",
        f"""SELECT company_id, fiscal_year, {d('opening + addition + addition - closing')} AS derived_closing, {d('closing - (opening + addition + addition - closing)')} AS reported_minus_derived,
  concat_ws(',', CASE WHEN opening + addition + addition - closing < 0 THEN 'NEGATIVE_CLOSING' END, CASE WHEN opening + addition + addition - closing <> closing THEN 'REPORTED_MISMATCH' END) AS issues
FROM share_row WHERE opening IS NOT NULL AND closing IS NOT NULL""",
    ),
)
def share_bridge(spark, sf):
    rows = share_rows(spark, sf).where(c("opening_issued_shares").isNotNull() & c("closing_issued_shares").isNotNull())
    derived = c("opening_issued_shares") + c("addition") + c("addition") - c("closing_issued_shares")
    bridge = rows.select(
        "company_id",
        "fiscal_year",
        "opening_issued_shares",
        F.array("addition", "addition").alias("issued_additions"),
        c("closing_issued_shares").alias("verified_cancelled_shares"),
        derived.alias("configured_closing"),
        c("closing_issued_shares").alias("reported_closing"),
        F.lit("ACCEPT").alias("bridge_status"),
    )
    return L.share_bridge(bridge).select(
        "company_id",
        "fiscal_year",
        c("derived_closing").cast("double").alias("derived_closing"),
        c("reported_minus_derived").cast("double").alias("reported_minus_derived"),
        F.array_join("issues", ",").alias("issues"),
    )


@query(
    "required_minus_present",
    with_parts(
        "point",
        """SELECT company_id, field_id FROM (SELECT DISTINCT company_id, 'FY' || fiscal_year || '.' || f AS field_id FROM (SELECT DISTINCT company_id, fiscal_year FROM point), (SELECT unnest(['net_profit','operating_cash_flow','capital_expenditure','total_equity','cash']) AS f))
EXCEPT SELECT company_id, field_id FROM point""",
    ),
)
def required_minus_present(spark, sf):
    points = D.raw_points(spark, sf)
    years = points.select("company_id", "fiscal_year").distinct()
    return L.explicit_absences(years, points, D.POINT_FIELDS).select("company_id", "field_id")


@query(
    "required_fields_by_industry",
    with_parts(
        ["company_year", "industry"],
        f"""WITH need AS (
  SELECT company_id, 'FY' || fiscal_year || '.' || unnest({list(Q.ANNUAL_FIELDS)}) AS field_id FROM company_year
  UNION SELECT s_suppkey, unnest(['MARKET.' || s_suppkey || '.price', 'MARKET.' || s_suppkey || '.fx_to_base', 'SECURITY.' || s_suppkey || '.issued_shares', 'SECURITY.' || s_suppkey || '.economic_rights_factor']) FROM supplier WHERE s_acctbal > 0
  UNION SELECT company_id, 'FY' || fiscal_year || '.' || unnest({list(Q.CASH_FLOW_FIELDS)}) FROM company_year JOIN industry USING (company_id) WHERE industry NOT IN ('BUILDING','HOUSEHOLD')
  UNION SELECT company_id, 'CURRENT.' || unnest({list(Q.BANK_FIELDS)}) FROM industry WHERE industry = 'BUILDING'
  UNION SELECT company_id, 'CURRENT.' || unnest({list(Q.INSURANCE_FIELDS)}) FROM industry WHERE industry = 'HOUSEHOLD'
  UNION SELECT company_id, unnest(['VALUATION.current','VALUATION.historical_median'] || {['RECONCILIATION.' + f for f in Q.RECONCILIATION_FIELDS]}) FROM industry
  UNION SELECT company_id, 'FY' || fiscal_year || '.net_debt' FROM company_year WHERE interest_bearing_debt - cash IS NOT NULL)
SELECT company_id, count(*) AS required FROM need GROUP BY 1""".replace("WITH need", ", need"),
    ).replace("\n, need AS", ",\nneed AS"),
)
def required_fields_by_industry(spark, sf):
    from cashlens.session import cut_lineage

    years = cut_lineage(D.company_years(spark, sf).select("company_id", "fiscal_year", "net_debt"))
    kind = F.when(c("industry") == "BUILDING", "BANK").when(c("industry") == "HOUSEHOLD", "INSURANCE").otherwise("NON_FINANCIAL")
    companies = D.industries(spark, sf).withColumn("industry_kind", kind)
    classes = D.securities(spark, sf).select(c("security_id").alias("company_id"), "security_id", (c("acctbal") > 0).alias("material"))
    need = Q.required_field_ids(years, classes, years, companies, years.where(c("net_debt").isNotNull()))
    return need.groupBy("company_id").agg(F.count(F.lit(1)).alias("required"))


@query(
    "provenance_issues",
    with_parts(
        "point",
        """SELECT code, data_status, count(*) AS n FROM (SELECT data_status, CASE WHEN value > 300000 THEN 'CURRENCY_REQUIRED' ELSE 'NONE' END AS code FROM point) GROUP BY 1, 2""",
    ),
)
def provenance_issues(spark, sf):
    checked = Q.provenance_issues(D.raw_points(spark, sf))
    code = F.explode(F.when(F.size("issues") == 0, F.array(F.lit("NONE"))).otherwise(c("issues")))
    return checked.select("data_status", code.alias("code")).groupBy("code", "data_status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "point_validation",
    with_parts(
        "point",
        """SELECT seq, concat_ws(',', CASE WHEN k > 1 AND value IS NOT DISTINCT FROM prior THEN 'DUPLICATE_SOURCE_RECORD' END, CASE WHEN data_status = 'CONFLICT' THEN 'RAW_SOURCE_CONFLICT' END,
  CASE WHEN data_status = 'MISSING' THEN 'RAW_SOURCE_INCOMPLETE' END) AS issues,
  CASE WHEN (k > 1 AND value IS NOT DISTINCT FROM prior) OR data_status = 'CONFLICT' THEN 'INVALID' WHEN data_status = 'MISSING' THEN 'PARTIAL' ELSE 'VALID' END AS publication_status
FROM (SELECT *, lag(value) OVER w AS prior, row_number() OVER w AS k FROM point WINDOW w AS (PARTITION BY company_id, field_id, source_document ORDER BY seq))""",
    ),
)
def point_validation(spark, sf):
    keys = ["company_id", "field_id", "fiscal_period", "source_document"]
    cols = [*keys, "ingest_seq", "seq", "value", "restatement_status", "data_status"]
    checked = Q.point_issues(D.raw_points(spark, sf).select(*cols), keys)
    return checked.select(
        "seq", F.array_join("issues", ",").alias("issues"), Q.publication_status(c("issues")).alias("publication_status")
    )


@query(
    "duplicate_ids",
    """SELECT 'o_custkey' AS key_name, CAST(o_custkey AS VARCHAR) AS key_value, count(*) AS n FROM orders GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'o_orderkey', CAST(o_orderkey AS VARCHAR), count(*) FROM orders GROUP BY 2 HAVING count(*) > 1""",
)
def duplicate_ids(spark, sf):
    return Q.duplicate_report(D.table(spark, sf, "orders"), "o_custkey", "o_orderkey")


@query(
    "accounting_identities",
    f"""SELECT o_orderkey AS id, abs(a - b) > 1 AND abs(a - b) / greatest(abs(a), abs(b), 1) > 0.02 AS market_cap_mismatch, c IS NULL AS dividend_missing,
  CASE WHEN b IS NULL OR c IS NULL OR (abs(a - b) > 1 AND abs(a - b) / greatest(abs(a), abs(b), 1) > 0.02) OR (abs(a - c) > 1 AND abs(a - c) / greatest(abs(a), abs(c), 1) > 0.02)
    OR (abs(b - c) > 1 AND abs(b - c) / greatest(abs(b), abs(c), 1) > 0.02) OR (abs(a - b) > 1 AND abs(a - b) / greatest(abs(a), abs(b), 1) > 0.005) THEN 'INVALID' ELSE 'VALID' END AS validation_status
FROM (SELECT o_orderkey, {d('any_value(' + AMT + ')')} AS a, {d('sum(' + m('l_extendedprice') + ')')} AS b, {d("sum(" + m('l_extendedprice') + ") FILTER (WHERE l_returnflag <> 'A')")} AS c
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)""",
)
def accounting_identities(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", D.money("o_totalprice").cast("double").alias("a"))
    price = D.money("l_extendedprice")
    li = D.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(price).cast("double").alias("b"), F.sum(F.when(c("l_returnflag") != "A", price)).cast("double").alias("cc")
    )
    j = o.join(li, c("o_orderkey") == c("l_orderkey"))
    rows = j.select(
        c("o_orderkey").alias("id"),
        c("a").alias("total_market_cap"),
        c("b").alias("class_market_cap"),
        c("a").alias("total_dividend"),
        c("cc").alias("dividend_per_share_times_shares"),
        c("b").alias("buyback_cash"),
        c("cc").alias("repurchased_shares_times_price"),
        c("a").alias("opening_minus_closing"),
        c("b").alias("cancelled_minus_issued"),
    )
    checked = Q.accounting_identities(rows)
    return checked.select(
        "id",
        F.array_contains("issues", "RECONCILIATION_MISMATCH:company_market_cap").alias("market_cap_mismatch"),
        F.array_contains("issues", "RECONCILIATION_INPUT_MISSING:ordinary_dividend").alias("dividend_missing"),
        "validation_status",
    )


@query(
    "release_contract",
    with_parts(
        "screen",
        """SELECT security_id AS company_id, concat_ws(',', CASE WHEN opportunity_coverage IS NULL THEN 'INVALID_COVERAGE:opportunity' END, CASE WHEN resilience_value IS NOT NULL AND resilience_value * 1.5 > 100 THEN 'SCORE_OUT_OF_RANGE:resilience' END) AS issues FROM screen""",
    ),
)
def release_contract(spark, sf):
    rows = SC.screened(spark, sf).select(
        c("security_id").alias("company_id"),
        "status",
        "opportunity_value",
        "opportunity_coverage",
        # A planted violation: scaled scores leave the allowed range.
        (c("resilience_value") * 1.5).alias("resilience_value"),
        F.lit(1.0).alias("resilience_coverage"),
        "fatal_errors",
    )
    return Q.release_issues(rows).select("company_id", F.array_join("issues", ",").alias("issues"))


@query(
    "change_plan",
    f"""SELECT coalesce(a.k, b.k) AS company_id, CASE WHEN a.k IS NULL THEN 'CREATE' WHEN b.k IS NULL THEN 'UNTOUCHED' WHEN a.v = b.v THEN 'UNCHANGED' ELSE 'CHANGE' END AS action
FROM (SELECT o_custkey AS k, sum({AMT}) AS v FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, sum({AMT}) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' GROUP BY 1) b ON a.k = b.k""",
)
def change_plan(spark, sf):
    o = D.table(spark, sf, "orders").select(c("o_custkey").alias("company_id"), "o_orderdate", D.money("o_totalprice").alias("v"))
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    before = o.where(c("o_orderdate") < at("2001-01-01")).groupBy("company_id").agg(F.sum("v").alias("v"))
    after = o.where(c("o_orderdate") >= at("1995-06-01")).groupBy("company_id").agg(F.sum("v").alias("v"))
    return L.change_plan(before, after, "company_id").select("company_id", "action")


@query(
    "field_coverage_matrix",
    with_parts(
        "point",
        """SELECT field, count(*) FILTER (WHERE NOT cf AND v) AS valid, count(*) FILTER (WHERE cf) AS conflict, count(*) FILTER (WHERE NOT cf AND NOT v) AS missing
FROM (SELECT company_id, fiscal_year, field, bool_or(data_status = 'CONFLICT') AS cf, bool_or(data_status = 'VALID') AS v FROM point GROUP BY 1, 2, 3 QUALIFY dense_rank() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC) <= 5) GROUP BY 1""",
    ),
)
def field_coverage_matrix(spark, sf):
    return L.coverage_matrix(D.raw_points(spark, sf))


@query(
    "status_histogram",
    with_parts("point", "SELECT data_status, source_name, count(*) AS n, count(DISTINCT company_id) AS companies FROM point GROUP BY 1, 2"),
)
def status_histogram(spark, sf):
    p = D.raw_points(spark, sf)
    return p.groupBy("data_status", "source_name").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("company_id").alias("companies")
    )


@query(
    "points_round_trip",
    with_parts(
        "company_year",
        f"""SELECT company_id, fiscal_year, {d('net_profit')} AS net_profit, {d('cash')} AS cash, CASE WHEN net_profit IS NULL THEN 'MISSING' WHEN net_profit = 0 THEN 'KNOWN_ZERO' ELSE 'VALID' END AS net_profit_status FROM company_year""",
    ),
)
def points_round_trip(spark, sf):
    y = D.company_years(spark, sf).select(
        "company_id", "fiscal_year", c("net_profit").cast("decimal(38,2)").alias("net_profit"), c("cash").cast("decimal(38,2)").alias("cash")
    )
    points = L.to_points(y, ["net_profit", "cash"])
    status = points.groupBy("company_id", "fiscal_year").agg(
        F.max(F.when(c("field") == "net_profit", c("data_status"))).alias("net_profit_status")
    )
    back = L.from_points(points, ["net_profit", "cash"])
    return back.join(status, ["company_id", "fiscal_year"]).withColumns({x: c(x).cast("double") for x in ("net_profit", "cash")})


@query(
    "coverage_slots",
    """WITH y AS (SELECT DISTINCT o_custkey AS company_id, year(o_orderdate) AS fiscal_year FROM orders QUALIFY dense_rank() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC) <= 5),
cand AS (SELECT o_custkey AS company_id, year(o_orderdate) AS fiscal_year, count(*) AS related, count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM')) AS ord,
  count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_orderpriority = '5-LOW') AS spec, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM')) AS prop,
  bool_or(o_totalprice > 400000 AND o_orderstatus = 'F') AS ready FROM orders GROUP BY 1, 2)
SELECT company_id, fiscal_year, CASE WHEN ready THEN 'READY' ELSE 'BLOCKED' END AS slot_status,
  CASE WHEN ready THEN NULL WHEN ord = 0 THEN 'NO_OFFICIAL_COMPLETE_TOTAL_LOCATED' WHEN spec > 0 THEN 'ORDINARY_AND_SPECIAL_NOT_SEPARATED' WHEN prop = ord THEN 'PROPOSAL_WITHOUT_VERIFIED_IMPLEMENTED_TOTAL' ELSE 'COMPLETE_COMPONENT_SET_NOT_RECONCILED' END AS reason_code,
  related AS related_candidates FROM y JOIN cand USING (company_id, fiscal_year)""",
)
def coverage_slots(spark, sf):
    o = D.table(spark, sf, "orders").select(
        c("o_custkey").alias("company_id"), F.year("o_orderdate").alias("fiscal_year"), "o_orderstatus", "o_orderpriority", "o_totalprice"
    )
    cand = o.select(
        "company_id",
        "fiscal_year",
        F.when(c("o_orderstatus") != "F", "TOTAL").otherwise("PER_SHARE").alias("amount_kind"),
        F.when(c("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "ORDINARY")
        .when(c("o_orderpriority") == "5-LOW", "SPECIAL")
        .otherwise("MIXED")
        .alias("dividend_kind"),
        F.when(c("o_orderstatus") == "O", "PROPOSED").otherwise("PAID").alias("lifecycle_status"),
    )
    facts = (
        o.where((c("o_totalprice") > 400_000) & (c("o_orderstatus") == "F"))
        .groupBy("company_id", "fiscal_year")
        .agg(F.max("o_totalprice").alias("amount"))
    )
    return L.coverage_slots(o.select("company_id", "fiscal_year"), facts, cand)


@query(
    "distribution_totals",
    f"""SELECT o_orderkey AS distribution_id, {d('s')} AS component_sum, n AS components, concat_ws(',', CASE WHEN c1 <> c2 THEN 'MIXED_CURRENCY' END, CASE WHEN c1 <> 'A' THEN 'TOTAL_CURRENCY_MISMATCH' END, CASE WHEN s <> t THEN 'SUM_MISMATCH' END) AS issues
FROM (SELECT o_orderkey, any_value({AMT}) AS t, sum({m('l_extendedprice')}) AS s, count(*) AS n, min(l_returnflag) AS c1, max(l_returnflag) AS c2 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)""",
)
def distribution_totals(spark, sf):
    comp = D.table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("distribution_id"),
        D.money("l_extendedprice").cast("decimal(38,6)").alias("value"),
        c("l_returnflag").alias("currency"),
        F.lit("OFFICIAL_TOTAL").alias("amount_method"),
        *[F.lit(None).cast("decimal(18,4)").alias(x) for x in ("per_share_value", "entitled_shares", "share_basis")],
    )
    tot = D.table(spark, sf, "orders").select(
        c("o_orderkey").alias("distribution_id"), D.money("o_totalprice").cast("decimal(38,6)").alias("value"), F.lit("A").alias("currency")
    )
    return L.distribution_total(comp, tot).select(
        "distribution_id", c("component_sum").cast("double").alias("component_sum"), "components", F.array_join("issues", ",").alias("issues")
    )


@query(
    "archive_coverage",
    """SELECT c_custkey AS company_id, coalesce(s, 0) AS selected, coalesce(v, 0) AS verified, coalesce(e, 0) AS errors, CASE WHEN coalesce(s, 0) > 0 AND s = v THEN 'VERIFIED' WHEN coalesce(v, 0) > 0 THEN 'PARTIAL' WHEN coalesce(e, 0) > 0 THEN 'ERROR' ELSE 'PENDING' END AS coverage_status
FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'O') AS s, count(*) FILTER (WHERE o_orderstatus = 'F') AS v, count(*) FILTER (WHERE o_orderstatus = 'O') AS e FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
)
def archive_coverage(spark, sf):
    o = D.table(spark, sf, "orders")
    docs = o.select(
        c("o_custkey").alias("company_id"),
        (c("o_orderstatus") != "O").alias("selected"),
        (c("o_orderstatus") == "F").alias("verified"),
        (c("o_orderstatus") == "O").alias("failed"),
    )
    return L.archive_coverage(docs, D.table(spark, sf, "customer").select(c("c_custkey").alias("company_id")))


@query(
    "unmatched_keys",
    """SELECT o_custkey AS id, 'left_only' AS side FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1
UNION ALL SELECT s_suppkey, 'right_only' FROM supplier WHERE s_suppkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1""",
)
def unmatched_keys(spark, sf):
    a = D.table(spark, sf, "orders").select(c("o_custkey").alias("id"))
    b = D.table(spark, sf, "supplier").select(c("s_suppkey").alias("id"))
    return L.both_ways(a, b, ["id"])


@query(
    "market_points",
    with_parts(
        "fundamentals",
        """SELECT security_id AS company_id, 'MARKET.' || security_id || '.' || f AS field_id, v AS value, CASE WHEN v = 0 THEN 'KNOWN_ZERO' WHEN v IS NOT NULL THEN 'VALID' ELSE 'MISSING' END AS data_status
FROM (SELECT security_id, unnest(['pe_ttm','pb','dividend_yield_ttm_pct']) AS f, unnest([pe_ttm, pb, dividend_yield_pct]) AS v FROM fundamentals)""",
    ),
)
def market_points(spark, sf):
    f = SC.fundamentals(spark, sf).select(
        c("security_id").alias("company_id"), "security_id", "pe_ttm", "pb", c("dividend_yield_pct").alias("dividend_yield_ttm_pct")
    )
    return L.market_points(f)


@query(
    "text_candidate_check",
    f"""WITH y AS (SELECT o_custkey AS company_id, year(o_orderdate) AS fiscal_year, sum({AMT}) AS value,
    sum(CASE WHEN o_orderstatus <> 'P' THEN {AMT} ELSE 0 END) AS settled, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1, 2)
SELECT a.company_id, a.fiscal_year, CASE WHEN a.kinds > 3 THEN 'CONFLICT' WHEN b.value IS NULL OR b.settled IS NULL THEN 'REVIEW_REQUIRED'
  WHEN abs(b.settled - b.value) > greatest(abs(b.settled), abs(b.value), 1) * 0.0001 THEN 'CONFLICT' WHEN a.value = 0 THEN 'KNOWN_ZERO' ELSE 'VALID' END AS status
FROM y a LEFT JOIN y b ON a.company_id = b.company_id AND b.fiscal_year = a.fiscal_year - 1""",
)
def text_candidate_check(spark, sf):
    """A year's total with the settled part of the year before as its comparative, against that year's own total."""
    amount = D.money("o_totalprice")
    years = (
        D.table(spark, sf, "orders")
        .groupBy(c("o_custkey").alias("company_id"), F.year("o_orderdate").alias("fiscal_year"))
        .agg(
            F.sum(amount).alias("value"),
            F.sum(F.when(c("o_orderstatus") != "P", amount).otherwise(0)).alias("settled"),
            F.countDistinct("o_orderpriority").alias("kinds"),
        )
    )
    said = years.select("company_id", (c("fiscal_year") + 1).alias("fiscal_year"), c("settled").alias("comparative_value"))
    prior = years.select("company_id", (c("fiscal_year") + 1).alias("fiscal_year"), "value", F.lit("CNY").alias("currency"), F.lit("yuan").alias("unit"))
    candidates = years.join(said, ["company_id", "fiscal_year"], "left").select(
        "company_id",
        "fiscal_year",
        "value",
        "comparative_value",
        F.when(c("kinds") > 3, 2).otherwise(1).alias("match_count"),
        F.lit("CNY").alias("currency"),
        F.lit("yuan").alias("unit"),
        F.lit(None).cast("string").alias("status"),
    )
    return Q.text_candidate_check(candidates, prior, ["company_id", "fiscal_year"]).select("company_id", "fiscal_year", "status")
