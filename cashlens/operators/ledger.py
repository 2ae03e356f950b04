"""Fact ledger operators (filled in below)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashlens.functions.numeric import ratio


def balance_sheet_kind(df: DataFrame) -> DataFrame:
    """NET_CASH, NET_DEBT_TO_EQUITY or a liabilities/assets proxy, with the value behind it.

    Strictly negative net debt is net cash here; exactly zero goes down the ratio branch.
    """
    c = F.col
    net = c("interest_bearing_debt") - c("cash")
    direct = F.coalesce(net.isNotNull() & (c("total_equity") > 0), F.lit(False))
    proxy = F.coalesce(c("total_liabilities").isNotNull() & (c("total_assets") > 0), F.lit(False))
    kind = (
        F.when(direct & (net < 0), "NET_CASH")
        .when(direct, "NET_DEBT_TO_EQUITY")
        .when(proxy, "DEBT_TO_ASSETS_PROXY")
        .otherwise("UNAVAILABLE")
    )
    value = (
        F.when(direct & (net < 0), -net.cast("double"))
        .when(direct, ratio(net, c("total_equity")))
        .when(proxy, ratio(c("total_liabilities"), c("total_assets")))
    )
    basis = F.when(direct, "DIRECT").when(proxy, "PROXY").otherwise("UNAVAILABLE")
    return df.withColumns({"net_debt": net, "balance_kind": kind, "balance_value": value, "balance_basis": basis})


c = F.col
# Fixed values.
ACCEPTED = ("VALID", "KNOWN_ZERO")
OFFICIAL_LEVEL = "OFFICIAL_FILING"
OFFICIAL_NAME = "Official annual report"
FULL_YEAR_TYPE = 7
VENDOR_MARKS = ("futu", "provider")
FIELD_ALIASES = {
    "revenue": ("营业收入", "营业总收入", "收入合计"),
    "net_profit": ("净利润",),
    "operating_cash_flow": ("经营活动产生的现金流量净额",),
    "capital_expenditure": ("购建固定资产、无形资产和其他长期资产支付的现金",),
    "total_assets": ("资产合计",),
    "total_liabilities": ("负债合计",),
    "total_equity": ("股东权益合计", "所有者权益合计"),
    "cash": ("货币资金", "现金及现金等价物", "现金及等价物"),
}
DEBT_ALIASES = (
    "短期借款", "一年内到期的非流动负债", "长期借款", "应付债券", "租赁负债", "银行借款", "计息银行及其他借款",
)
STATEMENT_OF = {
    "revenue": "income_statement",
    "net_profit": "income_statement",
    "operating_cash_flow": "cash_flow",
    "capital_expenditure": "cash_flow",
    "total_assets": "balance_sheet",
    "total_liabilities": "balance_sheet",
    "total_equity": "balance_sheet",
    "cash": "balance_sheet",
    "interest_bearing_debt": "balance_sheet",
}


def full_year(reports: DataFrame) -> DataFrame:
    """Full-year reports, by type code or by a period text that ends in /FY."""
    return reports.where(
        (c("financial_type") == FULL_YEAR_TYPE) | F.upper(F.coalesce(c("period_text"), F.lit(""))).endswith("/FY")
    )


def flatten_statements(evidence: DataFrame) -> DataFrame:
    """Statement evidence to one row per line item: company, statement, year, currency, label, amount text."""
    s = evidence.select(
        c("company.issuer_id").alias("company_id"),
        c("company.security_id").alias("security_id"),
        "fetched_at",
        F.explode("statements").alias("statement", "body"),
    )
    r = s.select("company_id", "security_id", "fetched_at", "statement", F.explode("body.report_list").alias("r"))
    return r.select(
        "company_id",
        "security_id",
        "fetched_at",
        "statement",
        c("r.fiscal_year").alias("fiscal_year"),
        c("r.financial_type").alias("financial_type"),
        c("r.period_text").alias("period_text"),
        c("r.date_time_str").alias("period_end"),
        c("r.currency_code").alias("currency"),
        F.explode("r.item_list").alias("i"),
    ).select("*", c("i.field_id").alias("item_id"), F.trim("i.display_name").alias("label"), c("i.data").alias("data")).drop("i")


def first_by_alias(items: DataFrame, keys: list[str], aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per field the value of its best-ranked alias that carries a number."""
    value = c("data").try_cast("decimal(38,12)")
    rows = []
    for field, names in aliases.items():
        for rank, name in enumerate(names):
            rows.append(F.struct(F.lit(field).alias("field"), F.lit(name).alias("alias"), F.lit(rank).alias("rank")))
    known = F.filter(F.array(*rows), lambda a: a["alias"] == c("label"))
    matched = items.withColumn("value", value).where(c("value").isNotNull()).select(
        *keys, "value", F.explode(known).alias("a")
    )
    return matched.groupBy(*keys, c("a.field").alias("field")).agg(
        F.min_by("value", c("a.rank")).alias("value"), F.min("a.rank").alias("alias_rank")
    )


def interest_bearing_debt(items: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of whichever debt lines exist; null when none carries a number."""
    value = c("data").try_cast("decimal(38,12)")
    return items.groupBy(*keys).agg(
        F.sum(F.when(c("label").isin(*DEBT_ALIASES), value)).alias("interest_bearing_debt")
    )


def exact_extract(items: DataFrame, keys: list[str], names: tuple[str, ...], out: str) -> DataFrame:
    """Exactly one matching line gives its value; none is MISSING, several are a CONFLICT."""
    hit = F.regexp_replace(c("label"), r"\s+", "").isin(*[n.replace(" ", "") for n in names])
    g = items.groupBy(*keys).agg(
        F.count(F.when(hit, 1)).alias("_n"), F.max(F.when(hit, c("data").try_cast("decimal(38,12)"))).alias("_v")
    )
    status = (
        F.when(c("_n") == 0, "MISSING")
        .when(c("_n") > 1, "CONFLICT")
        .when(c("_v").isNull(), "MISSING")
        .when(c("_v") == 0, "KNOWN_ZERO")
        .otherwise("VALID")
    )
    return g.select(*keys, F.when(c("_n") == 1, c("_v")).alias(out), status.alias(f"{out}_status"))


def capex_from_items(
    items: DataFrame, keys: list[str], direct: tuple[str, ...], groups: tuple[tuple[str, ...], ...]
) -> DataFrame:
    """Direct capex line as a positive amount, else the first component group whose labels all exist."""
    base = exact_extract(items, keys, direct, "direct")
    label = F.regexp_replace(c("label"), r"\s+", "")
    amount = c("data").try_cast("decimal(38,12)")
    aggs = []
    for i, group in enumerate(groups):
        for j, name in enumerate(group):
            hit = label == name.replace(" ", "")
            aggs.append(F.count(F.when(hit, 1)).alias(f"n{i}_{j}"))
            aggs.append(F.max(F.when(hit, F.abs(amount))).alias(f"v{i}_{j}"))
    if not aggs:
        return base.select(*keys, F.abs("direct").alias("capital_expenditure"), c("direct_status").alias("capex_status"))
    parts = items.groupBy(*keys).agg(*aggs)
    value, status = F.lit(None).cast("decimal(38,12)"), F.lit("MISSING")
    for i in reversed(range(len(groups))):
        idx = range(len(groups[i]))
        present = _all([c(f"n{i}_{j}") > 0 for j in idx])
        conflict = _any([c(f"n{i}_{j}") > 1 for j in idx])
        known = _all([c(f"v{i}_{j}").isNotNull() for j in idx])
        total = sum((c(f"v{i}_{j}") for j in idx), F.lit(0).cast("decimal(38,12)"))
        value = F.when(present & known & ~conflict, total).when(present, F.lit(None)).otherwise(value)
        status = (
            F.when(present & conflict, "CONFLICT")
            .when(present & known, F.when(total == 0, "KNOWN_ZERO").otherwise("VALID"))
            .when(present, "MISSING")
            .otherwise(status)
        )
    j = base.join(parts, keys)
    missing = c("direct_status") == "MISSING"
    return j.select(
        *keys,
        F.when(missing, value).otherwise(F.abs("direct")).alias("capital_expenditure"),
        F.when(missing, status).otherwise(c("direct_status")).alias("capex_status"),
    )


def _all(conds: list[Column]) -> Column:
    out = F.lit(True)
    for x in conds:
        out = out & x
    return out


def _any(conds: list[Column]) -> Column:
    out = F.lit(False)
    for x in conds:
        out = out | x
    return out


def yearly_ledger(cash_flow: DataFrame, balance: DataFrame, maximum: int = 10) -> DataFrame:
    """Cash-flow and balance reports side by side per company and period; a currency clash voids the values.

    Inputs hold one row per company, fiscal_year, period_text, period_end with currency and value
    columns (operating_cash_flow, capital_expenditure, share_capital) plus ``<value>_status``.
    """
    keys = ["company_id", "fiscal_year", "period_text", "period_end"]
    a = cash_flow.withColumnRenamed("currency", "_cc").withColumn("_ca", F.lit(True))
    b = balance.withColumnRenamed("currency", "_bc")
    j = a.join(b, keys, "full_outer").withColumns(
        {
            "currency": F.coalesce("_cc", "_bc"),
            "_bad": (F.coalesce("_cc", "_bc").isNull()) | F.coalesce(c("_cc") != c("_bc"), F.lit(False)),
        }
    )
    names = ("operating_cash_flow", "capital_expenditure", "share_capital")
    j = j.withColumns(
        {n: F.when(~c("_bad"), c(n)) for n in names}
        | {f"{n}_status": F.when(c("_bad"), "CONFLICT").otherwise(F.coalesce(f"{n}_status", F.lit("MISSING"))) for n in names}
    )
    newest = Window.partitionBy("company_id").orderBy(F.desc("fiscal_year"), F.desc("period_text"), F.desc("period_end"))
    return j.withColumn("_k", F.row_number().over(newest)).where(c("_k") <= maximum).drop("_k", "_cc", "_bc", "_ca", "_bad")


def to_points(years: DataFrame, fields: list[str]) -> DataFrame:
    """Yearly columns to provenance points ``FY<year>.<field>``; zero is KNOWN_ZERO, null is MISSING."""
    long = years.unpivot(["company_id", "fiscal_year"], fields, "field", "value")
    status = F.when(c("value").isNull(), "MISSING").when(c("value") == 0, "KNOWN_ZERO").otherwise("VALID")
    return long.select(
        "company_id",
        "fiscal_year",
        F.concat(F.lit("FY"), c("fiscal_year").cast("string"), F.lit("."), c("field")).alias("field_id"),
        "field",
        "value",
        status.alias("data_status"),
    )


def from_points(points: DataFrame, fields: list[str]) -> DataFrame:
    """Points ``FY<year>.<field>`` back to one row per company and year (fixed pivot list)."""
    p = points.select(
        "company_id",
        F.regexp_extract("field_id", r"^FY(\d{4})\.", 1).try_cast("int").alias("fiscal_year"),
        F.regexp_extract("field_id", r"^FY\d{4}\.(.+)$", 1).alias("_f"),
        "value",
    ).where(c("fiscal_year").isNotNull())
    return p.groupBy("company_id", "fiscal_year").agg(
        *[F.max(F.when(c("_f") == f, c("value"))).alias(f) for f in fields]
    )


def market_points(obs: DataFrame) -> DataFrame:
    """Current market values as points ``MARKET.<security>.<field>``."""
    fields = [
        "price", "fx_to_base", "total_market_value", "pe", "pe_ttm", "pb",
        "dividend_yield_ttm_pct", "earnings_per_share", "book_value_per_share",
    ]
    have = [f for f in fields if f in obs.columns]
    long = obs.select("company_id", "security_id", *[c(f).cast("double").alias(f) for f in have]).unpivot(
        ["company_id", "security_id"], have, "field", "value"
    )
    status = F.when(c("value") == 0, "KNOWN_ZERO").when(c("value").isNotNull(), "VALID").otherwise("MISSING")
    return long.select(
        "company_id",
        F.concat_ws(".", F.lit("MARKET"), c("security_id").cast("string"), "field").alias("field_id"),
        "value",
        status.alias("data_status"),
    )


def replace_market_points(points: DataFrame, current: DataFrame) -> DataFrame:
    """Drop the old market points of the refreshed companies and add the current ones."""
    refreshed = current.select("company_id").distinct()
    is_market = c("field_id").startswith("MARKET.")
    kept = points.where(~is_market).unionByName(
        points.where(is_market).join(refreshed, "company_id", "left_anti")
    )
    return kept.unionByName(current, allowMissingColumns=True)


def overlay_share_classes(companies: DataFrame) -> DataFrame:
    """Rewrite price, FX and quote status of the observed class inside the share_classes array."""
    return companies.withColumn(
        "share_classes",
        F.transform(
            "share_classes",
            lambda s: F.when(
                s["security_id"] == c("observed_security_id"),
                s.withField("price", c("observed_price"))
                .withField("fx_to_base", c("observed_fx"))
                .withField("quote_status", F.when(c("observed_price").isNotNull(), "VALID").otherwise("MISSING")),
            ).otherwise(s),
        ),
    )


def is_official(source_name: Column) -> Column:
    text = F.lower(F.coalesce(source_name, F.lit("")))
    return _all([~text.contains(m) for m in VENDOR_MARKS])


def official_over_provider(official: DataFrame, provider: DataFrame, maximum: int = 5) -> DataFrame:
    """Resolve each (company, year, field): a conflict voids only that field, an accepted official value wins.

    ``official``: company_id, fiscal_year, field, value, data_status, source_name, seq.
    ``provider``: company_id, fiscal_year, field, value.  Keeps the newest ``maximum`` years.
    """
    keys = ["company_id", "fiscal_year", "field"]
    ok = is_official(c("source_name")) & c("data_status").isin(*ACCEPTED)
    o = official.groupBy(*keys).agg(
        F.max(c("data_status") == "CONFLICT").alias("conflict"),
        F.max_by(F.when(ok, c("value")), F.when(ok, c("seq"))).alias("official_value"),
        F.max(ok).alias("has_official"),
    )
    j = o.join(provider.withColumnRenamed("value", "provider_value"), keys, "full_outer")
    years = Window.partitionBy("company_id").orderBy(F.desc("fiscal_year"))
    recent = j.withColumn("_k", F.dense_rank().over(years)).where(c("_k") <= maximum)
    conflict, has = F.coalesce(c("conflict"), F.lit(False)), F.coalesce(c("has_official"), F.lit(False))
    value = F.when(conflict, F.lit(None)).when(has, c("official_value")).otherwise(c("provider_value"))
    basis = (
        F.when(conflict, "SOURCE_CONFLICT")
        .when(has, "OFFICIAL_STRUCTURED")
        .when(c("provider_value").isNotNull(), "PROVIDER")
        .otherwise("MISSING")
    )
    return recent.select(*keys, value.alias("value"), basis.alias("basis"))


def financial_rows(resolved: DataFrame, fields: list[str]) -> DataFrame:
    """Resolved facts pivoted to one row per company and year, with conflict count and source label."""
    return resolved.groupBy("company_id", "fiscal_year").agg(
        *[F.max(F.when(c("field") == f, c("value"))).alias(f) for f in fields],
        F.count(F.when(c("basis") == "SOURCE_CONFLICT", 1)).alias("conflicts"),
        F.when(F.max(c("basis") == "OFFICIAL_STRUCTURED"), "OFFICIAL_STRUCTURED_AND_PROVIDER")
        .otherwise("PROVIDER")
        .alias("source"),
    )


def _same(a: Column, b: Column) -> Column:
    return a == b


def adjacent(reports: DataFrame) -> DataFrame:
    """Backward and forward relation of each report field to the neighbouring years.

    ``reports``: company_id, field, fiscal_year, current_value, comparative_value, currency, unit
    (one row per company, field and year).
    """
    w = Window.partitionBy("company_id", "field").orderBy("fiscal_year")
    s = reports.withColumns(
        {
            "_py": F.lag("fiscal_year").over(w),
            "_pv": F.lag("current_value").over(w),
            "_pc": F.lag("currency").over(w),
            "_ny": F.lead("fiscal_year").over(w),
            "_nv": F.lead("comparative_value").over(w),
            "_nc": F.lead("currency").over(w),
        }
    )
    same_back = c("currency").eqNullSafe(c("_pc"))
    same_fwd = c("currency").eqNullSafe(c("_nc"))
    back_known = (c("_py") == c("fiscal_year") - 1) & c("comparative_value").isNotNull() & c("_pv").isNotNull()
    fwd_known = (c("_ny") == c("fiscal_year") + 1) & c("current_value").isNotNull() & c("_nv").isNotNull()
    two_way = lambda known, same, a, b: F.when(
        F.coalesce(known & same, F.lit(False)), F.when(_same(a, b), "MATCH").otherwise("MISMATCH")
    ).otherwise("UNAVAILABLE")
    prior = (
        F.when(c("_py").isNull(), "NO_PRIOR_REPORT")
        .when(c("_py") != c("fiscal_year") - 1, "YEAR_GAP")
        .when(c("comparative_value").isNull() | c("_pv").isNull(), "VALUE_UNAVAILABLE")
        .when(~same_back, "CURRENCY_MISMATCH")
        .when(_same(c("comparative_value"), c("_pv")), "MATCH")
        .otherwise("AMOUNT_MISMATCH")
    )
    return s.withColumns(
        {
            "backward": two_way(back_known, same_back, c("comparative_value"), c("_pv")),
            "forward": two_way(fwd_known, same_fwd, c("current_value"), c("_nv")),
            "prior_report": prior,
        }
    ).drop("_py", "_pv", "_pc", "_ny", "_nv", "_nc")


def vendor_relation(official: Column, currency: Column, status: Column, vendor: Column, vendor_currency: Column) -> Column:
    return (
        F.when(official.isNull(), "NOT_CHECKED")
        .when(~status.isin(*ACCEPTED) | status.isNull() | vendor.isNull(), "VENDOR_MISSING")
        .when(~F.coalesce(vendor_currency, F.lit("")).eqNullSafe(F.coalesce(currency, F.lit(""))), "CURRENCY_MISMATCH")
        .when(official == vendor, "MATCH")
        .otherwise("AMOUNT_MISMATCH")
    )


def field_decision(rows: DataFrame) -> DataFrame:
    """VALID only with a vendor match and a prior-report match; any mismatch is a CONFLICT.

    ``rows`` comes from ``adjacent`` plus vendor_value, vendor_currency, vendor_status, extraction_status.
    """
    rel = vendor_relation(c("current_value"), c("currency"), c("vendor_status"), c("vendor_value"), c("vendor_currency"))
    bad = ("CURRENCY_MISMATCH", "AMOUNT_MISMATCH")
    s = rows.withColumn("vendor_relation", rel)
    conflict = (c("extraction_status") == "CONFLICT") | c("vendor_relation").isin(*bad) | c("prior_report").isin(*bad)
    valid = c("current_value").isNotNull() & (c("vendor_relation") == "MATCH") & (c("prior_report") == "MATCH")
    status = F.when(F.coalesce(conflict, F.lit(False)), "CONFLICT").when(valid, "VALID").otherwise("REVIEW")
    s = s.withColumn("status", status)
    return s.withColumn("value", F.when(c("status") == "VALID", c("current_value")))


def report_status(fields: DataFrame) -> DataFrame:
    """Status of a report from its fields: any CONFLICT, all VALID, else REVIEW."""
    g = fields.groupBy("company_id", "fiscal_year").agg(
        F.max(c("status") == "CONFLICT").alias("_c"), F.min(c("status") == "VALID").alias("_v")
    )
    return g.select(
        "company_id", "fiscal_year", F.when(c("_c"), "CONFLICT").when(c("_v"), "VALID").otherwise("REVIEW").alias("report_status")
    )


def coverage_decision(rows: DataFrame) -> DataFrame:
    """One of seven decision classes per (company, year, field), by an ordered ladder.

    Expects the columns of ``adjacent`` plus vendor_value, vendor_currency, vendor_status, accepted_before.
    """
    numeric = F.coalesce(c("vendor_status").isin(*ACCEPTED) & c("vendor_value").isNotNull(), F.lit(False))
    rel = (
        F.when(~numeric, "UNAVAILABLE")
        .when(~F.coalesce(c("vendor_currency") == c("currency"), F.lit(False)), "CURRENCY_MISMATCH")
        .when(c("current_value") == c("vendor_value"), "MATCH")
        .otherwise("AMOUNT_MISMATCH")
    )
    s = rows.withColumns({"_num": numeric, "_rel": rel})
    unclear = (F.coalesce(c("currency"), F.lit("")) == "") | ~F.coalesce(c("unit") == "currency", F.lit(False))
    clash = c("_rel").isin("CURRENCY_MISMATCH", "AMOUNT_MISMATCH") | (c("backward") == "MISMATCH") | (c("forward") == "MISMATCH")
    ladder = (
        F.when(c("current_value").isNull(), F.when(c("_num"), "PROVIDER_ONLY").otherwise("INSUFFICIENT_DATA"))
        .when(unclear, "REVIEW")
        .when(clash, "CONFLICT")
        .when(c("accepted_before"), F.when(c("_rel") == "MATCH", "ACCEPT_V1").otherwise("CONFLICT"))
        .when((c("backward") == "MATCH") | (c("forward") == "MATCH"), "ACCEPT_OFFICIAL_ADJACENT")
        .when(c("_rel") == "MATCH", "ACCEPT_OFFICIAL_PLUS_PROVIDER")
        .otherwise("REVIEW")
    )
    s = s.withColumn("decision", ladder)
    return s.withColumn("accepted_value", F.when(c("decision").startswith("ACCEPT"), c("current_value"))).drop("_num", "_rel")


def decision_from_checks(checks: Column) -> Column:
    """ACCEPT when every named check holds, with the names of the failed ones beside it."""
    failed = F.map_keys(F.map_filter(checks, lambda _, v: ~F.coalesce(v, F.lit(False))))
    return F.struct(F.when(F.size(failed) == 0, "ACCEPT").otherwise("REVIEW").alias("decision"), F.array_sort(failed).alias("failed"))


def share_chain(rows: DataFrame) -> DataFrame:
    """Closing balance of a year against the opening balance of the next, with split markers.

    ``rows``: company_id, fiscal_year, opening_issued_shares, closing_issued_shares, has_marker, extraction_status.
    """
    w = Window.partitionBy("company_id").orderBy("fiscal_year")
    s = rows.withColumns(
        {
            "_py": F.lag("fiscal_year").over(w),
            "_pc": F.lag("closing_issued_shares").over(w),
            "_pm": F.lag("has_marker").over(w),
            "_ny": F.lead("fiscal_year").over(w),
            "_no": F.lead("opening_issued_shares").over(w),
            "_nm": F.lead("has_marker").over(w),
        }
    )

    def edge(other_year: Column, step: int, a: Column, b: Column, marker: Column) -> Column:
        split = F.coalesce(marker, F.lit(False)) | F.coalesce(c("has_marker"), F.lit(False))
        return (
            F.when(other_year.isNull(), F.lit(None).cast("string"))
            .when(other_year != c("fiscal_year") + step, "YEAR_GAP")
            .when(a.isNull() | b.isNull(), F.lit(None).cast("string"))
            .when(a == b, F.when(split, "MATCH_REVIEW_SPLIT").otherwise("MATCH"))
            .otherwise(F.when(split, "MISMATCH_REVIEW_SPLIT").otherwise("MISMATCH"))
        )

    s = s.withColumns(
        {
            "opening_reconciliation": edge(c("_py"), -1, c("_pc"), c("opening_issued_shares"), c("_pm")),
            "closing_reconciliation": edge(c("_ny"), 1, c("closing_issued_shares"), c("_no"), c("_nm")),
        }
    )
    either = lambda v: F.coalesce(c("opening_reconciliation") == v, F.lit(False)) | F.coalesce(
        c("closing_reconciliation") == v, F.lit(False)
    )
    status = (
        F.when(c("extraction_status") == "CONFLICT", "CONFLICT")
        .when(either("MISMATCH"), "CONFLICT")
        .when(c("has_marker"), "REVIEW")
        .when(either("MATCH"), "VALID")
        .otherwise(c("extraction_status"))
    )
    return s.withColumn("status", status).drop("_py", "_pc", "_pm", "_ny", "_no", "_nm")


def share_bridge(df: DataFrame) -> DataFrame:
    """opening + additions - cancelled against the derived and reported closing balance.

    ``issued_additions`` is an array of share counts.
    """
    added = F.aggregate("issued_additions", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    s = df.withColumn("derived_closing", c("opening_issued_shares") + added - c("verified_cancelled_shares"))
    issues = F.array_compact(
        F.array(
            F.when(c("derived_closing") < 0, F.lit("NEGATIVE_CLOSING")),
            F.when(c("derived_closing") != c("configured_closing"), F.lit("DERIVED_MISMATCH")),
            F.when(
                (c("bridge_status") == "ACCEPT") & (c("derived_closing") != c("reported_closing")), F.lit("REPORTED_MISMATCH")
            ),
        )
    )
    return s.withColumns(
        {
            "reported_minus_derived": c("reported_closing") - c("derived_closing"),
            "derived_net_change": c("derived_closing") - c("opening_issued_shares"),
            "issues": issues,
        }
    )


def latest_restatements(points: DataFrame) -> DataFrame:
    """Newest fetched row per point identity; on equal fetch time the first ingested stays."""
    from cashlens.operators.scale import latest_by

    keys = ["company_id", "field_id", "security_id", "fiscal_period", "source_document"]
    return latest_by(points, keys, [c("source_fetch_time"), -c("ingest_seq")])


def upsert_facts(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) facts per company and field id, in the order of ``seq``.

    An accepted number is never replaced by a missing one; an equal official number replaces a
    provider number; disagreeing numbers go to quarantine; without a number the first CONFLICT
    sticks, else the last row stands.  One aggregate with map-side combine.
    """
    keys = ["company_id", "field_id"]
    numeric = c("data_status").isin(*ACCEPTED)
    official = numeric & ((c("source_level") == OFFICIAL_LEVEL) | (c("source_name") == OFFICIAL_NAME))
    row = F.struct("value", "data_status", "source_name", "seq")
    clash = c("data_status") == "CONFLICT"
    g = points.groupBy(*keys).agg(
        F.min(F.when(numeric, c("value"))).alias("_lo"),
        F.max(F.when(numeric, c("value"))).alias("_hi"),
        F.max_by(F.when(official, row), F.when(official, c("seq"))).alias("_official"),
        F.min_by(F.when(numeric, row), F.when(numeric, c("seq"))).alias("_numeric"),
        F.min_by(F.when(clash, row), F.when(clash, c("seq"))).alias("_clash"),
        F.max_by(row, c("seq")).alias("_last"),
        F.count(F.lit(1)).alias("candidates"),
    )
    good = g.where(c("_lo").isNull() | (c("_lo") == c("_hi")))
    bad = g.where(c("_lo") != c("_hi"))
    picked = F.coalesce(c("_official"), c("_numeric"), c("_clash"), c("_last"))
    accepted = good.withColumn("_p", picked).select(*keys, "_p.value", "_p.data_status", "_p.source_name", "_p.seq", "candidates")
    return accepted, bad.select(*keys, c("_lo").alias("lowest"), c("_hi").alias("highest"), "candidates")


def explicit_absences(years: DataFrame, points: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """NOT_DISCLOSED points for every company-year and required field that has none."""
    wanted = years.select(
        "company_id",
        F.explode(
            F.transform(
                F.array(*[F.lit(f) for f in fields]),
                lambda f: F.concat(F.lit("FY"), c("fiscal_year").cast("string"), F.lit("."), f),
            )
        ).alias("field_id"),
    )
    missing = wanted.join(points.select("company_id", "field_id").distinct(), ["company_id", "field_id"], "left_anti")
    return missing.withColumns({"value": F.lit(None).cast("double"), "data_status": F.lit("NOT_DISCLOSED")})


def change_plan(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per key the content hash before and after and what happens to the row."""
    from cashlens.functions.hashing import digest, stable_json

    h = lambda df, name: df.select(key, digest(stable_json(*[x for x in df.columns if x != key])).alias(name))
    j = h(before, "pre_hash").join(h(after, "post_hash"), key, "full_outer")
    action = (
        F.when(c("pre_hash").isNull(), "CREATE")
        .when(c("post_hash").isNull(), "UNTOUCHED")
        .when(c("pre_hash") == c("post_hash"), "UNCHANGED")
        .otherwise("CHANGE")
    )
    return j.withColumn("action", action)


def coverage_slots(years: DataFrame, facts: DataFrame, candidates: DataFrame, newest: int = 5) -> DataFrame:
    """Newest years x companies: READY with a fact, else BLOCKED with a reason code.

    ``candidates``: company_id, fiscal_year, amount_kind, dividend_kind, lifecycle_status.
    """
    slots = years.select("company_id", "fiscal_year").distinct()
    w = Window.partitionBy("company_id").orderBy(F.desc("fiscal_year"))
    slots = slots.withColumn("_k", F.row_number().over(w)).where(c("_k") <= newest).drop("_k")
    total = c("amount_kind") == "TOTAL"
    ordinary = total & (c("dividend_kind") == "ORDINARY")
    diag = candidates.groupBy("company_id", "fiscal_year").agg(
        F.count(F.lit(1)).alias("related"),
        F.count(F.when(ordinary, 1)).alias("ordinary_totals"),
        F.count(F.when(total & (c("dividend_kind") == "SPECIAL"), 1)).alias("special_totals"),
        F.count(F.when(ordinary & (c("lifecycle_status") == "PROPOSED"), 1)).alias("proposals"),
    )
    j = slots.join(facts.select("company_id", "fiscal_year", "amount"), ["company_id", "fiscal_year"], "left").join(
        diag, ["company_id", "fiscal_year"], "left"
    )
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    reason = (
        F.when(c("amount").isNotNull(), F.lit(None).cast("string"))
        .when(c("company_id").cast("string").startswith("HK"), "HK_TOTAL_CURRENCY_OR_LIFECYCLE_NOT_RECONCILED")
        .when(zero("ordinary_totals") == 0, "NO_OFFICIAL_COMPLETE_TOTAL_LOCATED")
        .when(zero("special_totals") > 0, "ORDINARY_AND_SPECIAL_NOT_SEPARATED")
        .when(zero("proposals") == zero("ordinary_totals"), "PROPOSAL_WITHOUT_VERIFIED_IMPLEMENTED_TOTAL")
        .otherwise("COMPLETE_COMPONENT_SET_NOT_RECONCILED")
    )
    return j.select(
        "company_id",
        "fiscal_year",
        F.when(c("amount").isNotNull(), "READY").otherwise("BLOCKED").alias("slot_status"),
        reason.alias("reason_code"),
        zero("related").alias("related_candidates"),
    )


def distribution_total(components: DataFrame, totals: DataFrame) -> DataFrame:
    """Sum of components in one currency against the stated total.

    ``components``: distribution_id, value, currency, amount_method, per_share_value, entitled_shares, share_basis.
    """
    derived = (c("per_share_value") * c("entitled_shares") / c("share_basis")).cast("decimal(38,6)")
    amount = F.when(c("amount_method") == "OFFICIAL_TOTAL", c("value")).otherwise(derived)
    bad = (c("amount_method") != "OFFICIAL_TOTAL") & ~F.coalesce(derived == c("value"), F.lit(False))
    g = components.groupBy("distribution_id").agg(
        F.sum(amount).alias("component_sum"),
        F.count(F.lit(1)).alias("components"),
        F.min("currency").alias("_c1"),
        F.max("currency").alias("_c2"),
        F.max(bad).alias("_bad"),
    )
    j = g.join(totals.select("distribution_id", c("value").alias("stated_total"), c("currency").alias("_tc")), "distribution_id", "left")
    issues = F.array_compact(
        F.array(
            F.when(c("_c1") != c("_c2"), F.lit("MIXED_CURRENCY")),
            F.when(c("_bad"), F.lit("COMPONENT_DERIVATION_MISMATCH")),
            F.when(c("stated_total").isNull(), F.lit("TOTAL_MISSING")),
            F.when(c("_tc") != c("_c1"), F.lit("TOTAL_CURRENCY_MISMATCH")),
            F.when(c("component_sum") != c("stated_total"), F.lit("SUM_MISMATCH")),
        )
    )
    return j.withColumn("issues", issues).drop("_c1", "_c2", "_tc", "_bad")


def convert_reviewed(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, rejects) from reviewed facts: only ACCEPT, all checks true, equal values, one currency."""
    checks_ok = F.forall(F.map_values("checks"), lambda x: F.coalesce(x, F.lit(False)))
    same = (c("value") == c("official_value")) & (c("value") == c("candidate_value"))
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce(c("decision") == "ACCEPT", F.lit(False)), F.lit("NOT_ACCEPTED")),
            F.when(~F.coalesce(checks_ok, F.lit(False)), F.lit("CHECK_FAILED")),
            F.when(~F.coalesce(same, F.lit(False)), F.lit("VALUES_DIFFER")),
            F.when(F.coalesce(F.size(F.array_distinct("currencies")), F.lit(0)) != 1, F.lit("CURRENCY_NOT_UNIQUE")),
            F.when(F.exists("forbidden_values", lambda x: x.isNotNull()), F.lit("FORBIDDEN_NUMERIC_PRESENT")),
        )
    )
    s = reviews.withColumn("reasons", reasons)
    points = s.where(F.size("reasons") == 0).select(
        "company_id",
        F.concat(F.lit("FY"), c("fiscal_year").cast("string"), F.lit("."), c("field")).alias("field_id"),
        "value",
        F.when(c("value") == 0, "KNOWN_ZERO").otherwise("VALID").alias("data_status"),
        c("currencies")[0].alias("currency"),
    )
    return points, s.where(F.size("reasons") > 0)


def coverage_matrix(points: DataFrame, newest: int = 5) -> DataFrame:
    """Field x VALID / MISSING / CONFLICT counts over the newest years of each company."""
    per = points.select("company_id", "fiscal_year", "field", "data_status").groupBy("company_id", "fiscal_year", "field").agg(
        F.max(c("data_status") == "CONFLICT").alias("_c"), F.max(c("data_status").isin(*ACCEPTED)).alias("_v")
    )
    w = Window.partitionBy("company_id").orderBy(F.desc("fiscal_year"))
    recent = per.withColumn("_k", F.dense_rank().over(w)).where(c("_k") <= newest)
    return recent.groupBy("field").agg(
        F.count(F.when(~c("_c") & c("_v"), 1)).alias("valid"),
        F.count(F.when(c("_c"), 1)).alias("conflict"),
        F.count(F.when(~c("_c") & ~c("_v"), 1)).alias("missing"),
    )


def archive_coverage(documents: DataFrame, companies: DataFrame) -> DataFrame:
    """VERIFIED / PARTIAL / ERROR / PENDING per company from selected, verified and failed documents."""
    g = documents.groupBy("company_id").agg(
        F.count(F.when(c("selected"), 1)).alias("selected"),
        F.count(F.when(c("selected") & c("verified"), 1)).alias("verified"),
        F.count(F.when(c("failed"), 1)).alias("errors"),
    )
    j = companies.select("company_id").join(g, "company_id", "left").fillna(0, ["selected", "verified", "errors"])
    status = (
        F.when((c("selected") > 0) & (c("selected") == c("verified")), "VERIFIED")
        .when(c("verified") > 0, "PARTIAL")
        .when(c("errors") > 0, "ERROR")
        .otherwise("PENDING")
    )
    return j.withColumn("coverage_status", status)


def both_ways(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, labelled by side."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    j = a.join(b, keys, "full_outer").where(c("_l").isNull() | c("_r").isNull())
    return j.select(*keys, F.when(c("_r").isNull(), "left_only").otherwise("right_only").alias("side"))


def default_calendar(companies: DataFrame, overrides: DataFrame, market_defaults: DataFrame, year: Column) -> DataFrame:
    """Fiscal year end: company override, else market default (two small left joins)."""
    j = companies.join(overrides.select("company_id", c("month").alias("_m1"), c("day").alias("_d1")), "company_id", "left").join(
        market_defaults.select("market", c("month").alias("_m2"), c("day").alias("_d2")), "market", "left"
    )
    return j.withColumn(
        "fiscal_year_end_date", F.make_date(year, F.coalesce("_m1", "_m2"), F.coalesce("_d1", "_d2"))
    ).drop("_m1", "_d1", "_m2", "_d2")


def current_scores(subjects: DataFrame, manual: DataFrame, reviewed: DataFrame, score_id: str, on: Column) -> DataFrame:
    """Score valid on a date: the manual configuration first, the reviewed overlay second.

    The interval test runs on each score table before the join, so the join is a plain equi join.
    """

    def valid(df: DataFrame, name: str) -> DataFrame:
        ok = (
            (c("score_id") == score_id)
            & c("value").between(0, 100)
            & (F.length(F.trim("source")) > 0)
            & (F.length(F.trim("reason")) > 0)
            & (c("as_of_date") <= on)
            & (on <= c("expires_at"))
        )
        return df.where(ok).groupBy("company_id").agg(F.max_by("value", "as_of_date").alias(name))

    return (
        subjects.join(valid(manual, "_m"), "company_id", "left")
        .join(valid(reviewed, "_r"), "company_id", "left")
        .withColumn(score_id, F.coalesce("_m", "_r"))
        .drop("_m", "_r")
    )
