"""Rule columns: each contract yields an array of issue codes per row instead of an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashlens.functions import policy as P
from cashlens.functions.numeric import reconciles
from cashlens.operators.scale import duplicate_keys, join_null_safe, lag_in_buckets

c = F.col
# Fixed values.
DATA_STATUSES = ("VALID", "KNOWN_ZERO", "MISSING", "NOT_DISCLOSED", "NOT_APPLICABLE", "CONFLICT", "STALE", "CALCULATION_FAILED")
SCREEN_STATUSES = ("READY", "DATA_LIMITED", "STALE", "UNAVAILABLE")
ALLOWED_FATAL = ("COMPANY_OR_SECURITY_IDENTITY_CONFLICT", "LEGAL_PRICE_MISSING", "NON_FINITE_INPUT", "STRUCTURE_DAMAGED")
AMOUNT_UNITS = ("currency", "currency_per_share", "yuan", "hundred_million_yuan")
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"
QUOTE_CODE = r"^(SH|SZ|HK|US)\.[A-Z0-9.]{1,12}$"


def issues(*rules: tuple[str, Column]) -> Column:
    """Array of the codes whose condition holds (a null condition does not)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules]))


def blank(x: str) -> Column:
    return F.coalesce(F.length(F.trim(c(x))), F.lit(0)) == 0


def duplicate_report(df: DataFrame, *keys: str) -> DataFrame:
    """For each key column its repeated values and counts."""
    parts = [
        duplicate_keys(df.where(c(k).isNotNull()), [k]).select(
            F.lit(k).alias("key_name"), c(k).cast("string").alias("key_value"), "n"
        )
        for k in keys
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def provenance_issues(points: DataFrame) -> DataFrame:
    """Contract of a provenance point: texts present, value and status consistent, currency on amounts."""
    texts = (
        "company_id", "field_id", "source_name", "source_document", "source_url_or_local_path",
        "fiscal_period", "unit", "restatement_status",
    )
    have = [t for t in texts if t in points.columns]
    missing_text = F.lit(False)
    for t in have:
        missing_text = missing_text | blank(t)
    number = c("data_status").isin("VALID", "KNOWN_ZERO")
    return points.withColumn(
        "issues",
        issues(
            ("BLANK_PROVENANCE_TEXT", missing_text),
            ("UNKNOWN_STATUS", ~c("data_status").isin(*DATA_STATUSES) | c("data_status").isNull()),
            ("VALUE_REQUIRED", number & c("value").isNull()),
            ("VALUE_FORBIDDEN", ~number & c("value").isNotNull()),
            ("ZERO_NOT_MARKED", (c("value") == 0) & (c("data_status") != "KNOWN_ZERO")),
            ("CURRENCY_REQUIRED", c("value").isNotNull() & blank("currency") & c("unit").isin(*AMOUNT_UNITS)),
        ),
    )


def point_issues(points: DataFrame, keys: list[str], width: int = 100_000) -> DataFrame:
    """Repeat of the previous row of the same identity, source conflict, incomplete source.

    The previous row is found in buckets of the ingest sequence, so a hot identity is not sorted in
    one task.
    """
    prior = lag_in_buckets(
        points.withColumn("_pair", F.concat_ws("|", F.coalesce(c("value").cast("string"), F.lit("null")), "restatement_status")),
        keys,
        ["ingest_seq"],
        F.floor(c("ingest_seq") / width),
        "_pair",
        "_prior",
    )
    return prior.withColumn(
        "issues",
        issues(
            ("DUPLICATE_SOURCE_RECORD", c("_prior") == c("_pair")),
            ("RAW_SOURCE_CONFLICT", c("data_status").isin("CONFLICT", "CALCULATION_FAILED")),
            ("RAW_SOURCE_INCOMPLETE", c("data_status").isin("MISSING", "NOT_DISCLOSED", "STALE")),
        ),
    ).drop("_pair", "_prior")


ERROR_CODES = ("DUPLICATE_SOURCE_RECORD", "RAW_SOURCE_CONFLICT")


def publication_status(issue_codes: Column, errors: tuple[str, ...] = ERROR_CODES) -> Column:
    """INVALID with any error, PARTIAL with any issue, else VALID."""
    return (
        F.when(F.arrays_overlap(issue_codes, F.array(*[F.lit(e) for e in errors])), "INVALID")
        .when(F.size(issue_codes) > 0, "PARTIAL")
        .otherwise("VALID")
    )


def required_minus_present(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Required keys without a row."""
    return required.select(*keys).distinct().join(present.select(*keys), keys, "left_anti")


# Fields a calculation of each industry needs.
ANNUAL_FIELDS = (
    "ordinary_dividend", "special_dividend", "gross_cancelled_buyback", "cancelled_shares",
    "diluted_net_share_reduction", "asset_sale_distribution", "one_off_buyback",
)
CASH_FLOW_FIELDS = ("operating_cash_flow", "capital_expenditure", "lease_principal_repayment")
BANK_FIELDS = (
    "adjusted_net_income", "capital_generation_capacity", "cet1_ratio", "cet1_regulatory_minimum",
    "risk_weighted_asset_growth", "nonperforming_loan_ratio", "provision_coverage_ratio", "credit_cost",
    "net_interest_margin",
)
INSURANCE_FIELDS = (
    "free_surplus_generation", "distributable_surplus_capacity", "comprehensive_solvency_ratio",
    "comprehensive_solvency_minimum", "core_solvency_ratio", "core_solvency_minimum",
    "investment_asset_quality_score", "interest_rate_sensitivity_score", "new_business_value",
)
RECONCILIATION_FIELDS = (
    "dividend_per_share_times_entitled_shares", "repurchased_shares_times_average_price",
    "opening_minus_closing_shares", "cancelled_minus_issued_and_converted",
)


def required_field_ids(
    years: DataFrame, classes: DataFrame, cash_years: DataFrame, companies: DataFrame, balance_years: DataFrame
) -> DataFrame:
    """All (company_id, field_id) pairs the current calculation needs a source for.

    Years, share classes and companies are made distinct before they unfold to field ids: no two of them share an id,
    so the many pairs are distinct without a shuffle or a hash table of their own. Without a year or a security the id
    is null, one for both.
    """
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")

    def needs(df: DataFrame, scope: str, part: Column, need: Column) -> DataFrame:
        part = part.cast("string")
        return df.select("company_id", F.when(part.isNull(), "NONE").otherwise(scope).alias("_scope"), part.alias("_part"), need.alias("_need"))

    year, kind = c("fiscal_year"), c("industry_kind")
    flows = cash_years.join(companies.where(kind == "NON_FINANCIAL").select("company_id"), "company_id", "left_semi")
    every = (
        needs(years, "FY", year, F.lit("annual"))
        .unionByName(needs(classes.where(F.coalesce(c("material"), F.lit(True))), "SECURITY", c("security_id"), F.lit("market")))
        .unionByName(needs(flows, "FY", year, F.lit("flows")))
        .unionByName(needs(companies, "COMPANY", F.lit(""), F.when(kind == "BANK", "bank").when(kind == "INSURANCE", "insurance").otherwise("fixed")))
        .unionByName(needs(balance_years, "FY", year, F.lit("debt")))
    )
    needed = lambda name: F.max(c("_need") == name).alias(name)
    scopes = every.groupBy("company_id", "_scope", "_part").agg(*map(needed, ("annual", "flows", "debt", "bank", "insurance")))
    fields = lambda name, xs: F.when(c(name), arr(xs)).otherwise(arr([]))
    of_year = F.concat(fields("annual", ANNUAL_FIELDS), fields("flows", CASH_FLOW_FIELDS), fields("debt", ["net_debt"]))
    of_security = F.array(
        F.concat(F.lit("MARKET."), c("_part"), F.lit(".price")),
        F.concat(F.lit("MARKET."), c("_part"), F.lit(".fx_to_base")),
        F.concat(F.lit("SECURITY."), c("_part"), F.lit(".issued_shares")),
        F.concat(F.lit("SECURITY."), c("_part"), F.lit(".economic_rights_factor")),
    )
    of_company = F.concat(
        fields("bank", [f"CURRENT.{f}" for f in BANK_FIELDS]),
        fields("insurance", [f"CURRENT.{f}" for f in INSURANCE_FIELDS]),
        arr(["VALUATION.current", "VALUATION.historical_median", *[f"RECONCILIATION.{f}" for f in RECONCILIATION_FIELDS]]),
    )
    ids = (
        F.when(c("_scope") == "FY", F.transform(of_year, lambda f: F.concat(F.lit("FY"), c("_part"), F.lit("."), f)))
        .when(c("_scope") == "SECURITY", of_security)
        .when(c("_scope") == "COMPANY", of_company)
        .otherwise(F.array(F.lit(None).cast("string")))
    )
    return scopes.select("company_id", F.explode(ids).alias("field_id"))


def accounting_identities(df: DataFrame) -> DataFrame:
    """Four identities with their tolerances: market cap, dividend, buyback, share bridge."""
    t = P.TOLERANCES
    checks = {
        "company_market_cap": ("total_market_cap", "class_market_cap", t["relative"]),
        "ordinary_dividend": ("total_dividend", "dividend_per_share_times_shares", t["relative"]),
        "buyback_cash": ("buyback_cash", "repurchased_shares_times_price", t["relative"]),
        "share_count_bridge": ("opening_minus_closing", "cancelled_minus_issued", t["share_count_relative"]),
    }
    rules = []
    for name, (a, b, rel) in checks.items():
        rules.append((f"RECONCILIATION_INPUT_MISSING:{name}", c(a).isNull() | c(b).isNull()))
        rules.append((f"RECONCILIATION_MISMATCH:{name}", ~reconciles(c(a), c(b), rel, t["absolute"])))
    return df.withColumn("issues", issues(*rules)).withColumn(
        "validation_status", F.when(F.size("issues") > 0, "INVALID").otherwise("VALID")
    )


def release_issues(records: DataFrame) -> DataFrame:
    """Contract of a release record: identity, status domain, score and coverage ranges, fatal codes.

    Repeated ids are counted with an aggregate and joined back.
    """
    n = records.groupBy("company_id").agg(F.count(F.lit(1)).alias("_n"))
    j = records.join(n, "company_id", "left")
    rules: list[tuple[str, Column]] = [
        ("MISSING_COMPANY_ID", c("company_id").isNull() | (c("company_id").cast("string") == "")),
        ("DUPLICATE_COMPANY_ID", c("_n") > 1),
        ("INVALID_SCREEN_STATUS", ~c("status").isin(*SCREEN_STATUSES) | c("status").isNull()),
    ]
    for s in ("opportunity", "resilience"):
        v, k = c(f"{s}_value"), c(f"{s}_coverage")
        rules.append((f"INVALID_COVERAGE:{s}", k.isNull() | F.isnan(k)))
        rules.append((f"COVERAGE_OUT_OF_RANGE:{s}", (k < 0) | (k > 1)))
        rules.append((f"SCORE_OUT_OF_RANGE:{s}", F.isnan(v) | (v < 0) | (v > 100)))
    if "fatal_errors" in records.columns:
        rules.append(("INVALID_FATAL_ERROR", F.size(F.array_except("fatal_errors", F.array(*[F.lit(x) for x in ALLOWED_FATAL]))) > 0))
    if "components" in records.columns:
        rules.append(("INVALID_COMPONENT_BASIS", F.exists(F.map_values("components"), lambda x: F.coalesce(F.length(x["basis"]), F.lit(0)) == 0)))
    return j.withColumn("issues", issues(*rules)).drop("_n")


def release_verdict(checked: DataFrame, expected: int | None = None) -> DataFrame:
    """One row: record count, number of records with issues, and whether the release may be activated."""
    g = checked.agg(
        F.count(F.lit(1)).alias("records"), F.count(F.when(F.size("issues") > 0, 1)).alias("records_with_issues")
    )
    ok = (c("records") > 0) & (c("records_with_issues") == 0)
    if expected is not None:
        ok = ok & (c("records") == expected)
    return g.withColumn("validity", F.when(ok, "VALID_RELEASE").otherwise("REJECTED_RELEASE"))


def capital_structure_issues(df: DataFrame) -> DataFrame:
    """Row contract of the capital-structure registry: identity, classes, and evidence behind each authorisation."""
    kinds = ("SINGLE_CLASS", "A_H", "ADS", "DUAL_COUNTER", "MULTI_CLASS")
    semantics = ("VENDOR_COMPANY_MARKET_VALUE", "VENDOR_SELECTED_SECURITY_EQUIVALENT_VALUE", "UNRESOLVED")
    vendor, direct = c("vendor_value_authorized"), c("direct_equivalent_shares_authorized")
    no_shares = c("official_equivalent_shares").isNull() | (c("official_equivalent_shares") <= 0)
    no_sources = (F.coalesce(F.size("authorization_source_ids"), F.lit(0)) < 1) | c("as_of_date").isNull()
    unequal = (c("structure_kind") == "A_H") & ~F.coalesce(c("distribution_rights_equal"), F.lit(False))
    no_ratio = (c("structure_kind") == "ADS") & ~F.coalesce(c("ads_ordinary_shares_per_security") > 0, F.lit(False))
    classes = c("material_share_classes")
    return df.withColumn(
        "issues",
        issues(
            ("COMPANY_ID_MISSING", blank("company_id")),
            ("SECURITY_ID_MISSING", blank("selected_security_id")),
            ("STRUCTURE_KIND_INVALID", ~c("structure_kind").isin(*kinds) | c("structure_kind").isNull()),
            ("SHARE_CLASSES_INVALID", (F.coalesce(F.size(classes), F.lit(0)) < 1) | (F.size(F.array_distinct(classes)) < F.size(classes))),
            ("RIGHTS_FACTOR_INVALID", c("selected_security_rights_factor").isNull() | (c("selected_security_rights_factor") <= 0)),
            ("SEMANTICS_INVALID", ~F.coalesce(c("vendor_semantics"), F.lit("UNRESOLVED")).isin(*semantics)),
            ("AUTHORIZATION_FLAG_MISSING", vendor.isNull() | direct.isNull()),
            ("VENDOR_WITHOUT_EVIDENCE", vendor & ((F.coalesce(c("vendor_semantics"), F.lit("UNRESOLVED")) == "UNRESOLVED") | no_sources)),
            ("AUTHORIZED_WITHOUT_SHARES", (vendor | direct) & no_shares),
            ("VENDOR_DIFFERENCE_ABOVE_LIMIT", vendor & ~F.coalesce(c("observed_relative_difference").between(0, 0.05), F.lit(False))),
            ("DIRECT_WITHOUT_EVIDENCE", direct & no_sources),
            ("RIGHTS_NOT_EQUAL", (vendor | direct) & unequal),
            ("DEPOSITARY_RATIO_MISSING", (vendor | direct) & no_ratio),
        ),
    )


def identifier_issues(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "issues",
        issues(
            ("UNSAFE_COMPANY_ID", ~F.coalesce(c("company_id").cast("string").rlike(SAFE_ID), F.lit(False))),
            ("INVALID_QUOTE_CODE", ~F.coalesce(c("quote_code").rlike(QUOTE_CODE), F.lit(False))),
        ),
    )


def bundle_issues(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Files listed and present must be the same set with equal size and SHA-256.

    ``manifest``: path, size, sha256; ``present``: path, length, sha256.
    """
    m = manifest.select("path", c("size").alias("_ms"), c("sha256").alias("_mh"), F.lit(True).alias("_m"))
    p = present.select("path", c("length").alias("_ps"), c("sha256").alias("_ph"), F.lit(True).alias("_p"))
    j = m.join(p, "path", "full_outer")
    return j.select(
        "path",
        issues(
            ("FILE_MISSING", c("_p").isNull()),
            ("FILE_NOT_LISTED", c("_m").isNull()),
            ("SIZE_MISMATCH", c("_ms") != c("_ps")),
            ("HASH_MISMATCH", c("_mh") != c("_ph")),
        ).alias("issues"),
    )


def self_hash_issues(df: DataFrame) -> DataFrame:
    """Declared content hash against the hash of the stored text."""
    return df.withColumn(
        "issues",
        issues(
            ("HASH_FORMAT", ~F.coalesce(c("declared_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))),
            ("HASH_MISMATCH", F.sha2("content", 256) != c("declared_sha256")),
        ),
    )


def fragment_issues(checks: DataFrame, pages: DataFrame) -> DataFrame:
    """Every required fragment must occur on the cited page, and the page must exist.

    ``checks``: check_id, document_id, page, fragments; ``pages``: document_id, page, text.
    """
    squeeze = lambda x: F.regexp_replace(x, r"\s+", "")
    j = checks.join(pages.select("document_id", "page", squeeze(c("text")).alias("_t")), ["document_id", "page"], "left")
    missing = F.filter("fragments", lambda f: ~c("_t").contains(squeeze(f)))
    return j.select(
        "check_id",
        "document_id",
        "page",
        F.when(c("_t").isNull(), c("fragments")).otherwise(missing).alias("missing_fragments"),
        issues(("PAGE_OUT_OF_RANGE", c("_t").isNull()), ("FRAGMENT_MISSING", F.size(missing) > 0)).alias("issues"),
    )


def reviewed_score_issues(df: DataFrame) -> DataFrame:
    """Reviewed qualitative score: dimension set, rounded mean, validity, red-flag cap, source.

    ``df``: score_id, value, dimensions map<string,int>, red_flags array, as_of_date, expires_at, source.
    """
    rules: list[tuple[str, Column]] = []
    mean = F.aggregate(F.map_values("dimensions"), F.lit(0.0), lambda a, x: a + x) / F.size("dimensions")
    for score_id, rub in P.REVIEW_RUBRIC.items():
        mine = c("score_id") == score_id
        want = F.array_sort(F.array(*[F.lit(d) for d in rub["dimensions"]]))
        flags = F.array(*[F.lit(x) for x in rub["red_flags"]])
        rules.append((f"DIMENSIONS_MISMATCH:{score_id}", mine & ~F.array_sort(F.map_keys("dimensions")).eqNullSafe(want)))
        rules.append((f"UNKNOWN_RED_FLAG:{score_id}", mine & (F.size(F.array_except("red_flags", flags)) > 0)))
        rules.append((f"RED_FLAG_CAP:{score_id}", mine & (F.size("red_flags") > 0) & (c("value") > rub["red_flag_cap"])))
    rules += [
        ("SCORE_ID_UNKNOWN", ~c("score_id").isin(*P.REVIEW_RUBRIC)),
        ("DIMENSION_OUT_OF_RANGE", F.exists(F.map_values("dimensions"), lambda x: (x < 0) | (x > 100))),
        ("MEAN_MISMATCH", c("value") != F.floor(mean + 0.5)),
        ("VALIDITY_TOO_LONG", F.datediff("expires_at", "as_of_date") > P.REVIEW_MAX_VALIDITY_DAYS),
        ("VALIDITY_ORDER", c("expires_at") < c("as_of_date")),
        ("SOURCE_MISSING", blank("source")),
    ]
    return df.withColumn("issues", issues(*rules))


# Fixed values.
IDENTITY_FIELDS = (
    "schema_version", "prompt_version", "model", "reasoning_effort", "analysis_id", "analysis_mode", "company_id",
    "input_snapshot_hash", "calculation_version",
)
SNAPSHOT_FIELDS = ("company_name", "ticker", "market", "as_of_date")
PLACEHOLDER_HOSTS = ("localhost", "example.com", "www.example.com")
PLACEHOLDER_ENDINGS = (".local", ".invalid")
URGENT_MODES = ("URGENT_VETO_REVIEW", "URGENT_RISK_REVIEW")


def source_url_issue(url: Column) -> Column:
    """SOURCE_SCHEME without http or https or a host, SOURCE_NOT_PUBLIC for local and placeholder hosts, else null."""
    known = F.coalesce(url, F.lit(""))
    place = F.regexp_extract(known, r"^(?i:https?)://([^/?#]*)", 1)
    # user and port are no part of the host; a host in brackets keeps its colons
    host = F.lower(F.regexp_extract(F.regexp_replace(place, r"^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1))
    ending = F.endswith(host, F.lit(PLACEHOLDER_ENDINGS[0])) | F.endswith(host, F.lit(PLACEHOLDER_ENDINGS[1]))
    return F.when(place == "", "SOURCE_SCHEME").when(host.isin(*PLACEHOLDER_HOSTS) | ending, "SOURCE_NOT_PUBLIC")


def analysis_output_issues(payloads: DataFrame, jobs: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Analysis payloads with the rules they break, sorted in the order of the rules.

    ``payloads``: the identity and snapshot fields, trigger_type, report_markdown, source_urls, verdict,
    data_issue_detected, data_issue_notes. ``jobs`` has one row per analysis_id with the expected identity and
    trigger_type; ``snapshots`` one per company_id with the snapshot fields, of which null ones ask for nothing.
    A payload without its job breaks JOB_UNKNOWN. Each payload meets one job and one snapshot.
    """
    expected = [x for x in IDENTITY_FIELDS if x != "analysis_id"]
    # a null id meets no job, and its own rows stay
    queued = jobs.select(c("analysis_id").alias("_job"), *[c(x).alias(f"_e_{x}") for x in [*expected, "trigger_type"]])
    j = payloads.join(queued, c("analysis_id") == c("_job"), "left")
    rules: list[tuple[str, Column]] = [("JOB_UNKNOWN", c("_job").isNull())]
    found = c("_job").isNotNull()
    rules += [(f"IDENTITY:{x}", found & ~c(x).eqNullSafe(c(f"_e_{x}"))) for x in expected]
    rules.append(("TRIGGER_MISMATCH", found & ~c("trigger_type").eqNullSafe(c("_e_trigger_type"))))
    if snapshots is not None:
        shown = snapshots.select(c("company_id").alias("_company"), *[c(x).alias(f"_s_{x}") for x in SNAPSHOT_FIELDS])
        j = j.join(shown, c("company_id") == c("_company"), "left")
        rules += [(f"SNAPSHOT:{x}", c(f"_s_{x}").isNotNull() & ~c(x).eqNullSafe(c(f"_s_{x}"))) for x in SNAPSHOT_FIELDS]
    urls = F.coalesce("source_urls", F.array().cast("array<string>"))
    broken = F.transform(urls, source_url_issue)
    has = lambda code: F.exists(broken, lambda x: F.coalesce(x == code, F.lit(False)))
    notes = F.coalesce(F.size("data_issue_notes"), F.lit(0)) > 0
    rules += [
        ("RAW_HTML", F.coalesce(c("report_markdown"), F.lit("")).rlike("[<>]")),
        ("SOURCE_SCHEME", has("SOURCE_SCHEME")),
        ("SOURCE_NOT_PUBLIC", has("SOURCE_NOT_PUBLIC")),
        ("URGENT_SCALE_IN", c("analysis_mode").isin(*URGENT_MODES) & (c("verdict") == "SCALE_IN")),
        ("DATA_ISSUE_DISAGREES", F.coalesce(c("data_issue_detected"), F.lit(False)) != notes),
    ]
    extra = [x for x in j.columns if x.startswith(("_e_", "_s_")) or x in ("_job", "_company")]
    return j.withColumn("issues", issues(*rules)).drop(*extra)


def document_checks(df: DataFrame, names: list[str]) -> DataFrame:
    """Named boolean checks as one map; all must hold, the failed names are listed."""
    pairs = []
    for n in names:
        pairs += [F.lit(n), F.coalesce(c(n), F.lit(False))]
    m = F.create_map(*pairs)
    return df.withColumn("checks", m).withColumns(
        {
            "all_checks_hold": F.forall(F.map_values("checks"), lambda v: v),
            "failed_checks": F.array_sort(F.map_keys(F.map_filter("checks", lambda _, v: ~v))),
        }
    )


def last_valid(candidate: DataFrame, stored: DataFrame) -> DataFrame:
    """What may be published, beside the last valid row of the company.

    A row with a data tier is current as it is, BLOCKED clears its score.  Without a tier VALID and
    PARTIAL are current; anything else keeps the stored row, marked STALE or INVALID.
    """
    s = stored.select("company_id", c("score").alias("_s"), c("run_at").alias("_r"))
    j = candidate.join(s, "company_id", "left")
    tiered = F.coalesce(c("data_tier"), F.lit("")) != ""
    blocked = tiered & (c("data_tier") == "BLOCKED")
    current = tiered | c("data_status").isin("VALID", "PARTIAL")
    kept = ~current & c("_r").isNotNull()
    return j.select(
        "company_id",
        F.when(blocked, F.lit(None)).when(kept, c("_s")).otherwise(c("score")).alias("score"),
        F.when(kept, c("_r")).otherwise(c("run_at")).alias("run_at"),
        F.when(kept, F.when(c("data_status") == "STALE", "STALE").otherwise("INVALID"))
        .otherwise(c("data_status"))
        .alias("data_status"),
        F.when(blocked, "BLOCKED")
        .when(kept, "BLOCKED_USING_LAST_VALID")
        .when(~current, "BLOCKED_NO_VALID_BASELINE")
        .otherwise("CURRENT")
        .alias("update_status"),
    )


def candidate_verdict(tolerance: float = 0.0001) -> Column:
    """Status of a text candidate against the prior report: (match_count, value, comparative_value, currency, unit)
    of the candidate, and prior_value, prior_currency, prior_unit of the same field a year before.

    A candidate counts when it is the only one of its field and its comparative column agrees with the prior report
    within the relative tolerance (of the larger amount, at least 1).
    """
    scale = F.greatest(F.abs(c("comparative_value")), F.abs(c("prior_value")), F.lit(1))
    apart = F.abs(c("comparative_value") - c("prior_value")) > scale * F.lit(str(tolerance)).cast("decimal(9,6)")
    comparable = (
        c("value").isNotNull()
        & c("comparative_value").isNotNull()
        & c("prior_value").isNotNull()
        & F.coalesce(c("currency") == c("prior_currency"), F.lit(False))
        & F.coalesce(c("unit") == c("prior_unit"), F.lit(False))
    )
    unique = F.coalesce(c("match_count") == 1, F.lit(False)) & F.coalesce(c("status") != "CONFLICT", F.lit(True))
    return (
        F.when(~unique, "CONFLICT")
        .when(~comparable, "REVIEW_REQUIRED")
        .when(apart, "CONFLICT")
        .when(c("value") == 0, "KNOWN_ZERO")
        .otherwise("VALID")
    )


def text_candidate_check(candidates: DataFrame, prior: DataFrame, keys: list[str], tolerance: float = 0.0001) -> DataFrame:
    """Candidates with their verdict in ``status``. ``prior`` has one row per key: value, currency, unit."""
    before = prior.select(*keys, c("value").alias("prior_value"), c("currency").alias("prior_currency"), c("unit").alias("prior_unit"))
    joined = join_null_safe(candidates, before, keys, "left")
    return joined.withColumn("status", candidate_verdict(tolerance)).select(*candidates.columns)
