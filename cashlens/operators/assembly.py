"""Putting company records together: input joins, enrichment, scoping, work order, import plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashlens.functions import text as X
from cashlens.functions.hashing import digest
from cashlens.functions.market import a_share_fields, h_share_fields
from cashlens.operators.quality import issues

c = F.col
# Fixed values.
PUBLIC_SCHEMA = "shareholder-screen-v2"
OPEN_STATUSES = ("QUEUED", "RETRY_WAIT")
MODE_PRIORITY = ("URGENT_RISK_REVIEW", "URGENT_VETO_REVIEW", "FULL_ENTRY_REVIEW", "MATERIAL_CHANGE_REVIEW")


def build_universe(listings: DataFrame, issuers: DataFrame) -> DataFrame:
    """Watch-list rows from listing codes: ids, quote code, ticker, market and currency follow the listing.

    ``listings``: code, listing ('A' or 'H'), name, sector, industry; ``issuers``: name, issuer_id.
    """
    a, h = a_share_fields(c("code")), h_share_fields(c("code"))
    fields = {k: F.when(c("listing") == "A", a[k]).otherwise(h[k]) for k in a}
    rows = listings.withColumns(fields).join(issuers, "name", "left")
    return rows.withColumn("issuer_id", F.coalesce("issuer_id", "security_id"))


def prepare_inputs(staging: DataFrame, observations: DataFrame, registry: DataFrame, balance: DataFrame) -> DataFrame:
    """Company input: staging with quote, capital structure and balance sheet; a missing authorisation is an issue."""
    packed = lambda df, name: df.select("company_id", F.struct(*[x for x in df.columns if x != "company_id"]).alias(name))
    j = (
        staging.join(packed(observations, "observation"), "company_id", "left")
        .join(packed(registry, "authorization"), "company_id", "left")
        .join(packed(balance, "balance"), "company_id", "left")
    )
    return j.withColumn(
        "input_issues",
        issues(
            ("AUTHORIZATION_MISSING", c("authorization").isNull()),
            ("MARKET_OBSERVATION_MISSING", c("observation").isNull()),
            ("BALANCE_SHEET_MISSING", c("balance").isNull()),
        ),
    )


def enrich_watchlist(watch: DataFrame, index: DataFrame, analysis: DataFrame) -> DataFrame:
    """Watch list beside its published record and analysis status (issuer id)."""
    i = index.select(c("company_id").alias("issuer_id"), F.struct(*[x for x in index.columns if x != "company_id"]).alias("screening"))
    a = analysis.select(c("company_id").alias("issuer_id"), c("status").alias("analysis_status"))
    return watch.join(i, "issuer_id", "left").join(a, "issuer_id", "left").withColumn(
        "analysis_status", F.coalesce("analysis_status", F.lit("NOT_REQUESTED"))
    )


def research_bundle(events: DataFrame, disclosures: DataFrame, facts: DataFrame) -> DataFrame:
    """Research material of every company as one long table (kind, reference, content).

    Kept long on purpose: a company with very many events never becomes one huge row.
    """
    e = events.select("company_id", F.lit("EVENT").alias("kind"), c("event_key").alias("reference"), c("payload").alias("content"))
    d = disclosures.select("company_id", F.lit("DISCLOSURE").alias("kind"), c("source_url").alias("reference"), c("source_document").alias("content")).distinct()
    f = facts.where(c("data_status").isin("VALID", "KNOWN_ZERO")).select(
        "company_id", F.lit("FACT").alias("kind"), c("field_id").alias("reference"), c("value").cast("string").alias("content")
    )
    return reduce(DataFrame.unionByName, [e, d, f])


def analysis_eligible(df: DataFrame) -> DataFrame:
    """Whether a snapshot may be analysed, routed by its schema.

    Current schema: usable status, identity, sources and an eligible or event-driven trigger.  Older
    rows: an unblocked tier with a core-valid status, or a VALID / pending PARTIAL data status.
    """
    usable = ("FULLY_VALID", "CORE_VALID_QUALITATIVE_OVERLAY_PENDING")
    current = (
        (c("status") != "UNAVAILABLE")
        & (F.length("company_id") > 0)
        & (F.length("company_name") > 0)
        & c("has_sources")
        & (c("trigger_eligible") | (F.size("event_codes") > 0))
    )
    tiered = c("data_tier").isin("ESTIMATED", "CALCULABLE", "VERIFIED") & c("eligible") & c("eligibility_status").isin(*usable)
    pending = (
        (c("data_status") == "PARTIAL")
        & c("eligible")
        & (c("eligibility_status") == usable[1])
        & (F.size("missing_scores") > 0)
        & (F.size(F.array_except("missing_scores", F.array(F.lit("business_durability"), F.lit("governance_capital_allocation")))) == 0)
    )
    older = F.when(c("data_tier") == "BLOCKED", F.lit(False)).when(
        c("data_tier").isin("ESTIMATED", "CALCULABLE", "VERIFIED"), tiered
    ).otherwise((c("data_status") == "VALID") | pending)
    return df.withColumn(
        "analysis_eligible", F.coalesce(F.when(c("schema_version") == PUBLIC_SCHEMA, current).otherwise(older), F.lit(False))
    )


def candidate_reviews(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Candidates against their reviews on (company, year): completeness, scope, value and source hash."""
    keys = ["company_id", "fiscal_year"]
    a = candidates.select(*keys, F.struct("scope", "value", "sha256").alias("k"))
    b = reviews.select(*keys, F.struct("scope", "value", "sha256", "decision").alias("r"))
    j = a.join(b, keys, "full_outer")
    return j.select(
        *keys,
        c("k.value").alias("value"),
        c("r.decision").alias("decision"),
        issues(
            ("REVIEW_MISSING", c("r").isNull()),
            ("CANDIDATE_MISSING", c("k").isNull()),
            ("SCOPE_MISMATCH", c("k.scope") != c("r.scope")),
            ("VALUE_MISMATCH", c("k.value") != c("r.value")),
            ("SOURCE_HASH_MISMATCH", c("k.sha256") != c("r.sha256")),
        ).alias("issues"),
    )


def manifest_mismatches(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """Candidate metadata against the selected document of its company and year."""
    keys = ["company_id", "fiscal_year"]
    names = ("source_url", "sha256", "source_document")
    m = manifest.where(c("selection_status") == "SELECTED_CURRENT").select(*keys, *[c(n).alias(f"_{n}") for n in names], F.lit(True).alias("_m"))
    j = candidates.join(m, keys, "left")
    rules = [("DOCUMENT_NOT_SELECTED", c("_m").isNull())] + [(f"{n.upper()}_MISMATCH", c(n) != c(f"_{n}")) for n in names]
    return j.withColumn("issues", issues(*rules)).drop("_m", *[f"_{n}" for n in names])


def action_bridge(targets: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Share-capital targets beside the reviewed cancellation of the year; a found one is ACCEPT."""
    keys = ["company_id", "fiscal_year"]
    j = targets.join(cancellations.select(*keys, "cancelled_shares", c("decision").alias("_d")), keys, "left")
    return j.withColumn(
        "bridge_status", F.when(c("_d").isNull(), "NOT_DISCLOSED").when(c("_d") == "ACCEPT", "ACCEPT").otherwise("REVIEW")
    ).drop("_d")


def share_capital_acceptance(rows: DataFrame, newest: int = 5) -> DataFrame:
    """Issued-share candidates accepted for the newest years: exact unit, one class, checks held, unique value.

    ``rows``: company_id, fiscal_year, issued_shares, unit_multiplier, share_classes, checks_hold, status.
    """
    w = Window.partitionBy("company_id").orderBy(F.desc("fiscal_year"))
    ranked = rows.withColumn("_k", F.dense_rank().over(w)).where(c("_k") <= newest)
    reasons = issues(
        ("UNIT_NOT_EXACT", c("unit_multiplier") != 1),
        ("SHARE_CLASS_NOT_SINGLE", F.size("share_classes") != 1),
        ("CHECK_FAILED", ~c("checks_hold")),
        ("EXTRACTION_CONFLICT", c("status") == "CONFLICT"),
        ("VALUE_MISSING", c("issued_shares").isNull()),
    )
    s = ranked.withColumn("reasons", reasons).drop("_k")
    return s.withColumn("decision", F.when(F.size("reasons") == 0, "ACCEPT").when(c("status") == "CONFLICT", "CONFLICT").otherwise("REVIEW"))


def import_counters(sources: dict[str, DataFrame]) -> DataFrame:
    """Distinct points per source and over their union."""
    keyed = [df.select(F.lit(n).alias("source"), "company_id", "field_id").distinct() for n, df in sources.items()]
    union = reduce(DataFrame.unionByName, keyed)
    per = union.groupBy("source").agg(F.count(F.lit(1)).alias("points"))
    whole = union.select("company_id", "field_id").distinct().agg(F.count(F.lit(1)).alias("points"))
    return per.unionByName(whole.select(F.lit("UNION").alias("source"), "points"))


def retain_compatible(old_points: DataFrame, universe: DataFrame) -> DataFrame:
    """Old series kept only where id, quote code and currency still match."""
    return old_points.join(universe.select("security_id", "quote_code", "currency").distinct(), ["security_id", "quote_code", "currency"], "left_semi")


def uncovered(master: DataFrame, archives: DataFrame, pattern: str = r"^\d*[_-]?(.+?)[_-]?(?:年报|年報|annual).*$") -> DataFrame:
    """Companies without an archive; the company name is taken out of the archive name, so the join is an equi join."""
    named = archives.select(X.fold_name(F.regexp_extract("archive_name", pattern, 1)).alias("_n")).where("_n <> ''").distinct()
    return master.withColumn("_n", X.fold_name(c("name"))).join(named, "_n", "left_anti").drop("_n")


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of one id; the filter reaches the parquet scan."""
    return df.where(c(column) == value)


def next_work(jobs: DataFrame, now: Column) -> DataFrame:
    """The waiting job to take next per company, in order: due, no running job of the company, priority, oldest.

    One row per company comes from an aggregate; the caller takes the first.
    """
    running = jobs.where(c("status") == "RUNNING").select("company_id").distinct()
    due = jobs.where(c("status").isin(*OPEN_STATUSES) & (c("retry_at").isNull() | (c("retry_at") <= now)))
    rank = F.lit(len(MODE_PRIORITY))
    for i, mode in reversed(list(enumerate(MODE_PRIORITY))):
        rank = F.when(c("analysis_mode") == mode, i).otherwise(rank)
    free = due.join(running, "company_id", "left_anti").withColumn("priority", rank)
    best = free.groupBy("company_id").agg(F.min(F.struct("priority", "created_at", "job_id")).alias("b"))
    return best.select("company_id", "b.*").orderBy("priority", "created_at", "job_id")


def universe_signature(df: DataFrame) -> DataFrame:
    """Order-independent signature of the listed identities."""
    row = digest(F.concat_ws("|", "security_id", "issuer_id", F.coalesce(c("quote_code"), F.lit(""))), 15)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(row, 16, 10).cast("decimal(38,0)")).alias("signature"))
