"""Writers: documents, CSV reports, gated history, validated releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashlens.functions.hashing import digest, stable_json
from cashlens.operators.events import buyback_totals, changed_snapshots, newest_rows
from cashlens.operators.quality import release_issues, release_verdict

c = F.col

PUBLIC_COLUMNS = (
    "company_id", "company_name", "status", "price", "price_timestamp", "opportunity_value", "opportunity_coverage",
    "opportunity_status", "resilience_value", "resilience_coverage", "resilience_status", "trigger_type",
    "trigger_eligible", "warnings", "fatal_errors",
)


def write_json(df: DataFrame, path: str) -> None:
    """Whole replacement under Spark's commit protocol: readers see the old or the new files."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    flat = [F.to_json(c(n)).alias(n) if t.startswith(("array", "struct", "map")) else c(n) for n, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def append_changed(batch: DataFrame, history_path: str, latest_path: str) -> None:
    """Always replace the latest table; append to the history only rows whose content changed."""
    spark = batch.sparkSession
    try:
        history = spark.read.parquet(history_path)
        fresh = changed_snapshots(history, batch)
    except Exception as error:  # noqa: BLE001 - only a missing table may start an empty history
        if "PATH_NOT_FOUND" not in str(error):
            raise
        fresh = batch
    fresh.write.mode("append").parquet(history_path)
    batch.write.mode("overwrite").parquet(latest_path)


def release_id(records: DataFrame) -> DataFrame:
    """One row: content id of a release, independent of row order.

    Row hashes are added up, so neither a sort nor a gathered list is needed.
    """
    row = digest(stable_json(*records.columns), 15)
    total = F.sum(F.conv(row, 16, 10).cast("decimal(38,0)"))
    return records.agg(digest(F.concat_ws("|", total.cast("string"), F.count(F.lit(1)).cast("string")), 24).alias("release_id"))


def write_release(records: DataFrame, root: str, expected: int | None = None) -> str | None:
    """Write the records under a content id, check what was written, and only then point to it.

    Returns the id, or None when the written release violates the contract; the pointer then stays.
    """
    spark = records.sparkSession
    rid = release_id(records).first()["release_id"]
    target = f"{root}/records/release_id={rid}"
    records.write.mode("overwrite").parquet(target)
    checked = release_issues(spark.read.parquet(target))
    verdict = release_verdict(checked, expected).first()
    if verdict["validity"] != "VALID_RELEASE":
        return None
    public = [x for x in PUBLIC_COLUMNS if x in records.columns]
    spark.read.parquet(target).select(*public).write.mode("overwrite").parquet(f"{root}/index/release_id={rid}")
    spark.range(1).select(F.lit(rid).alias("release_id"), F.current_timestamp().alias("activated_at"), F.lit(verdict["records"]).alias("records")).write.mode(
        "append"
    ).parquet(f"{root}/current_release")
    return rid


def current_release(spark: SparkSession, root: str) -> DataFrame:
    """Records of the newest activated release."""
    rid = spark.read.parquet(f"{root}/current_release").orderBy(F.desc("activated_at")).first()["release_id"]
    return spark.read.parquet(f"{root}/records/release_id={rid}")


def retained_releases(pointers: DataFrame, keep: int = 5) -> DataFrame:
    """Release ids to keep: the newest ones and the current one; everything else may be pruned."""
    newest = pointers.groupBy("release_id").agg(F.max("activated_at").alias("activated_at"))
    return newest.orderBy(F.desc("activated_at"), "release_id").limit(keep)


def analysis_statuses(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Latest job and latest success per company; a report that is not the latest success is pending.

    Both come from aggregates, so a company with very many jobs is not sorted.
    """
    order = F.struct("created_at", "job_id")
    latest = jobs.groupBy("company_id").agg(
        F.max_by("status", order).alias("latest_status"),
        F.max_by("job_id", order).alias("latest_job_id"),
        F.max_by(F.when(c("status") == "SUCCESS", c("job_id")), F.when(c("status") == "SUCCESS", order)).alias("success_job_id"),
        F.max(F.when(c("status") == "SUCCESS", c("created_at"))).alias("latest_success_at"),
    )
    j = latest.join(reports.select("company_id", c("job_id").alias("report_job_id")), "company_id", "full_outer")
    return j.withColumn(
        "public_status",
        F.when(c("latest_status").isNull(), "REPORT_WITHOUT_JOB")
        .when((c("latest_status") == "SUCCESS") & ~c("report_job_id").eqNullSafe(c("latest_job_id")), "REPORT_PENDING")
        .otherwise(c("latest_status")),
    )


def write_analysis_release(analyses: DataFrame, statuses: DataFrame, root: str) -> None:
    """Public analysis columns only; the private candidate column never leaves."""
    public = analyses.drop("reviewed_overlay_candidates")
    public.join(statuses, "company_id", "left").write.mode("overwrite").parquet(f"{root}/analyses")


def combined_status(queue: DataFrame, index: DataFrame, success: DataFrame) -> DataFrame:
    """Queue status first, index status as fallback, the latest success beside it."""
    j = index.select("company_id", c("status").alias("_i")).join(queue.select("company_id", c("status").alias("_q")), "company_id", "left")
    return j.join(success.select("company_id", "latest_success_at"), "company_id", "left").select(
        "company_id", F.coalesce("_q", "_i", F.lit("NOT_REQUESTED")).alias("status"), "latest_success_at"
    )


def history_tables(events: DataFrame) -> dict[str, DataFrame]:
    """Per-company history: dividends, yearly buyback totals, newest 12 statement periods, newest 50 news.

    ``events``: issuer_id, event_type, event_key, event_date, payload map<string,string>.
    """
    of = lambda t: events.where(c("event_type") == t)
    p = c("payload")
    order = [F.desc("event_date"), F.desc("event_key")]
    buy = of("buyback").select(
        "issuer_id",
        "event_date",
        p["buy_back_money"].alias("buy_back_money"),
        p["buy_back_sum"].alias("buy_back_sum"),
        F.coalesce(p["event_proce_desc"], p["share_type"]).alias("process"),
    )
    return {
        "dividends": of("dividend").select(
            "issuer_id", "event_date", *[p[x].alias(x) for x in ("statement", "process", "record_date", "ex_date", "dividend_payable_date")]
        ),
        "buyback_totals": buyback_totals(buy),
        "statements": newest_rows(of("financial"), ["issuer_id"], order, 12),
        "news": newest_rows(of("news"), ["issuer_id"], order, 50),
    }


def write_history(events: DataFrame, root: str) -> None:
    for name, df in history_tables(events).items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
