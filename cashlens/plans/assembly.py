"""Queries that put records together: work order, scoping, import counters, acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashlens.operators import assembly as A
from cashlens.operators import triggers as T
from cashlens.plans import screening as SC
from cashlens.plans.registry import query
from cashlens.plans.sqlparts import m, with_parts
from cashlens.sources import domain as D

c = F.col


@query(
    "dispatch_order",
    with_parts(
        "screen",
        """SELECT security_id, CASE WHEN len(codes) > 0 THEN 0 WHEN trigger_type = 'DIVIDEND_YIELD_TTM' THEN 1 ELSE 2 END AS dispatch_rank, opportunity_value FROM screen WHERE trigger_type IS NOT NULL""",
    ),
)
def dispatch_order(spark, sf):
    fired = SC.screened(spark, sf).where(c("trigger_type").isNotNull()).withColumn("company_id", c("security_id"))
    return T.dispatch_order(fired).select("security_id", "dispatch_rank", "opportunity_value")


@query(
    "next_work",
    """SELECT o_custkey AS company_id, arg_min(o_orderkey, row(p, o_orderdate, o_orderkey)) AS job_id, CAST(min(p) AS INTEGER) AS priority FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 2 ELSE 4 END AS p FROM orders)
WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2001-06-01') GROUP BY 1""",
)
def next_work(spark, sf):
    o = D.table(spark, sf, "orders")
    recent = c("o_orderdate") >= F.lit("2001-06-01").cast("timestamp_ntz")
    jobs = o.select(
        c("o_custkey").alias("company_id"),
        c("o_orderkey").alias("job_id"),
        c("o_orderdate").alias("created_at"),
        F.when(c("o_orderstatus") == "O", "QUEUED").when((c("o_orderstatus") == "P") & recent, "RUNNING").otherwise("SUCCESS").alias("status"),
        F.when(c("o_orderpriority") == "1-URGENT", "URGENT_RISK_REVIEW").when(c("o_orderpriority") == "2-HIGH", "FULL_ENTRY_REVIEW").otherwise("PRICE_RISK_ANALYSIS").alias("analysis_mode"),
        F.lit(None).cast("timestamp_ntz").alias("retry_at"),
    )
    return A.next_work(jobs, F.lit("2001-12-31").cast("timestamp_ntz")).select("company_id", "job_id", "priority")


@query(
    "import_counters",
    """WITH p AS (SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'official' WHEN 'O' THEN 'provider' ELSE 'filing' END AS source, o_custkey, year(o_orderdate) AS y, o_orderpriority FROM orders)
SELECT source, count(*) AS points FROM p GROUP BY 1 UNION ALL SELECT 'UNION', count(*) FROM (SELECT DISTINCT o_custkey, y, o_orderpriority FROM p)""",
)
def import_counters(spark, sf):
    p = D.raw_points(spark, sf)
    by = {"official": "Official annual report", "provider": "Provider feed", "filing": "Exchange filing"}
    return A.import_counters({k: p.where(c("source_name") == v) for k, v in by.items()})


@query(
    "compatible_series",
    """SELECT l_suppkey AS security_id, count(*) AS points FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1""",
)
def compatible_series(spark, sf):
    points = D.table(spark, sf, "lineitem").select(c("l_suppkey").alias("security_id"))
    # Counted before the match: the join sees one row per security.
    counted = points.groupBy("security_id").agg(F.count(F.lit(1)).alias("points"))
    old = counted.withColumns({"quote_code": c("security_id").cast("string"), "currency": F.lit("CNY")})
    universe = D.table(spark, sf, "supplier").where(c("s_acctbal") > 0).select(
        c("s_suppkey").alias("security_id"), c("s_suppkey").cast("string").alias("quote_code"), F.lit("CNY").alias("currency")
    )
    return A.retain_compatible(old, universe).select("security_id", "points")


@query(
    "share_capital_acceptance",
    f"""SELECT company_id, fiscal_year, CASE WHEN conflict THEN 'CONFLICT' WHEN big OR multi OR NOT chk THEN 'REVIEW' ELSE 'ACCEPT' END AS decision, concat_ws(',', CASE WHEN big THEN 'UNIT_NOT_EXACT' END, CASE WHEN multi THEN 'SHARE_CLASS_NOT_SINGLE' END, CASE WHEN NOT chk THEN 'CHECK_FAILED' END, CASE WHEN conflict THEN 'EXTRACTION_CONFLICT' END) AS reasons
FROM (SELECT o_custkey AS company_id, year(o_orderdate) AS fiscal_year, max({m('o_totalprice')}) > 450000 AS big, count(DISTINCT o_orderstatus) > 1 AS multi, bool_and(o_orderpriority <> '5-LOW') AS chk, count(*) > 3 AS conflict FROM orders GROUP BY 1, 2)
QUALIFY dense_rank() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC) <= 5""",
)
def share_capital_acceptance(spark, sf):
    o = D.table(spark, sf, "orders")
    rows = o.groupBy(c("o_custkey").alias("company_id"), F.year("o_orderdate").alias("fiscal_year")).agg(
        F.max(D.money("o_totalprice")).alias("issued_shares"),
        F.collect_set("o_orderstatus").alias("share_classes"),
        F.min(c("o_orderpriority") != "5-LOW").alias("checks_hold"),
        F.count(F.lit(1)).alias("n"),
    )
    rows = rows.withColumns(
        {
            "unit_multiplier": F.when(c("issued_shares") > 450_000, 1000).otherwise(1),
            "status": F.when(c("n") > 3, "CONFLICT").otherwise("REVIEW"),
        }
    )
    return A.share_capital_acceptance(rows).select("company_id", "fiscal_year", "decision", F.array_join("reasons", ",").alias("reasons"))


@query(
    "research_bundle",
    """SELECT 'EVENT' AS kind, count(*) AS n, count(DISTINCT user_id) AS companies FROM events
UNION ALL SELECT 'DISCLOSURE', count(*), count(DISTINCT k) FROM (SELECT DISTINCT o_custkey AS k, o_orderstatus FROM orders)
UNION ALL SELECT 'FACT', count(*), count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus <> 'P'""",
)
def research_bundle(spark, sf):
    points = D.raw_points(spark, sf)
    ev = D.event_observations(spark, sf).select(c("issuer_id").alias("company_id"), "event_key", "payload")
    docs = points.select("company_id", c("source_document").alias("source_url"), "source_document")
    bundle = A.research_bundle(ev, docs, points)
    return bundle.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("company_id").alias("companies"))
