"""Queries over event observations, snapshots and triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashlens.functions.hashing import digest
from cashlens.operators import events as E
from cashlens.operators import triggers as T
from cashlens.plans.registry import query
from cashlens.plans.sqlparts import d, m, part, rnd, with_parts
from cashlens.sources import domain as D
from cashlens.streaming.change_capture import revision_stream, run_available, scratch_table

c = F.col
STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(x):
    return F.date_format(x, STAMP)


def sql_stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


@query(
    "event_change_log",
    with_parts(
        "event_observation",
        """SELECT batch_seq, event_type, CASE WHEN before IS NULL THEN 'new' WHEN before <> payload_hash THEN 'changed' ELSE 'unchanged' END AS change_kind
FROM (SELECT *, lag(payload_hash) OVER (PARTITION BY event_key ORDER BY observed_at, batch_seq) AS before FROM event_observation)""",
    ),
)
def event_change_log(spark, sf):
    return E.change_log(D.event_observations(spark, sf)).select("batch_seq", "event_type", "change_kind")


part(
    "revision",
    """SELECT event_key, payload_hash, min(observed_at) AS observed_at, arg_min(batch_seq, row(observed_at, batch_seq)) AS revision_id,
  min(row(observed_at, batch_seq)) = any_value(origin) AS is_new
FROM (SELECT *, min(row(observed_at, batch_seq)) OVER (PARTITION BY event_key) AS origin FROM event_observation) GROUP BY 1, 2""",
    "event_observation",
)


@query(
    "event_revisions",
    with_parts(
        "revision",
        "SELECT event_key, payload_hash, CASE WHEN is_new THEN 'new' ELSE 'changed' END AS change_kind, revision_id FROM revision",
    ),
)
def event_revisions(spark, sf):
    return E.revisions(D.event_observations(spark, sf)).select("event_key", "payload_hash", "change_kind", "revision_id")


@query(
    "event_current_state",
    with_parts(
        "event_observation",
        f"""SELECT event_key, arg_max(payload_hash, row(observed_at, batch_seq)) AS payload_hash, {sql_stamp('min(observed_at)')} AS first_seen_at,
  {sql_stamp('max(observed_at)')} AS last_seen_at, count(*) AS observations FROM event_observation GROUP BY 1""",
    ),
)
def event_current_state(spark, sf):
    s = E.current_state(D.event_observations(spark, sf))
    return s.withColumns({x: stamp(c(x)) for x in ("first_seen_at", "last_seen_at")})


@query(
    "unsynced_revisions",
    with_parts(
        "revision",
        "SELECT event_key, revision_id FROM revision WHERE revision_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase' OR value > 100)",
    ),
)
def unsynced_revisions(spark, sf):
    acks = D.table(spark, sf, "events").where((c("event_type") == "purchase") | (c("value") > 100)).select(
        c("event_id").alias("revision_id")
    )
    return E.unsynced(E.revisions(D.event_observations(spark, sf)), acks).select("event_key", "revision_id")


@query(
    "last_in_batch",
    with_parts(
        "event_observation",
        "SELECT event_key, batch_seq, payload FROM event_observation QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY batch_seq DESC) = 1",
    ),
)
def last_in_batch(spark, sf):
    rows = D.event_observations(spark, sf).select("event_key", "batch_seq", "payload")
    return E.last_in_batch(rows).select("event_key", "batch_seq", "payload")


@query(
    "event_year_totals",
    f"""SELECT o_custkey AS issuer_id, strftime(o_orderdate, '%Y') AS year, count(*) AS records, {d(f"sum({m('o_totalprice')})")} AS money,
  CAST(sum(o_orderkey) AS BIGINT) AS shares, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '；') AS processes FROM orders GROUP BY 1, 2""",
)
def event_year_totals(spark, sf):
    rows = D.table(spark, sf, "orders").select(
        c("o_custkey").alias("issuer_id"),
        c("o_orderdate").cast("string").alias("event_date"),
        c("o_totalprice").alias("buy_back_money"),
        c("o_orderkey").alias("buy_back_sum"),
        c("o_orderpriority").alias("process"),
    )
    return E.buyback_totals(rows).withColumn("money", c("money").cast("double"))


@query(
    "newest_news",
    "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 12",
)
def newest_news(spark, sf):
    rows = D.table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return E.newest_rows(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 12).select("user_id", "event_id", "event_type")


@query(
    "master_upsert",
    """SELECT coalesce(s_suppkey, c_custkey) AS id, CASE WHEN s_suppkey IS NOT NULL THEN s_nationkey ELSE c_nationkey END AS nation,
  CASE WHEN s_suppkey IS NULL THEN 'unexpected' WHEN c_custkey IS NULL THEN 'inserted' WHEN s_nationkey = c_nationkey THEN 'unchanged' ELSE 'updated' END AS merge_action
FROM supplier FULL JOIN customer ON s_suppkey = c_custkey""",
)
def master_upsert(spark, sf):
    existing = D.table(spark, sf, "customer").select(c("c_custkey").alias("id"), c("c_nationkey").alias("nation"))
    incoming = D.table(spark, sf, "supplier").select(c("s_suppkey").alias("id"), c("s_nationkey").alias("nation"))
    return E.upsert_master(existing, incoming, "id")


@query(
    "selection_supersede",
    """SELECT o_custkey AS company_id, year(o_orderdate) AS fiscal_year, o_orderkey AS document_id,
  CASE WHEN k = 1 THEN 'CURRENT' ELSE 'SUPERSEDED' END AS selection_status, CASE WHEN k > 1 THEN top END AS superseded_by
FROM (SELECT *, row_number() OVER w AS k, first_value(o_orderkey) OVER w AS top FROM orders
  WINDOW w AS (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC))""",
)
def selection_supersede(spark, sf):
    rows = D.table(spark, sf, "orders").select(
        c("o_custkey").alias("company_id"),
        F.year("o_orderdate").alias("fiscal_year"),
        c("o_orderkey").alias("document_id"),
        c("o_orderdate").alias("selected_at"),
    )
    return E.supersede(rows).select("company_id", "fiscal_year", "document_id", "selection_status", "superseded_by")


@query(
    "work_queue",
    """WITH u AS (SELECT user_id AS company_id, event_type AS analysis_mode, sha256(props) AS snapshot_hash, min(ts) AS created_at FROM events GROUP BY 1, 2, 3)
SELECT company_id, analysis_mode, snapshot_hash,
  CASE WHEN row_number() OVER (PARTITION BY company_id, analysis_mode ORDER BY created_at DESC, snapshot_hash DESC) = 1 THEN 'QUEUED' ELSE 'SUPERSEDED' END AS queue_status FROM u""",
)
def work_queue(spark, sf):
    rows = D.table(spark, sf, "events").select(
        c("user_id").alias("company_id"),
        c("event_type").alias("analysis_mode"),
        digest(c("props")).alias("snapshot_hash"),
        c("ts").alias("created_at"),
    )
    return E.enqueue(rows, ("company_id", "analysis_mode", "snapshot_hash")).select(
        "company_id", "analysis_mode", "snapshot_hash", "queue_status"
    )


@query(
    "work_queue_counts",
    "SELECT event_type AS status, count(*) AS n, count(DISTINCT user_id) AS companies FROM events GROUP BY 1",
)
def work_queue_counts(spark, sf):
    return (
        D.table(spark, sf, "events")
        .groupBy(c("event_type").alias("status"))
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("companies"))
    )


@query(
    "slow_reuse",
    f"""SELECT o_custkey AS company_id FROM orders GROUP BY 1
HAVING sum({m('o_totalprice')}) <> coalesce(sum({m('o_totalprice')}) FILTER (WHERE o_orderdate < TIMESTAMP '2001-03-01'), 0)""",
)
def slow_reuse(spark, sf):
    o = D.table(spark, sf, "orders").select("o_custkey", "o_orderdate", D.money("o_totalprice").alias("amount"))
    g = o.groupBy(c("o_custkey").alias("company_id")).agg(
        F.sum("amount").alias("now"),
        F.sum(F.when(c("o_orderdate") < F.lit("2001-03-01").cast("timestamp_ntz"), c("amount"))).alias("then"),
    )
    hashed = lambda x: digest(F.concat_ws("|", c("company_id").cast("string"), c(x).cast("string")))
    inputs = g.select("company_id", hashed("now").alias("input_hash"))
    cached = g.where(c("then").isNotNull()).select("company_id", hashed("then").alias("input_hash"))
    return E.rows_to_recompute(inputs, cached).select("company_id")


part(
    "run",
    f"""SELECT user_id AS company_id, date_trunc('hour', ts) AS run_at, CAST(date_trunc('hour', ts) AS DATE) AS trade_date,
  {rnd(f"{d(f'''sum({m('value')})''')} / count(value) / 1250", 6)} AS ssy, {rnd(f"{d(f'''max({m('value')})''')} / 1250", 6)} AS raw_yield,
  {d(f"sum({m('value')})")} AS h, {d(f"min({m('value')})")} AS eri, {rnd(f"{d(f'''sum({m('value')})''')} / count(value) / 50", 6)} AS coverage,
  list_sort(list_distinct(list(event_type))) AS kinds
FROM events GROUP BY 1, 2""",
)
part(
    "zone",
    """SELECT company_id, run_at, trade_date, ssy, raw_yield, since IS NOT NULL AND days < 5 AS in_zone, CASE WHEN since IS NOT NULL AND days < 5 THEN days ELSE 0 END AS below_exit_days
FROM (SELECT *, sum(CASE WHEN low AND k = 1 AND since IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY company_id, since ORDER BY run_at) AS days
  FROM (SELECT *, sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY company_id, since, trade_date ORDER BY run_at) AS k
    FROM (SELECT *, ssy < 0.035 AND raw_yield < 0.035 AS low, max(CASE WHEN ssy >= 0.04 OR raw_yield >= 0.04 THEN run_at END) OVER (PARTITION BY company_id ORDER BY run_at) AS since FROM run)))""",
    "run",
)


@query(
    "zone_hysteresis",
    with_parts(
        "zone",
        f"SELECT company_id, {sql_stamp('run_at')} AS run_at, in_zone, CAST(below_exit_days AS INTEGER) AS below_exit_days FROM zone",
    ),
)
def zone_hysteresis(spark, sf):
    z = T.observation_zone(D.company_runs(spark, sf))
    return z.select("company_id", stamp(c("run_at")).alias("run_at"), "in_zone", "below_exit_days")


@query(
    "price_cooldown",
    "WITH RECURSIVE "
    + with_parts("run", "")[len("WITH ") :].rstrip()
    + f""",
hit AS (SELECT company_id, run_at FROM run WHERE ssy >= 0.04),
fire AS (SELECT company_id, min(run_at) AS t FROM hit GROUP BY 1
  UNION ALL SELECT f.company_id, (SELECT min(h.run_at) FROM hit h WHERE h.company_id = f.company_id AND h.run_at >= f.t + INTERVAL 7 DAY) AS t
  FROM fire f WHERE f.t IS NOT NULL)
SELECT company_id, {sql_stamp('t')} AS fired_at FROM fire WHERE t IS NOT NULL""",
)
def price_cooldown(spark, sf):
    hits = D.company_runs(spark, sf).where(c("ssy") >= 0.04).select("company_id", "run_at")
    return T.cooldown_fires(hits, 7).withColumn("fired_at", stamp(c("fired_at")))


@query(
    "material_changes",
    with_parts(
        "run",
        f"""SELECT company_id, {sql_stamp('run_at')} AS run_at, concat_ws(',', CASE WHEN abs(ssy - ps) >= 0.005 THEN 'SSY_ABSOLUTE' END,
  CASE WHEN abs(ssy - ps) / abs(nullif(ps, 0)) >= 0.15 THEN 'SSY_RELATIVE' END, CASE WHEN abs(h - ph) / abs(nullif(ph, 0)) >= 0.15 THEN 'H_RELATIVE' END,
  CASE WHEN abs(eri - pe) >= 10 THEN 'ERI_POINTS' END, CASE WHEN (coverage >= 1 AND pc < 1) OR (pc >= 1 AND coverage < 1) THEN 'COVERAGE_CROSSED_ONE' END,
  CASE WHEN abs(coverage - pc) >= 0.25 THEN 'COVERAGE_ABSOLUTE' END) AS reasons
FROM (SELECT *, lag(ssy) OVER w AS ps, lag(h) OVER w AS ph, lag(eri) OVER w AS pe, lag(coverage) OVER w AS pc FROM run WINDOW w AS (PARTITION BY company_id ORDER BY run_at))""",
    ),
)
def material_changes(spark, sf):
    mc = T.material_changes(D.company_runs(spark, sf))
    return mc.select("company_id", stamp(c("run_at")).alias("run_at"), F.array_join("material_reasons", ",").alias("reasons"))


KIND_CODE = {
    "error": "AUDIT_GOVERNANCE_ALERT",
    "signup": "MAJOR_REGULATORY_PENALTY",
    "purchase": "KEY_SOURCE_VALIDATION_FAILED",
}


@query(
    "newly_raised_flags",
    with_parts(
        "run",
        f"""SELECT company_id, {sql_stamp('run_at')} AS run_at, array_to_string(list_sort(list_filter(cur, lambda x: NOT list_contains(coalesce(prev, []), x))), ',') AS urgent_codes
FROM (SELECT *, lag(cur) OVER (PARTITION BY company_id ORDER BY run_at) AS prev FROM (SELECT *,
  list_filter(list_transform(kinds, lambda k: CASE k WHEN 'error' THEN 'AUDIT_GOVERNANCE_ALERT' WHEN 'signup' THEN 'MAJOR_REGULATORY_PENALTY' WHEN 'purchase' THEN 'KEY_SOURCE_VALIDATION_FAILED' END), lambda x: x IS NOT NULL) AS cur FROM run))""",
    ),
)
def newly_raised_flags(spark, sf):
    def code(k):
        out = F.lit(None).cast("string")
        for kind, name in KIND_CODE.items():
            out = F.when(k == kind, name).otherwise(out)
        return out

    runs = D.company_runs(spark, sf).withColumn("veto_codes", F.array_compact(F.transform("kinds", code)))
    return T.newly_raised(runs).select(
        "company_id", stamp(c("run_at")).alias("run_at"), F.array_join("urgent_codes", ",").alias("urgent_codes")
    )


@query(
    "refresh_due",
    with_parts(
        "zone",
        f"""SELECT company_id, in_zone, days AS refresh_days, coalesce(in_zone AND TIMESTAMP '2024-03-15 00:00:00' >= last_success + to_days(days), false) AS refresh_due
FROM (SELECT z.company_id, z.in_zone, CASE WHEN r.eri > 45 OR len(list_filter(r.kinds, lambda k: k = 'error')) > 0 THEN 30 ELSE 90 END AS days, s.last_success
  FROM zone z JOIN run r USING (company_id, run_at) LEFT JOIN (SELECT user_id AS company_id, max(ts) AS last_success FROM events WHERE event_type = 'purchase' GROUP BY 1) s USING (company_id)
  QUALIFY row_number() OVER (PARTITION BY z.company_id ORDER BY z.run_at DESC) = 1)""",
    ),
)
def refresh_due(spark, sf):
    zone = T.observation_zone(D.company_runs(spark, sf))
    newest = zone.groupBy("company_id").agg(
        F.max_by("in_zone", "run_at").alias("in_zone"),
        F.max_by("eri", "run_at").alias("eri"),
        F.max_by("kinds", "run_at").alias("kinds"),
    )
    success = (
        D.table(spark, sf, "events")
        .where(c("event_type") == "purchase")
        .groupBy(c("user_id").alias("company_id"))
        .agg(F.max("ts").alias("last_success_at"))
    )
    rows = newest.join(success, "company_id", "left").withColumn("veto_codes", F.filter("kinds", lambda k: k == "error"))
    now = F.lit("2024-03-15 00:00:00").cast("timestamp_ntz")
    return T.refresh_due(rows, now).select("company_id", "in_zone", "refresh_days", "refresh_due")


def event_files(spark, sf):
    """The events table as a file stream."""
    schema = D.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query(
    "stream_event_revisions",
    with_parts(
        "event_observation",
        "SELECT event_type, count(DISTINCT event_key || payload_hash) AS revisions, count(DISTINCT event_key) AS keys FROM event_observation GROUP BY 1",
    ),
)
def stream_event_revisions(spark, sf):
    e = event_files(spark, sf)
    obs = e.select(
        F.sha2(F.concat_ws("|", c("user_id").cast("string"), "event_type"), 256).alias("event_key"),
        "event_type",
        F.sha2("props", 256).alias("payload_hash"),
        c("ts").cast("timestamp").alias("observed_at"),
    )
    target = scratch_table(spark, "revisions")
    run_available(revision_stream(obs), target)
    log = spark.read.parquet(f"{target}/data")
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("revisions"), F.countDistinct("event_key").alias("keys"))
