"""Queries over industry rotation, dated scores, names in archives and public forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashlens.functions import redaction
from cashlens.functions.numeric import half_up
from cashlens.operators import containment, rotation, validity
from cashlens.plans.registry import query
from cashlens.plans.sqlparts import d, m, rnd
from cashlens.sources import domain as D

c = F.col


def daily_flows(spark, sf):
    """Turnover and signed flow per industry (the supplier's nation) and day; returned lines flow out."""
    amount = D.money("l_extendedprice")
    lines = D.lines(spark, sf, "l_suppkey", "l_shipdate", "l_returnflag", "l_extendedprice")
    per = lines.groupBy("l_suppkey", c("l_shipdate").cast("date").alias("day")).agg(
        F.sum(amount).alias("turnover"), F.sum(F.when(c("l_returnflag") == "R", -amount).otherwise(amount)).alias("flow")
    )
    s = D.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    joined = per.join(s, c("l_suppkey") == c("s_suppkey"))
    return joined.groupBy(c("s_nationkey").alias("industry"), "day").agg(F.sum("turnover").alias("turnover"), F.sum("flow").alias("flow"))


DAILY = f"""daily AS (SELECT s_nationkey AS industry, CAST(l_shipdate AS DATE) AS day, sum({m('l_extendedprice')}) AS turnover,
  sum(CASE WHEN l_returnflag = 'R' THEN -{m('l_extendedprice')} ELSE {m('l_extendedprice')} END) AS flow
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def flow_sql() -> str:
    parts = []
    for n in rotation.WIDTHS:
        w = f"OVER (PARTITION BY industry ORDER BY day RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND CURRENT ROW)"
        parts.append(f"{d(f'sum(turnover) {w}')} AS turnover_{n}, {d(f'sum(flow) {w}')} AS flow_{n}, {rnd(f'{d(f'sum(flow) {w}')} / {d(f'sum(turnover) {w}')}', 6)} AS ratio_{n}")
    return f"WITH {DAILY} SELECT industry, strftime(day, '%Y-%m-%d') AS day, {', '.join(parts)} FROM daily"


@query("industry_flow_windows", flow_sql())
def industry_flow_windows(spark, sf):
    sums = rotation.window_sums(daily_flows(spark, sf), ["industry"], "day", ["turnover", "flow"])
    out = [c("industry"), c("day").cast("string").alias("day")]
    for n in rotation.WIDTHS:
        turnover, flow = c(f"turnover_{n}").cast("double"), c(f"flow_{n}").cast("double")
        out += [turnover.alias(f"turnover_{n}"), flow.alias(f"flow_{n}"), half_up(flow / turnover, 6).alias(f"ratio_{n}")]
    return sums.select(*out)


@query(
    "covering_members",
    f"""
WITH t AS (SELECT p_type AS industry, date_trunc('month', l_shipdate) AS month, l_partkey AS member, sum({m('l_extendedprice')}) AS turnover
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER w AS rank, sum(turnover) OVER w AS running, sum(turnover) OVER (PARTITION BY industry, month) AS total
  FROM t WINDOW w AS (PARTITION BY industry, month ORDER BY turnover DESC, member ROWS UNBOUNDED PRECEDING))
SELECT industry, strftime(month, '%Y-%m') AS month, member, CAST(rank AS INTEGER) AS rank, {d('running')} AS running FROM r
WHERE rank <= 20 AND (rank <= 5 OR running - turnover < 0.8 * total)""",
)
def covering_members(spark, sf):
    lines = D.lines(spark, sf, "l_partkey", "l_shipdate", "l_extendedprice")
    per = lines.groupBy("l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.sum(D.money("l_extendedprice")).alias("turnover"))
    p = D.table(spark, sf, "part").select("p_partkey", c("p_type").alias("industry"))
    totals = per.join(p, c("l_partkey") == c("p_partkey")).select("industry", "month", c("l_partkey").alias("member"), "turnover")
    kept = rotation.covering_members(totals, ["industry", "month"], "member", "turnover")
    return kept.select("industry", "month", "member", "rank", c("running").cast("double").alias("running"))


LAST_WEEK = "1998-06-29"


def grid_sql() -> str:
    last = f"DATE '{LAST_WEEK}'"
    back = f"(datediff('day', week, {last}) // 7)"
    cells = ", ".join(f"{d(f'sum(flow) FILTER (WHERE pos = {n})')} AS w{n:02d}" for n in range(1, 13))
    total, before = "sum(flow) FILTER (WHERE pos >= 1)", "sum(flow) FILTER (WHERE pos < 1)"
    return f"""WITH {DAILY}, weekly AS (SELECT industry, CAST(date_trunc('week', day) AS DATE) AS week, sum(flow) AS flow FROM daily GROUP BY 1, 2),
k AS (SELECT industry, flow, 12 - {back} AS pos FROM weekly WHERE {back} BETWEEN 0 AND 23 AND week <= {last})
SELECT industry, {cells}, {d(total)} AS total, {d(before)} AS before, CASE WHEN {before} <> 0 THEN {rnd(f'{d(total)} / {d(before)} - 1', 6)} END AS change FROM k GROUP BY 1"""


@query("heat_grid", grid_sql())
def heat_grid(spark, sf):
    weekly = daily_flows(spark, sf).groupBy("industry", F.date_trunc("week", "day").cast("date").alias("week")).agg(F.sum("flow").alias("flow"))
    grid = rotation.heat_grid(weekly, ["industry"], "week", "flow", F.lit(LAST_WEEK).cast("date"))
    sums = [x for x in grid.columns if x.startswith("w")] + ["total", "before"]
    return grid.select("industry", *[c(x).cast("double").alias(x) for x in sums], half_up(c("change"), 6).alias("change"))


# ---------------------------------------------------------------- values that hold on a date


@query(
    "score_at_date",
    f"""
WITH i AS (SELECT p_partkey % 400 AS company_id, CASE WHEN p_partkey % 2 = 1 THEN 'MANUAL' ELSE 'REVIEWED' END AS kind,
    DATE '1995-01-01' + CAST(p_partkey * 37 % 2400 AS INTEGER) AS lo, p_size * 13 % 450 AS days, {m('p_retailprice')} % 120 AS value FROM part WHERE p_size <> 1),
v AS (SELECT *, lo + CAST(days AS INTEGER) AS hi FROM i WHERE days <= 365 AND value <= 100)
SELECT o_orderkey, {d('value')} AS score, kind AS score_kind FROM orders LEFT JOIN v ON company_id = o_custkey AND CAST(o_orderdate AS DATE) BETWEEN lo AND hi
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY kind, lo DESC, hi DESC, value DESC) = 1""",
)
def score_at_date(spark, sf):
    lo = F.date_add(F.lit("1995-01-01").cast("date"), (c("p_partkey") * 37 % 2400).cast("int"))
    intervals = D.table(spark, sf, "part").select(
        (c("p_partkey") % 400).alias("company_id"),
        F.when(c("p_partkey") % 2 == 1, validity.MANUAL).otherwise(validity.REVIEWED).alias("kind"),
        lo.alias("as_of_date"),
        F.date_add(lo, c("p_size") * 13 % 450).alias("expires_at"),
        (D.money("p_retailprice") % 120).alias("value"),
        F.when(c("p_size") != 1, "review").otherwise("").alias("source"),
        c("p_name").alias("reason"),
    )
    rows = D.table(spark, sf, "orders").select("o_orderkey", c("o_custkey").alias("company_id"), "o_orderdate")
    dated = validity.value_at(rows, validity.valid_intervals(intervals), "o_orderkey", ["company_id"], "o_orderdate")
    return dated.select("o_orderkey", c("score").cast("double").alias("score"), "score_kind")


# ---------------------------------------------------------------- names in archives


@query(
    "names_without_archive",
    """
WITH k AS (SELECT c_custkey AS id, c_name || CASE WHEN c_custkey % 10 = 0 THEN '-S' WHEN c_custkey % 10 = 1 THEN '-W' ELSE '' END AS name FROM customer),
a AS (SELECT DISTINCT year(o_orderdate) || '_Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '_年报' AS archive FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000)
SELECT id, name FROM k WHERE NOT EXISTS (SELECT 1 FROM a WHERE strpos(archive, replace(replace(name, '-S', ''), '-W', '')) > 0)""",
)
def names_without_archive(spark, sf):
    key = c("c_custkey") % 10
    master = D.table(spark, sf, "customer").select(
        c("c_custkey").alias("id"), F.concat("c_name", F.when(key == 0, "-S").when(key == 1, "-W").otherwise("")).alias("name")
    )
    filed = D.table(spark, sf, "orders").where((c("o_orderstatus") == "P") & (c("o_totalprice") > 300_000))
    archives = filed.select(
        F.concat(F.year("o_orderdate").cast("string"), F.lit("_Customer#"), F.lpad(c("o_custkey").cast("string"), 9, "0"), F.lit("_年报")).alias("archive_name")
    )
    return containment.without_cover(master, archives).select("id", "name")


# ---------------------------------------------------------------- public forms


@query(
    "public_props",
    f"""
SELECT event_id, '{{"deep":{{"a":{{"b":{{"c":{{"d":{{"e":"{redaction.TOO_DEEP}"}}}}}}}}}},"items":[{{"id":' || event_id || ',"note":"' || event_type || '"}},{{"id":0,"note":"{redaction.LOCAL_PATH}"}}],"log":"'
  || CASE WHEN event_type = 'error' THEN '{redaction.LOCAL_PATH}' ELSE 'at ' || event_type END || '","props":' || replace(props, ' ', '') || '}}' AS public FROM events""",
)
def public_props(spark, sf):
    """The events' props inside a nested document with credentials, paths and too many levels."""
    e = D.table(spark, sf, "events")
    path = F.when(c("event_type") == "error", F.concat(F.lit("~/logs/"), "event_type")).otherwise(F.concat(F.lit("at "), "event_type"))
    deep = F.lit('"deep":{"a":{"b":{"c":{"d":{"e":{"f":1}}}}}}')
    items = F.concat(F.lit('"items":[{"id":'), c("event_id").cast("string"), F.lit(',"note":"'), "event_type", F.lit('","client_secret":"s"},{"id":0,"note":"in /home/x"}]'))
    text = F.concat(
        F.lit('{"api_token":{"k":1},"log":"'), path, F.lit('",'), deep, F.lit(","), items, F.lit(',"props":'), "props", F.lit(',"Credential":"c"}')
    )
    return redaction.redacted_json(e.select("event_id", text.alias("document")), "document", "public").select("event_id", "public")
