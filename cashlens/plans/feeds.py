"""Queries over streams, injected sources and publications."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashlens.plans import events as E
from cashlens.plans import ledger  # noqa: F401 - its SQL parts
from cashlens.plans.registry import SQL, query
from cashlens.plans.sqlparts import d, m, with_parts
from cashlens.sources import domain as D
from cashlens.sources import injected, publish
from cashlens.streaming import feed, refresh_stream, restatement_stream
from cashlens.streaming.change_capture import run_available, scratch_table

c = F.col
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# ---------------------------------------------------------------- refreshes that fall due by the clock


def refresh_input(e, stretched):
    """Event rows as runs and successes, on a clock that is twelve times as slow so that 30 and 90 days pass."""
    rows = e.select(c("user_id").alias("company_id"), stretched(c("ts").cast("timestamp")).alias("at"), "event_type", c("value").cast(D.MONEY).alias("value"))
    success = (c("event_type") == "purchase") & (c("value") > 100)
    return rows.select(
        "company_id",
        "at",
        success.alias("success"),
        (~success & (c("value") >= 40)).alias("in_zone"),
        F.when(success, 0).when(c("event_type") == "error", 30).otherwise(90).cast("int").alias("days"),
    )


REFRESH_SQL = f"""
WITH r AS (SELECT user_id AS company_id, epoch_us(TIMESTAMP '2024-01-01' + 12 * (ts - TIMESTAMP '2024-01-01')) AS t_at,
    event_type = 'purchase' AND {m('value')} > 100 AS success, {m('value')} >= 40 AS zone, CASE WHEN event_type = 'error' THEN 30 ELSE 90 END AS days FROM events),
w AS (SELECT (max(t_at) // 1000) * 1000 - 86400000000 AS w FROM r),
s AS (SELECT company_id, t_at, lead(t_at) OVER o AS next, last_value(CASE WHEN NOT success THEN zone END IGNORE NULLS) OVER p AS zone,
    last_value(CASE WHEN NOT success THEN days END IGNORE NULLS) OVER p AS days, last_value(CASE WHEN success THEN t_at END IGNORE NULLS) OVER p AS done
  FROM r, w WHERE t_at < w
  WINDOW o AS (PARTITION BY company_id ORDER BY t_at), p AS (PARTITION BY company_id ORDER BY t_at ROWS UNBOUNDED PRECEDING)),
f AS (SELECT company_id, done, days, greatest(done + days * 86400000000, t_at) AS due FROM s, w
  WHERE zone AND done IS NOT NULL AND (greatest(done + days * 86400000000, t_at) <= next OR next IS NULL AND greatest(done + days * 86400000000, t_at) < w))
SELECT company_id, strftime(make_timestamp(min(due)), '%Y-%m-%d %H:%M:%S.%f') AS due_at, CAST(arg_min(days, due) AS INTEGER) AS refresh_days,
  strftime(make_timestamp(done), '%Y-%m-%d %H:%M:%S.%f') AS success_at FROM f GROUP BY company_id, done
"""


def shown(rows):
    return rows.select("company_id", F.date_format("due_at", STAMP).alias("due_at"), "refresh_days", F.date_format("success_at", STAMP).alias("success_at"))


@query("stream_due_refreshes", REFRESH_SQL)
def stream_due_refreshes(spark, sf):
    from cashlens.plans.triggers import stretched

    rows = refresh_input(E.event_files(spark, sf), stretched)
    target = scratch_table(spark, "refreshes")
    run_available(refresh_stream.refresh_stream(rows, "1 day"), target)
    return shown(spark.read.parquet(f"{target}/data"))


@query("due_refreshes", REFRESH_SQL)
def due_refreshes(spark, sf):
    from cashlens.plans.triggers import stretched

    rows = refresh_input(D.table(spark, sf, "events"), stretched)
    # the stream's watermark counts in milliseconds
    until = F.timestamp_millis(F.unix_millis(F.lit(rows.agg(F.max("at")).first()[0])) - 86_400_000)
    return shown(refresh_stream.due_refreshes(rows, until))


# ---------------------------------------------------------------- restatements in any order


@query("stream_restatements", SQL["latest_restatement"])
def stream_restatements(spark, sf):
    from cashlens.operators import ledger as L

    columns = ["company_id", "field_id", "security_id", "fiscal_period", "source_document", "source_fetch_time", "ingest_seq", "seq", "value"]
    points = D.raw_points(spark, sf).select(*columns).withColumn("source_fetch_time", c("source_fetch_time").cast("timestamp"))
    target = scratch_table(spark, "restatements")
    # dealt by hash, so fetch times arrive in no order
    points.repartition(F.xxhash64("seq")).write.parquet(f"{target}/pages")
    pages = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 4).parquet(f"{target}/pages")
    run_available(restatement_stream.newest_rows(pages, "4000 days"), target)
    newest = L.latest_restatements(spark.read.parquet(f"{target}/data"))
    return newest.select("company_id", "field_id", "source_document", "seq", c("value").cast("double").alias("value"))


# ---------------------------------------------------------------- all pages, then the newest


def observations(e):
    return e.select(
        F.sha2(F.concat_ws("|", c("user_id").cast("string"), "event_type"), 256).alias("event_key"),
        F.sha2("props", 256).alias("payload_hash"),
        c("ts").cast("timestamp").alias("observed_at"),
        c("event_id").alias("batch_seq"),
    )


@query("incremental_revisions", SQL["event_revisions"])
def incremental_revisions(spark, sf):
    e = D.table(spark, sf, "events")
    target = scratch_table(spark, "feed")
    last = e.agg(F.max("event_id")).first()[0] or 0

    def add_pages(first, end):
        """A part of the feed by sequence, as sorted page files that the next run finds."""
        part = e.where((c("event_id") >= first * last / 10) & (c("event_id") <= end * last / 10))
        part.repartitionByRange("event_id").write.mode("append").parquet(f"{target}/pages")

    # bootstrap: all there is; later runs: the newest page, which repeats the end of the one before
    for first, end in ((0, 7), (6, 9), (8.5, 10)):
        add_pages(first, end)
        feed.read_feed(spark, f"{target}/pages", e.schema, target, observations, pages_per_batch=1000)
    log = feed.revision_log(spark, target)
    return log.select("event_key", "payload_hash", "change_kind", "revision_id")


# ---------------------------------------------------------------- injected sources


def quotes(spark, sf):
    """Events as the quotes that an injected fetch returns for the codes of a watch list (the nations' keys)."""
    codes = [r[0] for r in D.table(spark, sf, "nation").select(c("n_nationkey").cast("bigint")).collect()]
    path = f"{sf}/events.parquet"
    columns = {"code": "user_id", "price": "value", "seq": "event_id", "update_time": "ts"}
    return injected.register(
        spark,
        "event_quotes",
        injected.Injected(
            injected.parquet_fetch(path, columns, "code"),
            codes,
            "code bigint, price double, seq bigint, update_time timestamp_ntz",
            pushed=("seq", "update_time"),
            sequence="seq",
            latest=injected.parquet_latest(path, "event_id"),
        ),
    )


QUOTE_SQL = f"""SELECT user_id AS code, count(*) AS n, arg_max(value, event_id) AS price, max(event_id) AS seq, {d(f"sum({m('value')})")} AS total
FROM events WHERE user_id IN (SELECT n_nationkey FROM nation) AND {{where}} GROUP BY 1"""


def quote_totals(rows):
    return rows.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("price", "seq").alias("price"), F.max("seq").alias("seq"), F.sum(c("price").cast(D.MONEY)).cast("double").alias("total")
    )


@query("injected_quotes", QUOTE_SQL.format(where="ts >= TIMESTAMP '2024-01-10 00:00:00' AND user_id <> 3"))
def injected_quotes(spark, sf):
    rows = spark.read.format(quotes(spark, sf)).load()
    return quote_totals(rows.where((c("update_time") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")) & (c("code") != 3)))


@query("stream_injected_quotes", QUOTE_SQL.format(where="true"))
def stream_injected_quotes(spark, sf):
    rows = spark.readStream.format(quotes(spark, sf)).load()
    target = scratch_table(spark, "quotes")
    query = rows.writeStream.format("parquet").option("path", f"{target}/data").option("checkpointLocation", f"{target}/checkpoint").start()
    query.processAllAvailable()
    query.stop()
    return quote_totals(spark.read.parquet(f"{target}/data"))


# ---------------------------------------------------------------- publication


SIGNED = """(SELECT string_agg(lpad(lower(to_hex(CAST(s AS UBIGINT))), 16, '0'), '' ORDER BY i) FROM (
  SELECT i, sum(CAST('0x' || substr(h, 16 * i + 1, 16) AS UBIGINT)) % 18446744073709551616 AS s FROM (
    SELECT sha256('=' || company_id) AS h, unnest(range(4)) AS i FROM {of}) GROUP BY i))"""

PUBLICATION_SQL = f"""
WITH total AS (SELECT c_custkey AS company_id, coalesce(sum({m('o_totalprice')}) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, coalesce(sum({m('o_totalprice')}), 0) AS a
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
part AS (SELECT company_id FROM total WHERE company_id % 7 <> 0)
SELECT b AS batch_id, status, CASE WHEN status = 'EMPTY' THEN repeat('0', 64) WHEN b = 3 THEN {SIGNED.format(of='part')} ELSE {SIGNED.format(of='total')} END AS signature,
  CASE WHEN status = 'EMPTY' THEN 0 WHEN b = 3 THEN (SELECT count(*) FROM part) ELSE (SELECT count(*) FROM total) END AS records,
  (SELECT {d('sum(a)')} FROM total) AS published_total
FROM (VALUES (1, 'PUBLISHED'), (2, 'PUBLISHED'), (3, 'REJECTED'), (4, 'REJECTED'), (5, 'EMPTY')) v(b, status)
"""


@query("publication_log", PUBLICATION_SQL)
def publication_log(spark, sf):
    """Five batches: two good ones, the second twice, then a changed universe, a broken rule and an empty table."""
    orders = D.table(spark, sf, "orders").groupBy(c("o_custkey").alias("company_id")).agg(
        F.sum(F.when(c("o_orderstatus") == "F", D.money("o_totalprice"))).alias("f"), F.sum(D.money("o_totalprice")).alias("a")
    )
    base = D.table(spark, sf, "customer").select(c("c_custkey").alias("company_id")).join(orders, "company_id", "left")
    total = lambda name: base.select("company_id", F.coalesce(c(name), F.lit(0)).cast("decimal(38,2)").alias("total"))
    negative = lambda df: df.where(c("total") < 0)
    root = scratch_table(spark, "publication")
    whole = total("a")
    for batch_id, df in (
        (1, total("f")),
        (2, whole),
        (2, total("f")),
        (3, whole.where(c("company_id") % 7 != 0)),
        (4, whole.withColumn("total", -c("total") - 1)),
        (5, whole.limit(0)),
    ):
        publish.publish(df, root, batch_id, ["company_id"], violations=negative)
    published = publish.current(spark, root).agg(F.sum("total").cast("double").alias("published_total"))
    log = publish.pointers(spark, root).select(c("batch_id").cast("int").alias("batch_id"), "status", "signature", "records")
    return log.join(F.broadcast(published))  # one row
