"""Corporate-action events: identity, change capture, revision log, acknowledgements, yearly totals.

A single event key may hold a large share of all observations, so nothing here sorts a whole key in
one task: first and last rows come from aggregates with map-side combine, and the row-to-row
comparison runs in time buckets with a carry between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashlens.functions.hashing import digest, stable_map_json, without_keys
from cashlens.functions.numeric import finite_decimal, ratio
from cashlens.operators.scale import lag_in_buckets, latest_by

c = F.col
VOLATILE_KEYS = ("view_count",)


def identity_of(event_type: Column, payload: Column) -> Column:
    """Identity fields per event type, as one array of texts."""
    f = lambda *k: F.array(*[payload[x] for x in k])
    hk = payload["record_market"] == "HK"
    return (
        F.when(event_type == "dividend", f("pub_date", "statement", "record_date"))
        .when((event_type == "buyback") & hk, f("end_date_str", "buy_back_sum", "buy_back_money", "share_type"))
        .when(
            event_type == "buyback",
            F.array(
                F.coalesce(payload["advance_date_str"], payload["start_date_str"]),
                payload["seller"],
                payload["buy_back_mode"],
                payload["share_type"],
            ),
        )
        .when(event_type == "financial", F.array(payload["fiscal_year"], payload["period_text"], F.lit("income")))
        .otherwise(
            F.when(F.length(payload["url"]) > 0, F.array(payload["url"])).otherwise(f("publish_time", "title"))
        )
    )


def event_date_of(event_type: Column, payload: Column) -> Column:
    first = lambda *k: F.coalesce(*[F.nullif(payload[x], F.lit("")) for x in k])
    return F.coalesce(
        F.when(event_type == "dividend", first("pub_date", "ex_date"))
        .when((event_type == "buyback") & (payload["record_market"] == "HK"), first("end_date_str", "publ_date_str"))
        .when(event_type == "buyback", first("change_date_str", "end_date_str", "advance_date_str"))
        .when(event_type == "financial", first("date_time_str"))
        .otherwise(first("publish_time")),
        F.lit(""),
    )


def normalize(raw: DataFrame) -> DataFrame:
    """Stable event key and content hash; volatile keys do not count as a change.

    ``raw``: issuer_id, quote_code, event_type, payload map<string,string>, observed_at, batch_seq.
    """
    stable = without_keys(c("payload"), *VOLATILE_KEYS)
    ident = F.to_json(F.array(c("quote_code"), F.to_json(identity_of(c("event_type"), c("payload")))))
    return raw.withColumns(
        {
            "event_key": F.concat_ws(":", "event_type", digest(ident, 24)),
            "event_date": event_date_of(c("event_type"), c("payload")),
            "payload": stable,
            "payload_hash": digest(stable_map_json(stable)),
        }
    )


def last_in_batch(df: DataFrame) -> DataFrame:
    """The last row of each event key inside one batch wins."""
    return latest_by(df, ["event_key"], [c("batch_seq")])


def change_log(df: DataFrame, bucket: str = "1 day") -> DataFrame:
    """new / changed / unchanged against the previous observation of the same key."""
    order = ["observed_at", "batch_seq"]
    lagged = lag_in_buckets(df, ["event_key"], order, F.window("observed_at", bucket)["start"], "payload_hash", "_before")
    kind = (
        F.when(c("_before").isNull(), "new").when(c("_before") != c("payload_hash"), "changed").otherwise("unchanged")
    )
    return lagged.withColumn("change_kind", kind).drop("_before")


def current_state(df: DataFrame) -> DataFrame:
    """One row per key: newest content with first and last sighting."""
    order = F.struct("observed_at", "batch_seq")
    return df.groupBy("event_key").agg(
        F.max_by("payload_hash", order).alias("payload_hash"),
        F.min("observed_at").alias("first_seen_at"),
        F.max("observed_at").alias("last_seen_at"),
        F.count(F.lit(1)).alias("observations"),
    )


def revisions(df: DataFrame) -> DataFrame:
    """One row per (key, content): its first sighting; going back to an old content adds nothing."""
    order = F.struct("observed_at", "batch_seq")
    first = df.groupBy("event_key", "payload_hash").agg(F.min(order).alias("seen"))
    # The key's origin comes from the reduced table, not from a second read of the observations.
    origin = first.groupBy("event_key").agg(F.min("seen").alias("origin"))
    return first.join(origin, "event_key").select(
        "event_key",
        "payload_hash",
        F.when(c("seen") == c("origin"), "new").otherwise("changed").alias("change_kind"),
        c("seen.observed_at").alias("observed_at"),
        c("seen.batch_seq").alias("revision_id"),
    )


def unsynced(revision_log: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """Revisions without an acknowledgement."""
    return revision_log.join(acknowledgements.select("revision_id"), "revision_id", "left_anti")


def year_of(text: Column) -> Column:
    found = F.regexp_extract(text, r"((?:19|20)\d{2})", 1)
    return F.when(found != "", found).otherwise("日期不明")


def buyback_totals(df: DataFrame) -> DataFrame:
    """Yearly count, money (each row rounded to cents half up), shares and sorted distinct labels."""
    money = F.round(F.coalesce(finite_decimal(c("buy_back_money")), F.lit(0)), 2)
    return df.groupBy("issuer_id", year_of(c("event_date")).alias("year")).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(money).cast("decimal(38,2)").alias("money"),
        F.sum(F.coalesce(c("buy_back_sum").cast("bigint"), F.lit(0))).alias("shares"),
        F.array_join(F.array_sort(F.collect_set("process")), "；").alias("processes"),
    )


def newest_rows(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Newest k rows per key; Spark cuts each partition to k rows per key before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(c("rn") <= k)


def upsert_master(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming wins per column; rows only in the existing side are marked unexpected."""
    fields = [x for x in incoming.columns if x != key]
    a = incoming.select(key, F.struct(*fields).alias("_new"))
    b = existing.select(key, F.struct(*fields).alias("_old"))
    return a.join(b, key, "full_outer").select(
        key,
        *[F.when(c("_new").isNotNull(), c(f"_new.{x}")).otherwise(c(f"_old.{x}")).alias(x) for x in fields],
        F.when(c("_new").isNull(), "unexpected")
        .when(c("_old").isNull(), "inserted")
        .when(c("_new") == c("_old"), "unchanged")
        .otherwise("updated")
        .alias("merge_action"),
    )


def confirm(expected: DataFrame, state: DataFrame) -> DataFrame:
    """Each expected event must exist with the same issuer, type, content hash and named values."""
    s = state.select(
        "event_key",
        c("issuer_id").alias("_i"),
        c("event_type").alias("_t"),
        c("payload_hash").alias("_h"),
        c("payload").alias("_p"),
        F.lit(True).alias("_found"),
    )
    j = expected.join(s, "event_key", "left")
    bad_values = F.filter(F.map_keys("expected_values"), lambda k: ~F.coalesce(c("_p")[k] == c("expected_values")[k], F.lit(False)))
    issues = F.array_compact(
        F.array(
            F.when(c("_found").isNull(), F.lit("EVENT_NOT_FOUND")),
            F.when(c("_i") != c("issuer_id"), F.lit("ISSUER_MISMATCH")),
            F.when(c("_t") != c("event_type"), F.lit("TYPE_MISMATCH")),
            F.when(c("_h") != c("payload_hash"), F.lit("PAYLOAD_HASH_MISMATCH")),
            F.when(c("_found") & (F.size(bad_values) > 0), F.lit("VALUE_MISMATCH")),
        )
    )
    return j.withColumns({"issues": issues, "confirmed": F.size(issues) == 0}).drop("_i", "_t", "_h", "_p", "_found")


def changed_snapshots(history: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` whose content differs from the newest stored content of their key."""
    newest = history.groupBy("event_key").agg(F.max_by("payload_hash", "observed_at").alias("_h"))
    return batch.join(newest, "event_key", "left").where(c("_h").isNull() | (c("_h") != c("payload_hash"))).drop("_h")


def rows_to_recompute(inputs: DataFrame, cached: DataFrame) -> DataFrame:
    """Companies whose slow-input hash has no cached result."""
    return inputs.join(cached.select("company_id", "input_hash"), ["company_id", "input_hash"], "left_anti")


def reuse_cached(inputs: DataFrame, cached: DataFrame, computed: DataFrame) -> DataFrame:
    """Cached results for unchanged inputs, together with the newly computed ones."""
    kept = cached.join(inputs.select("company_id", "input_hash"), ["company_id", "input_hash"], "left_semi")
    return kept.unionByName(computed)


def supersede(selections: DataFrame) -> DataFrame:
    """Newest selection per company and year is CURRENT, older ones SUPERSEDED; nothing is deleted.

    The newest selection is found with an aggregate and joined back, so a company-year selected very
    often is not sorted in one task.
    """
    newest = selections.groupBy("company_id", "fiscal_year").agg(F.max(F.struct("selected_at", "document_id")).alias("_n"))
    j = selections.join(newest, ["company_id", "fiscal_year"])
    is_newest = F.struct("selected_at", "document_id") == c("_n")
    return j.withColumns(
        {
            "selection_status": F.when(is_newest, "CURRENT").otherwise("SUPERSEDED"),
            "superseded_by": F.when(~is_newest, c("_n.document_id")),
        }
    ).drop("_n")


def enqueue(requests: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Idempotent requests on the full key; older waiting work of one company and mode is superseded."""
    unique = requests.groupBy(*key).agg(F.min("created_at").alias("created_at"))
    newest = unique.groupBy("company_id", "analysis_mode").agg(
        F.max(F.struct(c("created_at"), *[k for k in key if k not in ("company_id", "analysis_mode")])).alias("_n")
    )
    j = unique.join(newest, ["company_id", "analysis_mode"])
    same = F.struct(c("created_at"), *[k for k in key if k not in ("company_id", "analysis_mode")]) == c("_n")
    return j.withColumn("queue_status", F.when(same, "QUEUED").otherwise("SUPERSEDED")).drop("_n")


def mean_value(df: DataFrame) -> DataFrame:
    return df.groupBy("event_type").agg(ratio(F.sum(c("value").cast("decimal(18,2)")), F.count("value")).alias("mean"))
