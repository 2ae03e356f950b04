"""Queries of the watch list."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashlens.functions.market import market_state
from cashlens.functions.numeric import float_round, half_up, ratio
from cashlens.operators import watchlist as W
from cashlens.plans.registry import query
from cashlens.plans.sqlparts import d, fround, part, rnd, with_parts
from cashlens.session import cut_lineage
from cashlens.sources import domain as D

c = F.col

part(
    "change",
    f"""SELECT security_id, CASE WHEN last > 0 AND prev > 0 THEN {fround('x', 4)} END AS daily_change_pct
FROM (SELECT *, (last - prev) / prev * 100 AS x FROM price_feature)""",
    "price_feature",
)
part(
    "signal",
    f"""SELECT sector, {rnd("CAST(sum(CAST(return1d_pct AS DECIMAL(18,4))) AS DOUBLE) / count(return1d_pct)", 4)} AS r1,
  {rnd("CAST(sum(CAST(return5d_pct AS DECIMAL(18,4))) AS DOUBLE) / count(return5d_pct)", 4)} AS r5,
  {rnd("CAST(sum(CAST(return20d_pct AS DECIMAL(18,4))) AS DOUBLE) / count(return20d_pct)", 4)} AS r20,
  {rnd("100.0 * count(*) FILTER (WHERE return5d_pct > 0)::DOUBLE / nullif(count(return5d_pct), 0)", 4)} AS a5,
  {rnd("100.0 * count(*) FILTER (WHERE above_ma20)::DOUBLE / nullif(count(above_ma20), 0)", 4)} AS ma,
  count(DISTINCT issuer_id) AS ic, count(DISTINCT issuer_id) FILTER (WHERE last IS NOT NULL) AS cc
FROM security LEFT JOIN price_feature USING (security_id) GROUP BY sector""",
    "security",
    "price_feature",
)
part(
    "sector_base",
    f"""SELECT sector, security_count, issuer_count, quoted, advancers, decliners, quoted - advancers - decliners AS unchanged,
  {fround('avg_raw', 2)} AS average_daily_change_pct, {fround('breadth_raw', 2)} AS breadth_pct, {fround('cov_raw', 2)} AS heat_coverage_pct,
  r1, r5, r20, a5, ma, least(issuer_count, ic) AS heat_issuer_count,
  CASE WHEN least(issuer_count, ic) < 3 THEN 'insufficient_issuers' WHEN {fround('cov_raw', 2)} IS NULL OR {fround('cov_raw', 2)} < 80 THEN 'insufficient_coverage'
    WHEN r1 IS NULL OR r5 IS NULL OR r20 IS NULL OR a5 IS NULL OR ma IS NULL THEN 'incomplete_history' ELSE 'eligible' END AS st
FROM (SELECT sector, sum(members)::BIGINT AS security_count, count(*) AS issuer_count, count(ch) AS quoted, count(*) FILTER (WHERE ch > 0) AS advancers,
        count(*) FILTER (WHERE ch < 0) AS decliners, CAST(sum(CAST(ch AS DECIMAL(18,6))) AS DOUBLE) / nullif(count(ch), 0) AS avg_raw,
        count(*) FILTER (WHERE ch > 0)::DOUBLE / nullif(count(ch), 0) * 100 AS breadth_raw,
        any_value(r1) AS r1, any_value(r5) AS r5, any_value(r20) AS r20, any_value(a5) AS a5, any_value(ma) AS ma, any_value(ic) AS ic,
        least(any_value(cc), count(*))::DOUBLE / count(*) * 100 AS cov_raw
      FROM (SELECT sector, issuer_id, count(*) AS members, median(daily_change_pct) AS ch FROM security LEFT JOIN change USING (security_id) GROUP BY 1, 2)
      JOIN signal USING (sector) GROUP BY sector)""",
    "security",
    "change",
    "signal",
)


def _pr(col: str) -> str:
    return (
        f"(CASE WHEN count(*) OVER () = 1 THEN 50.0::DOUBLE ELSE (rank() OVER (ORDER BY {col}) - 1 + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0::DOUBLE) "
        f"/ (count(*) OVER () - 1) * 100 END)"
    )


part(
    "heat",
    f"""SELECT sector, {fround('h', 1)} AS heat_score,
  CASE WHEN h >= 80 THEN '偏热' WHEN h >= 60 THEN '升温' WHEN h >= 40 THEN '中性' WHEN h >= 20 THEN '降温' ELSE '偏冷' END AS heat_label, 'computed' AS heat_status
FROM (SELECT sector, 0.0::DOUBLE + {_pr('r1')} * 0.20::DOUBLE + {_pr('r5')} * 0.30::DOUBLE + {_pr('r20')} * 0.30::DOUBLE + {_pr('a5')} * 0.10::DOUBLE + {_pr('ma')} * 0.10::DOUBLE AS h
      FROM sector_base WHERE st = 'eligible')
UNION ALL SELECT sector, NULL, '数据不足', st FROM sector_base WHERE st <> 'eligible'""",
    "sector_base",
)


def listed(spark, sf):
    """Securities with price features and the yield basis (all one row per security)."""
    sec = D.securities(spark, sf)
    # The large table is scanned once; everything below reads the security x week aggregate.
    weeks = cut_lineage(D.trading_weeks(spark, sf))
    feats = D.price_features(spark, sf, weeks)
    basis = D.yield_basis(spark, sf, weeks)
    joined = sec.join(feats, "security_id", "left").join(basis, "security_id", "left")
    staged = joined.withColumn("_x", F.when((c("last") > 0) & (c("prev") > 0), (c("last") - c("prev")) / c("prev") * 100))
    return cut_lineage(staged.withColumn("daily_change_pct", float_round(c("_x"), 4)).drop("_x"))


def signals(listed_df):
    mean = lambda x: half_up(ratio(F.sum(c(x).cast("decimal(18,4)")), F.count(x)), 4)
    share = lambda cond, n: half_up(100.0 * F.count(F.when(cond, 1)) / F.nullif(F.count(n), F.lit(0)), 4)
    # Issuers per sector are counted on the issuer grain first.
    per = listed_df.groupBy("sector", "issuer_id").agg(
        F.max(c("last").isNotNull().cast("int")).alias("covered"),
    )
    counts = per.groupBy("sector").agg(F.count(F.lit(1)).alias("issuerCount"), F.sum("covered").alias("coveredIssuerCount"))
    g = listed_df.groupBy("sector").agg(
        mean("return1d_pct").alias("return1dPct"),
        mean("return5d_pct").alias("return5dPct"),
        mean("return20d_pct").alias("return20dPct"),
        share(c("return5d_pct") > 0, "return5d_pct").alias("advancers5dPct"),
        share(c("above_ma20"), "above_ma20").alias("aboveMa20Pct"),
    )
    return g.join(counts, "sector").withColumn("coveragePct", F.lit(None).cast("double"))


def bases(spark, sf):
    rows = listed(spark, sf)
    return W.sector_base(rows, signals(rows))


@query(
    "sector_breadth",
    with_parts(
        "sector_base",
        """SELECT sector, security_count, issuer_count, quoted AS quoted_issuer_count, advancers, decliners, unchanged,
  average_daily_change_pct, breadth_pct, heat_coverage_pct, st AS heat_status FROM sector_base""",
    ),
)
def sector_breadth(spark, sf):
    return bases(spark, sf).select(
        "sector",
        "security_count",
        "issuer_count",
        "quoted_issuer_count",
        "advancers",
        "decliners",
        "unchanged",
        "average_daily_change_pct",
        "breadth_pct",
        "heat_coverage_pct",
        "heat_status",
    )


@query(
    "sector_heat",
    with_parts(
        "heat",
        """SELECT sector, heat_score, heat_label, heat_status,
  CASE WHEN heat_score IS NOT NULL THEN CAST(row_number() OVER (ORDER BY heat_score DESC NULLS LAST, sector) AS INTEGER) END AS rank FROM heat""",
    ),
)
def sector_heat(spark, sf):
    return W.sector_heat(bases(spark, sf)).select("sector", "heat_score", "heat_label", "heat_status", "rank")


part(
    "watch_priced",
    f"""SELECT *, {fround('dist_raw', 2)} AS distance_pct, {fround('yield_raw', 3)} AS shareholder_yield_pct
FROM (SELECT *, (last - target_preferred) / target_preferred * 100 AS dist_raw, CASE WHEN cny > 0 THEN basis / cny * 100 END AS yield_raw
  FROM (SELECT *, {fround('tw', 4)} AS target_watch, {fround('tp', 4)} AS target_preferred, {fround('td', 4)} AS target_deep,
          {fround('pc', 4)} AS target_preferred_cny, {fround('cny', 4)} AS current_price_cny
        FROM (SELECT *, basis / 0.03::DOUBLE * (1.0::DOUBLE / fx) AS tw, basis / 0.04::DOUBLE * (1.0::DOUBLE / fx) AS tp, basis / 0.05::DOUBLE * (1.0::DOUBLE / fx) AS td,
                basis / 0.04::DOUBLE AS pc, last * fx AS cny
              FROM (SELECT s.*, f.* EXCLUDE (security_id), b.* EXCLUDE (security_id), CASE s.currency WHEN 'CNY' THEN 1.0::DOUBLE WHEN 'HKD' THEN 0.92::DOUBLE END AS fx
                    FROM security s LEFT JOIN price_feature f USING (security_id) LEFT JOIN yield_basis b USING (security_id)))))""",
    "security",
    "price_feature",
    "yield_basis",
)
part(
    "watch",
    f"""SELECT *, {fround('ot_raw', 1)} AS opportunity_technical
FROM (SELECT *, CASE WHEN technical IS NOT NULL AND heat_score IS NOT NULL AND target_attractiveness IS NOT NULL
        THEN target_attractiveness * 0.55::DOUBLE + technical * 0.30::DOUBLE + heat_score * 0.15::DOUBLE END AS ot_raw,
     CASE WHEN target_preferred IS NULL THEN 'unconfigured' WHEN last IS NULL THEN 'price_unavailable' WHEN distance_pct <= 0 THEN 'reached' WHEN distance_pct <= 3 THEN 'within_3' WHEN distance_pct <= 10 THEN 'within_10' ELSE 'far' END AS target_status,
     CASE WHEN target_preferred IS NULL THEN 'not_configured' WHEN last IS NULL THEN 'unavailable' WHEN distance_pct <= 0 THEN 'buy_zone' WHEN distance_pct <= 3 THEN 'approaching' WHEN distance_pct <= 10 THEN 'watch' ELSE 'none' END AS alert_status,
     CASE WHEN yield_raw IS NULL THEN 'unconfigured' WHEN yield_raw >= 5 THEN 'deeply_attractive' WHEN yield_raw >= 4 THEN 'attractive' WHEN yield_raw >= 3 THEN 'fair' ELSE 'expensive' END AS valuation_status,
     CASE WHEN technical IS NOT NULL THEN rsi14 <= 40 OR drawdown60d_pct <= -10 END AS technical_oversold
  FROM (SELECT w.*, h.heat_score, {fround('a_raw', 1)} AS target_attractiveness, {fround('t_raw', 1)} AS technical
        FROM (SELECT *, CASE WHEN distance_pct IS NOT NULL THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 - greatest(distance_pct, 0.0::DOUBLE) * 5)) END AS a_raw,
                CASE WHEN history_weeks >= 60 THEN 100 * (0.40::DOUBLE * least(1.0, greatest(0.0, (50 - rsi14) / 20)) + 0.35::DOUBLE * least(1.0, greatest(0.0, ((-drawdown60d_pct / 100) - 0.05::DOUBLE) / 0.20::DOUBLE))
                  + 0.25::DOUBLE * least(1.0, greatest(0.0, ((-relative_pct / 100) - 0.02::DOUBLE) / 0.08::DOUBLE))) END AS t_raw
              FROM (SELECT p.*, {rnd('p.return5d_pct - s.r5', 4)} AS relative_pct FROM watch_priced p JOIN signal s USING (sector))) w
        LEFT JOIN heat h USING (sector)))""",
    "watch_priced",
    "signal",
    "heat",
)


def watched(spark, sf):
    """The whole watch list; returns (watch, heat)."""
    rows = listed(spark, sf)
    sig = signals(rows)
    heat = W.sector_heat(W.sector_base(rows, sig))
    enriched = rows.join(sig.select("sector", c("return5dPct").alias("_r5")), "sector").withColumns(
        {
            "current_price": c("last"),
            "hkd_cny": F.lit(D.HKD_CNY),
            "relative_sector5d_pct": half_up(c("return5d_pct") - c("_r5"), 4),
            "history_days": c("history_weeks"),
            "industry": c("issuer_id"),
            "ticker": c("security_id").cast("string"),
        }
    )
    return W.build_watchlist(enriched, heat), heat


@query(
    "watchlist",
    with_parts(
        "watch",
        """SELECT security_id, target_preferred, target_preferred_cny, current_price_cny, shareholder_yield_pct, valuation_status, distance_pct, target_status, alert_status,
  target_attractiveness AS opportunity_score, technical, technical_oversold, heat_score, opportunity_technical FROM watch""",
    ),
)
def watchlist(spark, sf):
    watch, _ = watched(spark, sf)
    return W.sort_list(watch, "distance_pct").select(
        "security_id",
        "target_preferred",
        "target_preferred_cny",
        "current_price_cny",
        "shareholder_yield_pct",
        "valuation_status",
        "distance_pct",
        "target_status",
        "alert_status",
        "opportunity_score",
        "technical",
        "technical_oversold",
        "heat_score",
        "opportunity_technical",
    )


COUNTS = """count(*) FILTER (WHERE target_status = 'reached') AS reached, count(*) FILTER (WHERE target_status = 'within_3') AS within3,
  count(*) FILTER (WHERE target_status = 'within_10') AS within10, CAST(sum(CAST(distance_pct AS DECIMAL(18,2))) AS DOUBLE) / nullif(count(distance_pct), 0) AS da,
  CAST(sum(CAST(target_attractiveness AS DECIMAL(18,1))) AS DOUBLE) / nullif(count(target_attractiveness), 0) AS oa,
  arg_min(security_id, row(-target_attractiveness, coalesce(distance_pct, 'Infinity'::DOUBLE), name)) FILTER (WHERE target_attractiveness IS NOT NULL) AS top_id, max(target_attractiveness) AS top_score"""


@query(
    "watchlist_summary",
    with_parts(
        "watch",
        f"""SELECT total_securities, target_configured, price_available, unconfigured, hot_sector_dislocations, reached, reached + within3 AS at_or_within3,
  reached + within3 + within10 AS at_or_within10, {fround('da', 2)} AS average_distance_pct, top_id, top_score
FROM (SELECT count(*) AS total_securities, count(target_preferred) AS target_configured, count(last) AS price_available, count(*) FILTER (WHERE target_status = 'unconfigured') AS unconfigured,
  count(*) FILTER (WHERE ot_raw IS NOT NULL AND heat_score >= 60 AND distance_pct <= 10 AND relative_pct <= -3 AND technical_oversold) AS hot_sector_dislocations, {COUNTS} FROM watch)""",
    ),
)
def watchlist_summary(spark, sf):
    watch, _ = watched(spark, sf)
    return W.summarize(watch).select(
        "total_securities",
        "target_configured",
        "price_available",
        "unconfigured",
        "hot_sector_dislocations",
        "reached",
        "at_or_within3",
        "at_or_within10",
        "average_distance_pct",
        "top_id",
        "top_score",
    )


@query(
    "sector_ranking",
    with_parts(
        ["watch", "heat"],
        f"""SELECT sector, heat_score, heat_label, reached, within3, within10, {fround('da', 2)} AS average_distance_pct, {fround('oa', 1)} AS average_opportunity, top_id
FROM (SELECT sector, {COUNTS} FROM watch GROUP BY sector) JOIN heat USING (sector)""",
    ),
)
def sector_ranking(spark, sf):
    watch, heat = watched(spark, sf)
    return W.rank_sectors(watch, heat).select(
        "sector", "heat_score", "heat_label", "reached", "within3", "within10", "average_distance_pct", "average_opportunity", "top_id"
    )


@query(
    "target_lines",
    with_parts(
        "watch_priced",
        "SELECT security_id, k AS key, price FROM (SELECT security_id, unnest(['watch','preferred','deep']) AS k, unnest([target_watch, target_preferred, target_deep]) AS price FROM watch_priced)",
    ),
)
def target_lines(spark, sf):
    rows = listed(spark, sf).withColumns({"current_price": c("last"), "hkd_cny": F.lit(D.HKD_CNY)})
    return W.target_lines(W.yield_model(rows)).select("security_id", "key", "price")


@query(
    "list_filter_sort",
    with_parts(
        "watch",
        """SELECT security_id, name, distance_pct, alert_status FROM watch
WHERE contains(lower(name || ' ' || security_id || ' ' || market || ' ' || sector || ' ' || issuer_id), 'as') AND market = 'HK' AND alert_status IN ('buy_zone','approaching','watch')""",
    ),
)
def list_filter_sort(spark, sf):
    watch, _ = watched(spark, sf)
    hits = W.alerts(W.filter_list(watch, " AS ", market="HK"))
    return W.sort_list(hits, "distance_pct", descending=True).select("security_id", "name", "distance_pct", "alert_status")


@query(
    "candidate_views",
    with_parts(
        "watch",
        """SELECT security_id, 'price' AS view FROM watch WHERE distance_pct <= 10
UNION ALL SELECT security_id, 'technical' FROM watch WHERE ot_raw IS NOT NULL AND heat_score >= 60 AND distance_pct <= 10 AND relative_pct <= -3 AND technical_oversold
UNION ALL SELECT security_id, 'contrarian' FROM watch WHERE heat_score < 40 AND target_status = 'reached'""",
    ),
)
def candidate_views(spark, sf):
    watch, _ = watched(spark, sf)
    # One pass: the three views are tags of one row, not three scans.
    hit = F.coalesce(c("contrarian_low_price"), F.lit(False))
    tags = F.array_compact(
        F.array(
            F.when(c("distance_pct") <= 10, F.lit("price")),
            F.when(c("hot_sector_dislocation"), F.lit("technical")),
            F.when(hit, F.lit("contrarian")),
        )
    )
    return watch.select("security_id", F.explode(tags).alias("view"))


STATE_SQL = """CASE event_type WHEN 'click' THEN 'QotMarketState.MORNING' WHEN 'view' THEN 'closed' WHEN 'purchase' THEN ' rest ' WHEN 'signup' THEN 'FUTURE_OPEN' ELSE 'N/A' END"""


@query(
    "market_status",
    """WITH states AS (SELECT CASE WHEN user_id < 50 THEN 'CN' WHEN user_id < 100 THEN 'HK' ELSE 'US' END || '-' || event_type AS market,
   CASE event_type WHEN 'click' THEN 'open' WHEN 'view' THEN 'closed' WHEN 'purchase' THEN 'closed' WHEN 'signup' THEN 'open' ELSE 'unknown' END AS s FROM events)
SELECT market, CASE WHEN bool_or(s = 'open') THEN 'open' WHEN bool_and(s = 'closed') THEN 'closed' ELSE 'unknown' END AS status FROM states GROUP BY 1""",
)
def market_status_query(spark, sf):
    e = D.table(spark, sf, "events").select("user_id", "event_type")
    raw = (
        F.when(c("event_type") == "click", "QotMarketState.MORNING")
        .when(c("event_type") == "view", "closed")
        .when(c("event_type") == "purchase", " rest ")
        .when(c("event_type") == "signup", "FUTURE_OPEN")
        .otherwise("N/A")
    )
    venue = F.when(c("user_id") < 50, "CN").when(c("user_id") < 100, "HK").otherwise("US")
    rows = e.select(F.concat_ws("-", venue, "event_type").alias("market"), market_state(raw).alias("market_state"))
    return W.market_status(rows)


@query(
    "historical_yield",
    with_parts(
        ["weekly_price", "watch_priced"],
        f"""SELECT security_id, week, {fround('y', 4)} AS yield_pct FROM (SELECT security_id, week, target_preferred * 4 / {d('"close"')} AS y
FROM weekly_price JOIN watch_priced USING (security_id))""",
    ),
)
def historical_yield(spark, sf):
    basis = D.securities(spark, sf).join(D.yield_basis(spark, sf), "security_id", "left")
    targets = W.yield_model(basis.withColumns({"current_price": F.lit(None).cast("double"), "hkd_cny": F.lit(D.HKD_CNY)}))
    return W.historical_yield(D.weekly_prices(spark, sf), targets).select("security_id", "week", "yield_pct")
