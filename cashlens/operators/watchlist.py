"""Watch list: normalisation, yield model, target state, sector heat, technical score, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashlens.functions import policy as P
from cashlens.functions.numeric import clip, finite_double, float_round, lit_null, ratio
from cashlens.operators.scale import exact_median
from cashlens.operators.screening import average_rank_percentile

c = F.col


def text_or(col: Column, fallback: Column | str | None) -> Column:
    trimmed = F.trim(col)
    other = F.lit(fallback) if isinstance(fallback, str) or fallback is None else fallback
    return F.when(F.length(trimmed) > 0, trimmed).otherwise(other)


def normalize_securities(df: DataFrame) -> DataFrame:
    """Trimmed texts with defaults, positive prices, finite numbers; nested quote, targets, yieldBasis."""
    pos = lambda e: finite_double(e, positive=True)
    whole = lambda e: F.when(e > 0, e)
    return df.select(
        text_or(c("id"), None).alias("id"),
        text_or(c("issuerId"), F.trim(c("id"))).alias("issuer_id"),
        text_or(c("quoteCode"), None).alias("quote_code"),
        text_or(c("name"), F.trim(c("id"))).alias("name"),
        F.coalesce(F.trim(c("ticker")), F.lit("")).alias("ticker"),
        F.upper(text_or(c("market"), "UNKNOWN")).alias("market"),
        F.coalesce(F.trim(c("currency")), F.lit("")).alias("currency"),
        text_or(c("sector"), "未分类").alias("sector"),
        text_or(c("industry"), "未分类").alias("industry"),
        pos(c("quote.currentPrice")).alias("current_price"),
        finite_double(c("quote.dailyChangePct")).alias("daily_change_pct"),
        F.lower(text_or(c("quote.marketState"), "unknown")).alias("market_state"),
        F.lower(text_or(c("quote.status"), "unavailable")).alias("quote_status"),
        c("quote.lastUpdatedAt").alias("last_updated_at"),
        pos(c("targetPrices.watch")).alias("target_watch"),
        pos(c("targetPrices.preferred")).alias("target_preferred"),
        pos(c("targetPrices.deep")).alias("target_deep"),
        pos(c("yieldBasis.annualAveragePerShareCny")).alias("basis"),
        whole(c("yieldBasis.windowYears")).alias("window_years"),
        c("yieldBasis.startYear").alias("start_year"),
        c("yieldBasis.endYear").alias("end_year"),
        text_or(c("valuationStatus"), "unconfigured").alias("valuation_status"),
        technical_struct(c("technicalIndicators")).alias("technical"),
        F.coalesce(c("recommendationPaused"), F.lit(False)).alias("recommendation_paused"),
    )


def technical_struct(t: Column) -> Column:
    """The indicator struct, or null as a whole when a required member is missing or out of range."""
    rsi, dd = finite_double(t["rsi14"]), finite_double(t["drawdown60dPct"])
    rel, days = finite_double(t["relativeSector5dPct"]), t["historyTradingDays"]
    ok = rsi.between(0, 100) & dd.isNotNull() & rel.isNotNull() & (days >= 0)
    return F.when(
        ok,
        F.struct(
            rsi.alias("rsi14"), dd.alias("drawdown60d_pct"), rel.alias("relative_sector5d_pct"), days.alias("history_days")
        ),
    )


def normalize_history(points: Column) -> Column:
    """Price points above zero; a missing label becomes T-n counted from the end of the raw array."""
    n = F.size(points)
    labelled = F.transform(
        points,
        lambda p, i: F.struct(
            text_or(p["label"], F.concat(F.lit("T-"), (n - i - 1).cast("string"))).alias("label"),
            text_or(p["timestamp"], None).alias("timestamp"),
            finite_double(p["price"], positive=True).alias("price"),
        ),
    )
    return F.filter(labelled, lambda p: p["price"].isNotNull())


def normalize_target_history(entries: Column) -> Column:
    """Target revisions with positive prices and numbered default labels."""
    pos = lambda e: finite_double(e, positive=True)
    return F.transform(
        entries,
        lambda e, i: F.struct(
            text_or(e["label"], F.concat(F.lit("修订 "), (i + 1).cast("string"))).alias("label"),
            pos(e["preferredPrice"]).alias("preferred_price"),
            pos(e["watchPrice"]).alias("watch_price"),
            pos(e["deepPrice"]).alias("deep_price"),
            F.coalesce(F.trim(e["reason"]), F.lit("")).alias("reason"),
            text_or(e["changedAt"], None).alias("changed_at"),
        ),
    )


SIGNAL_FIELDS = tuple(P.SECTOR_HEAT_WEIGHTS)


def normalize_sector_signals(as_map: DataFrame | None, as_rows: DataFrame | None, column: str = "sectorSignals") -> DataFrame:
    """Sector signals given as a map (sector -> struct) or as an array of structs, in one table."""
    parts = []
    if as_map is not None:
        e = as_map.select(F.explode(F.map_entries(column)).alias("e"))
        parts.append(e.select(text_or(c("e.key"), "未分类").alias("sector"), "e.value.*"))
    if as_rows is not None:
        r = as_rows.select(F.explode(column).alias("r")).select("r.*")
        parts.append(r.where(F.length(F.trim("sector")) > 0).withColumn("sector", F.trim("sector")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return out.withColumns({f: finite_double(c(f)) for f in SIGNAL_FIELDS})


def yield_model(df: DataFrame) -> DataFrame:
    """Target prices at 3, 4 and 5 percent, the current cash yield and its valuation label.

    Expects basis, currency, current_price and hkd_cny.  Rows without a basis keep their own targets.
    """
    known = F.when(c("currency") == "CNY", F.lit(1.0)).when(
        (c("currency") == "HKD") & (c("hkd_cny") > 0), c("hkd_cny")
    )
    staged = df.withColumn("_fx", known).withColumns(
        {"_cny": c("current_price") * c("_fx"), "_local": F.lit(1.0) / c("_fx")}
    )
    raw = {}
    for name, _, pct in P.TARGETS:
        raw[f"_cny_{name}"] = c("basis") / F.lit(pct)
    staged = staged.withColumns(raw).withColumns(
        {f"_loc_{name}": c(f"_cny_{name}") * c("_local") for name, _, _ in P.TARGETS}
        | {"_yield": F.when(c("_cny") > 0, c("basis") / c("_cny") * 100)}
    )
    own = [x for x in df.columns if x.startswith("target_")]
    target = {}
    for name, _, _ in P.TARGETS:
        derived = float_round(c(f"_loc_{name}"), 4)
        kept = c(f"target_{name}") if f"target_{name}" in own else lit_null()
        target[f"target_{name}"] = F.when(c("basis").isNull(), kept).otherwise(derived)
        target[f"target_{name}_cny"] = float_round(c(f"_cny_{name}"), 4)
    label = (
        F.when(c("basis").isNull(), c("valuation_status") if "valuation_status" in df.columns else F.lit("unconfigured"))
        .when(c("_yield").isNull(), "unconfigured")
        .when(c("_yield") >= 5, "deeply_attractive")
        .when(c("_yield") >= 4, "attractive")
        .when(c("_yield") >= 3, "fair")
        .otherwise("expensive")
    )
    out = staged.withColumns(
        target
        | {
            "current_price_cny": F.when(c("basis").isNotNull(), float_round(c("_cny"), 4)),
            "shareholder_yield_pct": float_round(c("_yield"), 3),
            "valuation_status": label,
        }
    )
    return out.drop("_fx", "_cny", "_local", "_yield", *[f"_cny_{n}" for n, _, _ in P.TARGETS], *[f"_loc_{n}" for n, _, _ in P.TARGETS])


def target_state(df: DataFrame) -> DataFrame:
    """Distance to the preferred price, its bucket, alert and attractiveness; buckets use the rounded distance."""
    staged = df.withColumn(
        "_d", (c("current_price") - c("target_preferred")) / F.when(c("target_preferred") != 0, c("target_preferred")) * 100
    ).withColumn("distance_pct", float_round(c("_d"), 2))
    d = c("distance_pct")
    none, no_price = c("target_preferred").isNull(), c("current_price").isNull()
    status = (
        F.when(none, "unconfigured")
        .when(no_price, "price_unavailable")
        .when(d <= 0, "reached")
        .when(d <= 3, "within_3")
        .when(d <= 10, "within_10")
        .otherwise("far")
    )
    alert = (
        F.when(none, "not_configured")
        .when(no_price, "unavailable")
        .when(d <= 0, "buy_zone")
        .when(d <= 3, "approaching")
        .when(d <= 10, "watch")
        .otherwise("none")
    )
    return (
        staged.withColumns(
            {
                "target_status": status,
                "alert_status": alert,
                "_a": F.when(d.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.greatest(d, F.lit(0.0)) * 5))),
            }
        )
        .withColumn("target_attractiveness", float_round(c("_a"), 1))
        .drop("_d", "_a")
    )


def technical_score(df: DataFrame) -> DataFrame:
    """Oversold score from rsi14, drawdown60d_pct and relative_sector5d_pct; needs 60 days of history."""
    parts = {
        "_rsi": clip((50 - c("rsi14")) / 20, 0.0, 1.0),
        "_dd": clip(((-c("drawdown60d_pct") / 100) - 0.05) / 0.20, 0.0, 1.0),
        "_lag": clip(((-c("relative_sector5d_pct") / 100) - 0.02) / 0.08, 0.0, 1.0),
    }
    enough = c("history_days") >= 60
    staged = df.withColumns(parts).withColumn(
        "_t", F.when(enough, 100 * (0.40 * c("_rsi") + 0.35 * c("_dd") + 0.25 * c("_lag")))
    )
    return staged.withColumns(
        {
            "technical": float_round(c("_t"), 1),
            "technical_oversold": F.when(c("_t").isNotNull(), (c("rsi14") <= 40) | (c("drawdown60d_pct") <= -10)),
            "component_rsi": F.when(enough, float_round(c("_rsi"), 3)),
            "component_drawdown": F.when(enough, float_round(c("_dd"), 3)),
            "component_relative_lag": F.when(enough, float_round(c("_lag"), 3)),
        }
    ).drop("_rsi", "_dd", "_lag", "_t")


def issuer_changes(securities: DataFrame) -> DataFrame:
    """Issuer-level daily change: exact median over its securities (safe for an issuer with very many)."""
    return exact_median(securities, ["sector", "issuer_id"], "daily_change_pct", "change_pct")


def sector_base(securities: DataFrame, signals: DataFrame) -> DataFrame:
    """Per sector: issuers, quote coverage, breadth of the day and heat eligibility.

    ``securities`` needs sector, issuer_id, daily_change_pct; ``signals`` one row per sector with the
    five signal fields, issuerCount, coveredIssuerCount and coveragePct.
    """
    per_issuer = securities.groupBy("sector", "issuer_id").agg(F.count(F.lit(1)).alias("members"))
    joined = per_issuer.join(issuer_changes(securities), ["sector", "issuer_id"], "left")
    v = c("change_pct")
    g = joined.groupBy("sector").agg(
        F.sum("members").alias("security_count"),
        F.count(F.lit(1)).alias("issuer_count"),
        F.count(v).alias("quoted_issuer_count"),
        F.count(F.when(v > 0, 1)).alias("advancers"),
        F.count(F.when(v < 0, 1)).alias("decliners"),
        F.sum(v.cast("decimal(18,6)")).alias("_sum"),
    )
    s = g.join(signals, "sector", "left")
    staged = s.withColumns(
        {
            "unchanged": c("quoted_issuer_count") - c("advancers") - c("decliners"),
            "_avg": ratio(c("_sum"), c("quoted_issuer_count")),
            "_breadth": ratio(c("advancers"), c("quoted_issuer_count")) * 100,
            "_quoted": ratio(c("quoted_issuer_count"), c("issuer_count")) * 100,
            "heat_issuer_count": F.when(
                c("issuerCount") >= 0, F.least(c("issuer_count"), c("issuerCount").cast("bigint"))
            ).otherwise(c("issuer_count")),
            "_cov": F.least(c("coveredIssuerCount").cast("bigint"), c("issuer_count")) / c("issuer_count") * 100,
        }
    )
    cov = F.when(c("coveredIssuerCount") >= 0, float_round(c("_cov"), 2)).otherwise(finite_double(c("coveragePct")))
    staged = staged.withColumn("_hc", cov).withColumn("heat_coverage_pct", F.when(c("_hc").between(0, 100), c("_hc")))
    complete = F.lit(True)
    for f in SIGNAL_FIELDS:
        complete = complete & c(f).isNotNull()
    has_signal = F.coalesce(c("_signal"), F.lit(False)) if "_signal" in signals.columns else F.coalesce(
        *[c(f) for f in SIGNAL_FIELDS], c("issuerCount").cast("double"), c("coveredIssuerCount").cast("double"), c("coveragePct").cast("double")
    ).isNotNull()
    status = (
        F.when(~has_signal, "missing_history")
        .when(c("heat_issuer_count") < 3, "insufficient_issuers")
        .when(c("heat_coverage_pct").isNull() | (c("heat_coverage_pct") < 80), "insufficient_coverage")
        .when(~complete, "incomplete_history")
        .when(~(c("advancers5dPct").between(0, 100) & c("aboveMa20Pct").between(0, 100)), "invalid_history")
        .otherwise("eligible")
    )
    return staged.withColumns(
        {
            "average_daily_change_pct": float_round(c("_avg"), 2),
            "breadth_pct": float_round(c("_breadth"), 2),
            "quote_coverage_pct": float_round(c("_quoted"), 2),
            "heat_status": status,
        }
    ).drop("_sum", "_avg", "_breadth", "_quoted", "_cov", "_hc")


def sector_heat(base: DataFrame) -> DataFrame:
    """Heat score among the eligible sectors from average-rank percentiles of the five signals.

    The sector table is a dimension (one row per sector), so ranking it in one partition is bounded.
    """
    eligible = F.col("heat_status") == "eligible"
    masked = base.withColumns({f"_v_{f}": F.when(eligible, c(f)) for f in SIGNAL_FIELDS}).withColumn(
        "_part", eligible.cast("int")
    )
    ranked = masked.withColumns({f"_p_{f}": average_rank_percentile(f"_v_{f}", "_part") for f in SIGNAL_FIELDS})
    score = sum((c(f"_p_{f}") * F.lit(w) for f, w in P.SECTOR_HEAT_WEIGHTS.items()), F.lit(0.0))
    staged = ranked.withColumn("_heat", F.when(eligible, score))
    label = F.when(c("_heat").isNull(), "数据不足")
    for low, name in P.HEAT_LABELS:
        label = label.when(c("_heat") >= low, name)
    staged = staged.withColumns(
        {
            "heat_score": float_round(c("_heat"), 1),
            "heat_label": label.otherwise(P.HEAT_LABEL_LOWEST),
            "heat_status": F.when(eligible, "computed").otherwise(c("heat_status")),
        }
        | {f"pct_{f}": float_round(c(f"_p_{f}"), 1) for f in SIGNAL_FIELDS}
    )
    order = Window.partitionBy(c("heat_score").isNull()).orderBy(F.desc("heat_score"), "sector")
    return staged.withColumn("rank", F.when(c("heat_score").isNotNull(), F.row_number().over(order))).drop(
        "_heat", "_part", *[f"_v_{f}" for f in SIGNAL_FIELDS], *[f"_p_{f}" for f in SIGNAL_FIELDS]
    )


def build_watchlist(securities: DataFrame, heat: DataFrame) -> DataFrame:
    """Yield model, target state, technical score and their combinations with the sector heat."""
    staged = technical_score(target_state(yield_model(securities)))
    joined = staged.join(heat.select("sector", "heat_score", c("heat_status").alias("sector_heat_status")), "sector", "left")
    complete = c("technical").isNotNull() & c("heat_score").isNotNull() & c("target_attractiveness").isNotNull()
    labels = F.lit(None).cast("double")
    for k, v in P.VALUATION_LABEL_SCORES.items():
        labels = F.when(F.lower("valuation_status") == k, F.lit(v)).otherwise(labels)
    paused = F.coalesce(c("recommendation_paused"), F.lit(False)) if "recommendation_paused" in joined.columns else F.lit(False)
    hot = (
        (c("heat_score") >= 60)
        & F.coalesce(c("distance_pct") <= 10, F.lit(False))
        & F.coalesce(c("relative_sector5d_pct") <= -3, F.lit(False))
        & F.coalesce(c("technical_oversold"), F.lit(False))
        & ~paused
    )
    return (
        joined.withColumns(
            {
                "_ot": F.when(
                    complete, c("target_attractiveness") * 0.55 + c("technical") * 0.30 + c("heat_score") * 0.15
                ),
                "_ed": clip(c("shareholder_yield_pct") / 8, 0.0, 1.0) * 10,
            }
        )
        .withColumns(
            {
                "opportunity_score": c("target_attractiveness"),
                "opportunity_technical": float_round(c("_ot"), 1),
                "expected_dividend": float_round(c("_ed"), 1),
                "valuation_points": labels,
                "hot_sector_dislocation": F.when(complete, hot),
                "contrarian_low_price": F.when(
                    c("heat_score").isNotNull(), (c("heat_score") < 40) & (c("target_status") == "reached")
                ),
            }
        )
        .drop("_ot", "_ed")
    )


def best_first() -> Column:
    """Order of the top opportunity: highest score, then nearest target, then name."""
    return F.struct(
        (-c("opportunity_score")).alias("a"), F.coalesce(c("distance_pct"), F.lit(float("inf"))).alias("b"), c("name").alias("c")
    )


def target_counts() -> list[Column]:
    n = lambda s: F.count(F.when(c("target_status") == s, 1))
    scored = F.when(c("opportunity_score").isNotNull(), best_first())
    return [
        n("reached").alias("reached"),
        n("within_3").alias("within3"),
        n("within_10").alias("within10"),
        F.sum(c("distance_pct").cast("decimal(18,2)")).alias("_ds"),
        F.count("distance_pct").alias("_dn"),
        F.sum(c("opportunity_score").cast("decimal(18,1)")).alias("_os"),
        F.count("opportunity_score").alias("_on"),
        F.min_by("security_id", scored).alias("top_id"),
        F.max("opportunity_score").alias("top_score"),
    ]


def summarize(watch: DataFrame) -> DataFrame:
    """Whole-list summary in one aggregate."""
    n = lambda cond: F.count(F.when(cond, 1))
    have = lambda x: c(x).isNotNull() if x in watch.columns else F.lit(False)
    complete = F.lit(True)
    for k in ("pe", "pe_ttm", "pb", "dividend_yield_ttm_pct", "total_market_value", "earnings_per_share", "book_value_per_share"):
        complete = complete & have(k)
    g = watch.agg(
        F.count(F.lit(1)).alias("total_securities"),
        n(c("target_preferred").isNotNull()).alias("target_configured"),
        n(c("current_price").isNotNull()).alias("price_available"),
        n(have("pe_ttm") | have("pe")).alias("pe_available"),
        n(have("pb")).alias("pb_available"),
        n(complete).alias("metric_complete"),
        n(c("target_status") == "unconfigured").alias("unconfigured"),
        n(c("hot_sector_dislocation")).alias("hot_sector_dislocations"),
        *target_counts(),
    )
    return _averages(g).withColumns(
        {
            "at_or_within3": c("reached") + c("within3"),
            "at_or_within10": c("reached") + c("within3") + c("within10"),
        }
    )


def _averages(g: DataFrame) -> DataFrame:
    return (
        g.withColumns({"_da": ratio(c("_ds"), c("_dn")), "_oa": ratio(c("_os"), c("_on"))})
        .withColumns({"average_distance_pct": float_round(c("_da"), 2), "average_opportunity": float_round(c("_oa"), 1)})
        .drop("_ds", "_dn", "_os", "_on", "_da", "_oa")
    )


def rank_sectors(watch: DataFrame, heat: DataFrame) -> DataFrame:
    """Sector roll-up beside its heat and rank."""
    g = _averages(watch.groupBy("sector").agg(*target_counts()))
    return heat.select("sector", "heat_score", "heat_label", "rank").join(g, "sector", "left")


def market_status(securities: DataFrame) -> DataFrame:
    """open if any quote is open, closed if all are closed, else unknown; per market."""
    g = securities.groupBy("market").agg(
        F.max(c("market_state") == "open").alias("o"), F.min(c("market_state") == "closed").alias("k")
    )
    return g.select("market", F.when(c("o"), "open").when(c("k"), "closed").otherwise("unknown").alias("status"))


def overall_status(markets: DataFrame) -> DataFrame:
    g = markets.agg(
        F.max(c("status") == "open").alias("o"), F.min(c("status") == "closed").alias("k"), F.count(F.lit(1)).alias("markets")
    )
    return g.select(
        F.when(c("markets") == 0, "unconfigured").when(c("o"), "open").when(c("k"), "closed").otherwise("unknown").alias("status"),
        "markets",
    )


def target_lines(watch: DataFrame) -> DataFrame:
    """Three rows per security: key, label, local and CNY target."""
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("key"),
                F.lit(label).alias("label"),
                c(f"target_{name}").alias("price"),
                c(f"target_{name}_cny").alias("price_cny"),
            )
            for name, label, _ in P.TARGETS
        ]
    )
    return watch.select("security_id", "currency", F.explode(lines).alias("l")).select("security_id", "currency", "l.*")


def filter_list(df: DataFrame, query: str = "", **equal: str) -> DataFrame:
    """Case-folded text search over five columns and any number of equality filters."""
    out = df
    needle = query.strip().lower()
    if needle:
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(c(x), F.lit("")) for x in ("name", "ticker", "market", "sector", "industry")]))
        out = out.where(hay.contains(needle))
    for name, value in equal.items():
        if value:
            out = out.where(c(name) == value)
    return out


def sort_list(df: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Missing values last in both directions, name breaks ties."""
    first = c(key).desc_nulls_last() if descending else c(key).asc_nulls_last()
    return df.orderBy(first, "name")


def candidates(watch: DataFrame, view: str) -> DataFrame:
    """price: within ten percent; technical: hot-sector dislocation; contrarian: cold sector at target."""
    if view == "price":
        return watch.where(c("distance_pct") <= 10)
    if view == "technical":
        return watch.where(c("hot_sector_dislocation"))
    if view == "contrarian":
        return watch.where(c("contrarian_low_price") | ((c("target_status") == "reached") & (c("heat_score") < 40)))
    raise ValueError(f"unknown view {view}")


def alerts(watch: DataFrame) -> DataFrame:
    return watch.where(c("alert_status").isin("buy_zone", "approaching", "watch"))


def select_one(df: DataFrame, selector: str, columns: tuple[str, ...]) -> DataFrame:
    """One row: how many rows match the selector in any id column, and the match itself (null unless unique)."""
    hit = F.lit(False)
    for x in columns:
        hit = hit | (c(x) == selector)
    found = df.where(hit).agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct(*df.columns)).alias("match"))
    return found.withColumn("match", F.when(c("hits") == 1, c("match")))


def yield_basis(rows: DataFrame) -> DataFrame:
    """Mean yearly cash return per share, by the best available source of each security.

    ``rows``: security_id, source_priority (1 = best), year, per_share.
    """
    g = rows.groupBy("security_id", "source_priority").agg(
        F.sum(c("per_share").cast("decimal(28,12)")).alias("_s"),
        F.count("per_share").alias("window_years"),
        F.min("year").alias("start_year"),
        F.max("year").alias("end_year"),
    )
    basis = g.withColumn("basis", F.round(ratio(c("_s"), c("window_years")).cast("decimal(38,12)"), 12).cast("double")).drop("_s")
    best = F.row_number().over(Window.partitionBy("security_id").orderBy("source_priority"))
    return basis.withColumn("_k", best).where("_k = 1").drop("_k")


def join_quotes(watch: DataFrame, quotes: DataFrame) -> DataFrame:
    """Left join on the quote code; a missing quote leaves an unavailable status, duplicates are reported by R01."""
    joined = watch.join(quotes, "quote_code", "left")
    return joined.withColumn("quote_status", F.when(c("current_price").isNotNull(), "available").otherwise("unavailable"))


def historical_yield(prices: DataFrame, targets: DataFrame) -> DataFrame:
    """Weekly yield series from the four-percent target price."""
    joined = prices.join(targets.select("security_id", "target_preferred"), "security_id")
    return joined.withColumn("_y", c("target_preferred") * 4 / c("close").cast("double")).withColumn(
        "yield_pct", float_round(c("_y"), 4)
    ).drop("_y", "target_preferred")
