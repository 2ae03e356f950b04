"""Quote rows: vendor field aliases, market state, time zones, freshness, listing codes, FX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashlens.functions.numeric import finite_double, float_round, lit_null

# Vendor market-state tokens.
OPEN_STATES = (
    "OPEN", "AUCTION", "MORNING", "AFTERNOON", "PRE_MARKET_BEGIN", "AFTER_HOURS_BEGIN", "NIGHT_OPEN",
    "FUTURE_DAY_OPEN", "HK_CAS", "FUTURE_AFTERNOON", "FUTURE_OPEN", "FUTURE_BREAK_OVER",
    "STIB_AFTER_HOURS_BEGIN", "NIGHT", "TRADE_AT_LAST", "OVERNIGHT",
)
CLOSED_STATES = (
    "CLOSED", "REST", "NONE", "WAITING_OPEN", "PRE_MARKET_END", "AFTER_HOURS_END", "NIGHT_END",
    "FUTURE_DAY_BREAK", "FUTURE_DAY_CLOSE", "FUTURE_DAY_WAIT_OPEN", "FUTURE_NIGHT_WAIT",
    "FUTURE_SWITCH_DATE", "FUTURE_BREAK", "FUTURE_CLOSE", "STIB_AFTER_HOURS_WAIT", "STIB_AFTER_HOURS_END",
)
TRADING_WORDS = ("open", "trading", "morning", "afternoon")
# Trading sessions in UTC minutes of the day.
SESSIONS = {"HK": ((90, 240), (300, 480)), "CN": ((90, 210), (300, 420))}
FRESH_SECONDS = 600
CLOSED_MAX_SECONDS = 4 * 24 * 3600
FX_MAX_AGE_SECONDS = 6 * 3600

# Metric name -> (snake name, camel name, sign rule).
SNAPSHOT_FIELDS = {
    "pe": ("pe_ratio", "peRatio", "positive"),
    "peTtm": ("pe_ttm_ratio", "peTtmRatio", "positive"),
    "pb": ("pb_ratio", "pbRatio", "positive"),
    "dividendYieldTtmPct": ("dividend_ratio_ttm", "dividendRatioTtm", "nonnegative"),
    "totalMarketValue": ("total_market_val", "totalMarketVal", "positive"),
    "earningsPerShare": ("earning_per_share", "earningPerShare", "any"),
    "bookValuePerShare": ("net_asset_per_share", "netAssetPerShare", "any"),
}


def alias_column(df: DataFrame, *names: str) -> Column:
    """First of the named columns that exists and holds a value."""
    present = [F.col(n).cast("double") for n in names if n in df.columns]
    return F.coalesce(*present) if present else lit_null()


def snapshot_metrics(df: DataFrame) -> DataFrame:
    """Vendor snapshot rows to the metric contract, with the sign rule of each field."""
    out = {}
    for name, (snake, camel, rule) in SNAPSHOT_FIELDS.items():
        v = finite_double(alias_column(df, snake, camel))
        if rule == "positive":
            v = F.when(v > 0, v)
        elif rule == "nonnegative":
            v = F.when(v >= 0, v)
        out[name] = v
    return df.withColumns(out)


def daily_change(rate: Column, last: Column, previous: Column) -> Column:
    """Vendor change rate, else the change from the previous close, in percent.

    Staged callers should pass plain columns.
    """
    derived = F.when((last > 0) & (previous > 0), (last - previous) / previous * 100)
    return float_round(F.coalesce(finite_double(rate), derived), 4)


def market_state(raw: Column) -> Column:
    token = F.element_at(F.split(F.upper(F.trim(raw)), r"\."), -1)
    return F.when(token.isin(*OPEN_STATES), "open").when(token.isin(*CLOSED_STATES), "closed").otherwise("unknown")


def quote_timestamp(raw: Column, quote_code: Column) -> Column:
    """Quote time in UTC; a time without offset is local to the market of the code prefix."""
    text = F.trim(raw)
    blank = text.isNull() | text.isin("", "N/A", "--")
    zone = F.when(F.substring_index(quote_code, ".", 1) == "US", "America/New_York").otherwise("Asia/Shanghai")
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    # the zone is part of the text that is read, so the session's zone has no say
    local = F.concat(text.try_cast("timestamp_ntz").cast("string"), F.lit(" "), zone)
    return F.when(blank, F.lit(None).cast("timestamp")).when(zoned, text.try_cast("timestamp")).otherwise(
        local.try_cast("timestamp")
    )


def utc_seconds(now: Column) -> Column:
    return F.unix_seconds(now.cast("timestamp"))


def utc_date(now: Column) -> Column:
    """Date on the UTC clock, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(utc_seconds(now) / 86_400).cast("int"))


def weekdays_between(start: Column, end: Column) -> Column:
    """Weekdays in (start, end], from whole weeks plus the remainder; no list of days is built."""
    days = F.greatest(F.datediff(end, start), F.lit(0))
    whole = F.floor(days / 7)
    rest = days - whole * 7
    first = F.weekday(start)  # 0 = Monday
    extra = sum((F.when((rest >= k) & (F.pmod(first + k, F.lit(7)) < 5), 1).otherwise(0) for k in range(1, 7)), F.lit(0))
    return (whole * 5 + extra).cast("int")


def expected_open(now: Column, market: Column) -> Column:
    """Inside a trading session of the market (UTC clock, lunch break out), on a weekday."""
    seconds = F.pmod(utc_seconds(now), F.lit(86_400))
    inside = F.lit(False)
    for name, spans in SESSIONS.items():
        hit = F.lit(False)
        for low, high in spans:
            hit = hit | ((seconds >= low * 60) & (seconds <= high * 60))
        inside = inside | ((market == name) & hit)
    return (F.weekday(utc_date(now)) < 5) & inside


def seconds_between(start: Column, end: Column) -> Column:
    to_micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (to_micros(end) - to_micros(start)) / 1_000_000


def freshness(quote: Column, collected: Column, state: Column, market: Column, now: Column) -> Column:
    """CURRENT, MARKET_CLOSED_CURRENT or STALE_LAST_GOOD."""
    age = seconds_between(quote, now)
    trading = F.lower(F.trim(state)).isin(*TRADING_WORDS) | expected_open(now, market)
    quiet = (age <= CLOSED_MAX_SECONDS) & (weekdays_between(utc_date(quote), utc_date(now)) <= 1)
    return (
        F.when(quote.isNull() | collected.isNull() | (quote > now) | (collected > now), "STALE_LAST_GOOD")
        .when(trading & (age <= FRESH_SECONDS), "CURRENT")
        .when(trading, "STALE_LAST_GOOD")
        .when(quiet, "MARKET_CLOSED_CURRENT")
        .otherwise("STALE_LAST_GOOD")
    )


def fx_to_base(currency: Column, hkd_cny: Column) -> Column:
    """CNY is 1, HKD the given rate, any other currency unknown."""
    return F.when(currency == "CNY", F.lit(1.0)).when((currency == "HKD") & (hkd_cny > 0), hkd_cny.cast("double"))


def cross_rate(rates: DataFrame) -> DataFrame:
    """CNY per HKD from rows (as_of, currency, rate) of EUR rates, eight digits."""
    pick = lambda x: F.max(F.when(F.col("currency") == x, F.col("rate").cast("double")))
    g = rates.groupBy("as_of").agg(pick("CNY").alias("cny"), pick("HKD").alias("hkd"))
    return g.where((F.col("cny") > 0) & (F.col("hkd") > 0)).withColumn("ratio", F.col("cny") / F.col("hkd")).select(
        "as_of", float_round(F.col("ratio"), 8).alias("rate")
    )


def fx_age_class(fetched_at: Column, now: Column) -> Column:
    """cached while young enough, else stale_cache (fetching a new rate is the caller's job)."""
    return F.when(fetched_at.isNull(), lit_null("string")).when(
        seconds_between(fetched_at, now) <= FX_MAX_AGE_SECONDS, "cached"
    ).otherwise("stale_cache")


def latest_fx(rates: DataFrame, now: Column) -> DataFrame:
    """Newest fetched rate per pair with its age class."""
    g = rates.groupBy("pair").agg(F.max_by("rate", "fetched_at").alias("rate"), F.max("fetched_at").alias("fetched_at"))
    return g.withColumn("fx_status", fx_age_class(F.col("fetched_at"), now))


def a_share_fields(code: Column) -> dict[str, Column]:
    """Id, quote code and ticker of a mainland listing; an invalid code gives nulls."""
    ticker = F.when(F.length(F.trim(code)) <= 6, F.lpad(F.trim(code), 6, "0"))
    ok = ticker.rlike(r"^\d{6}$")
    exchange = F.when(ticker.rlike("^[03]"), "SZ").otherwise("SH")
    return {
        "security_id": F.when(ok, F.concat(exchange, ticker)),
        "quote_code": F.when(ok, F.concat_ws(".", exchange, ticker)),
        "ticker": F.when(ok, ticker),
        "market": F.when(ok, "CN"),
        "currency": F.when(ok, "CNY"),
    }


def h_share_fields(code: Column) -> dict[str, Column]:
    """Id, quote code and ticker of a Hong Kong listing; an invalid code gives nulls."""
    raw = F.trim(code)
    ok = raw.rlike(r"^\d{1,5}$")
    number = F.when(ok, raw).try_cast("int").cast("string")
    return {
        "security_id": F.when(ok, F.concat(F.lit("HK"), F.lpad(number, F.greatest(F.length(number), F.lit(4)), F.lit("0")))),
        "quote_code": F.when(ok, F.concat(F.lit("HK."), F.lpad(raw, 5, "0"))),
        "ticker": F.when(ok, F.lpad(number, 5, "0")),
        "market": F.when(ok, "HK"),
        "currency": F.when(ok, "HKD"),
    }
