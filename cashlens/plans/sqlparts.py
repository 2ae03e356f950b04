"""Shared common table expressions of the comparison SQL, written independently of the plans."""

from __future__ import annotations

from cashlens.functions import policy as P

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, body: str, *deps: str) -> None:
    PARTS[name] = (deps, body)


def with_parts(names: tuple[str, ...] | list[str] | str, body: str) -> str:
    """Prefix ``body`` with the named parts and all parts they depend on."""
    wanted = [names] if isinstance(names, str) else list(names)
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in PARTS[n][0]:
            visit(d)
        order.append(n)

    for n in wanted:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order)
    return f"WITH {ctes}\n{body}"


def rnd(x: str, digits: int) -> str:
    return f"CAST(round(CAST(CAST({x} AS DOUBLE) * 1.00000000000001::DOUBLE AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def fround(x: str, digits: int) -> str:
    """Round a double by its exact binary value."""
    q = f"{float(10 ** digits)!r}::DOUBLE"
    hi = f"({x} * 134217729.0::DOUBLE - ({x} * 134217729.0::DOUBLE - {x}))"
    err = f"(({hi} * {q} - {x} * {q}) + ({x} - {hi}) * {q})"
    lean = f"(CASE WHEN {x} * {q} - floor({x} * {q}) = 0.5 THEN sign({err}) * 0.25::DOUBLE ELSE 0.0::DOUBLE END)"
    return f"(round_even({x} * {q} + {lean}, 0) / {q})"


def m(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def clip(x: str, lo: float | str = 0.0, hi: float | str = 100.0) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END)"


def knots(x: str, points, digits: int | None = 2) -> str:
    """Interpolation between knots, flat outside."""
    out = f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {points[0][0]} THEN {float(points[0][1])}"
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        slope = f"CAST({float(y0)} AS DOUBLE) + ({x} - CAST({float(x0)} AS DOUBLE)) / CAST({float(x1) - float(x0)!r} AS DOUBLE) * CAST({float(y1) - float(y0)} AS DOUBLE)"
        out += f" WHEN {x} < {x1} THEN {slope} WHEN {x} = {x1} THEN {float(y1)}"
    out += f" ELSE {float(points[-1][1])} END"
    return rnd(f"({out})", digits) if digits is not None else f"({out})"


def at_most(x: str, steps, above: float) -> str:
    out = f"CASE WHEN {x} IS NULL THEN NULL"
    for limit, score in steps:
        out += f" WHEN {x} <= {limit} THEN {float(score)}"
    return f"CAST({out} ELSE {above} END AS DOUBLE)"


def at_least(x: str, steps, below: float) -> str:
    out = f"CASE WHEN {x} IS NULL THEN NULL"
    for limit, score in steps:
        out += f" WHEN {x} >= {limit} THEN {float(score)}"
    return f"CAST({out} ELSE {below} END AS DOUBLE)"


part(
    "security",
    """
SELECT s_suppkey AS security_id, s_name AS name, n_name AS issuer_id, r_name AS sector,
       CASE WHEN r_name IN ('AFRICA','AMERICA') THEN 'CN' WHEN r_name IN ('ASIA','EUROPE') THEN 'HK'
            WHEN r_name = 'MIDDLE EAST' THEN 'US' ELSE 'UNKNOWN' END AS market,
       CASE WHEN r_name IN ('AFRICA','AMERICA') THEN 'CNY' WHEN r_name IN ('ASIA','EUROPE') THEN 'HKD'
            WHEN r_name = 'MIDDLE EAST' THEN 'USD' ELSE '' END AS currency,
       s_acctbal AS acctbal
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
part(
    "weekly_price",
    f"""
SELECT l_suppkey AS security_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS week,
       CAST(round(CAST({d(f"sum({m('l_extendedprice')})")} / {d(f"sum({m('l_quantity')})")} AS DECIMAL(38,12)), 4) AS DECIMAL(18,4)) AS "close"
FROM lineitem GROUP BY 1, 2""",
)
part(
    "ranked_price",
    """
SELECT security_id, week, "close",
       row_number() OVER (PARTITION BY security_id ORDER BY week DESC) AS rn,
       lead("close") OVER (PARTITION BY security_id ORDER BY week DESC) AS older
FROM weekly_price""",
    "weekly_price",
)
part(
    "price_sums",
    """
SELECT security_id,
       max("close") FILTER (WHERE rn = 1) AS last, max("close") FILTER (WHERE rn = 2) AS prev,
       max("close") FILTER (WHERE rn = 6) AS p5, max("close") FILTER (WHERE rn = 21) AS p20,
       sum("close") FILTER (WHERE rn <= 20) AS sum20, count(*) FILTER (WHERE rn <= 20) AS n20,
       max("close") FILTER (WHERE rn <= 60) AS max60,
       coalesce(sum("close" - older) FILTER (WHERE rn <= 14 AND "close" > older), 0) AS gain,
       coalesce(sum(older - "close") FILTER (WHERE rn <= 14 AND "close" < older), 0) AS loss,
       count(*) AS history_weeks
FROM ranked_price GROUP BY security_id""",
    "ranked_price",
)
part(
    "price_feature",
    f"""
SELECT security_id, {d('last')} AS last, {d('prev')} AS prev,
       {rnd(f"({d('last')} / {d('prev')} - 1) * 100", 4)} AS return1d_pct,
       {rnd(f"({d('last')} / {d('p5')} - 1) * 100", 4)} AS return5d_pct,
       {rnd(f"({d('last')} / {d('p20')} - 1) * 100", 4)} AS return20d_pct,
       {d('last')} > {d('sum20')} / n20 AS above_ma20,
       {rnd(f"({d('last')} / {d('max60')} - 1) * 100", 4)} AS drawdown60d_pct,
       {rnd(f"{d('gain')} / {d('nullif(gain + loss, 0)')} * 100", 4)} AS rsi14,
       history_weeks
FROM price_sums""",
    "price_sums",
)
part(
    "yearly_cash",
    f"""
SELECT l_suppkey AS security_id, year(l_shipdate) AS fiscal_year,
       round(CAST({d(f"sum({m('l_extendedprice')} * {m('l_discount')})")} / {d(f"sum({m('l_quantity')})")} AS DECIMAL(38,12)), 6) AS per_share
FROM lineitem GROUP BY 1, 2""",
)
part(
    "yield_basis",
    f"""
SELECT security_id, {rnd(f"{d('sum(per_share)')} / count(per_share)", 6)} AS basis, count(*) AS window_years,
       min(fiscal_year) AS start_year, max(fiscal_year) AS end_year
FROM yearly_cash GROUP BY security_id""",
    "yearly_cash",
)
part(
    "order_flow",
    f"""
SELECT l_orderkey,
       sum({m('l_extendedprice')}) FILTER (WHERE l_returnflag = 'N') AS n_amount,
       sum({m('l_extendedprice')}) FILTER (WHERE l_returnflag = 'R') AS r_amount,
       sum({m('l_extendedprice')}) FILTER (WHERE l_returnflag = 'A') AS a_amount,
       sum({m('l_quantity')}) FILTER (WHERE l_returnflag = 'R') AS r_quantity,
       sum({m('l_quantity')}) FILTER (WHERE l_returnflag = 'A') AS a_quantity
FROM lineitem GROUP BY l_orderkey""",
)
part(
    "company_year",
    f"""
SELECT o_custkey AS company_id, year(o_orderdate) AS fiscal_year,
       sum({m('o_totalprice')}) FILTER (WHERE o_orderstatus IN ('F','P')) AS ordinary_dividend,
       CASE WHEN bool_or(o_orderstatus = 'F') THEN 'PAID' WHEN bool_or(o_orderstatus = 'P') THEN 'SHAREHOLDER_APPROVED' ELSE 'PROPOSED' END AS ordinary_dividend_status,
       sum({m('o_totalprice')}) FILTER (WHERE o_orderpriority = '1-URGENT') AS special_dividend,
       sum({m('o_totalprice')}) FILTER (WHERE o_orderpriority = '2-HIGH') AS asset_sale_distribution,
       sum({m('o_totalprice')}) FILTER (WHERE o_orderpriority = '5-LOW') AS one_off_buyback,
       sum(r_amount) AS gross_cancelled_buyback, sum(r_quantity) AS cancelled_shares,
       sum(r_quantity) - sum(a_quantity) AS diluted_net_share_reduction,
       sum(n_amount) AS operating_cash_flow, sum(r_amount) AS capital_expenditure,
       sum(a_amount) AS lease_principal_repayment, sum(n_amount) - sum(a_amount) AS net_profit,
       sum({m('o_totalprice')}) FILTER (WHERE o_orderstatus = 'F') AS cash,
       sum({m('o_totalprice')}) FILTER (WHERE o_orderstatus = 'O') AS interest_bearing_debt,
       sum({m('o_totalprice')}) FILTER (WHERE o_orderstatus = 'P') AS total_equity,
       sum({m('o_totalprice')}) AS total_assets,
       sum({m('o_totalprice')}) FILTER (WHERE o_orderstatus IN ('O','F')) AS total_liabilities
FROM orders LEFT JOIN order_flow ON o_orderkey = l_orderkey GROUP BY 1, 2""",
    "order_flow",
)
part("industry", "SELECT c_custkey AS company_id, c_name AS name, c_mktsegment AS industry FROM customer")
part(
    "event_observation",
    """
SELECT sha256(CAST(user_id AS VARCHAR) || '|' || event_type) AS event_key, user_id AS issuer_id, event_type,
       sha256(props) AS payload_hash, props AS payload, ts AS observed_at, event_id AS batch_seq, value
FROM events""",
)
part(
    "eligible_year",
    """
SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC) AS rn
FROM company_year
WHERE make_date(fiscal_year, 12, 31) <= DATE '2001-11-04'
  AND ordinary_dividend_status IN ('PAID','SHAREHOLDER_APPROVED','LEGAL_COMMITMENT','NO_DISTRIBUTION')
  AND ordinary_dividend >= 0
QUALIFY rn <= 10""",
    "company_year",
)
part(
    "coverage_year",
    """
SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC) AS rn
FROM company_year
WHERE make_date(fiscal_year, 12, 31) <= DATE '2001-11-04'
  AND operating_cash_flow IS NOT NULL AND capital_expenditure >= 0
QUALIFY rn <= 5""",
    "company_year",
)
part(
    "run_year",
    """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC) AS rn,
                      max(fiscal_year) OVER (PARTITION BY company_id) AS newest FROM company_year)
WHERE rn <= 5 AND fiscal_year = newest - rn + 1""",
    "company_year",
)


def changes(v: str) -> str:
    return (
        f"list_filter(list_transform(range(1, len({v})), lambda i: CASE WHEN {v}[i] <> 0 "
        f"THEN ({v}[i + 1] - {v}[i]) / abs({v}[i]) END), lambda x: x IS NOT NULL)"
    )


def median(v: str) -> str:
    return f"list_aggregate({v}, 'median')"


def cagr(v: str) -> str:
    return f"(pow({v}[len({v})] / {v}[1], CAST(1 AS DOUBLE) / (len({v}) - 1)) - 1)"


def trend(v: str) -> str:
    raw = (
        f"(CASE WHEN len({v}) < 2 THEN CAST(0 AS DOUBLE) WHEN {v}[1] > 0 AND {v}[len({v})] > 0 THEN {cagr(v)} "
        f"ELSE coalesce({median(changes(v))}, 0) END)"
    )
    return clip(raw, -0.20, 0.20)


def growth(v: str) -> str:
    raw = (
        f"(CASE WHEN len({v}) < 2 THEN NULL WHEN list_aggregate({v}, 'min') > 0 THEN {cagr(v)} "
        f"ELSE {median(changes(v))} END)"
    )
    return clip(raw, -0.08, 0.06)


# The four-percent policy numbers used by several parts.
CASH_ANCHOR = P.THRESHOLDS["cash_anchor_yield"]
