"""Text building blocks for the SQL of the panel queries (for an independent engine)."""

from __future__ import annotations

ORDER = "row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)"
BARS = f"""bars AS (
  SELECT ticker, date, arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS close,
    sum(l_quantity) AS volume, sum(l_extendedprice) / sum(l_quantity) AS vwap, count(*)::DOUBLE AS transactions
  FROM (SELECT l_suppkey::VARCHAR AS ticker, date_trunc('week', l_shipdate)::DATE AS date, l_extendedprice / l_quantity AS price, {ORDER} AS o, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 0)
  GROUP BY ticker, date
), master AS (
  SELECT s_suppkey::VARCHAR AS ticker, s_name AS name, s_acctbal AS market_cap, n_name AS industry, r_name AS sector
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
), sbars AS (SELECT bars.*, sector, industry, market_cap FROM bars LEFT JOIN master USING (ticker))"""
TICKS = """ticks AS (
  SELECT user_id::VARCHAR AS ticker, ts::DATE AS date, ts, date_trunc('minute', ts) AS minute, event_id, value AS trade_price,
    (props::JSON ->> '$.k')::DOUBLE AS trade_size, value * (props::JSON ->> '$.k')::DOUBLE AS trade_notional,
    CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END::DOUBLE AS off_exchange_flag, CASE WHEN event_type = 'view' THEN 0.0 ELSE 1.0 END::DOUBLE AS lit_exchange_flag
  FROM events
)"""
PO = "PARTITION BY ticker ORDER BY date"
ALL = f"({PO} ROWS UNBOUNDED PRECEDING)"


def offset(digits: int) -> float:
    return 3.7e-4 * 10.0**-digits


def rounded(x: str, digits: int = 6) -> str:
    return f"round(({x})::DOUBLE + {offset(digits)!r}::DOUBLE, {digits}) + 0.0"


def frame(n: int, skip: int = 0) -> str:
    return f"({PO} ROWS BETWEEN {n - 1 + skip} PRECEDING AND {skip if skip else 'CURRENT ROW'}{' PRECEDING' if skip else ''})"


def roll(f: str, x: str, n: int, least: int | None = None, skip: int = 0) -> str:
    w = frame(n, skip)
    return f"(CASE WHEN count({x}) OVER {w} >= {n if least is None else least} THEN {f}({x}) OVER {w} END)"


def mean(x, n, least=None, skip=0):
    return roll("avg", x, n, least, skip)


def std(x, n, least=None, skip=0):
    return roll("stddev_samp", x, n, least, skip)


def total(x, n, least=None, skip=0):
    return roll("sum", x, n, least, skip)


def low(x, n, least=None, skip=0):
    return roll("min", x, n, least, skip)


def high(x, n, least=None, skip=0):
    return roll("max", x, n, least, skip)


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({PO})" if k >= 0 else f"lead({x}, {-k}) OVER ({PO})"


def div(a: str, b: str, tiny: float = 0) -> str:
    return f"(CASE WHEN abs({b}) > {tiny!r} THEN ({a}) / ({b}) END)"


def clip(x: str, a: float | None = None, b: float | None = None) -> str:
    y = x if a is None else f"greatest({x}, {a})"
    y = y if b is None else f"least({y}, {b})"
    return f"(CASE WHEN ({x}) IS NOT NULL THEN {y} END)"


def z(x: str, n: int, least: int | None = None, floor: float | None = None) -> str:
    s = std(x, n, least)
    return div(f"{x} - {mean(x, n, least)}", s if floor is None else clip(s, floor))


def zero(x: str) -> str:
    return f"coalesce({x}, 0)"


def log(x: str, tiny: float = 0) -> str:
    return f"(CASE WHEN {x} > {tiny!r} THEN ln({x}) END)"


def slope(y: str, n: int) -> str:
    w = frame(n)
    return f"(CASE WHEN count({y}) OVER {w} = {n} THEN regr_slope({y}, _i) OVER {w} END)"


def r2(y: str, n: int) -> str:
    w = frame(n)
    return f"(CASE WHEN count({y}) OVER {w} = {n} THEN CASE WHEN var_pop({y}) OVER {w} = 0 THEN 0 ELSE regr_r2({y}, _i) OVER {w} END END)"


def corr(x: str, y: str, n: int, least: int) -> str:
    w = frame(n)
    return f"(CASE WHEN count({x} + {y}) OVER {w} >= {least} THEN CASE WHEN isfinite(corr({x}, {y}) OVER {w}) THEN corr({x}, {y}) OVER {w} END END)"


def ewm(x: str, alpha: float, least: int) -> str:
    """For series whose NULLs all come first."""
    return f"(CASE WHEN count({x}) OVER {ALL} >= {least} THEN list_reduce(list_filter(list({x}) OVER {ALL}, lambda v: v IS NOT NULL), lambda a, v: a * (1 - {alpha!r}::DOUBLE) + v * {alpha!r}::DOUBLE) END)"


def rank(x: str, *by: str, descending: bool = False) -> str:
    g = ", ".join(by)
    known = " AND ".join(f"{b} IS NOT NULL" for b in (x, *by))
    way = "DESC" if descending else "ASC"
    return f"(CASE WHEN {known} THEN (rank() OVER (PARTITION BY {g} ORDER BY {x} {way} NULLS LAST) + (count(*) OVER (PARTITION BY {g}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {g}) END)"


def group_z(x: str, *by: str, least: int = 2) -> str:
    g = f"(PARTITION BY {', '.join(by)})"
    return f"(CASE WHEN count({x}) OVER {g} >= {least} THEN {div(f'{x} - avg({x}) OVER {g}', f'stddev_samp({x}) OVER {g}')} END)"


def chain(base: str, *levels: dict[str, str], start: str = "bars", keys: str = "ticker, date", out: list[str] | None = None, digits: int = 6, where: str = "", places: dict[str, int] | None = None) -> str:
    """CTE levels, each adding columns to the one before; the outermost rounds the columns ``out``."""
    ctes, last = [base], start
    for k, level in enumerate(levels):
        ctes.append(f"l{k} AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in level.items())} FROM {last})")
        last = f"l{k}"
    out = out if out is not None else [c for level in levels for c in level if not c.startswith("_")]
    return f"WITH {', '.join(ctes)} SELECT {keys}, {', '.join(f'{rounded(c, (places or {}).get(c, digits))} AS {c}' for c in out)} FROM {last} {where}"
