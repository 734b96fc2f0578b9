"""Registration helper and SQL fragments shared by the oracle queries."""


def registry():
    entries = {}

    def query(key, sql=None):
        def wrap(fn):
            entries[key] = (fn, sql)
            return fn

        return wrap

    return entries, query


def code_sql(n: str) -> str:
    return (
        "(['sh600','sh601','sh603','sh605','sz000','sz001','sz002','sz003']"
        f"[CAST(floor((({n}) % 8000) / 1000) AS INT) + 1] || lpad(CAST(({n}) % 1000 AS VARCHAR), 3, '0'))"
    )


def _bars_sql(symbol: str, day: str) -> str:
    return f"""
raw AS (SELECT {symbol} AS symbol, CAST({day} AS DATE) AS date,
    floor((l_extendedprice / l_quantity) * 100) / 100 AS price, l_quantity AS volume,
    (l_orderkey * 8 + l_linenumber) * 4194304 + l_partkey % 4194304 AS seq FROM lineitem),
bars AS (SELECT symbol, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, seq) AS close, sum(volume) AS volume_shares FROM raw GROUP BY symbol, date)"""


DAILY = _bars_sql(code_sql("l_suppkey"), "l_shipdate")
MONTHLY = _bars_sql(code_sql("l_suppkey"), "date_trunc('month', l_shipdate)")
SESSION = _bars_sql(code_sql("CAST(floor(l_suppkey / 4) AS BIGINT)"), "date_trunc('week', l_shipdate)")
SESSION_MONTH = _bars_sql(
    code_sql("CAST(floor(l_suppkey / 4) AS BIGINT)"), "date_trunc('month', date_trunc('week', l_shipdate))"
)

MINUTES = """
points AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS minute,
    CAST(arg_max(round(value * 100), ts) AS BIGINT) AS last_cents,
    CAST(arg_min(round(value * 100), ts) AS BIGINT) AS first_cents,
    CAST(max(round(value * 100)) AS BIGINT) AS high_cents,
    CAST(min(round(value * 100)) AS BIGINT) AS low_cents,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS sum_cents,
    count(*) AS n FROM events GROUP BY 1, 2)"""


def calendar_sql(spec: dict, name="cal") -> str:
    """CTE with one row per covered date of a testbed calendar."""
    weekdays = spec.get("open_weekdays", (0, 1, 2, 3, 4))
    closed = " OR ".join(f"d BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in spec["closed_ranges"]) or "false"
    days = ", ".join(str(w + 1) for w in weekdays)
    return f"""
{name} AS (SELECT CAST(d AS DATE) AS date,
    isodow(d) IN ({days}) AND NOT ({closed}) AS is_trading
    FROM generate_series(DATE '{spec["start"]}', DATE '{spec["end"]}', INTERVAL 1 DAY) t(d))"""
