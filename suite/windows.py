"""Window, sort and top-k operators over derived bars."""

from pyspark.sql import Window, functions as F

from barloom import SERIES, testbed as T
from barloom.functions import shanghai_text
from barloom.operators import blocks, indicators as I, intraday, macd, paging

from .base import DAILY, MINUTES, MONTHLY, SESSION, registry

REGISTRY, query = registry()
W = "PARTITION BY symbol ORDER BY date"


def _win(expr, n_first, n_last):
    return f"{expr} OVER ({W} ROWS BETWEEN {n_first} PRECEDING AND {n_last})"


@query("e01_moving_average", f"""WITH {DAILY}
SELECT symbol, date, CASE WHEN count(*) OVER w20 = 20 THEN round(avg(close) OVER w20, 4) END AS ma20,
  CASE WHEN count(*) OVER w60 = 60 THEN round(avg(close) OVER w60, 4) END AS ma60
FROM bars WINDOW w20 AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
  w60 AS ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def moving_average(spark, d):
    b = I.moving_average(I.moving_average(T.daily_bars(spark, d), n=20), n=60)
    return b.select("symbol", "date", F.round("ma_close_20", 4).alias("ma20"), F.round("ma_close_60", 4).alias("ma60"))


@query("e02_volume_ma", f"""WITH {DAILY}
SELECT symbol, date, CASE WHEN count(*) OVER w = 5 THEN round(avg(volume_shares) OVER w, 4) END AS volume_ma5
FROM bars WINDOW w AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def volume_ma(spark, d):
    b = I.volume_ma(T.daily_bars(spark, d), 5)
    return b.select("symbol", "date", F.round("volume_ma_5", 4).alias("volume_ma5"))


@query("e03_change_pct", f"""WITH {DAILY}
SELECT symbol, date, round((close / lag(close, 5) OVER ({W}) - 1) * 100, 6) AS change_pct5 FROM bars""")
def change_pct(spark, d):
    b = I.change_pct(T.daily_bars(spark, d), 5)
    return b.select("symbol", "date", F.round("change_pct_5", 6).alias("change_pct5"))


@query("e04_prior_high", f"""WITH {DAILY}
SELECT symbol, date, CASE WHEN count(*) OVER w = 20 THEN max(high) OVER w END AS prior_high20
FROM bars WINDOW w AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def prior_high(spark, d):
    b = I.prior_high(T.daily_bars(spark, d), 20)
    return b.select("symbol", "date", F.col("prior_high_20").alias("prior_high20"))


@query("e05_volume_ratio", f"""WITH {DAILY}
SELECT symbol, date, CASE WHEN count(*) OVER w = 20
  THEN round(volume_shares / nullif(avg(volume_shares) OVER w, 0), 6) END AS volume_ratio20
FROM bars WINDOW w AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def volume_ratio(spark, d):
    b = I.volume_ratio(T.daily_bars(spark, d), 20)
    return b.select("symbol", "date", F.round("volume_ratio_20", 6).alias("volume_ratio20"))


@query("e06_ma_slope", f"""WITH {DAILY}, m AS (SELECT symbol, date,
  CASE WHEN count(*) OVER a = 20 THEN avg(close) OVER a END AS now20,
  CASE WHEN count(*) OVER b = 20 THEN avg(close) OVER b END AS then20
FROM bars WINDOW a AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
  b AS ({W} ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING))
SELECT symbol, date, now20 > then20 AS ma20_rising, round(100 * (now20 / then20 - 1), 4) AS ma20_change_5_pct FROM m""")
def ma_slope(spark, d):
    b = I.slope(T.daily_bars(spark, d), n=20, lag=5)
    return b.select("symbol", "date", "ma20_rising", F.round("ma20_change_5_pct", 4).alias("ma20_change_5_pct"))


@query("e07_cross", f"""WITH {DAILY}, m AS (SELECT symbol, date, close,
  CASE WHEN count(*) OVER a = 20 THEN max(high) OVER a END AS level
FROM bars WINDOW a AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, lag(close) OVER ({W}) AS c0, lag(level) OVER ({W}) AS l0 FROM m)
SELECT symbol, date, c0 <= l0 AND close > level AS cross_above, c0 >= l0 AND close < level AS cross_below FROM l""")
def cross(spark, d):
    b = I.prior_high(T.daily_bars(spark, d), 20, name="level")
    b = I.cross(I.cross(b, "close", "level", "above"), "close", "level", "below")
    return b.select("symbol", "date", "cross_above", "cross_below")


_MACD_SQL = """
idx AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars),
lists AS (SELECT symbol, list(close ORDER BY i) AS c, list(date ORDER BY i) AS ds, count(*) AS n FROM idx GROUP BY symbol),
rec(symbol, i, fast, slow, dea) AS (
  SELECT symbol, CAST(1 AS BIGINT), c[1], c[1], CAST(0 AS DOUBLE) FROM lists
  UNION ALL
  SELECT symbol, i + 1, f, s, dea + 2.0 / 10.0 * ((f - s) - dea)
  FROM (SELECT r.symbol, r.i, r.dea,
      r.fast + CAST(2 AS DOUBLE) / 13 * (l.c[r.i + 1] - r.fast) AS f,
      r.slow + CAST(2 AS DOUBLE) / 27 * (l.c[r.i + 1] - r.slow) AS s
    FROM rec r JOIN lists l USING (symbol) WHERE r.i < l.n))"""


@query("e08_macd", f"""WITH RECURSIVE {DAILY}, {_MACD_SQL}
SELECT r.symbol, idx.date, round(fast - slow, 6) AS dif, round(dea, 6) AS dea,
  round(2 * ((fast - slow) - dea), 6) AS macd_histogram
FROM rec r JOIN idx ON idx.symbol = r.symbol AND idx.i = r.i""")
def macd_all(spark, d):
    b = macd.macd(T.daily_bars(spark, d))
    return b.select("symbol", "date", *[F.round(c, 6).alias(c) for c in ("dif", "dea", "macd_histogram")])


@query("e08_macd_long_series", f"""WITH RECURSIVE {MINUTES},
bars AS (SELECT symbol, minute AS date, last_cents / 100 AS close FROM points), {_MACD_SQL}
SELECT r.symbol, idx.date AS minute, round(fast - slow, 6) AS dif, round(dea, 6) AS dea,
  round(2 * ((fast - slow) - dea), 6) AS macd_histogram
FROM rec r JOIN idx ON idx.symbol = r.symbol AND idx.i = r.i""")
def macd_long(spark, d):
    p = T.minute_points(spark, d).select("symbol", "minute", (F.col("last_cents") / 100).alias("close"))
    p = blocks.with_row_index(p, ["symbol"], ["minute"], F.to_date("minute"))
    out = macd.macd_long(p, keys=["symbol"])
    return out.select("symbol", "minute", *[F.round(c, 6).alias(c) for c in ("dif", "dea", "macd_histogram")])


@query("e01_moving_average_long_series", f"""WITH {MINUTES}
SELECT symbol, minute, CASE WHEN count(*) OVER w = 250 THEN round(avg(last_cents) OVER w, 4) END AS ma250,
  max(high_cents) OVER (PARTITION BY symbol ORDER BY minute ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS high60
FROM points WINDOW w AS (PARTITION BY symbol ORDER BY minute ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)""")
def moving_average_long(spark, d):
    p = T.minute_points(spark, d)
    p = blocks.with_row_index(p, ["symbol"], ["minute"], F.to_date("minute"))
    p = blocks.with_halo(p, reach=249, block=1024)
    keys = ["symbol", "block_id"]
    p = I.moving_average(p, "last_cents", 250, "ma", keys, "row_index")
    p = p.withColumn("high60", F.max("high_cents").over(I.Series(keys, "row_index").rows(-60, -1)))
    return p.filter(~F.col("is_halo")).select("symbol", "minute", F.round("ma", 4).alias("ma250"), "high60")


_INTRADAY_SQL = """
s AS (SELECT symbol, CAST(minute AS DATE) AS session_date, minute, last_cents, sum_cents, n FROM points),
cum AS (SELECT *, CAST(sum(n) OVER (PARTITION BY symbol, session_date, hour(minute) >= 12 ORDER BY minute) AS BIGINT) AS cumulative_volume,
  CAST(sum(sum_cents) OVER (PARTITION BY symbol, session_date ORDER BY minute) AS BIGINT) AS cumulative_amount FROM s)"""


def _cumulative(spark, d):
    """Cumulative minute series; the volume counter resets at noon."""
    p = T.minute_points(spark, d).withColumn("session_date", F.to_date("minute"))
    half = Window.partitionBy("symbol", "session_date", F.hour("minute") >= 12).orderBy("minute")
    day = Window.partitionBy("symbol", "session_date").orderBy("minute")
    return (
        p.withColumn("cumulative_volume_shares", F.sum("n").over(half))
        .withColumn("cumulative_amount_cny", F.sum("sum_cents").over(day))
        .withColumn("price", F.col("last_cents") / 100)
    )


@query("e09_interval_difference", f"""WITH {MINUTES}, {_INTRADAY_SQL},
l AS (SELECT *, lag(cumulative_volume) OVER w AS v0, lag(cumulative_amount) OVER w AS a0, lag(minute) OVER w AS m0
  FROM cum WINDOW w AS (PARTITION BY symbol, session_date ORDER BY minute))
SELECT symbol, minute, CASE WHEN cumulative_volume >= v0 THEN cumulative_volume - v0 END AS interval_volume_shares,
  CASE WHEN cumulative_amount >= a0 THEN cumulative_amount - a0 END AS interval_amount_cny,
  CAST(date_diff('minute', m0, minute) AS DOUBLE) AS interval_minutes FROM l""")
def interval_difference(spark, d):
    out = intraday.with_interval_differences(_cumulative(spark, d))
    return out.select("symbol", "minute", "interval_volume_shares", "interval_amount_cny", "interval_minutes")


@query("e10_gap_classification", f"""WITH {MINUTES},
l AS (SELECT symbol, minute, lag(minute) OVER (PARTITION BY symbol ORDER BY minute) AS m0 FROM points),
g AS (SELECT *, date_diff('minute', m0, minute) AS gap FROM l WHERE m0 IS NOT NULL AND date_diff('minute', m0, minute) > 1),
k AS (SELECT *, CASE WHEN CAST(m0 AS DATE) <> CAST(minute AS DATE) THEN 'session_boundary'
  WHEN strftime(m0, '%H:%M') BETWEEN '11:25' AND '11:30' AND strftime(minute, '%H:%M') BETWEEN '13:00' AND '13:05'
  THEN 'scheduled_lunch' ELSE 'unexplained_gap' END AS kind FROM g)
SELECT symbol, strftime(m0, '%Y-%m-%dT%H:%M:%S+08:00') AS gap_from, strftime(minute, '%Y-%m-%dT%H:%M:%S+08:00') AS gap_to, CAST(gap AS DOUBLE) AS elapsed_minutes, kind,
  CASE WHEN kind = 'unexplained_gap' THEN CAST(gap - 1 AS DOUBLE) END AS missing_minutes FROM k""")
def gap_classification(spark, d):
    g = intraday.gap_audit(T.minute_points(spark, d), expected_minutes=1, keys=["symbol"])
    return g.withColumn("gap_from", shanghai_text(F.col("gap_from"))).withColumn("gap_to", shanghai_text(F.col("gap_to")))


@query("e11_competition_rank", """WITH s AS (SELECT p_brand || '/' || p_type AS code, CASE WHEN min(p_size) > 5 THEN round(avg(p_retailprice), 2) END AS change_percent
  FROM part GROUP BY ALL)
SELECT code, change_percent, CASE WHEN change_percent IS NOT NULL THEN rank() OVER (ORDER BY change_percent DESC NULLS LAST) END AS rank_descending FROM s""")
def competition_rank(spark, d):
    """Every brand and type; a group with a part of size 5 or less has no change."""
    from barloom.operators import context

    s = T.table(spark, d, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("code")).agg(
        F.when(F.min("p_size") > 5, F.round(F.avg("p_retailprice"), 2)).alias("change_percent"))
    ranked = context.rank_sectors(s, expected_size=None)
    return ranked.select("code", "change_percent", F.col("rank_descending").cast("long").alias("rank_descending"))


@query("e12_breakout_kind", f"""WITH {DAILY}, m AS (SELECT symbol, date, close,
  CASE WHEN count(*) OVER a = 20 THEN max(high) OVER a END AS h,
  CASE WHEN count(*) OVER b = 20 THEN max(high) OVER b END AS h0, lag(close) OVER ({W}) AS c0
FROM bars WINDOW a AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS ({W} ROWS BETWEEN 21 PRECEDING AND 2 PRECEDING))
SELECT symbol, date, CASE WHEN close > h THEN CASE WHEN c0 > h0 THEN 'repeated' ELSE 'fresh' END END AS breakout_kind FROM m""")
def breakout_kind(spark, d):
    return I.breakout_kind(T.daily_bars(spark, d), 20).select("symbol", "date", "breakout_kind")


@query("e13_average_price", f"""WITH {MINUTES}, {_INTRADAY_SQL}
SELECT symbol, minute, CASE WHEN cumulative_volume > 0
  THEN round(cumulative_amount / cumulative_volume, 6) END AS average_price_cny FROM cum""")
def average_price(spark, d):
    out = intraday.with_average_price(_cumulative(spark, d))
    return out.select("symbol", "minute", F.round("average_price_cny", 6).alias("average_price_cny"))


_LAST_SQL = f"""WITH {DAILY}
SELECT symbol, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 30"""


@query("e14_last_n", _LAST_SQL)
def last_n(spark, d):
    return I.last_n(T.daily_bars(spark, d), 30).select("symbol", "date", "close")


@query("e15_offset_access", f"""WITH {DAILY}
SELECT symbol, date, lag(close, 250) OVER ({W}) AS close_back_250, lag(volume_shares, 1) OVER ({W}) AS volume_back_1 FROM bars""")
def offset_access(spark, d):
    b = I.shift(T.daily_bars(spark, d), "close", 250)
    b = I.shift(b, "volume_shares", 1, "volume_back_1")
    return b.select("symbol", "date", "close_back_250", "volume_back_1")


@query("e17_extension", f"""WITH {DAILY}
SELECT symbol, date, CASE WHEN count(*) OVER w = 20 THEN round(100 * (close / avg(close) OVER w - 1), 4) END AS extension_ma20_pct
FROM bars WINDOW w AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def extension(spark, d):
    b = I.extension(T.daily_bars(spark, d), 20)
    return b.select("symbol", "date", F.round("extension_ma20_pct", 4).alias("extension_ma20_pct"))


@query("e18_quote_change", """SELECT o_orderkey, round(o_totalprice - c_acctbal, 2) AS change,
  CASE WHEN c_acctbal > 0 THEN round((o_totalprice - c_acctbal) / c_acctbal * 100, 3) END AS change_percent
FROM orders JOIN customer ON o_custkey = c_custkey""")
def quote_change(spark, d):
    o = T.table(spark, d, "orders").join(T.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    q = I.quote_change(o, "o_totalprice", "c_acctbal")
    return q.select("o_orderkey", F.round("change", 2).alias("change"), F.round("change_percent", 3).alias("change_percent"))


@query("j04_macd_panel", f"""WITH RECURSIVE {DAILY},
recent AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 370),
{_MACD_SQL.replace('FROM bars)', 'FROM recent)')}
SELECT r.symbol, idx.date, round(fast - slow, 3) AS dif, round(dea, 3) AS dea, round(2 * ((fast - slow) - dea), 3) AS macd_histogram,
  greatest(l.n - 120, 0) AS warmup_bars, greatest(l.n - 120, 0) < 250 AS seed_sensitive
FROM rec r JOIN idx ON idx.symbol = r.symbol AND idx.i = r.i JOIN lists l ON l.symbol = r.symbol WHERE r.i > l.n - 120""")
def macd_panel(spark, d):
    b = macd.macd_panel(T.daily_bars(spark, d), limit=120)
    return b.select("symbol", "date", *[F.round(c, 3).alias(c) for c in ("dif", "dea", "macd_histogram")],
                    "warmup_bars", "seed_sensitive")


@query("j05_ma_panel", f"""WITH {DAILY}, m AS (SELECT symbol, date, close, """ + ", ".join(
    f"CASE WHEN count(*) OVER w{n} = {n} THEN round(avg(close) OVER w{n}, 4) END AS ma{n}" for n in (5, 10, 20)) + f"""
FROM bars WINDOW """ + ", ".join(f"w{n} AS ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 10, 20)) + """)
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 120""")
def ma_panel(spark, d):
    b = I.ma_panel(T.daily_bars(spark, d))
    return b.select("symbol", "date", "close", *[F.round(f"ma{n}", 4).alias(f"ma{n}") for n in (5, 10, 20)])


@query("f01_chronological_last", f"""WITH {MONTHLY}
SELECT symbol, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 12""")
def chronological_last(spark, d):
    return I.last_n(T.monthly_bars(spark, d), 12).orderBy("symbol", "date").select("symbol", "date", "close")


@query("f02_sector_leaders", """WITH s AS (SELECT p_brand || '/' || p_type AS code, round(avg(p_retailprice), 2) AS change_percent
  FROM part GROUP BY 1)
SELECT * FROM (SELECT 'leaders' AS direction, code, change_percent FROM s ORDER BY change_percent DESC, code LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'laggards', code, change_percent FROM s ORDER BY change_percent, code LIMIT 10)""")
def sector_top(spark, d):
    from barloom.operators import context

    s = T.table(spark, d, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("code")).agg(
        F.round(F.avg("p_retailprice"), 2).alias("change_percent"))
    return context.sector_leaders(s, 10).select("direction", "code", "change_percent")


_ARCHIVE_KEYS = "symbol = 'sh600000'"


@query("f03_archive_page", f"""WITH {DAILY}
SELECT date, close, count(*) OVER () > 50 AS has_more FROM
 (SELECT date, close FROM bars WHERE symbol = 'sh600000' AND date < DATE '2000-01-01' ORDER BY date DESC LIMIT 51)
QUALIFY row_number() OVER (ORDER BY date DESC) <= 50""")
def archive_page(spark, d):
    b = T.daily_bars(spark, d).filter(F.col("symbol") == "sh600000")
    return paging.page_before(b, "date", F.lit("2000-01-01").cast("date"), 50).select("date", "close", "has_more")


@query("f04_page_after", """SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey > 100
ORDER BY c_custkey LIMIT 100""")
def page_after(spark, d):
    c = T.table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    return paging.page_after(c, "c_custkey", F.lit(100), 100).select("c_custkey", "c_name")


@query("f05_batch_cursor", """SELECT s_suppkey, s_name, CASE WHEN (SELECT count(*) FROM supplier WHERE s_suppkey > 3) > 20 THEN (SELECT max(s_suppkey) FROM
  (SELECT s_suppkey FROM supplier WHERE s_suppkey > 3 ORDER BY s_suppkey LIMIT 20)) END AS next_after
FROM supplier WHERE s_suppkey > 3 ORDER BY s_suppkey LIMIT 20""")
def batch_cursor(spark, d):
    s = T.table(spark, d, "supplier")
    return paging.page_after(s, "s_suppkey", F.lit(3), 20, cursor="next_after").select("s_suppkey", "s_name", "next_after")


@query("f06_process_budget", """SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY p_partkey) > 150
  THEN 'unprocessed' ELSE 'processed' END AS state FROM part""")
def process_budget(spark, d):
    p = T.table(spark, d, "part").select("p_partkey")
    return paging.with_budget(p, "p_partkey", 150).select("p_partkey", F.col("state"))


@query("f07_offset_page", """SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100 OFFSET 40""")
def offset_page(spark, d):
    return paging.offset_page(T.table(spark, d, "part"), "p_partkey", 40, 100).select("p_partkey", "p_name")


@query("f09_result_order", f"""WITH {DAILY}, m AS (SELECT symbol, date,
  100 * (close / lag(close, 5) OVER ({W}) - 1) > 20 AS flagged FROM bars)
SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY coalesce(flagged, false), symbol) AS position FROM m""")
def result_order(spark, d):
    b = I.change_pct(T.daily_bars(spark, d), 5)
    b = b.withColumn("risk_flags", F.array_compact(F.array(F.when(F.col("change_pct_5") > 20, "RAPID_5_BAR_ADVANCE"))))
    return paging.result_order(b, ["date"], "symbol").select("symbol", "date", F.col("position").cast("long").alias("position"))


@query("f10_batch_assignment", """SELECT p_partkey, CAST(floor((row_number() OVER (ORDER BY p_partkey) - 1) / 20) AS BIGINT) AS batch_id
FROM part""")
def batch_assignment(spark, d):
    p = T.table(spark, d, "part").select("p_partkey")
    return paging.with_batches(p, "p_partkey", 20).select("p_partkey", "batch_id")
