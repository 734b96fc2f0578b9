"""Capture decoding: texts are built from the tables, then decoded again."""

from pyspark.sql import functions as F

from barloom import testbed as T
from barloom.functions import shanghai_text
from barloom.operators import context as X
from barloom.sources import bars as B, captures as K, directory as D, quotes as Q, sectors as S, store as ST

from .base import DAILY, MINUTES, MONTHLY, calendar_sql, registry
from .calendars import DIM, _completion_sql, _latest_sql, _done

REGISTRY, query = registry()
CAL = calendar_sql(T.DAILY_CALENDAR)
money = lambda c: F.format_string("%.2f", c)
whole = lambda c: F.format_string("%d", F.col(c).cast("long") if isinstance(c, str) else c.cast("long"))


def _joined(parts, sep):
    return F.array_join(F.array(*[p if not isinstance(p, str) else F.lit(p) for p in parts]), sep)


def _quote_base(spark, d):
    b = T.daily_bars(spark, d).withColumn("n", F.unix_date("date").cast("long"))
    return b.withColumn("fetched_at", F.expr("timestamp_seconds((n + 2) * 86400)"))


_N = "(date - DATE '1970-01-01')"


@query("a01_tilde_quotes", f"""WITH {DAILY}, q AS (SELECT *, {_N} AS n FROM bars),
r AS (SELECT *, CASE WHEN n % 17 = 2 THEN 'SYMBOL_NOT_RETURNED' WHEN n % 7 = 3 OR n % 13 = 6 THEN 'INVALID_TENCENT_QUOTE'
  WHEN n % 23 = 1 THEN 'INVALID_SOURCE_TIMESTAMP' WHEN n % 11 = 5 THEN 'INVALID_QUOTE_OHLC' END AS reason,
  CASE WHEN n % 5 = 0 THEN close ELSE high END AS up, CASE WHEN n % 5 = 1 THEN close ELSE low END AS down FROM q)
SELECT symbol, date, reason, CASE WHEN reason IS NULL THEN close END AS price, CASE WHEN reason IS NULL THEN volume_shares * 100 END AS volume_shares,
  CASE WHEN reason IS NULL THEN CASE WHEN n % 19 = 4 THEN volume_shares * 10000 ELSE volume_shares * 7 END END AS amount_cny,
  CASE WHEN reason IS NULL THEN 300.0::DOUBLE END AS third_bid_shares,
  CASE WHEN reason IS NULL AND high <= up AND low >= down AND up > down THEN CASE WHEN close = up THEN 'at_upper_limit' WHEN close = down THEN 'at_lower_limit' ELSE 'between_limits' END END AS price_relation
FROM r""")
def tilde_quotes(spark, d):
    out = Q.decode_quote_columns(_tilde_raw(spark, d), "tencent")
    ok = F.col("reason").isNull()
    return out.select("symbol", "date", "reason", *[F.when(ok, F.col(c)).alias(c) for c in ("price", "volume_shares", "amount_cny", "price_relation")],
                      F.when(ok, F.get("book.bids", F.lit(2))["volume_shares"]).alias("third_bid_shares"))


def _tilde_raw(spark, d):
    b = _quote_base(spark, d)
    n = F.col("n")
    close, high, low = F.col("close"), F.col("high"), F.col("low")
    lots = whole("volume_shares")
    detail = F.when(n % 19 == 4, _joined([money(close), lots], "/")).otherwise(_joined([money(close), lots, whole(F.col("volume_shares") * 7)], "/"))
    f = [""] * 49
    f[0], f[1] = "1", F.concat(F.lit("Name "), F.col("symbol"))
    f[2] = F.when(n % 13 == 6, "999999").otherwise(F.substring("symbol", 3, 6))
    f[3] = F.when(n % 7 == 3, "").otherwise(money(close))
    f[4], f[5], f[6] = money(F.col("open")), money(F.col("open")), lots
    for i in range(5):
        f[9 + 2 * i], f[10 + 2 * i], f[19 + 2 * i], f[20 + 2 * i] = money(low), str(i + 1), money(high), str(i + 1)
    f[30] = F.when(n % 23 == 1, "20010230150000").otherwise(F.concat(F.date_format("date", "yyyyMMdd"), F.lit("150000")))
    f[33] = F.when(n % 11 == 5, "0.01").otherwise(money(high))
    f[34], f[35], f[37] = money(low), detail, lots
    f[47] = money(F.when(n % 5 == 0, close).otherwise(high))
    f[48] = money(F.when(n % 5 == 1, close).otherwise(low))
    shown = F.when(n % 17 == 2, "sh999999").otherwise(F.col("symbol"))
    body = F.concat(F.lit('v_pv_none="1";\nv_'), shown, F.lit('="'), _joined(f, "~"), F.lit('";\n'))
    return b.select("symbol", "date", "fetched_at", body.alias("body"))


@query("a02_comma_quotes", f"""WITH {DAILY}, q AS (SELECT *, {_N} AS n FROM bars),
r AS (SELECT *, CASE WHEN n % 7 = 3 THEN 'INVALID_SINA_QUOTE' WHEN n % 11 = 5 THEN 'FUTURE_SOURCE_TIMESTAMP' WHEN n % 13 = 6 THEN 'INVALID_BOOK_VALUES' END AS reason FROM q)
SELECT symbol, date, reason, CASE WHEN reason IS NULL THEN close END AS price, CASE WHEN reason IS NULL THEN volume_shares END AS volume_shares,
  CASE WHEN reason IS NULL THEN strftime(date, '%Y-%m-%dT15:00:03+08:00') END AS source_timestamp, CASE WHEN reason IS NULL THEN high END AS first_ask FROM r""")
def comma_quotes(spark, d):
    b = _quote_base(spark, d)
    n = F.col("n")
    f = [""] * 33
    f[0] = F.concat(F.lit("名称"), F.col("symbol"))
    f[1], f[2], f[3] = money(F.col("open")), money(F.col("open")), F.when(n % 7 == 3, "0").otherwise(money(F.col("close")))
    f[4], f[5], f[8], f[9] = money(F.col("high")), money(F.col("low")), whole("volume_shares"), whole("volume_shares")
    for i in range(5):
        f[10 + 2 * i], f[11 + 2 * i] = str(100 * i), money(F.col("low"))
        f[20 + 2 * i], f[21 + 2 * i] = F.when(n % 13 == 6, "x").otherwise(str(100 * i)), money(F.col("high"))
    f[30] = F.when(n % 11 == 5, F.date_add("date", 9).cast("string")).otherwise(F.col("date").cast("string"))
    f[31] = "15:00:03"
    body = F.concat(F.lit("var hq_str_"), F.col("symbol"), F.lit('="'), _joined(f, ","), F.lit('";'))
    raw = b.select("symbol", "date", "fetched_at", body.alias("body"))
    out = Q.decode_quote_columns(raw, "sina")
    ok = F.col("reason").isNull()
    return out.select("symbol", "date", "reason", F.when(ok, F.col("price")).alias("price"), F.when(ok, F.col("volume_shares")).alias("volume_shares"),
                      F.when(ok, shanghai_text(F.col("source_timestamp"))).alias("source_timestamp"),
                      F.when(ok, F.get("book.asks", F.lit(0))["price"]).alias("first_ask"))


@query("b08_price_limits", f"""WITH {DAILY}, r AS (SELECT *, CASE WHEN {_N} % 5 = 0 THEN close ELSE high END AS up,
  CASE WHEN {_N} % 5 = 1 THEN close ELSE low END AS down FROM bars)
SELECT symbol, date, CASE WHEN high <= up AND low >= down AND up > down THEN CASE WHEN close = up THEN 'at_upper_limit' WHEN close = down THEN 'at_lower_limit' ELSE 'between_limits' END END AS price_relation FROM r""")
def limits(spark, d):
    n = F.unix_date("date")
    b = T.daily_bars(spark, d).withColumn("price", F.col("close"))
    b = b.withColumn("_up", F.when(n % 5 == 0, F.col("close")).otherwise(F.col("high"))).withColumn("_down", F.when(n % 5 == 1, F.col("close")).otherwise(F.col("low")))
    return Q.price_limits(b).select("symbol", "date", "price_relation")


def _minute_raw(spark, d):
    p = T.minute_points(spark, d).withColumn("day", F.to_date("minute"))
    bad = (F.dayofmonth("day") % 7 == 3) & (F.hour("minute") == 23)
    row = F.struct(
        F.date_format("minute", "yyyy-MM-dd HH:mm:ss").alias("day"), money(F.col("first_cents") / 100).alias("open"),
        money(F.col("high_cents") / 100).alias("high"), money(F.col("low_cents") / 100).alias("low"), money(F.col("last_cents") / 100).alias("close"),
        F.when(bad, "-1").otherwise(whole("n")).alias("volume"))
    g = p.groupBy("symbol", "day").agg(F.collect_list(row).alias("rows"))
    return g.select(F.concat_ws("/", "symbol", "day").alias("capture_id"), "symbol", F.col("day").alias("session_date"),
                    F.concat(F.lit("/*x*/=("), F.to_json("rows"), F.lit(");")).alias("body"))


_MIN_CUT = "TIMESTAMP '2024-01-20 12:00:30'"
_A03 = f"""WITH {MINUTES}, p AS (SELECT *, CAST(minute AS DATE) AS session_date FROM points),
bad AS (SELECT DISTINCT symbol, session_date FROM p WHERE day(minute) % 7 = 3 AND hour(minute) = 23),
good AS (SELECT p.*, minute + INTERVAL 3 SECOND < {_MIN_CUT} AS complete FROM p ANTI JOIN bad USING (symbol, session_date))"""


@query("a03_minute_bars", _A03 + """ SELECT symbol, session_date, strftime(minute, '%Y-%m-%dT%H:%M:%S+08:00') AS source_timestamp,
  first_cents / 100 AS open, high_cents / 100 AS high, low_cents / 100 AS low, last_cents / 100 AS close, CAST(n AS DOUBLE) AS volume_shares
FROM good WHERE complete QUALIFY row_number() OVER (PARTITION BY symbol, session_date ORDER BY minute DESC) <= 30""")
def minute_bars(spark, d):
    good, _ = B.decode_minute_bars(_minute_raw(spark, d), F.lit("2024-01-20T12:00:30+08:00").cast("timestamp"), 30)
    return good.select("symbol", "session_date", shanghai_text(F.col("source_timestamp")).alias("source_timestamp"), *B.BAR_FIELDS)


@query("b14_completion_filter", _A03 + """ SELECT symbol, session_date, count(CASE WHEN NOT complete THEN 1 END) AS excluded, count(CASE WHEN complete THEN 1 END) AS completed
FROM good GROUP BY 1, 2 HAVING count(CASE WHEN complete THEN 1 END) > 0""")
def completion_filter(spark, d):
    good, _ = B.decode_minute_bars(_minute_raw(spark, d), F.lit("2024-01-20T12:00:30+08:00").cast("timestamp"), None)
    return good.groupBy("symbol", "session_date").agg(F.max("excluded").cast("long").alias("excluded"), F.count("*").alias("completed"))


@query("a03_minute_quarantine", _A03 + """ SELECT symbol, session_date, 'INVALID_BAR_VALUES' AS reason FROM bad UNION ALL
SELECT symbol, session_date, 'NO_COMPLETED_BARS' FROM good GROUP BY 1, 2 HAVING count(CASE WHEN complete THEN 1 END) = 0""")
def minute_quarantine(spark, d):
    _, bad = B.decode_minute_bars(_minute_raw(spark, d), F.lit("2024-01-20T12:00:30+08:00").cast("timestamp"), 30)
    return bad.select("symbol", "session_date", "reason")


_A04 = f"WITH {MONTHLY}, {CAL}, {DIM}, " + _completion_sql("1mo", "bars", lambda c: f"CAST(date_trunc('month', {c}) AS DATE)").replace("SELECT symbol, date, NOT invalid", ", y AS (SELECT symbol, date, NOT invalid", 1) + ")"


@query("a04_period_history", _A04 + """ SELECT y.symbol, y.date, complete, calendar_completion, completion_basis, observed_latest, open, high, low, close, volume_shares * 100 AS volume_shares
FROM y JOIN bars b ON b.symbol = y.symbol AND b.date = y.date WHERE complete AND (CAST(substr(y.symbol, 8, 1) AS INT) % 2 = 1 OR y.symbol NOT IN (SELECT symbol FROM bars GROUP BY symbol HAVING max(date) > DATE '2001-06-13'))
QUALIFY row_number() OVER (PARTITION BY y.symbol ORDER BY y.date DESC) <= 48""")
def period_history(spark, d):
    good, _ = B.decode_history(_history_raw(spark, d), "tencent", T.dimension(spark, T.DAILY_CALENDAR), F.lit("2001-06-13T12:00:00+08:00").cast("timestamp"), "1mo", "qfq", limit=48)
    return good.select("symbol", "date", "complete", "calendar_completion", "completion_basis", "observed_latest", *B.BAR_FIELDS)


def _history_raw(spark, d):
    # Every second symbol's later months lie in a capture of their own; elsewhere they are future dates of the one capture.
    b = T.monthly_bars(spark, d)
    number = F.substring("symbol", 8, 1).cast("int")
    b = b.withColumn("late", (number % 2 == 1) & (F.col("date") > F.lit("2001-06-01").cast("date")))
    row = F.array(F.col("date").cast("string"), money(F.col("open")), money(F.col("close")), money(F.col("high")), money(F.col("low")), whole("volume_shares"))
    g = b.groupBy("symbol", "late").agg(F.collect_list(row).alias("rows"))
    body = F.to_json(F.struct(F.lit(0).alias("code"), F.create_map("symbol", F.create_map(F.lit("qfqmonth"), "rows")).alias("data")))
    return g.select(F.concat_ws("/", "symbol", F.when(F.col("late"), "late")).alias("capture_id"), "symbol", body.alias("body"))


@query("a04_history_quarantine", f"WITH {MONTHLY} SELECT symbol, 'FUTURE_BAR_DATE' AS reason FROM bars GROUP BY symbol HAVING max(date) > DATE '2001-06-13'")
def history_quarantine(spark, d):
    _, bad = B.decode_history(_history_raw(spark, d), "tencent", T.dimension(spark, T.DAILY_CALENDAR), F.lit("2001-06-13T12:00:00+08:00").cast("timestamp"), "1mo", "qfq")
    return bad.select("symbol", "reason")


_A05 = f"""WITH {DAILY}, {CAL}, y AS (SELECT bars.*, year(bars.date) AS yr, is_trading FROM bars LEFT JOIN cal ON bars.date = cal.date),
caps AS (SELECT *, NOT is_trading AND yr % 5 <> 1 AS apart FROM y), bad AS (SELECT DISTINCT symbol, yr, apart FROM caps WHERE NOT is_trading)"""


def _daily_raw(spark, d):
    cal = T.calendar(spark, T.DAILY_CALENDAR).select("date", "is_trading")
    b = T.daily_bars(spark, d).join(F.broadcast(cal), "date", "left").withColumn("yr", F.year("date"))
    # In four years of five the bars of closed days come in a capture of their own, in the fifth among the others.
    b = b.withColumn("apart", ~F.col("is_trading") & (F.col("yr") % 5 != 1))
    row = F.struct(F.col("date").cast("string").alias("day"), money(F.col("open")).alias("open"), money(F.col("high")).alias("high"),
                   money(F.col("low")).alias("low"), money(F.col("close")).alias("close"), whole("volume_shares").alias("volume"))
    g = b.groupBy("symbol", "yr", "apart").agg(F.collect_list(row).alias("rows"))
    return g.select(F.concat_ws("/", "symbol", "yr", F.when(F.col("apart"), "closed")).alias("capture_id"), "symbol", "yr", F.concat(F.lit("=("), F.to_json("rows"), F.lit(")")).alias("body"))


@query("a05_daily_history", _A05 + " SELECT symbol, yr, date, open, high, low, close, volume_shares FROM caps ANTI JOIN bad USING (symbol, yr, apart)")
def daily_history(spark, d):
    good, _ = B.decode_history(_daily_raw(spark, d), "sina", T.dimension(spark, T.DAILY_CALENDAR), F.lit("2002-01-01T12:00:00+08:00").cast("timestamp"))
    return good.select("symbol", F.col("yr").cast("long").alias("yr"), "date", *B.BAR_FIELDS)


@query("a05_daily_quarantine", _A05 + " SELECT symbol, yr, 'BAR_ON_NONTRADING_DATE' AS reason FROM bad")
def daily_quarantine(spark, d):
    _, bad = B.decode_history(_daily_raw(spark, d), "sina", T.dimension(spark, T.DAILY_CALENDAR), F.lit("2002-01-01T12:00:00+08:00").cast("timestamp"))
    return bad.select("symbol", F.col("yr").cast("long").alias("yr"), "reason")


_A06 = f"""WITH {MINUTES}, s AS (SELECT *, CAST(minute AS DATE) AS session_date FROM points),
c AS (SELECT *, sum(n) OVER (PARTITION BY symbol, session_date, hour(minute) >= 12 ORDER BY minute) * 100.0::DOUBLE AS v,
  CAST(sum(sum_cents) OVER (PARTITION BY symbol, session_date ORDER BY minute) AS DOUBLE) AS a FROM s),
l AS (SELECT *, lag(v) OVER w AS v0, lag(a) OVER w AS a0, lag(minute) OVER w AS m0 FROM c WINDOW w AS (PARTITION BY symbol, session_date ORDER BY minute))"""


def _session_raw(spark, d):
    from .windows import _cumulative

    c = _cumulative(spark, d)
    row = F.array_join(F.array(F.date_format("minute", "HHmm"), money(F.col("price")), whole("cumulative_volume_shares"), whole("cumulative_amount_cny")), " ")
    # Sorting by label keeps the session in order inside its capture.
    g = c.groupBy("symbol", "session_date").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    inner = F.struct(F.struct(F.date_format("session_date", "yyyyMMdd").alias("date"), F.col("rows").alias("data")).alias("data"))
    body = F.to_json(F.struct(F.lit(0).alias("code"), F.create_map(F.col("symbol"), inner).alias("data")))
    return g.select(F.concat_ws("/", "symbol", "session_date").alias("capture_id"), "symbol", body.alias("body"))


@query("a06_minute_session", _A06 + """ SELECT symbol, session_date, strftime(minute, '%Y-%m-%dT%H:%M:%S+08:00') AS source_timestamp, last_cents / 100 AS price,
  v AS cumulative_volume_shares, a AS cumulative_amount_cny, CASE WHEN v >= v0 THEN v - v0 END AS interval_volume_shares, CASE WHEN a >= a0 THEN a - a0 END AS interval_amount_cny,
  CAST(date_diff('minute', m0, minute) AS DOUBLE) AS interval_minutes, round(a / v, 6) AS average_price_cny FROM l WHERE minute + INTERVAL 63 SECOND < TIMESTAMP '2024-01-20 12:00:30'""")
def minute_session(spark, d):
    good, _ = B.decode_intraday(_session_raw(spark, d), F.lit("2024-01-20T12:00:30+08:00").cast("timestamp"))
    return good.select("symbol", "session_date", shanghai_text(F.col("source_timestamp")).alias("source_timestamp"), "price", "cumulative_volume_shares",
                       "cumulative_amount_cny", "interval_volume_shares", "interval_amount_cny", "interval_minutes", F.round("average_price_cny", 6).alias("average_price_cny"))


_CODE = "'sh6000' || lpad(CAST(ascii(event_type) % 100 AS VARCHAR), 2, '0')"


@query("a07_auction_points", f"""WITH o AS (SELECT {_CODE} AS symbol, CAST(ts AS DATE) AS session_date, minute(ts) AS m, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total
  FROM events GROUP BY 1, 2, 3),
bad AS (SELECT DISTINCT symbol, session_date FROM o WHERE m BETWEEN 15 AND 30 AND day(session_date) % 9 = 4)
SELECT symbol, session_date, strftime(CAST(session_date AS TIMESTAMP) + INTERVAL 9 HOUR + m * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S+08:00') AS source_timestamp,
  total / 100 AS observed_price, CASE WHEN total % 3 <> 0 THEN CAST(total * 100 AS DOUBLE) END AS reported_volume_shares,
  CASE WHEN total % 2 = 0 THEN CAST(total AS DOUBLE) END AS reported_amount_cny, CAST(NULL AS DOUBLE) AS final_match_price
FROM o ANTI JOIN bad USING (symbol, session_date) WHERE m BETWEEN 15 AND 30""")
def auction_points(spark, d):
    ev = T.table(spark, d, "events")
    code = F.concat(F.lit("sh6000"), F.lpad((F.ascii("event_type") % 100).cast("string"), 2, "0"))
    g = ev.groupBy(code.alias("symbol"), F.to_date("ts").alias("day"), F.minute("ts").alias("m")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))
    price = money(F.col("total") / 100)
    high = F.when((F.dayofmonth("day") % 9 == 4) & F.col("m").between(15, 30), "0.001").otherwise(price)
    row = _joined([F.concat(F.col("day").cast("string"), F.lit(" 09:"), F.lpad(F.col("m").cast("string"), 2, "0")), price, price, high, price,
                   F.when(F.col("total") % 3 != 0, whole("total")).otherwise(" "), F.when(F.col("total") % 2 == 0, whole("total")).otherwise("")], ",")
    rows = g.groupBy("symbol", "day").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    body = F.to_json(F.struct(F.lit(0).alias("rc"), F.struct(F.substring("symbol", 3, 6).alias("code"), F.lit(1).alias("market"), F.col("rows").alias("trends")).alias("data")))
    raw = rows.select(F.concat_ws("/", "symbol", "day").alias("capture_id"), "symbol", body.alias("body"))
    good, _ = B.decode_auction(raw, F.lit("2024-03-01T00:00:00+08:00").cast("timestamp"))
    return good.select("symbol", "session_date", shanghai_text(F.col("source_timestamp")).alias("source_timestamp"), "observed_price",
                       "reported_volume_shares", "reported_amount_cny", "final_match_price")


_BENCH_LIST = "['" + "','".join(Q.BENCHMARKS) + "','sh999999']"
_A08 = f"""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1),
x AS (SELECT day, n, cents, unnest({_BENCH_LIST}) AS symbol, unnest(range(1, 8)) AS i FROM o),
r AS (SELECT symbol, day, (cents // 100 + i * 7) AS price, (cents // 100 + n) AS prev, CASE WHEN symbol = 'sh999999' THEN 'INVALID_BENCHMARK' WHEN (n + i) % 6 = 2 THEN 'BENCHMARK_NOT_RETURNED'
  WHEN n % 7 = 3 THEN 'INVALID_BENCHMARK_NUMBER' END AS error FROM x)"""


def _benchmarks(spark, d):
    o = T.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    names = F.array(*[F.lit(b) for b in (*Q.BENCHMARKS, "sh999999")])
    x = o.select("day", "n", "cents", F.posexplode(names).alias("i", "symbol")).withColumn("i", F.col("i") + 1)
    base = F.floor(F.col("cents") / 100)
    price, prev = base + F.col("i") * 7, base + F.col("n")
    f = [""] * 40
    f[0], f[1], f[2], f[3], f[4] = "1", "Index", F.substring("symbol", 3, 6), whole(price), whole(prev)
    f[5] = F.when(F.col("n") % 7 == 3, "0").otherwise(whole(price))
    f[30] = F.concat(F.date_format("day", "yyyyMMdd"), F.lit("150000"))
    f[33], f[34] = whole(price + 5), whole(price - 5)
    shown = F.when((F.col("n") + F.col("i")) % 6 == 2, "sh111111").otherwise(F.col("symbol"))
    body = F.concat(F.lit("v_"), shown, F.lit('="'), _joined(f, "~"), F.lit('";'))
    raw = x.select("symbol", "day", F.expr("timestamp_seconds((unix_date(day) + 2) * 86400L)").alias("fetched_at"), body.alias("body"))
    return Q.decode_benchmarks(raw)


@query("a08_benchmarks", _A08 + """ SELECT symbol, strftime(CASE WHEN error IS NULL THEN day END, '%Y-%m-%dT15:00:00+08:00') AS source_timestamp, error,
  CASE WHEN error IS NULL THEN CAST(price AS DOUBLE) END AS index_points, CASE WHEN error IS NULL THEN CAST(price - prev AS DOUBLE) END AS change_points,
  CASE WHEN error IS NULL THEN round((CAST(price AS DOUBLE) / prev - 1) * 100, 6) END AS change_percent FROM r""")
def benchmarks(spark, d):
    return _benchmarks(spark, d).select("symbol", shanghai_text(F.col("source_timestamp")).alias("source_timestamp"), "error", "index_points", "change_points",
                                        F.round("change_percent", 6).alias("change_percent"))


@query("j10_market_context", _A08 + """ SELECT count(*) AS benchmarks, count(error) AS benchmark_errors, CAST((SELECT count(DISTINCT p_brand) FROM part) AS BIGINT) AS sectors,
  'available' AS status FROM r""")
def market_context(spark, d):
    s = T.table(spark, d, "part").groupBy(F.col("p_brand").alias("code")).agg(F.avg("p_retailprice").alias("change_percent"))
    return X.market_context(_benchmarks(spark, d), s)


_SECT = """s AS (SELECT p_type, p_brand, regexp_extract(p_brand, '[0-9]+') AS bn, CAST(round(avg(p_retailprice), 2) AS DOUBLE) AS chg FROM part GROUP BY 1, 2)"""


def _sector_lists(spark, d):
    s = T.table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.round(F.avg("p_retailprice"), 2).alias("chg"))
    number = F.lpad(F.regexp_extract("p_brand", "[0-9]+", 0), 4, "0")
    return s.withColumn("bk", F.concat(F.lit("BK"), number)).withColumn("new", F.concat(F.lit("new_b"), number))


@query("a09_ranked_sectors", f"""WITH {_SECT} SELECT p_type, 'BK' || lpad(bn, 4, '0') AS code, p_brand AS name, chg AS change_percent FROM s WHERE length(p_type) % 2 = 0""")
def ranked_sectors(spark, d):
    s = _sector_lists(spark, d)
    item = F.struct(F.col("chg").alias("f3"), F.lit(10.5).alias("f2"), F.lit(1.0).alias("f4"), F.col("bk").alias("f12"), F.lit(90).alias("f13"),
                    F.col("p_brand").alias("f14"), F.lit("20240115").alias("f297"))
    g = s.groupBy("p_type").agg(F.reverse(F.array_sort(F.collect_list(item))).alias("rows"))
    g = g.withColumn("rows", F.when(F.length("p_type") % 2 == 0, F.col("rows")).otherwise(F.reverse("rows")))
    body = F.to_json(F.struct(F.lit(0).alias("rc"), F.struct(F.size("rows").alias("total"), F.col("rows").alias("diff")).alias("data")))
    raw = g.select(F.col("p_type").alias("capture_id"), "p_type", F.lit("2024-01-16T00:00:00Z").cast("timestamp").alias("fetched_at"), body.alias("body"))
    good, _ = S.decode_ranked_sectors(raw, "leaders")
    return good.select("p_type", "code", "name", "change_percent")


def _mapped(spark, d):
    s = _sector_lists(spark, d)
    f = [""] * 13
    f[0], f[1], f[5] = F.col("new"), F.col("p_brand"), F.col("chg").cast("string")
    g = s.groupBy("p_type").agg(F.map_from_entries(F.collect_list(F.struct(F.col("new"), _joined(f, ",")))).alias("m"))
    body = F.concat(F.lit("var S_Finance_bankuai_sinaindustry = "), F.to_json("m"), F.lit(";"))
    raw = g.select(F.col("p_type").alias("capture_id"), "p_type", F.lit("2024-01-16T00:00:00Z").cast("timestamp").alias("fetched_at"), body.alias("body"))
    return S.decode_mapped_sectors(raw)[0]


@query("a10_mapped_sectors", f"""WITH {_SECT} SELECT p_type, 'new_b' || lpad(bn, 4, '0') AS code, p_brand AS name, chg AS change_percent FROM s""")
def mapped_sectors(spark, d):
    return _mapped(spark, d).select("p_type", "code", "name", "change_percent")


@query("j08_sector_context", f"""WITH {_SECT}, one AS (SELECT 'new_b' || lpad(bn, 4, '0') AS code, p_type, chg FROM s),
u AS (SELECT p_type || '/' || code AS code, chg FROM one)
SELECT * FROM (SELECT 'leaders' AS direction, code, chg AS change_percent, 'PRIMARY_UNAVAILABLE_WHOLE_FALLBACK' AS selection_reason FROM u ORDER BY chg DESC, code LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'laggards', code, chg, 'PRIMARY_UNAVAILABLE_WHOLE_FALLBACK' FROM u ORDER BY chg, code LIMIT 10)""")
def sector_context(spark, d):
    fallback = _mapped(spark, d).select(F.concat_ws("/", "p_type", "code").alias("code"), "name", "change_percent")
    # No primary list arrived for this request.
    primary = fallback.filter(F.col("code") == "")
    return X.sector_context(primary, fallback).select("direction", "code", "change_percent", "selection_reason")


_PAGES = """pg AS (SELECT page_id, 'sh' || lpad(CAST(600000 + page_id % 1000 AS VARCHAR), 6, '0') AS symbol, html FROM pages)"""


def _stock_pages(spark, d):
    p = T.table(spark, d, "pages")
    k = F.col("page_id")
    symbol = F.concat(F.lit("sh"), F.lpad((F.lit(600000) + k % 1000).cast("string"), 6, "0"))
    cat = F.concat(F.lit("new_b"), (k % 25).cast("string"))
    identity = F.concat(F.lit("<script>var papercode = '"), F.when(k % 11 == 3, "sh000000").otherwise(symbol), F.lit("';</script>"))
    link = F.concat(F.lit('<a href="https://finance.sina.com.cn/data/index.html#stock-schq-hsgs-xlhy/'), cat, F.lit('" target="_blank"> 行业对比 </a>'))
    links = F.when(k % 13 == 4, F.concat(link, link)).otherwise(link)
    label = F.concat(F.lit('<a href="http://vip.stock.finance.sina.com.cn/mkt/#'), F.when(k % 17 == 5, "new_other").otherwise(cat), F.lit('">Brand#'), (k % 25).cast("string"), F.lit("</a>"))
    body = F.concat(identity, links, F.col("html"), label)
    return p.select("page_id", symbol.alias("symbol"), body.alias("body"))


@query("a11_membership_pages", f"""WITH {_PAGES} SELECT page_id, symbol, CASE WHEN page_id % 11 = 3 THEN 'MEMBERSHIP_PAGE_IDENTITY_MISMATCH'
  WHEN page_id % 13 = 4 THEN 'MEMBERSHIP_CLASSIFICATION_UNAVAILABLE' WHEN page_id % 17 = 5 THEN 'MEMBERSHIP_LABEL_UNAVAILABLE' END AS reason FROM pg""")
def membership_pages(spark, d):
    good, bad = S.extract_membership(_stock_pages(spark, d))
    return good.select("page_id", "symbol", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("page_id", "symbol", "reason"))


_MEMB = f"""{_PAGES}, ok AS (SELECT page_id, symbol, 'new_b' || CAST(page_id % 25 AS VARCHAR) AS code, 'Brand#' || CAST(page_id % 25 AS VARCHAR) AS name FROM pg
  WHERE NOT (page_id % 11 = 3 OR page_id % 13 = 4 OR page_id % 17 = 5)),
sec AS (SELECT 'new_b' || regexp_extract(p_brand, '[0-9]+') AS code, CASE WHEN p_brand = 'Brand#7' THEN 'Other' ELSE p_brand END AS name, round(avg(p_retailprice), 2) AS chg FROM part GROUP BY 1, 2),
rk AS (SELECT *, rank() OVER (ORDER BY chg DESC) AS r FROM sec)"""


@query("j09_stock_sector_context", f"""WITH {_MEMB} SELECT ok.page_id, ok.symbol, ok.code, CASE WHEN rk.code IS NULL THEN 'MEMBERSHIP_NOT_IN_SECTOR_UNIVERSE'
  WHEN rk.name <> ok.name THEN 'MEMBERSHIP_SECTOR_LABEL_MISMATCH' END AS error, CASE WHEN rk.name = ok.name THEN chg END AS change_percent,
  CASE WHEN rk.name = ok.name THEN r END AS rank_descending, coalesce(rk.name = ok.name, false) AS available FROM ok LEFT JOIN rk ON rk.code = ok.code""")
def stock_sector_context(spark, d):
    sectors = T.table(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 2).alias("change_percent")).select(
        F.concat(F.lit("new_b"), F.regexp_extract("p_brand", "[0-9]+", 0)).alias("code"),
        F.when(F.col("p_brand") == "Brand#7", "Other").otherwise(F.col("p_brand")).alias("name"), "change_percent")
    good, _ = S.extract_membership(_stock_pages(spark, d))
    out = X.stock_sector_context(good.select("page_id", "symbol", "code", "name"), sectors, expected_size=25)
    return out.select("page_id", "symbol", "code", "error", "change_percent", "rank_descending", "available")


@query("c04_membership_join", f"""WITH {_MEMB} SELECT ok.page_id, rk.name AS sector_name, coalesce(rk.name = ok.name, false) AS label_agrees FROM ok LEFT JOIN rk ON rk.code = ok.code""")
def membership_join(spark, d):
    sectors = T.table(spark, d, "part").select("p_brand").distinct().select(
        F.concat(F.lit("new_b"), F.regexp_extract("p_brand", "[0-9]+", 0)).alias("code"),
        F.when(F.col("p_brand") == "Brand#7", "Other").otherwise(F.col("p_brand")).alias("sector_name"))
    good, _ = S.extract_membership(_stock_pages(spark, d))
    j = good.join(sectors, "code", "left")
    return j.select("page_id", "sector_name", F.coalesce(F.col("sector_name") == F.col("name"), F.lit(False)).alias("label_agrees"))


# -- directories ------------------------------------------------------------------
def _parts(spark, d):
    k = F.col("p_partkey")
    return T.table(spark, d, "part").select(
        "p_partkey", F.floor(k / 100).alias("page"), F.lpad((600000 + k % 2000).cast("string"), 6, "0").alias("ticker"), "p_name",
        F.date_add(F.lit("1995-01-01").cast("date"), (k % 2000).cast("int")).alias("listed"))


_PT = """pt AS (SELECT p_partkey, CAST(floor(p_partkey / 100) AS BIGINT) AS page, lpad(CAST(600000 + p_partkey % 2000 AS VARCHAR), 6, '0') AS ticker, p_name,
  DATE '1995-01-01' + CAST(p_partkey % 2000 AS INT) AS listed FROM part)"""


@query("a12_exchange_list", f"""WITH {_PT} SELECT page, 'sh' || ticker AS symbol, ticker || '.SH' AS thscode, p_name AS name, listed AS list_date,
  CAST(substr(ticker, 1, 3) AS INT) IN (600, 601, 603, 605, 688, 689) AS market_data_supported FROM pt WHERE page % 5 <> 2 AND page % 7 <> 3""")
def exchange_list(spark, d):
    p = _parts(spark, d)
    row = F.struct(F.col("ticker").alias("A_STOCK_CODE"), F.col("p_name").alias("SEC_NAME_CN"), F.date_format("listed", "yyyyMMdd").alias("LIST_DATE"),
                   F.lit("1").alias("STOCK_TYPE"), F.when((F.col("page") % 5 == 2), "2").otherwise("1").alias("LIST_BOARD"), F.lit("-").alias("DELIST_DATE"))
    g = p.groupBy("page").agg(F.collect_list(row).alias("rows"))
    none = F.array().cast("array<string>")
    total = F.when(F.col("page") % 7 == 3, F.size("rows") + 1).otherwise(F.size("rows"))
    helper = F.struct(F.lit(1).alias("pageNo"), F.lit(1).alias("pageCount"), F.lit(2000).alias("pageSize"), total.alias("total"), F.col("rows").alias("data"))
    body = F.to_json(F.struct(F.lit(D.SSE_QUERY).alias("sqlId"), F.lit("inParams").alias("type"), F.lit("true").alias("isPagination"), none.alias("actionErrors"),
                              none.alias("actionMessages"), F.create_map().cast("map<string,string>").alias("fieldErrors"), F.col("rows").alias("result"), helper.alias("pageHelp")))
    good, _ = D.decode_sse_directory(g.select(F.col("page").cast("string").alias("capture_id"), body.alias("body")))
    return good.select(F.col("capture_id").cast("long").alias("page"), "symbol", "thscode", "name", "list_date", "market_data_supported")


@query("a13_list_metadata", f"""WITH {_PT} SELECT page, 'sz' || ticker AS symbol, p_name || ' & co' AS name, listed AS list_date, DATE '2024-01-15' AS source_effective_date
FROM pt WHERE page % 5 <> 2 AND page % 7 <> 3""")
def list_metadata(spark, d):
    p = _parts(spark, d)
    link = F.concat(F.lit("<a href='x' a-param='1'><u>"), F.col("p_name"), F.lit(" &amp; co</u></a>"))
    row = F.struct(F.col("ticker").alias("agdm"), link.alias("agjc"), F.col("listed").cast("string").alias("agssrq"),
                   F.when(F.col("page") % 5 == 2, "创业板").otherwise(D.MAIN_BOARD).alias("bk"))
    g = p.groupBy("page").agg(F.collect_list(row).alias("rows"))
    n = F.size("rows")
    meta = F.struct(F.lit("1110").alias("catalogid"), F.lit("tab1").alias("tabkey"), F.lit(D.SZSE_TITLE).alias("name"), F.lit(1).alias("pageno"), F.lit(200).alias("pagesize"),
                    n.alias("recordcount"), F.when(F.col("page") % 7 == 3, 9).otherwise(1).alias("pagecount"), F.lit(" 2024-01-15 ").alias("subname"))
    body = F.to_json(F.array(F.struct(F.lit(None).cast("string").alias("error"), meta.alias("metadata"), F.col("rows").alias("data"))))
    good, _ = D.decode_szse_metadata(g.select(F.col("page").cast("string").alias("capture_id"), body.alias("body")))
    return good.select(F.col("capture_id").cast("long").alias("page"), "symbol", "name", "list_date", "source_effective_date")


@query("a14_workbook_rows", f"""WITH {_PT} SELECT p_partkey, 'sz' || ticker AS symbol, p_name AS name, listed AS list_date FROM pt
WHERE NOT ((page % 5 = 2 OR page % 7 = 3) AND EXISTS (SELECT 1 FROM pt o WHERE o.page = pt.page AND o.p_partkey % 100 = 7)) AND page % 11 <> 4""")
def workbook_rows(spark, d):
    """One list per page; a foreign board, a wrong date or a wrong count refuses a whole list."""
    p = _parts(spark, d)
    one = F.col("p_partkey") % 100 == 7
    rows = p.select("p_partkey", "page", F.when(one & (F.col("page") % 5 == 2), "创业板").otherwise("主板").alias("板块"), F.col("ticker").alias("A股代码"), F.col("p_name").alias("A股简称"),
                    F.when(one & (F.col("page") % 7 == 3), "1995-02-30").otherwise(F.col("listed").cast("string")).alias("A股上市日期"))
    counts = p.groupBy("page").agg((F.count("*") + F.when(F.first("page") % 11 == 4, 1).otherwise(0)).alias("recordcount"))
    good, _ = D.map_workbook_rows(rows, counts, ["page"])
    return good.select("p_partkey", "symbol", "name", "list_date")


def _ticker_raw(spark, d):
    p = _parts(spark, d)
    k = F.col("p_partkey")
    bad = (F.col("page") % 6 == 5) & (k % 100 == 50)
    row = F.struct(F.lit("a-share").alias("asset_type"), F.lit("SH").alias("exchange"), F.col("ticker"), F.concat(F.col("ticker"), F.when(bad, ".SZ").otherwise(".SH")).alias("thscode"),
                   F.col("p_name").alias("name"), F.lit("CNY").alias("currency"), F.col("listed").cast("string").alias("list_date"))
    g = p.groupBy("page").agg(F.collect_list(row).alias("rows"))
    body = F.to_json(F.struct(F.lit(0).alias("code"), F.struct(F.lit(1700000000000).alias("timestamp"), F.col("rows").alias("item")).alias("data")))
    return g.select(F.col("page").cast("string").alias("capture_id"), (F.col("page") * 100).cast("int").alias("page_offset"),
                    F.lit("2024-01-16T00:00:00Z").cast("timestamp").alias("fetched_at"), body.alias("body"))


@query("a15_ticker_pages", f"""WITH {_PT}, bad AS (SELECT DISTINCT page FROM pt WHERE page % 6 = 5 AND p_partkey % 100 = 50)
SELECT page, count(*) AS returned_count, count(*) < 100 AS source_page_end_observed, CASE WHEN count(*) = 100 THEN page * 100 + 100 END AS next_offset
FROM pt ANTI JOIN bad USING (page) GROUP BY page""")
def ticker_pages(spark, d):
    _, pages, _ = D.decode_ticker_pages(_ticker_raw(spark, d), 100, expected_snapshot=1700000000000)
    return pages.select(F.col("capture_id").cast("long").alias("page"), F.col("returned_count").cast("long").alias("returned_count"), "source_page_end_observed",
                        F.col("next_offset").cast("long").alias("next_offset"))


@query("b12_directory_identity", f"""WITH {_PT} SELECT DISTINCT page, 'DIRECTORY_IDENTITY_MISMATCH' AS reason FROM pt WHERE page % 6 = 5 AND p_partkey % 100 = 50""")
def directory_identity(spark, d):
    _, _, bad = D.decode_ticker_pages(_ticker_raw(spark, d), 100)
    return bad.select(F.col("capture_id").cast("long").alias("page"), "reason")


def suggestion_raw(spark, d):
    """One response per part name, listing parts of that name in key order."""
    p = _parts(spark, d).withColumn("row", _joined([F.lit("sh"), F.col("ticker"), F.col("p_name"), "py", F.when(F.col("p_partkey") % 10 == 3, "ZS").otherwise("GP-A")], "~"))
    g = p.groupBy("page", "p_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "row"))), lambda s: s["row"]), "^").alias("rows"))
    return g.select(F.concat_ws("/", "page", "p_name").alias("capture_id"), "page", F.col("p_name").alias("lookup_name"),
                    F.concat(F.lit(' v_hint = "'), F.col("rows"), F.lit('";')).alias("body"))


@query("a16_suggestions", f"""WITH {_PT} SELECT page, p_name AS lookup_name, 'sh' || ticker AS symbol, false AS truncated,
  CAST(row_number() OVER (PARTITION BY page, p_name ORDER BY p_partkey) - 1 AS INTEGER) AS position, p_partkey % 10 <> 3 AND CAST(substr(ticker, 1, 3) AS INT) IN (600, 601) AS kept
FROM pt QUALIFY kept""")
def suggestions(spark, d):
    out = D.decode_suggestions(suggestion_raw(spark, d))
    return out.select("page", "lookup_name", "symbol", "truncated", "position", F.lit(True).alias("kept"))


@query("a21_export_window", f"""WITH {DAILY} SELECT symbol, date, close FROM bars""")
def export_window(spark, d):
    from barloom.session import work_dir

    path = work_dir(spark, "export")
    ST.export_json(T.daily_bars(spark, d).select("symbol", "date", "close"), path)
    return K.read_table(spark, path, "json", schema="symbol string, date date, close double")
