"""Symbol and bar predicates, outer joins and row annotation."""

from pyspark.sql import functions as F

from barloom import testbed as T
from barloom.functions import dataset_symbol, excluded_name, instant_at, is_screen_mainboard, normalize_symbol, strict_date
from barloom.operators import coverage as V, market_clock as M, watchlist as W
from barloom.sources import bars as B

from . import calendars
from .base import DAILY, SESSION, calendar_sql, code_sql, registry
from .ledgers import _DIR, directory

REGISTRY, query = registry()


@query("b01_normalize_symbol", """WITH s AS (SELECT p_partkey, lpad(CAST((p_partkey * 4999) % 1000000 AS VARCHAR), 6, '0') AS c FROM part),
f AS (SELECT p_partkey, c, CASE WHEN c[1] = '6' THEN 'sh' WHEN c[1] IN ('4', '8', '9') THEN 'bj' ELSE 'sz' END || c AS x, CASE WHEN p_partkey % 3 = 1 THEN 'sz' || c END AS dotted FROM s),
g AS (SELECT p_partkey, coalesce(dotted, x) AS y FROM f)
SELECT p_partkey, CASE WHEN regexp_full_match(y, '(sh(600|601|603|605|688|689)[0-9]{3}|sz(000|001|002|003|004|300|301)[0-9]{3}|bj[489][0-9]{5})') THEN y END AS symbol FROM g""")
def normalize(spark, d):
    k = F.col("p_partkey")
    code = F.lpad(((k * 4999) % 1000000).cast("string"), 6, "0")
    raw = F.when(k % 3 == 1, F.concat(F.lit(" "), code, F.lit(".SZ "))).otherwise(code)
    return T.table(spark, d, "part").select("p_partkey", normalize_symbol(raw).alias("symbol"))


@query("b03_screen_mainboard", f"""WITH {_DIR} SELECT p_partkey, regexp_full_match(symbol, 'sh(600|601|603|605)[0-9]{{3}}|sz(000|001|002|003)[0-9]{{3}}') AND NOT (st AND name NOT LIKE '＊%') AS candidate FROM cla""")
def screen_mainboard(spark, d):
    u = directory(spark, d)
    ok = is_screen_mainboard(F.col("symbol"), F.col("market"), F.lit("mainboard")) & ~excluded_name(F.col("name"))
    return u.select("p_partkey", ok.alias("candidate"))


@query("b04_dataset_symbol", f"""WITH {_DIR} SELECT p_partkey, regexp_full_match(symbol, 'sh(600|601|603|605)[0-9]{{3}}|sz(000|001|002|003|004)[0-9]{{3}}') AND symbol <> 'sz000000'
  AND NOT (m = 'sz' AND t BETWEEN '001001' AND '001199') AS in_pool FROM cla""")
def dataset_pool(spark, d):
    return directory(spark, d).select("p_partkey", dataset_symbol(F.col("symbol")).alias("in_pool"))


@query("b06_bar_validity", f"""WITH {DAILY}, x AS (SELECT symbol, date, date - DATE '1970-01-01' AS n, open, high, low, close, volume_shares FROM bars),
y AS (SELECT *, CASE WHEN n % 7 = 3 THEN -low ELSE low END AS l2, CASE WHEN n % 11 = 5 THEN low / 2 ELSE high END AS h2, CASE WHEN n % 13 = 6 THEN NULL ELSE close END AS c2 FROM x)
SELECT symbol, date, CASE WHEN c2 IS NULL THEN 'INVALID_SOURCE_NUMBER' WHEN h2 < l2 OR open < l2 OR open > h2 OR c2 < l2 OR c2 > h2 THEN 'INVALID_BAR_VALUES' END AS any_sign,
  CASE WHEN c2 IS NULL THEN 'INVALID_SOURCE_NUMBER' WHEN h2 < l2 OR open < l2 OR open > h2 OR c2 < l2 OR c2 > h2 OR l2 <= 0 THEN 'INVALID_BAR_VALUES' END AS positive_low FROM y""")
def bar_validity(spark, d):
    n = F.unix_date("date")
    b = T.daily_bars(spark, d).withColumns({
        "high": F.when(n % 11 == 5, F.col("low") / 2).otherwise(F.col("high")), "close": F.when(n % 13 != 6, F.col("close")),
        "low": F.when(n % 7 == 3, -F.col("low")).otherwise(F.col("low"))})
    bar = F.struct(*B.BAR_FIELDS)
    return b.select("symbol", "date", B.value_code(bar).alias("any_sign"), B.value_code(bar, True).alias("positive_low"))


@query("b07_date_predicates", f"""WITH {calendar_sql(T.DAILY_CALENDAR)}, o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders)
SELECT o_orderkey, CASE WHEN day IS NULL THEN 'INVALID_DATE' WHEN day > DATE '2001-01-15' THEN 'FUTURE_BAR_DATE' WHEN NOT is_trading THEN 'BAR_ON_NONTRADING_DATE' END AS reason FROM o LEFT JOIN cal ON day = cal.date""")
def date_predicates(spark, d):
    text = F.when(F.col("o_orderkey") % 9 == 4, "2001-02-30").otherwise(F.to_date("o_orderdate").cast("string"))
    o = T.table(spark, d, "orders").select("o_orderkey", strict_date(text).alias("date"))
    cal = T.calendar(spark, T.DAILY_CALENDAR).select("date", "is_trading")
    j = o.join(F.broadcast(cal), "date", "left")
    return j.select("o_orderkey", F.when(F.col("date").isNull(), "INVALID_DATE").when(F.col("date") > F.lit("2001-01-15").cast("date"), "FUTURE_BAR_DATE")
                    .when(~F.col("is_trading"), "BAR_ON_NONTRADING_DATE").alias("reason"))


@query("c02_universe_history_join", f"""WITH {SESSION}, l AS (SELECT symbol, max(date) AS last_date FROM bars GROUP BY 1)
SELECT {code_sql('s_suppkey')} AS symbol, l.last_date, CASE WHEN l.symbol IS NULL THEN 'insufficient' ELSE 'ready' END AS state FROM supplier LEFT JOIN l ON l.symbol = {code_sql('s_suppkey')}""")
def universe_history(spark, d):
    universe = T.table(spark, d, "supplier").select(T.code_of(F.col("s_suppkey")).alias("symbol"))
    last = T.session_bars(spark, d).groupBy("symbol").agg(F.max("date").alias("last_date"))
    return universe.join(last, "symbol", "left").select("symbol", "last_date", F.when(F.col("last_date").isNull(), "insufficient").otherwise("ready").alias("state"))


@query("c06_preference_join", """SELECT c_custkey AS owner, o_orderkey AS symbol, o_orderpriority AS name FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderkey % 1000 = c_custkey % 1000""")
def preference_join(spark, d):
    prefs = T.table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), (F.col("c_custkey") % 1000).alias("pick"))
    watch = T.table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("symbol"), (F.col("o_orderkey") % 1000).alias("pick"), F.col("o_orderpriority").alias("name"))
    return prefs.join(watch, ["owner", "pick"]).select("owner", "symbol", "name")


@query("c06_watchlist_pages", """WITH w AS (SELECT o_custkey AS owner, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS symbol, o_orderpriority AS name FROM orders),
own AS (SELECT DISTINCT c_custkey AS owner FROM customer UNION SELECT owner FROM w),
p AS (SELECT owner, max(symbol) FILTER (WHERE CAST(symbol AS BIGINT) % 5 < 2) AS pick FROM w GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY symbol) AS n FROM w WHERE symbol > '000000001000')
SELECT own.owner, coalesce((SELECT string_agg(symbol || ' ' || name, ',' ORDER BY n) FROM r WHERE r.owner = own.owner AND n <= 10), '') AS items,
  (SELECT w.name FROM w JOIN p USING (owner) WHERE w.owner = own.owner AND w.symbol = p.pick) AS selected_name,
  (SELECT count(*) FROM w WHERE w.owner = own.owner) AS total, coalesce((SELECT max(n) FROM r WHERE r.owner = own.owner), 0) > 10 AS has_more,
  (SELECT symbol FROM r WHERE r.owner = own.owner AND n = 10 AND EXISTS (SELECT 1 FROM r x WHERE x.owner = own.owner AND x.n = 11)) AS next_after FROM own""")
def watchlist_pages(spark, d):
    """Orders as entries of their customer's list, the newest with a number of a kind as the preference; second pages."""
    o = T.table(spark, d, "orders")
    entries = o.select(F.col("o_custkey").alias("owner"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("symbol"), F.col("o_orderpriority").alias("name"),
                       F.col("o_orderdate").alias("verified_at"), "o_orderkey")
    picks = entries.groupBy("owner").agg(F.max(F.when(F.col("o_orderkey") % 5 < 2, F.col("symbol"))).alias("selected_symbol"))
    picks = T.table(spark, d, "customer").select(F.col("c_custkey").alias("owner")).join(picks, "owner", "left")
    out = W.watchlist_pages(entries, picks, F.lit("000000001000"), 10)
    items = F.array_join(F.transform("items", lambda x: F.concat_ws(" ", x["symbol"], x["name"])), ",").alias("items")
    return out.select("owner", items, F.col("selected.name").alias("selected_name"), "total", "has_more", "next_after")


@query("d05_auction_phases", f"""WITH {calendars._AUCTION} SELECT symbol, count(CASE WHEN m BETWEEN 15 AND 19 THEN 1 END) AS early_observations, count(CASE WHEN m BETWEEN 20 AND 24 THEN 1 END) AS late_observations,
  count(CASE WHEN m BETWEEN 25 AND 30 THEN 1 END) AS post_auction_reports, count(CASE WHEN vol IS NULL THEN 1 END) AS missing_reported_volume_points FROM obs GROUP BY 1""")
def auction_phases(spark, d):
    q = V.auction_quality(calendars._auction_points(spark, d), F.lit("2024-02-01T00:00:00Z").cast("timestamp"))
    names = ("early_observations", "late_observations", "post_auction_reports", "missing_reported_volume_points")
    return q.groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names])


@query("i10_security_status", f"""WITH {DAILY} SELECT symbol, date, 'unknown' AS suspension, CASE WHEN close = high AND high > low THEN 'at_upper_limit' WHEN close = low AND high > low THEN 'at_lower_limit' WHEN high > low THEN 'between_limits' ELSE 'unknown' END AS price_limit_status,
  CASE WHEN high > low THEN high END AS status_limit_up FROM bars""")
def security_status(spark, d):
    from barloom.sources import quotes as Q

    b = T.daily_bars(spark, d).withColumns({"price": F.col("close"), "_up": F.col("high"), "_down": F.col("low")})
    return M.with_security_status(Q.price_limits(b)).select("symbol", "date", "suspension", "price_limit_status", "status_limit_up")


@query("j27_annotated_quotes", f"""WITH {calendars.EVCAL}, {calendars.DIM}, {calendars._PHASE_SQL}
SELECT event_id, market_phase, CASE WHEN market_phase = 'unknown' THEN 'unknown' WHEN expected IS NULL THEN 'unknown' WHEN date_diff('second', now, expected) + 30 > 90 THEN 'stale' ELSE 'recent' END AS freshness_status FROM py""")
def annotated(spark, d):
    ev = calendars._event_clock(spark, d)
    ev = ev.withColumn("source_timestamp", F.timestamp_seconds(F.unix_seconds("as_of") - 30))
    return M.annotate(ev, T.dimension(spark, T.EVENT_CALENDAR)).select("event_id", "market_phase", "freshness_status")
