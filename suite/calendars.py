"""Calendar, completion, phase, freshness and coverage operators."""

from pyspark.sql import functions as F

from barloom import testbed as T
from barloom.functions import instant_at, shanghai_text
from barloom.operators import calendar as C, coverage as V, market_clock as M

from .base import DAILY, MINUTES, SESSION, calendar_sql, registry

REGISTRY, query = registry()
CAL = calendar_sql(T.DAILY_CALENDAR)
EVCAL = calendar_sql(T.EVENT_CALENDAR)
WKCAL = calendar_sql(T.WEEKLY_CALENDAR)
CUTOFF = "2001-06-13 12:00:00"

DIM = """
dim AS (SELECT date, is_trading,
  max(CASE WHEN is_trading THEN date END) OVER (ORDER BY date) AS session_at_or_before,
  max(CASE WHEN is_trading THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS session_before,
  count(CASE WHEN is_trading THEN 1 END) OVER (ORDER BY date) AS session_number,
  CASE WHEN is_trading THEN date END AS end_1d,
  CAST(date_trunc('week', date) AS DATE) AS wk, CAST(date_trunc('month', date) AS DATE) AS mo,
  CASE WHEN count(*) OVER (PARTITION BY date_trunc('week', date)) = 7
    THEN max(CASE WHEN is_trading THEN date END) OVER (PARTITION BY date_trunc('week', date)) END AS end_1w,
  CASE WHEN count(*) OVER (PARTITION BY date_trunc('month', date)) = day(last_day(date))
    THEN max(CASE WHEN is_trading THEN date END) OVER (PARTITION BY date_trunc('month', date)) END AS end_1mo
  FROM cal),
dims AS (SELECT *, session_before AS prev_end_1d,
  max(end_1w) OVER (ORDER BY wk RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS prev_end_1w,
  max(end_1mo) OVER (ORDER BY mo RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS prev_end_1mo FROM dim)"""


def _dim(spark, spec=T.DAILY_CALENDAR):
    return T.dimension(spark, spec)


def _cutoff(text=CUTOFF):
    return F.lit(f"{text.replace(' ', 'T')}+08:00").cast("timestamp")


@query("i01_trading_day", f"""WITH {CAL} SELECT o_orderkey, is_trading AS trading_day
FROM orders LEFT JOIN cal ON CAST(o_orderdate AS DATE) = date""")
def trading_day(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    cal = T.calendar(spark, T.DAILY_CALENDAR).select(F.col("date").alias("day"), F.col("is_trading").alias("trading_day"))
    return o.join(F.broadcast(cal), "day", "left").select("o_orderkey", "trading_day")


@query("i02_previous_session", f"""WITH {CAL}, {DIM} SELECT o_orderkey, session_at_or_before, session_before
FROM orders LEFT JOIN dims ON CAST(o_orderdate AS DATE) = date""")
def previous_session(spark, d):
    o = T.table(spark, d, "orders")
    out = C.with_asof_dim(o, _dim(spark), F.to_date("o_orderdate"), "x", ["session_at_or_before", "session_before"])
    return out.select("o_orderkey", F.col("x_session_at_or_before").alias("session_at_or_before"),
                      F.col("x_session_before").alias("session_before"))


@query("i03_period_end_session", f"""WITH {CAL}, {DIM} SELECT o_orderkey, end_1d, end_1w, end_1mo
FROM orders LEFT JOIN dims ON CAST(o_orderdate AS DATE) = date""")
def period_end_session(spark, d):
    out = C.with_asof_dim(T.table(spark, d, "orders"), _dim(spark), F.to_date("o_orderdate"), "x", ["end_1d", "end_1w", "end_1mo"])
    return out.select("o_orderkey", *[F.col(f"x_end_{i}").alias(f"end_{i}") for i in C.INTERVALS])


_DONE = "e.{e} + INTERVAL '15:30:03' HOUR TO SECOND"


def _done(expr, cutoff):
    return f"(CAST({expr} AS TIMESTAMP) + INTERVAL 55803 SECOND < {cutoff})"


@query("i04_period_completion", f"""WITH {CAL}, {DIM} SELECT o_orderkey,
  CASE WHEN is_trading THEN {_done('end_1d', f"TIMESTAMP '{CUTOFF}'")} END AS done_1d,
  {_done('end_1w', f"TIMESTAMP '{CUTOFF}'")} AS done_1w, {_done('end_1mo', f"TIMESTAMP '{CUTOFF}'")} AS done_1mo
FROM orders LEFT JOIN dims ON CAST(o_orderdate AS DATE) = date""")
def period_completion(spark, d):
    out = C.with_asof_dim(T.table(spark, d, "orders"), _dim(spark), F.to_date("o_orderdate"), "x", ["end_1d", "end_1w", "end_1mo"])
    return out.select("o_orderkey", *[C.completed_by(F.col(f"x_end_{i}"), _cutoff()).alias(f"done_{i}") for i in C.INTERVALS])


_ASOF = "(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + (o_orderkey % 24) * INTERVAL 1 HOUR)"


def _latest_sql(i, now=_ASOF):
    return f"CASE WHEN is_trading IS NULL THEN NULL WHEN {_done(f'end_{i}', now)} THEN end_{i} ELSE prev_end_{i} END"


@query("i05_latest_completed", f"""WITH {CAL}, {DIM} SELECT o_orderkey, {_latest_sql('1d')} AS latest_1d,
  {_latest_sql('1w')} AS latest_1w, {_latest_sql('1mo')} AS latest_1mo
FROM orders LEFT JOIN dims ON CAST(o_orderdate AS DATE) = date""")
def latest_completed(spark, d):
    o = T.table(spark, d, "orders").withColumn(
        "as_of", instant_at(F.to_date("o_orderdate"), (F.col("o_orderkey") % 24) * 3600))
    cols = ["is_trading"] + [f"{p}_{i}" for i in C.INTERVALS for p in ("end", "prev_end")]
    out = C.with_asof_dim(o, _dim(spark), F.to_date("o_orderdate"), "now", cols)
    return out.select("o_orderkey", *[C.latest_completed("now", i, F.col("as_of")).alias(f"latest_{i}") for i in C.INTERVALS])


def _completion_sql(i, bars, start):
    cut = f"TIMESTAMP '{CUTOFF}'"
    known = f"end_{i} IS NOT NULL" + (" AND is_trading" if i == "1d" else "")
    invalid = "coalesce(NOT is_trading, false)" if i == "1d" else "false"
    return f"""e AS (SELECT b.symbol, b.date, is_trading, end_{i} AS period_end_session, {invalid} AS invalid,
    CASE WHEN {known} THEN {_done(f'end_{i}', cut)} END AS cal_done,
    {start('b.date')} AS ps, {start(f"CAST({cut} AS DATE)")} AS today_ps
  FROM bars b LEFT JOIN dims ON b.date = dims.date),
x AS (SELECT {_latest_sql(i, cut)} AS expected FROM dims WHERE date = CAST({cut} AS DATE))
SELECT symbol, date, NOT invalid AND (coalesce(cal_done, false) OR (cal_done IS NULL AND ps < today_ps)) AS complete,
  CASE WHEN NOT invalid THEN cal_done END AS calendar_completion,
  CASE WHEN invalid THEN 'invalid_nontrading_daily_label'
    WHEN cal_done IS NULL THEN 'elapsed_calendar_period_unverified_exchange_calendar'
    ELSE 'verified_calendar_schedule_with_conservative_buffer' END AS completion_basis,
  period_end_session, ps = {start('(SELECT expected FROM x)')} AS observed_latest, 'unknown' AS source_finality
FROM e"""


@query("i06_bar_completion", f"WITH {DAILY}, {CAL}, {DIM}, " + _completion_sql("1d", "bars", lambda c: c))
def bar_completion(spark, d):
    out = C.with_bar_completion(T.daily_bars(spark, d), _dim(spark), _cutoff(), "1d")
    return out.select("symbol", "date", "complete", "calendar_completion", "completion_basis",
                      "period_end_session", "observed_latest", "source_finality")


@query("i06_bar_completion_weekly", f"WITH {SESSION}, {CAL}, {DIM}, "
       + _completion_sql("1w", "bars", lambda c: f"CAST(date_trunc('week', {c}) AS DATE)"))
def bar_completion_weekly(spark, d):
    out = C.with_bar_completion(T.session_bars(spark, d, "1w"), _dim(spark), _cutoff(), "1w")
    return out.select("symbol", "date", "complete", "calendar_completion", "completion_basis",
                      "period_end_session", "observed_latest", "source_finality")


_EVEN = "substr(symbol, 8, 1) IN ('0', '2', '4', '6', '8')"
_ONE_CALENDAR = "SELECT * FROM (WITH {bars}, {cal}, {dim}, " + _completion_sql("1d", "bars", lambda c: c) + ") x WHERE {half}"


@query("i06_several_calendars", _ONE_CALENDAR.format(bars=DAILY, cal=CAL, dim=DIM, half=_EVEN) + " UNION ALL "
       + _ONE_CALENDAR.format(bars=DAILY, cal=calendar_sql(T.WEEKLY_CALENDAR), dim=DIM, half=f"NOT {_EVEN}"))
def several_calendars(spark, d):
    """Bars of two calendar versions, by the last digit of the symbol, stamped in one pass."""
    dims = _dim(spark).unionByName(T.dimension(spark, T.WEEKLY_CALENDAR))
    even = F.substring("symbol", 8, 1).cast("int") % 2 == 0
    versions = F.when(even, T.DAILY_CALENDAR["version"]).otherwise(T.WEEKLY_CALENDAR["version"])
    out = C.with_bar_completion(T.daily_bars(spark, d).withColumn("v", versions), dims, _cutoff(), "1d", version="v")
    return out.select("symbol", "date", "complete", "calendar_completion", "completion_basis",
                      "period_end_session", "observed_latest", "source_finality")


def _event_clock(spark, d):
    wall = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    return T.table(spark, d, "events").withColumn("as_of", instant_at(F.to_date("ts"), wall))


_PHASE_SQL = """
ev AS (SELECT *, date_trunc('second', ts) AS now, hour(ts) * 60 + minute(ts) AS m FROM events),
ph AS (SELECT ev.*, is_trading, session_before, CASE WHEN is_trading IS NULL THEN 'unknown' WHEN NOT is_trading THEN 'closed'
  WHEN m < 555 THEN 'pre_open' WHEN m < 565 THEN 'opening_auction' WHEN m < 570 THEN 'opening_auction_gap'
  WHEN m < 690 THEN 'continuous_am' WHEN m < 780 THEN 'lunch_break' WHEN m < 897 THEN 'continuous_pm'
  WHEN m < 900 THEN 'closing_auction' ELSE 'after_close' END AS market_phase
  FROM ev LEFT JOIN dims ON CAST(ts AS DATE) = date),
px AS (SELECT *, CASE WHEN market_phase = 'unknown' THEN NULL WHEN market_phase IN ('closed','pre_open','opening_auction')
  THEN session_before ELSE CAST(ts AS DATE) END AS expected_session_date FROM ph),
py AS (SELECT *, CASE WHEN market_phase IN ('continuous_am','continuous_pm') THEN now
  ELSE CAST(expected_session_date AS TIMESTAMP) + CASE market_phase WHEN 'opening_auction_gap' THEN INTERVAL 33900 SECOND
    WHEN 'lunch_break' THEN INTERVAL 41400 SECOND WHEN 'closing_auction' THEN INTERVAL 53820 SECOND
    ELSE INTERVAL 54000 SECOND END END AS expected FROM px)"""
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S+08:00')"


@query("i07_market_phase", f"""WITH {EVCAL}, {DIM}, {_PHASE_SQL} SELECT event_id, market_phase, is_trading AS trading_day,
  expected_session_date, {_ISO.format('expected')} AS expected_source_timestamp FROM py""")
def market_phase(spark, d):
    out = M.with_market_phase(_event_clock(spark, d), _dim(spark, T.EVENT_CALENDAR))
    return out.select("event_id", "market_phase", "trading_day", "expected_session_date",
                      shanghai_text(F.col("expected_source_timestamp")).alias("expected_source_timestamp"))


_AGE = "(k * k - 100)"


@query("i08_freshness_quote", f"""WITH {EVCAL}, {DIM}, {_PHASE_SQL},
q AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM py),
r AS (SELECT *, {_AGE} AS age, date_diff('second', now - {_AGE} * INTERVAL 1 SECOND, expected) AS behind FROM q)
SELECT event_id, CASE WHEN age < -5 THEN 'future_timestamp' WHEN market_phase = 'unknown' THEN 'unknown'
  WHEN expected IS NULL THEN 'unknown' WHEN behind > 90 THEN 'stale'
  WHEN market_phase IN ('continuous_am','continuous_pm') OR age <= 90 THEN 'recent' ELSE 'latest_session' END AS freshness_status,
  age AS age_seconds, CASE WHEN behind IS NULL THEN 0 ELSE greatest(behind, 0) END AS lag_from_expected_seconds FROM r""")
def freshness_quote(spark, d):
    ev = _event_clock(spark, d)
    k = F.get_json_object("props", "$.k").cast("long")
    ev = ev.withColumn("source_timestamp", F.timestamp_seconds(F.unix_seconds("as_of") - (k * k - 100)))
    out = M.with_freshness(ev, _dim(spark, T.EVENT_CALENDAR))
    return out.select("event_id", "freshness_status", "age_seconds", "lag_from_expected_seconds")


@query("i08_freshness_bar", f"""WITH {CAL}, {DIM},
o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS TIMESTAMP) + CAST(o_orderkey % 12 - 1 AS INTEGER) * INTERVAL 1 DAY
  + (o_orderkey % 24) * INTERVAL 1 HOUR AS now FROM orders),
j AS (SELECT o.*, n.is_trading, n.end_1d, n.prev_end_1d, b.is_trading AS bar_trading, b.end_1d AS bar_end
  FROM o LEFT JOIN dims n ON CAST(now AS DATE) = n.date LEFT JOIN dims b ON day = b.date),
e AS (SELECT *, {_latest_sql('1d', 'now')} AS expected FROM j)
SELECT o_orderkey, CASE WHEN day > CAST(now AS DATE) THEN 'future_timestamp' WHEN is_trading IS NULL THEN 'unknown'
  WHEN expected IS NULL THEN 'unknown' WHEN day < expected THEN 'stale'
  WHEN NOT coalesce(bar_trading AND {_done('bar_end', 'now')}, false) THEN 'incomplete' ELSE 'latest_session' END AS freshness_status FROM e""")
def freshness_bar(spark, d):
    day = F.to_date("o_orderdate")
    key = F.col("o_orderkey")
    o = T.table(spark, d, "orders").withColumn("source_timestamp", instant_at(day, 15 * 3600)).withColumn(
        "as_of", instant_at(F.date_add(day, (key % 12 - 1).cast("int")), (key % 24) * 3600))
    return M.with_freshness(o, _dim(spark), kind="1d").select("o_orderkey", "freshness_status")


@query("i08_freshness_auction", f"""WITH {EVCAL}, {DIM}, {_PHASE_SQL},
q AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, hour(now) * 3600 + minute(now) * 60 + second(now) AS sec FROM py),
r AS (SELECT *, {_AGE} AS age, CAST(now - {_AGE} * INTERVAL 1 SECOND AS DATE) AS obs FROM q)
SELECT event_id, CASE WHEN age < -5 THEN 'future_timestamp' WHEN market_phase = 'unknown' THEN 'unknown'
  WHEN obs < CAST(now AS DATE) THEN 'prior_session_observations'
  WHEN is_trading AND sec >= 33300 AND sec < 34260 AND age <= 90 THEN 'delayed_recent_observation'
  WHEN is_trading AND sec >= 33300 AND sec < 34260 THEN 'delayed_observation_lagging'
  ELSE 'historical_auction_observations' END AS freshness_status FROM r""")
def freshness_auction(spark, d):
    ev = _event_clock(spark, d)
    k = F.get_json_object("props", "$.k").cast("long")
    ev = ev.withColumn("source_timestamp", F.timestamp_seconds(F.unix_seconds("as_of") - (k * k - 100)))
    return M.with_freshness(ev, _dim(spark, T.EVENT_CALENDAR), kind="auction").select("event_id", "freshness_status")


@query("i09_fixed_freshness", """SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) * 3 - 30 < -5 THEN 'future_timestamp'
  WHEN CAST(json_extract(props, '$.k') AS BIGINT) * 3 - 30 <= 90 THEN 'recent' ELSE 'stale' END AS freshness_status FROM events""")
def fixed_freshness(spark, d):
    ev = _event_clock(spark, d)
    k = F.get_json_object("props", "$.k").cast("long")
    ts = F.timestamp_seconds(F.unix_seconds("as_of") - (k * 3 - 30))
    return ev.select("event_id", M.fixed_freshness(ts, F.col("as_of"), 90).alias("freshness_status"))


@query("i11_completion_evidence", f"""WITH {DAILY}, {CAL}, {DIM}
SELECT symbol, bars.date, coalesce({_done('end_1d', f"TIMESTAMP '{CUTOFF}'")} IS NOT NULL
  AND bars.date >= DATE '1995-06-01' AND bars.date <= DATE '2001-06-30', false) AS completion_known
FROM bars LEFT JOIN dims ON bars.date = dims.date""")
def completion_evidence(spark, d):
    b = C.with_bar_completion(T.daily_bars(spark, d), _dim(spark), _cutoff(), "1d")
    from barloom.plans import rules

    known = rules.completion_known(
        F.col("completion"), F.col("calendar_completion"), F.col("completion_basis"),
        F.col("date"), F.col("date"), F.lit("1995-06-01").cast("date"), F.lit("2001-06-30").cast("date"))
    b = b.withColumn("completion", rules.adapter_completion(F.col("complete"), F.col("calendar_completion"), F.col("completion_basis")))
    return b.select("symbol", "date", known.alias("completion_known"))


@query("i12_adapter_completion", f"""WITH {DAILY}, {CAL}, {DIM},
e AS (SELECT symbol, bars.date, is_trading, CASE WHEN is_trading THEN {_done('end_1d', f"TIMESTAMP '{CUTOFF}'")} END AS done
FROM bars LEFT JOIN dims ON bars.date = dims.date)
SELECT symbol, date, CASE WHEN done THEN 'complete' WHEN NOT done THEN 'partial' ELSE 'unknown' END AS completion FROM e""")
def adapter_completion(spark, d):
    from barloom.plans import rules

    b = C.with_bar_completion(T.daily_bars(spark, d), _dim(spark), _cutoff(), "1d")
    return b.select("symbol", "date", rules.adapter_completion(
        F.col("complete"), F.col("calendar_completion"), F.col("completion_basis")).alias("completion"))


@query("c10_closed_range_join", f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE NOT (""" + " OR ".join(
    f"CAST(o_orderdate AS DATE) BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in T.DAILY_CALENDAR["closed_ranges"]) + ")")
def closed_range_join(spark, d):
    import datetime as dt

    ranges = spark.createDataFrame(
        [tuple(dt.date.fromisoformat(x) for x in r) for r in T.DAILY_CALENDAR["closed_ranges"]], "first_date date, last_date date")
    o = T.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return C.mark_closed_rows(o, ranges).filter(~F.col("in_closed_range")).select("o_orderkey", F.col("date").alias("day"))


@query("c11_asof_session_join", f"""WITH {EVCAL}, {DIM} SELECT event_id, session_before,
  CASE WHEN is_trading AND ts > CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 55803 SECOND THEN date ELSE session_before END AS last_completed_session
FROM events LEFT JOIN dims ON CAST(ts AS DATE) = date""")
def asof_session_join(spark, d):
    ev = _event_clock(spark, d)
    out = C.with_asof_dim(ev, _dim(spark, T.EVENT_CALENDAR), F.to_date("ts"), "now", ["is_trading", "session_before", "end_1d", "prev_end_1d"])
    micro = F.timestamp_micros(F.unix_micros("as_of") + F.date_format("ts", "SSSSSS").cast("long"))
    return out.select("event_id", F.col("now_session_before").alias("session_before"),
                      C.latest_completed("now", "1d", micro).alias("last_completed_session"))


_MISSING = """
r AS (SELECT symbol, min(date) AS a, max(date) AS b FROM bars GROUP BY symbol),
missing AS (SELECT r.symbol, cal.date AS missing_date FROM r JOIN cal ON cal.is_trading AND cal.date BETWEEN r.a AND r.b
  WHERE NOT EXISTS (SELECT 1 FROM bars WHERE bars.symbol = r.symbol AND bars.date = cal.date))"""


@query("c15_missing_sessions", f"WITH {SESSION}, {WKCAL}, {_MISSING} SELECT symbol, missing_date FROM missing")
def missing_sessions(spark, d):
    dim = _dim(spark, T.WEEKLY_CALENDAR)
    return V.missing_sessions(T.session_bars(spark, d), dim, keys=["symbol"]).select("symbol", "missing_date")


@query("g03_missing_sessions_daily", f"WITH {DAILY}, {CAL}, {_MISSING} SELECT symbol, count(*) AS missing_sessions FROM missing GROUP BY 1")
def missing_daily(spark, d):
    dim = _dim(spark)
    out = V.missing_sessions(T.daily_bars(spark, d), dim, keys=["symbol"])
    return out.groupBy("symbol").agg(F.count("*").alias("missing_sessions"))


@query("j07_coverage", f"""WITH {SESSION}, {WKCAL}, {_MISSING}
SELECT b.symbol, b.rows, b.first_date, b.last_date, CAST(0 AS BIGINT) AS duplicate_timestamps, CAST(0 AS BIGINT) AS non_monotonic_timestamps,
  b.unverified AS calendar_unverified_rows, b.unverified > 0 AS calendar_gaps_unverified, coalesce(m.n, 0) AS missing_sessions,
  m.f AS first_missing, m.l AS last_missing
FROM (SELECT symbol, count(*) AS rows, min(bars.date) AS first_date, max(bars.date) AS last_date,
    count(CASE WHEN cal.date IS NULL THEN 1 END) AS unverified FROM bars LEFT JOIN cal ON bars.date = cal.date GROUP BY symbol) b
LEFT JOIN (SELECT symbol, count(*) AS n, min(missing_date) AS f, max(missing_date) AS l FROM missing GROUP BY symbol) m USING (symbol)""")
def coverage(spark, d):
    dim = _dim(spark, T.WEEKLY_CALENDAR)
    return V.coverage(T.session_bars(spark, d), dim, keys=["symbol"])


@query("d02_series_coverage", """WITH r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day,
  lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT o_custkey, count(*) AS rows, min(day) AS first_date, max(day) AS last_date,
  count(CASE WHEN day = before THEN 1 END) AS duplicate_timestamps, count(CASE WHEN day < before THEN 1 END) AS non_monotonic_timestamps
FROM r GROUP BY 1""")
def series_coverage(spark, d):
    o = T.table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("row_no"))
    dim = _dim(spark)
    out = V.coverage(o, dim, keys=["o_custkey"])
    return out.select("o_custkey", "rows", "first_date", "last_date", "duplicate_timestamps", "non_monotonic_timestamps")


_AUCTION_NOW = "TIMESTAMP '2024-01-20 08:00:00'"
_AUCTION = f"""
obs AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS session_date, minute(ts) AS m,
  count(*) AS n, CASE WHEN sum(CAST(round(value * 100) AS BIGINT)) % 3 = 0 THEN NULL ELSE CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) END AS vol
  FROM events WHERE minute(ts) BETWEEN 15 AND 30 GROUP BY 1, 2, 3)"""


def _auction_points(spark, d):
    """Minute-of-hour labels 15..30 of a day's events as 09:15..09:30 points."""
    ev = T.table(spark, d, "events").filter(F.minute("ts").between(15, 30))
    g = ev.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("session_date"), F.minute("ts").alias("m")).agg(
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))
    volume = F.when(F.col("total") % 3 != 0, F.col("total"))
    return g.select("symbol", "session_date", "m",
                    instant_at(F.col("session_date"), 9 * 3600 + F.col("m") * 60).alias("source_timestamp"),
                    volume.alias("reported_volume_shares"),
                    F.when(F.col("total") % 2 == 0, F.col("total")).alias("reported_amount_cny"))


@query("j06_auction_quality", f"""WITH {_AUCTION},
a AS (SELECT *, true AS t FROM obs),
s AS (SELECT symbol, session_date, count(*) AS observed_minutes, count(CASE WHEN m BETWEEN 15 AND 19 THEN 1 END) AS early_observations,
  count(CASE WHEN m BETWEEN 20 AND 24 THEN 1 END) AS late_observations, count(CASE WHEN m BETWEEN 25 AND 30 THEN 1 END) AS post_auction_reports,
  count(CASE WHEN vol > 0 THEN 1 END) AS positive_reported_volume_points, count(CASE WHEN vol IS NULL THEN 1 END) AS missing_reported_volume_points
  FROM a GROUP BY 1, 2),
miss AS (SELECT s.symbol, s.session_date, string_agg('09:' || g.m, ',' ORDER BY g.m) AS labels FROM s, generate_series(15, 30) g(m)
  WHERE CAST(s.session_date AS TIMESTAMP) + INTERVAL 9 HOUR + (g.m + 1) * INTERVAL 1 MINUTE <= {_AUCTION_NOW}
  AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.symbol = s.symbol AND o.session_date = s.session_date AND o.m = g.m) GROUP BY 1, 2)
SELECT s.*, coalesce(labels, '') AS missing_labels, s.session_date = CAST({_AUCTION_NOW} AS DATE) AS same_day
FROM s LEFT JOIN miss USING (symbol, session_date)""")
def auction_quality(spark, d):
    out = V.auction_quality(_auction_points(spark, d), F.lit("2024-01-20T08:00:00+08:00").cast("timestamp"))
    return out.select("symbol", "session_date", "observed_minutes", "early_observations", "late_observations", "post_auction_reports",
                      "positive_reported_volume_points", "missing_reported_volume_points",
                      F.array_join(F.array_sort("missing_elapsed_minute_labels"), ",").alias("missing_labels"), "same_day")
