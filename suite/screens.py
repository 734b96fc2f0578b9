"""Swing screen, rule screen and their parts."""

from pyspark.sql import functions as F

from barloom import testbed as T
from barloom.operators import calendar as C, coverage as V
from barloom.plans import rules as R, swing as S

from .base import SESSION, SESSION_MONTH, calendar_sql, code_sql, registry

REGISTRY, query = registry()
WKCAL = calendar_sql(T.WEEKLY_CALENDAR)
TARGET = "2001-06-18"
AS_OF = f"{TARGET}T16:00:00+08:00"

# Fixed value: a four-condition rule over two frames.
RULE = {
    "version": 1,
    "root": {"type": "group", "op": "OR", "children": [
        {"type": "group", "op": "AND", "children": [
            {"type": "condition", "id": "trend", "timeframe": "D", "op": "gt",
             "left": {"kind": "ma", "field": "close", "window": 20}, "right": {"kind": "ma", "field": "close", "window": 60}},
            {"type": "condition", "id": "month", "timeframe": "M", "op": "gt",
             "left": {"kind": "change_pct", "window": 3}, "right": {"kind": "constant", "value": 0}},
        ]},
        {"type": "condition", "id": "breakout", "timeframe": "D", "op": "gt",
         "left": {"kind": "field", "field": "close"}, "right": {"kind": "prior_high", "window": 20}},
        {"type": "condition", "id": "turn", "timeframe": "W", "op": "cross_above",
         "left": {"kind": "field", "field": "close"}, "right": {"kind": "ma", "field": "close", "window": 10}},
    ]},
}


def _dim(spark):
    return T.dimension(spark, T.WEEKLY_CALENDAR)


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def history(spark, d):
    """Session bars as captured history: completion stamped, in stored order."""
    from barloom.functions import instant_at

    dim = _dim(spark)
    b = C.with_bar_completion(T.session_bars(spark, d), dim, _as_of(), "1d")
    return b.withColumn("row_no", F.unix_date("date")).withColumn("source_timestamp", instant_at(F.col("date"), 15 * 3600))


def swing_result(spark, d):
    # Bars on closed Mondays are histories of their own.
    dim = _dim(spark)
    closed = dim.filter(~F.col("is_trading")).select("date", F.lit("/closed").alias("_closed"))
    h = history(spark, d).join(F.broadcast(closed), "date", "left").withColumn("symbol", F.concat("symbol", F.coalesce("_closed", F.lit("")))).drop("_closed")
    return S.swing_screen(h, dim, _as_of())


_PANEL_COLS = """
m AS (SELECT symbol, date, open, high, low, close, volume_shares, row_number() OVER w AS n,
  avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma20,
  avg(close) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS ma60,
  max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior_high20,
  max(high) OVER (w ROWS BETWEEN 21 PRECEDING AND 2 PRECEDING) AS prev_high20,
  avg(volume_shares) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior_mean_volume20,
  lag(close, 5) OVER w AS close5, lag(close) OVER w AS close1, lag(date, 64) OVER w AS first65
  FROM hist WINDOW w AS (PARTITION BY symbol ORDER BY date)),
m2 AS (SELECT *, lag(ma20, 5) OVER w AS ma20b, lag(ma60, 5) OVER w AS ma60b FROM m WINDOW w AS (PARTITION BY symbol ORDER BY date)),
m3 AS (SELECT *, volume_shares / nullif(prior_mean_volume20, 0) AS vr, 100 * (close / close5 - 1) AS ret5, 100 * (close / ma20 - 1) AS ext,
  close > ma20 AND ma20 > ma20b AND close > prior_high20 AND volume_shares / nullif(prior_mean_volume20, 0) >= 1.5 AS emerging,
  close > ma20 AND ma20 > ma20b AND ma20 > ma60 AND ma60 > ma60b AND close >= prior_high20 * (1 - 5.0::DOUBLE / 100)
    AND volume_shares / nullif(prior_mean_volume20, 0) >= 0.8 AS continuation FROM m2),
m4 AS (SELECT *, CASE WHEN continuation THEN 'continuation' WHEN emerging THEN 'emerging' END AS phase,
  CASE WHEN close > prior_high20 THEN CASE WHEN close1 > prev_high20 THEN 'repeated' ELSE 'fresh' END END AS breakout_kind,
  concat_ws(',', CASE WHEN ext > 12 THEN 'OVEREXTENDED_MA20' END, CASE WHEN ret5 > 20 THEN 'RAPID_5_BAR_ADVANCE' END) AS flags FROM m3)"""
_PANEL_COLS = _PANEL_COLS.replace("OVER (w ROWS", "OVER (PARTITION BY symbol ORDER BY date ROWS")


@query("j13_swing_panel", f"""WITH {SESSION}, hist AS (SELECT * FROM bars), {_PANEL_COLS}
SELECT symbol, date, phase, breakout_kind, flags, round(ma20, 4) AS ma20, round(ma60, 4) AS ma60, round(vr, 6) AS volume_ratio20,
  emerging, continuation FROM m4 WHERE n >= 65""")
def swing_panel(spark, d):
    p = S.swing_panel(T.session_bars(spark, d))
    return p.select("symbol", "date", "phase", "breakout_kind", F.array_join("risk_flags", ",").alias("flags"),
                    F.round("ma20", 4).alias("ma20"), F.round("ma60", 4).alias("ma60"),
                    F.round("volume_ratio20", 6).alias("volume_ratio20"), "emerging", "continuation")


_SWING_ROWS = f"""WITH {SESSION}, {WKCAL},
hist AS (SELECT bars.* FROM bars JOIN cal ON bars.date = cal.date AND is_trading WHERE bars.date <= DATE '{TARGET}'), {_PANEL_COLS},
counts AS (SELECT symbol, count(*) AS input_count, count(CASE WHEN bars.date > DATE '{TARGET}' THEN 1 END) AS excluded_future
  FROM bars JOIN cal ON bars.date = cal.date AND is_trading GROUP BY symbol),
tail AS (SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS used_count FROM
  (SELECT symbol, date FROM hist QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 65) GROUP BY symbol),
gaps AS (SELECT t.*, (SELECT count(*) FROM cal WHERE is_trading AND date BETWEEN first_date AND last_date) - used_count AS missing FROM tail t),
expected AS (SELECT max(date) AS e FROM cal WHERE is_trading AND date <= DATE '{TARGET}'),
judged AS (SELECT c.symbol, e AS expected_session_date, g.first_date, g.last_date, coalesce(g.used_count, 0) AS used_count, input_count, excluded_future,
  CASE WHEN coalesce(g.used_count, 0) < 65 THEN 'INSUFFICIENT_COMPLETED_BARS' WHEN g.last_date <> e THEN 'STALE_DAILY_HISTORY'
    WHEN missing > 0 THEN 'MISSING_SCHEDULED_SESSIONS' END AS reason
  FROM counts c CROSS JOIN expected LEFT JOIN gaps g USING (symbol)),
result AS (SELECT j.*, CASE WHEN reason IS NOT NULL THEN 'insufficient_data' WHEN p.phase IS NOT NULL THEN 'match' ELSE 'not_match' END AS status,
  CASE WHEN reason IS NULL THEN p.phase END AS phase, coalesce(reason, CASE WHEN p.phase IS NULL THEN 'NO_RULE_MATCH' END) AS reason_code,
  CASE WHEN reason IS NULL THEN p.flags ELSE '' END AS flags, CASE WHEN reason IS NULL THEN round(p.ma20, 4) END AS ma20,
  CASE WHEN reason IS NULL THEN round(p.ma60, 4) END AS ma60, CASE WHEN reason IS NULL THEN round(p.vr, 6) END AS volume_ratio20,
  CASE WHEN reason IS NULL THEN round(p.ret5, 4) END AS return_5d_pct, CASE WHEN reason IS NULL THEN p.breakout_kind END AS breakout_kind
  FROM judged j LEFT JOIN m4 p ON p.symbol = j.symbol AND p.date = j.last_date
  UNION ALL SELECT symbol || '/closed', (SELECT e FROM expected), NULL, NULL, 0, count(*), count(CASE WHEN date > DATE '{TARGET}' THEN 1 END), NULL, 'insufficient_data', NULL,
    CASE WHEN min(date) <= DATE '{TARGET}' THEN 'BAR_ON_NONTRADING_DATE' ELSE 'INSUFFICIENT_COMPLETED_BARS' END, '', NULL, NULL, NULL, NULL, NULL
  FROM bars JOIN cal USING (date) WHERE NOT is_trading GROUP BY symbol)"""


@query("j14_swing_screen", _SWING_ROWS + """
SELECT symbol, status, phase, reason_code, flags, expected_session_date, first_date, last_date, CAST(used_count AS INTEGER) AS used_count,
  input_count, excluded_future, ma20, ma60, volume_ratio20, return_5d_pct, breakout_kind FROM result""")
def swing_screen(spark, d):
    r = swing_result(spark, d)
    return r.select("symbol", "status", "phase", "reason_code", F.array_join("risk_flags", ",").alias("flags"), "expected_session_date",
                    "first_date", "last_date", "used_count", "input_count", "excluded_future", F.round("ma20", 4).alias("ma20"),
                    F.round("ma60", 4).alias("ma60"), F.round("volume_ratio20", 6).alias("volume_ratio20"),
                    F.round("return_5d_pct", 4).alias("return_5d_pct"), "breakout_kind")


@query("d01_state_counts", _SWING_ROWS + """
SELECT count(*) AS total, count(CASE WHEN status = 'match' THEN 1 END) AS match, count(CASE WHEN status = 'not_match' THEN 1 END) AS not_match,
  count(CASE WHEN status = 'insufficient_data' THEN 1 END) AS insufficient_data, count(CASE WHEN phase = 'emerging' THEN 1 END) AS emerging,
  count(CASE WHEN phase = 'continuation' THEN 1 END) AS continuation, count(CASE WHEN flags <> '' THEN 1 END) AS flagged FROM result""")
def state_counts(spark, d):
    return S.swing_summary(swing_result(spark, d))


@query("j20_result_contract", _SWING_ROWS + " SELECT symbol, 'none' AS violation FROM result WHERE used_count < 0")
def result_contract(spark, d):
    return S.check_swing_result(swing_result(spark, d)).select("symbol", "violation")


@query("b16_threshold_overrides", f"""WITH {SESSION}, hist AS (SELECT * FROM bars), {_PANEL_COLS}
SELECT symbol, date, ext > 4 AS overextended, ret5 > 5 AS rapid FROM m4 WHERE n >= 65""")
def threshold_overrides(spark, d):
    p = S.swing_panel(T.session_bars(spark, d), {"max_extension_ma20_pct": 4, "max_return_5d_pct": 5})
    return p.select("symbol", "date", F.array_contains("risk_flags", "OVEREXTENDED_MA20").alias("overextended"),
                    F.array_contains("risk_flags", "RAPID_5_BAR_ADVANCE").alias("rapid"))


@query("j25_preset_panel", f"""WITH {SESSION}, p AS (SELECT symbol, date, close, volume_shares,
  CASE WHEN count(*) OVER a = 20 THEN avg(close) OVER a END AS ma20, CASE WHEN count(*) OVER b = 60 THEN avg(close) OVER b END AS ma60,
  CASE WHEN count(*) OVER c = 20 THEN max(high) OVER c END AS ph, CASE WHEN count(*) OVER e = 5 THEN avg(volume_shares) OVER e END AS mv FROM bars
  WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
  c AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), e AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
s AS (SELECT symbol, date, CASE WHEN ma20 IS NULL OR ma60 IS NULL THEN 2 ELSE (ma20 > ma60)::INT END AS c1,
  CASE WHEN ph IS NULL THEN 2 ELSE (close > ph)::INT END AS c2, CASE WHEN mv IS NULL THEN 2 ELSE (volume_shares / mv >= 1.2)::INT END AS c3 FROM p)
SELECT symbol, date, CASE WHEN greatest(c1, c2, c3) = 2 THEN 'insufficient' WHEN least(c1, c2, c3) = 1 THEN 'match' ELSE 'no_match' END AS state FROM s""")
def preset_panel(spark, d):
    return R.rule_panel(T.session_bars(spark, d), R.SWING_PRESET).select("symbol", "date", "state")


# -- frozen snapshot of the derived bars --------------------------------------
# A symbol has a second catalog number 8000 numbers later.
MEMBER = ["symbol", "catalog_no"]


def _group_no(spark, d):
    return T.table(spark, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / 4).alias("g")).agg(F.min("s_name").alias("s_name"))


def snapshot(spark, d):
    """Universe, stocks, series and bars as stored tables, with frames and run."""
    build = lambda i: lambda: _snapshot_tables(spark, d)[i]
    bars = T.kept_table(spark, f"frames {d}", lambda: _frame_bars(spark, d))
    universe, stocks, series = (
        T.kept_table(spark, f"{name} {d}", build(i)) for i, name in enumerate(("universe", "stocks", "series")))
    frames = {
        "D": {"cutoff_date": TARGET, "expected_last_date": TARGET},
        "W": {"cutoff_date": TARGET, "expected_last_date": TARGET},
        "M": {"cutoff_date": TARGET, "expected_last_date": "2001-05-01"},
    }
    run = {
        "generation": "synthetic-run", "target_session": TARGET, "calendar_version": T.WEEKLY_CALENDAR["version"],
        "policy_version": "local-ohlcv-v1", "synthetic": True, "directory_as_of": "2001-06-20",
        "verified_range": (T.WEEKLY_CALENDAR["start"], T.WEEKLY_CALENDAR["end"]),
    }
    return universe, stocks, series, bars, frames, run


def _frame_bars(spark, d):
    dim = _dim(spark)
    bars = T.session_bars(spark, d, "1d")
    bars = bars.join(F.broadcast(dim.filter("is_trading").select("date")), "date", "left_semi").select(*bars.columns)
    bars = bars.withColumn("interval", F.explode(F.array(F.lit("1d"), F.lit("1w"))))
    bars = C.with_bar_completion(bars.unionByName(T.session_bars(spark, d, "1mo")), dim, _as_of())
    completion = R.adapter_completion(F.col("complete"), F.col("calendar_completion"), F.col("completion_basis"))
    frame = F.element_at(F.create_map(*[F.lit(x) for x in ("1d", "D", "1w", "W", "1mo", "M")]), F.col("interval"))
    return bars.filter("period_end_session IS NOT NULL").select(
        "symbol", frame.alias("timeframe"), "date", F.col("date").alias("period_start"), F.col("period_end_session").alias("period_end"),
        completion.alias("completion"), "calendar_completion", "completion_basis", "source", "adjustment", "open", "high", "low", "close", "volume_shares")


def _snapshot_tables(spark, d):
    dim = _dim(spark)
    g = F.col("g")
    base = _group_no(spark, d).withColumn("symbol", T.code_of(g)).withColumn("catalog_no", g)
    universe = base.select(
        "symbol", F.upper(F.substring("symbol", 1, 2)).alias("exchange"),
        F.when(g % 19 == 4, F.concat(F.lit("*ST "), "s_name")).otherwise(F.col("s_name")).alias("name"),
        F.when(g % 23 == 6, "star").otherwise("mainboard").alias("board"),
        F.when(g % 17 == 3, "unknown").otherwise("non_st").alias("st_status"), "catalog_no")
    stocks = base.filter(g % 29 != 8).select(
        *MEMBER, F.when(g % 11 == 5, "error").otherwise("ready").alias("status"),
        F.when(g % 13 == 7, "suspended").otherwise("active").alias("suspension_state"),
        F.when(g % 31 == 9, F.lit("2001-06-11")).otherwise(F.lit("2001-12-31")).cast("date").alias("verified_through"))
    bars = T.kept_table(spark, f"frames {d}", lambda: _frame_bars(spark, d))
    returned = bars.groupBy("symbol", "timeframe").agg(F.count("*").alias("returned"), F.first("source").alias("source"), F.first("adjustment").alias("adjustment"))
    gaps = V.missing_sessions(bars.filter("timeframe = 'D'"), dim, keys=["symbol"]).groupBy("symbol").agg(
        F.collect_list("missing_date").alias("missing_sessions")).withColumn("timeframe", F.lit("D"))
    at = _as_of()
    series = returned.join(gaps, ["symbol", "timeframe"], "left").select(
        "symbol", "timeframe", F.lit("ready").alias("status"), F.lit("synthetic-run").alias("dataset_id"),
        F.lit(TARGET).cast("date").alias("target_session"), F.lit(T.WEEKLY_CALENDAR["version"]).alias("calendar_version"),
        F.lit("local-ohlcv-v1").alias("policy_version"), at.alias("request_started_at"), at.alias("completion_cutoff"), at.alias("fetched_at"),
        "source", "adjustment", F.lit("CNY").alias("currency"), F.lit("shares").alias("volume_unit"), "returned",
        F.coalesce("missing_sessions", F.array().cast("array<date>")).alias("missing_sessions"), F.lit(False).alias("calendar_gaps_unverified"))
    return universe, stocks, series


_G = "CAST(floor(s_suppkey / 4) AS BIGINT)"
_SNAP = f"""WITH {SESSION}, {SESSION_MONTH.replace('raw AS', 'rawm AS').replace('bars AS', 'mbars AS').replace('FROM raw ', 'FROM rawm ')}, {WKCAL},
hist AS (SELECT bars.* FROM bars JOIN cal ON bars.date = cal.date AND is_trading),
rng AS (SELECT symbol, min(date) AS a, max(date) AS b FROM hist GROUP BY symbol),
missing AS (SELECT r.symbol, cal.date AS md FROM rng r JOIN cal ON is_trading AND cal.date BETWEEN r.a AND r.b
  WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.symbol = r.symbol AND h.date = cal.date)),
dd AS (SELECT symbol, date, close, high, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY symbol) AS n,
  avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma20,
  avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS ma60,
  max(high) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ph,
  avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ma10,
  lag(date, 59) OVER (PARTITION BY symbol ORDER BY date) AS f60, lag(date, 20) OVER (PARTITION BY symbol ORDER BY date) AS f20
  FROM hist WHERE date <= DATE '{TARGET}'),
dl AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS c0, lag(ma10) OVER (PARTITION BY symbol ORDER BY date) AS m0 FROM dd),
mm AS (SELECT symbol, date, close, lag(close, 3) OVER (PARTITION BY symbol ORDER BY date) AS c3,
  row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM mbars
  WHERE date < DATE '2001-06-01' AND date >= DATE '1995-02-01'),
cond AS (SELECT d.symbol,
  CASE WHEN d.date < DATE '{TARGET}' OR n < 60 OR EXISTS (SELECT 1 FROM missing x WHERE x.symbol = d.symbol AND md BETWEEN f60 AND d.date) THEN 2 ELSE (ma20 > ma60)::INT END AS trend,
  CASE WHEN d.date < DATE '{TARGET}' OR n < 21 OR EXISTS (SELECT 1 FROM missing x WHERE x.symbol = d.symbol AND md BETWEEN f20 AND d.date) THEN 2 ELSE (d.close > ph)::INT END AS breakout,
  CASE WHEN d.date < DATE '{TARGET}' OR n < 11 THEN 2 ELSE (c0 <= m0 AND d.close > ma10)::INT END AS turn,
  CASE WHEN m.symbol IS NULL OR m.date < DATE '2001-05-01' OR c3 IS NULL THEN 2 ELSE ((m.close / c3 - 1) * 100 > 0)::INT END AS mon
  FROM dl d LEFT JOIN mm m ON m.symbol = d.symbol AND m.back = 1 WHERE d.back = 1),
tree AS (SELECT symbol, CASE WHEN greatest(trend, mon) = 2 THEN 2 ELSE least(trend, mon) END AS grp, breakout, turn, trend, mon FROM cond),
sev AS (SELECT *, greatest(grp, breakout, turn) AS severity FROM tree),
u AS (SELECT DISTINCT {_G} AS g, {code_sql(_G)} AS symbol FROM supplier),
scoped AS (SELECT *, CASE WHEN g % 19 = 4 OR g % 23 = 6 THEN 'excluded' ELSE 'candidate' END AS scope FROM u),
gated AS (SELECT *, CASE WHEN scope <> 'candidate' THEN NULL WHEN g % 17 = 3 THEN 'ST_STATUS_UNKNOWN' WHEN g % 29 = 8 THEN 'MISSING_STOCK'
  WHEN g % 11 = 5 THEN 'DATA_FAILURE' WHEN g % 13 = 7 THEN 'SUSPENDED' WHEN g % 31 = 9 THEN 'SUSPENSION_UNKNOWN' END AS gate FROM scoped),
rowz AS (SELECT gated.symbol, scope, gate, CASE WHEN scope <> 'candidate' THEN NULL WHEN gate = 'DATA_FAILURE' THEN 'failure' WHEN gate IS NOT NULL THEN 'insufficient'
  ELSE ['no_match', 'match', 'insufficient'][coalesce(severity, 2) + 1] END AS state FROM gated LEFT JOIN sev USING (symbol)),
final AS (SELECT *, CASE WHEN scope <> 'candidate' THEN NULL WHEN state = 'match' THEN 'pass' WHEN state = 'no_match' THEN 'fail' ELSE 'unknown' END AS decision,
  CASE WHEN state = 'match' THEN true WHEN state = 'no_match' THEN false END AS passed FROM rowz)"""


@query("j17_rule_screen", _SNAP + " SELECT symbol, scope, state, gate, decision, passed FROM final")
def rule_screen(spark, d):
    return R.screen(*snapshot(spark, d), RULE, member=MEMBER)[0]


@query("j15_rule_conditions", _SNAP + """ SELECT symbol, id, severity FROM (
  SELECT symbol, 'trend' AS id, trend AS severity FROM cond UNION ALL SELECT symbol, 'breakout', breakout FROM cond
  UNION ALL SELECT symbol, 'turn', turn FROM cond UNION ALL SELECT symbol, 'month', mon FROM cond)
WHERE symbol IN (SELECT symbol FROM scoped WHERE scope = 'candidate')""")
def rule_conditions(spark, d):
    return R.screen(*snapshot(spark, d), RULE)[1].select("symbol", "id", "severity")


@query("d09_group_states", _SNAP + """ SELECT severity, count(*) AS symbols FROM sev
WHERE symbol IN (SELECT symbol FROM scoped WHERE scope = 'candidate') GROUP BY severity""")
def group_states(spark, d):
    results = R.screen(*snapshot(spark, d), RULE)[1]
    states = results.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("id", "severity"))).alias("s"))
    total = R.tree_severity(RULE["root"], lambda c: F.element_at("s", F.lit(c["id"])))
    return states.groupBy(total.alias("severity")).agg(F.count("*").alias("symbols"))


@query("j17_screen_counts", _SNAP + """ SELECT count(*) AS catalog_total, count(CASE WHEN scope = 'excluded' THEN 1 END) AS excluded_total,
  CAST(0 AS BIGINT) AS restriction_excluded_total, count(CASE WHEN scope = 'candidate' THEN 1 END) AS total,
  count(CASE WHEN state = 'no_match' THEN 1 END) AS no_match, count(CASE WHEN state = 'match' THEN 1 END) AS match,
  count(CASE WHEN state = 'insufficient' THEN 1 END) AS insufficient, count(CASE WHEN state = 'failure' THEN 1 END) AS failure,
  CAST(0 AS BIGINT) AS unprocessed, count(state) AS processed, count(passed) AS successful FROM final""")
def screen_counts(spark, d):
    return R.screen_counts(R.screen(*snapshot(spark, d), RULE, member=MEMBER)[0])


@query("b13_user_restriction", _SNAP + """ SELECT symbol, CASE WHEN scope = 'candidate' AND substr(symbol, 1, 2) = 'sz' THEN 'restriction_excluded'
  ELSE scope END AS scope FROM scoped""")
def user_restriction(spark, d):
    universe = snapshot(spark, d)[0]
    return R.universe_scope(universe, {"exchanges": ["SH"]}).select("symbol", "scope")


@query("b15_frame_filter", f"""WITH {SESSION}, {WKCAL}, hist AS (SELECT bars.* FROM bars JOIN cal ON bars.date = cal.date AND is_trading)
SELECT symbol, date FROM hist WHERE date <= DATE '{TARGET}' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 61""")
def frame_filter(spark, d):
    _, _, series, bars, frames, run = snapshot(spark, d)
    p = R.prepared_frames(bars, series, frames, run, {"D": 61})
    return p.select("symbol", F.explode("_tail").alias("bar")).select("symbol", "bar.date")


@query("c12_gap_interval_join", f"""WITH {SESSION}, {WKCAL}, hist AS (SELECT bars.* FROM bars JOIN cal ON bars.date = cal.date AND is_trading),
rng AS (SELECT symbol, min(date) AS a, max(date) AS b FROM hist GROUP BY symbol),
missing AS (SELECT r.symbol, cal.date AS md FROM rng r JOIN cal ON is_trading AND cal.date BETWEEN r.a AND r.b
  WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.symbol = r.symbol AND h.date = cal.date)),
w AS (SELECT symbol, date, lag(date, 19) OVER (PARTITION BY symbol ORDER BY date) AS f FROM hist)
SELECT symbol, date, (SELECT count(*) FROM missing m WHERE m.symbol = w.symbol AND md BETWEEN f AND date) AS missing_in_window FROM w WHERE f IS NOT NULL""")
def gap_interval_join(spark, d):
    dim = _dim(spark)
    b = T.session_bars(spark, d).join(F.broadcast(dim.filter("is_trading").select("date")), "date", "left_semi")
    b = V.with_session_number(b.select("symbol", "date"), dim)
    from pyspark.sql import Window

    first = F.lag("session_number", 19).over(Window.partitionBy("symbol").orderBy("date"))
    b = b.withColumn("missing_in_window", F.col("session_number") - first + 1 - 20)
    return b.filter("missing_in_window IS NOT NULL").select("symbol", "date", "missing_in_window")


@query("c03_cross_frame_basis", """SELECT o_custkey, count(DISTINCT o_orderstatus || '/' || o_orderpriority) > 1 AS mixed_basis FROM orders GROUP BY 1""")
def cross_frame_basis(spark, d):
    o = T.table(spark, d, "orders")
    return o.groupBy("o_custkey").agg((F.count_distinct("o_orderstatus", "o_orderpriority") > 1).alias("mixed_basis"))


@query("c14_suspension_join", f"""WITH u AS (SELECT DISTINCT {_G} AS g FROM supplier)
SELECT {code_sql('g')} AS symbol, CASE WHEN g % 29 = 8 THEN 'SUSPENSION_UNKNOWN' WHEN g % 13 = 7 THEN 'SUSPENDED' WHEN g % 31 = 9 THEN 'SUSPENSION_UNKNOWN' ELSE 'active' END AS evidence FROM u""")
def suspension_join(spark, d):
    universe, stocks, *_ = snapshot(spark, d)
    j = universe.join(stocks, MEMBER, "left")
    ok = (F.col("suspension_state") == "active") & (F.col("verified_through") >= F.lit(TARGET).cast("date"))
    return j.select("symbol", F.when(F.col("suspension_state") == "suspended", "SUSPENDED").when(
        ~F.coalesce(ok, F.lit(False)), "SUSPENSION_UNKNOWN").otherwise("active").alias("evidence"))
