"""Fixed swing screen over adjusted daily histories.

`swing_screen` judges every series at one cutoff, fail-closed. `swing_panel`
evaluates the same predicates at every bar of every series.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clock import shanghai_date
from ..functions.numbers import finite
from ..operators.calendar import completed_by, latest_completed
from ..operators.indicators import Series
from ..sources.captures import settled

# Threshold defaults and bounds, and the fixed periods.
DEFAULTS = {
    "breakout_volume_ratio": 1.5,
    "continuation_volume_ratio": 0.8,
    "continuation_near_high_pct": 5,
    "max_extension_ma20_pct": 12,
    "max_return_5d_pct": 20,
}
BOUNDS = {
    "breakout_volume_ratio": (1, 5),
    "continuation_volume_ratio": (0.1, 5),
    "continuation_near_high_pct": (0, 20),
    "max_extension_ma20_pct": (1, 50),
    "max_return_5d_pct": (1, 100),
}
MINIMUM_BARS = 65

EMERGING = ("above_ma20", "ma20_rising", "breakout_prior20", "breakout_volume")
CONTINUATION = (
    "above_ma20", "ma20_rising", "ma_alignment", "ma60_rising", "near_prior20_high", "continuation_volume",
)
METRICS = (
    "close", "ma20", "ma60", "ma20_5_bars_ago", "ma60_5_bars_ago", "ma20_change_5d_pct", "ma60_change_5d_pct",
    "prior_high20", "volume_shares", "prior_mean_volume20", "volume_ratio20", "close_5_bars_ago",
    "return_5d_pct", "extension_ma20_pct",
)


def thresholds(overrides=None) -> dict:
    """Defaults merged with overrides; unknown keys and values out of bounds fail."""
    given = dict(overrides or {})
    for key, value in given.items():
        if key not in BOUNDS:
            raise ValueError(f"unknown swing threshold {key!r}")
        low, high = BOUNDS[key]
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
            raise ValueError(f"swing threshold {key} must lie in {low}..{high}")
    return {**DEFAULTS, **given}


def valid_values() -> Column:
    """Positive contained prices and a non-negative volume."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume_shares"))
    numbers = finite(o) & finite(h) & finite(l) & finite(c) & finite(v)
    return F.coalesce(
        numbers & (o > 0) & (h > 0) & (l > 0) & (c > 0) & (v >= 0)
        & (l <= h) & (o >= l) & (o <= h) & (c >= l) & (c <= h),
        F.lit(False),
    )


def _derived(m: dict) -> dict:
    """Ratios that follow from the base metrics."""
    pct = lambda a, b: 100 * (a / b - 1)
    return {
        **m,
        "ma20_change_5d_pct": pct(m["ma20"], m["ma20_5_bars_ago"]),
        "ma60_change_5d_pct": pct(m["ma60"], m["ma60_5_bars_ago"]),
        "volume_ratio20": m["volume_shares"] / F.nullif(m["prior_mean_volume20"], F.lit(0.0)),
        "return_5d_pct": pct(m["close"], m["close_5_bars_ago"]),
        "extension_ma20_pct": pct(m["close"], m["ma20"]),
    }


def with_checks(df: DataFrame, t: dict) -> DataFrame:
    """Predicates, phase, breakout kind and risk flags from metric columns."""
    m = {name: F.col(name) for name in METRICS}
    near = m["prior_high20"] * (1 - F.lit(t["continuation_near_high_pct"]) / 100)
    checks = {
        "above_ma20": m["close"] > m["ma20"],
        "ma20_rising": m["ma20"] > m["ma20_5_bars_ago"],
        "breakout_prior20": m["close"] > m["prior_high20"],
        "breakout_volume": m["volume_ratio20"] >= t["breakout_volume_ratio"],
        "ma_alignment": m["ma20"] > m["ma60"],
        "ma60_rising": m["ma60"] > m["ma60_5_bars_ago"],
        "near_prior20_high": m["close"] >= near,
        "continuation_volume": m["volume_ratio20"] >= t["continuation_volume_ratio"],
    }
    df = df.withColumns(checks)
    all_of = lambda names: F.forall(F.array(*names), lambda x: x)
    df = df.withColumns({"emerging": all_of(EMERGING), "continuation": all_of(CONTINUATION)})
    flags = F.array_compact(F.array(
        F.when(m["extension_ma20_pct"] > t["max_extension_ma20_pct"], "OVEREXTENDED_MA20"),
        F.when(m["return_5d_pct"] > t["max_return_5d_pct"], "RAPID_5_BAR_ADVANCE"),
    ))
    phase = F.when(F.col("continuation"), "continuation").when(F.col("emerging"), "emerging")
    again = F.col("previous_close") > F.col("previous_prior_high20")
    kind = F.when(F.col("breakout_prior20"), F.when(again, "repeated").otherwise("fresh"))
    return df.withColumns({"phase": phase, "breakout_kind": kind, "risk_flags": flags})


def swing_panel(bars: DataFrame, overrides=None, keys=("symbol",), order="date") -> DataFrame:
    """Metrics, checks and phase at every bar with 65 bars behind it.

    One shuffle on the series key and one sort serve all window frames.
    """
    t = thresholds(overrides)
    s = Series(keys, order)
    close, high, volume = F.col("close"), F.col("high"), F.col("volume_shares")
    base = bars.withColumns({
        "_n": F.row_number().over(s.window),
        "ma20": F.avg(close).over(s.rows(-19, 0)),
        "ma60": F.avg(close).over(s.rows(-59, 0)),
        "prior_high20": F.max(high).over(s.rows(-20, -1)),
        "previous_prior_high20": F.max(high).over(s.rows(-21, -2)),
        "prior_mean_volume20": F.avg(volume).over(s.rows(-20, -1)),
        "close_5_bars_ago": F.lag(close, 5).over(s.window),
        "previous_close": F.lag(close, 1).over(s.window),
    })
    base = base.withColumns({
        "ma20_5_bars_ago": F.lag("ma20", 5).over(s.window),
        "ma60_5_bars_ago": F.lag("ma60", 5).over(s.window),
    }).filter(F.col("_n") >= MINIMUM_BARS).drop("_n")
    given = ("close", "volume_shares", "ma20", "ma60", "ma20_5_bars_ago", "ma60_5_bars_ago",
             "prior_high20", "prior_mean_volume20", "close_5_bars_ago")
    metrics = _derived({name: F.col(name) for name in given})
    new = {k: v for k, v in metrics.items() if k not in base.columns}
    return with_checks(base.withColumns(new), t)


def _row_stage(df: DataFrame, dim: DataFrame, as_of: Column) -> DataFrame:
    """Classify each row in the order the history is judged.

    `_skip` rows never reach an indicator; `_fail` rows end their series.
    """
    side = dim.select(F.col("date").alias("_d"), "is_trading")
    df = df.join(F.broadcast(side), F.col("date") == F.col("_d"), "left").drop("_d")
    today = shanghai_date(as_of)
    date, trading = F.col("date"), F.col("is_trading")
    done = F.coalesce(trading & completed_by(date, as_of), F.lit(False))
    bad_date = date.isNull() | F.coalesce(shanghai_date(F.col("source_timestamp")) != date, F.lit(True))
    early = (
        F.when(bad_date, "INVALID_HISTORY_DATE")
        .when(date > today, "future")
        .when((date == today) & ~done, "current")
    )
    late = (
        F.when((F.col("source") != "tencent") | (F.col("adjustment") != "qfq"), "MIXED_HISTORY_BASIS")
        .when(trading.isNull(), "unknown_calendar")
        .when(~trading, "BAR_ON_NONTRADING_DATE")
        .when(~F.coalesce(F.col("complete"), F.lit(False)) | ~done, "incomplete")
        .when(~valid_values(), "INVALID_HISTORY_VALUES")
    )
    return df.withColumns({"_early": early, "_late": late})


SKIPS = ("future", "current", "unknown_calendar", "incomplete")


def swing_screen(bars: DataFrame, dim: DataFrame, as_of: Column, overrides=None, universe: DataFrame | None = None, requested: int | None = None) -> DataFrame:
    """Judge every symbol's history at a frozen cutoff; one row per symbol.

    `bars` needs symbol, source, adjustment, date, source_timestamp, OHLC,
    volume_shares, complete and row_no (input order). With a `universe`
    (column symbol), members without bars get an INVALID_HISTORY row. A
    history without any row of the provider, adjustment and (where bars carry
    one) interval that are screened, or of more than `requested` rows, has an
    INVALID_HISTORY_BASIS; `reordered` tells that its rows did not come in
    date order.
    """
    t = thresholds(overrides)
    if universe is not None:
        bars = bars.join(universe.select("symbol").distinct(), "symbol", "left_semi")
    rows = _row_stage(bars, dim, as_of)
    # All rows are counted, and those skipped before the duplicate test are
    # only counted: they need no window and may be any number.
    early_fail = F.when(~F.col("_early").isin(*SKIPS), F.col("row_no"))
    basis = (F.col("source") == "tencent") & (F.col("adjustment") == "qfq")
    if "interval" in rows.columns:
        basis = basis & (F.col("interval") == "1d")
    off_basis = F.count_if(basis) == 0
    if requested is not None:
        off_basis = off_basis | (F.count("*") > requested)
    totals = rows.groupBy("symbol").agg(
        F.count("*").alias("input_count"), F.count_if(F.col("_early") == "current").alias("excluded_current_date"),
        F.count_if(F.col("_early") == "future").alias("excluded_future"), F.min(early_fail).alias("_early_row"),
        off_basis.alias("_off_basis"))
    # A repeated date fails at its second row. Ranks above 2 cannot come first,
    # and the <= 2 limit is applied before the shuffle.
    rows = rows.filter(F.col("_early").isNull())
    rank = F.row_number().over(Window.partitionBy("symbol", "date").orderBy("row_no"))
    rows = rows.withColumn("_seen", rank).filter(F.col("_seen") <= 2)
    stage = F.coalesce(F.when(F.col("_seen") == 2, "DUPLICATE_HISTORY_DATE"), F.col("_late"), F.lit("eligible"))
    rows = rows.withColumn("_stage", stage)
    eligible = F.col("_stage") == "eligible"
    backward = F.lag("date").over(Window.partitionBy("symbol").orderBy("row_no")) > F.col("date")
    rows = rows.withColumn("_backward", F.coalesce(backward, F.lit(False)))
    newest = Window.partitionBy("symbol").orderBy(eligible.desc(), F.col("date").desc())
    rows = rows.withColumn("_back", F.row_number().over(newest))
    bar = F.struct("date", "open", "high", "low", "close", "volume_shares")
    failing = ~F.col("_stage").isin("eligible", *SKIPS)
    judged = {
        "completed_count": F.count_if(eligible),
        "excluded_incomplete": F.count_if(F.col("_stage") == "incomplete"),
        "excluded_unknown_calendar": F.count_if(F.col("_stage") == "unknown_calendar"),
    }
    counts = ("input_count", "completed_count", "excluded_current_date", "excluded_future", "excluded_incomplete", "excluded_unknown_calendar")
    series = rows.groupBy("symbol").agg(
        F.min(F.when(failing, F.struct("row_no", "_stage"))).alias("_late_fail"),
        # At most 65 bars per symbol reach the list.
        F.array_sort(F.collect_list(F.when(eligible & (F.col("_back") <= MINIMUM_BARS), bar))).alias("_used"),
        F.bool_or("_backward").alias("reordered"), *[c.alias(n) for n, c in judged.items()],
    )
    series = totals.join(series, "symbol", "left").fillna(0, list(judged))
    late = F.col("_late_fail")
    first = F.col("_early_row").isNotNull() & (late.isNull() | (F.col("_early_row") < late["row_no"]))
    series = series.withColumn("_row_fail", F.when(first, "INVALID_HISTORY_DATE").otherwise(late["_stage"]))
    series = series.withColumn("_row_fail", F.when(F.col("_off_basis"), "INVALID_HISTORY_BASIS").otherwise(F.col("_row_fail")))
    series = series.withColumn("reordered", F.coalesce("reordered", F.lit(False)) & F.col("_row_fail").isNull())
    series = settled(series.withColumn("_used", F.coalesce("_used", F.array().cast(series.schema["_used"].dataType))))
    if universe is not None:
        series = universe.select("symbol").distinct().join(series, "symbol", "left")
    today_dim = dim.filter(F.col("date") == shanghai_date(as_of)).select(
        F.col("is_trading").alias("now_is_trading"), F.col("end_1d").alias("now_end_1d"),
        F.col("prev_end_1d").alias("now_prev_end_1d"))
    expected = today_dim.select(F.max(latest_completed("now", "1d", as_of))).scalar()
    series = series.withColumns({
        "expected_session_date": expected,
        "used_count": F.coalesce(F.size("_used"), F.lit(0)),
        "first_date": F.get("_used", F.lit(0))["date"],
        "last_date": F.get("_used", F.size("_used") - 1)["date"],
    })
    for side, col in (("_first", "first_date"), ("_last", "last_date")):
        numbers = dim.select(F.col("date").alias(col), F.col("session_number").alias(f"{side}_no"))
        series = series.join(F.broadcast(numbers), col, "left")
    span = F.col("_last_no") - F.col("_first_no") + 1
    series = series.withColumn("missing_scheduled_sessions", F.greatest(span - F.col("used_count"), F.lit(0)))
    series = _tail_metrics(series)
    finite_all = F.forall(F.array(*[F.coalesce(F.col(m).cast("double"), F.lit(float("nan"))) for m in METRICS]), finite)
    reason = F.coalesce(
        F.when(F.col("input_count").isNull(), "INVALID_HISTORY"),
        F.col("_row_fail"),
        F.when(F.col("expected_session_date").isNull(), "UNKNOWN_CALENDAR"),
        F.when(F.col("used_count") < MINIMUM_BARS, "INSUFFICIENT_COMPLETED_BARS"),
        F.when(F.col("last_date") != F.col("expected_session_date"), "STALE_DAILY_HISTORY"),
        F.when(F.col("missing_scheduled_sessions") > 0, "MISSING_SCHEDULED_SESSIONS"),
        F.when(F.col("prior_mean_volume20") <= 0, "NONPOSITIVE_VOLUME_BASELINE"),
        F.when(~finite_all, "INVALID_DERIVED_METRICS"),
    )
    out = with_checks(series, t).withColumn("_reason", reason)
    usable = F.col("_reason").isNull()
    status = F.when(~usable, "insufficient_data").when(F.col("phase").isNotNull(), "match").otherwise("not_match")
    code = F.coalesce("_reason", F.when(F.col("phase").isNull(), "NO_RULE_MATCH"))
    keep = [*METRICS, *dict.fromkeys(EMERGING + CONTINUATION), "emerging", "continuation", "breakout_kind"]
    return out.select(
        "symbol", status.alias("status"), F.when(usable, F.col("phase")).alias("phase"), code.alias("reason_code"),
        F.when(usable, F.col("risk_flags")).otherwise(F.array().cast("array<string>")).alias("risk_flags"),
        "expected_session_date", "first_date", "last_date", "used_count", *counts, "missing_scheduled_sessions",
        F.coalesce("reordered", F.lit(False)).alias("reordered"),
        *[F.when(usable, F.col(c)).alias(c) for c in keep],
    )


def _tail_metrics(series: DataFrame) -> DataFrame:
    """Metrics of the newest bar from the (at most 65) used bars.

    Sums run left to right over the slice, so equality-sensitive comparisons
    see the same doubles as a row-order window would.
    """
    def tail(field, length, back=0):
        start = f"greatest(size(_used) - {back + length - 1}, 1)"
        return f"transform(slice(_used, {start}, {length}), b -> b.{field})"

    def mean(field, length, back=0):
        return f"aggregate({tail(field, length, back)}, 0D, (a, x) -> a + x) / {length}"

    at = lambda field, back=0: f"get(_used, size(_used) - {1 + back}).{field}"
    base = {
        "close": at("close"),
        "volume_shares": at("volume_shares"),
        "ma20": mean("close", 20),
        "ma60": mean("close", 60),
        "ma20_5_bars_ago": mean("close", 20, 5),
        "ma60_5_bars_ago": mean("close", 60, 5),
        "prior_high20": f"array_max({tail('high', 20, 1)})",
        "previous_prior_high20": f"array_max({tail('high', 20, 2)})",
        "prior_mean_volume20": mean("volume_shares", 20, 1),
        "close_5_bars_ago": at("close", 5),
        "previous_close": at("close", 1),
    }
    full = f"size(_used) >= {MINIMUM_BARS}"
    series = series.withColumns({k: F.expr(f"CASE WHEN {full} THEN {v} END") for k, v in base.items()})
    metrics = _derived({k: F.col(k) for k in base if k in METRICS})
    return series.withColumns({k: v for k, v in metrics.items() if k not in base})


def swing_summary(result: DataFrame) -> DataFrame:
    """Counts by status with the total they must add up to."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return result.agg(
        F.count("*").alias("total"), is_("match").alias("match"), is_("not_match").alias("not_match"),
        is_("insufficient_data").alias("insufficient_data"),
        F.count_if(F.col("phase") == "emerging").alias("emerging"),
        F.count_if(F.col("phase") == "continuation").alias("continuation"),
        F.count_if(F.size("risk_flags") > 0).alias("flagged"),
    )


def check_swing_result(result: DataFrame, expected_session: Column | None = None) -> DataFrame:
    """Rows that break the result contract, with the rule they break."""
    r = F.col
    expected = r("expected_session_date") if expected_session is None else expected_session
    judged = r("status") != "insufficient_data"
    numbers = ("close", "ma20", "ma60", "prior_high20", "volume_shares", "prior_mean_volume20",
               "volume_ratio20", "return_5d_pct", "extension_ma20_pct")
    positive = ("close", "ma20", "ma60", "prior_high20", "prior_mean_volume20")
    all_of = lambda cols: F.forall(F.array(*cols), lambda x: F.coalesce(x, F.lit(False)))
    phase = F.when(r("continuation"), "continuation").when(r("emerging"), "emerging")
    violation = (
        F.when(~r("status").isin("match", "not_match", "insufficient_data"), "STATUS")
        .when(~r("expected_session_date").eqNullSafe(expected), "MIXED_SESSION")
        .when(~judged & (r("reason_code").isNull() | r("phase").isNotNull() | r("close").isNotNull()), "INSUFFICIENT_SHAPE")
        .when(judged & ((r("used_count") != MINIMUM_BARS) | (r("last_date") != expected)), "SAMPLE")
        .when(judged & ~all_of([finite(r(c)) for c in numbers]), "METRIC_NOT_FINITE")
        .when(judged & ~all_of([r(c) > 0 for c in positive]), "METRIC_NOT_POSITIVE")
        .when(judged & (r("emerging") != all_of([r(c) for c in EMERGING])), "EMERGING_CHECKS")
        .when(judged & (r("continuation") != all_of([r(c) for c in CONTINUATION])), "CONTINUATION_CHECKS")
        .when(judged & ~r("phase").eqNullSafe(phase), "PHASE")
        .when(judged & (r("status") != F.when(phase.isNotNull(), "match").otherwise("not_match")), "STATUS_PHASE")
    )
    # A generator keeps the long expression from being copied into a filter.
    return result.select(*result.columns, F.explode(F.array_compact(F.array(violation))).alias("violation"))
