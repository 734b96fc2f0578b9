"""Market phase, freshness and security-status columns."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import instant_at, period_start, shanghai_date, shanghai_minute
from ..functions.numbers import age_seconds
from .calendar import completed_by, latest_completed, with_asof_dim

# Phase upper bounds in minutes of the +08:00 day, with the
# wall-clock second whose observation the phase expects (None = now).
PHASES = [
    (555, "pre_open", 15 * 3600),
    (565, "opening_auction", 15 * 3600),
    (570, "opening_auction_gap", 9 * 3600 + 25 * 60),
    (690, "continuous_am", None),
    (780, "lunch_break", 11 * 3600 + 30 * 60),
    (897, "continuous_pm", None),
    (900, "closing_auction", 14 * 3600 + 57 * 60),
    (1440, "after_close", 15 * 3600),
]
PREVIOUS_SESSION_PHASES = ("closed", "pre_open", "opening_auction")
ACTIVE_PHASES = ("continuous_am", "continuous_pm")
FUTURE_TOLERANCE = -5


def with_market_phase(df: DataFrame, dim: DataFrame, now: str = "as_of") -> DataFrame:
    """Add phase, trading_day, expected session and expected source timestamp."""
    ts = F.col(now)
    df = with_asof_dim(df, dim, shanghai_date(ts), "mkt", ["is_trading", "session_before"])
    minute = shanghai_minute(ts)
    trading = F.col("mkt_is_trading")
    phase = F.when(trading.isNull(), "unknown").when(~trading, "closed")
    for bound, name, _ in PHASES:
        phase = phase.when(minute < bound, name)
    df = df.withColumn("market_phase", phase)
    p = F.col("market_phase")
    session = (
        F.when(p == "unknown", F.lit(None).cast("date"))
        .when(p.isin(*PREVIOUS_SESSION_PHASES), F.col("mkt_session_before"))
        .otherwise(shanghai_date(ts))
    )
    clock = F.when(p == "closed", F.lit(15 * 3600))
    for _, name, second in PHASES:
        if second is not None:
            clock = clock.when(p == name, F.lit(second))
    expected = F.when(p.isin(*ACTIVE_PHASES), ts).otherwise(instant_at(session, clock))
    return (
        df.withColumn("trading_day", trading)
        .withColumn("expected_session_date", session)
        .withColumn("expected_source_timestamp", expected)
        .drop("mkt_is_trading", "mkt_session_before")
    )


def fixed_freshness(ts: Column, now: Column, max_age: float) -> Column:
    """Age-only freshness: future beyond 5 s, recent up to a limit, else stale."""
    age = age_seconds(now, ts)
    return (
        F.when(age < FUTURE_TOLERANCE, "future_timestamp").when(age <= max_age, "recent").otherwise("stale")
    )


def with_freshness(df, dim, ts="source_timestamp", now="as_of", kind="quote", max_age=90) -> DataFrame:
    """Add `freshness_status` (and the phase columns it derives from).

    `kind` is quote, auction or a bar interval (1d, 1w, 1mo).
    """
    if "market_phase" not in df.columns:
        df = with_market_phase(df, dim, now)
    t, n = F.col(ts), F.col(now)
    age = age_seconds(n, t)
    observed, today = shanghai_date(t), shanghai_date(n)
    bar = kind in ("1d", "1w", "1mo")
    status = F.when(t.isNull(), "invalid_timestamp")
    status = status.when((observed > today) if bar else (age < FUTURE_TOLERANCE), "future_timestamp")
    status = status.when(F.col("market_phase") == "unknown", "unknown")
    if kind == "auction":
        second = F.floor(F.pmod(F.unix_micros(n) + 8 * 3600 * 10**6, F.lit(86_400 * 10**6)) / 10**6)
        window = F.col("trading_day") & (second >= 9 * 3600 + 15 * 60) & (second < 9 * 3600 + 31 * 60)
        status = (
            status.when(observed < today, "prior_session_observations")
            .when(window & (age <= max_age), "delayed_recent_observation")
            .when(window, "delayed_observation_lagging")
            .otherwise("historical_auction_observations")
        )
    elif bar:
        df = with_asof_dim(df, dim, today, "fn", ["is_trading", f"end_{kind}", f"prev_end_{kind}"])
        df = with_asof_dim(df, dim, observed, "fb", ["is_trading", f"end_{kind}"])
        expected = latest_completed("fn", kind, n)
        done = completed_by(F.col(f"fb_end_{kind}"), n)
        if kind == "1d":
            done = done & F.coalesce("fb_is_trading", F.lit(False))
        status = (
            status.when(expected.isNull(), "unknown")
            .when(period_start(observed, kind) < period_start(expected, kind), "stale")
            .when(~F.coalesce(done, F.lit(False)), "incomplete")
            .otherwise("latest_session")
        )
    else:
        behind = age_seconds(F.col("expected_source_timestamp"), t)
        status = (
            status.when(F.col("expected_source_timestamp").isNull(), "unknown")
            .when(behind > max_age, "stale")
            .when(F.col("market_phase").isin(*ACTIVE_PHASES) | (age <= max_age), "recent")
            .otherwise("latest_session")
        )
    df = df.withColumn("freshness_status", status).withColumn("age_seconds", F.round(age).cast("long"))
    if kind == "quote":
        lag = age_seconds(F.col("expected_source_timestamp"), t)
        df = df.withColumn("lag_from_expected_seconds", F.greatest(F.lit(0), F.round(lag)).cast("long"))
    return df.drop("fn_is_trading", f"fn_end_{kind}", f"fn_prev_end_{kind}", "fb_is_trading", f"fb_end_{kind}")


def with_security_status(quotes: DataFrame) -> DataFrame:
    """Project provider limit fields to a status; never inferred from prices."""
    verified = (F.col("source") == "tencent") & F.col("price_relation").isNotNull()
    return (
        quotes.withColumn("suspension", F.lit("unknown"))
        .withColumn("price_limit_status", F.when(verified, F.col("price_relation")).otherwise("unknown"))
        .withColumn("status_limit_up", F.when(verified, F.col("limit_up_price")))
        .withColumn("status_limit_down", F.when(verified, F.col("limit_down_price")))
    )


def annotate(df, dim, as_of="as_of", kind="quote", max_age=90) -> DataFrame:
    """Market phase, freshness and, for quotes, security status on every row."""
    out = with_freshness(df, dim, now=as_of, kind=kind, max_age=max_age)
    if "price_relation" in out.columns:
        out = with_security_status(out)
    return out
