"""Trading-calendar dimension and bar-completion evidence.

A calendar holds one row per covered date. A date without a row is unknown,
never closed. Its size is bounded by the covered years, which is checked
before it is used as a broadcast side.
"""

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.clock import instant_at, period_end, period_start, shanghai_date

# Announced 2026 sessions (weekday rule plus closed ranges).
ANNOUNCED_2026 = {
    "version": "exchange-announced-2026-v1",
    "start": "2026-01-01",
    "end": "2026-12-31",
    "closed_ranges": [
        ("2026-01-01", "2026-01-03"),
        ("2026-02-15", "2026-02-23"),
        ("2026-04-04", "2026-04-06"),
        ("2026-05-01", "2026-05-05"),
        ("2026-06-19", "2026-06-21"),
        ("2026-09-25", "2026-09-27"),
        ("2026-10-01", "2026-10-07"),
    ],
}

# Day-level completion boundary, 15:30:00 plus 3 seconds.
COMPLETION_SECOND = 15 * 3600 + 30 * 60 + 3

MAX_CALENDAR_DAYS = 366 * 200
INTERVALS = ("1d", "1w", "1mo")

INVALID_DAY = "invalid_nontrading_daily_label"
ELAPSED = "elapsed_calendar_period_unverified_exchange_calendar"
VERIFIED = "verified_calendar_schedule_with_conservative_buffer"


def covered_dates(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every date of a coverage range; refuses ranges too long to broadcast."""
    days = (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days + 1
    if not 1 <= days <= MAX_CALENDAR_DAYS:
        raise ValueError(f"calendar range of {days} days is outside 1..{MAX_CALENDAR_DAYS}")
    first = F.lit(start).cast("date")
    return spark.range(0, days, 1, 1).select(F.date_add(first, F.col("id").cast("int")).alias("date"))


def mark_closed_rows(rows: DataFrame, closed: DataFrame, date="date", version: str | None = None) -> DataFrame:
    """Flag table rows whose date falls in a closed range.

    The ranges are expanded to dates first, which turns the range join into
    an equi-join on the date; Spark broadcasts them where its size statistics
    allow. `version` names the rows' calendar version, for ranges that carry
    a calendar_version.
    """
    day = F.explode(F.sequence("first_date", "last_date")).alias("_closed_day")
    same = F.col(date) == F.col("_closed_day")
    if version is None:
        days = closed.select(day).distinct()
    else:
        days = closed.select(day, F.col("calendar_version").alias("_closed_version")).distinct()
        same = same & (F.col(version) == F.col("_closed_version"))
    out = rows.join(days, same, "left")
    return out.withColumn("in_closed_range", F.col("_closed_day").isNotNull()).drop("_closed_day", "_closed_version")


def build_calendar(spark, version, start, end, closed_ranges=(), open_weekdays=(0, 1, 2, 3, 4)) -> DataFrame:
    """Calendar rows (calendar_version, date, is_trading).

    `open_weekdays` counts from Monday = 0. Work-shift weekends stay closed.
    """
    dates = covered_dates(spark, start, end)
    ranges = spark.createDataFrame(
        [(dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for a, b in closed_ranges],
        "first_date date, last_date date",
    )
    marked = mark_closed_rows(dates, ranges)
    open_day = F.weekday("date").isin(list(open_weekdays)) & ~F.col("in_closed_range")
    return marked.select(F.lit(version).alias("calendar_version"), "date", open_day.alias("is_trading"))


def announced_calendar(spark) -> DataFrame:
    return build_calendar(spark, **ANNOUNCED_2026)


def sessions_asof(calendar: DataFrame) -> DataFrame:
    """Per date, the last session at or before it, strictly before it, and the
    number of sessions up to it."""
    session = F.when(F.col("is_trading"), F.col("date"))
    upto = Window.partitionBy("calendar_version").orderBy("date")
    return calendar.select(
        "*",
        F.max(session).over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias("session_at_or_before"),
        F.max(session).over(upto.rowsBetween(Window.unboundedPreceding, -1)).alias("session_before"),
        F.count(session).over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias("session_number"),
    )


def period_end_sessions(calendar: DataFrame, interval: str) -> DataFrame:
    """Final scheduled session per period; NULL unless the period is fully covered."""
    start = period_start(F.col("date"), interval)
    length = F.datediff(period_end(F.first("date"), interval), period_start(F.first("date"), interval)) + 1
    return calendar.groupBy("calendar_version", start.alias("period_start")).agg(
        F.when(F.count("*") == length, F.max(F.when(F.col("is_trading"), F.col("date")))).alias("end_session")
    )


def calendar_dimension(calendar: DataFrame) -> DataFrame:
    """One row per covered date with everything completion tests need.

    For each interval: `end_*` is the final session of the period holding the
    date, `prev_end_*` the final session of the latest earlier period.
    """
    dim = sessions_asof(calendar)
    dim = dim.withColumn("end_1d", F.when(F.col("is_trading"), F.col("date"))).withColumn(
        "prev_end_1d", F.col("session_before")
    )
    for interval in ("1w", "1mo"):
        ends = period_end_sessions(calendar, interval)
        earlier = Window.partitionBy("calendar_version").orderBy("period_start").rowsBetween(
            Window.unboundedPreceding, -1
        )
        ends = ends.withColumn(f"prev_end_{interval}", F.max("end_session").over(earlier))
        ends = ends.withColumnRenamed("end_session", f"end_{interval}")
        dim = dim.withColumn("period_start", period_start(F.col("date"), interval)).join(
            ends, ["calendar_version", "period_start"]
        ).drop("period_start")
    return dim


def completed_by(end_session: Column, cutoff: Column) -> Column:
    """True when a session's completion boundary lies strictly before a cutoff."""
    return instant_at(end_session, COMPLETION_SECOND) < cutoff


def with_asof_dim(df: DataFrame, dim: DataFrame, day: Column, prefix: str, columns, version: str | None = None) -> DataFrame:
    """Left equi-join of selected calendar columns on a computed day.

    `dim` holds one calendar, whose length is checked, or with `version` (the
    rows' column of that name) any number: then version and day are the key,
    and the side is broadcast only where Spark's size statistics allow it.
    """
    key = [f"_{prefix}_day", *([f"_{prefix}_version"] if version else [])]
    side = dim.select(
        F.col("date").alias(key[0]), *[F.col("calendar_version").alias(k) for k in key[1:]], *[F.col(c).alias(f"{prefix}_{c}") for c in columns]
    )
    keyed = df.withColumns({key[0]: day, **{k: F.col(version) for k in key[1:]}})
    return keyed.join(side if version else F.broadcast(side), key, "left").drop(*key)


def latest_completed(prefix: str, interval: str, cutoff: Column) -> Column:
    """Latest completed period's final session, from as-of calendar columns."""
    this_end = F.col(f"{prefix}_end_{interval}")
    return (
        F.when(F.col(f"{prefix}_is_trading").isNull(), F.lit(None).cast("date"))
        .when(completed_by(this_end, cutoff), this_end)
        .otherwise(F.col(f"{prefix}_prev_end_{interval}"))
    )


def _constant(df: DataFrame, value: Column) -> bool:
    """Whether a column expression reads no column."""
    try:
        df.sparkSession.range(1).select(value)
    except AnalysisException:
        return False
    return True


def with_bar_completion(bars: DataFrame, dim: DataFrame, cutoff: Column, interval: str | None = None, date="date",
                        version: str | None = None) -> DataFrame:
    """Add the six completion-evidence columns.

    `interval` names the interval of all bars; None reads it from the
    `interval` column, so that mixed bars are stamped in one pass. `version`
    names the column with each bar's calendar version where `dim` holds
    several calendars; a bar whose version has none is judged like a bar
    outside the covered dates.
    """
    label = F.col(date)
    used = INTERVALS if interval is None else (interval,)

    def per_interval(value):
        """Value of the row's own interval."""
        if interval is not None:
            return value(interval)
        out = F.when(F.col("interval") == used[0], value(used[0]))
        for i in used[1:]:
            out = out.when(F.col("interval") == i, value(i))
        return out

    df = bars.withColumn("_cutoff", cutoff)
    df = with_asof_dim(df, dim, label, "bar", ["is_trading", *[f"end_{i}" for i in used]], version)
    now = [f"{p}_{i}" for i in used for p in ("end", "prev_end")]
    if version is None and _constant(bars, cutoff):
        # One cutoff for all rows: its day is looked up once, not joined.
        today = dim.filter(F.col("date") == shanghai_date(cutoff)).agg(F.max(F.struct("is_trading", *now)).alias("_t"))
        df = df.withColumn("_now", today.scalar())
        df = df.withColumns({f"now_{c}": F.col(f"_now.{c}") for c in ("is_trading", *now)})
    else:
        df = with_asof_dim(df, dim, shanghai_date(F.col("_cutoff")), "now", ["is_trading", *now], version)
    trading = F.col("bar_is_trading")
    daily = per_interval(lambda i: F.lit(i == "1d"))
    df = df.withColumns({
        "_end": per_interval(lambda i: F.col(f"bar_end_{i}")),
        "_invalid": F.coalesce(daily & ~trading, F.lit(False)),
        "_start": per_interval(lambda i: period_start(label, i)),
        "_today": per_interval(lambda i: period_start(shanghai_date(F.col("_cutoff")), i)),
        "_latest": per_interval(lambda i: period_start(latest_completed("now", i, F.col("_cutoff")), i)),
    })
    # A day bar has an end session only when its own date is a session.
    calendar, invalid = completed_by(F.col("_end"), F.col("_cutoff")), F.col("_invalid")
    df = df.withColumn("_calendar", calendar)
    calendar = F.col("_calendar")
    elapsed = ~invalid & calendar.isNull() & (F.col("_start") < F.col("_today"))
    return df.select(
        *[F.col(c) for c in bars.columns],
        (~invalid & (F.coalesce(calendar, F.lit(False)) | elapsed)).alias("complete"),
        F.when(~invalid, calendar).alias("calendar_completion"),
        F.when(invalid, INVALID_DAY).when(calendar.isNull(), ELAPSED).otherwise(VERIFIED).alias("completion_basis"),
        F.col("_end").alias("period_end_session"),
        (F.col("_start") == F.col("_latest")).alias("observed_latest"),
        F.lit("unknown").alias("source_finality"),
    )
