"""Minute series: interval differences, average price, gaps and fallback.

Windows run per (series, session day), at most 1440 minute labels each; the
link between days goes through a one-row-per-day summary.
"""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.clock import shanghai_date, shanghai_minute
from .blocks import with_previous_value

MINUTE_US = 60_000_000
# Fixed value: a minute point is complete once its label is 63 s old.
POINT_DELAY_SECONDS = 63
# The scheduled lunch break in minutes of the day.
LUNCH_FROM = (11 * 60 + 25, 11 * 60 + 30)
LUNCH_TO = (13 * 60, 13 * 60 + 5)


def _minutes(later, earlier):
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(MINUTE_US)


def with_interval_differences(points: DataFrame, keys=("symbol", "session_date"), ts="source_timestamp") -> DataFrame:
    """Interval volume, amount and minutes against the preceding raw point.

    The first point and any counter reset give NULL. Run before dropping
    incomplete points, so that differences use raw neighbours.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    out = points
    for total, name in (("cumulative_volume_shares", "interval_volume_shares"), ("cumulative_amount_cny", "interval_amount_cny")):
        before = F.lag(total).over(w)
        out = out.withColumn(name, F.when(F.col(total) >= before, F.col(total) - before))
    return out.withColumn("interval_minutes", _minutes(F.col(ts), F.lag(ts).over(w)))


def with_average_price(points: DataFrame) -> DataFrame:
    """Cumulative amount over cumulative shares; NULL when unavailable."""
    shares = F.col("cumulative_volume_shares")
    return points.withColumn("average_price_cny", F.when(shares > 0, F.col("cumulative_amount_cny") / shares))


def complete_points(points: DataFrame, cutoff, ts="source_timestamp") -> DataFrame:
    done = F.unix_micros(F.col(ts)) + F.lit(POINT_DELAY_SECONDS * 1_000_000) < F.unix_micros(cutoff)
    return points.withColumn("complete", done)


def gap_audit(points: DataFrame, expected_minutes=1, keys=("symbol", "source", "interval", "adjustment"),
              ts="source_timestamp") -> DataFrame:
    """Gaps longer than the expected step, with their kind and missing minutes."""
    keys = list(keys)
    df = with_previous_value(points, keys, ts, ts, shanghai_date(F.col(ts)), "previous_timestamp")
    a, b = F.col("previous_timestamp"), F.col(ts)
    elapsed = _minutes(b, a)
    lunch = shanghai_minute(a).between(*LUNCH_FROM) & shanghai_minute(b).between(*LUNCH_TO)
    kind = (
        F.when(shanghai_date(a) != shanghai_date(b), "session_boundary")
        .when(lunch, "scheduled_lunch")
        .otherwise("unexplained_gap")
    )
    gaps = df.filter(elapsed > expected_minutes).select(
        *keys, a.alias("gap_from"), b.alias("gap_to"), elapsed.alias("elapsed_minutes"), kind.alias("kind")
    )
    return gaps.withColumn(
        "missing_minutes",
        F.when(F.col("kind") == "unexplained_gap", F.col("elapsed_minutes") - expected_minutes),
    )


def latest_session_rows(bars: DataFrame, keys=("symbol",), ts="source_timestamp") -> DataFrame:
    """Rows of each series' latest session day only."""
    keys = list(keys)
    day = shanghai_date(F.col(ts))
    latest = bars.groupBy(*keys).agg(F.max(day).alias("session_date"))
    return bars.withColumn("session_date", day).join(latest, [*keys, "session_date"], "left_semi")


def minute_bars_as_points(bars: DataFrame) -> DataFrame:
    """Minute bars recast as points: close and interval totals, no cumulatives."""
    rows = latest_session_rows(bars)
    nothing = F.lit(None).cast("double")
    return rows.select(
        "symbol", "session_date", "source_timestamp",
        F.col("close").alias("price"),
        nothing.alias("cumulative_volume_shares"), nothing.alias("cumulative_amount_cny"),
        F.col("volume_shares").alias("interval_volume_shares"),
        F.col("amount_cny").alias("interval_amount_cny"),
        F.lit(1.0).alias("interval_minutes"), nothing.alias("average_price_cny"),
        "complete",
    )


def intraday_with_fallback(points: DataFrame, minute_bars: DataFrame) -> DataFrame:
    """Primary minute sessions; symbols without any fall back to minute bars."""
    have = points.select("symbol").distinct()
    backup = minute_bars_as_points(minute_bars.join(have, "symbol", "left_anti"))
    columns = backup.columns
    return points.select(*columns, F.lit("primary").alias("routing")).unionByName(
        backup.select(*columns, F.lit("minute_close_fallback").alias("routing"))
    )
