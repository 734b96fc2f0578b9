"""Coverage, missing sessions and auction-observation quality."""

from pyspark.sql import DataFrame, Window, functions as F

from .. import SERIES
from ..functions.clock import instant_at, shanghai_date, shanghai_minute
from .blocks import with_previous_value
from .paging import integer_bucket


def with_session_number(df: DataFrame, dim: DataFrame, date="date") -> DataFrame:
    """Add is_trading and the count of sessions up to the date.

    Dates before the coverage count 0 sessions, dates after it count all.
    """
    side = dim.select(F.col("date").alias("_d"), "is_trading", "session_number")
    out = df.join(F.broadcast(side), F.col(date) == F.col("_d"), "left").drop("_d")
    last_day = dim.select(F.max("date")).scalar()
    total = dim.select(F.max("session_number")).scalar()
    number = F.when(F.col(date) > last_day, total).otherwise(F.lit(0))
    return out.withColumn("session_number", F.coalesce("session_number", number))


def missing_sessions(bars: DataFrame, dim: DataFrame, keys=SERIES, date="date") -> DataFrame:
    """Scheduled sessions between a series' first and last bar without a bar.

    Consecutive bars are compared by session number, so only real gaps are
    expanded and the calendar is joined back by number.
    """
    keys = list(keys)
    days = with_session_number(bars.select(*keys, F.col(date).alias("date")).distinct(), dim)
    w = Window.partitionBy(*keys).orderBy("date")
    before = F.lag("session_number").over(w)
    upto = F.col("session_number") - F.coalesce(F.col("is_trading"), F.lit(False)).cast("long")
    gaps = days.select(*keys, (before + 1).alias("_from"), upto.alias("_to")).filter(F.col("_from") <= F.col("_to"))
    numbers = gaps.select(*keys, F.explode(F.sequence("_from", "_to")).alias("session_number"))
    sessions = dim.filter("is_trading").select("session_number", F.col("date").alias("missing_date"))
    return numbers.join(F.broadcast(sessions), "session_number").select(*keys, "missing_date")


def _order_faults(bars: DataFrame, keys, date, row) -> DataFrame:
    """Repeated and backward dates between neighbours in input order."""
    if row not in bars.columns:
        days = bars.groupBy(*keys, date).agg(F.count("*").alias("_n"))
        return days.groupBy(*keys).agg(
            F.sum(F.col("_n") - 1).alias("duplicate_timestamps"), F.lit(0).cast("long").alias("non_monotonic_timestamps")
        )
    pairs = with_previous_value(bars.select(*keys, date, row), keys, row, date, integer_bucket(row), "_before")
    return pairs.groupBy(*keys).agg(
        F.count_if(F.col(date) == F.col("_before")).alias("duplicate_timestamps"),
        F.count_if(F.col(date) < F.col("_before")).alias("non_monotonic_timestamps"),
    )


def coverage(bars: DataFrame, dim: DataFrame, keys=SERIES, date="date", row="row_no") -> DataFrame:
    """One row per series: counts, range, order faults and calendar gaps.

    Order faults compare neighbours in input order (`row`); without a row
    number the input order is the date order.
    """
    keys = list(keys)
    side = dim.select(F.col("date").alias("_d"), F.lit(True).alias("_covered"))
    df = bars.join(F.broadcast(side), F.col(date) == F.col("_d"), "left").drop("_d")
    unknown = F.count_if(F.col("_covered").isNull())
    base = df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        unknown.alias("calendar_unverified_rows"),
        (unknown > 0).alias("calendar_gaps_unverified"),
    )
    gaps = missing_sessions(bars, dim, keys, date).groupBy(*keys).agg(
        F.count("*").alias("missing_sessions"),
        F.min("missing_date").alias("first_missing"),
        F.max("missing_date").alias("last_missing"),
    )
    out = base.join(_order_faults(bars, keys, date, row), keys).join(gaps, keys, "left")
    return out.withColumn("missing_sessions", F.coalesce("missing_sessions", F.lit(0)))


# Observation phases by minute of the 09 hour.
AUCTION_PHASES = [("early_observations", 15, 19), ("late_observations", 20, 24), ("post_auction_reports", 25, 30)]


def auction_quality(points: DataFrame, now, keys=("symbol", "session_date"), ts="source_timestamp") -> DataFrame:
    """Phase counts, volume and amount gaps, and elapsed labels not observed."""
    minute = shanghai_minute(F.col(ts)) - 9 * 60
    volume, amount = F.col("reported_volume_shares"), F.col("reported_amount_cny")
    aggregates = [F.count("*").alias("observed_minutes")]
    aggregates += [F.count_if(minute.between(a, b)).alias(name) for name, a, b in AUCTION_PHASES]
    out = points.groupBy(*keys).agg(
        *aggregates,
        F.count_if(volume > 0).alias("positive_reported_volume_points"),
        F.count_if(volume.isNull()).alias("missing_reported_volume_points"),
        F.count_if(amount.isNull()).alias("missing_reported_amount_points"),
        F.collect_set(minute).alias("_seen"),
    )
    labels = F.sequence(F.lit(15), F.lit(30))
    elapsed = F.filter(
        labels,
        lambda m: F.unix_micros(instant_at(F.col("session_date"), 9 * 3600 + m * 60 + 60)) <= F.unix_micros(now),
    )
    missing = F.array_except(elapsed, F.col("_seen"))
    return (
        out.withColumn("missing_elapsed_minute_labels", F.transform(missing, lambda m: F.concat(F.lit("09:"), m.cast("string"))))
        .withColumn("same_day", F.col("session_date") == shanghai_date(now))
        .drop("_seen")
    )
