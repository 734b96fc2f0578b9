"""Market-shaped inputs derived from the star-schema test tables.

Used by the query suite and benchmarks only. Prices are cut to whole cents
with floor, which every engine computes alike.
"""

import weakref

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.clock import instant_at
from .operators.calendar import build_calendar, calendar_dimension
from .session import work_dir

# Synthetic calendars for the years the tables cover.
DAILY_CALENDAR = {
    "version": "weekday-1995-2001",
    "start": "1995-01-01",
    "end": "2001-06-30",
    "closed_ranges": [("1995-12-25", "1995-12-31"), ("1996-12-25", "1996-12-31"), ("2000-05-01", "2000-05-05")],
}
# One session a week: the Monday of each week, two weeks closed.
WEEKLY_CALENDAR = {
    "version": "monday-1995-2001",
    "start": "1995-01-02",
    "end": "2001-11-04",
    "closed_ranges": [("1997-01-27", "1997-02-02"), ("1999-10-04", "1999-10-10")],
    "open_weekdays": (0,),
}
EVENT_CALENDAR = {
    "version": "weekday-2024-01",
    "start": "2024-01-01",
    "end": "2024-01-28",
    "closed_ranges": [("2024-01-01", "2024-01-01"), ("2024-01-15", "2024-01-16")],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def calendar(spark, spec) -> DataFrame:
    return dimension(spark, spec).select("calendar_version", "date", "is_trading")


def dimension(spark, spec) -> DataFrame:
    """Calendar dimension of a testbed calendar, a small stored table."""
    return kept_table(spark, "calendar " + spec["version"], lambda: calendar_dimension(build_calendar(spark, **spec)).coalesce(1))


def kept_table(spark, name, build) -> DataFrame:
    """Derived input written once per session and read back as a table.

    Plans then scan it instead of deriving it again at every use.
    """
    paths = _PATHS.setdefault(spark, {})
    if name in paths:
        try:
            return spark.read.parquet(paths[name])
        except AnalysisException:
            pass
    paths[name] = work_dir(spark, "table")
    build().write.parquet(paths[name])
    return spark.read.parquet(paths[name])


def cents(price: Column) -> Column:
    return F.floor(price * 100) / 100


def code_of(n: Column) -> Column:
    """Mainboard code of an integer: four SH prefixes, then four SZ prefixes."""
    k = F.pmod(n, F.lit(8000))
    prefixes = F.array(*[F.lit(p) for p in ("sh600", "sh601", "sh603", "sh605", "sz000", "sz001", "sz002", "sz003")])
    return F.concat(F.element_at(prefixes, F.floor(k / 1000).cast("int") + 1), F.lpad((k % 1000).cast("string"), 3, "0"))


def row_order() -> Column:
    """Order of lineitem rows as one long, so that first/last stay hash aggregates."""
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return line * 4194304 + F.col("l_partkey") % 4194304


def _lines(spark, sf_dir, n: Column, day: Column) -> DataFrame:
    """Lines as trades: the symbol's number, the day, whole cents and the order."""
    return table(spark, sf_dir, "lineitem").select(
        F.pmod(n, F.lit(8000)).alias("n"),
        day.alias("date"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100).alias("price"),
        F.col("l_quantity").alias("volume"),
        row_order().alias("seq"),
    )


def _labelled(bars: DataFrame, interval: str) -> DataFrame:
    """Bars of numbered symbols in cents as market bars. Lines are grouped before that, as numbers need fewer bytes in a shuffle than text and prices."""
    return bars.select(
        code_of(F.col("n")).alias("symbol"),
        F.lit("tencent").alias("source"),
        F.lit(interval).alias("interval"),
        F.lit("qfq").alias("adjustment"),
        "date",
        *[(F.col(c) / 100).alias(c) for c in ("open", "high", "low", "close")],
        "volume_shares",
    )


def _bars(spark, sf_dir, n: Column, day: Column, interval: str) -> DataFrame:
    bars = _lines(spark, sf_dir, n, day).groupBy("n", "date").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("volume").alias("volume_shares"),
    )
    return _labelled(bars, interval)


def daily_bars(spark, sf_dir) -> DataFrame:
    """Sparse daily bars, one series per supplier."""
    return _bars(spark, sf_dir, F.col("l_suppkey"), F.to_date("l_shipdate"), "1d")


def monthly_bars(spark, sf_dir) -> DataFrame:
    return _bars(spark, sf_dir, F.col("l_suppkey"), F.trunc(F.to_date("l_shipdate"), "month"), "1mo")


def session_bars(spark, sf_dir, interval="1d") -> DataFrame:
    """Dense bars on weekly sessions, one series per four suppliers.

    interval 1d gives one bar per Monday session; 1w and 1mo give period bars
    labelled with the period's last possible session day.
    """
    day = F.to_date("l_shipdate")
    monday = F.date_sub(day, F.weekday(day))
    label = monday if interval == "1d" else F.trunc(monday, "month") if interval == "1mo" else monday
    return _bars(spark, sf_dir, F.floor(F.col("l_suppkey") / 4), label, interval)


def session_and_month_bars(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """session_bars of 1d and 1mo with one shuffle of the lines: months are made from the stored sessions."""

    def sessions():
        day = F.to_date("l_shipdate")
        return _lines(spark, sf_dir, F.floor(F.col("l_suppkey") / 4), F.date_sub(day, F.weekday(day))).groupBy("n", "date").agg(
            F.min_by("price", "seq").alias("open"), F.min("seq").alias("open_seq"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"), F.max("seq").alias("close_seq"), F.sum("volume").alias("volume_shares"))

    stored = kept_table(spark, f"session bars {sf_dir}", sessions)
    months = stored.groupBy("n", F.trunc("date", "month").alias("date")).agg(
        F.min_by("open", "open_seq").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "close_seq").alias("close"), F.sum("volume_shares").alias("volume_shares"))
    return _labelled(stored, "1d"), _labelled(months, "1mo")


def minute_points(spark, sf_dir) -> DataFrame:
    """Minute aggregates of events per (event_type, day): at most 1440 a day."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.date_trunc("minute", "ts").alias("minute"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.struct("ts", "event_id").alias("seq"),
    )
    points = ev.groupBy("symbol", "minute").agg(
        F.max_by("cents", "seq").alias("last_cents"),
        F.min_by("cents", "seq").alias("first_cents"),
        F.max("cents").alias("high_cents"),
        F.min("cents").alias("low_cents"),
        F.sum("cents").alias("sum_cents"),
        F.count("*").alias("n"),
    )
    wall = F.hour("minute") * 3600 + F.minute("minute") * 60
    return points.withColumn("source_timestamp", instant_at(F.to_date("minute"), wall))
