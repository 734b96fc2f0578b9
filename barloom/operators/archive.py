"""Observation archive: upserts, pages, snapshots and the auction fold.

Arrivals carry `arrival_no`, a unique integer in arrival order. A key may hold
any number of arrivals: they are judged in blocks of consecutive arrival
numbers, and blocks are linked through one summary row each.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import pytasks
from ..functions.numbers import age_seconds
from ..functions.clock import shanghai_date
from .blocks import join_on
from .coverage import auction_quality
from .paging import integer_bucket, page_before

SNAPSHOT_DAYS = 7
ARCHIVE_KEY = ("symbol", "source", "kind", "interval", "adjustment", "source_timestamp")
# What a key part stands for when a row leaves it out.
KEY_DEFAULTS = {"interval": "intraday", "adjustment": "none"}
STATE = ("first_fetched_at", "last_fetched_at", "payload", "revision_count")


def archive_eligible(rows: DataFrame) -> DataFrame:
    """Complete, not pending, with a usable timestamp."""
    return rows.filter(F.col("complete") & ~F.coalesce("pending", F.lit(False)) & F.col("source_timestamp").isNotNull())


def with_key_defaults(rows: DataFrame, keys=ARCHIVE_KEY) -> DataFrame:
    """Rows whose absent interval is intraday and whose absent adjustment is none."""
    return rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in KEY_DEFAULTS.items() if k in keys and k in rows.columns})


def archive_upsert(arrivals: DataFrame, archive: DataFrame | None = None, keys=ARCHIVE_KEY, bits=16) -> DataFrame:
    """Archive state after applying arrivals in order.

    A receipt at or after the stored one wins; a changed payload adds a
    revision; the first receipt stays that of the first arrival. Absent
    intervals and adjustments take their defaults; other null key parts equal
    each other. Arrivals without a payload or a receipt are refused: they
    change nothing and are no first arrival.
    """
    keys = list(keys)
    arrivals = with_key_defaults(arrivals, keys).filter("payload IS NOT NULL AND fetched_at IS NOT NULL")
    rows = arrivals.select(*keys, "arrival_no", "fetched_at", "payload").withColumn("_b", integer_bucket("arrival_no", bits))
    if archive is not None:
        archive = with_key_defaults(archive, keys)
        # The stored row acts as an arrival before all others.
        old = archive.select(*keys, F.col("last_fetched_at").alias("fetched_at"), "payload")
        rows = rows.unionByName(old.withColumn("arrival_no", F.lit(-1).cast("long")).withColumn("_b", F.lit(-1).cast("long")))
    blocks = rows.groupBy(*keys, "_b").agg(F.max("fetched_at").alias("_max"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(*keys, "_b", F.max("_max").over(earlier).alias("_carry"))
    inside = Window.partitionBy(*keys, "_b").orderBy("arrival_no")
    before = F.max("fetched_at").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    judged = join_on(rows.withColumn("_before", before), carry, [*keys, "_b"])
    floor = F.greatest("_before", "_carry")
    judged = judged.withColumn("_ok", floor.isNull() | (F.col("fetched_at") >= floor))
    shown = F.when(F.col("_ok"), F.col("payload"))
    previous = F.last(shown, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    judged = judged.withColumn("_changed", F.col("_ok") & (F.col("payload") != previous))
    # Running values, read at the last row of a block and then at the last block of a key: no aggregate has to sort.
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    receipt = F.when(F.col("_ok"), F.col("fetched_at"))
    per_block = judged.select(
        *keys, "_b", F.count_if("_changed").over(so_far).alias("_changes"), F.first(shown, ignorenulls=True).over(so_far).alias("_first"),
        F.last(shown, ignorenulls=True).over(so_far).alias("_last"), F.last(receipt, ignorenulls=True).over(so_far).alias("_fetched"),
        F.first("fetched_at").over(so_far).alias("_arrived"), F.lead("arrival_no").over(inside).alias("_next"))
    per_block = per_block.filter("_next IS NULL").drop("_next")
    link = F.last("_last", ignorenulls=True).over(earlier)
    per_block = per_block.withColumn("_jump", F.coalesce(F.col("_first") != link, F.lit(False)).cast("long"))
    by_block = Window.partitionBy(*keys).orderBy("_b")
    so_far = by_block.rowsBetween(Window.unboundedPreceding, 0)
    out = per_block.select(
        *keys, F.first("_arrived").over(so_far).alias("first_fetched_at"), F.last("_fetched", ignorenulls=True).over(so_far).alias("last_fetched_at"),
        F.last("_last", ignorenulls=True).over(so_far).alias("payload"), F.sum(F.col("_changes") + F.col("_jump")).over(so_far).alias("revision_count"),
        F.lead("_b").over(by_block).alias("_next")).filter("_next IS NULL").drop("_next")
    if archive is None:
        return out
    stored = archive.select(*keys, F.col("first_fetched_at").alias("_f"), F.col("revision_count").alias("_r"))
    out = join_on(out, stored, keys, "left")
    return out.select(
        *keys, F.coalesce("_f", "first_fetched_at").alias("first_fetched_at"), "last_fetched_at", "payload",
        (F.col("revision_count") + F.coalesce("_r", F.lit(0))).alias("revision_count"))


def archive_summary(archive: DataFrame, keys=ARCHIVE_KEY[:-1]) -> DataFrame:
    return archive.groupBy(*keys).agg(
        F.count("*").alias("count"), F.min("source_timestamp").alias("first_timestamp"), F.max("source_timestamp").alias("last_timestamp"),
        F.min("first_fetched_at").alias("first_receipt"), F.max("last_fetched_at").alias("last_receipt"))


def archive_page(archive: DataFrame, series: dict, limit=120, before: Column | None = None) -> DataFrame:
    """Latest window of one series, ascending, with has_more and next_before."""
    rows = archive
    for column, value in series.items():
        rows = rows.filter(F.col(column) == value)
    return page_before(rows, "source_timestamp", before, limit, cursor="next_before")


def archive_window(archive: DataFrame, series: dict, limit=120, before: Column | None = None, dim: DataFrame | None = None) -> DataFrame:
    """Latest window of one series with provenance, series summary and the window's coverage.

    Every row carries `provenance` (receipts and revision count), `archive`
    (what the whole series holds, before any cut) and `coverage` (the
    window's range and, with a calendar `dim` and dates as timestamps, the
    scheduled sessions inside it that were not observed). Both are one row
    each and are read as scalars.
    """
    rows = archive
    for column, value in series.items():
        rows = rows.filter(F.col(column) == value)
    whole = archive_summary(rows, ()).select(F.struct("*")).scalar()
    page = archive_page(rows, {}, limit, before)
    ts = F.col("source_timestamp")
    span = [F.count("*").alias("returned"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.count_distinct(ts).alias("labels")]
    seen = page.agg(*span)
    if dim is not None:
        range_ = page.agg(F.struct(F.min(ts).alias("first"), F.max(ts).alias("last"))).scalar()
        sessions = dim.filter("is_trading").filter(F.col("date").between(range_["first"], range_["last"])).select("date")
        absent = sessions.join(page.select(ts.alias("date")), "date", "left_anti")
        seen = seen.withColumn("missing_sessions", absent.agg(F.count("*")).scalar())
    provenance = F.struct("first_fetched_at", "last_fetched_at", "revision_count").alias("provenance")
    return page.select(ts, "payload", provenance, "has_more", "next_before", whole.alias("archive"), seen.select(F.struct("*")).scalar().alias("coverage"))


def read_auctions(points: DataFrame, now: Column, keys=("symbol",), position="position") -> DataFrame:
    """Stored auction snapshots of today, judged anew: one row per key with its quality report.

    points: one row per point of a stored snapshot, with session_date,
    source_timestamp, fetched_at, reported_volume_shares and
    reported_amount_cny. Snapshots of another Shanghai day are not read, and
    those whose points are not valid are refused.
    """
    per = [*keys, "session_date"]
    today = points.filter(F.col("session_date") == shanghai_date(now))
    valid = valid_auction(today, per, position=position).filter("valid")
    fetched = today.groupBy(*per).agg(F.max("fetched_at").alias("fetched_at"))
    quality = auction_quality(today, now, per)
    out = valid.select(*per, "points", "source_timestamp").join(fetched, per).join(quality.drop("same_day"), per)
    return out.withColumn("age_seconds", F.round(age_seconds(now, F.col("fetched_at"))).cast("long"))


def latest_snapshots(snapshots: DataFrame, as_of: Column, keys=("key",)) -> DataFrame:
    """Newest receipt per key, expired after seven days.

    Snapshots need fetched_at, payload and arrival_no (ties: later arrival).
    """
    rank = F.struct("fetched_at", "arrival_no")
    newest = snapshots.groupBy(*keys).agg(F.max("fetched_at").alias("fetched_at"), F.max_by("payload", rank).alias("payload"))
    return newest.filter(age_seconds(as_of, F.col("fetched_at")) <= SNAPSHOT_DAYS * 86_400)


def readable_snapshots(latest: DataFrame, as_of: Column) -> DataFrame:
    """Snapshots between 0 and 7 days old inclusive, with their age."""
    age = age_seconds(as_of, F.col("fetched_at"))
    return latest.withColumn("age_seconds", F.round(age).cast("long")).filter(age.between(0, SNAPSHOT_DAYS * 86_400))


def snapshot_health(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.count("*").alias("snapshot_count"), F.max("fetched_at").alias("latest_saved_fetch"))


def valid_auction(points: DataFrame, keys=("key",), session="session_date", ts="source_timestamp", fetched="fetched_at", position="position",
                  stamp: str | None = None) -> DataFrame:
    """Per capture: every point on the session day, later than the one before it, at most 5 s ahead.

    `position` orders the points of a capture, which one response bounds; an
    absent time is a fault. `stamp` names the capture's own time, which must be
    that of its last point.
    """
    late = F.unix_micros(ts) > F.unix_micros(fetched) + 5_000_000
    order = Window.partitionBy(*keys).orderBy(position)
    rows = points.withColumn("_before", F.lag(ts).over(order)).withColumn("_first", F.row_number().over(order) == 1)
    fine = (shanghai_date(F.col(ts)) == F.col(session)) & ~late & (F.col("_first") | (F.col(ts) > F.col("_before")))
    valid = F.bool_and(F.coalesce(fine, F.lit(False)))
    if stamp is not None:
        valid = valid & F.coalesce(F.max_by(ts, position) == F.max_by(stamp, position), F.lit(False))
    return rows.groupBy(*keys).agg(valid.alias("valid"), F.count("*").alias("points"), F.max(ts).alias("source_timestamp"))


def fold_auction(arrivals: DataFrame, keys=("symbol", "session_date"), bits=12) -> DataFrame:
    """Stored auction snapshot per key after all arrivals, as an arrival_no.

    A snapshot replaces the stored one only with a receipt, a point count and
    a source time all at or above it. A rejected snapshot leaves no trace, so
    running maxima do not apply. Each block of arrivals is reduced to the few
    rows that can matter, and the blocks' steps then stream by in order, with
    one state held per key. Arrivals without a receipt, a count or a time are
    refused before.
    """
    keys = list(keys)
    rows = arrivals.dropna(subset=["arrival_no", "fetched_at", "points", "source_timestamp"]).select(
        *keys, "arrival_no", F.unix_micros("fetched_at").alias("r"), F.col("points").cast("long").alias("c"),
        F.unix_micros("source_timestamp").alias("t"), integer_bucket("arrival_no", bits).alias("block"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    steps = rows.repartition(*keys, "block").sortWithinPartitions(*keys, "block", "arrival_no").mapInPandas(
        pytasks.block_steps(keys), f"{head}, block long, step long, r long, c long, t long, out_r long, out_c long, out_t long, arrival_no long")
    return steps.repartition(*keys).sortWithinPartitions(*keys, "block", "step").mapInPandas(
        pytasks.apply_steps(keys), f"{head}, arrival_no long")
