"""Streaming jobs. Sinks are levelled tables (sources/versioned.py): a micro-batch
reads only the buckets of its keys and publishes their new rows as one version
under its batch id, so a replayed batch replaces itself.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import pytasks
from ..operators.archive import ARCHIVE_KEY, STATE, archive_upsert, fold_auction, with_key_defaults
from ..operators.blocks import join_on
from ..sources.versioned import VersionedTables

# Completion delay in seconds by kind; days wait until 15:30:03.
DELAYS = {"1m": 3, "5m": 3, "intraday": 63, "1d": 30 * 60 + 3, "1w": 30 * 60 + 3, "1mo": 30 * 60 + 3}
FUTURE_SECONDS = 5


def event_cutoff(kind: str, ts: Column, cutoff: Column) -> Column:
    """True once a label of this kind is strictly older than its delay.

    Day, week and month labels stand at 15:00, so their delay is 30:03.
    """
    return F.unix_micros(ts) + F.lit(DELAYS[kind] * 1_000_000) < F.unix_micros(cutoff)


TABLE = "rows"
BUCKETS = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def log_at(spark: SparkSession, path: str, keys, buckets: int = BUCKETS) -> VersionedTables:
    return VersionedTables(spark, path, keys, buckets)


def read_log(spark: SparkSession, path: str, keys, below: int | None = None) -> DataFrame | None:
    """Newest row of every key; optionally only versions below a batch id."""
    return log_at(spark, path, keys).read(TABLE, below=below)


def _each_batch(stream: DataFrame, apply, checkpoint: str, trigger):
    """Run `apply` on every micro-batch, reading its source once."""
    def run(batch: DataFrame, batch_id: int):
        batch.persist()
        try:
            apply(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_archive(arrivals: DataFrame, path: str, checkpoint: str, keys=ARCHIVE_KEY, trigger=None, buckets=BUCKETS):
    """Archive upsert per micro-batch; receipts older than the stored one lose."""
    keys = list(keys)

    def apply(batch: DataFrame, batch_id: int):
        log = log_at(batch.sparkSession, path, keys, buckets)
        stored = log.read_for(TABLE, with_key_defaults(batch, keys), keys, below=batch_id)
        log.commit(batch_id, {TABLE: (archive_upsert(batch, stored, keys).select(*keys, *STATE), keys)})

    return _each_batch(arrivals, apply, checkpoint, trigger)


def stream_latest_quotes(quotes: DataFrame, path: str, checkpoint: str, now="fetched_at", trigger=None, buckets=BUCKETS):
    """Newest quote per symbol; quotes more than 5 s ahead are dropped."""
    early = F.unix_micros("source_timestamp") <= F.unix_micros(now) + FUTURE_SECONDS * 1_000_000
    rest = [c for c in quotes.columns if c != "symbol"]
    rank = F.struct(
        F.unix_micros("source_timestamp").alias("a"), (-F.col("request_latency_ms")).alias("b"), F.col("source").alias("c"))
    best = quotes.filter(early).withWatermark("source_timestamp", f"{FUTURE_SECONDS} seconds").groupBy("symbol").agg(
        F.max_by(F.struct(*rest), rank).alias("_q"))
    flat = best.select("symbol", "_q.*")

    def apply(batch: DataFrame, batch_id: int):
        log_at(batch.sparkSession, path, ["symbol"], buckets).commit(batch_id, {TABLE: (batch, ["symbol"])})

    writer = flat.writeStream.outputMode("update").foreachBatch(apply)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


POINTS = ("symbol string, session_date date, ts long, price double, interval_volume_shares double, "
          "interval_amount_cny double, interval_minutes double")


def stream_intraday(points: DataFrame, keep_hours: int = 24) -> DataFrame:
    """Interval differences per (symbol, session_date), carried across batches.

    The state is the last cumulative point of a session. An event-time timer
    drops it once the watermark, `keep_hours` behind the newest point seen, has
    passed the session's last point by as much; a point behind the watermark
    is late and is not answered. Unknown differences are null; a point before the
    stored one has none.
    """
    # The state store that stateful processors need.
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    src = points.withWatermark("source_timestamp", f"{keep_hours} hours").select(
        "symbol", "session_date", "source_timestamp", F.unix_micros("source_timestamp").alias("ts"), F.col("price").cast("double").alias("price"),
        F.col("cumulative_volume_shares").cast("double").alias("volume"), F.col("cumulative_amount_cny").cast("double").alias("amount"))
    df = src.groupBy("symbol", "session_date").transformWithStateInPandas(
        pytasks.session_differences(keep_hours * 3_600_000), POINTS, "append", "eventTime")
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in ("interval_volume_shares", "interval_amount_cny", "interval_minutes")}
    return df.withColumns(known).withColumn("source_timestamp", F.timestamp_micros("ts")).drop("ts")


def stream_auction(arrivals: DataFrame, path: str, checkpoint: str, keys=("symbol", "session_date"), trigger=None, buckets=BUCKETS):
    """Fuller-snapshot fold per micro-batch.

    The stored snapshot has the lowest arrival number of its key, so it simply
    joins the batch; the block-wise fold then copes with any number of
    arrivals per key.
    """
    keys = list(keys)
    columns = [*keys, "arrival_no", "fetched_at", "points", "source_timestamp"]

    def apply(batch: DataFrame, batch_id: int):
        log = log_at(batch.sparkSession, path, keys, buckets)
        rows = batch.select(*columns)
        stored = log.read_for(TABLE, batch, keys, below=batch_id)
        if stored is not None:
            rows = rows.unionByName(stored.select(*columns))
        kept = join_on(fold_auction(rows, keys), rows, [*keys, "arrival_no"])
        log.commit(batch_id, {TABLE: (kept.select(*columns), keys)})

    return _each_batch(arrivals, apply, checkpoint, trigger)
