"""Streaming jobs run to completion over whole tables."""

from pyspark.sql import functions as F

from barloom import streaming as S, testbed as T
from barloom.functions import instant_at, shanghai_text
from barloom.session import work_dir

from . import archives
from .base import MINUTES, registry

REGISTRY, query = registry()


DELIVERIES = 4


def delivered(df, path, order, run):
    """Hand the rows over in four deliveries of rising `order`, letting run(stream) end after each."""
    cuts = df.approxQuantile(order, [i / DELIVERIES for i in range(1, DELIVERIES)], 0.01)
    place = sum((F.when(F.col(order) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for part in range(DELIVERIES):
        df.filter(place == part).write.mode("append").parquet(f"{path}/in")
        run(df.sparkSession.readStream.schema(df.schema).parquet(f"{path}/in")).awaitTermination()


def _arrivals(df):
    return df.select(
        *archives.KEY, F.col("o_orderkey").alias("arrival_no"), F.col("o_orderdate").alias("fetched_at"),
        F.floor(F.col("o_totalprice") / 100000).cast("string").alias("payload"))


@query("l01_stream_archive", f"WITH {archives._FOLD} SELECT * FROM arch")
def stream_archive(spark, d):
    path = work_dir(spark, "stream-archive")
    delivered(_arrivals(T.table(spark, d, "orders")), path, "arrival_no", lambda s: S.stream_archive(s, f"{path}/log", f"{path}/checkpoint", archives.KEY, buckets=8))
    return S.read_log(spark, f"{path}/log", archives.KEY)


@query("l02_stream_intraday", f"""WITH {MINUTES}, s AS (SELECT *, CAST(minute AS DATE) AS session_date FROM points),
c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY symbol, session_date, hour(minute) >= 12 ORDER BY minute) AS DOUBLE) AS v FROM s),
l AS (SELECT *, lag(v) OVER w AS v0, lag(minute) OVER w AS m0 FROM c WINDOW w AS (PARTITION BY symbol, session_date ORDER BY minute))
SELECT symbol, session_date, strftime(minute, '%Y-%m-%dT%H:%M:%S+08:00') AS source_timestamp, CASE WHEN v >= v0 THEN v - v0 END AS interval_volume_shares,
  CAST(date_diff('minute', m0, minute) AS DOUBLE) AS interval_minutes FROM l""")
def stream_intraday(spark, d):
    from .windows import _cumulative

    path = work_dir(spark, "stream-intraday")
    c = _cumulative(spark, d).select("symbol", "session_date", "source_timestamp", "price", "cumulative_volume_shares", "cumulative_amount_cny")
    c = c.withColumn("day", F.unix_date("session_date").cast("double"))

    def run(stream):
        writer = S.stream_intraday(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
        return writer.trigger(availableNow=True).start()

    delivered(c, path, "day", run)
    out = spark.read.parquet(f"{path}/out")
    return out.select("symbol", "session_date", shanghai_text(F.col("source_timestamp")).alias("source_timestamp"), "interval_volume_shares", "interval_minutes")


def _quotes(df):
    k = F.get_json_object("props", "$.k").cast("long")
    wall = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    at = instant_at(F.to_date("ts"), wall)
    return df.select(F.col("user_id").cast("string").alias("symbol"), F.col("event_type").alias("source"), at.alias("source_timestamp"), k.alias("request_latency_ms"),
                     F.timestamp_seconds(F.unix_seconds(at) - k + 60).alias("fetched_at"), F.col("value").alias("price"), "event_id")


_LATEST = """q AS (SELECT CAST(user_id AS VARCHAR) AS symbol, event_type AS source, date_trunc('second', ts) AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value AS price, event_id FROM events),
ok AS (SELECT * FROM q WHERE k - 60 <= 5), best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC, k, source DESC) = 1)"""


@query("l03_stream_latest_quotes", f"WITH {_LATEST} SELECT symbol, source, price, event_id, k AS request_latency_ms FROM best")
def stream_latest(spark, d):
    path = work_dir(spark, "stream-quotes")
    quotes = _quotes(T.table(spark, d, "events"))
    delivered(quotes, path, "event_id", lambda s: S.stream_latest_quotes(s, f"{path}/log", f"{path}/checkpoint", buckets=8))
    return S.read_log(spark, f"{path}/log", ["symbol"]).select("symbol", "source", "price", "event_id", "request_latency_ms")


@query("l04_stream_auction", f"WITH {archives._AUC} SELECT symbol, s.n AS arrival_no FROM folded")
def stream_auction(spark, d):
    path = work_dir(spark, "stream-auction")
    k = F.col("o_orderkey")
    arrivals = T.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("symbol"), k.alias("arrival_no"),
        F.timestamp_seconds(F.unix_date(F.to_date("o_orderdate")) * 86400).alias("fetched_at"), (k % 16 + 1).alias("points"),
        F.timestamp_seconds((k % 7) * 60).alias("source_timestamp"), F.lit("2000-01-01").cast("date").alias("session_date"))

    delivered(arrivals, path, "arrival_no", lambda s: S.stream_auction(s, f"{path}/log", f"{path}/checkpoint", buckets=8))
    return S.read_log(spark, f"{path}/log", ["symbol", "session_date"]).select("symbol", "arrival_no")


@query("l05_completion_delays", f"""WITH {MINUTES} SELECT symbol, minute, minute + INTERVAL 3 SECOND < TIMESTAMP '2024-01-15 12:00:03' AS bar_done,
  minute + INTERVAL 63 SECOND < TIMESTAMP '2024-01-15 12:00:03' AS point_done FROM points""")
def completion_delays(spark, d):
    p = T.minute_points(spark, d)
    cut = F.lit("2024-01-15T12:00:03+08:00").cast("timestamp")
    return p.select("symbol", "minute", S.event_cutoff("1m", F.col("source_timestamp"), cut).alias("bar_done"),
                    S.event_cutoff("intraday", F.col("source_timestamp"), cut).alias("point_done"))
