"""Archive upserts, snapshots and the auction fold over order arrivals."""

from pyspark.sql import functions as F

from barloom import testbed as T
from barloom.functions import composite_key, instant_at
from barloom.operators import archive as A
from barloom.session import work_dir
from barloom.sources import store as ST

from .base import SESSION, calendar_sql, registry

REGISTRY, query = registry()
KEY = ["o_custkey", "o_orderstatus"]


def arrivals(spark, d):
    """Orders as archive arrivals; payloads repeat within a coarse price band."""
    return T.table(spark, d, "orders").select(
        *KEY, F.col("o_orderkey").alias("arrival_no"), F.col("o_orderdate").alias("fetched_at"),
        F.floor(F.col("o_totalprice") / 100000).cast("string").alias("payload"))


_ARR = """arr AS (SELECT o_custkey, o_orderstatus, o_orderkey AS arrival_no, o_orderdate AS fetched_at,
  CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS VARCHAR) AS payload FROM orders)"""
_FOLD = f"""{_ARR}, f AS (SELECT *, max(fetched_at) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY arrival_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM arr),
acc AS (SELECT *, lag(payload) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY arrival_no) AS p0 FROM f WHERE top IS NULL OR fetched_at >= top),
arch AS (SELECT o_custkey, o_orderstatus, arg_min(fetched_at, arrival_no) AS first_fetched_at, arg_max(fetched_at, arrival_no) AS last_fetched_at,
  arg_max(payload, arrival_no) AS payload, count(CASE WHEN payload <> p0 THEN 1 END) AS revision_count FROM acc GROUP BY 1, 2)"""


@query("k01_archive_upsert", f"WITH {_FOLD} SELECT * FROM arch")
def archive_upsert(spark, d):
    """Every third arrival leaves its interval out; it belongs to the default one."""
    a = arrivals(spark, d).withColumn("interval", F.when(F.col("arrival_no") % 3 != 0, "intraday"))
    return A.archive_upsert(a, keys=[*KEY, "interval"], bits=10).drop("interval")


@query("k01_archive_upsert_existing", f"WITH {_FOLD} SELECT * FROM arch")
def archive_upsert_existing(spark, d):
    """Half of the arrivals form the stored archive, the rest is applied to it."""
    a = arrivals(spark, d)
    middle = a.select(F.floor(F.max("arrival_no") / 2)).scalar()
    stored = A.archive_upsert(a.filter(F.col("arrival_no") <= middle), keys=KEY)
    return A.archive_upsert(a.filter(F.col("arrival_no") > middle), stored, keys=KEY)


@query("a18_archive_sink", f"WITH {_FOLD} SELECT * FROM arch")
def archive_sink(spark, d):
    """Two deliveries folded into a stored archive, bucket by bucket."""
    path = work_dir(spark, "archive")
    a = arrivals(spark, d)
    middle = a.select(F.floor(F.max("arrival_no") / 2)).scalar()
    for part in (F.col("arrival_no") <= middle, F.col("arrival_no") > middle):
        ST.upsert_archive(a.filter(part), path, KEY, buckets=16)
    return ST.read_archive(spark, path, KEY)


@query("d03_archive_summary", f"""WITH {_FOLD} SELECT o_orderstatus, count(*) AS count, min(o_custkey) AS first_timestamp, max(o_custkey) AS last_timestamp,
  min(first_fetched_at) AS first_receipt, max(last_fetched_at) AS last_receipt FROM arch GROUP BY 1""")
def archive_summary(spark, d):
    arch = A.archive_upsert(arrivals(spark, d), keys=KEY).withColumn("source_timestamp", F.col("o_custkey"))
    return A.archive_summary(arch, ["o_orderstatus"])


@query("k02_archive_window", f"""WITH {_FOLD}, w AS (SELECT o_custkey, payload, revision_count, row_number() OVER (ORDER BY o_custkey DESC) AS rn FROM arch
  WHERE o_orderstatus = 'F' AND o_custkey < 900)
SELECT o_custkey AS source_timestamp, payload, revision_count, true AS has_more, (SELECT o_custkey FROM w WHERE rn = 40) AS next_before FROM w WHERE rn <= 40""")
def archive_window(spark, d):
    arch = A.archive_upsert(arrivals(spark, d), keys=KEY).withColumn("source_timestamp", F.col("o_custkey"))
    out = A.archive_page(arch, {"o_orderstatus": "F"}, 40, F.lit(900))
    return out.select("source_timestamp", "payload", "revision_count", "has_more", "next_before")


_WINDOW = f"""{SESSION}, {calendar_sql(T.WEEKLY_CALENDAR)}, s AS (SELECT date, CAST(CAST(round(close * 100) AS BIGINT) AS VARCHAR) AS payload FROM bars WHERE symbol = (SELECT max(symbol) FROM bars)),
w AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS rn FROM s WHERE date < DATE '2001-01-01'), page AS (SELECT * FROM w WHERE rn <= 40)"""


@query("k02_archive_window_coverage", f"""WITH {_WINDOW}
SELECT date AS source_timestamp, payload, CAST(date AS TIMESTAMP) + INTERVAL 1 DAY AS first_fetched_at, CAST(date AS TIMESTAMP) + INTERVAL 2 DAY AS last_fetched_at, CAST(0 AS BIGINT) AS revision_count,
  (SELECT count(*) FROM w) > 40 AS has_more, (SELECT count(*) FROM s) AS total_observed_records, (SELECT max(date) FROM s) AS observed_last, (SELECT count(*) FROM page) AS returned,
  (SELECT count(*) FROM cal WHERE is_trading AND date BETWEEN (SELECT min(date) FROM page) AND (SELECT max(date) FROM page) AND date NOT IN (SELECT date FROM page)) AS missing_sessions FROM page""")
def archive_window_coverage(spark, d):
    """Every session bar received twice; the last series' window with provenance, summary and coverage."""
    bars = T.session_bars(spark, d)
    at = lambda days: F.timestamp_seconds((F.unix_date("date") + days) * 86400)
    each = bars.select("symbol", F.col("date").alias("source_timestamp"), F.round(F.col("close") * 100).cast("long").cast("string").alias("payload"),
                       F.explode(F.array(F.struct(F.unix_date("date").cast("long").alias("arrival_no"), at(1).alias("fetched_at")),
                                         F.struct((F.unix_date("date") + 100_000).cast("long").alias("arrival_no"), at(2).alias("fetched_at")))).alias("_r"))
    arch = A.archive_upsert(each.select("symbol", "source_timestamp", "payload", "_r.*"), keys=["symbol", "source_timestamp"])
    last = bars.select(F.max("symbol")).scalar()
    out = A.archive_window(arch, {"symbol": last}, 40, F.lit("2001-01-01").cast("date"), T.dimension(spark, T.WEEKLY_CALENDAR))
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    return out.select("source_timestamp", "payload", ntz("provenance.first_fetched_at").alias("first_fetched_at"), ntz("provenance.last_fetched_at").alias("last_fetched_at"),
                      F.col("provenance.revision_count").alias("revision_count"), "has_more", F.col("archive.count").alias("total_observed_records"),
                      F.col("archive.last_timestamp").alias("observed_last"), F.col("coverage.returned").alias("returned"), F.col("coverage.missing_sessions").alias("missing_sessions"))


_SNAP = f"""{_ARR}, latest AS (SELECT o_custkey, o_orderstatus, max(fetched_at) AS fetched_at, arg_max(payload, arrival_no) AS payload FROM
  (SELECT * FROM arr QUALIFY fetched_at = max(fetched_at) OVER (PARTITION BY o_custkey, o_orderstatus)) GROUP BY 1, 2)"""
_SNAP_NOW = "2001-08-01T00:00:00"


@query("k03_latest_snapshots", f"WITH {_SNAP} SELECT * FROM latest WHERE fetched_at >= TIMESTAMP '2001-07-25 00:00:00'")
def latest_snapshots(spark, d):
    s = arrivals(spark, d).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    out = A.latest_snapshots(s, F.lit(_SNAP_NOW).cast("timestamp"), KEY)
    return out.withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


@query("k04_readable_snapshots", f"""WITH {_SNAP} SELECT o_custkey, o_orderstatus, payload, date_diff('second', fetched_at, TIMESTAMP '2000-06-01 00:00:00') AS age_seconds
FROM latest WHERE fetched_at BETWEEN TIMESTAMP '2000-05-25 00:00:00' AND TIMESTAMP '2000-06-01 00:00:00'""")
def readable_snapshots(spark, d):
    now = F.lit("2000-06-01T00:00:00").cast("timestamp")
    s = arrivals(spark, d).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    out = A.readable_snapshots(A.latest_snapshots(s, now, KEY), now)
    return out.select(*KEY, "payload", "age_seconds")


@query("a19_snapshot_sink", f"WITH {_SNAP} SELECT o_custkey, o_orderstatus, payload FROM latest WHERE fetched_at >= TIMESTAMP '2001-07-25 00:00:00'")
def snapshot_sink(spark, d):
    path = work_dir(spark, "snapshots")
    s = arrivals(spark, d).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    ST.write_snapshots(A.latest_snapshots(s, F.lit(_SNAP_NOW).cast("timestamp"), KEY), path)
    return spark.read.parquet(path).select(*KEY, "payload")


@query("d04_snapshot_health", f"WITH {_SNAP} SELECT count(*) AS snapshot_count, max(fetched_at) AS latest_saved_fetch FROM latest")
def snapshot_health(spark, d):
    s = arrivals(spark, d)
    rank = F.struct("fetched_at", "arrival_no")
    latest = s.groupBy(*KEY).agg(F.max("fetched_at").alias("fetched_at"), F.max_by("payload", rank).alias("payload"))
    return A.snapshot_health(latest)


def auction_arrivals(spark, d):
    """Orders as auction snapshots: receipt, point count and source time vary apart."""
    k = F.col("o_orderkey")
    return T.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("symbol"), F.to_date("o_orderdate").alias("_d"), k.alias("arrival_no"),
        F.timestamp_seconds(F.unix_date(F.to_date("o_orderdate")) * 86400).alias("fetched_at"),
        (F.col("o_custkey") * 0 + k % 16 + 1).alias("points"),
        F.timestamp_seconds((k % 7) * 60).alias("source_timestamp"), F.lit("2000-01-01").cast("date").alias("session_date"))


_AUC = """a AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, o_orderkey AS n, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS r, o_orderkey % 16 AS c, o_orderkey % 7 AS t FROM orders),
lists AS (SELECT symbol, list({'n': n, 'r': r, 'c': c, 't': t} ORDER BY n) AS l FROM a GROUP BY symbol),
folded AS (SELECT symbol, list_reduce(l, lambda s, x: CASE WHEN x.r >= s.r AND x.c >= s.c AND x.t >= s.t THEN x ELSE s END) AS s FROM lists)"""


@query("k05_auction_fold", f"WITH {_AUC} SELECT symbol, s.n AS arrival_no FROM folded")
def auction_fold(spark, d):
    return A.fold_auction(auction_arrivals(spark, d), bits=8).select("symbol", "arrival_no")


_DAYS = """days AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS session_date, minute(ts) AS m, min(event_id) AS position, count(*) AS n FROM events WHERE minute(ts) BETWEEN 15 AND 30 GROUP BY 1, 2, 3),
today AS (SELECT * FROM days WHERE session_date = (SELECT max(session_date) FROM days)),
judged AS (SELECT *, lag(m) OVER (PARTITION BY symbol ORDER BY position) AS before FROM today)"""


@query("k06_auction_read", f"""WITH {_DAYS} SELECT symbol, count(*) AS points, count(CASE WHEN m BETWEEN 15 AND 19 THEN 1 END) AS early_observations, count(CASE WHEN m BETWEEN 25 AND 30 THEN 1 END) AS post_auction_reports,
  count(CASE WHEN n % 2 = 0 THEN 1 END) AS missing_reported_volume_points, CAST(1800 AS BIGINT) AS age_seconds FROM judged GROUP BY 1 HAVING bool_and(before IS NULL OR m > before)
UNION ALL SELECT symbol || '/sorted', count(*), count(CASE WHEN m BETWEEN 15 AND 19 THEN 1 END), count(CASE WHEN m BETWEEN 25 AND 30 THEN 1 END),
  count(CASE WHEN n % 2 = 0 THEN 1 END), CAST(1800 AS BIGINT) FROM today GROUP BY 1""")
def auction_read(spark, d):
    """Points of every day as stored snapshots: in arrival order, where most are refused, and in minute order; the last day is read."""
    ev = T.table(spark, d, "events").filter(F.minute("ts").between(15, 30))
    day = F.to_date("ts")
    points = ev.groupBy(F.col("event_type").alias("symbol"), day.alias("session_date"), F.minute("ts").alias("m")).agg(F.min("event_id").alias("position"), F.count("*").alias("n"))
    at = lambda s: instant_at(F.col("session_date"), 9 * 3600 + s)
    points = points.select("symbol", "session_date", "m", "position", at(F.col("m") * 60).alias("source_timestamp"), at(3600).alias("fetched_at"),
                           F.when(F.col("n") % 2 == 1, F.col("n")).alias("reported_volume_shares"), F.col("n").alias("reported_amount_cny"))
    points = points.unionByName(points.withColumn("symbol", F.concat("symbol", F.lit("/sorted"))).withColumn("position", F.col("m").cast("long")))
    last = points.agg(F.max("session_date")).first()[0]
    out = A.read_auctions(points, instant_at(F.lit(last), 10 * 3600 + 1800))
    return out.select("symbol", "points", "early_observations", "post_auction_reports", "missing_reported_volume_points", "age_seconds")


@query("b19_archive_eligible", """SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW'""")
def archive_eligible(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") != "O").alias("complete"), (F.col("o_orderpriority") == "5-LOW").alias("pending"),
                                           F.col("o_orderdate").alias("source_timestamp"))
    return A.archive_eligible(o).select("o_orderkey")


@query("b20_auction_validity", """WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, date_trunc('minute', ts) AS m, event_id FROM events),
q AS (SELECT *, lag(m) OVER (PARTITION BY user_id, day ORDER BY event_id) AS b FROM p)
SELECT user_id, day AS session_date, count(*) AS points, bool_and(b IS NULL OR m > b) AND max(m) <= CAST(day AS TIMESTAMP) + INTERVAL 43205 SECOND AS valid FROM q GROUP BY 1, 2""")
def auction_validity(spark, d):
    from barloom.functions import instant_at

    day = F.to_date("ts")
    p = T.table(spark, d, "events").select("user_id", day.alias("session_date"), instant_at(day, F.hour("ts") * 3600 + F.minute("ts") * 60).alias("source_timestamp"),
                                           instant_at(day, 12 * 3600).alias("fetched_at"), "event_id")
    return A.valid_auction(p, ["user_id", "session_date"], position="event_id").select("user_id", "session_date", "points", "valid")


@query("h14_composite_keys", """SELECT o_orderkey, '["' || o_custkey || '","' || o_orderstatus || '"]' AS key FROM orders""")
def composite_keys(spark, d):
    o = T.table(spark, d, "orders")
    return o.select("o_orderkey", composite_key(F.col("o_custkey"), F.col("o_orderstatus")).alias("key"))
