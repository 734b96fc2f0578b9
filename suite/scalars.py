"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from barloom import testbed as T
from barloom import functions as B

from .base import DAILY, code_sql, registry

REGISTRY, query = registry()


@query("h02_normalized_name", "SELECT s_suppkey, upper(replace(s_name, '#', '')) || '*ST' AS normalized_name FROM supplier")
def normalized(spark, d):
    name = F.concat(F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit(" ＊ st"))
    return T.table(spark, d, "supplier").select("s_suppkey", B.normalized_name(B.nfkc(name)).alias("normalized_name"))


@query("h03_entity_decode", r"""SELECT page_id, CAST(len(html) - coalesce(list_sum(list_transform(
  regexp_extract_all(html, '(?i)&(#x[0-9a-f]+|#[0-9]+|amp|lt|gt|quot|apos);'), lambda m: len(m) - 1)), 0) AS BIGINT) AS decoded_length FROM pages""")
def entities(spark, d):
    p = T.table(spark, d, "pages")
    return p.select("page_id", F.length(B.decode_entities(F.col("html"))).cast("long").alias("decoded_length"))


@query("h04_strict_number", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (1, 2, 3) THEN NULL ELSE o_totalprice END AS value FROM orders""")
def numbers(spark, d):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 1, " ").when(k == 2, "Infinity").when(k == 3, F.concat(F.format_string("%.2f", "o_totalprice"), F.lit("d"))).otherwise(F.format_string(" %.2f ", "o_totalprice"))
    return T.table(spark, d, "orders").select("o_orderkey", B.strict_number(text).alias("value"))


@query("h05_provider_stamps", """SELECT event_id, CASE WHEN event_id % 5 = 2 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S+08:00') END AS stamp FROM events""")
def stamps(spark, d):
    k = F.col("event_id") % 5
    text = F.when(k == 2, "20240230120000").when(k < 2, F.date_format("ts", "yyyyMMddHHmmss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return T.table(spark, d, "events").select("event_id", B.shanghai_text(B.parse_stamp(text)).alias("stamp"))


@query("h06_shanghai_day", """SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, CAST(hour(ts + INTERVAL 8 HOUR) * 60 + minute(ts) AS INTEGER) AS minute_of_day FROM events""")
def shanghai_day(spark, d):
    at = F.timestamp_seconds(F.unix_date(F.to_date("ts")) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60)
    ev = T.table(spark, d, "events").select("event_id", at.alias("at"))
    return ev.select("event_id", B.shanghai_date(F.col("at")).alias("day"), B.shanghai_minute(F.col("at")).alias("minute_of_day"))


@query("h07_period_bounds", """SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS week_end,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders""")
def bounds(spark, d):
    day = F.to_date("o_orderdate")
    return T.table(spark, d, "orders").select("o_orderkey", B.period_start(day, "1w").alias("week_start"), B.period_end(day, "1w").alias("week_end"),
                                              B.period_start(day, "1mo").alias("month_start"), B.period_end(day, "1mo").alias("month_end"))


@query("h08_minute_labels", """SELECT event_id, strftime(ts, '%H:%M') BETWEEN '09:15' AND '09:30' AS in_auction_window FROM events""")
def minute_labels(spark, d):
    at = B.instant_at(F.to_date("ts"), F.hour("ts") * 3600 + F.minute("ts") * 60)
    return T.table(spark, d, "events").select("event_id", B.shanghai_minute(at).between(555, 570).alias("in_auction_window"))


@query("h09_ticker_parts", f"""WITH s AS (SELECT s_suppkey, {code_sql('s_suppkey')} AS symbol FROM supplier)
SELECT s_suppkey, upper(substr(symbol, 1, 2)) AS market, substr(symbol, 3, 6) AS ticker, substr(symbol, 3, 6) || '.' || upper(substr(symbol, 1, 2)) AS thscode FROM s""")
def ticker_parts(spark, d):
    s = T.table(spark, d, "supplier").select("s_suppkey", B.ticker_parts(T.code_of(F.col("s_suppkey"))).alias("p"))
    return s.select("s_suppkey", "p.*")


@query("h10_compact_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def compact_dates(spark, d):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 3, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return T.table(spark, d, "orders").select("o_orderkey", B.strict_date(text).alias("day"))


@query("h11_canonical_json", """SELECT event_id, '{"a":' || user_id || ',"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',"z":"' || event_type || '"}' AS canonical FROM events""")
def canonical(spark, d):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"z": "'), F.col("event_type"), F.lit('", "k": '), k, F.lit(', "a": '), F.col("user_id").cast("string"), F.lit("}"))
    return T.table(spark, d, "events").select("event_id", B.canonical_json(text).alias("canonical"))


@query("h12_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256(spark, d):
    return T.table(spark, d, "documents").select("doc_id", B.sha256_hex(F.col("text")).alias("digest"))


@query("h13_ages", """SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate, l_shipdate) * 86400.0::DOUBLE AS age_seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def ages(spark, d):
    j = T.table(spark, d, "lineitem").join(T.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    at = lambda c: B.instant_at(F.to_date(c), 0)
    return j.select("l_orderkey", "l_linenumber", "l_partkey", B.age_seconds(at("l_shipdate"), at("o_orderdate")).alias("age_seconds"))


@query("h15_lot_scaling", f"""WITH {DAILY}, x AS (SELECT CASE WHEN symbol LIKE 'sh60000%' THEN 'sh688' || substr(symbol, 6, 3) WHEN symbol LIKE 'sh60001%' THEN 'sh689' || substr(symbol, 6, 3) ELSE symbol END AS symbol, date, volume_shares FROM bars)
SELECT symbol, date, CASE WHEN symbol LIKE 'sh689%' THEN NULL WHEN symbol LIKE 'sh688%' THEN volume_shares ELSE volume_shares * 100 END AS shares FROM x""")
def lot_scaling(spark, d):
    b = T.daily_bars(spark, d)
    s = F.col("symbol")
    tail = F.substring("symbol", 6, 3)
    s = F.when(s.startswith("sh60000"), F.concat(F.lit("sh688"), tail)).when(s.startswith("sh60001"), F.concat(F.lit("sh689"), tail)).otherwise(s)
    return b.select(s.alias("symbol"), "date", "volume_shares").select("symbol", "date", (F.col("volume_shares") * B.lot_factor(F.col("symbol"))).alias("shares"))


@query("h16_array_levels", """SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS positive_levels, len(embedding) AS levels FROM embeddings""")
def array_levels(spark, d):
    first = F.col("embedding")
    return T.table(spark, d, "embeddings").select(
        "vec_id", F.size(F.filter(first, lambda x: x > 0)).cast("long").alias("positive_levels"), F.size(first).cast("long").alias("levels"))


@query("h17_json_extract", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(3 AS INTEGER) AS points FROM events""")
def json_extract(spark, d):
    payload = F.concat(F.lit("["), "props", F.lit(","), "props", F.lit(","), "props", F.lit("]"))
    return T.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.json_array_length(payload).alias("points"))
