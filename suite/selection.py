"""Provider selection, deduplication and name resolution."""

from pyspark.sql import functions as F

from barloom import testbed as T
from barloom.functions import instant_at, nfkc, normalized_name, search_text_ok, shanghai_text
from barloom.operators import intraday as N, selection as S
from barloom.sources import quotes as Q

from .base import DAILY, MINUTES, registry

REGISTRY, query = registry()


def candidates(spark, d):
    """Every event is a quote candidate: its type is the provider, its user the symbol."""
    day = F.to_date("ts")
    wall = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    k = F.get_json_object("props", "$.k").cast("long")
    return T.table(spark, d, "events").select(
        F.col("user_id").alias("symbol"), day.alias("day"), F.col("event_type").alias("source"), instant_at(day, F.floor(wall / 14400) * 14400).alias("source_timestamp"),
        k.alias("request_latency_ms"), F.col("value").alias("price"), "event_id",
        F.when(F.col("value") < 20, "INVALID_QUOTE_VALUES").alias("reason"), instant_at(day, 86400).alias("as_of"))


_CAND = """cand AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS day, event_type AS source,
  CAST(CAST(ts AS DATE) AS TIMESTAMP) + CAST(floor((hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) / 14400) AS BIGINT) * INTERVAL 4 HOUR AS t,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k, value AS price, event_id, value < 20 AS bad FROM events),
v AS (SELECT * FROM cand WHERE NOT bad),
best AS (SELECT *, count(*) OVER (PARTITION BY symbol, day) AS valid, count(*) OVER (PARTITION BY symbol, day, t) AS ties FROM v
  QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY t DESC, k, source) = 1),
tot AS (SELECT symbol, day, count(*) AS candidates FROM cand GROUP BY 1, 2),
sel AS (SELECT tot.symbol, tot.day, b.source, b.k AS request_latency_ms, b.t, candidates, coalesce(valid, 0) AS valid_candidates,
  CASE WHEN b.symbol IS NULL THEN 'NO_VALID_SOURCE' WHEN date_diff('second', t, CAST(tot.day AS TIMESTAMP) + INTERVAL 24 HOUR) > 14400 THEN 'NEWEST_VALID_BUT_STALE'
    WHEN valid = 1 THEN 'ONLY_VALID_SOURCE' WHEN ties > 1 THEN 'EQUAL_SOURCE_TIMESTAMP_LOWER_REQUEST_LATENCY' ELSE 'NEWEST_VALID_SOURCE_TIMESTAMP' END AS selection_reason
  FROM tot LEFT JOIN best b ON b.symbol = tot.symbol AND b.day = tot.day)"""


def selected(spark, d):
    c = candidates(spark, d)
    return S.select_quotes(c.drop("as_of"), instant_at(F.col("day"), 86400), 14400, ["symbol", "day"])


@query("j01_select_quotes", f"WITH {_CAND} SELECT symbol, day, source, request_latency_ms, candidates, valid_candidates, selection_reason FROM sel")
def select_quotes(spark, d):
    return selected(spark, d).select("symbol", "day", "source", "request_latency_ms", "candidates", "valid_candidates", "selection_reason")


@query("e16_best_candidate", f"WITH {_CAND} SELECT symbol, day, source, k AS request_latency_ms FROM best")
def best_candidate(spark, d):
    return selected(spark, d).filter("selection_reason <> 'NO_VALID_SOURCE'").select("symbol", "day", "source", "request_latency_ms")


@query("c01_candidate_alignment", f"WITH {_CAND} SELECT symbol, day, candidates, valid_candidates FROM sel")
def candidate_alignment(spark, d):
    return selected(spark, d).select("symbol", "day", "candidates", "valid_candidates")


@query("d11_candidate_summary", f"""WITH {_CAND} SELECT symbol, source, count(*) AS returned, count(CASE WHEN bad THEN 1 END) AS errors,
  strftime(min(CASE WHEN NOT bad THEN t END), '%Y-%m-%d %H:%M') AS first_timestamp, strftime(max(CASE WHEN NOT bad THEN t END), '%Y-%m-%d %H:%M') AS last_timestamp FROM cand GROUP BY 1, 2""")
def candidate_summary(spark, d):
    out = S.candidate_summary(candidates(spark, d), F.lit("2024-02-01T00:00:00Z").cast("timestamp"))
    show = lambda c: F.replace(F.substring(shanghai_text(F.col(c)), 1, 16), F.lit("T"), F.lit(" ")).alias(c)
    return out.select("symbol", "source", "returned", "errors", show("first_timestamp"), show("last_timestamp"))


@query("d12_batch_health", f"""WITH {_CAND} SELECT day, CASE WHEN bool_and(selection_reason = 'NO_VALID_SOURCE') THEN 'error' WHEN bool_or(selection_reason = 'NO_VALID_SOURCE') THEN 'partial' ELSE 'success' END AS health,
  count(*) AS quotes FROM sel GROUP BY day""")
def batch_health(spark, d):
    return S.batch_health(selected(spark, d), ["day"])


def _histories(spark, d):
    """Two providers of every series: one stops early, one starts late."""
    b = T.daily_bars(spark, d).drop("source")
    n = F.substring("symbol", 6, 3).cast("int")
    early = b.filter((n % 3 != 0) | (F.col("date") < F.lit("2001-03-01").cast("date"))).withColumn("source", F.lit("tencent"))
    late = b.filter((n % 3 == 0) | (F.col("date") >= F.lit("1997-01-01").cast("date"))).withColumn("source", F.lit("sina"))
    return early.unionByName(late)


@query("j02_select_history", f"""WITH {DAILY}, x AS (SELECT *, CAST(substr(symbol, 6, 3) AS INT) AS n FROM bars),
both2 AS (SELECT *, 'tencent' AS source FROM x WHERE n % 3 <> 0 OR date < DATE '2001-03-01' UNION ALL SELECT *, 'sina' FROM x WHERE n % 3 = 0 OR date >= DATE '1997-01-01'),
st AS (SELECT symbol, source, max(date) AS l, count(*) AS c FROM both2 GROUP BY 1, 2),
win AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY l DESC, c DESC, source) = 1)
SELECT b.symbol, b.source, b.date, b.close FROM both2 b JOIN win USING (symbol, source)""")
def select_history(spark, d):
    return S.select_daily_history(_histories(spark, d)).select("symbol", "source", "date", "close")


@query("j03_intraday_fallback", f"""WITH {MINUTES}, prim AS (SELECT DISTINCT symbol FROM points WHERE symbol <> 'error' AND symbol <> 'view'),
back AS (SELECT p.* FROM points p WHERE symbol NOT IN (SELECT symbol FROM prim) QUALIFY CAST(minute AS DATE) = max(CAST(minute AS DATE)) OVER (PARTITION BY symbol))
SELECT symbol, minute, last_cents / 100 AS price, 'primary' AS routing FROM points WHERE symbol IN (SELECT symbol FROM prim)
UNION ALL SELECT symbol, minute, last_cents / 100, 'minute_close_fallback' FROM back""")
def intraday_fallback(spark, d):
    p = T.minute_points(spark, d)
    nothing = F.lit(None).cast("double")
    base = p.select("symbol", "minute", F.to_date("minute").alias("session_date"), "source_timestamp", (F.col("last_cents") / 100).alias("price"),
                    nothing.alias("cumulative_volume_shares"), nothing.alias("cumulative_amount_cny"), nothing.alias("interval_volume_shares"),
                    nothing.alias("interval_amount_cny"), nothing.alias("interval_minutes"), nothing.alias("average_price_cny"), F.lit(True).alias("complete"))
    bars = p.select("symbol", "source_timestamp", (F.col("last_cents") / 100).alias("close"), F.col("n").cast("double").alias("volume_shares"), nothing.alias("amount_cny"), F.lit(True).alias("complete"))
    out = N.intraday_with_fallback(base.filter(~F.col("symbol").isin("error", "view")), bars)
    wall = F.replace(F.substring(shanghai_text(F.col("source_timestamp")), 1, 19), F.lit("T"), F.lit(" "))
    return out.select("symbol", F.to_timestamp_ntz(wall).alias("minute"), "price", "routing")


@query("b18_latest_session", f"""WITH {MINUTES} SELECT symbol, minute FROM points QUALIFY CAST(minute AS DATE) = max(CAST(minute AS DATE)) OVER (PARTITION BY symbol)""")
def latest_session(spark, d):
    return N.latest_session_rows(T.minute_points(spark, d)).select("symbol", "minute")


@query("b05_quote_validity", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 4 THEN 'FUTURE_SOURCE_TIMESTAMP' WHEN c_acctbal < 0 THEN 'INVALID_QUOTE_VALUES'
  WHEN c_acctbal = 0 OR o_totalprice > 300000 THEN 'INVALID_QUOTE_OHLC' END AS reason FROM orders JOIN customer ON o_custkey = c_custkey""")
def quote_validity(spark, d):
    o = T.table(spark, d, "orders").join(T.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    at = instant_at(F.to_date("o_orderdate"), 0)
    p = F.col("o_totalprice")
    q = o.select("o_orderkey", F.col("c_name").alias("name"), F.lit("CNY").alias("currency"), F.lit("tencent").alias("source"), at.alias("source_timestamp"),
                 F.timestamp_seconds(F.unix_seconds(at) - F.when(F.col("o_orderkey") % 9 == 4, 6).otherwise(5)).alias("fetched_at"),
                 p.alias("price"), F.col("c_acctbal").alias("previous_close"), p.alias("open"), F.least(p, F.lit(300000.0)).alias("high"), F.lit(0.0).alias("low"),
                 F.lit(1.0).alias("volume_shares"), F.lit(1.0).alias("amount_cny"))
    return q.withColumn("reason", Q.quote_reason(include_book=False)).select("o_orderkey", "reason")


@query("g02_dedupe_first", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""")
def dedupe_first(spark, d):
    o = T.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return S.keep_first(o, ["o_custkey"], F.col("o_orderkey"))


@query("g02_deduplicated_count", "SELECT count(*) - count(DISTINCT o_custkey) AS deduplicated_count FROM orders")
def deduplicated_count(spark, d):
    return S.dedupe(T.table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")[1]


@query("g04_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return S.duplicate_keys(T.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("g05_merge_first", """WITH u AS (SELECT o_custkey AS symbol, o_orderkey AS n, 0 AS pr FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderstatus <> 'F')
SELECT symbol, n FROM u QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pr, n) = 1""")
def merge_first(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("n"), "o_orderstatus")
    by_code = o.filter("o_orderstatus = 'F'").drop("o_orderstatus")
    by_name = o.filter("o_orderstatus <> 'F'").drop("o_orderstatus")
    return S.union_first([by_code, by_name], ["symbol"], "n").select("symbol", "n")


# -- names ---------------------------------------------------------------------------
def name_candidates(spark, d):
    """Searches by part name: candidates share the name's first word and size."""
    p = T.table(spark, d, "part").select("p_partkey", "p_name", "p_size", F.floor(F.col("p_partkey") / 100).alias("page"))
    full = F.when(F.col("p_size") % 5 == 0, F.translate("p_name", "abcdefgh", "ａｂｃｄｅｆｇｈ")).otherwise(F.col("p_name"))
    name = normalized_name(nfkc(F.concat_ws(" ", full, "p_size")))
    return p.withColumn("norm", F.concat_ws("/", F.col("page"), name)).withColumn(
        "group", F.concat_ws("/", "page", F.substring_index("p_name", " ", 1)))


_NAMES = """p AS (SELECT p_partkey AS symbol, CAST(floor(p_partkey / 100) AS BIGINT) || '/' || upper(replace(p_name, ' ', '')) || p_size AS norm,
  CAST(floor(p_partkey / 100) AS BIGINT) || '/' || split_part(p_name, ' ', 1) AS grp FROM part),
lookups AS (SELECT DISTINCT norm AS lookup_name, grp FROM p),
c AS (SELECT l.lookup_name, p.symbol, p.norm AS candidate_name FROM lookups l JOIN p USING (grp)),
r AS (SELECT lookup_name, count(DISTINCT CASE WHEN candidate_name = lookup_name THEN symbol END) AS n, min(CASE WHEN candidate_name = lookup_name THEN symbol END) AS s FROM c GROUP BY 1),
res AS (SELECT lookup_name, CASE WHEN n = 1 THEN s END AS symbol, CASE WHEN n = 0 THEN 'STOCK_NAME_NOT_FOUND' WHEN n > 1 THEN 'STOCK_NAME_AMBIGUOUS' END AS error FROM r)"""


def _search(spark, d):
    p = name_candidates(spark, d)
    lookups = p.select(F.col("norm").alias("lookup_name"), "group").distinct()
    c = lookups.join(p.select("group", F.col("p_partkey").alias("symbol"), F.col("norm").alias("candidate_name")), "group")
    return lookups.select("lookup_name"), c.withColumn("truncated", F.lit(False)).withColumn("position", F.col("symbol"))


@query("c13_name_resolution", f"WITH {_NAMES} SELECT * FROM res")
def name_resolution(spark, d):
    return S.resolve_names(*_search(spark, d))


@query("j26_resolve_and_verify", f"""WITH {_NAMES} SELECT lookup_name, CASE WHEN error IS NULL AND symbol % 7 = 3 THEN NULL ELSE symbol END AS symbol,
  CASE WHEN error IS NULL AND symbol % 7 = 3 THEN 'STOCK_NAME_QUOTE_MISMATCH' WHEN error IS NULL AND symbol % 11 = 5 THEN 'QUOTE_UNAVAILABLE' ELSE error END AS error FROM res""")
def resolve_and_verify(spark, d):
    resolved = S.resolve_names(*_search(spark, d))
    k = F.col("p_partkey")
    quotes = name_candidates(spark, d).filter((k % 11 != 5) | (k % 7 == 3)).select(
        k.alias("symbol"), F.when(k % 7 == 3, "other").otherwise(F.col("norm")).alias("quote_name"))
    return S.verify_names(resolved, quotes)


@query("c16_name_verification", """SELECT o_orderkey, c_name = 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS same_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def name_verification(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("symbol"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("lookup_name"))
    q = T.table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_name").alias("quote_name"))
    j = o.join(q, "symbol", "left")
    return j.select("o_orderkey", (F.col("quote_name") == F.col("lookup_name")).alias("same_name"))


@query("f08_candidate_list", f"""WITH {_NAMES} SELECT lookup_name, symbol, CAST(row_number() OVER (PARTITION BY lookup_name ORDER BY candidate_name = lookup_name DESC, symbol) AS INTEGER) AS rank FROM c QUALIFY rank <= 3""")
def candidate_list(spark, d):
    return S.top_candidates(_search(spark, d)[1], 3).select("lookup_name", "symbol", "rank")


@query("b17_search_text", """SELECT p_partkey, regexp_full_match(trim(p_name || CASE WHEN p_size % 7 = 3 THEN '!' WHEN p_size % 7 = 4 THEN ' 中文' ELSE '' END), '[\\p{Han}A-Za-z0-9 *．.\\-]+') AS ok FROM part""")
def search_text(spark, d):
    p = T.table(spark, d, "part")
    tail = F.when(F.col("p_size") % 7 == 3, "!").when(F.col("p_size") % 7 == 4, " 中文").otherwise("")
    return p.select("p_partkey", search_text_ok(F.concat("p_name", tail)).alias("ok"))


@query("h01_nfkc_names", """SELECT p_partkey, p_name AS nfkc_name, upper(replace(p_name, ' ', '')) AS normalized_name FROM part""")
def nfkc_names(spark, d):
    wide = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ")
    p = T.table(spark, d, "part").select("p_partkey", nfkc(wide).alias("nfkc_name"))
    return p.select("p_partkey", "nfkc_name", normalized_name(F.col("nfkc_name")).alias("normalized_name"))
