"""Provider selection for quotes and daily histories, and name resolution."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import age_seconds
from .blocks import join_on

MAX_AGE = 90


def select_quotes(candidates: DataFrame, as_of: Column, max_age=MAX_AGE, keys=("symbol",)) -> DataFrame:
    """One row per key: the best candidate, why it won, and all candidates.

    Newest source timestamp wins, then lower latency, then source name. The
    choice is a rank that Spark cuts to two rows per key before the shuffle
    (the second one tells ties), so a key with many candidates fills no task;
    the counts are a hash aggregate on the same key. Candidates need source,
    source_timestamp, request_latency_ms and `reason` (NULL when valid).
    """
    keys = list(keys)
    valid = F.col("reason").isNull()
    extra = [c for c in candidates.columns if c not in (*keys, "reason")]
    order = Window.partitionBy(*keys).orderBy(F.desc(F.unix_micros("source_timestamp")), "request_latency_ms", "source")
    two = candidates.filter(valid & F.col("source_timestamp").isNotNull()).withColumn("_rn", F.row_number().over(order)).filter("_rn <= 2")
    tied = F.lead("source_timestamp").over(Window.partitionBy(*keys).orderBy("_rn")) == F.col("source_timestamp")
    best = two.withColumn("_tied", F.coalesce(tied, F.lit(False))).filter("_rn = 1").select(*keys, F.struct(*extra).alias("_best"), "_tied")
    agg = candidates.groupBy(*keys).agg(
        F.count_if(valid).alias("valid_candidates"),
        F.count("*").alias("candidates"),
        F.count_if(valid & (age_seconds(as_of, F.col("source_timestamp")) <= max_age)).alias("recent_candidates"),
        F.max(F.when(valid, F.col("source_timestamp"))).alias("_newest"),
    )
    agg = join_on(agg, best, keys, "left")
    age = age_seconds(as_of, F.col("_newest"))
    reason = (
        F.when(F.col("valid_candidates") == 0, "NO_VALID_SOURCE")
        .when(age > max_age, "NEWEST_VALID_BUT_STALE")
        .when(F.col("valid_candidates") == 1, "ONLY_VALID_SOURCE")
        .when(F.col("_tied"), "EQUAL_SOURCE_TIMESTAMP_LOWER_REQUEST_LATENCY")
        .otherwise("NEWEST_VALID_SOURCE_TIMESTAMP")
    )
    freshness = F.when(age.isNull(), F.lit(None).cast("string")).when(age <= max_age, "recent").otherwise("stale")
    return agg.select(
        *keys, "_best.*", reason.alias("selection_reason"), age.alias("data_age_seconds"), freshness.alias("freshness"),
        "candidates", "valid_candidates", "recent_candidates")


def candidate_summary(candidates: DataFrame, as_of: Column, max_age=MAX_AGE, keys=("symbol",)) -> DataFrame:
    """One row per (key, source): status, newest timestamp, rows returned."""
    age = age_seconds(as_of, F.col("source_timestamp"))
    status = F.when(F.col("reason").isNotNull(), "error").when(age <= max_age, "recent").otherwise("stale")
    return candidates.withColumn("_status", status).groupBy(*keys, "source").agg(
        F.count("*").alias("returned"),
        F.count_if(F.col("_status") == "error").alias("errors"),
        F.count_if(F.col("_status") == "recent").alias("recent"),
        F.min(F.when(F.col("reason").isNull(), F.col("source_timestamp"))).alias("first_timestamp"),
        F.max(F.when(F.col("reason").isNull(), F.col("source_timestamp"))).alias("last_timestamp"),
    )


def batch_health(selected: DataFrame, keys) -> DataFrame:
    """error when nothing was usable, partial when some was not, else success."""
    bad = F.col("selection_reason") == "NO_VALID_SOURCE"
    health = F.when(F.bool_and(bad), "error").when(F.bool_or(bad), "partial").otherwise("success")
    return selected.groupBy(*keys).agg(health.alias("health"), F.count("*").alias("quotes"))


def select_daily_history(bars: DataFrame, series_meta: DataFrame | None = None, keys=("symbol",), date="date") -> DataFrame:
    """Bars of the winning provider per key; providers are never spliced.

    Newest last bar wins, then more bars, then lower latency, then source.
    `series_meta` (keys, source, request_latency_ms, reason) is optional.
    """
    keys = list(keys)
    stats = bars.groupBy(*keys, "source").agg(F.max(date).alias("last_date"), F.count("*").alias("returned"))
    if series_meta is not None:
        stats = stats.join(series_meta, [*keys, "source"], "left").filter(F.col("reason").isNull())
        latency = F.coalesce("request_latency_ms", F.lit(0).cast("long"))
    else:
        latency = F.lit(0).cast("long")
    rank = F.struct((-F.unix_date("last_date")).alias("a"), (-F.col("returned")).alias("b"), latency.alias("c"), F.col("source").alias("d"))
    winner = stats.groupBy(*keys).agg(
        F.min_by("source", rank).alias("source"),
        F.when(F.count("*") == 1, "ONLY_VALID_SOURCE").otherwise("NEWEST_DATE_THEN_COVERAGE_THEN_HTTP_LATENCY").alias("selection_reason"))
    return bars.join(winner, [*keys, "source"])


def union_first(frames, keys, order: str) -> DataFrame:
    """Union in priority order, keeping the first row per key."""
    stacked = None
    for priority, df in enumerate(frames):
        df = df.withColumn("_priority", F.lit(priority))
        stacked = df if stacked is None else stacked.unionByName(df)
    return keep_first(stacked, keys, F.struct("_priority", order)).drop("_priority")


def keep_first(df: DataFrame, keys, order: Column) -> DataFrame:
    """First row per key by input order: a rank of one, which Spark cuts before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order.asc_nulls_last()))
    return df.withColumn("_rn", rank).filter("_rn = 1").drop("_rn")


def dedupe(df: DataFrame, keys, order: str):
    """(first rows, one-row frame with the deduplicated_count)."""
    kept = keep_first(df, keys, F.col(order))
    n = kept.select(F.count("*")).scalar()
    return kept, df.agg((F.count("*") - n).alias("deduplicated_count"))


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")


def resolve_names(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """Resolve lookup names to symbols through exact normalized-name matches.

    names: lookup_name. candidates: lookup_name (the search it came from),
    symbol, candidate_name (both names already normalized), truncated. A name
    resolves to exactly one symbol, a symbol must not carry another name in
    the same response, and two lookups must not claim one symbol.
    """
    exact = F.col("candidate_name") == F.col("lookup_name")
    ids = candidates.select("lookup_name", "symbol", "candidate_name", "truncated").distinct()
    per_symbol = ids.groupBy("lookup_name", "symbol").agg(
        F.bool_or(exact).alias("_exact"), F.bool_or(~exact).alias("_other"), F.bool_or("truncated").alias("_cut"))
    per_name = per_symbol.groupBy("lookup_name").agg(
        F.count_if("_exact").alias("_n"), F.bool_or(F.col("_exact") & F.col("_other")).alias("_mixed"),
        F.bool_or("_cut").alias("_cut"), F.min(F.when(F.col("_exact"), F.col("symbol"))).alias("symbol"))
    out = names.select("lookup_name").distinct().join(per_name, "lookup_name", "left")
    error = (
        F.when(F.coalesce("_cut", F.lit(False)), "STOCK_SEARCH_TRUNCATED")
        .when(F.coalesce("_n", F.lit(0)) == 0, "STOCK_NAME_NOT_FOUND")
        .when((F.col("_n") > 1) | F.col("_mixed"), "STOCK_NAME_AMBIGUOUS")
    )
    out = out.withColumn("error", error)
    claims = out.filter("error IS NULL").groupBy("symbol").agg(F.count("*").alias("_claims"))
    out = out.join(claims, "symbol", "left")
    error = F.coalesce("error", F.when(F.col("_claims") > 1, "STOCK_NAME_AMBIGUOUS"))
    return out.select("lookup_name", F.when(error.isNull(), F.col("symbol")).alias("symbol"), error.alias("error"))


def verify_names(resolved: DataFrame, quotes: DataFrame) -> DataFrame:
    """Check each resolved symbol against the name its quote carries.

    quotes: symbol, quote_name (normalized).
    """
    j = resolved.join(quotes, "symbol", "left")
    mismatch = F.col("error").isNull() & F.col("quote_name").isNotNull() & (F.col("quote_name") != F.col("lookup_name"))
    missing = F.col("error").isNull() & F.col("quote_name").isNull()
    error = F.when(mismatch, "STOCK_NAME_QUOTE_MISMATCH").when(missing, "QUOTE_UNAVAILABLE").otherwise(F.col("error"))
    return j.select("lookup_name", F.when(~F.coalesce(mismatch, F.lit(False)), F.col("symbol")).alias("symbol"), error.alias("error"))


def top_candidates(candidates: DataFrame, n: int = 20) -> DataFrame:
    """Per lookup: exact matches first, then response order, at most n."""
    exact = F.col("candidate_name") == F.col("lookup_name")
    w = Window.partitionBy("lookup_name").orderBy(exact.desc(), "position")
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
