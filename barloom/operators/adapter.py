"""Stored dataset documents as screen input, with one error code per series.

A record is one answer about a series: symbol, key (`1d:none`), available,
state, source_finality and the JSON document. Records are judged row by row;
only their keys are shuffled, to find repeats and series nobody supplied.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import period_start
from ..plans.rules import SUPPORTED_CALENDARS, SUPPORTED_POLICIES, adapter_completion
from ..sources.captures import settled
from .contracts import document_faults
from .datasets import POLICY, receipt_fault

# States a series may report, those that tell of a failure, and the intervals of the frames.
RECORD_STATES = ("ready", "partial", "pending_source", "pending", "failed_without_data", "failed", "error")
FAILED_STATES = ("failed_without_data", "failed", "error")
INTERVALS = {"D": "1d", "W": "1w", "M": "1mo"}

_DOCUMENT = """dataset_id string, symbol string, source string, interval string, adjustment string, target_session date,
calendar_version string, policy_version string, content_hash string, request_started_at string, completion_cutoff string, fetched_at string,
coverage struct<returned:long, missing_scheduled_session_dates:array<date>, calendar_gaps_unverified:boolean>,
bars array<struct<date:date, open:double, high:double, low:double, close:double, volume_shares:double, complete:boolean,
calendar_completion:boolean, completion_basis:string, period_end_session:date>>"""


def frame_keys(frames: dict) -> dict[str, str]:
    """Series key of each timeframe."""
    return {tf: f"{INTERVALS[tf]}:{frame.get('adjustment', 'none')}" for tf, frame in frames.items()}


def record_fault(symbol="symbol", key="key") -> Column:
    """Whether a record is no answer about a known series."""
    known = F.col(symbol).rlike(r"^(?i)(sh|sz)\d{6}$") & F.col(key).isin(*POLICY)
    final = F.when(F.col("available"), F.col("source_finality") == "unknown").otherwise(F.coalesce(F.col("source_finality"), F.lit("unknown")) == "unknown")
    answer = F.col("available").isNotNull() & F.col("state").isin(*RECORD_STATES) & final
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(no(known), "ADAPTER_RECORD_INVALID").when(no(answer), "ADAPTER_RESULT_INVALID")


def batch_faults(records: DataFrame, per=()) -> DataFrame:
    """Batches that are refused whole, with their code: one bad record or one repeated series is enough."""
    per = list(per)
    slim = records.select(*per, F.upper("symbol").alias("symbol"), "key", record_fault().alias("_fault"))
    pairs = slim.groupBy(*per, "symbol", "key").agg(F.count("*").alias("_n"), F.min("_fault").alias("_fault"))
    code = F.coalesce(F.min("_fault"), F.when(F.max("_n") > 1, "DUPLICATE_SERIES"))
    return pairs.groupBy(*per).agg(code.alias("batch_error")).filter("batch_error IS NOT NULL")


def _judged(records: DataFrame, frames: dict, run: dict, source: str) -> DataFrame:
    """Records of the wanted series with their parsed document `_d` and error_code."""
    keys = frame_keys(frames)
    frame = F.create_map(*[F.lit(x) for tf, key in keys.items() for x in (key, tf)])
    cutoffs = F.create_map(*[F.lit(x) for tf in keys for x in (tf, frames[tf]["cutoff_date"])])
    rows = records.filter(F.col("key").isin(*keys.values())).withColumns({"symbol": F.upper("symbol"), "timeframe": frame[F.col("key")]})
    rows = document_faults(rows.withColumn("document", F.when(F.col("available") & (F.col("state") == "ready"), F.col("document"))), "document")
    rows = settled(rows.withColumn("_d", F.from_json("document", _DOCUMENT)))
    d = F.col("_d")
    at = {c: d[c].cast("timestamp") for c in ("request_started_at", "completion_cutoff", "fetched_at")}
    rows = rows.withColumns(at)
    identity = (
        (d["dataset_id"] == run["run_id"]) & (F.upper(d["symbol"]) == F.col("symbol")) & (F.concat_ws(":", d["interval"], d["adjustment"]) == F.col("key"))
        & (d["source"] == source) & (d["target_session"] == cutoffs[F.col("timeframe")].cast("date")))
    frozen = d["target_session"] == F.lit(run["target_session"]).cast("date")
    for name in ("calendar_version", "policy_version"):
        frozen = frozen & (d[name] == run[name])
    policies = (*SUPPORTED_POLICIES, *run.get("synthetic_policies", ()))
    rows = rows.withColumn("_target", d["target_session"])
    last = F.element_at(d["bars"], -1)["date"]
    no = lambda c: ~F.coalesce(c, F.lit(False))
    error = (
        F.when(~F.col("available"), F.when(F.col("state").isin(*FAILED_STATES), "UPSTREAM_FAILED_WITHOUT_DATA").otherwise("SERIES_NOT_AVAILABLE"))
        .when(F.col("state") != "ready", "AVAILABLE_STATE_CONTRADICTION")
        .when(F.col("quality_error").isNotNull(), F.col("quality_error"))
        .when(no(identity), "DATASET_IDENTITY_OR_UNITS")
        .when(no(frozen), "DATASET_FREEZE_TUPLE_MISMATCH")
        .when(~d["policy_version"].isin(*policies), "POLICY_VERSION_UNSUPPORTED")
        .when(receipt_fault("_target").isNotNull(), "RECEIPT_CLOCK_INVALID")
        .when((F.size(d["bars"]) > 0) & no(last == d["target_session"]), "OBSERVATION_TARGET_MISMATCH")
    )
    return settled(rows.withColumn("error_code", error).drop("quality_error", "document", "_target"))


def adapt_documents(records: DataFrame, frames: dict, run: dict, per=(), source="tencent"):
    """Records as screen input: (series, bars, diagnostics).

    `frames` maps a timeframe to its cutoff_date and adjustment, `run` names
    run_id, target_session, calendar_version and policy_version, and may list
    further `synthetic_policies` and `calendars`. `per` names the columns that tell batches
    apart; a refused batch gives one diagnostic and no series. A series has
    one error code, the first of: failed upstream, available but not ready,
    field contract and bars, identity, freeze tuple, policy, receipt clocks,
    last bar off the target. A series that is wanted but not available is no
    row of `series` but a diagnostic, as is a calendar nobody knows, which
    leaves the completion of its bars unknown.
    """
    per = list(per)
    keys = frame_keys(frames)
    wanted = {tf: key for tf, key in keys.items() if key in POLICY}
    refused = batch_faults(records, per)
    code = lambda df, c: df.select(*per, F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("timeframe"), c.alias("code"))
    if per:
        sound = records.join(refused.select(*per), per, "left_anti")
    else:
        sound = records.filter(F.coalesce(refused.agg(F.count("*")).scalar(), F.lit(0)) == 0)
    judged = _judged(sound, {tf: frames[tf] for tf in wanted}, run, source)
    d, calendar = F.col("_d"), F.col("_d.calendar_version").isin(*SUPPORTED_CALENDARS, *run.get("calendars", ()))
    ready = F.col("error_code").isNull()
    series = judged.filter(ready | (F.col("error_code") != "SERIES_NOT_AVAILABLE")).select(
        *per, "symbol", "timeframe", F.when(ready, "ready").otherwise("error").alias("status"), "error_code", d["dataset_id"].alias("dataset_id"),
        d["target_session"].alias("target_session"), d["calendar_version"].alias("calendar_version"), d["policy_version"].alias("policy_version"),
        d["content_hash"].alias("content_hash"), "request_started_at", "completion_cutoff", "fetched_at", d["source"].alias("source"),
        d["adjustment"].alias("adjustment"), F.lit("CNY").alias("currency"), F.lit("shares").alias("volume_unit"),
        d["coverage"]["returned"].alias("returned"), d["coverage"]["missing_scheduled_session_dates"].alias("missing_sessions"),
        d["coverage"]["calendar_gaps_unverified"].alias("calendar_gaps_unverified"))
    interval = F.substring_index("key", ":", 1)
    start = F.coalesce(*[F.when(interval == i, period_start(F.col("bar.date"), i)) for i in INTERVALS.values()])
    evidence = adapter_completion(F.col("bar.complete"), F.col("bar.calendar_completion"), F.col("bar.completion_basis"))
    bars = judged.filter(ready).select(*per, "symbol", "timeframe", "key", calendar.alias("_known"), d["source"].alias("source"),
                                       d["adjustment"].alias("adjustment"), F.explode(d["bars"]).alias("bar"))
    bars = bars.select(
        *per, "symbol", "timeframe", "bar.date", start.alias("period_start"), F.col("bar.period_end_session").alias("period_end"),
        F.when(F.col("_known"), F.coalesce(evidence, F.lit("unknown"))).otherwise("unknown").alias("completion"), "bar.calendar_completion",
        "bar.completion_basis", "source", "adjustment", "bar.open", "bar.high", "bar.low", "bar.close", "bar.volume_shares")
    supplied = sound.groupBy(*per, F.upper("symbol").alias("symbol")).agg(F.collect_set("key").alias("_keys"))  # the registry has four keys
    frames_of = F.array(*[F.struct(F.lit(tf).alias("timeframe"), F.lit(key).alias("key")) for tf, key in keys.items()])
    asked = supplied.select(*per, "symbol", "_keys", F.explode(frames_of).alias("f")).filter(~F.array_contains("_keys", F.col("f.key")))
    absent = asked.select(*per, "symbol", "f.timeframe", F.when(F.col("f.key").isin(*POLICY), "SERIES_NOT_AVAILABLE").otherwise("SERIES_NOT_IN_REGISTRY").alias("code"))
    own = judged.select(*per, "symbol", "timeframe", F.explode(F.array_compact(F.array(
        F.col("error_code"), F.when((ready | (F.col("error_code") == "OBSERVATION_TARGET_MISMATCH")) & ~calendar, "CALENDAR_VERSION_UNSUPPORTED")))).alias("code"))
    # A failed series that says so reports in its own row only.
    own = own.filter("code <> 'UPSTREAM_FAILED_WITHOUT_DATA'")
    return series, bars, code(refused, F.col("batch_error")).unionByName(own).unionByName(absent)
