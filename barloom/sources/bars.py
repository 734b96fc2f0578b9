"""Bar, minute-session and pre-open captures."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clock import instant_at, parse_stamp, shanghai_date, strict_date
from ..functions.numbers import strict_number
from ..functions.symbols import lot_factor
from ..operators.calendar import with_bar_completion
from ..operators.intraday import POINT_DELAY_SECONDS
from .captures import first_code, settled, split_valid

# Fixed value: a minute bar is complete once its end label is 3 s old.
BAR_DELAY_SECONDS = 3
PERIOD_NAMES = {"1d": "day", "1w": "week", "1mo": "month"}
WRAPPED = "array<struct<day:string,open:string,high:string,low:string,close:string,volume:string,amount:string>>"
BAR_FIELDS = ("open", "high", "low", "close", "volume_shares")


def _wrapped_rows(body: Column) -> Column:
    """JSON rows between the first `([` and the last `])`."""
    return F.from_json(F.regexp_extract(body, r"(?s)\((\[.*\])\)", 1), WRAPPED)


def _contained(b: Column) -> Column:
    o, h, l, c = b["open"], b["high"], b["low"], b["close"]
    return (b["volume_shares"] >= 0) & (h >= l) & (o >= l) & (o <= h) & (c >= l) & (c <= h)


def value_code(b: Column, require_positive_low=False) -> Column:
    """Reason a bar struct is invalid: a missing number or broken containment."""
    missing = b["open"].isNull() | b["high"].isNull() | b["low"].isNull() | b["close"].isNull() | b["volume_shares"].isNull()
    bad = ~_contained(b)
    if require_positive_low:
        bad = bad | (b["low"] <= 0)
    return F.when(missing, "INVALID_SOURCE_NUMBER").when(bad, "INVALID_BAR_VALUES")


def _bar(r: Column, volume: Column) -> list:
    n = lambda k: strict_number(r[k]).alias(k)
    return [n("open"), n("high"), n("low"), n("close"), volume.alias("volume_shares")]


def decode_minute_bars(raw: DataFrame, cutoff: Column, limit: int | None, include_incomplete=False):
    """1m / 5m bars: (valid bars, quarantined captures).

    Completeness is an end label 3 s before the cutoff. The whole capture is
    judged inside its row; only kept bars are exploded, the newest `limit` of
    a capture or, without a limit, all.
    """
    df = raw.withColumn("_cut", F.unix_micros(cutoff)).withColumn("_rows", _wrapped_rows(F.col("body")))
    late = F.col("_cut")
    bars = F.transform("_rows", lambda r: F.struct(
        parse_stamp(r["day"]).alias("source_timestamp"), *_bar(r, strict_number(r["volume"])),
        strict_number(r["amount"]).alias("amount_cny"),
        (r["amount"].isNotNull() & strict_number(r["amount"]).isNull()).alias("bad_amount"),
        (F.unix_micros(parse_stamp(r["day"])) + BAR_DELAY_SECONDS * 1_000_000 < late).alias("complete"),
    ))
    df = settled(df.withColumn("_bars", bars).drop("body"))
    codes = F.transform("_bars", lambda b: F.when(b["source_timestamp"].isNull(), "INVALID_SOURCE_TIMESTAMP")
                        .when(b["bad_amount"], "INVALID_SOURCE_NUMBER")
                        .when(value_code(b).isNotNull(), value_code(b)).when(b["amount_cny"] < 0, "INVALID_BAR_VALUES"))
    kept = F.col("_bars") if include_incomplete else F.filter("_bars", lambda b: b["complete"])
    kept = F.array_sort(kept)
    newest = kept if limit is None else F.slice(kept, F.greatest(F.size(kept) - limit + 1, F.lit(1)), F.lit(limit))
    df = df.withColumn("_kept", newest)
    df = df.withColumn("excluded", F.size("_bars") - F.size(kept))
    df = df.withColumn("reason", F.when(F.col("_rows").isNull(), "INVALID_SINA_BAR_WRAPPER")
                       .when(first_code(codes).isNotNull(), first_code(codes))
                       .when(F.size("_kept") == 0, "NO_COMPLETED_BARS"))
    good, bad = split_valid(df.drop("_rows", "_bars", "_cut"))
    keep = [c for c in good.columns if c not in ("_kept", "excluded")]
    out = good.select(*keep, "excluded", F.inline("_kept")).drop("bad_amount")
    return out, bad.drop("_kept")


def _daily_rows(raw: DataFrame, provider: str, interval: str, adjustment: str) -> DataFrame:
    """Add `_bars`, an array of bar structs, and `_absent`."""
    if provider == "sina":
        df = raw.withColumn("_rows", _wrapped_rows(F.col("body")))
        make = lambda r: F.struct(
            strict_date(r["day"]).alias("date"), *_bar(r, strict_number(r["volume"])))
        absent = F.when(F.col("_rows").isNull(), "INVALID_SINA_BAR_WRAPPER").when(F.size("_rows") == 0, "DAILY_HISTORY_UNAVAILABLE")
    else:
        key = ("" if adjustment == "none" else adjustment) + PERIOD_NAMES[interval]
        doc = F.from_json("body", "struct<code:int,data:map<string,map<string,array<array<string>>>>>")
        df = raw.withColumn("_doc", doc)
        series = F.element_at("_doc.data", F.col("symbol"))
        df = df.withColumn("_rows", F.element_at(series, F.lit(key)))
        at = lambda r, i: strict_number(F.get(r, F.lit(i)))
        factor = lot_factor(F.col("symbol"))
        # Field order in a record: date, open, close, high, low, volume.
        make = lambda r: F.struct(
            strict_date(F.get(r, F.lit(0))).alias("date"), at(r, 1).alias("open"), at(r, 3).alias("high"),
            at(r, 4).alias("low"), at(r, 2).alias("close"), (at(r, 5) * factor).alias("volume_shares"))
        absent = (
            F.when((F.col("_doc.code") != 0) | series.isNull() | F.col("_doc.code").isNull(), "SYMBOL_DATA_UNAVAILABLE")
            .when(F.coalesce(F.size("_rows"), F.lit(-1)) <= 0, "HISTORY_OR_REQUESTED_ADJUSTMENT_UNAVAILABLE")
            .when(factor.isNull(), "TENCENT_VOLUME_UNIT_UNVERIFIED_FOR_CDR")
        )
    df = df.withColumn("_bars", F.transform("_rows", make)).withColumn("_absent", absent)
    return df.drop("_rows", "_doc", "body")


def decode_history(raw, provider, dim, cutoff, interval="1d", adjustment="none", limit=None, include_incomplete=False):
    """Day / week / month bars with completion evidence: (valid, quarantine).

    A capture fails as a whole on a bad or repeated date, a future date, a
    known closed day or broken values. Unadjusted sina days also need low > 0.
    """
    df = settled(_daily_rows(raw, provider, interval, adjustment)).withColumn("_today", shanghai_date(cutoff))
    days = F.transform("_bars", lambda b: b["date"])
    positive = provider == "sina"
    today = F.col("_today")
    codes = F.transform("_bars", lambda b: F.when(b["date"].isNull(), "INVALID_OR_DUPLICATE_BAR_DATE")
                        .when(b["date"] > today, "FUTURE_BAR_DATE")
                        .when(value_code(b, positive).isNotNull(), value_code(b, positive)))
    reason = F.coalesce(
        F.col("_absent"), first_code(codes),
        F.when(F.size(F.array_distinct(days)) < F.size(days), "INVALID_OR_DUPLICATE_BAR_DATE"))
    if interval == "1d":
        closed = dim.filter(~F.col("is_trading")).select(F.collect_list("date")).scalar()
        reason = F.coalesce(reason, F.when(F.arrays_overlap(days, closed), "BAR_ON_NONTRADING_DATE"))
    df = df.withColumn("reason", reason).drop("_absent", "_today")
    good, bad = split_valid(df)
    bars = good.select(*[c for c in good.columns if c != "_bars"], F.inline("_bars"))
    bars = bars.withColumn("source_timestamp", instant_at(F.col("date"), 15 * 3600))
    bars = bars.withColumn("amount_cny", F.lit(None).cast("double"))
    bars = with_bar_completion(bars, dim, cutoff, interval)
    if not include_incomplete:
        bars = bars.filter("complete")
    if limit is not None:
        newest = Window.partitionBy("capture_id").orderBy(F.col("date").desc())
        bars = bars.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= limit).drop("_rn")
    return bars, bad.drop("_bars")


def _clock(point: Column) -> Column:
    return F.substring(point, 1, 2).try_cast("int") * 3600 + F.substring(point, 3, 2).try_cast("int") * 60


def decode_intraday(raw: DataFrame, cutoff: Column, include_incomplete=False):
    """Minute sessions with interval differences: (valid points, quarantine).

    Differences are taken between neighbours inside the session's array.
    """
    doc = F.from_json("body", "struct<code:int,data:map<string,struct<data:struct<date:string,data:array<string>>>>>")
    df = raw.withColumn("_doc", doc)
    session = F.element_at("_doc.data", F.col("symbol"))["data"]
    df = df.withColumn("session_date", F.when(session["date"].rlike(r"^\d{8}$"), strict_date(session["date"])))
    df = df.withColumn("_rows", session["data"]).withColumn("_factor", lot_factor(F.col("symbol")))
    day, factor = F.col("session_date"), F.col("_factor")

    def parse(f):
        amount = F.get(f, F.lit(3))
        label = F.get(f, F.lit(0))
        return F.struct(
            F.when(label.rlike(r"^([01]\d|2[0-3])[0-5]\d$"), instant_at(day, _clock(label))).alias("source_timestamp"),
            strict_number(F.get(f, F.lit(1))).alias("price"),
            (strict_number(F.get(f, F.lit(2))) * factor).alias("cumulative_volume_shares"),
            strict_number(amount).alias("cumulative_amount_cny"),
            (amount.isNotNull() & strict_number(amount).isNull()).alias("bad_amount"),
        )

    df = settled(df.withColumn("_pts", F.transform(F.transform("_rows", lambda r: F.split(r, r"\s+")), parse)).drop("body"))
    points = F.col("_pts")
    cut = F.unix_micros(cutoff)

    def enrich(p, i):
        q = F.get(points, i - 1)
        step = (F.unix_micros(p["source_timestamp"]) - F.unix_micros(q["source_timestamp"])) / F.lit(60e6)
        v, a = p["cumulative_volume_shares"], p["cumulative_amount_cny"]
        v0, a0 = q["cumulative_volume_shares"], q["cumulative_amount_cny"]
        first = i == 0
        return F.struct(
            p["source_timestamp"].alias("source_timestamp"), p["price"].alias("price"),
            v.alias("cumulative_volume_shares"), a.alias("cumulative_amount_cny"),
            F.when(~first & (v >= v0), v - v0).alias("interval_volume_shares"),
            F.when(~first & (a >= a0), a - a0).alias("interval_amount_cny"),
            F.when(~first, step).alias("interval_minutes"),
            F.when(v > 0, a / v).alias("average_price_cny"),
            (F.unix_micros(p["source_timestamp"]) + POINT_DELAY_SECONDS * 1_000_000 < cut).alias("complete"),
            F.when(p["source_timestamp"].isNull(), "INVALID_INTRADAY_TIME")
            .when(v.isNull() | p["price"].isNull() | p["bad_amount"], "INVALID_SOURCE_NUMBER")
            .when((v < 0) | F.coalesce(a < 0, F.lit(False)) | F.coalesce(~first & (step <= 0), F.lit(False)),
                  "INVALID_INTRADAY_ORDER_OR_VALUES").alias("code"),
        )

    df = settled(df.withColumn("_all", F.transform(points, enrich)))
    code = first_code(F.transform("_all", lambda p: p["code"]))
    kept = F.col("_all") if include_incomplete else F.filter("_all", lambda p: p["complete"])
    df = df.withColumn("_kept", kept).withColumn("reason", F.coalesce(
        F.when((F.col("_doc.code") != 0) | F.col("_doc.code").isNull() | session.isNull(), "SYMBOL_DATA_UNAVAILABLE")
        .when(F.col("session_date").isNull() | F.col("_rows").isNull(), "INTRADAY_UNAVAILABLE")
        .when(F.col("_factor").isNull(), "TENCENT_VOLUME_UNIT_UNVERIFIED_FOR_CDR"),
        code, F.when(F.size(kept) == 0, "NO_COMPLETED_INTRADAY_POINTS")))
    good, bad = split_valid(df.drop("_doc", "_rows", "_factor", "_pts", "_all"))
    keep = [c for c in good.columns if c != "_kept"]
    return good.select(*keep, F.inline("_kept")).drop("code"), bad.drop("_kept")


# Columns the pre-open feed never supplies.
ALWAYS_NULL = ("virtual_matched_shares", "final_match_volume_shares", "final_match_price",
               "unmatched_buy_shares", "unmatched_sell_shares", "cancelled_orders")


def decode_auction(raw: DataFrame, as_of: Column):
    """Pre-open observations labelled 09:15..09:30: (valid points, quarantine).

    Blank volume and amount stay NULL; volumes arrive in lots of 100.
    """
    doc = F.from_json("body", "struct<rc:int,data:struct<code:string,market:int,trends:array<string>>>")
    df = raw.withColumn("_doc", doc)
    d = F.col("_doc.data")
    rows = F.transform(d["trends"], lambda r: F.split(r, ",", -1))
    label = lambda f: F.substring(F.get(f, F.lit(0)), 12, 5)
    window = F.filter(rows, lambda f: (label(f) >= "09:15") & (label(f) <= "09:30"))
    n = lambda f, i: strict_number(F.get(f, F.lit(i)))
    blank = lambda f, i: F.nullif(F.trim(F.get(f, F.lit(i))), F.lit(""))
    df = df.withColumn("_pts", F.transform(window, lambda f: F.struct(
        parse_stamp(F.get(f, F.lit(0))).alias("source_timestamp"), n(f, 1).alias("observed_open"),
        n(f, 2).alias("observed_price"), n(f, 3).alias("observed_high"), n(f, 4).alias("observed_low"),
        (strict_number(blank(f, 5)) * 100).alias("reported_volume_shares"), strict_number(blank(f, 6)).alias("reported_amount_cny"),
        ((blank(f, 5).isNotNull() & strict_number(blank(f, 5)).isNull())
         | (blank(f, 6).isNotNull() & strict_number(blank(f, 6)).isNull())).alias("bad_text"),
    )))
    df = settled(df.drop("body"))
    pts, limit = F.col("_pts"), F.unix_micros(as_of) + 5_000_000

    def code(p, i):
        q = F.get(pts, i - 1)
        o, x, h, l = (p[f"observed_{k}"] for k in ("open", "price", "high", "low"))
        ordered = (i == 0) | (
            (p["source_timestamp"] > q["source_timestamp"]) & (shanghai_date(p["source_timestamp"]) == shanghai_date(q["source_timestamp"])))
        values = (o > 0) & (x > 0) & (h > 0) & (l > 0) & (l <= h) & (x >= l) & (x <= h) & (o >= l) & (o <= h)
        counts = F.coalesce(p["reported_volume_shares"] >= 0, F.lit(True)) & F.coalesce(p["reported_amount_cny"] >= 0, F.lit(True))
        fine = F.coalesce(values & counts & ordered & (F.unix_micros(p["source_timestamp"]) <= limit), F.lit(False))
        return F.when(p["bad_text"], "INVALID_SOURCE_NUMBER").when(~fine, "INVALID_AUCTION_POINT")

    market = F.when(F.col("symbol").startswith("sh"), 1).otherwise(0)
    df = df.withColumn("reason", F.coalesce(
        F.when((F.col("_doc.rc") != 0) | F.col("_doc.rc").isNull() | (d["code"] != F.substring("symbol", 3, 6))
               | d["code"].isNull() | d["trends"].isNull(), "AUCTION_OBSERVATIONS_UNAVAILABLE")
        .when(d["market"] != market, "AUCTION_MARKET_MISMATCH"),
        first_code(F.transform(pts, code))))
    good, bad = split_valid(df.drop("_doc"))
    keep = [c for c in good.columns if c != "_pts"]
    out = good.select(*keep, F.inline("_pts")).drop("bad_text")
    out = out.withColumn("session_date", shanghai_date(F.col("source_timestamp")))
    return out.withColumns({c: F.lit(None).cast("double") for c in ALWAYS_NULL}), bad.drop("_pts")
