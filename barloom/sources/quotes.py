"""Quote and benchmark captures."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import parse_stamp
from ..functions.numbers import finite, strict_number
from ..functions.symbols import lot_factor
from .captures import quoted_fields, split_valid

# The six index benchmarks.
BENCHMARKS = ("sh000001", "sz399001", "sz399006", "sh000300", "sh000905", "sh000852")
# Field positions of the two quote layouts.
TILDE = {"name": 1, "code": 2, "price": 3, "previous_close": 4, "open": 5, "volume": 6, "stamp": 30,
         "high": 33, "low": 34, "detail": 35, "amount_10k": 37, "limit_up": 47, "limit_down": 48}
COMMA = {"name": 0, "open": 1, "previous_close": 2, "price": 3, "high": 4, "low": 5, "volume": 8, "amount": 9}
NUMBERS = ("price", "previous_close", "open", "high", "low", "volume_shares", "amount_cny")
FUTURE_SECONDS = 5


def _book(fields: Column, source: str, bid: tuple, ask: tuple, factor: float) -> Column:
    """Five levels a side; each side is (first price field, first volume field)."""
    def side(price_at, volume_at):
        return F.transform(
            F.sequence(F.lit(0), F.lit(4)),
            lambda i: F.struct(
                strict_number(F.get(fields, i * 2 + price_at)).alias("price"),
                (strict_number(F.get(fields, i * 2 + volume_at)) * factor).alias("volume_shares"),
            ),
        )
    return F.struct(F.lit(source).alias("source"), side(*bid).alias("bids"), side(*ask).alias("asks"))


def price_limits(df: DataFrame) -> DataFrame:
    """Limit prices and the price's relation to them, where the fields agree.

    Adds limit_up_price, limit_down_price, price_relation; all NULL when the
    provider limits are absent, inconsistent or not whole cents.
    """
    up, down, price = F.col("_up"), F.col("_down"), F.col("price")
    cents = lambda c: F.floor(c * 100 + 0.5)
    whole = lambda c: F.abs(c * 100 - cents(c)) <= 1e-6
    usable = (
        ~F.col("symbol").startswith("bj") & (up > 0) & (down > 0) & (up > down) & (price <= up) & (price >= down)
        & (F.col("high") <= up) & ~((F.col("low") > 0) & (F.col("low") < down))
        & whole(up) & whole(down) & whole(price)
    )
    relation = (
        F.when(cents(price) == cents(up), "at_upper_limit")
        .when(cents(price) == cents(down), "at_lower_limit")
        .otherwise("between_limits")
    )
    return df.withColumns({
        "limit_up_price": F.when(usable, up), "limit_down_price": F.when(usable, down),
        "price_relation": F.when(usable, relation),
    }).drop("_up", "_down")


def quote_reason(include_book: bool = True, received: str = "fetched_at") -> Column:
    """First reason a decoded quote is unusable; NULL for a valid one."""
    c = F.col
    bad_number = F.lit(False)
    for name in NUMBERS:
        bad_number = bad_number | ~finite(c(name)) | (c(name) < 0)
    price, high, low, open_ = c("price"), c("high"), c("low"), c("open")
    range_bad = (
        (price <= 0) | (c("previous_close") <= 0) | (high < low)
        | ((high > 0) & ((price > high) | ((open_ > 0) & (open_ > high))))
        | ((low > 0) & ((price < low) | ((open_ > 0) & (open_ < low))))
    )
    late = F.unix_micros(c("source_timestamp")) > F.unix_micros(c(received)) + FUTURE_SECONDS * 1_000_000
    reason = (
        F.when(c("name").isNull() | (F.trim("name") == "") | (c("currency") != "CNY"), "INVALID_QUOTE_SCHEMA_OR_UNITS")
        .when(c("source_timestamp").isNull(), "INVALID_SOURCE_TIMESTAMP")
        .when(late, "FUTURE_SOURCE_TIMESTAMP")
        .when(bad_number, "INVALID_QUOTE_VALUES")
        .when(range_bad, "INVALID_QUOTE_OHLC")
    )
    if include_book:
        level_ok = lambda l: finite(l["price"]) & (l["price"] >= 0) & finite(l["volume_shares"]) & (l["volume_shares"] >= 0)
        for side in ("bids", "asks"):
            levels = c(f"book.{side}")
            reason = reason.when(F.size(levels) != 5, "INVALID_BOOK_SCHEMA").when(~F.forall(levels, level_ok), "INVALID_BOOK_VALUES")
    return reason


def decode_quotes(raw: DataFrame, provider: str, include_book: bool = True):
    """Decode quote captures of one provider into (valid, quarantine)."""
    df = decode_quote_columns(raw, provider, include_book)
    return split_valid(df)


def decode_quote_columns(raw: DataFrame, provider: str, include_book: bool = True) -> DataFrame:
    """Quote columns plus `reason`; no row is dropped."""
    symbol = F.col("symbol")
    tilde = provider == "tencent"
    layout = TILDE if tilde else COMMA
    prefix, sep, least = ("v_", "~", 38) if tilde else ("hq_str_", ",", 32)
    df = raw.withColumn("_f", quoted_fields(F.col("body"), symbol, prefix, sep))
    f = F.col("_f")
    text = lambda key: F.get(f, F.lit(layout[key]))
    number = lambda key: strict_number(text(key))
    if tilde:
        detail = F.split(text("detail"), "/", -1)
        factor = lot_factor(symbol)
        amount = F.when(F.size(detail) == 3, strict_number(F.get(detail, F.lit(2)))).otherwise(number("amount_10k") * 10000)
        stamp, book = text("stamp"), _book(f, "tencent", (9, 10), (19, 20), 100.0)
        volume, up, down = number("volume") * factor, number("limit_up"), number("limit_down")
        malformed = (F.size(f) < least) | (text("code") != F.substring(symbol, 3, 6)) | ~(number("price") > 0)
        unit_unknown = factor.isNull()
    else:
        amount = number("amount")
        stamp = F.concat_ws(" ", F.get(f, F.lit(30)), F.get(f, F.lit(31)))
        book, volume = _book(f, "sina", (11, 10), (21, 20), 1.0), number("volume")
        up = down = F.lit(None).cast("double")
        malformed = (F.size(f) < least) | ~(number("price") > 0)
        unit_unknown = F.lit(False)
    columns = {
        "name": text("name"), "source": F.lit(provider), "source_timestamp": parse_stamp(stamp),
        "price": number("price"), "previous_close": number("previous_close"), "open": number("open"),
        "high": number("high"), "low": number("low"), "volume_shares": volume, "amount_cny": amount,
        "currency": F.lit("CNY"), "_up": up, "_down": down,
    }
    if include_book:
        columns["book"] = book
    df = df.withColumns(columns)
    df = price_limits(df)
    reason = (
        F.when(f.isNull(), "SYMBOL_NOT_RETURNED")
        .when(F.coalesce(malformed, F.lit(True)), f"INVALID_{provider.upper()}_QUOTE")
        .when(unit_unknown, "TENCENT_VOLUME_UNIT_UNVERIFIED_FOR_CDR")
        .otherwise(quote_reason(include_book))
    )
    return df.withColumn("reason", reason).drop("_f", "body")


def decode_benchmarks(raw: DataFrame) -> DataFrame:
    """Index benchmarks with change and % change; failures keep an `error`."""
    df = raw.withColumn("_f", quoted_fields(F.col("body"), F.col("symbol"), "v_", "~"))
    f = F.col("_f")
    text = lambda key: F.get(f, F.lit(TILDE[key]))
    number = lambda key: strict_number(text(key))
    price, previous, open_, high, low = (number(k) for k in ("price", "previous_close", "open", "high", "low"))
    stamp = F.when(text("stamp").rlike(r"^\d{14}$"), parse_stamp(text("stamp")))
    positive = F.lit(True)
    for c in (price, previous, open_, high, low):
        positive = positive & F.coalesce(c > 0, F.lit(False))
    late = F.unix_micros(stamp) > F.unix_micros("fetched_at") + FUTURE_SECONDS * 1_000_000
    inside = (low <= high) & (price >= low) & (price <= high) & (open_ >= low) & (open_ <= high)
    error = (
        F.when(~F.col("symbol").isin(*BENCHMARKS), "INVALID_BENCHMARK")
        .when(f.isNull() | (F.size(f) < 35) | (text("code") != F.substring("symbol", 3, 6)) | (text("name") == ""), "BENCHMARK_NOT_RETURNED")
        .when(stamp.isNull() | late, "INVALID_BENCHMARK_TIMESTAMP")
        .when(~positive, "INVALID_BENCHMARK_NUMBER")
        .when(~inside, "INVALID_BENCHMARK_RANGE")
    )
    out = {
        "error": error, "name": text("name"), "source_timestamp": stamp, "index_points": price,
        "previous_close_points": previous, "open_points": open_, "high_points": high, "low_points": low,
    }
    df = df.withColumns(out)
    ok = F.col("error").isNull()
    keep = [F.when(ok, F.col(k)).alias(k) for k in out if k != "error"]
    change = F.col("index_points") - F.col("previous_close_points")
    pct = (F.col("index_points") / F.col("previous_close_points") - 1) * 100
    return df.select(
        "symbol", "fetched_at", "error", *keep,
        F.when(ok, change).alias("change_points"), F.when(ok, pct).alias("change_percent"),
    )
