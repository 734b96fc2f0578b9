"""Security-code syntax: normalization, support and board tests."""

from pyspark.sql import Column, functions as F

# Code syntax accepted for market data.
SUPPORTED = r"^(sh(600|601|603|605|688|689)\d{3}|sz(000|001|002|003|004|300|301)\d{3}|bj[489]\d{5})$"
# Code syntax accepted for dataset pools.
DATASET_POOL = r"^(sh(600|601|603|605)\d{3}|sz(000|001|002|003|004)\d{3})$"
# Code syntax accepted by the condition screen.
SCREEN_SH = r"(?i)^sh(600|601|603|605)\d{3}$"
SCREEN_SZ = r"(?i)^sz(000|001|002|003)\d{3}$"
# Fixed value: display-name marker rejected by the condition screen.
SCREEN_NAME = r"(?i)(\*?ST|退)"


def supported_symbol(symbol: Column) -> Column:
    return symbol.rlike(SUPPORTED)


def normalize_symbol(raw: Column) -> Column:
    """Free-form code text to `<exchange><6 digits>`; NULL when unsupported."""
    text = F.lower(F.trim(raw))
    dotted = F.regexp_replace(text, r"^(\d{6})\.(sh|sz|bj)$", "$2$1")
    exchange = (
        F.when(dotted.startswith("6"), "sh")
        .when(dotted.rlike("^[489]"), "bj")
        .otherwise("sz")
    )
    full = F.when(dotted.rlike(r"^\d{6}$"), F.concat(exchange, dotted)).otherwise(dotted)
    return F.when(supported_symbol(full), full)


def lot_factor(symbol: Column) -> Column:
    """Shares per reported volume unit; NULL where the unit is unverified."""
    return (
        F.when(symbol.startswith("sh689"), F.lit(None).cast("double"))
        .when(symbol.startswith("sh688"), F.lit(1.0))
        .otherwise(F.lit(100.0))
    )


def is_screen_mainboard(symbol: Column, exchange: Column, board: Column) -> Column:
    """Condition-screen board test; the 001001..001199 range stays in."""
    code = F.when(exchange == "SH", symbol.rlike(SCREEN_SH)).otherwise(symbol.rlike(SCREEN_SZ))
    return (board == "mainboard") & code


def excluded_name(name: Column) -> Column:
    """Condition-screen name test: the marker anywhere in the name."""
    return name.rlike(SCREEN_NAME)


def dataset_symbol(symbol: Column) -> Column:
    """Dataset-pool code test."""
    number = F.substring(symbol, 3, 6).try_cast("int")
    depositary = symbol.startswith("sz") & number.between(1001, 1199)
    return symbol.rlike(DATASET_POOL) & (symbol != "sz000000") & ~depositary


def ticker_parts(symbol: Column) -> Column:
    """Struct of market, ticker and `ticker.market` code."""
    market = F.upper(F.substring(symbol, 1, 2))
    ticker = F.substring(symbol, 3, 6)
    return F.struct(
        market.alias("market"), ticker.alias("ticker"), F.concat_ws(".", ticker, market).alias("thscode")
    )
