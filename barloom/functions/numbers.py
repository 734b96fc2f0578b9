"""Numeric parsing that treats blank and non-finite input as an error."""

from pyspark.sql import Column, functions as F

# Decimal text: the cast alone would also take suffixes and names such as 1d or NaN.
_DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def finite(c: Column) -> Column:
    """True when a double is present and neither NaN nor infinite."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def strict_number(c: Column) -> Column:
    """Text to double; NULL for blank, malformed or non-finite text."""
    value = c.try_cast("double")
    return F.when(c.rlike(_DECIMAL_TEXT) & finite(value), value)


def age_seconds(now: Column, then: Column) -> Column:
    """Elapsed seconds between two instants, as a double."""
    return (F.unix_micros(now) - F.unix_micros(then)) / F.lit(1e6)
