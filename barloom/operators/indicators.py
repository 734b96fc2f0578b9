"""Window indicators over bars.

Every frame is a ROWS frame over one series. `keys` defaults to the series
key; for series of unbounded length pass the block key as well (see blocks).
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import SERIES

OHLC = ("open", "high", "low", "close")


class Series:
    """Window frames of one ordered series."""

    def __init__(self, keys=SERIES, order="date"):
        self.window = Window.partitionBy(*keys).orderBy(order)

    def rows(self, first: int, last: int):
        return self.window.rowsBetween(first, last)

    def lag(self, c: Column, n: int) -> Column:
        return F.lag(c, n).over(self.window) if n else c

    # -- operands -----------------------------------------------------------
    def mean(self, c: Column, n: int, back: int = 0) -> Column:
        """Mean of n rows ending `back` rows ago; NULL with fewer rows."""
        frame = self.rows(-(n - 1) - back, -back)
        return F.when(F.count(c).over(frame) == n, F.avg(c).over(frame))

    def highest(self, c: Column, n: int, back: int = 1) -> Column:
        """Largest of n rows, the current one excluded by default."""
        frame = self.rows(-(n - 1) - back, -back)
        return F.when(F.count(c).over(frame) == n, F.max(c).over(frame))

    def change_pct(self, c: Column, n: int) -> Column:
        return (c / self.lag(c, n) - 1) * 100

    def ratio(self, c: Column, n: int) -> Column:
        """Value over the mean of the n preceding rows; NULL on a zero baseline."""
        base = self.mean(c, n, back=1)
        return c / F.nullif(base, F.lit(0.0))


def _series(keys, order):
    return Series(SERIES if keys is None else keys, order)


def moving_average(bars, field="close", n=20, name=None, keys=None, order="date") -> DataFrame:
    s = _series(keys, order)
    return bars.withColumn(name or f"ma_{field}_{n}", s.mean(F.col(field), n))


def volume_ma(bars, n=20, name=None, keys=None, order="date") -> DataFrame:
    return moving_average(bars, "volume_shares", n, name or f"volume_ma_{n}", keys, order)


def change_pct(bars, n=5, name=None, keys=None, order="date") -> DataFrame:
    s = _series(keys, order)
    return bars.withColumn(name or f"change_pct_{n}", s.change_pct(F.col("close"), n))


def prior_high(bars, n=20, name=None, keys=None, order="date") -> DataFrame:
    s = _series(keys, order)
    return bars.withColumn(name or f"prior_high_{n}", s.highest(F.col("high"), n))


def volume_ratio(bars, n=20, name=None, keys=None, order="date") -> DataFrame:
    s = _series(keys, order)
    return bars.withColumn(name or f"volume_ratio_{n}", s.ratio(F.col("volume_shares"), n))


def slope(bars, field="close", n=20, lag=5, keys=None, order="date") -> DataFrame:
    """MA against its own value `lag` rows ago: rising flag and % change."""
    s = _series(keys, order)
    now, then = s.mean(F.col(field), n), s.mean(F.col(field), n, back=lag)
    return bars.withColumn(f"ma{n}_rising", now > then).withColumn(
        f"ma{n}_change_{lag}_pct", 100 * (now / then - 1)
    )


def cross(bars, left, right, direction="above", name=None, keys=None, order="date") -> DataFrame:
    """Crossing of two operand columns between the previous row and this one."""
    s = _series(keys, order)
    l1, r1 = F.col(left), F.col(right)
    l0, r0 = s.lag(l1, 1), s.lag(r1, 1)
    hit = ((l0 <= r0) & (l1 > r1)) if direction == "above" else ((l0 >= r0) & (l1 < r1))
    return bars.withColumn(name or f"cross_{direction}", hit)


def shift(bars, field, offset, name=None, keys=None, order="date") -> DataFrame:
    s = _series(keys, order)
    return bars.withColumn(name or f"{field}_back_{offset}", s.lag(F.col(field), offset))


def extension(bars, n=20, keys=None, order="date") -> DataFrame:
    """Close relative to its MA, in percent."""
    s = _series(keys, order)
    return bars.withColumn(f"extension_ma{n}_pct", 100 * (F.col("close") / s.mean(F.col("close"), n) - 1))


def breakout_kind(bars, n=20, keys=None, order="date") -> DataFrame:
    """fresh / repeated when this close tops the prior-n high; else NULL."""
    s = _series(keys, order)
    close, high = F.col("close"), F.col("high")
    today = close > s.highest(high, n)
    yesterday = s.lag(close, 1) > s.highest(high, n, back=2)
    return bars.withColumn(
        "breakout_kind", F.when(today, F.when(yesterday, "repeated").otherwise("fresh"))
    )


def last_n(df, n, keys=SERIES, order="date") -> DataFrame:
    """Latest n rows per key. Spark trims groups to n rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def ma_panel(bars, windows=(5, 10, 20), limit=120, keys=SERIES, order="date") -> DataFrame:
    """Chart panel: several MAs, computed before the last-n cut (warm-up)."""
    s = Series(keys, order)
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    out = bars.select("*", *[s.mean(F.col("close"), n).alias(f"ma{n}") for n in windows])
    return out.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= limit).drop("_rn")


def quote_change(df, price="price", previous="previous_close") -> DataFrame:
    p, q = F.col(price), F.col(previous)
    return df.withColumn("change", p - q).withColumn("change_percent", F.when(q > 0, (p - q) / q * 100))
