"""Clock arithmetic at a fixed +08:00 offset, independent of the session zone."""

from pyspark.sql import Column, functions as F

_OFFSET_US = 8 * 3600 * 1_000_000
_DAY_US = 86_400 * 1_000_000


def _local_us(ts: Column) -> Column:
    return F.unix_micros(ts) + F.lit(_OFFSET_US)


def shanghai_date(ts: Column) -> Column:
    """Calendar day of an instant at +08:00."""
    return F.date_from_unix_date(F.floor(_local_us(ts) / F.lit(_DAY_US)).cast("int"))


def shanghai_minute(ts: Column) -> Column:
    """Minute of the +08:00 day, 0..1439."""
    return F.floor(F.pmod(_local_us(ts), F.lit(_DAY_US)) / F.lit(60_000_000)).cast("int")


def shanghai_text(ts: Column) -> Column:
    """ISO text with an explicit +08:00 suffix, to the second."""
    second = F.floor(F.pmod(_local_us(ts), F.lit(_DAY_US)) / F.lit(1_000_000)).cast("int")
    clock = F.format_string(
        "T%02d:%02d:%02d+08:00",
        F.floor(second / 3600).cast("int"),
        F.floor((second % 3600) / 60).cast("int"),
        (second % 60).cast("int"),
    )
    return F.concat(shanghai_date(ts).cast("string"), clock)


def instant_at(date: Column, seconds_of_day) -> Column:
    """Instant of a +08:00 wall-clock second on a date."""
    seconds = seconds_of_day if isinstance(seconds_of_day, Column) else F.lit(seconds_of_day)
    epoch = F.unix_date(date).cast("long") * F.lit(86_400) + seconds.cast("long") - F.lit(8 * 3600)
    return F.timestamp_seconds(epoch)


def strict_date(c: Column) -> Column:
    """`yyyy-MM-dd` or `yyyyMMdd` text to a date; NULL when it does not round-trip."""
    shaped = c.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{8})$")
    return F.when(shaped, F.try_to_date(F.replace(c, F.lit("-"), F.lit("")), "yyyyMMdd"))


def parse_stamp(c: Column) -> Column:
    """14-digit, spaced or T-separated provider clock text to an instant at +08:00."""
    shaped = c.rlike(r"^(\d{14}|\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?(\+08:00)?)$")
    digits = F.regexp_replace(c, r"\+08:00$|[^0-9]", "")
    whole = F.concat(F.rpad(digits, 14, "0"), F.lit("+0800"))
    return F.when(shaped, F.try_to_timestamp(whole, F.lit("yyyyMMddHHmmssxx")))


def period_start(date: Column, interval: str) -> Column:
    """First day of the day / ISO week / month holding a date."""
    if interval == "1d":
        return date
    if interval == "1w":
        return F.date_sub(date, F.weekday(date))
    if interval == "1mo":
        return F.trunc(date, "month")
    raise ValueError(f"no period bounds for interval {interval!r}")


def period_end(date: Column, interval: str) -> Column:
    """Last day of the day / ISO week / month holding a date."""
    if interval == "1d":
        return date
    if interval == "1w":
        return F.date_add(period_start(date, "1w"), 6)
    if interval == "1mo":
        return F.last_day(date)
    raise ValueError(f"no period bounds for interval {interval!r}")
