"""MACD as affine maps over blocks.

The two averages and their signal are linear recurrences: n rows turn an entry
state (fast, slow, dea) into

    fast * a^n + F,  slow * b^n + S,  dea * g^n + fast * f(n) - slow * s(n) + D

where F, S and D are weighted sums of the closes. Such maps compose, so a
block of rows is one map, the state before a block is the composition of the
maps before it (an associative prefix scan over block rows), and every row
needs its block's entry state and running sums inside the block only. A
series enters with (first close, first close, 0).
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import SERIES
from .blocks import join_on

BLOCK = 512
PERIODS = (12, 26, 9)
FAST, SLOW, SIGNAL = (2.0 / (p + 1) for p in PERIODS)
KEEP = 1.0 - SIGNAL


def _power(base: float, n: Column) -> Column:
    return F.pow(F.lit(base), n)


def _leak(alpha: float, n: Column) -> Column:
    """What an entry value of the average with `alpha` adds to the signal after n rows."""
    p = 1.0 - alpha
    return F.lit(SIGNAL * p / (p - KEEP)) * (_power(p, n) - _power(KEEP, n))


def _entered(alpha: float, n: Column, entry: Column, own: Column) -> Column:
    return own + _power(1.0 - alpha, n) * entry


def _compose(n: Column, later, before):
    """The map of `before` and then n rows of `later`; maps are (F, S, D)."""
    f, s, d = before
    return (
        _entered(FAST, n, f, later[0]), _entered(SLOW, n, s, later[1]),
        later[2] + _power(KEEP, n) * d + _leak(FAST, n) * f - _leak(SLOW, n) * s)


def _running(value: Column, alpha: float, k: Column, frame) -> Column:
    """Weighted sum of a frame, scaled so that row k carries weight alpha."""
    return F.sum(F.lit(alpha) * value * _power(1.0 - alpha, -k)).over(frame) * _power(1.0 - alpha, k)


def _inside(df: DataFrame, k: Column, frame) -> DataFrame:
    """Running maps of a block, entered with zeros: _rf, _rs and _rd."""
    df = df.withColumns({"_rf": _running(F.col("close"), FAST, k, frame), "_rs": _running(F.col("close"), SLOW, k, frame)})
    return df.withColumn("_rd", _running(F.col("_rf") - F.col("_rs"), SIGNAL, k, frame))


def _results(df: DataFrame, k: Column) -> DataFrame:
    """dif, dea and macd_histogram from the running maps and the entry state _f, _s, _d."""
    f, s, d = _compose(k + 1, [F.col(c) for c in ("_rf", "_rs", "_rd")], [F.col(c) for c in ("_f", "_s", "_d")])
    df = df.withColumns({"dif": f - s, "dea": d})
    return df.withColumn("macd_histogram", 2 * (F.col("dif") - F.col("dea")))


#: Doublings of the scan. Five compose 32 full blocks, and a^n, b^n and g^n are
#: exactly zero in doubles long before that, so further ones would change nothing.
ROUNDS = 5


def _scanned(blocks: DataFrame, keys) -> DataFrame:
    """Entry state (_f, _s, _d) of every block from the blocks' own maps (_rf, _rs, _rd) and the first close."""
    order = Window.partitionBy(*keys).orderBy("_b")
    names = ("_rf", "_rs", "_rd")
    # The map of the block before, then of the two, four, ... blocks before.
    df = blocks.withColumns({f"_p{c}": F.lag(c).over(order) for c in names})
    for r in range(ROUNDS):
        far = {f"_q{c}": F.lag(f"_p{c}", 2**r).over(order) for c in names}
        df = df.withColumns(far)
        joined = _compose(F.lit(2**r * BLOCK), [F.col(f"_p{c}") for c in names], [F.coalesce(f"_q{c}", F.lit(0.0)) for c in names])
        df = df.withColumns({f"_p{c}": v for c, v in zip(names, joined, strict=True)})
    start = F.first("_x0").over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = _compose(F.col("_b") * BLOCK, [F.coalesce(f"_p{c}", F.lit(0.0)) for c in names], [start, start, F.lit(0.0)])
    return df.select(*keys, "_b", *[v.alias(c) for v, c in zip(before, ("_f", "_s", "_d"), strict=True)])


def macd_long(bars: DataFrame, index="row_index", keys=SERIES) -> DataFrame:
    """Add dif, dea and macd_histogram over series of any length, given a zero-based row index.

    Blocks of 512 rows are reduced to their maps by one hash aggregate with
    partial combine; the maps are scanned, one row a block, and joined back.
    Every row exists once, and no group holds more than a block of rows or a
    series' block rows.
    """
    keys = list(keys)
    i = F.col(index).cast("long")
    df = bars.withColumn("_b", F.floor(i / BLOCK)).withColumn("_k", i % BLOCK)
    back = BLOCK - 1 - F.col("_k")  # rows from here to a full block's end
    weight = {"_rf": F.lit(FAST) * _power(1 - FAST, back), "_rs": F.lit(SLOW) * _power(1 - SLOW, back)}
    weight["_rd"] = _signal_weight(FAST, back) - _signal_weight(SLOW, back)
    blocks = df.groupBy(*keys, "_b").agg(
        *[F.sum(w * F.col("close")).alias(c) for c, w in weight.items()], F.max(F.when(i == 0, F.col("close"))).alias("_x0"))
    entry = _scanned(blocks, keys)
    frame = Window.partitionBy(*keys, "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    return _results(join_on(_inside(df, F.col("_k"), frame), entry, [*keys, "_b"]), F.col("_k")).drop("_b", "_k", "_rf", "_rs", "_rd", "_f", "_s", "_d")


def _signal_weight(alpha: float, m: Column) -> Column:
    """Weight in the signal, m rows later, of a close that entered the average with `alpha`."""
    p = 1.0 - alpha
    return F.lit(SIGNAL * alpha / (KEEP - p)) * (_power(KEEP, m + 1) - _power(p, m + 1))


def macd(bars: DataFrame, keys=SERIES, order="date") -> DataFrame:
    """Add dif, dea and macd_histogram, one shuffle on the series key.

    Meant for day, week and month bars, whose count per series is bounded by
    the calendar. For minute bars of many sessions use macd_long.
    """
    keys = list(keys)
    series = Window.partitionBy(*keys)
    i = F.row_number().over(series.orderBy(order)) - 1
    df = bars.withColumn("_i", i.cast("long")).withColumn("_b", F.floor(F.col("_i") / BLOCK)).withColumn("_k", F.col("_i") % BLOCK)
    frame = Window.partitionBy(*keys, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    df = _inside(df, F.col("_k"), frame)
    start = F.first("close").over(series.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    names = ("_rf", "_rs", "_rd")
    at = lambda c, back: F.max(F.when(F.col("_k") == BLOCK - 1, F.col(c))).over(series.orderBy("_b").rangeBetween(-back, -back))
    # A series of the calendar's length has few blocks: four are composed, and what a fifth would add is below 1e-68.
    df = df.withColumns({f"_{n}{c}": at(c, n) for n in (1, 2, 3, 4) for c in names})
    before = [F.lit(0.0)] * 3
    for n in (4, 3, 2, 1):
        later = [F.coalesce(f"_{n}{c}", F.lit(0.0)) for c in names]
        before = _compose(F.lit(BLOCK), later, before)
    before = _compose(F.col("_b") * BLOCK, before, [start, start, F.lit(0.0)])
    df = df.withColumns(dict(zip(("_f", "_s", "_d"), before, strict=True)))
    drop = [f"_{n}{c}" for n in (1, 2, 3, 4) for c in names]
    return _results(df, F.col("_k")).drop("_i", "_b", "_k", *names, "_f", "_s", "_d", *drop)


def macd_panel(bars, limit=120, warmup=250, keys=SERIES, order="date") -> DataFrame:
    """Bounded panel: at most `limit + warmup` latest bars feed the averages.

    Adds `warmup_bars` and `seed_sensitive` (fewer than `warmup` earlier bars).
    """
    keys = list(keys)
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    want = limit + warmup
    recent = bars.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= want)
    warm = F.greatest(F.count("*").over(Window.partitionBy(*keys)) - limit, F.lit(0))
    recent = recent.withColumn("warmup_bars", warm).withColumn("seed_sensitive", warm < warmup)
    return macd(recent, keys, order).filter(F.col("_rn") <= limit).drop("_rn")
