import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barloom.operators import blocks, indicators as I, intraday as N, macd as M

HEAD = ("sh600000", "tencent", "1d", "none")


def bars(spark, closes, volumes=None):
    start = dt.date(2026, 1, 5)
    volumes = volumes or [100.0] * len(closes)
    rows = [(*HEAD, start + dt.timedelta(i), float(c), c + 1.0, c - 1.0, float(c), float(v)) for i, (c, v) in enumerate(zip(closes, volumes))]
    return spark.createDataFrame(rows, "symbol string, source string, interval string, adjustment string, date date, open double, high double, low double, close double, volume_shares double")


def last(df):
    return df.orderBy(F.col("date").desc()).first()


def test_hand_computed_values(spark):
    b = bars(spark, [10, 12, 14], [100, 200, 600])
    assert last(I.moving_average(b, n=2)).ma_close_2 == 13
    assert last(I.volume_ma(b, 2)).volume_ma_2 == 400
    assert last(I.change_pct(b, 2)).change_pct_2 == pytest.approx(40)
    assert last(I.prior_high(b, 2)).prior_high_2 == 13
    assert last(I.volume_ratio(b, 2)).volume_ratio_2 == 4
    assert last(I.moving_average(b, n=4)).ma_close_4 is None


def test_zero_baseline_is_null(spark):
    assert last(I.volume_ratio(bars(spark, [1, 2, 3], [0, 0, 5]), 2)).volume_ratio_2 is None


def test_cross_needs_both_sides(spark):
    def crossed(closes):
        b = bars(spark, closes).withColumn("level", F.lit(10.0))
        return last(I.cross(b, "close", "level")).cross_above
    assert crossed([9, 10, 11]) is True
    assert crossed([9, 9, 10]) is False
    assert crossed([11]) is None


def recurrence(closes):
    fast = slow = closes[0]
    dea, out = 0.0, []
    for i, c in enumerate(closes):
        if i:
            fast += 2 / 13 * (c - fast)
            slow += 2 / 27 * (c - slow)
        dif = fast - slow
        if i:
            dea += 2 / 10 * (dif - dea)
        out.append((dif, dea))
    return out


def test_macd_equals_the_recurrence_over_several_blocks(spark):
    closes = [100 + 10 * math.sin(i / 7) + (i % 13) for i in range(1700)]
    b = bars(spark, closes)
    want = recurrence(closes)
    got = [(r.dif, r.dea) for r in M.macd(b).orderBy("date").collect()]
    for (a, b_), (c, d) in zip(got, want):
        assert a == pytest.approx(c, abs=1e-9) and b_ == pytest.approx(d, abs=1e-9)
    indexed = blocks.with_row_index(b, ["symbol"], ["date"], F.year("date"))
    long = [(r.dif, r.dea) for r in M.macd_long(indexed, keys=["symbol"]).orderBy("date").collect()]
    assert len(long) == 1700
    for (a, b_), (c, d) in zip(long, want):
        assert a == pytest.approx(c, abs=1e-9) and b_ == pytest.approx(d, abs=1e-9)


def test_constant_series_has_zero_macd(spark):
    for r in M.macd(bars(spark, [50] * 300)).collect():
        assert abs(r.dif) < 1e-12 and abs(r.macd_histogram) < 1e-12


def test_panel_warmup(spark):
    r = last(M.macd_panel(bars(spark, range(100, 400)), limit=120))
    assert r.warmup_bars == 180 and r.seed_sensitive is True


def test_row_index_and_halo_match_plain_windows(spark):
    # One key holds almost everything.
    rows = [("hot" if i % 50 else f"cold{i % 3}", i, float((i * 37) % 101)) for i in range(3000)]
    df = spark.createDataFrame(rows, "symbol string, n long, close double")
    plain = I.moving_average(df, "close", 20, "ma", ["symbol"], "n").select("symbol", "n", "ma")
    indexed = blocks.with_row_index(df, ["symbol"], ["n"], F.floor(F.col("n") / 100))
    cut = blocks.with_halo(indexed, reach=19, block=64)
    blocked = I.moving_average(cut, "close", 20, "ma", ["symbol", "block_id"], "row_index").filter("NOT is_halo").select("symbol", "n", "ma")
    assert blocked.count() == 3000
    assert plain.exceptAll(blocked).count() == 0
    biggest = cut.groupBy("symbol", "block_id").count().agg(F.max("count")).first()[0]
    assert biggest <= 64 + 19


def test_previous_value_across_buckets(spark):
    df = spark.createDataFrame([("a", i, i * i) for i in range(50)], "k string, n long, v long")
    out = blocks.with_previous_value(df, ["k"], "n", "v", F.floor(F.col("n") / 7), "p")
    assert {r.n: r.p for r in out.collect()} == {i: (None if i == 0 else (i - 1) ** 2) for i in range(50)}


def test_gap_kinds(spark):
    labels = ["2026-09-29T14:59:00", "2026-09-30T11:29:00", "2026-09-30T11:30:00", "2026-09-30T13:01:00", "2026-09-30T13:04:00"]
    df = spark.createDataFrame([("x", t + "+08:00") for t in labels], "symbol string, t string")
    df = df.withColumn("source_timestamp", F.col("t").cast("timestamp"))
    got = [(r.kind, r.missing_minutes) for r in N.gap_audit(df, 1, ["symbol"]).orderBy("gap_from").collect()]
    assert got == [("session_boundary", None), ("scheduled_lunch", None), ("unexplained_gap", 2.0)]


def test_counter_reset_gives_null(spark):
    rows = [("x", dt.date(2026, 9, 30), f"2026-09-30T09:3{i}:00+08:00", v, a) for i, (v, a) in enumerate([(100, 10.0), (250, 30.0), (50, 40.0)])]
    df = spark.createDataFrame(rows, "symbol string, session_date date, t string, cumulative_volume_shares long, cumulative_amount_cny double")
    out = N.with_interval_differences(df.withColumn("source_timestamp", F.col("t").cast("timestamp"))).orderBy("t").collect()
    assert [r.interval_volume_shares for r in out] == [None, 150, None]
    assert [r.interval_amount_cny for r in out] == [None, 20.0, 10.0]
