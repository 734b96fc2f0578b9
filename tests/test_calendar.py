import datetime as dt

from pyspark.sql import functions as F

from barloom.operators import calendar as C, market_clock as M


def ts(text):
    return F.lit(text).cast("timestamp")


def days(spark, *texts):
    return spark.createDataFrame([(dt.date.fromisoformat(t),) for t in texts], "date date")


def test_trading_days_of_the_announced_year(dim):
    assert dim.count() == 365
    assert dim.filter("is_trading").count() == 242
    closed = {r.date.isoformat() for r in dim.filter("NOT is_trading AND weekday(date) < 5").collect()}
    assert {"2026-01-01", "2026-02-16", "2026-10-01", "2026-09-25"} <= closed


def test_boundary_is_strict(spark, dim):
    at = C.with_bar_completion(days(spark, "2026-09-30"), dim, ts("2026-09-30T15:30:03+08:00"), "1d").first()
    after = C.with_bar_completion(days(spark, "2026-09-30"), dim, ts("2026-09-30T15:30:03.001+08:00"), "1d").first()
    assert (at.complete, at.calendar_completion) == (False, False)
    assert (after.complete, after.calendar_completion, after.observed_latest) == (True, True, True)


def test_three_states(spark, dim):
    rows = {r.date.isoformat(): r for r in C.with_bar_completion(
        days(spark, "2026-10-01", "2025-12-31", "2026-09-30"), dim, ts("2026-10-09T12:00:00+08:00"), "1d").collect()}
    holiday, outside, known = rows["2026-10-01"], rows["2025-12-31"], rows["2026-09-30"]
    assert (holiday.complete, holiday.calendar_completion, holiday.completion_basis) == (False, None, C.INVALID_DAY)
    assert (outside.complete, outside.calendar_completion, outside.completion_basis) == (True, None, C.ELAPSED)
    assert (known.complete, known.calendar_completion, known.completion_basis) == (True, True, C.VERIFIED)


def test_week_and_month_wait_for_their_last_session(spark, dim):
    week = C.with_bar_completion(days(spark, "2026-09-28"), dim, ts("2026-09-30T16:00:00+08:00"), "1w").first()
    assert week.calendar_completion and week.period_end_session == dt.date(2026, 9, 30)
    month = C.with_bar_completion(days(spark, "2026-10-08"), dim, ts("2026-10-12T16:00:00+08:00"), "1mo").first()
    assert month.calendar_completion is False
    edge = C.with_bar_completion(days(spark, "2026-01-02"), dim, ts("2026-03-01T00:00:00+08:00"), "1w").first()
    assert edge.calendar_completion is None and edge.complete is True


def test_phases_and_expected_times(spark, dim):
    cases = {
        "2026-09-30T09:14:59": ("pre_open", "2026-09-29T07:00:00"),
        "2026-09-30T09:15:00": ("opening_auction", "2026-09-29T07:00:00"),
        "2026-09-30T09:25:00": ("opening_auction_gap", "2026-09-30T01:25:00"),
        "2026-09-30T11:30:00": ("lunch_break", "2026-09-30T03:30:00"),
        "2026-09-30T14:57:00": ("closing_auction", "2026-09-30T06:57:00"),
        "2026-09-30T15:00:00": ("after_close", "2026-09-30T07:00:00"),
        "2026-10-03T12:00:00": ("closed", "2026-09-30T07:00:00"),
        "2027-01-04T12:00:00": ("unknown", None),
    }
    df = spark.createDataFrame([(k, k + "+08:00") for k in cases], "k string, t string").withColumn("as_of", F.col("t").cast("timestamp"))
    for r in M.with_market_phase(df, dim).collect():
        expected = r.expected_source_timestamp.isoformat() if r.expected_source_timestamp else None
        assert (r.market_phase, expected) == cases[r.k], r.k


def test_quote_freshness_order(spark, dim):
    rows = [("2026-09-30T10:00:00+08:00", "2026-09-30T10:00:06+08:00", "future_timestamp"),
            ("2026-09-30T10:00:00+08:00", "2026-09-30T09:58:30+08:00", "recent"),
            ("2026-09-30T10:00:00+08:00", "2026-09-30T09:58:29+08:00", "stale"),
            ("2026-09-30T20:00:00+08:00", "2026-09-30T14:59:59+08:00", "latest_session"),
            ("2027-02-01T10:00:00+08:00", "2027-02-01T10:00:00+08:00", "unknown")]
    df = spark.createDataFrame(rows, "n string, s string, want string")
    df = df.withColumn("as_of", F.col("n").cast("timestamp")).withColumn("source_timestamp", F.col("s").cast("timestamp"))
    for r in M.with_freshness(df, dim).collect():
        assert r.freshness_status == r.want


def test_other_versions_and_closed_rows(spark):
    cal = C.build_calendar(spark, "v", "2024-01-01", "2024-01-31", [("2024-01-08", "2024-01-09")], open_weekdays=(0,))
    open_days = [r.date.day for r in cal.filter("is_trading").orderBy("date").collect()]
    assert open_days == [1, 15, 22, 29]


def test_versions_side_by_side(spark):
    spans = {"mondays": (0,), "weekdays": (0, 1, 2, 3, 4)}
    both = [C.calendar_dimension(C.build_calendar(spark, v, "2024-01-01", "2024-01-31", open_weekdays=w)) for v, w in spans.items()]
    bars = days(spark, "2024-01-08", "2024-01-09").crossJoin(spark.createDataFrame([("mondays",), ("weekdays",), ("unknown",), (None,)], "v string"))
    out = C.with_bar_completion(bars, both[0].unionByName(both[1]), ts("2024-01-12T12:00:00+08:00"), "1d", version="v")
    assert out.columns[:2] == ["date", "v"]
    got = {(r.v, r.date.day): (r.complete, r.calendar_completion, r.completion_basis, r.observed_latest) for r in out.collect()}
    assert len(got) == 8
    for v, dim in zip(spans, both):
        alone = C.with_bar_completion(days(spark, "2024-01-08", "2024-01-09"), dim, ts("2024-01-12T12:00:00+08:00"), "1d").collect()
        assert {k[1]: x for k, x in got.items() if k[0] == v} == {r.date.day: (r.complete, r.calendar_completion, r.completion_basis, r.observed_latest) for r in alone}
    assert got["mondays", 9][2] == C.INVALID_DAY and got["mondays", 8][3] is True
    assert got["unknown", 8] == got[None, 9] == (True, None, C.ELAPSED, None)


def test_closed_ranges_of_their_version(spark):
    d = dt.date
    ranges = spark.createDataFrame([("a", d(2024, 1, 1), d(2024, 1, 3)), ("a", d(2024, 1, 2), d(2024, 1, 4)), ("b", d(2024, 1, 9), d(2024, 1, 9))],
                                   "calendar_version string, first_date date, last_date date")
    rows = days(spark, "2024-01-02", "2024-01-09").crossJoin(spark.createDataFrame([("a",), ("b",), (None,)], "v string"))
    out = C.mark_closed_rows(rows, ranges, version="v")
    assert sorted((r.v, r.date.day) for r in out.collect() if r.in_closed_range) == [("a", 2), ("b", 9)] and out.count() == 6
