"""Inputs that must be counted, refused or given their defaults rather than dropped."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.functions import strict_number
from barloom.operators import archive as A, calendar as C, datasets as DS
from barloom.plans import swing as S
from barloom.session import work_dir
from barloom.sources import directory as D, store as ST
from barloom.streaming import read_log

from test_swing import AS_OF, SCHEMA, history, sessions

BAR = ("symbol string, source string, interval string, adjustment string, date date, open double, high double, low double, "
       "close double, volume_shares double, amount_cny double")
RUN = {"run_id": "r", "target_session": "2026-09-30", "calendar_version": "v", "policy_version": "p"}


def bars(days, symbol="sh600000", source="tencent"):
    return [[symbol, source, "1d", "none", d, 1.0, 1.2, 0.9, 1.1, 5.0, None] for d in days]


def published(spark, dim, rows):
    header, good = DS.publish_dataset(spark.createDataFrame([tuple(r) for r in rows], BAR), dim, RUN, F.lit(AS_OF).cast("timestamp"))
    return {r.symbol: r for r in header.collect()}, good


def test_publication_refuses_undated_and_mixed_series_and_keeps_long_ones(spark, dim):
    days = sessions(dim, 170)
    rows = bars(days) + bars(days, "sh600001") + bars(days, "sh600002") + bars([*days, None], "sh600003")
    rows[len(days) + 3][1] = "sina"
    rows[2 * len(days)][3] = "other"
    got, _ = published(spark, dim, rows)
    assert (got["sh600000"].status, got["sh600000"].returned) == ("ready", len(days))
    assert got["sh600001"].error_code == "INVALID_SERIES_BASIS"
    assert got["sh600003"].error_code == "INVALID_SERIES_DATES"


def test_quality_sees_bars_without_a_date(spark):
    days = [dt.date(2026, 9, 1), dt.date(2026, 9, 2)]
    df = spark.createDataFrame([tuple(r) for r in bars([*days, None])], BAR)
    header = spark.createDataFrame([("sh600000", "1d", "none", 3, 0, days[0], days[1])],
                                   "symbol string, interval string, adjustment string, returned long, calendar_unverified_rows long, first_date date, last_date date")
    assert DS.dataset_quality(header, df).first().quality_error == "MALFORMED_BARS"


def test_swing_counts_every_row(spark, dim):
    days = sessions(dim)
    rows = history(days, [100.0] * 80)
    again = [r[:-1] + [100 + i] for i, r in enumerate([rows[0]] * 7)]
    future = [r[:3] + [dt.date(2026, 10, 9), dt.datetime(2026, 10, 9, 7)] + r[5:-1] + [200 + i] for i, r in enumerate([rows[0]] * 4)]
    df = spark.createDataFrame([tuple(r) for r in rows + again + future], SCHEMA)
    got = S.swing_screen(df, dim, F.lit(AS_OF).cast("timestamp")).first()
    assert (got.input_count, got.excluded_future, got.reason_code) == (91, 4, "DUPLICATE_HISTORY_DATE")


def test_absent_key_parts_take_their_defaults(spark):
    t = dt.datetime(2026, 9, 30, 8)
    rows = [("x", None, 1, t, "a"), ("x", "intraday", 2, t, "b"), (None, None, 3, t, "c"), (None, "intraday", 4, t, "c")]
    df = spark.createDataFrame(rows, "symbol string, interval string, arrival_no long, fetched_at timestamp, payload string")
    got = {(r.symbol, r.interval): (r.payload, r.revision_count) for r in A.archive_upsert(df, keys=["symbol", "interval"]).collect()}
    assert got == {("x", "intraday"): ("b", 1), (None, "intraday"): ("c", 0)}


def test_auction_points_must_rise(spark):
    day, at = dt.date(2026, 9, 30), lambda m: dt.datetime(2026, 9, 30, 1, m)
    captures = {"rising": [15, 20, 25], "falling": [20, 15], "equal": [15, 15], "absent": [15, None]}
    rows = [(k, day, None if m is None else at(m), at(30), i, at(25)) for k, ms in captures.items() for i, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "key string, session_date date, source_timestamp timestamp, fetched_at timestamp, position int, stamp timestamp")
    assert {r.key for r in A.valid_auction(df).filter("valid").collect()} == {"rising"}
    assert {r.key for r in A.valid_auction(df.withColumn("stamp", F.lit(at(26))), stamp="stamp").filter("valid").collect()} == set()


def test_a_run_written_again_replaces_itself(spark, tmp_path):
    key, path = "run_id string, symbol string, interval string, adjustment string", str(tmp_path / "store")
    ids = [("r1", "x", "1d", "none"), ("r2", "y", "1d", "none")]
    header = spark.createDataFrame([(*i, "ready") for i in ids], f"{key}, status string")
    bars = spark.createDataFrame([(*i, n) for i in ids for n in range(5)], f"{key}, n long")
    for _ in range(2):
        ST.write_dataset(header, bars, path, 4)
        ST.write_dataset(header.filter("run_id = 'r1'"), bars.filter("run_id = 'r1' AND n < 3"), path, 4)
    series, kept = ST.read_dataset_tables(spark, path, "r1")
    assert series.count() == 1 and sorted(r.n for r in kept.collect()) == [0, 1, 2]
    assert ST.read_dataset_tables(spark, path, "r2")[1].count() == 5
    ST.commit_attempts(header.withColumn("status", F.lit("failed_without_data")), bars.filter("n = 9"), path, 4)
    assert {r.status for r in ST.read_dataset_tables(spark, path, "r2")[0].collect()} == {"ready"}


def test_a_broken_log_is_no_empty_log(spark, tmp_path):
    assert read_log(spark, str(tmp_path / "none"), ["k"]) is None
    (tmp_path / "log" / "manifest-0").mkdir(parents=True)
    (tmp_path / "log" / "manifest-0" / "part-0.parquet").write_text("no table")
    with pytest.raises(Exception, match="part-0"):
        read_log(spark, str(tmp_path / "log"), ["k"])


def test_finite_numbers_of_any_length(spark):
    df = spark.createDataFrame([("1e100",), ("1" + "0" * 200,), ("1e400",), ("1d",), ("NaN",), ("",), (" 2.5 ",)], "t string")
    assert [r.v for r in df.select(strict_number(F.col("t")).alias("v")).collect()] == [1e100, 1e200, None, None, None, None, 2.5]


def test_one_faulty_row_refuses_its_list(spark):
    rows = [(1, "主板", "000001", "a", "1995-01-02"), (2, "主板", "000002", "b", "1995-02-30"), (2, "主板", "000003", "c", "1995-01-02"),
            (3, "主板", "000004", "d", "1995-01-02"), (3, "主板", "000004", "e", "1995-01-02"), (4, "主板", "000005", "f", "1995-01-02")]
    df = spark.createDataFrame(rows, "list int, `板块` string, `A股代码` string, `A股简称` string, `A股上市日期` string")
    counts = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 9)], "list int, recordcount int")
    good, bad = D.map_workbook_rows(df, counts, ["list"])
    assert [r.symbol for r in good.collect()] == ["sz000001"]
    assert {(r.list, r.reason) for r in bad.collect()} == {
        (2, "PUBLIC_DIRECTORY_INVALID_DATE"), (3, "PUBLIC_DIRECTORY_DUPLICATE_IDENTITY"), (4, "SZSE_WORKBOOK_COUNT_MISMATCH")}
    alone, _ = D.map_workbook_rows(df.filter("list = 1").drop("list"), counts.filter("list = 1"))
    assert alone.count() == 1


def test_one_cutoff_needs_no_loop_join(spark, dim):
    df = spark.createDataFrame([(dt.date(2026, 9, 30),)], "date date")
    out = C.with_bar_completion(df, dim, F.lit(AS_OF).cast("timestamp"), "1d")
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.first().complete


def test_cluster_sessions_need_a_shared_folder(spark):
    if spark.conf.get("spark.checkpoint.dir", None):
        assert work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))
    else:
        assert work_dir(spark, "x")
