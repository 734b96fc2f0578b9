import datetime as dt
import random

from pyspark.sql import functions as F

from barloom import pytasks
from barloom.operators import archive as A
from barloom.streaming import read_log, stream_archive, stream_auction, stream_intraday
from barloom.sources import store as ST

BASE = dt.datetime(2026, 9, 30, 8)


def arrivals(spark, rows):
    data = [(k, n, BASE + dt.timedelta(seconds=s), p) for k, n, s, p in rows]
    return spark.createDataFrame(data, "key string, arrival_no long, fetched_at timestamp, payload string")


def brute_archive(rows):
    state = {}
    for k, n, s, p in sorted(rows, key=lambda r: r[1]):
        if k not in state:
            state[k] = [s, s, p, 0]
        elif s >= state[k][1]:
            state[k] = [state[k][0], s, p, state[k][3] + (p != state[k][2])]
    return {k: tuple(v) for k, v in state.items()}


def as_dict(df):
    sec = lambda t: int((t - BASE).total_seconds())
    return {r.key: (sec(r.first_fetched_at), sec(r.last_fetched_at), r.payload, r.revision_count) for r in df.collect()}


def random_rows(n, seed):
    rnd = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{i % 7}", i, rnd.randrange(60) + i // 4, rnd.choice("abc")) for i in range(n)]


def test_archive_fold_matches_one_by_one(spark):
    rows = random_rows(600, 1)
    assert as_dict(A.archive_upsert(arrivals(spark, rows), keys=["key"], bits=4)) == brute_archive(rows)


def test_archive_fold_onto_stored_rows(spark):
    rows = random_rows(400, 2)
    stored = A.archive_upsert(arrivals(spark, rows[:250]), keys=["key"], bits=5)
    out = A.archive_upsert(arrivals(spark, rows[250:]), stored, keys=["key"], bits=5)
    assert as_dict(out) == brute_archive(rows)


def test_archive_revision_cases(spark):
    rows = [("k", 0, 10, "a"), ("k", 1, 20, "b"), ("k", 2, 5, "c"), ("k", 3, 20, "b"), ("k", 4, 20, "d")]
    assert as_dict(A.archive_upsert(arrivals(spark, rows), keys=["key"])) == {"k": (10, 20, "d", 2)}


def brute_auction(rows):
    state = None
    for r, c, t, n in rows:
        if state is None or (r >= state[0] and c >= state[1] and t >= state[2]):
            state = (r, c, t, n)
    return state[3]


def test_block_steps_answer_every_entry_state():
    rnd = random.Random(3)
    for _ in range(200):
        rows = [(rnd.randrange(6), rnd.randrange(4), rnd.randrange(4), i) for i in range(rnd.randrange(1, 12))]
        steps = pytasks.reduce_block(rows)
        for _ in range(30):
            s = (rnd.randrange(7), rnd.randrange(5), rnd.randrange(5))
            state = (*s, None)
            for row in rows:
                if all(row[i] >= state[i] for i in range(3)):
                    state = row
            hits = [out for *step, out in steps if all(x >= y for x, y in zip(step, s))]
            assert (hits[0] if hits else (*s, None)) == state


def test_a_long_series_of_steps_streams_through_one_state():
    import itertools

    import pandas as pd

    n = 4096
    climbing = [(i, i, i, i) for i in range(n)]
    assert pytasks.reduce_block(climbing) == [(n - 1, n - 1, n - 1, climbing[-1])]
    # Receipts fall while times rise: no row hides another, each is a step of its own.
    apart = [(n - i, 5, i, i) for i in range(n)]
    assert [s[:3] for s in pytasks.reduce_block(apart)] == [row[:3] for row in apart]
    seen = itertools.count()

    def batches():
        for b in range(300):
            next(seen)
            rows = [("hot", b, r, c, t, *out) for r, c, t, out in pytasks.reduce_block([(b, 1, b, 2 * b), (b + 1, 1, b, 2 * b + 1)])]
            yield pd.DataFrame(rows, columns=["k", "block", "r", "c", "t", "out_r", "out_c", "out_t", "arrival_no"])

    out = pd.concat(pytasks.apply_steps(["k"])(batches()))
    assert out.values.tolist() == [["hot", 599]] and next(seen) == 300


def test_auction_fold_refuses_arrivals_without_clocks(spark):
    at = lambda m: BASE + dt.timedelta(minutes=m)
    day = dt.date(2026, 9, 30)
    rows = [("a", day, 0, at(1), 3, at(1)), ("a", day, 1, None, 9, at(2)), ("a", day, 2, at(2), None, at(2)), ("a", day, 3, at(2), 3, None), ("b", day, 4, None, 1, at(1))]
    df = spark.createDataFrame(rows, "symbol string, session_date date, arrival_no long, fetched_at timestamp, points int, source_timestamp timestamp")
    assert [(r.symbol, r.arrival_no) for r in A.fold_auction(df).collect()] == [("a", 0)]


def test_auction_fold_matches_one_by_one(spark):
    rnd = random.Random(4)
    rows = [("hot" if i % 2 else f"s{i % 5}", i, 100 + i // 3 - rnd.randrange(8), rnd.randrange(1, 17), rnd.randrange(16)) for i in range(800)]
    day = dt.date(2026, 9, 30)
    df = spark.createDataFrame(
        [(s, day, n, BASE + dt.timedelta(seconds=r), c, BASE + dt.timedelta(minutes=t)) for s, n, r, c, t in rows],
        "symbol string, session_date date, arrival_no long, fetched_at timestamp, points int, source_timestamp timestamp")
    got = {r.symbol: r.arrival_no for r in A.fold_auction(df, bits=4).collect()}
    want = {s: brute_auction([(r, c, t, n) for s2, n, r, c, t in rows if s2 == s]) for s in {x[0] for x in rows}}
    assert got == want


def test_snapshot_ages(spark):
    now = BASE + dt.timedelta(days=8)
    rows = [("new", 0, 86400 * 8 + 1, "x"), ("edge", 1, 86400, "y"), ("old", 2, 86399, "z")]
    latest = A.latest_snapshots(arrivals(spark, rows), F.lit(now), ["key"])
    assert {r.key for r in latest.collect()} == {"new", "edge"}
    assert {r.key for r in A.readable_snapshots(latest, F.lit(now)).collect()} == {"edge"}


def test_page_walk_covers_a_series_once(spark):
    df = spark.createDataFrame([("x", i, "p") for i in range(23)], "symbol string, source_timestamp long, payload string")
    seen, before = [], None
    while True:
        page = A.archive_page(df, {"symbol": "x"}, 5, before).collect()
        seen = [r.source_timestamp for r in page] + seen
        if not page[0].has_more:
            break
        assert page[0].next_before == page[0].source_timestamp
        before = F.lit(page[0].next_before)
    assert seen == list(range(23))


def test_stream_archive_over_several_batches(spark, tmp_path):
    rows = random_rows(300, 5)
    src, log, cp = (str(tmp_path / x) for x in ("in", "log", "cp"))
    schema = arrivals(spark, rows[:1]).schema
    for lo in range(0, 300, 100):
        arrivals(spark, rows[lo:lo + 100]).coalesce(1).write.mode("append").parquet(src)
        stream_archive(spark.readStream.schema(schema).parquet(src), log, cp, ["key"]).awaitTermination()
    assert as_dict(read_log(spark, log, ["key"])) == brute_archive(rows)


def test_stream_auction_over_several_batches(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(f"s{i % 3}", i, 100 + i // 3 - rnd.randrange(8), rnd.randrange(1, 17), rnd.randrange(16)) for i in range(150)]
    day = dt.date(2026, 9, 30)
    src, log, cp = (str(tmp_path / x) for x in ("in", "log", "cp"))
    schema = "symbol string, session_date date, arrival_no long, fetched_at timestamp, points int, source_timestamp timestamp"
    for lo in range(0, 150, 50):
        part = [(s, day, n, BASE + dt.timedelta(seconds=r), c, BASE + dt.timedelta(minutes=t)) for s, n, r, c, t in rows[lo:lo + 50]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream_auction(spark.readStream.schema(schema).parquet(src), log, cp).awaitTermination()
    got = {r.symbol: r.arrival_no for r in read_log(spark, log, ["symbol", "session_date"]).collect()}
    assert got == {s: brute_auction([(r, c, t, n) for s2, n, r, c, t in rows if s2 == s]) for s in got}


def test_stream_differences_carry_over_batches(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "symbol string, session_date date, source_timestamp timestamp, price double, cumulative_volume_shares double, cumulative_amount_cny double"
    day = dt.date(2026, 9, 30)
    volumes = [100.0, 250.0, 50.0, 80.0]
    for i, v in enumerate(volumes):
        spark.createDataFrame([("x", day, BASE + dt.timedelta(minutes=i), 1.0, v, v)], schema).coalesce(1).write.mode("append").parquet(src)
        q = stream_intraday(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp)
        q.trigger(availableNow=True).start().awaitTermination()
    got = [r.interval_volume_shares for r in spark.read.parquet(out).orderBy("source_timestamp").collect()]
    assert [None if x is None or x != x else x for x in got] == [None, 150.0, None, 30.0]


def test_archive_sink_layout(spark, tmp_path):
    df = spark.createDataFrame([("x", "1d", "none", 1, "p"), ("x", "1w", "qfq", 2, "q")], "symbol string, interval string, adjustment string, source_timestamp long, payload string")
    ST.write_archive(df, str(tmp_path / "archive"))
    assert (tmp_path / "archive" / "interval=1d" / "adjustment=none").is_dir()
    assert spark.read.parquet(str(tmp_path / "archive")).count() == 2
