"""Levelled tables, streaming state, and the plans that scale."""

import datetime as dt
import os
import random
import re
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from barloom.operators import archive as A, context, paging, selection, universe as U
from barloom.sources.versioned import VersionedTables
from barloom.streaming import read_log, stream_archive, stream_intraday

BASE = dt.datetime(2026, 9, 30, 8)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def size_of(df):
    return sum(os.path.getsize(urlparse(f).path) for f in df.inputFiles())


def rows(spark, data):
    return spark.createDataFrame(data, "k string, v long")


def content(df):
    return {r.k: r.v for r in df.collect()}


def test_newest_row_of_every_key_over_many_commits(spark, tmp_path):
    rnd, want = random.Random(1), {}
    t = VersionedTables(spark, str(tmp_path / "t"), ["k"], buckets=4)
    for version in range(9):
        new = {f"k{rnd.randrange(60)}": version * 1000 + i for i in range(rnd.choice((3, 40)))}
        want |= new
        t.commit(version, {"rows": (rows(spark, list(new.items())), ["k"])})
        assert content(t.read("rows")) == want
    runs = t.version().runs["rows"]
    assert all(len(listed) <= 4 and all(a > 2 * b for (_, a), (_, b) in zip(listed, listed[1:])) for listed in runs.values())


def test_bytes_read_do_not_grow_with_history(spark, tmp_path):
    t = VersionedTables(spark, str(tmp_path / "t"), ["k"], buckets=4)
    data = [(f"k{i}", i) for i in range(400)]
    t.commit(0, {"rows": (rows(spark, data), ["k"])})
    batch = rows(spark, data[:20])
    first = size_of(t.read_for("rows", batch, ["k"]))
    for version in range(1, 12):
        t.commit(version, {"rows": (rows(spark, [(k, version) for k, _ in data[:20]]), ["k"])})
        assert size_of(t.read_for("rows", batch, ["k"])) <= 2 * first
    one = rows(spark, [("k3", 0)])
    assert size_of(t.read_for("rows", one, ["k"])) < size_of(t.read("rows")) / 2


def test_a_commit_run_again_replaces_itself(spark, tmp_path):
    t = VersionedTables(spark, str(tmp_path / "t"), ["k"], buckets=2)
    t.commit(0, {"rows": (rows(spark, [("a", 1), ("b", 1)]), ["k"])})
    for _ in range(2):
        t.commit(1, {"rows": (rows(spark, [("a", 2), ("c", 2)]), ["k"])})
    assert content(t.read("rows")) == {"a": 2, "b": 1, "c": 2}
    assert content(t.read("rows", below=1)) == {"a": 1, "b": 1}


def test_a_failed_commit_leaves_the_version_before(spark, tmp_path):
    t = VersionedTables(spark, str(tmp_path / "t"), ["k"], buckets=2)
    t.commit(0, {"head": (rows(spark, [("a", 1)]), ["k"]), "rows": (rows(spark, [("a", 1), ("b", 1)]), ["k"])})
    bad = rows(spark, [("a", 3)]).withColumn("v", F.when(F.col("k") == "a", F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        t.commit(1, {"head": (rows(spark, [("a", 2)]), ["k"]), "rows": (bad, ["k"])})
    assert content(t.read("head")) == {"a": 1} and content(t.read("rows")) == {"a": 1, "b": 1}
    t.commit(1, {"head": (rows(spark, [("a", 2)]), ["k"]), "rows": (rows(spark, [("a", 2)]), ["k"])})
    assert content(t.read("head")) == {"a": 2} and content(t.read("rows")) == {"a": 2, "b": 1}


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = VersionedTables(spark, str(tmp_path / "t"), ["k"], buckets=8)
    t.commit(0, {"rows": (rows(spark, [(f"k{i}", 0) for i in range(80)]), ["k"])})
    before = t.version().runs["rows"]
    t.commit(1, {"rows": (rows(spark, [("k1", 1)]), ["k"])})
    after = t.version().runs["rows"]
    assert sum(before[b] != after[b] for b in after) == 1


def test_empty_and_null_keys(spark, tmp_path):
    t = VersionedTables(spark, str(tmp_path / "t"), ["k"], buckets=2)
    assert t.read("rows") is None
    t.commit(0, {"rows": (rows(spark, []), ["k"])})
    assert t.read("rows") is None and t.version().number == 0
    t.commit(1, {"rows": (rows(spark, [(None, 1), ("a", 1)]), ["k"])})
    t.commit(2, {"rows": (rows(spark, [(None, 2)]), ["k"])})
    assert content(t.read("rows")) == {None: 2, "a": 1}


def test_archive_arrivals_without_payload_or_receipt_change_nothing(spark):
    data = [("k", 0, 10, "p"), ("k", 1, None, "q"), ("k", 2, 5, "z"), ("k", 3, 12, None), ("only", 4, 3, None)]
    df = spark.createDataFrame([(k, n, None if s is None else BASE + dt.timedelta(seconds=s), p) for k, n, s, p in data],
                               "key string, arrival_no long, fetched_at timestamp, payload string")
    out = A.archive_upsert(df, keys=["key"]).collect()
    assert [(r.key, r.payload, r.last_fetched_at, r.revision_count) for r in out] == [("k", "p", BASE + dt.timedelta(seconds=10), 0)]


POINT = "symbol string, session_date date, source_timestamp timestamp, price double, cumulative_volume_shares double, cumulative_amount_cny double"


def test_session_state_expires_behind_the_watermark(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    kept = []
    for day, volume in ((0, 5.0), (0, 9.0), (1, 3.0), (5, 1.0), (5, 4.0)):
        at = BASE + dt.timedelta(days=day, minutes=int(volume))
        spark.createDataFrame([("x", at.date(), at, 1.0, volume, volume)], POINT).coalesce(1).write.mode("append").parquet(src)
        q = stream_intraday(spark.readStream.schema(POINT).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp)
        q = q.trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        sums = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
        kept.append(sums[-1]["numRowsTotal"])
    got = [r.interval_volume_shares for r in spark.read.parquet(out).orderBy("source_timestamp").collect()]
    assert got == [None, 4.0, None, None, 3.0]
    # Sessions of the first days are dropped once the watermark is far enough; one session is left.
    assert kept[-1] < kept[2]


def test_stream_reads_only_its_keys_buckets(spark, tmp_path):
    src, log, cp = (str(tmp_path / x) for x in ("in", "log", "cp"))
    schema = "key string, arrival_no long, fetched_at timestamp, payload string"
    for n in range(4):
        spark.createDataFrame([(f"k{i}", n * 10 + i, BASE + dt.timedelta(seconds=n), f"p{n}") for i in range(8)], schema).coalesce(1).write.mode("append").parquet(src)
        stream_archive(spark.readStream.schema(schema).parquet(src), log, cp, ["key"], buckets=4).awaitTermination()
    out = read_log(spark, log, ["key"]).collect()
    assert {(r.key, r.payload, r.revision_count) for r in out} == {(f"k{i}", "p3", 3) for i in range(8)}


def test_digest_is_one_aggregate_that_tells_multisets_apart(spark):
    data = [("a", i % 7) for i in range(300)] + [(None, 1), ("null", 1)]
    digest = lambda d: U.table_digest(rows(spark, d), ["k", "v"]).first().digest
    base = digest(data)
    mixed = list(data)
    random.Random(2).shuffle(mixed)
    assert digest(mixed) == base
    assert len({base, digest(data[:-1]), digest([*data, data[0]]), digest([("b", 0), *data[1:]]), digest([*data[:-2], (None, 1), (None, 1)]), digest([])}) == 6
    text = plan(U.table_digest(rows(spark, data), ["v"], ["k"]))
    assert "collect_list" not in text and "SortAggregate" not in text and "ObjectHash" not in text


def test_choices_are_ranks_cut_before_the_shuffle(spark):
    data = [(f"s{i % 3}", "a" if i % 2 else "b", BASE + dt.timedelta(seconds=i // 4), i % 5, None if i % 7 else "bad") for i in range(60)]
    c = spark.createDataFrame(data, "symbol string, source string, source_timestamp timestamp, request_latency_ms long, reason string")
    chosen = selection.select_quotes(c, F.lit(BASE + dt.timedelta(seconds=20)).cast("timestamp"))
    first = selection.keep_first(c, ["symbol"], F.col("request_latency_ms"))
    folded = A.archive_upsert(spark.createDataFrame([("k", 1, BASE, "p")], "key string, arrival_no long, fetched_at timestamp, payload string"), keys=["key"])
    for df in (chosen, first, folded):
        assert "SortAggregate" not in plan(df)
    assert "WindowGroupLimit" in plan(chosen) and "WindowGroupLimit" in plan(first)
    by = {}
    for s, src, at, ms, bad in data:
        if bad is None:
            by.setdefault(s, []).append((-at.timestamp(), ms, src))
    for r in chosen.collect():
        best = sorted(by[r.symbol])[:2]
        assert (r.request_latency_ms, r.source) == best[0][1:]
        assert (r.selection_reason == "EQUAL_SOURCE_TIMESTAMP_LOWER_REQUEST_LATENCY") == (best[0][0] == best[1][0])


@pytest.mark.parametrize("keys", [
    [*range(300), *[10**15 + 7 * i for i in range(40)], -(10**12)],
    [*[5] * 900, *range(100, 200), None, None],
    [f"s{i * 37 % 501:04d}" for i in range(501)],
])
def test_positions_without_a_single_task(spark, keys):
    kind = "string" if isinstance(keys[0], str) else "long"
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"key {kind}, n long")
    out = paging.with_position(df, "key", parts=8)
    assert "SinglePartition" not in plan(out)
    got = sorted((r.position, r.key) for r in out.collect()) if None not in keys else sorted(((r.position, r.key) for r in out.collect()), key=lambda x: x[0])
    assert [p for p, _ in got] == list(range(len(keys)))
    assert [k for _, k in got] == sorted(keys, key=lambda k: (k is not None, k if k is not None else 0))
    most = df.groupBy(paging.range_bucket(df, "key", 8).alias("b")).count().agg(F.max("count")).first()[0]
    assert most <= len(keys) / 2


def test_positions_of_an_empty_table(spark):
    df = spark.createDataFrame([], "key long")
    assert paging.with_position(df, "key").collect() == []


def test_ranks_keep_rows_without_a_change(spark):
    values = [3.0, None, 5.0, 3.0, -1.0, None, 5.0, 0.0]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "code string, change_percent double")
    out = context.rank_sectors(df, None)
    assert "SinglePartition" not in plan(out)
    got = {r.code: r.rank_descending for r in out.collect()}
    assert got == {str(i): None if v is None else 1 + sum(w > v for w in values if w is not None) for i, v in enumerate(values)}


def test_result_order_of_one_large_run(spark):
    data = [("run", f"s{i % 50:02d}{i:04d}", ["f"] if i % 3 == 0 else None if i % 3 == 1 else []) for i in range(400)]
    df = spark.createDataFrame(data, "run string, symbol string, risk_flags array<string>")
    got = {r.symbol: r.position for r in paging.result_order(df, ["run"], "symbol").collect()}
    want = sorted(data, key=lambda r: (bool(r[2]), r[1]))
    assert got == {r[1]: i for i, r in enumerate(want, 1)}
    assert re.search(r"hashpartitioning\(run", plan(paging.result_order(df, ["run"], "symbol")))
