import json

from pyspark.sql import functions as F

from barloom.functions import decode_entities, normalize_symbol, parse_stamp, shanghai_text, strict_number
from barloom.operators import context as X, selection as S, universe as U
from barloom.sources import bars as B, captures as K, quotes as Q, sectors as SEC

NOW = "2026-09-30T16:00:00+08:00"


def at(text=NOW):
    return F.lit(text).cast("timestamp")


def captures(spark, rows, columns="capture_id string, symbol string, body string"):
    return spark.createDataFrame(rows, columns).withColumn("fetched_at", at())


def tilde(code, **over):
    f = [""] * 49
    f[1], f[2], f[3], f[4], f[5], f[6] = "N", code, "10.50", "10.00", "10.10", "123"
    for i in range(5):
        f[9 + 2 * i], f[10 + 2 * i], f[19 + 2 * i], f[20 + 2 * i] = "10.4", "1", "10.6", "2"
    f[30], f[33], f[34], f[35], f[37], f[47], f[48] = "20260930150000", "10.80", "9.90", "10.5/123/129000", "12.9", "11.00", "9.00"
    for k, v in over.items():
        f[int(k[1:])] = v
    return "~".join(f)


def quote_reasons(spark, cases):
    rows = [(str(i), s, f'v_{s}="{body}";') for i, (s, body) in enumerate(cases)]
    out = Q.decode_quote_columns(captures(spark, rows), "tencent").orderBy(F.col("capture_id").cast("int")).collect()
    return out


def test_tilde_quotes(spark):
    ok, star, cdr, blank, late, feb, limit = quote_reasons(spark, [
        ("sh600522", tilde("600522")), ("sh688001", tilde("688001")), ("sh689009", tilde("689009")), ("sh600522", tilde("600522", f33="")),
        ("sh600522", tilde("600522", f30="20260930160006")), ("sh600522", tilde("600522", f30="20260230150000")), ("sh600522", tilde("600522", f3="10.80", f47="10.80"))])
    assert (ok.reason, ok.volume_shares, ok.amount_cny, ok.price_relation) == (None, 12300.0, 129000.0, "between_limits")
    assert ok.book.bids[0].volume_shares == 100.0 and len(ok.book.asks) == 5
    assert star.volume_shares == 123.0
    assert cdr.reason == "TENCENT_VOLUME_UNIT_UNVERIFIED_FOR_CDR"
    assert blank.reason == "INVALID_QUOTE_VALUES"
    assert late.reason == "FUTURE_SOURCE_TIMESTAMP" and feb.reason == "INVALID_SOURCE_TIMESTAMP"
    assert limit.price_relation == "at_upper_limit"


def test_limits_must_be_whole_cents_and_not_beijing(spark):
    rows = [("sh600000", 10.5, 10.8, 9.9, 11.001, 9.0), ("bj430001", 10.5, 10.8, 9.9, 11.0, 9.0), ("sh600000", 10.5, 11.2, 9.9, 11.0, 9.0)]
    df = spark.createDataFrame(rows, "symbol string, price double, high double, low double, _up double, _down double")
    assert [r.price_relation for r in Q.price_limits(df).collect()] == [None, None, None]


def day_json(symbol, rows, key="qfqday", code=0):
    return json.dumps({"code": code, "data": {symbol: {key: rows}}})


def history(spark, dim, body, **kw):
    return B.decode_history(captures(spark, [("c", "sh600522", body)]), "tencent", dim, at(), "1d", "qfq", **kw)


def test_history_is_all_or_nothing(spark, dim):
    row = lambda d, c="10": [d, c, c, "11", "9", "5"]
    good, bad = history(spark, dim, day_json("sh600522", [row("2026-09-29"), row("2026-09-30")]))
    assert [r.volume_shares for r in good.collect()] == [500.0, 500.0] and bad.count() == 0
    cases = {
        "INVALID_OR_DUPLICATE_BAR_DATE": [row("2026-09-29"), row("2026-09-29")],
        "FUTURE_BAR_DATE": [row("2026-09-30"), row("2026-10-09")],
        "BAR_ON_NONTRADING_DATE": [row("2026-09-26"), row("2026-09-30")],
        "INVALID_BAR_VALUES": [row("2026-09-30", "12")],
        "INVALID_SOURCE_NUMBER": [row("2026-09-30", "")],
    }
    for code, rows in cases.items():
        good, bad = history(spark, dim, day_json("sh600522", rows))
        assert good.count() == 0 and [r.reason for r in bad.collect()] == [code], code
    # No silent fall back to unadjusted bars, negative adjusted prices are legal.
    assert history(spark, dim, day_json("sh600522", [row("2026-09-30")], key="day"))[1].first().reason == "HISTORY_OR_REQUESTED_ADJUSTMENT_UNAVAILABLE"
    assert history(spark, dim, day_json("sh600522", [["2026-09-30", "-2", "-2", "-1", "-3", "5"]]))[0].count() == 1


def test_bulk_decode_needs_no_shuffle(spark, dim):
    good, _ = history(spark, dim, day_json("sh600522", [["2026-09-30", "10", "10", "11", "9", "5"]]))
    plan = good._jdf.queryExecution().executedPlan().toString()
    body = plan[plan.rindex("Generate"):] if "Generate" in plan else plan
    assert "hashpartitioning" not in body.split("Scan")[0]


def test_minute_bars_boundary_and_limit(spark):
    rows = [{"day": f"2026-09-30 15:0{i}:00", "open": "1", "high": "2", "low": "1", "close": "1", "volume": "5"} for i in range(5)]
    df = captures(spark, [("c", "sh600522", f"x=({json.dumps(rows)});")])
    good, _ = B.decode_minute_bars(df, at("2026-09-30T15:03:03+08:00"), 2)
    out = good.orderBy("source_timestamp").collect()
    assert [r.source_timestamp.minute for r in out] == [1, 2] and out[0].excluded == 2
    assert B.decode_minute_bars(df, at("2026-09-30T14:00:00+08:00"), 2)[1].first().reason == "NO_COMPLETED_BARS"


def test_session_order_and_reset(spark):
    doc = lambda pts: json.dumps({"code": 0, "data": {"sh600522": {"data": {"date": "20260930", "data": pts}}}})
    good, _ = B.decode_intraday(captures(spark, [("c", "sh600522", doc(["0930 10 1 1000", "0931 10 3 2500", "0932 10 2 2600", "1600 1 9 9000"]))]), at())
    out = good.orderBy("source_timestamp").collect()
    assert [r.interval_volume_shares for r in out] == [None, 200.0, None]
    assert out[1].average_price_cny == 2500 / 300
    _, bad = B.decode_intraday(captures(spark, [("c", "sh600522", doc(["0931 10 1 1", "0930 10 2 2"]))]), at())
    assert bad.first().reason == "INVALID_INTRADAY_ORDER_OR_VALUES"


def test_auction_blank_is_null_not_zero(spark):
    doc = json.dumps({"rc": 0, "data": {"code": "600522", "market": 1, "trends": ["2026-09-30 09:14,1,1,1,1,1,1", "2026-09-30 09:15,1,1,1,1,,", "2026-09-30 09:30,1,1,1,1,3,9"]}})
    good, _ = B.decode_auction(captures(spark, [("c", "sh600522", doc)]), at())
    assert [r.reported_volume_shares for r in good.orderBy("source_timestamp").collect()] == [None, 300.0]


def test_sector_order_is_checked(spark):
    item = lambda c, p: {"f2": 1.5, "f3": p, "f4": 0.1, "f12": c, "f13": 90, "f14": "n", "f297": 20260930}
    doc = lambda items: json.dumps({"rc": 0, "data": {"total": len(items), "diff": items}})
    rows = [("up", "", doc([item("BK0001", 1.0), item("BK0002", 2.0)])), ("down", "", doc([item("BK0001", 2.0), item("BK0002", 1.0)])), ("twice", "", doc([item("BK0001", 2.0)] * 2))]
    good, bad = SEC.decode_ranked_sectors(captures(spark, rows), "leaders")
    assert {r.capture_id for r in good.collect()} == {"down"}
    assert {r.capture_id: r.reason for r in bad.collect()} == {"up": "INVALID_SECTOR_SORT", "twice": "INVALID_SECTOR_ID"}


def test_ranks_only_for_the_known_taxonomy_size(spark):
    sectors = spark.range(49).selectExpr("concat('c', id) code", "concat('n', id) name", "CAST(id div 2 AS double) change_percent")
    members = spark.createDataFrame([("s1", "c48", "n48"), ("s2", "c0", "other"), ("s3", "zz", "x")], "symbol string, code string, name string")
    out = {r.symbol: r for r in X.stock_sector_context(members, sectors).collect()}
    assert out["s1"].rank_descending == 1 and out["s2"].error == "MEMBERSHIP_SECTOR_LABEL_MISMATCH" and out["s3"].error == "MEMBERSHIP_NOT_IN_SECTOR_UNIVERSE"
    assert X.stock_sector_context(members, sectors.limit(48)).filter("rank_descending IS NOT NULL").count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("&lt;A&amp;B&gt;",), ("&amp;lt;",), ("&#x4e2d;&#25991;",), ("&#xd800;",), ("plain",)], "t string")
    assert [r[0] for r in df.select(decode_entities(F.col("t"))).collect()] == ["<A&B>", "&lt;", "中文", None, "plain"]
    raw = spark.createDataFrame([(bytearray("中文".encode("gb18030")),), (bytearray(b"ascii"),)], "b binary")
    assert [r[0] for r in raw.select(K.decode_text(F.col("b"), "gb18030")).collect()] == ["中文", "ascii"]
    codes = spark.createDataFrame([(" 600522 ",), ("000001.SZ",), ("430001",), ("sh900001",), ("abc",)], "s string")
    assert [r[0] for r in codes.select(normalize_symbol(F.col("s"))).collect()] == ["sh600522", "sz000001", "bj430001", None, None]


def candidates(spark, rows):
    df = spark.createDataFrame(rows, "symbol string, source string, t string, request_latency_ms long, reason string")
    return df.withColumn("source_timestamp", F.col("t").cast("timestamp")).drop("t")


def test_quote_choice_reasons(spark):
    t = "2026-09-30T15:59:50+08:00"
    old = "2026-09-30T15:00:00+08:00"
    rows = [("tie", "tencent", t, 50, None), ("tie", "sina", t, 40, None), ("one", "tencent", t, 50, None), ("one", "sina", t, 1, "INVALID_QUOTE_OHLC"),
            ("new", "tencent", t, 50, None), ("new", "sina", old, 1, None), ("stale", "sina", old, 1, None), ("none", "sina", t, 1, "X")]
    out = {r.symbol: (r.source, r.selection_reason) for r in S.select_quotes(candidates(spark, rows), at()).collect()}
    assert out == {"tie": ("sina", "EQUAL_SOURCE_TIMESTAMP_LOWER_REQUEST_LATENCY"), "one": ("tencent", "ONLY_VALID_SOURCE"),
                   "new": ("tencent", "NEWEST_VALID_SOURCE_TIMESTAMP"), "stale": ("sina", "NEWEST_VALID_BUT_STALE"), "none": (None, "NO_VALID_SOURCE")}


def test_name_resolution_conflicts(spark):
    names = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), ("E",)], "lookup_name string")
    rows = [("A", "s1", "A", False), ("B", "s2", "B", False), ("B", "s3", "B", False), ("C", "s4", "CX", False), ("D", "s5", "D", False), ("D", "s5", "OTHER", False), ("E", "s6", "E", True)]
    got = {r.lookup_name: (r.symbol, r.error) for r in S.resolve_names(names, spark.createDataFrame(rows, "lookup_name string, symbol string, candidate_name string, truncated boolean")).collect()}
    assert got == {"A": ("s1", None), "B": (None, "STOCK_NAME_AMBIGUOUS"), "C": (None, "STOCK_NAME_NOT_FOUND"), "D": (None, "STOCK_NAME_AMBIGUOUS"), "E": (None, "STOCK_SEARCH_TRUNCATED")}


def directory(spark, rows):
    df = spark.createDataFrame(rows, "symbol string, name string")
    from barloom.functions import supported_symbol, ticker_parts

    return df.select("symbol", "name", ticker_parts(F.col("symbol")).alias("p"), F.lit("a-share").alias("asset_type"), supported_symbol(F.col("symbol")).alias("market_data_supported"),
                     F.lit("2000-01-01").cast("date").alias("list_date")).select("*", "p.*").drop("p")


def test_universe_classes(spark):
    rows = [("sh600000", "a", "eligible_mainboard_non_st"), ("sh600001", "＊ＳＴ b", "excluded_st_name"), ("sh688001", "ST c", "excluded_other_boards"), ("sz300001", "d", "excluded_other_boards"),
            ("sz001001", "e", "excluded_other_boards"), ("sz001200", "f", "eligible_mainboard_non_st"), ("bj430001", "g", "excluded_other_boards"), ("sz000000", "h", "unclassified"), ("sh900001", "*ST i", "unsupported")]
    out = U.classify_universe(directory(spark, [r[:2] for r in rows]))
    assert {r.symbol: r.classification for r in out.collect()} == {r[0]: r[2] for r in rows}
    c = U.partition_counts(out).first()
    assert c.provider_rows == sum(c[k] for k in U.CLASSES) == 9


def test_digest_ignores_order_but_not_content(spark):
    a = spark.createDataFrame([(i, str(i)) for i in range(200)], "n long, t string")
    digest = lambda df: U.table_digest(df, ["n", "t"]).first().digest
    assert digest(a) == digest(a.orderBy(F.rand(1)).repartition(7))
    assert digest(a) != digest(a.withColumn("t", F.when(F.col("n") == 5, "x").otherwise(F.col("t"))))
    assert digest(a) != digest(a.union(a.limit(1)))


def test_duplicate_identity_rejects_the_whole_directory(spark):
    d = directory(spark, [("sh600000", "a"), ("sh600000", "a"), ("sh600001", "b")])
    rows, rejected = U.build_universe(d)
    assert rows.count() == 0 and rejected.first().reason == "MAINBOARD_DIRECTORY_DUPLICATE_IDENTITY"


def test_curated_pool_hash_gate(spark):
    d = U.classify_universe(directory(spark, [("sh600000", "a"), ("sh600001", "*ST b")]))
    pool = d.select("symbol", "name")
    right = U.table_digest(pool, ("symbol", "name")).first().digest
    admitted, rejected = U.curated_pool(pool, d, right)
    assert [r.symbol for r in admitted.collect()] == ["sh600000"] and rejected.count() == 1
    assert U.curated_pool(pool, d, "0" * 64)[0].count() == 0
